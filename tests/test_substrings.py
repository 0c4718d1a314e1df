"""Very many spellings and models: equal results to trying each, and a cost that hardly depends on their number."""

import time

from pyspark.sql import functions as F

from pricetide.operators import identify, match, substrings
from pricetide.plans.quote import QuoteJob
from pricetide.sources import dictionary


def test_containing_against_brute_force(spark):
    texts = ["", "A", "AB", "ABABAB", "ノースABCDEFGHIJ", "ABCDEFGHIX", "x" * 5000 + "END", None, "AB"]
    needles = ["", None, "A", "BA", "ABCDEFGH", "ABCDEFGHI", "ABCDEFGHIJ", "ノース", "END", "AB"]
    t = spark.createDataFrame([(i % 2, v) for i, v in enumerate(texts)], "k int, t string")
    n = spark.createDataFrame([(i % 2, i, v) for i, v in enumerate(needles)], "k int, i int, n string")
    pairs = substrings.containing(t.select("t"), n.select("i", "n"), "t", "n").collect()
    want = {(a, i) for a in texts if a for i, b in enumerate(needles) if b and b in a}
    assert len(pairs) == len(want) and {(r.t, r.i) for r in pairs} == want
    keyed = substrings.containing(t, n, "t", "n", ["k"], reach=3).collect()
    want = {(j % 2, a, i) for j, a in enumerate(texts) if a for i, b in enumerate(needles) if b and b in a and i % 2 == j % 2}
    assert len(keyed) == len(want) and {(r.k, r.t, r.i) for r in keyed} == want
    assert substrings.containing(t, n.limit(0), "t", "n", ["k"]).count() == 0
    assert substrings.containing(t.select("t"), n.select("n").limit(0), "t", "n").count() == 0


def tags(spark, count):
    return spark.range(count).select(
        F.col("id").alias("tag_id"),
        F.concat_ws("\n", F.concat(F.lit("maker "), F.lpad((F.col("id") * 37 % 100_000).cast("string"), 6, "0")),
                    F.when(F.col("id") % 3 == 0, F.lit("THE NORTH FACE JACKET")), F.lit("ND91841")).alias("text"))


def grown(spark, size):
    more = spark.range(size).select(
        F.concat(F.lit("Maker"), F.col("id").cast("string")).alias("canonical"),
        F.concat(F.lit("maker "), F.lpad(F.col("id").cast("string"), 6, "0")).alias("alias"))
    return dictionary.brand_aliases(spark).select("canonical", "alias").unionByName(more)


def test_fixed_dictionary_as_a_table_gives_the_same(spark):
    rows = spark.createDataFrame(
        [(1, "THE NORTH FACE\nND91841"), (2, "patagonia シェル"), (3, "無地"), (4, ""), (5, None), (5, "ユニクロ THE NORTH FACE")],
        "tag_id int, text string")
    hints = spark.createDataFrame(
        [(1, "ノースフェイス"), (2, ""), (3, " Nowhere "), (4, None)], "tag_id int, brand string").select(
        "*", *[F.array().cast("array<string>").alias(c) for c in ("model_numbers", "sizes", "materials")],
        F.lit(None).cast("string").alias("made_in"))
    for given in (None, hints):
        want = identify.identify(rows, given).collect()
        got = identify.identify(rows, given, spellings=dictionary.brand_aliases(spark)).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_hundred_thousand_spellings(spark):
    def seconds(spellings):
        best = []
        for _ in range(2):
            begin = time.perf_counter()
            identify.identify(tags(spark, 40_000), spellings=spellings).write.format("noop").mode("overwrite").save()
            best.append(time.perf_counter() - begin)
        return min(best)

    many = grown(spark, 100_000)
    got = identify.identify(tags(spark, 3_000), spellings=many).select("tag_id", "brand.canonical").collect()
    assert len(got) == 3_000
    # the longest spelling counts: THE NORTH FACE has more letters than MAKER 000037
    face = next(name for name, alias in dictionary.ordered_aliases() if alias.upper() == "THE NORTH FACE")
    assert all(r.canonical == (face if r.tag_id % 3 == 0 else f"Maker{r.tag_id * 37 % 100_000}") for r in got)
    few, all_ = seconds(dictionary.brand_aliases(spark)), seconds(many)
    print(f"82 spellings {few:.1f} s, 100,082 spellings {all_:.1f} s")
    assert all_ < 3 * few


def test_quote_of_hundred_thousand_models(spark):
    listings = spark.range(6_000).select(
        (F.col("id") % 2).alias("quote_id"), F.lit("yahoo").alias("source"), F.col("id").alias("pos"),
        F.concat(F.lit("コート AB-"), F.lpad((F.col("id") * 31 % 200_000).cast("string"), 7, "0")).alias("title"),
        (F.lit(1000) + F.col("id")).alias("price"))
    options = spark.range(2).select(F.col("id").alias("quote_id"))
    models = F.transform(F.sequence(F.lit(0), F.lit(99_999)), lambda i: F.concat(F.lit("ab"), F.lpad(i.cast("string"), 7, "0")))
    targets = spark.range(1).select(F.lit(0).cast("bigint").alias("quote_id"), F.lit(None).cast("string").alias("brand"),
                                    models.alias("model_numbers"))
    job = QuoteJob(listings, options, targets, many_models=True)
    got = job.classified.select("quote_id", "pos", "tier").collect()
    assert len(got) == 6_000
    assert all(r.tier == ("model" if r.quote_id == 0 and r.pos * 31 % 200_000 < 100_000 else "loose") for r in got)
    few = targets.withColumn("model_numbers", F.slice("model_numbers", 1, 2_000))
    now, before = (QuoteJob(listings, options, few, many_models=flag).quotes.orderBy("quote_id").collect() for flag in (True, False))
    assert now == before and now[0].n_model > 0
    # no array of models travels with the listings
    assert match.without_models(match.complete_targets(few)).first().models == []


def test_least_of_a_basis_by_quote(spark):
    rows = [(q, "yahoo", f"ND91841 {i}", 5000 + i) for q in range(4) for i in range(4)]
    listings = spark.createDataFrame(rows, "quote_id int, source string, title string, price bigint")
    options = spark.createDataFrame([(0, 5), (1, 4), (2, None), (3, 0)], "quote_id int, min_basis_count int")
    targets = spark.createDataFrame([(q, "", ["ND91841"]) for q in range(4)], "quote_id int, brand string, model_numbers array<string>")
    for wide in (False, True):
        job = QuoteJob(listings, options, targets, wide=wide)
        assert {r.quote_id: r.basis_tier for r in job.quotes.collect()} == {0: "all", 1: "model", 2: "model", 3: "model"}


def test_pieces_of_no_needle_go_no_further(spark):
    needles = spark.range(40).select(F.lit(1).alias("k"), F.format_string("MD%05d", "id").alias("piece"))
    mark = substrings.marks(needles, ["k"]).first().marks
    assert len(mark) == substrings.MARK_WORDS and 0 < sum(bin(w % 2**64).count("1") for w in mark) <= 40
    titles = spark.range(4_000).select(F.lit(1).alias("k"), F.format_string("BRAND12GREENCOATMD%05dまとめ売り", "id").alias("t"))
    cut = titles.join(substrings.marks(needles, ["k"]), "k").select(
        "t", F.explode(substrings.marked_pieces(F.col("t"), F.array(F.lit(7), F.lit(3)), F.col("marks"))).alias("p"))
    # of 50 pieces a title hardly one is left, and all that are needles are
    assert cut.count() < 6_000
    assert cut.join(needles, F.col("p.piece") == F.col("piece")).count() == 40
    assert substrings.containing(titles, needles.withColumnRenamed("piece", "n"), "t", "n", ["k"]).count() == 40
