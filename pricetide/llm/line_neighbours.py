"""Line dedup with an edit bound of one word, by deletion neighbourhoods.

A line is its words (blanks between them do not matter). Lines with equal words are copies; two lines
of ``NEAR_WORDS`` words or more that differ by one inserted, deleted or replaced word are near copies.
Of copies the earliest line stays; a line with an earlier near copy goes. Earliest means smallest
doc_id (null last), then text hash, then place in the text.

1. Copies: one scan turns texts into a table of lines known by 128 hash bits, without any text; it
   shrinks to different lines with their earliest place.
2. Only lines that agree with another in their first or last half can be one word apart; a count of
   hashed halves (four per line) finds them. The others need no neighbourhood.
3. Every variant with one word left out is emitted as a hash key. Left-out words come from running
   XORs of word-at-place hashes, so a line of n words costs n steps.
4. Equal variants meet. Lines that lack a word at the same place are one replacement apart, all of
   them from each other, so each is paired with the earliest only. A line that equals another's
   variant is one deletion apart from it. No pairs of whole groups are made.
5. The edit distance of each pair is verified on the words, and a line with an earlier partner goes.

Defined results: a null text is one without lines; lines without a word are neither counted nor
dropped; rows that repeat an id and text are one document and get the same result; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.functions.text import bound, contains_any
from pricetide.llm.words import BLANKS, fresh, stored, text_key, written

NEAR_WORDS = 8
BROADCAST_LINES = 500_000


def tidy(line: Column) -> Column:
    """A line's words with one space between them; a pattern runs only on lines that are untidy."""
    untidy = contains_any(line, ["  ", "\t", "\x0b", "\f", "\r"])
    return F.trim(F.when(untidy, F.regexp_replace(line, BLANKS, " ")).otherwise(line))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, a and b (text key), place, line (tidy), h1 and h2 (line key): a row per line with a word."""
    cut = docs.select(docs["doc_id"].alias("doc_id"), text_key(docs["text"]).alias("k"), F.posexplode(
        F.split(F.coalesce(docs["text"], F.lit("")), "\n")).alias("place", "raw"))
    lines = cut.select("doc_id", "k.a", "k.b", "place", tidy(F.col("raw")).alias("line")).where("line <> ''")
    return lines.select("*", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))


def order() -> Column:
    """A line's rank among all lines, as a struct that compares field by field."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("a").alias("a"),
                    F.col("place").alias("place"))


def halves(line: Column, n: Column) -> Column:
    """Hashes of the halves of which a line of ``n`` words must share one with a line one word apart."""
    keys = []
    for m in (F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")):
        keys += [F.xxhash64(F.lit("first"), m, F.call_function("substring_index", line, F.lit(" "), m)),
                 F.xxhash64(F.lit("last"), m, F.call_function("substring_index", line, F.lit(" "), -m))]
    return F.array_distinct(F.array(*keys))


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, a, b, place, h1, h2 and halves (null for lines too short to have near copies); no text."""
    lines = lines_of(docs).withColumn(
        "n", F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    return lines.select("doc_id", "a", "b", "place", "h1", "h2",
                        F.when(F.col("n") >= NEAR_WORDS, halves(F.col("line"), F.col("n"))).alias("halves"))


def suspects(table: DataFrame) -> DataFrame:
    """h1 and h2 of lines that share a half with a different line."""
    keyed = table.where("halves is not null").select("h1", "h2", F.explode("halves").alias("half"))
    shared = keyed.groupBy("half").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high")
    return keyed.join(shared, "half").select("h1", "h2").distinct()


def with_words(docs: DataFrame, chosen: DataFrame, limit: int = BROADCAST_LINES) -> DataFrame:
    """h1, h2, rank and the words of the chosen lines (h1, h2, rank), read at their earliest place.

    Up to ``limit`` chosen lines are sent to all tasks; more of them meet the lines in a shuffle.
    """
    ours = chosen.select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), "rank")
    ours = F.broadcast(ours) if chosen.count() <= limit else ours
    here = lines_of(docs).withColumn("here", order()).select("h1", "h2", "here", "line")
    found = here.join(ours, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")) & (F.col("here") == F.col("rank")))
    # repeated rows bring the same place more than once
    return found.groupBy("h1", "h2").agg(F.min("rank").alias("rank"), F.split(F.first("line"), " ").alias("words"))


def variants(lines: DataFrame) -> DataFrame:
    """h1, h2, whole (key of the line), n, at and variant: the key of the line without its word ``at``."""
    words = lines.select("h1", "h2", F.size("words").alias("n"), F.posexplode("words").alias("at", "word")).select(
        "h1", "h2", "n", "at", F.xxhash64("word", "at").alias("here"), F.xxhash64("word", F.col("at") - 1).alias("left"))
    line = Window.partitionBy("h1", "h2")
    run = line.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = words.select("h1", "h2", "n", "at", "here", F.bit_xor("here").over(run).alias("upto"),
                          F.bit_xor("left").over(run).alias("upto_left"), F.bit_xor("here").over(line).alias("all"),
                          F.bit_xor("left").over(line).alias("all_left"))
    before = F.col("upto").bitwiseXOR(F.col("here"))
    after = F.col("all_left").bitwiseXOR(F.col("upto_left"))
    return summed.select("h1", "h2", "n", "at", F.col("all").alias("whole"), before.bitwiseXOR(after).alias("variant"))


def one_apart(x: Column, y: Column) -> Column:
    """Whether two word arrays are exactly one edit apart."""
    def replaced(a: Column, b: Column) -> Column:
        return F.size(F.filter(F.zip_with(a, b, lambda v, w: v != w), lambda differs: differs)) == 1

    def deleted(short: Column, long: Column) -> Column:
        # the first place where they part; from there on, long must run one word ahead
        part = F.coalesce(F.array_position(F.zip_with(short, F.slice(long, F.lit(1), F.size(short)), lambda v, w: v != w), True),
                          F.lit(0)).cast("int")
        at = F.when(part == 0, F.size(short) + 1).otherwise(part)
        return F.slice(short, at, F.size(short)) == F.slice(long, at + 1, F.size(long))

    return F.when(F.size(x) == F.size(y), replaced(x, y)).when(
        F.size(x) + 1 == F.size(y), deleted(x, y)).when(F.size(x) == F.size(y) + 1, deleted(y, x)).otherwise(F.lit(False))


def pairs(lines: DataFrame) -> DataFrame:
    """(h1, h2) of a line and (e1, e2) of an earlier one whose variants meet; not verified yet.

    ``lines`` has h1, h2, rank and words.
    """
    made = written(variants(lines), "variants")
    ranks = lines.select("h1", "h2", "rank")
    shared = made.groupBy("variant", "at", "n").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1")
    alike = stored(made.join(shared, ["variant", "at", "n"]).select("variant", "at", "n", "h1", "h2").join(ranks, ["h1", "h2"]))
    earliest = alike.groupBy("variant", "at", "n").agg(F.min(F.struct("rank", "h1", "h2")).alias("e"))
    replaced = alike.join(earliest, ["variant", "at", "n"]).where(F.col("rank") > F.col("e.rank")).select(
        "h1", "h2", F.col("e.h1").alias("e1"), F.col("e.h2").alias("e2"))
    short = made.where("at = 0").select(F.col("whole").alias("variant"), F.col("h1").alias("s1"), F.col("h2").alias("s2"),
                                        (F.col("n") + 1).alias("n"))
    met = made.join(short, ["variant", "n"]).select("h1", "h2", "s1", "s2").distinct()
    ranked = met.join(ranks, ["h1", "h2"]).join(
        ranks.withColumnsRenamed({"h1": "s1", "h2": "s2", "rank": "s_rank"}), ["s1", "s2"])
    later = F.col("rank") > F.col("s_rank")
    deleted = ranked.select(*[F.when(later, x).otherwise(y).alias(name) for name, x, y in (
        ("h1", F.col("h1"), F.col("s1")), ("h2", F.col("h2"), F.col("s2")),
        ("e1", F.col("s1"), F.col("h1")), ("e2", F.col("s2"), F.col("h2")))])
    return replaced.union(deleted).distinct()


def near_copies(lines: DataFrame) -> DataFrame:
    """h1 and h2 of the lines that have an earlier near copy, verified."""
    met = stored(pairs(lines))
    words = lines.select("h1", "h2", "words")
    both = met.join(words, ["h1", "h2"]).join(words.select(
        F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("words").alias("earlier")), ["e1", "e2"])
    return both.where(one_apart(F.col("words"), F.col("earlier"))).select("h1", "h2").distinct()


def judged(docs: DataFrame, limit: int = BROADCAST_LINES) -> DataFrame:
    """doc_id, a, b, place, copy and near: a row per line with a word."""
    texts = docs.select("doc_id", "text")
    table = written(line_table(texts), "lines")
    different = written(table.groupBy("h1", "h2").agg(F.min(order()).alias("rank")), "different-lines")
    chosen = stored(different.join(suspects(table), ["h1", "h2"]))
    near = stored(near_copies(stored(with_words(texts, chosen, limit)))).withColumn("near", F.lit(True))
    # written, so that the join below may split the rows of a line that very many documents share
    fates = written(different.join(near, ["h1", "h2"], "left"), "fates")
    told = table.select("doc_id", "a", "b", "place", "h1", "h2").join(fates, ["h1", "h2"])
    return written(told.select("doc_id", "a", "b", "place", (order() != F.col("rank")).alias("copy"),
                               F.coalesce("near", F.lit(False)).alias("near")), "judged-lines")


def summary(docs: DataFrame, limit: int = BROADCAST_LINES) -> DataFrame:
    """Per different (id, text): n_lines, n_copies, n_near and gone, the places of dropped lines in order."""
    def places(which: Column) -> Column:
        # sets, since repeated rows bring every place as often as they occur
        return F.collect_set(F.when(which, F.col("place")))

    copy, near = F.col("copy"), F.col("near")
    rows = judged(docs, limit).groupBy("doc_id", "a", "b").agg(
        F.size(places(F.lit(True))).cast("long").alias("n_lines"), F.size(places(copy)).cast("long").alias("n_copies"),
        F.sort_array(places(copy | near)).alias("gone"))
    return rows.withColumn("n_near", F.size("gone") - F.col("n_copies"))


def without(lines: Column, gone: Column) -> Column:
    """Lines but those at the places in ``gone`` (in order): the stretches between them, put together."""
    starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda g: g + 1))
    ends = F.concat(gone, F.array(F.size(lines)))
    return bound(lines, lambda all_: F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice(all_, s + 1, e - s))))


COUNTS = ["n_lines", "n_copies", "n_near"]


def attached(docs: DataFrame, limit: int = BROADCAST_LINES) -> tuple[DataFrame, dict[str, str]]:
    """The input's rows with their summary, and the names under which it stands."""
    names = ["doc_id", "a", "b", "gone", *COUNTS]
    of = dict(zip(names, fresh(*names)))
    key_a, key_b = fresh("a", "b")
    found = stored(summary(docs, limit)).select(*[F.col(n).alias(m) for n, m in of.items()])
    key = text_key(docs["text"])
    rows = docs.select("*", key["a"].alias(key_a), key["b"].alias(key_b))
    match = docs["doc_id"].eqNullSafe(F.col(of["doc_id"])) & (F.col(key_a) == F.col(of["a"])) & (F.col(key_b) == F.col(of["b"]))
    return rows.join(found, match, "left"), of


def deduped(docs: DataFrame, limit: int = BROADCAST_LINES) -> DataFrame:
    """The input's rows with ``text`` rid of dropped lines and n_lines, n_copies, n_near (names replaced)."""
    rows, of = attached(docs, limit)
    gone = F.col(of["gone"])
    text = F.when(F.size(gone) > 0, F.array_join(without(F.split(docs["text"], "\n"), gone), "\n")).otherwise(docs["text"])
    return rows.select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns if c not in COUNTS],
                       *[F.coalesce(of[c], F.lit(0)).cast("long").alias(c) for c in COUNTS])


def query(spark, sf_dir: str) -> DataFrame:
    """op8 over the whole ``documents`` table: which lines of each document go, by their places from 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows, of = attached(docs)
    counts = {c: F.coalesce(of[c], F.lit(0)).cast("long") for c in COUNTS}
    return rows.select(
        "doc_id", *[value.alias(c) for c, value in counts.items()],
        (counts["n_lines"] - counts["n_copies"] - counts["n_near"]).alias("n_kept"),
        F.coalesce(F.array_join(of["gone"], ","), F.lit("")).alias("gone"))


ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (
  SELECT r, doc_id, place,
         list_filter(string_split_regex(ls[place], '[ 	-
]+'), lambda x: x <> '') AS w
  FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS place FROM d)),
t AS (
  SELECT *, array_to_string(w, ' ') AS line, row_number() OVER (ORDER BY doc_id NULLS LAST, place) AS rank
  FROM l WHERE len(w) > 0),
u AS (SELECT line, arg_min(w, rank) AS w, min(rank) AS rank FROM t GROUP BY line),
v AS (
  SELECT line, rank, w, len(w) AS n, unnest(range(1, len(w) + 1)) AS cut FROM u WHERE len(w) >= {NEAR_WORDS}),
x AS (SELECT line, rank, n, cut, array_to_string(list_concat(w[1:cut - 1], w[cut + 1:]), ' ') AS variant FROM v),
e AS (SELECT variant, cut, n, min(rank) AS first FROM x GROUP BY ALL HAVING count(*) > 1),
near AS (
  SELECT DISTINCT line FROM x JOIN e USING (variant, cut, n) WHERE rank > first
  UNION
  SELECT CASE WHEN x.rank > u.rank THEN x.line ELSE u.line END FROM x JOIN u ON u.line = x.variant WHERE x.n > {NEAR_WORDS}),
f AS (
  SELECT t.r, t.place, t.rank <> u.rank AS copy, near.line IS NOT NULL AS near
  FROM t JOIN u USING (line) LEFT JOIN near USING (line)),
k AS (
  SELECT l.r, string_agg((place - 1)::VARCHAR, ',' ORDER BY place) FILTER (copy OR near) AS gone,
         count(copy) AS n_lines, count(*) FILTER (copy) AS n_copies, count(*) FILTER (NOT copy AND near) AS n_near
  FROM l LEFT JOIN f USING (r, place) GROUP BY l.r)
SELECT doc_id, n_lines, n_copies, n_near, n_lines - n_copies - n_near AS n_kept, coalesce(gone, '') AS gone
FROM d JOIN k USING (r)
"""
