import pytest
from pyspark.sql import functions as F

from pricetide.operators import clean, match
from pricetide.functions import text as tx


@pytest.fixture
def reasons(spark):
    def run(rows, **options):
        """rows: (title, price) -> reasons in order."""
        given = {"query": "", "exclude_words": [], **options}
        kinds = {"query": "string", "exclude_words": "array<string>", "price_min": "bigint", "price_max": "bigint",
                 "use_default_excludes": "boolean"}
        schema = "quote_id int, " + ", ".join(f"{k} {kinds[k]}" for k in given)
        terms = clean.complete_options(spark.createDataFrame([(1, *given.values())], schema))
        df = spark.createDataFrame([(1, i, t, p) for i, (t, p) in enumerate(rows)],
                                   "quote_id int, i int, title string, price bigint")
        df = df.withColumn("t", tx.nfkc(F.col("title"))).withColumn("t", tx.squeeze(F.col("t")))
        out = df.join(terms, "quote_id").select("i", clean.exclusion_reason(
            F.col("t"), F.col("price"), F.col("price_min"), F.col("price_max"), F.col("rules_on"),
            F.col("exclude_words")).alias("r")).orderBy("i")
        return [r["r"] for r in out.collect()]

    return run


def test_default_rules(reasons):
    rows = [("古着 まとめ売り 10点", 5000), ("ジャンク品 ダウン", 5000), ("スーツ セットアップ 美品", 5000),
            ("Tシャツ 3枚セット", 5000), ("ダウン やや傷や汚れあり L", 5000), ("ダウン", 100), ("ダウン", 9_000_000),
            ("レプリカ", 5000), ("子供服", 5000), ("ＤＶＤ付き", 5000), ("タグのみ", 5000)]
    assert reasons(rows) == ["まとめ売り", "難あり", None, "セット売り", None, "下限価格(300円)未満",
                             "上限価格(3,000,000円)超", "レプリカ/真贋", "対象違い", "商品違い", "本体でない"]


def test_query_switches_its_own_rule_off(reasons):
    assert reasons([("キッズ ダウン 120", 5000), ("まとめ売り", 5000)], query="キッズ ダウン") == [None, "まとめ売り"]


def test_user_words_are_plain_text(reasons):
    got = reasons([("ジュニア ダウン", 5000), ("abc ダウン", 5000), ("A.C ダウン", 5000)], exclude_words=["ジュニア", " a.c", ""])
    assert got == ["除外語: ジュニア", None, "除外語: a.c"]


def test_defaults_can_be_off_and_zero_means_default_bound(reasons):
    assert reasons([("まとめ売り", 5000), ("x", 200)], use_default_excludes=False, price_min=0) == [
        None, "下限価格(300円)未満"]


def test_crossed_bounds_are_rejected(spark):
    rows = spark.createDataFrame([(1, 500, 400), (2, 500, None), (3, 400, 500)],
                                 "quote_id int, price_min bigint, price_max bigint")
    valid, rejects = clean.split_by_validity(rows)
    assert [r.quote_id for r in rejects.collect()] == [1]
    assert sorted(r.quote_id for r in valid.collect()) == [2, 3]


@pytest.fixture
def tiers(spark):
    def run(titles, brand, models):
        targets = spark.createDataFrame([(1, brand, models)], "quote_id int, brand string, model_numbers array<string>")
        df = spark.createDataFrame([(1, i, t) for i, t in enumerate(titles)], "quote_id int, i int, title string")
        df = df.withColumn("n", tx.nfkc(F.col("title"))).withColumn("f", tx.fold_normal(F.col("n")))
        out = df.join(match.complete_targets(targets), "quote_id").select(
            "i", match.match_tier(F.col("f"), F.col("models"), F.col("model_lengths"),
                                  F.col("model_starts"), F.col("aliases")).alias("t"))
        return [r["t"] for r in out.orderBy("i").collect()]

    return run


TITLES = ["THE NORTH FACE ヌプシ ND91841 L", "ノースフェイス ND-91841 ダウン", "ノースフェイス ND 91841 ダウン",
          "ノースフェイス ヌプシ 700 M", "THE NORTH FACE マウンテンパーカー", "アディダス ジャージ上下", ""]
EXPECTED = ["model"] * 3 + ["brand"] * 2 + ["loose"] * 2


def test_tiers(tiers):
    assert tiers(TITLES, "ノースフェイス", ["ND91841"]) == EXPECTED


def test_tiers_with_very_many_models_take_the_hashed_way(tiers):
    many = [f"QQ{i:05d}" for i in range(500)] + ["ND-91841", "LONGER-123456"]
    assert tiers([*TITLES, "x longer123456 y"], "TNF", many) == [*EXPECTED, "model"]


def test_short_models_do_not_count(tiers):
    assert tiers(["ノースフェイス 501 デニム"], None, ["501"]) == ["loose"]


def test_brand_spellings(spark):
    names = spark.createDataFrame([("ノースフェイス",), ("THE NORTH FACE",), ("架空ブランド",), ("",)], "brand string")
    got = {r.brand: r.aliases for r in match.expand_brand(names).collect()}
    assert "TNF" in got["ノースフェイス"] and "ノースフェイス" in got["THE NORTH FACE"]
    assert got["架空ブランド"] == ["架空ブランド"] and got[""] == []


def test_basis(spark):
    rows = [(True, 3, 1, "model"), (True, 1, 2, "brand"), (True, 0, 1, "all"), (False, 9, 9, "all")]
    df = spark.createDataFrame(rows, "h boolean, m int, b int, want string")
    got = df.select("want", match.choose_basis(F.col("h"), F.col("m"), F.col("b")).alias("got")).collect()
    assert all(r.want == r.got for r in got)
