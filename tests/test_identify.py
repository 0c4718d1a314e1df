import pytest
from pyspark.sql import functions as F

from pricetide.operators import identify

TAG = "THE NORTH FACE\nND91841\nヌプシ ジャケット\nSIZE: L\n表地 ナイロン100%\n中わた ダウン90%\nMADE IN CHINA"
TEXTS = {
    "tag": TAG, "tnf": "THE NORTH FACE", "pata": "patagonia", "levis": "Levi's", "kana": "ノースフェイス ダウン",
    "wip": "CARHARTT WIP", "coat": "ステンカラーコート", "retro": "patagonia\nRETRO-X\n23056\nSIZE M",
    "501": "Levi's\n501\nW32 L34", "kids": "ユニクロ\nキッズ ダウンジャケット\n120", "label": "SIZE 1234",
    "size m": "サイズ M", "line": "ダウンジャケット\nXL", "made": "ステンカラーコート\n日本製", "empty": "", "null": None,
    "coat m": "ステンカラーコート\nサイズ M", "champ": "CHAMPION", "gu": "GU\n336N004N\n331-359039 (62-06)",
    "kana code": "ヌプシND91841", "long code": "ABCD-12345678901234", "note": "THE NORTH FACE\nSIZE L",
}


@pytest.fixture(scope="module")
def tags(spark):
    rows = [(k, t, "4901234567894" if k == "tag" else None, "ヌプシ" if k == "note" else None) for k, t in TEXTS.items()]
    df = spark.createDataFrame(rows, "tag_id string, text string, barcode string, note string")
    return identify.identify(df)


@pytest.fixture(scope="module")
def found(tags):
    return {r.tag_id: r for r in tags.collect()}


@pytest.fixture(scope="module")
def queries(tags):
    def run(**extras):
        out = {}
        for r in identify.search_queries(tags, **extras).orderBy("tag_id", "rank").collect():
            out.setdefault(r.tag_id, []).append(r.query)
        return out

    return run


def test_brands(found):
    want = {"tnf": "ノースフェイス", "pata": "パタゴニア", "levis": "リーバイス", "kana": "ノースフェイス"}
    assert {k: found[k].brand.canonical for k in want} == want
    assert found["wip"].brand.matched == "CARHARTT WIP"
    assert found["coat"].brand is None and found["empty"].brand is None


def test_models(found):
    want = {"tag": ["ND91841"], "retro": ["23056"], "501": ["501"], "kids": [], "label": [],
            "gu": ["336N004N", "331-359039"], "kana code": ["ND91841"], "long code": ["ABCD-12345678901234"]}
    assert {k: found[k].model_numbers for k in want} == want


def test_sizes(found):
    want = {"tag": ["L"], "size m": ["M"], "line": ["XL"], "501": ["W32L34"], "kids": ["120"]}
    assert {k: found[k].sizes for k in want} == want


def test_origin_materials_keywords(found):
    assert (found["tag"].made_in, found["made"].made_in) == ("CHINA", "日本製")
    assert found["tag"].materials == ["ナイロン", "ダウン"]
    assert found["tag"].keywords == ["ヌプシ", "ジャケット"]
    assert found["null"].keywords == [] and found["null"].model_numbers == []


def test_queries(queries):
    got = queries()
    assert got["tag"][:2] == ["ノースフェイス ND91841", "ND91841"] and "ノースフェイス" in got["tag"]
    assert (got["kids"][0], got["kids"][-1]) == ("ユニクロ キッズ ダウンジャケット 120", "キッズ ダウンジャケット")
    assert got["coat m"] == ["ステンカラーコート M", "ステンカラーコート"]
    assert "empty" not in got
    assert all(len(set(q)) == len(q) for q in got.values())


def test_extras(spark, tags):
    extras = spark.createDataFrame([("tag", "4901234567894", None), ("note", None, "ヌプシ")],
                                   "tag_id string, barcode string, note string")
    joined = tags.drop("barcode", "note").join(extras, "tag_id")
    rows = identify.search_queries(joined, barcode="barcode", note="note").orderBy("rank").collect()
    got = {k: [r.query for r in rows if r.tag_id == k] for k in ("tag", "note")}
    assert got["tag"][0] == "4901234567894"
    assert "ノースフェイス ヌプシ L" in got["note"]


def test_hints_win_over_text(spark):
    tags = spark.createDataFrame([(1, TAG), (2, TAG)], "tag_id int, text string")
    hints = spark.createDataFrame(
        [(1, "gu", ["336N004N", "336N004N"], ["M"], ["綿"], "ベトナム"), (2, "", [], [], [], None)],
        "tag_id int, brand string, model_numbers array<string>, sizes array<string>, materials array<string>, made_in string")
    first, second = identify.identify(tags, hints).orderBy("tag_id").collect()
    assert (first.brand.canonical, first.model_numbers, first.sizes) == ("ジーユー", ["336N004N"], ["M"])
    assert (first.materials, first.made_in) == (["綿"], "ベトナム")
    assert (second.brand.canonical, second.model_numbers, second.made_in) == ("ノースフェイス", ["ND91841"], "CHINA")


def test_canonical_brand(column_values):
    got = column_values(identify.canonical_brand, ["the north face", " 架空 ", "", None])
    assert got == ["ノースフェイス", "架空", None, None]


def test_urls(column_values):
    yahoo = column_values(lambda v: identify.search_page_url(F.lit("yahoo"), v), ["ヌプシ 700", "a!b'(c)~*+"])
    assert "closedsearch" in yahoo[0] and "%20700" in yahoo[0]
    assert "p=a!b'(c)~*%2B&" in yahoo[1]
    assert "status=sold_out" in column_values(lambda v: identify.search_page_url(F.lit("mercari"), v), ["x"])[0]
    assert column_values(lambda v: identify.search_page_url(F.lit("rakuma"), v), ["x"]) == [""]


def test_words_meet_no_cast(spark):
    df = spark.createDataFrame([("160",), ("L",), ("2 XL",), ("ND",), ("999",), ("",)], "v string")
    sizes = df.select(identify.as_size(F.col("v")).alias("s"))
    assert [r.s for r in sizes.collect()] == ["160", "L", None, None, None, None]
    plan = sizes._jdf.queryExecution().analyzed().toString().lower()
    # the one cast stands behind the test for digits
    assert plan.index("rlike") < plan.index("cast(") and "regexp_extract" not in plan


def test_one_file_of_tags_is_many_tasks(spark):
    tags = spark.range(1000).repartition(1).select(F.col("id").alias("tag_id"), F.lit(TAG).alias("text"))
    found = identify.identify(tags).select("tag_id", F.spark_partition_id().alias("task"))
    assert found.count() == 1000 and found.select("task").distinct().count() >= 8
