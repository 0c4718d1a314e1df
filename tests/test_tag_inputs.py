import json

from pyspark.sql import functions as F

from pricetide.operators import barcode, hints, ocr_text
from pricetide.sources import ocr_output

CLEANED = {
    "THE NORTH FACE\nND91841": "THE NORTH FACE\nND91841",
    "THE NORTH FACE\n~|_.-\nND91841": "THE NORTH FACE\nND91841",
    "A\nND91841": "ND91841",
    "  THE   NORTH  FACE  ": "THE NORTH FACE",
    "ＮＤ９１８４１": "ND91841",
    "SIZE L\nSIZE L\nND91841": "SIZE L\nND91841",
    "SIZE L\nND91841\nSIZE L": "SIZE L\nND91841\nSIZE L",
    "ナイロン100%\n日本製": "ナイロン100%\n日本製",
    "": "",
    "|\n~\n--\n. .": "",
    "サイ ズ M": "サイズ M",
    "日 本 製": "日本製",
    "ウル トラ ライ ト ダ ウン": "ウルトラライトダウン",
    "ナイ ロン 100%": "ナイロン 100%",
    "331 -359039 (62-06)": "331-359039 (62-06)",
    "331- 359039": "331-359039",
    "ND 91841": "ND91841",
    "MADE IN CHINA": "MADE IN CHINA",
    "SIZE L": "SIZE L",
    "品番ND 91841": "品番ND91841",
}


def test_clean_text(spark):
    df = spark.createDataFrame(list(enumerate(CLEANED)), "i int, text string")
    got = [r.clean_text for r in ocr_text.clean_text(df).orderBy("i").collect()]
    assert got == list(CLEANED.values())


def test_missing_text(spark):
    df = spark.createDataFrame([(None,)], "text string")
    assert ocr_text.clean_text(df).first().clean_text == ""


def test_recognised_lines(spark):
    line = lambda text, confidence: {"text": text, "confidence": confidence}
    outputs = [
        {"photo_id": 1, "lines": [line("THE NORTH FACE", 80.0), line("GARBAGE", 29.0), line("ND 91841", 30.0), line("X", None)]},
        {"photo_id": 2, "lines": [], "blocks": [{"paragraphs": [{"lines": [line("ND91841", 50.0)]}, {"lines": None}]},
                                                {"paragraphs": None}]},
        {"photo_id": 3, "text": "PATAGONIA 23056"},
        {"photo_id": 4, "text": "abcde"},
    ]
    raw = spark.createDataFrame([(json.dumps(o),) for o in outputs], "j string")
    df = raw.select(F.from_json("j", ocr_output.SCHEMA).alias("o")).select("o.*")
    got = {r.photo_id: r.clean_text for r in ocr_text.read_lines(ocr_output.with_lines(df)).collect()}
    assert got == {1: "THE NORTH FACE\nND91841", 2: "ND91841", 3: "PATAGONIA 23056", 4: ""}


def test_pass_choice(spark):
    rows = [
        (1, 0, "probe", 0, 40.0), (1, 1, "probe", 90, 60.0), (1, 2, "probe", 180, 60.0),
        (1, 8, "variant", 90, 84.4), (1, 9, "variant", 90, 85.0), (1, 10, "variant", 90, 99.0),
        (2, 8, "variant", 0, 50.4), (2, 9, "variant", 0, 50.1), (2, 10, "variant", 0, None),
    ]
    df = spark.createDataFrame(rows, "photo_id int, ord int, kind string, degrees int, confidence double")
    got = {r.photo_id: r for r in ocr_text.pick_passes(df).collect()}
    assert (got[1].degrees, got[1].ord, got[1].confidence, got[1].shaky) == (90, 9, 85, False)
    assert (got[2].degrees, got[2].ord, got[2].confidence, got[2].shaky) == (0, 8, 50, True)
    assert ocr_text.pick_orientation(df).collect()[0].degrees == 90
    assert {r.photo_id: r.ord for r in ocr_text.pick_variant(df).collect()} == {1: 9, 2: 8}


def wrap(text):
    return json.dumps({"candidates": [{"content": {"parts": [{"text": text[:5]}, {}, {"text": text[5:]}]}}]})


def test_responses(spark):
    full = {"text": "GU\n336N004N", "brand": "GU", "model_numbers": ["336N004N", "331-359039"], "sizes": ["M"],
            "materials": ["ポリエステル"], "made_in": "中国"}
    payloads = {
        "full": wrap(json.dumps(full)),
        "bare": wrap(json.dumps({"text": "よくわからない", "brand": "", "model_numbers": []})),
        "trim": wrap(json.dumps({"text": " GU ", "brand": " GU ", "model_numbers": [" 336N ", " ", 501]})),
        "plain": wrap("GU 336N004N"),
        "number": wrap("  12345"),
        "quotes": wrap("{'text': 'x'}"),
        "blocked": json.dumps({"promptFeedback": {"blockReason": "SAFETY"}}),
        "no parts": json.dumps({"candidates": [{"content": {"parts": []}}]}),
        "nothing": "{}",
    }
    df = spark.createDataFrame(list(payloads.items()), "k string, payload string")
    got = {r.k: r for r in hints.read_responses(df).collect()}
    assert got["full"].text == "GU\n336N004N" and got["full"].brand == "GU" and got["full"].made_in == "中国"
    assert got["full"].model_numbers == ["336N004N", "331-359039"] and got["full"].sizes == ["M"]
    assert got["bare"].brand is None and got["bare"].model_numbers == []
    assert (got["trim"].text, got["trim"].brand, got["trim"].model_numbers) == ("GU", "GU", ["336N", "501"])
    assert got["plain"].status == "text_only" and got["plain"].text == "GU 336N004N" and got["plain"].sizes == []
    assert got["number"].status == "ok" and got["number"].text == ""
    assert got["quotes"].status == "text_only"
    assert got["blocked"].error == "写真が受け付けられませんでした（SAFETY）。"
    assert "空でした" in got["no parts"].error and "空でした" in got["nothing"].error


def test_barcodes(spark):
    codes = ["4901234567894", "4901234567890", "0123456789012", "12345", " 4901-2345-67894 ", "", None,
             "96385074", "036000291452", "4710000000000"]
    df = spark.createDataFrame(list(enumerate(codes)), "i int, code string")
    got = barcode.describe(df).orderBy("i").collect()
    assert (got[0].valid, got[0].kind, got[0].country, got[0].maker_code) == (True, "JAN/EAN-13", "日本", "4901234")
    assert not got[1].valid
    assert (got[2].country, got[2].maker_code) == ("アメリカ・カナダ", None)
    assert (got[3].valid, got[3].kind) == (False, "5桁のコード")
    assert got[4].digits == "4901234567894"
    for row in got[5:7]:
        assert (row.digits, row.valid, row.kind, row.country, row.maker_code) == ("", False, None, None, None)
    assert (got[7].kind, got[7].valid, got[8].kind, got[8].valid) == ("EAN-8", True, "UPC-A", True)
    assert got[9].country == "台湾"


def test_check_digits(column_values):
    assert column_values(barcode.check_digit, ["490123456789", "456995110113", "9638507"]) == [4, 7, 4]
