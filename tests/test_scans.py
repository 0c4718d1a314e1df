import json
import os
import tempfile

from pricetide.operators import ocr_text
from pricetide.sources import dictionary, ocr_output, pastes


def write(name, text):
    path = os.path.join(tempfile.mkdtemp(prefix="run-"), name)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_entries_from_csv_and_parquet(spark):
    path = write("entries.csv", 'quote_id,source,pos,title,price\nq,yahoo,0,"a ""b"", c",500\nq,mercari,1,,700\n')
    rows = pastes.read_entries(spark, path, "csv")
    got = [tuple(r) for r in rows.orderBy("pos").collect()]
    assert got == [("q", "yahoo", 0, 'a "b", c', 500), ("q", "mercari", 1, None, 700)]
    out = tempfile.mkdtemp(prefix="run-") + "/entries"
    rows.write.parquet(out)
    assert [tuple(r) for r in pastes.read_entries(spark, out).orderBy("pos").collect()] == got


def test_paste_table_reads_missing_text_as_empty(spark):
    out = tempfile.mkdtemp(prefix="run-") + "/pastes"
    spark.createDataFrame([("q", "yahoo", None)], "quote_id string, source string, text string").write.parquet(out)
    assert pastes.read_table(spark, out).first().text == ""


def test_recogniser_output_from_json(spark):
    outputs = [
        {"photo_id": 1, "ord": 8, "kind": "variant", "confidence": 90.0, "lines": [{"text": "ND 91841", "confidence": 77}]},
        {"photo_id": 2, "blocks": [{"paragraphs": [{"lines": [{"text": "PATAGONIA", "confidence": 40}, {"text": "??", "confidence": 3}]}]}]},
    ]
    path = write("passes.json", "\n".join(json.dumps(o) for o in outputs))
    read = ocr_text.read_lines(ocr_output.read_json(spark, path))
    assert {r.photo_id: r.clean_text for r in read.collect()} == {1: "ND91841", 2: "PATAGONIA"}


def test_dictionaries(spark):
    assert dictionary.brands(spark).count() == 62
    aliases = dictionary.brand_aliases(spark).orderBy("alias_ord").collect()
    assert len(aliases) == len({(a.canonical, a.alias) for a in aliases})
    assert [len(a.folded) for a in aliases] == sorted((len(a.folded) for a in aliases), reverse=True)
    assert [r.source for r in dictionary.sources(spark).orderBy("ordinal").collect()] == ["yahoo", "mercari"]
    assert dictionary.conditions(spark).filter("condition = 'normal'").first().quantile == 0.5


def test_paste_folders_with_blanks_and_kana(spark):
    top = tempfile.mkdtemp(prefix="run-")
    for quote, source in (("検索 1", "フリマ"), ("a+b%20c", "x y")):
        os.makedirs(f"{top}/{quote}")
        with open(f"{top}/{quote}/{source}.txt", "w", encoding="utf-8") as f:
            f.write("¥700\n手袋")
    got = {(r.quote_id, r.source) for r in pastes.read_text_files(spark, top).collect()}
    assert got == {("検索 1", "フリマ"), ("a+b%20c", "x y")}
