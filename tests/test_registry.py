import duckdb
import pytest

import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    return round(float(value), 6)


def as_rows(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_every_query_has_sql():
    assert set(entry._oracles.oracle_sql()) == set(entry._queries.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", [
    "quote_headline", "listing_exclusions", "verdicts", "result_rows", "price_histogram", "quote_warnings",
    "tag_identify", "search_urls", "ocr_clean_docs", "ocr_pass_pick", "barcode_check", "tag_responses",
    "paste_roundtrip_market", "paste_roundtrip_csv", "records_replay", "csv_export_lines", "title_keys",
    "result_rows_top500", "result_rows_sorted", "quotes_mixed_inputs", "mixed_warnings", "mixed_cards", "paste_item_ids",
    "photo_texts", "search_queries_noted", "source_stats_wide", "price_histogram_wide", "quotes_wide", "quotes_incremental",
    "match_tiers_indexed", "quotes_selected", "basis_choice_least", "tag_brands_indexed", "tag_models_bare", "tag_responses_empty",
])
def test_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = as_rows(df.select(*columns).collect())
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    want = as_rows([tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()])
    assert sorted(names) == columns
    assert got == want
