import duckdb
import pytest

SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    return round(float(value), 6)


@pytest.fixture
def same_as_sql(spark):
    """Compare a query on the small tables with its SQL, as sets of rows."""
    def compare(query, sql):
        df = query(spark, SF)
        columns = sorted(df.columns)
        con = duckdb.connect()
        for name in ("documents", "benchmark", "labels"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
        cursor = con.execute(sql)
        names = [c[0] for c in cursor.description]
        assert sorted(names) == columns
        want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
        got = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
        assert got == want
    return compare


@pytest.fixture
def documents(spark):
    """A documents table of (doc_id, text) pairs or (doc_id, text, source)."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    return make
