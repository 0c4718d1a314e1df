import datetime as dt
import glob
import tempfile

import pytest
from pyspark.sql import functions as F

from pricetide import dims
from pricetide.operators import parse, stats
from pricetide.operators.positions import number_rows
from pricetide.plans.quote import QuoteJob
from pricetide.plans.replay import replay
from pricetide.sources import csv_export, pastes, records
from pricetide.session import cut_lineage
from pricetide.streaming import ingest

SOURCES = [("yahoo", "ヤフオク", ""), ("mercari", "メルカリ", "")]


def folder():
    return tempfile.mkdtemp(prefix="run-")


def quoted(spark):
    rows = [(f"q{k}", "yahoo", i, f"コート {i}", 5000 + 100 * i + k) for k in range(3) for i in range(5)]
    listings = spark.createDataFrame(rows, "quote_id string, source string, pos bigint, title string, price bigint")
    options = spark.createDataFrame([(f"q{k}", f"コート {k}") for k in range(3)], "quote_id string, query string")
    return QuoteJob(listings, options, sources=SOURCES, keep_counts=True)


def saved(spark):
    job = quoted(spark)
    text = "\n".join(f"¥{5000 + 100 * i}\nコート {i}" for i in range(5))
    day = dt.datetime(2026, 8, 30, 12, 0, 0)
    rows = [(f"q{k}", f"コート {k}", day + dt.timedelta(days=k), [("yahoo", "ヤフオク", text), ("mercari", "メルカリ", None)],
             "ノースフェイス\nND91841" if k == 2 else None, 4800) for k in range(3)]
    inputs = spark.createDataFrame(
        rows, "quote_id string, query string, created_at timestamp, "
        "groups array<struct<key:string,label:string,text:string>>, tag_text string, shop_price int")
    return records.records(records.summary(job.quotes, job.source_stats, SOURCES), inputs)


def test_records_round_trip(spark):
    store = records.RecordStore(spark, folder())
    store.save(saved(spark))
    listed = store.latest().collect()
    assert [r.query for r in listed] == ["コート 2", "コート 1", "コート 0"]
    assert "groups" not in listed[0].asDict() and listed[0].summary.blend.equal_weight_median == 5202
    assert store.latest(limit=1).count() == 1
    record = store.get(listed[1].id).collect()
    assert len(record) == 1 and record[0].query == "コート 1" and record[0].shop_price == 4800
    assert listed[1].id.startswith("20260831-120000-")

    store.delete(spark.createDataFrame([(listed[0].id,), ("unknown",)], "id string"))
    assert [r.query for r in store.latest().collect()] == ["コート 1", "コート 0"]
    store.save(saved(spark).filter("query = 'コート 1'").withColumn("id", F.lit("another")))
    assert store.read().count() == 3
    fresh = store.compact(folder())
    assert fresh.read().count() == 3 and spark.read.parquet(fresh.data).count() == 3


def test_listing_does_not_read_texts(spark):
    store = records.RecordStore(spark, folder())
    store.save(saved(spark))
    plan = store.latest()._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "groups" not in plan.split("ReadSchema")[1]


def test_ids_do_not_depend_on_the_run(spark):
    assert {r.id for r in saved(spark).collect()} == {r.id for r in saved(spark).collect()}


def test_replay(spark):
    job = replay(saved(spark), sources=SOURCES)
    got = job.quotes.collect()
    assert len(got) == 3
    assert {(r.combined_count, r.equal_weight_median) for r in got} == {(5, 5200)}
    assert sum(r.has_target for r in got) == 1


def read_bytes(paths):
    return b"".join(open(p, "rb").read() for p in sorted(paths))


def test_csv_by_quote(spark):
    job = quoted(spark)
    rows = job.rows.withColumn("title", F.concat(F.lit('a "b", '), F.col("title")))
    out = folder() + "/csv"
    csv_export.write_by_quote(rows, out, stats.source_order(F.col("source"), SOURCES), csv_export.listing_sizes(job.listings))
    text = read_bytes(glob.glob(f"{out}/quote_id=q1/part-*")).decode("utf-8")
    lines = text.split("\r\n")
    assert lines[0] == "﻿" + ",".join(f'"{h}"' for h in dims.EXPORT_HEADER)
    assert lines[1] == '"ヤフオク","a ""b"", コート 0","5001","手がかりなし","yes",""'
    assert len(lines) == 7 and lines[-1] == ""


def test_csv_files_are_planned_before_the_rows(spark):
    sizes = {("q0", "mercari"): 7, ("q0", "yahoo"): 95, ("q1", "yahoo"): 3, ("q1", None): 2, ("q2", "mercari"): 1}
    listed = [(q, s, i, f"title {q} {s} {i}", 5000 + i) for (q, s), n in sizes.items() for i in range(n)]
    listings = spark.createDataFrame(listed, "quote_id string, source string, pos bigint, title string, price bigint")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(title):
        seen.add(1)
        return title

    rows = listings.repartition(5).select(
        "quote_id", "source", "pos", F.col("source").alias("label"), counted.asNondeterministic()("title").alias("title"), "price",
        F.lit("loose").alias("tier"), F.lit(True).alias("in_basis"), F.lit(None).cast("string").alias("exclude_reason"))
    out = folder() + "/csv"
    csv_export.write_by_quote(
        rows, out, stats.source_order(F.col("source"), SOURCES), csv_export.listing_sizes(listings), rows_per_file=20)
    assert seen.value == len(listed)
    for q, sources in (("q0", ["yahoo", "mercari"]), ("q1", ["yahoo", None]), ("q2", ["mercari"])):
        text = read_bytes(glob.glob(f"{out}/quote_id={q}/part-*")).decode("utf-8")
        titles = [line.split(",")[1] for line in text.split("\r\n")[1:-1]]
        assert titles == [f'"title {q} {s} {i}"' for s in sources for i in range(sizes[q, s])]
        assert text.count("﻿") == 1 and text.startswith("﻿")
    assert len(glob.glob(f"{out}/quote_id=q0/part-*")) == 6 and len(glob.glob(f"{out}/quote_id=q1/part-*")) == 1


def test_csv_table(spark):
    out = folder() + "/csv"
    csv_export.write_table(quoted(spark).rows, out)
    back = spark.read.csv(out, header=True)
    assert back.columns == ["quote_id", *dims.EXPORT_HEADER] and back.count() == 15


def test_text_file_pastes(spark):
    import os

    base = folder()
    os.makedirs(f"{base}/q1")
    with open(f"{base}/q1/yahoo.txt", "w", encoding="utf-8") as f:
        f.write("コートA\n落札 1,000円")
    row = pastes.read_text_files(spark, base).first()
    assert (row.quote_id, row.source, row.text) == ("q1", "yahoo", "コートA\n落札 1,000円")


def test_stream_of_pastes(spark):
    arrived, out = folder() + "/in", folder() + "/out"
    batch = spark.createDataFrame([("q", "yahoo", "¥1,000\nコートA\n¥2,000\nコートB")], ingest.PASTES)
    batch.write.parquet(arrived)
    point = folder()
    ingest.append_listings(ingest.read_pastes(spark, arrived), out, point).awaitTermination()
    batch.withColumn("quote_id", F.lit("r")).write.mode("append").parquet(arrived)
    ingest.append_listings(ingest.read_pastes(spark, arrived), out, point).awaitTermination()
    got = spark.read.parquet(out).orderBy("quote_id", "pos").collect()
    assert [(r.quote_id, r.pos, r.title, r.price) for r in got] == [
        (q, i, t, p) for q in "qr" for i, t, p in ((0, "コートA", 1000), (1, "コートB", 2000))]


def test_pages_of_a_stream_are_numbered_on(spark):
    arrived, out, point = folder() + "/in", folder() + "/out", folder()
    pages = [("q", "yahoo", 1, "¥3,000\nコートC"), ("q", "yahoo", 0, "¥1,000\nコートA\n¥2,000\nコートB"), ("q", "mercari", 1, "¥4,000\nコートD")]
    for page in pages:
        spark.createDataFrame([page], ingest.PAGED_PASTES).write.mode("append").parquet(arrived)
        ingest.append_listings(ingest.read_pastes(spark, arrived, ingest.PAGED_PASTES), out, point).awaitTermination()
    got = ingest.stored_listings(spark, out).orderBy("source", "pos").collect()
    assert [(r.source, r.pos, r.title) for r in got] == [
        ("mercari", 0, "コートD"), ("yahoo", 0, "コートA"), ("yahoo", 1, "コートB"), ("yahoo", 2, "コートC")]


def test_listing_opens_the_last_days_only(spark):
    store = records.RecordStore(spark, folder())
    one = saved(spark).limit(1).drop("id", "created_at")
    days = spark.range(300).select(
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 86_400).alias("created_at"), F.format_string("r%04d", "id").alias("id"))
    filled = one.first().asDict(recursive=True)
    rows = spark.createDataFrame([filled], one.schema).select("*", F.lit(1).alias("k")).join(
        days.withColumn("k", F.lit(1)), "k").drop("k")
    rows = rows.unionByName(rows.where("id = 'r0000'").withColumns({"created_at": F.lit(None).cast("timestamp"), "id": F.lit("untimed")}))
    store.save(rows)
    assert len(store.days()) == 300

    def read_days(listed):
        listed.collect()
        plan = listed._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in plan and ">=" in plan.split("PartitionFilters: [")[1].split("]\n")[0]
        return [r.id for r in listed.collect()]

    assert read_days(store.latest(3)) == ["r0299", "r0298", "r0297"]
    assert read_days(store.latest(50)) == [f"r{i:04d}" for i in range(299, 249, -1)]
    since = store._since(store.days()[63])
    assert since.count() == 64
    store.delete(spark.createDataFrame([(f"r{i:04d}",) for i in range(290, 300)], "id string"))
    assert read_days(store.latest(3)) == ["r0289", "r0288", "r0287"]
    everything = [r.id for r in store.latest(1000).collect()]
    assert len(everything) == 291 and everything[-1] == "untimed"


def test_positions_over_blocks(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.hash("id").alias("order"))
    got = number_rows(df, ["k"], ["order"], F.floor(F.col("order") / 100_000_000)).collect()
    for key in range(3):
        rows = sorted((r for r in got if r.k == key), key=lambda r: r.order)
        assert [r.pos for r in rows] == list(range(len(rows)))


def test_direct_entries_have_a_report(spark):
    listings = quoted(spark).listings
    assert {r.mode for r in parse.direct_report(listings).collect()} == {"direct"}


def test_cut_lineage_keeps_rows(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    assert sorted(r.x for r in cut_lineage(df).collect()) == list(range(0, 20, 2))


def test_one_record_opens_one_day(spark):
    store = records.RecordStore(spark, folder())
    store.save(saved(spark))
    record = store.latest().first().id
    one = store.get(record)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "created_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert [r.id for r in one.collect()] == [record] and store.get("unknown").count() == 0
    days = glob.glob(f"{store.data}/created_date=*")
    assert len(days) == 3 and all(len(glob.glob(f"{d}/*.parquet")) == 1 for d in days)


def record_days(spark, days, each=3):
    """Records of some days, several of each, one of them with a long text."""
    one = saved(spark).limit(1).drop("id", "created_at")
    keys = spark.range(days * each).select(
        F.timestamp_seconds(F.lit(1_700_000_000) + F.floor(F.col("id") / each) * 86_400).alias("created_at"),
        F.format_string("r%04d", "id").alias("id"))
    return spark.createDataFrame([one.first().asDict(recursive=True)], one.schema).select("*", F.lit(1).alias("k")).join(
        keys.withColumn("k", F.lit(1)), "k").drop("k").select("id", "created_at", *one.columns)


def files_of(store):
    return set(glob.glob(f"{store.data}/*/*.parquet"))


def ids(rows):
    return sorted(r.id for r in rows.select("id").collect())


def test_fold_rewrites_touched_days_and_switches_once(spark):
    store = records.RecordStore(spark, folder())
    rows = record_days(spark, 6).unionByName(
        record_days(spark, 1).withColumns({"created_at": F.lit(None).cast("timestamp"), "id": F.concat(F.lit("u"), "id")}))
    store.save(rows)
    everything, files = ids(store.read()), files_of(store)
    assert len(everything) == 21 and not store.fold()
    gone = ["r0000", "r0003", "r0004", "r0005", "ur0001", "unknown"]
    store.delete(spark.createDataFrame([(i,) for i in gone], "id string"))
    kept = [i for i in everything if i not in gone]

    early = store.read()  # a reader that began before the switch
    commit, seen = store._commit, []

    def between(pointer):
        # the version is written, nothing points to it: readers see the state before, whole
        seen.append((ids(records.RecordStore(spark, store.data[:-len("/records")]).read()), pointer))
        store.delete(spark.createDataFrame([("r0008",)], "id string"))
        store.save(record_days(spark, 1).where("id = 'r0001'").withColumn("id", F.lit("late")))
        commit(pointer)

    store._commit = between
    assert store.fold()
    assert seen[0][0] == kept and ids(early) == kept
    pointer = store.pointer()
    assert pointer == seen[0][1] and pointer.versions == (1,)
    assert {name.split("/")[0] for name in pointer.replaced} == {
        "created_date=2023-11-14", "created_date=2023-11-15", "created_date=__HIVE_DEFAULT_PARTITION__"}
    # days without deletions keep their files, and what came meanwhile counts
    assert files < files_of(store)
    assert len(glob.glob(f"{store.folded}/version=1/*/*.parquet")) == 2
    now = sorted(set(kept) - {"r0008"} | {"late"})
    assert ids(store.read()) == now
    assert ids(store.latest(100)) == now and ids(store.get("r0001")) == ["r0001"] and ids(store.get("r0003")) == []
    assert ids(store.compact(folder()).read()) == now

    store._commit = commit
    store.delete(spark.createDataFrame([("late",), ("r0002",)], "id string"))
    assert store.fold() and ids(store.read()) == sorted(set(now) - {"late", "r0002"})
    assert store.fold() and ids(store.read()) == sorted(set(now) - {"late", "r0002"})
    # the second of two folds changes nothing
    with pytest.raises(RuntimeError):
        store._commit(records.Pointer(store.pointer().number))
    # an unfinished version is passed over, and a store can lose all its records
    store.delete(store.read().select("id"))
    record_days(spark, 1).write.parquet(f"{store.folded}/version=3/created_date=2023-11-14")
    assert store.fold() and ids(store.read()) == [] and 3 not in store.pointer().versions


def test_files_of_a_day_follow_its_size(spark):
    store = records.RecordStore(spark, folder())
    noise = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda k: F.sha2(F.concat("id", k.cast("string")), 256)), "")
    rows = record_days(spark, 4, each=400).withColumn("tag_text", F.when(F.col("id") < "r0400", noise).otherwise(F.lit("")))
    arrived = folder() + "/arrived"
    rows.repartition(8).write.parquet(arrived)
    rows = spark.read.parquet(arrived)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100k")
    try:
        store.save(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    count = {d: len(glob.glob(f"{store.data}/created_date={d}/*.parquet")) for d in store.days()}
    # a small day may share the partition of the large one
    assert count["2023-11-14"] > 4 and min(n for d, n in count.items() if d != "2023-11-14") == 1
    assert store.read().count() == 1600
