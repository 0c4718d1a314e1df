import random
import re

import pytest
from pyspark.sql import functions as F

from pricetide.operators import histogram, stats, wide_stats
from pricetide.plans.quote import QuoteJob
from pricetide.streaming.running_quotes import RunningQuotes

OPTIONS = "quote_id bigint, query string, price_max bigint"
TARGETS = "quote_id bigint, brand string, model_numbers array<string>"


@pytest.fixture
def listings(spark):
    rng = random.Random(4)
    titles = ["ACME MD-00017 coat", "ACME coat", "plain coat", "ACME coat junk ジャンク", "MD00017"]
    rows = [(rng.randrange(1, 6), rng.choice(["auction", "market", None]) or "auction", rng.choice(titles),
             rng.choice([rng.randrange(900, 30_000), 90_000, 5000])) for _ in range(600)]
    return spark.createDataFrame(rows, "quote_id bigint, source string, title string, price bigint")


@pytest.fixture
def terms(spark):
    options = spark.createDataFrame([(i, "coat", 50_000 if i == 2 else None) for i in range(1, 8)], OPTIONS)
    targets = spark.createDataFrame([(1, "ACME", ["MD-00017"]), (2, "ACME", []), (3, None, ["MD-00017"])], TARGETS)
    return options, targets


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def rounded(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def test_batches_add_up_to_the_whole_job(spark, listings, terms, tmp_path):
    store = RunningQuotes(spark, str(tmp_path), *terms)
    assert rows_of(store.quotes()) == rows_of(QuoteJob(listings.limit(0), *terms).quotes)
    parts = [listings.where(F.col("price") % 3 == k) for k in range(3)]
    for k, part in enumerate(parts):
        store.absorb(part, k)
    assert rows_of(store.quotes()) == rows_of(QuoteJob(listings, *terms).quotes)


def test_a_repeated_batch_changes_nothing(spark, listings, terms, tmp_path):
    store = RunningQuotes(spark, str(tmp_path), *terms)
    first, second = listings.where("quote_id < 4"), listings.where("quote_id >= 4 OR price % 2 = 0")
    store.absorb(first, 0)
    store.absorb(second, 1)
    before = rows_of(store.quotes()), rows_of(store.counts())
    store.absorb(first, 0)
    store.absorb(second, 1)
    assert (rows_of(store.quotes()), rows_of(store.counts())) == before


def test_only_touched_quotes_are_settled(spark, listings, terms, tmp_path):
    store = RunningQuotes(spark, str(tmp_path), *terms)
    store.absorb(listings, 0)
    store.absorb(spark.createDataFrame([(3, "market", "MD00017", 7777)], listings.schema), 1)
    changed = spark.read.parquet(f"{tmp_path}/quotes/batch=1")
    assert [r.quote_id for r in changed.collect()] == [3]
    assert store.job().quotes.count() == 7 and store.quotes().count() == 7


def test_a_half_written_batch_is_not_read(spark, listings, terms, tmp_path):
    store = RunningQuotes(spark, str(tmp_path), *terms)
    store.absorb(listings, 0)
    before = rows_of(store.counts())
    store.absorb(listings, 1)
    (tmp_path / "counts" / "batch=1" / "_SUCCESS").unlink()
    assert rows_of(store.counts()) == before


def test_a_stream_feeds_the_store(spark, listings, terms, tmp_path):
    listings.repartition(3).write.parquet(f"{tmp_path}/in")
    store = RunningQuotes(spark, f"{tmp_path}/store", *terms)
    stream = spark.readStream.schema(listings.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream.writeStream.foreachBatch(store.absorb).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert store.stored("counts").select("batch").distinct().count() == 3
    assert rows_of(store.quotes()) == rows_of(QuoteJob(listings, *terms).quotes)


@pytest.mark.parametrize("width", [1, 4096])
def test_wide_ranks_equal_windows(spark, listings, terms, width):
    counts = QuoteJob(listings, *terms).counted
    plain, wide = stats.settle(counts), wide_stats.settle(counts, width)
    names = plain.columns
    assert wide.columns == names
    kept = [c for c in names if c not in ("running", "pool_running")]
    assert rounded(plain.select(*kept)) == rounded(wide.select(*kept))
    assert rounded(plain.where("kept")) == rounded(wide.where("kept"))
    assert rounded(histogram.stacked(plain)) == rounded(histogram.stacked(wide, wide=True))
    for result in (stats.source_stats, stats.pooled_stats, stats.basis_choice, stats.fences):
        assert rounded(result(plain)) == rounded(result(wide))


def test_a_million_prices_of_one_quote_spread_over_tasks(spark):
    counts = spark.range(1_000_000).select(
        F.lit(1).alias("quote_id"), F.lit("market").alias("source"), F.lit(False).alias("excluded"), F.lit("loose").alias("tier"),
        (F.col("id") + 400).alias("price"), (1 + F.col("id") % 3).alias("n"), F.lit(False).alias("has_target"),
        F.lit(True).alias("remove_outliers"), F.lit(1.5).alias("iqr_k"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        settled = wide_stats.settle(counts)
        sizes = [r["count"] for r in settled.groupBy(F.spark_partition_id()).count().collect()]
        stat = stats.source_stats(settled).collect()[0]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(sizes) == 1_000_000 and max(sizes) < 100_000
    windows = re.findall(r"Window \[.*", settled._jdf.queryExecution().executedPlan().toString())
    assert all("stretch" in w for w in windows if "price" in w)
    assert stat["count"] == 1_999_999 and stat["min"] == 400 and stat["max"] == 1_000_399 and stat["median"] == 500_400


def test_wide_job_classifies_once(spark, listings, terms):
    job = QuoteJob(listings, *terms, wide=True)
    plan = job.settled._jdf.queryExecution().optimizedPlan().toString()
    # stored counts only: no listing is read again
    assert "title" not in plan
    counts = spark.range(1_000).select(
        F.lit(1).alias("quote_id"), F.lit("market").alias("source"), F.lit(False).alias("excluded"), F.lit("loose").alias("tier"),
        (F.col("id") + 400).alias("price"), F.lit(1).cast("bigint").alias("n"), F.lit(False).alias("has_target"),
        F.lit(True).alias("remove_outliers"), F.lit(1.5).alias("iqr_k"))
    plan = wide_stats.settle(counts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 2


def test_one_shuffle_sums_and_settles(spark, listings, terms, tmp_path):
    store = RunningQuotes(spark, str(tmp_path), *terms)
    store.absorb(listings, 0)
    plan = store.job(counts=store.counts()).settled._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
