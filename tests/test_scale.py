"""Plans and hot keys: what must hold when one quote holds most of the rows."""

import re
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from pricetide.operators import stats, verdict
from pricetide.plans.quote import QuoteJob, title_keys

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@contextmanager
def settings(spark, values):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def hot(spark):
    """60,000 listings, two thirds of them in one quote and one source."""
    rows = spark.range(0, 60000, 1, 8).select(
        F.when(F.col("id") % 3 > 0, F.lit(0)).otherwise(F.col("id") % 50).cast("bigint").alias("quote_id"),
        F.when(F.col("id") % 5 == 0, F.lit("mercari")).otherwise(F.lit("yahoo")).alias("source"),
        F.col("id").alias("pos"),
        F.concat(F.lit("ノースフェイス コート ND"), F.lpad((F.col("id") % 9999).cast("string"), 5, "0")).alias("title"),
        (F.lit(3000) + (F.col("id") * 7919) % 5000).alias("price"),
    )
    quotes = spark.range(50).select(F.col("id").alias("quote_id"), F.lit("x").alias("query"))
    targets = spark.range(50).select(
        F.col("id").alias("quote_id"), F.lit("ノースフェイス").alias("brand"),
        F.array(F.lit("ND00001")).alias("model_numbers"))
    return rows, quotes, targets


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_quote_is_split_in_the_join_and_still_right(spark, hot):
    rows, quotes, targets = hot
    with settings(spark, SMALL):
        counts = QuoteJob(rows, quotes, targets).counted
        plan = final_plan(counts)
        split = {(r.quote_id, r.source, r.tier, r.price): r.n for r in counts.collect()}
    assert "skew=true" in plan
    plain = QuoteJob(rows, quotes, targets).counted
    assert split == {(r.quote_id, r.source, r.tier, r.price): r.n for r in plain.collect()}
    assert sum(split.values()) == 60000


def test_hot_quote_is_counted_before_it_is_sorted(spark, hot):
    rows, quotes, targets = hot
    counts = QuoteJob(rows, quotes, targets).counted
    per_quote = counts.groupBy("quote_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"))
    largest = per_quote.orderBy(F.desc("n")).first()
    # distinct prices x sources x tiers, not listings
    assert largest.n > 40000 and largest.rows <= 5000 * 2 * 2


def test_one_shuffle_after_the_counts(spark, hot):
    rows, quotes, targets = hot
    job = QuoteJob(rows, quotes, targets)
    counts_shuffles = count_shuffles(job.counted)
    assert count_shuffles(job.quotes) <= counts_shuffles + 1
    assert count_shuffles(job.source_stats) <= counts_shuffles + 1


def count_shuffles(df):
    return len(re.findall(r"Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))


def test_nothing_pairs_tags_with_listings(spark, hot):
    rows, quotes, targets = hot
    job = QuoteJob(rows, quotes, targets, keep_counts=True)
    tags = spark.range(20000).select(
        F.col("id").alias("tag_id"), (F.col("id") % 1).alias("quote_id"),
        (F.lit(2500) + F.col("id") % 6000).alias("shop_price"), F.lit("normal").alias("condition"))
    judged = job.verdicts(tags)
    plan = final_plan(judged)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert judged.count() == 20000
    prices = [(r.price, r.n) for r in stats.kept_prices(job.settled).filter("quote_id = 0").collect()]
    total = sum(n for _, n in prices)
    for row in judged.filter("tag_id % 997 = 0").collect():
        below = sum(n for p, n in prices if p < row.shop_price)
        assert row.position_pct == int(below / total * 100 + 0.5)


def test_points_shrink_hot_tags(spark):
    tags = spark.range(10000).select(F.lit(1).alias("quote_id"), (F.col("id") % 10).alias("shop_price"), F.lit("new").alias("condition"))
    prices = spark.createDataFrame([(1, 5, 3)], "quote_id int, price bigint, n bigint")
    points = tags.distinct()
    got = {r.shop_price: r.cheaper for r in verdict.cheaper_counts(points, prices).collect()}
    assert got == {p: (3 if p > 5 else 0) for p in range(10)}


def test_scan_reads_only_what_is_needed(spark):
    from checks import queries

    plan = queries.quote_headline(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"ReadSchema: struct<([^>]*)", plan)
    line = next(s for s in scans if "l_suppkey" in s)
    assert "l_tax" not in line and "l_shipdate" not in line


def test_filter_on_a_quote_reaches_the_listings_scan(spark, hot, tmp_path):
    rows, quotes, targets = hot
    title_keys(rows).write.parquet(str(tmp_path / "listings"))
    listings = spark.read.parquet(str(tmp_path / "listings"))
    job = QuoteJob(listings, quotes, targets).only([7])
    tags = spark.createDataFrame([(1, 7, 4000, "normal")], "tag_id int, quote_id bigint, shop_price bigint, condition string")
    for df in (job.quotes, job.rows, job.verdicts(tags), QuoteJob(listings, quotes, targets).quotes.where("quote_id = 7")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in plan.split("\n") if "title_folded" in line and "PushedFilters" in line]
        assert scans and all(re.search(r"PushedFilters: \[[^\]]*quote_id", line) for line in scans)
    want = QuoteJob(rows, quotes, targets).quotes.where("quote_id = 7").collect()
    assert job.quotes.collect() == want


def test_rows_shuffle_titles_once(spark, hot):
    rows, quotes, targets = hot
    with settings(spark, SMALL):
        plan = QuoteJob(rows, quotes, targets).rows._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join" in line]
    assert sum("quote_id" in line and "source" in line for line in joins) == 0


def test_tag_prices_of_one_quote_are_counted_in_stretches(spark):
    points = spark.range(100000).select(F.lit(1).alias("quote_id"), (F.col("id") * 7).alias("shop_price"), F.lit("new").alias("condition"))
    prices = spark.range(50000).select(F.lit(1).alias("quote_id"), (F.col("id") * 11 + 5).alias("price"), F.lit(2).cast("bigint").alias("n"))
    counted = verdict.cheaper_counts(points, prices)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    windows = re.findall(r"Window \[.*", plan)
    assert any("stretch" in w and "value" in w for w in windows)
    assert not any("value" in w and "stretch" not in w for w in windows)
    for row in counted.where("shop_price % 4999 = 0").collect():
        cheaper = min(50000, max(0, -(-(row.shop_price - 5) // 11)))
        assert row.cheaper == 2 * cheaper
    assert counted.count() == 100000
