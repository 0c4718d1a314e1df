"""Price histograms, stacked by source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricetide.functions.money import nice_step
from pricetide.functions.order_stats import interpolated


def bin_count(n: Column, low: Column, high: Column, q1: Column, q3: Column) -> Column:
    """Freedman-Diaconis bins, held between 8 and 20."""
    spread, width = q3 - q1, high - low
    wanted = F.ceil(width / (2 * spread / F.cbrt(n)))
    return (
        F.when(n < 2, F.lit(1))
        .when((spread <= 0) | (width <= 0), F.greatest(F.lit(1), F.least(F.lit(8), n)))
        .otherwise(F.greatest(F.lit(8), F.least(F.lit(20), wanted)))
    )


def ranges(settled: DataFrame) -> DataFrame:
    """Per quote: extremes and quartiles of the kept prices, as mergeable aggregates."""
    kept, price = F.col("kept"), F.when(F.col("kept"), F.col("price"))
    quartile = {f"q{i}": interpolated(F.col("price"), F.col("pool_running"), F.col("pool_total"), q, kept) for i, q in ((1, 0.25), (3, 0.75))}
    return settled.groupBy("quote_id").agg(
        F.min(price).alias("low"), F.max(price).alias("high"), *[c.alias(name) for name, c in quartile.items()])


def ranged_by_join(settled: DataFrame) -> DataFrame:
    """Kept prices with the range of their quote, for quotes too large for a window: AQE splits a hot one."""
    prices = settled.filter("kept").select("quote_id", "source", "price", "n", "kept", "pool_total")
    known = ranges(settled).withColumn("key", F.struct("quote_id")).drop("quote_id")
    return prices.withColumn("key", F.struct("quote_id")).join(known, "key").drop("key")


def ranged_by_window(settled: DataFrame) -> DataFrame:
    """Kept prices with the range of their quote; shares the partitioning of ``stats.settle``."""
    whole = Window.partitionBy("quote_id").orderBy("price").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    kept, price, total = F.col("kept"), F.col("price"), F.col("pool_total")

    def quartile(q: float) -> Column:
        return interpolated(price, F.col("pool_running"), total, q, kept,
                            over=lambda aggregate: aggregate.over(whole))

    return settled.select(
        "quote_id", "source", "price", "n", "kept", "pool_total",
        F.min(F.when(kept, price)).over(whole).alias("low"),
        F.max(F.when(kept, price)).over(whole).alias("high"),
        quartile(0.25).alias("q1"),
        quartile(0.75).alias("q3"),
    ).filter("kept")


def stacked(settled: DataFrame, bins: int | None = None, wide: bool = False) -> DataFrame:
    """``quote_id, source, bin, lo, hi, n``; empty bins included, for sources with kept prices.

    The range is that of all sources of the quote. ``bins`` overrides the suggested number. ``wide``
    takes the range from aggregates instead of a window over the quote's prices.
    """
    ranged, total = ranged_by_join(settled) if wide else ranged_by_window(settled), F.col("pool_total")
    low, high = F.col("low"), F.col("high")
    wanted = F.lit(bins) if bins else bin_count(total, low, high, F.col("q1"), F.col("q3"))
    flat = low == high
    step = F.when(flat, nice_step(F.greatest(F.lit(1), F.floor(low / 10)).cast("double"))).otherwise(
        nice_step((high - low) / wanted)
    )
    start = F.floor(low / F.col("step"))
    binned = ranged.withColumn("step", step).select(
        "quote_id", "source", "n", "step",
        F.when(flat, low).otherwise((start * F.col("step")).cast("bigint")).alias("first"),
        F.when(flat, F.lit(1)).otherwise(F.floor(high / F.col("step")) - start + 1)
        .cast("int").alias("bins"),
        "price",
    ).withColumn(
        "bin",
        F.least(F.col("bins") - 1, F.greatest(F.lit(0), F.floor((F.col("price") - F.col("first")) / F.col("step"))))
        .cast("int"),
    )
    counted = binned.groupBy("quote_id", "source", "bin").agg(
        F.sum("n").alias("n"), *[F.max(c).alias(c) for c in ("step", "first", "bins")]
    )
    # at most `bins` entries per source
    filled = counted.groupBy("quote_id", "source").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("counts"),
        *[F.max(c).alias(c) for c in ("step", "first", "bins")],
    )
    return filled.select(
        "quote_id", "source", "counts", "step", "first",
        F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"),
    ).select(
        "quote_id", "source", "bin",
        (F.col("first") + F.col("bin") * F.col("step")).alias("lo"),
        (F.col("first") + (F.col("bin") + 1) * F.col("step")).alias("hi"),
        F.coalesce(F.try_element_at("counts", F.col("bin")), F.lit(0)).alias("n"),
    )


def wide(stacked_rows: DataFrame, sources: list[tuple]) -> DataFrame:
    """One row per bin, one column per source (``n_<source>``)."""
    return stacked_rows.groupBy("quote_id", "bin", "lo", "hi").agg(*[
        F.sum(F.when(F.col("source") == key, F.col("n")).otherwise(0)).alias(f"n_{key}")
        for key, *_ in sources
    ])
