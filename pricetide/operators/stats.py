"""Basis choice, outliers and summary statistics over price counts.

A *price count* row says how often a price occurs for a quote, a source and a tier. Counting first,
with the price among the grouping keys, spreads even one enormous quote over all reducers; what is
left per quote is at most (whole yen between the price guards) x tiers x sources rows, whatever the
number of listings. Everything after that shares one partitioning by ``quote_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricetide import dims
from pricetide.functions.money import round_half_up
from pricetide.functions.order_stats import interpolated
from pricetide.operators import match

UNBOUNDED = (Window.unboundedPreceding, Window.unboundedFollowing)
STAT_NAMES = ["count", "min", "p25", "median", "p75", "max", "mean", "stdev", "iqr"]


def price_counts(classified: DataFrame) -> DataFrame:
    """``quote_id, source, excluded, tier, price, n`` plus the quote's own settings.

    Excluded listings keep only their number: their price and tier are null. A row whose ``price``
    is null and ``is_listing`` false stands for an empty source and counts zero.
    """
    excluded = F.col("excluded")
    return classified.groupBy(
        "quote_id",
        "source",
        "excluded",
        F.when(~excluded, F.col("tier")).alias("tier"),
        F.when(~excluded, F.col("price")).alias("price"),
    ).agg(
        F.sum(F.col("is_listing").cast("bigint")).alias("n"),
        F.first("has_target").alias("has_target"),
        F.first("remove_outliers").alias("remove_outliers"),
        F.first("iqr_k").alias("iqr_k"),
        F.first("min_basis_count").alias("min_basis_count"),
    )


def least_of_basis(counts: DataFrame) -> Column:
    """The quote's own minimum; counts stored without one have the default."""
    return F.col("min_basis_count") if "min_basis_count" in counts.columns else F.lit(dims.MIN_BASIS_COUNT)


def settle(counts: DataFrame) -> DataFrame:
    """Choose the basis of every quote, mark outliers per source, and rank what is kept.

    Adds ``basis, n_model, n_brand, n_loose, low, high, kept`` and the running counts that
    percentiles are read from. All windows lie within ``quote_id``; the first four share one sort.
    """
    whole_quote = Window.partitionBy("quote_id").orderBy("source", "price").rowsBetween(*UNBOUNDED)
    by_source = Window.partitionBy("quote_id", "source").orderBy("price")
    whole_source = by_source.rowsBetween(*UNBOUNDED)
    pooled = Window.partitionBy("quote_id").orderBy("price")
    whole_pool = pooled.rowsBetween(*UNBOUNDED)

    n, price = F.col("n"), F.col("price")
    counted = ~F.col("excluded") & price.isNotNull()

    def count_of(tier: str) -> Column:
        return F.coalesce(F.sum(F.when(counted & (F.col("tier") == tier), n)).over(whole_quote), F.lit(0))

    tiered = counts.select(
        "*", *[count_of(tier).alias(f"n_{tier}") for tier in ("model", "brand", "loose")]
    ).withColumn("basis", match.choose_basis(F.col("has_target"), F.col("n_model"), F.col("n_brand"), least_of_basis(counts)))
    in_basis = counted & match.within_basis(F.col("basis"), F.col("tier"))
    ranked = tiered.withColumn("in_basis", in_basis).withColumn(
        "m", F.when(F.col("in_basis"), n).otherwise(F.lit(0))
    ).select(
        "*",
        F.sum("m").over(by_source).alias("running"),
        F.sum("m").over(whole_source).alias("total"),
    )

    def quartile(q: float) -> Column:
        return interpolated(price, F.col("running"), F.col("total"), q, F.col("in_basis"),
                            over=lambda aggregate: aggregate.over(whole_source))

    spread = F.col("q3") - F.col("q1")
    bounded = F.col("remove_outliers") & (F.col("total") >= dims.MIN_FOR_BOUNDS) & (spread > 0)
    fenced = ranked.select("*", quartile(0.25).alias("q1"), quartile(0.75).alias("q3")).select(
        "*",
        F.when(bounded, F.col("q1") - F.col("iqr_k") * spread).alias("low"),
        F.when(bounded, F.col("q3") + F.col("iqr_k") * spread).alias("high"),
    )
    below = F.coalesce(price < F.col("low"), F.lit(False))
    above = F.coalesce(price > F.col("high"), F.lit(False))
    dropped = fenced.select(
        "*",
        F.sum(F.when(below, F.col("m")).otherwise(0)).over(whole_source).alias("n_below"),
        F.sum(F.when(below | above, F.col("m")).otherwise(0)).over(whole_source).alias("n_outside"),
    )
    # if every listing lay outside, none would be dropped
    active = F.col("n_outside") < F.col("total")
    kept = dropped.select(
        "quote_id", "source", "excluded", "price", "n", "basis", "has_target",
        "n_model", "n_brand", "n_loose",
        F.when(active, F.col("low")).alias("low"),
        F.when(active, F.col("high")).alias("high"),
        (F.col("in_basis") & ~(active & (below | above))).alias("kept"),
        F.when(active, F.col("n_outside")).otherwise(0).alias("outlier_count"),
        (F.col("running") - F.when(active, F.col("n_below")).otherwise(0)).alias("running"),
        (F.col("total") - F.when(active, F.col("n_outside")).otherwise(0)).alias("total"),
    )
    m = F.when(F.col("kept"), n).otherwise(F.lit(0))
    amount = F.when(F.col("kept"), n * price.cast("double")).otherwise(F.lit(0.0))
    return kept.select(
        "*",
        F.sum(amount).over(whole_source).alias("amount"),
    ).select(
        "*",
        F.sum(m).over(pooled).alias("pool_running"),
        F.sum(m).over(whole_pool).alias("pool_total"),
        F.sum(amount).over(whole_pool).alias("pool_amount"),
    )


def kept_prices(settled: DataFrame) -> DataFrame:
    """``quote_id, source, price, n``: what the quote is made of."""
    return settled.filter("kept").select("quote_id", "source", "price", "n")


def _stats(prefix: str, running: str, total: str, amount: str) -> list[Column]:
    """Summary statistics as aggregates over rows that carry running counts."""
    kept, n, price = F.col("kept"), F.col("n"), F.col("price")
    mean = F.col(amount) / F.nullif(F.col(total), F.lit(0))
    squares = F.sum(F.when(kept, n * F.pow(price - mean, 2)))
    size = F.max(total)

    def percentile(q: float) -> Column:
        return round_half_up(interpolated(price, F.col(running), F.col(total), q, kept))

    return [
        F.coalesce(size, F.lit(0)).alias(f"{prefix}count"),
        F.min(F.when(kept, price)).alias(f"{prefix}min"),
        percentile(0.25).alias(f"{prefix}p25"),
        percentile(0.5).alias(f"{prefix}median"),
        percentile(0.75).alias(f"{prefix}p75"),
        F.max(F.when(kept, price)).alias(f"{prefix}max"),
        round_half_up(F.max(mean)).alias(f"{prefix}mean"),
        round_half_up(
            F.when(size == 1, F.lit(0.0)).when(size > 1, F.sqrt(squares / (size - 1)))
        ).alias(f"{prefix}stdev"),
    ]


def _with_iqr(stats: DataFrame, prefix: str = "") -> DataFrame:
    return stats.withColumn(f"{prefix}iqr", F.col(f"{prefix}p75") - F.col(f"{prefix}p25"))


def source_stats(settled: DataFrame) -> DataFrame:
    """Per quote and source: counters and statistics; empty sources have count 0 and nulls."""
    excluded = F.sum(F.when(F.col("excluded"), F.col("n")).otherwise(0))
    # a row without a source stands for a quote without listings
    return _with_iqr(
        settled.where("source is not null").groupBy("quote_id", "source").agg(
            F.sum("n").alias("n_read"),
            (excluded + F.max("outlier_count")).alias("excluded_count"),
            F.max("outlier_count").alias("outlier_count"),
            *_stats("", "running", "total", "amount"),
        )
    )


def pooled_stats(settled: DataFrame) -> DataFrame:
    """Per quote: statistics over the kept prices of all its sources."""
    return _with_iqr(
        settled.groupBy("quote_id").agg(*_stats("", "pool_running", "pool_total", "pool_amount"))
    )


def basis_choice(settled: DataFrame) -> DataFrame:
    """Per quote: tier counts before outliers, the chosen tier and its size."""
    return (
        settled.groupBy("quote_id")
        .agg(*[F.max(c).alias(c) for c in ("basis", "has_target", "n_model", "n_brand", "n_loose")])
        .select(
            "quote_id",
            F.col("basis").alias("basis_tier"),
            "n_model", "n_brand", "n_loose",
            F.when(F.col("basis") == "model", F.col("n_model"))
            .when(F.col("basis") == "brand", F.col("n_model") + F.col("n_brand"))
            .otherwise(F.col("n_model") + F.col("n_brand") + F.col("n_loose"))
            .alias("n_basis"),
            "has_target",
            match.tier_label(F.col("basis")).alias("label"),
        )
    )


def fences(settled: DataFrame) -> DataFrame:
    """Per quote and source: the chosen basis and the bounds outside which a listing is dropped."""
    return settled.where("source is not null").groupBy("quote_id", "source").agg(
        F.max("basis").alias("basis"), F.max("low").alias("low"), F.max("high").alias("high")
    )


def fences_by_quote(settled: DataFrame) -> DataFrame:
    """``quote_id, fences``: an array with the source, basis and bounds of each source of the quote."""
    return fences(settled).groupBy("quote_id").agg(
        F.collect_list(F.struct("source", "basis", "low", "high")).alias("fences"))


def source_order(source: Column, sources: list[tuple]) -> Column:
    """Display order of a source; unknown ones come last."""
    place = F.array_position(F.array(*[F.lit(key) for key, *_ in sources]), source)
    return F.when(place > 0, place).otherwise(F.lit(len(sources) + 1))


def source_label(source: Column, sources: list[tuple]) -> Column:
    label = source
    for key, text, *_ in sources:
        label = F.when(source == key, F.lit(text)).otherwise(label)
    return label


def quotes(
    settled: DataFrame, sources: list[tuple] = dims.SOURCES, levels: tuple[float, ...] = ()
) -> DataFrame:
    """One row per quote: basis, pooled statistics and the blend of its sources.

    Computed in two nested groupings over the same partitioning. A pooled percentile is the
    smallest price past a rank, so the smallest over sources of the per-source smallest. ``levels``
    adds further pooled percentiles, unrounded, as ``level_<percent>``.
    """
    pool = [(q, side) for q in sorted({0.25, 0.5, 0.75, *levels}) for side in ("lo", "hi")]
    kept, n, price = F.col("kept"), F.col("n"), F.col("price")

    def at(q: float, side: str) -> Column:
        position = (F.col("pool_total") - 1) * F.lit(q)
        rank = F.floor(position) if side == "lo" else F.ceil(position)
        return F.min(F.when(kept & (F.col("pool_running") > rank), price))

    pool_mean = F.col("pool_amount") / F.nullif(F.col("pool_total"), F.lit(0))
    per_source = settled.groupBy("quote_id", "source").agg(
        *_stats("", "running", "total", "amount"),
        *[at(q, side).alias(f"{side}{round(q * 100)}") for q, side in pool],
        F.sum(F.when(kept, n * F.pow(price - pool_mean, 2))).alias("pool_squares"),
        F.max(pool_mean).alias("pool_mean"),
        F.max("pool_total").alias("pool_total"),
        *[F.max(c).alias(c) for c in ("basis", "has_target", "n_model", "n_brand", "n_loose")],
    )
    used = F.col("count") > 0
    entry = F.struct(source_order(F.col("source"), sources).alias("o"), F.col("source").alias("s"))
    merged = per_source.groupBy("quote_id").agg(
        *[F.max(c).alias(c) for c in ("basis", "has_target", "n_model", "n_brand", "n_loose")],
        F.max("pool_total").alias("combined_count"),
        F.min("min").alias("combined_min"),
        F.max("max").alias("combined_max"),
        *[F.min(f"{side}{round(q * 100)}").cast("double").alias(f"{side}{round(q * 100)}") for q, side in pool],
        F.max("pool_mean").alias("pool_mean"),
        F.sum("pool_squares").alias("pool_squares"),
        round_half_up(F.avg(F.when(used, F.col("median")))).alias("equal_weight_median"),
        round_half_up(F.avg(F.when(used, F.col("mean")))).alias("equal_weight_mean"),
        # one element per source of the quote
        F.transform(F.array_sort(F.collect_list(F.when(used, entry))), lambda e: e["s"])
        .alias("sources_used"),
    )

    def exact_percentile(q: float) -> Column:
        lo, hi = F.col(f"lo{round(q * 100)}"), F.col(f"hi{round(q * 100)}")
        position = (F.col("combined_count") - 1) * F.lit(q)
        between = lo * (F.ceil(position) - position) + hi * (position - F.floor(position))
        return F.when(lo == hi, lo).otherwise(between)

    def pool_percentile(q: float) -> Column:
        return round_half_up(exact_percentile(q))

    size = F.col("combined_count")
    model, brand, loose = F.col("n_model"), F.col("n_brand"), F.col("n_loose")
    return merged.select(
        "quote_id",
        F.col("basis").alias("basis_tier"),
        "has_target", "n_model", "n_brand", "n_loose",
        F.when(F.col("basis") == "model", model).when(F.col("basis") == "brand", model + brand)
        .otherwise(model + brand + loose).alias("n_basis"),
        "equal_weight_median",
        "equal_weight_mean",
        round_half_up(F.col("pool_mean")).alias("weighted_mean"),
        "sources_used",
        "combined_count",
        "combined_min",
        pool_percentile(0.25).alias("combined_p25"),
        pool_percentile(0.5).alias("combined_median"),
        pool_percentile(0.75).alias("combined_p75"),
        "combined_max",
        round_half_up(F.col("pool_mean")).alias("combined_mean"),
        round_half_up(
            F.when(size == 1, F.lit(0.0)).when(size > 1, F.sqrt(F.col("pool_squares") / (size - 1)))
        ).alias("combined_stdev"),
        (pool_percentile(0.75) - pool_percentile(0.25)).alias("combined_iqr"),
        *[exact_percentile(q).alias(f"level_{round(q * 100)}") for q in levels],
    )
