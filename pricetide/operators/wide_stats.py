"""Settled price counts for quotes too large for one task: exact ranks in two levels.

``stats.settle`` runs its windows over all price counts of a quote. Here prices are cut into stretches of
``STRETCH`` yen. Counts per stretch are narrow rows, a few hundred per quote and source, and windows over
those give the basis, totals and how many listings lie before each stretch. Inside a stretch, and
nowhere else, price rows are ordered; a rank is the offset of the stretch plus the place in it. What
is known per stretch joins back on (quote, source, stretch), so a quote's prices are dealt over as
many tasks as it has stretches. The narrow rows are stored at each level: every later one reads them, and would
otherwise work them out again from all counts.

Rows and columns are those of ``stats.settle``, so everything built on them stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricetide import dims
from pricetide.functions.order_stats import interpolated
from pricetide.operators import match
from pricetide.operators.stats import least_of_basis
from pricetide.session import cut_lineage

STRETCH = 4096
KEYS = ["quote_id", "source_key", "stretch"]
TIERS = ("model", "brand", "loose")


def in_stretches(counts: DataFrame, width: int = STRETCH) -> DataFrame:
    """Adds the stretch of each price and a source key that is never null."""
    return counts.withColumns({
        "source_key": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")),
        "stretch": F.coalesce(F.floor(F.col("price") / width), F.lit(-1)),
        "counted": ~F.col("excluded") & F.col("price").isNotNull(),
    })


def of_basis() -> Column:
    """How many of a stretch's listings are within the basis."""
    model, brand, loose = (F.col(f"t_{t}") for t in TIERS)
    basis = F.col("basis")
    return F.when(basis == "model", model).when(basis == "brand", model + brand).otherwise(model + brand + loose)


def offsets(rows: DataFrame) -> DataFrame:
    """Per stretch: the quote's basis, its own count within it, and the source's count before it and in all."""
    sums = rows.groupBy(*KEYS).agg(
        *[F.sum(F.when(F.col("counted") & (F.col("tier") == t), F.col("n")).otherwise(0)).alias(f"t_{t}") for t in TIERS],
        *[F.max(c).alias(c) for c in ("has_target", "remove_outliers", "iqr_k")], F.max(least_of_basis(rows)).alias("least"))
    quote = Window.partitionBy("quote_id")
    source = Window.partitionBy("quote_id", "source_key")
    placed = sums.select("*", *[F.sum(f"t_{t}").over(quote).alias(f"n_{t}") for t in TIERS]).withColumn(
        "basis", match.choose_basis(F.col("has_target"), F.col("n_model"), F.col("n_brand"), F.col("least"))).withColumn("in_stretch", of_basis())
    return placed.select(
        *KEYS, "has_target", "remove_outliers", "iqr_k", "basis", *[f"n_{t}" for t in TIERS], "in_stretch",
        (F.sum("in_stretch").over(source.orderBy("stretch")) - F.col("in_stretch")).alias("before"),
        F.sum("in_stretch").over(source).alias("total"))


def with_basis(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Price rows with what is known of their stretch, and their count if within the basis."""
    joined = rows.drop("has_target", "remove_outliers", "iqr_k").join(known, KEYS)
    inside = F.col("counted") & match.within_basis(F.col("basis"), F.col("tier"))
    return joined.withColumn("in_basis", F.coalesce(inside, F.lit(False))).withColumn(
        "m", F.when(F.col("in_basis"), F.col("n")).otherwise(F.lit(0)))


def running_in_source() -> Column:
    return F.col("before") + F.sum("m").over(Window.partitionBy(*KEYS).orderBy("price"))


def bounds(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Outlier bounds of each quote and source, from the exact quartiles."""
    ranked = with_basis(rows, known).withColumn("running", running_in_source())
    price, running, total, keep = (F.col(c) for c in ("price", "running", "total", "in_basis"))
    quartiles = ranked.groupBy("quote_id", "source_key").agg(
        interpolated(price, running, total, 0.25, keep).alias("q1"), interpolated(price, running, total, 0.75, keep).alias("q3"),
        *[F.max(c).alias(c) for c in ("total", "remove_outliers", "iqr_k")])
    spread = F.col("q3") - F.col("q1")
    bounded = F.col("remove_outliers") & (F.col("total") >= dims.MIN_FOR_BOUNDS) & (spread > 0)
    return quartiles.select(
        "quote_id", "source_key",
        F.when(bounded, F.col("q1") - F.col("iqr_k") * spread).alias("low"),
        F.when(bounded, F.col("q3") + F.col("iqr_k") * spread).alias("high"))


def outside() -> tuple[Column, Column]:
    price = F.col("price")
    return F.coalesce(price < F.col("low"), F.lit(False)), F.coalesce(price > F.col("high"), F.lit(False))


def kept_offsets(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``known`` with what is kept per stretch: offsets of source and pool, sums, and whether bounds apply."""
    below, above = outside()
    m, amount = F.col("m"), F.col("m") * F.col("price").cast("double")
    part = with_basis(rows, known).groupBy(*KEYS).agg(
        F.sum(F.when(below, m).otherwise(0)).alias("below"), F.sum(F.when(below | above, m).otherwise(0)).alias("outside"),
        F.sum(F.when(below | above, 0.0).otherwise(F.coalesce(amount, F.lit(0.0)))).alias("amount_inside"),
        F.sum(F.coalesce(amount, F.lit(0.0))).alias("amount_all"))
    source, quote = Window.partitionBy("quote_id", "source_key"), Window.partitionBy("quote_id")
    summed = known.join(part, KEYS).select(
        "*", F.sum("below").over(source).alias("n_below"), F.sum("outside").over(source).alias("n_outside"))
    # if every listing lay outside, none would be dropped
    summed = summed.withColumn("active", F.col("n_outside") < F.col("total")).withColumns({
        "kept_here": F.col("in_stretch") - F.when(F.col("active"), F.col("outside")).otherwise(0),
        "amount_here": F.when(F.col("active"), F.col("amount_inside")).otherwise(F.col("amount_all"))})
    # stretches of several sources are peers, so their counts are taken off again as a whole
    return summed.select(
        "*", F.sum("amount_here").over(source).alias("amount"),
        (F.sum("kept_here").over(quote.orderBy("stretch")) - F.sum("kept_here").over(Window.partitionBy("quote_id", "stretch"))).alias("pool_before"),
        F.sum("kept_here").over(quote).alias("pool_total"), F.sum("amount_here").over(quote).alias("pool_amount"))


def settle(counts: DataFrame, width: int = STRETCH) -> DataFrame:
    """As ``stats.settle``, without a window over all prices of a quote or source."""
    rows = in_stretches(counts, width)
    first = cut_lineage(offsets(rows))
    fenced = cut_lineage(first.join(bounds(rows, first), ["quote_id", "source_key"]))
    whole = with_basis(rows, kept_offsets(rows, fenced))
    below, above = outside()
    active = F.col("active")
    kept = whole.withColumn("running", running_in_source()).withColumn(
        "kept", F.col("in_basis") & ~(active & (below | above)))
    pooled = Window.partitionBy("quote_id", "stretch").orderBy("price")
    return kept.select(
        "quote_id", "source", "excluded", "price", "n", "basis", "has_target", "n_model", "n_brand", "n_loose",
        F.when(active, F.col("low")).alias("low"),
        F.when(active, F.col("high")).alias("high"),
        "kept",
        F.when(active, F.col("n_outside")).otherwise(0).alias("outlier_count"),
        (F.col("running") - F.when(active, F.col("n_below")).otherwise(0)).alias("running"),
        (F.col("total") - F.when(active, F.col("n_outside")).otherwise(0)).alias("total"),
        "amount",
        (F.col("pool_before") + F.sum(F.when(F.col("kept"), F.col("n")).otherwise(F.lit(0))).over(pooled)).alias("pool_running"),
        "pool_total", "pool_amount",
    )
