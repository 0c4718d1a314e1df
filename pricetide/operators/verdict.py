"""Is a shop's price tag fair? Verdict, position, confidence and the factors behind them.

A verdict depends on the quote, the tag price and the condition only. Tags are therefore reduced to
distinct (quote, price, condition) points first, and the number of cheaper listings comes from one
running count over prices and points together: no tag ever meets a listing in a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricetide import dims
from pricetide.functions.money import round_half_up, round_to_cents, yen

# Percentiles of the quote's prices a verdict reads.
LEVELS = (0.25, 0.30, 0.50, 0.65, 0.75, 0.80)
POINT = ["quote_id", "shop_price", "condition"]


def level_name(q: float) -> str:
    return f"level_{round(q * 100)}"


def has_price(shop_price: Column) -> Column:
    value = shop_price.cast("double")
    return F.coalesce(~F.isnan(value) & (value > 0) & (value < float("inf")), F.lit(False))


def condition_or_default(condition: Column) -> Column:
    keys = [key for key, *_ in dims.CONDITIONS]
    return F.when(condition.isin(keys), condition).otherwise(F.lit(dims.DEFAULT_CONDITION))


def _of_condition(condition: Column, pick) -> Column:
    result = None
    for row in dims.CONDITIONS:
        result = F.when(condition == row[0], pick(row)) if result is None else result.when(
            condition == row[0], pick(row))
    return result


def _of_band(ratio: Column, part: int) -> Column:
    """A missing ratio falls into the first band."""
    result = F.when(ratio.isNull() | (ratio <= dims.BANDS[0][3]), F.lit(dims.BANDS[0][part]))
    for band in dims.BANDS[1:-1]:
        result = result.when(ratio <= band[3], F.lit(band[part]))
    return result.otherwise(F.lit(dims.BANDS[-1][part]))


def confidence(tier: Column, count: Column, median: Column, iqr: Column) -> Column:
    """``STRUCT<level, label, score, spread, reasons ARRAY<STRUCT<tone, text>>>``."""
    def reason(tone: str, *text) -> Column:
        return F.struct(F.lit(tone).alias("tone"), F.concat(*text).alias("text"))

    n = count.cast("string")
    by_model, by_brand = tier == "model", tier == "brand"
    spread = F.when(median > 0, iqr / median)
    tight = F.coalesce((spread <= 0.5) & (count >= 8), F.lit(False))
    loose = F.coalesce(spread > 1.0, F.lit(False))
    score = (
        F.when(by_model, 2).when(by_brand, 1).otherwise(0)
        + F.when(count >= 12, 2).when(count >= 8, 1).when(count >= 5, 0).otherwise(-1)
        + F.when(tight, 1).when(loose, -1).otherwise(0)
    )
    level = (
        F.when(count < 5, F.lit("low"))
        .when((score >= 4) & by_model, F.lit("high"))
        .when(score >= 2, F.lit("medium"))
        .otherwise(F.lit("low"))
    )
    about_tier = (
        F.when(by_model, reason("good", F.lit(dims.WHY_MODEL)))
        .when(by_brand, reason("warning", F.lit(dims.WHY_BRAND)))
        .otherwise(reason("warning", F.lit(dims.WHY_ALL)))
    )
    about_count = (
        F.when(count >= 12, reason("good", n, F.lit(dims.WHY_MANY)))
        .when(count >= 8, reason("neutral", n, F.lit(dims.WHY_SOME)))
        .when(count >= 5, reason("warning", n, F.lit(dims.WHY_FEW)))
        .otherwise(reason("warning", n, F.lit(dims.WHY_TOO_FEW)))
    )
    about_spread = F.when(tight, reason("good", F.lit(dims.WHY_TIGHT))).when(
        loose, reason("warning", F.lit(dims.WHY_LOOSE))
    )
    label = F.when(level == "high", F.lit("高い")).when(level == "medium", F.lit("ふつう")).otherwise(F.lit("低い"))
    return F.struct(
        level.alias("level"), label.alias("label"), score.alias("score"),
        round_to_cents(spread).alias("spread"),
        F.array_compact(F.array(about_tier, about_count, about_spread)).alias("reasons"),
    )


STRETCH = 4096  # yen


def cheaper_counts(points: DataFrame, prices: DataFrame) -> DataFrame:
    """For each distinct (quote_id, shop_price): how many listings are strictly cheaper.

    ``prices(quote_id, price, n)``. At equal values points sort before prices, so a running sum up
    to a point counts what lies below it.
    """
    probes = points.select("quote_id", "shop_price").distinct().select(
        "quote_id", F.col("shop_price").alias("value"), F.lit(0).alias("is_price"), F.lit(0).cast("bigint").alias("n")
    )
    kind = points.schema["shop_price"].dataType
    listed = prices.select("quote_id", F.col("price").cast(kind).alias("value"), F.lit(1).alias("is_price"), "n")
    # counted within stretches of values first: neither the tags nor the prices of a quote meet in one task
    rows = probes.unionByName(listed).withColumn("stretch", F.coalesce(F.floor(F.col("value") / STRETCH), F.lit(-1)))
    so_far = Window.partitionBy("quote_id", "stretch").orderBy("value", "is_price").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("quote_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = listed.withColumn("stretch", F.coalesce(F.floor(F.col("value") / STRETCH), F.lit(-1))).groupBy(
        "quote_id", "stretch").agg(F.sum("n").alias("n"))
    starts = rows.select("quote_id", "stretch").distinct().join(before, ["quote_id", "stretch"], "left").select(
        "quote_id", "stretch", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    return (
        rows.withColumn("inside", F.sum("n").over(so_far))
        .filter("is_price = 0")
        .join(starts, ["quote_id", "stretch"])
        .select("quote_id", F.col("value").alias("shop_price"), (F.col("start") + F.col("inside")).alias("cheaper"))
    )


def judge(tags: DataFrame, prices: DataFrame, quotes: DataFrame) -> DataFrame:
    """Verdict of every tag.

    ``tags(tag_id, quote_id, shop_price, condition)``; ``prices(quote_id, price, n)`` kept by the
    quote; ``quotes`` with its ``level_*`` percentiles. Ineligible tags keep a row with a reason.
    """
    keyed = tags.withColumn("condition", condition_or_default(F.col("condition")))
    points = keyed.filter(has_price(F.col("shop_price"))).select(*POINT).distinct()
    measured = (
        points.join(cheaper_counts(points, prices), ["quote_id", "shop_price"])
        .join(
            quotes.select(
                "quote_id", "basis_tier", F.col("combined_count").alias("count"),
                F.coalesce("equal_weight_median", "combined_median").cast("double").alias("anchor"),
                *[level_name(q) for q in LEVELS],
            ),
            "quote_id", "left",
        )
        .withColumn("count", F.coalesce("count", F.lit(0)))
    )
    middle = F.col(level_name(0.5))
    base = F.when(F.col("anchor") > 0, F.col("anchor")).otherwise(middle)
    share = _of_condition(F.col("condition"), lambda row: F.col(level_name(row[2])))
    targeted = measured.select(
        *POINT, "cheaper", "count", F.col("basis_tier").alias("tier"),
        round_half_up(F.when(middle > 0, base * (share / middle)).otherwise(base)).alias("target"),
        round_half_up(middle).alias("median"),
        round_half_up(F.col(level_name(0.75)) - F.col(level_name(0.25))).alias("iqr"),
    ).withColumn("raw_ratio", F.when(F.col("target") > 0, F.col("shop_price") / F.col("target")))
    ratio, count = F.col("raw_ratio"), F.col("count")
    rated = targeted.select(
        *POINT, "cheaper", "count", "tier", "target", "median", "raw_ratio",
        F.coalesce(round_to_cents(ratio), F.lit(0.0)).alias("ratio"),
        F.struct(*[_of_band(ratio, i).alias(n) for i, n in enumerate(("key", "label", "tone"))]).alias("verdict"),
        round_half_up(F.col("cheaper") / F.nullif(count, F.lit(0)) * 100).alias("position_pct"),
        confidence(F.col("tier"), count, F.col("median"), F.col("iqr")).alias("confidence"),
    )
    judged = rated.select("*", _factors().alias("factors"))
    verdicts = keyed.join(judged, POINT, "left")
    eligible = has_price(F.col("shop_price"))
    size = F.coalesce("count", F.lit(0))
    ok = eligible & (size >= dims.MIN_VERDICT_PRICES)
    head, tail = dims.TOO_FEW_PRICES.split("{}")
    reason = F.when(~eligible, F.lit(dims.NO_SHOP_PRICE)).when(
        ~ok, F.concat(F.lit(head), size.cast("string"), F.lit(tail)))
    details = ["target", "median", "ratio", "verdict", "position_pct", "count", "confidence", "factors"]
    return verdicts.select(
        "tag_id", "quote_id", "shop_price", "condition",
        ok.alias("ok"), reason.alias("reason"),
        *[F.when(ok, F.col(c)).alias(c) for c in details],
        F.when(ok, F.array(*[F.lit(t) for t in dims.OFF_BOOK])).alias("off_book"),
    )


def _factors() -> Column:
    def factor(key: str, value: Column, note: Column, tone: Column) -> Column:
        return F.struct(F.lit(key).alias("key"), F.lit(dims.FACTOR_LABELS[key]).alias("label"), value.alias("value"),
                        note.alias("note"), tone.alias("tone"))

    reasons, level = F.col("confidence.reasons"), F.col("confidence.level")
    condition = _of_condition(F.col("condition"), lambda row: F.lit(row[1]))
    compared = F.when(F.col("tier") == "model", F.lit(dims.COMPARED_WITH["model"])).when(
        F.col("tier") == "brand", F.lit(dims.COMPARED_WITH["brand"])).otherwise(F.lit(dims.COMPARED_WITH["all"]))
    others = F.transform(F.slice(reasons, 2, 9), lambda r: r["text"])
    percent = F.coalesce(round_half_up(F.col("raw_ratio") * 100), F.lit(0))
    return F.array(
        factor(
            "ratio", F.concat(percent.cast("string"), F.lit("%")),
            F.concat(condition, F.lit(dims.RATIO_NOTE[0]), yen(F.col("target")), F.lit(dims.RATIO_NOTE[1]), yen(F.col("shop_price"))),
            F.col("verdict.tone"),
        ),
        factor(
            "position",
            F.concat(F.lit(dims.POSITION_VALUE), F.col("position_pct").cast("string"), F.lit("%")),
            F.concat(F.lit(dims.POSITION_NOTE[0]), F.col("count").cast("string"), F.lit(dims.POSITION_NOTE[1]),
                     F.col("cheaper").cast("string"), F.lit(dims.POSITION_NOTE[2])),
            F.lit("neutral"),
        ),
        factor("basis", compared, F.get(reasons, F.lit(0))["text"], F.get(reasons, F.lit(0))["tone"]),
        factor(
            "confidence", F.col("confidence.label"), F.array_join(others, " / "),
            F.when(level == "high", F.lit("good")).when(level == "low", F.lit("warning")).otherwise(F.lit("neutral")),
        ),
    )
