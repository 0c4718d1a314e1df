"""Result rows, source cards and headline notes as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricetide import dims
from pricetide.functions.money import yen
from pricetide.operators.match import tier_label, within_basis
from pricetide.operators.stats import source_label, source_order


def listing_rows(classified: DataFrame, sources: list[tuple]) -> DataFrame:
    """Final state of every listing: outliers excluded, ``in_basis`` set, labels and status added.

    ``classified`` carries the ``fences`` of its quote, one entry per source.
    """
    own = F.get(F.filter("fences", lambda f: f["source"].eqNullSafe(F.col("source"))), F.lit(0))
    joined = classified.withColumn("fence", own).select(
        "*", *[F.col(f"fence.{c}").alias(c) for c in ("basis", "low", "high")])
    candidate = ~F.col("excluded") & within_basis(F.col("basis"), F.col("tier"))
    outside = (F.col("price") < F.col("low")) | (F.col("price") > F.col("high"))
    marked = joined.withColumn("candidate", candidate).withColumn(
        "outlier", F.col("candidate") & F.coalesce(outside, F.lit(False))
    )
    digits = F.col("pos").cast("string")
    padded = F.lpad(digits, F.greatest(F.lit(4), F.length(digits)), F.lit("0"))
    final = marked.select(
        "quote_id", "source",
        source_label(F.col("source"), sources).alias("label"),
        F.concat(F.col("source"), F.lit("-"), padded).alias("item_id"),
        "pos", "title", "price",
        (F.col("excluded") | F.col("outlier")).alias("excluded"),
        F.when(F.col("outlier"), F.lit(dims.OUTLIER_REASON)).otherwise(F.col("exclude_reason"))
        .alias("exclude_reason"),
        "tier",
        tier_label(F.col("tier")).alias("tier_label"),
        (F.col("candidate") & ~F.col("outlier")).alias("in_basis"),
    )
    return final.withColumn(
        "status",
        F.when(F.col("excluded"), F.col("exclude_reason"))
        .when(F.col("in_basis"), F.lit(dims.STATUS_USED))
        .otherwise(F.lit(dims.STATUS_OUTSIDE)),
    )


# up to this limit Spark itself drops surplus rows of a group before the shuffle
GROUP_LIMIT = 1000
SALTS = 64


def shown_rows(
    rows: DataFrame,
    include_excluded: bool = False,
    sort_key: str = "price",
    descending: bool = False,
    limit: int = dims.ROWS_SHOWN,
    sources: list[tuple] = dims.SOURCES,
) -> DataFrame:
    """The first rows of each quote by ``label, title, price`` or ``tier``.

    Equal keys keep the order of sources and, within a source, of arrival, whichever way the key
    runs. Surplus rows of a quote are dropped before the shuffle: by Spark for small limits, and by
    a first round over pieces of the quote for large ones.
    """
    if not include_excluded:
        rows = rows.filter("in_basis")
    key = F.col(sort_key) if sort_key == "price" else F.coalesce(F.col(sort_key), F.lit(""))
    order = [key.desc() if descending else key.asc(), source_order(F.col("source"), sources), "source",
             F.col("pos").asc_nulls_last()]
    if limit > GROUP_LIMIT:
        piece = Window.partitionBy("quote_id", F.pmod(F.xxhash64("source", "pos"), F.lit(SALTS))).orderBy(*order)
        rows = rows.withColumn("place", F.row_number().over(piece)).filter(F.col("place") <= limit).drop("place")
    window = Window.partitionBy("quote_id").orderBy(*order)
    return rows.withColumn("place", F.row_number().over(window)).filter(F.col("place") <= limit)


def source_cards(source_stats: DataFrame, parse_report: DataFrame | None, sources: list[tuple]) -> DataFrame:
    """Per source: headline statistics, used and read counts, exclusions apart from outliers."""
    cards = source_stats.select(
        "quote_id", "source",
        source_label(F.col("source"), sources).alias("label"),
        "median", "mean", "p25", "p75",
        F.col("count").alias("used"),
        F.col("n_read").alias("read"),
        (F.col("excluded_count") - F.col("outlier_count")).alias("excluded"),
        F.col("outlier_count").alias("outliers"),
    )
    if parse_report is None:
        return cards.select("*", F.lit(0).cast("bigint").alias("untitled"), F.lit(None).cast("string").alias("error"))
    notes = parse_report.select("quote_id", "source", F.col("untitled").cast("bigint").alias("untitled"), "error")
    return cards.join(notes, ["quote_id", "source"], "left")


def headlines(quotes: DataFrame) -> DataFrame:
    """Headline price, usual range, and the note on what the quote was computed from."""
    headline = F.coalesce("equal_weight_median", "combined_median")
    counts = F.concat_ws(" / ", *[
        F.concat(F.lit(f"{text} "), F.col(f"n_{tier}"), F.lit(" 件"))
        for tier, text in dims.BASIS_PARTS.items()
    ])
    whole_head, whole_tail = dims.WHOLE_NOTE.split("{}")
    note = F.when(
        ~F.col("has_target"),
        F.concat(
            F.lit(whole_head), F.col("n_basis"), F.lit(whole_tail),
        ),
    ).otherwise(
        F.concat(tier_label(F.col("basis_tier")), F.lit("の "), F.col("n_basis"),
                 F.lit(" 件で計算（内訳: "), counts, F.lit("）"))
    )
    return quotes.select(
        "quote_id",
        headline.alias("headline"),
        F.concat(yen(F.col("combined_p25")), F.lit(" 〜 "), yen(F.col("combined_p75"))).alias("usual_range"),
        F.coalesce("weighted_mean", "combined_mean").alias("average"),
        F.col("combined_count").alias("n"),
        F.col("combined_min").alias("cheapest"),
        F.col("combined_max").alias("dearest"),
        note.alias("basis_note"),
    )
