"""What a reader of a quote should know about it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide import dims
from pricetide.operators.stats import source_label, source_order


def quote_warnings(settled: DataFrame, groups: DataFrame | None, sources: list[tuple]) -> DataFrame:
    """``quote_id, warnings ARRAY<STRING>`` in order; an empty array where there is nothing to say."""
    per_source = settled.groupBy("quote_id", "source").agg(
        F.max("total").alias("count"),
        *[F.max(c).alias(c) for c in ("basis", "has_target", "n_model")],
    )
    if groups is None:
        per_source = per_source.withColumn("error", F.lit(None).cast("string"))
    else:
        per_source = per_source.join(groups.select("quote_id", "source", "error"), ["quote_id", "source"], "left")

    count, error = F.col("count"), F.col("error")
    order = source_order(F.col("source"), sources).alias("o")
    label = source_label(F.col("source"), sources)
    thin = error.isNull() & (count > 0) & (count < dims.THIN_SOURCE)
    # one entry per source of the quote
    per_quote = per_source.groupBy("quote_id").agg(
        *[F.max(c).alias(c) for c in ("basis", "has_target", "n_model")],
        F.sum("count").alias("total"),
        F.count_if(count > 0).alias("used"),
        F.array_sort(F.collect_list(F.when(error.isNotNull(), F.struct(order, F.concat(label, F.lit(": "), error).alias("t")))))
        .alias("errors"),
        F.array_sort(F.collect_list(F.when(thin, F.struct(order, label.alias("t"))))).alias("thin"),
    )
    head, tail = dims.WIDENED_WARNING.split("{}")
    failed = F.size("errors") > 0
    about_basis = F.when(
        F.col("has_target") & (F.col("basis") == "all"), F.lit(dims.NO_MATCH_WARNING)
    ).when(
        (F.col("basis") == "brand") & (F.col("n_model") > 0),
        F.concat(F.lit(head), F.col("n_model").cast("string"), F.lit(tail)),
    )
    about_thin = F.when(
        F.size("thin") > 0,
        F.concat(F.lit(dims.THIN_WARNING), F.array_join(F.transform("thin", lambda e: e["t"]), " / ")),
    )
    about_input = F.when((F.col("total") == 0) & ~failed, F.lit(dims.EMPTY_WARNING)).when(
        F.col("used") == 1, F.lit(dims.ONE_SOURCE_WARNING)
    )
    return per_quote.select(
        "quote_id",
        F.concat(
            F.transform("errors", lambda e: e["t"]),
            F.array_compact(F.array(about_basis, about_thin, about_input)),
        ).alias("warnings"),
    )
