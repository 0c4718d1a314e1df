"""Arrival order within a group, without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def number_rows(df: DataFrame, keys: list[str], order: list[str], block: Column, name: str = "pos") -> DataFrame:
    """0-based position of each row in its group.

    ``block`` must not decrease along ``order`` (for instance an order key divided by a constant).
    Rows are numbered inside (keys, block), and each block starts after the sizes of those before it, so
    a group of any size is spread over its blocks.
    """
    blocked = df.withColumn("block", block)
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocked.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("size")).select(
        *keys, "block", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start")
    )
    inside = Window.partitionBy(*keys, "block").orderBy(*order)
    return (
        blocked.withColumn("place", F.row_number().over(inside))
        .join(starts, [*keys, "block"])
        .withColumn(name, F.col("start") + F.col("place") - 1)
        .drop("block", "start", "place")
    )
