"""Recogniser output: lines of text with a confidence each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES = "array<struct<text:string,confidence:double>>"
SCHEMA = (
    "photo_id bigint, ord int, kind string, degrees int, confidence double, text string, "
    f"lines {LINES}, blocks array<struct<paragraphs:array<struct<lines:{LINES}>>>>"
)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return with_lines(spark.read.schema(SCHEMA).json(path))


def with_lines(recognised: DataFrame) -> DataFrame:
    """``lines`` where given, else those of all blocks and paragraphs in order."""
    paragraphs = F.flatten(F.transform("blocks", lambda b: F.coalesce(
        b["paragraphs"], F.array().cast(f"array<struct<lines:{LINES}>>"))))
    nested = F.flatten(F.transform(paragraphs, lambda p: F.coalesce(p["lines"], F.array().cast(LINES))))
    lines = F.when(F.size("lines") > 0, F.col("lines")).otherwise(F.coalesce(nested, F.array().cast(LINES)))
    return recognised.withColumn("lines", lines).drop("blocks")
