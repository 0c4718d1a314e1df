"""Paste scan: one text per (quote, source)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_text_files(spark: SparkSession, folder: str) -> DataFrame:
    """``quote_id, source, text`` from ``<folder>/<quote_id>/<source>.txt``. Paths are URIs and are decoded."""
    files = spark.read.text(f"{folder}/*/*.txt", wholetext=True)
    path = F.split(F.col("_metadata.file_path"), "/")

    def part(place: int):
        # url_decode would read a plus sign as a space
        return F.url_decode(F.replace(F.element_at(path, place), F.lit("+"), F.lit("%2B")))

    return files.select(
        part(-2).alias("quote_id"),
        F.regexp_replace(part(-1), r"\.txt$", "").alias("source"),
        F.col("value").alias("text"),
    )


def read_table(spark: SparkSession, folder: str) -> DataFrame:
    """The same from Parquet; a missing text counts as empty."""
    return spark.read.parquet(folder).select("quote_id", "source", F.coalesce("text", F.lit("")).alias("text"))


def read_entries(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Listings given already parsed: ``quote_id, source, pos, title, price``."""
    if form == "csv":
        schema = "quote_id string, source string, pos bigint, title string, price bigint"
        return spark.read.csv(path, schema=schema, header=True, escape='"')
    return spark.read.parquet(path).select("quote_id", "source", "pos", "title", "price")
