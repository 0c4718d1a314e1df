"""Stateless parsing of arriving pastes.

A quote is always recomputed from all of its text, so only parsing is incremental: listings are
appended as pastes arrive, and quotes are rebuilt from the listings table by the batch job. Where
pastes name their ``page``, listings keep it, and ``stored_listings`` numbers them over all pages of a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pricetide.operators import parse
from pricetide.operators.positions import number_rows
from pricetide.plans.quote import title_keys

PASTES = "quote_id string, source string, text string"
PAGED_PASTES = "quote_id string, source string, page bigint, text string"


def read_pastes(spark: SparkSession, folder: str, schema: str = PASTES) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def append_listings(pastes: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Parse arriving pastes into a Parquet listings table that holds the title keys as well."""
    listings = title_keys(parse.entries(parse.parse_pastes(pastes)))
    return (
        listings.writeStream.format("parquet")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stored_listings(spark: SparkSession, folder: str) -> DataFrame:
    """The listings that have arrived, with ``pos`` counted on from page to page of the same quote and source.

    A listing without a page comes before those with one. Two pages of one number are taken as one page, whose
    listings are ordered by place, title and price. A folder written without pages is returned as it is.
    """
    rows = spark.read.parquet(folder)
    if "page" not in rows.columns:
        return rows
    return number_rows(rows, ["quote_id", "source"], ["page", "pos", "title", "price"], F.coalesce("page", F.lit(-1)))
