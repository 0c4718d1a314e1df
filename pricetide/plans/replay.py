"""Pastes to quotes, and saved records back to quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.operators import identify, parse
from pricetide.plans.quote import QuoteJob
from pricetide.session import written
from pricetide.sources.records import saved_pastes


def quotes_from_pastes(
    pastes: DataFrame,
    options: DataFrame,
    targets: DataFrame | None = None,
    entries: DataFrame | None = None,
    sources: list | None = None,
    keep_counts: bool = False,
    page: str | None = None,
    keep_pages: bool = False,
) -> QuoteJob:
    """``pastes(quote_id, source, text)``, optionally with listings that need no parsing.

    ``page`` names a column that orders the pages of a source; positions then run on over them, and
    entries given directly come after the pages. ``keep_pages`` stores the parsed pages: worth it where more than
    the listings is taken from them, as in cards and warnings, since they are then parsed once.
    """
    parsed = parse.parse_pastes(pastes)
    if keep_pages:
        parsed = written(parsed, "parsed-pages")
    listings = parse.entries(parsed, page).select("quote_id", "source", "pos", "title", "price")
    unplaced = parse.entries(parsed).select("quote_id", "source", "title", "price")
    groups = parse.report_by_source(parsed)
    if entries is not None:
        direct = parse.direct_report(entries)
        pasted = groups.select("quote_id", "source", F.col("prices_found").alias("before"))
        placed = entries.join(pasted, ["quote_id", "source"], "left").withColumn(
            "pos", F.col("pos") + F.coalesce("before", F.lit(0)))
        listings = listings.unionByName(placed.select(*listings.columns))
        unplaced = unplaced.unionByName(entries.select(*unplaced.columns))
        counts = ["quote_id", "source", "lines", "prices_found", "untitled"]
        groups = parse.merged_reports(groups.select(*counts).unionByName(direct.select(*counts)))
    return QuoteJob(listings, options, targets, groups, sources, keep_counts, unplaced=unplaced)


def replay(records: DataFrame, sources: list | None = None, keep_counts: bool = False) -> QuoteJob:
    """Recompute saved records from their texts.

    The tag text is identified again. Exclude words, price bounds and hints are not part of a record,
    so the replay runs with the defaults.
    """
    options = records.select(F.col("id").alias("quote_id"), "query")
    tags = records.select(F.col("id").alias("tag_id"), F.col("tag_text").alias("text"))
    targets = identify.as_targets(identify.identify(tags))
    return quotes_from_pastes(saved_pastes(records), options, targets, sources=sources, keep_counts=keep_counts)
