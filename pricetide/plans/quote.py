"""Listings to quotes, for many searches at once.

    listings ⋈ per-quote terms  ->  classified rows            (one join on quote_id)
    classified rows             ->  price counts               (partial counts before the shuffle)
    price counts                ->  settled counts             (windows within quote_id)
    settled counts              ->  statistics, quotes, histogram, warnings

``QuoteJob`` only names the steps; every attribute is a lazy DataFrame, but ``keep_counts`` and ``wide`` make the first
one that needs the counts run the job that classifies and stores them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide import dims
from pricetide.functions import text as tx
from pricetide.operators import clean, histogram, match, stats, verdict, views, warnings, wide_stats
from pricetide.session import cut_lineage


def terms(options: DataFrame, targets: DataFrame | None, keep_models: bool = True) -> DataFrame:
    """One row per quote that has options or a target: completed options, target keys, ``rejected``.

    Every option is optional, and so is the row that holds them: what is missing has its default.
    Quotes whose bounds cross are marked as rejected.
    """
    valid, crossed = clean.split_by_validity(options)
    defaults = clean.default_terms()
    rejected = crossed.select("quote_id", *[value.alias(name) for name, value in defaults.items()], F.lit(True).alias("rejected"))
    completed = clean.complete_options(valid).withColumn("rejected", F.lit(False)).unionByName(rejected)
    if targets is None:
        return completed.select("*", *[value.alias(name) for name, value in no_target().items()])
    # Joined on a wrapped key, so that the result is not yet partitioned by quote_id: AQE splits a
    # skewed partition of the listings join only where both of its sides come from a shuffle.
    ready = match.complete_targets(targets)
    ready = (ready if keep_models else match.without_models(ready)).withColumn("key", F.struct("quote_id")).drop("quote_id")
    joined = completed.withColumn("key", F.struct("quote_id")).drop("quote_id").join(ready, "key", "full")
    return joined.select(
        F.col("key.quote_id").alias("quote_id"),
        *[F.coalesce(name, value).alias(name) for name, value in all_defaults().items()],
    )


def no_target() -> dict[str, Column]:
    """The target keys of a quote without a target."""
    return {
        "has_target": F.lit(False),
        "models": match.empty_words(),
        "model_lengths": F.array().cast("array<int>"),
        "model_starts": match.empty_words(),
        "aliases": match.empty_words(),
    }


def all_defaults() -> dict[str, Column]:
    return clean.default_terms() | {"rejected": F.lit(False)} | no_target()


def title_keys(listings: DataFrame) -> DataFrame:
    """Adds the normal and the folded form of each title, worth storing at ingest.

    Spark takes the call that normalises for non-deterministic and pushes no filter past it. Over
    listings that hold both forms, a filter on a quote reaches the scan.
    """
    normal = listings.withColumn("title_normal", tx.nfkc(F.col("title")))
    squeezed = normal.withColumn("title_normal", tx.squeeze(F.col("title_normal")))
    return squeezed.withColumn("title_folded", tx.fold_normal(F.col("title_normal")))


def keyed_listings(listings: DataFrame) -> DataFrame:
    """Listings with title keys, stored or made here."""
    return listings if {"title_normal", "title_folded"} <= set(listings.columns) else title_keys(listings)


def classify(listings: DataFrame, per_quote: DataFrame, model_titles: DataFrame | None = None) -> DataFrame:
    """Adds ``excluded, exclude_reason, tier`` and the quote's settings to every listing.

    The join is an ordinary one on ``quote_id``: Spark broadcasts ``per_quote`` when it measures it
    as small, and otherwise AQE splits the partition of a quote that holds very many listings. A
    listing of a quote without terms has the defaults; one of a rejected quote, or without any
    quote, is left out. Columns of ``per_quote`` beyond the terms pass through. ``model_titles`` (of
    ``match.titles_with_models``) stands in for the models among the terms.
    """
    defaults = all_defaults()
    further = [c for c in per_quote.columns if c not in defaults and c != "quote_id"]
    keyed = keyed_listings(listings)
    joined = keyed.where("quote_id is not null").join(per_quote, "quote_id", "left").where(
        ~F.coalesce("rejected", F.lit(False))).withColumns(
        {name: F.coalesce(name, value) for name, value in defaults.items()})
    reason = clean.exclusion_reason(
        F.col("title_normal"), F.col("price"), F.col("price_min"), F.col("price_max"),
        F.col("rules_on"), F.col("exclude_words"),
    )
    holds_model = None
    if model_titles is not None:
        joined = joined.withColumn("compacted", tx.compact(F.col("title_folded"))).join(
            model_titles, ["quote_id", "compacted"], "left")
        holds_model = F.coalesce("holds_model", F.lit(False))
    tier = match.match_tier(
        F.col("title_folded"), F.col("models"), F.col("model_lengths"), F.col("model_starts"), F.col("aliases"), holds_model)
    keep = [c for c in ("pos", "title") if c in listings.columns]
    is_listing = F.col("is_listing") if "is_listing" in listings.columns else F.lit(True)
    return (
        joined.withColumn("exclude_reason", reason)
        .select(
            "quote_id", "source", *keep, "price",
            F.col("exclude_reason").isNotNull().alias("excluded"),
            "exclude_reason",
            F.when(F.col("has_target"), tier).otherwise(F.lit("loose")).alias("tier"),
            is_listing.alias("is_listing"),
            "has_target", "remove_outliers", "iqr_k", "min_basis_count", *further,
        )
    )


@dataclass(frozen=True)
class QuoteJob:
    """``listings(quote_id, source, pos, title, price)`` with options, targets and input groups.

    ``groups(quote_id, source, error)`` is optional: a row per pasted source, so that sources without
    a single listing still appear. Quotes are those of options, targets, groups and listings alike;
    one without listings counts 0 and warns. ``keep_counts`` checkpoints the price counts: worth it
    where several results are taken from one job, since the listings are then classified once.
    ``store_counts`` and ``with_counts`` do the same by a table in a folder of the caller's choice.
    ``wide`` is for quotes with more prices than a task should sort: ranks are then found in two levels
    (``operators.wide_stats``), at the price of three joins; results are the same. Counts are then stored, since each level reads them. ``many_models`` is for quotes
    whose target has more models than should travel with its listings: titles then meet models in a join.
    ``unplaced`` are the same listings without positions, for the counts, where giving a position costs a join.

    The plan relies on the settings of ``pricetide.session``: ``tune(spark)`` sets them on a session
    that was built without them, else a hot quote's join partition stays in one piece.
    """

    listings: DataFrame
    options: DataFrame
    targets: DataFrame | None = None
    groups: DataFrame | None = None
    sources: list | None = None
    keep_counts: bool = False
    counts: DataFrame | None = None
    wide: bool = False
    many_models: bool = False
    unplaced: DataFrame | None = None

    def only(self, quote_ids: list) -> QuoteJob:
        """The same job for some quotes. All inputs are filtered first, so that the filter reaches their scans."""
        def some(df: DataFrame | None) -> DataFrame | None:
            return None if df is None else df.where(F.col("quote_id").isin(list(quote_ids)))

        return replace(self, listings=some(self.listings), options=some(self.options), targets=some(self.targets),
                       groups=some(self.groups), counts=some(self.counts), unplaced=some(self.unplaced))

    def store_counts(self, path: str) -> None:
        """Write the price counts as a new table, for ``with_counts``; a folder that is there may have readers and is left alone."""
        self.counted.write.mode("error").parquet(path)

    def with_counts(self, path: str) -> QuoteJob:
        """The same job on stored counts: listings are read for ``rows`` only."""
        return replace(self, counts=self.listings.sparkSession.read.parquet(path))

    @cached_property
    def source_groups(self) -> DataFrame | None:
        """One row per quote and source, whatever ``groups`` holds."""
        if self.groups is None:
            return None
        untitled = F.sum("untitled") if "untitled" in self.groups.columns else F.lit(0)
        return self.groups.groupBy("quote_id", "source").agg(
            F.max("error").alias("error"), untitled.cast("bigint").alias("untitled"))

    @property
    def source_list(self) -> list:
        return self.sources or dims.SOURCES

    @cached_property
    def per_quote(self) -> DataFrame:
        return terms(self.options, self.targets, keep_models=not self.many_models)

    @cached_property
    def model_titles(self) -> DataFrame | None:
        if self.targets is None or not self.many_models:
            return None
        # titles need no positions, and giving those costs a join
        listings = self.listings if self.unplaced is None else self.unplaced
        return match.titles_with_models(keyed_listings(listings), self.targets)

    @cached_property
    def rejects(self) -> DataFrame:
        return clean.split_by_validity(self.options)[1]

    @cached_property
    def classified(self) -> DataFrame:
        return classify(self.listings, self.per_quote, self.model_titles)

    @cached_property
    def counted(self) -> DataFrame:
        if self.counts is not None:
            return self.counts
        # a row that is no listing keeps its source visible, and one without a source its quote
        empty = self.per_quote.select("quote_id", F.lit(None).cast("string").alias("source"))
        if self.groups is not None:
            empty = empty.unionByName(self.groups.select("quote_id", "source"))
        blank = empty.select(
            "quote_id", "source", F.lit(None).cast("string").alias("title"),
            F.lit(None).cast("bigint").alias("price"), F.lit(False).alias("is_listing"))
        keys = [c for c in ("title_normal", "title_folded") if c in self.listings.columns]
        listings = self.listings if self.unplaced is None else self.unplaced
        rows = listings.select("quote_id", "source", "title", "price", F.lit(True).alias("is_listing"), *keys)
        counts = stats.price_counts(classify(
            rows.unionByName(blank.select("*", *[F.lit("").alias(k) for k in keys])), self.per_quote, self.model_titles))
        return cut_lineage(counts) if self.keep_counts or self.wide else counts

    @cached_property
    def settled(self) -> DataFrame:
        return wide_stats.settle(self.counted) if self.wide else stats.settle(self.counted)

    @cached_property
    def basis(self) -> DataFrame:
        return stats.basis_choice(self.settled)

    @cached_property
    def source_stats(self) -> DataFrame:
        return stats.source_stats(self.settled)

    @cached_property
    def pooled_stats(self) -> DataFrame:
        return stats.pooled_stats(self.settled)

    @cached_property
    def quotes(self) -> DataFrame:
        return stats.quotes(self.settled, self.source_list)

    @cached_property
    def histogram(self) -> DataFrame:
        return histogram.stacked(self.settled, wide=self.wide)

    @cached_property
    def warnings(self) -> DataFrame:
        return warnings.quote_warnings(self.settled, self.source_groups, self.source_list)

    @cached_property
    def rows(self) -> DataFrame:
        """Every listing with its final state. Bounds travel with the terms, so listings are joined once."""
        bounds = stats.fences_by_quote(self.settled).withColumn("key", F.struct("quote_id")).drop("quote_id")
        fenced = self.per_quote.withColumn("key", F.struct("quote_id")).drop("quote_id").join(bounds, "key", "full").select(
            F.col("key.quote_id").alias("quote_id"), *[c for c in self.per_quote.columns if c != "quote_id"], "fences")
        return views.listing_rows(classify(self.listings, fenced, self.model_titles), self.source_list)

    @cached_property
    def cards(self) -> DataFrame:
        return views.source_cards(self.source_stats, self.source_groups, self.source_list)

    def verdicts(self, tags: DataFrame) -> DataFrame:
        """Shop tags against these quotes; best with ``keep_counts``, as the counts are read twice."""
        levelled = stats.quotes(self.settled, self.source_list, verdict.LEVELS)
        return verdict.judge(tags, stats.kept_prices(self.settled), levelled)
