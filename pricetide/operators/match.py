"""How closely a listing matches the target item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide import dims
from pricetide.functions import text as tx
from pricetide.operators.substrings import containing
from pricetide.sources import dictionary


# letters by which the place of a possible model is recognised
MODEL_START = 2


def empty_words() -> Column:
    return F.array().cast("array<string>")


def complete_targets(targets: DataFrame) -> DataFrame:
    """``quote_id, has_target, models, model_lengths, model_starts, aliases``: keys ready to be searched for in titles.

    Input: ``quote_id, brand STRING, model_numbers ARRAY<STRING>``, one row per quote. A brand found in
    the dictionary under any spelling brings all its spellings; another brand only itself.
    """
    keyed = targets.select(
        "quote_id",
        F.coalesce(F.nullif(F.col("brand"), F.lit("")), F.lit(None)).alias("brand"),
        tx.nfkc(F.col("brand")).alias("brand_normal"),
        F.coalesce("model_numbers", empty_words()).alias("model_numbers"),
        F.transform(F.coalesce("model_numbers", empty_words()), tx.nfkc).alias("models_normal"),
    ).select(
        "quote_id",
        (F.col("brand").isNotNull() | (F.size("model_numbers") > 0)).alias("has_target"),
        tx.fold_normal(F.col("brand_normal")).alias("folded"),
        F.transform("models_normal", lambda m: tx.compact(tx.fold_normal(m))).alias("models"),
    )
    groups = dictionary.alias_groups(targets.sparkSession).select("folded", "aliases")
    return keyed.join(F.broadcast(groups), "folded", "left").withColumn(
        "models", F.filter(F.array_distinct("models"), lambda m: F.length(m) >= dims.MIN_MODEL_LENGTH)
    ).select(
        "quote_id",
        "has_target",
        "models",
        F.array_distinct(F.transform("models", lambda m: F.length(m))).alias("model_lengths"),
        F.array_distinct(F.transform("models", lambda m: F.left(m, F.lit(MODEL_START)))).alias("model_starts"),
        F.when(F.col("folded") == "", empty_words())
        .otherwise(F.coalesce("aliases", F.array("folded"))).alias("aliases"),
    )


def expand_brand(names: DataFrame) -> DataFrame:
    """``brand`` to ``aliases``: every spelling as written, or the name itself; '' has none."""
    dictionary_rows = dictionary.alias_groups(names.sparkSession).select("folded", "spellings")
    keyed = names.withColumn("folded", tx.nfkc(F.col("brand"))).withColumn(
        "folded", tx.fold_normal(F.col("folded"))
    )
    return keyed.join(F.broadcast(dictionary_rows), "folded", "left").withColumn(
        "aliases",
        F.when(F.col("folded") == "", empty_words()).otherwise(F.coalesce("spellings", F.array("brand"))),
    ).drop("folded", "spellings")


def _holds_model(compacted: Column, models: Column, lengths: Column, starts: Column) -> Column:
    """Does the compact title contain one of the models?

    Few models are looked for one by one. For many, the title is walked through instead, and only
    where some model could start are pieces of a model's length looked up; the cheaper of the two
    exact ways is taken row by row.
    """
    def starts_here(at: Column) -> Column:
        return F.array_contains(starts, F.substr(compacted, at, F.lit(MODEL_START))) & F.exists(
            lengths, lambda size: F.array_contains(models, F.substr(compacted, at, size)))

    return F.when(
        F.size(models) > F.length(compacted),
        F.exists(F.sequence(F.lit(1), F.length(compacted)), starts_here),
    ).otherwise(F.exists(models, lambda m: F.contains(compacted, m)))


def titles_with_models(listings: DataFrame, targets: DataFrame) -> DataFrame:
    """``quote_id, compacted, holds_model``: the different compact titles that hold a model of their quote's target.

    For quotes of very many models: models stay rows, none travels with a listing, and titles meet them by equal pieces.
    """
    models = complete_targets(targets).select("quote_id", F.explode("models").alias("model"))
    titles = listings.select("quote_id", tx.compact(F.col("title_folded")).alias("compacted"))
    hits = containing(titles, models, "compacted", "model", ["quote_id"]).select("quote_id", "compacted").distinct()
    return hits.withColumn("holds_model", F.lit(True))


def without_models(ready: DataFrame) -> DataFrame:
    """Completed targets whose models are looked up by ``titles_with_models`` instead."""
    none = F.array().cast("array<int>")
    return ready.withColumns({"models": empty_words(), "model_lengths": none, "model_starts": empty_words()})


def match_tier(folded: Column, models: Column, lengths: Column, starts: Column, aliases: Column,
               holds_model: Column | None = None) -> Column:
    """``model``, ``brand`` or ``loose`` for a folded title. ``holds_model`` says what a lookup has already found."""
    def found(f: Column) -> Column:
        return tx.bound(tx.compact(f), lambda c: _holds_model(c, models, lengths, starts))

    return tx.bound(folded, lambda f: (
        F.when(f == "", F.lit("loose"))
        .when(found(f) if holds_model is None else holds_model, F.lit("model"))
        .when(F.exists(aliases, lambda a: F.contains(f, a)), F.lit("brand"))
        .otherwise(F.lit("loose"))
    ))


def choose_basis(has_target: Column, n_model: Column, n_brand: Column, least: Column | None = None) -> Column:
    """The tier a quote is computed from; a tier with fewer than ``least`` listings widens to the next."""
    least = F.lit(dims.MIN_BASIS_COUNT) if least is None else least
    return (
        F.when(~has_target, F.lit("all"))
        .when(n_model >= least, F.lit("model"))
        .when(n_model + n_brand >= least, F.lit("brand"))
        .otherwise(F.lit("all"))
    )


def within_basis(basis: Column, tier: Column) -> Column:
    return (basis == "all") | (tier == "model") | ((basis == "brand") & (tier == "brand"))


def tier_label(tier: Column) -> Column:
    label = F.lit(dims.TIER_LABELS["all"])
    for key, text in dims.TIER_LABELS.items():
        label = F.when(tier == key, F.lit(text)).otherwise(label)
    return label
