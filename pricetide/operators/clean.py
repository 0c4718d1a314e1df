"""Price guards, exclusion rules and user exclude words: why a listing does not count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide import dims
from pricetide.functions import money
from pricetide.functions import text as tx

# One row per quote, after options have been completed.
OPTION_COLUMNS = [
    "query", "price_min", "price_max", "rules_on", "exclude_words", "remove_outliers", "iqr_k",
]


def rule_matches(title: Column, rule: int) -> Column:
    """Does the rule's word list hit a normalised title?"""
    words, _ = dims.EXCLUSION_RULES[rule]
    if words == [dims.SET_WORD]:
        return F.contains(F.replace(title, F.lit(dims.SUIT_WORD), F.lit("#")), F.lit(dims.SET_WORD))
    return tx.contains_any(title, words)


def enabled_rules(query: Column, use_defaults: Column) -> Column:
    """One flag per rule: a rule that the search query itself trips is off."""
    return F.array(*[
        use_defaults & ~rule_matches(query, rule) for rule in range(len(dims.EXCLUSION_RULES))
    ])


def default_terms() -> dict[str, Column]:
    """What holds for a quote without options."""
    return {
        "query": F.lit(""),
        "price_min": F.lit(dims.MIN_PRICE).cast("bigint"),
        "price_max": F.lit(dims.MAX_PRICE).cast("bigint"),
        "rules_on": F.array(*[F.lit(True)] * len(dims.EXCLUSION_RULES)),
        "exclude_words": F.array().cast("array<string>"),
        "remove_outliers": F.lit(True),
        "iqr_k": F.lit(dims.IQR_K),
        "min_basis_count": F.lit(dims.MIN_BASIS_COUNT).cast("bigint"),
    }


def complete_options(options: DataFrame) -> DataFrame:
    """Defaults and normal forms, one row per quote.

    Input columns, all optional but ``quote_id``: ``query, price_min, price_max,
    exclude_words ARRAY<STRING>, use_default_excludes, remove_outliers, iqr_k, min_basis_count``. A bound
    of 0 or null means the default guard.
    """
    present = set(options.columns)

    def given(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in present else F.lit(None).cast(kind)

    normal = options.select(
        "quote_id",
        tx.nfkc(given("query", "string")).alias("query"),
        F.coalesce(F.nullif(given("price_min", "bigint"), F.lit(0)), F.lit(dims.MIN_PRICE))
        .cast("bigint").alias("price_min"),
        F.coalesce(F.nullif(given("price_max", "bigint"), F.lit(0)), F.lit(dims.MAX_PRICE))
        .cast("bigint").alias("price_max"),
        F.transform(F.coalesce(given("exclude_words", "array<string>"), F.array().cast("array<string>")),
                    tx.nfkc).alias("exclude_words"),
        F.coalesce(given("use_default_excludes", "boolean"), F.lit(True)).alias("use_defaults"),
        F.coalesce(given("remove_outliers", "boolean"), F.lit(True)).alias("remove_outliers"),
        F.coalesce(given("iqr_k", "double"), F.lit(dims.IQR_K)).alias("iqr_k"),
        F.coalesce(given("min_basis_count", "bigint"), F.lit(dims.MIN_BASIS_COUNT)).alias("min_basis_count"),
    ).withColumn("query", tx.squeeze(F.col("query")))
    return normal.select(
        "quote_id", "query", "price_min", "price_max",
        enabled_rules(F.col("query"), F.col("use_defaults")).alias("rules_on"),
        tx.non_empty(F.transform("exclude_words", tx.squeeze)).alias("exclude_words"),
        "remove_outliers", "iqr_k", "min_basis_count",
    )


def split_by_validity(options: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Options that can be used, and (quote_id, reason) of those whose bounds cross."""
    if not {"price_min", "price_max"} <= set(options.columns):
        return options, options.limit(0).select("quote_id", F.lit(dims.BOUNDS_REJECTED).alias("reason"))
    crossed = F.coalesce(F.col("price_min") > F.col("price_max"), F.lit(False))
    rejects = options.filter(crossed).select("quote_id", F.lit(dims.BOUNDS_REJECTED).alias("reason"))
    return options.filter(~crossed), rejects


def user_words(csv: Column) -> Column:
    """The comma-separated form the words are typed in."""
    return tx.non_empty(F.transform(F.split(csv, ","), tx.strip))


def exclusion_reason(
    title: Column,
    price: Column,
    price_min: Column,
    price_max: Column,
    rules_on: Column,
    exclude_words: Column,
) -> Column:
    """Null for a listing that counts. Guards come first, then rules in order, then user words."""
    def around(wording: str, bound: Column) -> Column:
        head, tail = wording.split("{}")
        return F.concat(F.lit(head), money.grouped(bound), F.lit(tail))

    reason = F.when(
        price.isNull() | (price < price_min), around(dims.BELOW_GUARD, price_min)
    ).when(
        price > price_max, around(dims.ABOVE_GUARD, price_max)
    )
    for rule, (_, why) in enumerate(dims.EXCLUSION_RULES):
        reason = reason.when(F.get(rules_on, F.lit(rule)) & rule_matches(title, rule), F.lit(why))
    hit = F.when(F.size(exclude_words) > 0, tx.bound(F.lower(title), lambda lowered: F.get(
        F.filter(exclude_words, lambda word: F.contains(lowered, F.lower(word))), F.lit(0))))
    return F.coalesce(reason, F.concat(F.lit(dims.USER_WORD_REASON), hit))
