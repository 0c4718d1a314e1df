"""Scanned codes: kind, check digit, country and maker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide import dims


def check_digit(digits: Column) -> Column:
    """Weights 3 and 1 in turn from the right."""
    weighted = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.coalesce(d.try_cast("int"), F.lit(0)) * F.when(i % 2 == 0, 3).otherwise(1),
    )
    total = F.aggregate(weighted, F.lit(0), lambda acc, x: acc + x)
    return (10 - total % 10) % 10


def describe(codes: DataFrame, code: str = "code") -> DataFrame:
    """Adds ``digits, valid, kind, country, maker_code``; a code without digits has only nulls."""
    digits = F.col("digits")
    size = F.length(digits)
    kind = F.when(size > 0, F.concat(size.cast("string"), F.lit(dims.OTHER_CODE)))
    for length, name in dims.CODE_KINDS.items():
        kind = F.when(size == length, F.lit(name)).otherwise(kind)
    country = F.lit(None).cast("string")
    for pattern, name in reversed(dims.COUNTRY_PREFIXES):
        country = F.when(F.rlike(digits, F.lit(pattern)), F.lit(name)).otherwise(country)
    known = size.isin(list(dims.CODE_KINDS))
    body, last = F.substr(digits, F.lit(1), size - 1), F.right(digits, F.lit(1))
    return codes.withColumn("digits", F.regexp_replace(F.coalesce(code, F.lit("")), "[^0-9]", "")).select(
        "*",
        F.when(known, check_digit(body) == last.try_cast("int")).otherwise(F.lit(False)).alias("valid"),
        kind.alias("kind"),
        F.when(size == 13, country).alias("country"),
        F.when((size == 13) & F.rlike(digits, F.lit(dims.COUNTRY_PREFIXES[0][0])), F.substring(digits, 1, 7))
        .alias("maker_code"),
    )
