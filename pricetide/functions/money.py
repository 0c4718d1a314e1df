"""Rounding, money wording and step sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(value: Column) -> Column:
    """Nearest whole number, halves upward (also for negatives)."""
    return F.floor(value + F.lit(0.5)).cast("bigint")


def round_to_cents(value: Column) -> Column:
    return F.floor(value * 100 + F.lit(0.5)) / F.lit(100.0)


def grouped(value: Column) -> Column:
    """Digits with thousands separators, up to three decimals where there are any."""
    return F.when(
        value == F.floor(value), F.format_number(value, 0)
    ).otherwise(F.regexp_replace(F.format_number(value, 3), "0+$", ""))


def yen(value: Column) -> Column:
    return F.concat(F.lit("¥"), grouped(value))


def nice_step(raw: Column) -> Column:
    """Smallest of 1, 2, 2.5, 5, 10 times a power of ten that is at least ``raw``; whole, at least 1."""
    base = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    step = F.lit(10.0) * base
    for factor in (5.0, 2.5, 2.0, 1.0):
        step = F.when(F.lit(factor) * base >= raw, F.lit(factor) * base).otherwise(step)
    return F.when(raw <= 0, F.lit(1).cast("bigint")).otherwise(
        F.greatest(F.lit(1).cast("bigint"), round_half_up(step))
    )
