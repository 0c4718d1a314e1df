"""Fixed lookup tables as DataFrames. Their row counts are constants, so they may be broadcast."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide import dims
from pricetide.functions import text as tx


def _constant_table(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A constant table held in the plan as one literal."""
    names = [field.split(" ")[0] for field in schema.split(", ")]
    literal = F.lit(json.dumps([dict(zip(names, row)) for row in rows], ensure_ascii=False))
    return spark.range(1).select(F.inline(F.from_json(literal, f"array<struct<{schema}>>")))


def brands(spark: SparkSession) -> DataFrame:
    """``canonical, spellings``: one row per brand; the canonical name is the first spelling."""
    rows = [(name, [name, *others]) for name, others in dims.BRANDS]
    return _constant_table(spark, "canonical string, spellings array<string>", rows)


def brand_aliases(spark: SparkSession) -> DataFrame:
    """``canonical, alias, folded, alias_ord``: one row per spelling, longest folded key first."""
    rows = [
        (name, alias, tx.fold_literal(alias), order)
        for order, (name, alias) in enumerate(ordered_aliases())
    ]
    return _constant_table(spark, "canonical string, alias string, folded string, alias_ord int", rows)


def ordered_aliases() -> list[tuple[str, str]]:
    """(canonical, alias), longest folded alias first, dictionary order among equals."""
    pairs = [(name, alias) for name, others in dims.BRANDS for alias in [name, *others]]
    return sorted(pairs, key=lambda pair: -len(tx.fold_literal(pair[1])))


def alias_groups(spark: SparkSession) -> DataFrame:
    """``folded, aliases, spellings``: any folded spelling to all spellings of its brand."""
    rows = []
    for name, others in dims.BRANDS:
        spellings = [name, *others]
        aliases = list(dict.fromkeys(tx.fold_literal(s) for s in spellings))
        rows += [(folded, aliases, spellings) for folded in aliases]
    return _constant_table(spark, "folded string, aliases array<string>, spellings array<string>", rows)


def sources(spark: SparkSession) -> DataFrame:
    """``source, label, ordinal, url``: the marketplaces, in display order."""
    rows = [(key, label, i, url) for i, (key, label, url) in enumerate(dims.SOURCES)]
    return _constant_table(spark, "source string, label string, ordinal int, url string", rows)


def conditions(spark: SparkSession) -> DataFrame:
    return _constant_table(spark, "condition string, label string, quantile double", dims.CONDITIONS)
