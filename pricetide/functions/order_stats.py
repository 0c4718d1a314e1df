"""Exact order statistics over (value, n) frequency rows.

Percentiles are read off a running count: the value at 0-based rank r is the smallest value whose
inclusive running count exceeds r. The rows are frequencies, already combined on the map side, so a
group costs as many rows as it has distinct values, however many listings stand behind them, and the
window that computes the running count sorts with spilling instead of holding a map in memory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def percentile_position(total: Column, q: float) -> Column:
    return (total - F.lit(1)) * F.lit(float(q))


def value_at(value: Column, running: Column, rank: Column, keep: Column | None = None) -> Column:
    """Aggregate (or window) expression for the value at ``rank``."""
    hit = running > rank
    if keep is not None:
        hit = keep & hit
    return F.min(F.when(hit, value))


def interpolated(
    value: Column,
    running: Column,
    total: Column,
    q: float,
    keep: Column | None = None,
    over: Callable[[Column], Column] = lambda aggregate: aggregate,
) -> Column:
    """Percentile with linear interpolation at (n-1)q.

    ``total`` must be the same on all rows of the group. ``over`` turns the aggregates into window
    functions where a row-level result is wanted.
    """
    position = percentile_position(total, q)
    low = over(value_at(value, running, F.floor(position), keep)).cast("double")
    high = over(value_at(value, running, F.ceil(position), keep)).cast("double")
    at = over(F.max(position))
    return F.when(low == high, low).otherwise(low * (F.ceil(at) - at) + high * (at - F.floor(at)))
