"""Which title goes with which price: the one step that columns cannot express.

A greedy choice where each pick depends on all before it. Only line numbers go to Python, in Arrow
batches; texts stay in the JVM.
"""

from bisect import bisect_right
from typing import Iterator, Tuple

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nearest_titles(prices: list[int], titles: list[int]) -> list[int]:
    """Which title each price takes: the nearest free one, the earlier of two equally near.

    Line numbers are ascending. Taken titles are skipped by chained pointers on either side, so a
    page of n lines costs about n steps. Once all titles are taken, the nearest is taken again.
    """
    size = len(titles)
    if not size:
        return [-1] * len(prices)
    before = list(range(size + 1))  # before[k + 1] leads to the nearest free title at or before k, plus 1
    after = list(range(size + 1))   # after[k] leads to the nearest free title at or after k

    def follow(links: list[int], k: int) -> int:
        end = k
        while links[end] != end:
            end = links[end]
        while links[k] != end:
            links[k], k = end, links[k]
        return end

    chosen, free = [], size
    for line in prices:
        place = bisect_right(titles, line) - 1
        if free:
            left, right = follow(before, place + 1) - 1, follow(after, place + 1)
        else:
            left, right = place, place + 1
        if right >= size or (left >= 0 and line - titles[left] <= titles[right] - line):
            pick = left
        else:
            pick = right
        if free:
            before[pick + 1], after[pick] = pick, pick + 1
            free -= 1
        chosen.append(pick)
    return chosen


def nearest_of_pages(prices: list, titles: list) -> list:
    """``nearest_titles`` of many pages; ``prices`` and ``titles`` hold an array of line numbers a page.

    Where the nearest titles of a page's prices all differ, none is ever taken, so these are the greedy choice. They are
    found for all pages at once; only pages on which two prices are nearest to one title are walked through.
    """
    sizes, titled = np.array([len(p) for p in prices]), np.array([len(t) for t in titles])
    if not sizes.sum() or not titled.sum():
        return [np.full(size, -1, np.int32) for size in sizes]
    lines, places = np.concatenate(prices).astype(np.int64), np.concatenate(titles).astype(np.int64)
    page = np.repeat(np.arange(len(sizes)), sizes)
    first = np.concatenate([[0], np.cumsum(titled)])  # of a page's titles
    stride = max(lines.max(), places.max()) + 1
    right = np.searchsorted(places + np.repeat(np.arange(len(titled)), titled) * stride, lines + page * stride, "right")
    left = right - 1
    has_left, has_right = left >= first[page], right < first[page + 1]
    to_left = lines - places[np.maximum(left, 0)]
    to_right = places[np.minimum(right, len(places) - 1)] - lines
    pick = np.where(has_left & (~has_right | (to_left <= to_right)), left, right) - first[page]
    pick[titled[page] == 0] = -1
    shared = page[1:][(page[1:] == page[:-1]) & (pick[1:] == pick[:-1]) & (pick[1:] >= 0)]
    chosen = np.split(pick.astype(np.int32), np.cumsum(sizes)[:-1])
    for k in np.unique(shared):
        chosen[k] = np.array(nearest_titles(prices[k].tolist(), titles[k].tolist()), np.int32)
    return chosen


def _pick_batches(batches: Iterator[Tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for prices, titles in batches:
        yield pd.Series(nearest_of_pages(list(prices), list(titles)), dtype=object)


def pick_titles(price_lines, title_lines):
    """``ARRAY<INT>``: for each price line the place of its title in ``title_lines``, or -1.

    Marked non-deterministic so that no filter on its result is pushed below it and runs it again.
    """
    pick = F.pandas_udf(_pick_batches, T.ArrayType(T.IntegerType()))
    return pick.asNondeterministic()(price_lines, title_lines)
