"""Periodic runs of words: minimizers that return at period distance seed an exact extension.

A run is a stretch of words with smallest period q, as long as the bound of ``least_length`` asks, that
cannot be made longer at either end. The words of a text are numbered, and then:

* Periods under ``SHORT`` are too short for windows: each of them is scanned as a lag over the whole text.
* Longer ones are found by scale. Scale j has the periods from s = 2**j to 2s - 1. Its grams are 2s words
  long, its windows s grams; the least gram hash of every window is a minimizer. In a run of four periods
  q, a whole window and the one q further on hold equal grams, so its minimizer returns at distance q. A
  gram is longer than q, so within a run no equal one lies in between. Neighbours of equal hash at a
  distance of that scale are therefore all that must be looked at; each is extended, word by word, to
  where the period breaks, and its period is tested for a smaller one. Nothing is found by hash alone.
  If no two minimizers of a scale are equal, no larger scale has a run, and the search ends.

A text is read by one task, whole, in steps that grow with its words; no text meets another, so there is no
shuffle and no hot group. Rows are scanned in Arrow batches of at most 2000 texts.

Defined results: words are split at ASCII blanks only; null and empty texts have no words and no runs (four
nulls, hashes of the empty string); a text shorter than the bound has no run; repeated rows and ties each
get the same answer; the text of a null id is taken as it is; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.llm.words import in_small_batches, narrow

SHORT = 16  # periods below are scanned directly; a power of two
LEAST_WORDS = 6
LEAST_PERIODS = 4
ODD = np.uint64(0x9E3779B97F4A7C15)


def least_length(period: int) -> int:
    return max(LEAST_WORDS, LEAST_PERIODS * period)


def numbered(words: list) -> np.ndarray:
    """A number for each word, equal for equal words."""
    seen: dict = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int32)


def stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * ODD
    return x ^ (x >> np.uint64(29))


def primitive(ids: np.ndarray, start: int, end: int, period: int) -> bool:
    """Whether the stretch has no smaller period; of at least two periods, only a divisor could be one."""
    rest, p = period, 2
    while rest > 1:
        if rest % p == 0:
            lag = period // p
            if np.array_equal(ids[start + lag:end], ids[start:end - lag]):
                return False
            while rest % p == 0:
                rest //= p
        p = p + 1 if p * p <= rest else max(p + 1, rest)
    return True


def lag_runs(ids: np.ndarray, lag: int) -> Iterator[tuple[int, int]]:
    """Longest stretches (start, end) in which words ``lag`` apart are equal, if long enough for a run."""
    same = np.concatenate(([False], ids[lag:] == ids[:-lag], [False]))
    edges = np.flatnonzero(same[1:] != same[:-1])
    starts, ends = edges[::2], edges[1::2] + lag
    for k in np.flatnonzero(ends - starts >= least_length(lag)):
        yield int(starts[k]), int(ends[k])


def reach(ids: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words from places a < b on, forwards (step 1) or backwards (-1), are equal one by one."""
    total, size = 0, 64
    while True:
        size = min(size, len(ids) - b if step > 0 else a + 1)
        if size <= 0:
            return total
        x, y = (ids[a:a + size], ids[b:b + size]) if step > 0 else (ids[a - size + 1:a + 1][::-1], ids[b - size + 1:b + 1][::-1])
        differ = x != y
        if differ.any():
            return total + int(differ.argmax())
        total, a, b, size = total + size, a + step * size, b + step * size, size * 2


def extreme(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The least or greatest of each ``width`` neighbours; ``width`` is a power of two."""
    step = 1
    while step < width:
        x = best(x[:-step], x[step:])
        step *= 2
    return x


def minimizers(grams: np.ndarray, width: int) -> np.ndarray:
    """Places whose hash is the least of some window of ``width`` grams."""
    least = extreme(grams, width, np.minimum)
    edge = np.zeros(width - 1, dtype=np.uint64)
    return np.flatnonzero(extreme(np.concatenate((edge, least, edge)), width, np.maximum) == grams)


def scale_seeds(grams: np.ndarray, pieces: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places and distances of equal minimizers that may lie in a run, and whether any two minimizers are equal.

    ``pieces`` has the hashes of grams of ``scale`` words: steps of one such piece around a pair
    tell whether the stretch can reach four periods, so that chance repeats are not extended.
    """
    at = minimizers(grams, scale)
    order = at[np.argsort(grams[at], kind="stable")]
    equal = grams[order[1:]] == grams[order[:-1]]
    lags = order[1:] - order[:-1]
    keep = equal & (lags >= scale) & (lags < 2 * scale)
    places, lags = order[:-1][keep], lags[keep]
    steps = np.zeros(len(places), dtype=np.int64)
    for first, way in ((2 * scale, scale), (-scale, -scale)):
        alive = np.ones(len(places), dtype=bool)
        for t in range(LEAST_PERIODS + 1):
            here = places + first + t * way
            inside = (here >= 0) & (here + lags < len(pieces))
            here = np.where(inside, here, 0)
            alive &= inside & (pieces[here] == pieces[np.where(inside, here + lags, 0)])
            steps += alive
    may = 2 * scale + (steps + 2) * scale > (LEAST_PERIODS - 1) * lags
    return places[may], lags[may], bool(equal.any())


def scaled_runs(ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of stretches of at least four periods of ``SHORT`` words or more."""
    grams, length, scale = stirred(ids.astype(np.uint64) + ODD), 1, SHORT
    while LEAST_PERIODS * scale <= len(ids):
        while length < 2 * scale:
            pieces = grams
            grams, length = stirred(grams[:-length] * np.uint64(3) + grams[length:] * ODD), 2 * length
        places, lags, more = scale_seeds(grams, pieces, scale)
        lag, end = 0, 0
        for k in np.lexsort((places, lags)):
            at = int(places[k])
            if int(lags[k]) == lag and at + lag < end:
                continue
            lag = int(lags[k])
            start, end = at - reach(ids, at - 1, at + lag - 1, -1), at + lag + reach(ids, at, at + lag, 1)
            if end - start >= least_length(lag):
                yield start, end, lag
        if not more:
            return
        scale *= 2


def word_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """Every run as (start, length, period), by start and period."""
    found = {(s, e, q) for q in range(1, SHORT) if least_length(q) <= len(ids) for s, e in lag_runs(ids, q)}
    found |= set(scaled_runs(ids))
    return sorted((s, e - s, q) for s, e, q in found if primitive(ids, s, e, q))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """False for words that a run holds after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def run_column(text: Column) -> Column:
    """Every run of a text, as an array of (start, length, period)."""
    @F.pandas_udf("array<struct<start long, length long, period long>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": s, "length": n, "period": q} for s, n, q in word_runs(numbered(split(t)))]
                          for t in texts], dtype=object)

    return run(text)


def collapsed_column(text: Column) -> Column:
    """The text's words without what runs repeat, one blank between them; null stays null."""
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            words = split(t)
            kept = kept_words(len(words), word_runs(numbered(words)))
            return b" ".join(w for w, k in zip(words, kept) if k).decode()

        return pd.Series([None if t is None else one(t) for t in texts], dtype=object)

    return run(text)


def runs(docs: DataFrame) -> DataFrame:
    """doc_id and one row per run: start, length and period in words."""
    found = in_small_batches(narrow(docs, "doc_id", "text")).select("doc_id", F.explode(run_column(F.col("text"))).alias("r"))
    return found.select("doc_id", "r.*")


def collapsed(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated part of every run taken out of ``text``; other columns stay as they are."""
    return in_small_batches(docs).withColumn("text", collapsed_column(docs["text"]))


def planted(words: list, doc_id: int | None) -> list:
    """The contract's words: every tenth document repeats a stretch to its end."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def digest(text: str | None, doc_id: int | None) -> tuple:
    words = planted(split(text), doc_id)
    found = word_runs(numbered(words))
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    if found:
        start, length, period = strongest(found)
        best = (start, length, period, 1000 * length // period)
        words = [w for w, k in zip(words, kept_words(len(words), found)) if k]
    else:
        best = (None,) * 4
    return len(found), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()


def digest_column(text: Column, doc_id: Column) -> Column:
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]

    @F.pandas_udf("n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
    def run(texts: pd.Series, ids: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([digest(t, None if i is None else int(i)) for t, i in zip(texts, ids)], columns=names)
        return out.astype({n: "Int64" for n in names[:5]})

    return run(text, doc_id)


def query(spark, sf_dir: str) -> DataFrame:
    """op13 over the whole ``documents`` table."""
    docs = in_small_batches(narrow(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"))
    # Ids travel as text: a column of whole numbers with nulls would reach pandas as floats.
    return docs.select("doc_id", digest_column(F.col("text"), F.col("doc_id").cast("string")).alias("d")).select("doc_id", "d.*")
