"""Interpolated modified Kneser-Ney model of order two or three, counted in Spark and read from memory-mapped arrays.

Words are runs of anything but ASCII blanks, A-Z as a-z; every text ends with an end token and begins
after a start mark that is never predicted itself.

    p(w | u v) = (c(u v w) - D3(c(u v w))) / c(u v .) + gamma(u v) * p(w | v)
    p(w | v)   = (a(v w) - D2(a(v w))) / a(v .) + gamma(v) * p(w)
    p(w)       = (N(. w) - D1(N(. w))) / N(. .) + gamma' / (V + 1)

c counts occurrences, N(. w) the different words before w, V the different training tokens. At order
three a(v w) is the number of different words before the pair, but the occurrences of a pair that opens
a text; at order two, where p(w | v) is the whole model, it is the occurrences. The first token of a text
has no word before the start mark and stays at p(w | v). The discounts of a level for counts of 1, 2 and
3 or more come from its counts of counts, and gamma gives back what they took.

1. Words: each task counts its tokens, hashes the different ones to 64 bits and sends sorted runs to
   the shard that owns that range of hashes, which merges them. The shards in order are one sorted
   hash array; a word's number is its place in it.
2. Word triples (order three): each task counts (two words, next word) and sends sorted runs to shards,
   which merge them into sorted arrays of next words and counts. A shard owns whole contexts, those whose
   pair it owns in stage 3, and in the same order: a context is not stored again, its pair's row says which
   it is. Contexts of two very frequent words are dealt over all shards and stored apart, and their partial
   sums are merged by the next stage. Shards send on how many contexts each pair (last word, next word) has.
3. Word pairs: each task counts pairs of numbers (order two), or stage 2 has counted them, and sorted
   runs go to shards, which merge them into sorted arrays of (pair, count). A shard owns whole contexts,
   so that it can sum them up; the pairs of very frequent contexts are dealt over all shards.
4. Contexts and continuations: sums per context and the number of contexts per word go back to the
   shards of the words as sorted runs.
5. Scoring: tasks map the arrays into memory and look up their texts' different pairs and triples in
   sorted order. No model passes through the driver, and no text is shuffled.

What a task holds is one run of tokens (``RUN`` to count, ``LOOKUP`` to look up) or one shard, and shards grow in number with the
input (``SHARD_BYTES``). Only shard sizes and sums reach the driver.

Defined results: a null or empty text is the end token alone; unseen words share what is left over
for one more word than the vocabulary; a word behind an unseen one falls back to the level below; rows are
scored each for itself; without training texts every token has probability 1; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.llm.array_store import mapped, new_folder, put
from pricetide.llm.words import Remembered, in_small_batches

END = pa.array(["\n"])  # blanks are never words
START_NUMBER = 0xFFFFFFFF
NONE = 0xFFFFFFFE  # stands before the start mark, and for an unseen word
ORDER = 3
RUN = 2_000_000
LOOKUP = 400_000  # tokens that are looked up together
SHARD_BYTES = 16 << 20
MOST_SHARDS = 20_000
FREQUENT = 20  # a context with over 1 / (FREQUENT * shards) of all tokens is dealt over all shards
U32, U64 = np.uint32, np.uint64
SENT = "shard int, keys binary, values binary"


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words of all texts, one after another, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    words, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.greater(pc.binary_length(words), 0)  # a text without words is split into an empty one
    if pc.all(real).as_py() is False:
        nothing = np.flatnonzero(~real.to_numpy(zero_copy_only=False))
        sizes[np.searchsorted(np.cumsum(sizes), nothing, side="right")] = 0
        words = words.filter(real)
    return words.dictionary_encode(), sizes


def hashes_of(words: pa.Array) -> np.ndarray:
    """64 bits for each word, the same in every process."""
    return pd.util.hash_array(words.cast(pa.large_binary()).to_numpy(zero_copy_only=False), categorize=False)


def range_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards as equal ranges of the hash, in hash order."""
    return ((hashes >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


def mixed(keys: np.ndarray) -> np.ndarray:
    keys = (keys ^ (keys >> U64(31))) * U64(0x9E3779B97F4A7C15)
    return keys ^ (keys >> U64(29))


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order with the sums of their rows of values."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, dtype=np.int64)
    return keys[first], np.add.reduceat(values, first, axis=0) if len(keys) else values


def packed(rows: np.ndarray) -> bytes:
    """Whole numbers (one sorted column as steps between neighbours), byte plane after byte plane, by zstd."""
    whole = rows if rows.ndim > 1 else rows[:, None]
    steps = whole.shape[1] == 1 and bool((whole[1:] >= whole[:-1]).all())
    if steps:
        whole = np.diff(whole, axis=0, prepend=whole.dtype.type(0))
    planes = np.ascontiguousarray(whole).view(np.uint8).T.tobytes()
    return len(planes).to_bytes(8, "little") + bytes([steps, whole.shape[1]]) + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def unpacked(data: bytes, kind) -> np.ndarray:
    """The numbers, row by row."""
    kind, size = np.dtype(kind), int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[10:], size, asbytes=True) if size else b"", np.uint8)
    whole = np.ascontiguousarray(planes.reshape(data[9] * kind.itemsize, -1).T).view(kind)
    return np.cumsum(whole[:, 0], dtype=kind) if data[8] else whole.reshape(-1)


def by_shard(shard: np.ndarray) -> np.ndarray:
    """Rows ordered by shard, else as they stand."""
    low = shard.min() if len(shard) else 0
    return np.argsort((shard - low).astype(np.uint16) if len(shard) and shard.max() - low < 1 << 16 else shard, kind="stable")


def parted(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Every shard with its rows, as they stand."""
    order = by_shard(shard)
    cuts = np.flatnonzero(firsts(shard[order]))
    for a, b in zip(cuts, [*cuts[1:], len(shard)]):
        yield int(shard[order[a]]), order[a:b]


def among(values: np.ndarray, few: np.ndarray) -> np.ndarray:
    """Which values are among a few sorted ones."""
    return few[np.minimum(np.searchsorted(few, values), len(few) - 1)] == values if len(few) else np.zeros(len(values), dtype=bool)


def sent(shard: np.ndarray, keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """One row per shard with its keys (in the order given) and values."""
    order = by_shard(shard)
    shard, keys, values = shard[order], keys[order], values[order]
    cuts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if len(shard) else []
    ends = [*cuts[1:], len(shard)] if len(shard) else []
    return pa.RecordBatch.from_arrays([
        pa.array([int(shard[a]) for a in cuts], pa.int32()),
        pa.array([packed(keys[a:b]) for a, b in zip(cuts, ends)], pa.binary()),
        pa.array([packed(values[a:b]) for a, b in zip(cuts, ends)], pa.binary())], names=["shard", "keys", "values"])


def gathered(batches: Iterator[pa.RecordBatch], key, value, width: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """All runs of each shard, one after another; rows come sorted by shard."""
    rows = ((s.as_py(), k.as_py(), v.as_py()) for b in batches for s, k, v in zip(b["shard"], b["keys"], b["values"]))
    for shard, group in groupby(rows, key=lambda r: r[0]):
        keys, values = [], []
        for _, k, v in group:
            keys.append(unpacked(k, key))
            values.append(unpacked(v, value).reshape(-1, width).astype(np.int64))
        yield shard, np.concatenate(keys), np.concatenate(values)


def received(batches: Iterator[pa.RecordBatch], key, value, width: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Merged runs of each shard."""
    for shard, keys, values in gathered(batches, key, value, width):
        yield shard, *summed(keys, values)


def dealt(df: DataFrame, shards: int) -> DataFrame:
    return df.repartition(shards, "shard").sortWithinPartitions("shard")


def count_words(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for texts in in_runs(batch["text"]):
                words, sizes = words_of(texts)
                held.append((hashes_of(words.dictionary), np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))))
                held.append((hashes_of(END), np.array([len(sizes)])))
                size += len(words.dictionary)
                if size >= RUN // 2:
                    held = [summed(*(np.concatenate(x) for x in zip(*held)))]
                    size = len(held[0][0])
                    if size >= RUN // 4:
                        yield sent(range_shard(held[0][0], shards), *held[0])
                        held, size = [], 0
        if held:
            hashes, counts = summed(*(np.concatenate(x) for x in zip(*held)))
            yield sent(range_shard(hashes, shards), hashes, counts)

    return run


def keep_words(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, hashes, counts in received(batches, U64, np.int64):
            counts = counts[:, 0]
            put(folder, f"hash-{shard}", hashes)
            put(folder, f"count-{shard}", counts)
            top = np.argsort(-counts, kind="stable")[:200]
            yield pa.RecordBatch.from_pydict({
                "shard": [shard], "n": [len(hashes)], "tokens": [int(counts.sum())],
                "top": [top.tolist()], "top_counts": [counts[top].tolist()]})

    return run


@dataclass(frozen=True)
class Words:
    """Where the words' arrays are, and what the driver knows of them."""

    folder: str
    shards: int
    sizes: tuple[int, ...]
    tokens: int
    frequent: tuple[int, ...]

    @property
    def v(self) -> int:
        return sum(self.sizes)

    @property
    def offsets(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.sizes)))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of hashes, -1 for words the training texts lack."""
        order = np.argsort(hashes)
        asked = hashes[order]
        shard, out, offsets = range_shard(asked, self.shards), np.full(len(asked), -1, dtype=np.int64), self.offsets
        for s, mine in parted(shard):
            known = arrays(self.folder, f"hash-{s}", "u8")
            at = np.minimum(np.searchsorted(known, asked[mine]), max(0, len(known) - 1))
            if len(known):
                out[mine] = np.where(known[at] == asked[mine], offsets[s] + at, -1)
        back = np.empty_like(out)
        back[order] = out
        return back

    def gather(self, name: str, dtype: str, numbers: np.ndarray, width: int = 1) -> np.ndarray:
        """Rows of an array that is laid out like the words, for sorted or unsorted known numbers."""
        shard, offsets = np.searchsorted(self.offsets, numbers, side="right") - 1, self.offsets
        out = np.zeros((len(numbers), width), dtype=np.float64)
        for s, mine in parted(shard):
            rows = arrays(self.folder, f"{name}-{s}", dtype).reshape(-1, width)
            if len(rows):
                out[mine] = rows[numbers[mine] - offsets[s]]
        return out


@Remembered
def arrays(folder: str, name: str, dtype: str) -> np.ndarray:
    return np.asarray(mapped(folder, name, np.dtype(dtype)))


def placed(texts: pa.Array, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of all tokens among the numbers of the known ones, those numbers in order, and where each text starts.

    Each text is opened by the start mark, which has the first place behind the known ones, and closed by the end
    token; unseen words have the second.
    """
    tokens, sizes = words_of(texts)
    numbers = words.numbers(np.append(hashes_of(tokens.dictionary), hashes_of(END)))
    known = np.unique(numbers[numbers >= 0])
    place_of = np.where(numbers < 0, len(known) + 1, np.searchsorted(known, numbers))
    starts = np.cumsum(sizes + 2) - (sizes + 2)
    places, inner = np.empty(int((sizes + 2).sum()), dtype=np.int64), np.ones(int((sizes + 2).sum()), dtype=bool)
    places[starts], places[starts + sizes + 1] = len(known), place_of[-1]
    inner[starts] = inner[starts + sizes + 1] = False
    places[inner] = place_of[tokens.indices.to_numpy()]
    return places, known, starts


def in_runs(texts: pa.Array) -> Iterator[pa.Array]:
    """Texts in runs of about ``LOOKUP`` tokens, or one text of more."""
    first, size = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        size += 2 + n // 6
        if size >= LOOKUP:
            yield texts[first:i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield texts[first:]


def pair_shard(pairs: np.ndarray, shards: int, frequent: np.ndarray) -> np.ndarray:
    context = pairs >> U64(32)
    spread = among(context, frequent)
    return (mixed(np.where(spread, pairs, context)) % U64(shards)).astype(np.int64)


def count_pairs(words: Words, shards: int):
    frequent = np.array(words.frequent, dtype=U64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            pairs, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return sent(pair_shard(pairs, shards, frequent), pairs, counts.astype(U32))

        for batch in batches:
            for texts in in_runs(batch["text"]):
                places, known, _ = placed(texts, words)
                numbers = np.append(known, START_NUMBER)[places]
                pairs = (numbers[:-1].astype(U64) << U64(32)) | numbers[1:].astype(U64)
                held.append(pairs[numbers[1:] != START_NUMBER])
                size += len(held[-1])
                if size >= RUN:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def triple_spread(context: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Which contexts are dealt over all shards.

    A pair occurs no more often than either of its words, so frequent pairs are among those of two frequent words.
    """
    return among(context >> U64(32), frequent) & among(context & U64(START_NUMBER), frequent)


def spread_shard(context: np.ndarray, word: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(mixed(context) ^ word) % U64(shards)).astype(np.int64)


def sums_shard(context: np.ndarray, shards: int) -> np.ndarray:
    """Where the sums of a context that is dealt over all shards are merged."""
    return (mixed(context) % U64(shards)).astype(np.int64)


def firsts(*keys: np.ndarray) -> np.ndarray:
    """Which rows differ from the one before."""
    out = np.ones(len(keys[0]), dtype=bool)
    if len(out):
        out[1:] = keys[0][1:] != keys[0][:-1]
        for k in keys[1:]:
            out[1:] |= k[1:] != k[:-1]
    return out


def merged(context: np.ndarray, word: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different triples in order with their counts; sorted runs, one after another, take least time."""
    order = np.argsort(context, kind="stable")
    context, word, counts = context[order], word[order], counts[order]
    order = np.argsort((np.cumsum(firsts(context)).astype(U64) << U64(32)) | word, kind="stable")
    word, counts = word[order], counts[order]  # contexts stand as they stood
    first = np.flatnonzero(firsts(context, word))
    return context[first], word[first], np.add.reduceat(counts, first) if len(first) else counts


def triple_frequent(words: Words) -> np.ndarray:
    return np.array(sorted([*words.frequent, NONE]), dtype=U64)


def counted(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different triples of runs of ``placed`` tokens in order, as contexts and words, with their counts."""
    known = np.unique(np.concatenate([numbers for _, numbers in runs]))
    numbers, base = np.append(known, [NONE, START_NUMBER]).astype(U64), len(known) + 2
    keys, parts = [], []
    for places, of_run in runs:
        # with NONE and the start mark behind the known words places are ordered like numbers
        places = np.append(np.searchsorted(known, of_run), base - 1)[places]
        outer, last, word = np.append(base - 2, places[:-2]), places[:-1], places[1:]
        outer = np.where(last == base - 1, base - 2, outer)
        real = word != base - 1
        if base ** 3 < 1 << 64:
            keys.append(((outer.astype(U64) * U64(base) + last.astype(U64)) * U64(base) + word.astype(U64))[real])
        else:
            parts.append(((numbers[outer] << U64(32) | numbers[last])[real], numbers[word][real]))
    if parts:
        context, word = (np.concatenate(x) for x in zip(*parts))
        return merged(context, word, np.ones(len(word), dtype=np.int64))
    keys = np.sort(np.concatenate(keys))
    first = np.flatnonzero(firsts(keys))
    context, word = np.divmod(keys[first], U64(base))
    outer, last = np.divmod(context, U64(base))
    return (numbers[outer] << U64(32)) | numbers[last], numbers[word], np.diff(np.append(first, len(keys)))


def count_triples(words: Words, shards: int):
    of_pairs, of_triples = np.array(words.frequent, dtype=U64), triple_frequent(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            context, word, counts = counted(held)
            held.clear()
            spread = triple_spread(context, of_triples)
            shard = np.where(spread, spread_shard(context, word, shards), pair_shard(context, shards, of_pairs))
            return sent(shard, context, np.stack([word, counts], axis=1).astype(U32))

        for batch in batches:
            for texts in in_runs(batch["text"]):
                places, known, _ = placed(texts, words)
                held.append((places.astype(U32), known))
                size += len(places)
                if size >= RUN:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def keep_triples(folder: str, words: Words, shards: int):
    """Stores a shard's triples; sends pairs to their shards.

    Shards from ``shards`` on carry the total, ones, twos and more of contexts that are dealt over all shards, each
    ``shards`` apart; shard -3 the counts of counts.
    """
    of_pairs, of_triples = np.array(words.frequent, dtype=U64), triple_frequent(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, context, values in gathered(batches, U64, U32, 2):
            context, word, counts = merged(context, values[:, 0].astype(U64), values[:, 1])
            opens = context >> U64(32) == NONE
            pairs = (context << U64(32)) | word
            if opens.any():  # sorted: one context, and each pair once
                yield sent(pair_shard(pairs[opens], shards, of_pairs), pairs[opens], counts[opens].astype(U32))
            context, word, counts, pairs = context[~opens], word[~opens], counts[~opens], np.sort(pairs[~opens])
            if not len(context):
                continue
            first = np.flatnonzero(firsts(pairs))
            pairs, n = pairs[first], np.diff(np.append(first, len(pairs)))
            yield sent(pair_shard(pairs, shards, of_pairs), pairs, n.astype(U32))
            yield sent(np.full(4, -3), np.arange(4, dtype=U64), np.array(tallied(counts), dtype=U32))
            apart = triple_spread(context, of_triples)
            for name, mine in ((f"triples-{shard}", np.flatnonzero(~apart)), (f"apart-{shard}", np.flatnonzero(apart))):
                if len(mine):
                    far = context[mine]
                    first = np.flatnonzero(firsts(far))
                    sums = sums_by(counts[mine], first)
                    put_rows(folder, name, far, word[mine], counts[mine], sums, named=name.startswith("apart"))
            if not apart.any():
                continue
            owner = sums_shard(far[first], shards)
            for k in range(4):
                order = np.argsort(owner, kind="stable")
                yield sent(shards * (1 + k) + owner[order], far[first][order], sums[order, k].astype(U32))

    return run


# What one shard of counted rows holds in one file, widest numbers first, so that all are aligned.
PARTS = {"big_count": "u8", "sums": "u8", "outer": "u4", "outer_start": "u4", "inner": "u4", "start": "u4", "word": "u4",
         "big": "u4", "wide": "u4",
         "bare": "u4", "count": "u1"}
BIG, WIDE = 255, 64


def put_rows(folder: str, name: str, context: np.ndarray, word: np.ndarray, counts: np.ndarray, sums: np.ndarray | None = None,
             named: bool = True, bare: np.ndarray | None = None) -> None:
    """Rows sorted by context and word: contexts once, as upper halves with the place of the first lower half and lower
    halves with the place of the first row; words; counts in a byte.

    Counts from ``BIG`` on stand in full beside them, and so do the sums of contexts of ``WIDE`` rows or more.
    Contexts that are not ``named`` have only their first rows. ``bare`` are the places of pairs that are no such context.
    """
    first, big = np.flatnonzero(firsts(context)), np.flatnonzero(counts >= BIG)
    start = np.append(first, len(word))
    wide = np.flatnonzero(np.diff(start) >= WIDE) if sums is not None else first[:0]
    outer, inner = context[first if named else first[:0]] >> U64(32), context[first if named else first[:0]] & U64(START_NUMBER)
    opening = np.flatnonzero(firsts(outer))
    parts = {"outer": outer[opening], "outer_start": np.append(opening, len(outer)), "inner": inner, "big_count": counts[big],
             "sums": sums[wide] if sums is not None else wide, "start": start, "word": word, "big": big, "wide": wide,
             "bare": first[:0] if bare is None else bare, "count": np.minimum(counts, BIG)}
    header = np.array([parts[p].size for p in PARTS], dtype=U64)
    whole = b"".join([header.tobytes(), *[parts[p].astype(kind).tobytes() for p, kind in PARTS.items()]])
    put(folder, name, np.frombuffer(whole, dtype=np.uint8))


@Remembered
def rows_of(folder: str, name: str) -> dict[str, np.ndarray] | None:
    raw = np.asarray(mapped(folder, name, np.dtype("u1")))
    if not len(raw):
        return None
    at, out = 8 * len(PARTS), {}
    for (part, kind), n in zip(PARTS.items(), raw[:at].view(U64)):
        size = int(n) * np.dtype(kind).itemsize
        out[part] = raw[at:at + size].view(kind)
        at += size
    return out


def row_counts(rows: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
    counts = rows["count"][at].astype(np.int64)
    over = np.flatnonzero(counts == BIG)
    if len(over):
        counts[over] = rows["big_count"][np.searchsorted(rows["big"], at[over])]
    return counts


def within(values: np.ndarray, low: np.ndarray, high: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of values in their sorted stretches, and whether they are there; a stretch's questions come together.

    Stretches that are short for their questions are read whole, of others those with many questions one by one, and
    the rest are halved side by side.
    """
    at, held = low.copy(), np.zeros(len(low), dtype=bool)
    first = np.flatnonzero(firsts(low, high))
    questions, size = np.diff(np.append(first, len(low))), (high - low)[first]
    short = size <= 16 * questions
    many = ~short & (questions >= 8)
    mine = np.flatnonzero(np.repeat(short, questions))
    begin = np.cumsum(size[short]) - size[short]
    which = np.repeat(np.arange(len(begin)), size[short])
    read = (which.astype(U64) << U64(32)) | values[np.arange(len(which)) + (low[first[short]] - begin)[which]]
    if len(read):
        which = np.repeat(np.arange(len(begin)), questions[short])
        wanted = (which.astype(U64) << U64(32)) | asked[mine]
        found = np.searchsorted(read, wanted)
        held[mine] = read[np.minimum(found, len(read) - 1)] == wanted
        at[mine] = found + (low[first[short]] - begin)[which]
    for a, n in zip(first[many].tolist(), questions[many].tolist()):
        stretch = values[low[a]:high[a]]
        found = np.searchsorted(stretch, asked[a:a + n])
        held[a:a + n] = stretch[np.minimum(found, len(stretch) - 1)] == asked[a:a + n]
        at[a:a + n] = found + low[a]
    mine = np.flatnonzero(np.repeat(~(short | many), questions))
    low, high, end, asked, left = low[mine], high[mine], high[mine], asked[mine], np.arange(len(mine))
    place, of = low.copy(), asked
    while len(left):
        middle = (low + high) >> 1
        less = values[middle] < asked
        low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
        place[left] = low
        going = np.flatnonzero(low < high)
        if len(going) < len(left):
            low, high, asked, left = low[going], high[going], asked[going], left[going]
    there = place < end
    there[there] = values[place[there]] == of[there]
    at[mine], held[mine] = place, there
    return at, held


def stretches(rows: dict[str, np.ndarray], context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of the sorted different contexts is, and whether it is there."""
    outer = (context >> U64(32)).astype(U32)
    at = np.minimum(np.searchsorted(rows["outer"], outer), len(rows["outer"]) - 1)
    known = rows["outer"][at] == outer
    low, high = (np.where(known, rows["outer_start"][at + k], 0).astype(np.int64) for k in (0, 1))
    at, held = within(rows["inner"], low, high, (context & U64(START_NUMBER)).astype(U32))
    return np.where(held, at, 0), held


def words_within(rows: dict[str, np.ndarray], at: np.ndarray, held: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of sorted words in the contexts at their places, whether they are there, and their counts."""
    low, high = (np.where(held, rows["start"][at + k], 0).astype(np.int64) for k in (0, 1))
    row, hit = within(rows["word"], low, high, word.astype(U32))
    counts = np.zeros(len(word), dtype=np.int64)
    counts[hit] = row_counts(rows, row[hit])
    return row, hit, counts


def looked_up(rows: dict[str, np.ndarray], context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each context is, whether it is there, and the counts of the rows asked for, which come sorted."""
    new = firsts(context)
    which = np.cumsum(new) - 1
    at, held = (x[which] for x in stretches(rows, context[new]))
    return at, held, words_within(rows, at, held, word)[2]


def context_sums(rows: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
    """Total, ones, twos and more of contexts, whose places are given in order."""
    new = firsts(at)
    places = at[new]
    low, size = rows["start"][places].astype(np.int64), np.diff(np.stack([rows["start"][places], rows["start"][places + 1]]).astype(np.int64), axis=0)[0]
    out, wide = np.zeros((len(places), 4)), size >= WIDE
    if wide.any():
        out[wide] = rows["sums"].reshape(-1, 4)[np.searchsorted(rows["wide"], places[wide])]
    low, size = low[~wide], size[~wide]
    if len(low):
        begin = np.concatenate(([0], np.cumsum(size)[:-1]))
        counts = row_counts(rows, np.repeat(low - begin, size) + np.arange(size.sum()))
        out[~wide] = sums_by(counts, begin)
    return out[np.cumsum(new) - 1]


def sums_by(counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    ones, twos = counts == 1, counts == 2
    return np.stack([np.add.reduceat(x, first, dtype=np.int64) for x in (counts, ones, twos, ~(ones | twos))], axis=1)


def tallied(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4."""
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def keep_pairs(folder: str, words: Words, shards: int, order: int):
    """Stores a shard's pairs; sends (number; total, ones, twos, more, continuations) to the words' shards.

    Shard -1 carries the start mark, -2 and -3 the counts of counts of pairs and triples.
    """
    offsets, frequent = words.offsets, triple_frequent(words)

    def sums(keys: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
        numbers = keys.astype(np.int64)
        owner = np.where(numbers == START_NUMBER, -1, np.searchsorted(offsets, numbers, side="right") - 1)
        return sent(owner, keys.astype(U32), np.stack(columns, axis=1).astype(U32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, pairs, counts in received(batches, U64, U32):
            counts = counts[:, 0] if counts.ndim > 1 else counts
            if shard == -3:
                yield sent(np.array([-3]), np.array([0], dtype=U32), np.array([[*counts, 0]], dtype=U32))
                continue
            if shard >= shards:
                put(folder, f"far-{shard}", pairs)
                put(folder, f"far-sum-{shard}", counts.astype(U64))
                continue
            context, word = pairs >> U64(32), pairs & U64(START_NUMBER)
            # all other pairs are the contexts that the shard of the same number has stored, in the same order
            bare = (word == U64(words.numbers(hashes_of(END))[0])) | triple_spread(pairs, frequent)
            put_rows(folder, f"pairs-{shard}", context, word, counts, bare=np.flatnonzero(bare) if order == 3 else None)
            first = np.flatnonzero(firsts(context))
            yield sums(context[first], *sums_by(counts, first).T, np.zeros(len(first), dtype=np.int64))
            word, before = np.unique(word, return_counts=True)
            nothing = np.zeros(len(word), dtype=np.int64)
            yield sums(word, nothing, nothing, nothing, nothing, before)
            yield sent(np.array([-2]), np.array([0], dtype=U32), np.array([[*tallied(counts), 0]], dtype=U32))

    return run


def keep_contexts(folder: str, words: Words):
    """Lays the sums out like the words: total, ones, twos, more and continuations of each."""
    offsets = words.offsets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, keys, values in received(batches, U32, U32, 5):
            known = [0, 0, 0, 0]
            if shard >= 0:
                at = keys.astype(np.int64) - offsets[shard]
                total, rows = np.zeros(words.sizes[shard], dtype=U64), np.zeros((words.sizes[shard], 4), dtype=U32)
                total[at], rows[at] = values[:, 0], values[:, 1:]
                put(folder, f"total-{shard}", total)
                put(folder, f"sums-{shard}", rows)
                known = tallied(values[:, 4])
            yield pa.RecordBatch.from_pydict({"shard": [shard], "sums": [values.sum(axis=0).tolist()], "tally": [known]})

    return run


def discounts(tally: list[int]) -> tuple[float, float, float]:
    """Modified discounts for counts of 1, 2 and more, from how many counts are 1, 2, 3 and 4."""
    n1, n2, n3, n4 = tally
    if not (n1 and n2):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.0), float(k)) for k, d in enumerate(raw, 1))


@dataclass(frozen=True)
class Model:
    words: Words
    shards: int
    of_pairs: tuple[float, float, float]
    of_words: tuple[float, float, float]
    start: tuple[int, ...]  # sums of the start mark as a context
    continuations: int
    left_over: float  # gamma'
    of_triples: tuple[float, float, float] | None = None  # of order three

    def discounted(self, counts: np.ndarray, by: tuple[float, float, float]) -> np.ndarray:
        taken = np.select([counts == 0, counts == 1, counts == 2], [0.0, by[0], by[1]], by[2])
        return np.maximum(counts - taken, 0.0)

    def pair_rows(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shards, rows there (-1: not there) and counts of sorted different pairs."""
        shard = pair_shard(pairs, self.shards, np.array(self.words.frequent, dtype=U64))
        row, counts = np.full(len(pairs), -1, dtype=np.int64), np.zeros(len(pairs))
        for s, mine in parted(shard):
            rows = rows_of(self.words.folder, f"pairs-{s}")
            if rows:
                context = pairs[mine] >> U64(32)
                new = firsts(context)
                which = np.cumsum(new) - 1
                at, held = (x[which] for x in stretches(rows, context[new]))
                at, hit, counts[mine] = words_within(rows, at, held, pairs[mine] & U64(START_NUMBER))
                row[mine] = np.where(hit, at, -1)
        return shard, row, counts

    def triple_counts(self, pairs: np.ndarray, shard: np.ndarray, row: np.ndarray, which: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of sorted different triples, and total, ones, twos and more of their contexts.

        A triple is one of the sorted ``pairs``, of which ``which`` tells the number, with its shard and row, and a next word.
        """
        counts, sums = np.zeros(len(which)), np.zeros((len(which), 4))
        folder, spread = self.words.folder, triple_spread(pairs, triple_frequent(self.words))[which]
        near = np.flatnonzero(~spread & (row[which] >= 0))
        for s, mine in parted(shard[which[near]]):
            mine = near[mine]
            rows = rows_of(folder, f"triples-{s}")
            place = row[which[mine]]
            place -= np.searchsorted(rows_of(folder, f"pairs-{s}")["bare"], place)
            counts[mine] = words_within(rows, place, np.ones(len(mine), dtype=bool), word[mine])[2]
            sums[mine] = context_sums(rows, place)
        far = np.flatnonzero(spread)
        context = pairs[which[far]]
        for s, mine in parted(spread_shard(context, word[far], self.shards)):
            rows = rows_of(folder, f"apart-{s}")
            if rows:
                counts[far[mine]] = looked_up(rows, context[mine], word[far[mine]])[2]
        for s, mine in parted(sums_shard(context, self.shards)):
            for k in range(4):
                known = arrays(folder, f"far-{self.shards * (1 + k) + s}", "u8")
                if len(known):
                    at = np.minimum(np.searchsorted(known, context[mine]), len(known) - 1)
                    found = arrays(folder, f"far-sum-{self.shards * (1 + k) + s}", "u8")[at]
                    sums[far[mine], k] = np.where(known[at] == context[mine], found, 0)
        return counts, sums

    def log_probabilities(self, place: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every token but the first: log10 by the model, by add-one counts, and whether it is known."""
        words, start = self.words, len(known)
        of_known = np.hstack([words.gather("total", "u8", known), words.gather("sums", "u4", known, 4)])
        sums = np.vstack([of_known, np.array(self.start, dtype=float)[None, :], np.zeros((1, 5))])
        counts = np.concatenate([words.gather("count", "i8", known)[:, 0], [0.0, 0.0]])
        seen = self.discounted(sums[:, 4], self.of_words) / max(1, self.continuations)
        single = seen + self.left_over / (words.v + 1)
        total = sums[:, 0]
        back = given_back(sums, self.of_pairs)
        base = U64(start + 2)
        local, where = ranked(place[:-1].astype(U64) * base + place[1:].astype(U64))
        c, w = (x.astype(np.int64) for x in np.divmod(local, base))
        outer = np.concatenate([known, [START_NUMBER, NONE]]).astype(U64)
        pairs = (outer[c] << U64(32)) | outer[w]
        real = np.flatnonzero((c <= start) & (w < start))
        shard, row, found = np.zeros(len(local), dtype=np.int64), np.full(len(local), -1, dtype=np.int64), np.zeros(len(local))
        shard[real], row[real], found[real] = self.pair_rows(pairs[real])
        p = (self.discounted(found, self.of_pairs) / np.maximum(total[c], 1) + back[c] * single[w])[where]
        if self.of_triples is not None:
            # tokens behind two known ones of their text, or the start mark and a known one
            at = np.flatnonzero((place[:-2] <= start) & (place[1:-1] < start) & (place[2:] != start))
            local, triple = ranked(where[at].astype(U64) * base + place[at + 2].astype(U64))
            which, w = (x.astype(np.int64) for x in np.divmod(local, base))
            found, sums = self.triple_counts(pairs, shard, row, which, outer[w])
            top = self.discounted(found, self.of_triples) / np.maximum(sums[:, 0], 1)
            p[at + 1] = top[triple] + given_back(sums, self.of_triples)[triple] * p[at + 1]
        add_one = np.log10((counts + 1) / (words.tokens + words.v + 1))
        return np.log10(p), add_one[place[1:]], (counts > 0)[place[1:]]

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """n_tokens, n_known, base_score and score of each text."""
        out = [np.empty((4, 0))]
        for run in in_runs(texts):
            place, known, starts = placed(run, self.words)
            logs, base, is_known = self.log_probabilities(place, known)
            # the value at i - 1 belongs to token i; start marks count nothing
            inner = place[1:] != len(known)
            out.append(np.stack([np.add.reduceat(np.where(inner, x, 0), starts) for x in (inner, is_known, base, logs)]))
        return tuple(np.concatenate(out, axis=1))


def given_back(sums: np.ndarray, by: tuple[float, float, float]) -> np.ndarray:
    """gamma of contexts, from their totals, ones, twos and more."""
    taken = sums[:, 1] * by[0] + sums[:, 2] * by[1] + sums[:, 3] * by[2]
    return np.where(sums[:, 0] > 0, taken / np.maximum(sums[:, 0], 1), 1.0)


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and which of them each key is."""
    order = np.argsort(keys)
    keys = keys[order]
    new, which = firsts(keys), np.empty(len(keys), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    return keys[new], which


def trained_on(doc_id: Column) -> Column:
    return ~F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def train(docs: DataFrame, order: int = ORDER) -> Model:
    """Count the model of the texts of ``docs``; its arrays stay in the shared folder."""
    if order not in (2, 3):
        raise ValueError("order is two or three")
    spark = docs.sparkSession
    texts = in_small_batches(docs).select("text")
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = min(MOST_SHARDS, 1 + size // SHARD_BYTES)
    word_shards = 1 + shards // 2
    folder = new_folder(spark, "kneser-ney")

    rows = dealt(texts.mapInArrow(count_words(word_shards), SENT), word_shards).mapInArrow(
        keep_words(folder), "shard long, n long, tokens long, top array<long>, top_counts array<long>").collect()
    by = {r["shard"]: r for r in rows}
    sizes = tuple(by[s]["n"] if s in by else 0 for s in range(word_shards))
    tokens = sum(r["tokens"] for r in rows)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    frequent = {START_NUMBER} | {int(offsets[s]) + i for s, r in by.items() for i, n in zip(r["top"], r["top_counts"])
                                 if n * FREQUENT * shards > tokens}
    words = Words(folder, word_shards, sizes, tokens, tuple(sorted(frequent)))
    if words.v >= NONE:
        raise ValueError("word numbers have 32 bits")

    if order == 2:
        pairs = texts.mapInArrow(count_pairs(words, shards), SENT)
    else:
        pairs = dealt(texts.mapInArrow(count_triples(words, shards), SENT), shards).mapInArrow(
            keep_triples(folder, words, shards), SENT)
    sums = dealt(dealt(pairs, shards).mapInArrow(keep_pairs(folder, words, shards, order), SENT), word_shards).mapInArrow(
        keep_contexts(folder, words), "shard long, sums array<long>, tally array<long>").collect()
    at = {r["shard"]: r for r in sums}
    real = [r for r in sums if r["shard"] >= 0]
    continuations = sum(r["sums"][4] for r in real)
    word_tally = [sum(r["tally"][k] for r in real) for k in range(4)]
    of_words = discounts(word_tally)
    several = words.v - word_tally[0] - word_tally[1]
    taken = of_words[0] * word_tally[0] + of_words[1] * word_tally[1] + of_words[2] * several
    return Model(words, shards, discounts(at[-2]["sums"][:4] if -2 in at else [0, 0, 0, 0]), of_words,
                 tuple(at[-1]["sums"]) if -1 in at else (0,) * 5, continuations,
                 taken / continuations if continuations else 1.0,
                 discounts(at[-3]["sums"][:4] if -3 in at else [0, 0, 0, 0]) if order == 3 else None)


def scored(docs: DataFrame, model: Model, into: str = "lm") -> DataFrame:
    """The input's rows with a struct: n_tokens, n_known, base_score, score."""
    @F.pandas_udf("n_tokens long, n_known long, base_score double, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        n_tokens, n_known, base_score, score = model.score(pa.array(texts, pa.large_string(), from_pandas=True))
        return pd.DataFrame({"n_tokens": n_tokens.astype(np.int64), "n_known": n_known.astype(np.int64), "base_score": base_score, "score": score})

    return in_small_batches(docs).withColumn(into, run(docs["text"]))


def perplexity(lm: str = "lm") -> Column:
    return F.pow(F.lit(10.0), -F.col(lm)["score"] / F.col(lm)["n_tokens"])


def query(spark, sf_dir: str) -> DataFrame:
    """op10 over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs.where(trained_on(F.col("doc_id"))))
    return scored(docs, model).select(
        "doc_id", (~trained_on(F.col("doc_id"))).alias("held_out"), "lm.n_tokens", "lm.n_known",
        F.lit(model.words.tokens).cast("long").alias("train_tokens"), "lm.base_score", "lm.score",
        perplexity().alias("perplexity"))
