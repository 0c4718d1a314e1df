"""Packing along a space-filling curve: documents alike in tokens follow one another in the token stream.

1. Every text becomes its token ids, once. Their counts are hashed into ``BUCKETS`` signed buckets, damped,
   scaled to length one and projected to ``AXES`` dimensions by a fixed random matrix. Ids, their number and
   the point are written.
2. A point is scaled by mean and deviation of all points and becomes a cell of a grid; the cell's place on
   the Hilbert curve is the key. Narrow rows (number, key, tokens) are sorted by range of (key, row number),
   so a group of equal documents, whose keys are equal too, is dealt over as many ranges as it needs.
3. The tokens before each row are those of the ranges before it plus those before it in its range. Place p of
   that stream is place p % length of sequence p // length: documents are cut where a sequence ends, every
   sequence but the last is full, and the whole corpus is padded by less than one sequence.

Only step 2 brings documents together, and only as three numbers; the ids move once, to their starts. What
is broadcast is a row per range of the sort. Points are whole numbers and their sums exact, so keys do not
depend on the order of summing; only the order of equal rows depends on how the input was split.

Defined results: a null or empty text is the end id alone; equal rows and null ids are packed like any other
row; a text longer than a sequence runs on into the next ones; no documents give no pieces; columns of the
input other than doc_id and text are not read. A special token's name in a text is ordinary text.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.llm.words import in_small_batches, narrow, written

TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
LENGTH = 1024
END = 0
AXES = 3
BITS = 20
BUCKETS = 256
UNIT = 1 << 20  # a point's whole numbers per unit
TEXTS_AT_ONCE = 64
ODD = np.uint64(0x9E3779B97F4A7C15)


def encoder(tokenizer: str, ranks: bytes | None) -> Callable[[list[str]], list[list[int]]]:
    """Token ids of texts. With the same vocabulary as ranks the faster of two libraries is taken; both give the same ids."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if ranks is None:
        import tokenizers

        whole = tokenizers.Tokenizer.from_str(tokenizer)
        whole.encode_special_tokens = True
        return lambda texts: [e.ids for e in whole.encode_batch_fast(texts, add_special_tokens=False)]
    import tiktoken

    table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines())}
    merges = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return lambda texts: [merges.encode_ordinary(t) for t in texts]


def hashed(ids: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Signed bucket counts of the ids, damped by a square root and scaled to length one (or zero)."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * ODD
    h ^= h >> np.uint64(32)
    counts = np.bincount((h % np.uint64(buckets)).astype(np.int64), (h >> np.uint64(20) & np.uint64(1)) * 2.0 - 1.0, buckets)
    damped = np.sign(counts) * np.sqrt(np.abs(counts))
    size = np.sqrt(damped @ damped)
    return damped / size if size else damped


def projection(axes: int = AXES, buckets: int = BUCKETS) -> np.ndarray:
    return np.random.RandomState(12).standard_normal((buckets, axes))


def encoded(docs: DataFrame, tokenizer_path: str, ranks_path: str | None, end: int, axes: int) -> DataFrame:
    """Row number, doc_id, ids (two or four bytes each, little-endian), n and the point of every row; written."""
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = f.read()
    ranks = None
    if ranks_path:
        with open(ranks_path, "rb") as f:
            ranks, vocabulary = f.read(), ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, matrix = encoder(vocabulary, ranks), projection(axes)
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(k, TEXTS_AT_ONCE)
                lists = [np.array(x + [end], dtype="<u4") for x in encode([t or "" for t in part.column("text").to_pylist()])]
                points = np.rint(np.array([hashed(x) for x in lists]) @ matrix * UNIT).astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    part.column("row"), part.column("doc_id"),
                    pa.array([(x.astype("<u2") if x.max() < 1 << 16 else x).tobytes() for x in lists], pa.binary()),
                    pa.array([len(x) for x in lists], pa.int64()), pa.array(list(points), pa.list_(pa.int64()))], out)

    out = ["row", "doc_id", "ids", "n", "point"]
    rows = in_small_batches(docs).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(run, "row long, doc_id long, ids binary, n long, point array<long>"), "packing-ids")


def curve_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of cells, an array of (row, axis) of whole numbers under 2**bits.

    From the coarsest bit down, each axis whose bit is set mirrors the first axis below that bit, and
    otherwise changes places with it; a Gray code then gives the order, whose bits are interleaved.
    """
    x = [c.astype(np.int64).copy() for c in cells.T]
    zero = np.zeros(len(cells), dtype=np.int64)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(len(x)):
            mirrored = x[i] >> b & 1 == 1
            swap = np.where(mirrored, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(mirrored, low, swap)
            x[i] ^= np.where(mirrored, 0, swap) if i else zero
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = zero.copy()
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> b & 1 == 1, (1 << b) - 1, 0)
    key = zero.copy()
    for b in range(bits - 1, -1, -1):
        for axis in x:
            key = key << 1 | ((axis ^ turn) >> b & 1)
    return key


def grid(points: np.ndarray, mean: np.ndarray, spread: np.ndarray, bits: int) -> np.ndarray:
    """Cells of points: about equally filled along each axis if the points are near normal."""
    share = 1 / (1 + np.exp(-1.702 * np.clip((points - mean) / spread, -40, 40)))
    return np.minimum((share * (1 << bits)).astype(np.int64), (1 << bits) - 1)


def keyed(rows: DataFrame, axes: int, bits: int) -> DataFrame:
    """Row number, tokens and curve key of encoded rows."""
    sums = [F.sum(F.col("point")[i].cast("decimal(30,0)")).alias(f"s{i}") for i in range(axes)]
    squares = [F.sum((F.col("point")[i] * F.col("point")[i]).cast("decimal(30,0)")).alias(f"q{i}") for i in range(axes)]
    all_ = rows.agg(F.count(F.lit(1)).alias("n"), *sums, *squares).first()
    n = max(1, all_["n"])
    mean = np.array([float((all_[f"s{i}"] or 0) / n) for i in range(axes)])
    square = np.array([float((all_[f"q{i}"] or 0) / n) for i in range(axes)])
    spread = np.sqrt(np.maximum(square - mean * mean, 1.0))

    @F.pandas_udf("long")
    def key(points):
        return points.__class__(curve_keys(grid(np.stack(points.to_numpy()), mean, spread, bits), bits)) if len(points) else points.astype("int64")

    return rows.select("row", "n", key(F.col("point")).alias("key"))


def starts(rows: DataFrame, axes: int, bits: int) -> DataFrame:
    """Row number and the tokens before the row, along the curve."""
    order = ["key", "row"]
    dealt = keyed(rows, axes, bits).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = written(dealt.withColumn("range", F.spark_partition_id()), "packing-order")
    totals = ranged.groupBy("range").agg(F.sum("n").alias("in_range"))
    # A row per range of the sort, as many as tasks; they fit one task and a broadcast.
    bases = totals.select("range", (F.sum("in_range").over(Window.orderBy("range")) - F.col("in_range")).alias("base"))
    before = F.sum("n").over(Window.partitionBy("range").orderBy(*order)) - F.col("n")
    return ranged.withColumn("before", before).join(F.broadcast(bases), "range").select("row", (F.col("base") + F.col("before")).alias("place"))


def cut_column(ids: Column, n: Column, place: Column, length: int) -> Column:
    """The pieces of a row that starts at a place of the stream: start, length, sequence_id, offset, ids (four bytes each)."""
    @F.pandas_udf("array<struct<start long, length long, sequence_id long, offset long, ids binary>>")
    def run(ids, n, place):
        def pieces(raw, count, at):
            every = np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * count else "<u4").astype("<u4")
            cuts = [0, *range(length - at % length, count, length), count]
            return [{"start": a, "length": b - a, "sequence_id": (at + a) // length, "offset": (at + a) % length, "ids": every[a:b].tobytes()}
                    for a, b in zip(cuts, cuts[1:])]

        return n.__class__([pieces(*x) for x in zip(ids, n.tolist(), place.tolist())], dtype=object)

    return run(ids, n, place)


def pieces(docs: DataFrame, tokenizer: str | None = None, ranks: str | None = None, length: int = LENGTH, end: int = END,
           axes: int = AXES, bits: int = BITS) -> DataFrame:
    """A row per piece: doc_id, doc_tokens, start, length, sequence_id, offset and ids.

    ``tokenizer`` is the path of a vocabulary for the tokenizers library, ``ranks`` that of the same one
    as ranks; without either the byte-level vocabulary of 50,257 ids is used in both forms.
    """
    if tokenizer is None:
        tokenizer, ranks = public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS)
    if axes * bits > 62:
        raise ValueError("a key has 62 bits at most")
    rows = encoded(narrow(docs, "doc_id", "text"), tokenizer, ranks, end, axes)
    placed = in_small_batches(rows.select("row", "doc_id", "ids", "n").join(starts(rows, axes, bits), "row"))
    cut = F.explode(cut_column(F.col("ids"), F.col("n"), F.col("place"), length))
    return placed.select("doc_id", F.col("n").alias("doc_tokens"), cut.alias("p")).select("doc_id", "doc_tokens", "p.*")


def sequences(parts: DataFrame, length: int = LENGTH) -> DataFrame:
    """A row per sequence: its ids in order, the documents they come from, and the padding it needs.

    A sequence whose size is a power of two needs none. At most ``length`` pieces meet in one row.
    """
    rows = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids"))).alias("p"))
    size = F.aggregate("p", F.lit(0).cast("long"), lambda n, p: n + p["length"])
    joined = F.aggregate("p", F.lit(b""), lambda all_, p: F.concat(all_, p["ids"]))
    of = F.transform("p", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["start"].alias("start"), p["length"].alias("length")))
    padding = F.when(size.bitwiseAND(size - 1) == 0, 0).otherwise(length - size).cast("long")
    return rows.select("sequence_id", joined.alias("ids"), of.alias("documents"), padding.alias("padding"))


def query(spark, sf_dir: str) -> DataFrame:
    """op12 over the whole ``documents`` table."""
    parts = pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return parts.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
