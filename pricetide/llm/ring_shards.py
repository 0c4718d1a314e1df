"""Shards on a consistent-hash ring with virtual nodes and bounded loads.

A row's place on the ring is a hash of its id and text. The ring is cut into ``SLICES`` equal slices;
every shard owns many virtual nodes, and a slice belongs to the next node clockwise. No shard may
take more than (1 + ``SLACK``) of the mean bytes: slices, heaviest first, that find their shard full
go on clockwise to the next shard with room. Sizes of slices are summed in Spark; their placing looks
at no more than ``SLICES`` totals, a fixed number, on the driver, and comes back as a table of that
size. A row's shard then follows from its hash without any shuffle.

With another number of shards most slices keep their node; what moves is what the new shard takes
over and what the changed bound pushes on.

Defined results: a null text has no bytes; rows are placed each for itself, also with null or
repeated ids; rows equal in id and text share a slice; when a single slice exceeds what is left
anywhere it goes to the emptiest shard; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.llm.words import fresh

SHARDS = 24
SLICE_BITS = 16
SLICES = 1 << SLICE_BITS
NODES = 256
SLACK = 0.001
OVERHEAD = 8


def place(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, F.coalesce(text, F.lit("")))


def slice_of(position: Column) -> Column:
    return F.shiftrightunsigned(position, 64 - SLICE_BITS).cast("int")


def row_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def ring(shards: int, nodes: int = NODES) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, in ring order. A shard's nodes do not depend on the others."""
    return sorted((xxhash.xxh64_intdigest(f"shard {s} node {v}"), s) for s in range(shards) for v in range(nodes))


def assign(loads: dict[int, int], shards: int = SHARDS, slack: float = SLACK, nodes: int = NODES) -> dict[int, int]:
    """Shard of each slice, from the bytes of each slice that has any."""
    circle = ring(shards, nodes)
    positions = [p for p, _ in circle]
    bound = (1 + slack) * sum(loads.values()) / shards
    filled = [0] * shards
    smallest = min(loads.values(), default=0)
    full: set[int] = set()
    out = {}
    for piece, size in sorted(loads.items(), key=lambda x: (-x[1], x[0])):
        at = bisect_left(positions, piece << (64 - SLICE_BITS))
        for step in range(len(circle)):
            shard = circle[(at + step) % len(circle)][1]
            if shard not in full and filled[shard] + size <= bound:
                break
            if len(full) == shards:
                step = len(circle)
                break
        if filled[shard] + size > bound:
            shard = min(range(shards), key=lambda s: (filled[s], s))
        out[piece] = shard
        filled[shard] += size
        if filled[shard] + smallest > bound:
            full.add(shard)
    return out


def slice_table(docs: DataFrame, shards: int = SHARDS, slack: float = SLACK) -> DataFrame:
    """slice, shard and first (how many rows of the shard come before the slice); at most ``SLICES`` rows."""
    totals = docs.groupBy(slice_of(place(docs["doc_id"], docs["text"])).alias("slice")).agg(
        F.sum(row_size(docs["text"])).alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    chosen = assign({r["slice"]: r["bytes"] for r in totals}, shards, slack)
    rows, before = [], [0] * shards
    for r in sorted(totals, key=lambda r: r["slice"]):
        shard = chosen[r["slice"]]
        rows.append((r["slice"], shard, before[shard]))
        before[shard] += r["n"]
    table = pd.DataFrame(rows, columns=["slice", "shard", "first"]).astype({"slice": "int32", "shard": "int32", "first": "int64"})
    return docs.sparkSession.createDataFrame(table, "slice int, shard int, first long")


def placed(docs: DataFrame, shards: int = SHARDS, slack: float = SLACK, slots: bool = False,
           keep: list[str] | None = None) -> DataFrame:
    """The input's rows with ``shard`` and, if asked for, ``slot`` (the row's number within its shard).

    ``keep`` names the columns to carry, all by default. The slice table is broadcast: ``SLICES``
    bounds it whatever the input. Input columns called shard or slot are replaced.
    """
    position, tie, here, piece, first = fresh("position", "tie", "here", "piece", "first")
    table = slice_table(docs, shards, slack).withColumnsRenamed({"slice": piece, "first": first})
    kept = [c for c in (keep or docs.columns) if c not in ("shard", "slot")]
    at = place(docs["doc_id"], docs["text"])
    rows = docs.select(*[docs[c] for c in kept], at.alias(position), F.xxhash64(docs["text"]).alias(tie),
                       slice_of(at).alias(here))
    found = rows.join(F.broadcast(table), F.col(here) == F.col(piece))
    if not slots:
        return found.select(*kept, "shard")
    order = Window.partitionBy(here).orderBy(position, tie, *[c for c in ("doc_id",) if c in kept])
    return found.select(*kept, "shard", (F.col(first) + F.row_number().over(order) - 1).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, files: int = 8) -> None:
    """One folder per shard, each of up to ``files`` files; a row's file follows from its hash."""
    rows = placed(docs, shards)
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(files))
    rows.repartition(shards * files, "shard", part).write.partitionBy("shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    """op9 over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", "text", row_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    return placed(docs, slots=True, keep=["doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
