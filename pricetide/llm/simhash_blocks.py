"""SimHash near-duplicates: fingerprints that share a block meet in a join and are compared.

A fingerprint has 64 bits; bit i is 1 if it is set in over half of the hashes of the text's word
shingles. Two fingerprints that differ in at most ``bits`` places, cut into ``blocks`` pieces, agree
on at least ``blocks - bits`` whole pieces, so each is filed once under every choice of that many
pieces, and only fingerprints filed alike are compared.

Texts with the same fingerprint are one row from then on. A crowded file (more than ``CROWD``
fingerprints that agree on the chosen pieces) is not compared pair by pair: its members are filed
under all values half way to their partners (themselves with up to ``bits // 2`` places changed, and
for an odd bound one side with one more), under which nearly all crowds fall apart into small ones.

Defined results: null and empty texts have fingerprint zero; a text of fewer words than a shingle is
one shingle; a null ``doc_id`` counts as a document but never names a component unless all are null;
repeated rows get the same component; no table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.llm.components import roots
from pricetide.llm.words import fresh, in_small_batches, narrow, stored, text_key

WIDTH = 3
SEED = 42
BITS = 2
BLOCKS = 4
CROWD = 64
ROWS_AT_ONCE = 50_000  # shingles whose bits are unpacked together


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The fingerprint as a signed long. A-Z count as a-z; words end at ASCII blanks."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1:].tolist())
    hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], dtype=">u8")
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), ROWS_AT_ONCE):
        part = hashes[k:k + ROWS_AT_ONCE].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">i8")[0])


def fingerprint_column(text: Column, width: int = WIDTH) -> Column:
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    return run(text)


def piece_masks(blocks: int) -> list[int]:
    """64 bits cut into nearly equal pieces, as masks."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(cuts, cuts[1:])]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def filed(prints: DataFrame, bits: int, blocks: int) -> DataFrame:
    """One row per fingerprint and choice of pieces: the choice and the bits of those pieces."""
    choices = [sum(c) for c in combinations(piece_masks(blocks), blocks - bits)]
    files = [F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key"))
             for i, m in enumerate(choices)]
    return prints.select("fp", F.explode(F.array(*files)).alias("f")).select("fp", "f.*")


def close(a: str, b: str, bits: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= bits


def joined_links(rows: DataFrame, on: list[str], bits: int) -> DataFrame:
    """Pairs of fingerprints of one file within the bound."""
    left, right = rows.withColumnRenamed("fp", "a"), rows.withColumnRenamed("fp", "b")
    return left.join(right, on).where((F.col("a") < F.col("b")) & close("a", "b", bits)).select("a", "b")


def changed(places: int) -> Column:
    """``fp`` with up to ``places`` of its bits flipped."""
    flips = [signed(sum(1 << b for b in c)) for n in range(places + 1) for c in combinations(range(64), n)]
    return F.transform(F.array(*[F.lit(f) for f in flips]), lambda flip: F.col("fp").bitwiseXOR(flip))


def halfway_links(prints: DataFrame, bits: int) -> DataFrame:
    """Links among fingerprints of crowded files, without comparing all pairs.

    For an even bound, two fingerprints are within it exactly if some value lies within half the
    bound of both; at such a value everyone is within the bound of everyone, so a star to the
    smallest holds the same components. For an odd bound the star joins those within the smaller
    half, and each value's smallest also meets those within the larger half.
    """
    half = bits // 2
    near = prints.select("fp", F.explode(changed(half)).alias("mid"))
    least = near.groupBy("mid").agg(F.min("fp").alias("a"))
    star = near.join(least, "mid").where("fp <> a").select("a", F.col("fp").alias("b"))
    if bits % 2 == 0:
        return star
    wide = prints.select(F.col("fp").alias("b"), F.explode(changed(bits - half)).alias("mid"))
    return star.union(least.join(wide, "mid").where("a <> b").select("a", "b"))


def links(prints: DataFrame, bits: int = BITS, blocks: int = BLOCKS, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) with the same components as all pairs of distinct ``fp`` within ``bits`` places."""
    if not 0 < bits < blocks:
        raise ValueError("there must be more pieces than places that may differ")
    files = filed(prints, bits, blocks)
    sizes = files.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = files.join(sizes, ["choice", "key"])
    pairs = joined_links(shared.where(F.col("n") <= crowd).select("choice", "key", "fp"), ["choice", "key"], bits)
    crowded = shared.where(F.col("n") > crowd).select("fp").distinct()
    return pairs.union(halfway_links(crowded, bits))


def component_ids(rows: DataFrame, pairs: DataFrame, roots=roots) -> DataFrame:
    """(fp, root, component_id) for the fp of (doc_id, fp) rows, linked by pairs (a, b) of fp."""
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    linked = roots(pairs)
    rooted = stored(prints.join(linked, prints["fp"] == linked["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")))
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(ids, "root").select("fp", "root", "component_id")


def labelled(rows: DataFrame, bits: int = BITS, blocks: int = BLOCKS) -> DataFrame:
    """(fp, root, component_id) for the fingerprints of (doc_id, fp) rows."""
    return component_ids(rows, links(stored(rows.select("fp").distinct()), bits, blocks))


def components(docs: DataFrame, bits: int = BITS, blocks: int = BLOCKS, width: int = WIDTH) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, a row per row of ``docs``."""
    rows = stored(in_small_batches(narrow(docs, "doc_id", "text")).select(
        F.col("doc_id").cast("long").alias("doc_id"), fingerprint_column(F.col("text"), width).alias("fp")))
    return rows.join(labelled(rows, bits, blocks), "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, bits: int = BITS, blocks: int = BLOCKS, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component, the row of the smallest doc_id.

    Where several rows claim the place (repeated rows, null ids) one of them stays.
    """
    rows = stored(in_small_batches(narrow(docs, "doc_id", "text")).select(
        F.col("doc_id").cast("long").alias("doc_id"), fingerprint_column(F.col("text"), width).alias("fp"),
        text_key(F.col("text")).alias("text_id")))
    return one_of_each(docs, rows, labelled(rows, bits, blocks))


def one_of_each(docs: DataFrame, rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that name a component; ``rows`` has their doc_id, text_id and fp, ``labels`` what fp belongs to."""
    claims = rows.join(labels, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    tally = claims.groupBy("root", "component_id", "text_id").agg(F.count(F.lit(1)).alias("n"))
    id_, a, b, many = fresh("id", "a", "b", "many")
    keep = stored(tally.groupBy("root").agg(F.min(F.struct("text_id", "component_id", "n")).alias("k")).select(
        F.col("k.component_id").alias(id_), F.col("k.text_id.a").alias(a), F.col("k.text_id.b").alias(b),
        (F.col("k.n") > 1).alias(many)))
    key = text_key(docs["text"])
    match = docs["doc_id"].cast("long").eqNullSafe(F.col(id_)) & (key["a"] == F.col(a)) & (key["b"] == F.col(b))
    own = [docs[c] for c in docs.columns]
    single = docs.join(keep.where(~F.col(many)), match).select(*own)
    repeated = keep.where(F.col(many))
    if repeated.isEmpty():
        return single
    return single.union(docs.join(repeated, match).dropDuplicates([id_, a, b]).select(*own))


def query(spark, sf_dir: str) -> DataFrame:
    """op7 over the whole ``documents`` table."""
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
