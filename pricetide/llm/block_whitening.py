"""Whitening of embeddings with MLlib's BlockMatrix: scatter by transpose and multiply, local eigh, projection.

1. Vectors become whole numbers ``floor(1024 * c) + 100000``; count and sums per dimension are exact.
2. Rows are packed into blocks, at first by the task that reads them, so rows need no shuffle to meet: a
   block is one written row with the ids, the exact deviations and the numbers of up to ``rows_of``
   vectors. Blocks are numbered in the order of tasks; a task's last block may be short, which the products
   below allow, since they pair blocks by number.
3. The blocks, centred, are a BlockMatrix A. Its scatter is A' A, in as many middle splits as there are
   ``SPLIT_BYTES`` of blocks (without splits, one task would multiply everything); eigh takes it on the
   driver, where it has as many rows as a vector has entries.
4. A times the whitening matrix (unit eigenvectors over the roots of their eigenvalues) gives the result rows,
   which join the ids by block number. The identity error is taken from P' P of those rows.

The driver holds two matrices of dimension x dimension and, since BlockMatrix plans its product there, the
blocks' numbers: rows per block grow with the table, so that there are about ``MOST_BLOCKS`` of them or one
per task. A product moves both its sides, A' A thus two doubles per entry; lost tasks are run again from
the written blocks.

Defined results: a vector that is null, empty or holds null or non-finite entries is left out, and so are those
of any other length than the most frequent one (the longer of two equally frequent); numbers are bounded to
2**52 either way; repeated rows, equal vectors and null ids each keep their row. A component
without variance (eigenvalue under 1e-12 of the first) cannot be whitened: its values are null. A table
without a usable vector gives no rows. Only the id and the vector column are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.llm.words import in_small_batches, stored, written

SCALE = 1024
SHIFT = 100_000
LARGEST = float(1 << 52)
COMPONENTS = 8
LEAST_ROWS = 2048  # of a block
MOST_BLOCKS = 2_000_000
SPLIT_BYTES = 64 << 20
NO_VARIANCE = 1e-12


@dataclass
class Whitening:
    """A fitted whitening. ``blocks``: block, ids, deviations and numbers of the vectors it was fitted to."""
    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling, as many as the vectors have entries
    vectors: np.ndarray  # unit eigenvectors as columns, in that order
    rows_of: int
    blocks: DataFrame
    matrix: BlockMatrix

    def scaled(self, components: int) -> np.ndarray:
        """The whitening matrix of the first components; zero where there is no variance."""
        values = self.values[:components]
        whole = values > NO_VARIANCE * max(self.values[0], 1e-300)
        return self.vectors[:, :components] * np.where(whole, 1 / np.sqrt(np.where(whole, values, 1.0)), 0.0)

    def explained(self) -> np.ndarray:
        total = self.values.sum()
        return self.values / total if total > 0 else np.zeros(len(self.values))


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def whole_numbers(table: DataFrame, id_column: str, column: str) -> DataFrame:
    """id and x, the whole numbers of every usable vector."""
    vector = table[column].cast("array<double>")
    at = lambda c: F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), SCALE * c))) + F.lit(SHIFT).cast("long")
    return table.where(usable(vector)).select(table[id_column].cast("long").alias("id"), F.transform(vector, at).alias("x"))


def totals(rows: DataFrame) -> tuple[int, list[int]]:
    """Count and exact sums per dimension of the vectors of the most frequent length."""
    each = stored(rows.select(F.size("x").alias("size"), F.posexplode("x").alias("k", "v")).groupBy("size", "k").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")))
    size = each.groupBy("size").agg(F.max("n").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if size is None:
        return 0, []
    found = each.where(F.col("size") == size["size"]).orderBy("k").collect()
    return size["n"], [int(r["s"]) for r in found]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Exact sum over dimensions of (n * x - sum)**2, row by row."""
    near = np.array([s // n for s in sums], dtype=np.int64)
    rest = [s % n for s in sums]
    y = x - near
    most = n * (int(np.abs(y).max(initial=0)) + 1)
    kind = np.int64 if len(sums) * most * most < 1 << 63 else object
    d = n * y.astype(kind) - np.array(rest, dtype=kind)
    return [int(v) for v in (d * d).sum(axis=1)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x less the mean, as doubles; the mean's whole part is taken off before rounding."""
    return (x - np.array([s // n for s in sums], dtype=np.int64)) - np.array([s % n / n for s in sums])


def blocked(rows: DataFrame, n: int, sums: list[int], rows_of: int) -> DataFrame:
    """block, ids, deviations and x of all vectors, a row per block; written."""
    size = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, count, made = TaskContext.get().partitionId(), [], 0, 0

        def block(parts):
            x = np.concatenate([p[1] for p in parts])
            ids = pa.concat_arrays([p[0] for p in parts])
            offsets = pa.array([0, len(ids)], pa.int32())
            devs = pa.array([str(d) for d in deviations(x, n, sums)])
            return pa.RecordBatch.from_arrays([
                pa.array([task], pa.int64()), pa.array([made], pa.int64()), pa.ListArray.from_arrays(offsets, ids),
                pa.ListArray.from_arrays(offsets, devs), pa.array([x.tobytes()], pa.binary())], ["task", "made", "ids", "deviations", "x"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, rows_of - count)
                held.append((part.column("id"), np.asarray(part.column("x").flatten()).reshape(-1, size)))
                at, count = at + part.num_rows, count + part.num_rows
                if count == rows_of:
                    yield block(held)
                    held, count, made = [], 0, made + 1
        if held:
            yield block(held)

    schema = "task long, made long, ids array<long>, deviations array<string>, x binary"
    parts = written(in_small_batches(rows.where(F.size("x") == size)).mapInArrow(run, schema), "whitening-blocks")
    # A row per task that read vectors: few enough for one window and for a broadcast.
    tasks = parts.groupBy("task").agg(F.count(F.lit(1)).alias("k"))
    bases = tasks.select("task", (F.sum("k").over(Window.orderBy("task")) - F.col("k")).alias("base"))
    return parts.join(F.broadcast(bases), "task").select((F.col("base") + F.col("made")).alias("block"), "ids", "deviations", "x")


def block_matrix(blocks: DataFrame, n_blocks: int, n: int, sums: list[int], rows_of: int) -> BlockMatrix:
    """The centred rows; blocks are kept, since every product and its plan reads them anew."""
    def one(row):
        x = np.frombuffer(row["x"], dtype=np.int64).reshape(-1, len(sums))
        return (row["block"], 0), DenseMatrix(len(x), len(sums), centred(x, n, sums).ravel(), True)

    made = blocks.select("block", "x").rdd.map(one)
    return BlockMatrix(made, rows_of, len(sums), n_blocks * rows_of, len(sums)).persist(StorageLevel.MEMORY_AND_DISK)


def multiplied(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """The product with its middle dimension in splits, which the Python class does not pass on."""
    wrapped = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(wrapped, left.rowsPerBlock, right.colsPerBlock)


def fit(table: DataFrame, id_column: str = "vec_id", column: str = "embedding", least_rows: int = LEAST_ROWS,
        most_blocks: int = MOST_BLOCKS) -> Whitening | None:
    """The whitening of all usable vectors of a table; None if it has none."""
    rows = whole_numbers(table, id_column, column)
    n, sums = totals(rows)
    if not n:
        return None
    rows_of = max(least_rows, -(-n // most_blocks))
    blocks = blocked(rows, n, sums, rows_of)
    n_blocks = blocks.count()
    matrix = block_matrix(blocks, n_blocks, n, sums, rows_of)
    splits = max(1, min(n_blocks, 8 * n * len(sums) // SPLIT_BYTES))
    scatter = multiplied(matrix.transpose(), matrix, splits).toLocalMatrix().toArray()
    values, vectors = np.linalg.eigh((scatter + scatter.T) / (2 * n))
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(sums))] < 0, -1.0, 1.0)
    return Whitening(n, sums, values, vectors, rows_of, blocks, matrix)


def projected(model: Whitening, components: int = COMPONENTS) -> BlockMatrix:
    """All rows times the whitening matrix."""
    weights = model.scaled(components)
    size, k = weights.shape
    spark = model.blocks.sparkSession
    small = BlockMatrix(spark.sparkContext.parallelize([((0, 0), DenseMatrix(size, k, weights.ravel(order="F")))], 1), size, k, size, k)
    return model.matrix.multiply(small).persist(StorageLevel.MEMORY_AND_DISK)


def identity_error(model: Whitening, product: BlockMatrix, components: int = COMPONENTS) -> float:
    """Largest entry of the whitened rows' covariance less the identity, over components with variance."""
    splits = max(1, 8 * model.n * components // SPLIT_BYTES)
    whole = model.values[:components] > NO_VARIANCE * max(model.values[0], 1e-300)
    covariance = multiplied(product.transpose(), product, splits).toLocalMatrix().toArray() / model.n
    return float(np.abs(covariance - np.diag(whole.astype(float))).max())


def whitened(model: Whitening, product: BlockMatrix) -> DataFrame:
    """id, deviation (decimal, exact) and the whitened vector of every row."""
    def flat(block):
        (number, _), m = block
        return number, m.toArray().ravel().tobytes()

    spark = model.blocks.sparkSession
    values = spark.createDataFrame(product.blocks.map(flat), "block long, w binary")
    width = product.numCols()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, devs = batch.column("ids").slice(k, 1).flatten(), batch.column("deviations").slice(k, 1).flatten()
                w = np.frombuffer(batch.column("w")[k].as_py(), dtype=np.float64)
                for a in range(0, len(ids), LEAST_ROWS):
                    part = pa.array(w[a * width:(a + LEAST_ROWS) * width])
                    offsets = pa.array(np.arange(0, len(part) + 1, width), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(a, LEAST_ROWS), devs.slice(a, LEAST_ROWS), pa.ListArray.from_arrays(offsets, part)], ["id", "deviation", "whitened"])

    rows = model.blocks.select("block", "ids", "deviations").join(values, "block").select("ids", "deviations", "w")
    found = rows.mapInArrow(run, "id long, deviation string, whitened array<double>")
    return found.select("id", F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened")


def query(spark, sf_dir: str) -> DataFrame:
    """op11 over the whole ``embeddings`` table. A deviation beyond 64 bits is null; the operator's own is a decimal."""
    kinds = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    if model is None:
        return spark.createDataFrame([], kinds)
    product = projected(model)
    error = identity_error(model, product)
    values, share = model.values[:COMPONENTS], model.explained()
    whole = values > NO_VARIANCE * max(model.values[0], 1e-300)
    parts = F.transform(F.col("whitened"), lambda w, i: F.struct((i + 1).alias("component"), w.alias("w")))
    explained = F.array(*[F.lit(float(v)) for v in share[:COMPONENTS]])
    has = F.array(*[F.lit(bool(v)) for v in whole])
    at = F.col("p.component") - 1
    return whitened(model, product).select("id", "deviation", F.explode(parts).alias("p")).select(
        F.col("id").alias("vec_id"), F.col("p.component").cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"),
        F.expr("try_cast(deviation AS bigint)").alias("deviation"), F.when(F.get(has, at), F.col("p.w")).alias("whitened"),
        F.get(explained, at).alias("explained"), F.lit(error).alias("identity_error"))
