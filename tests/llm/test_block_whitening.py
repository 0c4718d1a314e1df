import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricetide.llm import block_whitening as bw

SCHEMA = "vec_id long, embedding array<float>, label int"


def slow(rows, components=8):
    """n, deviations, covariance and its eigenvectors by plain arrays."""
    rows = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    devs = [sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in x]
    a = np.array(x, dtype=float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(a.T @ a / n)
    return [i for i, _ in rows], devs, a, values[::-1], vectors[:, ::-1]


def compared(got, rows):
    ids, devs, a, values, vectors = slow(rows)
    k = min(8, a.shape[1])
    assert len(got) == len(ids) * k
    by_id = {(r["vec_id"], r["component"]): r for r in got}
    whole = values > 1e-12 * values[0]
    want = a @ vectors[:, :k] / np.sqrt(np.where(whole[:k], values[:k], 1))
    for c in range(k):
        col = [by_id[i, c + 1] for i in ids]
        assert [r["n"] for r in col] == [len(ids)] * len(ids) and [r["deviation"] for r in col] == devs
        assert np.allclose([r["explained"] for r in col], values[c] / values.sum(), rtol=1e-9, atol=1e-13)
        if not whole[c]:
            assert {r["whitened"] for r in col} == {None}
            continue
        w = np.array([r["whitened"] for r in col])
        assert min(np.abs(w - want[:, c]).max(), np.abs(w + want[:, c]).max()) < 1e-6
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_query_against_arrays(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    compared(bw.query(spark, sf).collect(), rows)


def test_small_blocks_and_splits(spark, monkeypatch, tmp_path):
    """Many short blocks, several splits of the product, an awkward mean, a hot vector."""
    monkeypatch.setattr(bw, "SPLIT_BYTES", 4096)
    monkeypatch.setattr(bw.fit, "__defaults__", ("vec_id", "embedding", 7, 10**6))
    rng = np.random.RandomState(1)
    spread = np.linspace(3, 0.3, 11)
    rows = [(i, (rng.standard_normal(11) * spread + 50).astype("float32").tolist()) for i in range(300)]
    rows += [(300 + i, rows[5][1]) for i in range(150)]
    spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    compared(bw.query(spark, str(tmp_path)).collect(), rows)


@pytest.mark.parametrize("rows", [
    [(1, [1.0, 2.0]), (2, [1.0, 5.0]), (3, [1.0, -4.0])],
    [(1, [1.0, 2.0, 3.0])],
    [(i, [float(i)]) for i in range(5)],
])
def test_components_without_variance(spark, tmp_path, rows):
    spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = bw.query(spark, str(tmp_path)).collect()
    if len(rows) > 1:
        compared(got, rows)
    else:
        assert [(r["deviation"], r["whitened"], r["explained"]) for r in got] == [(0, None, 0.0)] * 3


def test_odd_rows(spark, tmp_path):
    rng = np.random.RandomState(2)
    good = [(i if i else None, rng.standard_normal(3).astype("float32").tolist()) for i in range(20)]
    bad = [(90, None), (91, []), (92, [1.0, None, 2.0]), (93, [1.0, float("nan"), 2.0]), (94, [1.0, float("inf"), 2.0]), (95, [1.0, 2.0])]
    rows = [(i, v, 0) for i, v in good + bad + good[:2]]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("x", F.lit("clash")).withColumn("block", F.lit("clash")).withColumn("id", F.lit("clash"))
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = bw.query(spark, str(tmp_path)).collect()
    assert Counter(r["vec_id"] for r in got) == Counter([i for i, _ in good + good[:2]] * 3)
    huge = spark.createDataFrame([(i, [3e38 * (-1) ** i, float(i)], 0) for i in range(6)], SCHEMA)
    model = bw.fit(huge)
    out = bw.whitened(model, bw.projected(model)).collect()
    assert len(out) == 6 and all(r["deviation"] > 1 << 64 for r in out)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert bw.query(spark, f"{tmp_path}/none").count() == 0


def test_deviations_beyond_64_bits():
    x = np.array([[10**6, 3], [0, 5]], dtype=np.int64)
    n, sums = 10**9, [5 * 10**14 + 7, 11]
    assert bw.deviations(x, n, sums) == [sum((n * int(v) - s) ** 2 for v, s in zip(r, sums)) for r in x]
