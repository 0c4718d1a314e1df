import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricetide.llm import crf_quality as cq


def toy(seed=0, n=5):
    rng = np.random.default_rng(seed)
    return [(rng.normal(size=(k, cq.N_FEATURES)), int(rng.integers(2))) for k in rng.integers(1, 6, size=n)]


def test_marginals_against_all_labelings():
    rng = np.random.default_rng(3)
    field = cq.Field(rng.normal(size=3 * cq.N_FEATURES) / 3, rng.normal(size=(2, 2)))
    for x, _ in toy(1, 6):
        e = cq.with_neighbours(x) @ field.weights
        total, good = 0.0, np.zeros(len(x))
        for y in itertools.product((0, 1), repeat=len(x)):
            p = np.exp(sum(e[i] for i in range(len(x)) if y[i]) + sum(field.links[a, b] for a, b in zip(y, y[1:])))
            total += p
            good += p * np.array(y)
        assert field.marginals(x) == pytest.approx(good / total, rel=1e-9)


def test_gradient():
    rows = sorted(toy(2, 7), key=lambda r: -len(r[0]))
    x = np.vstack([cq.with_neighbours(r[0]) for r in rows])
    sizes = np.array([len(r[0]) for r in rows])
    batch = {"x": x, "y": np.array([float(r[1]) for r in rows]), "sizes": sizes,
             "starts": np.concatenate(([0], np.cumsum(sizes)[:-1]))}
    theta = np.random.default_rng(5).normal(size=x.shape[1] + 4) / 4
    _, slope = cq.loss_and_slope(theta, batch)
    for i in range(0, len(theta)):
        step = np.zeros_like(theta)
        step[i] = 1e-6
        numeric = (cq.loss_and_slope(theta + step, batch)[0] - cq.loss_and_slope(theta - step, batch)[0]) / 2e-6
        assert slope[i] == pytest.approx(numeric, abs=1e-6)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = {r["doc_id"]: r for r in cq.query(spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    aside = {i: r for i, r in out.items() if zlib.crc32(str(i).encode()) % 4 == 2}
    assert all(r["held_out"] == (i in aside) for i, r in out.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out.values())
    told = [(labels[i], r["predicted"]) for i, r in aside.items() if i in labels]
    assert sum(a == b for a, b in told) / len(told) > 0.95
    again = {r["doc_id"]: r["score"] for r in cq.query(spark, sf).collect()}
    assert all(abs(again[i] - r["score"]) < 1e-9 for i, r in out.items())


def test_odd_rows(documents, spark):
    text = "A fine line of plain words.\nAnother good line here.\n"
    rows = [(i, text + f"word{i} and more", "a") for i in range(20)] + [(100 + i, "### $$$ %%%\n&&& ***\n|||", "a") for i in range(20)]
    df = documents(rows + [(1, None), (None, ""), (500, " \n\n"), (501, "w " * 100000), (501, "w " * 100000)])
    df = df.withColumn("score", F.lit("clash")).withColumn("quality", F.lit("clash")).withColumn("id", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(100 + i, 0, 0) for i in range(20)] + [(None, 1, 0), (3, None, 0)],
                                   "doc_id long, quality int, toxic int")
    field = cq.train(df, labels)
    out = cq.scored(df, field).collect()
    assert len(out) == 45 and all(0 <= r["score"] <= 1 for r in out)
    assert min(r["score"] for r in out[:20]) > 0.7 > max(r["score"] for r in out[20:40])
    assert len({r["score"] for r in out if not (r["text"] or "").strip()}) == 1
    untrained = cq.train(df, labels.where("false"))
    assert {r["score"] for r in cq.scored(df, untrained).collect()} == {0.5}
    assert cq.scored(documents([]), cq.train(documents([]), labels)).count() == 0
    lines = df.where("doc_id = 2").select(cq.line_marginals(F.col("text"), field).alias("m")).first()["m"]
    assert len(lines) == 3
