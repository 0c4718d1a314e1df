import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pricetide.llm import entropy_mix as em


def test_sql(same_as_sql):
    same_as_sql(em.query, em.ORACLE)


def fill(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Targets by cutting and resharing until none is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > cap * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        out |= {s: cap * sizes[s] for s in over}
        left -= sum(cap * sizes[s] for s in over)
        free -= over
    return out


def corpus(seed=2, n=600):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["a"] * 9 + ["b", "c", "D", "é", "z", None])
        rows.append((i, " ".join(["w"] * rng.choice([0, 3, 10, 40, 90])), source))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_taken(documents, seed):
    rows = corpus(seed)
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(text.split())
    out = em.mixed(documents(rows)).collect()
    want = fill(sizes)
    taken = defaultdict(int)
    for r in out:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-12)
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
    assert all(abs(taken[s] - want[s]) <= 45 for s in sizes)
    again = em.mixed(documents(rows[::-1])).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in again) == sorted((r["doc_id"], r["copies"]) for r in out)


def test_dual_with_priors(documents):
    """Rates must be the capped exponential tilt of the prior whose tokens meet the target."""
    rows = corpus(7)
    df = documents(rows).withColumn("q", F.when(F.col("doc_id") % 3 == 0, 0.2).otherwise(1.3))
    out = em.mixed(df, prior="q").collect()
    by = defaultdict(list)
    for r in out:
        by[r["source"]].append(r)
    for group in by.values():
        target = group[0]["target"]
        assert sum(r["rate"] * r["size"] for r in group) == pytest.approx(target, rel=1e-9)
        open_ = [math.log(r["rate"] / r["q"]) for r in group if r["rate"] < 2]
        assert not open_ or max(open_) - min(open_) < 1e-9
        assert abs(sum(r["copies"] * r["size"] for r in group) - target) <= 90
        assert all(r["copies"] in (math.floor(r["rate"]), math.floor(r["rate"]) + 1) for r in group)


def test_repeated_rows_of_the_mix(documents):
    df = documents(corpus(3)).withColumn("copies", F.lit("clash")).withColumn("s", F.lit(0))
    rows = em.mixed(df).select("doc_id", "copies").collect()
    counts = {r["doc_id"]: r["copies"] for r in rows if r["copies"]}
    made = em.repeated(df)
    assert made.columns == df.columns
    assert {r["doc_id"]: r["count"] for r in made.groupBy("doc_id").count().collect()} == counts


def test_odd_rows(documents):
    rows = [(1, None, None), (2, "", "a"), (None, "x y", "a"), (3, "x y z", "b"), (3, "x y z", "b"), (4, "w " * 50000, "c")]
    out = em.mixed(documents(rows)).collect()
    assert len(out) == 6 and all(r["copies"] * r["size"] <= 2 * r["size"] for r in out)
    assert {r["target"] for r in out if r["source"] is None} == {0.0}
    assert len({r["copies"] for r in out if r["doc_id"] == 3}) == 1
    assert em.mixed(documents([])).count() == 0 and em.repeated(documents([])).count() == 0
    assert {r["copies"] * r["size"] for r in em.mixed(documents([(1, None, "a"), (2, "", None)])).collect()} == {0}
