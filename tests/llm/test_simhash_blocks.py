import random

import pytest
import xxhash
from pyspark.sql import functions as F

from pricetide.llm import simhash_blocks as sb


def slow_print(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, bits):
    """prints: {doc_id: fingerprint}; the smallest id reachable."""
    out, left = {}, set(prints)
    while left:
        start = min(left)
        group, todo = set(), {start}
        while todo:
            x = todo.pop()
            group.add(x)
            todo |= {y for y in left - group if bin(prints[x] ^ prints[y]).count("1") <= bits}
        out |= {x: start for x in group}
        left -= group
    return out


def texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 40, 400]))]
        for _ in range(rng.choice([1, 1, 3])):
            copy = list(base)
            if len(copy) > 100:
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((len(rows) * 3, rng.choice([str.upper, str.lower])(rng.choice([" ", "\n"]).join(copy))))
    return rows


def test_against_brute_force(documents):
    rows = texts()
    out = sb.components(documents(rows)).collect()
    prints = {i: slow_print(t) for i, t in rows}
    assert {r["doc_id"]: r["fingerprint"] for r in out} == {i: f"{p:016x}" for i, p in prints.items()}
    want = slow_components(prints, 2)
    assert {r["doc_id"]: r["component_id"] for r in out} == want
    assert len(set(want.values())) < len(set(prints.values()))


@pytest.mark.parametrize("bits, blocks, crowd", [(2, 4, 64), (2, 3, 2), (3, 6, 64), (3, 5, 2), (2, 4, 1)])
def test_links_join_what_is_close(spark, bits, blocks, crowd):
    rng = random.Random(bits * 10 + blocks)
    prints = set()
    for _ in range(12):
        p = rng.getrandbits(64)
        for _ in range(rng.choice([1, 4, 25])):
            for _ in range(rng.randint(0, 3)):
                p ^= 1 << rng.choice([0, 1, 17, 40, 41, 63])
            prints.add(p)
    ids = {sb.signed(p): p for p in prints}
    from pricetide.llm.components import roots
    df = spark.createDataFrame([(k,) for k in ids], "fp long")
    pairs = sb.links(df, bits, blocks, crowd)
    assert all(bin((r["a"] ^ r["b"]) & (2**64 - 1)).count("1") <= bits for r in pairs.collect())
    root = {r["node"]: r["root"] for r in roots(pairs).collect()}
    want = slow_components(ids, bits)
    assert {k: root.get(k, k) for k in ids} == want


def test_long_chain(spark):
    from pricetide.llm.components import roots
    df = spark.createDataFrame([(i * 7 % 1009, (i + 1) * 7 % 1009) for i in range(700)], "a long, b long")
    assert {r["root"] for r in roots(df).collect()} == {0}
    assert roots(df.where("false")).count() == 0


def test_odd_rows(documents, spark):
    rows = [(9, None), (8, ""), (None, " \n"), (5, "a b"), (5, "a b"), (None, "x y z w"), (None, "x y z w"), (3, "A\tb")]
    df = documents(rows).withColumn("fp", F.lit("clash")).withColumn("root", F.lit("clash"))
    out = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in sb.components(df).collect()}
    assert (9, "0" * 16, 8) in out and (None, "0" * 16, 8) in out
    assert {c for d, f, c in out if d in (3, 5)} == {3}
    assert {c for d, f, c in out if d is None and f != "0" * 16} == {None}
    kept = sb.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept.collect()) == [(-1, "x y z w"), (3, "A\tb"), (8, "")]
    assert sb.components(documents([])).count() == 0 and sb.keep_one(documents([])).count() == 0


def test_keep_one_leaves_distinct_texts(documents):
    rows = texts()
    kept = {r["doc_id"] for r in sb.keep_one(documents(rows)).collect()}
    assert kept == set(slow_components({i: slow_print(t) for i, t in rows}, 2).values())
