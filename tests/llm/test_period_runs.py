import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pricetide.llm import period_runs as pr


def slow_runs(words):
    """Every run by its definition, each period tried at each place."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            s, e = i, j + q
            smaller = any(all(words[k] == words[k + p] for k in range(s, e - p)) for p in range(1, q))
            if e - s >= max(6, 4 * q) and not smaller:
                out.append((s, e - s, q))
            i = j + 1
    return sorted(out)


def slow_row(doc_id, text):
    words = [w for w in pr.split(text)]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = slow_runs(words)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    left = b" ".join(w for i, w in enumerate(words) if i not in drop)
    sha = [hashlib.sha256(x).hexdigest() for x in ("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode(), left)]
    if not runs:
        return (doc_id, 0, None, None, None, None, *sha)
    s, m, q = sorted(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))[0]
    return (doc_id, len(runs), s, m, q, 1000 * m // q, *sha)


@pytest.mark.parametrize("seed", range(60))
def test_against_definition(seed):
    """Long and nested periods between noise, over few and many words."""
    rng = random.Random(seed)
    words = []
    for _ in range(rng.randint(1, 4)):
        words += [rng.randrange(rng.choice([2, 5, 900])) for _ in range(rng.randint(0, 40))]
        q = rng.choice([1, 2, 3, 7, 15, 16, 17, 31, 32, 33, 50, 64, 65])
        base = [rng.randrange(rng.choice([2, 3, 900])) for _ in range(q)]
        if seed % 3 == 0:
            base[q // 2:] = base[:q - q // 2]
        words += (base * 7)[:rng.randint(3 * q, 7 * q)]
    assert pr.word_runs(pr.numbered(words)) == slow_runs(words)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=200), st.integers(0, 5), st.integers(1, 70))
def test_two_words(words, repeats, take):
    words = words + words[-take:] * repeats + words[:3]
    assert pr.word_runs(pr.numbered(words)) == slow_runs(words)


def test_very_long_text_takes_steps_by_its_length():
    rng = random.Random(3)
    line = [rng.randrange(10**6) for _ in range(5000)]
    words = [rng.randrange(10**6) for _ in range(200_000)] + line * 80 + [1, 2] * 100_000
    assert pr.word_runs(pr.numbered(words)) == [(200_000, 400_000, 5000), (600_000, 200_000, 2)]


def test_query_against_definition(spark):
    sf = "/root/testdata/sf0.001"
    got = {tuple(r) for r in pr.query(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert got == {slow_row(r["doc_id"], r["text"]) for r in docs}
    assert sum(r[1] > 0 for r in got) >= 5


def test_operator_and_odd_rows(documents, spark, tmp_path):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "x " * 9 + "y"), (None, "x " * 9 + "y"), (5, "a b\u00a0c " * 4),
            (6, "p " + "q r s " * 6 + "q t"), (7, "z " * 20_000)]
    df = documents(rows).withColumn("start", F.lit("clash")).withColumn("n_runs", F.lit("clash"))
    found = sorted((tuple(r) for r in pr.runs(df).collect()), key=repr)
    assert found == sorted([(None, 0, 9, 1), (None, 0, 9, 1), (5, 0, 8, 2), (6, 1, 19, 3), (7, 0, 20_000, 1)], key=repr)
    out = pr.collapsed(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out.where("text is not null").collect()) == [
        (0, "x y"), (0, "x y"), (2, ""), (3, ""), (5, "a b\u00a0c"), (6, "p q r s t"), (7, "z")]
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in pr.query(spark, str(tmp_path)).collect()]
    assert [r[1:5] for r in got if r[0] == 7] == [(1, 0, 20_000, 1)]
    assert sorted((r for r in got if r[0] != 7), key=repr) == sorted((slow_row(i, t) for i, t in rows if i != 7), key=repr)
    documents([]).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert pr.query(spark, f"{tmp_path}/none").count() == 0
