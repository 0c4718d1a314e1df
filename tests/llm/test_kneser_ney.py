import glob
import math
import os
import random
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pricetide.llm import kneser_ney as kn

END = "</end>"


def low(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "").split()


def slow_model(texts, order=3):
    """p(w, v, u) of the model from its definition, over dicts; u is None for the first token of a text."""
    triples, occurs, tokens = Counter(), Counter(), Counter()
    for t in texts:
        seq = low(t) + [END]
        tokens.update(seq)
        occurs.update(zip(["<start>", *seq], seq))
        triples.update(zip(["<start>", *seq], seq, seq[1:]))
    pairs, behind, follow, before = occurs, defaultdict(list), defaultdict(list), Counter()
    if order == 3:
        pairs = Counter((v, w) for _, v, w in triples)
        pairs.update({(v, w): n for (v, w), n in occurs.items() if v == "<start>"})
    for (u, v, w), n in triples.items():
        behind[u, v].append(n)
    for (v, w), n in pairs.items():
        follow[v].append(n)
        before[w] += 1

    def cuts(counts):
        n = Counter(counts)
        if not (n[1] and n[2]):
            return lambda c: 0.5 if c else 0.0
        y = n[1] / (n[1] + 2 * n[2])
        d = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
        d = [min(max(x, 0), k) for k, x in enumerate(d, 1)]
        return lambda c: d[min(c, 3) - 1] if c else 0.0

    dt, dp, dw = cuts(triples.values()), cuts(pairs.values()), cuts(before.values())
    types = sum(before.values())
    left = sum(dw(c) for c in before.values()) / types if types else 1.0

    def p(w, v, u=None):
        if u is not None and order == 3 and behind[u, v]:
            total = sum(behind[u, v])
            return max(triples[u, v, w] - dt(triples[u, v, w]), 0) / total + sum(map(dt, behind[u, v])) / total * p(w, v)
        one = max(before[w] - dw(before[w]), 0) / max(1, types) + left / (len(tokens) + 1)
        if not follow[v]:
            return one
        total = sum(follow[v])
        return max(pairs[v, w] - dp(pairs[v, w]), 0) / total + sum(map(dp, follow[v])) / total * one

    return p, tokens


def slow_scores(text, p, tokens):
    seq = low(text) + [END]
    n, v = sum(tokens.values()), len(tokens)
    return (len(seq), sum(tokens[w] > 0 for w in seq), sum(math.log10((tokens[w] + 1) / (n + v + 1)) for w in seq),
            sum(math.log10(p(*x)) for x in zip(seq, ["<start>", *seq], [None, "<start>", *seq])))


def corpus(seed, n=80):
    rng = random.Random(seed)
    words = ["the"] * 20 + ["Of", "a", "É"] * 5 + [f"w{i}" for i in range(60)]
    return [(i, rng.choice(["\n", " ", "\t "]).join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 50])))) for i in range(n)]


@pytest.mark.parametrize("order", [2, 3])
@pytest.mark.parametrize("shard_bytes", [16 << 20, 700])
def test_against_definition(documents, monkeypatch, shard_bytes, order):
    monkeypatch.setattr(kn, "SHARD_BYTES", shard_bytes)
    rows = corpus(1)
    p, tokens = slow_model([t for _, t in rows], order)
    model = kn.train(documents(rows), order)
    if order == 3 and shard_bytes == 700:  # some pair of words is dealt over all shards
        assert len(model.words.frequent) > 2
    assert (model.words.tokens, model.words.v) == (sum(tokens.values()), len(tokens))
    assert (model.shards > 4) == (shard_bytes == 700)
    asked = rows + [(1000, "never seen words the"), (1001, None), (1002, ""), (None, "the the"), (3, rows[3][1]), (3, rows[3][1]),
                    (1003, "THE of " * 30000)]
    df = documents(asked).withColumn("lm", F.lit("clash")).withColumn("shard", F.lit("clash"))
    out = kn.scored(df, model).select("doc_id", "text", "lm.*").collect()
    assert len(out) == len(asked)
    for r in out:
        n, k, base, score = slow_scores(r["text"], p, tokens)
        assert (r["n_tokens"], r["n_known"]) == (n, k)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-9)


def test_probabilities_of_a_context_sum_to_one():
    p, tokens = slow_model([t for _, t in corpus(4)])
    for u, v in ((None, "<start>"), ("<start>", "the"), ("of", "the"), ("the", "w3"), ("the", "unseen"), ("unseen", "the")):
        assert sum(p(w, v, u) for w in tokens) + p("not there", v, u) == pytest.approx(1)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    aside = {r["doc_id"] for r in docs if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2}
    texts = {r["doc_id"]: r["text"] for r in docs}
    p, tokens = slow_model([t for i, t in texts.items() if i not in aside])
    out = kn.query(spark, sf).collect()
    assert {r["doc_id"] for r in out} == set(texts)
    for r in out:
        n, k, base, score = slow_scores(texts[r["doc_id"]], p, tokens)
        assert r["held_out"] == (r["doc_id"] in aside) and r["train_tokens"] == sum(tokens.values())
        assert (r["n_tokens"], r["n_known"]) == (n, k)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-9)
    heldout = [r for r in out if r["held_out"]]
    assert sum(r["score"] for r in heldout) > sum(r["base_score"] for r in heldout)


def test_empty_tables(documents):
    model = kn.train(documents([]))
    assert kn.scored(documents([]), model).count() == 0
    out = kn.scored(documents([(1, "a b"), (2, None)]), model).select("lm.*").collect()
    assert [(r["n_tokens"], r["n_known"], r["score"], r["base_score"]) for r in out] == [(3, 0, 0, 0), (1, 0, 0, 0)]


def test_arrays_are_mapped(tmp_path):
    from pricetide.llm import array_store
    array_store.put(f"file://{tmp_path}/a", "x", np.arange(5))
    got = array_store.mapped(f"file://{tmp_path}/a", "x", "i8")
    assert isinstance(got, np.memmap) and got.tolist() == [0, 1, 2, 3, 4]
    assert len(array_store.mapped(f"{tmp_path}/a", "none", "i8")) == 0


def test_rows_keep_large_counts_and_wide_contexts(tmp_path):
    rng = random.Random(9)
    counts = {(c, w): rng.choice([1, 1, 2, 3, 254, 255, 256, 5_000_000_000])
              for c in range(0, 300, 3) for w in rng.sample(range(500), rng.choice([1, 2, 63, 64, 200]))}
    keys = sorted(counts)
    context, word = (np.array(x, dtype=np.uint64) for x in zip(*keys))
    n = np.array([counts[k] for k in keys])
    kn.put_rows(f"file://{tmp_path}", "x", context, word, n, kn.sums_by(n, np.flatnonzero(kn.firsts(context))))
    rows = kn.rows_of(f"file://{tmp_path}", "x")
    asked = sorted({*keys, *[(rng.randrange(310), rng.randrange(510)) for _ in range(2000)]})
    c, w = (np.array(x, dtype=np.uint64) for x in zip(*asked))
    at, held, found = kn.looked_up(rows, c, w)
    assert found.tolist() == [counts.get(k, 0) for k in asked] and held.tolist() == [k[0] < 300 and k[0] % 3 == 0 for k in asked]
    of = defaultdict(list)
    for (k, _), x in counts.items():
        of[k].append(x)
    want = [[sum(v), v.count(1), v.count(2), sum(x > 2 for x in v)] for v in (of[k] for (k, _), h in zip(asked, held) if h)]
    assert kn.context_sums(rows, at[held]).tolist() == want
    assert kn.rows_of(f"file://{tmp_path}", "none") is None


@pytest.mark.parametrize("kind", ["u8", "u4", "i8"])
def test_packed_arrays_come_back(kind):
    rng = np.random.default_rng(2)
    for rows, width in ((0, 1), (1, 1), (1000, 1), (1000, 5)):
        values = rng.integers(0, 1 << 31, (rows, width)).astype(kind)
        assert (kn.unpacked(kn.packed(values), kind).reshape(-1, width) == values).all()
    keys = np.sort(rng.integers(0, 1 << 31, 5000)).astype(kind)
    assert (kn.unpacked(kn.packed(keys), kind) == keys).all() and len(kn.packed(keys)) < keys.nbytes / 1.3


def test_contexts_of_triples_are_not_stored_again(documents):
    rows = corpus(5, 400)
    triples = {t for _, text in rows for seq in [["<start>", *low(text), END]] for t in zip(seq, seq[1:], seq[2:])}
    model = kn.train(documents(rows))
    size = sum(os.path.getsize(f) for name in ("triples", "apart") for f in glob.glob(f"{model.words.folder.removeprefix('file:')}/{name}-*"))
    contexts = len({t[:2] for t in triples})
    assert contexts > 1000 and size < 5 * len(triples) + 5 * contexts + 1000  # word, count; first row


def test_counting_makes_no_call_per_word():
    def calls(words):
        seen, texts = Counter(), [" ".join(f"w{i % words}" for i in range(20000))]
        sys.setprofile(lambda frame, event, arg: seen.update([event]))
        try:
            assert len(list(kn.count_words(1)(iter([pa.RecordBatch.from_pydict({"text": pa.array(texts)})])))) == 1
        finally:
            sys.setprofile(None)
        return seen.total()

    calls(10)
    assert calls(20000) < 2 * calls(10)


def test_words_are_split_at_ascii_blanks_and_only_ascii_is_lowered():
    texts = [None, "", " \t", "\x1cA\x85b \u2003C\u00c9 a a\x00"] + [f" {chr(c)}X{chr(c)}{chr(c)} Y{chr(c)}" for c in range(256)]
    for kind in (pa.string(), pa.large_string()):
        words, sizes = kn.words_of(pa.array(texts, kind))
        want = [(t or "").encode().lower().split() for t in texts]
        assert [w.encode() for w in words.to_pylist()] == sum(want, []) and sizes.tolist() == [len(w) for w in want]
        assert len(set(kn.hashes_of(words.dictionary).tolist())) == len(words.dictionary) == len(set(sum(want, [])))


@pytest.mark.parametrize("others", [0, 2_700_000])  # with many words three places do not fit 64 bits
def test_triples_of_a_run_are_counted_in_order(others):
    rng, want, runs = random.Random(6), Counter(), []
    for part in range(3):
        known = np.unique(np.concatenate((np.arange(1000, 1000 + others), [rng.randrange(1 << 31) for _ in range(30)])))
        places = []
        for size in (0, 1, 200):
            places += [len(known), *(rng.randrange(30) for _ in range(size)), 29]
            seq = [kn.START_NUMBER, *(int(known[p]) for p in places[-size - 1:])]
            want.update(zip([kn.NONE, *seq], seq, seq[1:]))
        runs.append((np.array(places, dtype=np.uint32), known))
    context, word, counts = kn.counted(runs)
    got = list(zip((context >> np.uint64(32)).tolist(), (context & np.uint64(0xFFFFFFFF)).tolist(), word.tolist()))
    assert got == sorted(want) and counts.tolist() == [want[t] for t in got]


def test_values_are_found_in_short_and_long_stretches():
    rng = random.Random(7)
    values, low, high, asked = [], [], [], []
    for _ in range(300):
        stretch = sorted(rng.sample(range(5000), rng.choice([0, 1, 3, 400, 2000])))
        wanted = sorted(rng.choice(stretch or [0]) + rng.choice([0, 0, 1]) for _ in range(rng.choice([1, 2, 20, 60])))
        low += [len(values)] * len(wanted)
        values += stretch
        high += [len(values)] * len(wanted)
        asked += wanted
    at, held = kn.within(np.array(values, dtype="u4"), np.array(low), np.array(high), np.array(asked, dtype="u4"))
    assert held.tolist() == [x in values[a:b] for x, a, b in zip(asked, low, high)]
    assert 0 < held.sum() < len(held) and all(values[p] == x for p, x, h in zip(at, asked, held) if h)
