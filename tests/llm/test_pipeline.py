from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from pricetide.llm import entropy_mix, ring_shards, rule_ledger, seed_decontam
from test_entropy_mix import fill
from test_rule_ledger import brute_repeats
from test_shingle_copies import slow_kept

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def passes(text):
    words = [w for w in (text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
    lines = [x for x in (text or "").split("\n") if x.strip()]
    chars, n = sum(map(len, words)), len(words)
    return not (n < 20 or 100 * brute_repeats(text or "") > 30 * n or 10 * sum(c in "#*$%&|<>" for c in text) > n
                or (len(lines) >= 4 and 100 * (len(lines) - len(set(lines))) > 50 * len(lines))
                or 2 * sum("A" <= c <= "Z" for c in text) > chars or chars < 2 * n or chars > 15 * n
                or 10 * sum(a == b for a, b in zip(words, words[1:])) > 3 * n)


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage returns, as rows."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in cp.STAGES:
        df = stage(spark, docs, SF)
        rows = df.collect()
        out.append((name, df.columns, rows))
        docs = spark.createDataFrame(rows, df.schema)
    return out


def test_stages(spark, stages):
    before = spark.read.parquet(f"{SF}/documents.parquet").collect()
    for name, columns, rows in stages:
        assert columns == COLUMNS + ["shard"] * (name == "sharding")
        ids = Counter(r["doc_id"] for r in rows)
        if name == "quality rules":
            assert ids == Counter(r["doc_id"] for r in before if passes(r["text"]))
        elif name == "SimHash near-dedup":
            assert ids == Counter(slow_kept([(r["doc_id"], r["text"]) for r in before])) and len(rows) == 153
        elif name == "benchmark decontamination":
            items = [r["text"].lower() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            leaked = {r["doc_id"] for r in before if any(i in r["text"].lower() for i in items)}
            assert not leaked & set(ids) and len(before) - len(rows) - len(leaked) in range(0, 4)
        elif name == "mixing":
            size = {r["doc_id"]: len(r["text"].split()) for r in before}
            source = {r["doc_id"]: r["source"] for r in before}
            have, took, most = Counter(), Counter(), defaultdict(int)
            for i, n in size.items():
                have[source[i]] += n
                took[source[i]] += n * ids[i]
                most[source[i]] = max(most[source[i]], n)
            want = fill(have)
            assert all(abs(took[s] - want[s]) <= most[s] / 2 + 1 for s in have)
        else:
            assert ids == Counter(r["doc_id"] for r in before)
            shards = Counter()
            for r in rows:
                shards[r["shard"]] += len(r["text"].encode()) + 8
            assert len(shards) == 24
        before = rows


def test_run_reads_back_what_the_stages_return(spark, stages):
    assert sorted(cp.run(spark, SF).collect(), key=repr) == sorted(stages[-1][2], key=repr)


def test_odd_tables(documents, spark):
    odd = documents([(1, None), (None, ""), (None, None), (3, "a " * 5000), (3, "a " * 5000)])
    clash = odd
    for name in ("fp", "n", "files", "bits", "print", "size", "slot", "copies", "source_size", "target", "base_failed"):
        clash = clash.withColumn(name, F.lit("clash"))
    for df in (documents([]), odd, clash):
        for _, stage in cp.STAGES:
            df = stage(spark, df, SF)
            rows = df.collect()
            df = spark.createDataFrame(rows, df.schema)
