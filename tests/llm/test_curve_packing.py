import itertools
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from pricetide.llm import curve_packing as cp


@pytest.fixture(scope="module")
def whole():
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path(cp.TOKENIZER))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("axes, bits", [(2, 1), (2, 4), (3, 1), (3, 3), (4, 2)])
def test_curve_visits_neighbours(axes, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
    keys = cp.curve_keys(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_both_libraries_agree(spark):
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += ["", "a" * 5000, " " * 5000, "\n\n x y \U0001f600 <|endoftext|>", "".join(map(chr, range(0x20, 0xD7FF, 7)))]
    slow = cp.encoder(open(public_tokenizers.path(cp.TOKENIZER)).read(), None)(texts)
    assert slow == cp.encoder("", open(public_tokenizers.path(cp.RANKS), "rb").read())(texts)


def checked(rows, texts, whole, length=1024):
    """Pieces cover every document's ids once, and sequences from 0 on without a gap."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc_id, text in texts:
        ids, at = whole(text), 0
        for r in sorted(by_doc.pop(doc_id), key=lambda r: r["start"]):
            part = np.array(ids[at:at + r["length"]], dtype="<u4").tobytes()
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(part)
            at += r["length"]
        assert at == len(ids)
    assert not by_doc and sorted(by_seq) == list(range(len(by_seq)))
    for k, parts in by_seq.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == length or k == len(by_seq) - 1


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query(spark, whole, sf):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").collect()
    checked(cp.query(spark, f"/root/testdata/sf{sf}").collect(), [(r["doc_id"], r["text"]) for r in docs], whole)


def test_alike_documents_are_neighbours(documents):
    """Two sorts of text, mixed up in the input, hardly share a sequence."""
    rows = [(i, " ".join(f"{w}{(i * 7 + k) % 60}" for k in range(40))) for i in range(200) for w in [("alpha", "zulu")[i % 2]]]
    seqs = cp.sequences(cp.pieces(documents(rows), length=512), 512).collect()
    mixed = sum(len({d["doc_id"] % 2 for d in r["documents"]}) > 1 for r in seqs)
    assert len(seqs) > 20 and mixed <= 3


def test_sequences_hold_what_pieces_hold(documents, whole):
    rows = [(i, "word " * (i * 37 % 300)) for i in range(40)]
    seqs = sorted(cp.sequences(cp.pieces(documents(rows), length=64), 64).collect(), key=lambda r: r["sequence_id"])
    stream = np.frombuffer(b"".join(r["ids"] for r in seqs), dtype="<u4").tolist()
    docs = dict(rows)
    assert stream == [x for r in seqs for d in r["documents"] for x in whole(docs[d["doc_id"]])[d["start"]:d["start"] + d["length"]]]
    assert [r["padding"] for r in seqs[:-1]] == [0] * (len(seqs) - 1)
    last = len(seqs[-1]["ids"]) // 4
    assert seqs[-1]["padding"] == (0 if last & (last - 1) == 0 else 64 - last)


def test_odd_rows(documents, whole):
    rows = [(1, None), (2, ""), (None, "a b"), (None, "a b"), (None, None), (3, "x " * 30_000), (4, "same"), (4, "same")]
    df = documents(rows).withColumn("ids", F.lit("clash")).withColumn("row", F.lit("clash")).withColumn("n", F.lit(1))
    got = cp.pieces(df).collect()
    assert sum(r["length"] for r in got) == sum(len(whole(t)) for _, t in rows)
    assert sum(r["doc_id"] is None for r in got) == 3 and sum(r["doc_id"] == 4 for r in got) == 2
    assert cp.pieces(documents([])).count() == 0
    slow = cp.pieces(documents(rows[:3]), tokenizer=public_tokenizers.path(cp.TOKENIZER))
    assert sorted((r["doc_id"] or 0, r["length"]) for r in slow.collect()) == [(0, 3), (1, 1), (2, 1)]
