import random

from pyspark.sql import functions as F

from pricetide.llm import seed_decontam as sd


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def slow(text, item):
    """Best stretch over all shifts that a mask hits; a short item is found whole or not at all."""
    w, v = (text or "").lower().split(), item.lower().split()
    if len(v) < 6:
        return len(v) if any(w[p:p + len(v)] == v for p in range(len(w))) and v else 0
    best, least = 0, 9 if len(v) > 16 else min(len(v), 8)
    for p in range(len(w)):
        for q in range(len(v)):
            if any(p + m[-1] < len(w) and q + m[-1] < len(v) and all(w[p + k] == v[q + k] for k in m) for m in sd.MASKS):
                here = 0
                for k in range(max(0, q - p), len(v)):
                    at = p - q + k
                    here = max(here, 0) + (1 if at < len(w) and w[at] == v[k] else -1)
                    best = max(best, here)
    return best if best >= least else 0


def test_sql(same_as_sql):
    same_as_sql(sd.query, sd.ORACLE)


def planted():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(3, 30)))) for i in range(12)] + [(12, "w1"), (13, "w2 w3")]
    docs = []
    for i in range(50):
        body = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        copy = rng.choice(items)[1].split()
        for _ in range(rng.choice([0, 1, 3, 6])):
            copy[rng.randrange(len(copy))] = "changed"
        at = rng.randint(0, len(body))
        docs.append((i, " ".join(body[:at] + copy + body[at:])))
    return docs, items


def test_against_brute_force(documents, spark):
    docs, items = planted()
    want = {}
    for d, text in docs:
        found = {i: s for i, item in items if (s := slow(text, item))}
        want[d] = found
    for limit in (sd.BROADCAST_ROWS, 0):
        out = sd.overlaps(documents(docs), bench(spark, items), limit=limit).collect()
        got = {r["doc_id"]: {} for r in out}
        for r in out:
            for o in r["overlaps"]:
                got[r["doc_id"]][o["item_id"]] = max(o["overlap"], got[r["doc_id"]].get(o["item_id"], 0))
        assert got == want
    assert sum(any(i > 11 for i in v) for v in want.values()) > 10 and sum(any(i < 12 for i in v) for v in want.values()) > 10


def test_every_length_is_found_and_one_word_less_is_not(documents, spark):
    items = [(n, " ".join(f"v{n}x{k}" for k in range(n))) for n in range(1, 25)]
    whole = [(n, f"before {text} after") for n, text in items]
    cut = [(100 + n, "before " + " ".join(text.split()[1:]) + " after") for n, text in items]
    out = {r["doc_id"]: [o["item_id"] for o in r["overlaps"]] for r in sd.overlaps(documents(whole + cut), bench(spark, items)).collect()}
    assert all(out[n] == [n] for n in range(1, 25))
    assert {n for n in range(1, 25) if out[100 + n]} == set(range(9, 17)) | set(range(17, 25)) and not out[108]


def test_four_replaced_words_of_sixteen(documents, spark):
    item = [f"v{k}" for k in range(16)]
    text = " ".join("changed" if k in (3, 7, 10, 13) else w for k, w in enumerate(item))
    assert [o["overlap"] for o in sd.overlaps(documents([(1, text)]), bench(spark, [(5, " ".join(item))])).first()["overlaps"]] == [8]


def test_seeds_of_a_long_item_hold_keys_only(documents, spark, monkeypatch):
    sent = []
    monkeypatch.setattr(sd, "checked", lambda table, rows, limit: sent.append((table.columns, rows)) or table)
    item = " ".join(f"v{k}" for k in range(10_000))
    assert sd.overlaps(documents([(1, "x " + item)]), bench(spark, [(1, item)])).first()["overlaps"][0]["overlap"] == 10_000
    for columns, rows in sent:
        assert "hashes" not in columns and rows < 40_001 or columns == ["item_id", "hashes", "ia", "ib"]


def test_replaced_words(documents, spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    third = " ".join("x" if i % 4 == 3 else w for i, w in enumerate(item.split()))
    rows = [(1, "a b c " + item.upper().replace(" ", ", ") + "."), (2, "z " + third + " y"), (3, "one two three four five six and more")]
    out = {r["doc_id"]: r["overlaps"] for r in sd.overlaps(documents(rows), bench(spark, [(7, item)])).collect()}
    assert out[1][0]["overlap"] == 15 and out[1][0]["item_id"] == 7
    assert out[2] and not out[3]


def test_pieces_of_long_texts_lose_no_window(documents, spark):
    item = " ".join(f"v{i}" for i in range(20))
    for start in (sd.PIECE - 12, sd.PIECE - 1, 2 * sd.PIECE):
        text = " ".join(f"f{i}" for i in range(start)) + " " + item + " tail" * 30
        out = sd.overlaps(documents([(1, text)]), bench(spark, [(0, item)])).first()["overlaps"]
        assert [(o["at"], o["overlap"]) for o in out] == [(start, 20)]


def test_odd_rows(documents, spark):
    item = "a b c d e f g h i j k l"
    rows = [(1, None), (2, ""), (None, item), (4, item), (4, item)]
    df = documents(rows).withColumn("overlaps", F.lit("clash")).withColumn("item_id", F.lit(1)).withColumn("a", F.lit(2))
    items = bench(spark, [(None, item), (2, None), (3, ""), (4, "a b"), (None, item)])
    out = sd.overlaps(df, items)
    assert sorted((r["doc_id"] or 0, len(r["overlaps"])) for r in out.collect()) == [(0, 2), (1, 0), (2, 0), (4, 2), (4, 2)]
    assert sd.clean(df, items).columns == df.columns and sd.clean(df, items).count() == 2
    assert sd.clean(df, items.where("false")).count() == 5
    assert sd.overlaps(documents([]), items).count() == 0
