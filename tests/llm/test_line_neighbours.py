import random

from pyspark.sql import functions as F

from pricetide.llm import line_neighbours as ln


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def slow(rows):
    """{doc_id: (n_lines, n_copies, n_near, text)}, by comparing all lines with all earlier ones."""
    seen, out = [], {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        kept, n = [], [0, 0, 0]
        for line in (text or "").split("\n"):
            words = line.split()
            if words:
                n[0] += 1
                copy = words in seen
                near = not copy and len(words) >= ln.NEAR_WORDS and any(
                    len(s) >= ln.NEAR_WORDS and distance(s, words) == 1 for s in seen)
                seen.append(words)
                n[1] += copy
                n[2] += near
                if copy or near:
                    continue
            kept.append(line)
        out[i] = (*n, "\n".join(kept))
    return out


def corpus(seed):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(30)}" for _ in range(rng.choice([1, 3, 8, 9, 14]))] for _ in range(25)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(rng.randint(0, 8)):
            words = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randrange(len(words))
                kind = rng.choice("idr")
                if kind == "i":
                    words.insert(at, f"w{rng.randrange(30)}")
                elif kind == "d" and len(words) > 1:
                    del words[at]
                else:
                    words[at] = f"w{rng.randrange(30)}"
            lines.append(rng.choice([" ", "  ", "\t"]).join(words))
            if rng.random() < 0.2:
                lines.append(rng.choice(["", "  "]))
        rows.append((i, "\n".join(lines)))
    return rows


def test_sql(same_as_sql):
    same_as_sql(ln.query, ln.ORACLE)


def test_against_all_pairs(documents):
    rows = corpus(1) + [(i + 100, t) for i, t in corpus(2)]
    want = slow(rows)
    for limit in (ln.BROADCAST_LINES, 0):
        out = ln.deduped(documents(rows), limit).collect()
        assert {r["doc_id"]: (r["n_lines"], r["n_copies"], r["n_near"], r["text"]) for r in out} == want
    assert sum(w[2] for w in want.values()) > 20 and sum(w[1] for w in want.values()) > 20


def test_one_apart(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(300):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 5))]
        b = [rng.choice("abc") for _ in range(rng.randint(0, 5))]
        rows.append((a, b))
    df = spark.createDataFrame(rows, "x array<string>, y array<string>")
    for r in df.withColumn("one", ln.one_apart(F.col("x"), F.col("y"))).collect():
        assert r["one"] == (distance(r["x"], r["y"]) == 1), (r["x"], r["y"])


def test_a_template_of_many_lines(documents, spark):
    """All lines of a template share a variant; pairs must not multiply."""
    rows = [(i, f"this line of the template has number {i} in it somewhere") for i in range(300)]
    df = documents(rows)
    out = {r["doc_id"]: r["n_near"] for r in ln.deduped(df).collect()}
    assert out == {i: int(i > 0) for i in range(300)}
    table = ln.line_table(df)
    ranked = table.groupBy("h1", "h2").agg(F.min(ln.order()).alias("rank")).join(ln.suspects(table), ["h1", "h2"])
    assert ln.pairs(ln.with_words(df, ranked)).count() == 299


def test_odd_rows(documents):
    line = "one two three four five six seven eight nine"
    rows = [(2, None), (3, ""), (None, line), (5, line), (5, line), (6, line + " ten\n\n x "), (7, "w " * 30000)]
    df = documents(rows).withColumn("n_lines", F.lit("clash")).withColumn("place", F.lit("clash"))
    out = ln.deduped(df)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "place", "n_lines", "n_copies", "n_near"]
    got = sorted(((r["doc_id"] or 99), r["text"], r["n_lines"], r["n_copies"], r["n_near"]) for r in out.collect() if r["doc_id"] != 7 and r["text"] is not None)
    assert got == [(3, "", 0, 0, 0), (5, line, 1, 0, 0), (5, line, 1, 0, 0), (6, "\n x ", 2, 0, 1), (99, "", 1, 1, 0)]
    assert ln.deduped(documents([])).count() == 0
