import random

from pyspark.sql import functions as F

from pricetide.llm import rule_ledger as rl


def brute_repeats(text, width=8):
    words = [w for w in text.replace("\n", " ").split(" ") if w]
    seen = {}
    for i in range(len(words) - width + 1):
        seen.setdefault(tuple(words[i:i + width]), []).append(i)
    covered = {p for starts in seen.values() if len(starts) > 1 for s in starts for p in range(s, s + width)}
    return len(covered)


def test_sql(same_as_sql):
    same_as_sql(rl.query, rl.ORACLE)


def test_repeated_words_against_brute_force(documents):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        body = [rng.choice("abc") for _ in range(rng.randint(0, 60))]
        rows.append((i, " ".join(body + body[: rng.randint(0, 30)])))
    got = {r["doc_id"]: r["n_repeat_words"] for r in rl.measured(documents(rows)).collect()}
    assert got == {i: brute_repeats(t) for i, t in rows}


def test_odd_rows(documents, spark):
    rows = [(1, None), (2, ""), (None, "a b"), (4, "x " * 60000), (5, " \n\t\n"), (5, " \n\t\n")]
    out = rl.verdicts(rl.ledger(documents(rows).withColumn("n_words", F.lit("clash")))).collect()
    by_id = {r["doc_id"]: r for r in out}
    assert len(out) == 6
    assert by_id[1]["n_words"] == by_id[2]["n_words"] == 0 and not by_id[1]["kept"]
    assert by_id[4]["n_repeat_words"] == 60000 and by_id[4]["base_failed"]
    assert by_id[5]["n_dup_lines"] == 0
    empty = documents([])
    assert rl.verdicts(rl.ledger(empty)).count() == 0
    assert rl.ablations(rl.ledger(empty)).count() == 0


def test_lines_equal_to_an_earlier_line(documents):
    out = rl.measured(documents([(1, "a b\n\nc\na b\n a b\nc\nc")])).first()
    assert (out["n_dup_lines"], out["n_symbols"], out["word_chars"]) == (3, 0, 9)


def test_ablations_count_what_one_rule_alone_rejects(documents):
    noisy = "ab*** " * 3 + " ".join(f"word{i}" for i in range(30))
    rows = [(1, noisy), (2, "a b"), (3, "## a"), (4, " ".join(f"word{i}" for i in range(30)))]
    out = {(r["policy"], r["rule"]): r for r in rl.ablations(rl.ledger(documents(rows))).collect()}
    assert out["2026-12", "symbols"]["failed_docs"] == 2
    assert out["2026-12", "symbols"]["sole_docs"] == 1
    assert out["base", "few_words"]["sole_docs"] == 2
