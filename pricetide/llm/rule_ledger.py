"""Quality rules as a ledger of failure bits, judged afterwards by versioned policies.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per
failed rule; a policy is a mask over those bits, so another policy, or the question what a policy
would keep without one of its rules, needs no second look at any text.

Defined results: a null text is an empty one; a null ``doc_id`` stays null; repeated rows get a row
each; an empty table gives an empty ledger. Other columns of the input are left alone, unless they
have the name of a ledger column, which then is the ledger's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.functions.text import bound
from pricetide.llm.words import fresh, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8

# Rule names by bit. A document fails a rule where the expression over its measurements holds.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines",
    "upper_case": "2 * n_upper > word_chars",
    "word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
    "stutter": "10 * n_stutter > 3 * n_words",
}
BASE_RULES = ("few_words", "repeated_windows")

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_stutter"]


@dataclass(frozen=True)
class Policy:
    """A version and the rules whose failure rejects a document."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


POLICIES = [
    Policy("base", BASE_RULES),
    Policy("2026-11", (*BASE_RULES, "symbols", "upper_case")),
    Policy("2026-12", tuple(RULES)),
]
CURRENT = POLICIES[-1]


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """How many words lie in a window of ``width`` words that the text holds at least twice.

    Windows are compared by 64-bit hash. Only texts that do repeat a window sort their windows by
    hash; equal neighbours give the start positions, and consecutive starts cover at most ``width``
    words each.
    """
    def covered(hashes: Column) -> Column:
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        shared = bound(by_hash, lambda s: F.filter(s, lambda e, j: (
            F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False))
            | F.coalesce((j > 0) & (F.get(s, F.greatest(j - 1, F.lit(0)))["h"] == e["h"]), F.lit(False)))))
        starts = F.sort_array(F.transform(shared, lambda e: e["i"]))
        return bound(starts, lambda s: F.aggregate(
            F.transform(s, lambda p, j: F.least(F.lit(width), F.coalesce(F.get(s, j + 1) - p, F.lit(width)))),
            F.lit(0).cast("long"), lambda total, n: total + n))

    windows = bound(words, lambda w: F.transform(
        F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, width))))
    return F.when(F.size(words) > width, bound(windows, lambda h: F.when(
        F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))
    ).otherwise(F.lit(0)).cast("long")


def stutters(words: Column) -> Column:
    """How many words equal the word before them."""
    return bound(words, lambda w: F.size(F.filter(w, lambda x, i: (i > 0) & (F.get(w, i - 1) == x)))).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """The input's columns with one long column per measurement."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")))
    kept = docs.drop(*[c for c in docs.columns if c in MEASURES or c.startswith("ledger_")])
    split = kept.withColumns({"ledger_words": words_of(F.col("text")), "ledger_lines": lines})
    return split.withColumns({
        "n_words": F.size("ledger_words").cast("long"),
        "word_chars": F.char_length(F.array_join("ledger_words", "")).cast("long"),
        "n_symbols": F.char_length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long"),
        "n_dup_lines": (F.size("ledger_lines") - F.size(F.array_distinct("ledger_lines"))).cast("long"),
        "n_repeat_words": repeated_words(F.col("ledger_words")),
        "n_lines": F.size("ledger_lines").cast("long"),
        "n_upper": F.char_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long"),
        "n_stutter": stutters(F.col("ledger_words")),
    }).drop("ledger_words", "ledger_lines")


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements and ``failed_rules``, bit i set where rule i of ``RULES`` fails."""
    bits = F.lit(0).cast("long")
    for i, failing in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(failing), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measured(docs).withColumn("failed_rules", bits)


def rejected_by(policy: Policy) -> Column:
    return F.col("failed_rules").bitwiseAND(F.lit(policy.mask)) != 0


def verdicts(ledger_rows: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """``base_failed`` and ``kept``; the base rules reject under every policy."""
    base = rejected_by(POLICIES[0])
    return ledger_rows.withColumns({
        "base_failed": base, "kept": ~base & ~rejected_by(policy), "policy": F.lit(policy.version)})


def passing(docs: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """The rows of ``docs`` the policy keeps, with their own columns and values."""
    text, = fresh("text")
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias(text), docs["text"].alias("text"))
    kept = verdicts(ledger(whole), policy).where("kept")
    return kept.select(*[F.col(text)[c].alias(c) for c in docs.columns])


def ablations(ledger_rows: DataFrame, policies: list[Policy] = POLICIES) -> DataFrame:
    """Per policy and rule: documents and words the rule rejects, and those only it rejects.

    The ledger shrinks to its distinct bit patterns (at most 2 to the number of rules) before
    policies are applied, so the number of policies costs nothing at scale.
    """
    patterns = ledger_rows.groupBy("failed_rules").agg(
        F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("words"))
    tests = [F.struct(F.lit(p.version).alias("policy"), F.lit(r).alias("rule"), F.lit(p.mask).cast("long").alias("mask"),
                      F.lit(1 << list(RULES).index(r)).cast("long").alias("bit")) for p in policies for r in p.rules]
    applied = patterns.select("*", F.explode(F.array(*tests)).alias("t"))
    hit = F.col("failed_rules").bitwiseAND(F.col("t.bit")) != 0
    sole = F.col("failed_rules").bitwiseAND(F.col("t.mask")) == F.col("t.bit")
    return applied.groupBy("t.policy", "t.rule").agg(
        *[F.sum(F.when(which, F.col(what)).otherwise(0)).alias(f"{name}_{what}")
          for name, which in (("failed", hit), ("sole", sole)) for what in ("docs", "words")])


def query(spark, sf_dir: str) -> DataFrame:
    """op2 over the whole ``documents`` table."""
    rows = verdicts(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return rows.select("doc_id", *MEASURES[:5], "base_failed", "kept", "failed_rules", "policy")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT r, doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
windows AS (
  SELECT r, i, array_to_string(words[i:i+7], ' ') AS win
  FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) > 8)),
shared AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT r, sum(least(8, coalesce(nxt - i, 8))) AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM shared) GROUP BY r),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
         length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_upper,
         len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS n_stutter
  FROM w LEFT JOIN covered USING (r)),
b AS (
  SELECT *, ((n_words < 20)::INT
    + 2 * (100 * n_repeat_words > 30 * n_words)::INT
    + 4 * (10 * n_symbols > n_words)::INT
    + 8 * (n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines)::INT
    + 16 * (2 * n_upper > word_chars)::INT
    + 32 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::INT
    + 64 * (10 * n_stutter > 3 * n_words)::INT)::BIGINT AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, failed_rules = 0 AS kept,
       failed_rules, '2026-12' AS policy
FROM b
"""
