"""Secrets, told apart by who holds them: widely copied examples and credentials of one owner.

Candidates are found by pattern with their code point spans. Each candidate's value is hashed, and
over the whole corpus every hash is counted by the distinct repositories and distinct owners that
hold it. A value that ``SHARED_BY`` owners or ``COPIED_BY`` repositories or more hold is an example: many
owners do not share a credential, and one pasted into that many repositories, even of one owner, is
boilerplate. The others look live. Both counts are returned with every span reported.
Candidates of the base kinds are reported either way, with that verdict; candidates of the broader
kinds (``MORE``) are reported only if they look live, since mere shape says little about a string
that everybody has.

Text is scanned once; spans are stored, and counting and reporting read those. Positions come from
the lengths of what lies between the matches, as patterns never match across a line end or the
empty string. Counts are distinct aggregations that combine before the shuffle, so a value in a
third of all rows is no hot group; spans of equal lists are judged once and joined back.

Defined results: a null text is empty; a null owner or repository counts as one of its own; repeated
rows each keep a row; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.functions.text import bound
from pricetide.llm.words import stored

# Fixed words that introduce a value; letters in either case.
WORDS = ("password", "passwd", "secret", "token", "api_?key")


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    value: int = 0  # the group that holds the value
    least: int = 0  # shortest value
    needs: tuple[str, ...] = ()  # patterns the value must hold


# Runs are maximal, so a minimum length in the pattern finds the same matches as a later test would.
BASE = [
    Kind("assign", "(" + "|".join(map(either_case, WORDS)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Kind("access", "AKIA[A-Z0-9]{12,}"),
    Kind("hex", "[0-9a-f]{32,}"),
]
MORE = [
    Kind("key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Kind("opaque", "[A-Za-z0-9+/_-]{24,}", needs=("[0-9]", "[A-Z]", "[a-z]")),
]
KINDS = BASE + MORE
SHARED_BY = 3
COPIED_BY = 50
TOLD = "array<struct<shared:boolean,n_repos:long,n_owners:long>>"
SPAN = "array<struct<start:long,kind:int,end:long,value:long>>"


def spans_of(text: Column, number: int, kind: Kind) -> Column:
    """Matches of one kind, leftmost first and not overlapping; ``value`` is a hash."""
    between = F.transform(F.split(text, kind.pattern), lambda p: F.char_length(p))
    lengths = F.transform(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), lambda m: F.char_length(m))
    values = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.value))
    matches = F.arrays_zip(between.alias("gap"), lengths.alias("n"), values.alias("v"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("out"))

    def step(s: Column, m: Column) -> Column:
        # the piece after the last match has no match of its own
        begin = s["at"] + m["gap"]
        end = begin + F.coalesce(m["n"], F.lit(0))
        good = m["n"].isNotNull() & (F.char_length(m["v"]) >= kind.least)
        for need in kind.needs:
            good = good & F.rlike(m["v"], F.lit(need))
        span = F.struct(begin.cast("long").alias("start"), F.lit(number).alias("kind"), end.cast("long").alias("end"),
                        F.xxhash64(m["v"]).alias("value"))
        return F.struct(end.cast("long").alias("at"), F.when(good, F.array_append(s["out"], span)).otherwise(s["out"]).alias("out"))

    return F.when(F.rlike(text, F.lit(kind.pattern)), F.aggregate(matches, start, step, lambda s: s["out"])).otherwise(
        F.array().cast(SPAN))


def candidates(text: Column) -> Column:
    """All spans of a text, by start and then kind."""
    return bound(F.coalesce(text, F.lit("")), lambda t: F.array_sort(F.concat(
        *[spans_of(t, i, kind) for i, kind in enumerate(KINDS)])))


def ownership(found: DataFrame, shared_by: int = SHARED_BY, copied_by: int = COPIED_BY) -> DataFrame:
    """value, n_repos, n_owners and shared for every value of rows (repo, owner, spans)."""
    held = found.select("repo", "owner", F.explode("spans").alias("s")).select("repo", "owner", "s.value")
    return held.groupBy("value").agg(
        F.count_distinct(F.struct("repo")).alias("n_repos"), F.count_distinct(F.struct("owner")).alias("n_owners")
    ).withColumn("shared", (F.col("n_owners") >= shared_by) | (F.col("n_repos") >= copied_by))


def printed(spans: Column) -> Column:
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, repo: str = "doc_id", owner: str = "source", shared_by: int = SHARED_BY,
         copied_by: int = COPIED_BY) -> DataFrame:
    """doc_id, repo, owner, spans and ``told``, the verdict and both counts of each span, a row per row of ``docs``."""
    found = stored(docs.select(
        docs["doc_id"].alias("doc_id"), docs[repo].alias("repo"), docs[owner].alias("owner"),
        candidates(docs["text"]).alias("spans")))
    some = found.where(F.size("spans") > 0).withColumn("list", F.sha2(F.to_json("spans"), 256))
    verdicts = stored(ownership(found, shared_by, copied_by)).withColumnRenamed("value", "v").select(
        "v", F.struct("shared", "n_repos", "n_owners").alias("t"))
    lists = some.groupBy("list").agg(F.first("spans").alias("spans"))
    judged = lists.select("list", F.posexplode("spans").alias("i", "s")).join(verdicts, F.col("s.value") == F.col("v"))
    by_list = stored(judged.groupBy("list").agg(F.sort_array(F.collect_list(F.struct("i", "t"))).alias("j")).select(
        F.col("list").alias("l"), F.transform("j", lambda x: x["t"]).alias("told")))
    with_some = some.join(by_list, F.col("list") == F.col("l")).select("doc_id", "repo", "owner", "spans", "told")
    without = found.where(F.size("spans") == 0).withColumn("told", F.array().cast(TOLD))
    return with_some.union(without)


def report(scanned: DataFrame) -> DataFrame:
    """Per row: counts, the base spans' digest, the spans reported, each with its repositories:owners in ``held``,
    and how many look live or shared."""
    pairs = F.zip_with("spans", "told", lambda s, x: F.struct(
        s.alias("s"), x["shared"].alias("shared"), F.concat_ws(":", x["n_repos"], x["n_owners"]).alias("held")))
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    told = F.filter(pairs, lambda p: (p["s"]["kind"] < len(BASE)) | ~p["shared"])

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return scanned.select(
        "doc_id", *[count(i).alias(f"n_{k.name}") for i, k in enumerate(BASE)],
        F.sha2(printed(base).cast("binary"), 256).alias("base_sha256"),
        printed(F.transform(told, lambda p: p["s"])).alias("spans"),
        F.array_join(F.transform(told, lambda p: p["held"]), ",").alias("held"),
        F.size(F.filter(told, lambda p: ~p["shared"])).cast("long").alias("n_live"),
        F.size(F.filter(told, lambda p: p["shared"])).cast("long").alias("n_shared"))


def query(spark, sf_dir: str) -> DataFrame:
    """op5 over the whole ``documents`` table: a document is a repository, a source an owner."""
    return report(scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def oracle() -> str:
    parts = []
    for i, k in enumerate(KINDS):
        pattern = k.pattern.replace("'", "''")
        tests = [f"length(v) >= {k.least}", *[f"regexp_matches(v, '{n}')" for n in k.needs]]
        parts.append(f"""
  SELECT r, {i} AS kind, '{k.name}' AS name, v, ok_base, start, start + n AS stop FROM (
    SELECT r, {str(i < len(BASE)).lower()} AS ok_base, v, n,
           sum(gap) OVER (PARTITION BY r ORDER BY j) + coalesce(sum(n) OVER (PARTITION BY r ORDER BY j
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM (SELECT r, unnest(range(1, len(m) + 1)) AS j, length(g[j]) AS gap, length(m[j]) AS n, x[j] AS v
          FROM (SELECT r, string_split_regex(text, '{pattern}') AS g, regexp_extract_all(text, '{pattern}') AS m,
                       regexp_extract_all(text, '{pattern}', {k.value}) AS x FROM d)))
  WHERE {' AND '.join(tests)}""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
f AS ({' UNION ALL '.join(parts)}),
o AS (SELECT v, count(DISTINCT coalesce(source, chr(0))) AS owners, count(DISTINCT coalesce(doc_id::VARCHAR, '')) AS repos FROM f JOIN d USING (r) GROUP BY v),
t AS (SELECT f.*, owners >= {SHARED_BY} OR repos >= {COPIED_BY} AS shared, repos || ':' || owners AS held, name || ':' || start::BIGINT || ':' || stop::BIGINT AS span FROM f JOIN o USING (v)),
a AS (
  SELECT r, {', '.join(f"count(*) FILTER (kind = {i}) AS n_{k.name}" for i, k in enumerate(BASE))},
         coalesce(string_agg(span, ',' ORDER BY start, kind) FILTER (ok_base), '') AS base,
         coalesce(string_agg(span, ',' ORDER BY start, kind) FILTER (ok_base OR NOT shared), '') AS spans,
         coalesce(string_agg(held, ',' ORDER BY start, kind) FILTER (ok_base OR NOT shared), '') AS held,
         count(*) FILTER (NOT shared) AS n_live, count(*) FILTER (ok_base AND shared) AS n_shared
  FROM t GROUP BY r)
SELECT doc_id, {', '.join(f"coalesce(n_{k.name}, 0)::BIGINT AS n_{k.name}" for k in BASE)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(held, '') AS held,
       coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_shared, 0)::BIGINT AS n_shared
FROM d LEFT JOIN a USING (r)
"""


ORACLE = oracle()
