"""Mixing sources to target token counts by entropy balancing.

Every document d of source s gets the rate r_d = min(cap, q_d * exp(lambda_s)), q_d being its prior
rate (1 unless given): of all rates whose tokens meet the targets these are the closest to the prior
in relative entropy. The multipliers solve the convex dual by Newton steps, kept inside a bracket; a
step is one distributed sum of tokens and of the dual's curvature. Rates depend on source and prior
alone, so rows are summed over both once before the first step.

Rates become whole copies: floor(r_d) for all, and one more for the documents of the source that
come first in a pseudo-random order (a hash of id and text over the fraction of the rate) for as
long as that brings the tokens nearer to the target. Where the extra copies end is found in two
steps, sums over slices of the order, then rows of the one slice where they end, so no source is
ever sorted whole. After that, the copies of a document follow from its own row and one small row of
its source.

Defined results: a null text has size 0; a null source is a source, the last one; rows equal in id
and text get the same number of copies; a source without tokens has target 0 and rate 0; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.llm.words import fresh, narrow, stored, words_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
SLICES = 4096
TOLERANCE = 1e-12
MOST_STEPS = 100
BROADCAST_SOURCES = 100_000  # more sources than this meet the documents in a shuffled join
LOWEST = -60.0  # a multiplier for targets of 0


def size_of(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def order_hash(doc_id: Column, text: Column) -> Column:
    """52 hash bits of id and text as a number in [0, 1)."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))
    digits = F.substring(F.md5(whole.cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size and target of each source, from one row (source, source_size) each.

    Sources in code point order, null last, weigh ``weights`` in turn and divide ``share`` of all
    tokens; none gets more than ``cap`` times what it has, and what is cut goes to the others by
    weight. Seen from the sources that fill up first, target = min(cap * size, weight * level); the
    level is that of the first source it does not fill. This table has a row per source and is
    ordered in one task.
    """
    ranked = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.array(*[F.lit(float(w)) for w in weights])[F.col("place") % len(weights)]
    weighed = ranked.withColumn("weight", weight).withColumn("most", F.lit(cap) * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("weight"), "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    filling = weighed.withColumns({
        "level": (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        / F.sum("weight").over(after)})
    open_level = F.min(F.when(F.col("most") / F.col("weight") >= F.col("level"), F.struct(
        (F.col("most") / F.col("weight")).alias("by"), "place", "level"))).over(whole)["level"]
    return filling.withColumn("open", open_level).select(
        "source", "source_size", F.least("most", F.col("weight") * F.col("open")).alias("target"))


def rate(prior: Column, multiplier: Column, cap: float) -> Column:
    return F.least(F.lit(cap), prior * F.exp(multiplier))


def multipliers(rows: DataFrame, wanted: DataFrame, cap: float = CAP) -> DataFrame:
    """source, source_size, target, multiplier: the dual's solution.

    ``rows`` has source, prior and size. Newton's step is taken where it stays inside the bracket
    that the signs of earlier residuals give, else the bracket is halved.
    """
    mass = stored(rows.groupBy("source", "prior").agg(F.sum("size").alias("tokens")))
    bounds = mass.groupBy("source").agg(F.min("prior").alias("least_prior")).withColumnRenamed("source", "s")
    top = F.log(F.lit(cap) / F.col("least_prior"))
    full = F.col("target") >= F.lit(cap * (1 - TOLERANCE)) * F.col("source_size")
    state = stored(wanted.join(bounds, wanted["source"].eqNullSafe(F.col("s"))).select(
        "source", "source_size", "target", F.lit(LOWEST).alias("low"), top.alias("high"),
        F.when(F.col("target") == 0, F.lit(LOWEST)).when(full, top).otherwise(F.lit(0.0)).alias("multiplier"),
        ((F.col("target") == 0) | full).alias("done")))
    for _ in range(MOST_STEPS):
        sums = mass.withColumnRenamed("source", "s").join(
            state.where("not done").select("source", "multiplier"), F.col("s").eqNullSafe(F.col("source"))).select(
            "s", "tokens", rate(F.col("prior"), F.col("multiplier"), cap).alias("r")).groupBy("s").agg(
            F.sum(F.col("tokens") * F.col("r")).alias("reached"),
            F.sum(F.when(F.col("r") < cap, F.col("tokens") * F.col("r")).otherwise(0.0)).alias("slope"))
        joined = state.join(sums, state["source"].eqNullSafe(F.col("s")), "left")
        left = F.col("target") - F.col("reached")
        done = F.col("done") | (F.abs(left) <= TOLERANCE * F.col("target"))
        low = F.when(left > 0, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(left > 0, F.col("high")).otherwise(F.col("multiplier"))
        step = F.when(F.col("slope") > 0, F.col("multiplier") + left / F.col("slope"))
        inside = F.when((step > low) & (step < high), step).otherwise((low + high) / 2)
        state = stored(joined.select(
            "source", "source_size", "target", F.when(done, F.col("low")).otherwise(low).alias("low"),
            F.when(done, F.col("high")).otherwise(high).alias("high"),
            F.when(done, F.col("multiplier")).otherwise(inside).alias("multiplier"), done.alias("done")))
        if state.where("not done").isEmpty():
            break
    return state.select("source", "source_size", "target", "multiplier")


def order_key(u: Column, r: Column) -> Column:
    """Where a document stands in the order of extra copies: its hash over its fraction, null at 0."""
    part = r - F.floor(r)
    return F.when(part > 0, u / part)


def slice_of(key: Column) -> Column:
    """The order cut into slices; large keys crowd into the last ones."""
    return F.floor(key / (1 + key) * SLICES).cast("int")


def plan(rows: DataFrame, wanted: DataFrame, cap: float = CAP) -> DataFrame:
    """One row per source: multiplier, and the slice and key up to which documents get an extra copy."""
    solved = stored(multipliers(rows, wanted, cap))
    sources = solved.withColumnRenamed("source", "s")
    keyed = rows.join(sources, rows["source"].eqNullSafe(F.col("s"))).withColumn(
        "r", rate(F.col("prior"), F.col("multiplier"), cap)).withColumn("key", order_key(F.col("u"), F.col("r")))
    sliced = keyed.withColumn("slice", slice_of(F.col("key")))
    base = sliced.groupBy("s").agg((F.first("target") - F.sum(F.floor("r") * F.col("size"))).alias("extra"))
    sums = sliced.where("key is not null").groupBy("s", "slice").agg(F.sum("size").alias("tokens"))
    run = Window.partitionBy("s").orderBy("slice")
    ends = (sums.withColumn("upto", F.sum("tokens").over(run)).withColumnRenamed("s", "t")
            .join(base, F.col("t").eqNullSafe(F.col("s"))).where(F.col("upto") > F.col("extra")).groupBy("t")
            .agg(F.min(F.struct("slice", (F.col("upto") - F.col("tokens")).alias("before"), "extra")).alias("end"))
            .select("t", F.col("end.slice").alias("end_slice"), F.col("end.before").alias("before"), F.col("end.extra").alias("extra")))
    ends = stored(ends)
    last = sliced.join(ends, F.col("s").eqNullSafe(F.col("t")) & (F.col("slice") == F.col("end_slice")))
    here = Window.partitionBy("s").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    fits = F.col("before") + F.coalesce(F.sum("size").over(here), F.lit(0)) + F.col("size") / 2 <= F.col("extra")
    cut = last.withColumn("fits", fits).where("fits").groupBy("s").agg(F.max("key").alias("end_key")).withColumnRenamed("s", "c")
    return stored(sources.join(ends.select("t", "end_slice"), F.col("s").eqNullSafe(F.col("t")), "left")
                  .join(cut, F.col("s").eqNullSafe(F.col("c")), "left")
                  .select("s", "source_size", "target", "multiplier", "end_slice", "end_key"))


def attached(docs: DataFrame, weights, share: float, cap: float, prior: str | None) -> tuple[DataFrame, dict[str, str]]:
    """The input's rows with what the mix says of them, and the names under which it does."""
    given = F.coalesce(docs[prior].cast("double"), F.lit(1.0)) if prior else F.lit(1.0)
    rows = stored(docs.select(
        docs["doc_id"].alias("doc_id"), docs["source"].cast("string").alias("source"),
        size_of(docs["text"]).alias("size"), order_hash(docs["doc_id"], docs["text"]).alias("u"), given.alias("prior")))
    wanted = stored(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap))
    names = ["s", "source_size", "target", "multiplier", "end_slice", "end_key", "size", "u", "rate", "key", "copies"]
    of = dict(zip(names, fresh(*names)))
    per_source = plan(rows, wanted, cap).select(*[F.col(n).alias(of[n]) for n in names[:6]])
    if per_source.count() <= BROADCAST_SOURCES:
        per_source = F.broadcast(per_source)
    col = {n: F.col(m) for n, m in of.items()}
    joined = docs.select(
        *[docs[c] for c in docs.columns], size_of(docs["text"]).alias(of["size"]),
        order_hash(docs["doc_id"], docs["text"]).alias(of["u"]), given.alias(of["rate"])).join(
        per_source, docs["source"].cast("string").eqNullSafe(col["s"]), "left")
    rated = joined.withColumn(of["rate"], rate(col["rate"], col["multiplier"], cap)).withColumn(
        of["key"], order_key(col["u"], col["rate"]))
    at = slice_of(col["key"])
    extra = col["end_slice"].isNull() | (at < col["end_slice"]) | ((at == col["end_slice"]) & (col["key"] <= col["end_key"]))
    more = F.when(F.coalesce(col["key"].isNotNull() & extra, F.lit(False)), 1).otherwise(0)
    return rated.withColumn(of["copies"], (F.floor(col["rate"]) + more).cast("int")), of


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, prior: str | None = None) -> DataFrame:
    """The input's rows with size, source_size, target, rate and copies (columns of these names are replaced)."""
    rows, of = attached(docs, weights, share, cap, prior)
    out = ["size", "source_size", "target", "rate", "copies"]
    return rows.select(*[c for c in docs.columns if c not in out], *[F.col(of[n]).alias(n) for n in out])


def repeated(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, prior: str | None = None) -> DataFrame:
    """The mix itself: every row of ``docs`` as many times as it has copies, with the input's columns."""
    rows, of = attached(docs, weights, share, cap, prior)
    n = F.col(of["copies"])
    return rows.where(n > 0).select(*docs.columns, F.explode(F.sequence(F.lit(1), n)).alias(of["key"])).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op4 over the whole ``documents`` table."""
    rows = mixed(narrow(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "source"))
    return rows.select("doc_id", "size", "source_size", "target",
                       (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", "copies")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ' ' || coalesce(text, '')), 1, 13))::BIGINT::DOUBLE
         / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS most,
         [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
l AS (
  SELECT *, most / weight AS fill,
         (1.5::DOUBLE * sum(source_size) OVER ()
          - coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s),
t AS (
  SELECT source, source_size, least(most, weight * (SELECT level FROM l WHERE fill >= level ORDER BY fill, place LIMIT 1)) AS target
  FROM l),
r AS (
  SELECT d.*, t.source_size, target, CASE WHEN t.source_size > 0 THEN target / t.source_size ELSE 0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
f AS (
  SELECT *, CASE WHEN rate >= 2 THEN 2 ELSE floor(rate) END AS whole,
         coalesce(sum(size) OVER (PARTITION BY source ORDER BY u, doc_id, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM r)
SELECT doc_id, size::BIGINT AS size, source_size, target, (copies * size)::BIGINT AS taken, source, copies
FROM (SELECT *, (whole + CASE WHEN rate > whole AND before + size / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END)::INT
             AS copies FROM f)
"""
