"""Benchmark decontamination with spaced seeds.

A seed looks at six word positions of a short window and ignores the others, so a replaced word at
an ignored position does not hide a copy. Windows of benchmark items and of documents that agree
under a mask meet in a join on the mask's hash; each such hit names an item and how far the item is
shifted against the text. The item is then laid over the text at that shift and compared word by
word: equal words count +1, replaced words -1, and the best stretch is the overlap. What an overlap must
reach follows the item's length (``needed``): ``LEAST`` for items of 17 words or more, 8 for those of 8 to
16, all words of a shorter one. Items too short for a mask, of one to five words, are met by the hash
of all their words at every place of the text; documents are read for lengths that occur only.

Words are runs of letters and digits in lower case, compared by 64-bit hash. The first two positions
belong to every mask: windows whose first two words never stand together in the benchmark are
dropped by one lookup, before any mask is applied.

Scale: documents become windows and are filtered inside one scan stage. Benchmark tables are
broadcast only while their counted rows stay under ``BROADCAST_ROWS``, and hold keys and places only, 40
bytes a row; beyond it the same joins shuffle. An item's words join its hits once, when these are distinct. A text is cut into overlapping pieces before it becomes windows, so memory does not follow
its length.

Defined results: a null text is empty; null or repeated ``doc_id`` and repeated rows each keep a row
of their own; benchmark rows with null or empty text match nothing; a null ``item_id`` counts as an item; an empty benchmark contaminates nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.functions.text import bound
from pricetide.llm.words import fresh, stored, text_key

# Positions a mask looks at.
MASKS = [
    (0, 1, 2, 3, 4, 5),
    (0, 1, 2, 4, 5, 6),
    (0, 1, 3, 4, 6, 7),
    (0, 1, 4, 5, 8, 9),
]
SHORT = len(MASKS[0])  # words of the shortest item that a mask can look at
SPAN = 1 + max(p for mask in MASKS for p in mask)
LEAST = 9
PIECE = 4096
BROADCAST_ROWS = 1_000_000
NOT_WORD = r"[^\p{L}\p{N}]+"


def hashed_words(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def needed(size: Column, least: int = LEAST) -> Column:
    """The overlap that tells a copy of an item of so many words."""
    half = F.floor((size + 1) / 2).cast("int")
    return F.least(F.lit(least), F.greatest(F.least(size, F.lit(least - 1)), half))


def windows(rows: DataFrame, *keys: str, least: int = 2) -> DataFrame:
    """keys, at (position of the window) and h0 .. h9 (hashes of its words, null past the end; ``least`` are there).

    ``rows`` has the keys and ``hashes``, the hashed words.
    """
    def piece(hashes: Column, n: Column) -> Column:
        return F.struct((n * PIECE).alias("base"), F.slice(hashes, n * PIECE + 1, PIECE + SPAN - 1).alias("h"))

    pieces = bound(F.col("hashes"), lambda h: F.transform(
        F.sequence(F.lit(0), F.floor((F.greatest(F.size(h), F.lit(1)) - 1) / PIECE).cast("int")), lambda n: piece(h, n)))
    cut = rows.select(*keys, F.explode(pieces).alias("p"))
    shifted = [F.slice("p.h", F.lit(k + 1), F.lit(PIECE)) for k in range(SPAN)]
    zipped = cut.select(*keys, F.col("p.base").alias("base"), F.posexplode(F.arrays_zip(*[
        s.alias(f"h{k}") for k, s in enumerate(shifted)])).alias("i", "w"))
    # arrays_zip names its fields by position for computed arrays
    fields = zipped.schema["w"].dataType.fieldNames()
    return zipped.select(*keys, (F.col("base") + F.col("i")).alias("at"),
                         *[F.col("w")[f].alias(f"h{k}") for k, f in enumerate(fields)]).where(f"h{least - 1} is not null")


def anchor() -> Column:
    return F.xxhash64("h0", "h1")


def seeded(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, at, mask and seed of every window under every mask it is long enough for."""
    seeds = [F.when(F.col(f"h{mask[-1]}").isNotNull(), F.struct(
        F.lit(i).alias("mask"), F.xxhash64(*[f"h{p}" for p in mask]).alias("seed"))) for i, mask in enumerate(MASKS)]
    return (rows.select(*keys, "at", F.explode(F.array(*seeds)).alias("s")).where("s is not null")
            .select(*keys, "at", "s.mask", "s.seed"))


def checked(table: DataFrame, rows: int, limit: int) -> DataFrame:
    return F.broadcast(table) if rows <= limit else table


def of_length(k: int) -> Column:
    """Length and hash of a window's first k words, if it has them."""
    return F.when(F.col(f"h{k - 1}").isNotNull(), F.struct(
        F.lit(-k).alias("mask"), F.xxhash64(*[f"h{p}" for p in range(k)]).alias("seed")))


def short_hits(items: DataFrame, texts: DataFrame, limit: int) -> DataFrame | None:
    """Hits of items that no mask fits, by all their words; None without such items."""
    short = items.where(F.size("hashes").between(1, SHORT - 1))
    lengths = sorted(r["k"] for r in short.select(F.size("hashes").alias("k")).distinct().collect())
    if not lengths:
        return None
    whole = windows(short, "ia", "ib", "hashes", least=1).where("at = 0")
    own = F.coalesce(*[F.when(F.size("hashes") == k, of_length(k)) for k in lengths])
    seeds = whole.select("ia", "ib", F.lit(0).alias("item_at"), own.alias("s")).select("ia", "ib", "item_at", "s.mask", "s.seed")
    places = windows(texts, "a", "b", least=1).select("a", "b", "at", F.explode(F.array(*[of_length(k) for k in lengths])).alias("s"))
    return places.where("s is not null").select("a", "b", "at", "s.mask", "s.seed").join(
        checked(seeds, short.count(), limit), ["mask", "seed"])


def candidates(docs: DataFrame, benchmark: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Per text (a, b): ``found``, the items its seeds hit with their hashed words and shifts."""
    words = benchmark.select(F.col("item_id"), hashed_words(F.col("text")).alias("hashes")).distinct()
    items = words.select("*", F.xxhash64("item_id", "hashes").alias("ia"), F.xxhash64(F.lit(7), "item_id", "hashes").alias("ib"))
    of_items = windows(items, "ia", "ib")
    seeds = seeded(of_items, "ia", "ib").select("ia", "ib", F.col("at").alias("item_at"), "mask", "seed")
    n_seeds = seeds.count()
    anchors = of_items.select(anchor().alias("anchor")).distinct()
    texts = docs.select(text_key(F.col("text")).alias("k"), hashed_words(F.col("text")).alias("hashes")).select("k.a", "k.b", "hashes")
    near = windows(texts, "a", "b").withColumn("anchor", anchor()).join(
        checked(anchors, n_seeds, limit), "anchor", "left_semi")
    hits = seeded(near, "a", "b").join(checked(seeds, n_seeds, limit), ["mask", "seed"])
    short = short_hits(items, texts, limit)
    columns = ["a", "b", "ia", "ib", (F.col("at") - F.col("item_at")).alias("shift")]
    shifts = hits.select(*columns) if short is None else hits.select(*columns).union(short.select(*columns))
    # at most as many shifts as text and item have words
    of_item = shifts.groupBy("a", "b", "ia", "ib").agg(F.collect_set("shift").alias("shifts"))
    placed = of_item.join(checked(items, n_seeds, limit), ["ia", "ib"])
    return placed.groupBy("a", "b").agg(F.collect_list(F.struct("item_id", "shifts", "hashes")).alias("found"))


def overlap(hashes: Column, item: Column, shift: Column) -> Column:
    """The best stretch of the item laid over the text: equal words less replaced ones."""
    ours = F.slice(hashes, F.greatest(shift, F.lit(0)) + 1, F.size(item))
    theirs = F.slice(item, F.greatest(-shift, F.lit(0)) + 1, F.size(item))
    # a missing word, past either end, is a replaced one
    same = F.zip_with(ours, theirs, lambda x, y: F.when(x == y, 1).otherwise(-1))
    start = F.struct(F.lit(0).alias("here"), F.lit(0).alias("best"))

    def step(s: Column, x: Column) -> Column:
        here = F.greatest(s["here"], F.lit(0)) + x
        return F.struct(here.alias("here"), F.greatest(s["best"], here).alias("best"))

    return F.aggregate(same, start, step, lambda s: s["best"])


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The input's rows with ``overlaps``: item_id, at (shift) and overlap of every item found in the text.

    The benchmark must have item_id and text; an input column named ``overlaps`` is replaced.
    """
    a, b, found = fresh("a", "b", "found")
    key = text_key(docs["text"])
    # stored, so that the join may split the rows of a text that very many documents share
    hits = stored(candidates(docs, benchmark, limit)).select(
        F.col("a").alias(a), F.col("b").alias(b), F.col("found").alias(found))
    joined = docs.join(hits, (key["a"] == F.col(a)) & (key["b"] == F.col(b)), "left")

    def laid(h: Column, c: Column) -> Column:
        """An item at all its shifts, as far as the overlap is enough."""
        each = F.transform(c["shifts"], lambda shift: F.struct(
            c["item_id"].alias("item_id"), shift.alias("at"), overlap(h, c["hashes"], shift).alias("overlap")))
        return F.filter(each, lambda o: o["overlap"] >= needed(F.size(c["hashes"]), least))

    verified = bound(hashed_words(F.col("text")), lambda h: F.flatten(F.transform(F.col(found), lambda c: laid(h, c))))
    empty = F.filter(F.transform(F.array(F.lit(0)), lambda x: F.struct(
        F.lit(None).cast(benchmark.schema["item_id"].dataType).alias("item_id"), x.alias("at"), x.alias("overlap"))),
        lambda c: F.lit(False))
    return joined.withColumn("overlaps", F.when(F.col(found).isNull(), empty).otherwise(verified)).drop(a, b, found)


def clean(docs: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """The documents without contaminated ones."""
    names = docs.columns
    return overlaps(docs, benchmark, least).where(F.size("overlaps") == 0).select(*names)


def query(spark, sf_dir: str) -> DataFrame:
    """op1 over the whole ``documents`` and ``benchmark`` tables."""
    found = overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"),
                     spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.array_sort(F.array_distinct(F.transform("overlaps", lambda o: o["item_id"])))
    return found.select(
        "doc_id", (F.size("overlaps") > 0).alias("contaminated"), F.size(items).cast("long").alias("n_items"),
        F.array_join(F.transform(items, lambda i: i.cast("string")), ",").alias("items"),
        F.coalesce(F.array_max(F.transform("overlaps", lambda o: o["overlap"])), F.lit(0)).cast("long").alias("best_overlap"))


def oracle(masks=MASKS, least=LEAST) -> str:
    def seed(alias: str) -> str:
        parts = []
        for i, mask in enumerate(masks):
            words = " || ' ' || ".join(f"w[p + {m}]" for m in mask)
            parts.append(f"SELECT r, p, {i} AS mask, {words} AS seed FROM {alias}_at WHERE p + {mask[-1]} <= len(w)")
        for k in range(1, SHORT):
            words = " || ' ' || ".join(f"w[p + {m}]" for m in range(k))
            whole = f"p = 1 AND len(w) = {k}" if alias == "i" else f"p + {k - 1} <= len(w) AND EXISTS (SELECT 1 FROM i WHERE len(i.w) = {k})"
            parts.append(f"SELECT r, p, {-k} AS mask, {words} AS seed FROM {alias}_at WHERE {whole}")
        return " UNION ALL ".join(parts)

    split = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {split} AS w FROM documents),
i AS (SELECT row_number() OVER () AS r, * FROM (SELECT DISTINCT item_id, {split} AS w FROM benchmark)),
d_at AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d),
i_at AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM i),
ds AS ({seed('d')}), "is" AS ({seed('i')}),
hits AS (SELECT DISTINCT ds.r AS dr, "is".r AS ir, ds.p - "is".p AS shift FROM ds JOIN "is" USING (mask, seed)),
words AS (
  SELECT dr, ir, shift, q, CASE WHEN d.w[q + shift] = i.w[q] THEN 1 ELSE -1 END AS x
  FROM (SELECT *, unnest(range(greatest(1, 1 - shift), len(i.w) + 1)) AS q
        FROM hits JOIN i ON i.r = ir) h JOIN d ON d.r = dr JOIN i ON i.r = h.ir),
sums AS (SELECT *, sum(x) OVER (PARTITION BY dr, ir, shift ORDER BY q) AS s FROM words),
best AS (
  SELECT dr, ir, shift, max(s - low) AS overlap FROM (
    SELECT *, least(0, coalesce(min(s) OVER (PARTITION BY dr, ir, shift ORDER BY q
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM sums) GROUP BY ALL),
found AS (
  SELECT dr, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS t,
         list_sort(list(DISTINCT item_id)) AS ids, max(overlap) AS best
  FROM best JOIN i ON i.r = ir
  WHERE overlap >= least({least}, greatest(least(len(i.w), {least - 1}), (len(i.w) + 1) // 2)) GROUP BY dr)
SELECT doc_id, n IS NOT NULL AS contaminated, coalesce(n, 0)::BIGINT AS n_items,
       coalesce(array_to_string(ids, ','), '') AS items, coalesce(best, 0)::BIGINT AS best_overlap
FROM d LEFT JOIN found ON found.dr = d.r
"""


ORACLE = oracle()
