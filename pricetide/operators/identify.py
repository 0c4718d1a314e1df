"""Garment tag text to brand, model numbers, sizes and keywords, and on to search queries."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide import dims
from pricetide.functions import text as tx
from pricetide.operators.substrings import containing
from pricetide.sources import dictionary

STRINGS = "array<string>"
TASKS_PER_CORE = 4
HINT_COLUMNS = ["brand", "model_numbers", "sizes", "materials", "made_in"]


def _no_words() -> Column:
    return F.array().cast(STRINGS)


def _alias_literal() -> Column:
    rows = [
        {"canonical": name, "matched": alias, "folded": tx.fold_literal(alias)}
        for name, alias in dictionary.ordered_aliases()
    ]
    schema = "array<struct<canonical:string,matched:string,folded:string>>"
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), schema)


def brand_in(folded: Column) -> Column:
    """Longest dictionary spelling contained in a folded text: ``STRUCT<canonical, matched, folded>``.

    The dictionary is a constant array, longest spelling first, so the substring join needs no
    nested-loop join.
    """
    return tx.bound(folded, lambda f: F.get(
        F.filter(_alias_literal(), lambda a: F.contains(f, a["folded"])), F.lit(0)))


def spellings_in(texts: DataFrame, spellings: DataFrame, folded: str = "folded") -> DataFrame:
    """``folded, hit``: for each different folded text that holds a spelling, the longest one, as ``brand_in`` gives it.

    ``spellings(canonical, alias)`` is a dictionary of any size; ``folded`` and ``alias_ord`` are taken
    from it where present. Of equally long spellings the first counts, by ``alias_ord`` or else by
    canonical name and alias. A spelling that folds to nothing is passed over.
    """
    keyed = spellings if "folded" in spellings.columns else spellings.withColumn("folded", tx.nfkc(F.col("alias"))).withColumn(
        "folded", tx.fold_normal(F.col("folded")))
    first = F.col("alias_ord") if "alias_ord" in keyed.columns else F.lit(0)
    filed = keyed.select(
        F.col("folded").alias("spelling"),
        F.struct((-F.length("folded")).alias("size"), first.alias("ord"), "canonical", F.col("alias").alias("matched")).alias("rank"),
    )
    found = containing(texts.select(F.col(folded).alias("folded")), filed, "folded", "spelling")
    best = found.groupBy("folded").agg(F.min(F.struct("rank", "spelling")).alias("b"))
    return best.select("folded", F.struct(
        "b.rank.canonical", "b.rank.matched", F.col("b.spelling").alias("folded")).alias("hit"))


def usual_name(name: Column, folded: Column, known: Column) -> Column:
    return F.when(folded != "", F.coalesce(known, F.nullif(tx.strip_raw(name), F.lit(""))))


def canonical_brand(name: Column) -> Column:
    """Usual name of a brand; an unknown one stays as it is; null where there is none."""
    folded = tx.fold(name)
    known = brand_in(folded)["canonical"]
    return usual_name(name, folded, known)


def as_size(token: Column) -> Column:
    """A size without blanks, or null. Bare numbers must be a plausible body height or waist."""
    def judge(value: Column) -> Column:
        # words never meet the cast: in a lambda a cast that fails throws and catches an exception each time
        number = value.try_cast("int")
        plausible = F.lit(False)
        for low, high in dims.NUMERIC_SIZE_RANGES:
            plausible = plausible | number.between(low, high)
        plausible = F.when(F.rlike(value, F.lit(r"^\d{2,3}$")), plausible).otherwise(F.lit(True))
        return F.when(F.rlike(value, F.lit(dims.SIZE_TOKEN)) & plausible, F.regexp_replace(value, r"\s+", ""))

    return tx.bound(tx.squeeze(token), judge)


def models_in(line: Column, sizes: Column) -> Column:
    """Model numbers of one folded line, pattern by pattern; a line of digits only counts as well."""
    found = F.concat(*[
        F.regexp_extract_all(line, F.lit(tx.ascii_words(p)), F.lit(0)) for p in dims.MODEL_PATTERNS
    ])
    tidy = F.filter(
        F.transform(found, lambda m: F.regexp_replace(m, r"\s+", "")),
        lambda m: (m != "") & ~F.regexp_extract(m, r"^[^-0-9]*", 0).isin(dims.MODEL_DENY),
    )
    bare = F.rlike(line, F.lit(dims.BARE_MODEL)) & ~F.array_contains(sizes, line)
    return F.concat(tidy, F.when(bare, F.array(line)).otherwise(_no_words()))


def dealt(tags: DataFrame) -> DataFrame:
    """The same tags over all cores: a file of some MB is one task to Spark, and holds minutes of matching."""
    return tags.repartition(TASKS_PER_CORE * tags.sparkSession.sparkContext.defaultParallelism)


def _words(text: Column) -> Column:
    return tx.non_empty(F.split(text, " "))


def identify(tags: DataFrame, hints: DataFrame | None = None, text: str = "text",
             spellings: DataFrame | None = None) -> DataFrame:
    """Adds ``brand STRUCT<canonical, matched>, model_numbers, sizes, made_in, materials, keywords, raw``.

    ``hints(tag_id, brand, model_numbers, sizes, materials, made_in)``: where a field of the hint is
    not empty it replaces what the text says. ``spellings`` is a dictionary as ``spellings_in`` takes it, in
    place of the fixed one, for very many brands.
    """
    keys = [c for c in tags.columns if c != text]
    read = dealt(tags).select(*keys, tx.strip_raw(F.coalesce(text, F.lit(""))).alias("raw")).select(
        *keys, "raw", tx.nfkc(F.col("raw")).alias("normal")
    ).select(
        *keys, "raw", "normal",
        tx.fold_normal(F.col("normal")).alias("folded"),
        tx.non_empty(F.transform(F.split("normal", "\r?\n"), tx.fold_normal)).alias("tag_lines"),
    )
    labelled = F.transform(
        F.regexp_extract_all("normal", F.lit(dims.SIZE_LABEL), F.lit(1)), lambda s: as_size(tx.fold(s))
    )
    if spellings is None:
        read = read.withColumn("hit", brand_in(F.col("folded")))
    else:
        read = read.join(spellings_in(read, spellings), "folded", "left")
    sized = read.select(
        "*",
        F.array_distinct(F.array_compact(F.concat(labelled, F.transform("tag_lines", as_size)))).alias("t_sizes"),
        F.coalesce(
            F.nullif(F.regexp_extract("normal", dims.MADE_IN, 1), F.lit("")),
            F.nullif(F.regexp_extract("normal", dims.MADE_IN, 2), F.lit("")),
        ).alias("t_made_in"),
        F.array_distinct(F.regexp_extract_all("raw", F.lit(dims.MATERIAL), F.lit(1))).alias("t_materials"),
    )
    modelled = sized.withColumn(
        "t_models",
        F.array_distinct(F.flatten(F.transform("tag_lines", lambda line: models_in(line, F.col("t_sizes"))))),
    )
    consumed = F.concat(
        F.coalesce(F.split("hit.folded", " "), _no_words()), F.col("t_models"), F.col("t_sizes"),
        F.transform("t_materials", F.upper),
    )
    # array_except keeps the order, drops repeats and looks words up by hash
    worded = modelled.withColumn(
        "t_keywords",
        F.slice(F.filter(F.array_except(_words(F.col("folded")), consumed), lambda w: (
            (tx.utf16_length(w) >= 2)
            & ~w.isin(dims.STOP_WORDS)
            & ~F.rlike(w, F.lit(r"[\d%]"))
        )), 1, dims.MAX_KEYWORDS),
    )
    if hints is None:
        merged = worded.select(
            *keys, "raw",
            F.when(F.col("hit").isNotNull(), F.struct("hit.canonical", "hit.matched")).alias("brand"),
            F.col("t_models").alias("model_numbers"), F.col("t_sizes").alias("sizes"),
            F.col("t_made_in").alias("made_in"), F.col("t_materials").alias("materials"), "t_keywords",
        )
    else:
        given = hints.select("tag_id", *[F.col(c).alias(f"h_{c}") for c in HINT_COLUMNS])
        if spellings is None:
            given = given.withColumn("h_canonical", canonical_brand(F.col("h_brand")))
        else:
            given = given.withColumn("h_folded", tx.nfkc(F.col("h_brand"))).withColumn("h_folded", tx.fold_normal(F.col("h_folded")))
            known = spellings_in(given, spellings, "h_folded").select(
                F.col("folded").alias("h_folded"), F.col("hit.canonical").alias("h_known"))
            given = given.join(known, "h_folded", "left").withColumn(
                "h_canonical", usual_name(F.col("h_brand"), F.col("h_folded"), F.col("h_known")))

        def listed(hint: str, own: str) -> Column:
            return F.when(F.size(hint) > 0, F.array_distinct(hint)).otherwise(F.col(own))

        merged = worded.join(given, "tag_id", "left").select(
            *keys, "raw",
            F.when(
                F.nullif("h_brand", F.lit("")).isNotNull(),
                F.struct(F.col("h_canonical").alias("canonical"), F.col("h_brand").alias("matched")),
            ).when(F.col("hit").isNotNull(), F.struct("hit.canonical", "hit.matched")).alias("brand"),
            listed("h_model_numbers", "t_models").alias("model_numbers"),
            listed("h_sizes", "t_sizes").alias("sizes"),
            F.coalesce(F.nullif("h_made_in", F.lit("")), F.col("t_made_in")).alias("made_in"),
            listed("h_materials", "t_materials").alias("materials"),
            "t_keywords",
        )
    known = F.concat(
        F.split(tx.fold(F.coalesce("brand.canonical", F.lit(""))), " "),
        F.transform("model_numbers", tx.fold),
        F.transform("sizes", tx.fold),
    )
    return merged.withColumn("known", known).select(
        *keys, "brand", "model_numbers", "sizes", "made_in", "materials",
        F.array_except("t_keywords", "known").alias("keywords"), "raw",
    )


def search_queries(identified: DataFrame, barcode: str | None = None, note: str | None = None) -> DataFrame:
    """``tag_id, rank, query, label``: the narrowest query first, each query once.

    ``barcode`` and ``note`` name columns with a scanned code and with words typed by hand.
    """
    def first(words: str) -> Column:
        return F.coalesce(F.get(F.col(words), F.lit(0)), F.lit(""))

    typed = _words(tx.fold(F.col(note))) if note else _no_words()
    base = identified.select(
        "tag_id",
        (F.coalesce(F.col(barcode).cast("string"), F.lit("")) if barcode else F.lit("")).alias("barcode"),
        F.coalesce("brand.canonical", F.lit("")).alias("brand"),
        first("model_numbers").alias("model"),
        first("sizes").alias("size"),
        F.concat(typed, F.col("keywords")).alias("topics"),
    ).withColumn("topic", F.array_join(F.slice("topics", 1, dims.TOPIC_WORDS), " "))

    def candidate(label: str, *parts: str, only_if: Column | None = None) -> Column:
        present = [F.col(p) != "" for p in parts] + ([only_if] if only_if is not None else [])
        needed = present[0]
        for condition in present[1:]:
            needed = needed & condition
        query = F.trim(F.concat_ws(" ", *parts))
        return F.when(needed, F.struct(query.alias("query"), F.lit(dims.QUERY_LABELS[label]).alias("label")))

    candidates = F.array(
        candidate("barcode", "barcode"),
        candidate("brand_model", "brand", "model"),
        candidate("model", "model"),
        candidate("brand_topic_size", "brand", "topic", "size"),
        candidate("brand_topic", "brand", "topic"),
        candidate("topic_size", "topic", "size", only_if=F.col("brand") == ""),
        candidate("brand_size", "brand", "size"),
        candidate("brand", "brand"),
        candidate("topic", "topic"),
    )
    wanted = F.filter(F.array_compact(candidates), lambda c: c["query"] != "")
    unique = tx.bound(wanted, lambda all_: F.filter(
        all_, lambda c, i: F.array_position(all_["query"], c["query"]) == i + 1))
    listed = base.select("tag_id", F.posexplode_outer(unique).alias("place", "q")).filter("q is not null")
    return listed.select(
        "tag_id", (F.col("place") + 1).alias("rank"), "q.query", "q.label"
    )


def percent_encode(text: Column) -> Column:
    """Percent-encoding that keeps ``! ' ( ) ~`` and writes a space as %20."""
    encoded = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, letter in {"%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}.items():
        encoded = F.replace(encoded, F.lit(code), F.lit(letter))
    return encoded


def search_urls(queries: DataFrame) -> DataFrame:
    """Each query once per marketplace, with the address of its search page."""
    keys = F.explode(F.array(*[F.lit(key) for key, *_ in dims.SOURCES]))
    return queries.withColumn("source", keys).withColumn(
        "url", search_page_url(F.col("source"), F.col("query")))


def search_page_url(source: Column, query: Column) -> Column:
    """Address of one source's search page; '' for an unknown source."""
    url = F.lit("")
    for key, _, template in dims.SOURCES:
        url = F.when(source == key, F.replace(F.lit(template), F.lit("{}"), percent_encode(query))).otherwise(url)
    return url


def as_targets(identified: DataFrame, key: str = "tag_id") -> DataFrame:
    """Identified garments as the targets of quotes."""
    return identified.select(
        F.col(key).alias("quote_id"), F.col("brand.canonical").alias("brand"), "model_numbers"
    )
