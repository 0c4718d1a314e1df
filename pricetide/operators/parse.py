"""Pasted result pages to listings.

A paste is one row, and its lines are an array, so parsing needs no shuffle. Each step that several
others read is put into an array of structs first, so that it is computed once per line.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from pricetide import dims
from pricetide.functions import text as tx
from pricetide.functions.pairing import pick_titles

REPORT_COLUMNS = ["mode", "lines", "prices_found", "untitled", "ignored_samples", "error"]


def clean(text: Column) -> Column:
    return F.replace(tx.nfkc(text), F.lit("￥"), F.lit("¥"))


def split_lines(cleaned: Column) -> Column:
    return tx.non_empty(F.transform(F.split(cleaned, "\r?\n"), tx.strip))


def marked(line: Column) -> Column:
    return F.contains(line, F.lit("¥")) | F.contains(line, F.lit("円"))


HUGE = (1 << 63) - 1


def _whole(digits: Column) -> Column:
    """Digits, perhaps signed, as a number; null for ''. What 64 bits cannot hold becomes the nearest they can.

    '' never meets the cast: in a lambda a cast that fails throws and catches an exception each time.
    """
    def read(text: Column) -> Column:
        beyond = F.when(F.startswith(text, F.lit("-")), F.lit(-HUGE)).otherwise(F.lit(HUGE))
        return F.when(text != "", F.coalesce(text.try_cast("bigint"), beyond))

    return tx.bound(digits, read)


def _amount(text: Column) -> Column:
    """The one number in a text that holds no other digits; null for ''."""
    return _whole(F.regexp_replace(text, "[^0-9]", ""))


def extract_price(line: Column) -> Column:
    """Winning bid, else the first plausible amount, else the first amount, else null."""
    amounts = F.transform(F.regexp_extract_all(line, F.lit(dims.CURRENCY_AMOUNT), F.lit(0)), _amount)
    won = F.when(F.contains(line, F.lit(dims.WON)), _amount(F.regexp_extract(line, dims.WINNING_BID, 0)))
    # every amount has its mark, so text without one meets no pattern
    return F.when(marked(line), F.coalesce(
        won,
        tx.bound(amounts, lambda a: F.coalesce(
            F.get(F.filter(a, lambda x: x >= dims.MIN_PLAUSIBLE_PRICE), F.lit(0)),
            F.get(F.filter(a, lambda x: x.isNotNull()), F.lit(0)),
        )),
    ))


def _opens(line: Column, words: list[str]) -> Column:
    """Byte-level prefix tests, joined with OR."""
    return reduce(or_, [F.startswith(line, F.lit(word)) for word in words])


def looks_like_title(line: Column) -> Column:
    # one letter beyond the basic plane counts as two
    long_enough = (F.length(line) >= 2) | (F.octet_length(line) == 4)
    # a Latin letter is a title letter, and opens two words of noise only
    latin = ((line >= "A") & (line < "[")) | ((line >= "a") & (line < "{"))
    return long_enough & ((latin & ~_opens(line, dims.LATIN_NOISE)) | (
        ~F.rlike(line, F.lit(dims.NOISE)) & F.rlike(line, F.lit(dims.TITLE_LETTER))))


def strip_prices(line: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.regexp_replace(line, dims.CURRENCY_AMOUNT, " "), r"\s{2,}", " "))
    return F.regexp_replace(F.regexp_replace(bare, dims.TRAILING_DATE, ""), dims.TITLE_EDGES, "")


def is_table(lines: Column) -> Column:
    """At least two lines, and half of them, hold a tab or a comma that does not group thousands."""
    delimited = F.size(F.filter(lines, lambda x: F.contains(x, F.lit("\t")) | (F.contains(x, F.lit(",")) & F.contains(
        F.regexp_replace(x, dims.THOUSANDS_COMMA, "$1"), F.lit(",")))))
    return delimited >= F.greatest(F.lit(2), F.ceil(F.size(lines) / 2))


def _leading_int(field: Column) -> Column:
    return _whole(F.regexp_extract(F.replace(field, F.lit(","), F.lit("")), r"^\s*([+-]?[0-9]+)", 1))


def _table_fields(line: Column) -> Column:
    parts = F.when(F.contains(line, F.lit("\t")), F.split(line, "\t")).otherwise(F.split(line, ","))
    return tx.non_empty(F.transform(parts, lambda f: F.regexp_replace(tx.strip(f), '^"|"$', "")))


def table_entries(lines: Column) -> Column:
    """``ARRAY<STRUCT<title, price>>``: rightmost number is the price, leftmost title-like field the title."""
    def read(fields: Column) -> Column:
        values = F.transform(F.reverse(fields), lambda f: F.coalesce(extract_price(f), _leading_int(f)))
        price = F.get(F.filter(values, lambda p: p != 0), F.lit(0))
        title = F.coalesce(F.get(F.filter(fields, looks_like_title), F.lit(0)), F.lit(""))
        return F.struct(title.alias("title"), F.when(F.size(fields) >= 2, price).alias("price"))

    return F.filter(F.transform(F.transform(lines, _table_fields), read), lambda e: e["price"].isNotNull())


def flow_lines(lines: Column, has_currency: Column) -> Column:
    """Class of every line: ``ARRAY<STRUCT<i, price, title, ignored>>``."""
    def priced(line: Column) -> Column:
        dropped, only = _opens(line, dims.NON_FINAL_PRICE), F.rlike(line, F.lit(dims.PRICE_ONLY))
        # the cheap tests come first, so that a line without a mark meets no pattern on a page that has marks;
        # an amount inside a line is looked for only where the line is not an amount as a whole
        return F.struct(
            line.alias("line"),
            dropped.alias("dropped"),
            F.when(~dropped & (marked(line) | ~has_currency) & only, _amount(line)).alias("whole"),
            F.when(marked(line) & ~dropped & ~only, extract_price(line)).alias("inline"),
        )

    def judged(f: Column, i: Column) -> Column:
        whole = f["whole"].isNotNull()
        inline = F.coalesce(f["inline"] >= dims.MIN_PLAUSIBLE_PRICE, F.lit(False))
        text = F.when(inline, strip_prices(f["line"])).when(~f["dropped"] & ~whole, f["line"])
        return tx.bound(text, lambda t: tx.bound(looks_like_title(t), lambda titled: F.struct(
            i.alias("i"),
            F.when(whole, f["whole"]).when(inline, f["inline"]).alias("price"),
            F.when(titled, t).alias("title"),
            F.when(~titled & ~inline, t).alias("ignored"),
        )))

    return F.transform(F.transform(lines, priced), judged)


def parse_pastes(pastes: DataFrame, text: str = "text", tables: bool = False) -> DataFrame:
    """Adds ``entries ARRAY<STRUCT<title, price>>`` and the parse report to each paste.

    Whether a paste is a table is seen from its lines, and one line alone never is. ``tables`` states that all
    are, as where they come from files of that form; a line alone is then read as one too. Other columns are keys and pass through. A paste with lines but no entries gets an ``error``;
    other pastes are not affected by it.
    """
    keys = [c for c in pastes.columns if c != text]
    split = pastes.select(*keys, clean(F.col(text)).alias("cleaned")).select(
        *keys, marked(F.col("cleaned")).alias("has_currency"), split_lines(F.col("cleaned")).alias("all_lines")
    )
    lines = F.col("all_lines")
    moded = split.select("*", (F.lit(True) if tables else is_table(lines)).alias("table"))
    nothing = F.filter(lines, lambda x: F.lit(False))
    staged = moded.select(
        *keys, F.size(lines).alias("lines"), "table",
        table_entries(F.when(F.col("table"), lines).otherwise(nothing)).alias("table_rows"),
        flow_lines(F.when(F.col("table"), nothing).otherwise(lines), F.col("has_currency")).alias("flow"),
    ).select(
        *keys, "lines", "table", "table_rows",
        F.filter("flow", lambda f: f["price"].isNotNull()).alias("prices"),
        F.filter("flow", lambda f: f["title"].isNotNull()).alias("titles"),
        F.slice(F.transform(F.filter("flow", lambda f: f["ignored"].isNotNull()), lambda f: f["ignored"]),
                1, dims.IGNORED_SAMPLES).alias("ignored_samples"),
    )
    paired = staged.withColumn("picks", pick_titles(F.col("prices.i"), F.col("titles.i")))
    flow_rows = F.transform(F.col("prices"), lambda p, k: F.struct(
        # the title is taken out of its struct last: ``titles.title`` would be built anew for every price
        F.coalesce(F.get(F.col("titles"), F.get(F.col("picks"), k))["title"], F.lit("")).alias("title"),
        p["price"].alias("price"),
    ))
    result = paired.select(
        *keys, "lines", "ignored_samples",
        F.when(F.col("table"), F.lit("table")).otherwise(F.lit("flow")).alias("mode"),
        F.when(F.col("table"), F.col("table_rows")).otherwise(flow_rows).alias("entries"),
        # the size of entries, stated so that a plan that only counts drops the pairing and the titles
        F.when(F.col("table"), F.size("table_rows")).otherwise(F.size("prices")).alias("prices_found"),
        # so too here: on a page that has any title every price takes one
        F.when(F.col("table"), F.size(F.filter("table_rows", lambda e: e["title"] == ""))).when(
            F.size("titles") == 0, F.size("prices")).otherwise(0).alias("untitled"),
    )
    count = F.col("prices_found")
    return result.select(
        *keys, "entries", "mode", "lines", "prices_found", "untitled", "ignored_samples",
        F.when((F.col("lines") > 0) & (count == 0), F.lit(dims.UNREADABLE_PASTE)).alias("error"),
    )


def page_starts(parsed: DataFrame, page: str | None) -> DataFrame:
    """Adds ``start``: how many entries the earlier pages of the same quote and source hold.

    The running sum is over one narrow row a page, and parsed pages meet it by their page, so a source of
    very many pages is spread over tasks. Pastes of one page number are taken in the order of their entries.
    """
    if page is None:
        return parsed.withColumn("start", F.lit(0).cast("bigint"))
    # keys in a struct meet where they are null as well
    keyed = parsed.withColumn("page_key", F.struct("quote_id", "source", F.col(page).alias("page")))
    sizes = keyed.groupBy("page_key").agg(F.sum("prices_found").alias("size"))
    earlier = Window.partitionBy("page_key.quote_id", "page_key.source").orderBy("page_key.page")
    starts = sizes.select("page_key", F.sum("size").over(_before(earlier)).alias("earlier"))
    placed = keyed.withColumn("within", F.sum("prices_found").over(
        _before(Window.partitionBy("page_key").orderBy("entries"))))
    start = F.coalesce("earlier", F.lit(0)) + F.coalesce("within", F.lit(0))
    return placed.join(starts, "page_key").withColumn("start", start.cast("bigint")).drop("page_key", "earlier", "within")


def _before(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def entries(parsed: DataFrame, page: str | None = None) -> DataFrame:
    """One row per listing with its ``pos``, counted over all pages where ``page`` names their order.

    The outer form of the explode, because the plain one makes Spark add a size filter, push it
    below the parser and so parse every paste twice.
    """
    keys = [c for c in parsed.columns if c not in REPORT_COLUMNS + ["entries"]]
    started = page_starts(parsed, page)
    return started.select(*keys, "start", F.posexplode_outer("entries").alias("pos", "entry")).filter(
        "entry is not null").select(*keys, (F.col("start") + F.col("pos")).alias("pos"), "entry.title", "entry.price")


def report(parsed: DataFrame) -> DataFrame:
    return parsed.drop("entries")


def merged_reports(reports: DataFrame) -> DataFrame:
    """``quote_id, source, lines, prices_found, untitled, error``: one row per source of a quote."""
    return reports.groupBy("quote_id", "source").agg(
        *[F.sum(c).cast("bigint").alias(c) for c in ("lines", "prices_found", "untitled")]
    ).withColumn(
        "error", F.when((F.col("lines") > 0) & (F.col("prices_found") == 0), F.lit(dims.UNREADABLE_PASTE)))


def report_by_source(parsed: DataFrame) -> DataFrame:
    """The report of a source, all its pages together."""
    return merged_reports(report(parsed))


def direct_report(listings: DataFrame) -> DataFrame:
    """The report of listings that were given already parsed."""
    return listings.groupBy("quote_id", "source").agg(
        F.lit("direct").alias("mode"),
        F.count(F.lit(1)).cast("int").alias("lines"),
        F.count(F.lit(1)).cast("int").alias("prices_found"),
        F.lit(0).alias("untitled"),
        F.array().cast("array<string>").alias("ignored_samples"),
        F.lit(None).cast("string").alias("error"),
    )
