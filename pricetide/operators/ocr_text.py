"""Recognised text: line confidence, gaps, noise lines, and the choice among passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide import dims
from pricetide.functions import text as tx


def close_japanese_gaps(line: Column) -> Column:
    joined = F.regexp_replace(line, f"({tx.JAPANESE})[ \t]+(?={tx.JAPANESE})", "$1")
    return F.when(F.octet_length(line) == F.length(line), line).otherwise(joined)


def close_code_gaps(line: Column) -> Column:
    joined = F.regexp_replace(line, r"(\w)\s+-\s*(\d)", "$1-$2")
    joined = F.regexp_replace(joined, r"(\d)\s*-\s+(\d)", "$1-$2")
    joined = F.regexp_replace(joined, tx.ascii_words(r"\b([A-Z]{1,4})\s+(\d{3,7})\b"), "$1$2")
    return F.when(F.rlike(line, F.lit("[0-9]")), joined).otherwise(line)


def is_useful(line: Column) -> Column:
    """At least three meaningful letters, which make up half of the line."""
    return tx.bound(tx.meaningful_count(line), lambda good: (good >= 3) & (good * 2 >= tx.utf16_length(line)))


def useful_lines(normal: Column) -> Column:
    """Cleaned lines of NFKC text, without noise and without a line that repeats the one before."""
    def tidy(line: Column) -> Column:
        wide = tx.contains_any(line, ["  ", "\t"])
        spaced = tx.strip(F.when(wide, F.regexp_replace(line, "[ \t]+", " ")).otherwise(line))
        return tx.bound(tx.bound(spaced, close_japanese_gaps), close_code_gaps)

    useful = F.filter(F.transform(F.split(normal, "\r?\n"), tidy), is_useful)
    return tx.bound(useful, lambda rows: F.filter(
        rows, lambda line, i: (i == 0) | (line != F.get(rows, i - 1))))


def clean_text(docs: DataFrame, text: str = "text", result: str = "clean_text") -> DataFrame:
    normal = docs.withColumn("normal_text", tx.nfkc(F.col(text)))
    return normal.withColumn(result, F.array_join(useful_lines(F.col("normal_text")), "\n")).drop("normal_text")


def confident_text(lines: Column) -> Column:
    """Text of the recognised ``ARRAY<STRUCT<text, confidence>>`` lines that are sure enough."""
    sure = F.filter(lines, lambda x: F.coalesce(x["confidence"], F.lit(0)) >= dims.MIN_LINE_CONFIDENCE)
    return F.array_join(F.transform(sure, lambda x: F.coalesce(x["text"], F.lit(""))), "\n")


def content_or_nothing(text: Column) -> Column:
    """'' for text with too few letters to be more than creases in the cloth."""
    return F.when(tx.meaningful_count(text) < dims.MIN_MEANINGFUL_CHARS, F.lit("")).otherwise(text)


def read_lines(recognised: DataFrame) -> DataFrame:
    """Recogniser output with ``lines`` to ``clean_text``: confidence, cleaning, minimum content.

    Where no lines are given, the plain ``text`` is cleaned instead.
    """
    source = F.when(F.size("lines") > 0, confident_text(F.col("lines"))).otherwise(
        F.coalesce(F.col("text"), F.lit(""))
    )
    cleaned = clean_text(recognised.withColumn("picked_text", source), "picked_text")
    return cleaned.withColumn("clean_text", content_or_nothing(F.col("clean_text"))).drop("picked_text")


def pick_orientation(passes: DataFrame) -> DataFrame:
    """``photo_id, degrees, confidence`` of the surest probe, the first of equals.

    ``max_by`` combines on the map side, so a photo with very many passes needs no window.
    """
    sure = F.coalesce("confidence", F.lit(0))
    return passes.filter("kind = 'probe'").groupBy("photo_id").agg(
        F.max_by("degrees", F.struct(sure, -F.col("ord"))).alias("degrees"),
        F.max(sure).alias("confidence"),
    )


def pick_variant(passes: DataFrame, payload: str | None = None) -> DataFrame:
    """The variant a reader who stops at the first good one would keep.

    Variants are tried in ``ord``; the first with a rounded confidence of 85 ends the search and,
    being surer than all before it, is the result. Without one, the surest wins, the first of equals.
    """
    sure = F.floor(F.coalesce("confidence", F.lit(0)) + F.lit(0.5)).cast("bigint")
    good = sure >= dims.GOOD_ENOUGH
    rank = F.struct(good, F.when(good, -F.col("ord")).otherwise(sure), -F.col("ord"))
    kept = F.struct(F.col("ord"), sure.alias("confidence"), *([F.col(payload)] if payload else []))
    best = passes.filter("kind = 'variant'").groupBy("photo_id").agg(F.max_by(kept, rank).alias("best"))
    return best.select("photo_id", "best.*").withColumn(
        "shaky", F.col("confidence") < dims.SHAKY_CONFIDENCE
    )


def pick_passes(passes: DataFrame) -> DataFrame:
    """``photo_id, degrees, ord, confidence, shaky``: both choices of a photo in one grouping."""
    sure = F.coalesce("confidence", F.lit(0))
    whole = F.floor(sure + F.lit(0.5)).cast("bigint")
    good = whole >= dims.GOOD_ENOUGH
    probe, variant = F.col("kind") == "probe", F.col("kind") == "variant"
    rank = F.struct(good, F.when(good, -F.col("ord")).otherwise(whole), -F.col("ord"))
    return passes.groupBy("photo_id").agg(
        F.max_by("degrees", F.when(probe, F.struct(sure, -F.col("ord")))).alias("degrees"),
        F.max_by(F.struct(F.col("ord"), whole.alias("confidence")), F.when(variant, rank)).alias("best"),
    ).select(
        "photo_id",
        F.coalesce("degrees", F.lit(0)).alias("degrees"),
        "best.ord", "best.confidence",
        (F.col("best.confidence") < dims.SHAKY_CONFIDENCE).alias("shaky"),
    )


def photo_texts(passes: DataFrame) -> DataFrame:
    """``photo_id, degrees, ord, confidence, shaky, clean_text``: passes with ``lines`` to the text of the pick.

    The pick is made on the numbers alone; lines are read for the picked pass only.
    """
    picks = pick_passes(passes.drop("lines"))
    read = passes.where("kind = 'variant'").select(
        F.col("photo_id").alias("p"), F.col("ord").alias("o"), "lines", F.lit("").alias("text"))
    joined = picks.join(read, (F.col("photo_id") == F.col("p")) & (F.col("ord") == F.col("o")), "left").drop("p", "o")
    return read_lines(joined).drop("lines", "text")
