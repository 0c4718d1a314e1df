"""Result rows as CSV, excluded rows included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricetide import dims
from pricetide.operators.match import tier_label

ROWS_PER_FILE = 500_000
BYTE_ORDER_MARK = "﻿"


def export_columns() -> list[Column]:
    """The exported cells, under their fixed header."""
    cells = [
        F.col("label"), F.col("title"), F.col("price").cast("string"), tier_label(F.col("tier")),
        F.when(F.col("in_basis"), F.lit("yes")).otherwise(F.lit("no")),
        F.coalesce("exclude_reason", F.lit("")),
    ]
    return [cell.alias(name) for cell, name in zip(cells, dims.EXPORT_HEADER)]


def csv_line(cells: list[Column]) -> Column:
    """One line with every cell quoted and quotes doubled."""
    quoted = [
        F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
        for c in cells
    ]
    return F.concat_ws(",", *quoted)


def export_lines(rows: DataFrame) -> DataFrame:
    """``quote_id, source, pos, line``: the text of every exported row."""
    return rows.select("quote_id", "source", "pos", csv_line(export_columns()).alias("line"))


def write_table(rows: DataFrame, path: str) -> None:
    """All quotes as one CSV data set, ``quote_id`` in front, written in parallel."""
    rows.select("quote_id", *export_columns()).write.mode("error").csv(
        path, header=True, quoteAll=True, escape='"', lineSep="\r\n", emptyValue="")


def write_by_quote(rows: DataFrame, path: str, source_order: Column, sizes: DataFrame, rows_per_file: int = ROWS_PER_FILE) -> None:
    """One folder per quote whose part files, in name order, form the file with mark and header.

    ``sizes(quote_id, source, n)`` says how many rows each quote and source has (``listing_sizes``); with the
    positions, which count from 0 within a quote and source, it gives every row its file before the rows
    themselves are computed, so they are computed once and nothing is sampled. A quote of more than
    ``rows_per_file`` rows is spread over several part files; only its first one starts with the byte order
    mark and the header. Smaller quotes share tasks.
    """
    header = BYTE_ORDER_MARK + ",".join(f'"{name}"' for name in dims.EXPORT_HEADER)
    ordered = sizes.withColumn("o", source_order.cast("int"))
    earlier = Window.partitionBy("quote_id").orderBy("o", "source").rowsBetween(Window.unboundedPreceding, -1)
    starts = ordered.select(
        "quote_id", "source", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    total, longest = starts.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max(F.col("start") + F.col("n")), F.lit(0))).first()
    common = 1 + total // rows_per_file
    first_file = F.pmod(F.xxhash64("quote_id"), F.lit(common))
    # keys in a struct meet where the source is null as well
    key = F.struct("quote_id", "source").alias("key")
    body = rows.select(key, "quote_id", "pos", csv_line(export_columns()).alias("line")).join(
        starts.select(key, "start"), "key").select("quote_id", (F.col("start") + F.col("pos")).alias("place"), "line")
    heads = sizes.select("quote_id").distinct().select(
        "quote_id", F.lit(-1).cast("bigint").alias("place"), F.lit(header).alias("line"))
    lines = heads.unionByName(body)
    file = first_file + F.floor(F.greatest("place", F.lit(0)) / rows_per_file)
    (
        lines.repartitionById(common + longest // rows_per_file + 1, file.cast("int"))
        .sortWithinPartitions("quote_id", "place")
        .select("quote_id", "line")
        .write.mode("error").partitionBy("quote_id").option("lineSep", "\r\n").text(path)
    )


def listing_sizes(listings: DataFrame) -> DataFrame:
    """``quote_id, source, n`` of the listings that become rows; no title is read."""
    return listings.where("quote_id is not null").groupBy("quote_id", "source").agg(F.count(F.lit(1)).alias("n"))
