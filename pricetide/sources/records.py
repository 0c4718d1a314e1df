"""Saved quotes: append, list, get, delete.

Records are Parquet, partitioned by day. Deleting appends ids to a second Parquet folder, which
readers anti-join. ``fold`` rewrites the days that hold deleted records into a new version and then
writes the pointer that makes readers follow it; ``compact`` writes a fresh copy of everything. Nothing
is overwritten in place, so a lost executor or driver never leaves a half-written day behind.

    records/created_date=D/          what is saved
    deleted/                         ids
    folded/version=N/created_date=D/ days without their deleted records
    pointers/N.json                  committed versions, files they replace, deletions they hold
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from pricetide import dims

FIRST_DAYS = 4  # opened at first to list the newest records
SLACK_DAYS = 2  # a day folder may be off by one where sessions of other time zones wrote
LISTED = ["id", "query", "created_at", "note", "summary"]


def record_id(created_at: Column, *parts: Column) -> Column:
    """Time stamp and a hexadecimal tail. A hash instead of a random tail: a retried task writes the same id."""
    tail = F.lower(F.lpad(F.hex(F.xxhash64(created_at, *parts)), 16, "0"))
    return F.concat_ws("-", F.date_format(created_at, "yyyyMMdd-HHmmss"), tail)


def summary(quotes: DataFrame, source_stats: DataFrame, sources: list[tuple]) -> DataFrame:
    """``quote_id, summary STRUCT<blend, combined, match, per_source>``."""
    from pricetide.operators.stats import source_label, source_order

    entry = F.struct(
        source_order(F.col("source"), sources).alias("o"), F.col("source"),
        source_label(F.col("source"), sources).alias("label"), F.col("median"), F.col("count"),
    )
    per_source = source_stats.groupBy("quote_id").agg(F.array_sort(F.collect_list(entry)).alias("entries")).select(
        "quote_id",
        F.transform("entries", lambda e: F.struct(
            e["source"].alias("source"), e["label"].alias("label"),
            e["median"].alias("median"), e["count"].alias("count"))).alias("per_source"),
    )
    stat_names = ["count", "min", "p25", "median", "p75", "max", "mean", "stdev", "iqr"]
    # a quote without any listing has no entry
    nothing = F.filter(F.array(F.struct(
        F.lit("").alias("source"), F.lit("").alias("label"), F.lit(None).cast("bigint").alias("median"),
        F.lit(None).cast("bigint").alias("count"))), lambda e: F.lit(False))
    return quotes.join(per_source, "quote_id", "left").withColumn(
        "per_source", F.coalesce("per_source", nothing)).select(
        "quote_id",
        F.struct(
            F.struct("equal_weight_median", "equal_weight_mean", "weighted_mean", "sources_used").alias("blend"),
            F.struct(*[F.col(f"combined_{n}").alias(n) for n in stat_names]).alias("combined"),
            F.struct(
                F.col("basis_tier").alias("tier"), "n_model", "n_brand", "n_loose",
                F.col("n_basis").alias("count"),
            ).alias("match"),
            "per_source",
        ).alias("summary"),
    )


def records(summaries: DataFrame, inputs: DataFrame) -> DataFrame:
    """Complete records. ``inputs``: ``quote_id, query, created_at, groups`` and optionally
    ``note, tag_text, barcode, shop_price, condition``."""
    def optional(name: str, kind: str) -> Column:
        value = F.col(name) if name in inputs.columns else F.lit(None)
        return value.cast(kind).alias(name)

    return summaries.join(inputs, "quote_id").select(
        record_id(F.col("created_at"), F.col("quote_id").cast("string")).alias("id"),
        "query", "created_at", "groups", "summary",
        F.coalesce(optional("note", "string"), F.lit("")).alias("note"),
        F.coalesce(optional("tag_text", "string"), F.lit("")).alias("tag_text"),
        F.coalesce(optional("barcode", "string"), F.lit("")).alias("barcode"),
        optional("shop_price", "bigint"),
        F.coalesce(optional("condition", "string"), F.lit("")).alias("condition"),
    )


@dataclass(frozen=True)
class Pointer:
    """What readers follow: the newest pointer file, or this where there is none."""

    number: int = 0
    versions: tuple[int, ...] = ()
    replaced: tuple[str, ...] = ()  # day folder and name of files that a version stands for
    applied: tuple[str, ...] = ()  # files of deletions that a version holds


class RecordStore:
    """Paths of one set of records."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.data = f"{folder}/records"
        self.deleted = f"{folder}/deleted"
        self.folded = f"{folder}/folded"
        self.pointers = f"{folder}/pointers"

    def save(self, rows: DataFrame) -> None:
        self._write(rows.withColumn("created_date", F.to_date("created_at")), self.data, "append")

    def _write(self, dated: DataFrame, path: str, mode: str) -> None:
        """Days become files of about the advisory partition size, as the shuffle measures it.

        A small day is one file, or a few where it shares a shuffle partition with a large one.
        """
        dated.hint("rebalance", F.col("created_date")).write.mode(mode).partitionBy("created_date").parquet(path)

    def read(self) -> DataFrame:
        pointer = self.pointer()
        return self._kept(self._rows(pointer), pointer).drop("file")

    def _rows(self, pointer: Pointer) -> DataFrame:
        """Records of one version with their ``file``, those not yet folded away included."""
        def standing(rows: DataFrame) -> DataFrame:
            rows = rows.withColumn("file", F.substring_index("_metadata.file_path", "/", -2))
            return rows.where(~F.col("file").isin(list(pointer.replaced))) if pointer.replaced else rows

        saved = self.spark.read.parquet(self.data)
        rows = standing(saved)
        if pointer.versions:
            schema = StructType([*saved.schema, StructField("version", IntegerType())])
            folded = self.spark.read.schema(schema).parquet(self.folded)
            rows = rows.unionByName(standing(folded.where(F.col("version").isin(list(pointer.versions)))).drop("version"))
        return rows

    def _kept(self, rows: DataFrame, pointer: Pointer) -> DataFrame:
        tombstones = self._tombstones(pointer)
        return rows if tombstones is None else rows.join(tombstones.select("id").distinct(), "id", "left_anti")

    def _tombstones(self, pointer: Pointer) -> DataFrame | None:
        schema = "id string"
        try:
            rows = self.spark.read.schema(schema).parquet(self.deleted)
        except Exception as error:  # no folder until the first deletion
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise
        return rows.where(~F.col("_metadata.file_name").isin(list(pointer.applied))) if pointer.applied else rows

    def _path(self, path: str):
        """A Hadoop path and its file system."""
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, pattern: str) -> list[str]:
        path, files = self._path(pattern)
        return [str(s.getPath().getName()) for s in files.globStatus(path) or []]

    def pointer(self) -> Pointer:
        numbers = [int(n[:-5]) for n in self._listed(f"{self.pointers}/*.json") if re.fullmatch(r"\d+\.json", n)]
        if not numbers:
            return Pointer()
        path, files = self._path(f"{self.pointers}/{max(numbers)}.json")
        stream = files.open(path)
        try:
            held = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Pointer(**{name: tuple(v) if isinstance(v, list) else v for name, v in held.items()})

    def _commit(self, pointer: Pointer) -> None:
        """Written aside, then renamed to a name that must be free, so that readers see a whole pointer or none."""
        aside, files = self._path(f"{self.pointers}/.{uuid.uuid4().hex}")
        out = files.create(aside)
        out.write(bytearray(json.dumps(asdict(pointer)).encode()))
        out.close()
        final, _ = self._path(f"{self.pointers}/{pointer.number}.json")
        if files.exists(final) or not files.rename(aside, final):
            raise RuntimeError(f"another fold has written pointer {pointer.number}")

    def fold(self) -> bool:
        """Rewrite the days that hold deleted records, then switch readers over; False where nothing is deleted.

        Files of other days stay. Records saved and deletions made meanwhile are in files this version does
        not name, so they keep counting. Folds of one store run one at a time: the second to finish fails at its
        pointer and changes nothing. A deleted id that is saved again after its deletion was folded is a new record.
        The driver holds the touched days and the names of their files.
        """
        before = self.pointer()
        gone = self._tombstones(before)
        if gone is None:
            return False
        applied = [r[0] for r in gone.select("_metadata.file_name").distinct().collect()]
        gone, rows = gone.select("id").distinct(), self._rows(before)
        days = [r[0] for r in rows.join(gone, "id", "left_semi").select("created_date").distinct().collect()]
        day, versions, replaced = F.col("created_date"), before.versions, before.replaced
        if days:
            held = rows.where(day.isin([d for d in days if d is not None]) | (day.isNull() & F.lit(None in days)))
            stored = [r[0] for r in held.select("file").distinct().collect()]
            version = max(versions, default=0) + 1
            while self._listed(f"{self.folded}/version={version}"):  # left by a fold that did not finish
                version += 1
            self._write(held.join(gone, "id", "left_anti").drop("file"), f"{self.folded}/version={version}", "error")
            versions, replaced = (*versions, version), (*replaced, *stored)
        self._commit(Pointer(before.number + 1, versions, replaced, (*before.applied, *applied)))
        return True

    def days(self) -> list[str]:
        """Days that hold records, newest first, from folder names alone; records without a time have none."""
        names = [name.partition("=")[2] for name in self._listed(f"{self.data}/created_date=*")]
        return sorted((n for n in names if re.fullmatch(r"\d{4}-\d\d-\d\d", n)), reverse=True)

    def latest(self, limit: int = dims.RECORDS_LISTED) -> DataFrame:
        """The newest records. Days are opened from the newest on, twice as many at each step, until they hold
        ``limit`` records that are not deleted; older days are never read."""
        days, opened = self.days(), FIRST_DAYS
        while opened + SLACK_DAYS < len(days):
            recent = self._since(days[opened - 1])
            if recent.select("id").limit(limit).count() >= limit:
                return latest(self._since(days[opened - 1 + SLACK_DAYS]), limit)
            opened *= 2
        return latest(self.read(), limit)

    def _since(self, day: str) -> DataFrame:
        return self.read().where(F.col("created_date") >= F.lit(day).cast("date"))

    def get(self, record: str) -> DataFrame:
        """One record. Its id begins with its day, so that only that day's folder is opened."""
        rows = self.read().filter(F.col("id") == record)
        day = re.match(r"(\d{4})(\d\d)(\d\d)-", record)
        if day:
            rows = rows.filter(F.col("created_date") == F.lit("-".join(day.groups())).cast("date"))
        return rows

    def delete(self, ids: DataFrame) -> None:
        ids.select("id").distinct().write.mode("append").parquet(self.deleted)

    def compact(self, folder: str) -> "RecordStore":
        """A copy without deleted records, in a new folder, for readers to switch to."""
        fresh = RecordStore(self.spark, folder)
        fresh._write(self.read(), fresh.data, "error")
        return fresh


def latest(rows: DataFrame, limit: int = dims.RECORDS_LISTED) -> DataFrame:
    """Newest first, without the pasted texts, which are then not even read."""
    return rows.select(*LISTED).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select("id"), "id", "left_anti")


def saved_pastes(rows: DataFrame) -> DataFrame:
    """The pasted texts of saved records, as input of a new job; ``quote_id`` is the record id."""
    return rows.select(F.col("id").alias("quote_id"), F.explode("groups").alias("g")).select(
        "quote_id", F.col("g.key").alias("source"), F.coalesce("g.text", F.lit("")).alias("text"))
