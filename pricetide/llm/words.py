"""Words, row keys and stored intermediates shared by the operators of this folder."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.llm.array_store import new_folder
from pricetide.session import cut_lineage

BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """Runs of anything but ASCII blanks; null counts as empty text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def text_key(text: Column) -> Column:
    """128 bits that stand for a whole text, in joins that need not carry it."""
    whole = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(whole).alias("a"), F.xxhash64(F.lit(7), whole).alias("b"))


def narrow(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, null where the table lacks one; other columns cannot clash."""
    return docs.select(*[docs[n] if n in docs.columns else F.lit(None).cast("string").alias(n) for n in names])


def fresh(*names: str) -> list[str]:
    """Column names that no input can hold."""
    tag = uuid.uuid4().hex[:8]
    return [f"{n}_{tag}" for n in names]


def stored(df: DataFrame) -> DataFrame:
    """Write an intermediate to the shared checkpoint folder and read it from there."""
    return cut_lineage(df)


def written(df: DataFrame, name: str) -> DataFrame:
    """Like ``stored``, as Parquet: smaller where sorted columns repeat."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def released(spark: SparkSession) -> None:
    """Let Spark remove the shuffle and checkpoint files of earlier rounds, to which nothing refers any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Remembered:
    """A function that keeps its results while a task runs; it travels to executors without them."""

    def __init__(self, function):
        self.function, self.kept = function, {}

    def __call__(self, *args):
        if args not in self.kept:
            self.kept[args] = self.function(*args)
        return self.kept[args]

    def __reduce__(self):
        return Remembered, (self.function,)


BATCH_ROWS = 2000


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, with its session set to hand Python at most ``BATCH_ROWS`` texts at once.

    Spark bounds such batches by rows only, and by default far higher; texts may be very long.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df
