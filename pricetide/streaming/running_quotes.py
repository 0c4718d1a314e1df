"""Quotes that are kept up to date as listings arrive, without reading earlier listings again.

A quote depends on its listings through counts of (quote, source, excluded, tier, price) only, and
counts add up. Each batch of listings becomes a delta of counts in a folder named by its batch id;
only the quotes that a batch touches are settled again, from the sums of all deltas. A batch that
arrives again writes the same folder again, so replays and retries change nothing. Options and targets must
stay the same for one store, since they decide how listings are counted.

    store = RunningQuotes(spark, folder, options, targets)
    listings_stream.writeStream.foreachBatch(store.absorb).option("checkpointLocation", ...).start()
    store.quotes()
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.plans.quote import QuoteJob

LISTINGS = "quote_id {key}, source string, title string, price bigint"
KEYS = ["quote_id", "source", "excluded", "tier", "price"]
SETTINGS = ["has_target", "remove_outliers", "iqr_k", "min_basis_count"]


class RunningQuotes:
    """A folder of count deltas and of the quotes each batch changed."""

    def __init__(self, spark: SparkSession, folder: str, options: DataFrame, targets: DataFrame | None = None,
                 sources: list | None = None, wide: bool = False):
        self.spark, self.folder, self.wide = spark, folder, wide
        self.options, self.targets, self.sources = options, targets, sources

    def job(self, listings: DataFrame | None = None, counts: DataFrame | None = None) -> QuoteJob:
        if listings is None:
            listings = self.spark.createDataFrame([], LISTINGS.format(key=dict(self.options.dtypes)["quote_id"]))
        return QuoteJob(listings, self.options, self.targets, sources=self.sources, counts=counts, wide=self.wide)

    def stored(self, kind: str) -> DataFrame | None:
        """What finished batches wrote, with their ``batch``; None before the first one."""
        top = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        files = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(top):
            return None
        # a batch that is being written, or whose writer was lost, has no mark yet
        done = [str(s.getPath()) for s in files.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}/batch=*/_SUCCESS"))]
        paths = [p.removesuffix("/_SUCCESS") for p in done]
        return self.spark.read.option("basePath", f"{self.folder}/{kind}").parquet(*paths) if paths else None

    def absorb(self, listings: DataFrame, batch: int) -> None:
        """Add a batch of listings and settle the quotes it touches. The same batch id replaces its earlier self."""
        delta = self.job(listings.select("quote_id", "source", "title", "price")).counted.where("n > 0")
        here = f"{self.folder}/counts/batch={batch}"
        delta.write.mode("overwrite").parquet(here)
        touched = self.spark.read.parquet(here).select("quote_id").distinct()
        counts = self.counts().join(touched, "quote_id", "left_semi")
        self.job(counts=counts).quotes.write.mode("overwrite").parquet(f"{self.folder}/quotes/batch={batch}")

    def counts(self) -> DataFrame:
        """Sums of all deltas: a row per quote, source, tier and price, as ``QuoteJob`` takes them.

        Deltas are counts already, so they are dealt by quote at once, as the windows that settle them need it: one
        shuffle serves the sums, the choice of touched quotes and the windows. ``wide`` is for quotes that no task should hold.
        """
        deltas = self.stored("counts")
        deltas = deltas if self.wide else deltas.repartition("quote_id")
        return deltas.groupBy(*KEYS).agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in SETTINGS])

    def quotes(self) -> DataFrame:
        """Every quote as of its last batch; one without listings so far counts 0."""
        nothing = self.job().quotes
        written = self.stored("quotes")
        if written is None:
            return nothing
        columns = nothing.columns
        last = written.groupBy("quote_id").agg(F.max_by(F.struct(*columns), "batch").alias("q")).select("q.*")
        return last.unionByName(nothing.join(last.select("quote_id"), "quote_id", "left_anti"))
