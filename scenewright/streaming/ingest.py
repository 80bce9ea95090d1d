"""Streams of sightings, folded into a store by the same merges as batches, and the queue of a crawl that can stop
anywhere and go on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scenewright.operators import merge
from scenewright.sources.store import Store, Version


def ingest(
    spark: SparkSession, source: str, schema: str, fold: Callable[[DataFrame], DataFrame], root: str, table: str, keys: list[str], checkpoint: str, buckets: int = 16
) -> StreamingQuery:
    """Merge new files of sightings into a table of the store, batch by batch, until none is left.

    A batch reads and writes the buckets of its keys alone. The stream's checkpoint gives each batch the number it had
    before a failure, and the store takes a number once. A fold's result has to be foldable again with the raw columns
    under the same names."""
    stream, store = spark.readStream.schema(schema).json(source), Store(spark, root)

    def take(batch: DataFrame, number: int) -> None:
        store.merge(table, batch, keys, fold, f"stream:{table}", number, buckets)

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Crawl:
    """A crawl's queue and runs in a store: entries (urn, depth, status, priority, attempts, enqueued_at, run), runs
    (run, started, finished, visited). Each step is one version of the store, so a crawl that dies goes on from its last
    step: what it had claimed is pending again after resume()."""

    QUEUE = "urn string, depth int, status string, priority long, attempts int, enqueued_at long, run string"
    RUNS = "run string, started long, finished long, visited long"

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.store, self.buckets = spark, Store(spark, root), buckets

    def queue(self) -> DataFrame:
        return self._table("queue", self.QUEUE)

    def runs(self) -> DataFrame:
        return self._table("runs", self.RUNS)

    def _table(self, name: str, schema: str) -> DataFrame:
        version = self.store.version()
        return self.store.read(name, version) if name in version.tables else self.spark.createDataFrame([], schema)

    def _put(self, changed: DataFrame) -> Version:
        """Entries as they are now, in place of those of the same urn."""
        new = changed.select(*[c.split()[0] for c in self.QUEUE.split(", ")]).withColumn("_new", F.lit(1))

        def fold(both: DataFrame) -> DataFrame:
            rows = [c for c in both.columns if c not in ("urn", "_new")]
            return both.groupBy("urn").agg(F.max_by(F.struct(*rows), F.coalesce("_new", F.lit(0))).alias("e")).select("urn", "e.*", F.lit(0).alias("_new"))

        return self.store.merge("queue", new, ["urn"], fold, buckets=self.buckets)

    def enqueue(self, found: DataFrame, at: int, source: str | None = None, number: int | None = None) -> Version:
        """found (urn, depth): a new urn is pending; one that is there takes the lesser depth and one more priority for
        each time it is found, and one that is done or failed comes back only for a strictly lesser depth. A source's
        batch number counts once."""
        new = found.where("urn is not null").groupBy("urn").agg(F.min("depth").cast("int").alias("depth"), F.count("*").alias("n"))
        batch = new.select("urn", "depth", F.lit(None).cast("string").alias("status"), F.col("n").alias("priority"), F.lit(0).alias("attempts"), F.lit(at).cast("long").alias("enqueued_at"),
                           F.lit(None).cast("string").alias("run"), F.lit(1).alias("_new"))

        def fold(both: DataFrame) -> DataFrame:
            old = lambda c: F.max(F.when(F.col("_new") == 0, F.col(c)))  # noqa: E731  one old row at most
            add = lambda f, c: f(F.when(F.col("_new") == 1, F.col(c)))
            told = both.groupBy("urn").agg(
                *[old(c).alias(f"o_{c}") for c in ("depth", "status", "priority", "attempts", "enqueued_at", "run")], F.max(F.col("_new") == 0).alias("there"),
                add(F.min, "depth").alias("depth"), F.coalesce(add(F.sum, "priority"), F.lit(0)).alias("n"), add(F.min, "enqueued_at").alias("at"),
            )
            again = F.col("o_status").isin("done", "failed") & F.coalesce(F.col("depth") < F.col("o_depth"), F.lit(False))
            fresh = ~F.col("there") | again
            return told.select(
                "urn", F.least("depth", "o_depth").alias("depth"), F.when(fresh, "pending").otherwise(F.col("o_status")).alias("status"),
                F.when(F.col("there"), F.col("o_priority") + F.col("n")).otherwise(F.col("n") - 1).alias("priority"),
                F.when(fresh, 0).otherwise(F.col("o_attempts")).alias("attempts"), F.coalesce("o_enqueued_at", "at").alias("enqueued_at"),
                F.when(~fresh, F.col("o_run")).alias("run"), F.lit(0).alias("_new"),
            )

        return self.store.merge("queue", batch, ["urn"], fold, source, number, self.buckets)

    def claim(self, k: int, run: str) -> DataFrame:
        """The next k pending entries, now in progress under this run."""
        took = merge.claim(self.queue(), k).withColumn("status", F.lit("in_progress")).withColumn("run", F.lit(run))
        took = self.spark.createDataFrame(took.collect(), took.schema)  # k rows
        self._put(took)
        return took

    def done(self, urns: DataFrame) -> Version:
        """What of them is in progress is done."""
        return self._put(merge.mark_done(self.queue().join(urns.select("urn").distinct(), "urn", "left_semi"), urns))

    def failed(self, urns: DataFrame) -> Version:
        mine = self.queue().where("status = 'in_progress'").join(urns.select("urn").distinct(), "urn", "left_semi")
        return self._put(merge.mark_failed(mine, urns))

    def resume(self) -> Version:
        """After a crash, what was in progress is pending again."""
        return self._put(merge.reset_in_progress(self.queue().where("status = 'in_progress'")))

    def start_run(self, run: str, at: int) -> Version:
        return self._run(run, at, None, None)

    def finish_run(self, run: str, at: int) -> Version:
        """The run's row with its end, and how many entries it did."""
        n = self.queue().where((F.col("run") == run) & (F.col("status") == "done")).count()
        return self._run(run, None, at, n)

    def _run(self, run: str, started: int | None, finished: int | None, visited: int | None) -> Version:
        row = self.spark.createDataFrame([(run, started, finished, visited)], self.RUNS)
        return self.store.merge("runs", row, ["run"], lambda both: both.groupBy("run").agg(*[F.max(c).alias(c) for c in ("started", "finished", "visited")]), buckets=1)


def recent_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window, event_type, n) of an event stream or table: tumbling windows, closed when the watermark has passed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("window_start"), "event_type", "n"
    )
