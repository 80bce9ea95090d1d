"""Idempotent merges of sightings: every fold is a maximum, a minimum, a first or a last, so batches may come in any
order and be merged again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEEP_LATEST = ["permalink", "city_raw", "country"]


def merge_artists(sightings: DataFrame) -> DataFrame:
    """One row per urn of sightings (urn, seen, depth, discovered_via, attributes): each attribute's latest non-null
    value, the least depth, the first discovery, first and last sight."""
    order = F.struct("seen", F.coalesce("discovered_via", F.lit("")))
    return sightings.groupBy("urn").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("seen", c))).alias(c) for c in KEEP_LATEST if c in sightings.columns],
        F.min("depth").alias("depth"),
        F.min_by("discovered_via", order).alias("discovered_via"),
        F.min("seen").alias("first_seen"),
        F.max("seen").alias("last_seen"),
    )


def merge_edges(sightings: DataFrame) -> DataFrame:
    """(src, dst, type, weight, first_seen, last_seen): the greatest weight seen."""
    return sightings.groupBy("src", "dst", "type").agg(F.max("weight").alias("weight"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"))


def merge_terms(sightings: DataFrame) -> DataFrame:
    """(urn, term, kind, evidence, last_seen): the greatest evidence of any visit, not the sum."""
    return sightings.groupBy("urn", "term", "kind").agg(F.max("evidence").alias("evidence"), F.max("seen").alias("last_seen"))


def merge_engagement(observed: DataFrame) -> DataFrame:
    """(urn, plays, likes, comments) of the latest observation."""
    return observed.groupBy("urn").agg(F.max_by(F.struct("plays", "likes", "comments"), F.struct("seen", "plays", "likes", "comments")).alias("m")).select("urn", "m.*")


def merge_queue(queue: DataFrame) -> DataFrame:
    """(urn, depth, status, priority) after folding enqueue events (urn, at, depth) and finish events (urn, at, depth
    null, status) in time order, of one instant the enqueues first: a finished entry comes back only for a strictly
    lesser depth; each enqueue after the first raises the priority by one.

    Only the last finish counts: an entry is open again if it was found at a lesser depth after it than before. So an
    urn's history is two rounds of sums, and no list, however long it is."""
    last = queue.where("depth is null").groupBy("urn").agg(F.max("at").alias("_end"), F.max_by("status", F.struct("at", "status")).alias("_status"))
    told = queue.where("depth is not null").join(last, "urn", "full")
    after = F.col("at") > F.col("_end")
    sums = told.groupBy("urn").agg(
        F.min("depth").alias("depth"), F.min(F.when(after, F.col("depth"))).alias("_late"), F.min(F.when(~after, F.col("depth"))).alias("_early"),
        F.count("depth").alias("_n"), F.max("_status").alias("_status"),
    )
    again = F.col("_late").isNotNull() & F.coalesce(F.col("_late") < F.col("_early"), F.lit(True))
    status = F.when(F.col("_status").isNull() | again, "pending").otherwise(F.col("_status"))
    return sums.select("urn", "depth", status.alias("status"), (F.col("_n") - 1).alias("priority"))


def reprioritized(queue: DataFrame, edges: DataFrame) -> DataFrame:
    """Pending entries take their inbound edges as priority."""
    n = edges.groupBy(F.col("dst").alias("urn")).agg(F.count("*").alias("inbound"))
    told = queue.join(n, "urn", "left")
    return told.withColumn("priority", F.when(F.col("status") == "pending", F.coalesce("inbound", F.lit(0))).otherwise(F.col("priority"))).drop("inbound")


def claim(queue: DataFrame, k: int) -> DataFrame:
    """The next k pending entries: priority first, then the lesser depth, then the earlier."""
    return queue.where("status = 'pending'").orderBy(F.desc("priority"), "depth", "enqueued_at", "urn").limit(k)

MAX_ATTEMPTS = 3


def mark_failed(queue: DataFrame, failed: DataFrame) -> DataFrame:
    """Entries (urn, status, attempts) after one failure of each urn in failed: one attempt more, given up at the third."""
    told = queue.join(failed.select("urn", F.lit(True).alias("_failed")).distinct(), "urn", "left")
    tried = F.col("attempts") + F.when(F.col("_failed"), 1).otherwise(0)
    status = F.when(F.col("_failed") & (tried >= MAX_ATTEMPTS), "failed").when(F.col("_failed"), "pending").otherwise(F.col("status"))
    return told.withColumn("status", status).withColumn("attempts", tried).drop("_failed")


def mark_done(queue: DataFrame, done: DataFrame) -> DataFrame:
    """Entries (urn, status) with those of done (urn) that were in progress done."""
    told = queue.join(done.select("urn", F.lit(True).alias("_done")).distinct(), "urn", "left")
    return told.withColumn("status", F.when(F.col("_done") & (F.col("status") == "in_progress"), "done").otherwise(F.col("status"))).drop("_done")


def mark_crawled(artists: DataFrame, visits: DataFrame) -> DataFrame:
    """artists (urn, ...) with crawled and crawled_at of visits (urn, at): the last visit counts; who was crawled before
    stays so."""
    last = visits.groupBy("urn").agg(F.max("at").alias("_at"))
    told = artists.join(last, "urn", "left")
    return told.withColumn("crawled_at", F.greatest("crawled_at", "_at")).withColumn("crawled", F.col("crawled_at").isNotNull()).drop("_at")


def merge_runs(events: DataFrame) -> DataFrame:
    """(run, started, finished, visited) of events (run, at, kind, visited): the first start, the last finish, and how
    many it visited by then; a run that goes on has no finish."""
    end = F.when(F.col("kind") == "finish", F.struct("at", "visited"))
    told = events.groupBy("run").agg(F.min(F.when(F.col("kind") == "start", F.col("at"))).alias("started"), F.max(end).alias("e"))
    return told.select("run", "started", F.col("e.at").alias("finished"), F.col("e.visited").alias("visited"))


def reset_in_progress(queue: DataFrame) -> DataFrame:
    """After a crash, what was in progress is pending again."""
    return queue.withColumn("status", F.when(F.col("status") == "in_progress", "pending").otherwise(F.col("status")))


def merge_links(sightings: DataFrame) -> DataFrame:
    """(urn, url, first_seen)."""
    return sightings.groupBy("urn", "url").agg(F.min("seen").alias("first_seen"))
