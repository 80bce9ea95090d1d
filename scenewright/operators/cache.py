"""The cache's rules over tables of entries; `now` is always given, in milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# How long entries of each type are fresh, and how long they are held after that, in milliseconds; what
# people search for and what they play is not held.
HOUR = 3_600_000
POLICY = {"profile": 24 * HOUR, "playlists": 72 * HOUR, "tracks": 72 * HOUR, "followers": 24 * HOUR, "search": 5 * 60_000, "streams": 30 * 60_000}
HELD, NOT_HELD = 90 * 24 * HOUR, ("search", "streams")


def ttl_of(kind: Column) -> Column:
    """How long an entry of that type is fresh; null of an unknown one."""
    return F.create_map(*[F.lit(x) for pair in POLICY.items() for x in pair])[kind]


def held_of(kind: Column) -> Column:
    """How long it is held after that."""
    return F.when(kind.isin(*NOT_HELD), 0).when(kind.isin(*POLICY), HELD)


def seeded(lists: DataFrame, kind: str, sizes: tuple[int, ...] = (50, 200)) -> DataFrame:
    """Sets (key, value, type, at, ttl) of what a visit has fetched anyway: lists (id, items, at) under the key of each
    size that is asked for, cut to it. value is JSON."""
    told = lists.select("id", "items", "at", F.explode(F.array(*[F.lit(n) for n in sizes])).alias("n"))
    value = F.to_json(F.struct(F.slice("items", F.lit(1), F.col("n")).alias("collection")))
    return told.select(F.concat_ws(":", F.lit(kind), "id", "n").alias("key"), value.alias("value"), F.lit(kind).alias("type"), "at", F.lit(POLICY[kind]).alias("ttl"))


def latest(sets: DataFrame, stale_ms: int = 0) -> DataFrame:
    """One row per key of sets (key, value, type, at, ttl): a ttl of none is five minutes; created_at is the first."""
    ttl = F.when(F.coalesce("ttl", F.lit(0)) > 0, F.col("ttl")).otherwise(F.lit(300_000))
    fresh = F.col("at") + ttl
    told = sets.withColumn("fresh_until", fresh).withColumn("expires_at", F.col("fresh_until") + stale_ms)
    return told.groupBy("key").agg(
        F.max_by(F.struct("value", "type", "fresh_until", "expires_at"), F.struct("at", "value")).alias("e"), F.min("at").alias("created_at"), F.max("at").alias("updated_at")
    ).select("key", "e.*", "created_at", "updated_at")


def state(now: int) -> Column:
    """fresh, stale or miss of an entry."""
    return F.when(F.coalesce("fresh_until", "expires_at") > now, "fresh").when(F.col("expires_at") > now, "stale").otherwise("miss")


def stats(reads: DataFrame) -> DataFrame:
    """(type, hits, misses, last_access) of reads (type, hit, at)."""
    return reads.groupBy("type").agg(F.count_if(F.col("hit")).alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.max("at").alias("last_access"))


def retained(entries: DataFrame, now: int) -> DataFrame:
    """Entries that are still held, fresh or not."""
    return entries.where(F.col("expires_at") > now)


def without(entries: DataFrame, keys: DataFrame | None = None, kind: str | None = None) -> DataFrame:
    """Entries that are left when those of some keys (key), or of one type, are deleted."""
    left = entries if keys is None else entries.join(keys.select("key"), "key", "left_anti")
    return left if kind is None else left.where(~F.col("type").eqNullSafe(F.lit(kind)))


def due(urns: DataFrame, failures: DataFrame, now: int, hours: int = 6) -> DataFrame:
    """Urns without a failure (urn, at) in the hours before now."""
    return urns.join(failures.where(F.col("at") > now - hours * 3_600_000).select("urn"), "urn", "left_anti")
