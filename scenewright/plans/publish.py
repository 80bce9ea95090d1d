"""What a run leaves for its readers: all tables of one version of the store, or none of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenewright.functions.text import rounded
from scenewright.operators import browse, rollup
from scenewright.sources.store import Store, Version

ROSTER, HUBS, GENRES = 24, 12, 3


def ranked_members(members: DataFrame, artists: DataFrame, roster: int = ROSTER, hubs: int = HUBS) -> DataFrame:
    """(scene, kind, place, urn, connections) of members (scene, urn, degree): a scene's artists by their degree in it,
    and its hubs by themselves; accounts known to have no track are left out. connections is the degree at 1 decimal."""
    who = artists.select("urn", F.coalesce("account_kind", F.lit("artist")).alias("kind"), "track_count")
    told = members.join(who, "urn", "left").where("coalesce(track_count, 1) != 0").withColumn("kind", F.coalesce("kind", F.lit("artist")))
    top = browse.first(told, max(roster, hubs), F.desc("degree"), "urn", by=["scene", "kind"])
    kept = top.where(F.col("place") <= F.when(F.col("kind") == "hub", hubs).otherwise(roster))
    return kept.select("scene", "kind", "place", "urn", rounded(F.col("degree"), 1).alias("connections"))


def rosters(members: DataFrame, artists: DataFrame, terms: DataFrame) -> DataFrame:
    """(scene, roster, hubs): arrays of what a page shows of each account, counts that are not known as 0."""
    others = browse.first(rollup.memberships(terms), GENRES, F.desc("evidence"), "fold", by=["urn"])
    others = others.groupBy("urn").agg(F.array_sort(F.collect_list(F.struct("place", "fold"))).alias("g")).select("urn", F.transform("g", lambda x: x["fold"]).alias("other_genres"))
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    about = artists.select("urn", "permalink", "city_raw", count("followers"), count("plays"), count("likes"), count("comments"), "track_count", "last_upload_at")
    told = ranked_members(members, artists).join(about, "urn", "left").join(others, "urn", "left")
    none = F.array().cast("array<string>")
    entry = F.struct("place", "urn", "permalink", "city_raw", "connections", "followers", "plays", "likes", "comments", "track_count", "last_upload_at", F.coalesce("other_genres", none).alias("other_genres"))
    listed = lambda of: F.array_sort(F.collect_list(F.when((F.col("kind") == "hub") == F.lit(of == "hub"), entry)))  # noqa: E731  at most ROSTER and HUBS
    return told.groupBy("scene").agg(listed("artist").alias("roster"), listed("hub").alias("hubs"))


def scene_tables(scenes: DataFrame, members: DataFrame, artists: DataFrame, terms: DataFrame, resolution: float | None, at: Column) -> dict[str, tuple[DataFrame, list[str]]]:
    """The tables of a scene batch with their keys: scenes (scene, name, slug, tags, ...) with counts and rosters, their
    members with degrees at 3 decimals, and the kind of every account."""
    hubs = artists.where("account_kind = 'hub' and track_count > 0").select("urn", F.lit(1).alias("_hub"))
    counts = members.join(hubs, "urn", "left").groupBy("scene").agg(F.count("*").alias("total_count"), F.count("_hub").alias("hub_count"))
    told = scenes.drop("total_count", "hub_count", "roster", "hubs", "resolution", "computed_at").join(counts, "scene", "left").join(rosters(members, artists, terms), "scene", "left")
    return {
        "scenes": (told.withColumn("resolution", F.lit(resolution).cast("double")).withColumn("computed_at", at), ["scene"]),
        "scene_members": (members.select("scene", "urn", rounded(F.col("degree"), 3).alias("degree")), ["scene"]),
        "account_kinds": (artists.select("urn", F.coalesce("account_kind", F.lit("artist")).alias("kind")), ["urn"]),
    }


def browse_tables(terms: DataFrame, artists: DataFrame, at: Column) -> dict[str, tuple[DataFrame, list[str]]]:
    """The tables of the rollup with their keys, each row with the run's instant."""
    stamped = lambda df: df.withColumn("aggregated_at", at)
    return {
        "genres": (stamped(rollup.genres(terms)), ["fold"]),
        "cities": (stamped(rollup.cities(artists)), ["city"]),
        "artist_genres": (stamped(rollup.memberships(terms)), ["urn"]),
        "artist_cities": (stamped(rollup.city_of(artists)), ["urn"]),
        "genre_city": (stamped(rollup.cross_tab(terms, artists)), ["fold"]),
        "rosters": (stamped(rollup.roster(terms, artists)), ["fold"]),
    }


def publish(store: Store, tables: dict[str, tuple[DataFrame, list[str]]], buckets: int = 16) -> Version:
    """Replace all the tables in one version of the store: run again, it makes equal tables; killed before its end, it
    leaves those before it."""
    return store.publish(tables, buckets)


def previous_members(store: Store) -> DataFrame:
    """(id, member) of the scenes that the store has, hidden ones included: what the next run's ids are matched with.
    Empty where none was published yet."""
    version = store.version()
    if "scene_members" not in version.tables:
        return store.spark.createDataFrame([], "id long, member string")
    return store.read("scene_members", version).select(F.col("scene").alias("id"), F.col("urn").alias("member"))
