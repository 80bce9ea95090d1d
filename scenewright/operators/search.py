"""Search: matching, relevance, quality, type-first order, quick jumps, interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenewright.functions.text import similarity


def _lower(query: str | Column) -> Column:
    return F.lower(F.lit(query) if isinstance(query, str) else query)


def matches(query: str | Column, title: Column, owner: Column) -> Column:
    q = _lower(query)
    one = lambda x: F.contains(F.lower(x), q) | (similarity(F.lower(x), q) > 0.7)
    return one(F.coalesce(title, F.lit(""))) | one(F.coalesce(owner, F.lit("")))


def relevance(query: str | Column, title: Column, owner: Column, followers: Column, likes: Column, plays: Column) -> Column:
    q = _lower(query)

    def text(x: Column) -> Column:
        x = F.lower(F.coalesce(x, F.lit("")))
        return F.when(F.startswith(x, q), 100).otherwise(0) + F.when(F.contains(x, q), 50).otherwise(0) + 30 * similarity(x, q)

    reach = lambda n: F.log10(F.coalesce(n, F.lit(0)) + 1)
    return text(title) + text(owner) + 5 * reach(followers) + 2 * reach(likes) + 2 * reach(plays)


def quality(kind: Column, image: Column, followers: Column, tracks: Column, plays: Column) -> Column:
    """Users with an image, ten followers or a track; tracks with an image or a thousand plays; playlists with an image
    or three tracks; anything else."""
    has = image.isNotNull()
    n = lambda c: F.coalesce(c, F.lit(0))
    return (
        F.when(kind == "user", has | (n(followers) >= 10) | (n(tracks) >= 1))
        .when(kind == "track", has | (n(plays) >= 1000))
        .when(kind == "playlist", has | (n(tracks) >= 3))
        .otherwise(F.lit(True))
    )


def type_first(results: DataFrame, limit: int) -> DataFrame:
    """Users first, then what has an image, tracks before playlists, by reach, by id."""
    reach = F.when(F.col("kind") == "user", F.col("followers")).when(F.col("kind") == "track", F.col("plays")).otherwise(F.col("likes"))
    order = [F.desc(F.col("kind") == "user"), F.desc(F.col("image").isNotNull()), F.desc(F.col("kind") == "track"), F.desc_nulls_last(reach), F.asc("id")]
    return results.orderBy(*order).limit(limit)


def quick_jumps(names: DataFrame, query: str, limit: int = 4) -> DataFrame:
    """Names that begin with the query, then those that contain it, each in index order."""
    if len(query) < 2:
        return names.limit(0)
    low = F.lower("name")
    found = names.where(F.contains(low, F.lit(query.lower()))).withColumn("prefix", F.startswith(low, F.lit(query.lower())))
    return found.orderBy(F.desc("prefix"), "ord").limit(limit).drop("prefix")


def interleaved(tracks: DataFrame, per_artist: int = 4, limit: int = 40) -> DataFrame:
    """Round-robin over ranked artists: every artist's first track, then every one's second, each track once."""
    once = Window.partitionBy("track").orderBy("artist_rank", "position")
    unique = tracks.withColumn("at", F.row_number().over(once)).where("at = 1").drop("at")
    turn = Window.partitionBy("artist_rank").orderBy("position", "track")
    told = unique.withColumn("round", F.row_number().over(turn)).where(F.col("round") <= per_artist)
    return told.orderBy("round", "artist_rank", "track").limit(limit)


def playable(t: DataFrame) -> Column:
    """A track that can be played: named, linked, of some length, not blocked, streamable or at least previewed."""
    there = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    blocked = F.coalesce(F.col("access") == "blocked", F.lit(False))
    closed = (F.coalesce("streamable", F.lit(True)) == F.lit(False)) & ~F.coalesce(F.col("access") == "preview", F.lit(False))
    return there("id") & there("title") & there("permalink_url") & (F.coalesce("duration", F.lit(0)) > 0) & ~blocked & ~closed


def federated(users: DataFrame, tracks: DataFrame, playlists: DataFrame, only: str | None = None) -> DataFrame:
    """(kind, ...) of what was found: one resource (users, tracks, playlists, or albums: the playlists that are), or users,
    tracks and playlists as one list. Columns that a kind lacks are null."""
    parts = {"users": ("user", users), "tracks": ("track", tracks), "playlists": ("playlist", playlists.drop("is_album")), "albums": ("album", playlists.where("is_album").drop("is_album"))}
    out = None
    for name in [only] if only else ["users", "tracks", "playlists"]:
        kind, df = parts[name]
        told = df.withColumn("kind", F.lit(kind))
        out = told if out is None else out.unionByName(told, allowMissingColumns=True)
    return out
