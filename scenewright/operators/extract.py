"""From landed API records to graph records: follow and repost edges, terms, purchase links, upload time, engagement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenewright.functions.text import parse_tag_list


def follow_edges(followings: DataFrame) -> DataFrame:
    """(src, dst, type, weight) of followings (src, id): accounts without an id and oneself are left."""
    told = followings.where("id is not null and id != 0").select("src", F.concat(F.lit("user:"), F.col("id").cast("string")).alias("dst"))
    return told.where("src != dst").select("src", "dst", F.lit("follow").alias("type"), F.lit(1.0).alias("weight"))


def repost_edges(reposts: DataFrame) -> DataFrame:
    """(src, dst, type, weight) of reposted tracks (src, owner): a track each, grouped by owner."""
    told = reposts.where("owner is not null and owner != 0").select("src", F.concat(F.lit("user:"), F.col("owner").cast("string")).alias("dst"))
    return told.where("src != dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight")).select("src", "dst", F.lit("repost").alias("type"), "weight")


def track_terms(tracks: DataFrame) -> DataFrame:
    """(urn, term, kind, evidence) of tracks (urn, genre, tag_list): one pass makes both kinds of each track."""
    genre = F.lower(F.trim("genre"))
    one = lambda term, kind: F.struct(term.alias("term"), F.lit(kind).alias("kind"))
    found = F.concat(
        F.when(F.length(genre) > 1, F.array(one(genre, "genre"))).otherwise(F.array().cast("array<struct<term:string,kind:string>>")),
        F.transform(parse_tag_list(F.col("tag_list")), lambda t: one(t, "tag")),
    )
    return tracks.select("urn", F.explode(found).alias("t")).groupBy("urn", "t.term", "t.kind").agg(F.count("*").alias("evidence"))


def purchase_links(tracks: DataFrame) -> DataFrame:
    """(urn, url), each once."""
    return tracks.where(F.startswith("purchase_url", F.lit("http"))).select("urn", F.col("purchase_url").alias("url")).distinct()


def upload_time(created: Column) -> Column:
    """ISO 8601 or `2026/01/10 12:00:00 +0000`; anything else is null."""
    return F.coalesce(F.try_to_timestamp(created, F.lit("yyyy/MM/dd HH:mm:ss Z")), created.try_cast("timestamp"))


def engagement(tracks: DataFrame) -> DataFrame:
    """(urn, plays, likes, comments, last_upload_at)."""
    total = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    return tracks.groupBy("urn").agg(
        total("playback_count").alias("plays"), total("likes_count").alias("likes"), total("comment_count").alias("comments"), F.max(upload_time(F.col("created_at"))).alias("last_upload_at")
    )


def next_visits(visited: DataFrame, edges: DataFrame, max_depth: int, followings: int = 600) -> DataFrame:
    """(urn, depth) to enqueue after visits (urn, depth): whom the visited repost, and the first `followings` (by urn) whom
    they follow, one step further, if that is not beyond max_depth. Each once, at its least depth."""
    from pyspark.sql.window import Window

    told = edges.join(visited.where(F.col("depth") < max_depth).select(F.col("urn").alias("src"), "depth"), "src")
    turn = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
    followed = told.where("type = 'follow'").withColumn("_n", turn).where(F.col("_n") <= followings).drop("_n")
    both = told.where("type = 'repost'").select("dst", "depth").unionByName(followed.select("dst", "depth"))
    return both.groupBy(F.col("dst").alias("urn")).agg((F.min("depth") + 1).alias("depth"))


def crawlable(artists: DataFrame) -> DataFrame:
    """The accounts that a crawl visits: those with a track."""
    return artists.where(F.coalesce("track_count", F.lit(0)) >= 1)


def crawl(edges: DataFrame, artists: DataFrame, seeds: list[str], max_depth: int) -> DataFrame:
    """(urn, depth): accounts with a track that edges (src, dst) reach from the seeds, at their least depth.

    Each round joins the frontier alone with the edges; rounds are bounded by max_depth, visits by the accounts."""
    from scenewright.operators.scenes import written

    spark = edges.sparkSession
    can = crawlable(artists).select("urn")
    seen = written(spark.createDataFrame([(s, 0) for s in seeds], "urn string, depth int").join(can, "urn", "left_semi"))
    frontier = seen
    for depth in range(1, max_depth + 1):
        reached = frontier.join(edges, F.col("urn") == F.col("src")).select(F.col("dst").alias("urn")).distinct()
        frontier = written(reached.join(can, "urn", "left_semi").join(seen, "urn", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = written(seen.unionByName(frontier))
    return seen
