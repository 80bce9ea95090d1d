"""Counts, orders and lists of the read side over terms, accounts, ties and scene members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenewright.operators.browse import first

def by_reach() -> list[Column]:
    """The order of accounts by followers, then likes and comments, then plays, nulls as 0, then urn."""
    n = lambda c: F.coalesce(c, F.lit(0))
    return [F.desc(n(F.col("followers"))), F.desc(n(F.col("likes") + F.col("comments"))), F.desc(n(F.col("plays"))), F.asc("urn")]


def sizes(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name) of each group, the largest first, of equal ones by the key."""
    return df.groupBy(key).agg(F.count("*").alias(name)).orderBy(F.desc(name), key)


def members_of_terms(terms: DataFrame, artists: DataFrame) -> DataFrame:
    """(term, members, reach): who declares a term, and how many follow them together."""
    told = terms.join(artists.select("urn", "followers"), "urn")
    return told.groupBy("term").agg(F.count("*").alias("members"), F.sum("followers").alias("reach"))


def without_hubs(terms: DataFrame, artists: DataFrame) -> DataFrame:
    return terms.join(artists.where("account_kind = 'hub'").select("urn"), "urn", "left_anti")


def ties(edges: DataFrame) -> DataFrame:
    """(urn, ties): edges at either end; one to oneself counts once. The ends are listed, as a join on either would pair
    all with all."""
    ends = edges.select(F.explode(F.when(F.col("src") == F.col("dst"), F.array("src")).otherwise(F.array("src", "dst"))).alias("urn"))
    return ends.groupBy("urn").agg(F.count("*").alias("ties"))


def named(df: DataFrame, names: DataFrame) -> DataFrame:
    """df (urn) with the name of names (urn, name), or the urn itself."""
    return df.join(names.select("urn", F.col("name").alias("_name")), "urn", "left").withColumn("name", F.coalesce("_name", "urn")).drop("_name")


def first_source(*sources: DataFrame) -> DataFrame:
    """(urn, place): each urn of the sources (urn) with the number of the first that has it, from 1."""
    out = None
    for place, df in enumerate(sources, 1):
        told = df.select("urn", F.lit(place).alias("place"))
        out = told if out is None else out.unionByName(told)
    return out.groupBy("urn").agg(F.min("place").alias("place"))


def support(terms: DataFrame, members: DataFrame) -> DataFrame:
    """(scene, term, support): how many members (scene, urn) carry a term, whatever its kind."""
    carried = terms.select("urn", "term").distinct().join(members.select("scene", "urn"), "urn")
    return carried.groupBy("scene", "term").agg(F.count_distinct("urn").alias("support"))


def document_frequency(terms: DataFrame, members: DataFrame) -> DataFrame:
    """(term, df): in how many scenes a term has any evidence. Terms of no scene count 0."""
    told = terms.where("evidence > 0").join(members.select("scene", "urn"), "urn", "left")
    return told.groupBy("term").agg(F.count_distinct("scene").alias("df"))


def scenes_of_term(terms: DataFrame, members: DataFrame, term: str, n: int = 6) -> DataFrame:
    """(scene, n) of the scenes where a term comes most often."""
    told = terms.where(F.col("term") == term).join(members, "urn").groupBy("scene").agg(F.count("*").alias("n"))
    return told.orderBy(F.desc("n"), "scene").limit(n)


def crawled_and_hubs(members: DataFrame, artists: DataFrame) -> DataFrame:
    """(scene, crawled, hubs) of members (scene, urn)."""
    told = members.join(artists.select("urn", "last_upload_at", "account_kind"), "urn")
    return told.groupBy("scene").agg(F.count("last_upload_at").alias("crawled"), F.count_if(F.col("account_kind") == "hub").alias("hubs"))


def top_share(members: DataFrame, what: str) -> DataFrame:
    """(scene, <what>, n, share): what most members (scene, <what>) have, and its share of them."""
    counts = members.groupBy("scene", what).agg(F.count("*").alias("n"))
    total = counts.groupBy("scene").agg(F.sum("n").alias("total"))
    return first(counts, 1, F.desc("n"), what, by=["scene"]).join(total, "scene").select("scene", what, "n", (F.col("n") / F.col("total")).alias("share"))


def status(artists: DataFrame) -> DataFrame:
    """One row: artists, cities and hubs."""
    return artists.agg(F.count("*").alias("artists"), F.count_distinct("city_raw").alias("cities"), F.count_if(F.col("account_kind") == "hub").alias("hubs"))


def tagged(**parts: tuple[DataFrame, str]) -> DataFrame:
    """(kind, name, n) of parts: each a table and the column that names its entries, counted."""
    out = None
    for kind, (df, column) in parts.items():
        told = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
        out = told if out is None else out.unionByName(told)
    return out


def presence(terms: DataFrame, artists: DataFrame, members: DataFrame, sounds: int = 4) -> DataFrame:
    """(urn, kind, name, evidence): each account's leading sounds, its place and its scene."""
    own = first(terms.where("kind = 'genre'"), sounds, F.desc("evidence"), "term", by=["urn"]).select("urn", F.lit("sound").alias("kind"), F.col("term").alias("name"), "evidence")
    one = lambda df, kind, name: df.select("urn", F.lit(kind).alias("kind"), F.col(name).alias("name"), F.lit(1).cast("long").alias("evidence"))
    return own.unionByName(one(artists, "place", "city_raw")).unionByName(one(members, "scene", "scene"))


def most_played(artists: DataFrame, n: int = 3) -> DataFrame:
    """The n most played; those without plays are left out after that, so there may be fewer."""
    return artists.orderBy(F.desc("plays"), "urn").limit(n).where("plays > 0")


def inbound(artists: DataFrame, edges: DataFrame) -> DataFrame:
    """(urn, priority): how many edges lead to each account."""
    n = edges.groupBy(F.col("dst").alias("urn")).agg(F.count("*").alias("_n"))
    return artists.select("urn").join(n, "urn", "left").select("urn", F.coalesce("_n", F.lit(0)).alias("priority"))
