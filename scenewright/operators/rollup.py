"""Genres and places: canonical terms, thresholds, cross-tabs, affinities, rosters."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenewright.functions.text import fold_term, slugify, title_case
from scenewright.operators.tables import written


@dataclass(frozen=True)
class Config:
    """Thresholds; those that the survey calls undetermined are choices of this engine."""

    min_genre_artists: int = 2
    min_city_artists: int = 2
    min_tag_evidence: int = 2
    roster_size: int = 12
    preview_genres: int = 2


# Terms that name a format and no sound, and bare function words.
FORMATS = [
    "podcast", "mix", "dj mix", "dj set", "live", "live set", "radio", "radio show", "premiere", "music", "free download", "promo", "demo", "snippet", "preview", "exclusive",
    "mixtape", "mastering", "recording", "interview", "talk", "talkshow", "audiobooks", "business", "comedy", "entertainment", "learning", "news & politics", "religion & spirituality",
    "science", "sports", "storytelling", "technology",
]
STOP_WORDS = ["the", "a", "an", "and", "or", "of", "in", "on", "at", "to", "for", "with", "by", "from"]
FORMAT_TERMS = [re.sub("[^a-z0-9]", "", x) for x in FORMATS] + STOP_WORDS

def memberships(terms: DataFrame, config: Config = Config()) -> DataFrame:
    """(urn, fold, evidence): a genre always makes a member, a tag from min_tag_evidence on; format terms don't."""
    kept = terms.where((F.col("kind") == "genre") | (F.col("evidence") >= config.min_tag_evidence))
    sound = lambda x: (x != "") & ~x.isin(FORMAT_TERMS) & ~F.rlike(x, F.lit("^[0-9]+$"))
    kept = kept.select("urn", "evidence", F.explode(F.filter(F.array(fold_term(F.col("term"))), sound)).alias("fold"))  # folded once, not once a condition
    return kept.groupBy("urn", "fold").agg(F.sum("evidence").alias("evidence"))


def dropped_terms(terms: DataFrame, artists: DataFrame, hubs: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """(fold, reason): the terms that are no genre, each with the first reason that holds: `format` for those that name a
    format, a bare word or a number, `city` for the name of a city, `hub` for that of a hub (hubs: fold, in any number)."""
    folds = terms.select(fold_term(F.col("term")).alias("fold")).where("fold != ''").distinct()
    places = city_of(artists).select(F.col("city").alias("fold"), F.lit(True).alias("_city")).distinct()
    told = folds.join(places, "fold", "left")
    if hubs is None:
        hubs = artists.where("account_kind = 'hub'").select(fold_term(F.col("permalink")).alias("fold"))
    told = told.join(hubs.select("fold", F.lit(True).alias("_hub")).distinct(), "fold", "left")
    form = F.col("fold").isin(FORMAT_TERMS) | F.rlike("fold", F.lit("^[0-9]+$"))
    reason = F.when(form, "format").when(F.col("_city"), "city").when(F.col("_hub"), "hub")
    return told.select("fold", reason.alias("reason")).where("reason is not null")


def term_report(terms: DataFrame, artists: DataFrame, hubs: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """(fold, artists, fate) of every term that makes members: `kept` as a genre, `below` the least number of artists, or
    the reason for which it is none. Each term has one row, so they add up to all."""
    kept = terms.where((F.col("kind") == "genre") | (F.col("evidence") >= config.min_tag_evidence)).withColumn("fold", fold_term(F.col("term"))).where("fold != ''")
    n = kept.groupBy("fold").agg(F.count_distinct("urn").alias("artists"))
    told = n.join(dropped_terms(terms, artists, hubs, config), "fold", "left")
    return told.select("fold", "artists", F.coalesce("reason", F.when(F.col("artists") >= config.min_genre_artists, "kept").otherwise("below")).alias("fate"))


def spellings(terms: DataFrame) -> DataFrame:
    """(fold, name): the most voted spelling, a genre counting twice, in title case; ties go by the spelling."""
    votes = terms.groupBy("term").agg(F.sum(F.when(F.col("kind") == "genre", 2).otherwise(1)).alias("votes")).withColumn("fold", fold_term(F.col("term")))
    order = Window.partitionBy("fold").orderBy(F.desc("votes"), "term")
    best = votes.withColumn("at", F.row_number().over(order)).where("at = 1")
    return best.select("fold", title_case(F.lower("term")).alias("name"))


def genre_sizes(terms: DataFrame, config: Config = Config(), own: DataFrame | None = None) -> DataFrame:
    """(fold, artist_count) of the genres with enough artists. own: the memberships, if they are there."""
    n = (memberships(terms, config) if own is None else own).groupBy("fold").agg(F.count("*").alias("artist_count"))
    return n.where(F.col("artist_count") >= config.min_genre_artists)


def genres(terms: DataFrame, config: Config = Config(), own: DataFrame | None = None) -> DataFrame:
    """(slug, name, fold, artist_count) of the genres with enough artists. own: the memberships, if they are there."""
    return genre_sizes(terms, config, own).join(spellings(terms), "fold").withColumn("slug", slugify(F.col("name")))


def below_threshold(terms: DataFrame, config: Config = Config()) -> DataFrame:
    n = memberships(terms, config).groupBy("fold").agg(F.count("*").alias("artists"))
    return n.where(F.col("artists") < config.min_genre_artists).select(F.col("fold").alias("term"), "artists")


def city_of(artists: DataFrame, none: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """(urn, city, spelling, country): the part before the first comma, by its alias if it has one, folded. What is no
    place is left out. none (fold) and aliases (fold, city) are a canon, as files.city_canon reads it; without, every
    spelling stands for itself."""
    given = F.trim(F.element_at(F.split("city_raw", ","), 1))
    told = artists.where("city_raw is not null").select("urn", given.alias("spelling"), "country").withColumn("_given", fold_term(F.col("spelling"))).where("_given != ''")
    if none is not None:
        told = told.join(none.select(F.col("fold").alias("_given")).distinct(), "_given", "left_anti")
    if aliases is not None:
        named = aliases.groupBy(F.col("fold").alias("_given")).agg(F.min("city").alias("_named"))
        told = told.join(named, "_given", "left").withColumn("spelling", F.coalesce("_named", "spelling")).drop("_named")
    return told.select("urn", fold_term(F.col("spelling")).alias("city"), "spelling", "country")


def cities(artists: DataFrame, config: Config = Config(), none: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """(city, name, country, artist_count): spelling and country by majority, ties by the value; the canon as in
    city_of()."""
    own = city_of(artists, none, aliases)
    n = own.groupBy("city").agg(F.count("*").alias("artist_count")).where(F.col("artist_count") >= config.min_city_artists)

    def voted(column: str) -> DataFrame:
        order = Window.partitionBy("city").orderBy(F.desc("n"), column)
        votes = own.where(F.col(column).isNotNull()).groupBy("city", column).agg(F.count("*").alias("n"))
        return votes.withColumn("at", F.row_number().over(order)).where("at = 1").select("city", column)

    named = n.join(voted("spelling"), "city").join(voted("country"), "city", "left")
    return named.select("city", title_case(F.lower("spelling")).alias("name"), "country", "artist_count")


def cross_tab(terms: DataFrame, artists: DataFrame, config: Config = Config()) -> DataFrame:
    """(fold, city, artist_count) of artists in both."""
    return memberships(terms, config).join(city_of(artists), "urn").groupBy("fold", "city").agg(F.count_distinct("urn").alias("artist_count"))


def top_city(terms: DataFrame, artists: DataFrame, config: Config = Config()) -> DataFrame:
    order = Window.partitionBy("fold").orderBy(F.desc("artist_count"), "city")
    return cross_tab(terms, artists, config).withColumn("at", F.row_number().over(order)).where("at = 1").drop("at")


def related(terms: DataFrame, config: Config = Config()) -> DataFrame:
    """(fold, other, shared, affinity): genres that share artists, by the Jaccard measure of their artists.

    The self-join is on the artist, whose genres are few; its size is the sum of their squares."""
    own = written(memberships(terms, config).select("urn", "fold"))  # read four times
    n = own.groupBy("fold").agg(F.count("*").alias("n"))
    shared = own.join(own.withColumnRenamed("fold", "other"), "urn").where("fold != other").groupBy("fold", "other").agg(F.count("*").alias("shared"))
    both = shared.join(n, "fold").join(n.select(F.col("fold").alias("other"), F.col("n").alias("m")), "other")
    return both.select("fold", "other", "shared", (F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))).alias("affinity"))


def activity_of(members: DataFrame, artists: DataFrame, key: str, value, now) -> DataFrame:
    """(day, week) of one group of members: one row, of zeros where nobody has uploaded."""
    mine = members.where(F.col(key) == value)
    told = activity(mine, artists, key, now)
    return told.agg(F.coalesce(F.sum("day"), F.lit(0)).alias("day"), F.coalesce(F.sum("week"), F.lit(0)).alias("week"))


REACH = ["followers", "impact", "plays"]


def roster(terms: DataFrame, artists: DataFrame, config: Config = Config()) -> DataFrame:
    """(fold, rank, urn, followers, impact, plays): a genre's leading artists, each shown under its top genres only."""
    own = memberships(terms, config)
    top = Window.partitionBy("urn").orderBy(F.desc("evidence"), "fold")
    shown = own.withColumn("at", F.row_number().over(top)).where(F.col("at") <= config.preview_genres)
    told = shown.join(artists.select("urn", "followers", (F.col("likes") + F.col("comments")).alias("impact"), "plays"), "urn")
    order = Window.partitionBy("fold").orderBy(*[F.desc(c) for c in REACH], "urn")
    return told.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.roster_size).select("fold", "rank", "urn", *REACH)


def activity(members: DataFrame, artists: DataFrame, key: str, now) -> DataFrame:
    """(key, day, week): members whose last upload is within a day and a week of now."""
    fresh = artists.where(F.col("last_upload_at") > now - F.expr("interval 7 days")).select("urn", "last_upload_at")
    day = F.count_if(F.col("last_upload_at") > now - F.expr("interval 1 day"))
    return members.join(fresh, "urn").groupBy(key).agg(day.alias("day"), F.count("*").alias("week"))
