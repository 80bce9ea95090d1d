"""Which accounts are institutions and not artists, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenewright.functions.text import unstyled

TRACK_THRESHOLD = 1000

# What a profile's description says if the account is an institution.
DESCRIPTION = [
    r"record ?label",
    r"net-?label",
    r"label (based|from|founded|run)",
    r"independent label",
    r"\bimprint\b",
    r"(demo|track) submissions?",
    r"submit (your )?demos?",
    r"send (us )?(your )?demos?",
    r"sello discogr",
    r"plattenlabel",
    r"record company",
    r"va compilations?",
    r"(music|techno|electronic|dance|arts?) festival\b",
    r"festival (based|founded|series|for|takes place)",
    r"(techno|music) club\b(?! night)",
    r"club (based|located) in",
    r"platform (for|dedicated|showcasing)",
    r"(music|youtube) channel",
    r"premiere (inquiries|submissions?|enquiries)",
    r"premieres?, demos",
    r"demos and inquiries",
    r"\borgani[sz]ation\b",
    r"is an? .{0,20}radio show",
    r"podcast series",
    r"\bcurat(ion|or|orship)",
    r"curated .{0,30}(radio|show|platform|selection|channel|series|playlist)",
    r"curated by",
    r"\b(mix|premiere|mixtape|radio) series\b",
    r"series (focused|dedicated|where)",
    r"(music|electronic|independent|house|techno|disco|bass|dance) ?(music )?label",
    r"label by\b",
    r"music company",
    r"record shop",
    r"no demos\b",
    r"demos? (→|to:|via|through)",
    r"weekly podcast",
    r"podcast (since|and)\b",
    r"is run by @",
    r"online publication",
    r"publication (offering|dedicated)",
    r"magazine (en ligne|based)",
    r"submit (a|your|us)\b",
    r"delivery service",
    r"(music|techno) movement",
    r"series of events",
    r"collective label",
    r"(\b|/)demos? .{0,15}@",
    r"platform to (share|discover)",
    r"emerging talents?",
    r"premieres?, (demos|mixes)",
    r"label,? (vinyl|cassette)",
    r"independent radio",
    r"division of",
    r"is now an archive",
    r"archive showcasing",
    r"event series",
    r"events? (company|agency|brand|platform|collective)",
    r"party series",
    r"club night\b",
    r"concert series",
    r"(music|media|streaming) platform",
    r"(music|culture|online|arts?) magazine",
    r"music blog",
    r"webzine",
    r"(booking|artist|management) agency",
    r"community radio",
    r"radio (station|network)",
    r"web ?radio",
    r"\bnightclub\b",
    r"record store",
    r"vinyl shop",
    r"music distribution",
    r"distribution specialists?",
]

# Words that end an institution's name, and its permalink.
NAME_WORDS = "records recordings recs tapes editions imprint musik discos label collective soundsystem agency magazine radio fm distribution podcast sessions festival premieres".split()
PERMALINK_WORDS = "records recordings recs label tapes podcast radio radioshow magazine collective festival soundsystem distribution premieres events series media".split()


def described_as_hub(description: Column) -> Column:
    """Whether a description, in plain letters, speaks of an institution."""
    return F.rlike(unstyled(F.coalesce(description, F.lit(""))), F.lit("(?i)" + "|".join(DESCRIPTION)))


def named_as_hub(name: Column) -> Column:
    """A name that ends, in plain letters, in a label word, without brackets, slash, bar or middle dot before it. The
    word's edge is written out, as an ASCII one is meant."""
    plain = F.trim(unstyled(F.coalesce(name, F.lit(""))))
    return F.rlike(plain, F.lit(r"(?i)^(?:[^\[\]/|·]*[^\[\]/|·A-Za-z0-9_])?(?:" + "|".join(NAME_WORDS) + r")\s*$"))


def permalink_of_hub(permalink: Column) -> Column:
    return F.rlike(F.coalesce(permalink, F.lit("")), F.lit("(?i)(?:" + "|".join(PERMALINK_WORDS) + ")$"))


#: A title's part before a dash between blanks.
TITLE_PREFIX = r"^(.{2,40}?)\s+[-–—]\s+"


def _many(dashed: Column, different: Column) -> Column:
    return (dashed >= 10) & (different >= 15) & (different / dashed >= 0.7)


def channels_by_titles(titles: DataFrame) -> DataFrame:
    """(urn) of those whose titles (urn, title) name many different others: `someone - something`."""
    prefix = F.trim(F.lower(F.regexp_extract("title", TITLE_PREFIX, 1)))
    told = titles.where(F.rlike("title", F.lit(TITLE_PREFIX))).groupBy("urn").agg(F.count("*").alias("dashed"), F.count_distinct(prefix).alias("n"))
    return told.where(_many(F.col("dashed"), F.col("n"))).select("urn")


def titles_of_channel(titles: Column) -> Column:
    """The same of an account's array of titles. Null has none."""
    dashed = F.filter(F.coalesce(titles, F.array().cast("array<string>")), lambda t: F.coalesce(F.rlike(t, F.lit(TITLE_PREFIX)), F.lit(False)))
    prefixes = F.array_distinct(F.transform(dashed, lambda t: F.trim(F.lower(F.regexp_extract(t, TITLE_PREFIX, 1)))))
    return _many(F.size(dashed), F.size(prefixes))


def is_hub(
    permalink: Column, track_count: Column, description: Column, name: Column, hubs: list[str] = (), artists: list[str] = (), titles: Column | None = None
) -> Column:
    """Listed artists are none; else many tracks, a listed or telling permalink, or the profile's text or titles decide."""
    low = F.lower(F.coalesce(permalink, F.lit("")))
    told = permalink_of_hub(permalink) | described_as_hub(description) | named_as_hub(name)
    return (
        F.when(low.isin([a.lower() for a in artists]) & (low != ""), False)
        .when(F.coalesce(track_count, F.lit(0)) >= TRACK_THRESHOLD, True)
        .when(low.isin([h.lower() for h in hubs]) & (low != ""), True)
        .otherwise(told if titles is None else told | titles_of_channel(titles))
    )


def classified(artists: DataFrame, profiles: DataFrame, titles: DataFrame, canon: DataFrame) -> DataFrame:
    """artists (urn, permalink, track_count, ...) with account_kind, hub or artist.

    profiles (urn, username, description) and titles (urn, title) are of some of them; canon (kind, name) lists hubs and
    artists by permalink, in lower case, as files.account_canon reads it. The lists may be long: they are joined."""
    listed = canon.where("kind in ('hub', 'artist')").groupBy(F.col("name").alias("_name")).agg(F.max(F.when(F.col("kind") == "artist", 1)).alias("_artist"), F.max(F.when(F.col("kind") == "hub", 1)).alias("_hub"))
    told = artists.drop("account_kind").withColumn("_name", F.lower("permalink")).join(listed, "_name", "left")
    told = told.join(profiles.select("urn", F.col("username").alias("_username"), F.col("description").alias("_description")), "urn", "left")
    told = told.join(channels_by_titles(titles).withColumn("_channel", F.lit(True)), "urn", "left")
    text = permalink_of_hub(F.col("permalink")) | described_as_hub(F.col("_description")) | named_as_hub(F.col("_username")) | F.coalesce("_channel", F.lit(False))
    hub = F.when(F.col("_artist") == 1, False).when(F.coalesce("track_count", F.lit(0)) >= TRACK_THRESHOLD, True).when(F.col("_hub") == 1, True).otherwise(text)
    return told.withColumn("account_kind", F.when(hub, "hub").otherwise("artist")).drop("_name", "_artist", "_hub", "_username", "_description", "_channel")


def moved_late(rosters: DataFrame) -> DataFrame:
    """rosters (scene, kind, place, urn, name) in which accounts whose shown name is an institution's stand behind the
    hubs, in the order that they had; places are given out anew in both lists."""
    late = (F.col("kind") == "artist") & named_as_hub(F.col("name"))
    told = rosters.withColumn("_late", late).withColumn("kind", F.when(late, "hub").otherwise(F.col("kind")))
    order = Window.partitionBy("scene", "kind").orderBy("_late", "place", "urn")
    return told.withColumn("place", F.row_number().over(order)).drop("_late")
