"""Records as they come from outside, nested and with gaps, to the tables and lists that the rest reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenewright.functions.text import urn_to_id

# How accounts, tracks and playlists are named; fixed values: what makes a playlist an album, and the fields that a raw
# record may have.
PREFIX = {"user": "user:", "track": "track:", "playlist": "playlist:"}
ALBUMS = ["album", "ep", "compilation", "single"]
USER = "struct<id:bigint,urn:string,username:string,permalink:string,permalink_url:string,avatar_url:string,followers_count:bigint,track_count:bigint,city:string,country:string>"
TRACK = f"struct<id:bigint,urn:string,title:string,permalink_url:string,artwork_url:string,duration:bigint,playback_count:bigint,favoritings_count:bigint,comment_count:bigint,genre:string,tag_list:string,created_at:string,user:{USER}>"
PLAYLIST = f"struct<id:bigint,urn:string,title:string,permalink_url:string,artwork_url:string,duration:bigint,track_count:bigint,playlist_type:string,tracks:array<{TRACK}>,user:{USER}>"


def urn(kind: str, id_: Column) -> Column:
    """The name of a user, track or playlist by its number."""
    return F.concat(F.lit(PREFIX[kind]), id_.cast("string"))


def _id(raw: Column) -> Column:
    return F.coalesce(raw["id"], urn_to_id(F.coalesce(raw["urn"], F.lit("")))).alias("id")


def _text(raw: Column, name: str) -> Column:
    return F.coalesce(raw[name], F.lit("")).alias(name)


def _count(raw: Column, name: str) -> Column:
    return F.coalesce(raw[name], F.lit(0)).alias(name)


def user(raw: Column) -> Column:
    """A raw user as the tables have it: what must be there is, empty or 0."""
    given = [raw["avatar_url"].alias("avatar_url"), raw["city"].alias("city"), raw["country"].alias("country_code")]
    return F.struct(_id(raw), _text(raw, "permalink"), _text(raw, "username"), _text(raw, "permalink_url"), _count(raw, "followers_count"), _count(raw, "track_count"), *given)


def embedded_user(raw: Column) -> Column:
    return F.struct(_id(raw), _text(raw, "username"), _text(raw, "permalink_url"), raw["avatar_url"].alias("avatar_url"))


def track(raw: Column) -> Column:
    """A raw track; counts that it lacks stay null, its user is there in any case."""
    given = [raw[c].alias(c) for c in ("artwork_url", "playback_count", "comment_count", "genre", "tag_list", "created_at")]
    return F.struct(_id(raw), _text(raw, "title"), _text(raw, "permalink_url"), _count(raw, "duration"), raw["favoritings_count"].alias("likes_count"), *given, embedded_user(raw["user"]).alias("user"))


def playlist(raw: Column) -> Column:
    """A raw playlist with its tracks; set_type is in lower case, and says whether it is an album."""
    kind = F.lower(raw["playlist_type"])
    tracks = F.transform(raw["tracks"], track).alias("tracks")
    return F.struct(
        _id(raw), _text(raw, "title"), _text(raw, "permalink_url"), raw["artwork_url"].alias("artwork_url"), _count(raw, "duration"), _count(raw, "track_count"),
        F.coalesce(kind.isin(ALBUMS), F.lit(False)).alias("is_album"), kind.alias("set_type"), tracks, embedded_user(raw["user"]).alias("user"),
    )


def read_json(json: Column, kind: str) -> Column:
    """A record of JSON text; null where it is no object. Fields that the record lacks are null, others are left out."""
    return F.from_json(json, {"user": USER, "track": TRACK, "playlist": PLAYLIST}[kind], {"mode": "PERMISSIVE"})


def _lacking(t: Column) -> Column:
    return (t["title"] == "") | (t["duration"] == 0) | (t["user"]["username"] == "")


def completed(playlists: DataFrame, known: DataFrame) -> DataFrame:
    """playlists (id, tracks, ...) whose tracks that lack a title, a length or a user's name are taken from known (id,
    track), in the places that they had. A track without a title after that, or of the number 0, is left out; of known
    tracks that repeat an id, the least counts. A null list stays null, an empty one empty. Ids of playlists are
    distinct."""
    once = known.groupBy(F.col("id").alias("_id")).agg(F.min("track").alias("_known"))
    rest = [c for c in playlists.columns if c != "tracks"]
    row = F.struct(F.col("tracks").isNotNull().alias("_list"), *rest)
    each = playlists.select(F.col("id").alias("_of"), row.alias("_row"), F.posexplode_outer("tracks").alias("_at", "_track"))
    each = each.withColumn("_row", F.when(F.coalesce("_at", F.lit(0)) == 0, F.col("_row")))  # goes with the first track
    told = each.join(once, F.col("_track.id") == F.col("_id"), "left")
    better = F.when(_lacking(F.col("_track")), F.coalesce("_known", "_track")).otherwise(F.col("_track"))
    told = told.withColumn("_track", better)
    good = F.when((F.col("_track.title") != "") & (F.col("_track.id") != 0), F.struct("_at", "_track"))
    again = told.groupBy("_of").agg(F.collect_list("_row").alias("_row"), F.array_sort(F.collect_list(good)).alias("_tracks"))
    again = again.withColumn("_row", F.explode("_row"))
    full = F.when(F.col("_row._list"), F.transform("_tracks", lambda x: x["_track"])).alias("tracks")
    return again.select(*[full if c == "tracks" else F.col("_row")[c].alias(c) for c in playlists.columns])


def valid_tracks(tracks: Column) -> Column:
    """The tracks of a list that have an id and a title; null has none."""
    return F.filter(F.coalesce(tracks, F.array()), lambda t: (t["id"] != 0) & (t["title"] != ""))


def total_plays(tracks: Column) -> Column:
    """What an album's tracks were played together."""
    return F.aggregate(F.coalesce(tracks, F.array()), F.lit(0).cast("long"), lambda s, t: s + F.coalesce(t["playback_count"], F.lit(0)))


def engagement_of_cache(cached: DataFrame, artists: DataFrame) -> DataFrame:
    """(urn, plays, likes, comments) of the artists (urn) from retained cache rows (value: a JSON list of raw tracks),
    nothing fetched: each track once, nulls as 0, tracks of other accounts left out. Text that is no list has none."""
    tracks = cached.select(F.explode(F.from_json("value", f"array<{TRACK}>")).alias("raw")).where("raw is not null").select(track(F.col("raw")).alias("t")).where("t.id != 0")
    once = tracks.groupBy("t.id").agg(F.max("t").alias("t")).select(urn("user", F.col("t.user.id")).alias("urn"), "t")
    n = lambda c, name: F.sum(F.coalesce(f"t.{c}", F.lit(0))).alias(name)
    return once.join(artists.select("urn").distinct(), "urn", "left_semi").groupBy("urn").agg(n("playback_count", "plays"), n("likes_count", "likes"), n("comment_count", "comments"))


def interleaved(groups: DataFrame, page: str = "page") -> DataFrame:
    """(page, place, urn) of groups (page, group, at, urn): the first of every group, then the second of every one, and so
    on; what comes again stands where it came first. A page is a list that is shown, so it is ranked in one task."""
    first = groups.where("urn is not null").groupBy(page, "urn").agg(F.min(F.struct("at", "group")).alias("_first"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(page).orderBy("_first"))).select(page, "place", "urn")


def avatars(listed: DataFrame, cached: DataFrame, page: str = "page", budget: int | None = None) -> DataFrame:
    """listed (page, place, urn) with avatar and ask: the image that the cache (urn, avatar_url) holds, and for those that
    it does not know whether they are asked for: the first `budget` of each page (None: all)."""
    known = cached.groupBy("urn").agg(F.max("avatar_url").alias("avatar"), F.lit(True).alias("_known"))
    told = listed.join(known, "urn", "left")
    turn = F.row_number().over(Window.partitionBy(page, F.col("_known").isNull()).orderBy("place"))
    ask = F.col("_known").isNull() if budget is None else F.col("_known").isNull() & (turn <= budget)
    return told.withColumn("ask", ask).select(page, "place", "urn", "avatar", "ask")


def from_clicked(items: Column, clicked: Column) -> Column:
    """A list that begins with the item at the place clicked, counted from 0; what stood before it comes last. A place
    outside the list leaves it as it is."""
    n = F.size(items)
    inside = (clicked >= 0) & (clicked < n)
    turned = F.concat(F.slice(items, clicked + 1, n), F.slice(items, F.lit(1), clicked))
    return F.when(inside, turned).otherwise(items)
