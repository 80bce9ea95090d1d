"""Raw records with gaps, nulls and repeats."""

import json

from pyspark.sql import functions as F

from scenewright.operators import records as R
from scenewright.operators import rollup


def test_raw_records_with_gaps(spark):
    raw = [
        '{"urn": "user:9", "username": null, "followers_count": 4, "surprise": [1]}', '{"id": 3, "urn": "user:9", "city": "Rome"}', "{}", "not json", None,
    ]
    df = spark.createDataFrame(list(enumerate(raw)), "n long, value string").withColumn("r", R.read_json(F.col("value"), "user"))
    got = {r.n: r.u and (r.u.id, r.u.username, r.u.followers_count, r.u.city) for r in df.select("n", F.when(F.col("r").isNotNull(), R.user(F.col("r"))).alias("u")).collect()}
    assert got[0] == (9, "", 4, None) and got[1] == (3, "", 0, "Rome") and got[2] == (0, "", 0, None) and got[4] is None
    kinds = [("ALBUM", True), ("Ep", True), ("playlist", False), (None, False)]
    told = spark.createDataFrame([(json.dumps({"id": 1, "playlist_type": k, "tracks": None}),) for k, _ in kinds], "value string")
    lists = told.select(R.playlist(R.read_json(F.col("value"), "playlist")).alias("p")).select("p.*").collect()
    assert [(r.is_album, r.tracks) for r in lists] == [(a, None) for _, a in kinds]


def test_gaps_are_filled_in_place(spark):
    t = lambda i, title="", ms=0, who="": {"id": i, "title": title, "duration": ms, "user": {"id": 1, "username": who}}
    lists = [(1, [t(5), t(7, "own", 3, "me"), t(6), t(5), t(0), t(8, "half")]), (2, []), (3, None), (4, [t(6)])]
    raw = [json.dumps({"id": i, "tracks": ts}) for i, ts in lists]
    df = spark.createDataFrame([(x,) for x in raw], "value string").select(R.playlist(R.read_json(F.col("value"), "playlist")).alias("p")).select("p.*")
    known = [t(5, "five", 1, "a"), t(5, "zzz", 1, "a"), t(8, "eight", 2, "b"), t(7, "other", 9, "c")]
    known = spark.createDataFrame([(json.dumps(x),) for x in known], "value string").select(R.track(R.read_json(F.col("value"), "track")).alias("track")).select("track.id", "track")
    got = {r.id: r.tracks and [(x.id, x.title) for x in r.tracks] for r in R.completed(df, known).collect()}
    assert got[1] == [(5, "five"), (7, "own"), (5, "five"), (8, "eight")]
    assert got[2] == [] and got[3] is None and got[4] == []
    assert R.completed(df.limit(0), known).count() == 0


def test_lists_in_turn_and_from_a_click(spark):
    rows = [(1, 2, 0, "b"), (1, 1, 0, "a"), (1, 1, 1, "b"), (1, 2, 1, "c"), (1, 1, 2, None), (1, 2, 5, "a"), (2, 1, 0, "a")]
    df = spark.createDataFrame(rows, "page long, group int, at int, urn string")
    listed = R.interleaved(df)
    assert sorted(tuple(r) for r in listed.collect()) == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "a")]
    cached = spark.createDataFrame([("b", None), ("c", "img")], "urn string, avatar_url string")
    got = {(r.page, r.urn): (r.avatar, r.ask) for r in R.avatars(listed, cached, budget=1).collect()}
    assert got == {(1, "a"): (None, True), (1, "b"): (None, False), (1, "c"): ("img", False), (2, "a"): (None, True)}
    turn = lambda items, at: spark.createDataFrame([(items, at)], "i array<int>, at int").select(R.from_clicked(F.col("i"), F.col("at")).alias("x")).first().x
    assert [turn([1, 2, 3], k) for k in (0, 1, 2, 3, -1)] == [[1, 2, 3], [2, 3, 1], [3, 1, 2], [1, 2, 3], [1, 2, 3]] and turn([], 0) == [] and turn(None, 0) is None


def test_each_term_has_one_fate(spark):
    say = [("1", "Podcast", "genre", 3), ("1", "tokyo", "genre", 1), ("2", "Tokyo", "tag", 2), ("1", "Rinse FM", "genre", 1), ("1", "dub", "genre", 1), ("2", "Dub", "tag", 9), ("2", "rare", "genre", 1), ("2", "once", "tag", 1), ("1", "2024", "genre", 1), ("1", "!!", "genre", 1)]
    terms = spark.createDataFrame(say, "urn string, term string, kind string, evidence long")
    artists = spark.createDataFrame([("1", "a", "Tokyo", None, "artist"), ("3", "rinsefm", None, None, "hub")], "urn string, permalink string, city_raw string, country string, account_kind string")
    got = {r.fold: (r.artists, r.fate) for r in rollup.term_report(terms, artists).collect()}
    assert got == {"podcast": (1, "format"), "tokyo": (2, "city"), "rinsefm": (1, "hub"), "dub": (2, "kept"), "rare": (1, "below"), "2024": (1, "format")}
