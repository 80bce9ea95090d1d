"""Stores, snapshots, seeds and canons, and the small rules on tracks."""

import json

import pytest
from pyspark.sql import functions as F

from scenewright.operators import tracks
from scenewright.sources import files


def test_a_store_that_lacks_a_table_or_columns(spark, tmp_path):
    at = f"{tmp_path}/genres"
    assert files.table(spark, at, "slug string, n long").count() == 0
    spark.createDataFrame([("a",)], "slug string").write.parquet(at)
    assert [tuple(r) for r in files.table(spark, at, "slug string, n long").collect()] == [("a", None)]


def test_snapshots_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", None), (2, None, 0.5), (2, None, 0.5)], "id long, name string, w double")
    folder = files.write_snapshot({"artists": df, "edges": df.limit(0)}, str(tmp_path), 7)
    assert folder.endswith("run-0007")
    got = files.read_lines(spark, f"{folder}/artists.ndjson", "id long, name string, w double", "id")
    assert sorted(map(tuple, got.collect())) == [(1, "é", None), (2, None, 0.5)]
    assert files.read_lines(spark, f"{folder}/artists.ndjson", "id long", "id", skip=1).collect()[0].id == 2


def test_seeds_and_canons(spark, tmp_path):
    path = tmp_path / "seeds.json"
    path.write_text(json.dumps({"seeds": ["site:users:1", "https://s.x/a", "someone"]}))
    got = files.seeds(spark, str(path), "site:users:", "https://s.x").collect()
    assert [(r.urn, r.url) for r in got] == [("site:users:1", None), (None, "https://s.x/a"), (None, "https://s.x/someone")]
    path.write_text('{"seeds": []}')
    with pytest.raises(ValueError):
        files.seeds(spark, str(path), "u", "s")
    none, named = files.city_canon(spark, f"{tmp_path}/absent.json")
    assert none.count() == named.count() == 0 and files.account_canon(spark, f"{tmp_path}/absent.json").count() == 0
    path.write_text(json.dumps({"nonPlaces": ["World Wide", "!"], "cityAliases": {"N.Y.C.": "New York"}}))
    none, named = files.city_canon(spark, str(path))
    assert [r.fold for r in none.collect()] == ["worldwide"] and [tuple(r) for r in named.collect()] == [("nyc", "New York")]
    path.write_text(json.dumps({"hubs": ["Label"], "hubTerms": ["Pod Cast"], "artists": ["Me"]}))
    assert {tuple(r) for r in files.account_canon(spark, str(path)).collect()} == {("hub", "label"), ("term", "podcast"), ("artist", "me")}
    path.write_text("{not json")
    with pytest.raises(Exception):
        files.city_canon(spark, str(path))[0].collect()


def test_queue_falls_back_to_all_tracks(spark):
    t = spark.createDataFrame([("a", 1, "x", None), ("a", 2, "y", ["Drum & Bass"]), ("b", 1, "z", None)], "urn string, at int, track string, tags array<string>")
    found = tracks.artist_queue(t, tracks.in_vocabulary(F.lit(None).cast("string"), F.col("tags"), F.array(F.lit("drumbass"))))
    assert sorted((r.urn, r.track) for r in found.collect()) == [("a", "y"), ("b", "z")]
