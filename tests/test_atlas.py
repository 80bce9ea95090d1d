"""The atlas views: the rows of their texts, in parts that do not grow."""

import os

import pytest

from scenewright.sources import atlas

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")


@pytest.mark.parametrize("name", ["edges", "terms"])
def test_view_has_the_rows_of_its_text(spark, name):
    told, text = atlas.view(spark, DATA, name), atlas.run(spark, DATA, atlas.VIEWS[name])
    assert told.dtypes == text.dtypes
    assert sorted(told.collect()) == sorted(text.collect())


@pytest.mark.parametrize("name", ["edges", "terms"])
def test_view_is_dealt_in_more_parts_as_it_grows(spark, name, monkeypatch):
    monkeypatch.setattr(atlas, "PART_ROWS", 100)
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert atlas.view(spark, DATA, name).rdd.getNumPartitions() >= lines / 100


def scans(df, column="l_orderkey"):
    """How often the line items are read in a frame's plan."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(f"{column}#") and df._jdf.queryExecution().sparkPlan().toString().count(f"FileScan parquet [{column}")


def test_artist_queue_is_dealt_by_account_and_read_once(spark, monkeypatch):
    from scenewright import pages

    monkeypatch.setattr(atlas, "PART_ROWS", 100)
    queue = pages.q14_artist_queue(spark, DATA)
    assert queue.rdd.getNumPartitions() >= spark.read.parquet(f"{DATA}/lineitem.parquet").count() / 100
    assert scans(queue) == 1


@pytest.mark.parametrize("name", ["ag19_report", "ag16_other_genres", "u26_completed_playlists"])
def test_line_items_are_read_once(spark, name):
    from scenewright import catalog, pages, reads, record_queries  # noqa: F401

    column = "l_orderkey"
    assert scans(catalog.QUERIES[name](spark, DATA), column) == (0 if name == "ag16_other_genres" else 1)


def test_labels_read_tables_that_were_worked_out_before(spark):
    from scenewright import scene_queries

    assert [scans(df) for df in scene_queries.labelled(spark, DATA)] == [0, 0, 0, 0]
