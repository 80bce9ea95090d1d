"""The store: versions are there as a whole or not at all, merges touch the buckets of their keys, crawls go on."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from scenewright.operators import merge
from scenewright.sources import store as S
from scenewright.streaming import ingest


def fold(both):
    return both.groupBy("k").agg(F.max("v").alias("v"))


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, v long")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_merges_write_only_the_buckets_of_their_keys(spark, tmp_path):
    store = S.Store(spark, f"file://{tmp_path}/s")
    store.merge("t", frame(spark, [(i, i) for i in range(2000)]), ["k"], fold, buckets=50)
    before = store.version()
    some = [(i, 10_000 + i) for i in range(0, 2000, 400)]
    after = store.merge("t", frame(spark, some), ["k"], fold)
    changed = {b for b in before.tables["t"]["at"] if before.tables["t"]["at"][b] != after.tables["t"]["at"][b]}
    assert 0 < len(changed) <= 5 and set(before.tables["t"]["at"]) == set(after.tables["t"]["at"]) and len(before.tables["t"]["at"]) == 50
    want = dict((i, i) for i in range(2000)) | dict(some)
    assert rows(store.read("t")) == sorted(want.items())
    assert rows(store.read("t", before)) == [(i, i) for i in range(2000)]  # whoever opened it keeps it
    assert store.vacuum(keep=1) >= 1 and rows(store.read("t")) == sorted(want.items())


def test_a_batch_counts_once_and_a_dead_write_changes_nothing(spark, tmp_path, monkeypatch):
    store = S.Store(spark, f"file://{tmp_path}/s")
    add = lambda both: both.groupBy("k").agg(F.sum("v").alias("v"))  # noqa: E731  a fold that would count twice
    for _ in range(2):
        store.merge("t", frame(spark, [(1, 5)]), ["k"], add, "x", 0)
    assert rows(store.read("t")) == [(1, 5)] and store.version().number == 1

    def dies(version):
        raise OSError("killed")

    with monkeypatch.context() as m:
        m.setattr(store, "_make", dies)
        with pytest.raises(OSError):
            store.merge("t", frame(spark, [(1, 7), (2, 1)]), ["k"], add, "x", 1)
        with pytest.raises(OSError):
            store.publish({"t": (frame(spark, []), ["k"])})
    assert rows(store.read("t")) == [(1, 5)]
    store.merge("t", frame(spark, [(1, 7), (2, 1)]), ["k"], add, "x", 1)
    assert rows(store.read("t")) == [(1, 12), (2, 1)]
    assert store.vacuum(keep=9) == 2  # what the dead writes left


def test_tables_are_published_together_and_again_the_same(spark, tmp_path):
    store = S.Store(spark, f"file://{tmp_path}/s")
    two = lambda n: {"a": (frame(spark, [(1, n)]), ["k"]), "b": (frame(spark, [(2, n), (3, n)]), ["k"])}
    first = store.publish(two(1))
    again = store.publish(two(1))
    assert rows(store.read("a", first)) == rows(store.read("a", again)) == [(1, 1)] and rows(store.read("b")) == [(2, 1), (3, 1)]
    slow, quick = S.Store(spark, store.root), store
    seen = slow.version()
    quick.publish(two(2))
    with pytest.raises(S.Conflict):
        slow._make(S.Version(seen.number + 1, seen.tables, {}))
    assert [rows(store.read(t)) for t in "ab"] == [[(1, 2)], [(2, 2), (3, 2)]]
    assert rows(S.Store(spark, store.root).read("b", again)) == [(2, 1), (3, 1)]
    with pytest.raises(KeyError):
        store.read("none")


def test_a_stream_of_sightings_equals_one_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    told = [{"src": "a", "dst": str(i % 3), "type": "follow", "weight": float(i), "seen": i} for i in range(12)]
    schema = "src string, dst string, type string, weight double, seen long"
    once = lambda df: df.groupBy("src", "dst", "type").agg(F.max("weight").alias("weight"), F.max("seen").alias("seen"))
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(map(json.dumps, told[k::3])))
        ingest.ingest(spark, str(tmp_path / "in"), schema, once, f"file://{tmp_path}/out", "edges", ["src", "dst"], str(tmp_path / "check"), 8).awaitTermination()
    got = S.Store(spark, f"file://{tmp_path}/out").read("edges").select("dst", "weight", "seen")
    assert {tuple(r) for r in got.collect()} == {(str(d), float(9 + d), 9 + d) for d in range(3)}
    assert len(os.listdir(tmp_path / "out" / "versions")) >= 3


def test_queue_history_against_a_loop(spark):
    draw, events = random.Random(8), []
    for u in range(60):
        for at in range(draw.randrange(9)):
            events.append((f"u{u}", at, draw.randrange(4), None) if draw.random() < 0.6 else (f"u{u}", at, None, draw.choice(["done", "failed"])))
    want = {}
    for urn, _, depth, status in sorted(events, key=lambda e: (e[0], e[1])):
        d, s, p = want.get(urn, (None, None, -1))
        if depth is None:
            want[urn] = (d, status, p)
        else:
            fresh = d is None or (s in ("done", "failed") and depth < d)
            want[urn] = (depth if d is None else min(d, depth), "pending" if fresh else s, p + 1)
    got = merge.merge_queue(spark.createDataFrame(events, "urn string, at int, depth int, status string")).collect()
    assert {r.urn: (r.depth, r.status, r.priority) for r in got} == want


def test_a_crawl_that_stops_goes_on(spark, tmp_path):
    crawl = ingest.Crawl(spark, f"file://{tmp_path}/c", buckets=4)
    found = lambda *r: spark.createDataFrame(list(r), "urn string, depth int")
    state = lambda: {r.urn: (r.depth, r.status, r.priority, r.attempts) for r in crawl.queue().collect()}
    urns = lambda *u: spark.createDataFrame([(x,) for x in u], "urn string")
    crawl.start_run("r1", 10)
    for _ in range(2):  # the second time is a repeat after a failure
        crawl.enqueue(found(("a", 0), ("b", 1), ("b", 2), ("c", 1)), 1, "seeds", 0)
    assert state() == {"a": (0, "pending", 0, 0), "b": (1, "pending", 1, 0), "c": (1, "pending", 0, 0)}
    assert [r.urn for r in crawl.claim(2, "r1").collect()] == ["b", "a"]
    crawl.done(urns("a", "c"))  # c was never claimed
    crawl.failed(urns("b"))
    assert state() == {"a": (0, "done", 0, 0), "b": (1, "pending", 1, 1), "c": (1, "pending", 0, 0)}
    for attempt in (2, 3):
        assert [r.urn for r in crawl.claim(1, "r1").collect()] == ["b"]
        crawl.failed(urns("b"))
    assert state()["b"] == (1, "failed", 1, 3)
    assert [r.urn for r in ingest.Crawl(spark, crawl.store.root, 4).claim(5, "r1").collect()] == ["c"]
    crawl.resume()  # the crawl died with c in progress
    crawl.enqueue(found(("a", 0), ("b", 0)), 2, "seeds", 1)
    assert state() == {"a": (0, "done", 1, 0), "b": (0, "pending", 2, 0), "c": (1, "pending", 0, 0)}
    crawl.finish_run("r1", 20)
    assert [tuple(r) for r in crawl.runs().select("run", "started", "finished", "visited").collect()] == [("r1", 10, 20, 1)]
