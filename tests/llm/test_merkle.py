import random

from pyspark.sql import functions as F

from scenewright.llm import merkle


def rows(n=3000):
    draw = random.Random(1)
    return [(i, f"http://x/{i}", "html " * draw.randrange(1, 9) + str(i), "x") for i in range(n)]


def of(spark, own):
    df = spark.createDataFrame(own, "page_id long, url string, html string, node string")
    return merkle.replica(df, "page_id", merkle.warc_record(F.col("page_id"), F.col("url"), F.col("html")))


def test_audit_names_what_differs(spark):
    own = rows()
    a = of(spark, own)
    assert a.root() == of(spark, own[::-1]).root() and merkle.audit(a, of(spark, own[::-1])).count() == 0
    other = list(own)
    other[17] = (17, "http://x/17", "rotten", "x")
    other[2500] = (2500, "http://x/2500", None, "x")
    del other[900]
    other += [(9999, "new", "new", None), (5, *own[5][1:])]  # one more, and one twice
    found = {(r.key, r.status) for r in merkle.audit(a, of(spark, other)).where("status != 'moved'").collect()}
    assert found == {(17, "damaged"), (2500, "damaged"), (900, "missing"), (9999, "extra"), (17, "extra"), (2500, "extra"), (5, "damaged"), (5, "extra")}


def test_offsets_follow_the_records(spark):
    own = rows(50)
    got = of(spark, own).records.orderBy("key").collect()
    at = 0
    for r in got:
        assert r.offset == at
        at += r.length


def test_shifted_and_overlapping_ranges_are_seen(spark):
    own = [(i, f"http://x/{i}", f"html {i:05}", i * 1000) for i in range(900)]

    def at(rows):
        df = spark.createDataFrame(rows, "page_id long, url string, html string, place long")
        return merkle.replica(df, "page_id", merkle.warc_record(F.col("page_id"), F.col("url"), F.col("html")), F.col("place"))

    a = at(own)
    assert a.root() == at(own[::-1]).root()
    one = [(*r[:3], r[3] + 7 * (r[0] == 77)) for r in own]  # a record that overlaps what follows
    assert [(r.key, r.status) for r in merkle.audit(a, at(one)).collect()] == [(77, "moved")]
    block = [(*r[:3], r[3] + 5 * (64 <= r[0] < 80)) for r in own]  # a whole range, moved
    found = merkle.audit(a, at(block)).collect()
    assert [(r.key, r.status, r.file) for r in found] == [(None, "moved", 0)] and found[0].length > 15_000
    late = [(*r[:3], r[3] + 5 * (r[0] >= 450)) for r in own]  # all records from one on
    assert {r.status for r in merkle.audit(a, at(late)).collect()} == {"moved"} and merkle.audit(a, at(late)).count() < 60


def test_nulls_ties_and_empty_replicas(spark):
    own = [(None, None, None, None)] * 3 + [(None, "u", "x", None), (7, None, "", None), (-5, "u", None, None)]
    a = of(spark, own)
    assert a.records.agg(F.sum("copies")).first()[0] == 6
    none = of(spark, [])
    assert none.root() is None and merkle.audit(none, none).count() == 0
    assert {r.status for r in merkle.audit(a, none).collect()} == {"missing"} and merkle.audit(a, none).count() == 4
    assert {r.status for r in merkle.audit(none, a).collect()} == {"extra"}


def test_a_swollen_file_is_parted(spark, monkeypatch):
    monkeypatch.setattr(merkle, "FILE", 10)
    own = [(3, f"u{i}", "same key", None) for i in range(500)]
    a = of(spark, own)
    assert a.records.select("part").distinct().count() > 5
    assert [(r.key, r.status) for r in merkle.audit(a, of(spark, own[1:])).where("status != 'moved'").collect()] == [(3, "damaged")]
