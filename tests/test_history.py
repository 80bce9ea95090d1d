"""Steadied searches: as a table against a plain loop, and as a stream against the table."""

import datetime
import math
import random

import pytest

from scenewright.operators import history

SCHEMA = f"key string, seq long, ts timestamp, query string, results array<{history.RESULT}>"
START = datetime.datetime(2024, 1, 1)


def rows(seed, n, keys=3):
    draw, names = random.Random(seed), ["dub techno", "dub", "dubstep", "techno", "deep", "Deep House", ""]
    out = []
    for i in range(n):
        found = [(draw.randrange(30), draw.choice(names), draw.choice([None, "dub"]), draw.choice([None, 9]), None, 5) for _ in range(draw.randrange(5))]
        at = START + datetime.timedelta(seconds=draw.randrange(600), microseconds=draw.choice([0, 0, 500]))
        out.append((f"k{draw.randrange(keys)}", i, at, draw.choice(["d", "du", "dub", "dub t", "deep", "t"]), found))
    return out


def similarity(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return 1.0 if not a and not b else 1 - d[-1] / max(len(a), len(b))


def by_loop(searches, most, ttl):
    kept, out = {}, {}
    for key, seq, ts, q, own in sorted(searches, key=lambda x: (x[2], x[1])):
        past = [h for h in kept.get(key, []) if (ts - h[0]).total_seconds() < ttl]
        pool = list(own)
        for _, other, found in past:
            if other.startswith(q) or q.startswith(other):
                pool += found
        seen, good = set(), []
        for at, r in enumerate(pool):
            if r[0] in seen:
                continue
            seen.add(r[0])
            texts = [(r[1] or "").lower(), (r[2] or "").lower()]
            if any(q in t or similarity(t, q) > 0.7 for t in texts):
                score = sum(100 * t.startswith(q) + 50 * (q in t) + 30 * similarity(t, q) for t in texts)
                score += 5 * math.log10((r[3] or 0) + 1) + 2 * math.log10((r[4] or 0) + 1) + 2 * math.log10((r[5] or 0) + 1)
                good.append((-round(score, 6), at, r[0]))
        out[key, seq] = [x[2] for x in sorted(good)][:20]
        kept[key] = [*past, (ts, q, own)][-most:]
    return {k: v for k, v in out.items() if v}


def listed(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.key, r.seq, r.place)):
        out.setdefault((r.key, r.seq), []).append(r.id)
    return out


@pytest.mark.parametrize("most,ttl", [(50, 60), (4, 90)])
def test_table_against_a_loop(spark, most, ttl):
    given = rows(most, 250)
    df = spark.createDataFrame(given, SCHEMA).repartition(3)
    got = listed(history.steadied(history.with_past(df, most, ttl)))
    assert got == by_loop(given, most, ttl)
    assert listed(history.steadied(history.with_past(df.limit(0)))) == {}


def test_stream_equals_table_also_out_of_order(spark, tmp_path):
    given = rows(7, 120)
    draw = random.Random(3)
    given.sort(key=lambda x: x[2])
    late = 40  # seconds that searches may come late
    order = sorted(range(len(given)), key=lambda i: (given[i][2] - START).total_seconds() + draw.uniform(0, late - 1))
    end = [("end", 10_000, START + datetime.timedelta(days=1), "x", [])]
    files = [order[i : i + 25] for i in range(0, len(order), 25)]
    batches = [[given[i] for i in part] for part in files] + [end, [("k0", 777, START - datetime.timedelta(days=1), "dub", [])]]
    for n, part in enumerate(batches):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{n}"))
    (tmp_path / "in").mkdir()
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = history.with_past_streamed(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), f"{late} seconds", 4, 90)
        to = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check"))
        for n in range(len(batches)):  # a query of its own for each batch: the state outlives it
            for f in (tmp_path / f"in{n}").glob("*.parquet"):
                f.rename(tmp_path / "in" / f"{n}-{f.name}")
            to.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.seq for r in got.select("seq").collect()) == sorted(x[1] for x in given)  # the one a day late is left out
    assert listed(history.steadied(got)) == by_loop(given, 4, 90)
