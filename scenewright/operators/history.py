"""Search results steadied by what similar recent searches of the same key found: as a table, and as a stream.

A search is (key, seq, ts, query, results); seq tells searches of one instant apart, results is an array of
(id, title, owner, followers, likes, plays). It looks back at the last MOST searches of its key that are younger than
TTL_SECONDS; those whose query begins with its own, or the other way round, lend it their results."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from scenewright.functions.text import rounded
from scenewright.operators.search import matches, relevance

MOST, TTL_SECONDS, SHOWN = 50, 60, 20
RESULT = "struct<id:bigint,title:string,owner:string,followers:bigint,likes:bigint,plays:bigint>"
PAST = f"array<struct<ts:timestamp,query:string,results:array<{RESULT}>>>"


def with_past(searches: DataFrame, most: int = MOST, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """searches with past: the searches of the key before each one, oldest first.

    A key's time is cut into stretches of the time to live, and each search is also seen by the stretch after its own, so
    a busy key is shared out among tasks, and none holds more than two stretches of it."""
    stretch = F.floor(F.unix_micros("ts") / (ttl_seconds * 1_000_000))
    dealt = searches.withColumn("_own", stretch).withColumn("_in", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    before = Window.partitionBy("key", "_in").orderBy("ts", "seq").rowsBetween(-most, -1)
    told = dealt.withColumn("past", F.collect_list(F.struct("ts", "query", "results")).over(before)).where("_in = _own")
    young = lambda x: F.unix_micros("ts") - F.unix_micros(x["ts"]) < ttl_seconds * 1_000_000
    return told.withColumn("past", F.filter("past", young)).drop("_own", "_in")


def steadied(searches: DataFrame, shown: int = SHOWN) -> DataFrame:
    """(key, seq, query, place, id, title, score) of searches with their past: own results first, then those of similar
    past searches, each id once, those that match the query, the most relevant `shown` of them."""
    query = F.col("query")
    similar = lambda x: F.startswith(query, x["query"]) | F.startswith(x["query"], query)
    lent = F.flatten(F.transform(F.filter("past", similar), lambda x: x["results"]))
    every = searches.select("key", "seq", "query", F.posexplode(F.concat("results", lent)).alias("at", "r")).select("key", "seq", "query", "at", "r.*")
    once = every.groupBy("key", "seq", "query", "id").agg(F.min_by(F.struct("title", "owner", "followers", "likes", "plays"), "at").alias("r"), F.min("at").alias("at"))
    good = once.select("key", "seq", "query", "id", "at", "r.*").where(matches(query, F.col("title"), F.col("owner")))
    scored = good.withColumn("score", rounded(relevance(query, *[F.col(c) for c in ("title", "owner", "followers", "likes", "plays")]), 9))
    order = Window.partitionBy("key", "seq").orderBy(F.desc("score"), "at")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= shown).select("key", "seq", "query", "place", "id", "title", "score")


class Rolling(StatefulProcessor):
    """The past of each search of a key, in the order of time whatever order they arrive in: a search waits until the
    watermark has passed it, so that none can come before it any more; what comes later than that is left out by Spark.
    The state holds waiting searches and the last `most` past ones, and nothing of a key that was quiet for the time to
    live."""

    def __init__(self, most: int, ttl_seconds: int):
        self.most, self.ttl = most, ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        state = "us long, seq long, query string, results string"
        self.waiting, self.past = handle.getListState("waiting", state), handle.getListState("past", state)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        for r in rows:
            self.waiting.appendValue((r.us, r.seq, r.query, r.results))
            self.handle.registerTimer(-(-r.us // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        waiting, past = [tuple(x) for x in self.waiting.get()], [tuple(x) for x in self.past.get()]
        ready, out = sorted(x for x in waiting if x[0] <= now), []
        for x in ready:
            past = [p for p in past if x[0] - p[0] < self.ttl]
            shown = [p for p in past if p[2].startswith(x[2]) or x[2].startswith(p[2])]
            out.append(Row(key=key[0], us=x[0], seq=x[1], query=x[2], results=x[3], past=[Row(us=p[0], query=p[2], results=p[3]) for p in shown]))
            past = [*past, x][-self.most :]
        if ready:
            self.waiting.put([x for x in waiting if x[0] > now]) if len(ready) < len(waiting) else self.waiting.clear()
            self.handle.registerTimer(-(-(ready[-1][0] + self.ttl) // 1000))
        past = [p for p in past if now - p[0] < self.ttl]
        self.past.put(past) if past else self.past.clear()
        return iter(out)

    def close(self) -> None:
        pass


def with_past_streamed(searches: DataFrame, late: str, most: int = MOST, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """A stream of searches with their past, as with_past() has it for a table; searches that come more than `late`
    after others are left out. It needs the RocksDB state store. Of the past it holds the similar searches only."""
    told = searches.withWatermark("ts", late).select("key", "ts", F.unix_micros("ts").alias("us"), "seq", "query", F.to_json("results").alias("results"))
    out = "key string, us long, seq long, query string, results string, past array<struct<us:long,query:string,results:string>>"
    found = told.groupBy("key").transformWithState(Rolling(most, ttl_seconds), out, "append", "eventTime")
    read = lambda c: F.from_json(c, f"array<{RESULT}>")
    past = F.transform("past", lambda x: F.struct(F.timestamp_micros(x["us"]).alias("ts"), x["query"].alias("query"), read(x["results"]).alias("results")))
    return found.select("key", "seq", F.timestamp_micros("us").alias("ts"), "query", read(F.col("results")).alias("results"), past.alias("past"))


def searches_of(rows: DataFrame, *found: Column) -> DataFrame:
    """rows (key, seq, ts, query, ...) with an array of results, each a struct of RESULT's fields; nulls are no result."""
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("results", F.filter(F.array(*found), lambda x: x.isNotNull()).cast(f"array<{RESULT}>"))
