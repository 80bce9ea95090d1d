"""Fixity audit of archived records by Merkle trees over records and ordered offset ranges.

Records are dealt into files by ranges of their keys and lie in a file by key, then digest, at offsets that are given or
follow from their lengths. FANOUT consecutive records make a range: its hash covers, for each of them in order, where it
begins within the range, its length and its hash. FANOUT ranges make the next one in the same way, up to the file and on
over the files up to one root for the replica. So a range that is shifted, overlaps another or leaves a gap changes the
hash above it, while its own, which knows no place, stays.

Two replicas with equal roots are equal; else only the children of branches that differ are compared, level by level,
until the records that differ are named. Every level is a table a FANOUTth as long as the one below, so the descent
reads little more than what differs.

Equal records of one key are one leaf with their number. A file that a key with many different records swells is parted
by the records' digests.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenewright.llm.common import cut

FANOUT = 16
#: Keys in a file.
FILE = 1000


def warc_record(key: Column, uri: Column, payload: Column) -> Column:
    """A page as a WARC resource record. Null parts are empty."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(key.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(uri, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


@dataclass
class Replica:
    """records: (file, part, key, digest, length, copies, offset, node, start, size, hash); above them each level has
    (file, part, node, start, size, hash) up to one node a file, and then (node, start, size, hash) over files up to one
    root. start and size are the range's in bytes; over files, the file's number is its start."""

    records: DataFrame
    inside: list[DataFrame]
    over: list[DataFrame]

    def root(self) -> str | None:
        """The replica's hash; None if it has no records."""
        row = self.over[-1].select("hash").first()
        return row and row.hash


def _of_children(all_: Column) -> Column:
    """The hash of ordered children (start, size, hash): where each begins within their range, its size and hash."""
    first = F.array_min(F.transform(all_, lambda x: x["start"]))
    return F.sha2(F.array_join(F.transform(all_, lambda x: F.concat_ws(":", (x["start"] - first).cast("string"), x["size"].cast("string"), x["hash"])), ","), 256)


def _up(level: DataFrame, within: list[str]) -> DataFrame:
    """The next level: ranges of FANOUT nodes each, in order."""
    order = F.array_sort(F.collect_list(F.struct("node", "start", "size", "hash")))
    end = F.max(F.col("start") + F.col("size"))
    up = level.groupBy(*within, F.expr(f"node div {FANOUT}").alias("parent")).agg(order.alias("all"), F.min("start").alias("start"), end.alias("end"))
    return up.select(*within, F.col("parent").alias("node"), "start", (F.col("end") - F.col("start")).alias("size"), _of_children(F.col("all")).alias("hash"))


def replica(df: DataFrame, key: str, record: Column, offset: Column | None = None) -> Replica:
    """The trees of df's records. offset: where each lies in its file, as its index says; by default they lie one behind
    the other. A null key lies before all others, in files of its own by digest; an empty table has no root. Other
    columns of df play no part."""
    given = (F.lit(None) if offset is None else offset).cast("long").alias("given")
    told = df.select(F.col(key).cast("long").alias("key"), F.sha2(record, 256).alias("digest"), F.octet_length(record).cast("long").alias("length"), given)
    leaves = told.groupBy("key", "digest", "length", "given").agg(F.count("*").alias("copies"))
    file = F.when(F.col("key").isNull(), F.lit(None).cast("long")).otherwise(F.floor(F.col("key") / FILE).cast("long"))
    leaves = cut(leaves.withColumn("file", file))
    full = leaves.groupBy("file").agg(F.ceil(F.count("*") / (4 * FILE)).cast("int").alias("parts")).withColumnRenamed("file", "of")
    parted = leaves.join(full, F.col("file").eqNullSafe(F.col("of"))).withColumn("part", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int"))
    order = Window.partitionBy("file", "part").orderBy("key", "digest", "given")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("length") * F.col("copies")
    at = F.coalesce("given", F.sum(size).over(before), F.lit(0))
    records = parted.select(
        "file", "part", "key", "digest", "length", "copies", at.alias("offset"), (F.row_number().over(order) - 1).cast("long").alias("node"), at.alias("start"),
        size.alias("size"), F.sha2(F.concat_ws(":", "digest", "copies"), 256).alias("hash"),
    )
    records = cut(records)
    inside, longest = [], records.agg(F.max("node")).first()[0] or 0
    level = records.select("file", "part", "node", "start", "size", "hash")
    while longest > 0:
        level = cut(_up(level, ["file", "part"]))
        inside.append(level)
        longest //= FANOUT
    # files in order of their numbers, the null one first; their places differ between replicas if files are missing,
    # so a file's node is its own number
    shift = level.select(F.min("file")).first()[0] or 0
    parts = level.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("part", "start", "size", "hash"))).alias("all"))
    number = (F.coalesce(F.col("file") - min(shift, 0), F.lit(-1)) + 1).alias("node")
    over = [cut(parts.select(number, "file", number.alias("start"), F.lit(1).cast("long").alias("size"), _of_children(F.col("all")).alias("hash")))]
    longest = over[0].agg(F.max("node")).first()[0] or 0
    while longest > 0:
        over.append(cut(_up(over[-1], [])))
        longest //= FANOUT
    return Replica(records, inside, over)


def _differing(a: DataFrame, b: DataFrame, on: list[str], carry: str | None = None) -> DataFrame:
    """The nodes that only one side has, or whose hashes differ."""
    x, y = a.select(*on, F.col("hash").alias("hash_a")), b.select(*on, F.col("hash").alias("hash_b"))
    x, y = x.toDF(*[f"a_{c}" for c in on], "hash_a"), y.toDF(*[f"b_{c}" for c in on], "hash_b")
    same = F.lit(True)
    for c in on:
        same = same & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    both = x.join(y, same, "full").where(~F.col("hash_a").eqNullSafe(F.col("hash_b")))
    return both.select(*[F.coalesce(f"a_{c}", f"b_{c}").alias(c) for c in on])


def _children(level: DataFrame, parents: DataFrame, within: list[str]) -> DataFrame:
    up = parents.select(*[F.col(c).alias(f"p_{c}") for c in within], F.col("node").alias("p_node"))
    same = F.expr(f"node div {FANOUT}") == F.col("p_node")
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col(f"p_{c}"))
    return level.join(up, same, "left_semi")


def _moved(a: DataFrame, b: DataFrame, within: list[str]) -> DataFrame:
    """Ranges (within, node) of a that b has whole, but elsewhere in the range above."""
    first = Window.partitionBy(*within, F.expr(f"node div {FANOUT}"))
    place = lambda df: df.withColumn("place", F.col("start") - F.min("start").over(first))
    x, y = place(a).select(*within, "node", "size", "hash", "place"), place(b).select(*within, "node", "hash", "place")
    y = y.toDF(*[f"b_{c}" for c in y.columns])
    same = F.col("hash") == F.col("b_hash")
    for c in [*within, "node"]:
        same = same & F.col(c).eqNullSafe(F.col(f"b_{c}"))
    return x.join(y, same).where("place != b_place").select(*within, "node", "size", "hash")


def audit(a: Replica, b: Replica) -> DataFrame:
    """(file, key, digest, length, copies, status) of what differs: `damaged` records of a whose key has other records
    in b, `missing` ones whose key b lacks, `extra` ones of b that a lacks, and `moved` ones that b has at another place
    within their range. A range that b has whole, but elsewhere, is one `moved` row with its hash and size and without a
    key. Empty if the roots are equal."""
    columns = ["file", "key", "digest", "length", "copies"]
    if a.root() == b.root():
        return a.records.select(*columns, F.lit("").alias("status")).limit(0)
    # the trees may differ in height: the descent begins where both have a level
    low = min(len(a.over), len(b.over)) - 1
    differ = cut(_differing(a.over[low], b.over[low], ["node"]))
    for k in range(low - 1, -1, -1):
        differ = cut(_differing(_children(a.over[k], differ, []), _children(b.over[k], differ, []), ["node"]))
    files = a.over[0].select("node", "file").unionByName(b.over[0].select("node", "file")).distinct().join(differ, "node", "left_semi").select("file").distinct()
    files = cut(files)
    mine = lambda df: df.join(files.withColumnRenamed("file", "p_file"), F.col("file").eqNullSafe(F.col("p_file")), "left_semi")
    low = min(len(a.inside), len(b.inside)) - 1
    within, ranges = ["file", "part"], None
    x, y = mine(a.records), mine(b.records)
    if low >= 0:
        differ = cut(_differing(mine(a.inside[low]), mine(b.inside[low]), [*within, "node"]))
        for k in range(low - 1, -1, -1):
            p, q = cut(_children(a.inside[k], differ, within)), cut(_children(b.inside[k], differ, within))
            moved = _moved(p, q, within)
            ranges = moved if ranges is None else ranges.unionByName(moved)
            differ = cut(_differing(p, q, [*within, "node"]))
        x, y = _children(a.records, differ, within), _children(b.records, differ, within)
    # a record that was inserted or lost shifts those behind it, so what is left is compared by key and digest
    first = Window.partitionBy("file", "part", F.expr(f"node div {FANOUT}"))
    kept = lambda df: cut(df.select(*columns, (F.col("start") - F.min("start").over(first)).alias("place")))
    x, y = kept(x), kept(y)
    same = lambda p, q, on: [F.col(f"x_{c}").eqNullSafe(F.col(f"y_{c}")) for c in on]
    x, y = x.toDF(*[f"x_{c}" for c in x.columns]), y.toDF(*[f"y_{c}" for c in y.columns])
    whole = ["file", "key", "digest", "copies"]
    lost = x.join(y, same(x, y, whole), "left_anti")
    extra = y.join(x, same(x, y, whole), "left_anti")
    told = lambda df, side, status: df.select(*[F.col(f"{side}_{c}").alias(c) for c in columns], F.lit(status).alias("status"))
    out = told(lost.join(y, same(x, y, ["file", "key"]), "left_semi"), "x", "damaged")
    out = out.unionByName(told(lost.join(y, same(x, y, ["file", "key"]), "left_anti"), "x", "missing")).unionByName(told(extra, "y", "extra"))
    both = x.join(y, same(x, y, whole)).groupBy(*[f"x_{c}" for c in columns]).agg(F.bool_or(F.col("x_place") == F.col("y_place")).alias("there"))
    out = out.unionByName(told(both.where("not there"), "x", "moved"))
    if ranges is not None:
        none = lambda kind: F.lit(None).cast(kind)
        out = out.unionByName(ranges.select("file", none("long").alias("key"), F.col("hash").alias("digest"), F.col("size").alias("length"), none("long").alias("copies"), F.lit("moved").alias("status")))
    return out
