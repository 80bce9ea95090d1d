"""N-gram Jaccard join with filters under several global token orders.

Documents are sets of word shingles, hashed; two link when the sets' intersection is at least PERCENT of their union.

1. Equal sets are one node, whatever their number.
2. A document that links with another shares at least PERCENT of its shingles with it. So nodes are dropped that have
   more shingles than that which no other node has: first by a part of all hashes, counted in buckets, which clears
   away most of a corpus at little cost, then by all shingles of what is left.
3. For any order of all shingles, the first one that two linking sets share has as many before it in either set, at
   most, as the set is larger than the least intersection of the two. The first order goes by document frequency, rare
   ones first; its prefixes are the index, with each shingle's place. So sets that share an index token are candidates
   only if both places fit both sizes: near copies whose own changes alone are too many never meet. Two more orders, by
   hashes, must agree before a pair is verified on the whole sets.
4. Only components are wanted, so pairs that are connected already needn't be verified. First every document of a
   prefix token is compared with the one that has least before that token, which of near copies is the one with the
   fewest changes of its own. What of a token's documents isn't in its largest component then is compared with all
   of the token's outside its own component. So no link is lost, and a group of thousands of near copies costs as many
   comparisons as it has documents, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenewright.llm.common import cut, join_hot, sliced
from scenewright.llm.graph import components
from scenewright.llm.textbytes import mixed, pieces, releasing, shingle_sets, sums

#: The part of all hashes that the first clearing looks at; above 1 - PERCENT, so that new texts can't pass.
PART = 4
#: Shingles that a bucket of the first clearing has, in expectation.
BUCKET = 2_000_000
#: Rows (of two numbers) up to which the documents to look at again are sent to all tasks instead of shuffling texts.
BROADCAST_ROWS = 1_000_000
#: Rounds in which a prefix token's documents are compared with one of them.
ROUNDS = 1
#: Rows of one token that one task compares others with, in expectation.
SIDE = 4096


def _sets(batch: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    step = 4096
    for first in range(0, len(batch), step):
        for a, b, raw, offsets in pieces(batch.slice(first, step)):
            tokens, at = shingle_sets(raw, offsets, size)
            yield first + a, first + b, tokens, at


def _hashes(tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    one = mixed(tokens + np.uint64(1))
    return mixed(sums(one, at)).view(np.int64), mixed(sums(mixed(one ^ np.uint64(0x5851F42D4C957F2D)), at)).view(np.int64)


def signatures(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, n, h1, h2): the number of shingles and the hashes of each document's set. Null is an empty text."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, tokens, at in _sets(batch.column(1), size):
                h1, h2 = _hashes(tokens, at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(at)), pa.array(h1), pa.array(h2)], names=["key", "n", "h1", "h2"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(releasing(run), f"key {kind}, n long, h1 long, h2 long")


def _cleared(texts: DataFrame, size: int, shingles: int) -> DataFrame:
    """(node, alone): how many of a PARTth of its hashes no other set has, for each set that has such. texts: (text),
    any number of rows for each set; sets are told apart by their hash, and a piece of text deals each set once."""
    buckets = max(texts.sparkSession.sparkContext.defaultParallelism * 2, sliced(shingles // PART, BUCKET))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each bucket the hashes that fall into it, and the place of their set in a list of sets."""
        for batch in batches:
            for a, b, tokens, at in _sets(batch.column(0), size):
                nodes, first, of = np.unique(_hashes(tokens, at)[0], return_index=True, return_inverse=True)
                owner = np.repeat(of.astype(np.uint16), np.diff(at))
                seen = mixed(tokens)
                here = ((seen % np.uint64(PART)) == 0) & np.repeat(first[of] == np.arange(b - a), np.diff(at))
                seen, owner, tokens = seen[here], owner[here], tokens[here]
                bucket = (seen // np.uint64(PART)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                bucket, owner, tokens = bucket[order], owner[order], tokens[order]
                ends = np.searchsorted(bucket, np.arange(buckets + 1).astype(np.uint64))
                rows = []
                for k in np.flatnonzero(np.diff(ends)):
                    some, place = np.unique(owner[ends[k] : ends[k + 1]], return_inverse=True)
                    rows.append((int(k), nodes[some].tobytes(), place.astype(np.uint16).tobytes(), tokens[ends[k] : ends[k + 1]].tobytes()))
                if rows:
                    bk, no, pl, to = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(bk, pa.int32()), *[pa.array(x, pa.binary()) for x in (no, pl, to)]], names=["bucket", "nodes", "place", "tokens"])

    def count(rows: pa.Table) -> pa.Table:
        """How many hashes of each set in this bucket are its own alone."""
        nodes = [np.frombuffer(x.as_py(), np.int64) for x in rows.column("nodes")]
        base = np.r_[0, np.cumsum([len(x) for x in nodes])]
        place = np.concatenate([np.frombuffer(x.as_py(), np.uint16).astype(np.int64) + base[i] for i, x in enumerate(rows.column("place"))])
        tokens = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in rows.column("tokens")])
        order = np.argsort(tokens)
        tokens, node = tokens[order], np.concatenate(nodes)[place[order]]
        starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        # a hash is a set's own if the least and the largest set that have it are the same
        low, high = np.minimum.reduceat(node, starts), np.maximum.reduceat(node, starts)
        some, alone = np.unique(low[low == high], return_counts=True)
        return pa.table({"node": some, "alone": alone.astype(np.int64)})

    dealt = texts.select("text").mapInArrow(releasing(deal), "bucket int, nodes binary, place binary, tokens binary")
    return dealt.groupBy("bucket").applyInArrow(count, "node long, alone long").groupBy("node").agg(F.sum("alone").alias("alone"))


def _rows(texts: DataFrame, size: int) -> DataFrame:
    """(node, n, token) of every shingle. texts: (h1, text); a row whose text is not the set that h1 names is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1 = batch.column(0).to_numpy()
            for a, b, tokens, at in _sets(batch.column(1), size):
                n = np.where(_hashes(tokens, at)[0] == h1[a:b], np.diff(at), 0)
                columns = [np.repeat(h1[a:b], n), np.repeat(n, n), tokens[np.repeat(n > 0, np.diff(at))].view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["node", "n", "token"])

    return texts.select("h1", "text").mapInArrow(releasing(run), "node long, n long, token long")


def required(n: Column, percent: int) -> Column:
    """The least size of an intersection with which a set of n shingles can link."""
    return F.ceil(n * percent / F.lit(100) - F.lit(1e-9)).cast("long")


def least_common(n: Column, m: Column, percent: int) -> Column:
    """The least size of an intersection with which sets of n and m shingles link."""
    return F.ceil((n + m) * percent / F.lit(100 + percent) - F.lit(1e-9)).cast("long")


def _candidates(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The shared shingles of the sets that may link and their prefixes under the hashed orders, (node, n, tokens,
    second, third), and the index of the first order's prefixes, (token, node, n, pos); pos counts from 1 in the order
    of all the set's shingles, those that no other set has coming first."""
    # more shingles that no other set has than a link allows: gone. Those of the others are counted once more.
    shared = rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = shared.withColumn("times", F.col("df"))
    own = join_hot(rows, shared, "token", "times", rows.count()).groupBy("node", "n").agg(F.collect_set(F.struct("df", "token")).alias("own"))
    spare = F.size("own") - required(F.col("n"), percent) + 1  # the prefix of any order
    own = own.withColumn("spare", spare.cast("int")).where("spare > 0")
    hashed = lambda seed: F.transform(
        F.slice(F.array_sort(F.transform("own", lambda t: F.struct(F.xxhash64(F.lit(seed), t["token"]).alias("h"), t["token"].alias("t")))), 1, F.col("spare")),
        lambda x: x["t"],
    )
    own = cut(
        own.select(
            "node",
            "n",
            F.transform("own", lambda t: t["token"]).alias("tokens"),
            F.transform(F.slice(F.array_sort("own"), 1, F.col("spare")), lambda t: t["token"]).alias("first"),
            hashed(2).alias("second"),
            hashed(3).alias("third"),
        )
    )
    # the index has no arrays: a long text has as many rows there as its prefix is long
    index = own.select(F.posexplode("first").alias("at", "token"), "node", "n", (F.col("n") - F.size("tokens")).alias("alone"))
    index = cut(index.select("token", "node", "n", (F.col("alone") + F.col("at") + 1).cast("long").alias("pos")))
    repeated = index.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    return own.drop("first"), cut(join_hot(index, repeated, "token", "df", index.count()))


def _may_link(percent: int) -> Column:
    """Whether the sets x and y of an index token can still link: it is the first that both have, so each has as many
    shingles before it as the intersection leaves over, at most. That settles their sizes too."""
    least = least_common(F.col("x.n"), F.col("y.n"), percent)
    fits = lambda s: F.col(f"{s}.pos") <= F.col(f"{s}.n") - least + 1
    return fits("x") & fits("y") & (F.col("x.component") != F.col("y.component"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, ca, cb) that link: those whose prefixes meet under the other orders too are verified on whole
    sets."""
    of = lambda x, *names: sets.select(F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in names])
    both = pairs.join(of("a", "second", "third"), "a").join(of("b", "n", "tokens", "second", "third"), "b")
    both = both.where(F.arrays_overlap("a_second", "b_second") & F.arrays_overlap("a_third", "b_third"))
    both = both.select("a", "b", "ca", "cb", "b_n", "b_tokens").join(of("a", "n", "tokens"), "a")
    inter = F.size(F.array_intersect("a_tokens", "b_tokens"))
    return both.where(100 * inter >= percent * (F.col("a_n") + F.col("b_n") - inter)).select("a", "b", "ca", "cb")


def _pairs(met: DataFrame, percent: int) -> DataFrame:
    """(a, b, ca, cb): each two sets x and y, index rows of one token with components, that may link, once."""
    met = met.where(_may_link(percent))
    first = F.col("x.node") < F.col("y.node")
    either = lambda c: (F.when(first, F.col(f"x.{c}")).otherwise(F.col(f"y.{c}")), F.when(first, F.col(f"y.{c}")).otherwise(F.col(f"x.{c}")))
    (a, b), (ca, cb) = either("node"), either("component")
    return met.select(a.alias("a"), b.alias("b"), ca.alias("ca"), cb.alias("cb")).distinct()


def _merged(label: DataFrame, found: DataFrame) -> DataFrame:
    """label (node, component) after links between components."""
    new = cut(components(found.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).toDF("c", "to"))
    moved = label.join(new.withColumnRenamed("c", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    # a component of one set that had no link so far
    fresh = new.select(F.col("c").alias("node"), F.col("to").alias("component")).join(label.select("node"), "node", "left_anti")
    return cut(moved.unionByName(fresh))


def link(sets: DataFrame, index: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the sets that link with another one."""
    spark, total = sets.sparkSession, index.count()
    label = spark.createDataFrame([], "node long, component long")
    told = lambda: cut(index.join(label, "node", "left").withColumn("component", F.coalesce("component", "node")))
    y = F.struct("node", "n", "pos", "component").alias("y")
    for turn in range(ROUNDS):
        known = told()
        row = F.struct("pos", F.xxhash64(F.lit(turn), "node").alias("h"), "node", "n", "component")
        lead = known.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min(row).alias("x"), F.count("*").alias("times"))
        lead = lead.where("low < high").select("token", "x", "times")  # a token whose sets are all connected is done
        found = cut(_verified(_pairs(join_hot(known.select("token", y), lead, "token", "times", total), percent), sets, percent))
        if not found.isEmpty():
            label = _merged(label, found)
    known = told()
    part = known.groupBy("token", "component").agg(F.count("*").alias("size"))
    main = part.groupBy("token").agg(F.max(F.struct("size", "component")).alias("main"), F.count("*").alias("parts"))
    main = main.where("parts > 1").select("token", F.col("main.component").alias("main"))
    # sets outside the component that has most of a token's sets, with all of that token's. A token that many sets have
    # is dealt by a hash of the larger side
    open_ = cut(known.join(main, "token"))
    few, times = open_.where("component != main"), F.greatest(F.lit(1), F.ceil(F.col("times") / SIDE)).cast("int")
    per = open_.groupBy("token").agg(F.count("*").alias("times")).select("token", times.alias("sides"))
    few = few.join(per, "token").select("token", F.struct("node", "n", "pos", "component").alias("x"), F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("side"))
    open_ = open_.join(per, "token").select("token", y, F.pmod(F.xxhash64("node"), F.col("sides")).cast("int").alias("side"))
    found = cut(_verified(_pairs(few.join(open_, ["token", "side"]), percent), sets, percent))
    return label if found.isEmpty() else _merged(label, found)


def join(df: DataFrame, key: str = "doc_id", text: str = "text", *, words: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id, n_copies) of every row of df.

    component_id is the smallest key that links reach, itself included; n_copies counts the rows with the same set.
    A null or wordless text has an empty set, links with nothing and is its own component. Of rows with equal keys each
    keeps its line. A row whose key is null takes the smallest key of its component; if none of its copies has a key,
    its component is null and only they are compared with it. Memory is in proportion to the longest text."""
    signed = cut(signatures(df, key, text, words))
    groups = signed.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("key").alias("least"), F.count("*").alias("n_copies"))
    groups = cut(groups)
    told = groups.where("least is not null")
    shingles = told.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    texts = df.select(F.col(key).alias("key"), F.col(text).alias("text"))

    alone = _cleared(texts, words, shingles)
    may = cut(
        told.join(alone, told["h1"] == alone["node"], "left")
        .where(F.coalesce("alone", F.lit(0)) <= F.col("n") - required(F.col("n"), percent))
        .select(F.col("least").alias("key"), "h1")
    )
    few = may.count() <= BROADCAST_ROWS
    rows = _rows(texts.join(F.broadcast(may) if few else may, "key"), words)
    rows = cut(rows.distinct() if _keys_repeat(signed) else rows)
    sets, index = _candidates(rows, percent)
    label = link(sets, index, percent)
    named = groups.join(label, groups["h1"] == label["node"], "left").withColumn("node", F.coalesce("component", "h1"))
    least = named.groupBy("node").agg(F.min("least").alias("component_id"))
    named = cut(named.select("n", "h1", "h2", "n_copies", "node").join(least, "node").drop("node"))
    out = signed.join(named, ["n", "h1", "h2"], "left")
    return out.select(
        F.col("key").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
    )


def _keys_repeat(signed: DataFrame) -> bool:
    said = signed.agg(F.count("key").alias("n"), F.count_distinct("key").alias("d")).first()
    return said.n != said.d
