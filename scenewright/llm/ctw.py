"""Language-model scoring by context-tree weighting over bytes.

Each byte is eight binary decisions, each with a tree of its own over the DEPTH bytes before. A node's block
probability by Krichevsky and Trofimov depends on its counts alone, so Spark counts the grams of DEPTH + 1 bytes over
all training texts, and grouping those level by level gives every node's counts and, from the leaves up, its weighted
probability: half its own estimate, half the product of its children's. What a node then predicts is its own estimate
and its child's on the path, mixed by their posterior weights: all depths take part in each decision.

Every counted node is in the tree, whatever the size of the corpus. A context's nodes lie below those of its last bytes,
so the distinct grams of all texts are dealt by their last SPLITS[0] bytes, of which none has more than 256 ** (DEPTH + 1
- SPLITS[0]) however common it is, and each task works out the levels from DEPTH to there. The nodes found are dealt by
SPLITS[1] bytes, and so on, with 255 x 256 nodes of one context at most in each step; the 255 x 256 nodes of the last
one come to the driver. Going down again in the same steps gives each distinct gram its bits. Those of the HEAD most
frequent grams, at most, are broadcast; the others, which are few of a text's, are joined. Grams that only held-out
texts have count 0.

The baseline is the add-a-tenth unigram of whole words. Words that make up at least WORD_SHARE of all tokens, at most
1 / WORD_SHARE of them, are broadcast; the rest, which no text has many of, are joined with their counts.

Texts are scored in lower case (A-Z), with one more byte that ends each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenewright.llm.common import cut, most_frequent, sliced
from scenewright.llm.textbytes import LOWER, Counts, Memo, find, grams, pieces, prefix_hashes, releasing, span_hashes, words

DEPTH = 5
#: Bytes of context that grams, and then nodes, are dealt by.
SPLITS = (3, 2, 1)
#: Grams whose bits are broadcast, at most.
HEAD = 1 << 21
#: Distinct grams that one task works on, about.
GRAMS_PER_TASK = 200_000
#: The occurrences that a node in the tree has at least: one. Those that only held-out texts have are no nodes.
LEAST = 1
WORD_SHARE = 2.5e-7
#: Distinct grams, and words, that a task holds before it gives their counts out.
COUNTED = 600_000
#: No UTF-8 text has this byte: it stands before each text and ends it.
EDGE = 255
#: The word hash that stands for the end of a text.
END = np.uint64(0)
GRAM, WORD = 0, 1


def held_out(key: Column) -> Column:
    """Whether a document is held out: the CRC-32 of its key as text is divisible by 10. A null key is the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each word; no hash equals END."""
    starts, ends, text = words(raw, offsets)
    h = span_hashes(prefix_hashes(raw), starts, ends)
    return np.where(h == END, np.uint64(1), h), text


def count(texts: DataFrame) -> DataFrame:
    """(kind, key, n): grams of DEPTH + 1 bytes and words of texts (text) or (text, held_out). A held-out text's grams
    count 0, its words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {GRAM: Counts(COUNTED), WORD: Counts(COUNTED)}
        out = lambda kind, k, n: pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(k), kind, np.int8)), pa.array(k.view(np.int64)), pa.array(n)], names=["kind", "key", "n"]
        )
        for batch in batches:
            told = batch.column(0)
            apart = batch.column(1) if batch.num_columns > 1 else pa.array(np.zeros(len(told), bool))
            for a, b, raw, offsets in pieces(told.filter(pc.invert(apart))):
                low = LOWER[raw]
                for kind, keys in ((GRAM, grams(low, offsets, DEPTH + 1, EDGE, end=True)[0]), (WORD, np.r_[_words(low, offsets)[0], np.full(b - a, END)])):
                    for k, n in held[kind].add(keys):
                        yield out(kind, k, n)
            for _, _, raw, offsets in pieces(told.filter(apart)):
                keys = np.unique(grams(LOWER[raw], offsets, DEPTH + 1, EDGE, end=True)[0])
                for k, n in held[GRAM].add(keys, np.zeros(len(keys), np.int64)):
                    yield out(GRAM, k, n)
        for kind, counts in held.items():
            for k, n in counts.rest():
                yield out(kind, k, n)

    part = texts.mapInArrow(releasing(run), "kind byte, key long, n long")
    return part.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x >= 1/2, by Stirling's series eight places on."""
    s = x + 8
    product = x.copy()
    for k in range(1, 8):
        product *= x + k
    series = 1 / (12 * s) - 1 / (360 * s * s * s) + 1 / (1260 * s * s * s * s * s)
    return (s - 0.5) * np.log(s) - s + 0.5 * math.log(2 * math.pi) + series - np.log(product)


def _kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1.0) - math.log(math.pi)


@dataclass
class Level:
    """The nodes of one depth (context above an eight-bit prefix of the byte, with a leading one) in order, their counts
    and weighted probability, the weight of a node's own estimate, the estimate of the children that aren't in the
    tree, and the place in this level of each node of the level below, or of each gram below the deepest."""

    nodes: np.ndarray
    n0: np.ndarray
    n1: np.ndarray
    weighted: np.ndarray
    own: np.ndarray
    other: np.ndarray
    of: np.ndarray

    def down(self, sure: np.ndarray, left: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each node the part of a one's probability that the path to it settles, and the weight that is left for
        the nodes below it, from those of its parent and the parent's other. A node not in the tree ends the path."""
        kept, estimate = self.n0 + self.n1 >= LEAST, (self.n1 + 0.5) / (self.n0 + self.n1 + 1)
        return sure + left * np.where(kept, self.own * estimate, other), np.where(kept, left * (1 - self.own), 0.0)


def _leaves(keys: np.ndarray, n: np.ndarray, bit: int) -> Level:
    """The deepest nodes for a bit of the grams' last bytes."""
    prefix, one = _split(keys, bit)
    nodes, of = np.unique(((keys >> np.uint64(8)) << np.uint64(8)) | prefix, return_inverse=True)
    n1 = np.bincount(of, weights=n * one, minlength=len(nodes))
    n0 = np.bincount(of, weights=n * ~one, minlength=len(nodes))
    return Level(nodes, n0, n1, _kt(n0, n1), np.ones(len(nodes)), np.full(len(nodes), 0.5), of)


def _split(keys: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray]:
    """The prefix before a bit of the grams' last bytes, and whether the bit is one."""
    byte = keys & np.uint64(255)
    return (np.uint64(1) << np.uint64(bit)) | (byte >> np.uint64(8 - bit)), ((byte >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)


def _above(level: Level, depth: int) -> Level:
    """The nodes at that depth, of those one deeper."""
    nodes, of = np.unique(level.nodes & np.uint64((1 << 8 * (depth + 1)) - 1), return_inverse=True)
    added = lambda x: np.bincount(of, weights=x, minlength=len(nodes))
    kept = level.n0 + level.n1 >= LEAST
    n0, n1, o0, o1 = added(level.n0), added(level.n1), added(np.where(kept, 0, level.n0)), added(np.where(kept, 0, level.n1))
    a = math.log(0.5) + _kt(n0, n1)
    weighted = np.logaddexp(a, math.log(0.5) + added(np.where(kept, level.weighted, 0)) + _kt(o0, o1))
    return Level(nodes, n0, n1, weighted, np.exp(a - weighted), (o1 + 0.5) / (o0 + o1 + 1), of)


def _levels(keys: np.ndarray, n: np.ndarray, bit: int, depth: int, top: int) -> list[Level]:
    """The levels of a bit from `depth` up to `top`."""
    found = [_leaves(keys, n, bit)]
    for d in range(depth - 1, top - 1, -1):
        found.append(_above(found[-1], d))
    return found


Path = tuple[np.ndarray, np.ndarray, np.ndarray]


def _settled(levels: list[Level], path: Path) -> Path:
    """What the path settles before each node or gram below the lowest level, of what it settles before the top one's."""
    sure, left, other = path
    for level in levels[::-1]:
        sure, left = level.down(sure, left, other)
        sure, left, other = sure[level.of], left[level.of], level.other[level.of]
    return sure, left, other


def _suffix(size: int) -> Column:
    """The last bytes of the context of a gram or node."""
    return F.shiftright("key", 8).bitwiseAND((1 << 8 * size) - 1)


def _read(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
    """The columns of all batches of a task."""
    read = list(batches)
    if not read:
        return []
    return [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in read]) for i in range(read[0].num_columns)]


def _told(columns: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(columns[0]), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000]) for c in columns], names=names)


NODES, PATHS = ["key", "n0", "n1", "weighted"], ["key", "sure", "left", "other"]


def _node_level(columns: list[np.ndarray]) -> Level:
    """Nodes (key, n0, n1, weighted), in order."""
    order = np.argsort(columns[0].view(np.uint64))
    node, n0, n1, weighted = (c[order] for c in columns)
    none = np.zeros(0)
    return Level(node.view(np.uint64), n0, n1, weighted, none, none, none)


def _apart(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, Path]:
    """Of rows dealt together: the lower ones' columns, and the upper nodes in order with their paths."""
    upper = columns[-1]
    keys, sure, left, other = (c[upper] for c in (columns[0], *columns[-4:-1]))
    order = np.argsort(keys.view(np.uint64))
    return [c[~upper] for c in columns[:-4]], keys.view(np.uint64)[order], (sure[order], left[order], other[order])


def _together(lower: DataFrame, paths: DataFrame, size: int, rows: int) -> DataFrame:
    """Lower rows and the paths of the nodes above them, dealt by the same bytes of context."""
    none = [F.lit(None).cast("double").alias(c) for c in PATHS[1:]]
    below = lower.select("*", *none, F.lit(False).alias("upper"))
    above = paths.select("key", *[F.lit(0).cast(f.dataType).alias(f.name) for f in lower.schema[1:]], *PATHS[1:], F.lit(True).alias("upper"))
    return below.unionByName(above).repartition(sliced(rows, GRAMS_PER_TASK), _suffix(size))


def costs(found: DataFrame) -> DataFrame:
    """(key, n, bits): log2 of the probability of the last byte after the bytes before it of all grams of found (key, n),
    whose counts make the tree. Without any count, each decision is even."""
    rows, depth = found.count(), DEPTH
    steps = [t for t in SPLITS if t <= depth] or [depth]
    grams_ = found.select("key", "n")

    def leaves_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _read(batches)
        for bit in range(8 if read else 0):
            x = _levels(read[0].view(np.uint64), read[1], bit, depth, steps[0])[-1]
            yield from _told([x.nodes.view(np.int64), x.n0, x.n1, x.weighted], NODES)

    def nodes_up(to: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            read = _read(batches)
            if read:
                x = _above(_node_level(read), to)
                yield from _told([x.nodes.view(np.int64), x.n0, x.n1, x.weighted], NODES)

        return run

    def nodes_down(to: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            read = _read(batches)
            if read:
                own, above, path = _apart(read)
                if len(own[0]):
                    x = _node_level(own)
                    level = _above(x, to)
                    at = find(above, level.nodes)[0]
                    yield from _told([x.nodes.view(np.int64), *_settled([level], tuple(p[at] for p in path))], PATHS)

        return run

    def leaves_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _read(batches)
        if not read:
            return
        (key, n), above, path = _apart(read)
        keys, bits = key.view(np.uint64), np.zeros(len(key))
        for bit in range(8 if len(keys) else 0):
            levels = _levels(keys, n, bit, depth, steps[0])
            at = find(above, levels[-1].nodes)[0]
            sure = _settled(levels, tuple(p[at] for p in path))[0]
            bits += np.log2(np.where(_split(keys, bit)[1], sure, 1 - sure))
        yield from _told([key, n, bits], ["key", "n", "bits"])

    node_schema, path_schema = ", ".join(f"{c} {'long' if c == 'key' else 'double'}" for c in NODES), ", ".join(f"{c} {'long' if c == 'key' else 'double'}" for c in PATHS)
    tables = [cut(grams_.repartition(sliced(rows, GRAMS_PER_TASK), _suffix(steps[0])).mapInArrow(releasing(leaves_up), node_schema))]
    sizes = [tables[0].count()]
    for to in steps[1:]:
        dealt = tables[-1].repartition(sliced(sizes[-1], GRAMS_PER_TASK), _suffix(to))
        tables.append(cut(dealt.mapInArrow(releasing(nodes_up(to)), node_schema)))
        sizes.append(tables[-1].count())
    # 255 x 256 rows at most (where DEPTH is greater than 0)
    top = [_node_level([c.to_numpy() for c in tables[-1].toArrow().columns])]
    for d in range(steps[-1] - 1, -1, -1):
        top.append(_above(top[-1], d))
    n = len(top[-1].nodes)
    path = _settled(top[1:], (np.zeros(n), np.ones(n), np.full(n, 0.5)))
    schema = "key long, sure double, left double, other double"
    paths = found.sparkSession.createDataFrame(pa.table([pa.array(top[0].nodes.view(np.int64)), *map(pa.array, path)], names=PATHS), schema) if n else found.sparkSession.createDataFrame([], schema)
    for to, lower, size in zip(steps[:0:-1], tables[-2::-1], sizes[-2::-1], strict=True):
        paths = cut(_together(lower, paths, to, size).mapInArrow(releasing(nodes_down(to)), path_schema))
    out = _together(grams_, paths, steps[0], rows + sizes[0])
    return cut(out.mapInArrow(releasing(leaves_down), "key long, n long, bits double"))


@dataclass
class Tree:
    """The tree of counted grams (key, n)."""

    found: DataFrame

    def log2(self, keys: np.ndarray) -> np.ndarray:
        """log2 of the probability of each gram's last byte after the bytes before it."""
        asked = self.found.sparkSession.createDataFrame([(k,) for k in keys.view(np.int64).tolist()], "key long").distinct()
        whole = self.found.unionByName(asked.withColumn("n", F.lit(0).cast("long"))).groupBy("key").agg(F.sum("n").alias("n"))
        bits = dict(costs(whole).join(asked, "key").select("key", "bits").collect())
        return np.array([bits[k] for k in keys.view(np.int64).tolist()])


def grow(counts: DataFrame) -> Tree:
    """The tree of the grams in counts, a table."""
    return Tree(counts.where(F.col("kind") == GRAM).select("key", "n"))


def score(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of every row of df.

    Learns from the rows that aren't held out. A null text is an empty one: its only token is the end, its only byte the
    one that ends it. Rows that repeat a key are scored, and learned from, each. An empty table gives an empty one; if
    nothing is learned, scores are those of the even model. Memory is in proportion to the longest text."""
    given = df.select(F.col(key).alias("key"), F.col(text).alias("text"), held_out(F.col(key)).alias("held_out"))
    counts = cut(count(given.select("text", "held_out")))
    head, others = most_frequent(costs(counts.where(F.col("kind") == GRAM)), HEAD)
    often = head.select("key", "bits").toArrow()  # at most HEAD rows
    keys, bits = often.column(0).to_numpy().view(np.uint64), often.column(1).to_numpy()
    by = np.argsort(keys)
    vocabulary = counts.where(F.col("kind") == WORD).select("key", "n")
    n, v = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    common = vocabulary.where(F.col("n") >= max(1.0, WORD_SHARE * n)).toArrow()  # at most 1 / WORD_SHARE rows
    hashes, times = common.column(0).to_numpy().view(np.uint64), common.column(1).to_numpy()
    order = np.argsort(hashes)
    shared = df.sparkSession.sparkContext.broadcast((keys[by], bits[by], hashes[order], times[order]))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often_keys, often_bits, hashes, times = shared.value

        def told(keys: np.ndarray) -> np.ndarray:
            at, there = find(often_keys, keys)
            return np.where(there, often_bits[at], np.nan) if len(often_keys) else np.full(len(keys), np.nan)

        cost = Memo(told, bits=20)

        def known(h: np.ndarray) -> np.ndarray:
            at, there = find(hashes, h)
            return np.where(there, times[at], 0).astype(np.float64) if len(hashes) else np.zeros(len(h))

        often = Memo(known, bits=18)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for a, b, raw, offsets in pieces(batch.column(1)):
                m, low = b - a, LOWER[raw]
                keys, at = grams(low, offsets, DEPTH + 1, EDGE, end=True)
                each = cost(keys)
                other = np.flatnonzero(np.isnan(each))
                upto = np.searchsorted(other, at).astype(np.int32)
                bits = np.add.reduceat(np.nan_to_num(each), at[:-1])  # each text has its end at least
                h, of = _words(low, offsets)
                h, of = np.r_[h, np.full(m, END)], np.r_[of, np.arange(m)]
                c = often(h)
                base = np.bincount(of, weights=np.where(c > 0, np.log10(c + 0.1), 0.0), minlength=m)
                rare = np.flatnonzero(c == 0)
                rare = rare[np.argsort(of[rare], kind="stable")]
                ends = np.r_[0, np.cumsum(np.bincount(of[rare], minlength=m))].astype(np.int32)
                columns = [
                    pa.array(row + np.arange(m)), batch.column(0).slice(a, m), batch.column(2).slice(a, m),
                    pa.array(np.bincount(of, minlength=m)), pa.array(np.bincount(of[c > 0], minlength=m)), pa.array(base),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(h[rare].view(np.int64))), pa.array(bits), pa.array(np.diff(at)),
                    pa.ListArray.from_arrays(pa.array(upto), pa.array(keys[other].view(np.int64))),
                ]
                row += m
                yield pa.RecordBatch.from_arrays(columns, names=["row", "key", "held_out", "n_tokens", "known", "base", "rare", "bits", "n_bytes", "grams"])

    schema = f"row long, key {kind}, held_out boolean, n_tokens long, known long, base double, rare array<long>, bits double, n_bytes long, grams array<long>"
    rows = cut(given.mapInArrow(releasing(run), schema))
    rare = rows.select("row", F.explode("rare").alias("word"))
    rare = rare.join(vocabulary.toDF("word", "n"), "word", "left").groupBy("row").agg(
        F.count("n").alias("rare_known"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("rare_base")
    )
    out = rows.drop("rare", "grams").join(rare, "row", "left")
    if others is not None:
        more = rows.select("row", F.explode("grams").alias("gram")).groupBy("row", "gram").agg(F.count("*").alias("times"))
        more = more.join(others.select(F.col("key").alias("gram"), F.col("bits").alias("each")), "gram")
        out = out.join(more.groupBy("row").agg(F.sum(F.col("times") * F.col("each")).alias("more")), "row", "left")
        out = out.withColumn("bits", F.col("bits") + F.coalesce("more", F.lit(0.0)))
    each = math.log10(n + 0.1 * (v + 1))
    return out.select(
        F.col("key").alias(key),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * each).alias("base_score"),
        (F.col("bits") * math.log10(2)).alias("score"),
        "n_bytes",
        (-F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"),
    )
