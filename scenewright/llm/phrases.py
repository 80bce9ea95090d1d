"""Phrase collocation mining by suffix automata of bounded depth.

Each shard of texts (a run of whole texts inside a task) becomes one generalised suffix automaton of its pieces' words,
down to DEPTH words. Its nodes are the shard's distinct phrases, level by level: a transition leads from a phrase to
the one with a further word, a suffix link to the one without its first word, and the number of a phrase's end
positions is its count. A phrase whose suffix link has the same count ends wherever its suffix does, so both are one
state, which is given out once: its longest phrase and the length of its shortest. Spark adds up the counts of all
shards.

A phrase is no more frequent than its parts. So before its phrases are given out as text, what can't reach the least
count is pruned: words, then pairs of kept words, then longer phrases of kept pairs are counted under 64-bit hashes,
and those that reach it set a bit in a map of bounded size. A hash that meets another or a bit set twice lets a phrase
through that the exact counts drop in the end; none is lost.

A phrase is subsumed by a longer one with (nearly) its count. As counts fall along every extension, it is enough to
look at those by one word: each phrase hands its count along its suffix link (without its first word) and along the
mirrored one (without its last).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenewright.llm.common import cut, drop_cut, join_hot
from scenewright.llm.textbytes import BASE, LOWER, Counts, mixed, pieces, prefix_hashes, releasing, span_hashes

#: Words of the longest phrase.
DEPTH = 5
#: Bytes of text in a shard; a longer text is a shard of its own.
SHARD = 1 << 21
#: Bits of a map at most, and for each entry.
MOST_BITS, BITS_EACH = 30, 16
#: Slices of a language's phrases, of which each gives its first rows to the last ranking.
SLICES = 64

#: Bytes that end a piece (.,;:!? and 0x0A to 0x0D), and those or blanks, which end a word.
ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAPS = ENDS.copy()
GAPS[[0x20, 0x09]] = True


@dataclass
class Words:
    """The words of a shard in order: where they start and end, hashes that tell languages apart, whether the next
    word belongs to the same piece, and the text that each stands in."""

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    key: np.ndarray
    next: np.ndarray
    text: np.ndarray


def words_of(raw: np.ndarray, offsets: np.ndarray, languages: np.ndarray) -> Words:
    """The words of texts; languages: a hash for each text."""
    raw = LOWER[raw]
    inside = ~GAPS[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops = np.zeros(len(raw) + 1, bool)
    stops[1:] = inside
    stops[1:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops)
    text = np.searchsorted(offsets, start, "right") - 1
    key = mixed(span_hashes(prefix_hashes(raw), start, end) + languages[text]) if len(start) else np.zeros(0, np.uint64)
    piece = np.r_[0, np.cumsum(ENDS[raw])][start]
    follows = np.zeros(len(start), bool)
    follows[:-1] = (text[1:] == text[:-1]) & (piece[1:] == piece[:-1])
    return Words(raw, start, end, key, follows, text)


Passes = Callable[[np.ndarray], np.ndarray]


@dataclass
class Level:
    """The phrases of one length: at each of `at` (the place of the first word) the node `node`; each node's hash, count
    of end positions, and suffix link into the level before."""

    at: np.ndarray
    node: np.ndarray
    key: np.ndarray
    count: np.ndarray
    first: np.ndarray
    link: np.ndarray


def automaton(found: Words, passes: list[Passes | None], depth: int = DEPTH) -> list[Level]:
    """The levels 1 to depth. passes[k - 1] tells by their hashes which phrases of k words are taken in (None: all of
    those whose parts are)."""
    levels: list[Level] = []
    at, pair = np.arange(len(found.key)), found.key
    for k in range(1, depth + 1):
        if k > 1:
            before = levels[-1]
            node = np.full(len(found.key) + 1, -1)
            node[before.at] = before.node
            at = before.at[(node[before.at + 1] >= 0) & found.next[before.at + k - 2]]
            # both parts without an end word are nodes; (node, last word) names the phrase
            pair = mixed(before.key[node[at]] * np.uint64(BASE) + found.key[at + k - 1] + np.uint64(k))
        keep = passes[k - 1] if k <= len(passes) else None
        if keep is not None and len(at):
            good = keep(pair)
            at, pair = at[good], pair[good]
        key, first, own, count = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
        link = node[at[first] + 1] if k > 1 else np.full(len(key), -1)
        levels.append(Level(at, own, key, count, first, link))
    return levels


def states(levels: list[Level]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, nodes, shortest length) of the automaton's states by their longest phrase: a suffix with as many end
    positions belongs to the same state."""
    shortest = [np.full(len(x.key), k) for k, x in enumerate(levels, 1)]
    inner = [np.zeros(len(x.key), bool) for x in levels]
    for k in range(1, len(levels)):
        same = levels[k].count == levels[k - 1].count[levels[k].link]
        shortest[k][same] = shortest[k - 1][levels[k].link[same]]
        inner[k - 1][levels[k].link[same]] = True
    for k, x in enumerate(levels):
        longest = np.flatnonzero(~inner[k])
        yield k + 1, longest, shortest[k][longest]


class Texts:
    """Phrases of a shard as text, their words joined by single blanks."""

    def __init__(self, found: Words):
        size = found.end - found.start
        self.at = np.r_[0, np.cumsum(size + 1)]
        self.joined = np.full(int(self.at[-1]), 0x20, np.uint8)
        shift = np.repeat(self.at[:-1] - np.r_[0, np.cumsum(size)][:-1], size)
        self.joined[np.arange(int(size.sum())) + shift] = found.raw[~GAPS[found.raw]]

    def runs(self, first: np.ndarray, length: int, most: int = 1 << 24) -> Iterator[tuple[slice, pa.Array]]:
        """The phrases of `length` words from each of `first` on, in runs of about `most` bytes."""
        begin = self.at[first]
        total = np.cumsum(self.at[first + length] - 1 - begin)
        done = 0
        while done < len(first):
            before = int(total[done - 1]) if done else 0
            to = max(done + 1, int(np.searchsorted(total, before + most, "right")))
            offsets = np.r_[0, total[done:to] - before].astype(np.int64)
            data = self.joined[np.arange(int(offsets[-1])) + np.repeat(begin[done:to] - offsets[:-1], np.diff(offsets))]
            texts = pa.LargeStringArray.from_buffers(to - done, pa.py_buffer(offsets), pa.py_buffer(data))
            yield slice(done, to), texts.cast(pa.string())
            done = to


def _language_hashes(names: list[str]) -> np.ndarray:
    known = {x: hash_of(x.encode()) for x in set(names)}
    return mixed(np.array([known[x] for x in names], np.uint64))


def hash_of(data: bytes) -> int:
    """A hash of a short string, the same in every process."""
    out = len(data)
    for b in data:
        out = (out * 0x100000001B3 ^ b) & ((1 << 64) - 1)
    return out


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, list[str]]]:
    """Words and languages of the shards of a task's rows (language, text)."""
    for batch in batches:
        for a, b, raw, offsets in pieces(batch.column(1), SHARD):
            names = batch.column(0).slice(a, b - a).to_pylist()
            yield words_of(raw, offsets, _language_hashes(names)), names


class Map:
    """A set of hashes as bits: what was put in is found, and now and then something else."""

    def __init__(self, bits: int, blocks: dict[int, bytes]):
        self.bits, self.map = bits, np.zeros(1 << max(bits - 3, 12), np.uint8)
        for block, data in blocks.items():
            self.map[block * 4096 : (block + 1) * 4096] = np.frombuffer(data, np.uint8)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        place = keys >> np.uint64(64 - self.bits)
        return (self.map[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def bit_map(keys: DataFrame, rows: int) -> Map:
    """The column key of a table as a map of BITS_EACH bits an entry, 2 ** MOST_BITS bits (128 MB) at most."""
    bits = min(MOST_BITS, max(15, (rows * BITS_EACH).bit_length()))
    place = F.shiftrightunsigned("key", 64 - bits) + 1  # Spark's maps count places from 1
    blocks = keys.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("block"))
    found = blocks.agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    return Map(bits, {r.block - 1: bytes(r.bits) for r in found.toLocalIterator()})  # 4 KB each, 2 ** (bits - 15) at most


def _counted(rows: DataFrame, passes: list[Map], depth: int, least: int) -> DataFrame:
    """(lang, key, n): hashes of phrases of more words than there are passes, up to depth, that occur at least `least`
    times; without passes, also each language's number of words, without a key."""
    shared = rows.sparkSession.sparkContext.broadcast(passes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals, sieve = Counts(), {}, shared.value

        def out(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "key", "n"])

        for found, names in _shards(batches):
            for x in automaton(found, sieve, depth)[len(sieve) :]:
                for k, n in counts.add(x.key, x.count):
                    yield out(k, n)
            if not sieve:
                for name, n in zip(names, np.bincount(found.text, minlength=len(names)).tolist(), strict=True):
                    totals[name] = totals.get(name, 0) + n
        for k, n in counts.rest():
            yield out(k, n)
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(totals), pa.nulls(len(totals), pa.int64()), pa.array(totals.values(), pa.int64())], names=["lang", "key", "n"])

    part = rows.mapInArrow(releasing(run), "lang string, key long, n long")
    return part.groupBy("lang", "key").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | F.col("key").isNull())


def _phrases(rows: DataFrame, passes: list[Map], depth: int) -> DataFrame:
    """(lang, phrase, words, f): exact counts of the phrases that passed."""
    shared = rows.sparkSession.sparkContext.broadcast(passes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, names in _shards(batches):
            levels = automaton(found, shared.value, depth)
            texts, names = Texts(found), pa.array(names, pa.string())
            for length, nodes, shortest in states(levels):
                x = levels[length - 1]
                first = x.at[x.first[nodes]]
                for some, longest in texts.runs(first, length):
                    columns = [names.take(pa.array(found.text[first[some]])), longest, pa.array(shortest[some].astype(np.int32)), pa.array(x.count[nodes[some]])]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "longest", "shortest", "n"])

    given = rows.mapInArrow(releasing(run), "lang string, longest string, shortest int, n long")
    given = given.groupBy("lang", "longest", "shortest").agg(F.sum("n").alias("n"))  # before the states are taken apart
    parts = F.split("longest", " ")
    own = given.withColumn("parts", parts).withColumn("words", F.explode(F.sequence("shortest", F.size("parts"))))
    phrase = F.array_join(F.slice("parts", F.size("parts") - F.col("words") + 1, F.col("words")), " ")
    return own.select("lang", phrase.alias("phrase"), "words", "n").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("f"))


def _looked_up(rows: DataFrame, counts: DataFrame, part: str, name: str) -> DataFrame:
    """rows with the count of the phrase in column `part` as column `name`. One word may begin any share of them."""
    key = lambda phrase: F.concat("lang", F.lit("\n"), phrase)  # noqa: E731  no phrase holds a line break
    asked = cut(rows.withColumn("_key", key(F.col(part))))
    n = asked.groupBy("_key").agg(F.count("*").alias("_n"))
    one = counts.select(key(F.col("phrase")).alias("_key"), F.col("f").alias(name)).join(n, "_key")
    return join_hot(asked, cut(one), "_key", "_n", asked.count()).drop("_key")


def score_of(a: str, n: str, left: str, right: str) -> Column:
    """floor(1000 * a * n / (left * right)), exactly: the products are decimals of 38 digits."""
    wide = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    return F.expr(f"(CAST(1000 * {wide(a)} AS DECIMAL(23, 0)) * CAST({n} AS DECIMAL(15, 0))) div CAST({wide(left)} * {wide(right)} AS DECIMAL(38, 0))")


def mine(df: DataFrame, text: str = "text", language: str = "lang", *, least: int = 100, percent: int = 100, depth: int = DEPTH) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all phrases of 2 to depth words that occur at least `least` times in a
    language, but for those inside a longer one with `percent` of their count.

    A null text is empty; a null language is `und`; languages are told apart by their exact names. Texts without words,
    and an empty table, give no rows. Repeated rows count each; other columns are not read. A phrase's words are
    lower-cased in A-Z and joined by single blanks, whatever blanks and tabs stood between them. Of cuts of equal score
    the one after the fewest words counts. Memory is in proportion to the longest text."""
    rows = df.select(F.coalesce(F.col(language).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    passes: list[Map] = []
    totals = None
    for to in (1, 2, depth):  # hashes of words, of pairs of kept words, of longer phrases of kept pairs
        if to < len(passes) + 1:
            continue
        found = cut(_counted(rows, passes, to, least))
        if totals is None:
            totals = found.where("key is null").select("lang", F.col("n").alias("_total"))
        keys = found.where("key is not null")
        known = bit_map(keys, keys.count())
        passes = [*passes, *[known] * (to - len(passes))]
        if len(passes) > 1:
            drop_cut(found)
    counts = cut(_phrases(rows, passes, depth).where(F.col("f") >= least))

    candidates = counts.where("words > 1").withColumnRenamed("f", "a")
    parts = F.split("phrase", " ")
    cuts = candidates.withColumn("_parts", parts).withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select(
        "lang", "phrase", "a", "_k",
        F.array_join(F.slice("_parts", F.lit(1), F.col("_k")), " ").alias("_left"),
        F.array_join(F.slice("_parts", F.col("_k") + 1, F.size("_parts")), " ").alias("_right"),
    )
    cuts = _looked_up(_looked_up(cuts, counts, "_left", "l").drop("_left"), counts, "_right", "r").drop("_right")
    per = totals.join(cuts.groupBy("lang").agg(F.count("*").alias("_n")), "lang")
    cuts = join_hot(cuts, per, "lang", "_n", cuts.count())
    cuts = cuts.withColumn("score", score_of("a", "_total", "l", "r"))
    worst = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "_k", "l", "r", "a", F.col("_total").alias("n"))).alias("x"))

    longer = candidates.where("words > 2").withColumn("_parts", parts)
    shorter = F.array(F.slice("_parts", F.lit(2), F.size("_parts") - 1), F.slice("_parts", F.lit(1), F.size("_parts") - 1))
    inner = longer.withColumn("_in", F.explode(F.transform(shorter, lambda w: F.array_join(w, " "))))
    inner = inner.groupBy("lang", F.col("_in").alias("phrase")).agg(F.max("a").alias("_longer"))
    out = worst.join(inner, ["lang", "phrase"], "left")
    out = out.where(F.expr(f"_longer is null or 100 * cast(_longer as decimal(20, 0)) < {int(percent)} * cast(x.a as decimal(20, 0))"))
    return out.select("lang", "phrase", "x.a", "x.l", "x.r", "x.n", "x.score")


def top(mined: DataFrame, most: int) -> DataFrame:
    """The first `most` of each language by score and a, both falling, and phrase, with rank from 1.

    A language's phrases are ranked in SLICES slices first, so no task ranks more than most x SLICES of them at the end."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    sliced = mined.withColumn("_slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES)))
    sliced = sliced.withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_slice").orderBy(*order))).where(F.col("_place") <= most)
    ranked = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
