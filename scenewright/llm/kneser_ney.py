"""Quality rules: n-gram perplexity of a modified Kneser-Ney model, with bands for each language.

The grams are of bytes, ORDER long. Spark counts them over all documents, each language its own; continuation counts of
the shorter orders, the discounts and the contexts' sums come from those counts by grouping. All counted grams are in
the model (LEAST can raise that: a gram left out gives its weight to the shorter context, and each context's
probabilities still add up to one).

The model is a table for each order. Joining them gives the cost of every distinct gram of the texts. The HEAD most
frequent grams, at most, are broadcast as sorted arrays; the others, which are few of a text's, are joined by text.

A document's verdict is its mean log-perplexity a byte against its language's band. The band reaches so many times from
the median of all documents that pass the base rules to their lower and upper quartiles. How many times, the documents
labelled good say, LOST of which may lie outside on each side: those of the language itself, weighed by their number
against OTHERS, and those of all languages, by one formula for any number of labels. Without labels it is BELOW and
ABOVE. The bands come from exact counts in bins of equal width, so they are the same in every run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenewright.llm.common import cut, most_frequent
from scenewright.llm.textbytes import LOWER, SPACE, Counts, Memo, find, grams, mixed, per_text, pieces, prefix_hashes, releasing, span_hashes, words

ORDER = 5
#: The occurrences in its language that a gram in the model has at least: all are in it.
LEAST = 1
#: Languages with a model of their own, the most frequent ones; all others, and null, share one.
MOST_LANGUAGES = 1 << 16
#: Grams whose costs are broadcast, at most.
HEAD = 1 << 21
#: Labelled good documents that may lie below the band, and above it, and how many of its own weigh as much in a
#: language's band as those of all languages.
LOST, OTHERS = 0.01, 200
#: The band's reach without labels below and above the median, in distances to the lower and the upper quartile, and the
#: width of the bins, in which the quartiles are told (a distance is one bin at least), and of those of the reach.
BELOW, ABOVE = 8.0, 8.0
BIN, REACH_BIN = 1e-4, 0.01
#: Fixed values of the query's contract.
SYMBOLS, LEAST_WORDS, MOST_REPEATED = b"#*$%&|<>", 50, 50

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
#: Lower-case letters; all white space is a blank.
_FOLD = np.where(SPACE, np.uint8(32), LOWER)


def _low(k: int) -> Column:
    return F.col("key").bitwiseAND((1 << 8 * k) - 1)


def _above() -> Column:
    """The language of a packed gram, above its bytes."""
    return F.shiftleft(F.shiftright(F.col("key"), 8 * ORDER), 8 * ORDER)


@dataclass
class Model:
    """grams: (key, n) of all grams of the texts. orders, from 1 on: grams with their discounted share (key, u), and
    contexts with the weight of the next shorter one (key, b). Languages have numbers from 1; 0 is for all others."""

    languages: dict[str, int]
    grams: DataFrame
    orders: list[tuple[DataFrame, DataFrame]]

    def costs(self, asked: DataFrame) -> DataFrame:
        """(key, n, nats) of asked (key, n): -ln of the probability of each gram's last byte after those before it."""
        out = asked.select("key", "n", F.lit(1 / 256).alias("p"))
        few = len(self.languages) <= 1000
        for k, (shares, weights) in enumerate(self.orders, 1):
            # at most 256 rows of a language are sent to all tasks
            shares = F.broadcast(shares) if few and k == 1 else shares
            weights = F.broadcast(weights) if few and k <= 2 else weights
            out = out.withColumn("gram", _above() + _low(k)).withColumn("context", _above() + F.shiftright(_low(k), 8))
            out = out.join(shares.toDF("gram", "u"), "gram", "left").join(weights.toDF("context", "b"), "context", "left")
            out = out.select("key", "n", (F.coalesce("b", F.lit(1.0)) * F.col("p") + F.coalesce("u", F.lit(0.0))).alias("p"))
        return out.select("key", "n", (-F.ln("p")).alias("nats"))


def _language_keys(column: pa.Array, languages: dict[str, int]) -> np.ndarray:
    named = column.cast(pa.string()).to_pylist()
    return np.array([languages.get(x, 0) for x in named], np.uint64) << np.uint64(8 * ORDER)


def count_grams(df: DataFrame, text: str, language: str, languages: dict[str, int]) -> DataFrame:
    """(key, n) of all grams of all texts: counted in each task, then added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        out = lambda k, n: pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], names=["key", "n"])
        for batch in batches:
            of = _language_keys(batch.column(1), languages)
            for a, b, raw, offsets in pieces(batch.column(0)):
                keys, at = grams(_FOLD[raw], offsets, ORDER, 32)
                for k, n in counts.add(keys | np.repeat(of[a:b], np.diff(at))):
                    yield out(k, n)
        for k, n in counts.rest():
            yield out(k, n)

    part = df.select(F.col(text).alias("text"), F.col(language).alias("language")).mapInArrow(releasing(run), "key long, n long")
    return part.groupBy("key").agg(F.sum("n").alias("n"))


def train(df: DataFrame, text: str = "text", language: str = "lang") -> Model:
    """The model of all documents of df, each language's own; documents of a null one share a model."""
    per = df.groupBy(F.col(language).cast("string").alias("language")).agg(F.count("*").alias("n"))
    common = per.where("language is not null").orderBy(F.desc("n"), "language").limit(MOST_LANGUAGES)
    languages = {r[0]: i + 1 for i, r in enumerate(sorted(common.select("language").collect()))}
    grams = cut(count_grams(df, text, language, languages))
    level, orders = grams.select("key", F.col("n").alias("a"), F.col("n").alias("raw")), []
    for k in range(ORDER, 0, -1):
        spread = level.groupBy(_above().alias("language")).agg(*[F.count_if(F.col("a") == i).alias(f"n{i}") for i in (1, 2, 3, 4)])
        n1, n2, n3, n4 = (F.col(f"n{i}").cast("double") for i in (1, 2, 3, 4))
        # the discounts of counts 1, 2 and 3 or more; without such counts in the corpus, the plain half
        over = lambda a, b: F.when(b > 0, a / b)
        y = over(n1, n1 + 2 * n2)
        fall = lambda e, top: F.least(F.greatest(F.coalesce(e, F.lit(0.5)), F.lit(0.05)), F.lit(float(top)))
        discounts = spread.select(
            "language",
            fall(1 - 2 * y * over(n2, n1), 0.95).alias("d1"),
            fall(2 - 3 * y * over(n3, n2), 1.95).alias("d2"),
            fall(3 - 4 * y * over(n4, n3), 2.95).alias("d3"),
        )
        context = (_above() + F.shiftright(_low(k), 8)).alias("context")
        told = level.select("key", "a", "raw", _above().alias("language"), context).join(F.broadcast(discounts), "language")  # one row a language
        d = F.when(F.col("a") == 1, F.col("d1")).when(F.col("a") == 2, F.col("d2")).otherwise(F.col("d3"))
        told = told.withColumn("u", F.when(F.col("raw") >= LEAST, F.col("a") - d))
        sums = told.groupBy("context").agg(F.sum("a").alias("all"), F.sum("u").alias("held"))
        weights = cut(sums.where("held is not null").select(F.col("context").alias("key"), "all", F.greatest(1 - F.col("held") / F.col("all"), F.lit(1e-9)).alias("b")))
        per_context = weights.select(F.col("key").alias("context"), "all")
        shares = told.where("u is not null").join(F.broadcast(per_context) if k == 1 else per_context, "context")
        orders.append((cut(shares.select("key", (F.col("u") / F.col("all")).alias("u"))), weights.select("key", "b")))
        if k > 1:
            level = cut(level.groupBy((_above() + _low(k - 1)).alias("key")).agg(F.count("*").alias("a"), F.sum("raw").alias("raw")))
    return Model(languages, grams, orders[::-1])


def base_counts(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n = len(offsets) - 1
    within = lambda marks: np.diff(np.r_[0, np.cumsum(marks)][offsets])
    starts, ends, text = words(raw, offsets)
    n_words = np.bincount(text, minlength=n)
    chars = within(~SPACE[raw] & ((raw & 0xC0) != 0x80))
    symbols = within(_IS_SYMBOL[raw])
    hashes = prefix_hashes(raw)

    breaks = np.flatnonzero(raw == 10)
    line_starts = np.unique(np.r_[offsets[:-1], breaks + 1])
    line_starts = line_starts[line_starts < len(raw)]
    line_text = np.searchsorted(offsets, line_starts, "right") - 1
    line_ends = np.minimum(np.r_[breaks, len(raw)][np.searchsorted(breaks, line_starts)], offsets[line_text + 1])
    has = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, line_text = line_starts[has], line_ends[has], line_text[has]
    of_line = mixed(span_hashes(hashes, line_starts, line_ends) + mixed(line_text.astype(np.uint64)))
    _, first = np.unique(of_line, return_index=True)
    dup_lines = np.bincount(line_text, minlength=n) - np.bincount(line_text[first], minlength=n)

    repeated = np.zeros(n, np.int64)
    if len(starts) > 2:
        h = span_hashes(hashes, starts, ends)
        one = np.flatnonzero(text[2:] == text[:-2])
        window = mixed(mixed(mixed(h[one]) + h[one + 1]) + h[one + 2] + mixed(text[one].astype(np.uint64)))
        order = np.argsort(window)
        same = window[order[1:]] == window[order[:-1]]
        twice = np.zeros(len(one), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(len(starts), bool)
        for i in range(3):
            covered[one[twice] + i] = True
        repeated = np.bincount(text[covered], minlength=n)
    return [x.astype(np.int64) for x in (n_words, chars, symbols, dup_lines, repeated)]


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measure(df: DataFrame, model: Model, text: str = "text", language: str = "lang", carry: list[str] | None = None) -> DataFrame:
    """The columns of df named in carry (all, if None) with MEASURES, n_bytes and nats (the text's -ln probability).
    df is what the model was trained on, or a part of it.

    Null is an empty text, whose nats are 0. Repeated rows are measured each; an empty table gives an empty one. Memory
    is in proportion to the longest text. Columns of df named like the new ones are replaced."""
    df = df.drop(*[c for c in (*MEASURES, "n_bytes", "nats") if c not in (text, language)])
    head, others = most_frequent(cut(model.costs(model.grams)), HEAD)
    often = head.select("key", "nats").toArrow()  # at most HEAD rows
    keys, nats = often.column(0).to_numpy().view(np.uint64), often.column(1).to_numpy()
    order = np.argsort(keys)
    shared = df.sparkSession.sparkContext.broadcast((keys[order], nats[order], model.languages))
    names = df.columns if carry is None else carry
    schema = ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)
    given = df.select(*[F.col(f"`{n}`") for n in names], F.col(text).alias("_measured_text"), F.col(language).alias("_measured_language"))
    i, j = len(names), len(names) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often_keys, often_nats, languages = shared.value

        def told(keys: np.ndarray) -> np.ndarray:
            at, there = find(often_keys, keys)
            return np.where(there, often_nats[at], np.nan) if len(often_keys) else np.full(len(keys), np.nan)

        cost, row = Memo(told, bits=19), TaskContext.get().partitionId() << 33
        for batch in batches:
            of = _language_keys(batch.column(j), languages)
            for a, b, raw, offsets in pieces(batch.column(i)):
                m = b - a
                keys, at = grams(_FOLD[raw], offsets, ORDER, 32)
                keys |= np.repeat(of[a:b], np.diff(at))
                each = cost(keys)
                other = np.flatnonzero(np.isnan(each))
                total = per_text(np.nan_to_num(each), np.repeat(np.arange(m), np.diff(at)), m)
                rest = pa.ListArray.from_arrays(pa.array(np.searchsorted(other, at).astype(np.int32)), pa.array(keys[other].view(np.int64)))
                added = [*base_counts(raw, offsets), np.diff(offsets), total]
                columns = [*[batch.column(c).slice(a, m) for c in range(len(names))], *map(pa.array, added), pa.array(row + np.arange(m)), rest]
                row += m
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *MEASURES, "n_bytes", "nats", "_row", "_rest"])

    added = ", ".join(f"{m} long" for m in MEASURES) + ", n_bytes long, nats double, _row long, _rest array<long>"
    out = given.mapInArrow(releasing(run), f"{schema}, {added}")
    if others is None:
        return out.drop("_row", "_rest")
    out = cut(out)
    rest = out.select("_row", F.explode("_rest").alias("key")).groupBy("_row", "key").agg(F.count("*").alias("_times"))
    rest = rest.join(others.select("key", F.col("nats").alias("_each")), "key").groupBy("_row").agg(F.sum(F.col("_times") * F.col("_each")).alias("_more"))
    out = out.drop("_rest").join(rest, "_row", "left").withColumn("nats", F.col("nats") + F.coalesce("_more", F.lit(0.0)))
    return out.drop("_row", "_more")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _quantiles(df: DataFrame, by: list[str], value: Column, width: float, **which: float) -> DataFrame:
    """(by..., all, name...): the quantiles of value in each group, told in bins, and the number of its rows."""
    counts = df.groupBy(*by, F.floor(value / width).cast("long").alias("_bin")).agg(F.count("*").alias("_n"))
    sums = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*by).orderBy("_bin"))).withColumn("_all", F.sum("_n").over(Window.partitionBy(*by)))
    at = lambda q: (F.min(F.when(F.col("_upto") >= q * F.col("_all"), F.col("_bin"))) + 0.5) * width
    return sums.groupBy(*by).agg(F.max("_all").alias("all"), *[at(q).alias(name) for name, q in which.items()])


def bands(measured: DataFrame, language: str = "lang", good: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """(language, lower, upper) in nats a byte, of documents that pass the base rules; one row per language.

    good: (key) of documents labelled good; keys that are null have no label. A document on an edge is inside."""
    x = F.col("nats") / F.col("n_bytes")
    passed = measured.where(~base_failed()).withColumn("language", F.col(language))
    found = _quantiles(passed, ["language"], x, BIN, q1=0.25, q2=0.5, q3=0.75)
    down, up = F.greatest(F.col("q2") - F.col("q1"), F.lit(BIN)), F.greatest(F.col("q3") - F.col("q2"), F.lit(BIN))
    below, above = F.lit(BELOW), F.lit(ABOVE)
    found = found.select("language", "q2", down.alias("down"), up.alias("up"))
    if good is not None:
        found = cut(found)
        labelled = passed.join(good.select(F.col(key).alias(key)).distinct(), key, "left_semi").select(F.col("language").alias("of"), x.alias("x"))
        labelled = cut(labelled.join(found, F.col("of").eqNullSafe(F.col("language"))).select("of", ((F.col("q2") - F.col("x")) / F.col("down")).alias("below"), ((F.col("x") - F.col("q2")) / F.col("up")).alias("above")))
        told = lambda by, side, n: _quantiles(labelled, by, F.col(side), REACH_BIN, reach=1 - LOST).select(*by, F.col("all").alias(f"n_{n}"), F.col("reach").alias(n))
        for side, usual in (("below", BELOW), ("above", ABOVE)):
            every = told([], side, f"all_{side}").first()  # one row; nulls without labels
            pooled = usual if every is None or every[1] is None else float(every[1])
            own = told(["of"], side, f"own_{side}")
            found = found.join(own, F.col("language").eqNullSafe(F.col("of")), "left").drop("of")
            n = F.coalesce(f"n_own_{side}", F.lit(0))
            reach = (n * F.coalesce(f"own_{side}", F.lit(0.0)) + OTHERS * pooled) / (n + OTHERS) + REACH_BIN
            found = found.withColumn(side, reach).drop(f"n_own_{side}", f"own_{side}")
        below, above = F.col("below"), F.col("above")
    return found.select("language", (F.col("q2") - below * F.col("down") - BIN).alias("lower"), (F.col("q2") + above * F.col("up") + BIN).alias("upper"))


def judge(measured: DataFrame, found: DataFrame, language: str = "lang") -> DataFrame:
    """measured with nats_per_byte, base_failed, lower, upper and kept. A document of a language without a band, as no
    document of it passes the base rules, fails them itself."""
    measured = measured.drop("nats_per_byte", "base_failed", "lower", "upper", "kept")
    told = found.withColumnRenamed("language", "_language")
    out = measured.join(told, measured[language].eqNullSafe(told["_language"]), "left").drop("_language")
    out = out.withColumn("nats_per_byte", F.when(F.col("n_bytes") > 0, F.col("nats") / F.col("n_bytes")))
    out = out.withColumn("base_failed", base_failed())
    inside = F.col("nats_per_byte").between(F.col("lower"), F.col("upper"))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))
