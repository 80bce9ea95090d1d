"""Secret scans with DataFrame functions only.

Three known kinds are found by their form. What else may be a secret is a run of at least MIN_RUN letters, digits and
signs outside those, or what such spans leave of a longer run; two first-order Markov models of characters, one of random strings and one of ordinary
identifiers, score it, and it is a secret if random strings explain it better by MARGIN nats. Both models are counted
from labelled samples and come as one table of log-likelihood ratios, of fixed size.

Spans count code points of the text, the end excluded.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the query's contract: kind, pattern, least length, and the group whose length counts.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = [("assign", ASSIGN, 12, 2), ("access", "AKIA[A-Z0-9]+", 18, 0), ("hex", "[0-9a-f]+", 16, 0)]
#: The same spans, with a pattern that doesn't stop at each short run.
QUICK = {"access": "AKIA[A-Z0-9]{14,}", "hex": "[0-9a-f]{16,}"}

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
#: Place 0 is the start of a string and any other character.
SIZE = len(ALPHABET) + 1
MIN_RUN = 12
RUN = f"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}"
#: The log-odds that a random string must have over an identifier: secrets are rare among long runs.
MARGIN = 10.0
#: Bounds of the labelled sample: strings of each label, and documents from which identifiers are taken (expected).
SAMPLES, SAMPLE_DOCS = 20_000, 2_000

#: Two private-use characters: one parts matches from the rest, the other stands in for it where a text has it.
MARK, OTHER = "\ue000", "\ue001"
#: Parts of a text that are summed up together; even, as every other one is a match.
CHUNK = 512
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spans(text: Column, pattern: str, kind: int) -> Column:
    """The leftmost non-overlapping matches as an array of (start, kind, end, value). Null and no match give none."""
    none = F.array().cast(SPAN)
    # parts are summed up in chunks of even length, as arrays that grow part by part cost the square of their number
    parts = F.split(F.regexp_replace(F.translate(text, MARK, OTHER), F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK)
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("match"), none.alias("out"))

    def step(s: Column, part: Column) -> Column:
        end = s["at"] + F.length(part)
        one = F.array(F.struct(s["at"].alias("start"), F.lit(kind).alias("kind"), end.alias("end"), part.alias("value")))
        out = F.when(s["match"], F.concat(s["out"], one)).otherwise(s["out"])
        return F.struct(end.alias("at"), (~s["match"]).alias("match"), out.alias("out"))

    moved = lambda x, by: F.transform(
        x["out"], lambda m: F.struct((m["start"] + by).alias("start"), m["kind"].alias("kind"), (m["end"] + by).alias("end"), m["value"].alias("value"))
    )

    def in_order(told: Column) -> Column:
        before = F.aggregate(
            F.transform(told, lambda x: x["at"]),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda s, at: F.struct((s["at"] + at).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")),
            lambda s: s["out"],
        )
        return F.flatten(F.zip_with(told, before, moved))

    def summed(parts: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / CHUNK).cast("int")), lambda i: F.slice(parts, i * CHUNK + 1, F.lit(CHUNK)))
        return let(F.transform(chunks, lambda c: F.aggregate(c, start, step)), in_order)

    found = let(parts, summed)
    return F.when(F.rlike(F.coalesce(text, F.lit("")), F.lit(pattern)), found).otherwise(none)


def left_of(run: Column, taken: Column) -> Column:
    """What the spans in taken, in order of start, leave of a run: an array of spans, in order."""

    def part(a: Column, b: Column) -> Column:
        value = F.substring(run["value"], a - run["start"] + 1, b - a)
        return F.struct(a.alias("start"), run["kind"].alias("kind"), b.alias("end"), value.alias("value"))

    def parted(over: Column) -> Column:
        ends = F.transform(over, lambda _, i: F.array_max(F.transform(F.slice(over, F.lit(1), i + 1), lambda b: b["end"])))
        stops = F.concat(F.transform(over, lambda b: b["start"]), F.array(run["end"]))
        left = F.filter(F.zip_with(F.concat(F.array(run["start"]), ends), stops, part), lambda s: s["end"] > s["start"])
        return F.when(F.size(over) == 0, F.array(run)).otherwise(left)

    return let(F.filter(taken, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"])), parted)


def _long_enough(pattern: str, group: int, least: int) -> Callable[[Column], Column]:
    return lambda s: F.length(F.regexp_extract(s["value"], pattern, group)) >= least


def base_spans(text: Column) -> list[Column]:
    """The spans of each known kind, short ones dropped."""
    out = []
    for k, (kind, pattern, least, group) in enumerate(BASE):
        found = spans(text, QUICK.get(kind, pattern), k)
        if group:  # the length that counts is a part's
            found = F.filter(found, _long_enough(pattern, group, least))
        out.append(found)
    return out


def labelled_samples(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(value, random) strings to train on. Random: digests in hexadecimal, base 64 and base 62, of several lengths.
    Ordinary: words of a hashed sample of about SAMPLE_DOCS documents, alone and joined into identifiers."""
    spark = docs.sparkSession
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 512)
    in_64 = F.base64(F.unhex(digest))
    plain = F.regexp_replace(in_64, "[^A-Za-z0-9]", "")
    form = F.element_at(F.array(digest, F.upper(digest), in_64, plain, plain, F.upper(plain)), (F.pmod("id", F.lit(6)) + 1).cast("int"))
    length = (F.lit(16) + F.pmod(F.xxhash64("id"), F.lit(33))).cast("int")
    random = spark.range(SAMPLES).select(F.substring(F.regexp_replace(form, r"[\r\n]", ""), F.lit(1), length).alias("value"), F.lit(1).alias("random"))

    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    drawn = docs.where(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    words = drawn.select(F.explode(F.split(text, r"[\x20\x09-\x0D]+")).alias("word"))
    words = words.where(F.rlike("word", F.lit(r"^[A-Za-z]{3,}[.,;:!?]?$"))).select(F.regexp_replace("word", "[.,;:!?]$", "").alias("word"))
    words = words.distinct().orderBy(F.xxhash64("word")).limit(SAMPLES)
    turn = F.pmod(F.xxhash64(F.lit("form"), "word"), F.lit(5))
    mate = F.reverse(F.substring("word", 1, 1))
    joined = (
        F.when(turn == 0, F.concat("word", F.lit("_"), F.lower("word")))
        .when(turn == 1, F.concat("word", F.lit("-"), F.lower("word")))
        .when(turn == 2, F.concat(F.lower("word"), F.upper(mate), F.substring(F.lower("word"), F.lit(2), F.length("word"))))
        .when(turn == 3, F.concat(F.lower("word"), F.lit("/"), F.lower("word")))
        .otherwise(F.concat("word", F.lit("_"), F.upper("word")))
    )
    ordinary = words.select(F.explode(F.array("word", F.lower("word"), joined)).alias("value"), F.lit(0).alias("random"))
    return random.unionByName(ordinary)


def _places(value: Column) -> Column:
    """The places in the alphabet of a string's characters; 0 for any other."""
    return F.transform(F.split(value, ""), lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(ALPHABET), c)))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios, random over ordinary, of each character after each other: SIZE x SIZE numbers.

    samples: (value, random) with 1 for random strings and 0 for ordinary ones; other labels and null values don't
    count. Each character starts with SIZE / 2 successors, dealt as the label's characters are (half a count added to
    each), so a character that no sample had is followed by the usual ones, and any label may be empty."""
    at = _places(F.col("value"))
    pairs = F.zip_with(F.concat(F.array(F.lit(0)), at), at, lambda a, b: a * SIZE + b)
    pairs = F.slice(pairs, F.lit(1), F.size(at))
    counted = (
        samples.where("value != '' and random in (0, 1)")
        .select("random", F.explode(pairs).alias("pair"))
        .groupBy("random", "pair")
        .agg(F.count("*").alias("n"))
    )
    told, usual = counted.collect(), [[0.5] * SIZE for _ in range(2)]  # 2 x SIZE x SIZE rows at most
    for label, pair, count in told:
        usual[label][pair % SIZE] += count
    n = [[SIZE / 2 * x / sum(u) for x in u] * SIZE for u in usual]
    for label, pair, count in told:
        n[label][pair] += count
    total = [[sum(x[a * SIZE : (a + 1) * SIZE]) for a in range(SIZE)] for x in n]
    return [math.log(n[1][i] / total[1][i // SIZE]) - math.log(n[0][i] / total[0][i // SIZE]) for i in range(SIZE * SIZE)]


def log_odds(value: Column, model: list[float]) -> Column:
    """The summed log-likelihood ratio of a string's characters. Null gives null, the empty string 0."""
    table = F.lit([float(x) for x in model])
    start = F.struct(F.lit(0).alias("before"), F.lit(0.0).alias("sum"))

    def step(s: Column, c: Column) -> Column:
        return F.struct(c.alias("before"), (s["sum"] + F.element_at(table, s["before"] * SIZE + c + 1)).alias("sum"))

    return F.aggregate(F.filter(_places(value), lambda c: c.isNotNull()), start, step, lambda s: s["sum"])


def scan(df: DataFrame, model: list[float], text: str = "text", margin: float = MARGIN) -> DataFrame:
    """df with base_spans and secret_spans: arrays of (start, kind, end, value) by start, then kind. kind is the place
    in assign, access, hex, random; secret_spans has all four.

    A null or empty text has none. Repeated rows are scanned alike; an empty table gives an empty one. Columns of df
    named like the new ones are replaced."""
    df = df.drop("base_spans", "secret_spans")
    value = F.coalesce(F.col(text), F.lit(""))
    found = df.withColumn("base_spans", F.array_sort(F.concat(*base_spans(value))))
    runs = lambda base: F.flatten(F.transform(spans(value, RUN, len(BASE)), lambda r: left_of(r, base)))
    likely = let(F.col("base_spans"), lambda base: F.filter(runs(base), lambda s: (F.length(s["value"]) >= MIN_RUN) & (log_odds(s["value"], model) >= margin)))
    found = found.withColumn("_random_spans", F.when(F.rlike(value, F.lit(RUN)), likely).otherwise(F.array().cast(SPAN)))
    return found.withColumn("secret_spans", F.array_sort(F.concat("base_spans", "_random_spans"))).drop("_random_spans")


KINDS = ["assign", "access", "hex", "random"]


def n_of(found: Column, kind: str) -> Column:
    """How many spans are of that kind."""
    return F.size(F.filter(found, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def listed(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, found: Column, put: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced; found is in order of start. Null stays null."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, span: Column) -> Column:
        gap = F.substring(text, s["at"] + 1, span["start"] - s["at"])
        out = F.when(span["start"] >= s["at"], F.concat(s["out"], F.array(gap, F.lit(put)))).otherwise(s["out"])
        return F.struct(F.greatest(s["at"], span["end"]).alias("at"), out.alias("out"))

    rest = lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text)))
    return F.when(F.size(found) > 0, F.aggregate(found, start, step, rest)).otherwise(text)


def model_of(docs: DataFrame, text: str = "text", key: str = "doc_id") -> list[float]:
    """A model trained on labelled_samples() of these documents."""
    return train(labelled_samples(docs, text, key))

