"""Harmonic packing of tokenized documents into sequences of fixed capacity.

Class j of the harmonic partition holds lengths above C/(j+1) and up to C/j, and each of its sequences takes exactly j
pieces, whatever they are, so that workers fill sequences without knowing of each other. A document is cut so that its
pieces all but fill their shares: first as many whole sequences as it has, then, of the rest, the piece that exactly
fills the share of the next class, until a piece of at least FILL of its share is left. So a sequence of class j has
at most 1 - FILL of padding and the rounding of C/j.

Pieces of a class are numbered without gaps in slices; number // j is the sequence. What doesn't fill up its class's
last sequence, fewer than j pieces of each class and so bounded by the capacity alone, goes into common sequences.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenewright.llm.common import cut, gapless
from scenewright.llm.textbytes import release, releasing

#: A piece stays whole if it has so much of its class's share.
FILL = 0.99
#: Chunks of text whose ids a worker remembers.
REMEMBERED = 20_000
#: The id that ends each document.
END = 0


def cuts(length: int, capacity: int, fill: float = FILL) -> list[int]:
    """The lengths of a document's pieces, in order."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        share = capacity // (capacity // rest)  # of the class that this length belongs to
        if rest < fill * share:
            share = capacity // (capacity // rest + 1)
        out.append(min(rest, share))
        rest -= out[-1]
    return out


class Ids:
    """Token ids of texts as little-endian 32-bit bytes, by a tokenizers file.

    A text of plain scripts is encoded whole, from the file's vocabulary. Others are cut into chunks, of which the plain
    ones take the same way and the rest goes to the tokenizer itself.

    A byte-level tokenizer of this kind never joins a blank that stands before a letter, digit or sign with what
    stands before it. So a text may be cut before each such blank, and the ids of the chunks, mostly words that come
    again and again, are remembered. The cut needs a plain blank followed by something that is no white space; texts
    where a blank is followed by other white space are cut with a pattern instead."""

    def __init__(self, file: bytes, remembered: int = REMEMBERED):
        self.file, self.size = file, remembered
        self.known, self.older = {}, {}  # what was met lately, and before that
        self.odd, self.apart = re.compile(r" (?:\s|\Z)"), re.compile(r" (?=\S)")
        self.ranks = _ranked(json.loads(file))

    @functools.cached_property
    def tokenizer(self):
        """The file's own tokenizer, made when the first text needs it: it takes much memory."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.file.decode())

    def of(self, text: str) -> bytes:
        if self.ranks is not None and _plain(text):  # whole, by the quicker of two encoders of one file
            return self._ranks(text)
        odd = self.odd.search(text) is not None
        first, *rest = self.apart.split(text) if odd else text.split(" ")
        out = [self._new([first], "")[0]]
        try:
            out.append(b"".join([self.known[x] for x in rest]))
        except KeyError:
            missing = {x for x in rest if x not in self.known}
            if len(self.known) + len(missing) > self.size:  # words that come often pass over to the new table
                self.known, self.older, missing = {}, self.known, set(rest)
            known, older = self.known, self.older
            known.update([(x, older[x]) for x in missing if x in older])
            missing = [x for x in missing if x not in known]
            known.update(zip(missing, self._new(missing, " "), strict=True))
            out.append(b"".join([known[x] for x in rest]))
        return b"".join(out)

    def _ranks(self, text: str) -> bytes:
        """The ids of a plain text by the encoder of ranks.

        Its pattern goes back over white space step by step and ends in an error on runs of several hundred thousand.
        Of a run of white space all but the last character make one part of the text, whatever stands around it (at the
        text's end, the last one too), so a long run's part is merged by itself and the pattern never sees it."""
        out, at = [], 0
        for run in LONG_SPACE.finditer(text):
            end = run.end() - (run.end() < len(text))
            out.append(self.ranks.encode_to_numpy(text[at : run.start()]))
            out.append(np.array(self.ranks._core_bpe.encode_single_piece(text[run.start() : end].encode()), np.uint32))
            at = end
        if not out:
            return self.ranks.encode_to_numpy(text).astype("<u4", copy=False).tobytes()
        out.append(self.ranks.encode_to_numpy(text[at:]))
        return np.concatenate(out).astype("<u4", copy=False).tobytes()

    def _new(self, chunks: list[str], before: str) -> list[bytes]:
        out, slow = [b""] * len(chunks), []
        for i, x in enumerate(chunks):
            if self.ranks is None or not _plain(x):
                slow.append(i)
            else:
                out[i] = self._ranks(before + x)
        if slow:
            found = self.tokenizer.encode_batch_fast([before + chunks[i] for i in slow], add_special_tokens=False)
            for i, x in zip(slow, found, strict=True):
                out[i] = _little(x.ids)
        return out


def _plain(text: str) -> bool:
    """Whether both libraries see the text alike: scripts whose letters and numbers they class alike, no special token."""
    return (text.isascii() or max(text) < PLAIN) and "<|" not in text


def _little(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


#: Fixed values of byte-level tokenizers: how they part a text, and the first character past the plain scripts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = "\u0250"
#: White space of the plain scripts, in runs that the pattern had better not see.
LONG_SPACE = re.compile("[\t-\r \x85\xa0]{4096,}")


def _ranked(told: dict):
    """The file's vocabulary as an encoder by ranks, if it is plain byte-level BPE whose ids are the ranks of its
    merges; else None."""
    split, model = told.get("pre_tokenizer") or {}, told["model"]
    vocabulary, merges = model.get("vocab"), model.get("merges") or []
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    if model.get("type") != "BPE" or not plain or told.get("normalizer") or told.get("post_processor"):
        return None
    pairs = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
    if any(vocabulary.get(m) != 256 + i for i, m in enumerate(pairs)):
        return None
    import tiktoken

    # printable bytes stand for themselves, the others for the characters from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = {x["content"] for x in told.get("added_tokens") or []}
    ranks = {bytes(byte[c] for c in t): i for t, i in vocabulary.items() if t not in special}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=1)
def encoder(file: bytes) -> Ids:
    """The worker's encoder of this file: Spark's Python workers live on from task to task, and so does what it
    remembers."""
    found = Ids(file)
    release()  # what reading the file took
    return found


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def pieces(df: DataFrame, keys: list[str], text: str, tokenizer: bytes, capacity: int, *, ids: bool = False) -> DataFrame:
    """The pieces of each document: keys, start, length, ids_crc32, doc_tokens and, if asked for, ids (32-bit little
    endian). A null text is an empty one: its only id is the one that ends it."""
    kept = df.select(*[F.col(k) for k in keys], F.col(text).alias("_pack_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]), PIECES])
    end = np.array([END], "<u4").tobytes()
    step = 512

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = encoder(tokenizer)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                rows, start, length, crc, total, got = [], [], [], [], [], []
                for i, value in enumerate(batch.column(len(keys)).to_pylist()):
                    data = (find.of(value) if value else b"") + end
                    a, n = 0, len(data) // 4
                    for size in cuts(n, capacity):
                        part = data[4 * a : 4 * (a + size)]
                        rows.append(i)
                        start.append(a)
                        length.append(size)
                        crc.append(zlib.crc32(part))
                        total.append(n)
                        got.append(part if ids else None)
                        a += size
                cols = [batch.column(k).take(pa.array(rows, pa.int64())) for k in range(len(keys))]
                cols += [pa.array(x, pa.int64()) for x in (start, length, crc, total)] + [pa.array(got, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=[*keys, "start", "length", "ids_crc32", "doc_tokens", "ids"])

    out = kept.mapInArrow(releasing(run), schema)
    return out if ids else out.drop("ids")


def _common(capacity: int):
    def fill(rest: pa.Table) -> pa.Table:
        """First fit of the pieces, the longest first."""
        others = [(c, "descending") for c in rest.column_names if c != "length"]
        rest = rest.sort_by([("length", "descending"), *others])
        room = np.full(rest.num_rows, capacity)
        place, offset = [], []
        for n in rest.column("length").to_pylist():
            k = int(np.argmax(room >= n))
            place.append(k)
            offset.append(capacity - int(room[k]))
            room[k] -= n
        return rest.append_column("sequence_id", pa.array(place, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return fill


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """The pieces with sequence_id and offset (gapless from 0 within a sequence).

    pieces: a table, as it is read several times, with a length of 1 to capacity in each row; other columns go along.
    Equal rows keep one place each; an empty table stays empty."""
    pieces = pieces.drop("sequence_id", "offset")
    names = pieces.columns
    dealt = pieces.withColumn("_class", F.expr(f"{int(capacity)} div length").cast("long"))
    counts = dealt.groupBy("_class").agg(F.count("*").alias("_count"))
    # the sequences of one class come after those of the classes before; there are at most `capacity` classes
    before = Window.orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)
    full = F.expr("_count div _class")
    counts = counts.withColumn("_full", full).withColumn("_base", F.coalesce(F.sum(full).over(before), F.lit(0)))
    counts = cut(counts)
    told = counts.agg(F.coalesce(F.sum("_count"), F.lit(0)), F.coalesce(F.sum("_full"), F.lit(0))).first()
    numbered = gapless(dealt, ["_class"], names, "_number", told[0])
    numbered = cut(numbered.join(counts.drop("_count"), "_class").withColumn("_bin", F.expr("_number div _class")))
    inside = Window.partitionBy("_class", "_bin").orderBy("_number").rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        numbered.where("_bin < _full")
        .withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long"))
        .withColumn("sequence_id", (F.col("_base") + F.col("_bin")).cast("long"))
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    rest = numbered.where("_bin >= _full").select(*names)
    rest = rest.groupBy().applyInArrow(_common(capacity), f"{schema}, sequence_id long, offset long")
    rest = rest.withColumn("sequence_id", F.col("sequence_id") + F.lit(int(told[1])))
    return filled.select(*names, "sequence_id", "offset").unionByName(rest)
