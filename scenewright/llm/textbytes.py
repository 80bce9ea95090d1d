"""Texts of an Arrow column as one array of bytes, in pieces of bounded size."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once. A longer text is a piece of its own.
PIECE = 1 << 19

#: A-Z lower-cased, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The six white-space bytes, 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: An odd multiplier, so that its powers can be undone modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


Batches = Iterator[pa.RecordBatch]


def release() -> None:
    """Hand freed memory back to the system: Spark's Python workers live on between stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def releasing(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A task's work on batches, with memory handed back before and after."""

    @functools.wraps(run)
    def released(batches: Batches) -> Batches:
        release()
        try:
            yield from run(batches)
        finally:
            release()

    return released


def pieces(texts: pa.Array, piece: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole texts with about `piece` bytes. Null is empty."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if texts.null_count:  # what lies under a null is not text
        sizes = np.where(np.asarray(texts.is_null()), 0, np.diff(offsets))
        if (sizes != np.diff(offsets)).any():
            texts = texts.fill_null("")
            yield from pieces(texts, piece)
            return
    start = 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + piece, "right")) - 1
        end = min(n, max(start + 1, end))
        yield start, end, raw[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**0 to BASE**n and their inverses, modulo 2**64."""
    if "up" not in _powers or len(_powers["up"]) <= n:
        size = max(n + 1, PIECE + 1024)
        up, down = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers["up"], _powers["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers["up"], _powers["down"]


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """Sums of value x BASE**place before each place, from which span_hashes() reads the hash of any span."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=out[1:])
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values, one to one."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans' bytes; equal spans have equal hashes wherever they stand."""
    _, down = powers(len(prefix))
    return mixed((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of each word; words end at white space and at the ends of texts."""
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    begins[heads] = inside[heads]
    stops = np.zeros(n + 1, bool)
    stops[1:n] = inside[:-1] & ~inside[1:]
    stops[n] = inside[-1]
    tails = offsets[1:][np.diff(offsets) > 0]
    stops[tails] = inside[tails - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def per_text(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """The sum of values for each of n texts."""
    return np.bincount(text, weights=values, minlength=n)


def grams(raw: np.ndarray, offsets: np.ndarray, order: int, pad: int, *, end: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The `order` bytes up to each byte of each text, as one number with the last byte lowest, and where each text's
    begin. Before its start a text has `pad` bytes; with `end`, one more pad byte ends it and counts as its last."""
    n, last = len(offsets) - 1, int(end)
    sizes = np.diff(offsets) + last
    ends = np.cumsum(sizes + order - 1)
    padded = np.full(int(ends[-1]) if n else 0, pad, np.uint8)
    begins = ends - sizes
    if len(raw):
        shift = begins - offsets[:-1]
        padded[np.arange(len(raw)) + np.repeat(shift, np.diff(offsets))] = raw
    total = max(0, len(padded) - order + 1)
    key = np.zeros(total, np.uint64)
    for i in range(order):
        key <<= np.uint64(8)
        key |= padded[i : i + total]
    # a gram that ends in a text's padding is none of its own
    own = np.ones(len(padded), bool)
    own[(begins[:, None] - np.arange(1, order)[None, :]).ravel()] = False
    at = np.zeros(n + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    return key[own[order - 1 :]], at


class Counts:
    """Counts of 64-bit keys, given out and begun anew when there are many, so that memory is bounded."""

    def __init__(self, most: int = 1_500_000):
        self.most, self.held, self.kept = most, 0, []

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.kept.append((keys, counts))
        self.held += len(keys)
        if self.held > self.most:
            self._merge()
            if self.held > self.most // 2:
                yield from self.rest()

    def _merge(self) -> None:
        keys = np.concatenate([k for k, _ in self.kept]) if self.kept else np.zeros(0, np.uint64)
        counts = np.concatenate([c for _, c in self.kept]) if self.kept else np.zeros(0, np.int64)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        self.kept = [(keys[first], np.add.reduceat(counts, first) if len(keys) else counts)]
        self.held = len(first)

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self._merge()
        (keys, counts), = self.kept
        self.kept, self.held = [], 0
        for i in range(0, len(keys), 100_000):
            yield keys[i : i + 100_000], counts[i : i + 100_000]


class Memo:
    """Remembers a function of 64-bit keys in a table of fixed size; what it can't hold is worked out again."""

    def __init__(self, f, bits: int = 20):
        self.f, self.shift = f, np.uint64(64 - bits)
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.float64)
        self.full = np.zeros(1 << bits, bool)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = (keys * np.uint64(BASE)) >> self.shift
        out = self.values[slot]
        miss = np.flatnonzero((self.keys[slot] != keys) | ~self.full[slot])
        if len(miss):
            some, back = np.unique(keys[miss], return_inverse=True)
            found = self.f(some)
            out[miss] = found[back]
            at = (some * np.uint64(BASE)) >> self.shift
            self.keys[at], self.values[at], self.full[at] = some, found, True
            # where two keys met in one slot, key and value must be of the same one
            lost = self.keys[at] != some
            good = ~lost
            self.values[at[good]] = found[good]
        return out


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each key in a sorted array."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


#: Bits of a shingle's hash, below those for the place of its text in a piece.
TOKEN_BITS = 52


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of `size` words of up to 4,096 texts: hashes of TOKEN_BITS bits, in order within each
    text, and where each text's begin. A text of fewer words has one shingle, of all of them; one without has none."""
    n = len(offsets) - 1
    if n > 1 << (64 - TOKEN_BITS):
        raise ValueError("too many texts at once")
    starts, ends, text = words(raw, offsets)
    per = np.bincount(text, minlength=n)
    h = span_hashes(prefix_hashes(LOWER[raw]), starts, ends)
    first = np.r_[0, np.cumsum(per)]
    take = np.minimum(per, size)
    begins = np.repeat(first[:-1], np.where(per > 0, np.maximum(per - size + 1, 1), 0))
    owner = np.repeat(np.arange(n), np.where(per > 0, np.maximum(per - size + 1, 1), 0))
    begins = begins + np.arange(len(begins)) - np.searchsorted(owner, owner)
    token = mixed(take[owner].astype(np.uint64))
    for k in range(size):
        inside = k < take[owner]
        more = mixed(token + h[np.minimum(begins + k, max(0, len(h) - 1))]) if len(h) else token
        token = np.where(inside, more, token)
    key = (owner.astype(np.uint64) << np.uint64(TOKEN_BITS)) | (token >> np.uint64(64 - TOKEN_BITS))
    key = np.unique(key)
    at = np.searchsorted(key, np.arange(n + 1).astype(np.uint64) << np.uint64(TOKEN_BITS)) if n < 1 << (64 - TOKEN_BITS) else None
    if at is None:
        at = np.r_[np.searchsorted(key, np.arange(n).astype(np.uint64) << np.uint64(TOKEN_BITS)), len(key)]
    return key & np.uint64((1 << TOKEN_BITS) - 1), at


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values between each two places of at, modulo 2**64."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]
