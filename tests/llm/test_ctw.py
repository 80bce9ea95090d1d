import math
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest

from scenewright.llm import ctw

W = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return re.sub("[A-Z]", lambda c: c[0].lower(), t or "")


def rows():
    draw = random.Random(2)
    pool = ["the", "rain", "é", "漢字", "falls", "Hills", "x9", "quiet", "\x1c", "re"]
    some = [(i, "".join(x for _ in range(draw.randrange(0, 60)) for x in (draw.choice(pool + [f"w{draw.randrange(99)}"]), draw.choice([" ", "\n", "  "])))) for i in range(120)]
    return [*some, (500, None), (501, ""), (None, "the rain"), (3, some[3][1])]


def brute_tree(texts, depth, least):
    """Weighted probabilities by recursion over contexts."""
    counts = [Counter() for _ in range(depth + 1)]
    for t in texts:
        b = b"\xff" * depth + low(t).encode() + b"\xff"
        for i in range(depth, len(b)):
            for d in range(depth + 1):
                for j in range(8):
                    counts[d][b[i - d : i], (1 << j) | (b[i] >> (8 - j)), (b[i] >> (7 - j)) & 1] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    n = lambda d, c, p: (counts[d][c, p, 0], counts[d][c, p, 1])

    @lru_cache(None)
    def node(d, c, p):
        a, b = n(d, c, p)
        if d == depth:
            return kt(a, b), 1.0, 0.5, {}
        kept = {x: n(d + 1, bytes([x]) + c, p) for x in range(256)}
        kept = {x: v for x, v in kept.items() if sum(v) >= least}
        o0, o1 = a - sum(v[0] for v in kept.values()), b - sum(v[1] for v in kept.values())
        own = math.log(0.5) + kt(a, b)
        below = math.log(0.5) + sum(node(d + 1, bytes([x]) + c, p)[0] for x in kept) + kt(o0, o1)
        w = max(own, below) + math.log1p(math.exp(-abs(own - below)))
        return w, math.exp(own - w), (o1 + 0.5) / (o0 + o1 + 1), kept

    def predict(d, c, p, whole):
        a, b = n(d, c, p)
        _, own, other, kept = node(d, c, p)
        est = (b + 0.5) / (a + b + 1)
        if d == depth:
            return est
        x = whole[len(whole) - d - 1]
        q = predict(d + 1, bytes([x]) + c, p, whole) if x in kept else other
        return own * est + (1 - own) * q

    def log2(gram):
        out = 0
        for j in range(8):
            p = (1 << j) | (gram[-1] >> (8 - j))
            q = predict(0, b"", p, gram[:-1]) if sum(n(0, b"", p)) >= least else 0.5
            out += math.log2(q if (gram[-1] >> (7 - j)) & 1 else 1 - q)
        return out

    return log2


@pytest.mark.parametrize("depth", [0, 1, 2, 3, 5])
def test_scores_equal_the_recursion(spark, monkeypatch, depth):
    monkeypatch.setattr(ctw, "DEPTH", depth)
    monkeypatch.setattr(ctw, "GRAMS_PER_TASK", 300)
    own = [(i, t and t[:40]) for i, t in rows()[:14] + rows()[-4:]]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    train = [t for i, t in own if not held(i)]
    log2 = brute_tree(train, depth, 1.0)
    got = ctw.score(spark.createDataFrame(own, "doc_id long, text string")).collect()
    want = []
    for i, t in own:
        b = b"\xff" * depth + low(t).encode() + b"\xff"
        want.append((-1 if i is None else i, len(b) - depth, sum(log2(b[k - depth : k + 1]) for k in range(depth, len(b))) * math.log10(2)))
    found = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.score) for r in got)
    for a, b in zip(found, sorted(want), strict=True):
        assert a[:2] == b[:2] and math.isclose(a[2], b[2], rel_tol=1e-5, abs_tol=1e-5)


def test_each_context_adds_up_to_one_and_the_base_is_exact(spark, monkeypatch):
    own = rows()
    df = spark.createDataFrame([(i, t, "x") for i, t in own], "doc_id long, text string, score string")
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    counts = Counter()
    for i, t in own:
        if not held(i):
            counts.update(W.findall(low(t)))
            counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    for share in (ctw.WORD_SHARE, 0.02):  # all words broadcast, or most of them joined
        monkeypatch.setattr(ctw, "WORD_SHARE", share)
        got = sorted(ctw.score(df).collect(), key=lambda r: (-1 if r.doc_id is None else r.doc_id, r.n_bytes))
        for r, (i, t) in zip(got, sorted(own, key=lambda x: (-1 if x[0] is None else x[0], len(low(x[1]).encode()))), strict=True):
            tokens = [*W.findall(low(t)), None]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(tokens), sum(counts[x] > 0 for x in tokens), n)
            assert math.isclose(r.base_score, sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens), rel_tol=1e-9)
    tree = ctw.grow(ctw.cut(ctw.count(df.select("text"))))
    for context in (b"ain f", b"\xff\xff\xffth", b"zzzzz"):
        keys = np.array([int.from_bytes(context + bytes([c]), "big") for c in range(256)], np.uint64)
        assert math.isclose((2 ** tree.log2(keys)).sum(), 1, rel_tol=1e-6)


def test_nothing_to_learn_from(spark):
    assert ctw.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    r = ctw.score(spark.createDataFrame([(None, "ab")], "doc_id long, text string")).first()
    assert r.held_out and r.n_known == 0 and math.isclose(r.bits_per_byte, 8)


def test_rare_contexts_of_a_larger_corpus_count(spark, monkeypatch):
    monkeypatch.setattr(ctw, "DEPTH", 2)
    draw = random.Random(5)
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    own = {i: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz 0123456789", k=1500)) for i in range(40)}
    log2 = brute_tree([t for i, t in own.items() if not held(i)], 2, 1.0)
    df = spark.createDataFrame(list(own.items()), "doc_id long, text string")
    got = {r.doc_id: r.score for r in ctw.score(df).collect()}
    for i in [i for i in own if held(i)]:
        b = b"\xff\xff" + own[i].encode() + b"\xff"
        assert math.isclose(got[i], sum(log2(b[k - 2 : k + 1]) for k in range(2, len(b))) * math.log10(2), rel_tol=1e-9)
    monkeypatch.setattr(ctw, "HEAD", 3_000)  # most grams are joined, in several tasks
    monkeypatch.setattr(ctw, "GRAMS_PER_TASK", 5_000)
    for r in ctw.score(df).collect():
        assert math.isclose(r.score, got[r.doc_id], rel_tol=1e-9)


def test_one_context_holds_most_grams(spark, monkeypatch):
    monkeypatch.setattr(ctw, "DEPTH", 3)
    monkeypatch.setattr(ctw, "GRAMS_PER_TASK", 500)
    draw = random.Random(6)
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    own = {i: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz0123456789") + "e " for _ in range(700)) for i in range(30)}
    own |= {100 + i: "e " * 50 for i in range(20)}
    df = spark.createDataFrame(list(own.items()), "doc_id long, text string")
    log2 = brute_tree([t for i, t in own.items() if not held(i)], 3, 1.0)
    got = {r.doc_id: r.score for r in ctw.score(df).collect()}
    for i, t in own.items():
        b = b"\xff" * 3 + t.encode() + b"\xff"
        assert math.isclose(got[i], sum(log2(b[k - 3 : k + 1]) for k in range(3, len(b))) * math.log10(2), rel_tol=1e-9)
