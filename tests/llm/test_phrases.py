import random
import re
from collections import Counter

import pytest

from scenewright.llm import phrases

DATA = "/root/testdata/sf0.001"


def brute(rows, least, percent, depth=5):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, depth + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    kept = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in kept.items():
        inside = any(
            len(v) > len(w) and o == lang and 100 * b >= percent * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (o, v), b in kept.items()
        )
        if not inside:
            cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    return sorted(out)


def mined(spark, rows, **how):
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    return sorted(tuple(r) for r in phrases.mine(df, **how).collect())


@pytest.mark.parametrize("percent", [100, 60])
def test_against_brute_force(spark, percent):
    draw = random.Random(percent)
    vocabulary = ["a", "B", "ça", "Ça", "dé", "x\x0b", "y,", "z", "\t", " ", "…", ";", ""]
    passage = "One passage, that comes again and again; One passage THAT"
    rows = []
    for _ in range(120):
        text = " ".join(draw.choices(vocabulary, weights=[9, 7, 5, 3, 3, 1, 2, 4, 1, 2, 1, 1, 1], k=draw.randrange(40)))
        rows.append((draw.choice(["en", "fr", None, "und"]), text + draw.choice(["", passage, ".", " "])))
    rows += [("en", None), ("en", ""), (None, None), ("xx", "."), ("fr", passage * 40), ("de", "same same same same same same same same")] + [rows[0]] * 5
    got = mined(spark, rows, least=4, percent=percent)
    assert got == brute(rows, 4, percent) and len(got) > 50


def test_shards_and_long_texts_count_alike(spark, monkeypatch):
    draw = random.Random(3)
    rows = [("en", " ".join(draw.choices("abcdefgh", k=draw.randrange(200)))) for _ in range(60)] + [("en", "tic tac toe " * 30_000)]
    want = brute(rows[:-1], 3, 100)
    monkeypatch.setattr(phrases, "SHARD", 64)
    df = spark.createDataFrame(rows[:-1], "lang string, text string").coalesce(1)
    assert sorted(tuple(r) for r in phrases.mine(df, least=3).collect()) == want
    assert mined(spark, rows, least=3) == brute(rows, 3, 100)


def test_a_map_finds_all_that_was_put_in(spark):
    draw = random.Random(1)
    keys = [draw.randrange(-(2**63), 2**63) for _ in range(5000)] + [0, -1, 2**63 - 1, -(2**63)]
    known = phrases.bit_map(spark.createDataFrame([(k,) for k in keys], "key long"), len(keys))
    import numpy as np

    assert known(np.array(keys, np.int64).view(np.uint64)).all()
    others = np.array([draw.randrange(2**64) for _ in range(5000)], np.uint64)
    assert known(others).mean() < 0.2


def test_exact_beyond_64_bits(spark):
    df = spark.createDataFrame([(10**12, 10**13, 10**12 + 1, 10**12 + 7)], "a long, n long, l long, r long")
    a, n, x, y = 10**12, 10**13, 10**12 + 1, 10**12 + 7
    assert df.select(phrases.score_of("a", "n", "l", "r").alias("s")).first().s == 1000 * a * n // (x * y)


def test_ranks_and_empty_tables(spark):
    rows = [("en", f"p{i}", 5, 1, 1, 9, i % 3) for i in range(50)] + [("fr", "é", 1, 1, 1, 1, 1), ("fr", "z", 1, 1, 1, 1, 1), ("fr", "f", 2, 1, 1, 1, 1)]
    df = spark.createDataFrame(rows, "lang string, phrase string, a long, l long, r long, n long, score long")
    got = [(r.lang, r["rank"], r.phrase) for r in phrases.top(df, 7).orderBy("lang", "rank").collect()]
    en = sorted((x for x in rows if x[0] == "en"), key=lambda x: (-x[6], -x[2], x[1].encode()))[:7]
    assert got == [("en", i + 1, x[1]) for i, x in enumerate(en)] + [("fr", 1, "f"), ("fr", 2, "z"), ("fr", 3, "é")]
    empty = spark.createDataFrame([], "lang string, text string, phrase string")
    assert phrases.top(phrases.mine(empty), 5).count() == 0
    clash = spark.createDataFrame([("en", "a b a b", 1, 2)], "lang string, text string, n long, key long")
    assert [tuple(r)[:3] for r in phrases.mine(clash, least=2).collect()] == [("en", "a b", 2)]
