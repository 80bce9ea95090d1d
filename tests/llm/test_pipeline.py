import random
import re
from collections import Counter

import corpus_pipeline as P
from scenewright.llm.common import cut
from tests.llm.test_ngram_join import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    draw = random.Random(6)
    words = ["".join(draw.choices(["ta", "ren", "is", "mo", "el", "dor", "ka"], k=draw.randrange(1, 4))) for _ in range(1500)]
    rows = []
    for i in range(120):
        text = " ".join(draw.choices(words, k=draw.randrange(60, 400)))
        rows.append([i, text, "en", draw.choice("abc"), len(text)])
    rows[10][1] = rows[3][1]
    rows[11][1] = rows[4][1] + " tail"
    rows[20][1] += " token = 0123456789abcdef0123456789abcdef01234567"
    rows[30][1], rows[31][1], rows[32][1] = "too short", None, "again and again " * 50
    return [(i, t, x, s, len(t or "")) for i, t, x, s, _ in rows]


def test_each_stage_takes_effect(spark):
    own = documents()
    docs = spark.createDataFrame(own, SCHEMA)
    stages = dict(P.STAGES)
    assert list(stages) == ["quality_rules", "near_duplicates", "secret_scan", "source_mix", "packing"]
    good = cut(stages["quality_rules"](spark, docs, ""))
    assert good.columns == docs.columns
    kept = {r.doc_id for r in good.collect()}
    assert kept == set(range(120)) - {30, 31, 32}

    unique = cut(stages["near_duplicates"](spark, good, ""))
    want = {i for i, _, c in brute([(i, t) for i, t, *_ in own if i in kept], 5, 80) if i == c}
    assert unique.columns == docs.columns and {r.doc_id for r in unique.collect()} == want and 10 not in want and 11 not in want

    clean = cut(stages["secret_scan"](spark, unique, ""))
    got = {r.doc_id: r for r in clean.collect()}
    assert clean.columns == docs.columns and set(got) == want
    assert got[20].text.endswith(" [SECRET]") and got[20].n_chars == len(got[20].text)
    assert all(got[i].text == own[i][1] for i in want if i != 20)

    mixed = cut(stages["source_mix"](spark, clean, ""))
    copies = Counter(r.doc_id for r in mixed.collect())
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    total = sum(words(r.text) for r in got.values())
    taken = sum(n * words(got[i].text) for i, n in copies.items())
    assert mixed.columns == docs.columns and max(copies.values()) <= 2 and abs(taken - 1.5 * total) < 1000

    pieces = stages["packing"](spark, mixed, "").collect()
    tokens = sum({r.doc_id: r.doc_tokens for r in pieces}[i] * n for i, n in copies.items())
    assert sum(r.length for r in pieces) == tokens


def test_near_duplicates_tells_rows_of_one_id_apart(spark):
    one = " ".join(f"a{i}" for i in range(100))
    other = " ".join(f"b{i}" for i in range(100))
    rows = [(3, one), (7, one + " tail"), (7, other), (7, other), (None, one + " end"), (None, "stands alone"), (None, None), (9, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "x", len(t or ""), 5) for i, t in rows], SCHEMA + ", component_id long")
    got = dict(P.STAGES)["near_duplicates"](spark, docs, "")
    assert got.columns == P.COLUMNS
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, [(3, one), (7, other), (None, "stands alone"), (None, None), (9, None), (9, "")]))


def test_empty_tables_pass(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in P.STAGES:
        docs = cut(stage(spark, docs, ""))
    assert docs.count() == 0


CLASHING = ["n_words", "nats", "kept", "lower", "language", "component_id", "_whose", "base_spans", "secret_spans", "size", "copies", "taken", "start", "length", "sequence_id", "offset"]


def test_stages_take_very_long_texts_and_clashing_columns(spark):
    draw = random.Random(7)
    words = ["".join(draw.choices(["ta", "ren", "is", "mo", "el", "dor"], k=draw.randrange(1, 4))) for _ in range(400)]
    rows = [(i, " ".join(draw.choices(words, k=200)), draw.choice(["en", None]), draw.choice(["a", None])) for i in range(40)]
    long = " ".join(draw.choices(words, k=300_000)) + " token=0123456789abcdefX " + " " * 400_000 + "end"
    rows += [(100, long, "en", "a"), (101, None, None, None), (102, "", "en", "a"), (None, rows[0][1], "en", "a"), (103, "x" * 1_000_000, "en", "a"), (104, "0123456789abcdef" * 20_000, "en", "a")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), *["clash"] * len(CLASHING)) for r in rows], SCHEMA + ", " + ", ".join(f"{c} string" for c in CLASHING))
    for name, stage in P.STAGES:
        out = cut(stage(spark, docs, ""))
        if name == "packing":
            assert {r.doc_id for r in out.select("doc_id").collect()} == {r[0] for r in rows}
        else:
            assert out.columns == P.COLUMNS
            got = {r.doc_id: r.text for r in out.where("doc_id >= 100").collect()}
            assert (100 in got or name == "quality_rules") and (name != "secret_scan" or ("[SECRET]" in got[100] and got[104] == "[SECRET]" and len(got[103]) == 1_000_000))
