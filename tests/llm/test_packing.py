import os
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from scenewright.llm import packing
from scenewright.llm.common import cut

FILE = public_tokenizers.path("byte_bpe_50k.json")
RAW = open(FILE, "rb").read()
DOCUMENTS = "/root/testdata/sf0.001/documents.parquet"


def test_cuts_lose_nothing_and_nearly_fill_their_class():
    for n in range(1, 4000):
        out = packing.cuts(n, 1024)
        assert sum(out) == n and all(0 < x <= 1024 for x in out)
        assert all(x >= packing.FILL * (1024 // (1024 // x)) for x in out)


def test_ids_equal_those_of_the_whole_text():
    plain, ids = Tokenizer.from_file(FILE), packing.Ids(RAW, remembered=40)
    draw = random.Random(5)
    parts = ["the", "Été", " ", "  ", "\n", "\t", "\r\n", "12", "it's", "'s", "!!", "<|endoftext|>", " ", "　", "漢字", "a.b", "\x1c", "\x85", "🙂", "x" * 40]
    texts = ["", " ", "  a", "a  ", "a \n b", "\n a", "a  b"] + ["".join(draw.choices([*parts, " ", " "], k=draw.randrange(1, 30))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(ids.of(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_the_ids_of_every_plain_character_and_of_real_words():
    plain, ids = Tokenizer.from_file(FILE), packing.Ids(RAW)
    assert ids.ranks is not None
    draw = random.Random(8)
    chars = [chr(i) for i in range(0x250)]
    texts = ["".join(draw.choices(chars, k=12)) for _ in range(3000)] + [f"x {a}{b} y" for a in chars for b in ("a", " ", "1", "!")]
    for t, e in zip(texts, plain.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids.of(t), "<u4").tolist() == e.ids, repr(t)


def test_the_ids_of_the_drivers_documents():
    if not os.path.isfile(DOCUMENTS):
        pytest.skip("the tables are not here")
    plain, ids = Tokenizer.from_file(FILE), packing.encoder(RAW)
    texts = [t for t in pq.read_table(DOCUMENTS, columns=["text"]).column("text").to_pylist() if t]
    for t, e in zip(texts, plain.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids.of(t), "<u4").tolist() == e.ids


@pytest.mark.parametrize("around", [("", ""), ("prose, ends here.", "More prose 12"), ("a", " "), ("漢字 x", "y"), ("x", "漢")])
def test_very_long_runs_have_the_tokenizers_own_ids(around):
    plain, ids = Tokenizer.from_file(FILE), packing.Ids(RAW)
    for run in (" ", "\n", "\t", " \n", "\xa0", "a", "="):
        text = around[0] + run * (1_500_000 // len(run)) + around[1]
        assert (np.frombuffer(ids.of(text), "<u4") == np.array(plain.encode(text, add_special_tokens=False).ids)).all(), (run, around)
    for n in (4094, 4095, 4096, 4097, 4098):
        for text in (around[0] + " " * n + around[1], around[0] + "\n" * n + " " + around[1] + "\t" * n):
            assert np.frombuffer(ids.of(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, (n, around)


def test_a_million_blanks_in_a_table(spark):
    docs = spark.createDataFrame([(1, " " * 1_000_000 + "x"), (2, "\n" * 600_000), (3, None)], "doc_id long, text string")
    got = packing.pack(cut(packing.pieces(docs, ["doc_id"], "text", RAW, 1024)), 1024)
    plain = Tokenizer.from_file(FILE)
    want = {1: len(plain.encode(" " * 1_000_000 + "x").ids) + 1, 2: len(plain.encode("\n" * 600_000).ids) + 1, 3: 1}
    assert {r.doc_id: r.n for r in got.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()} == want


def test_packing_by_brute_force(spark):
    draw = random.Random(2)
    rows = [(i, " ".join(draw.choices(["alpha", "beta", "gamma,", "delta"], k=int(draw.paretovariate(0.7)) % 6000)), "x") for i in range(300)]
    rows += [(None, None, None), (7, "", "y"), (8, rows[8][1], "z"), (8, rows[8][1], "z"), (9, "word " * 30000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string")
    found = cut(packing.pieces(docs, ["doc_id"], "text", RAW, 1024, ids=True))
    got = packing.pack(found, 1024).collect()
    plain = Tokenizer.from_file(FILE)
    want = sorted((i if i is not None else -1, plain.encode(t or "", add_special_tokens=False).ids + [0]) for i, t, _ in rows)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_doc[r.doc_id if r.doc_id is not None else -1].append(r)
        by_seq[r.sequence_id].append(r)
    seen = []
    for i, ps in by_doc.items():
        copies = sum(p.start == 0 for p in ps)
        for total in {p.doc_tokens for p in ps}:
            own = sorted((p for p in ps if p.doc_tokens == total), key=lambda p: p.start)
            times = sum(p.start == 0 for p in own)
            assert all(own[k].start == own[k + 1].start for k in range(0, len(own) - 1, 2)) if times == 2 else True
            ids = np.frombuffer(b"".join(p.ids for p in own[::times]), "<u4").tolist()
            seen += [(i, ids)] * times
        assert copies >= 1
    assert sorted(seen) == want
    padding = 0
    for ps in by_seq.values():
        ps.sort(key=lambda p: p.offset)
        assert [p.offset for p in ps] == np.cumsum([0] + [p.length for p in ps])[:-1].tolist()
        n = sum(p.length for p in ps)
        assert n <= 1024
        padding += 0 if n & (n - 1) == 0 else 1024 - n
    assert padding < 0.02 * sum(p.length for p in got) + 1024  # the last of the common sequences
    assert packing.pack(found.limit(0), 1024).count() == 0
    again = packing.pack(found.repartition(7), 1024).select("doc_id", "start", "sequence_id", "offset")
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, again.collect())) == sorted(key((r.doc_id, r.start, r.sequence_id, r.offset)) for r in got)
