"""Entities, shop links, embedded objects and hub rules against plain Python."""

import os
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from scenewright.functions import text as T
from scenewright.operators import entities as E
from scenewright.operators import hubs

DATA = "/root/testdata/sf0.001"
SPACE = "\t-\r    -     　﻿"
ONE = re.compile(
    rf"https?://[^{SPACE}]+|(?<!http://)(?<!https://)www\.[^{SPACE}]+|@[a-zA-Z0-9_-]+(?![@\w.-]*\.[a-zA-Z]{{2,}})|[\w.-]+@(?:[\w-]+\.)+[\w-]{{2,4}}", re.ASCII
)


def by_hand(text):
    out = []
    for m in ONE.finditer(text or ""):
        x = m[0]
        kind = "url" if re.match(r"https?://|www\.", x) else "mention" if x[0] == "@" else "email"
        out.append((m.start(), m.end(), kind, "https://" + x if x.startswith("www.") else x[1:] if x[0] == "@" else x))
    return out


def found(df):
    return {r.doc_id: [tuple(x) for x in r.e] for r in df.select("doc_id", E.entities(F.col("text")).alias("e")).collect()}


def test_entities_of_made_texts(spark):
    draw = random.Random(2)
    parts = ["http://", "https://a.b/c", "www.", "x.de", "@name", "@", "me@mail.org", ".com", " ", "\n", "é", "🙂", " ", "a", "-", "_", "", "/", "foo.bar@baz.co.uk"]
    texts = ["", None, "see http://www.x.de and www.y.de", "mail me@x.org or @me", "@a.b@c.com", "www.foo@bar.com"] + ["".join(draw.choices(parts, k=draw.randrange(12))) for _ in range(1500)]
    texts.append("@x " * 4000)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = found(df)
    for i, t in enumerate(texts):
        assert got[i] == by_hand(t.replace("", "") if t else t), t


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
def test_entities_of_all_documents(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in df.collect()}
    got = found(df)
    assert got == {i: by_hand(t) for i, t in texts.items()} and any(got.values())


def test_links_to_shops(spark):
    def links(*row):
        df = spark.createDataFrame([row], "p string, d string, t string, ms long, own string")
        return [tuple(x) for x in df.select(E.external_links(F.col("p"), F.col("d"), F.col("t"), F.col("ms"), F.col("own")).alias("x")).first().x]

    assert links("https://A.Bandcamp.com/x", None, "http://beatport.com/1 http://b.bandcamp.com http://beatport.com/2", 5, "o") == [
        ("https://A.Bandcamp.com/x", "Bandcamp", "Buy"), ("http://beatport.com/1", "Beatport", "Buy"),
    ]
    assert links("https://shop", "http://hypeddit.com/bandcamp.com", None, 10**9, "o") == [("http://hypeddit.com/bandcamp.com", "Bandcamp", "Buy")]
    assert links("", None, "none", 900_001, "own") == [("own", "Home", "Listen")] and links(None, None, None, 900_000, "own") == [] and links(None, None, None, None, "own") == []


def test_embedded_objects(spark):
    user = lambda data: f'<script>x=1</script><SCRIPT type="a">\nwindow.__data = [{{"hydratable":"other"}},{{"hydratable":"user","data":{data}}}];\n</SCRIPT><script>window.__data = []</script>'
    pages = [
        user('{"id": 7, "permalink": "p", "username": "u", "followers_count": 3}'), user('{"id": "7", "permalink": "p", "username": "u"}'), user('{"id": 7, "permalink": null, "username": "u"}'),
        user('{"id": 7, "permalink": "p", "username": "u"'), "<script>window.__data = [1, 2</script>", "", None, "<script>window.__data = {}</script>", user('{"id": 8, "permalink": "", "username": "ü]"}'), user("[]"),
    ]
    df = spark.createDataFrame(list(enumerate(pages)), "n long, html string")
    got = {r.n: r.u and tuple(r.u) for r in df.select("n", E.hydrated_user(F.col("html"), "window.__data").alias("u")).collect()}
    assert got == {i: None for i in range(10)} | {0: (7, "p", "u", 3), 8: (8, "", "ü]", None)}


def test_styled_letters_are_plain(spark):
    texts = ["𝗠𝗜𝗫 𝗦𝗘𝗥𝗜𝗘𝗦", "𝕃𝕒𝕓𝕖𝕝", "ＡＢＣ１２３", "ﬁne ﬂow", "Ⓐⓑ", "plain é", "", None]
    got = [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.unstyled(F.col("t")).alias("x")).collect()]
    assert got == [t if t is None else unicodedata.normalize("NFKC", t) for t in texts]


def test_running_sums(spark):
    rows = [([],), ([5],), (list(range(1500)),), (None,)]
    got = [r.x for r in spark.createDataFrame(rows, "v array<int>").select(T.running_sums(F.col("v")).alias("x")).collect()]
    assert got == [[], [0], [sum(range(i)) for i in range(1500)], []]


def test_hubs_by_all_rules_and_late(spark):
    titles = [("ch", f"Artist {i} - Song") for i in range(16)] + [("few", f"A{i} - x") for i in range(9)] + [("same", f"A{i % 10} – x") for i in range(40)] + [("no", f"song {i}") for i in range(40)]
    artists = [(u, p, n) for u, p, n in [("ch", "x", 3), ("few", "x", 3), ("same", "x", 3), ("no", "x", 3), ("big", None, 1000), ("star", "Star", 5000), ("desk", "y", 1), ("nm", "z", None), ("listed", "L", 1), ("perma", "angelsrecs", 1), ("plain", "q", 1)]]
    profiles = [("desk", "D", "an 𝗶𝗻𝗱𝗲𝗽𝗲𝗻𝗱𝗲𝗻𝘁 𝗿𝗮𝗱𝗶𝗼 from Leeds"), ("nm", "𝕂𝕠𝕞 Records", None), ("plain", "Plain [x] records", "I make music")]
    canon = [("artist", "star"), ("hub", "l")]
    told = hubs.classified(
        spark.createDataFrame(artists, "urn string, permalink string, track_count long"), spark.createDataFrame(profiles, "urn string, username string, description string"),
        spark.createDataFrame(titles, "urn string, title string"), spark.createDataFrame(canon, "kind string, name string"),
    )
    assert {r.urn for r in told.where("account_kind = 'hub'").collect()} == {"ch", "big", "desk", "nm", "listed", "perma"} and told.count() == len(artists)
    lists = spark.createDataFrame(titles, "urn string, title string").groupBy("urn").agg(F.collect_list("title").alias("t"))
    assert {r.urn for r in lists.where(hubs.titles_of_channel(F.col("t"))).collect()} == {"ch"}
    rows = [(1, "artist", 1, "a", "A"), (1, "artist", 2, "b", "B Records"), (1, "artist", 3, "c", None), (1, "hub", 1, "h", "H")]
    got = hubs.moved_late(spark.createDataFrame(rows, "scene long, kind string, place int, urn string, name string")).orderBy("kind", "place").collect()
    assert [(r.kind, r.place, r.urn) for r in got] == [("artist", 1, "a"), ("artist", 2, "c"), ("hub", 1, "h"), ("hub", 2, "b")]
