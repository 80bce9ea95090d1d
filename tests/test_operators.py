"""Small pinned results of the atlas operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from scenewright.functions import text as T
from scenewright.operators import browse, cache, merge, naming, rollup, scenes, search, weights
from scenewright.plans import publish
from scenewright.sources.store import Store
from scenewright.streaming import ingest


def edges(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, type string, weight double")


def test_pairs_factor_strength_and_symmetry(spark):
    e = edges(spark, [("a", "b", "follow", 1.0), ("a", "b", "repost", 3.0), ("b", "a", "follow", 1.0), ("a", "a", "repost", 9.0)])
    pairs = weights.directed_pairs(e)
    assert {(r.src, r.dst, r.follow, r.reposts) for r in pairs.collect()} == {("a", "b", True, 3.0), ("b", "a", True, 0.0), ("a", "a", False, 9.0)}
    got = {(r.src, r.dst): r.strength for r in weights.strengths(pairs).collect()}
    assert got == {("a", "b"): 3.0, ("b", "a"): 1.0}
    many = weights.directed_pairs(edges(spark, [("h", f"t{i}", "repost", 1.0) for i in range(8)] + [("s", "x", "repost", 40.0), ("s", "y", "repost", 40.0)]))
    assert {r.src: r.factor for r in weights.hub_factor(many, 2).collect()} == {"h": 0.25, "s": 1.0}
    w = lambda rows: [r.weight for r in weights.symmetric(spark.createDataFrame(rows, "src string, dst string, strength double")).collect()]
    assert w([("a", "b", 2.0), ("b", "a", 1.0)]) == [4.0] and w([("b", "a", 2.0)]) == [2.0] and w([("a", "b", 1.0), ("b", "a", 1.0)]) == [3.0]


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.fold_term(F.lit("Dub-Téchno 2"))) == "dubtechno2" and one(T.slugify(F.lit(" São Paulo!"))) == "sao-paulo"
    assert one(T.title_case(F.lit("éclair dub-techno 2step"))) == "éClair Dub-Techno 2step"
    assert one(T.parse_tag_list(F.lit('TECHNO x "Dub Techno"'))) == ["techno", "dub techno"]
    assert [one(T.urn_to_id(F.lit(x))) for x in ("a:b:12", "a:x", "7z")] == [12, 0, 7]
    assert [one(T.format_duration(F.lit(x))) for x in (61_000, 3_661_000, 0)] == ["1:01", "1:01:01", "0:00"]
    assert [one(T.format_count(F.lit(x))) for x in (950, 2300, 2000, 1_200_000)] == ["950", "2.3k", "2k", "1.2M"]
    assert one(T.similarity(F.lit("abcd"), F.lit("abce"))) == 0.75 and one(T.similarity(F.lit(""), F.lit(""))) == 1.0


def test_rollup_merges_spellings(spark):
    terms = spark.createDataFrame(
        [("1", "dub techno", "genre", 5), ("2", "dubtechno", "genre", 3), ("3", "dub-techno", "genre", 2), ("1", "ambient", "genre", 2), ("2", "ambient", "genre", 1), ("4", "jungle", "genre", 3), ("4", "ambient", "tag", 1), ("1", "podcast", "genre", 9)],
        "urn string, term string, kind string, evidence long",
    )
    got = {r.fold: (r.slug, r.artist_count) for r in rollup.genres(terms).collect()}
    assert got["dubtechno"][1] == 3 and got["ambient"] == ("ambient", 2) and "jungle" not in got and "podcast" not in got
    assert [(r.term, r.artists) for r in rollup.below_threshold(terms).collect()] == [("jungle", 1)]
    assert {(r.fold, r.other, r.shared) for r in rollup.related(terms).collect()} == {("dubtechno", "ambient", 2), ("ambient", "dubtechno", 2)}
    artists = spark.createDataFrame([("1", "Berlin", "DE"), ("2", "berlin, Germany", "DE"), ("3", "Tokyo", "JP"), ("4", None, None)], "urn string, city_raw string, country string")
    assert [(r.city, r.country, r.artist_count) for r in rollup.cities(artists).collect()] == [("berlin", "DE", 2)]


def test_merges_are_idempotent_and_keep_first_and_last(spark):
    rows = [("u", 1, 2, "seed", "p", None, "x"), ("u", 2, 1, "repost", None, "Rome", None), ("u", 2, 1, "repost", None, "Rome", None)]
    df = spark.createDataFrame(rows, "urn string, seen int, depth int, discovered_via string, permalink string, city_raw string, country string")
    r = merge.merge_artists(df).first()
    assert (r.permalink, r.city_raw, r.country, r.depth, r.discovered_via, r.first_seen, r.last_seen) == ("p", "Rome", "x", 1, "seed", 1, 2)
    q = spark.createDataFrame([("a", 1, 2, None), ("a", 2, None, "done"), ("a", 3, 2, None), ("b", 1, 2, None), ("b", 2, None, "done"), ("b", 3, 1, None)], "urn string, at int, depth int, status string")
    assert {(r.urn, r.depth, r.status, r.priority) for r in merge.merge_queue(q).collect()} == {("a", 2, "done", 1), ("b", 1, "pending", 1)}


def test_stable_ids(spark):
    def ids(clusters, previous):
        c = spark.createDataFrame([(i, m) for i, ms in enumerate(clusters) for m in ms], "cluster long, member string")
        p = spark.createDataFrame([(k, m) for k, ms in previous.items() for m in ms], "id long, member string")
        return [r.id for r in scenes.stable_ids(c, p).orderBy("cluster").collect()]

    assert ids(["abcd", "wxyz"], {1: "wxyv", 2: "abce"}) == [2, 1]
    assert ids(["ab", "cd", "ef"], {6: "zz"}) == [7, 8, 9]
    assert ids(["abcdef", "gh"], {1: "ghabcdef"[:8]}) == [1, 2]
    assert ids(["ab", "cd"], {}) == [1, 2]


def test_contested_ids_go_to_the_most_alike(spark):
    draw = random.Random(13)
    people = [f"p{i}" for i in range(60)]
    clusters, previous = ({k: set(draw.sample(people, draw.randrange(2, 9))) for k in range(1, 12)} for _ in range(2))
    previous = {k * 3: v for k, v in previous.items()}
    pairs = sorted(((-len(c & p) / len(c | p), i, k) for k, c in clusters.items() for i, p in previous.items() if c & p and len(c & p) / len(c | p) >= 0.1))
    want, used = {}, set()
    for _, i, k in pairs:
        if k not in want and i not in used:
            want[k] = i
            used.add(i)
    contested = len(pairs) - len(want)
    fresh = max(previous)
    for k in sorted(clusters):
        if k not in want:
            fresh += 1
            want[k] = fresh
    rows = lambda groups: [(k, m) for k, ms in groups.items() for m in ms]
    got = scenes.stable_ids(spark.createDataFrame(rows(clusters), "cluster long, member string"), spark.createDataFrame(rows(previous), "id long, member string"))
    assert {r.cluster: r.id for r in got.collect()} == want and contested > 5


def test_louvain_separates_cliques(spark):
    clique = lambda ns: [(a, b, 1.0) for a in ns for b in ns if a < b]
    e = spark.createDataFrame([*clique(range(1, 6)), *clique(range(11, 16)), (1, 11, 0.1)], "u long, v long, weight double")
    got = {r.node: r.community for r in scenes.louvain(e).collect()}
    assert got == {i: 1 for i in range(1, 6)} | {i: 11 for i in range(11, 16)}
    assert scenes.louvain(e.limit(0)).count() == 0
    assert scenes.modularity(e, scenes.louvain(e)) > 0.45
    # many resolutions at once find what each finds alone; a coarse community is parted by its own edges
    swept = scenes.sweep(e, [0.001, 1.0]).collect()
    assert {r.node: r.community for r in swept if r.resolution == 1.0} == got
    assert {r.community for r in swept if r.resolution == 0.001} == {1}
    one = spark.createDataFrame([(i, 1) for i in got], "node long, community long")
    parted = scenes.sub_communities(e, one, one, 0.5, most=9)
    assert {r.node: r.community for r in parted.collect()} == got
    assert scenes.sub_communities(e, one, one, 0.5, most=10).select("community").distinct().count() == 1


def test_modularity_never_falls_and_planted_groups_are_found(spark):
    draw = random.Random(9)
    nodes = range(60)
    ties = {(a, b): 1.0 + draw.random() for a in nodes for b in nodes if a < b and draw.random() < (0.6 if a % 4 == b % 4 else 0.04)}
    ties |= {(0, b): 0.5 for b in nodes if b}  # one node is tied to all
    e = spark.createDataFrame([(a, b, w) for (a, b), w in ties.items()], "u long, v long, weight double")
    levels = []
    found = scenes.sweep(e, [0.5, 1.0], least=0.0, levels=levels)
    rows = found.collect()
    assert sorted((r.resolution, r.node) for r in rows) == [(x, n) for x in (0.5, 1.0) for n in nodes]
    groups = {}
    for r in rows:
        groups.setdefault((r.resolution, r.community), []).append(r.node)
    assert all(min(ns) == c for (_, c), ns in groups.items())
    for x in (0.5, 1.0):
        risen = [scenes.modularity(e, f.where(F.col("resolution") == x), x) for f in levels]
        assert all(b >= a - 1e-9 for a, b in zip(risen, risen[1:]))
    planted = spark.createDataFrame([(n, n % 4) for n in nodes], "node long, community long")
    assert scenes.modularity(e, found.where("resolution = 1.0")) >= scenes.modularity(e, planted) - 0.01
    # whatever moves at once, what they gain together is what modularity says
    labels = spark.createDataFrame([(n, n % 7) for n in nodes], "node long, c long")
    both = e.toDF("a", "b", "w").union(e.select("v", "u", "weight"))
    total = sum(ties.values())
    rates = spark.createDataFrame([(n, 1 / (2 * total), 0, total) for n in nodes], "node long, rate double, g long, m double")
    degree = both.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")).join(rates, "node")
    wish = scenes._wishes(both, labels, degree).where("node % 2 = 0")
    gained = scenes._gained(both, labels, degree, wish).first().gained
    after = labels.join(wish.select("node", "to"), "node", "left").select("node", F.coalesce("to", "c").alias("community"))
    rise = scenes.modularity(e, after) - scenes.modularity(e, labels.toDF("node", "community"))
    assert math.isclose(gained / total, rise, abs_tol=1e-9)
    apart = scenes._apart(wish).collect()
    touched = [x for r in apart for x in (r.c, r.to)]
    assert apart and len(touched) == len(set(touched))


def test_a_round_shuffles_its_ways_once(spark):
    """And what it says of the moves before is what they bring, by the changed ways and by modularity."""
    draw = random.Random(5)
    ties = [(a, b, 1.0 + draw.random()) for a in range(30) for b in range(a) if draw.random() < 0.3]
    e = spark.createDataFrame(ties, "u long, v long, weight double")
    both = e.toDF("a", "b", "w").union(e.select("v", "u", "weight"))
    total = sum(w for *_, w in ties)
    degree = both.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")).withColumns({"rate": F.lit(1 / (2 * total)), "g": F.lit(0).cast("long"), "m": F.lit(total)})
    labels = both.select(F.col("a").alias("node"), F.col("a").alias("c")).distinct()
    ways = both.repartition(3, "b").persist()
    ways.count()
    first = scenes._seen(ways, scenes._start(labels, degree), 3)
    plan = first._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    at = next(i for i, x in enumerate(plan) if "InMemoryTableScan" in x)
    path, least = [], depth(plan[at])
    for line in reversed(plan[:at]):  # what stands above the ways
        if depth(line) < least:
            path, least = [*path, line], depth(line)
    assert sum("Exchange" in x for x in path) == 1
    goes = F.col("to").isNotNull() & (F.col("node") % 2 == 0)
    moved = first.select("node", "g", "k", "rate", "m", F.when(goes, F.col("to")).otherwise(F.col("c")).alias("c"), goes.alias("moved"), F.lit(True).alias("wished"))
    worth = scenes._worth(scenes._seen(ways, moved, 3), scenes._worth(first)).first()
    gained = scenes._gained(both, labels, degree, scenes._wishes(both, labels, degree).where("node % 2 = 0")).first().gained
    rise = [x[1.0] for x in scenes.sweep_modularities(e, [f.select(F.lit(1.0).alias("resolution"), "node", F.col("c").alias("community")) for f in (labels, moved)])]
    assert math.isclose(worth.gained, gained, abs_tol=1e-9) and math.isclose((rise[1] - rise[0]) * total, gained, abs_tol=1e-9)
    assert math.isclose(rise[1], scenes.modularity(e, moved.select("node", F.col("c").alias("community"))), abs_tol=1e-12)
    ways.unpersist()


def test_ways_stay_in_their_parts(spark, monkeypatch):
    """A round shuffles what nodes say, no ways, and says what the plain one says; in many parts or one, rounds end alike."""
    from scenewright.operators import ways as W

    draw = random.Random(4)
    ties = [(a, b, 1.0 + draw.random()) for a in range(90) for b in range(a) if draw.random() < (0.5 if a % 3 == b % 3 else 0.05)]
    e = spark.createDataFrame(ties, "u long, v long, weight double")
    both, total = e.toDF("a", "b", "w").union(e.select("v", "u", "weight")), sum(w for *_, w in ties)
    degree = both.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")).withColumns({"rate": F.lit(1 / (2 * total)), "g": F.lit(0).cast("long"), "m": F.lit(total)})
    labels = both.select(F.col("a").alias("node"), (F.col("a") % 10).alias("c")).distinct()
    start = scenes._start(labels, degree).withColumn("inside", F.lit(None).cast("double"))
    volume = start.groupBy("c").agg(F.sum("k").alias("volume"))
    monkeypatch.setattr(W, "FEW_WAYS", 200)
    dealt = W.deal(both)
    assert dealt.parts == 4
    seen = W.seen(dealt, start.join(volume, "c"))
    plan = seen._jdf.queryExecution().executedPlan().toString()
    held = plan.splitlines().index(next(x for x in plan.splitlines() if "InMemoryTableScan" in x and "weights" in x))
    assert "Exchange" not in plan.splitlines()[held - 1]
    want = {r.node: r for r in scenes._seen(both, scenes._start(labels, degree), 3).collect()}
    got = {r.node: r for r in seen.collect()}
    assert got.keys() == want.keys() and any(r.to is not None for r in want.values())
    assert all((r.to, r.gain, r.c) == (want[n].to, want[n].gain, want[n].c) and math.isclose(r.inside, want[n].inside, abs_tol=1e-9) for n, r in got.items())
    joined = {(r.ca, r.cb): r.w for r in W.between(dealt, labels).collect()}
    plain = {}
    for a, b, w in [*ties, *[(b, a, w) for a, b, w in ties]]:
        plain[a % 10, b % 10] = plain.get((a % 10, b % 10), 0.0) + w
    assert joined.keys() == plain.keys() and all(math.isclose(joined[x], plain[x]) for x in plain)
    dealt.close()
    found = {}
    for few in (200, 200_000):
        monkeypatch.setattr(W, "FEW_WAYS", few)
        levels = []
        swept = scenes.sweep(e, [1.0, 0.5], levels=levels)
        risen = scenes.sweep_modularities(e, levels)
        assert all(b[x] >= a[x] - 1e-9 for a, b in zip(risen, risen[1:]) for x in a)
        found[few] = {(r.node, r.community) for r in swept.where("resolution = 1.0").collect()}
        assert all(least == min(n for n, c in found[few] if c == least) for _, least in found[few])
    assert found[200] == found[200_000] == {(n, n % 3) for n in range(90)}


def test_naming(spark):
    pick = lambda rows: spark.createDataFrame([(rows,)], "r array<struct<score:double,term:string>>").select(scenes.picked(F.col("r"))).first()[0]
    assert pick([(1.0, "dub techno"), (0.9, "techno"), (0.8, "ambient"), (0.4, "noise")]) == ["dub techno", "ambient"]
    home = lambda a, b, c: spark.range(1).select(scenes.scene_home(F.lit(a), F.lit(b), F.lit(c))).first()[0]
    assert [home(150, 300, 0.4), home(200, 800, 0.24), home(500, 1300, 0.096), home(80, 1000, 0.75), home(3, 1000, 1.0)] == ["place", "tinted", "global", "global", "global"]
    df = spark.createDataFrame([(1, "a", 3.0), (2, "a", 1.0), (1, "b", 2.0)], "scene int, term string, weight double")
    got = {(r.scene, r.term): r.score for r in scenes.term_scores(df, 1, 1.0).collect()}
    assert math.isclose(got[1, "b"], 2 / 5 * math.log(1 + 3 / 2))


def test_slugs_are_what_taking_turns_gives(spark):
    def by_turns(rows):
        used, out = set(), {}
        for i, base in sorted(rows):
            slug, k = base, i
            while slug in used:
                slug, k = f"{base}-{k}", k + 1
            used.add(slug)
            out[i] = slug
        return out

    def found(rows):
        return {r.id: r.slug for r in browse.slugs(spark.createDataFrame(rows, "id long, base string")).collect()}

    assert found([(1, "techno"), (5, "techno"), (7, "techno-5"), (9, None)]) == {1: "techno", 5: "techno-5", 7: "techno-5-7", 9: None}
    assert found([(1, "techno"), (4, "techno-5"), (5, "techno"), (6, "techno")]) == {1: "techno", 4: "techno-5", 5: "techno-6", 6: "techno-7"}
    draw = random.Random(4)
    rows = [(i, draw.choice(["a", "b", f"a-{i + draw.randrange(4)}", f"a-{draw.randrange(90)}"])) for i in draw.sample(range(90), 60)]
    got = found(rows)
    assert got == by_turns(rows) and len(set(got.values())) == len(rows)
    assert browse.slugs(spark.createDataFrame([], "id long, base string")).count() == 0


def test_names_go_down_the_chain(spark):
    """Twelve scenes of ten, so that terms of three to seven are in the vocabulary."""
    members, terms, artists = [], [], []
    city = {0: "Berlin", 5: "Leeds"}
    for s in range(12):
        for i in range(10):
            urn = f"u{s}-{i}"
            members.append((s, urn, float(i) if s != 1 else 0.0))
            artists.append((urn, urn, city.get(s), None, "hub" if (s, i) == (3, 9) else "artist"))
            say = lambda t, n=1: terms.append((urn, t, "genre", n))  # noqa: B023, E731
            if s in (0, 1, 2):
                say("Dub Techno", 9 - s)  # all three carry it: the first owns it
            if s in (0, 1, 4) and i < 8 - s:
                say("Noise")
            if s in (0, 6, 7) and i < 4:
                say("berlin", 50)  # a place
            if s in (1, 2, 8):
                say("dubtechno", 1)
            if s in (9, 10, 11) and i < 5:
                say("Jungle", 2)
            if s in (3, 9, 10) and i == 9:
                say("Rave", 99)  # by too few, and by a hub
    told = naming.name_scenes(
        spark.createDataFrame(members, "scene long, urn string, degree double"),
        spark.createDataFrame(terms, "urn string, term string, kind string, evidence long"),
        spark.createDataFrame(artists, "urn string, permalink string, city_raw string, country string, account_kind string"),
    )
    got = {r.scene: (r.name, r.tags) for r in told.collect()}
    # scene 0 has most carriers of both terms, of equals the first; its tags count degrees, those of scene 1 can't
    assert got[0] == ("Berlin Dub Techno · Noise", ["Dub Techno", "Noise"])
    assert got[1] == ("Dub Techno · Noise", ["Dub Techno", "Noise"]) and got[2] == ("Dub Techno", ["Dub Techno"])
    assert got[5] == ("Leeds", []) and got[9] == ("Jungle", ["Jungle"])
    assert got[10][0] == "Jungle" and got[6] == (None, []) and got[3] == (None, [])


def test_search(spark):
    rows = [("playlist", 1, "i", None, None, 5, None), ("track", 2, None, None, 9000, None, None), ("track", 3, None, None, 10, None, None), ("user", 4, None, 20, None, None, None)]
    df = spark.createDataFrame(rows, "kind string, id long, image string, followers long, plays long, likes long, tracks long")
    good = df.where(search.quality(F.col("kind"), F.col("image"), F.col("followers"), F.col("tracks"), F.col("plays")))
    assert [r.id for r in search.type_first(good, 9).collect()] == [4, 1, 2]
    t = spark.createDataFrame([(1, 11, 1), (1, 12, 2), (2, 21, 1), (2, 22, 2), (2, 11, 3)], "artist_rank int, track long, position int")
    assert [r.track for r in search.interleaved(t).collect()] == [11, 21, 12, 22]


def test_cache(spark):
    sets = spark.createDataFrame([("k", "1", "t", 0, 1000), ("k", "2", "t", 500, None), ("j", "1", "t", 0, 10)], "key string, value string, type string, at long, ttl long")
    got = {r.key: r for r in cache.latest(sets, stale_ms=100).withColumn("s", cache.state(105)).collect()}
    assert (got["k"].value, got["k"].fresh_until, got["k"].created_at, got["k"].s, got["j"].s) == ("2", 300_500, 0, "fresh", "stale")


@pytest.mark.parametrize("late", ["1 day"])
def test_recent_counts(spark, late):
    df = spark.createDataFrame([("2024-01-01 01:00:00", "a"), ("2024-01-01 23:00:00", "a"), ("2024-01-02 00:00:00", "a")], "t string, event_type string").withColumn("ts", F.col("t").cast("timestamp"))
    assert sorted(r.n for r in ingest.recent_counts(df, late=late).collect()) == [1, 2]


def test_scene_batch_names_two_scenes(spark, tmp_path):
    from scenewright.plans.scene_batch import compute_scenes

    genre = {0: "Dub Techno", 1: "Jungle", 2: "Noise"}
    urn = lambda g, i: f"{'abc'[g]}{i:02}"
    ties = [(urn(g, i), urn(g, j), "follow", 1.0) for g in range(3) for i in range(8) for j in range(8) if i != j] + [("a00", "b00", "follow", 1.0)]
    edges = spark.createDataFrame(ties, "src string, dst string, type string, weight double")
    who = [(urn(g, i), f"name{g}{i}", ["Berlin", None, "Leeds"][g], "X", 0 if g == 2 else 3, "artist", 5, 0, None, 0, None) for g in range(3) for i in range(8)]
    counts = "followers long, plays long, likes long, comments long, last_upload_at string"
    artists = spark.createDataFrame(who, f"urn string, permalink string, city_raw string, country string, track_count long, account_kind string, {counts}")
    terms = spark.createDataFrame([(urn(g, i), genre[g], "genre", 2) for g in range(3) for i in range(8)], "urn string, term string, kind string, evidence long")
    before = spark.createDataFrame([(7, urn(1, i)) for i in range(6)], "id long, member string")
    got = compute_scenes(edges, artists, terms, before, [1.0], dust=5, least_crawled=4)
    assert got.stats.count() == 1
    rows = {r.scene: r for r in got.scenes.collect()}
    assert sorted(rows) == [7, 8, 9] and {r.members for r in rows.values()} == {8}
    named = {r.name for r in rows.values()}
    # the vocabulary asks for terms of three scenes, so no term names one: a city does, or nothing
    assert named == {"Berlin", None}
    assert rows[7].name is None and {r.slug for r in rows.values()} == {"berlin", None}
    assert {r.degree for r in got.members.where("urn = 'b01'").collect()} == {7.0}
    assert compute_scenes(edges.limit(0), artists, terms, before.limit(0)).scenes.count() == 0
    # a run that is published hands its ids on to the next one, unnamed scenes included
    store = Store(spark, f"file://{tmp_path}/store")
    assert publish.previous_members(store).count() == 0
    publish.publish(store, publish.scene_tables(got.scenes, got.members, artists, terms, 1.0, F.lit("2024-01-01").cast("timestamp")), 2)
    again = compute_scenes(edges, artists, terms, publish.previous_members(store), [1.0], dust=5, least_crawled=4)
    told = lambda df: sorted((r.scene, r.urn, r.degree) for r in df.select("scene", "urn", "degree").collect())
    assert told(again.members) == told(got.members) == told(store.read("scene_members"))
    shown = {r.scene: r for r in store.read("scenes").collect()}
    assert [x.place for x in shown[7].roster] == list(range(1, 9)) and shown[7].hubs == [] and shown[7].total_count == 8
    assert {x.connections for x in shown[7].roster} == {7.0, 8.0} or {x.connections for x in shown[7].roster} == {7.0}
