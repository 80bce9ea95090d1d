import random
import re

from scenewright.llm import graph, ngram_join

W = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return re.sub("[A-Z]", lambda c: c[0].lower(), t or "")


def shingles(t, w):
    x = W.findall(low(t))
    return {tuple(x[i : i + w]) for i in range(len(x) - w + 1)} or ({tuple(x)} if x else set())


def brute(rows, w, percent):
    sets = [shingles(t, w) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            inter = len(a & sets[j])
            if a and sets[j] and 100 * inter >= percent * (len(a) + len(sets[j]) - inter):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return [(k, len(sets[i]), least[find(i)]) for i, (k, _) in enumerate(rows)]


def corpus(seed=3):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = draw.choices(vocabulary, k=60)
    rows = []
    for g in range(25):
        own = draw.choices(vocabulary, k=draw.choice([1, 2, 4, 30, 120, 200]))
        if g % 3 == 0:
            own[10:10] = passage
        for _ in range(draw.choice([1, 2, 3, 12])):
            x = list(own)
            for _ in range(draw.randrange(0, 6)):
                x[draw.randrange(len(x))] = draw.choice(vocabulary)
            rows.append(" ".join(y.upper() if draw.random() < 0.1 else y for y in x))
    rows += ["", " \n", "only", "ONLY", "a b", "a  b", "b a", "a a a a a", "a a a a", "é É"]
    draw.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


def test_equals_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, n int")
    for w, percent in ((3, 90), (5, 80), (1, 55)):
        got = ngram_join.join(df, words=w, percent=percent).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, w, percent)), (w, percent)


def test_no_link_is_lost_without_rounds_or_with_one_bucket(spark, monkeypatch):
    rows = corpus(9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(brute(rows, 3, 80))
    for rounds, part in ((0, 1), (1, 4)):
        monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
        monkeypatch.setattr(ngram_join, "PART", part)
        monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
        got = ngram_join.join(df, words=3, percent=80).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_many_near_copies_with_changes_of_their_own(spark):
    draw = random.Random(4)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for g in range(300):  # most are too far from each other to link, and hang together by the least changed
        x = list(base)
        for _ in range(draw.choice([0, 1, 1, 2, 2, 3])):
            x[draw.randrange(120)] = f"c{draw.randrange(400)}"
        rows.append((g, " ".join(x)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.join(df, words=3, percent=90).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, 3, 90))


def test_very_long_texts(spark):
    long = " ".join(f"v{i % 70_000}" for i in range(150_000))
    rows = [(1, long), (2, long + " end"), (3, "v1 v2 v3 v4 v5 v6"), (4, long[: len(long) // 3])]
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=90).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 1), (3, 3), (4, 4)]


def test_nulls_repeated_keys_and_empty_tables(spark):
    long = " ".join(f"v{i}" for i in range(50))
    rows = [(None, long), (5, long), (4, long + " z"), (4, "another text that is quite different from it"), (None, None), (9, None), (None, "alone it stands here")]
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=90).collect()
    assert len(got) == len(rows)
    assert sorted((r.component_id for r in got if r.n_shingles >= 48)) == [4, 4, 4]
    assert [r.component_id for r in got if r.doc_id == 9] == [9]
    assert ngram_join.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    draw = random.Random(1)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, x) for x in range(2001, 2100)] + [(7, 7)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = graph.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((i, find(i)) for i in root)
