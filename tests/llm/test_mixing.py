import random
from collections import defaultdict

from pyspark.sql import functions as F

from scenewright.llm import mixing


def fill(sizes, weights, share, cap):
    """Deal, cap and reshare until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, free = dict.fromkeys(order, 0.0), share * sum(sizes.values()), set(order)
    while left > 1e-9 and free:
        total = sum(w[s] for s in free)
        for s in free:
            target[s] += left * w[s] / total
        left = 0.0
        for s in list(free):
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                free.discard(s)
    return target


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, size long, target string")


def test_targets_and_taken_words(spark):
    draw = random.Random(3)
    rows = [(i, draw.choice(["a", "b", "b", "b", "é", "z", None]), draw.choice([0, 3, 50, 400, None]), "x") for i in range(2000)]
    rows += [(5000, "empty", 0, None)]
    got = mixing.mix(frame(spark, rows), ["doc_id"]).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, s, n, _ in rows:
        sizes[s] += n or 0
    want = fill(sizes, [5, 2, 1], 1.5, 2)
    taken = defaultdict(int)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and r.source_size == sizes[r.source]
        assert r.taken == r.copies * (r["size"] or 0) and r.copies <= 2
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 200  # half of the largest document
    again = mixing.mix(frame(spark, rows[::-1]).repartition(5), ["doc_id"]).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_the_slice_of_the_cut_does_not_matter(spark, monkeypatch):
    rows = [(i, "ab"[i % 2], i % 90, None) for i in range(3000)]
    one = mixing.mix(frame(spark, rows), ["doc_id"]).select("doc_id", "copies").collect()
    monkeypatch.setattr(mixing, "sliced", lambda n: 37)
    assert sorted(mixing.mix(frame(spark, rows), ["doc_id"]).select("doc_id", "copies").collect()) == sorted(one)


def test_equal_keys_and_empty_tables(spark):
    rows = [(None, "a", 10, None)] * 5 + [(1, None, 10, None)]
    got = mixing.mix(frame(spark, rows), ["doc_id"]).collect()
    assert len(got) == 6 and len({r.copies for r in got if r.source == "a"}) == 1
    assert mixing.mix(frame(spark, []), ["doc_id"]).count() == 0


def test_pareto_rank_orders_by_odds(spark):
    df = spark.createDataFrame([(0.5, 0.5), (0.5, 0.9), (0.5, 1.0), (0.5, 0.0)], "u double, p double")
    one, likely, certain, never = [r[0] for r in df.select(mixing.pareto_rank(F.col("u"), F.col("p"))).collect()]
    assert certain == 0 < likely < one == 1 < never


def test_words(spark):
    df = spark.createDataFrame([(None,), ("",), (" a\tb c\x1c d\n",)], "t string")
    assert [r[0] for r in df.select(mixing.n_words(F.col("t"))).collect()] == [0, 0, 3]


def test_the_order_weighs_inclusion_and_not_the_draw_alone(spark, monkeypatch):
    rows = [(i, "x" if i % 3 else None, 1 << (i % 11)) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = {r.doc_id: r for r in mixing.mix(df, ["doc_id"]).collect()}
    by_size = {}
    for r in got.values():
        by_size.setdefault((r.source, r["size"]), []).append(r)
    for own in by_size.values():  # all of one length have one inclusion, and are taken about so often
        assert len({r.inclusion for r in own}) == 1
        whole = min(r.copies for r in own)
        assert abs(sum(r.copies for r in own) / len(own) - whole - own[0].inclusion) < 0.15 or own[0].inclusion < 1e-9
    assert len({r.inclusion for r in got.values() if r.source == "x"}) > 5
    for source in ("x", None):
        own = [r for r in got.values() if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1024 and all(r.taken <= 2 * r["size"] for r in own)
    monkeypatch.setattr(mixing, "pareto_rank", lambda u, inclusion: u / (1 - u))
    plain = {r.doc_id: r.copies for r in mixing.mix(df, ["doc_id"]).collect()}
    assert sum(plain[i] != r.copies for i, r in got.items()) > 100


def plain_mix(rows, u, weights=(5, 2, 1), share=1.5, cap=2.0):
    """The copies of rows (id, source, size) with draws u: levels by bisection, and the whole order sorted."""
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    aim, out = fill(sizes, list(weights), share, cap), {}
    for source in sizes:
        own = [(i, n, n.bit_length()) for i, s, n in rows if s == source]
        low, high = 0.0, 1e9
        for _ in range(300):
            level = (low + high) / 2
            low, high = (level, high) if sum(n * min(cap, level * (d + 1)) for _, n, d in own) < aim[source] else (low, level)
        copies = {d: min(cap, high * (d + 1)) if aim[source] > 0 else 0.0 for _, _, d in own}
        whole = {d: int(c + 1e-9) for d, c in copies.items()}
        order = []
        for i, n, d in own:
            p = max(0.0, copies[d] - whole[d])
            if p > 1e-12:
                r = u[i] / (1 - u[i]) / (p / (1 - p))
                order.append((r / (1 + r), u[i], n, i))
        order.sort()
        rest, best, total = aim[source] - sum(n * whole[d] for _, n, d in own), None, 0
        for k in range(len(order) + 1):
            off = abs(total - rest)
            if best is None or off < best[0] - 1e-9:
                best = (off, k)
            total += order[k][2] if k < len(order) else 0
        more = {i for *_, i in order[: best[1] if rest > 0 else 0]}
        out |= {i: whole[d] + (i in more) for i, _, d in own}
    return out


def test_row_by_row_against_a_plain_mix(spark):
    draw = random.Random(11)
    rows = [(i, draw.choice(["a", "b", "b", "c", "c", "c", None, "é"]), draw.choice([0, 1, 7, 90, 800, 5000]) + draw.randrange(40)) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    u = {r.doc_id: r.u for r in df.select("doc_id", mixing.draw(["doc_id"], 9).alias("u")).collect()}
    got = {r.doc_id: r.copies for r in mixing.mix(df, ["doc_id"]).collect()}
    want = plain_mix(rows, u)
    assert got == want and len(set(want.values())) > 1
