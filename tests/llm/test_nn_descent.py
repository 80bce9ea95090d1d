import math
import random

import numpy as np

from scenewright.llm import nn_descent as N

SCHEMA = "vec_id long, embedding array<float>, label int, node string, m int"


def brute(rows, cosine):
    def good(r):
        v = r[1]
        return r[0] is not None and r[2] is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    own = [r for r in rows if good(r)]
    links, root = [0] * len(own), list(range(len(own)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    unit = [np.array(r[1], np.float32).astype(float) for r in own]
    unit = [u / np.linalg.norm(u) for u in unit]
    for i in range(len(own)):
        for j in range(i):
            if own[i][2] == own[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(own):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    told = {r[0]: (links[i], least[find(i)]) for i, r in enumerate(own)}
    return sorted((r[0], *told.get(r[0], (0, r[0]))) for r in rows)


def vectors(seed, n_groups=60, dim=16, most=40, noise=(0.02, 0.06, 0.1)):
    draw, rng = random.Random(seed), np.random.default_rng(seed)
    rows, i = [], 0
    for _ in range(n_groups):
        centre, label = rng.normal(size=dim), draw.choice([1, 1, 1, 2])
        for _ in range(draw.choice([1, 1, 2, 5, most])):
            v = (centre + draw.choice(noise) * np.linalg.norm(centre) * rng.normal(size=dim)) * draw.choice([1, 3])
            rows.append((i, [float(np.float32(x)) for x in v], label, "x", 1))
            i += draw.randrange(1, 4)
    draw.shuffle(rows)
    return rows


def test_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 64)
    for seed in (1, 2):
        rows = vectors(seed)
        rows += [(9000, rows[0][1], rows[0][2], "y", 0), (9001, rows[0][1], rows[0][2], "y", 0)]
        got = N.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute(rows, 0.93)
        assert all(r.kept == (r.vec_id == r.component_id) for r in got) and got[0].recall >= N.RECALL


def test_lists_are_enlarged_where_cells_cannot_gather(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 64)
    monkeypatch.setattr(N, "K", 3)
    rows = vectors(5, n_groups=12, most=60, noise=(0.09,))
    got = N.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    want = brute(rows, 0.93)
    found, true = sum(r.n_links for r in got), sum(x[1] for x in want)
    assert 0.98 * true <= found <= true


def test_odd_vectors_link_with_nothing(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, v, None), (3, None, 1), (4, [0.0] * 3, 1), (5, [1.0, None, 3.0], 1), (6, [1.0, float("nan"), 3.0], 1), (7, [float("inf")] * 3, 1),
            (8, [2.0, 4.0, 6.0], 1), (9, [1.0, 2.0], 1), (10, [], 1), (11, v, 2), (12, [1e-30, 2e-30, 3e-30], 1)]
    rows = [(*r, None, None) for r in rows]
    got = {r.vec_id: r for r in N.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i: r.n_links for i, r in got.items() if r.n_links} == {1: 2, 8: 2, 12: 2}
    assert [got[i].component_id for i in (1, 8, 12, 11, 5)] == [1, 1, 1, 11, 5]
    assert N.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rows_that_repeat_a_key(spark):
    rng = np.random.default_rng(5)
    one, other = ([float(np.float32(x)) for x in rng.normal(size=8)] for _ in range(2))
    near = [float(np.float32(x * 1.001)) for x in one]
    rows = [(7, one, 1, "x", 0), (7, other, 1, "x", 0), (3, near, 1, "y", 0), (8, one, 2, "z", 0), (7, one, 1, "x", 0)]
    got = N.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(3, 2, 3, True), (7, 0, 7, True), (7, 2, 3, False), (7, 2, 3, False), (8, 0, 8, True)]


def test_many_equal_vectors(spark):
    rows = [(i, [1.0, 2.0], 1, "x", 0) for i in range(3000)] + [(9000, [2.0, -1.0], 1, "x", 0)]
    got = N.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.n_links, r.component_id) for r in got if r.vec_id < 3000} == {(2999, 0)} and (0, 9000) in {(r.n_links, r.component_id) for r in got}


def test_doubles_keep_their_precision(spark):
    rows = [(1, [1e300, 0.0], 1), (2, [1e300, 0.0], 1), (3, [1e-300, 1e-310], 1), (4, [0.0, 1e200], 1), (5, [1e-320, 5e200], 1), (6, None, 1)]
    got = N.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 6: (0, 6)}
    edge = [(1, [1.0, 0.0], 1), (2, [0.93, math.sqrt(1 - 0.93**2) - 1e-12], 1), (3, [0.93, math.sqrt(1 - 0.93**2) + 1e-9], 1)]
    got = N.near_duplicates(spark.createDataFrame(edge, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.vec_id: r.n_links for r in got} == {1: 1, 2: 2, 3: 1}


def test_one_vector_on_a_third_of_the_rows(spark):
    rows = vectors(3, n_groups=30)
    rows += [(100_000 + i, rows[0][1], rows[0][2], "x", 1) for i in range(len(rows) // 2)]
    got = N.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute(rows, 0.93)


def test_blocks_against_blocks_where_the_descent_finds_too_little(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 32)
    monkeypatch.setattr(N, "PASSES", 1)
    monkeypatch.setattr(N, "RECALL", 1.1)
    monkeypatch.setattr(N, "LEAST_RECALL", 1.1)
    rows = vectors(8, n_groups=25)
    got = N.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute(rows, 0.93) and got[0].recall == 1.0
