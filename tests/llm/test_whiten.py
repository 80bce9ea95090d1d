import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenewright.llm import whiten


def brute(rows, components, scale=256):
    good = [(k, [math.floor(scale * float(c)) for c in v]) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}), object)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    x = fit.astype(float) - np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh(x.T @ x / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for key, v in good:
        d = sum((n * a - s) ** 2 for a, s in zip(v, sums))
        w = (np.array(v, float) - np.array([s / n for s in sums])) @ vectors[:, :components] / np.sqrt(values[:components])
        out.setdefault(key, []).append((d, w))
    return n, out, values / values.sum()


def vectors(seed, rows, dim):
    draw = np.random.default_rng(seed)
    mix = draw.normal(size=(dim, dim)) * np.linspace(3, 0.2, dim)
    return [(i, [float(c) for c in v]) for i, v in enumerate(draw.normal(size=(rows, dim)) @ mix + draw.normal(size=dim) * 5)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_against_numpy(spark, kind):
    rows = vectors(4, 150, 7)
    if kind == "float":
        rows = [(i, [float(np.float32(c)) for c in v]) for i, v in rows]
    bad = [(900, None), (901, [None] + rows[0][1][1:]), (902, [float("nan")] + rows[0][1][1:]), (903, rows[0][1][:-1] + [float("-inf")]), (904, [1.0, 2.0])]
    more = [(500 + i, rows[3][1]) for i in range(60)] + [rows[3], (None, rows[4][1])]
    df = spark.createDataFrame(rows + bad + more, f"vec_id long, embedding array<{kind}>").withColumn("n", F.lit("clash")).withColumn("x", F.lit(1)).repartition(3)
    got = whiten.whiten(df, ["vec_id"], "embedding", components=4).collect()
    n, want, share = brute(rows + more, 4)
    assert n == 150 and len(got) == 4 * (len(rows) + len(more))
    by = {}
    for r in got:
        by.setdefault((r.vec_id, int(r.deviation)), {}).setdefault(r.component, []).append(r.whitened)
        assert r.n == n and abs(r.explained - share[r.component - 1]) < 1e-9 and r.identity_error < 1e-9
    signs = None
    for (key, deviation), found in by.items():
        d, w = want[key][0]
        assert deviation == d and all(len(set(x)) == 1 for x in found.values())
        mine = np.array([found[k][0] for k in (1, 2, 3, 4)])
        if signs is None:
            signs = np.sign(mine * w)
        assert np.allclose(mine * signs, w, rtol=1e-9, atol=1e-9)


def test_pairs_in_several_aggregations(spark):
    rows = [(tuple(random.Random(i).randrange(-99, 99) for _ in range(6)),) for i in range(40)]
    df = spark.createDataFrame([(list(x),) for (x,) in rows], "x array<long>")
    x = np.array([r[0] for r in rows], float)
    sums = [int(s) for s in x.sum(axis=0)]
    want = (x - x.mean(axis=0)).T @ (x - x.mean(axis=0)) / len(x)
    for pairs in (4, 4096):
        assert np.allclose(whiten.covariance(df, len(rows), sums, pairs), want, rtol=1e-12)


def test_large_entries_stay_exact(spark):
    rows = [(1, [1e12, 3.0]), (2, [-1e12, 4.0]), (3, [5e11, 1e300]), (4, [0.0, -0.0])]
    got = {r.vec_id: r for r in whiten.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), ["vec_id"], "embedding", components=1).collect()}
    x = {1: [256 * 10**12, 768], 2: [-256 * 10**12, 1024], 3: [128 * 10**12, 2**63 - 1], 4: [0, 0]}
    sums = [sum(v[i] for v in x.values()) for i in (0, 1)]
    for k, v in x.items():
        d = sum((4 * a - s) ** 2 for a, s in zip(v, sums))
        assert got[k].deviation == (d if d < 10**38 else None)


def test_without_variance_and_without_rows(spark):
    schema = "vec_id long, embedding array<double>"
    one = whiten.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema), ["vec_id"], "embedding").collect()
    assert [(r.component, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in one] == [(k, 1, 0, None, None, None) for k in (1, 2, 1, 2)]
    flat = whiten.whiten(spark.createDataFrame([(i, [float(i), 5.0]) for i in range(9)], schema), ["vec_id"], "embedding").collect()
    assert all((r.whitened is None) == (r.component == 2) for r in flat) and max(r.identity_error for r in flat) < 1e-9
    for rows in ([], [(1, None)], [(1, [])], [(None, [None])]):
        out = whiten.whiten(spark.createDataFrame(rows, schema), ["vec_id"], "embedding")
        assert out.columns == ["vec_id", *whiten.COLUMNS] and out.count() == 0
