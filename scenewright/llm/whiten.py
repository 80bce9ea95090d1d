"""Embedding whitening by upper-triangle column aggregates.

Vectors are quantised to integers. Over each distinct one, once, Spark sums the columns, then, with an expression
generated for every pair of dimensions i <= j, the products of the centred columns, all in one aggregation. The one row
that comes back is the covariance's upper triangle; LAPACK decomposes it, and every vector is projected on the first
components, each over the root of its eigenvalue.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenewright.llm.common import cut

#: Pairs of dimensions in one aggregation; vectors of more than 90 dimensions take as many aggregations as needed.
PAIRS = 4096
#: An eigenvalue below this share of the largest is rounding and no variance.
LEAST_SHARE = 1e-11


@dataclass
class Fit:
    """n distinct vectors, their columns' sums, the covariance's eigenvalues, falling, and eigenvectors (columns)."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    @property
    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The means as integers and what is left of them, so that a centred integer is rounded once."""
        whole = [s // self.n for s in self.sums]
        rest = [float(Fraction(s - w * self.n, self.n)) for s, w in zip(self.sums, whole, strict=True)]
        return np.array(whole, np.float64), np.array(rest)

    def explained(self, k: int) -> float | None:
        """The share of component k (from 0) in the whole variance; None if there is no variance."""
        total = float(self.values.sum())
        return float(self.values[k]) / total if total > 0 else None

    def scales(self, components: int) -> np.ndarray:
        """1 / sqrt(eigenvalue) of the first components; NaN for those without variance."""
        e = self.values[:components]
        good = e > LEAST_SHARE * max(float(self.values[0]), 0.0) if len(e) else e > 0
        return np.where(good, 1 / np.sqrt(np.where(good, e, 1.0)), np.nan)


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * entry) of each entry as a long (of entries beyond 64 bits, the greatest or least long); null for a
    null vector and for one with an entry that is null or not finite."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.when(finite, F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long")))


def covariance(fit: DataFrame, n: int, sums: list[int], pairs: int = PAIRS) -> np.ndarray:
    """The covariance (divisor n) of the arrays `x` of fit, by one expression for each pair of dimensions."""
    d = len(sums)
    whole, rest = Fit(n, sums, np.zeros(0), np.zeros(0)).centre
    literal = lambda values: F.array(*[F.lit(float(v)) for v in values])
    centred = F.zip_with(F.zip_with("x", literal(whole), lambda v, c: v.cast("double") - c), literal(rest), lambda v, c: v - c)
    rows = fit.select(centred.alias("c"))
    wanted = [(i, j) for i in range(d) for j in range(i, d)]
    out = np.zeros((d, d))
    for at in range(0, len(wanted), pairs):
        some = wanted[at : at + pairs]
        found = rows.selectExpr(*[f"sum(c[{i}] * c[{j}]) as s{k}" for k, (i, j) in enumerate(some)]).first()
        for (i, j), s in zip(some, found, strict=True):
            out[i, j] = out[j, i] = s / n
    return out


def fit(distinct: DataFrame) -> Fit | None:
    """The fit of a table of distinct arrays `x` of one length; None if it is empty."""
    d = distinct.select(F.size("x").alias("d")).limit(1).collect()
    if not d:
        return None
    wide = [F.sum(F.col("x")[i].cast("decimal(19,0)")).alias(f"s{i}") for i in range(d[0].d)]  # exact
    n, *sums = distinct.agg(F.count("*"), *wide).first()
    sums = [int(s) for s in sums]
    values, vectors = np.linalg.eigh(covariance(distinct, n, sums))
    return Fit(n, sums, np.maximum(values[::-1], 0.0), vectors[:, ::-1])


def _projected(rows: DataFrame, keys: list[str], found: Fit, components: int) -> DataFrame:
    """keys, deviation (the exact sum of squares of n * x - S; null beyond 38 digits) and scores (one for each
    component, NaN for one without variance)."""
    schema = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys), "deviation decimal(38,0), scores array<double>"])
    d, n, sums = len(found.sums), found.n, found.sums
    whole, rest = found.centre
    ways = found.vectors[:, :components] * found.scales(components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact, most = np.array(sums, object), max(map(abs, sums), default=0)
        for batch in batches:
            x = batch.column(len(keys)).flatten().to_numpy().reshape(batch.num_rows, d)
            scores = (x.astype(np.float64) - whole - rest) @ ways
            top = max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
            if d * (n * top + most) ** 2 < 1 << 63:
                off = n * x - np.array(sums, np.int64)
                deviation = pa.array((off * off).sum(axis=1)).cast(pa.decimal128(38, 0))
            else:
                off = n * x.astype(object) - exact
                told = [int(s) for s in (off * off).sum(axis=1)] if d else [0] * batch.num_rows
                deviation = pa.array([s if s < 10**38 else None for s in told], pa.decimal128(38, 0))
            k = scores.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * k), pa.array(scores.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], deviation, lists], names=[*keys, "deviation", "scores"])

    return rows.select(*[F.col(f"`{k}`") for k in keys], "x").mapInArrow(run, schema)


def identity_error(scores: DataFrame, scales: np.ndarray) -> float | None:
    """The largest absolute entry of the scores' covariance minus the identity, over the components with variance."""
    good = [int(k) for k in np.flatnonzero(~np.isnan(scales))]
    pairs = [(i, j) for i in good for j in good if i <= j]
    if not pairs:
        return None
    found = scores.selectExpr(*[f"covar_pop(scores[{i}], scores[{j}]) as s{k}" for k, (i, j) in enumerate(pairs)]).first()
    return max(abs(s - (i == j)) for s, (i, j) in zip(found, pairs, strict=True))


def whiten(df: DataFrame, keys: list[str], vector: str, *, components: int = 4, scale: int = 256) -> DataFrame:
    """For every row of df with a valid vector and each of the first components (at most its dimensions): keys,
    component (from 1), n, deviation, whitened, explained and identity_error.

    A vector that is null or holds null or non-finite entries is left out. The fit is of vectors of one length, that of
    most rows (of equally many, the least); others are left out, too. Rows that repeat a vector are all returned and
    count once in the fit. A component without variance (all of them, where only one vector is left) has a null
    whitened value; explained is null where nothing varies. An empty table gives no rows; other columns are not read."""
    rows = df.select(*[F.col(f"`{k}`") for k in keys], quantised(F.col(vector), scale).alias("x")).where("x is not null")
    length = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    dim = length[0].d if length else 0
    rows = rows.where(F.size("x") == dim)
    distinct = cut(rows.select("x").distinct())
    found = fit(distinct) if dim else None
    if found is None:
        kept = rows.select(*[F.col(f"`{k}`") for k in keys]).limit(0)
        return kept.selectExpr("*", *[f"cast(null as {t}) as {c}" for c, t in COLUMNS.items()])
    components = min(components, dim)
    scales = found.scales(components)
    error = identity_error(_projected(distinct, [], found, components), scales)
    table = F.array(*[F.struct(F.lit(k + 1).alias("component"), F.lit(found.explained(k)).cast("double").alias("explained")) for k in range(components)])
    out = _projected(rows, keys, found, components).withColumn("_of", F.explode(F.arrays_zip(table.alias("t"), F.col("scores").alias("s"))))
    return out.select(
        *[F.col(f"`{k}`") for k in keys],
        F.col("_of.t.component").alias("component"),
        F.lit(found.n).cast("long").alias("n"),
        "deviation",
        F.nanvl("_of.s", F.lit(None).cast("double")).alias("whitened"),
        F.col("_of.t.explained").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


COLUMNS = {"component": "int", "n": "bigint", "deviation": "decimal(38,0)", "whitened": "double", "explained": "double", "identity_error": "double"}
