"""Near-duplicate embeddings by NN-descent.

Vectors link when their labels are equal and their cosine is at least a threshold. The neighbour graph starts from
blocks of vectors that fall together under random hyperplanes and is refined by joins of neighbours' neighbours, until
a round improves little. A list that is full of links may have lost some, so it is enlarged, and its surroundings are
refined again. A sample of vectors is compared with all others in the end; where links are missing, more blocks and
rounds follow.

Before that, tight groups are put together, as a group of g near copies has g x g / 2 links. All vectors within half
of the threshold's angle of one pivot link with each other, whatever their number, so such a cell is one node with a
radius. Two cells link wholly, or not at all, or must be compared member by member, as the angle of their pivots and
their radii tell; such comparisons are made in blocks of members and give counts, not pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenewright.llm.common import cut, join_hot
from scenewright.llm.graph import components

#: Neighbours in a list at first, and links beyond which a list isn't enlarged any more in one pass (it doubles).
K = 8
#: Vectors in a block, in expectation.
BLOCK = 512
#: Hyperplane tables from which the graph starts.
TABLES = 4
#: Rounds of refinement at most; a round that changes less than LITTLE of the lists is the last.
ROUNDS, LITTLE = 5, 0.01
#: Cells of the audit (expected), the recall that it asks for, passes until it is met, each with twice the tables of
#: the one before, and the recall below which, after the last one, blocks are compared with blocks.
AUDIT, RECALL, PASSES, LEAST_RECALL = 256, 0.98, 6, 0.95
#: Angles are known up to this.
EPS = 1e-6
PLANES = 24


def _planes(dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).normal(size=(dim, PLANES))


def _unit(vectors: list[bytes]) -> np.ndarray:
    """Vectors of one length as rows of length 1, in double precision. Their first byte is the width of a number."""
    kind = np.float32 if vectors[0][0] == 4 else np.float64
    x = np.frombuffer(b"".join([v[1:] for v in vectors]), kind).reshape(len(vectors), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # else squares of very large or small numbers are lost
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def valid(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(node, label, dim, vec, m, least): the vectors that may link, equal ones as one with their number and smallest
    key. A node is named by a 64-bit hash of its label and vector, as keys may repeat."""
    good = valid_rows(df, key, vector, label).where("vec is not null")
    width = F.ascii(F.substring(F.col("vec"), 1, 1).cast("string"))  # 4 or 8
    return good.groupBy("label", "vec").agg(F.min("key").alias("least"), F.count("*").alias("m")).select(
        F.xxhash64("label", "vec").alias("node"), "label", ((F.length("vec") - 1) / width).cast("int").alias("dim"), "vec", "m", "least"
    )


def _blocks(nodes: DataFrame, seed: int) -> DataFrame:
    """nodes with block: vectors of one label that fall together under hyperplanes, about BLOCK in each.

    The larger a label, the more planes part it; what still falls together in large numbers is parted by a hash."""
    names = nodes.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields)
    i = names.index("vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column(i).to_pylist()
            code = np.zeros(len(vec), np.int64)
            sizes = np.array([len(v) for v in vec])
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                x = _unit([vec[k] for k in own])
                signs = x @ _planes(x.shape[1], seed) > 0
                code[own] = signs @ (1 << np.arange(PLANES)[::-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code)], names=[*names, "_code"])

    coded = nodes.mapInArrow(run, f"{schema}, _code long")
    per = nodes.groupBy("label", "dim").agg(F.count("*").alias("_n"))
    planes = F.least(F.lit(PLANES), F.greatest(F.lit(0), F.ceil(F.log2(F.col("_n") / BLOCK)))).cast("int")
    per = per.withColumn("_shift", F.lit(PLANES) - planes).drop("_n")
    coded = coded.join(per, ["label", "dim"]).withColumn("_code", F.expr("shiftright(_code, _shift)")).drop("_shift")
    full = coded.groupBy("label", "dim", "_code").agg(F.ceil(F.count("*") / (2 * BLOCK)).cast("int").alias("_parts"))
    out = coded.join(full, ["label", "dim", "_code"])
    return out.withColumn("_part", F.pmod(F.xxhash64(F.lit(seed), "node"), F.col("_parts")).cast("int"))


BLOCKED = ["label", "dim", "_code", "_part"]


def cells(nodes: DataFrame, reach: float) -> tuple[DataFrame, DataFrame]:
    """(pivots, members): pivots is nodes with radius and size (in vectors), members has (node, pivot).

    A cell's vectors lie within `reach` of its pivot. Cells are made inside blocks, then of pivots in other blocks."""

    def gather(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("node").to_numpy(), kind="stable")
        node, radius = rows.column("node").to_numpy()[order], rows.column("radius").to_numpy()[order]
        x = _unit(rows.column("vec").to_pylist())[order]
        pivot, least = np.full(len(x), -1), np.zeros(len(x))
        for i in range(len(x)):
            if pivot[i] < 0:
                far = _angle(x @ x[i]) + radius + EPS
                far[i] = radius[i]
                own = (pivot < 0) & (far <= reach)
                own[i] = True
                pivot[own], least[own] = i, far[own]
        return pa.table({"node": node, "pivot": node[pivot], "far": least})

    now = nodes.select("node", "label", "dim", "vec", "m", "least").withColumn("radius", F.lit(0.0))
    members = None
    for seed in (11, 12, 13):
        found = cut(_blocks(now, seed).groupBy(*BLOCKED).applyInArrow(gather, "node long, pivot long, far double"))
        radii = found.groupBy("pivot").agg(F.max("far").alias("r"))
        if members is None:
            members = found.select("node", "pivot")
        else:
            step = found.select(F.col("node").alias("old"), F.col("pivot").alias("new"))
            members = members.join(step, F.col("pivot") == F.col("old")).select("node", F.col("new").alias("pivot"))
        members = cut(members)
        now = cut(now.drop("radius").join(radii, F.col("node") == F.col("pivot")).drop("pivot").withColumnRenamed("r", "radius"))
    sizes = members.join(nodes.select("node", "m"), "node").groupBy("pivot").agg(F.sum("m").alias("size"), F.count("*").alias("n"))
    return cut(now.drop("m", "least").join(sizes, F.col("node") == F.col("pivot")).drop("pivot")), members


def _top(lists: DataFrame) -> DataFrame:
    """The best k of each node's neighbours (i, j, s, k), each neighbour once."""
    best = lists.groupBy("i", "j").agg(F.max("s").alias("s"), F.max("k").alias("k"))
    order = Window.partitionBy("i").orderBy(F.desc("s"), "j")
    return best.withColumn("k", F.max("k").over(Window.partitionBy("i"))).withColumn("_at", F.row_number().over(order)).where("_at <= k").drop("_at")


def _start(nodes: DataFrame, seeds: list[int]) -> DataFrame:
    """(i, j, s, k): each node's best neighbours in its blocks."""

    def near(rows: pa.Table) -> pa.Table:
        node = rows.column("node").to_numpy()
        x = _unit(rows.column("vec").to_pylist())
        i, j, s = [], [], []
        for a in range(0, len(x), 1024):
            sim = x[a : a + 1024] @ x.T
            sim[np.arange(len(sim)), a + np.arange(len(sim))] = -2
            k = min(K, len(x) - 1)
            if k > 0:
                top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
                i.append(np.repeat(node[a : a + 1024], k))
                j.append(node[top].ravel())
                s.append(np.take_along_axis(sim, top, axis=1).ravel())
        flat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        return pa.table({"i": flat(i, np.int64), "j": flat(j, np.int64), "s": flat(s, np.float64)})

    out = None
    for seed in seeds:
        one = _blocks(nodes.select("node", "label", "dim", "vec"), seed).groupBy(*BLOCKED).applyInArrow(near, "i long, j long, s double")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("k", F.lit(K))


def _local_join(lists: DataFrame, nodes: DataFrame, around: DataFrame | None) -> DataFrame:
    """(i, j, s) of neighbours' neighbours that are nearer than the last of i's list.

    A node's surroundings are its list and as many of those that have it in theirs, drawn by a hash. around: the nodes
    whose surroundings are looked at (all, if None)."""
    last = lists.groupBy("i").agg(F.min("s").alias("low"), F.count("*").alias("n"), F.max("k").alias("k"))
    bound = last.select(F.col("i").alias("member"), F.when(F.col("n") >= F.col("k"), F.col("low")).otherwise(F.lit(-2.0)).alias("low"))
    drawn = Window.partitionBy("v").orderBy(F.xxhash64("member", "v"))
    back = lists.select(F.col("j").alias("v"), F.col("i").alias("member"), "k").withColumn("_at", F.row_number().over(drawn)).where("_at <= k")
    own = lists.select(F.col("i").alias("v"), F.col("j").alias("member"))
    # the node itself stands in its surroundings, so lists become mutual
    itself = last.select(F.col("i").alias("v"), F.col("i").alias("member"))
    near = own.unionByName(back.select("v", "member")).unionByName(itself).distinct()
    if around is not None:
        near = near.join(around, "v", "left_semi")
    rows = near.join(bound, "member").join(nodes.select(F.col("node").alias("member"), "vec"), "member")
    groups = rows.groupBy("v").agg(F.collect_list(F.struct("member", "low", "vec")).alias("near"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            flat, at = column.flatten(), np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]
            member, low = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            vec = flat.field(2)
            i, j, s = [], [], []
            for a, b in zip(at[:-1], at[1:], strict=True):
                x = _unit(vec.slice(a, b - a).to_pylist())
                sim = x @ x.T
                np.fill_diagonal(sim, -3)
                p, q = np.nonzero(sim > low[a:b, None])
                i.append(member[a + p])
                j.append(member[a + q])
                s.append(sim[p, q])
            if i:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (i, j, s)], names=["i", "j", "s"])

    found = groups.select("near").mapInArrow(run, "i long, j long, s double")
    return found.distinct()


def _refine(lists: DataFrame, nodes: DataFrame, around: DataFrame | None = None) -> DataFrame:
    total = None
    for _ in range(ROUNDS):
        k = lists.groupBy("i").agg(F.max("k").alias("k"))
        more = _local_join(lists, nodes, around).join(k, "i")
        now = cut(_top(lists.select("i", "j", "s", "k").unionByName(more.select("i", "j", "s", "k"))))
        fresh = now.join(lists.select("i", "j"), ["i", "j"], "left_anti").count()
        total = now.count() if total is None else total
        lists = now
        if fresh <= LITTLE * total:
            break
    return lists


def _near(lists: DataFrame, nodes: DataFrame, theta: float) -> DataFrame:
    """(a, b, angle, ra, rb, link): the pairs of lists, a < b, whose cells may hold links; link: surely all of them."""
    r = nodes.select("node", "radius")
    pairs = lists.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "s").groupBy("a", "b").agg(F.max("s").alias("s"))
    both = pairs.join(r.toDF("a", "ra"), "a").join(r.toDF("b", "rb"), "b")
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("s"))))
    both = both.withColumn("angle", angle)
    return both.where(F.col("angle") <= theta + F.col("ra") + F.col("rb") + EPS)


def _audit(lists: DataFrame, nodes: DataFrame, theta: float, seed: int) -> tuple[float, DataFrame]:
    """The share of a sample's near pairs that the lists have, and those that they lack, as (i, j, s). The sample is of
    about AUDIT cells; a pair weighs as much as the pairs of vectors that it stands for."""
    n = nodes.count()
    drawn = nodes.where(F.pmod(F.xxhash64(F.lit(seed), "node"), F.lit(1_000_000)) < math.ceil(1e6 * min(1.0, AUDIT / max(1, n))))
    sample = [tuple(r) for r in drawn.select("node", "label", "dim", "vec", "radius").collect()]  # about AUDIT rows
    held: dict = {}
    for node, label, dim, vec, radius in sample:
        held.setdefault((label, dim), []).append((node, bytes(vec), radius))
    shared = nodes.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = {k: (np.array([x[0] for x in v]), _unit([x[1] for x in v]), np.array([x[2] for x in v])) for k, v in shared.value.items()}
        for batch in batches:
            names = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            node, radius, vec = batch.column(0).to_numpy(), batch.column(4).to_numpy(), batch.column(3).to_pylist()
            rows: dict = {}
            for at, name in enumerate(names):
                rows.setdefault(name, []).append(at)
            i, j, s = [], [], []
            for name, at in rows.items():
                if name in asked:
                    ids, x, r = asked[name]
                    sim = x @ _unit([vec[k] for k in at]).T
                    p, q = np.nonzero((_angle(sim) <= theta + r[:, None] + radius[at][None, :]) & (ids[:, None] != node[at][None, :]))
                    i.append(ids[p])
                    j.append(node[at][q])
                    s.append(sim[p, q])
            if i:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (i, j, s)], names=["i", "j", "s"])

    true = cut(nodes.select("node", "label", "dim", "vec", "radius").mapInArrow(run, "i long, j long, s double"))
    ways = lists.select("i", "j").unionByName(lists.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct()
    lacking = cut(true.join(ways, ["i", "j"], "left_anti"))
    size = nodes.select("node", F.col("size").cast("double").alias("size"))
    weight = F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0.0))
    weighed = lambda pairs: pairs.join(size.toDF("i", "x"), "i").join(size.toDF("j", "y"), "j").agg(weight).first()[0]
    lost = 0.0 if lacking.isEmpty() else weighed(lacking)
    return (1 - lost / weighed(true) if lost else 1.0), lacking


def neighbours(nodes: DataFrame, theta: float) -> tuple[DataFrame, float]:
    """(lists, recall): the refined lists (i, j, s, k) of nodes with radii, and the audited recall of near pairs."""
    lists, extra = _refine(cut(_top(_start(nodes, list(range(TABLES))))), nodes), None
    for turn in range(PASSES):
        while True:  # lists full of near pairs are enlarged, and their surroundings refined
            near = _near(lists, nodes, theta)
            ends = near.select(F.col("a").alias("i")).unionByName(near.select(F.col("b").alias("i"))).groupBy("i").agg(F.count("*").alias("links"))
            full = lists.groupBy("i").agg(F.count("*").alias("n"), F.max("k").alias("k")).where("n >= k").join(ends, "i").where("links >= k")
            full = cut(full.select("i"))
            if full.isEmpty():
                break
            lists = cut(lists.join(full.withColumn("full", F.lit(2)), "i", "left").withColumn("k", F.col("k") * F.coalesce("full", F.lit(1))).drop("full"))
            around = lists.join(full, "i", "left_semi").select(F.col("j").alias("v")).unionByName(full.select(F.col("i").alias("v"))).distinct()
            before = lists.count()
            lists = _refine(lists, nodes, cut(around))
            if lists.count() == before:  # nothing further lies near them
                break
        # what an audit has found stays beside the lists, however full they are
        held = lists if extra is None else lists.unionByName(extra)
        recall, lacking = _audit(held, nodes, theta, 100 + turn)
        lacking = lacking.select("i", "j", "s", F.lit(1 << 30).alias("k"))
        extra = lacking if extra is None else extra.unionByName(lacking)
        if recall >= RECALL:
            break
        if turn + 1 < PASSES:
            tables = TABLES << (turn + 1)
            more = _start(nodes, [1000 * (turn + 1) + t for t in range(tables)]).unionByName(lacking.withColumn("k", F.lit(2 * K)))
            lists = _refine(cut(_top(lists.unionByName(more.select("i", "j", "s", "k")))), nodes)
    if recall < LEAST_RECALL:  # all blocks against all of their label, which loses none
        return lists.unionByName(_all_near(nodes, theta)), 1.0
    return lists.unionByName(extra), recall


def _all_near(nodes: DataFrame, theta: float) -> DataFrame:
    """(i, j, s, k) of all pairs of cells of one label that may hold links. Labels are dealt by a hash into blocks of about
    BLOCK cells, and each pair of blocks is compared by itself: only near pairs come out."""
    n = nodes.groupBy("label", "dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = nodes.join(n, ["label", "dim"]).withColumn("part", F.pmod(F.xxhash64(F.lit("all"), "node"), F.col("parts")).cast("int"))
    rows = dealt.select("label", "dim", "part", "parts", "node", "radius", "vec")
    # each cell goes to the pairs of blocks that its own is one of
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least(q, F.col("part")).alias("p"), F.greatest(q, F.col("part")).alias("q")))
    told = rows.withColumn("pair", F.explode(pairs)).select("label", "dim", "pair.p", "pair.q", "part", "node", "radius", "vec")

    def near(block: pa.Table) -> pa.Table:
        node, radius, part = (block.column(c).to_numpy() for c in ("node", "radius", "part"))
        x = _unit(block.column("vec").to_pylist())
        p, q = block.column("p")[0].as_py(), block.column("q")[0].as_py()
        a, b = np.flatnonzero(part == p), np.flatnonzero(part == q)
        sim = x[a] @ x[b].T
        i, j = np.nonzero((_angle(sim) <= theta + radius[a][:, None] + radius[b][None, :] + EPS) & (node[a][:, None] != node[b][None, :]))
        return pa.table({"i": node[a][i], "j": node[b][j], "s": sim[i, j]})

    return told.groupBy("label", "dim", "p", "q").applyInArrow(near, "i long, j long, s double").withColumn("k", F.lit(1 << 30))


def _members_compared(pairs: DataFrame, members: DataFrame, nodes: DataFrame, pivots: DataFrame, cosine: float) -> DataFrame:
    """(a, b, node, links) of cell pairs whose radii don't tell: how many vectors of the other cell each node links.

    A cell's members are dealt by a hash into blocks of about BLOCK, so no task holds a whole cell."""
    asked = pairs.select(F.col("a").alias("pivot")).unionByName(pairs.select(F.col("b").alias("pivot"))).distinct()
    blocks = pivots.select(F.col("node").alias("pivot"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")).join(asked, "pivot", "left_semi")
    part = F.pmod(F.xxhash64(F.lit("part"), "node"), F.col("blocks"))
    own = members.join(blocks, "pivot").join(nodes.select("node", "vec", "m"), "node").withColumn("part", part)
    parts = own.groupBy("pivot", "part").agg(F.collect_list(F.struct("node", "m", "vec")).alias("own"))
    both = pairs.select("a", "b").join(parts.toDF("a", "pa", "xs"), "a").join(parts.toDF("b", "pb", "ys"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = lambda c, row=row, batch=batch: batch.column(c)[row].values
                x, y = one(2), one(3)
                hit = _unit(x.field(2).to_pylist()) @ _unit(y.field(2).to_pylist()).T >= cosine
                for own, other, marks in ((x, y, hit), (y, x, hit.T)):
                    links = marks @ other.field(1).to_numpy()
                    some = np.flatnonzero(links)
                    n = len(some)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column(0)[row].as_py()] * n, pa.int64()), pa.array([batch.column(1)[row].as_py()] * n, pa.int64()), pa.array(own.field(0).to_numpy()[some]), pa.array(links[some])],
                        names=["a", "b", "node", "links"],
                    )

    return both.select("a", "b", "xs", "ys").mapInArrow(run, "a long, b long, node long, links long")


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", *, cosine: float = 0.93) -> DataFrame:
    """(key, n_links, component_id, kept, recall) of every row of df.

    Rows link when their labels are equal and not null and their vectors' cosine, in double precision, is at least
    `cosine`; vectors of unequal length don't. A vector that is null, empty, all zeros, or holds a null or non-finite
    number, and a row without key or label, links with nothing and is its own component. Rows with equal vectors link
    with each other like any others; a row that repeats a key is a vertex of its own, whose vector decides. An empty
    table gives an empty one. Columns of df other than the three play no part. Arrays of doubles are
    compared as such, all others as single floats, both in double precision. recall is the audit's, weighed by pairs of vectors."""
    theta = math.acos(cosine)
    nodes = cut(valid(df, key, vector, label))
    pivots, members = cells(nodes, theta / 2 - EPS)
    lists, recall = neighbours(pivots, theta)
    near = cut(_near(lists, pivots, theta))
    exact = (F.col("ra") == 0) & (F.col("rb") == 0)
    sure = near.where((exact & (F.col("s") >= cosine)) | (~exact & (F.col("angle") + F.col("ra") + F.col("rb") <= theta - EPS)))
    open_ = near.where(~exact & (F.col("angle") + F.col("ra") + F.col("rb") > theta - EPS))
    compared = cut(_members_compared(open_, members, nodes, pivots, cosine))
    size = pivots.select("node", "size")
    whole = sure.select("a", F.col("b").alias("o")).unionByName(sure.select(F.col("b").alias("a"), F.col("a").alias("o")))
    of_cell = whole.join(size.toDF("o", "size"), "o").groupBy("a").agg(F.sum("size").alias("cell_links"))
    of_node = compared.groupBy("node").agg(F.sum("links").alias("node_links"))
    label_of = components(sure.select("a", "b").unionByName(compared.select("a", "b").distinct()))
    told = (
        members.join(size.toDF("pivot", "size"), "pivot")
        .join(of_cell.withColumnRenamed("a", "pivot"), "pivot", "left")
        .join(of_node, "node", "left")
        .join(label_of.toDF("pivot", "c"), "pivot", "left")
        .withColumn("c", F.coalesce("c", "pivot"))
    )
    told = cut(told.join(nodes.select("node", "label", "vec", "least", "m"), "node"))
    least = told.groupBy("c").agg(F.min("least").alias("component_id"))
    links = F.col("size") - 1 + F.coalesce("cell_links", F.lit(0)) + F.coalesce("node_links", F.lit(0))
    told = cut(told.join(least, "c").select(F.struct("label", "vec").alias("own"), "component_id", links.alias("n_links"), "m"))
    # each row finds its vector's node by the vector itself; vectors of many rows are sent to all tasks
    rows = cut(valid_rows(df, key, vector, label).select("key", F.when(F.col("vec").isNotNull(), F.struct("label", "vec")).alias("own")))
    linked = join_hot(rows.where("own is not null"), told, "own", "m", rows.count())
    out = linked.select("key", "n_links", "component_id").unionByName(rows.where("own is null").select("key"), allowMissingColumns=True)
    return out.select(
        F.col("key").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "key").alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("key"), F.lit(True)).alias("kept"),
        F.lit(float(recall)).alias("recall"),
    )


def valid_rows(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(key, label, vec) of every row; vec as in valid(), null where the row can't link. An array of doubles keeps its
    precision, any other is one of single floats; the first byte of vec tells which (8 or 4)."""
    double = df.schema[vector].dataType.simpleString() in ("array<double>", "array<bigint>", "array<int>")
    kind, arrow = (np.float64, pa.float64()) if double else (np.float32, pa.float32())
    width = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(3)
            length = given.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            x = given.flatten().cast(arrow).fill_null(np.nan).to_numpy(zero_copy_only=False) + kind(0)  # -0 is 0
            at = np.r_[0, np.cumsum(length)]
            within = lambda marks, at=at: np.diff(np.r_[0, np.cumsum(marks)][at])
            good = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool) & (within(~np.isfinite(x)) == 0) & (within(x != 0) > 0)
            starts = width * at + np.arange(len(at))  # each vector behind one byte
            raw = np.full(int(starts[-1]), width, np.uint8)
            raw[np.arange(width * len(x)) + np.repeat(np.arange(len(length)) + 1, width * length)] = x.view(np.uint8)
            held = [pa.py_buffer(np.packbits(good, bitorder="little")), pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(raw)]
            vec = pa.Array.from_buffers(pa.large_binary(), len(good), held).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), vec], names=["key", "label", "vec"])

    of_label = df.schema[label].dataType.simpleString()
    given = df.select(
        F.col(key).cast("long").alias("key"), F.col(label).alias("label"),
        (F.col(key).isNotNull() & F.col(label).isNotNull()).alias("ok"), F.col(vector).cast(f"array<{'double' if double else 'float'}>").alias("v"),
    )
    return given.mapInArrow(run, f"key long, label {of_label}, vec binary")
