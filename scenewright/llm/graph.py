"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenewright.llm.common import cut, drop_cut, join_hot

def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links (a, b): the smallest node that links reach.

    Each round links the neighbours of every node to the smallest of them (first those above the node, then those
    below it), which keeps the components and flattens them into stars; it ends when a round changes nothing. A star's
    centre with many leaves is one minimum over its rows, never a list, and its rows are never shuffled to one task. Links of a node to itself name the node. No
    links give no rows; a null end is no node."""
    links = links.where("a is not null and b is not null")
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    now = cut(both.where("a > b"))  # each link from the larger node to the smaller
    alone = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    last, rows = None, now.count()
    while rows:
        ways = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = cut(join_hot(ways, least, "a", "n", 2 * rows).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b"))
        small = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        stars = small.select("a", F.col("m").alias("b"))
        small = join_hot(large, small, "a", "n", rows).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        after = cut(small.unionByName(stars).distinct())
        said = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_cut(now)
        now, rows = after, said[0]
        if tuple(said) == last:
            break
        last = tuple(said)
    out = alone.join(now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")), "node", "left")
    return out.select("node", F.coalesce("component", "node").alias("component"))
