"""The atlas tables (accounts, edges, terms) as views of the driver's star schema.

The view texts run unchanged in Spark, where {table} is a DataFrame, and in DuckDB, where it is a name. Ties and terms,
which grow with the line items, are the same rows from DataFrames in Spark: dealt by account, in parts that stay as small
however many there are."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Line items of one part: what a task holds of them stays the same at every size.
PART_ROWS = 400_000

TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()

ARTISTS = """
SELECT concat('customer:', c_custkey) AS urn, c_name AS permalink, n_name AS city_raw, r_name AS country,
  o.last_upload_at, coalesce(o.track_count, 0) AS track_count, CAST(floor(c_acctbal) AS BIGINT) + 1000 AS followers,
  coalesce(o.plays, 0) AS plays, coalesce(o.likes, 0) AS likes, coalesce(o.comments, 0) AS comments,
  CASE WHEN coalesce(o.track_count, 0) >= 18 THEN 'hub' ELSE 'artist' END AS account_kind, c_mktsegment AS segment
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_upload_at, count(*) AS track_count,
    CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS plays,
    count(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END) AS likes, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS comments
  FROM {orders} GROUP BY o_custkey) o ON o_custkey = c_custkey
UNION ALL
SELECT concat('supplier:', s_suppkey), s_name, n_name, r_name, NULL, 0, CAST(floor(s_acctbal) AS BIGINT) + 1000, 0, 0, 0, 'artist', NULL
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""

EDGES = """
SELECT CASE e.kind WHEN 3 THEN concat('supplier:', supp) ELSE concat('customer:', cust) END AS src,
  CASE e.kind WHEN 3 THEN concat('customer:', cust) ELSE concat('supplier:', supp) END AS dst,
  CASE e.kind WHEN 1 THEN 'repost' ELSE 'follow' END AS type, CAST(CASE e.kind WHEN 1 THEN n ELSE 1 END AS DOUBLE) AS weight
FROM (SELECT o_custkey AS cust, l_suppkey AS supp, count(*) AS n, count(CASE WHEN l_quantity >= 40 THEN 1 END) AS large, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS returned
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey) p
CROSS JOIN (SELECT 1 AS kind UNION ALL SELECT 2 UNION ALL SELECT 3) e
WHERE e.kind = 1 OR (e.kind = 2 AND large > 0) OR (e.kind = 3 AND returned > 0)
"""

TERMS = """
SELECT concat('customer:', o_custkey) AS urn, CASE WHEN grouping(p_type) = 1 THEN p_brand ELSE p_type END AS term,
  CASE WHEN grouping(p_type) = 1 THEN 'genre' ELSE 'tag' END AS kind, count(*) AS evidence
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey GROUP BY GROUPING SETS ((o_custkey, p_brand), (o_custkey, p_type))
"""

VIEWS = {"artists": ARTISTS, "edges": EDGES, "terms": TERMS}


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A text's result, its {tables} read from sf_dir."""
    used = [t for t in TABLES if "{" + t + "}" in text]
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in ("edges", "terms"):
        return (_edges if name == "edges" else _terms)(*_tables(spark, sf_dir))
    return run(spark, sf_dir, VIEWS[name])


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Line items, orders and parts, and in how many parts the line items are dealt."""
    lines, orders, part = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders", "part"))
    return lines, orders, part, parts(lines)


def parts(lines: DataFrame) -> int:
    return max(lines.sparkSession.sparkContext.defaultParallelism, -(-lines.count() // PART_ROWS))


def ordered(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Line items with their orders. The hints save the sorting of the larger side."""
    return lines.join(orders.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))


def _edges(lines: DataFrame, orders: DataFrame, part: DataFrame, n: int) -> DataFrame:
    own = ordered(lines, orders).select("o_custkey", "l_suppkey", "l_quantity", "l_returnflag").repartition(n, "o_custkey")
    pairs = own.groupBy("o_custkey", "l_suppkey").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_quantity") >= 40).alias("large"), F.count_if(F.col("l_returnflag") == "R").alias("returned")
    )
    customer, supplier = F.concat(F.lit("customer:"), "o_custkey"), F.concat(F.lit("supplier:"), "l_suppkey")
    way = lambda src, dst, kind, weight: F.struct(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), weight.cast("double").alias("weight"))
    ways = F.array(
        way(customer, supplier, "repost", F.col("n")), F.when(F.col("large") > 0, way(customer, supplier, "follow", F.lit(1))), F.when(F.col("returned") > 0, way(supplier, customer, "follow", F.lit(1)))
    )
    return pairs.select(F.inline(F.array_compact(ways)))


def _terms(lines: DataFrame, orders: DataFrame, part: DataFrame, n: int) -> DataFrame:
    told = ordered(lines, orders).join(part.hint("shuffle_hash"), F.col("l_partkey") == F.col("p_partkey"))
    said = told.select(F.concat(F.lit("customer:"), "o_custkey").alias("urn"), "p_brand", "p_type").repartition(n, "urn")
    one = lambda term, kind: F.struct(F.col(term).alias("term"), F.lit(kind).alias("kind"))
    return said.select("urn", F.inline(F.array(one("p_brand", "genre"), one("p_type", "tag")))).groupBy("urn", "term", "kind").agg(F.count("*").alias("evidence"))


def oracle(body: str) -> str:
    """SQL for DuckDB whose body names the views: those that it uses stand before it."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", body)]
    head = ", ".join(f"{v} AS ({re.sub(r'[{](\w+)[}]', r'\1', VIEWS[v])})" for v in used)
    body = body.strip()
    if not head:
        return body
    recursive = body.upper().startswith("WITH RECURSIVE")
    rest = re.sub(r"(?i)^with( recursive)?\s", ", ", body) if body.upper().startswith("WITH") else f" {body}"
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}{rest}"
