"""Every named query of the atlas engine with its SQL. A query's name starts with its row of the operator inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenewright.functions import text as T
from scenewright.operators import cache, extract, merge, rollup, scenes, search, weights
from scenewright.sources import atlas

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The instant that the recency queries count from.
NOW = "1998-08-01 00:00:00"


def query(sql: str | None = None):
    """Register a function by its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = atlas.oracle(sql)
        return f

    return add


def same_sql(name: str, sql: str, duck: str | None = None) -> None:
    """Register a query whose SQL is the same for both engines; {views} stand for the atlas tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = {v: atlas.view(spark, sf_dir, v) for v in atlas.VIEWS if "{" + v + "}" in sql}
        tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in atlas.TABLES if "{" + t + "}" in sql}
        return spark.sql(sql, **used, **tables)

    QUERIES[name] = run
    ORACLES[name] = atlas.oracle((duck or sql).replace("{", "").replace("}", ""))


v = atlas.view
six = lambda x: T.rounded(x, 6)  # noqa: E731  doubles are compared at six digits

# --- ties -------------------------------------------------------------------------------------------------------------

PAIRS = """p AS (SELECT src, dst, bool_or(type = 'follow') AS follow, coalesce(sum(CASE WHEN type = 'repost' THEN weight END), 0.0) AS reposts
  FROM edges GROUP BY src, dst)"""
FACTOR = "h AS (SELECT src, count(*) AS targets, least(1.0, CAST(40 AS DOUBLE) / count(*)) AS factor FROM p WHERE reposts > 0 GROUP BY src)"
STRENGTH = """s AS (SELECT p.src, dst, (CASE WHEN follow THEN 1.0 ELSE 0.0 END) + coalesce(factor, 1.0) * log2(1 + reposts) AS strength
  FROM p LEFT JOIN h ON p.src = h.src WHERE p.src <> dst)"""


@query(f"WITH {PAIRS} SELECT * FROM p")
def a1_directed_pairs(spark, d):
    return weights.directed_pairs(v(spark, d, "edges"))


@query(f"WITH {PAIRS}, {FACTOR} SELECT src, targets, floor(factor * 1e6 + 0.5) / 1e6 AS factor FROM h")
def g1_repost_hub_factor(spark, d):
    return weights.hub_factor(weights.directed_pairs(v(spark, d, "edges"))).withColumn("factor", six(F.col("factor")))


@query(f"WITH {PAIRS}, {FACTOR}, {STRENGTH} SELECT src, dst, floor(strength * 1e6 + 0.5) / 1e6 AS strength FROM s WHERE strength > 0")
def g2_directed_strength(spark, d):
    return weights.strengths(weights.directed_pairs(v(spark, d, "edges"))).withColumn("strength", six(F.col("strength")))


@query(
    f"""WITH {PAIRS}, {FACTOR}, {STRENGTH}, b AS (SELECT least(src, dst) AS u, greatest(src, dst) AS v,
    sum(CASE WHEN src < dst THEN strength ELSE 0.0 END) AS f, sum(CASE WHEN src > dst THEN strength ELSE 0.0 END) AS r
    FROM s WHERE strength > 0 GROUP BY 1, 2)
    SELECT u, v, floor((f + r + least(f, r)) * 1e6 + 0.5) / 1e6 AS weight FROM b"""
)
def g3_symmetric_edges(spark, d):
    return weights.symmetric(weights.strengths(weights.directed_pairs(v(spark, d, "edges")))).withColumn("weight", six(F.col("weight")))


@query(
    """WITH w AS (SELECT src AS urn, dst AS other, type, weight FROM edges UNION ALL SELECT dst, src, type, weight FROM edges WHERE src <> dst),
    t AS (SELECT urn, other, sum(weight) AS weight, string_agg(DISTINCT type || 's', ' · ' ORDER BY type || 's') AS types FROM w GROUP BY urn, other),
    r AS (SELECT *, row_number() OVER (PARTITION BY urn ORDER BY weight DESC, other) AS rank FROM t)
    SELECT urn, other, weight, types, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5"""
)
def a7_strongest_connections(spark, d):
    return weights.strongest_connections(v(spark, d, "edges")).select("urn", "other", "weight", "types", "rank")


# --- genres and places ------------------------------------------------------------------------------------------------

FOLD = "regexp_replace(lower(strip_accents({})), '[^a-z0-9]', '', 'g')"
MEMBERS = f"""m AS (SELECT urn, fold, CAST(sum(evidence) AS BIGINT) AS evidence FROM (SELECT urn, {FOLD.format('term')} AS fold, evidence FROM terms
  WHERE kind = 'genre' OR evidence >= 2) WHERE fold <> '' AND NOT regexp_matches(fold, '^[0-9]+$')
  AND fold NOT IN ({', '.join(f"'{x}'" for x in rollup.FORMAT_TERMS)}) GROUP BY urn, fold)"""
CITY = f"c AS (SELECT urn, {FOLD.format('city_raw')} AS city, country FROM artists)"


@query(f"WITH {MEMBERS} SELECT fold, count(*) AS artist_count FROM m GROUP BY fold HAVING count(*) >= 2")
def ag2_genres(spark, d):
    return rollup.genres(v(spark, d, "terms")).select("fold", "artist_count")


@query(f"WITH {MEMBERS} SELECT fold AS term, count(*) AS artists FROM m GROUP BY fold HAVING count(*) < 1030")
def ag2_below_threshold(spark, d):
    return rollup.below_threshold(v(spark, d, "terms"), rollup.Config(min_genre_artists=1030))


@query(f"WITH {MEMBERS} SELECT * FROM m")
def ag4_memberships(spark, d):
    return rollup.memberships(v(spark, d, "terms"))


@query(f"WITH {CITY} SELECT city, min(country) AS country, count(*) AS artist_count FROM c GROUP BY city HAVING count(*) >= 2")
def ag7_cities(spark, d):
    return rollup.cities(v(spark, d, "artists")).select("city", "country", "artist_count")


@query(f"WITH {MEMBERS}, {CITY} SELECT fold, city, count(DISTINCT m.urn) AS artist_count FROM m JOIN c ON m.urn = c.urn GROUP BY fold, city")
def ag12_cross_tab(spark, d):
    return rollup.cross_tab(v(spark, d, "terms"), v(spark, d, "artists"))


@query(
    f"""WITH {MEMBERS}, n AS (SELECT fold, count(*) AS n FROM m GROUP BY fold),
    s AS (SELECT a.fold, b.fold AS other, count(*) AS shared FROM m a JOIN m b ON a.urn = b.urn AND a.fold <> b.fold GROUP BY 1, 2)
    SELECT s.fold, other, shared, floor(CAST(shared AS DOUBLE) / (x.n + y.n - shared) * 1e6 + 0.5) / 1e6 AS affinity
    FROM s JOIN n x ON x.fold = s.fold JOIN n y ON y.fold = other"""
)
def ag13_related_genres(spark, d):
    return rollup.related(v(spark, d, "terms")).withColumn("affinity", six(F.col("affinity")))


@query(
    f"""WITH {MEMBERS}, {CITY}, t AS (SELECT fold, city, count(DISTINCT m.urn) AS artist_count FROM m JOIN c ON m.urn = c.urn GROUP BY fold, city)
    SELECT fold, city, artist_count FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY artist_count DESC, city) AS place FROM t) WHERE place = 1"""
)
def ag14_top_city(spark, d):
    return rollup.top_city(v(spark, d, "terms"), v(spark, d, "artists"))


@query(
    f"""WITH {MEMBERS}, t AS (SELECT *, row_number() OVER (PARTITION BY urn ORDER BY evidence DESC, fold) AS place FROM m),
    r AS (SELECT fold, t.urn, followers, likes + comments AS impact, plays, row_number() OVER (PARTITION BY fold
      ORDER BY followers DESC, likes + comments DESC, plays DESC, t.urn) AS rank FROM t JOIN artists a ON a.urn = t.urn WHERE place <= 2)
    SELECT fold, CAST(rank AS INTEGER) AS rank, urn, followers, impact, plays FROM r WHERE rank <= 12"""
)
def ag9_roster(spark, d):
    return rollup.roster(v(spark, d, "terms"), v(spark, d, "artists"))


@query(
    f"""WITH {MEMBERS}, f AS (SELECT urn, last_upload_at FROM artists WHERE last_upload_at > TIMESTAMP '{NOW}' - INTERVAL 7 DAY)
    SELECT fold, count(CASE WHEN last_upload_at > TIMESTAMP '{NOW}' - INTERVAL 1 DAY THEN 1 END) AS day, count(*) AS week
    FROM m JOIN f ON f.urn = m.urn GROUP BY fold"""
)
def a4_activity(spark, d):
    return rollup.activity(rollup.memberships(v(spark, d, "terms")), v(spark, d, "artists"), "fold", F.lit(NOW).cast("timestamp"))


@query(f"WITH {MEMBERS} SELECT urn, fold, CAST(place AS INTEGER) AS place FROM (SELECT urn, fold, row_number() OVER (PARTITION BY urn ORDER BY evidence DESC, fold) AS place FROM m) WHERE place <= 3")
def w1_top_terms_per_artist(spark, d):
    order = Window.partitionBy("urn").orderBy(F.desc("evidence"), "fold")
    return rollup.memberships(v(spark, d, "terms")).select("urn", "fold", F.row_number().over(order).alias("place")).where("place <= 3")


# --- browse -----------------------------------------------------------------------------------------------------------

same_sql(
    "q5_sound_in_place",
    """SELECT a.urn, a.followers, a.account_kind FROM {terms} t JOIN {artists} a ON a.urn = t.urn
    WHERE t.term = 'Brand#17' AND t.kind = 'genre' AND a.city_raw = 'NATION_3' ORDER BY a.followers DESC, a.likes + a.comments DESC, a.plays DESC, a.urn LIMIT 24""",
)


@query("WITH f AS (SELECT DISTINCT src, dst FROM edges WHERE type = 'follow') SELECT a.src, a.dst FROM f a JOIN f b ON b.src = a.dst AND b.dst = a.src")
def j12_mutual_follows(spark, d):
    return weights.mutual(v(spark, d, "edges"))


same_sql("a22_metric_summary", "SELECT event_type, count(*) AS n, floor(avg(value) * 1e4 + 0.5) / 1e4 AS mean, min(value) AS low, max(value) AS high FROM {events} GROUP BY event_type")
same_sql("st7_slow_metrics", """SELECT event_id, value > 50 AS slow FROM (SELECT event_id, value FROM {events} ORDER BY ts DESC, event_id DESC LIMIT 500) x""")
same_sql("p7_crawled_predicate", "SELECT urn, CASE WHEN last_upload_at IS NOT NULL THEN 1 ELSE 0 END AS crawled FROM {artists}")
# --- functions --------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {FOLD.format('text')} AS fold, regexp_replace(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM documents")
def f1_fold_and_slug(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", T.fold_term(F.col("text")).alias("fold"), T.slugify(F.col("text")).alias("slug"))


@query("""SELECT o_orderkey, CASE WHEN s >= 3600 THEN s // 3600 || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0')
    ELSE s // 60 || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') END AS length FROM (SELECT o_orderkey, CAST(floor(o_totalprice * 100) AS BIGINT) // 1000 AS s FROM orders)""")
def f7_format_duration(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", T.format_duration(F.floor(F.col("o_totalprice") * 100).cast("long")).alias("length"))


@query(f"""SELECT o_orderkey, CASE WHEN n < 1 THEN 'today' WHEN n < 2 THEN 'yesterday' WHEN n < 7 THEN n || ' days ago' WHEN n < 14 THEN 'last week'
    WHEN n < 30 THEN n // 7 || ' weeks ago' WHEN n < 60 THEN 'last month' WHEN n < 365 THEN n // 30 || ' months ago' WHEN n < 730 THEN 'last year' ELSE n // 365 || ' years ago' END AS said
    FROM (SELECT o_orderkey, CAST(floor((epoch(TIMESTAMP '{NOW}') - epoch(o_orderdate)) / 86400) AS BIGINT) AS n FROM orders)""")
def f8_relative_time(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", T.relative_time(F.col("o_orderdate"), F.lit(NOW).cast("timestamp")).alias("said"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def f15_json_field(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.get_json_object("props", "$.k").alias("k"))


# --- merges, cache, search, scenes ------------------------------------------------------------------------------------


@query("SELECT user_id AS src, user_id % 7 AS dst, event_type AS type, max(value) AS weight, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY ALL")
def u5_merge_edges(spark, d):
    seen = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("src"), (F.col("user_id") % 7).alias("dst"), F.col("event_type").alias("type"), F.col("value").alias("weight"), F.col("ts").alias("seen"))
    return merge.merge_edges(seen)


@query("SELECT user_id AS urn, event_type AS term, 'tag' AS kind, max(CAST(floor(value) AS BIGINT)) AS evidence, max(ts) AS last_seen FROM events GROUP BY ALL")
def u6_merge_terms(spark, d):
    seen = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("urn"), F.col("event_type").alias("term"), F.lit("tag").alias("kind"), F.floor("value").cast("long").alias("evidence"), F.col("ts").alias("seen"))
    return merge.merge_terms(seen)


@query("""SELECT key, updated_at, created_at, CASE WHEN updated_at + 86400000 > 1706000000000 THEN 'fresh' WHEN updated_at + 864000000 > 1706000000000 THEN 'stale' ELSE 'miss' END AS state
    FROM (SELECT user_id || ':' || event_type AS key, max(epoch_us(ts) // 1000) AS updated_at, min(epoch_us(ts) // 1000) AS created_at FROM events GROUP BY 1)""")
def c4_swr_classification(spark, d):
    sets = spark.read.parquet(f"{d}/events.parquet").select(
        F.concat_ws(":", "user_id", "event_type").alias("key"), F.lit("{}").alias("value"), F.col("event_type").alias("type"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.lit(86_400_000).alias("ttl")
    )
    return cache.latest(sets, stale_ms=777_600_000).select("key", "updated_at", "created_at", cache.state(1_706_000_000_000).alias("state"))


@query("SELECT event_type AS type, count(CASE WHEN value > 20 THEN 1 END) AS hits, count(CASE WHEN NOT value > 20 THEN 1 END) AS misses, max(ts) AS last_access FROM events GROUP BY event_type")
def a23_cache_stats(spark, d):
    return cache.stats(spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("type"), (F.col("value") > 20).alias("hit"), F.col("ts").alias("at")))


@query("""SELECT p_partkey, p_name FROM (SELECT p_partkey, p_name, starts_with(lower(p_name), 're') AS prefix FROM part WHERE contains(lower(p_name), 're'))
    ORDER BY prefix DESC, p_partkey LIMIT 4""")
def r5_quick_jumps(spark, d):
    names = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"))
    return search.quick_jumps(names, "re").select("p_partkey", F.col("name").alias("p_name"))


@query("""SELECT urn, floor((CASE WHEN starts_with(t, 'customer#1') THEN 100 ELSE 0 END + CASE WHEN contains(t, 'customer#1') THEN 50 ELSE 0 END
    + 30 * CAST(greatest(length(t), 10) - levenshtein(t, 'customer#1') AS DOUBLE) / greatest(length(t), 10) + 5 * log10(followers + 1) + 2 * log10(likes + 1) + 2 * log10(plays + 1)
    + 30 * CAST(greatest(length(c), 10) - levenshtein(c, 'customer#1') AS DOUBLE) / greatest(length(c), 10)) * 1e6 + 0.5) / 1e6 AS score
    FROM (SELECT *, lower(permalink) AS t, lower(city_raw) AS c FROM artists)""")
def r2_relevance(spark, d):
    a = v(spark, d, "artists")
    score = search.relevance("customer#1", F.col("permalink"), F.col("city_raw"), F.col("followers"), F.col("likes"), F.col("plays"))
    return a.select("urn", six(score).alias("score"))


@query("""WITH t AS (SELECT l_partkey AS track, l_suppkey AS artist_rank, min(l_linenumber) AS position FROM lineitem GROUP BY 1, 2),
    u AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY artist_rank, position) AS place FROM t),
    r AS (SELECT track, artist_rank, position, row_number() OVER (PARTITION BY artist_rank ORDER BY position, track) AS round FROM u WHERE place = 1)
    SELECT track, artist_rank, position, CAST(round AS INTEGER) AS round FROM r WHERE round <= 4 ORDER BY round, artist_rank, track LIMIT 40""")
def w4_interleaved_queue(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_partkey").alias("track"), F.col("l_suppkey").alias("artist_rank")).agg(F.min("l_linenumber").alias("position"))
    return search.interleaved(t)


SCENE_DOCS = "d AS (SELECT a.segment AS scene, t.term, CAST(sum(t.evidence) AS DOUBLE) AS weight FROM terms t JOIN artists a ON a.urn = t.urn WHERE a.segment IS NOT NULL GROUP BY 1, 2)"


def scene_docs(spark, d):
    a = v(spark, d, "artists").where("segment is not null").select("urn", "segment")
    return v(spark, d, "terms").join(a, "urn").groupBy(F.col("segment").alias("scene"), "term").agg(F.sum("evidence").cast("double").alias("weight"))


@query(f"""WITH {SCENE_DOCS}, n AS (SELECT count(DISTINCT scene) AS scenes FROM d),
    f AS (SELECT term, count(*) AS df, sum(weight) AS total FROM d GROUP BY term), k AS (SELECT d.*, total, scenes FROM d JOIN f ON d.term = f.term, n WHERE df >= 1 AND df <= greatest(1.0, 1.0 * scenes)),
    t AS (SELECT scene, sum(weight) AS doc FROM k GROUP BY scene), g AS (SELECT sum(weight) / max(scenes) AS average FROM k)
    SELECT k.scene, term, weight, floor(weight / doc * ln(1 + average / total) * 1e6 + 0.5) / 1e6 AS score FROM k JOIN t ON t.scene = k.scene, g""")
def n2_term_scores(spark, d):
    return scenes.term_scores(scene_docs(spark, d), min_docs=1, max_share=1.0).withColumn("score", six(F.col("score")))


@query(f"WITH {SCENE_DOCS} SELECT term, scene FROM (SELECT term, scene, row_number() OVER (PARTITION BY term ORDER BY weight DESC, scene) AS place FROM d) WHERE place = 1")
def n3_naming_rights(spark, d):
    return scenes.naming_rights(scene_docs(spark, d).withColumnRenamed("weight", "support"))


@query(f"""WITH {PAIRS}, {FACTOR}, {STRENGTH}, l AS (SELECT urn, country FROM artists)
    SELECT x.country AS community, dst AS node, floor(sum(strength) * 1e3 + 0.5) / 1e3 AS degree FROM s JOIN l x ON x.urn = src JOIN l y ON y.urn = dst
    WHERE strength > 0 AND x.country = y.country GROUP BY 1, 2""")
def a9_in_scene_degree(spark, d):
    labels = v(spark, d, "artists").select(F.col("urn").alias("node"), F.col("country").alias("community"))
    got = scenes.in_scene_degree(weights.strengths(weights.directed_pairs(v(spark, d, "edges"))), labels)
    return got.withColumn("degree", T.rounded(F.col("degree"), 3))


@query("""WITH s AS (SELECT n_nationkey AS community, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
    SELECT count(*) AS count, CAST(max(n) AS DOUBLE) / sum(n) AS largest, (SELECT coalesce(quantile_cont(n, 0.5), 0.0) FROM s WHERE n >= 20) AS median FROM s""")
def a16_partition_stats(spark, d):
    return scenes.partition_stats(spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_nationkey").alias("community")))


@query("""WITH c AS (SELECT c_nationkey AS cluster, c_custkey AS member FROM customer), p AS (SELECT c_nationkey + 100 AS id, c_custkey AS member FROM customer WHERE c_acctbal > 1000)
    SELECT cluster, CAST(cluster + 100 AS BIGINT) AS id FROM (SELECT DISTINCT cluster FROM c)""")
def g13_stable_ids(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    return scenes.stable_ids(
        c.select(F.col("c_nationkey").alias("cluster"), F.col("c_custkey").alias("member")),
        c.where("c_acctbal > 1000").select((F.col("c_nationkey") + 100).cast("long").alias("id"), F.col("c_custkey").alias("member")),
    )


@query()
def g6_louvain_nations(spark, d):
    """Communities of the nations' trade graph; checked by invariants."""
    told = atlas.run(spark, d, """SELECT CAST(c_nationkey AS BIGINT) AS u, CAST(s_nationkey AS BIGINT) AS v, CAST(count(*) AS DOUBLE) AS weight
      FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON c_custkey = o_custkey JOIN {supplier} ON s_suppkey = l_suppkey GROUP BY 1, 2""")
    return scenes.louvain(told)


# --- extraction and hubs ----------------------------------------------------------------------------------------------

TRACKS = "{lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey"


def tracks(spark, d):
    """Line items as tracks of their customers."""
    return atlas.run(spark, d, f"""SELECT concat('user:', o_custkey) AS urn, p_type AS genre, concat(p_brand, ' "', p_name, '"') AS tag_list,
      CAST(l_quantity AS BIGINT) AS playback_count, CASE WHEN l_returnflag = 'R' THEN NULL ELSE CAST(l_linenumber AS BIGINT) END AS likes_count,
      CAST(1 AS BIGINT) AS comment_count, date_format(l_shipdate, "yyyy/MM/dd HH:mm:ss '+0000'") AS created_at FROM {TRACKS}""")


@query("""SELECT 'user:' || o_custkey AS src, 'user:' || l_suppkey AS dst, 'repost' AS type, CAST(count(*) AS DOUBLE) AS weight
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey <> l_suppkey AND l_suppkey <> 0 GROUP BY 1, 2""")
def u17_repost_edges(spark, d):
    return extract.repost_edges(atlas.run(spark, d, "SELECT concat('user:', o_custkey) AS src, l_suppkey AS owner FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"))


@query("""SELECT 'user:' || user_id AS src, 'user:' || (user_id + event_id % 3) AS dst, 'follow' AS type, CAST(1.0 AS DOUBLE) AS weight FROM events WHERE event_id % 3 <> 0 AND user_id + event_id % 3 <> 0""")
def u16_follow_edges(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return extract.follow_edges(e.select(F.concat(F.lit("user:"), "user_id").alias("src"), (F.col("user_id") + F.col("event_id") % 3).alias("id")))


@query("""WITH t AS (SELECT 'user:' || o_custkey AS urn, lower(p_type) AS genre, lower(p_brand) AS brand, lower(p_name) AS name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)
    SELECT urn, term, kind, count(*) AS evidence FROM (SELECT urn, genre AS term, 'genre' AS kind FROM t UNION ALL SELECT urn, brand, 'tag' FROM t UNION ALL SELECT urn, name, 'tag' FROM t) GROUP BY ALL""")
def u18_track_terms(spark, d):
    return extract.track_terms(tracks(spark, d))


@query("""SELECT 'user:' || o_custkey AS urn, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS plays, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_linenumber END) AS BIGINT) AS likes, count(*) AS comments,
    CAST(date_trunc('second', max(l_shipdate)) AS VARCHAR) AS last_upload_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def u21_engagement(spark, d):
    return extract.engagement(tracks(spark, d)).withColumn("last_upload_at", F.date_format("last_upload_at", "yyyy-MM-dd HH:mm:ss"))


@query("""WITH RECURSIVE a AS (SELECT c_nationkey AS s, s_nationkey AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2),
    r AS (SELECT 3 AS n, 0 AS depth UNION SELECT t, depth + 1 FROM r JOIN a ON s = n WHERE depth < 3)
    SELECT CAST(n AS VARCHAR) AS urn, min(depth) AS depth FROM r GROUP BY n""")
def u23_bounded_crawl(spark, d):
    ways = atlas.run(spark, d, """SELECT CAST(c_nationkey AS STRING) AS src, CAST(s_nationkey AS STRING) AS dst FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
      JOIN {customer} ON c_custkey = o_custkey JOIN {supplier} ON s_suppkey = l_suppkey GROUP BY 1, 2""")
    all_ = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("urn"), F.lit(1).alias("track_count"))
    return extract.crawl(ways, all_, ["3"], 3)


# --- more browse and read-side queries --------------------------------------------------------------------------------

same_sql("w8_display_rank", "SELECT urn, lpad(CAST(row_number() OVER (ORDER BY followers DESC, urn) AS STRING), 2, '0') AS place FROM (SELECT urn, followers FROM {artists} ORDER BY followers DESC, urn LIMIT 24) x", "SELECT urn, lpad(CAST(row_number() OVER (ORDER BY followers DESC, urn) AS VARCHAR), 2, '0') AS place FROM (SELECT urn, followers FROM {artists} ORDER BY followers DESC, urn LIMIT 24) x")

def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From typed edges to symmetric weighted ties."""
    return g3_symmetric_edges(spark, sf_dir)
