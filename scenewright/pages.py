"""Named queries of profiles, queues, rosters and scene naming, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenewright.catalog import CITY, FOLD, MEMBERS, query, v
from scenewright.operators import rollup, tracks
from scenewright.operators.browse import first
from scenewright.sources import atlas, files

table = lambda spark, d, name: spark.read.parquet(f"{d}/{name}.parquet")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10 AND l_suppkey % 5 <> l_partkey % 5")
def p5_own_tracks_stripped(spark, d):
    t = table(spark, d, "lineitem").withColumns({"owner": F.col("l_suppkey") % 5, "profile": F.col("l_partkey") % 5})
    return t.where("l_quantity > 10 and owner != profile").select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey, lower(p_brand) IN ('brand#12', 'brand#34') OR list_has_any(string_split(p_type, ' '), ['STEEL', 'TIN']) AS matched FROM part")
def p10_vocabulary(spark, d):
    folds = F.array(*[F.lit(x) for x in ("brand12", "brand34", "steel", "tin")])
    return table(spark, d, "part").select("p_partkey", tracks.in_vocabulary(F.col("p_brand"), F.split("p_type", " "), folds).alias("matched"))


@query("""WITH t AS (SELECT l_suppkey AS urn, l_orderkey * 10 + l_linenumber AS track, l_shipdate AS day, p_type LIKE '%STEEL' AS hit FROM lineitem JOIN part ON p_partkey = l_partkey),
    x AS (SELECT *, bool_or(hit) OVER (PARTITION BY urn) AS anyhit FROM t), r AS (SELECT urn, track, CAST(row_number() OVER (PARTITION BY urn ORDER BY day, track) AS INTEGER) AS place FROM x WHERE hit OR NOT anyhit)
    SELECT urn, place, track FROM r WHERE place <= 30""")
def q14_artist_queue(spark, d):
    hit = tracks.in_vocabulary(F.lit(None).cast("string"), F.split("p_type", " "), F.array(F.lit("steel")))
    lines, part = table(spark, d, "lineitem"), table(spark, d, "part").select("p_partkey", hit.alias("hit"))
    t = lines.join(part.hint("shuffle_hash"), F.expr("p_partkey = l_partkey")).selectExpr("l_suppkey AS urn", "l_orderkey * 10 + l_linenumber AS track", "l_shipdate AS at", "hit")
    return tracks.artist_queue(t.repartition(atlas.parts(lines), "urn"), F.col("hit"))


@query("""WITH i AS (SELECT o_custkey AS urn, CASE o_orderkey % 3 WHEN 0 THEN 'track' WHEN 1 THEN 'playlist' ELSE 'album' END AS kind, o_orderkey % 2 AS likes, o_orderkey % 7 AS reposts, o_orderkey % 5 AS comments FROM orders),
    s AS (SELECT urn, sum(likes) AS likes, sum(reposts) AS reposts, coalesce(sum(CASE WHEN kind = 'track' THEN comments END), 0) AS comments FROM i GROUP BY urn)
    SELECT urn, label, CAST(value AS BIGINT) AS value FROM (SELECT urn, 'likes' AS label, likes AS value FROM s UNION ALL SELECT urn, 'reposts', reposts FROM s UNION ALL SELECT urn, 'comments', comments FROM s) u WHERE value > 0""")
def a20_stat_totals(spark, d):
    i = table(spark, d, "orders").selectExpr("o_custkey AS urn", "element_at(array('track', 'playlist', 'album'), CAST(o_orderkey % 3 + 1 AS INT)) AS kind", "o_orderkey % 2 AS likes", "o_orderkey % 7 AS reposts", "o_orderkey % 5 AS comments")
    return tracks.stat_totals(i).select("urn", "label", F.col("value").cast("long").alias("value"))


@query("""SELECT urn, CASE WHEN plays % 3 = 0 AND track_count > 0 THEN coalesce(s, 0) WHEN plays % 3 = 0 THEN 0 ELSE plays END AS plays FROM artists
    LEFT JOIN (SELECT 'customer:' || o_custkey AS u, CAST(sum(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE 0 END) AS BIGINT) AS s FROM orders GROUP BY o_custkey) t ON u = urn""")
def a24_roster_plays(spark, d):
    r = v(spark, d, "artists").withColumn("plays", F.when(F.col("plays") % 3 == 0, 0).otherwise(F.col("plays")))
    t = table(spark, d, "orders").selectExpr("concat('customer:', o_custkey) AS urn", "if(o_orderkey % 2 = 0, o_orderkey, NULL) AS plays")
    return tracks.with_plays(r, t).select("urn", F.col("plays").cast("long").alias("plays"))


@query(f"""WITH {MEMBERS}, h AS (SELECT fold, a.urn, row_number() OVER (PARTITION BY fold ORDER BY followers DESC, likes + comments DESC, plays DESC, a.urn) AS place FROM m JOIN artists a ON a.urn = m.urn WHERE account_kind = 'hub')
    SELECT fold, count(*) AS hub_count, string_agg(CASE WHEN place <= 12 THEN urn END, ',' ORDER BY place) AS hub_roster FROM h GROUP BY fold""")
def ag17_hub_split(spark, d):
    told = tracks.hub_split(rollup.memberships(v(spark, d, "terms")).select("fold", "urn"), v(spark, d, "artists"), "fold")
    return told.select("fold", "hub_count", F.array_join("hub_roster", ",").alias("hub_roster"))


@query(f"""WITH {MEMBERS}, {CITY}, g AS (SELECT fold, count(*) AS n FROM m GROUP BY fold), k AS (SELECT city, count(*) AS n FROM c WHERE city <> '' GROUP BY city)
    SELECT 'genres' AS line, count(CASE WHEN n >= 2 THEN 1 END) AS n FROM g UNION ALL SELECT 'genre memberships', CAST(coalesce(sum(CASE WHEN n >= 2 THEN n END), 0) AS BIGINT) FROM g
    UNION ALL SELECT 'cities', count(CASE WHEN n >= 2 THEN 1 END) FROM k UNION ALL SELECT 'city memberships', CAST(coalesce(sum(CASE WHEN n >= 2 THEN n END), 0) AS BIGINT) FROM k""")
def ag19_report(spark, d):
    lines = []
    for of, counts in (("genre", rollup.genre_sizes(v(spark, d, "terms"))), ("city", rollup.cities(v(spark, d, "artists")))):
        plural = {"genre": "genres", "city": "cities"}[of]
        sums = counts.agg(F.count("*").alias("n"), F.coalesce(F.sum("artist_count"), F.lit(0)).alias("of"))
        lines.append(sums.select(F.explode(F.create_map(F.lit(plural), F.col("n"), F.lit(f"{of} memberships"), F.col("of"))).alias("line", "n")))
    return lines[0].unionByName(lines[1])


@query("""SELECT kind, id FROM (SELECT p_partkey % 4 AS kind, p_partkey AS id, row_number() OVER (PARTITION BY p_partkey % 4 ORDER BY p_size DESC, p_partkey) AS n FROM part) x WHERE n <= CASE WHEN kind = 0 THEN 6 ELSE 8 END""")
def k13_grouped_results(spark, d):
    ranked = first(table(spark, d, "part").selectExpr("p_partkey % 4 AS kind", "p_partkey AS id", "p_size"), 8, F.desc("p_size"), "id", by=["kind"])
    return ranked.where(F.col("place") <= F.when(F.col("kind") == 0, 6).otherwise(8)).select("kind", "id")


@query(f"SELECT DISTINCT fold FROM (SELECT {FOLD.format('permalink')} AS fold FROM artists WHERE account_kind = 'hub' UNION ALL SELECT {FOLD.format('city_raw')} FROM artists UNION ALL SELECT {FOLD.format('country')} FROM artists) x WHERE fold <> ''")
def x4_exclusions(spark, d):
    a = v(spark, d, "artists")
    return tracks.exclusions(a.where("account_kind = 'hub'").select("permalink"), a.select("city_raw"), a.select("country"))


@query("SELECT src, dst, type FROM edges WHERE src LIKE '%1' AND dst LIKE '%1'")
def g9_induced_edges(spark, d):
    nodes = v(spark, d, "artists").where("urn like '%1'").select(F.col("urn").alias("node"))
    return tracks.induced(v(spark, d, "edges"), nodes).select("src", "dst", "type")


@query("""SELECT segment AS scene, CASE WHEN count(CASE WHEN account_kind = 'artist' AND track_count > 0 THEN 1 END) >= 75 THEN segment END AS name, count(*) AS members FROM artists WHERE segment IS NOT NULL GROUP BY segment""")
def g15_surfacing_floor(spark, d):
    a = v(spark, d, "artists").where("segment is not null").groupBy("segment")
    told = a.agg(F.count(F.when((F.col("account_kind") == "artist") & (F.col("track_count") > 0), 1)).alias("crawled"), F.count("*").alias("members"))
    return tracks.named_scenes(told.withColumn("name", F.col("segment"))).select(F.col("segment").alias("scene"), "name", "members")


@query("""WITH p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN p_brand || ' · x' END AS owned, p_partkey % 50 / 100 AS share, p_size % 12 AS located,
    CASE WHEN p_partkey % 3 = 0 THEN 'shared' END AS shared, CASE WHEN p_partkey % 2 = 0 THEN 'a · b' END AS carried FROM part),
    c AS (SELECT *, CASE WHEN share >= 0.4 AND located >= 5 THEN 'city' END AS strict, CASE WHEN share >= 0.25 AND located >= 8 THEN 'city' END AS loose FROM p)
    SELECT id, CASE WHEN owned IS NOT NULL THEN concat_ws(' ', strict, owned) ELSE coalesce(strict, loose, shared, carried) END AS name FROM c""")
def n6_fallback_chain(spark, d):
    of = lambda n, *terms: F.when(F.col("p_partkey") % n == 0, F.array(*terms)).otherwise(F.array().cast("array<string>"))
    name = tracks.scene_name(
        of(7, "p_brand", F.lit("x")), F.lit("city"), F.col("p_partkey") % 50 / 100, F.col("p_size") % 12, of(3, F.lit("shared")), of(2, F.lit("a"), F.lit("b"), F.lit("c"))
    )
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), name.alias("name"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 2 = 0 THEN p_type ELSE NULL END AS image FROM part")
def f23_artwork(spark, d):
    of_tracks = F.array(F.lit(None).cast("string"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")))
    return table(spark, d, "part").select("p_partkey", tracks.artwork(F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")), of_tracks).alias("image"))


@query("SELECT urn, permalink, followers, CASE WHEN plays % 2 = 0 THEN 0 ELSE plays END AS plays FROM artists")
def f16_stored_roster(spark, d):
    kept = F.struct("urn", "permalink", "followers", F.when(F.col("plays") % 2 != 0, F.col("plays")).alias("plays"))
    json = v(spark, d, "artists").select(F.to_json(F.array(kept)).alias("roster"))
    return json.select(F.inline(files.roster(F.col("roster")))).select("urn", "permalink", "followers", "plays")


@query("SELECT e.src, e.dst, a.permalink AS name FROM edges e JOIN artists a ON a.urn = e.dst WHERE type = 'follow' AND followers % 2 = 0")
def j14_named_connections(spark, d):
    names = v(spark, d, "artists").select(F.col("urn").alias("dst"), F.when(F.col("followers") % 2 == 0, F.col("permalink")).alias("name"))
    return v(spark, d, "edges").where("type = 'follow'").join(names, "dst", "left").where("name is not null").select("src", "dst", "name")
