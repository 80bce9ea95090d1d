"""Queries of counts, orders and lists of the read side."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenewright.catalog import query, six, v
from scenewright.operators import browse, extract, lists


def scenes_of(spark, d):
    """(scene, urn): market segments stand for scenes."""
    return v(spark, d, "artists").where("segment is not null").select(F.col("segment").alias("scene"), "urn")


@query("""SELECT a.segment, count(*) AS n FROM terms t JOIN artists a ON a.urn = t.urn WHERE t.term = 'Brand#17' AND a.segment IS NOT NULL GROUP BY a.segment ORDER BY n DESC, a.segment LIMIT 6""")
def a6_scenes_per_genre(spark, d):
    return lists.scenes_of_term(v(spark, d, "terms"), scenes_of(spark, d), "Brand#17").withColumnRenamed("scene", "segment")


@query("""SELECT count(*) AS n FROM artists WHERE city_raw IS NOT NULL AND segment IS NOT NULL""")
def a8_located_members(spark, d):
    return scenes_of(spark, d).join(v(spark, d, "artists").where("city_raw is not null").select("urn"), "urn", "left_semi").agg(F.count("*").alias("n"))


@query("""SELECT a.segment, t.term, count(DISTINCT t.urn) AS support FROM terms t JOIN artists a ON a.urn = t.urn WHERE a.segment IS NOT NULL GROUP BY a.segment, t.term""")
def a11_term_support(spark, d):
    return lists.support(v(spark, d, "terms"), scenes_of(spark, d)).withColumnRenamed("scene", "segment")


@query("""SELECT segment, count(CASE WHEN last_upload_at IS NOT NULL THEN 1 END) AS crawled, count(CASE WHEN account_kind = 'hub' THEN 1 END) AS hubs FROM artists GROUP BY segment""")
def a15_scene_counts(spark, d):
    return lists.crawled_and_hubs(v(spark, d, "artists").select(F.col("segment").alias("scene"), "urn"), v(spark, d, "artists")).withColumnRenamed("scene", "segment")


@query("""SELECT term, count(DISTINCT a.segment) AS df FROM terms t JOIN artists a ON a.urn = t.urn WHERE evidence > 0 GROUP BY term""")
def a17_document_frequency(spark, d):
    return lists.document_frequency(v(spark, d, "terms"), scenes_of(spark, d))


@query("""SELECT segment, urn, followers FROM (SELECT segment, urn, followers, row_number() OVER (PARTITION BY segment ORDER BY followers DESC, urn) AS place FROM artists WHERE account_kind = 'hub') x WHERE place <= 12""")
def w3_top_hubs(spark, d):
    hubs = v(spark, d, "artists").where("account_kind = 'hub'")
    return browse.first(hubs, 12, F.desc("followers"), "urn", by=["segment"]).select("segment", "urn", "followers")


@query("""SELECT urn, plays FROM (SELECT urn, plays FROM artists ORDER BY plays DESC, urn LIMIT 3) x WHERE plays > 0""")
def k9_most_played(spark, d):
    return lists.most_played(v(spark, d, "artists")).select("urn", "plays")


@query("""SELECT segment, count(*) AS member_count FROM artists WHERE segment IS NOT NULL GROUP BY segment ORDER BY member_count DESC, segment""")
def k2_scenes_by_size(spark, d):
    return lists.sizes(scenes_of(spark, d).withColumnRenamed("scene", "segment"), "segment", "member_count")


@query("""SELECT t.term, count(*) AS members, CAST(sum(a.followers) AS BIGINT) AS reach FROM terms t JOIN artists a ON a.urn = t.urn WHERE t.kind = 'genre' GROUP BY t.term""")
def j1_membership_join(spark, d):
    return lists.members_of_terms(v(spark, d, "terms").where("kind = 'genre'"), v(spark, d, "artists"))


@query("""SELECT t.term, count(*) AS n FROM terms t WHERE NOT EXISTS (SELECT 1 FROM artists a WHERE a.urn = t.urn AND a.account_kind = 'hub') GROUP BY t.term""")
def j9_terms_without_hubs(spark, d):
    return lists.without_hubs(v(spark, d, "terms"), v(spark, d, "artists")).groupBy("term").agg(F.count("*").alias("n"))


@query("""SELECT urn, count(*) AS ties FROM (SELECT src AS urn FROM edges UNION ALL SELECT dst FROM edges WHERE src <> dst) x GROUP BY urn""")
def j11_either_end(spark, d):
    return lists.ties(v(spark, d, "edges"))


@query("""SELECT a.urn, coalesce(b.permalink, a.urn) AS name FROM artists a LEFT JOIN (SELECT urn, permalink FROM artists WHERE followers > 5000) b ON b.urn = a.urn""")
def j13_name_or_slug(spark, d):
    a = v(spark, d, "artists")
    return lists.named(a.select("urn"), a.where("followers > 5000").select("urn", F.col("permalink").alias("name")))


@query("""SELECT urn, place FROM (SELECT urn, place, row_number() OVER (PARTITION BY urn ORDER BY place) AS n FROM (SELECT src AS urn, 1 AS place FROM edges UNION ALL SELECT urn, 2 FROM artists) x) y WHERE n = 1""")
def x3_first_source_wins(spark, d):
    return lists.first_source(v(spark, d, "edges").select(F.col("src").alias("urn")), v(spark, d, "artists"))


@query("""SELECT city_raw, count(*) AS artist_count FROM artists GROUP BY city_raw ORDER BY artist_count DESC, city_raw""")
def k1_cities_by_size(spark, d):
    return lists.sizes(v(spark, d, "artists"), "city_raw", "artist_count")


@query("""SELECT count(*) AS artists, count(DISTINCT city_raw) AS cities, count(CASE WHEN account_kind = 'hub' THEN 1 END) AS hubs FROM artists""")
def a19_status_counts(spark, d):
    return lists.status(v(spark, d, "artists"))


@query("""SELECT urn, followers, likes + comments AS impact, plays FROM artists ORDER BY coalesce(followers, 0) DESC, coalesce(likes + comments, 0) DESC, coalesce(plays, 0) DESC, urn""")
def k4_reach_order(spark, d):
    return v(spark, d, "artists").orderBy(*lists.by_reach()).select("urn", "followers", (F.col("likes") + F.col("comments")).alias("impact"), "plays")


@query("""SELECT 'city' AS kind, city_raw AS name, count(*) AS n FROM artists GROUP BY city_raw
    UNION ALL SELECT kind, term, count(*) FROM terms GROUP BY kind, term UNION ALL SELECT 'scene', segment, count(*) FROM artists WHERE segment IS NOT NULL GROUP BY segment""")
def q9_browse_index(spark, d):
    terms = v(spark, d, "terms")
    of = lambda kind: (terms.where(F.col("kind") == kind), "term")
    return lists.tagged(city=(v(spark, d, "artists"), "city_raw"), genre=of("genre"), tag=of("tag"), scene=(scenes_of(spark, d), "scene"))


@query("""SELECT urn, kind, name, evidence FROM (SELECT urn, 'sound' AS kind, term AS name, evidence, row_number() OVER (PARTITION BY urn ORDER BY evidence DESC, term) AS place
      FROM terms WHERE kind = 'genre') x WHERE place <= 4
    UNION ALL SELECT urn, 'place', city_raw, 1 FROM artists UNION ALL SELECT urn, 'scene', segment, 1 FROM artists WHERE segment IS NOT NULL""")
def q11_artist_presence(spark, d):
    return lists.presence(v(spark, d, "terms"), v(spark, d, "artists"), scenes_of(spark, d))


@query("""SELECT segment, city_raw, n, floor(CAST(n AS DOUBLE) / total * 1e6 + 0.5) / 1e6 AS share FROM (
    SELECT segment, city_raw, count(*) AS n, sum(count(*)) OVER (PARTITION BY segment) AS total, row_number() OVER (PARTITION BY segment ORDER BY count(*) DESC, city_raw) AS place
    FROM artists WHERE segment IS NOT NULL GROUP BY segment, city_raw) x WHERE place = 1""")
def a13_top_city_share(spark, d):
    told = lists.top_share(v(spark, d, "artists").where("segment is not null").select(F.col("segment").alias("scene"), "city_raw"), "city_raw")
    return told.select(F.col("scene").alias("segment"), "city_raw", "n", six(F.col("share")).alias("share"))


@query("""SELECT a.urn, coalesce(n, 0) AS priority FROM artists a LEFT JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY dst) e ON e.dst = a.urn""")
def u9_inbound_priority(spark, d):
    return lists.inbound(v(spark, d, "artists"), v(spark, d, "edges"))


@query("""SELECT 'artists' AS name, count(*) AS n FROM artists UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'terms', count(*) FROM terms""")
def u14_counts(spark, d):
    count = lambda name: v(spark, d, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return count("artists").unionByName(count("edges")).unionByName(count("terms"))


@query("""SELECT urn FROM artists WHERE coalesce(track_count, 0) >= 1""")
def u22_crawl_guard(spark, d):
    return extract.crawlable(v(spark, d, "artists")).select("urn")


@query("""SELECT segment, CASE WHEN located < 5 OR CAST(located AS DOUBLE) / members < 0.12 THEN 'global' WHEN CAST(top AS DOUBLE) / located >= 0.33 THEN 'place'
    WHEN CAST(top AS DOUBLE) / located >= 0.18 THEN 'tinted' ELSE 'global' END AS home FROM (SELECT segment, sum(n) AS members, sum(n) AS located, max(n) AS top
      FROM (SELECT segment, country, count(*) AS n FROM artists WHERE segment IS NOT NULL GROUP BY segment, country) c GROUP BY segment) x""")
def g18_scene_home(spark, d):
    told = v(spark, d, "artists").where("segment is not null").select(F.col("segment").alias("scene"), F.col("country").alias("city"))
    return browse.scene_homes(told).withColumnRenamed("scene", "segment")
