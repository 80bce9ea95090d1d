"""Named queries of the read side, the queue, profiles and naming, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenewright.catalog import CITY, FOLD, MEMBERS, NOW, PAIRS, SCENE_DOCS, query, scene_docs, six, v
from scenewright.functions import profile as P
from scenewright.functions import text as T
from scenewright.operators import browse, cache, hubs, merge, rollup, scenes, search
from scenewright.operators.weights import directed_pairs, strengths

now = lambda: F.lit(NOW).cast("timestamp")
table = lambda spark, d, name: spark.read.parquet(f"{d}/{name}.parquet")

TITLE = "array_to_string(list_transform(regexp_extract_all(lower({0}), '([a-z0-9]+|[^a-z0-9]+)'), lambda p: CASE WHEN regexp_matches(p, '^[a-z0-9]') THEN upper(p[1]) || p[2:] ELSE p END), '')"
SPELLED = f"""y AS (SELECT fold, {TITLE.format('term')} AS name FROM (SELECT fold, term, row_number() OVER (PARTITION BY fold ORDER BY votes DESC, term) AS placed FROM
  (SELECT {FOLD.format('term')} AS fold, term, sum(CASE WHEN kind = 'genre' THEN 2 ELSE 1 END) AS votes FROM terms GROUP BY ALL) s) s WHERE placed = 1)"""
LINE = "CASE WHEN day > 0 THEN 'active now' WHEN week > 0 THEN week || ' this week' END"


def listed(members: str, key: str) -> str:
    return f"""n AS (SELECT {key}, count(*) AS artist_count FROM {members} GROUP BY {key} HAVING count(*) >= 2),
    hb AS (SELECT x.{key}, count(*) AS hub_count FROM {members} x JOIN artists a ON a.urn = x.urn WHERE account_kind = 'hub' GROUP BY x.{key}),
    ac AS (SELECT x.{key}, count(CASE WHEN last_upload_at > TIMESTAMP '{NOW}' - INTERVAL 1 DAY THEN 1 END) AS day, count(*) AS week FROM {members} x JOIN artists a ON a.urn = x.urn
      WHERE last_upload_at > TIMESTAMP '{NOW}' - INTERVAL 7 DAY GROUP BY x.{key})"""


@query(f"WITH {SPELLED} SELECT * FROM y")
def a12_spelling_vote(spark, d):
    return rollup.spellings(v(spark, d, "terms"))


@query(f"WITH {MEMBERS}, {SPELLED}, {listed('m', 'fold')} SELECT n.fold, name, artist_count, coalesce(hub_count, 0) AS hub_count, {LINE} AS activity FROM n JOIN y ON y.fold = n.fold LEFT JOIN hb ON hb.fold = n.fold LEFT JOIN ac ON ac.fold = n.fold")
def q1_list_genres(spark, d):
    return browse.list_genres(v(spark, d, "terms"), v(spark, d, "artists"), now()).select("fold", "name", "artist_count", "hub_count", "activity")


@query(f"WITH {CITY}, {listed('c', 'city')} SELECT n.city, artist_count, coalesce(hub_count, 0) AS hub_count, {LINE} AS activity FROM n LEFT JOIN hb ON hb.city = n.city LEFT JOIN ac ON ac.city = n.city")
def q2_list_cities(spark, d):
    return browse.list_cities(v(spark, d, "artists"), now()).select("city", "artist_count", "hub_count", "activity")


TAB = "t AS (SELECT fold, city, count(DISTINCT m.urn) AS n FROM m JOIN c ON m.urn = c.urn GROUP BY fold, city)"
KIN = """k AS (SELECT a.fold, b.fold AS other, count(*) AS shared, count(*) / (max(x.n) + max(y.n) - count(*)) AS affinity FROM m a JOIN m b ON a.urn = b.urn AND a.fold <> b.fold
  JOIN (SELECT fold, count(*) AS n FROM m GROUP BY fold) x ON x.fold = a.fold JOIN (SELECT fold, count(*) AS n FROM m GROUP BY fold) y ON y.fold = b.fold GROUP BY 1, 2)"""


@query(f"""WITH {MEMBERS}, {CITY}, {TAB}, {KIN}, p AS (SELECT 'city' AS part, CAST(row_number() OVER (ORDER BY n DESC, city) AS INTEGER) AS place, city AS name, n FROM t WHERE fold = 'brand12'
    UNION ALL SELECT 'related', CAST(row_number() OVER (ORDER BY affinity DESC, other) AS INTEGER), other, shared FROM k WHERE fold = 'brand12') SELECT * FROM p WHERE place <= 6""")
def q3_genre_detail(spark, d):
    return browse.genre_detail(v(spark, d, "terms"), v(spark, d, "artists"), "brand12")


@query(f"""WITH {MEMBERS}, {CITY}, {TAB}, o AS (SELECT city, count(*) AS n FROM c GROUP BY city HAVING count(*) >= 2 AND city <> 'nation3'),
    p AS (SELECT 'genre' AS part, 6 AS most, CAST(row_number() OVER (ORDER BY n DESC, fold) AS INTEGER) AS place, fold AS name, n FROM t WHERE city = 'nation3'
    UNION ALL SELECT 'other', 4, CAST(row_number() OVER (ORDER BY n DESC, city) AS INTEGER), city, n FROM o) SELECT part, place, name, n FROM p WHERE place <= most""")
def q4_city_detail(spark, d):
    return browse.city_detail(v(spark, d, "terms"), v(spark, d, "artists"), "nation3")


@query(f"""WITH {MEMBERS}, {CITY}, r AS (SELECT account_kind AS kind, CAST(row_number() OVER (PARTITION BY account_kind ORDER BY followers DESC, likes + comments DESC, plays DESC, a.urn) AS INTEGER) AS place, a.urn
    FROM m JOIN c ON c.urn = m.urn JOIN artists a ON a.urn = m.urn WHERE fold = 'brand12' AND city = 'nation3') SELECT * FROM r WHERE place <= CASE WHEN kind = 'hub' THEN 12 ELSE 24 END""")
def q5_artists_and_hubs(spark, d):
    both = rollup.memberships(v(spark, d, "terms")).join(rollup.city_of(v(spark, d, "artists")).select("urn", "city"), "urn")
    return browse.sound_in_place(both, v(spark, d, "artists"), "brand12", "nation3")


SEGMENTS = "g AS (SELECT segment, urn FROM artists WHERE segment IS NOT NULL)"


def segments(spark, d):
    return v(spark, d, "artists").where("segment is not null").select("segment", "urn")


@query(f"WITH {SEGMENTS}, {listed('g', 'segment')} SELECT n.segment, artist_count, coalesce(hub_count, 0) AS hub_count, {LINE} AS activity FROM n LEFT JOIN hb ON hb.segment = n.segment LEFT JOIN ac ON ac.segment = n.segment")
def q6_list_scenes(spark, d):
    own = segments(spark, d)
    n = own.groupBy("segment").agg(F.count("*").alias("artist_count")).where("artist_count >= 2")
    return browse.listed(n, own, v(spark, d, "artists"), "segment", now())


@query(f"""WITH {MEMBERS}, {CITY}, {SEGMENTS}, p AS (SELECT 'genre' AS part, fold AS name, count(*) AS n FROM m JOIN g ON g.urn = m.urn WHERE segment = 'BUILDING' GROUP BY fold
    UNION ALL SELECT 'city', city, count(*) FROM c JOIN g ON g.urn = c.urn WHERE segment = 'BUILDING' GROUP BY city),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY part ORDER BY n DESC, name) AS INTEGER) AS place FROM p) SELECT * FROM r WHERE place <= 6""")
def q7_scene_detail(spark, d):
    own = segments(spark, d).where("segment = 'BUILDING'").withColumnRenamed("segment", "scene")
    terms = browse.scene_counts(rollup.memberships(v(spark, d, "terms")).join(own, "urn"), "fold")
    places = browse.scene_counts(rollup.city_of(v(spark, d, "artists")).join(own, "urn").select("scene", "city"), "city")
    part = lambda df, kind, name: df.select(F.lit(kind).alias("part"), "place", F.col(name).alias("name"), F.col("count").alias("n"))
    return part(terms, "genre", "fold").unionByName(part(places, "city", "city"))


@query(f"WITH {MEMBERS}, {SEGMENTS}, r AS (SELECT segment AS scene, fold, count(*) AS n, CAST(row_number() OVER (PARTITION BY segment ORDER BY count(*) DESC, fold) AS INTEGER) AS place FROM m JOIN g ON g.urn = m.urn GROUP BY 1, 2) SELECT scene, place, fold, n FROM r WHERE place <= 6")
def a5_scene_genres(spark, d):
    own = rollup.memberships(v(spark, d, "terms")).join(segments(spark, d).withColumnRenamed("segment", "scene"), "urn")
    return browse.scene_counts(own, "fold").select("scene", "place", "fold", F.col("count").alias("n"))


@query("""WITH p AS (SELECT c_mktsegment AS scene, CASE WHEN c_custkey % 3 <> 0 THEN n_name END AS city, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_nationkey % 5 < 3 OR c_mktsegment = 'BUILDING' GROUP BY 1, 2),
    s AS (SELECT scene, sum(n) AS members, coalesce(sum(CASE WHEN city IS NOT NULL THEN n END), 0) AS located, max(CASE WHEN city IS NOT NULL THEN n END) AS top FROM p GROUP BY scene)
    SELECT scene, CASE WHEN located < 5 OR located / members < 0.12 THEN 'global' WHEN top / located >= 0.33 THEN 'place' WHEN top / located >= 0.18 THEN 'tinted' ELSE 'global' END AS home FROM s""")
def g18_scene_homes(spark, d):
    told = table(spark, d, "customer").join(table(spark, d, "nation"), F.expr("c_nationkey = n_nationkey")).where("c_nationkey % 5 < 3 or c_mktsegment = 'BUILDING'")
    return browse.scene_homes(told.select(F.col("c_mktsegment").alias("scene"), F.when(F.col("c_custkey") % 3 != 0, F.col("n_name")).alias("city")))


@query("SELECT urn, sum(weight) AS connections FROM (SELECT src AS urn, weight FROM edges UNION ALL SELECT dst, weight FROM edges WHERE src <> dst) x GROUP BY urn")
def ag10_connections(spark, d):
    return browse.connections(v(spark, d, "edges"))


@query(f"""WITH {MEMBERS}, {KIN} SELECT fold, string_agg(other, ',' ORDER BY place) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY affinity DESC, other) AS place FROM k) r WHERE place <= 6 GROUP BY fold""")
def ag15_top_terms(spark, d):
    return browse.top_terms(v(spark, d, "terms")).select("fold", F.array_join("terms", ",").alias("terms"))


@query(f"""WITH {MEMBERS}, kept AS (SELECT * FROM m WHERE fold IN (SELECT fold FROM m GROUP BY fold HAVING count(*) >= 2)),
    r AS (SELECT a.urn, a.fold, b.fold AS other, row_number() OVER (PARTITION BY a.urn, a.fold ORDER BY b.evidence DESC, b.fold) AS place FROM kept a JOIN kept b ON a.urn = b.urn AND a.fold <> b.fold)
    SELECT urn, fold, string_agg(other, ',' ORDER BY place) AS others FROM r WHERE place <= 3 GROUP BY urn, fold""")
def ag16_other_genres(spark, d):
    return browse.other_genres(v(spark, d, "terms")).select("urn", "fold", F.array_join("others", ",").alias("others"))


# --- queue and merges -------------------------------------------------------------------------------------------------


@query("""SELECT user_id AS urn, max_by(event_type, ts) AS permalink, min(event_id % 5) AS depth, min(ts) AS first_seen, max(ts) AS last_seen, min_by(event_type, ts) AS discovered_via
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) AS n FROM events) e WHERE n = 1 GROUP BY user_id""")
def u1_merge_artists(spark, d):
    e = table(spark, d, "events").groupBy("user_id", "ts").agg(F.min_by("event_type", "event_id").alias("event_type"), F.min("event_id").alias("event_id"))
    seen = e.select(F.col("user_id").alias("urn"), F.col("ts").alias("seen"), F.col("event_type").alias("permalink"), (F.col("event_id") % 5).alias("depth"), F.col("event_type").alias("discovered_via"))
    return merge.merge_artists(seen).select("urn", "permalink", "depth", "first_seen", "last_seen", "discovered_via")


@query("SELECT user_id AS urn, max_by(event_id, event_id) AS plays, max_by(event_id % 7, event_id) AS likes, max_by(event_id % 3, event_id) AS comments FROM events GROUP BY user_id")
def u2_engagement(spark, d):
    return merge.merge_engagement(table(spark, d, "events").selectExpr("user_id AS urn", "event_id AS seen", "event_id AS plays", "event_id % 7 AS likes", "event_id % 3 AS comments"))


@query("SELECT user_id AS urn, 'https://' || event_type AS url, min(ts) AS first_seen FROM events GROUP BY ALL")
def u7_purchase_links(spark, d):
    return merge.merge_links(table(spark, d, "events").selectExpr("user_id AS urn", "concat('https://', event_type) AS url", "ts AS seen"))


QUEUE = """SELECT o_orderkey AS urn, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'in_progress' ELSE 'done' END AS status,
  CAST(o_orderkey % 4 AS BIGINT) AS attempts, o_custkey % 11 AS priority, o_orderkey % 3 AS depth, o_orderdate AS enqueued_at FROM {}"""


def queue(spark, d):
    return spark.sql(QUEUE.format("{orders}"), orders=table(spark, d, "orders"))


@query(f"WITH q AS ({QUEUE.format('orders')}) SELECT * FROM q WHERE status = 'pending' ORDER BY priority DESC, depth, enqueued_at, urn LIMIT 100")
def u10_claim(spark, d):
    return merge.claim(queue(spark, d), 100)


@query(f"""WITH q AS ({QUEUE.format('orders')}), t AS (SELECT *, urn % 5 = 0 AS f FROM q) SELECT urn, attempts + CASE WHEN f THEN 1 ELSE 0 END AS attempts,
    CASE WHEN f AND attempts >= 2 THEN 'failed' WHEN f THEN 'pending' ELSE status END AS status FROM t""")
def u12_mark_failed(spark, d):
    q = queue(spark, d)
    return merge.mark_failed(q, q.where("urn % 5 = 0")).select("urn", "attempts", "status")


@query(f"WITH q AS ({QUEUE.format('orders')}) SELECT urn, replace(status, 'in_progress', 'pending') AS status FROM q")
def u13_reset_in_progress(spark, d):
    return merge.reset_in_progress(queue(spark, d)).select("urn", "status")


@query("""SELECT a.urn, CASE WHEN account_kind = 'artist' THEN coalesce(n, 0) ELSE followers END AS priority FROM artists a LEFT JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY dst) e ON e.dst = a.urn""")
def u9_reprioritized(spark, d):
    q = v(spark, d, "artists").select("urn", F.when(F.col("account_kind") == "artist", "pending").otherwise("done").alias("status"), F.col("followers").alias("priority"))
    return merge.reprioritized(q, v(spark, d, "edges")).select("urn", "priority")


# --- search, predicates, cache ----------------------------------------------------------------------------------------


@query("""WITH k AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'user' WHEN 1 THEN 'track' WHEN 2 THEN 'playlist' ELSE 'album' END AS kind, CASE WHEN p_size > 25 THEN p_name END AS image, p_size AS followers,
    p_size % 5 AS tracks, CAST(floor(p_retailprice) AS BIGINT) AS plays FROM part) SELECT id, kind FROM k WHERE CASE kind WHEN 'user' THEN image IS NOT NULL OR followers >= 10 OR tracks >= 1
    WHEN 'track' THEN image IS NOT NULL OR plays >= 1000 WHEN 'playlist' THEN image IS NOT NULL OR tracks >= 3 ELSE true END""")
def p3_quality(spark, d):
    t = table(spark, d, "part").selectExpr("p_partkey AS id", "element_at(array('user', 'track', 'playlist', 'album'), CAST(p_partkey % 4 + 1 AS INT)) AS kind", "if(p_size > 25, p_name, NULL) AS image", "p_size", "floor(p_retailprice) AS plays")
    return t.where(search.quality(F.col("kind"), F.col("image"), F.col("p_size"), F.col("p_size") % 5, F.col("plays"))).select("id", "kind")


@query("""WITH k AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'track' ELSE 'playlist' END AS kind, CASE WHEN p_size > 25 THEN 1 END AS image, p_size AS reach FROM part)
    SELECT id, kind FROM k ORDER BY kind = 'user' DESC, image IS NOT NULL DESC, kind = 'track' DESC, reach DESC, id LIMIT 50""")
def r4_type_first(spark, d):
    t = table(spark, d, "part").selectExpr("p_partkey AS id", "element_at(array('user', 'track', 'playlist'), CAST(p_partkey % 3 + 1 AS INT)) AS kind", "if(p_size > 25, 1, NULL) AS image", "p_size AS followers", "p_size AS plays", "p_size AS likes")
    return search.type_first(t, 50).select("id", "kind")


@query("""SELECT p_partkey FROM part WHERE contains(lower(p_name), 'small') OR contains(lower(p_brand), 'small') OR 1 - levenshtein(lower(p_name), 'small') / greatest(length(p_name), 5) > 0.7
    OR 1 - levenshtein(lower(p_brand), 'small') / greatest(length(p_brand), 5) > 0.7""")
def r1_matches(spark, d):
    return table(spark, d, "part").where(search.matches("small", F.col("p_name"), F.col("p_brand"))).select("p_partkey")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10 AND l_returnflag <> 'A' AND (l_linestatus = 'O' OR l_returnflag = 'N')""")
def p1_playable(spark, d):
    t = table(spark, d, "lineitem").withColumns({
        "id": F.col("l_partkey"), "title": F.col("l_comment") if "l_comment" in table(spark, d, "lineitem").columns else F.lit("t"), "permalink_url": F.lit("https://x"),
        "duration": F.greatest(F.lit(0), F.col("l_quantity").cast("int") - 10), "streamable": F.col("l_linestatus") == "O",
        "access": F.when(F.col("l_returnflag") == "A", "blocked").when(F.col("l_returnflag") == "N", "preview"),
    })
    return t.where(search.playable(t)).select("l_orderkey", "l_linenumber")


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_id % 3 = 0 THEN 'user' WHEN event_id % 5 = 0 THEN 'playlist' WHEN event_id % 7 = 0 THEN 'track' END AS kind FROM events""")
def p4_kind_by_fields(spark, d):
    there = lambda n: F.when(F.col("event_id") % n == 0, 1)
    return table(spark, d, "events").select("event_id", P.kind_of(there(2), there(3), there(5), there(7)).alias("kind"))


@query(rf"""WITH t AS (SELECT *, lower(permalink) AS p FROM artists) SELECT urn, CASE WHEN p = 'customer#000000007' THEN false WHEN plays % 50 = 0 AND track_count > 0 THEN true WHEN p = 'supplier#000000003' THEN true
    ELSE urn LIKE '%5' END AS hub FROM t""")
def h1_hub_precedence(spark, d):
    a = v(spark, d, "artists")
    named = F.when(F.endswith("urn", F.lit("5")), F.lit("North Records")).otherwise("Someone")
    many = F.when((F.col("plays") % 50 == 0) & (F.col("track_count") > 0), 1000).otherwise(3)
    return a.select("urn", hubs.is_hub(F.col("permalink"), many, F.lit("a plain text"), named, hubs=["Supplier#000000003"], artists=["Customer#000000007"]).alias("hub"))


@query("""SELECT p_partkey, p_partkey % 4 IN (0, 1) AS hub FROM part""")
def h3_name_rule(spark, d):
    name = F.element_at(F.array(F.concat("p_brand", F.lit(" Records")), F.concat("p_brand", F.lit(" fm ")), F.concat("p_brand", F.lit(" [x] records")), F.concat("p_brand", F.lit("records"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", hubs.named_as_hub(name).alias("hub"))


@query("""SELECT user_id || ':' || event_type AS key, event_type AS type FROM events WHERE event_type <> 'click' GROUP BY ALL HAVING max(epoch_us(ts) // 1000) + 864000000 > 1706000000000""")
def c5_deleted_and_retained(spark, d):
    sets = table(spark, d, "events").select(
        F.concat_ws(":", "user_id", "event_type").alias("key"), F.lit("{}").alias("value"), F.col("event_type").alias("type"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.lit(86_400_000).alias("ttl")
    )
    return cache.retained(cache.without(cache.latest(sets, stale_ms=777_600_000), kind="click"), 1_706_000_000_000).select("key", "type")


@query("SELECT urn FROM artists WHERE urn NOT IN (SELECT 'customer:' || o_custkey FROM orders WHERE epoch(o_orderdate) * 1000 > 896659200000 - 21600000 * 40)")
def c8_failure_memo(spark, d):
    failed = table(spark, d, "orders").select(F.concat(F.lit("customer:"), "o_custkey").alias("urn"), (F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) * 1000).alias("at"))
    return cache.due(v(spark, d, "artists").select("urn"), failed, 896_659_200_000, hours=240)


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def st5_recent_windows(spark, d):
    from scenewright.streaming.ingest import recent_counts

    return recent_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# --- scalar functions -------------------------------------------------------------------------------------------------

SHORT = "CASE WHEN {n} >= 1000000 THEN printf('%.1f', floor({n} / 1000000 * 10 + 0.5) / 10) || 'M' WHEN {n} >= 1000 THEN printf('%.1f', floor({n} / 1000 * 10 + 0.5) / 10) || '{k}' ELSE CAST({n} AS VARCHAR) END"


@query(f"SELECT urn, replace({SHORT.format(n='plays', k='k')}, '.0', '') AS short, {SHORT.format(n='plays', k='K')} AS exact FROM artists")
def f10_f11_counts(spark, d):
    return v(spark, d, "artists").select("urn", T.format_count(F.col("plays")).alias("short"), P.format_number(F.col("plays")).alias("exact"))


@query(f"SELECT doc_id, {TITLE.format('text')} AS title FROM documents")
def f3_title_case(spark, d):
    return table(spark, d, "documents").select("doc_id", T.title_case(F.lower("text")).alias("title"))


@query("SELECT urn, CAST(split_part(urn, ':', 2) AS BIGINT) AS id FROM artists")
def f5_urn_to_id(spark, d):
    return v(spark, d, "artists").select("urn", T.urn_to_id(F.col("urn")).cast("long").alias("id"))


@query("SELECT o_orderkey, CASE WHEN year(o_orderdate) = 1998 THEN strftime(o_orderdate, '%d.%m') ELSE strftime(o_orderdate, '%d.%m.%y') END AS said FROM orders")
def f12_format_date(spark, d):
    return table(spark, d, "orders").select("o_orderkey", P.format_date(F.col("o_orderdate"), now()).alias("said"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN n_name ELSE n_name || ' · ' || c_mktsegment END AS line FROM customer JOIN nation ON c_nationkey = n_nationkey")
def f22_location_line(spark, d):
    both = table(spark, d, "customer").join(table(spark, d, "nation"), F.expr("c_nationkey = n_nationkey"))
    return both.select("c_custkey", P.location_line(F.col("n_name"), F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_mktsegment"))).alias("line"))


@query("SELECT page_id, 'https://i1.x.com/artworks-' || page_id || '-t500x500.jpg' AS image FROM pages")
def f17_image_size(spark, d):
    size = F.element_at(F.array(F.lit("large"), F.lit("t120x120"), F.lit("badge")), (F.col("page_id") % 3 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", P.large_image(F.concat(F.lit("https://i1.x.com/artworks-"), "page_id", F.lit("-"), size, F.lit(".jpg"))).alias("image"))


# --- scenes and names -------------------------------------------------------------------------------------------------


@query(f"""WITH {PAIRS}, h AS (SELECT src, least(1.0, CAST(40 AS DOUBLE) / count(*)) AS factor FROM p WHERE reposts > 0 GROUP BY src),
    s AS (SELECT p.src, dst, (CASE WHEN follow THEN 1.0 ELSE 0.0 END) + coalesce(factor, 1.0) * log2(1 + reposts) AS strength FROM p LEFT JOIN h ON p.src = h.src WHERE p.src <> dst),
    g AS (SELECT x.country AS community, dst AS node, floor(sum(strength) * 1e3 + 0.5) / 1e3 AS degree FROM s JOIN artists x ON x.urn = src JOIN artists y ON y.urn = dst WHERE strength > 0 AND x.country = y.country GROUP BY 1, 2)
    SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY community ORDER BY degree DESC, node) AS INTEGER) AS place FROM g) r WHERE place <= 24""")
def w2_scene_roster(spark, d):
    labels = v(spark, d, "artists").select(F.col("urn").alias("node"), F.col("country").alias("community"))
    degree = scenes.in_scene_degree(strengths(directed_pairs(v(spark, d, "edges"))), labels).withColumn("degree", T.rounded(F.col("degree"), 3))
    return browse.first(degree, 24, F.desc("degree"), "node", by=["community"])


@query(f"WITH {SCENE_DOCS} SELECT scene, term, floor(weight / max(weight) OVER (PARTITION BY scene) * 1e6 + 0.5) / 1e6 AS ratio FROM d")
def w6_ratio_to_leader(spark, d):
    from pyspark.sql.window import Window

    docs = scene_docs(spark, d)
    return docs.select("scene", "term", six(F.col("weight") / F.max("weight").over(Window.partitionBy("scene"))).alias("ratio"))


@query(f"""WITH {SEGMENTS}, s AS (SELECT segment AS scene, term, count(DISTINCT t.urn) AS support FROM terms t JOIN g ON g.urn = t.urn GROUP BY 1, 2), n AS (SELECT segment AS scene, count(DISTINCT t.urn) AS termed FROM terms t JOIN g ON g.urn = t.urn GROUP BY 1)
    SELECT s.scene, term, support, termed FROM s JOIN n ON n.scene = s.scene WHERE support >= greatest(4, ceil(0.08 * termed - 1e-9))""")
def n4_breadth_floor(spark, d):
    both = v(spark, d, "terms").join(segments(spark, d).withColumnRenamed("segment", "scene"), "urn")
    support = both.groupBy("scene", "term").agg(F.count_distinct("urn").alias("support"))
    return browse.broad_enough(support, both.groupBy("scene").agg(F.count_distinct("urn").alias("termed"))).select("scene", "term", "support", "termed")


SCENE_NAMES = """SELECT p_partkey AS id, CASE WHEN p_partkey % 50 = 49 THEN NULL WHEN p_partkey % 3 = 1 THEN concat(p_brand, ' ', CAST(p_partkey + p_size % 3 AS {string})) ELSE p_brand END AS name FROM {part}"""


@query(f"""WITH RECURSIVE n AS ({SCENE_NAMES.format(part='part', string='VARCHAR')}),
    o AS (SELECT id, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS base, row_number() OVER (ORDER BY id) AS turn FROM n WHERE name IS NOT NULL),
    r(turn, id, slug, used) AS (
      SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST([] AS VARCHAR[])
      UNION ALL SELECT turn, id, slug, list_append(used, slug) FROM (
        SELECT o.turn, o.id, used, CASE WHEN NOT list_contains(used, base) THEN base
          ELSE list_filter(list_transform(range(o.id, o.id + o.turn + 1), lambda k: base || '-' || k), lambda x: NOT list_contains(used, x))[1] END AS slug
        FROM r JOIN o ON o.turn = r.turn + 1) x)
    SELECT n.id, name, slug FROM n LEFT JOIN (SELECT id, slug FROM r WHERE id IS NOT NULL) t ON t.id = n.id""")
def g16_scene_slugs(spark, d):
    named = spark.sql(SCENE_NAMES.format(part="{part}", string="STRING"), part=table(spark, d, "part"))
    return browse.slugs(named.withColumn("base", T.slugify(F.col("name")))).select("id", "name", "slug")


@query("""SELECT c_custkey AS node, CASE WHEN n >= 20 THEN k END AS community FROM (SELECT c_custkey, c_nationkey * 100 + c_custkey % 9 AS k, count(*) OVER (PARTITION BY c_nationkey * 100 + c_custkey % 9) AS n FROM customer) x""")
def g11_dust_pooled(spark, d):
    return browse.pooled(table(spark, d, "customer").select(F.col("c_custkey").alias("node"), (F.col("c_nationkey") * 100 + F.col("c_custkey") % 9).alias("community")))


@query("""WITH s AS (SELECT CAST(p_size AS DOUBLE) AS resolution, max(p_retailprice) / sum(p_retailprice) AS largest, CAST(count(*) AS DOUBLE) AS median FROM part GROUP BY p_size)
    SELECT * FROM s ORDER BY largest > 0.1, CASE WHEN median = 0 THEN 1e300 ELSE greatest(0, (50 - median) / 50, (median - 2000) / 2000) END, CASE WHEN largest > 0.1 THEN largest ELSE resolution END, CASE WHEN largest > 0.1 THEN resolution ELSE largest END LIMIT 1""")
def g8_partition_choice(spark, d):
    stats = table(spark, d, "part").groupBy(F.col("p_size").cast("double").alias("resolution"))
    return browse.partition_choice(stats.agg((F.max("p_retailprice") / F.sum("p_retailprice")).alias("largest"), F.count("*").cast("double").alias("median")))
