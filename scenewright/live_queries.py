"""Queries of searches, crawls and published tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenewright.catalog import CITY, FOLD, MEMBERS, NOW, query, v
from scenewright.functions import text as T
from scenewright.operators import browse, cache, extract, history, merge, rollup, tracks
from scenewright.operators.tables import scratch
from scenewright.sources import files
from scenewright.sources.store import Store


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Every event as a search of its user: the beginning of a part's name, and five parts found.
SEARCHES = """SELECT user_id AS key, event_id AS seq, ts, substring(q.p_name, 1, CAST(1 + event_id % 9 AS INTEGER)) AS query, event_id,
    p0.p_partkey AS i0, p0.p_name AS t0, p1.p_partkey AS i1, p1.p_name AS t1, p2.p_partkey AS i2, p2.p_name AS t2, p0.p_brand AS b0, p1.p_brand AS b1, p2.p_brand AS b2
  FROM {events} CROSS JOIN (SELECT count(*) AS parts FROM {part}) n JOIN {part} q ON q.p_partkey = (event_id * 7) % parts JOIN {part} p0 ON p0.p_partkey = (event_id * 13) % parts
  JOIN {part} p1 ON p1.p_partkey = (event_id * 13 + 1) % parts JOIN {part} p2 ON p2.p_partkey = (event_id * 5 + user_id) % parts"""
SIMILARITY = "CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 ELSE (greatest(length({a}), length({b})) - levenshtein({a}, {b})) / CAST(greatest(length({a}), length({b})) AS DOUBLE) END"


def _text(x):
    return f"CASE WHEN starts_with({x}, q) THEN 100 ELSE 0 END + CASE WHEN contains({x}, q) THEN 50 ELSE 0 END + 30 * ({SIMILARITY.format(a=x, b='q')})"


@query(f"""WITH s AS ({SEARCHES.replace('{', '').replace('}', '')}),
  f AS (SELECT key, seq, 0 AS k, i0 AS id, t0 AS title, b0 AS owner FROM s UNION ALL SELECT key, seq, 1, i1, t1, b1 FROM s UNION ALL SELECT key, seq, 2, i2, t2, b2 FROM s),
  o AS (SELECT key, seq, ts, query, row_number() OVER (PARTITION BY key ORDER BY ts, seq) AS turn FROM s),
  h AS (SELECT a.key, a.seq, a.query, b.seq AS of, b.turn FROM o a JOIN o b ON b.key = a.key AND b.turn < a.turn AND b.turn >= a.turn - 6 AND epoch_us(a.ts) - epoch_us(b.ts) < 259200000000
    WHERE starts_with(a.query, b.query) OR starts_with(b.query, a.query)),
  e AS (SELECT o.key, o.seq, lower(query) AS q, query, 0 AS turn, k, id, title, owner FROM o JOIN f ON f.key = o.key AND f.seq = o.seq
    UNION ALL SELECT h.key, h.seq, lower(query), query, turn, k, id, title, owner FROM h JOIN f ON f.key = h.key AND f.seq = h.of),
  u AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY key, seq, id ORDER BY turn, k) = 1),
  g AS (SELECT *, lower(title) AS t, lower(owner) AS w FROM u),
  m AS (SELECT *, floor((({_text('t')}) + ({_text('w')}) + 2 * log10(id + 1)) * 1e9 + 0.5) / 1e9 AS score FROM g
    WHERE contains(t, q) OR contains(w, q) OR {SIMILARITY.format(a='t', b='q')} > 0.7 OR {SIMILARITY.format(a='w', b='q')} > 0.7)
  SELECT key, seq, query, CAST(place AS INTEGER) AS place, id, title, floor(score * 1e6 + 0.5) / 1e6 AS score FROM (SELECT *, row_number() OVER (PARTITION BY key, seq ORDER BY score DESC, turn, k) AS place FROM m) x WHERE place <= 20""")
def r3_steadied_searches(spark, d):
    """What every search shows once the six searches before it within three days have lent theirs."""
    rows = spark.sql(SEARCHES, events=table(spark, d, "events"), part=table(spark, d, "part"))
    none = F.lit(None).cast("bigint")
    found = [F.struct(F.col(f"i{k}").alias("id"), F.col(f"t{k}").alias("title"), F.col(f"b{k}").alias("owner"), none.alias("followers"), none.alias("likes"), F.col(f"i{k}").alias("plays")) for k in range(3)]
    searches = history.searches_of(rows, *found).select("key", "seq", "ts", "query", "results")
    shown = history.steadied(history.with_past(searches, 6, 3 * 86400))
    return shown.withColumn("score", T.rounded(F.col("score"), 6))


# --- crawls and merges ------------------------------------------------------------------------------------------------


@query("""SELECT CAST(user_id AS VARCHAR) AS src, CAST(event_id % 97 AS VARCHAR) AS dst, event_type AS type, max(value) AS weight, CAST(min(event_id) AS BIGINT) AS first_seen, CAST(max(event_id) AS BIGINT) AS last_seen FROM events GROUP BY 1, 2, 3""")
def st4_bucketed_ingest(spark, d):
    """All events as sightings of ties, merged into a store in three batches, one of them twice."""
    seen = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("src"), (F.col("event_id") % 97).cast("string").alias("dst"), F.col("event_type").alias("type"), F.col("value").alias("weight"),
        F.col("event_id").alias("first_seen"), F.col("event_id").alias("last_seen"),
    )
    store = Store(spark, scratch(spark))

    def fold(both):
        return both.groupBy("src", "dst", "type").agg(F.max("weight").alias("weight"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))

    for number in (0, 1, 1, 2):
        store.merge("edges", seen.where(F.col("first_seen") % 3 == number), ["src", "dst"], fold, "events", number, 8)
    return store.read("edges")


ENTRIES = "SELECT o_orderkey AS urn, CAST(CASE o_orderstatus WHEN 'O' THEN 'in_progress' WHEN 'F' THEN 'pending' ELSE 'failed' END AS {string}) AS status, CAST(o_custkey % 3 AS INTEGER) AS attempts FROM {orders}"


@query(f"""WITH q AS ({ENTRIES.replace('{string}', 'VARCHAR').replace('{orders}', 'orders')})
    SELECT urn, CASE WHEN status = 'in_progress' AND urn % 4 = 1 THEN 'done' ELSE status END AS status FROM q""")
def u11_mark_done(spark, d):
    queue = spark.sql(ENTRIES.replace("{string}", "STRING"), orders=table(spark, d, "orders"))
    return merge.mark_done(queue, queue.where("urn % 4 = 1").select("urn")).select("urn", "status")


@query("""WITH e AS (SELECT user_id AS urn, event_id AS n, CASE WHEN event_type IN ('error', 'purchase') THEN NULL ELSE event_id % 5 END AS depth FROM events),
    t AS (SELECT urn, max(n) AS last FROM e WHERE depth IS NULL GROUP BY urn)
    SELECT e.urn, min(depth) AS depth, CASE WHEN any_value(last) IS NULL OR min(CASE WHEN n > last THEN depth END) < coalesce(min(CASE WHEN n < last THEN depth END), 99) THEN 'pending' ELSE 'done' END AS status, count(depth) - 1 AS priority
    FROM e LEFT JOIN t ON t.urn = e.urn GROUP BY e.urn""")
def u8_queue_history(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("urn"), F.col("event_id").alias("at"), "event_type")
    ends = F.col("event_type").isin("error", "purchase")
    return merge.merge_queue(e.select("urn", "at", F.when(~ends, F.col("at") % 5).alias("depth"), F.when(ends, "done").alias("status")))


# --- lists of the read side -------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT a.urn, permalink, followers, CASE WHEN followers % 3 > 0 THEN CASE WHEN followers % 5 = 0 THEN 0 ELSE followers + 1 END END AS live,
      CASE WHEN followers % 3 = 1 THEN 'u' || followers WHEN followers % 3 = 2 THEN ' ' END AS username, CASE WHEN followers % 3 = 2 AND followers % 2 = 0 THEN 'Full' END AS full_name FROM artists a)
    SELECT urn, coalesce(nullif(live, 0), followers) AS followers, coalesce(CASE WHEN trim(username) <> '' THEN username END, full_name, permalink, urn) AS name FROM r""")
def q18_roster_resolve(spark, d):
    """Every account with what a live profile says, where it says more."""
    a = v(spark, d, "artists").select("urn", "permalink", "followers")
    n = F.col("followers")
    live = a.where("followers % 3 > 0").select(
        "urn", F.when(n % 3 == 1, F.concat(F.lit("u"), n)).otherwise(" ").alias("username"), F.when((n % 3 == 2) & (n % 2 == 0), "Full").alias("full_name"), F.when(n % 5 == 0, 0).otherwise(n + 1).alias("followers")
    )
    return browse.resolved(a, live).select("urn", "followers", "name")


@query("""WITH f AS (SELECT DISTINCT src, dst FROM edges WHERE type = 'follow' AND src <> dst), big AS (SELECT urn FROM artists WHERE followers > 9000),
    n AS (SELECT dst, src, row_number() OVER (PARTITION BY dst ORDER BY src) AS k FROM f),
    o AS (SELECT src AS urn, dst AS friend FROM f WHERE src IN (SELECT urn FROM big) UNION ALL
      SELECT f.src, f.dst FROM f JOIN n ON n.dst = f.src AND n.src = f.dst AND k <= 25 WHERE f.src NOT IN (SELECT urn FROM big))
    SELECT urn, CAST(place AS INTEGER) AS place, friend FROM (SELECT *, row_number() OVER (PARTITION BY urn ORDER BY friend) AS place FROM o) x WHERE place <= 12""")
def q15_friends(spark, d):
    """The friends of every account: followings of the largest, mutual follows of the others."""
    return browse.friends(v(spark, d, "edges").where("type = 'follow'"), v(spark, d, "artists"), big=9000, scan=25, most=12)


#: Line items as tracks of the customers of one genre, some of which cannot be played.
SCOPE = """SELECT concat('customer:', o_custkey) AS urn, l_orderkey * 10 + l_linenumber AS {at}, l_partkey AS track, l_quantity % 3 <> 0 AS playable FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"""


@query(f"""WITH {MEMBERS}, r AS (SELECT a.urn, row_number() OVER (ORDER BY followers DESC, a.urn) AS rank FROM artists a JOIN m ON m.urn = a.urn WHERE fold = 'brand12'),
    t AS (SELECT x.*, rank, row_number() OVER (PARTITION BY x.urn ORDER BY pos, track) AS seen FROM ({SCOPE.replace('{at}', 'pos').replace('{', '').replace('}', '')}) x JOIN r ON r.urn = x.urn WHERE rank <= 8),
    p AS (SELECT *, row_number() OVER (PARTITION BY urn ORDER BY pos, track) AS round FROM t WHERE seen <= 50 AND playable),
    o AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY round, rank) AS n FROM p WHERE round <= 4)
    SELECT CAST(row_number() OVER (ORDER BY round, rank) AS INTEGER) AS place, urn, track FROM o WHERE n = 1 QUALIFY place <= 40""")
def q13_scope_queue(spark, d):
    """The queue of one genre: the first playable tracks of its eight leading artists, in turn."""
    mine = rollup.memberships(v(spark, d, "terms")).where("fold = 'brand12'").select("urn")
    roster = browse.foremost(v(spark, d, "artists").join(mine, "urn", "left_semi"), 8, F.desc("followers"), "urn").select("urn", F.col("place").alias("rank"))
    tracks = spark.sql(SCOPE.replace("{at}", "at"), lineitem=table(spark, d, "lineitem"), orders=table(spark, d, "orders"))
    return browse.scope_queue(roster, tracks)


@query(f"""WITH {MEMBERS}, s AS (SELECT urn, fold, row_number() OVER (PARTITION BY urn ORDER BY evidence DESC, fold) AS n FROM m),
    r AS (SELECT fold, a.urn, row_number() OVER (PARTITION BY fold ORDER BY followers DESC, likes + comments DESC, plays DESC, a.urn) AS rank FROM s JOIN artists a ON a.urn = s.urn WHERE n <= 2)
    SELECT fold, string_agg(urn, ',' ORDER BY rank) AS covers FROM r WHERE rank <= 20 GROUP BY fold""")
def k11_covers(spark, d):
    """The accounts on every genre's cover."""
    roster = rollup.roster(v(spark, d, "terms"), v(spark, d, "artists"), rollup.Config(roster_size=24))
    return browse.covers(roster).select("fold", F.array_join("covers", ",").alias("covers"))


@query(f"""WITH {MEMBERS}, {CITY}, p AS (SELECT 'genres' AS part, 6 AS most, fold AS name, count(*) AS n FROM m GROUP BY fold UNION ALL SELECT 'scenes', 12, segment, count(*) FROM artists WHERE segment IS NOT NULL GROUP BY segment
    UNION ALL SELECT 'cities', 9, city, count(*) FROM c WHERE city <> '' GROUP BY city), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY part ORDER BY n DESC, name) AS INTEGER) AS place FROM p)
    SELECT part, place, name, n, place <= most AS shown FROM r WHERE place <= most + 30""")
def k10_home(spark, d):
    """The front page: the largest genres, scenes and cities, and those behind them."""
    a = v(spark, d, "artists")
    n = lambda df, c: df.groupBy(c).agg(F.count("*").alias("n"))
    return browse.home({
        "genres": (n(rollup.memberships(v(spark, d, "terms")), "fold"), "fold", 6), "scenes": (n(a.where("segment is not null"), "segment"), "segment", 12), "cities": (n(rollup.city_of(a), "city"), "city", 9),
    })


@query("""WITH o AS (SELECT DISTINCT p_type AS collection, p_name AS id FROM part WHERE p_size > 10), n AS (SELECT DISTINCT p_type AS collection, p_name AS id FROM part WHERE p_size <= 25)
    SELECT coalesce(o.collection, n.collection) AS collection, count(CASE WHEN o.id IS NULL THEN 1 END) AS new, count(CASE WHEN n.id IS NULL THEN 1 END) AS removed
    FROM o FULL JOIN n ON o.collection = n.collection AND o.id = n.id GROUP BY 1""")
def x5_new_and_removed(spark, d):
    """How many names of each type came and went between two states."""
    p = table(spark, d, "part").select(F.col("p_type").alias("collection"), F.col("p_name").alias("id"), "p_size")
    return browse.changes(p.where("p_size > 10").drop("p_size"), p.where("p_size <= 25").drop("p_size"))


@query("""WITH f AS (SELECT dst AS urn, src AS follower, followers FROM edges e JOIN artists a ON a.urn = e.src WHERE type = 'follow')
    SELECT urn, CAST(place AS INTEGER) AS place, follower FROM (SELECT *, row_number() OVER (PARTITION BY urn ORDER BY followers DESC, follower) AS place FROM f) x WHERE place <= 10""")
def k8_followers_by_reach(spark, d):
    """The ten widest known followers of every account."""
    f = v(spark, d, "edges").where("type = 'follow'").select(F.col("dst").alias("urn"), F.col("src").alias("follower"))
    told = f.join(v(spark, d, "artists").select(F.col("urn").alias("follower"), "followers"), "follower")
    return browse.first(told, 10, F.desc("followers"), "follower", by=["urn"]).select("urn", "place", "follower")


@query(f"SELECT o_orderkey, epoch(TIMESTAMP '{NOW}') - epoch(o_orderdate) < 86400 AS fresh FROM orders")
def f9_within_last_day(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.within_last_day(F.col("o_orderdate"), F.lit(NOW).cast("timestamp")).alias("fresh"))


CANON = "SELECT urn, concat(city_raw, ', ', country) AS city_raw, country FROM {artists}"


@query(f"""WITH c AS (SELECT urn, CASE city_raw WHEN 'NATION_3' THEN 'Nation_4' WHEN 'NATION_7' THEN 'New Place' ELSE city_raw END AS spelling, country FROM artists WHERE city_raw NOT IN ('NATION_5', 'NATION_6')),
    n AS (SELECT {FOLD.format('spelling')} AS city, count(*) AS artist_count FROM c GROUP BY 1 HAVING count(*) >= 2),
    k AS (SELECT {FOLD.format('spelling')} AS city, country FROM c GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY {FOLD.format('spelling')} ORDER BY count(*) DESC, country) = 1)
    SELECT n.city, country, artist_count FROM n JOIN k ON k.city = n.city""")
def ag5_canon_cities(spark, d):
    """Cities behind commas, by a canon of other names and of what is no place."""
    a = spark.sql(CANON, artists=v(spark, d, "artists"))
    raw = table(spark, d, "nation").select("n_name")
    aliases = raw.where("n_name in ('NATION_3', 'NATION_7')").select(T.fold_term(F.col("n_name")).alias("fold"), F.when(F.col("n_name") == "NATION_3", "Nation_4").otherwise("New Place").alias("city"))
    none = raw.where("n_name in ('NATION_5', 'NATION_6')").select(T.fold_term(F.col("n_name")).alias("fold"))
    return rollup.cities(a, none=none, aliases=aliases).select("city", "country", "artist_count")


# --- crawls and caches, small ones ------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT c_custkey AS urn, CASE WHEN c_custkey % 4 = 0 THEN c_custkey * 20 END AS before FROM customer), v AS (SELECT o_custkey AS urn, max(o_orderkey) AS last FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
    SELECT a.urn, greatest(before, last) AS crawled_at, coalesce(before, last) IS NOT NULL AS crawled FROM a LEFT JOIN v ON v.urn = a.urn""")
def u4_mark_crawled(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("urn"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_custkey") * 20).alias("crawled_at"))
    visits = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("urn"), F.col("o_orderkey").alias("at"))
    return merge.mark_crawled(a, visits).select("urn", "crawled_at", "crawled")


@query("""SELECT user_id AS run, min(CASE WHEN event_type = 'click' THEN event_id END) AS started, max(CASE WHEN event_type = 'purchase' THEN event_id END) AS finished,
    CAST(arg_max(CAST(floor(value) AS BIGINT), event_id) FILTER (event_type = 'purchase') AS BIGINT) AS visited FROM events GROUP BY 1""")
def u15_runs(spark, d):
    kind = F.when(F.col("event_type") == "click", "start").when(F.col("event_type") == "purchase", "finish")
    return merge.merge_runs(table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("at"), kind.alias("kind"), F.floor("value").cast("long").alias("visited")))


@query("""SELECT 'tracks:' || o_custkey || ':' || size AS key, least(size, count(*)) AS items, 259200000 AS ttl FROM orders, (VALUES (5), (200)) s(size) GROUP BY o_custkey, size""")
def c7_seeded_lists(spark, d):
    """Every account's list under the keys of both sizes that pages ask for."""
    lists = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("items"), F.max("o_orderkey").alias("at"))
    n = F.json_array_length(F.get_json_object("value", "$.collection")).cast("long")
    return cache.seeded(lists, "tracks", (5, 200)).select("key", n.alias("items"), F.col("ttl").cast("int").alias("ttl"))


# --- sightings, stores and gates --------------------------------------------------------------------------------------


@query("SELECT DISTINCT page_id % 50 AS urn, url FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'ftp:' || url ELSE regexp_replace(url, '[?].*$', '') END AS url FROM pages) WHERE starts_with(url, 'http')")
def u19_purchase_links(spark, d):
    url = F.when(F.col("page_id") % 4 == 1, F.concat(F.lit("ftp:"), "url")).when(F.col("page_id") % 4 > 1, F.regexp_replace("url", "[?].*$", ""))
    return extract.purchase_links(table(spark, d, "pages").select((F.col("page_id") % 50).alias("urn"), url.alias("purchase_url")))


@query("""WITH v AS (SELECT urn, followers % 4 AS depth FROM artists WHERE followers % 3 = 0), f AS (SELECT src, dst, type, row_number() OVER (PARTITION BY src, type ORDER BY dst) AS n FROM edges)
    SELECT dst AS urn, min(depth) + 1 AS depth FROM v JOIN f ON f.src = v.urn WHERE depth < 3 AND (type = 'repost' OR n <= 8) GROUP BY dst""")
def u24_visit_policy(spark, d):
    """What a round of visits puts into the queue."""
    visited = v(spark, d, "artists").where("followers % 3 = 0").select("urn", (F.col("followers") % 4).alias("depth"))
    return extract.next_visits(visited, v(spark, d, "edges"), 3, followings=8)


@query(f"""WITH {MEMBERS}, r AS (SELECT last_upload_at AS t FROM m JOIN artists a ON a.urn = m.urn WHERE fold = 'brand12')
    SELECT count(CASE WHEN t > TIMESTAMP '{NOW}' - INTERVAL 1 DAY THEN 1 END) AS day, count(CASE WHEN t > TIMESTAMP '{NOW}' - INTERVAL 7 DAY THEN 1 END) AS week FROM r""")
def a3_activity_of_one(spark, d):
    return rollup.activity_of(rollup.memberships(v(spark, d, "terms")), v(spark, d, "artists"), "fold", "brand12", F.lit(NOW).cast("timestamp"))


@query(f"""WITH {MEMBERS}, {CITY}, n AS (SELECT city, count(*) AS artist_count FROM c GROUP BY city HAVING count(*) >= 2),
    t AS (SELECT fold, c.city, count(DISTINCT m.urn) AS members FROM m JOIN c ON m.urn = c.urn GROUP BY 1, 2)
    SELECT fold, t.city, members, artist_count FROM t JOIN n ON n.city = t.city""")
def j3_genres_in_cities(spark, d):
    """Every genre in every city that has a page, with the city's own size."""
    a = v(spark, d, "artists")
    tab = rollup.cross_tab(v(spark, d, "terms"), a).withColumnRenamed("artist_count", "members")
    return tab.join(rollup.cities(a).select("city", "artist_count"), "city").select("fold", "city", "members", "artist_count")


@query("""WITH s AS (SELECT c_mktsegment || '/' || c_nationkey AS scene, count(*) AS crawled FROM customer GROUP BY 1) SELECT scene AS name, crawled FROM s WHERE crawled >= 12""")
def p6_named_only(spark, d):
    """Scenes that have a name: those below the floor have theirs withheld and are read by no page."""
    c = table(spark, d, "customer").select(F.concat_ws("/", "c_mktsegment", "c_nationkey").alias("name"))
    return tracks.named_scenes(c.groupBy("name").agg(F.count("*").alias("crawled")), 12).where("name is not null").select("name", "crawled")


@query("SELECT urn, permalink, followers FROM artists WHERE urn IN (SELECT 'customer:' || o_custkey FROM orders WHERE o_totalprice > 400000)")
def p12_in_list(spark, d):
    """The accounts of a list of urns, which may be long: it is joined, and sent along where it is small."""
    urns = table(spark, d, "orders").where("o_totalprice > 400000").select(F.concat(F.lit("customer:"), "o_custkey").alias("urn"))
    return v(spark, d, "artists").join(urns, "urn", "left_semi").select("urn", "permalink", "followers")


@query("SELECT urn, permalink, followers, last_upload_at, CAST(NULL AS BIGINT) AS likes_total FROM artists WHERE followers % 2 = 0")
def s6_snapshot_round_trip(spark, d):
    """Accounts written as a run's snapshot and read back line by line, with a column that the store got later."""
    path = files.write_snapshot({"artists": v(spark, d, "artists").where("followers % 2 = 0").select("urn", "permalink", "followers", "last_upload_at")}, scratch(spark), 1)
    rows = files.read_lines(spark, f"{path}/artists.ndjson", "urn string, permalink string, followers long, last_upload_at timestamp_ntz", "urn")
    return files.with_columns_of(rows, "urn string, likes_total bigint")
