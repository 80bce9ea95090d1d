"""Queries of free text, pages and raw records."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenewright.catalog import FOLD, query, v
from scenewright.operators import browse, entities, hubs, records, rollup, search


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def sql(spark, d, text, *names):
    return spark.sql(text, **{t: table(spark, d, t) for t in names})


def plain(text):
    return text.replace("{string}", "VARCHAR").replace("{", "").replace("}", "")


def spark_text(text):
    return text.replace("{string}", "STRING")


# --- free text and pages ----------------------------------------------------------------------------------------------


@query()
def f19_entities(spark, d):
    """Links, mentions and mail addresses of every document, in order; held against plain matching by a test."""
    told = table(spark, d, "documents").select("doc_id", entities.entities(F.col("text")).alias("e"))
    n = lambda kind: F.size(F.filter("e", lambda x: x["kind"] == kind)).alias(f"n_{kind}")
    spans = F.array_join(F.transform("e", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return told.select("doc_id", n("url"), n("mention"), n("email"), spans.alias("spans"))


#: Pages as tracks: some addresses lead to shops.
SHOPS = """SELECT page_id, CASE page_id % 5 WHEN 0 THEN replace(url, 'example', 'Bandcamp') WHEN 1 THEN '' END AS purchase_url,
  CASE page_id % 3 WHEN 0 THEN replace(url, 'example', 'beatport') WHEN 1 THEN replace(url, 'example', 'bandcamp') END AS download_url,
  CASE page_id % 4 WHEN 0 THEN concat('at ', replace(url, 'example', 'hypeddit'), ' or ', replace(url, 'example', 'beatport'), ' now') WHEN 1 THEN 'nowhere' END AS description,
  page_id * 7919 % 2000000 AS duration, url FROM {pages}"""


@query(f"""WITH t AS ({plain(SHOPS)}),
  u AS (SELECT page_id, 1 AS pos, purchase_url AS u FROM t UNION ALL SELECT page_id, 2, download_url FROM t
    UNION ALL SELECT page_id, 2 + i, x[i] FROM (SELECT page_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(coalesce(description, ''), 'https?://\\S+') AS x FROM t) y) z),
  p AS (SELECT *, CASE WHEN contains(lower(u), 'bandcamp.com') THEN 'Bandcamp' WHEN contains(lower(u), 'hypeddit.com') THEN 'Hypeddit' WHEN contains(lower(u), 'beatport.com') THEN 'Beatport' END AS platform FROM u),
  f AS (SELECT page_id, platform, u, pos FROM p WHERE platform IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id, platform ORDER BY pos) = 1),
  l AS (SELECT page_id, string_agg(platform || ' ' || u, ', ' ORDER BY pos) AS links FROM f GROUP BY page_id)
  SELECT t.page_id, coalesce(links, CASE WHEN duration > 900000 THEN 'Home ' || url END, '') AS links FROM t LEFT JOIN l ON l.page_id = t.page_id""")
def f18_link_platforms(spark, d):
    """The first address of each shop that a track leads to, over all pages."""
    t = sql(spark, d, spark_text(SHOPS), "pages")
    links = entities.external_links(F.col("purchase_url"), F.col("download_url"), F.col("description"), F.col("duration"), F.col("url"))
    return t.select("page_id", F.array_join(F.transform(links, lambda x: F.concat_ws(" ", x["platform"], x["url"])), ", ").alias("links"))


#: Pages with an object embedded behind their own scripts; some lack it, some have a broken one or a wrong field.
HYDRATED = """SELECT page_id, CASE page_id % 9 WHEN 4 THEN html ELSE concat(html, '<script>window.__data = [{{"hydratable":"anonymousId","data":"x"}},', CASE page_id % 9 WHEN 5 THEN '{{"hydratable":"sound"}}'
    ELSE concat('{{"hydratable":"user","data":{{"id":', CASE page_id % 9 WHEN 6 THEN '"7"' ELSE CAST(page_id AS {string}) END, ',"permalink":"', CAST(page_id % 31 AS {string}), '","username":', CASE page_id % 9 WHEN 7 THEN 'null' ELSE '"ü & ]<b>"' END,
      ',"followers_count":', CAST(page_id * 3 AS {string}), CASE page_id % 9 WHEN 8 THEN '' ELSE '}}}}' END) END, '];</script></html>') END AS html FROM {pages}"""


@query("""SELECT page_id, page_id % 9 < 4 AS valid, CASE WHEN page_id % 9 < 4 THEN page_id END AS id, CASE WHEN page_id % 9 < 4 THEN CAST(page_id % 31 AS VARCHAR) END AS permalink,
    CASE WHEN page_id % 9 < 4 THEN 'ü & ]<b>' END AS username, CASE WHEN page_id % 9 < 4 THEN page_id * 3 END AS followers_count FROM pages""")
def s12_page_hydration(spark, d):
    """The user embedded in every page, and which pages have no valid one."""
    pages = spark.sql(spark_text(HYDRATED), pages=table(spark, d, "pages"))
    return pages.select("page_id", entities.hydrated_user(F.col("html"), "window.__data").alias("u")).select("page_id", F.col("u").isNotNull().alias("valid"), "u.id", "u.permalink", "u.username", "u.followers_count")


#: Profiles: descriptions of institutions and of musicians, plain and in styled letters.
PROFILES = """SELECT p_partkey, element_at(array('Independent radio from Leeds', 'I make music', '𝗠𝘂𝘀𝗶𝗰 𝗽𝗹𝗮𝘁𝗳𝗼𝗿𝗺', 'our record label', 'Ｗｅｂｚｉｎｅ', 'label mates with no one', 'nightclubs', 'a nightclub', ''), CAST(p_partkey % 9 + 1 AS INT)) AS description,
  element_at(array('x', '𝕏 ℝ𝕖𝕔𝕠𝕣𝕕𝕤', 'Someone [ours] tapes', concat(p_name, ' fm')), CAST(p_size % 4 + 1 AS INT)) AS name FROM {part}"""


@query("SELECT p_partkey, p_partkey % 9 IN (0, 2, 3, 4, 7) AS described, p_size % 4 IN (1, 3) AS named FROM part")
def h2_profile_text(spark, d):
    """Which profiles speak of an institution, by description and by name, whatever letters they use."""
    return sql(spark, d, PROFILES, "part").select("p_partkey", hubs.described_as_hub(F.col("description")).alias("described"), hubs.named_as_hub(F.col("name")).alias("named"))


#: Titles of customers: some name many others, some themselves, some nobody.
TITLES = """SELECT concat('customer:', CAST(o_custkey AS {string})) AS urn, CASE o_custkey % 3 WHEN 0 THEN concat('Artist ', CAST((2 * o_orderkey + n) % 40 AS {string}), ' - Song') WHEN 1 THEN concat('Me ', CAST(o_orderkey % 3 AS {string}), ' – Song') ELSE 'Song' END AS title
  FROM {orders} JOIN (SELECT 1 AS n UNION ALL SELECT 2) x ON true"""


@query(f"""WITH t AS ({plain(TITLES)}), c AS (SELECT urn FROM t WHERE title <> 'Song' GROUP BY urn
    HAVING count(*) >= 10 AND count(DISTINCT CASE WHEN title LIKE 'Artist%' THEN lower(split_part(title, ' - ', 1)) ELSE lower(split_part(title, ' – ', 1)) END) >= 15
      AND count(DISTINCT CASE WHEN title LIKE 'Artist%' THEN lower(split_part(title, ' - ', 1)) ELSE lower(split_part(title, ' – ', 1)) END) / count(*) >= 0.7)
  SELECT a.urn, CASE WHEN a.urn LIKE '%77' THEN 'artist' WHEN a.urn LIKE '%78' OR a.urn IN (SELECT urn FROM c) OR a.urn LIKE '%3' THEN 'hub' ELSE 'artist' END AS account_kind FROM artists a""")
def h5_classified(spark, d):
    """The kind of every account by lists, counts, profiles and titles together."""
    a = v(spark, d, "artists").select("urn", "permalink", "track_count")
    lists = [a.where(f"urn like '%{n}'").select(F.lit(kind).alias("kind"), F.lower("permalink").alias("name")) for n, kind in ((77, "artist"), (78, "hub"))]
    profiles = a.select("urn", F.lit(None).cast("string").alias("username"), F.when(F.endswith("urn", F.lit("3")), "we are an 𝗶𝗻𝗱𝗲𝗽𝗲𝗻𝗱𝗲𝗻𝘁 𝗿𝗮𝗱𝗶𝗼").alias("description"))
    titles = spark.sql(spark_text(TITLES), orders=table(spark, d, "orders"))
    return hubs.classified(a, profiles, titles, lists[0].unionByName(lists[1])).select("urn", "account_kind")


# --- terms and their fates --------------------------------------------------------------------------------------------

SPOKEN = """SELECT urn, term, kind, evidence FROM {terms} UNION ALL SELECT urn, city_raw, 'tag', 3 FROM {artists} WHERE followers % 3 = 0
  UNION ALL SELECT urn, CASE WHEN followers % 2 = 0 THEN 'Podcast' ELSE '2024' END, 'genre', 1 FROM {artists} WHERE followers % 7 = 0
  UNION ALL SELECT concat('customer:', CAST(1 AS {string})), permalink, 'genre', 1 FROM {artists} WHERE account_kind = 'hub'"""


@query(f"""WITH s AS ({plain(SPOKEN)}), n AS (SELECT {FOLD.format('term')} AS fold, count(DISTINCT urn) AS artists FROM s WHERE kind = 'genre' OR evidence >= 2 GROUP BY 1)
  SELECT fold, artists, CASE WHEN regexp_matches(fold, '^[0-9]+$') OR fold IN ({', '.join(repr(x) for x in rollup.FORMAT_TERMS)}) THEN 'format' WHEN fold IN (SELECT {FOLD.format('city_raw')} FROM artists) THEN 'city'
    WHEN fold IN (SELECT {FOLD.format('permalink')} FROM artists WHERE account_kind = 'hub') THEN 'hub' WHEN artists >= 2 THEN 'kept' ELSE 'below' END AS fate FROM n WHERE fold <> ''""")
def ag3_term_fates(spark, d):
    """Every term with what became of it: kept, below the floor, or why it is no genre."""
    artists = v(spark, d, "artists")
    said = spark.sql(spark_text(SPOKEN), terms=v(spark, d, "terms"), artists=artists)
    return rollup.term_report(said, artists)


# --- raw records ------------------------------------------------------------------------------------------------------

LINES = """SELECT o_orderkey, o_custkey, o_orderpriority, l_linenumber, l_partkey, l_quantity, p_name, p_size FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {part} ON p_partkey = l_partkey"""


def raw_playlists(spark, d):
    """Orders as JSON of raw playlists: of some tracks only the number is there, of some not even that."""
    lines = sql(spark, d, LINES, "orders", "lineitem", "part")
    stub = F.col("l_linenumber") % 2 == 0
    there = lambda c: F.when(~stub, F.col(c))
    one = F.struct(
        F.when(F.col("l_linenumber") != 3, F.col("l_partkey")).alias("id"), F.when(F.col("l_linenumber") == 3, F.concat(F.lit("x:"), "l_partkey")).alias("urn"), there("p_name").alias("title"),
        there("p_size").alias("duration"), F.col("l_quantity").cast("long").alias("playback_count"), F.when(~stub, F.struct(F.lit(1).alias("id"), F.lit("me").alias("username"))).alias("user"),
    )
    kind = F.when(F.startswith("o_orderpriority", F.lit("1")), "ALBUM").when(F.startswith("o_orderpriority", F.lit("2")), "Ep").when(F.startswith("o_orderpriority", F.lit("3")), "PLAYLIST")
    lists = lines.groupBy("o_orderkey", kind.alias("playlist_type")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", one.alias("t")))).alias("t"))
    return lines, lists.select(F.to_json(F.struct(F.concat(F.lit("playlist:"), "o_orderkey").alias("urn"), "playlist_type", F.transform("t", lambda x: x["t"]).alias("tracks"))).alias("value"))


@query("""WITH t AS (SELECT o_orderkey, l_linenumber, l_partkey, o_orderpriority, CAST(l_quantity AS BIGINT) AS plays, CASE WHEN l_linenumber % 2 = 0 AND l_partkey % 5 = 0 THEN NULL ELSE p_name END AS title FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
    WHERE l_partkey <> 0),
  a AS (SELECT DISTINCT o_orderkey, o_orderpriority FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey)
  SELECT a.o_orderkey AS id, CASE left(a.o_orderpriority, 1) WHEN '1' THEN 'album' WHEN '2' THEN 'ep' WHEN '3' THEN 'playlist' END AS set_type, left(a.o_orderpriority, 1) IN ('1', '2') AS is_album,
    coalesce(string_agg(l_partkey || ' ' || title, ', ' ORDER BY l_linenumber, l_partkey) FILTER (title IS NOT NULL), '') AS tracks
  FROM a LEFT JOIN t ON t.o_orderkey = a.o_orderkey GROUP BY ALL""")
def u26_completed_playlists(spark, d):
    """Raw playlists read from JSON, their gaps filled from known tracks, in the order that they had."""
    lines, raw = raw_playlists(spark, d)
    lists = raw.select(records.playlist(records.read_json(F.col("value"), "playlist")).alias("p")).select("p.*")
    known = table(spark, d, "part").where("p_partkey % 5 <> 0")
    known = known.select(F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_size").alias("duration"))).alias("value"))
    known = known.select(records.track(records.read_json(F.col("value"), "track")).alias("track")).select("track.id", "track")
    full = records.completed(lists, known)
    return full.select("id", "set_type", "is_album", F.array_join(F.transform("tracks", lambda t: F.concat_ws(" ", t["id"].cast("string"), t["title"])), ", ").alias("tracks"))


@query("""SELECT o_orderkey AS id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS plays FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE left(o_orderpriority, 1) IN ('1', '2') GROUP BY 1""")
def a21_album_plays(spark, d):
    """What every album's tracks were played together; playlists that are none are left out."""
    raw = raw_playlists(spark, d)[1]
    lists = raw.select(records.playlist(records.read_json(F.col("value"), "playlist")).alias("p")).select("p.*")
    return lists.where("is_album").select("id", records.total_plays(F.col("tracks")).alias("plays"))


@query("""SELECT 'user:' || o_custkey AS urn, CAST(sum(o_orderkey % 100) AS BIGINT) AS plays, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 2 END) AS BIGINT) AS likes, CAST(0 AS BIGINT) AS comments
    FROM orders WHERE o_custkey % 2 = 0 AND o_orderkey <> 0 GROUP BY 1""")
def s15_cached_engagement(spark, d):
    """Engagement of half of the accounts from retained cache rows, which repeat tracks."""
    o = table(spark, d, "orders")
    one = F.struct(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 100).alias("playback_count"), F.when(F.col("o_orderstatus") != "F", 2).alias("favoritings_count"), F.struct(F.col("o_custkey").alias("id")).alias("user"))
    lists = o.select("o_custkey", F.explode(F.array(F.col("o_orderkey") % 3, F.lit(7))).alias("page"), one.alias("t")).groupBy("o_custkey", "page").agg(F.to_json(F.collect_list("t")).alias("value"))
    broken = o.select(F.lit("{no list").alias("value")).limit(1)
    artists = o.where("o_custkey % 2 = 0").select(records.urn("user", F.col("o_custkey")).alias("urn"))
    return records.engagement_of_cache(lists.select("value").unionByName(broken), artists)


#: Every country's page: three lists of its accounts, which overlap.
CARDS = """SELECT country AS page, g AS {group}, CAST(row_number() OVER (PARTITION BY country, g ORDER BY score DESC, urn) - 1 AS BIGINT) AS {at}, urn FROM (
  SELECT country, 1 AS g, followers AS score, urn FROM {artists} UNION ALL SELECT country, 2, plays, urn FROM {artists} UNION ALL SELECT country, 3, likes, urn FROM {artists}) x"""


@query(f"""WITH g AS ({CARDS.replace('{artists}', 'artists').replace('{group}', 'grp').replace('{at}', 'pos')}), f AS (SELECT page, urn, min(pos * 10 + grp) AS first FROM g GROUP BY page, urn),
    o AS (SELECT page, urn, CAST(row_number() OVER (PARTITION BY page ORDER BY first) AS INTEGER) AS place FROM f), m AS (SELECT o.*, CASE WHEN followers % 2 = 0 THEN permalink END AS avatar, followers % 2 <> 0 AS missed FROM o JOIN artists a ON a.urn = o.urn)
    SELECT page, place, urn, avatar, missed AND row_number() OVER (PARTITION BY page, missed ORDER BY place) <= 40 AS ask FROM m""")
def x9_q19_avatar_map(spark, d):
    """The accounts of three overlapping lists in turn, each once, with cached images and which gaps are asked for."""
    a = v(spark, d, "artists")
    groups = spark.sql(CARDS.replace("{group}", "`group`").replace("{at}", "at"), artists=a)
    return records.avatars(records.interleaved(groups), a.where("followers % 2 = 0").select("urn", F.col("permalink").alias("avatar_url")), budget=40)


@query("""WITH l AS (SELECT o_custkey AS id, list(o_orderkey ORDER BY o_orderkey) AS items FROM orders GROUP BY o_custkey)
    SELECT id, array_to_string(CASE WHEN id % 12 < len(items) THEN list_concat(items[id % 12 + 1:], items[1:id % 12]) ELSE items END, ',') AS items FROM l""")
def k14_from_clicked(spark, d):
    """Every account's list from the item on that was clicked."""
    lists = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("items"))
    return lists.select("id", F.array_join(records.from_clicked(F.col("items"), (F.col("id") % 12).cast("int")).cast("array<string>"), ",").alias("items"))


# --- small lists ------------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey AS id, CAST(count(CASE WHEN l_linenumber % 2 = 1 AND l_partkey <> 0 THEN 1 END) AS INTEGER) AS valid FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def p2_valid_tracks(spark, d):
    """How many of every playlist's tracks have an id and a title."""
    lists = raw_playlists(spark, d)[1].select(records.playlist(records.read_json(F.col("value"), "playlist")).alias("p")).select("p.*")
    return lists.select("id", F.size(records.valid_tracks(F.col("tracks"))).alias("valid"))


@query("""WITH l AS (SELECT o_custkey AS id, list(o_orderkey ORDER BY o_orderkey) AS a, list(o_orderkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders GROUP BY o_custkey) SELECT id, a <> b AS changed FROM l""")
def x8_order_changed(spark, d):
    """Whether a list shows the same items in another order."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("a"), F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("b"))
    return o.select("id", (F.col("a") != F.transform("b", lambda x: x["o_orderkey"])).alias("changed"))


@query("""SELECT 'user' AS kind, c_custkey AS id, c_name AS title, c_acctbal > 9000 AS listed FROM customer WHERE contains(lower(c_name), '77') UNION ALL SELECT 'track', p_partkey, p_name, p_size > 40 FROM part WHERE contains(lower(p_name), '77') OR contains(lower(p_brand), '#17')
    UNION ALL SELECT 'album', o_orderkey, o_orderpriority, false FROM orders WHERE contains(CAST(o_orderkey AS VARCHAR), '77') AND o_orderpriority = '1-URGENT'""")
def r6_federated_search(spark, d):
    """Users, tracks and albums that match, as one list of kinds."""
    users = table(spark, d, "customer").where("contains(lower(c_name), '77')").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), (F.col("c_acctbal") > 9000).alias("listed"))
    tracks = table(spark, d, "part").where("contains(lower(p_name), '77') or contains(lower(p_brand), '#17')").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), (F.col("p_size") > 40).alias("listed"))
    lists = table(spark, d, "orders").where("contains(cast(o_orderkey as string), '77')").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.lit(False).alias("listed"), (F.col("o_orderpriority") == "1-URGENT").alias("is_album")
    )
    return search.federated(users, tracks, lists, "albums").unionByName(search.federated(users, tracks, lists, "users")).unionByName(search.federated(users, tracks, lists, "tracks"))


@query("""WITH s AS (SELECT c_mktsegment || '/' || c_nationkey AS scene, min(c_custkey) AS least, count(*) AS members FROM customer GROUP BY 1)
    SELECT scene, members, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (ORDER BY members DESC, least) AS place FROM s) x WHERE place <= 20""")
def k5_k6_largest_scenes(spark, d):
    """The twenty largest scenes; of equal ones the one of the least member comes first."""
    c = table(spark, d, "customer").select(F.concat_ws("/", "c_mktsegment", "c_nationkey").alias("scene"), "c_custkey")
    sizes = c.groupBy("scene").agg(F.count("*").alias("members"), F.min("c_custkey").alias("least"))
    return browse.foremost(sizes, 20, F.desc("members"), "least").select("scene", "members", "place")


#: Permalinks: words of parts, some with an institution's word at their end or elsewhere.
PERMALINKS = """SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN concat(replace(p_name, ' ', ''), 'Recs') WHEN 1 THEN concat('label-', replace(p_name, ' ', '')) WHEN 2 THEN concat(replace(p_name, ' ', '-'), '-radio')
  WHEN 3 THEN concat(replace(p_name, ' ', ''), 'media2') WHEN 4 THEN NULL WHEN 5 THEN concat(replace(p_name, ' ', ''), 'podcast') ELSE replace(p_name, ' ', '') END AS permalink FROM {part}"""


@query("SELECT p_partkey, p_partkey % 7 IN (0, 2, 5) AS hub FROM part")
def h3_permalink_rule(spark, d):
    """Which permalinks end in an institution's word."""
    return sql(spark, d, PERMALINKS, "part").select("p_partkey", hubs.permalink_of_hub(F.col("permalink")).alias("hub"))


@query(f"""WITH t AS ({plain(TITLES)}), p AS (SELECT urn, CASE WHEN title LIKE 'Artist%' THEN lower(split_part(title, ' - ', 1)) ELSE lower(split_part(title, ' – ', 1)) END AS p FROM t WHERE title <> 'Song')
  SELECT urn FROM p GROUP BY urn HAVING count(*) >= 10 AND count(DISTINCT p) >= 15 AND count(DISTINCT p) / count(*) >= 0.7""")
def h4_title_shapes(spark, d):
    """Channels by their titles, among accounts that name themselves, many others, or nobody."""
    return hubs.channels_by_titles(spark.sql(spark_text(TITLES), orders=table(spark, d, "orders")))
