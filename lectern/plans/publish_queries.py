"""Queries over what is written out and small report states, with their oracle SQL."""

from pyspark.sql import functions as F

from lectern.operators import order as O
from lectern.operators import points as PT
from lectern.operators import prices as P
from lectern.operators import publish as W

from . import adapters as A
from .adapters import oracle

Q, S = {}, {}


def entries(spark, d):
    b, h = A.books(spark, d), A.price_history(spark, d)
    return W.atom_entries(P.change_events(b, h).join(b.select("asin", F.concat("title", F.lit(" <&>")).alias("title")), "asin"))


Q["k02_atom_entries"] = lambda spark, d: entries(spark, d).where("kind in ('joined', 'left')")
S["k02_atom_entries"] = oracle("ph bk", """+nw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asin ORDER BY ts DESC, id DESC) AS r FROM ph) WHERE r <= 50), e AS (SELECT asin, ts, id, ku, lag(ku) OVER (PARTITION BY asin ORDER BY ts, id) AS was FROM nw WHERE ku OR price IS NOT NULL), g AS (SELECT asin, arg_max(ku, (ts, id)) AS now, max(CASE WHEN ku AND NOT was THEN ts END) AS j, max(CASE WHEN NOT ku AND was THEN ts END) AS l FROM e GROUP BY asin),
v AS (SELECT asin, 'joined' AS kind, j AS t FROM g WHERE now AND j IS NOT NULL UNION ALL SELECT asin, 'left', l FROM g WHERE NOT now AND l IS NOT NULL)
SELECT v.asin, kind, '<entry><id>tag:' || v.asin || ':' || kind || '</id><title>' || title || ' &lt;&amp;&gt;</title><updated>' || strftime(t, '%Y-%m-%dT%H:%M:%S+00:00') || '</updated></entry>' AS entry FROM v JOIN bk ON v.asin = bk.asin""")
Q["k06_book_markdown"] = lambda spark, d: W.book_markdown(A.highlights(spark, d).select("id", "book", "chapter", "location", "text")).select("book", F.md5("text").alias("h"))
S["k06_book_markdown"] = oracle("hl", "+c AS (SELECT book, chapter, min(location) AS f, '## ' || chapter || chr(10) || string_agg('- ' || text, chr(10) ORDER BY location, id) AS t FROM hl GROUP BY book, chapter) SELECT book, md5(string_agg(t, chr(10) || chr(10) ORDER BY f, chapter)) AS h FROM c GROUP BY book")
Q["k07_outline_markdown"] = lambda spark, d: W.outline_markdown(A.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("outline"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice").alias("pos"), (F.col("l_linenumber") == 1).alias("heading"), F.concat(F.lit("*"), F.col("l_partkey"), F.lit("*")).alias("text"))).select("outline", F.md5("text").alias("h"))
S["k07_outline_markdown"] = r"SELECT l_suppkey AS outline, md5(string_agg(CASE WHEN l_linenumber = 1 THEN '## ' ELSE '- ' END || '\*' || l_partkey || '\*', chr(10) ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice)) AS h FROM lineitem GROUP BY l_suppkey"
Q["k08_marks_export"] = lambda spark, d: W.marks_export(A.books(spark, d).select("asin", F.lit("want").alias("tag"), (F.col("asin") % 5).alias("rating"), F.filter(F.array(F.when(F.col("wanted"), "tag"), F.when(F.col("purchased"), "rating"), F.lit("other")), lambda x: x.isNotNull()).alias("touched")), ["tag", "rating"])
S["k08_marks_export"] = oracle("bk", """SELECT asin, '{' || CASE WHEN wanted AND purchased THEN '"tag":"want","rating":' || asin % 5 WHEN wanted THEN '"tag":"want"' ELSE '"rating":' || asin % 5 END || '}' AS item FROM bk WHERE wanted OR purchased""")
Q["x19_inbox_marks"] = lambda spark, d: W.inbox_marks(A.wishlist(spark, d).select(F.col("idx").alias("asin"), F.col("idx").alias("pos"), "title", F.when(F.col("wanted"), "seen").otherwise("want").alias("tag"), (F.col("idx") % 8).cast("int").alias("rating")), 500, 6)
S["x19_inbox_marks"] = oracle("wl", "SELECT idx AS asin, substr(title, 1, 6) AS title, CASE WHEN wanted THEN 'seen' ELSE 'want' END AS tag, CASE WHEN wanted AND idx % 8 BETWEEN 1 AND 5 THEN CAST(idx % 8 AS INTEGER) END AS rating FROM wl ORDER BY idx LIMIT 500")
Q["c21_price_text"] = lambda spark, d: A.wishlist(spark, d).select("idx", W.price_text(F.col("price"), F.col("ku"), F.when(F.col("idx") % 2 == 0, "gone")).alias("text"))
S["c21_price_text"] = oracle("wl", "SELECT idx, CASE WHEN ku THEN 'Kindle Unlimited' WHEN price IS NULL THEN 'no price' || CASE WHEN idx % 2 = 0 THEN ' (gone)' ELSE '' END ELSE '¥' || format('{:,}', CAST(trunc(price) AS BIGINT)) END AS text FROM wl")
Q["x25_result_kinds"] = lambda spark, d: A.read(spark, d, "events").groupBy(W.result_kind(F.when(F.col("value") > 20, F.col("value")), F.col("event_type") == "signup", F.col("event_type") == "error").alias("kind")).agg(F.count("*").alias("n"))
S["x25_result_kinds"] = "SELECT CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'signup' THEN 'unlimited' WHEN value > 20 THEN 'priced' ELSE 'unpriced' END AS kind, count(*) AS n FROM events GROUP BY 1"


def ticks(spark, d):
    e = A.read(spark, d, "events").select(F.col("user_id").alias("asin"), "ts", F.when(F.col("event_type") != "error", F.col("value")).alias("sell"), F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 9).alias("points"), (F.col("event_type") == "signup").alias("ku"), F.lit("no_price").alias("reason"))
    rows, why = W.price_ticks(e)
    return rows.select("asin", "ts", F.round("price", 2).alias("price"), F.lit("").alias("reason")).unionByName(why.select("asin", "ts", F.lit(None).cast("double").alias("price"), "reason"))


Q["x22_price_ticks"] = ticks
S["x22_price_ticks"] = "SELECT user_id AS asin, ts, CASE WHEN event_type NOT IN ('error', 'signup') THEN round(value - CASE WHEN event_id % 2 = 0 THEN event_id % 9 ELSE 0 END, 2) END AS price, '' AS reason FROM events UNION ALL SELECT user_id, ts, NULL, 'no_price' FROM events WHERE event_type = 'error' OR (value IS NULL AND event_type <> 'signup')"
Q["x12_freshness"] = lambda spark, d: W.freshness(A.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("name")).agg(F.min("l_shipdate").alias("created"), F.max(F.when(F.col("l_quantity") > 30, F.col("l_shipdate"))).alias("recommended")))
S["x12_freshness"] = "SELECT l_orderkey AS name, greatest(min(l_shipdate), max(CASE WHEN l_quantity > 30 THEN l_shipdate END)) AS fresh FROM lineitem GROUP BY l_orderkey"
Q["x15_assignments"] = lambda spark, d: W.assignments(A.read(spark, d, "events").select(F.col("user_id").alias("id"), F.struct("ts", "event_id").alias("at"), F.when(F.col("event_type") != "error", F.col("event_id") % 40).alias("line")))
S["x15_assignments"] = "SELECT user_id AS id, arg_max(CASE WHEN event_type <> 'error' THEN event_id % 40 ELSE -1 END, (ts, event_id)) AS line FROM events GROUP BY user_id HAVING line >= 0"
Q["x16_dismissed_sets"] = lambda spark, d: W.dismissed_sets(A.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("set")).agg(F.collect_list("l_partkey").alias("ids")), A.read(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") - F.col("p_partkey") % 3).alias("current")).where("id % 2 = 0")).select("set", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
S["x16_dismissed_sets"] = "WITH m AS (SELECT DISTINCT l_orderkey AS s, CASE WHEN l_partkey % 2 = 0 AND l_partkey IN (SELECT p_partkey FROM part) THEN l_partkey - l_partkey % 3 ELSE l_partkey END AS i FROM lineitem) SELECT s AS \"set\", string_agg(i, ',' ORDER BY i) AS ids FROM m GROUP BY s"
Q["x23_source_flags"] = lambda spark, d: W.flags_from_origin(A.books(spark, d).select("asin", F.when(F.col("asin") % 3 == 0, F.col("wanted")).alias("kindle"), F.lit(None).cast("boolean").alias("bookmeter"), F.when(F.col("asin") % 2 == 0, "s").alias("sample"), F.col("target").alias("reader_id")))
S["x23_source_flags"] = oracle("bk", "SELECT asin, CASE WHEN asin % 3 = 0 THEN wanted ELSE asin % 2 = 0 END AS kindle, target IS NOT NULL AS bookmeter FROM bk")
Q["x34_recommendation_notes"] = lambda spark, d: W.recommendation_note(A.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), F.when(F.col("l_quantity") > 20, F.col("l_partkey")).alias("asin"), F.when(F.col("l_returnflag") == "A", "verified").alias("state")))
S["x34_recommendation_notes"] = "SELECT l_orderkey AS run, CASE WHEN count(CASE WHEN l_quantity > 20 THEN 1 END) = 0 THEN 'empty' WHEN count(CASE WHEN l_returnflag = 'A' THEN 1 END) = 0 THEN 'unverified' END AS note FROM lineitem GROUP BY l_orderkey"
Q["x21_keyed_lookup"] = lambda spark, d: A.read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("asin")).join(A.books(spark, d).where("target is not null").select("asin", "target"), "asin").select("o_orderkey", "target")
S["x21_keyed_lookup"] = oracle("bk", "SELECT o_orderkey, target FROM orders JOIN bk ON o_custkey = asin WHERE target IS NOT NULL")
Q["x31_read_discoveries"] = lambda spark, d: A.read(spark, d, "orders").select(F.col("o_orderkey").alias("id")).join(A.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_shipdate").alias("read_at")), "id", "left").select("id", F.col("read_at").isNotNull().alias("read"))
S["x31_read_discoveries"] = "SELECT o_orderkey AS id, o_orderkey IN (SELECT l_orderkey FROM lineitem) AS read FROM orders"
Q["x11_analysis_counts"] = lambda spark, d: PT.pending(A.points(spark, d).select("id"), A.points(spark, d).where("id % 10 < 6"), A.points(spark, d).where("id % 10 = 7")).agg(F.count("*").alias("pending"))
S["x11_analysis_counts"] = "SELECT count(*) AS pending FROM embeddings WHERE vec_id % 10 >= 6 AND vec_id % 10 <> 7"
Q["o03_books_by_last"] = lambda spark, d: O.numbered(A.highlights(spark, d).groupBy("book").agg(F.max("location").alias("last")), [(F.col("last"), True), (F.col("book"), False)]).select("book", "pos")
S["o03_books_by_last"] = oracle("hl", "SELECT book, row_number() OVER (ORDER BY max(location) DESC, book) AS pos FROM hl GROUP BY book")
Q["o04_newest_first"] = lambda spark, d: O.numbered(A.versions(spark, d).select("id", "updated"), [(F.col("updated"), True), (F.col("id"), True)]).select("id", "pos")
S["o04_newest_first"] = oracle("vs", "SELECT id, row_number() OVER (ORDER BY updated DESC, id DESC) AS pos FROM vs")
Q["s24_filtered_scan"] = lambda spark, d: A.read(spark, d, "events").where((F.col("event_type") == "purchase") & (F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz"))).select("event_id", "user_id")
S["s24_filtered_scan"] = "SELECT event_id, user_id FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-10'"
Q["x17_month_reading"] = lambda spark, d: A.records(spark, d).where((F.year("read_on") == 1998) & (F.month("read_on") == 5)).agg(F.count("*").alias("books"), F.sum("pages").alias("pages"), F.count_if(F.col("pages").isNull()).alias("unknown"))
S["x17_month_reading"] = oracle("rd", "SELECT count(*) AS books, sum(pages) AS pages, count(*) FILTER (WHERE pages IS NULL) AS unknown FROM rd WHERE year(read_on) = 1998 AND month(read_on) = 5")


def listed(spark, d):
    """Books with all that the published list takes: unlimited, unpriced and blank ones among them."""
    c = A.read(spark, d, "customer")
    k = F.col("c_custkey")
    n = lambda e: e.cast("int")
    return c.select(
        F.concat(F.lit("C"), k).alias("asin"), F.when(k % 13 != 0, F.col("c_name")).alias("title"), F.when(k % 5 != 0, n(k * 37 % 2000)).alias("actual_price"), F.when(k % 7 != 0, k % 11 == 0).alias("is_unlimited"),
        (F.col("c_acctbal") > 0).alias("wanted"), (F.col("c_mktsegment") == "BUILDING").alias("purchased"), (k % 2 == 0).alias("from_store"), (k % 3 == 0).alias("from_reader"), F.lit("novel").alias("kind"),
        F.when(k % 4 == 0, "seen").alias("tag"), F.when(k % 4 == 0, n(k % 5 + 1)).alias("rating"), F.when(k % 7 != 0, F.concat(F.lit("2024-01-0"), k % 9 + 1)).alias("scraped_at"),
        F.struct(n(k % 900).alias("prev"), F.lit("2024").alias("changed_at"), n(k % 300).alias("low"), F.lit("2023").alias("low_at")).alias("trend"), F.when(k % 6 == 0, 500).alias("target_price"),
        F.when(k % 3 != 1, F.array(F.struct(F.lit("2024-01-01").alias("at"), n(k).alias("price")))).alias("history"), F.lit("no_price").alias("reason"), F.when(k % 5 == 0, "x").otherwise(k.cast("string")).alias("reader_id"),
        F.when(k % 8 == 0, "  ").otherwise(" Pub ").alias("publisher"), n(k * 37 % 2000 + 10).alias("sell_price"), F.when(k % 2 == 0, 10).alias("points"), F.when(k % 3 == 0, "sale").alias("campaign"),
    )


Q["k01_wishlist_items"] = lambda spark, d: W.wishlist_items(listed(spark, d))
S["k01_wishlist_items"] = """WITH b AS (SELECT c_custkey AS k, c_name, c_acctbal, c_mktsegment, coalesce(CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 11 = 0 END, false) AS ku FROM customer), p AS (SELECT *, CASE WHEN NOT ku AND k % 5 <> 0 THEN k * 37 % 2000 END AS price FROM b)
SELECT 'C' || k AS asin, CAST(to_json({'asin': 'C' || k, 'title': CASE WHEN k % 13 <> 0 THEN c_name ELSE '(unknown)' END, 'price': price, 'ku': ku, 'wanted': c_acctbal > 0, 'purchased': c_mktsegment = 'BUILDING',
  'sources': list_filter([CASE WHEN k % 2 = 0 THEN 'kindle' END, CASE WHEN k % 3 = 0 THEN 'bookmeter' END], lambda x: x IS NOT NULL), 'kind': 'novel', 'tag': CASE WHEN k % 4 = 0 THEN 'seen' END, 'rating': CASE WHEN k % 4 = 0 THEN k % 5 + 1 END,
  'scraped_at': CASE WHEN k % 7 <> 0 THEN '2024-01-0' || (k % 9 + 1) END, 'price_prev': CASE WHEN price IS NOT NULL THEN k % 900 END, 'price_changed_at': CASE WHEN price IS NOT NULL THEN '2024' END, 'price_low': CASE WHEN price IS NOT NULL THEN k % 300 END,
  'price_low_at': CASE WHEN price IS NOT NULL THEN '2023' END, 'target_price': CASE WHEN k % 6 = 0 THEN 500 END, 'price_history': CASE WHEN k % 3 <> 1 THEN [{'at': '2024-01-01', 'price': k}] ELSE [] END, 'price_reason': CASE WHEN price IS NULL THEN 'no_price' END,
  'bookmeter_id': CASE WHEN k % 5 <> 0 THEN CAST(k AS VARCHAR) END, 'publisher': CASE WHEN k % 8 <> 0 THEN 'Pub' END, 'sell_price': CASE WHEN price IS NOT NULL THEN k * 37 % 2000 + 10 END, 'points': CASE WHEN price IS NOT NULL AND k % 2 = 0 THEN 10 ELSE 0 END,
  'campaign': CASE WHEN price IS NOT NULL AND k % 3 = 0 THEN 'sale' ELSE '' END}) AS VARCHAR) AS item FROM p"""
Q["k01_wishlist_header"] = lambda spark, d: W.wishlist_header(listed(spark, d))
S["k01_wishlist_header"] = "SELECT 'wishlist' AS format, CAST(1 AS INTEGER) AS version, max(CASE WHEN c_custkey % 7 <> 0 THEN '2024-01-0' || (c_custkey % 9 + 1) END) AS last_scraped FROM customer"


def news(spark, d):
    e, k = A.read(spark, d, "events"), F.col("event_id")
    return e.select(k.alias("id"), F.when(k % 2 == 0, F.concat(F.lit("B"), F.lpad(F.col("user_id").cast("string"), 9, "0"))).otherwise("none").alias("asin"), F.col("ts").alias("at"), F.concat(F.col("event_type"), F.lit(" <"), k, F.lit("> & more")).alias("title"))


Q["k02_atom_feed"] = lambda spark, d: W.atom_feed(news(spark, d), "https://site.example", "feed.xml", "News", "lectern")
S["k02_atom_feed"] = """WITH n AS (SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'https://www.amazon.co.jp/dp/B' || lpad(CAST(user_id AS VARCHAR), 9, '0') ELSE 'https://site.example/' END AS link, CAST(ts AS TIMESTAMP) AS t, event_type || ' &lt;' || event_id || '&gt; &amp; more' AS title FROM events ORDER BY t DESC, id DESC LIMIT 50)
SELECT '<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<feed xmlns="http://www.w3.org/2005/Atom">' || chr(10) || ' <id>https://site.example/feed.xml</id>' || chr(10) || ' <title>News</title>' || chr(10) || ' <link rel="self" href="https://site.example/feed.xml" />' || chr(10) || ' <link rel="alternate" href="https://site.example/" />' || chr(10)
  || ' <updated>' || strftime(max(t), '%Y-%m-%dT%H:%M:%S+00:00') || '</updated>' || chr(10) || ' <author>' || chr(10) || '  <name>lectern</name>' || chr(10) || ' </author>' || chr(10)
  || string_agg(' <entry>' || chr(10) || '  <id>https://site.example/feed.xml#' || id || '</id>' || chr(10) || '  <title>' || title || '</title>' || chr(10) || '  <updated>' || strftime(t, '%Y-%m-%dT%H:%M:%S+00:00') || '</updated>' || chr(10) || '  <link rel="alternate" href="' || link || '" />' || chr(10) || ' </entry>' || chr(10), '' ORDER BY t DESC, id DESC) || '</feed>' || chr(10) AS feed FROM n"""
