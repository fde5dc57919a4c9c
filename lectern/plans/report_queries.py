"""Queries over lookups, drafts, labels and limits with their oracle SQL."""

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import graph as G
from lectern.operators import reports as R

from . import adapters as A
from .adapters import oracle

Q, S = {}, {}

#: Numbers of one to 41 places behind eight letters, one of them a capital.
Q["x01_id_kinds"] = lambda spark, d: A.read(spark, d, "orders").select("o_orderkey", F.concat(F.substring(F.lit("htnokdfzH"), (F.col("o_orderkey") % 9 + 1).cast("int"), F.lit(1)), F.repeat(F.lit("7"), (F.col("o_orderkey") % 42).cast("int"))).alias("c")).select("o_orderkey", R.id_kind(F.col("c")).alias("kind"), R.is_point(F.col("c")).alias("point"), R.is_link_end(F.col("c")).alias("link_end"))
S["x01_id_kinds"] = "WITH k AS (SELECT o_orderkey, CASE WHEN o_orderkey % 42 BETWEEN 1 AND 40 THEN ['highlight', 'thought', 'note', 'outline', 'link', 'discovery', 'far'][o_orderkey % 9 + 1] END AS kind FROM orders) SELECT o_orderkey, kind, coalesce(kind IN ('highlight', 'thought'), false) AS point, coalesce(kind IN ('highlight', 'thought', 'note'), false) AS link_end FROM k"


def states(spark, d):
    p = A.read(spark, d, "part").where("p_size > 5").select(F.col("p_partkey").alias("id"), (F.col("p_size") > 40).alias("deleted"), (F.col("p_size") % 2 == 0).alias("discarded"))
    now = A.read(spark, d, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") + 1).alias("current"))
    return R.point_states(A.read(spark, d, "part").select(F.col("p_partkey").alias("id")), p, now)


Q["x02_point_states"] = states
S["x02_point_states"] = "WITH n AS (SELECT p_partkey AS id, p_partkey + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS c FROM part) SELECT id, c AS current, CASE WHEN p_size IS NULL OR p_size <= 5 THEN 'missing' WHEN p_size > 40 THEN 'deleted' WHEN p_size % 2 = 0 THEN 'discarded' ELSE 'live' END AS state FROM n LEFT JOIN part ON c = p_partkey"
Q["x03_live_collections"] = lambda spark, d: A.versions(spark, d).where("not gone").groupBy("field").agg(F.count("*").alias("n"), F.max("updated").alias("last"))
S["x03_live_collections"] = oracle("vs", "SELECT field, count(*) AS n, max(updated) AS last FROM vs WHERE NOT gone GROUP BY field")


def sides(v):
    one = lambda r: v.where(F.col("replica") == r).groupBy("user").agg(F.max_by("value", F.struct("updated", "id")).alias("value"), F.max_by(F.when(F.col("id") % 3 > 0, F.col("field")), F.struct("updated", "id")).alias("field"), F.max("updated").alias("updated"))
    return R.merged_tables(one(0), one(1), "user", ["value", "field"], "updated")


Q["j08_merged_tables"] = lambda spark, d: sides(A.versions(spark, d))
S["j08_merged_tables"] = oracle("vs", """+l AS (SELECT replica AS p, "user" AS u, updated AS t, value AS v, CASE WHEN id % 3 > 0 THEN field END AS f FROM (SELECT *, row_number() OVER (PARTITION BY replica, "user" ORDER BY updated DESC, id DESC) AS r FROM vs) WHERE r = 1), b AS (SELECT * FROM l WHERE p = 0), i AS (SELECT * FROM l WHERE p = 1)
SELECT coalesce(b.u, i.u) AS "user", CASE WHEN b.u IS NULL OR i.t > b.t THEN coalesce(i.v, b.v) ELSE coalesce(b.v, i.v) END AS value, CASE WHEN b.u IS NULL OR i.t > b.t THEN coalesce(i.f, b.f) ELSE coalesce(b.f, i.f) END AS field, greatest(b.t, i.t) AS updated FROM b FULL JOIN i ON b.u = i.u""")
Q["o05_limits"] = lambda spark, d: R.limited(A.versions(spark, d).select("id", "field", "updated"), "field", [F.col("updated").desc(), F.col("id").desc()], {"click": 30, "error": 8, "signup": 12}).select("id", "field")
S["o05_limits"] = oracle("vs", "SELECT id, field FROM (SELECT id, field, row_number() OVER (PARTITION BY field ORDER BY updated DESC, id DESC) AS r FROM vs) WHERE r <= CASE field WHEN 'click' THEN 30 WHEN 'error' THEN 8 WHEN 'signup' THEN 12 ELSE 0 END")
Q["x13_outline_materials"] = lambda spark, d: R.outline_materials(A.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("outline"), F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("source"), "l_orderkey").withColumnRenamed("l_orderkey", "place"), 12)
S["x13_outline_materials"] = """WITH o AS (SELECT l_suppkey AS outline, l_partkey AS id, min((l_returnflag, l_orderkey)) AS f FROM lineitem GROUP BY ALL), t AS (SELECT outline, id, f[1] AS source, row_number() OVER (PARTITION BY outline, f[1] ORDER BY f[2], id) AS turn FROM (SELECT outline, id, [f[1]::VARCHAR, f[2]::VARCHAR] AS g, f FROM o)) SELECT outline, id, pos FROM (SELECT outline, id, row_number() OVER (PARTITION BY outline ORDER BY turn, source, id) AS pos FROM t) WHERE pos <= 12"""
Q["x04_note_drafts"] = lambda spark, d: R.note_drafts(A.read(spark, d, "supplier").select(F.col("s_suppkey").alias("line"), F.col("s_name").alias("name")), A.read(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_suppkey").alias("line"), F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("place"))).select("line", "title", F.array_join(F.col("evidence").cast("array<string>"), ",").alias("evidence"))
S["x04_note_drafts"] = "SELECT s_suppkey AS line, s_name AS title, string_agg(l_partkey, ',' ORDER BY l_orderkey, l_partkey) AS evidence FROM supplier JOIN lineitem ON s_suppkey = l_suppkey WHERE l_quantity > 45 GROUP BY ALL"
Q["x07_far_links"] = lambda spark, d: R.far_links(A.read(spark, d, "lineitem").where("l_linenumber = 2").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_partkey").alias("a"), F.max("l_suppkey").alias("b")), A.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "interesting").otherwise("wrong").alias("reaction"), F.col("o_orderdate").alias("at")))
S["x07_far_links"] = "SELECT least(a, b) AS a, greatest(a, b) AS b, o_orderdate AS \"at\" FROM (SELECT l_orderkey, min(l_partkey) AS a, max(l_suppkey) AS b FROM lineitem WHERE l_linenumber = 2 GROUP BY l_orderkey) JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'"
Q["x37_page_labels"] = lambda spark, d: A.read(spark, d, "pages").select("page_id", R.page_label(F.when(F.col("page_id") % 7 == 0, F.concat("url", F.lit("/Errors/validateCaptcha"))).when(F.col("page_id") % 7 == 1, F.concat("url", F.lit("/robots.txt"))).when(F.col("page_id") % 7 == 2, F.concat("url", F.lit("&ref=cs_503_link"))).otherwise(F.col("url")), F.element_at(F.array(*[F.lit(x) for x in ("Robot Check", "Sorry, verify", "Sorry: CAPTCHA", "エラーが発生しました", "ロボット", "a book", "a book")], F.lit(None).cast("string")), (F.col("page_id") % 8 + 1).cast("int")), F.substring("html", 1, 195 + F.col("page_id").cast("int") % 10)).alias("label"))
S["x37_page_labels"] = "SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'captcha' WHEN page_id % 7 <= 2 THEN 'robot_check' ELSE coalesce(['robot_check', 'access_denied', 'captcha', 'access_denied', 'robot_check', NULL, NULL, NULL][page_id % 8 + 1], CASE WHEN least(length(html), 195 + page_id % 10) < 200 THEN 'suspicious' ELSE 'ok' END) END AS label FROM pages"
Q["x36_first_unsponsored"] = lambda spark, d: R.first_unsponsored(A.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("query"), F.col("l_linenumber").alias("pos")).agg(F.min("l_partkey").alias("asin"), F.max(F.col("l_returnflag") == "R").alias("sponsored"), F.max(F.col("l_quantity") > 49).alias("blocked")))
S["x36_first_unsponsored"] = "WITH c AS (SELECT l_orderkey AS query, l_linenumber AS pos, min(l_partkey) AS asin, bool_or(l_returnflag = 'R') AS ad, bool_or(l_quantity > 49) AS bl FROM lineitem GROUP BY ALL) SELECT query, arg_min(asin, pos) FILTER (WHERE NOT ad) AS asin FROM c GROUP BY query HAVING NOT bool_or(bl) AND count(*) FILTER (WHERE NOT ad) > 0"
Q["w10_distinct_names"] = lambda spark, d: R.distinct_names(A.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 40 == 0, F.concat("p_brand", F.lit(" ("), F.col("p_partkey") % 23, F.lit(")"))).otherwise(F.col("p_brand")).alias("name")))
S["w10_distinct_names"] = """WITH r AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 40 = 0 THEN p_brand || ' (' || p_partkey % 23 || ')' ELSE p_brand END AS name FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id) - 1 AS k FROM r),
f AS (SELECT name, i, row_number() OVER (PARTITION BY name ORDER BY i) AS k FROM (SELECT name, unnest(range(2, 40 + 2 * count(*))) AS i FROM r GROUP BY name) WHERE name || ' (' || i || ')' NOT IN (SELECT name FROM r))
SELECT n.id, CASE WHEN n.k = 0 THEN n.name ELSE n.name || ' (' || f.i || ')' END AS name FROM n LEFT JOIN f ON n.name = f.name AND n.k = f.k"""
Q["k09_vector_cache"] = lambda spark, d: R.vector_cache(A.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 6 == 0, F.slice("embedding", 1, 10)).when(F.col("vec_id") % 6 == 1, F.transform("embedding", lambda x: F.when(x > 0, x))).otherwise(F.col("embedding")).alias("v")), 64).select("id")
S["k09_vector_cache"] = "SELECT vec_id AS id FROM embeddings WHERE vec_id % 6 > 1"
Q["s11_empty_exports"] = lambda spark, d: R.empty_export(A.read(spark, d, "pages").select(F.col("page_id").alias("name"), "html", F.length(F.regexp_replace("html", "(?i)<li>", "")).cast("long").alias("m")).select("name", "html", (F.length("html") - F.col("m")).alias("n")))
S["s11_empty_exports"] = "SELECT page_id AS name, CASE WHEN regexp_matches(html, '(?i)<li>') THEN 'filled' WHEN regexp_matches(html, '(?i)display\\s*:\\s*none|hidden') THEN 'hidden' ELSE 'empty' END AS why FROM pages"
Q["c04_truncate"] = lambda spark, d: A.read(spark, d, "documents").select("doc_id", T.truncate(F.col("text"), 40).alias("text"))
S["c04_truncate"] = "SELECT doc_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 39) || '…' ELSE text END AS text FROM documents"
Q["r08_payload"] = lambda spark, d: A.wishlist(spark, d).where("wanted and not purchased").orderBy("idx").limit(300).select("idx", "title", "price")
S["r08_payload"] = oracle("wl", "SELECT idx, title, price FROM wl WHERE wanted AND NOT purchased ORDER BY idx LIMIT 300")
Q["x14_saved_answers"] = lambda spark, d: A.read(spark, d, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("t")).select("conv_id", F.md5("t").alias("h"))
S["x14_saved_answers"] = "SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn, text)) AS h FROM conversations WHERE role = 'assistant' GROUP BY conv_id"
Q["x30_sniffed_ends"] = lambda spark, d: A.read(spark, d, "part").select("p_partkey", F.lower(F.regexp_extract(F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, ".HTML").otherwise("/x")), r"\.([A-Za-z0-9]+)$", 1)).alias("ending"))
S["x30_sniffed_ends"] = "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'html' ELSE '' END AS ending FROM part"
Q["t08_resume"] = lambda spark, d: A.books(spark, d).select("asin").join(A.price_history(spark, d).where(F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")).select("asin"), "asin", "left_anti")
S["t08_resume"] = oracle("bk ph", "SELECT asin FROM bk WHERE asin NOT IN (SELECT asin FROM ph WHERE ts >= TIMESTAMP '2024-01-15')")
Q["w09_interleave"] = lambda spark, d: G.interleave(A.read(spark, d, "part").select(F.col("p_brand").alias("lst"), F.col("p_partkey").alias("k"), F.col("p_partkey").alias("item")))
S["w09_interleave"] = "SELECT p_partkey AS item, row_number() OVER (ORDER BY n, p_brand) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)"
Q["t10_batches"] = lambda spark, d: R.batches(A.read(spark, d, "orders").select("o_orderkey"), "o_orderkey", 400)
S["t10_batches"] = "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 400 AS batch FROM orders"


def bodies(spark, d):
    """Reports of checks, some with fields of another form or beyond their limits."""
    e, k = A.read(spark, d, "events"), F.col("event_id")
    ok = F.when(k % 13 == 0, F.lit('"yes"')).otherwise(F.when(k % 2 == 0, "true").otherwise("false"))
    added = F.when(k % 11 == 0, F.lit("100001")).when(k % 7 == 0, F.lit("1.5")).otherwise(F.concat(F.lit(""), k % 50))
    body = F.concat(F.lit('{"ok": '), ok, F.lit(', "added": '), added, F.when(k % 3 == 0, F.lit(', "intervalMin": "30"')).when(k % 3 == 1, F.lit(', "intervalMin": 0')).otherwise(""), F.when(k % 5 == 0, F.concat(F.lit(', "fetched": '), k % 9)).otherwise(""), F.lit(', "error": "bad\\n'), k, F.lit('", "other": {"a": 1}}'))
    return e.select(k.alias("id"), F.when(k % 17 == 0, F.substring(body, 1, 12)).otherwise(body).alias("body"))


Q["x28_health_reports"] = lambda spark, d: R.health_reports(bodies(spark, d))
S["x28_health_reports"] = "SELECT event_id AS id, event_id % 2 = 0 AS ok, false AS need_login, CAST(event_id % 50 AS BIGINT) AS added, CASE WHEN event_id % 5 = 0 THEN CAST(event_id % 9 AS BIGINT) END AS fetched, CAST(CASE WHEN event_id % 3 = 0 THEN 30 ELSE 15 END AS BIGINT) AS interval, 'bad' || event_id AS error FROM events WHERE event_id % 13 > 0 AND event_id % 11 > 0 AND event_id % 7 > 0 AND event_id % 3 <> 1 AND event_id % 17 > 0"


def kept(spark, d):
    """Histories of what users were shown, by day, as they are kept; some are broken."""
    e = A.read(spark, d, "events")
    day = e.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.array_sort(F.collect_set(F.concat(F.lit("h"), "event_id"))).alias("ids"))
    rows = day.groupBy(F.col("user_id").alias("owner")).agg(F.to_json(F.array_sort(F.collect_list(F.struct("day", "ids")))).alias("text"))
    return rows.select("owner", F.when(F.col("owner") % 9 == 0, F.substring("text", 1, 40)).otherwise(F.col("text")).alias("text"))


Q["x32_seen_picks"] = lambda spark, d: R.seen_picks(kept(spark, d))
S["x32_seen_picks"] = "SELECT DISTINCT user_id AS owner, strftime(ts, '%Y-%m-%d') AS day, 'h' || event_id AS id FROM events WHERE user_id % 9 > 0"
Q["x32_shuffle_seeds"] = lambda spark, d: R.shuffle_seeds(A.read(spark, d, "orders").select(F.col("o_orderkey").alias("owner"), F.when(F.col("o_orderkey") % 5 == 0, "{").otherwise(F.to_json(F.struct(F.when(F.col("o_orderkey") % 3 == 0, "2024-01-01").otherwise("2024-01-02").alias("day"), F.col("o_custkey").cast("string").alias("seed")))).alias("text")), F.lit("2024-01-01"))
S["x32_shuffle_seeds"] = "SELECT o_orderkey AS owner, CASE WHEN o_orderkey % 5 > 0 AND o_orderkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE '' END AS seed FROM orders"
