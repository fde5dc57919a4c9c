"""Queries over states of several devices with their oracle SQL."""

from pyspark.sql import functions as F

from lectern.operators import states as M

from . import adapters as A
from .adapters import oracle

Q, S = {}, {}
LATE = "ORDER BY {0} DESC, id DESC"


def versions(spark, d):
    """Events of a user as versions of one highlight."""
    v = A.versions(spark, d)
    k = F.col("id")
    return v.select(
        F.col("user").alias("id"), F.col("field").alias("text"), F.col("updated"), k.alias("content"), F.when(k % 4 == 0, F.col("updated")).alias("user_at"), F.when(k % 6 == 0, F.col("updated")).alias("edited_at"),
        F.when(k % 6 == 0, F.concat(F.lit("was "), "field")).alias("original"), F.concat(F.lit("t"), k % 3).alias("tags"), (k % 8 == 0).alias("deleted"), F.when(k % 29 == 0, k + 100000).alias("next"), (k % 58 == 0).alias("joined"),
    )


Q["m04_merge_highlights"] = lambda spark, d: M.merge_highlights(versions(spark, d))
S["m04_merge_highlights"] = oracle("vs", """+v AS (SELECT "user" AS u, id, field, updated FROM vs), t AS (SELECT u, arg_max(field, (updated, id)) AS text FROM v GROUP BY u), e AS (SELECT u, arg_max(field, (updated, id)) AS text, max(updated) AS edited_at FROM v WHERE id % 6 = 0 GROUP BY u),
w AS (SELECT u, arg_max(id, (updated, id)) AS w FROM v WHERE id % 4 = 0 GROUP BY u), f AS (SELECT u, min(id + 100000) AS forced FROM v WHERE id % 29 = 0 AND id % 58 <> 0 GROUP BY u)
SELECT t.u AS id, coalesce(e.text, t.text) AS text, 'was ' || e.text AS original, e.edited_at, 't' || (w % 3) AS tags, coalesce(w % 8 = 0, false) OR forced IS NOT NULL OR coalesce(w % 58 = 0, false) AS deleted, coalesce(forced, CASE WHEN w % 58 = 0 THEN w + 100000 END) AS next
FROM t LEFT JOIN e ON t.u = e.u LEFT JOIN w ON t.u = w.u LEFT JOIN f ON t.u = f.u""")


def replaced(spark, d):
    c = A.read(spark, d, "customer")
    k = F.col("c_custkey")
    return c.select(k.alias("id"), F.concat(F.lit("t"), k).alias("tags"), F.when(k % 5 != 0, (k * 7919) % 1000).alias("user_at"), (k % 3 == 0).alias("deleted"), F.when(k % 3 == 0, k + 1 + k % 2).alias("next"))


Q["m06_hand_over"] = lambda spark, d: M.hand_over(replaced(spark, d))
S["m06_hand_over"] = """WITH p AS (SELECT c_custkey AS id, 't' || c_custkey AS tags, CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey * 7919) % 1000 END AS t, c_custkey % 3 = 0 AS deleted, CASE WHEN c_custkey % 3 = 0 THEN c_custkey + 1 + c_custkey % 2 END AS nx FROM customer),
g AS (SELECT nx, arg_max(tags, (t, id)) AS tags, max(t) AS t FROM p WHERE nx IS NOT NULL AND t IS NOT NULL GROUP BY nx)
SELECT id, CASE WHEN w THEN gt ELSE tags END AS tags, CASE WHEN w THEN ga ELSE t END AS user_at FROM (SELECT p.*, g.tags AS gt, g.t AS ga, NOT deleted AND g.t IS NOT NULL AND (p.t IS NULL OR g.t > p.t) AS w FROM p LEFT JOIN g ON p.id = g.nx)"""


def thoughts(spark, d):
    v = A.versions(spark, d)
    at = lambda n: F.when(F.col("id") % n == 0, F.col("updated"))
    return v.select(F.col("user").alias("id"), F.col("field").alias("text"), at(2).alias("text_at"), F.concat(F.lit("s"), F.col("id") % 4).alias("status"), at(3).alias("status_at"), (F.col("id") % 7 > 3).alias("favorite"), at(5).alias("favorite_at"), F.col("gone").alias("deleted"))


Q["m07_merge_thoughts"] = lambda spark, d: M.merge_thoughts(thoughts(spark, d))
S["m07_merge_thoughts"] = oracle("vs", """+a AS (SELECT "user" AS u, arg_max(field, (updated, field)) FILTER (WHERE id % 2 = 0) AS text, arg_max('s' || id % 4, (updated, 's' || id % 4)) FILTER (WHERE id % 3 = 0) AS status, arg_max(id % 7 > 3, (updated, id % 7 > 3)) FILTER (WHERE id % 5 = 0) AS favorite, bool_or(gone) AS deleted FROM vs GROUP BY "user") SELECT u AS id, text, status, favorite, deleted FROM a""")
Q["m09_link_collection"] = lambda spark, d: M.collection(A.versions(spark, d).select("user", "field", F.col("updated").alias("at"), F.col("value").alias("weight"), F.col("gone").alias("deleted")), ["user", "field"], ["weight"])
S["m09_link_collection"] = oracle("vs", 'SELECT "user", field, max(updated) AS "at", arg_max(value, (updated, value)) AS weight, bool_or(gone) AS deleted FROM vs GROUP BY "user", field')
Q["m11_newer_analysis"] = lambda spark, d: M.newer_analysis(*[A.read(spark, d, "orders").where(F.col("o_orderstatus") == s).agg(F.max("o_orderdate").alias("created"), F.min("o_orderdate").alias("recommended")).withColumn("name", F.lit(s)) for s in ("O", "F")])
S["m11_newer_analysis"] = "SELECT CASE WHEN o >= f THEN 'O' ELSE 'F' END AS name, greatest(o, f) AS fresh FROM (SELECT max(o_orderdate) FILTER (WHERE o_orderstatus = 'O') AS o, max(o_orderdate) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders)"
Q["m13_get_or_create"] = lambda spark, d: M.get_or_create(A.read(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("paid_id"), F.col("p_name").alias("title")), A.read(spark, d, "lineitem").select(F.when(F.col("l_quantity") > 5, F.col("l_partkey")).alias("paid_id"), F.col("l_returnflag").alias("title")))
S["m13_get_or_create"] = "SELECT p_partkey AS paid_id, p_name AS title, false AS \"new\" FROM part WHERE p_size < 25 UNION ALL SELECT l_partkey, min(l_returnflag), true FROM lineitem WHERE l_quantity > 5 AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25) GROUP BY l_partkey"
Q["m15_set_fields"] = lambda spark, d: M.set_fields(A.books(spark, d), A.books(spark, d).where("asin % 4 = 0").select("asin", F.when(F.col("asin") % 8 == 0, F.lit(500.0)).alias("target"), F.lit(True).alias("purchased")), "asin", ["target", "purchased"])
S["m15_set_fields"] = oracle("bk", "SELECT asin, title, wanted, purchased OR asin % 4 = 0 AS purchased, CASE WHEN asin % 8 = 0 THEN 500.0 ELSE target END AS target FROM bk")
Q["m17_effective_marks"] = lambda spark, d: M.effective_marks(A.wishlist(spark, d).where("wanted").select(F.col("idx").alias("asin"), F.lit("want").alias("tag")), A.wishlist(spark, d).where("ku or purchased").select(F.col("idx").alias("asin"), F.when(F.col("purchased"), "seen").otherwise("want").alias("tag")))
S["m17_effective_marks"] = oracle("wl", "SELECT idx AS asin, CASE WHEN purchased THEN 'seen' ELSE 'want' END AS tag, purchased OR (ku AND NOT wanted) AS own FROM wl WHERE wanted OR ku OR purchased")
Q["m18_record_changes"] = lambda spark, d: M.apply_record_changes(A.records(spark, d).select("book", "read_on"), A.read(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("book"), F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey").alias("seq"), F.when(F.col("l_returnflag") == "R", "remove").when(F.col("l_returnflag") == "A", "read").otherwise("exclude").alias("action"), F.col("l_shipdate").cast("date").alias("on")))
S["m18_record_changes"] = oracle("rd", "+c AS (SELECT l_orderkey AS book, arg_max(l_returnflag, (l_shipdate, l_linenumber, l_partkey, l_suppkey)) AS a, CAST(max(l_shipdate) AS DATE) AS d FROM lineitem WHERE l_quantity > 40 GROUP BY l_orderkey) SELECT coalesce(rd.book, c.book) AS book, CASE WHEN a = 'A' THEN d ELSE read_on END AS read_on FROM rd FULL JOIN c ON rd.book = c.book WHERE a IS NULL OR a = 'A'")
Q["m19_apply_notes"] = lambda spark, d: M.apply_notes(A.highlights(spark, d).select("id", F.col("chapter").alias("note"), F.col("favorite").alias("star")), A.highlights(spark, d).where("id % 3 <> 0").select("id", F.when(F.col("id") % 3 == 1, F.col("chapter")).otherwise("edited").alias("note"), F.lit(True).alias("star")))
S["m19_apply_notes"] = oracle("hl", "SELECT id, CASE WHEN id % 3 = 2 THEN 'edited' ELSE chapter END AS note, favorite OR id % 3 <> 0 AS star, id % 3 = 2 OR (id % 3 = 1 AND NOT favorite) AS changed FROM hl")
Q["x29_changed_files"] = lambda spark, d: M.changed_files(A.read(spark, d, "orders").select(F.col("o_orderkey").alias("name"), F.col("o_orderdate").alias("edited"), F.md5("o_orderpriority").alias("hash")), A.read(spark, d, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("name"), F.md5(F.when(F.col("o_orderkey") % 3 == 1, F.col("o_orderpriority")).otherwise("old")).alias("hash")), F.lit("1998-06-01").cast("timestamp_ntz"))
S["x29_changed_files"] = "SELECT o_orderkey AS name FROM orders WHERE o_orderdate > TIMESTAMP '1998-06-01' AND o_orderkey % 3 <> 1"


def edits(spark, d):
    c = A.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("text"), F.when(F.col("c_custkey") % 10 == 0, "first").alias("original"), (F.col("c_custkey") % 7 == 0).alias("deleted"), F.lit("then").alias("updated"))
    e = A.read(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", "text").when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "restore").otherwise("other").alias("action"), F.col("props").alias("text"))
    return M.edit(c, e, "now")


Q["m21_edit_points"] = edits
S["m21_edit_points"] = """WITH e AS (SELECT user_id AS id, arg_max(props, event_id) FILTER (WHERE event_type = 'click') AS nt, arg_max(event_type, event_id) FILTER (WHERE event_type IN ('error', 'signup')) AS tomb FROM events GROUP BY user_id)
SELECT c_custkey AS id, coalesce(nt, c_name) AS text, CASE WHEN c_custkey % 10 = 0 THEN 'first' WHEN nt <> c_name THEN c_name END AS original, CASE WHEN tomb = 'error' THEN true WHEN tomb = 'signup' THEN false ELSE c_custkey % 7 = 0 END AS deleted, CASE WHEN nt IS NOT NULL OR tomb IS NOT NULL THEN 'now' ELSE 'then' END AS updated FROM customer LEFT JOIN e ON c_custkey = e.id"""
Q["m23_toggle"] = lambda spark, d: M.toggle(A.read(spark, d, "part").where("p_size < 30").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 2 == 0).alias("on")), ["id"], A.read(spark, d, "part").where("p_size > 20").select(F.col("p_partkey").alias("id")))
S["m23_toggle"] = "SELECT p_partkey AS id, CASE WHEN p_size >= 30 THEN true WHEN p_size > 20 THEN p_size % 2 <> 0 ELSE p_size % 2 = 0 END AS \"on\" FROM part"


def neighbours(spark, d):
    h = A.highlights(spark, d).select("id", "text", F.array("chapter", F.lit("own")).alias("tags"), F.col("location").alias("start"), (F.col("location") + 9).alias("end"))
    pairs = h.where("id % 2 = 0").select(F.col("id").alias("first"), (F.col("id") + 1).alias("second"))
    return M.joined_points(h, pairs).select("id", F.length("text").cast("long").alias("n"), F.array_join("tags", ",").alias("tags"), "start", "end")


Q["w06_joined_points"] = neighbours
S["w06_joined_points"] = oracle("hl", "SELECT a.id, length(a.text) + length(b.text) AS n, CASE WHEN a.chapter = b.chapter THEN a.chapter || ',own' ELSE a.chapter || ',own,' || b.chapter END AS tags, least(a.location, b.location) AS \"start\", greatest(a.location, b.location) + 9 AS \"end\" FROM hl a JOIN hl b ON a.id % 2 = 0 AND b.id = a.id + 1")
Q["m20_migrated"] = lambda spark, d: M.migrated(A.read(spark, d, "nation"), {"n_region": F.col("n_regionkey") + 1, "n_name": F.lit("kept")}).select("n_nationkey", "n_name", "n_region")
S["m20_migrated"] = "SELECT n_nationkey, n_name, n_regionkey + 1 AS n_region FROM nation"
