"""Queries over points, evidence and links with their oracle SQL."""

from pyspark.sql import functions as F

from lectern.operators import points as P
from lectern.operators import vectors as V

from . import adapters as A
from .adapters import oracle

Q, S = {}, {}


def highlights(spark, d):
    """(id, book, chapter, text, note, tags, source, favorite, edited_at, deleted, at)."""
    h = A.highlights(spark, d)
    return h.select("id", "book", "chapter", "text", F.when(F.col("id") % 9 == 0, "margin note").alias("note"), F.array("chapter").alias("tags"), F.when(F.col("id") % 2 == 0, "kindle").otherwise("paper").alias("source"), "favorite", F.when(F.col("id") % 5 == 0, F.col("id")).alias("edited_at"), "deleted", F.col("location").alias("at"))


def shelf(spark, d):
    return A.highlights(spark, d).select("book").distinct().select("book", F.concat(F.lit("Book "), "book").alias("title"), F.lit("Ann Author").alias("author"), (F.col("book") == "src3").alias("deleted"))


def thoughts(spark, d):
    c = A.read(spark, d, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn") + 10000000).alias("id"), "text", F.array("role").alias("tags"), (F.col("conv_id") % 3 == 0).alias("favorite"), (F.col("turn") > 3).alias("deleted"), F.length("text").cast("long").alias("at"))


HS = "hs AS (SELECT *, CASE WHEN id % 9 = 0 THEN 'margin note' END AS note, CASE WHEN id % 2 = 0 THEN 'kindle' ELSE 'paper' END AS source, id % 5 = 0 AS edited, lower(text || CASE WHEN id % 9 = 0 THEN ' margin note' ELSE '' END || ' ' || chapter || ' book ' || book || ' ann author #' || chapter) AS hay FROM hl WHERE NOT deleted AND book <> 'src3')"
TS = "ts AS (SELECT conv_id * 1000 + turn + 10000000 AS id, conv_id % 3 = 0 AS favorite, CAST(length(text) AS BIGINT) AS \"at\", lower(text || ' #' || role) AS hay FROM conversations WHERE turn <= 3)"
Q["f04_search_filters"] = lambda spark, d: P.search_highlights(highlights(spark, d), shelf(spark, d), "Ｔｈｅ #en author", "kindle", False, False).select("id", "book", "at")
S["f04_search_filters"] = oracle("hl", "+" + HS + ' SELECT id, book, location AS "at" FROM hs WHERE contains(hay, \'the\') AND contains(hay, \'#en\') AND source = \'kindle\'')
Q["f05_search_points"] = lambda spark, d: P.search_points(highlights(spark, d), thoughts(spark, d), shelf(spark, d), "de")
S["f05_search_points"] = oracle("hl", "+" + HS + ", " + TS + " SELECT id, 'highlight' AS kind, location AS \"at\" FROM hs WHERE contains(hay, 'de') UNION ALL SELECT id, 'thought', \"at\" FROM ts WHERE contains(hay, 'de')")
Q["f05_search_edited"] = lambda spark, d: P.search_points(highlights(spark, d), thoughts(spark, d), shelf(spark, d), "note", edited=True)
S["f05_search_edited"] = oracle("hl", "+" + HS + " SELECT id, 'highlight' AS kind, location AS \"at\" FROM hs WHERE contains(hay, 'note') AND edited")
Q["f06_search_thoughts"] = lambda spark, d: P.matching(thoughts(spark, d).where("not deleted"), "#user la", F.col("text"), P.tagged(F.col("tags"))).select("id")
S["f06_search_thoughts"] = "WITH " + TS + " SELECT id FROM ts WHERE contains(hay, '#user') AND contains(hay, 'la')"
Q["f17_pending_with_isolated"] = lambda spark, d: P.pending(A.points(spark, d).select("id"), A.points(spark, d).where("id % 10 < 6"), A.points(spark, d).where("id % 10 = 7"))
S["f17_pending_with_isolated"] = "SELECT vec_id AS id FROM embeddings WHERE vec_id % 10 >= 6 AND vec_id % 10 <> 7"


def removed(spark, d):
    h = A.highlights(spark, d)
    lib = h.select("id", "book", (F.col("id") % 11 == 0).alias("thought"), "deleted", F.when(F.col("id") % 13 == 0, F.col("id") + 1).alias("next"))
    now = lib.where("not thought and not deleted and next is null and book not in ('src3', 'src10')").select("id")
    every = h.select("id").unionByName(spark.range(10**9, 10**9 + 5))
    return P.removed(every, lib, shelf(spark, d), now)


Q["f18_removed_points"] = removed
S["f18_removed_points"] = oracle("hl", """+r AS (SELECT id, CASE WHEN id % 11 = 0 AND deleted THEN 'thought-deleted' WHEN id % 11 = 0 THEN 'discarded' WHEN id % 13 = 0 THEN 'replaced' WHEN book = 'src3' THEN 'book-deleted' WHEN deleted THEN 'deleted' WHEN book = 'src10' THEN 'technical' END AS reason FROM hl UNION ALL SELECT 1000000000 + unnest(range(5)), 'missing')
SELECT id, reason, CAST(list_position(['technical', 'deleted', 'book-deleted', 'discarded', 'replaced', 'thought-deleted', 'missing'], reason) AS INTEGER) AS place FROM r WHERE reason IS NOT NULL""")


def fetch(spark, d):
    o = A.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("on"))
    was = o.where("id % 6 <> 5").select("id", F.when(F.col("id") % 7 == 0, F.date_sub("on", 1)).otherwise(F.col("on")).alias("on"))
    return P.refetch(o, was, F.lit("1998-08-02").cast("date"))


Q["f20_refetch"] = fetch
S["f20_refetch"] = "WITH o AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d FROM orders) SELECT id, d AS \"on\" FROM o WHERE id % 7 = 0 OR id % 6 = 5 OR d = (SELECT max(d) FROM o) OR d = DATE '1998-08-02'"
Q["f21_to_look_up"] = lambda spark, d: P.to_look_up(A.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 20, F.col("p_brand")).alias("isbn")), A.read(spark, d, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("id"))).select("id")
S["f21_to_look_up"] = "SELECT p_partkey AS id FROM part WHERE p_size <= 20 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)"
Q["f24_recent_picks"] = lambda spark, d: P.recent_picks(A.read(spark, d, "events").select(F.col("user_id").alias("id"), F.col("ts").cast("date").alias("on")), F.lit("2024-01-06").cast("date"))
S["f24_recent_picks"] = "SELECT user_id AS id, bool_or(CAST(ts AS DATE) <= DATE '2024-01-05') AS recent FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-06' GROUP BY user_id"
Q["f26_starred_lines"] = lambda spark, d: P.starred(spark.range(60).select(F.col("id").alias("line")), A.points(spark, d).select("line"), False)
S["f26_starred_lines"] = "SELECT i AS line, CASE WHEN i IN (SELECT label FROM embeddings) THEN 'present' ELSE 'missing' END AS state FROM (SELECT unnest(range(60)) AS i)"


def reactions(spark, d):
    c = A.read(spark, d, "customer")
    r = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, "wrong").when(F.col("c_custkey") % 3 == 1, "interesting").otherwise("seen").alias("reaction"))
    return P.visible_far(c.where("c_acctbal > 3000").select(F.col("c_custkey").alias("id")), r)


Q["f27_visible_far"] = reactions
S["f27_visible_far"] = "SELECT c_custkey AS id, c_acctbal <= 3000 AS kept FROM customer WHERE c_custkey % 3 <> 0 AND (c_acctbal > 3000 OR c_custkey % 3 = 1)"
Q["f28_unread"] = lambda spark, d: P.unread(A.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("found_at")), A.read(spark, d, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("id")), F.lit("1998-01-01").cast("timestamp_ntz"))
S["f28_unread"] = "SELECT o_orderkey AS id, o_orderdate > TIMESTAMP '1998-01-01' AS fresh FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')"

Q["j05_with_books"] = lambda spark, d: highlights(spark, d).join(shelf(spark, d), "book").select("id", "title")
S["j05_with_books"] = oracle("hl", "SELECT id, 'Book ' || book AS title FROM hl")
Q["j06_seen_titles"] = lambda spark, d: A.read(spark, d, "part").join(A.read(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi").select(F.trim("p_name").alias("title")).where("title <> ''").distinct()
S["j06_seen_titles"] = "SELECT DISTINCT trim(p_name) AS title FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)"
Q["j07_not_processed"] = lambda spark, d: A.read(spark, d, "part").select("p_partkey").join(A.read(spark, d, "lineitem").where("l_quantity = 1").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")
S["j07_not_processed"] = "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 1)"


def spots(spark, d):
    h = A.highlights(spark, d).select("id", "book", F.when(F.col("id") % 8 != 0, F.col("location")).alias("start"), F.when(F.col("id") % 8 != 0, F.col("location") + F.col("id") % 90).alias("end"), F.floor(F.col("location") / 300).alias("page"))
    return P.same_spot(h, h).where("a < b")


Q["j14_same_spot"] = spots
S["j14_same_spot"] = oracle("hl", """+r AS (SELECT id, book, CASE WHEN id % 8 <> 0 THEN location END AS s, CASE WHEN id % 8 <> 0 THEN location + id % 90 END AS e, floor(location / 300) AS page FROM hl)
SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.book = b.book AND a.id < b.id AND CASE WHEN a.s IS NULL OR b.s IS NULL THEN a.page = b.page ELSE a.s <= b.e + 1 AND b.s <= a.e + 1 END""")
Q["j23_partners"] = lambda spark, d: P.partners(A.points(spark, d))
S["j23_partners"] = oracle("pt", "SELECT a.id, min(b.id) AS partner FROM pt a JOIN pt b ON a.line = b.line AND a.source <> b.source GROUP BY a.id")


def pointers(spark, d):
    from lectern.operators import graph as G

    c = A.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 4 != 3, F.col("c_custkey") + 1).alias("next"))
    return G.current_ids(c)


Q["j19_former_ids"] = lambda spark, d: P.former_ids(pointers(spark, d))
S["j19_former_ids"] = "SELECT least(c_custkey + 3 - c_custkey % 4, (SELECT max(c_custkey) + 1 FROM customer)) AS current, c_custkey AS former FROM customer WHERE c_custkey % 4 <> 3"


def notes(spark, d):
    return A.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("note")).agg(F.collect_set("l_partkey").alias("evidence"))


Q["g18_missing_evidence"] = lambda spark, d: P.missing_evidence(notes(spark, d), A.read(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("id")))
S["g18_missing_evidence"] = "SELECT l_orderkey AS note, count(DISTINCT CASE WHEN l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10) THEN l_partkey END) AS missing FROM lineitem GROUP BY l_orderkey"
Q["g19_result_counts"] = lambda spark, d: A.read(spark, d, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"))
S["g19_result_counts"] = "SELECT event_type AS status, count(*) AS n FROM events GROUP BY event_type"
Q["g22_line_spread"] = lambda spark, d: V.line_stats(A.points(spark, d), V.centroids(A.points(spark, d))).select("line", "mean", "sd")
S["g22_line_spread"] = oracle("px", "+cs AS (SELECT line, i, sum(x) AS x FROM px GROUP BY line, i), cn AS (SELECT line, sqrt(sum(x * x)) AS n FROM cs GROUP BY line), sm AS (SELECT px.id, px.line, sum(px.x * cs.x / n) AS sim FROM px JOIN cs ON px.line = cs.line AND px.i = cs.i JOIN cn ON cn.line = px.line GROUP BY px.id, px.line) SELECT line, round(avg(sim), 6) AS mean, round(stddev_pop(sim), 6) AS sd FROM sm GROUP BY line")
Q["g24_judged_counts"] = lambda spark, d: P.judged_counts(A.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b")))
S["g24_judged_counts"] = "SELECT id, count(*) AS n FROM (SELECT l_orderkey AS id FROM lineitem UNION ALL SELECT l_partkey FROM lineitem) GROUP BY id"
Q["x05_cites"] = lambda spark, d: P.cites(notes(spark, d), pointers(spark, d), A.read(spark, d, "part").where("p_size = 7").select(F.col("p_partkey").alias("id")))
S["x05_cites"] = "WITH c AS (SELECT c_custkey AS id, least(c_custkey + 3 - c_custkey % 4, (SELECT max(c_custkey) + 1 FROM customer)) AS cur FROM customer), w AS (SELECT coalesce(cur, p_partkey) AS g FROM part LEFT JOIN c ON p_partkey = c.id WHERE p_size = 7) SELECT DISTINCT l_orderkey AS note FROM lineitem LEFT JOIN c ON l_partkey = c.id WHERE coalesce(cur, l_partkey) IN (SELECT g FROM w)"
Q["x06_unlink"] = lambda spark, d: P.unlink(A.read(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")), A.read(spark, d, "lineitem").where("l_quantity > 30").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"))).groupBy("a").agg(F.count("*").alias("n"))
S["x06_unlink"] = "WITH g AS (SELECT DISTINCT least(l_partkey, l_suppkey) AS lo, greatest(l_partkey, l_suppkey) AS hi FROM lineitem WHERE l_quantity > 30) SELECT l_partkey AS a, count(*) AS n FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.lo = least(l_partkey, l_suppkey) AND g.hi = greatest(l_partkey, l_suppkey)) GROUP BY l_partkey"


def members(spark, d, shifted=False):
    p = A.highlights(spark, d)
    text = F.when(F.col("id") % 50 == 0, "edited").otherwise(F.col("text")) if shifted else F.col("text")
    return p.select(F.col("book").alias("group"), F.col("id").alias("member"), text.alias("text"))


Q["a29_fingerprints"] = lambda spark, d: P.fingerprints(members(spark, d))
S["a29_fingerprints"] = oracle("hl", "SELECT book AS \"group\", sha256(string_agg(id || ':' || md5(text), '|' ORDER BY id || ':' || md5(text))) AS print FROM hl GROUP BY book")
Q["x10_changed_since"] = lambda spark, d: P.changed_since(members(spark, d, True), P.fingerprints(members(spark, d)))
S["x10_changed_since"] = oracle("hl", "SELECT book AS \"group\", bool_or(id % 50 = 0) AS changed FROM hl GROUP BY book")
Q["a30_stale_vectors"] = lambda spark, d: P.stale_vectors(A.highlights(spark, d).select("id", "text"), A.highlights(spark, d).where("id % 4 <> 0").select("id", F.md5(F.when(F.col("id") % 9 == 1, "old").otherwise(F.col("text"))).alias("hash")))
S["a30_stale_vectors"] = oracle("hl", "SELECT id FROM hl WHERE id % 4 = 0 OR id % 9 = 1")
Q["o08_all_points"] = lambda spark, d: highlights(spark, d).select("id", "at").unionByName(thoughts(spark, d).select("id", "at"))
S["o08_all_points"] = "SELECT doc_id AS id, n_chars AS \"at\" FROM documents UNION ALL SELECT conv_id * 1000 + turn + 10000000, CAST(length(text) AS BIGINT) FROM conversations"
Q["o09_union_first"] = lambda spark, d: P.union_first(A.read(spark, d, "part").where("p_size < 30").select(F.col("p_partkey").alias("id"), F.lit("new").alias("origin")), A.read(spark, d, "part").where("p_size > 20").select(F.col("p_partkey").alias("id"), F.lit("old").alias("origin")))
S["o09_union_first"] = "SELECT p_partkey AS id, CASE WHEN p_size < 30 THEN 'new' ELSE 'old' END AS origin FROM part"
Q["o10_ranked_union"] = lambda spark, d: A.read(spark, d, "orders").select("o_orderkey", F.array_join(P.ranked_union(F.array(F.lit("zine"), F.lit("paper")), F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("atlas"), F.lit("kindle")))), ",").alias("sources"))
S["o10_ranked_union"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'kindle,paper,atlas,zine' ELSE 'paper,zine' END AS sources FROM orders"
Q["f16_source_list"] = lambda spark, d: A.books(spark, d).select("asin", F.array_join(P.source_list(wanted=F.col("wanted"), purchased=F.col("purchased")), "+").alias("sources"))
S["f16_source_list"] = oracle("bk", "SELECT asin, CASE WHEN wanted AND purchased THEN 'wanted+purchased' WHEN wanted THEN 'wanted' WHEN purchased THEN 'purchased' ELSE '' END AS sources FROM bk")
Q["o11_set_difference"] = lambda spark, d: A.read(spark, d, "lineitem").where("l_linestatus = 'O'").select("l_partkey").subtract(A.read(spark, d, "lineitem").where("l_linestatus = 'F'").select("l_partkey")).withColumn("side", F.lit("open")).unionByName(A.read(spark, d, "lineitem").where("l_quantity > 49").select("l_partkey").intersect(A.read(spark, d, "lineitem").where("l_quantity < 2").select("l_partkey")).withColumn("side", F.lit("both")))
S["o11_set_difference"] = "SELECT *, 'open' AS side FROM (SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O' EXCEPT SELECT l_partkey FROM lineitem WHERE l_linestatus = 'F') UNION ALL SELECT *, 'both' FROM (SELECT l_partkey FROM lineitem WHERE l_quantity > 49 INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity < 2)"
Q["o07_retained"] = lambda spark, d: P.retained(A.versions(spark, d).select("id", F.col("updated").alias("at"), F.col("gone").alias("deleted")), 500).select("id", "deleted")
S["o07_retained"] = oracle("vs", "SELECT id, gone AS deleted FROM vs ORDER BY gone, updated DESC, id DESC LIMIT 500")
Q["t09_unsynced"] = lambda spark, d: P.unsynced(A.versions(spark, d).select("id", F.col("updated").alias("at")), "2024-01-15").select("id")
S["t09_unsynced"] = oracle("vs", "SELECT id FROM vs WHERE updated > TIMESTAMP '2024-01-15'")
