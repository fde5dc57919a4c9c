"""Queries over upserts, marks and recommendation inputs, with their oracle SQL."""

from pyspark.sql import functions as F

from lectern.operators import shelves as H
from lectern.operators import wishlist as W

from . import adapters as A
from .adapters import oracle

Q, S = {}, {}


def wl(f):
    return lambda spark, d: f(A.wishlist(spark, d))


def bk(f):
    return lambda spark, d: f(A.books(spark, d))


Q["j13_unique_external_id"] = wl(lambda b: H.unique_match(b.select("idx", "title"), b.select("title", F.col("size").alias("ext")), "title", "ext").select("idx", "ext"))
S["j13_unique_external_id"] = oracle("wl", "SELECT a.idx, e.ext FROM wl a LEFT JOIN (SELECT title, min(size) AS ext FROM wl GROUP BY title HAVING count(DISTINCT size) = 1) e ON a.title = e.title")
Q["j12_fill_truncated_title"] = wl(lambda b: H.fill_truncated(b.select(F.col("idx").alias("id"), F.substring("title", 1, 9).alias("title")), b.select("title"), 9))
S["j12_fill_truncated_title"] = oracle("wl", "+f AS (SELECT substr(title, 1, 9) AS head, min(title) AS ft FROM wl GROUP BY 1 HAVING count(DISTINCT title) = 1) SELECT idx AS id, CASE WHEN length(substr(title, 1, 9)) >= 9 THEN coalesce(ft, substr(title, 1, 9)) ELSE substr(title, 1, 9) END AS title FROM wl LEFT JOIN f ON substr(title, 1, 9) = head")
Q["m12_mapping_upsert"] = bk(lambda b: H.upsert_mapping(b.where("asin % 3 <> 0"), b.where("asin % 2 = 0").select((F.col("asin") + 300).alias("asin"), "wanted", "purchased", "title"), "asin", ["wanted", "purchased"], ["title"]))
S["m12_mapping_upsert"] = oracle("bk", "+b AS (SELECT * FROM bk WHERE asin % 3 <> 0), i AS (SELECT asin + 300 AS asin, wanted, purchased, title FROM bk WHERE asin % 2 = 0) SELECT coalesce(b.asin, i.asin) AS asin, coalesce(b.wanted, false) OR coalesce(i.wanted, false) AS wanted, coalesce(b.purchased, false) OR coalesce(i.purchased, false) AS purchased, coalesce(b.title, i.title) AS title FROM b FULL JOIN i ON b.asin = i.asin")


def marks(b):
    own = b.where("asin % 5 = 0").select("asin", F.when(F.col("wanted"), "want").otherwise("seen").alias("tag"), F.when(~F.col("wanted"), (F.col("asin") % 7).cast("int")).alias("rating"))
    items = b.where("asin % 4 = 0").select((F.col("asin") % 500 + 1).alias("asin"), F.col("asin").alias("n"), F.when(F.col("asin") % 3 == 0, "").when(F.col("asin") % 3 == 1, "seen").alias("tag"), F.lit(4).alias("rating"))
    return H.import_marks(own, items)


Q["m14_marks_import"] = bk(marks)
S["m14_marks_import"] = oracle("bk", """+o AS (SELECT asin, CASE WHEN wanted THEN 'want' ELSE 'seen' END AS tag, CASE WHEN NOT wanted THEN CAST(asin % 7 AS INTEGER) END AS rating FROM bk WHERE asin % 5 = 0),
i AS (SELECT * FROM (SELECT asin % 500 + 1 AS asin, CASE WHEN asin % 3 = 0 THEN '' WHEN asin % 3 = 1 THEN 'seen' END AS nt, row_number() OVER (PARTITION BY asin % 500 + 1 ORDER BY asin DESC) AS r FROM bk WHERE asin % 4 = 0) WHERE r = 1),
m AS (SELECT coalesce(o.asin, i.asin) AS asin, nullif(coalesce(nt, tag), '') AS tag, CASE WHEN i.asin IS NOT NULL THEN 4 ELSE rating END AS rating FROM o FULL JOIN i ON o.asin = i.asin)
SELECT asin, tag, CASE WHEN tag = 'seen' THEN rating END AS rating FROM m WHERE tag IS NOT NULL""")


def local(b):
    side = lambda k, t: b.where(f"asin % {k} = 0").select("asin", F.concat(F.lit(t), (F.col("asin") % 3).cast("string")).alias("tag"), (F.col("asin") * k % 101).alias("at"))
    return H.merge_local_marks(side(2, "l"), side(3, "s"))


Q["m16_local_marks"] = bk(local)
S["m16_local_marks"] = oracle("bk", "+l AS (SELECT asin, 'l' || (asin % 3) AS tag, asin * 2 % 101 AS t FROM bk WHERE asin % 2 = 0), s AS (SELECT asin, 's' || (asin % 3) AS tag, asin * 3 % 101 AS t FROM bk WHERE asin % 3 = 0) SELECT coalesce(l.asin, s.asin) AS asin, CASE WHEN l.t IS NOT NULL AND (s.t IS NULL OR l.t > s.t) THEN l.tag ELSE s.tag END AS tag, CASE WHEN l.t IS NULL THEN 'kept' WHEN s.t IS NULL OR l.t > s.t THEN 'applied' ELSE 'skipped' END AS outcome FROM l FULL JOIN s ON l.asin = s.asin")


def shown(b):
    tag = F.element_at(F.array(F.lit("want"), F.lit("seen"), F.lit("odd")), (F.col("asin") % 3 + 1).cast("int"))
    return b.select("asin", H.publishable(tag, (F.col("asin") % 8).cast("int")).alias("p")).select("asin", "p.tag", "p.rating")


Q["f15_publishable_mark"] = bk(shown)
S["f15_publishable_mark"] = oracle("bk", "SELECT asin, CASE asin % 3 WHEN 0 THEN 'want' WHEN 1 THEN 'seen' END AS tag, CASE WHEN asin % 3 = 1 AND asin % 8 BETWEEN 1 AND 5 THEN CAST(asin % 8 AS INTEGER) END AS rating FROM bk")
Q["f12_work_list"] = bk(lambda b: H.work_list(b.withColumn("manga", F.col("asin") % 9 == 0), b.where("asin % 4 = 0"), b.where("asin % 7 = 0"), 11))
S["f12_work_list"] = oracle("bk", "SELECT asin, pos FROM (SELECT asin, row_number() OVER (ORDER BY asin) AS pos FROM bk WHERE asin % 9 <> 0 AND NOT purchased AND asin % 4 <> 0 AND asin % 7 <> 0) WHERE pos >= 11")
Q["r01_seen_inputs"] = wl(lambda b: H.seen_inputs(b.select(F.col("idx").alias("asin"), "title", F.col("label").alias("kind"), F.lit("seen").alias("tag"), (F.col("size") % 6).alias("rating"), F.col("size").alias("at")), 20))
S["r01_seen_inputs"] = oracle("wl", "SELECT kind, asin, row_number() OVER (PARTITION BY kind ORDER BY rating DESC NULLS LAST, title, asin) AS pos FROM (SELECT label AS kind, idx AS asin, title, size % 6 AS rating, row_number() OVER (PARTITION BY label ORDER BY size DESC, idx DESC) AS r FROM wl) WHERE r <= 20")
Q["r04_candidate_pool"] = wl(lambda b: H.candidate_pool(b.select(F.col("label").alias("query"), (F.col("idx") % 300).alias("asin"), F.col("size").alias("pos")), b.where("purchased").select((F.col("idx") % 50).alias("asin"))))
S["r04_candidate_pool"] = oracle("wl", "+f AS (SELECT label AS query, idx % 300 AS asin, size AS pos FROM wl WHERE idx % 300 NOT IN (SELECT idx % 50 FROM wl WHERE purchased)), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asin ORDER BY query, pos) AS k FROM f) WHERE k = 1) SELECT query, asin FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY pos, asin) AS r FROM o) WHERE r <= 5")
Q["j21_evidence_overlap"] = lambda spark, d: H.evidence_overlap(A.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("note"), F.col("l_suppkey").alias("point")), [3, 5])
S["j21_evidence_overlap"] = 'SELECT l_orderkey AS note, true AS "any", count(DISTINCT l_suppkey) = 2 AS "all" FROM lineitem WHERE l_suppkey IN (3, 5) GROUP BY l_orderkey'
Q["t04_auto_recompute"] = lambda spark, d: H.auto_recompute(A.read(spark, d, "events").groupBy(F.col("user_id").alias("user")).agg(F.count_if(F.col("event_type") == "purchase").alias("n"), F.floor((F.max(F.unix_micros(F.col("ts").cast("timestamp"))) - F.min(F.unix_micros(F.col("ts").cast("timestamp")))) / 3600000000).alias("hours")))
S["t04_auto_recompute"] = 'SELECT user_id AS "user", count(*) FILTER (WHERE event_type = \'purchase\') >= 10 OR (count(*) FILTER (WHERE event_type = \'purchase\') > 0 AND floor((max(epoch_us(ts)) - min(epoch_us(ts))) / 3600000000) >= 24) AS due FROM events GROUP BY user_id'
Q["g13_seen_summary"] = wl(lambda b: W.seen_summary(b.select(F.col("label").alias("kind"), F.col("purchased").alias("seen"), (F.col("size") % 6).alias("rating"))))
S["g13_seen_summary"] = oracle("wl", "SELECT label AS kind, count(*) FILTER (WHERE purchased) AS seen, count(*) FILTER (WHERE purchased AND size % 6 > 0) AS rated FROM wl GROUP BY label")
Q["f13_manga_classifier"] = wl(lambda b: b.select("idx", W.is_manga(F.col("kind"), F.when(F.col("idx") % 100 == 1, F.lit(True)), "(?i)tin|copper").alias("manga")))
S["f13_manga_classifier"] = oracle("wl", "SELECT idx, idx % 100 = 1 OR regexp_matches(kind, '(?i)tin|copper') AS manga FROM wl")
Q["f17_pending_points"] = lambda spark, d: A.highlights(spark, d).where("not deleted").select("id").join(A.points(spark, d).select("id"), "id", "left_anti")
S["f17_pending_points"] = oracle("hl", "SELECT id FROM hl WHERE NOT deleted AND id NOT IN (SELECT vec_id FROM embeddings)")
