"""Vector, graph and text queries with their oracle SQL."""

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import graph as G
from lectern.operators import reports as R
from lectern.operators import vectors as V

from . import adapters as A
from .adapters import oracle

Q, S = {}, {}


def pt(f):
    return lambda spark, d: f(A.points(spark, d))


CENT = "+cs AS (SELECT line, i, sum(x) AS x FROM px GROUP BY line, i), cn AS (SELECT line, sqrt(sum(x * x)) AS n FROM cs GROUP BY line), ct AS (SELECT cs.line, i, x / n AS c FROM cs JOIN cn ON cs.line = cn.line)"
OWN = CENT + ", sm AS (SELECT px.id, px.line, sum(x * c) AS sim FROM px JOIN ct ON px.line = ct.line AND px.i = ct.i GROUP BY px.id, px.line)"
ALL = CENT + ", al AS (SELECT px.id, ct.line AS centre, round(sum(x * c), 9) AS sim FROM px JOIN ct ON px.i = ct.i GROUP BY px.id, ct.line)"

Q["a01_unit_length"] = pt(lambda p: p.select("id", F.round(V.dot(V.normalised(F.col("v")), V.normalised(F.col("v"))), 6).alias("length")))
S["a01_unit_length"] = oracle("px", "SELECT id, 1.0 AS length FROM px GROUP BY id")
Q["g20_centroids"] = pt(lambda p: V.centroids(p).select("line", F.posexplode("c").alias("i", "c")).select("line", "i", F.round("c", 6).alias("c")))
S["g20_centroids"] = oracle("px", CENT + " SELECT line, i, round(c, 6) AS c FROM ct")
Q["a05_nearest_centroid"] = pt(lambda p: V.nearest_centroid(p, V.centroids(p)).select("id", "best", F.round("sim", 6).alias("sim")))
S["a05_nearest_centroid"] = oracle("px", ALL + " SELECT id, centre AS best, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, centre) AS r FROM al) WHERE r = 1")
Q["g21_line_stats"] = pt(lambda p: V.line_stats(p, V.centroids(p)))
S["g21_line_stats"] = oracle("px", OWN + " SELECT line, round(percentile_disc(0.5) WITHIN GROUP (ORDER BY sim), 6) AS median, round(avg(sim), 6) AS mean, round(stddev_pop(sim), 6) AS sd FROM sm GROUP BY line")
Q["a07_outliers"] = pt(lambda p: V.outliers(p, V.centroids(p)))
S["a07_outliers"] = oracle("px", OWN + " SELECT sm.id, sm.line FROM sm JOIN (SELECT line, avg(sim) - 1.5 * stddev_pop(sim) AS low FROM sm GROUP BY line) l ON sm.line = l.line WHERE sim < low")
Q["a09_neighbours"] = pt(lambda p: V.neighbours(p, V.centroids(p), 5, 8).select("id", "other", "sim"))
S["a09_neighbours"] = oracle("px", ALL + """, nr AS (SELECT id, centre AS line FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, centre) AS r FROM al) WHERE r <= 8),
ps AS (SELECT DISTINCT id, line, source FROM px), cd AS (SELECT nr.id, b.id AS other FROM nr JOIN ps a ON nr.id = a.id JOIN ps b ON nr.line = b.line AND a.source <> b.source),
sc AS (SELECT cd.id, other, round(list_dot_product(CAST(ea.embedding AS DOUBLE[]), CAST(eb.embedding AS DOUBLE[])), 6) AS sim FROM cd JOIN embeddings ea ON cd.id = ea.vec_id JOIN embeddings eb ON cd.other = eb.vec_id)
SELECT id, other, sim FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, other) AS r FROM sc) WHERE r <= 5""")
RANK = "rk AS (SELECT b.id AS query, a.id, round(sum(a.x * b.x), 6) AS sim FROM px a JOIN px b ON a.i = b.i AND b.id % 100 = 0 AND a.id <> b.id GROUP BY b.id, a.id), tp AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, id) AS r FROM rk)"


def asked(p, n=30):
    return V.search(p.where("id % 100 = 0"), p, n)


Q["a12_semantic_rank"] = pt(lambda p: asked(p).select("query", "id", "sim"))
S["a12_semantic_rank"] = oracle("px", "+" + RANK + " SELECT query, id, sim FROM tp WHERE r <= 30")
Q["a13_ask_context"] = pt(lambda p: V.ask_context(asked(p), 0.2, 0.15))
S["a13_ask_context"] = oracle("px", "+" + RANK + " SELECT query, id, sim FROM tp WHERE r <= 8 AND sim >= 0.15 AND query IN (SELECT query FROM tp GROUP BY query HAVING max(sim) >= 0.2)")


def uncited(p):
    cited = p.where("id % 100 = 0").select(F.col("id").alias("query"), F.explode(F.sequence(F.col("id") - 20, F.col("id") + 20)).alias("id"))
    return V.search(p.where("id % 100 = 0"), p, 10, cited).select("query", "id", "sim")


Q["a11_note_neighbours"] = pt(uncited)
S["a11_note_neighbours"] = oracle("px", "+" + RANK + " SELECT query, id, sim FROM (SELECT query, id, sim, row_number() OVER (PARTITION BY query ORDER BY sim DESC, id) AS n FROM rk WHERE abs(query - id) > 20) WHERE n <= 10")
Q["a10_related"] = pt(lambda p: V.related(p, V.centroids(p)).select("line", "id", F.round("sim", 6).alias("sim")))
S["a10_related"] = oracle("px", ALL + """, own AS (SELECT DISTINCT id, line FROM px), sec AS (SELECT * FROM (SELECT al.id, al.centre, al.sim, row_number() OVER (PARTITION BY al.id ORDER BY al.sim DESC, al.centre) AS r FROM al JOIN own ON al.id = own.id AND al.centre <> own.line) WHERE r = 1),
md AS (SELECT own.line, percentile_disc(0.5) WITHIN GROUP (ORDER BY al.sim) AS median FROM al JOIN own ON al.id = own.id AND al.centre = own.line GROUP BY own.line)
SELECT line, id, round(sim, 6) AS sim FROM (SELECT sec.centre AS line, sec.id, sec.sim, row_number() OVER (PARTITION BY sec.centre ORDER BY sec.sim DESC, sec.id) AS n FROM sec JOIN md ON sec.centre = md.line WHERE sec.sim >= md.median) WHERE n <= 12""")
Q["a14_left_out_limits"] = pt(lambda p: V.left_out_limits(p, V.centroids(p)).select("id", "line", F.round("limit", 5).alias("limit")))
S["a14_left_out_limits"] = oracle("px", OWN + ', lo AS (SELECT a.id, a.line, avg(b.sim) - 1.5 * stddev_pop(b.sim) AS "limit" FROM sm a JOIN sm b ON a.line = b.line AND a.id <> b.id GROUP BY a.id, a.line) SELECT id, line, round("limit", 5) AS "limit" FROM lo')
Q["a26_sunflower"] = pt(lambda p: V.sunflower(p).select("id", F.round("x", 5).alias("x"), F.round("y", 5).alias("y")))
S["a26_sunflower"] = oracle("pt", "+n AS (SELECT id, row_number() OVER (PARTITION BY line ORDER BY id) - 1 AS k FROM pt) SELECT id, round(sqrt(k + 0.5) * cos(k * pi() * (3 - sqrt(5))), 5) AS x, round(sqrt(k + 0.5) * sin(k * pi() * (3 - sqrt(5))), 5) AS y FROM n")
Q["w08_similarity_band"] = pt(lambda p: V.band(V.line_similarities(p, V.centroids(p)).withColumn("sim", F.round("sim", 9))).select("id"))
S["w08_similarity_band"] = oracle("px", OWN + ", o AS (SELECT id, round(sim, 9) AS sim, row_number() OVER (ORDER BY round(sim, 9)) - 1 AS k, count(*) OVER () AS m FROM sm) SELECT id FROM o WHERE sim >= (SELECT min(sim) FROM o WHERE k = floor(0.15 * m)) AND sim <= (SELECT max(sim) FROM o WHERE k = floor(0.45 * m))")

PARTS = "+p AS (SELECT p_partkey AS id, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS p FROM part), gr AS (SELECT id, substr(p, i, n) AS gram FROM (SELECT id, p, n, unnest(range(1, length(p) - n + 2)) AS i FROM p, (SELECT unnest([2, 3]) AS n))), tf AS (SELECT id, gram, count(*) AS tf FROM gr WHERE length(gram) >= 2 GROUP BY id, gram)"


def titles(spark, d):
    return A.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))


Q["a02_char_grams"] = lambda spark, d: V.grams(titles(spark, d)).groupBy("gram").agg(F.sum("tf").alias("tf"))
S["a02_char_grams"] = "WITH " + PARTS[1:] + " SELECT gram, CAST(sum(tf) AS BIGINT) AS tf FROM tf GROUP BY gram"
Q["g23_document_frequency"] = lambda spark, d: V.grams(titles(spark, d)).groupBy("gram").agg(F.count("id").alias("df"))
S["g23_document_frequency"] = "WITH " + PARTS[1:] + " SELECT gram, count(DISTINCT id) AS df FROM tf GROUP BY gram"


def weights(spark, d):
    t = titles(spark, d)
    return V.tfidf(V.grams(t), t.count()).groupBy("id").agg(F.round(F.sum(F.col("w") * F.col("w")), 4).alias("norm2"))


Q["a03_tfidf"] = weights
S["a03_tfidf"] = "WITH " + PARTS[1:] + ", df AS (SELECT gram, count(*) AS df FROM tf GROUP BY gram) SELECT id, round(sum(power((1 + ln(tf)) * (ln(((SELECT count(*) FROM p) + 1.0) / (df + 1)) + 1) * CASE WHEN df > 1 THEN 1.0 ELSE 0.3 END, 2)), 4) AS norm2 FROM tf JOIN df ON tf.gram = df.gram GROUP BY id"


def pointers(spark, d):
    c = A.read(spark, d, "customer")
    k = F.col("c_custkey")
    return G.current_ids(c.select(k.alias("id"), F.when(k % 12 != 0, k + 1).alias("next")))


Q["j18_pointer_chase"] = pointers
S["j18_pointer_chase"] = "WITH c AS (SELECT c_custkey AS id, CAST(12 - (c_custkey % 12) AS BIGINT) % 12 AS togo, (SELECT max(c_custkey) FROM customer) AS last FROM customer) SELECT id, id + least(togo, 10, last + 1 - id) AS current FROM c"


def links(spark, d):
    li = A.read(spark, d, "lineitem")
    return G.newest_per_peer(li.select(F.col("l_suppkey").alias("a"), (F.col("l_suppkey") + F.col("l_partkey") % 5 + 1).alias("b"), F.col("l_shipdate").cast("date").alias("at")))


Q["j20_newest_per_peer"] = links
S["j20_newest_per_peer"] = "WITH l AS (SELECT l_suppkey AS a, l_suppkey + l_partkey % 5 + 1 AS b, CAST(l_shipdate AS DATE) AS t FROM lineitem) SELECT node, peer, max(t) AS \"at\" FROM (SELECT a AS node, b AS peer, t FROM l UNION ALL SELECT b, a, t FROM l) GROUP BY node, peer"
Q["a21_snapshot_diff"] = pt(lambda p: G.diff(p.where("id % 3 <> 0 and line <> 4").select("line", F.col("id").alias("point")), p.where("line <> 5").select("line", F.col("id").alias("point"))))
S["a21_snapshot_diff"] = oracle("pt", "SELECT line, CASE WHEN line = 4 THEN 'added' WHEN line = 5 THEN 'removed' WHEN count(*) FILTER (WHERE id % 3 = 0) > 0 THEN 'grown' ELSE 'kept' END AS state, CASE WHEN line = 4 THEN count(*) WHEN line = 5 THEN 0 ELSE count(*) FILTER (WHERE id % 3 = 0) END AS n_new FROM pt GROUP BY line HAVING line <> 5 OR count(*) FILTER (WHERE id % 3 <> 0) > 0")


def planes(spark, d):
    o = A.read(spark, d, "lineitem")
    ev = o.select(F.col("l_orderkey").alias("note"), F.col("l_suppkey").alias("point"))
    s = A.read(spark, d, "supplier").select(F.col("s_suppkey").alias("point"), F.col("s_nationkey").alias("plane"))
    return G.main_plane(ev, s)


Q["j22_main_plane"] = planes
S["j22_main_plane"] = "SELECT note, plane FROM (SELECT l_orderkey AS note, s_nationkey AS plane, row_number() OVER (PARTITION BY l_orderkey ORDER BY count(*) DESC, s_nationkey) AS r FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_orderkey, s_nationkey) WHERE r = 1"
Q["a25_graph_edges"] = lambda spark, d: G.tree_edges(A.read(spark, d, "nation").select(F.col("n_regionkey").alias("plane"), F.col("n_nationkey").alias("line")), A.read(spark, d, "supplier").select(F.col("s_nationkey").alias("line"), F.col("s_suppkey").alias("point")))
S["a25_graph_edges"] = "SELECT 'p' || n_regionkey AS src, 'l' || n_nationkey AS dst, 'plane' AS kind FROM nation UNION ALL SELECT 'l' || s_nationkey, 'h' || s_suppkey, 'line' FROM supplier"


def quota(spark, d):
    o = A.read(spark, d, "orders")
    return G.keep_with_quota(o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("at"), (F.col("o_orderkey") % 3 == 0).alias("wrong")), 50).select("id")


Q["o06_keep_with_quota"] = quota
S["o06_keep_with_quota"] = "SELECT id FROM (SELECT o_orderkey AS id, sum(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END) OVER (ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC ROWS UNBOUNDED PRECEDING) AS k FROM orders) WHERE k <= 50"

Q["c02_clean_text"] = lambda spark, d: A.read(spark, d, "documents").select("doc_id", F.md5(T.clean_text(F.concat("text", F.lit("  \r\n \n\n\nend ")))).alias("h"))
S["c02_clean_text"] = r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text || '  ' || chr(13) || chr(10) || ' ' || chr(10) || chr(10) || chr(10) || 'end ', chr(13) || chr(10) || '?', chr(10), 'g'), '[ ' || chr(9) || ']+' || chr(10), chr(10), 'g'), chr(10) || '{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13))) AS h FROM documents"
Q["c08_html_text"] = lambda spark, d: A.read(spark, d, "pages").select("page_id", F.md5(T.html_text(F.col("html"))).alias("h"))
S["c08_html_text"] = r'''SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '(?i)</?(p|div|br|li|ul|tr|td|h[1-6]|table)[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g').replace('&copy;', '©').replace('&middot;', '·').replace('&quot;', '"').replace('&amp;', '&'), chr(13) || chr(10) || '?', chr(10), 'g'), '[ ' || chr(9) || ']+' || chr(10), chr(10), 'g'), chr(10) || '{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13))) AS h FROM pages'''
Q["c09_mask_credentials"] = lambda spark, d: A.read(spark, d, "pages").select("page_id", T.mask_credentials(F.concat(F.lit("https://me:pw@"), F.col("url"))).alias("u"))
S["c09_mask_credentials"] = "SELECT page_id, regexp_replace('https://me:pw@' || url, '://[^/@ ]+@', '://***@', 'g') AS u FROM pages"
Q["c15_price_text"] = lambda spark, d: A.read(spark, d, "part").select("p_partkey", T.price_of(F.concat(F.lit("¥ "), F.when(F.col("p_partkey") % 2 == 0, F.translate(F.format_number(F.col("p_partkey") * 37, 0), "0123456789,", "０１２３４５６７８９，")).otherwise(F.format_number(F.col("p_partkey") * 37, 0)), F.lit(" incl. 10"))).alias("price"))
S["c15_price_text"] = "SELECT p_partkey, CAST(p_partkey * 37 AS BIGINT) AS price FROM part"


def landed(spark, d):
    """Pages with statuses of all kinds and none; every fifth shows a block, at all statuses."""
    k = F.col("o_orderkey")
    code = F.element_at(F.array(*[F.lit(x) for x in (200, 301, 403, 404, 429, 500, 503)], F.lit(None).cast("int")), (k % 8 + 1).cast("int"))
    title = F.when(k % 5 == 0, "Robot Check").otherwise("A book")
    return A.read(spark, d, "orders").select("o_orderkey", code.alias("code"), R.page_label(F.lit("https://store/dp/1"), title, F.repeat(F.lit("text "), 60)).alias("label"))


Q["c16_status_reason"] = lambda spark, d: landed(spark, d).select("o_orderkey", T.status_reason(F.col("code"), F.col("label") != "ok").alias("reason"))
S["c16_status_reason"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'blocked' WHEN o_orderkey % 8 IN (2, 4, 5, 6) THEN 'page_error' WHEN o_orderkey % 8 = 3 THEN 'not_found' ELSE 'no_price' END AS reason FROM orders"
Q["f25_isbn10"] = lambda spark, d: A.read(spark, d, "customer").select("c_custkey", T.isbn10(F.lpad((F.col("c_custkey") * 66601).cast("string"), 9, "0")).alias("isbn"))
S["f25_isbn10"] = "WITH a AS (SELECT c_custkey, lpad(CAST(c_custkey * 66601 AS VARCHAR), 9, '0') AS d FROM customer), b AS (SELECT c_custkey, d, (11 - (10 * CAST(substr(d, 1, 1) AS INTEGER) + 9 * CAST(substr(d, 2, 1) AS INTEGER) + 8 * CAST(substr(d, 3, 1) AS INTEGER) + 7 * CAST(substr(d, 4, 1) AS INTEGER) + 6 * CAST(substr(d, 5, 1) AS INTEGER) + 5 * CAST(substr(d, 6, 1) AS INTEGER) + 4 * CAST(substr(d, 7, 1) AS INTEGER) + 3 * CAST(substr(d, 8, 1) AS INTEGER) + 2 * CAST(substr(d, 9, 1) AS INTEGER)) % 11) % 11 AS k FROM a) SELECT c_custkey, d || CASE WHEN k = 10 THEN 'X' ELSE CAST(k AS VARCHAR) END AS isbn FROM b"
