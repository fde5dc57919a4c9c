"""Queries over analysis snapshots, publishing and recommendations with their oracle SQL."""

from pyspark.sql import functions as F

from lectern.operators import analysis as N
from lectern.operators import prices as P
from lectern.operators import vectors as V
from lectern.operators import wishlist as W

from . import adapters as A
from .adapters import oracle

Q, S = {}, {}


def pt(f):
    return lambda spark, d: f(A.points(spark, d))


Q["a16_rebuild"] = lambda spark, d: A.read(spark, d, "embeddings").agg(F.count("*").alias("n")).select(F.lit(N.rebuild(A.read(spark, d, "embeddings").count(), 320, True, 5)).alias("rebuild"), "n")
S["a16_rebuild"] = "SELECT count(*) >= 480 AS rebuild, count(*) AS n FROM embeddings"
Q["a17_line_samples"] = pt(lambda p: N.line_samples(p.select("line", "id", (F.col("id") % 9 == 0).alias("favorite"), F.col("id").alias("place")), 6))
S["a17_line_samples"] = oracle("pt", "+s AS (SELECT * FROM (SELECT line, id, row_number() OVER (PARTITION BY line ORDER BY CASE WHEN id % 9 = 0 THEN 0 ELSE 1 END, id) AS r FROM pt) WHERE r <= 6) SELECT line, id, row_number() OVER (PARTITION BY line ORDER BY id) - 1 AS pos FROM s")
Q["a18_placed"] = pt(lambda p: N.placed(p.select("line", "id"), p.where("id % 3 > 0").select((F.col("line") % 5).alias("line"), "id")))
S["a18_placed"] = oracle("pt", "+b AS (SELECT CASE WHEN id % 3 > 0 THEN line % 5 ELSE line END AS line, id FROM pt WHERE id % 3 = 0 OR line % 5 IN (SELECT line FROM pt)), k AS (SELECT line FROM b GROUP BY line HAVING count(*) >= 2) SELECT line, id FROM b WHERE line IN (SELECT line FROM k)")
Q["a19_resembling"] = pt(lambda p: N.resembling(p.select("line", "id"), p.where("id % 2 = 0").select((F.col("line") % 4).alias("set"), "id")))
S["a19_resembling"] = oracle("pt", "+m AS (SELECT line, line % 4 AS s, count(*) AS n FROM pt WHERE id % 2 = 0 GROUP BY 1, 2), z AS (SELECT line, count(*) AS size FROM pt GROUP BY line) SELECT DISTINCT m.line FROM m JOIN z ON m.line = z.line WHERE n >= 2 AND n >= 0.5 * size")
Q["a20_without_dismissed"] = pt(lambda p: N.without_dismissed(p.select("line", (F.col("line") % 6).alias("plane")).distinct(), p.select("line", "id"), p.where("line % 4 = 1").select("line").distinct()))
S["a20_without_dismissed"] = oracle("pt", "+l AS (SELECT DISTINCT line, line % 6 AS plane FROM pt WHERE line % 4 <> 1), k AS (SELECT plane FROM l GROUP BY plane HAVING count(*) >= 2) SELECT plane, pt.line, id FROM pt JOIN l ON pt.line = l.line WHERE plane IN (SELECT plane FROM k)")


def reps(p):
    low = p.groupBy("line").agg(F.min("id").alias("id"))
    judged = p.select("id", (F.col("id") % 4).cast("long").alias("n")).where("n > 0")
    return N.far_reps(low, p.join(low, "id", "left_anti").where("id % 6 = 0"), judged, 60)


REPS = "+lw AS (SELECT line, min(id) AS id FROM pt GROUP BY line), rp AS (SELECT id, row_number() OVER (ORDER BY k, n, id) - 1 AS pos FROM (SELECT id, 0 AS k, 0 AS n FROM lw UNION ALL SELECT id, 1, id % 4 FROM pt WHERE id % 6 = 0 AND id NOT IN (SELECT id FROM lw)) ORDER BY k, n, id LIMIT 60)"
Q["a23_far_reps"] = pt(reps)
S["a23_far_reps"] = oracle("pt", REPS + " SELECT id, pos FROM rp")


def far(p):
    return N.far_pairs(reps(p).join(p.select("id", "source", (F.col("line") % 5).alias("plane"), "v"), "id"))


FAR = REPS + ", fp AS (SELECT a.id AS a, b.id AS b, round(list_dot_product(CAST(x.v AS DOUBLE[]), CAST(y.v AS DOUBLE[])), 6) AS sim FROM rp a JOIN rp b ON a.pos < b.pos JOIN pt x ON a.id = x.id JOIN pt y ON b.id = y.id WHERE x.source <> y.source AND x.line % 5 <> y.line % 5)"
Q["j16_far_pairs"] = pt(far)
S["j16_far_pairs"] = oracle("pt", FAR + " SELECT a, b, sim FROM fp")
Q["a24_far_candidates"] = pt(lambda p: V.band(far(p)).select("a", "b"))
S["a24_far_candidates"] = oracle("pt", FAR + ", o AS (SELECT *, row_number() OVER (ORDER BY sim) - 1 AS k, count(*) OVER () AS m FROM fp) SELECT a, b FROM o WHERE sim >= (SELECT min(sim) FROM o WHERE k = floor(0.15 * m)) AND sim <= (SELECT max(sim) FROM o WHERE k = floor(0.45 * m))")
Q["a27_peers"] = lambda spark, d: N.peers(A.read(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), F.col("l_returnflag").alias("kind")))
S["a27_peers"] = "SELECT 'p' || l_partkey AS node, l_returnflag AS kind, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT 's' || l_suppkey, l_returnflag, count(DISTINCT l_partkey) FROM lineitem GROUP BY ALL"


def profile(spark, d):
    t = A.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    w = V.tfidf(V.grams(t), t.count())
    return N.closest_titles(w.where("id % 100 = 0"), w, 8)


Q["a28_closest_titles"] = profile
S["a28_closest_titles"] = """WITH p AS (SELECT p_partkey AS id, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS p FROM part), gr AS (SELECT id, substr(p, i, n) AS gram FROM (SELECT id, p, n, unnest(range(1, length(p) - n + 2)) AS i FROM p, (SELECT unnest([2, 3]) AS n))), tf AS (SELECT id, gram, count(*) AS tf FROM gr GROUP BY id, gram),
df AS (SELECT gram, count(*) AS df FROM tf GROUP BY gram), w AS (SELECT id, tf.gram, (1 + ln(tf)) * (ln(((SELECT count(*) FROM part) + 1.0) / (df + 1)) + 1) * CASE WHEN df > 1 THEN 1.0 ELSE 0.3 END AS w FROM tf JOIN df ON tf.gram = df.gram), u AS (SELECT w.id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY w.id)) AS x FROM w),
s AS (SELECT a.id AS profile, b.id, round(sum(a.x * b.x), 6) AS sim FROM u a JOIN u b ON a.gram = b.gram WHERE a.id % 100 = 0 GROUP BY a.id, b.id) SELECT profile, id, sim FROM (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY sim DESC, id) AS r FROM s) WHERE r <= 8"""


def titled(spark, d):
    p = A.read(spark, d, "part")
    left = p.select(F.col("p_partkey").alias("id"), F.substring_index("p_name", " ", 1).alias("title"), F.col("p_brand").alias("author"))
    right = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"))
    return N.title_match_counts(left, right)


Q["j11_title_matches"] = titled
S["j11_title_matches"] = "WITH a AS (SELECT p_partkey AS l, split_part(p_name, ' ', 1) AS t, p_brand FROM part), b AS (SELECT p_partkey AS r, p_name AS t, p_brand FROM part) SELECT l, count(*) AS n FROM a JOIN b ON a.p_brand = b.p_brand AND length(a.t) >= 4 AND length(b.t) >= 4 AND (contains(a.t, b.t) OR contains(b.t, a.t)) GROUP BY l"


def publish(spark, d):
    b, h = A.books(spark, d), A.price_history(spark, d)
    marks = b.where("asin % 5 = 0").select("asin", F.when(F.col("wanted"), "want").otherwise("seen").alias("tag"))
    target = b.where("target is not null").select("asin", F.col("target").alias("goal"))
    label = b.where("asin % 3 = 1").select("asin", F.concat(F.lit("L"), F.col("asin") % 7).alias("name"))
    reasons = b.where("asin % 11 = 0").select("asin", F.lit("not_found").alias("why"))
    out = N.published(b.select("asin", "title"), marks=marks, trend=P.trend(h), history=h.groupBy("asin").agg(F.count("*").alias("n"), F.max("ts").alias("last")), reason=reasons, target=target, publisher=label)
    return out.select("asin", "title", "marks.tag", "trend.prev", "trend.low", "history.n", "history.last", "reason.why", "target.goal", F.col("publisher.name").alias("publisher"))


Q["j04_published"] = publish
S["j04_published"] = oracle("bk ph", """+p AS (SELECT asin, ts, id, price, lag(price) OVER (PARTITION BY asin ORDER BY ts, id) AS before FROM ph WHERE NOT ku AND price IS NOT NULL), t AS (SELECT asin, arg_max(before, (ts, id)) FILTER (WHERE before IS NOT NULL AND before <> price) AS prev, min(price) AS low FROM p GROUP BY asin), h AS (SELECT asin, count(*) AS n, max(ts) AS last FROM ph GROUP BY asin)
SELECT bk.asin, title, CASE WHEN bk.asin % 5 = 0 THEN CASE WHEN wanted THEN 'want' ELSE 'seen' END END AS tag, prev, low, n, last, CASE WHEN bk.asin % 11 = 0 THEN 'not_found' END AS why, target AS goal, CASE WHEN bk.asin % 3 = 1 THEN 'L' || bk.asin % 7 END AS publisher FROM bk LEFT JOIN t ON bk.asin = t.asin LEFT JOIN h ON bk.asin = h.asin""")
Q["w01_value_runs"] = lambda spark, d: N.value_runs(A.versions(spark, d), "user", ["updated", "id"], "value")
S["w01_value_runs"] = oracle("vs", """+r AS (SELECT "user", updated, id, value, lag(value) OVER (PARTITION BY "user" ORDER BY updated, id) AS before FROM vs WHERE value IS NOT NULL)
SELECT "user", arg_max(value, (updated, id)) AS current, arg_max(before, (updated, id)) FILTER (WHERE before IS NOT NULL AND before <> value) AS prev, arg_max(updated, (updated, id)) FILTER (WHERE before IS NULL OR before <> value) AS since, min(value) AS low, arg_min(updated, (value, updated, id)) AS low_since FROM r GROUP BY "user\"""")


def marked(spark, d):
    w = A.wishlist(spark, d)
    return w.select("idx", "price", "ku", F.when(F.col("idx") % 4 > 0, F.col("price") + (F.col("idx") % 5 - 2)).alias("prev"), F.when(F.col("idx") % 3 > 0, F.col("price") + (F.col("idx") % 2 * 2 - 1)).alias("low"), F.when(F.col("purchased"), "purchased").alias("stop"))


Q["f09_price_marks"] = lambda spark, d: marked(spark, d).select("idx", *[N.price_mark(m).alias(m) for m in ("drop", "lowest", "missing")])
S["f09_price_marks"] = oracle("wl", "+m AS (SELECT *, price IS NOT NULL AND idx % 4 > 0 AND NOT purchased AS known FROM wl) SELECT idx, known AND idx % 5 > 2 AS \"drop\", known AND idx % 3 > 0 AND idx % 2 = 1 AS lowest, price IS NULL AND NOT ku AS missing FROM m")
Q["f11_reading_counts"] = lambda spark, d: W.reading_state(A.wishlist(spark, d).where("purchased"), A.wishlist(spark, d).where("idx % 9 = 0").select("idx", F.lit(1).alias("n")), A.wishlist(spark, d).where("idx % 500 = 1").select("title", F.col("idx").alias("n"))).groupBy("state").agg(F.count("*").alias("n"))
S["f11_reading_counts"] = oracle("wl", "SELECT CASE WHEN idx % 9 = 0 OR title IN (SELECT title FROM wl WHERE idx % 500 = 1) THEN 'reading' ELSE 'unread' END AS state, count(*) AS n FROM wl WHERE purchased GROUP BY 1")
Q["o01_sort_rating"] = lambda spark, d: W.ranked(A.wishlist(spark, d).withColumn("stars", N.rating_order(F.when(F.col("wanted"), "seen").otherwise("want"), F.col("idx") % 6)), "stars", True)
S["o01_sort_rating"] = oracle("wl", "SELECT idx, row_number() OVER (ORDER BY CASE WHEN wanted THEN coalesce(nullif(idx % 6, 0), 0.5) ELSE 0 END DESC, idx) AS pos FROM wl")
Q["o01_sort_drop"] = lambda spark, d: W.ranked(marked(spark, d).withColumn("amount", F.when(N.price_mark("drop"), F.round(F.col("prev") - F.col("price"), 2)).otherwise(0.0)), "amount", True)
S["o01_sort_drop"] = oracle("wl", "SELECT idx, row_number() OVER (ORDER BY CASE WHEN price IS NOT NULL AND idx % 4 > 0 AND NOT purchased AND idx % 5 > 2 THEN idx % 5 - 2 ELSE 0 END DESC, idx) AS pos FROM wl")
Q["r02_valid_picks"] = lambda spark, d: N.valid_picks(A.read(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).otherwise(F.lit(-1).cast("long")).alias("asin"), F.concat(F.lit("CUSTOMER#"), F.lpad((F.col("o_orderkey") % 400).cast("string"), 9, "0")).alias("title")), A.books(spark, d).select("asin", "title"), 200)
S["r02_valid_picks"] = oracle("bk", "+r AS (SELECT o_orderkey AS pos, CASE WHEN o_orderkey % 2 = 0 AND o_custkey IN (SELECT asin FROM bk) THEN o_custkey ELSE (SELECT min(asin) FROM bk WHERE lower(title) = 'customer#' || lpad(CAST(o_orderkey % 400 AS VARCHAR), 9, '0')) END AS asin FROM orders) SELECT asin, min(pos) AS pos FROM r WHERE asin IS NOT NULL GROUP BY asin ORDER BY pos, asin LIMIT 200")
Q["r03_catalogue_hits"] = lambda spark, d: N.catalogue_hits(A.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("query"), F.when(F.col("l_quantity") > 10, F.col("l_partkey")).alias("isbn"), F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("source")), ("R", "A"), 1996, 3).groupBy("query", "source").agg(F.count("*").alias("n"))
S["r03_catalogue_hits"] = "WITH f AS (SELECT l_orderkey AS query, l_returnflag AS source, CASE l_returnflag WHEN 'R' THEN 1 ELSE 2 END AS k FROM lineitem WHERE l_quantity > 10 AND abs(year(l_shipdate) - 1996) <= 3 AND l_returnflag IN ('R', 'A')) SELECT query, source, count(*) AS n FROM f WHERE k = (SELECT min(k) FROM f g WHERE g.query = f.query) GROUP BY ALL"
Q["r06_named_candidate"] = lambda spark, d: N.named_candidate(A.read(spark, d, "orders").select(F.col("o_orderkey").alias("pick"), (F.col("o_orderkey") % 50).alias("index"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("read 『Customer#"), F.lpad((F.col("o_orderkey") % 200).cast("string"), 9, "0"), F.lit("』 next"))).otherwise("good").alias("reason")), A.books(spark, d).select(F.col("asin").alias("id"), F.col("asin").alias("index"), "title"))
S["r06_named_candidate"] = oracle("bk", "SELECT o_orderkey AS pick, coalesce((SELECT asin FROM bk WHERE o_orderkey % 3 = 0 AND title = 'Customer#' || lpad(CAST(o_orderkey % 200 AS VARCHAR), 9, '0')), o_orderkey % 50) AS id FROM orders")
Q["r07_existence"] = lambda spark, d: A.read(spark, d, "lineitem").groupBy("l_orderkey").agg(N.existence(F.count("*"), F.count_if(F.col("l_quantity") > 5), F.count_if(F.col("l_quantity") > 40)).alias("state"))
S["r07_existence"] = "SELECT l_orderkey, CASE WHEN count(*) FILTER (WHERE l_quantity > 40) > 0 THEN 'verified' WHEN count(*) FILTER (WHERE l_quantity > 5) = count(*) THEN 'false' ELSE 'unknown' END AS state FROM lineitem GROUP BY l_orderkey"
Q["x27_sync_outcome"] = lambda spark, d: N.sync_outcome(A.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), (F.col("l_returnflag") != "R").alias("ok"), F.floor(F.col("l_quantity") / 45).alias("found")))
S["x27_sync_outcome"] = "SELECT l_orderkey AS run, CASE WHEN count(*) FILTER (WHERE l_returnflag = 'R') = count(*) THEN 'failed' WHEN count(*) FILTER (WHERE l_returnflag = 'R') > 0 THEN 'partial' WHEN sum(floor(l_quantity / 45)) = 0 THEN 'broken' ELSE 'ok' END AS outcome FROM lineitem GROUP BY l_orderkey"


def wishes(spark, d):
    o = A.read(spark, d, "orders")
    items = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_custkey")).alias("asin"), F.concat(F.lit("Order "), F.col("o_orderkey") % 90).alias("title"), (F.col("o_orderstatus") == "P").alias("failed"), F.col("o_orderpriority"))
    seen = o.where("o_orderkey % 30 = 0").select(F.concat(F.lit("ORDER  "), F.col("o_orderkey") % 90).alias("title"), F.col("o_custkey").alias("asin"))
    return N.wish_sync(items, seen, F.col("o_orderpriority") == "5-LOW").groupBy("state").agg(F.count("*").alias("n"))


Q["x24_wish_sync"] = wishes
S["x24_wish_sync"] = "WITH s AS (SELECT o_orderkey % 90 AS t, o_custkey AS a FROM orders WHERE o_orderkey % 30 = 0) SELECT CASE WHEN o_orderkey % 90 IN (SELECT t FROM s) THEN 'seen-title' WHEN o_orderkey % 5 > 0 AND o_custkey IN (SELECT a FROM s) THEN 'seen-asin' WHEN o_orderpriority = '5-LOW' THEN 'manga' WHEN o_orderkey % 5 = 0 THEN 'unresolved' WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'registered' END AS state, count(*) AS n FROM orders GROUP BY 1"
