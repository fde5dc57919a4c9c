"""Clusters under limits, carried-over snapshots and what joined since, with their oracle SQL where
no random start decides."""

from pyspark.sql import functions as F

from lectern.operators import analysis as N
from lectern.operators import clusters as C
from lectern.operators import far as R
from lectern.operators import graph as G
from lectern.operators import vectors as V

from . import adapters as A
from .adapters import oracle
from .analysis_queries import FAR, far, pt

Q, S = {}, {}

MATRIX = """+cs AS (SELECT line, i, sum(x) AS x FROM px GROUP BY line, i), cn AS (SELECT line, sqrt(sum(x * x)) AS n FROM cs GROUP BY line),
ct AS (SELECT cs.line, i, x / n AS c FROM cs JOIN cn ON cs.line = cn.line),
al AS (SELECT px.id, ct.line AS c, round(sum(px.x * ct.c), 9) AS sim FROM px JOIN ct ON px.i = ct.i GROUP BY px.id, ct.line)"""


def capped(p):
    n, centres = p.count(), V.centroids(p).persist()
    return C.assign_capped(p, centres, -(-11 * n // (10 * centres.count()))).select("id", "line")


Q["a06_capped_assignment"] = pt(capped)
#: Places all pairs one after the other.
S["a06_capped_assignment"] = oracle("px", MATRIX + """,
k AS (SELECT line, row_number() OVER (ORDER BY line) AS j FROM cn),
pr AS (SELECT al.id, k.j, k.line, row_number() OVER (ORDER BY sim DESC, al.id, al.c) AS s FROM al JOIN k ON al.c = k.line),
lim AS (SELECT CAST(ceil(1.1 * count(DISTINCT id) / count(DISTINCT j)) AS BIGINT) AS cap, CAST(count(DISTINCT j) AS INTEGER) AS k, max(id) AS last, max(s) AS steps FROM pr),
st AS (
  SELECT CAST(0 AS BIGINT) AS s, list_transform(range(k), lambda x: CAST(0 AS BIGINT)) AS sizes, list_transform(range(last + 1), lambda x: CAST(-1 AS BIGINT)) AS own FROM lim
  UNION ALL
  SELECT pr.s, CASE WHEN st.own[pr.id + 1] < 0 AND st.sizes[pr.j] < lim.cap THEN list_transform(st.sizes, lambda x, i: x + CASE WHEN i = pr.j THEN 1 ELSE 0 END) ELSE st.sizes END,
    CASE WHEN st.own[pr.id + 1] < 0 AND st.sizes[pr.j] < lim.cap THEN list_concat(st.own[:pr.id], [CAST(pr.line AS BIGINT)], st.own[pr.id + 2:]) ELSE st.own END
  FROM st JOIN pr ON pr.s = st.s + 1, lim
), fin AS (SELECT unnest(range(len(own))) AS id, unnest(own) AS line FROM st WHERE s = (SELECT steps FROM lim))
SELECT id, line FROM fin WHERE line >= 0""").replace("WITH ", "WITH RECURSIVE ", 1)

Q["a04_spherical_kmeans"] = pt(lambda p: C.kmeans(p, 8, 3)[0].select("id", "line", "sim"))
Q["a07_grouped_points"] = pt(lambda p: C.group_points(p, target=25, rounds=4))
Q["a08_grouped_lines"] = lambda spark, d: C.group_lines(V.centroids(A.points(spark, d).withColumn("line", F.col("line") * 100 + F.col("id") % 4)).select(F.col("line").alias("id"), F.col("c").alias("v")), rounds=4)


def carried(p):
    before = p.where("id % 5 > 0").select("line", "id")
    lone = p.where("id % 10 = 5").select("id")
    lines = before.select("line").distinct().count()
    return C.carry_lines(p, before, lone, most=-(-9 * p.count() // (10 * lines)), most_groups=lines).select("id", "line")


Q["a14_carried_lines"] = pt(carried)
#: New points come one after the other; then those isolated before try the lines that grew.
S["a14_carried_lines"] = oracle("px", """+kept AS (SELECT * FROM px WHERE id % 5 > 0), cs AS (SELECT line, i, sum(x) AS x FROM kept GROUP BY line, i), cn AS (SELECT line, sqrt(sum(x * x)) AS n FROM cs GROUP BY line),
vs AS (SELECT kept.id, kept.line, sum(kept.x * cs.x) AS vs, sum(kept.x * kept.x) AS vv FROM kept JOIN cs ON kept.line = cs.line AND kept.i = cs.i GROUP BY kept.id, kept.line),
loo AS (SELECT CASE WHEN n * n - 2 * vs + vv > 1e-14 THEN (vs - vv) / sqrt(n * n - 2 * vs + vv) ELSE 1 END AS loo FROM vs JOIN cn ON vs.line = cn.line),
lim AS (SELECT (SELECT avg(loo) - 1.5 * stddev_pop(loo) FROM loo) AS low, (SELECT CAST(ceil(0.9 * count(DISTINCT id) / (SELECT count(*) FROM cn)) AS BIGINT) FROM px) AS most, (SELECT count(*) FROM cn) AS k),
kk AS (SELECT line, row_number() OVER (ORDER BY line) AS j FROM cn), size AS (SELECT list(n ORDER BY j) AS sizes FROM (SELECT kk.j, count(DISTINCT id) AS n FROM kept JOIN kk ON kept.line = kk.line GROUP BY kk.j)),
s1 AS (SELECT id, row_number() OVER (ORDER BY id) AS s, sims FROM (SELECT id, list(sim ORDER BY j) AS sims FROM (SELECT px.id, kk.j, round(sum(px.x * cs.x / cn.n), 9) AS sim FROM px JOIN cs ON px.i = cs.i JOIN cn ON cs.line = cn.line JOIN kk ON cs.line = kk.line WHERE px.id % 10 = 0 GROUP BY px.id, kk.j) GROUP BY id)),
r1 AS (
  SELECT CAST(0 AS BIGINT) AS s, CAST(-1 AS BIGINT) AS id, CAST(0 AS BIGINT) AS j, sizes FROM size
  UNION ALL
  SELECT s, id, j, list_transform(sizes, lambda x, i: x + CASE WHEN i = j THEN 1 ELSE 0 END) FROM (
    SELECT s, id, sizes, CASE WHEN top >= low AND top > 0 THEN CAST(list_position(open, top) AS BIGINT) ELSE 0 END AS j FROM (
      SELECT *, list_max(open) AS top FROM (
        SELECT s1.s, s1.id, r1.sizes, lim.low, list_transform(s1.sims, lambda x, i: CASE WHEN r1.sizes[i] < lim.most THEN x ELSE -9 END) AS open FROM r1 JOIN s1 ON s1.s = r1.s + 1, lim)))
), j1 AS (SELECT r1.id, kk.line FROM r1 JOIN kk ON r1.j = kk.j), grown AS (SELECT DISTINCT line FROM j1),
c2 AS (SELECT line, i, sum(x) AS x FROM (SELECT line, i, x FROM kept UNION ALL SELECT j1.line, px.i, px.x FROM px JOIN j1 ON px.id = j1.id) WHERE line IN (SELECT line FROM grown) GROUP BY line, i),
n2 AS (SELECT line, sqrt(sum(x * x)) AS n FROM c2 GROUP BY line), k2 AS (SELECT line, row_number() OVER (ORDER BY line) AS j FROM n2),
z2 AS (SELECT list(z.sizes[kk.j] ORDER BY kk.j) AS sizes FROM (SELECT sizes FROM r1 ORDER BY s DESC LIMIT 1) z, kk JOIN k2 ON kk.line = k2.line),
s2 AS (SELECT id, row_number() OVER (ORDER BY id) AS s, sims FROM (SELECT id, list(sim ORDER BY j) AS sims FROM (SELECT px.id, k2.j, round(sum(px.x * c2.x / n2.n), 9) AS sim FROM px JOIN c2 ON px.i = c2.i JOIN n2 ON c2.line = n2.line JOIN k2 ON c2.line = k2.line WHERE px.id % 10 = 5 GROUP BY px.id, k2.j) GROUP BY id)),
r2 AS (
  SELECT CAST(0 AS BIGINT) AS s, CAST(-1 AS BIGINT) AS id, CAST(0 AS BIGINT) AS j, sizes FROM z2
  UNION ALL
  SELECT s, id, j, list_transform(sizes, lambda x, i: x + CASE WHEN i = j THEN 1 ELSE 0 END) FROM (
    SELECT s, id, sizes, CASE WHEN top >= low AND top > 0 THEN CAST(list_position(open, top) AS BIGINT) ELSE 0 END AS j FROM (
      SELECT *, list_max(open) AS top FROM (
        SELECT s2.s, s2.id, r2.sizes, lim.low, list_transform(s2.sims, lambda x, i: CASE WHEN r2.sizes[i] < lim.most THEN x ELSE -9 END) AS open FROM r2 JOIN s2 ON s2.s = r2.s + 1, lim)))
), own AS (SELECT DISTINCT id, line FROM kept UNION ALL SELECT id, line FROM j1 UNION ALL SELECT r2.id, k2.line FROM r2 JOIN k2 ON r2.j = k2.j)
SELECT a.id, own.line FROM (SELECT DISTINCT id FROM px) a LEFT JOIN own ON a.id = own.id""").replace("WITH ", "WITH RECURSIVE ", 1)


def planes(p):
    lines = V.centroids(p).select(F.col("line").alias("id"), F.col("c").alias("v"))
    return C.carry_planes(lines, lines.where("id < 6").select((F.col("id") % 3).cast("long").alias("plane"), "id"))


Q["a15_carried_planes"] = pt(planes)
S["a15_carried_planes"] = oracle("px", MATRIX + """, ps AS (SELECT line % 3 AS plane, i, sum(c) AS x FROM ct WHERE line < 6 GROUP BY 1, 2), pn AS (SELECT plane, sqrt(sum(x * x)) AS n FROM ps GROUP BY plane),
sm AS (SELECT ct.line, ps.plane, round(sum(ct.c * ps.x / n), 9) AS sim FROM ct JOIN ps ON ct.i = ps.i JOIN pn ON ps.plane = pn.plane WHERE ct.line >= 6 GROUP BY ct.line, ps.plane)
SELECT DISTINCT CAST(line AS BIGINT) AS id, CAST(line % 3 AS BIGINT) AS plane FROM ct WHERE line < 6 UNION ALL SELECT CAST(line AS BIGINT), CAST(plane AS BIGINT) FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY sim DESC, plane) AS r FROM sm) WHERE r = 1""")


def band(p):
    b = V.band(far(p))
    return b.withColumns({"note": (F.col("a") % 12 == 0) | (F.col("b") % 12 == 0), "isolated": (F.col("a") % 6 == 0) | (F.col("b") % 6 == 0)})


Q["w07_picked_pairs"] = pt(lambda p: C.far_slots(band(p)).select("a", "b", "sim"))
#: Takes the best pair that still fits, ten times.
S["w07_picked_pairs"] = oracle("pt", FAR + """, o AS (SELECT *, row_number() OVER (ORDER BY sim) - 1 AS k, count(*) OVER () AS m FROM fp),
bd AS (SELECT a, b, sim, a % 12 = 0 OR b % 12 = 0 AS note, a % 6 = 0 OR b % 6 = 0 AS lone FROM o WHERE sim >= (SELECT min(sim) FROM o WHERE k = floor(0.15 * m)) AND sim <= (SELECT max(sim) FROM o WHERE k = floor(0.45 * m))),
st AS (
  SELECT 0 AS n, CAST([] AS BIGINT[]) AS used, CAST(NULL AS STRUCT(a BIGINT, b BIGINT, sim DOUBLE)) AS p
  UNION ALL
  SELECT n, list_concat(used, [p.a, p.b]), p FROM (
    SELECT st.n + 1 AS n, st.used, arg_min({'a': CAST(bd.a AS BIGINT), 'b': CAST(bd.b AS BIGINT), 'sim': CAST(bd.sim AS DOUBLE)}, [CASE WHEN note AND st.n < 3 THEN 0 WHEN lone AND st.n < 5 THEN 1 ELSE 2 END, -sim, bd.a, bd.b]) AS p
    FROM st, bd WHERE st.n < 10 AND NOT list_contains(st.used, bd.a) AND NOT list_contains(st.used, bd.b) GROUP BY st.n, st.used)
) SELECT p.a AS a, p.b AS b, p.sim AS sim FROM st WHERE n > 0""").replace("WITH ", "WITH RECURSIVE ", 1)


def snapshots(p):
    """A snapshot before (line 5 missing, every ninth point new or isolated, some under a former
    id) and the one after (line 4 gone)."""
    span = p.agg(F.max("id") - F.min("id") + 1).first()[0] or 0  # former ids lie behind all of the table's
    after = p.where("line <> 4").select("line", "id", F.col("id").alias("place"), "source", "v")
    swapped = F.col("id") % 27 == 0
    before = p.where("line <> 5 and (id % 9 > 0 or id % 27 = 0)").select("line", F.when(swapped, F.col("id") + span).otherwise(F.col("id")).alias("id"))
    former = p.where(swapped).select("id", (F.col("id") + span).alias("former"))
    return after, before, p.where("id % 18 = 0").select("id"), former


Q["a22_discoveries"] = pt(lambda p: N.discoveries(*snapshots(p), most=40))
JOINED = "+now AS (SELECT * FROM pt WHERE line <> 4), jn AS (SELECT id, line, source, v, id % 18 = 0 AS lone FROM now WHERE line <> 5 AND id % 9 = 0 AND id % 27 > 0)"
S["a22_discoveries"] = oracle("pt", JOINED + """, cd AS (SELECT p.line, p.id AS a, q.id AS b, p.lone, row_number() OVER (PARTITION BY p.id ORDER BY p.source = q.source, round(list_dot_product(CAST(p.v AS DOUBLE[]), CAST(q.v AS DOUBLE[])), 9) DESC, q.id) AS r
  FROM jn p JOIN now q ON p.line = q.line AND p.id <> q.id WHERE p.lone OR p.source <> q.source),
f AS (SELECT min(id) AS a FROM now WHERE line = 5), l AS (SELECT f.a, min(q.id) AS b FROM f, now q WHERE q.line = 5 AND q.source <> f.a % 7 GROUP BY f.a),
al AS (SELECT CASE WHEN lone THEN 1 ELSE 2 END AS k, line, a AS place, a, b FROM cd WHERE r = 1 UNION ALL SELECT 3, 5, 0, a, b FROM l WHERE b IS NOT NULL),
ds AS (SELECT *, row_number() OVER (PARTITION BY line, least(a, b), greatest(a, b) ORDER BY k, line, place, a) AS n FROM al)
SELECT ['isolated', 'cross', 'line'][k] AS kind, line, a, b FROM ds WHERE n = 1 ORDER BY k, line, place, a LIMIT 40""")


def moved(p):
    after, before, _, former = snapshots(p)
    return before.select("line", F.col("id").alias("point")), after.select("line", F.col("id").alias("point")), former


Q["a21_line_changes"] = pt(lambda p: G.diff(*moved(p)))
S["a21_line_changes"] = oracle("pt", "SELECT line, CASE WHEN line = 5 THEN 'added' WHEN line = 4 THEN 'removed' WHEN count(*) FILTER (WHERE id % 9 = 0 AND id % 27 > 0) > 0 THEN 'grown' ELSE 'kept' END AS state, CASE WHEN line = 5 THEN count(*) WHEN line = 4 THEN 0 ELSE count(*) FILTER (WHERE id % 9 = 0 AND id % 27 > 0) END AS n_new FROM pt GROUP BY line HAVING line = 5 OR count(*) FILTER (WHERE id % 9 > 0 OR id % 27 = 0) > 0")
Q["a21_connected_points"] = pt(lambda p: G.connected(*moved(p)))
S["a21_connected_points"] = oracle("pt", "SELECT id AS point, line, CASE WHEN id % 27 = 0 AND line <> 5 THEN 'extended' ELSE 'connected' END AS state FROM pt WHERE line <> 4 AND (line = 5 OR id % 9 = 0)")
Q["r05_required_kinds"] = lambda spark, d: N.with_required(A.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.split("p_type", " ")[0].alias("kind"), F.col("p_partkey").alias("pos")), ("ECONOMY", "PROMO", "SMALL"), 5).select("id", "kind")
#: One required kind after the other.
S["r05_required_kinds"] = "WITH p AS (SELECT p_partkey AS id, split_part(p_type, ' ', 1) AS kind, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part), c0 AS (SELECT pos, id, kind FROM p WHERE pos < 5)" + "".join(f""",
n{k} AS (SELECT id, kind FROM p WHERE pos >= 5 AND kind = '{kind}' AND NOT EXISTS (SELECT 1 FROM c{k - 1} WHERE kind = '{kind}') ORDER BY pos LIMIT 1), o{k} AS (SELECT max(pos) AS pos FROM c{k - 1} WHERE kind IN (SELECT kind FROM c{k - 1} GROUP BY kind HAVING count(*) > 1)),
c{k} AS (SELECT c.pos, coalesce(n.id, c.id) AS id, coalesce(n.kind, c.kind) AS kind FROM c{k - 1} c LEFT JOIN n{k} n ON c.pos = (SELECT pos FROM o{k}))""" for k, kind in enumerate(("ECONOMY", "PROMO", "SMALL"), 1)) + " SELECT id, kind FROM c3"


def said(spark, d):
    """Answers on the parts of an order: some fail, some cannot be read."""
    li = A.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("pos")).agg(F.min("l_partkey").alias("a"), F.max("l_suppkey").alias("b"))
    n = F.col("a") + F.col("b")
    shared = F.when(n % 4 == 0, "True").when(n % 4 == 1, "false").when(n % 4 == 2, " true ").otherwise("maybe")
    return li.select("run", "pos", "a", "b", (n % 3 == 0).alias("failed"), shared.alias("shared"), F.when(n % 5 > 0, F.concat(F.lit("an\n idea of "), n)).alias("idea"), F.repeat(F.lit("why "), (n % 90).cast("int")).alias("explanation"))


SAID = "WITH l AS (SELECT l_orderkey AS run, l_linenumber AS pos, min(l_partkey) AS a, max(l_suppkey) AS b FROM lineitem GROUP BY 1, 2), n AS (SELECT *, a + b AS n, row_number() OVER (PARTITION BY run ORDER BY pos) AS r FROM l), e AS (SELECT x.run, min(x.r) AS stop FROM n x JOIN n y ON x.run = y.run AND y.r = x.r - 1 AND x.n % 3 = 0 AND y.n % 3 = 0 GROUP BY x.run), j AS (SELECT n.run, a, b, n, CASE WHEN n % 2 = 0 AND n % 5 > 0 AND n % 90 > 0 THEN 'shared' WHEN n % 4 = 1 THEN 'apart' ELSE 'unreadable' END AS verdict FROM n LEFT JOIN e ON n.run = e.run WHERE n % 3 > 0 AND (stop IS NULL OR r <= stop))"
Q["x08_judged"] = lambda spark, d: R.judged(said(spark, d)).select("run", "a", "b", "verdict", "idea", F.length("explanation").alias("chars"))
S["x08_judged"] = SAID + " SELECT run, a, b, verdict, CASE WHEN verdict = 'shared' THEN 'an idea of ' || n ELSE '' END AS idea, CAST(CASE WHEN verdict = 'shared' THEN least(300, 4 * (n % 90) - 1) ELSE 0 END AS INTEGER) AS chars FROM j"
Q["x08_to_judge"] = lambda spark, d: R.to_judge(said(spark, d).select("a", "b").distinct(), R.judged(said(spark, d)))
S["x08_to_judge"] = SAID + " SELECT DISTINCT a, b FROM l WHERE (a, b) NOT IN (SELECT (a, b) FROM j GROUP BY a, b HAVING bool_or(verdict <> 'unreadable') OR count(*) >= 2)"
Q["x09_far_discoveries"] = lambda spark, d: R.far_discoveries(R.judged(said(spark, d)), F.lit("2024-01-01").cast("date")).groupBy("a", "b").agg(F.countDistinct("id").alias("ids"), F.min("name").alias("name"), F.max("at").alias("at"))
S["x09_far_discoveries"] = SAID + " SELECT a, b, CAST(1 AS BIGINT) AS ids, 'an idea of ' || min(n) AS name, DATE '2024-01-01' AS \"at\" FROM j WHERE verdict = 'shared' GROUP BY a, b"
Q["x09_has_changes"] = pt(lambda p: R.has_changes(G.diff(*moved(p)), G.connected(*moved(p))))
S["x09_has_changes"] = "SELECT count(*) FILTER (WHERE label = 4 OR label = 5 OR (vec_id % 9 = 0 AND vec_id % 27 > 0)) > 0 AS changed FROM embeddings"
