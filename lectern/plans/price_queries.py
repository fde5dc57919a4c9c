"""Price queries with their oracle SQL."""

from pyspark.sql import functions as F

from lectern.operators import prices as P

from . import adapters as A
from .adapters import oracle

Q, S = {}, {}


def history(f):
    return lambda spark, d: f(A.price_history(spark, d))


def both(f):
    return lambda spark, d: f(A.books(spark, d), A.price_history(spark, d))


LATEST = "+lt AS (SELECT asin, id, ts, price, ku FROM (SELECT *, rank() OVER (PARTITION BY asin ORDER BY ts DESC) AS r FROM ph) WHERE r = 1)"
PAID = "+pd AS (SELECT *, lag(price) OVER (PARTITION BY asin ORDER BY ts, id) AS before, row_number() OVER (PARTITION BY asin ORDER BY ts, id) AS n FROM ph WHERE NOT ku AND price IS NOT NULL)"
TREND = PAID + """, ch AS (SELECT asin, before AS prev, ts AS changed_at FROM (SELECT *, row_number() OVER (PARTITION BY asin ORDER BY ts DESC, id DESC) AS k FROM pd WHERE before <> price) WHERE k = 1),
lo AS (SELECT asin, price AS low, CASE WHEN n > 1 THEN ts END AS low_at FROM (SELECT *, row_number() OVER (PARTITION BY asin ORDER BY price, ts, id) AS k FROM pd) WHERE k = 1),
cu AS (SELECT asin, price AS current FROM (SELECT *, row_number() OVER (PARTITION BY asin ORDER BY ts DESC, id DESC) AS k FROM pd) WHERE k = 1),
tr AS (SELECT cu.asin, current, prev, changed_at, low, low_at FROM cu JOIN lo ON cu.asin = lo.asin LEFT JOIN ch ON cu.asin = ch.asin)"""
NEWEST = "nw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asin ORDER BY ts DESC, id DESC) AS r FROM ph) WHERE r <= 50)"


def transition(name, state, eligible, source="nw"):
    return f"""{name}_e AS (SELECT asin, ts, id, {state} AS s FROM {source} WHERE {eligible}),
{name}_l AS (SELECT *, lag(s) OVER (PARTITION BY asin ORDER BY ts, id) AS before, row_number() OVER (PARTITION BY asin ORDER BY ts DESC, id DESC) AS k FROM {name}_e),
{name} AS (SELECT asin, max(CASE WHEN s AND NOT before THEN ts END) AS at FROM {name}_l GROUP BY asin HAVING bool_or(k = 1 AND s) AND max(CASE WHEN s AND NOT before THEN ts END) IS NOT NULL)"""


KU = ("ku OR price IS NOT NULL", "NOT ku AND price IS NOT NULL")
JOINED, LEFT = transition("jn", "ku", KU[0]), transition("lf", "NOT ku", KU[0])
CAMPAIGN = transition("cp", "coalesce(campaign, '') <> ''", KU[1])
TARGET = "nt AS (SELECT nw.*, target FROM nw JOIN bk ON nw.asin = bk.asin WHERE target IS NOT NULL), " + transition("tg", "price <= target", KU[1], "nt")

Q["j01_latest_rows"] = history(lambda h: P.latest(h).select("asin", "id", "ts", "price", "ku"))
S["j01_latest_rows"] = oracle("ph", LATEST + " SELECT * FROM lt")

Q["j02_latest_price"] = both(lambda b, h: b.join(P.latest(h).select("asin", "ts", "price", "ku"), "asin", "left").join(P.trend(h), "asin", "left").select("asin", "title", "ts", "price", "ku", "prev", "changed_at", "low", "low_at"))
S["j02_latest_price"] = oracle("ph bk", TREND + ", " + LATEST[1:] + " SELECT bk.asin, title, ts, price, ku, prev, changed_at, low, low_at FROM bk LEFT JOIN lt ON bk.asin = lt.asin LEFT JOIN tr ON bk.asin = tr.asin")

Q["j03_wanted_price"] = both(lambda b, h: P.with_latest(b.where("wanted"), h).select("asin", "title", "ts", "price", "purchased"))
S["j03_wanted_price"] = oracle("ph bk", LATEST + " SELECT bk.asin, title, ts, price, purchased FROM bk LEFT JOIN lt ON bk.asin = lt.asin WHERE wanted")

Q["g14_price_trend"] = history(P.trend)
S["g14_price_trend"] = oracle("ph", TREND + " SELECT * FROM tr")

Q["g15_history_list"] = history(P.history_lists)
S["g15_history_list"] = oracle("ph", "+" + NEWEST + """ SELECT asin, count(*) AS n_points, string_agg(CAST(id AS VARCHAR) || ':' || CASE WHEN ku OR price IS NULL THEN '-' ELSE CAST(CAST(trunc(price * 100) AS BIGINT) AS VARCHAR) END || CASE WHEN NOT ku AND price IS NOT NULL AND coalesce(campaign, '') <> '' THEN '*' ELSE '' END, ' ' ORDER BY ts, id) AS points FROM nw GROUP BY asin""")

Q["g16_last_scraped"] = history(lambda h: h.groupBy("asin").agg(F.max("ts").alias("last_scraped")))
S["g16_last_scraped"] = oracle("ph", "SELECT asin, max(ts) AS last_scraped FROM ph GROUP BY asin")

for key, f, cte, last in (("w02_joined_unlimited", P.joined_unlimited, JOINED, "jn"), ("w02_left_unlimited", P.left_unlimited, LEFT, "lf"), ("w02_campaign_started", P.campaign_started, CAMPAIGN, "cp")):
    Q[key] = history(f)
    S[key] = oracle("ph", f"+{NEWEST}, {cte} SELECT * FROM {last}")
Q["w02_target_reached"] = both(lambda b, h: P.target_reached(h, b))
S["w02_target_reached"] = oracle("ph bk", f"+{NEWEST}, {TARGET} SELECT * FROM tg")

EVENTS = """, ev AS (SELECT asin, changed_at AS "at", CASE WHEN current < prev THEN 'drop' ELSE 'rise' END AS kind FROM tr WHERE changed_at IS NOT NULL
UNION ALL SELECT asin, "at", 'joined' FROM jn UNION ALL SELECT asin, "at", 'left' FROM lf UNION ALL SELECT asin, "at", 'campaign' FROM cp UNION ALL SELECT asin, "at", 'target' FROM tg)"""
Q["w03_feed_events"] = both(P.feed)
S["w03_feed_events"] = oracle("ph bk", f"{TREND}, {NEWEST}, {JOINED}, {LEFT}, {CAMPAIGN}, {TARGET}{EVENTS} SELECT asin, \"at\", kind FROM ev WHERE asin IN (SELECT asin FROM bk WHERE wanted AND NOT purchased) ORDER BY \"at\" DESC, asin DESC, kind DESC LIMIT 50")


def reasons(b, h):
    failed = h.where("price is null").groupBy("asin").agg(F.max("ts").alias("ts")).withColumn("reason", F.lit("no_price"))
    return P.missing_reason(b, h, failed)


Q["f14_missing_reason"] = both(reasons)
S["f14_missing_reason"] = oracle("ph bk", LATEST + """, la AS (SELECT asin, max(ts) AS ts, bool_or(ku) AS ku, max(price) AS price FROM lt GROUP BY asin), rs AS (SELECT asin, max(ts) AS r_ts FROM ph WHERE price IS NULL GROUP BY asin)
SELECT bk.asin, CASE WHEN ku THEN 'ku' WHEN ts IS NULL THEN 'not_scraped' WHEN r_ts = ts THEN 'no_price' ELSE 'unknown' END AS reason FROM bk LEFT JOIN la ON bk.asin = la.asin LEFT JOIN rs ON bk.asin = rs.asin WHERE price IS NULL OR ku""")

Q["w11_sparkline"] = history(P.sparkline)
S["w11_sparkline"] = oracle("ph", """+b AS (SELECT *, epoch_us(ts) AS t FROM ph WHERE NOT ku AND price IS NOT NULL), w AS (SELECT asin, count(*) AS n, min(price) AS lo, max(price) AS hi, CAST(min(t) AS DOUBLE) AS f, CAST(max(t) AS DOUBLE) AS l FROM b GROUP BY asin)
SELECT b.asin, id, round(CASE WHEN l > f THEN (t - f) / (l - f) * 100.0 ELSE 0.0 END, 4) AS x, round(CASE WHEN hi > lo THEN (hi - price) / (hi - lo) * 20.0 ELSE 10.0 END, 4) AS y FROM b JOIN w ON b.asin = w.asin WHERE n >= 2""")

Q["w12_resume_set"] = history(lambda h: h.where(F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")).select("asin").distinct())
S["w12_resume_set"] = oracle("ph", "SELECT DISTINCT asin FROM ph WHERE ts >= TIMESTAMP '2024-01-15'")

Q["c20_price_change"] = history(lambda h: P.trend(h).select("asin", F.round(F.col("current") - F.col("prev"), 2).alias("diff"), (F.col("current") <= F.col("low")).alias("lowest")))
S["c20_price_change"] = oracle("ph", TREND + " SELECT asin, round(current - prev, 2) AS diff, current <= low AS lowest FROM tr")

Q["x20_ordered_history"] = history(lambda h: h.where("price is not null and not ku").select("asin", "id", "price", F.row_number().over(P.Window.partitionBy("asin").orderBy("ts", "id")).cast("long").alias("pos")))
S["x20_ordered_history"] = oracle("ph", "SELECT asin, id, price, row_number() OVER (PARTITION BY asin ORDER BY ts, id) AS pos FROM ph WHERE price IS NOT NULL AND NOT ku")


def document(b, h):
    t = P.trend(h).select("asin", "prev", "low")
    last = P.latest(h).groupBy("asin").agg(F.max("price").alias("price"), F.bool_or("ku").alias("ku"))
    out = b.join(last, "asin", "left").join(t, "asin", "left")
    sources = F.array_join(F.filter(F.array(F.when(F.col("wanted"), "wanted"), F.when(F.col("purchased"), "purchased")), lambda x: x.isNotNull()), "+")
    return out.select("asin", "title", F.when(~F.coalesce("ku", F.lit(False)), F.col("price")).alias("price"), F.coalesce("ku", F.lit(False)).alias("ku"), "prev", "low", sources.alias("sources"))


Q["k01_wishlist_document"] = both(document)
S["k01_wishlist_document"] = oracle("ph bk", TREND + ", " + LATEST[1:] + """, la AS (SELECT asin, max(price) AS price, bool_or(ku) AS ku FROM lt GROUP BY asin)
SELECT bk.asin, title, CASE WHEN NOT coalesce(ku, false) THEN price END AS price, coalesce(ku, false) AS ku, prev, low, CASE WHEN wanted AND purchased THEN 'wanted+purchased' WHEN wanted THEN 'wanted' WHEN purchased THEN 'purchased' ELSE '' END AS sources FROM bk LEFT JOIN la ON bk.asin = la.asin LEFT JOIN tr ON bk.asin = tr.asin""")
