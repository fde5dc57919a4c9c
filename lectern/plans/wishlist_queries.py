"""Wish-list and reading-record queries with their oracle SQL."""

from pyspark.sql import functions as F

from lectern.operators import wishlist as W

from . import adapters as A
from .adapters import oracle

Q, S = {}, {}


def wl(f):
    return lambda spark, d: f(A.wishlist(spark, d))


def rd(f):
    return lambda spark, d: f(A.records(spark, d))


Q["f07_wishlist_filter"] = wl(lambda b: W.filtered(b, "wanted", "a", None, None, 900.0, 1200.0).select("idx", "price", "range_ignored"))
S["f07_wishlist_filter"] = oracle("wl", "SELECT idx, price, false AS range_ignored FROM wl WHERE NOT purchased AND wanted AND contains(lower(title), 'a') AND price BETWEEN 900 AND 1200")
Q["f07_inverted_range"] = wl(lambda b: W.filtered(b, None, "", True, "Brand#12", 1200.0, 900.0).select("idx", "range_ignored"))
S["f07_inverted_range"] = oracle("wl", "SELECT idx, true AS range_ignored FROM wl WHERE ku AND label = 'Brand#12'")
Q["f08_shelves"] = wl(lambda b: b.select("idx", F.when(W.shelf("purchased"), "purchased").when(W.shelf("wanted"), "wanted").otherwise("other").alias("shelf")))
S["f08_shelves"] = oracle("wl", "SELECT idx, CASE WHEN purchased THEN 'purchased' WHEN wanted THEN 'wanted' ELSE 'other' END AS shelf FROM wl")
Q["f10_price_stop"] = wl(lambda b: b.select("idx", W.stop_reason(F.col("kind").contains("TIN"), F.col("purchased"), F.col("size") > 40).alias("stop")))
S["f10_price_stop"] = oracle("wl", "SELECT idx, CASE WHEN contains(kind, 'TIN') THEN 'manga' WHEN purchased THEN 'purchased' WHEN size > 40 THEN 'seen' END AS stop FROM wl")
Q["g04_label_counts"] = wl(W.label_counts)
S["g04_label_counts"] = oracle("wl", "SELECT label, count(*) AS n FROM wl GROUP BY label")
Q["g05_facets"] = wl(lambda b: W.facets(b, purchased=W.shelf("purchased"), wanted=W.shelf("wanted"), ku=F.col("ku"), missing=F.col("price").isNull(), cheap=F.col("price") < 1000))
S["g05_facets"] = oracle("wl", "SELECT 'purchased' AS facet, count(*) AS n FROM wl WHERE purchased UNION ALL SELECT 'wanted', count(*) FROM wl WHERE wanted AND NOT purchased UNION ALL SELECT 'ku', count(*) FROM wl WHERE ku UNION ALL SELECT 'missing', count(*) FROM wl WHERE price IS NULL UNION ALL SELECT 'cheap', count(*) FROM wl WHERE price < 1000")
Q["g06_price_total"] = wl(W.totals)
S["g06_price_total"] = oracle("wl", "SELECT round(sum(price), 2) AS total, count(price) AS priced, count(*) FILTER (WHERE price IS NULL) AS unpriced FROM wl")
Q["g07_summary"] = wl(lambda b: W.summary(b, 3, (F.col("idx") % 5 == 1) & F.col("price").isNotNull()))
S["g07_summary"] = oracle("wl", "SELECT count(*) AS n, count(*) FILTER (WHERE ku) AS n_ku, count(*) FILTER (WHERE idx % 5 = 1 AND price IS NOT NULL) AS n_dropped, (SELECT string_agg(CAST(idx AS VARCHAR), ',' ORDER BY price NULLS LAST, idx) FROM (SELECT idx, price FROM wl WHERE ku ORDER BY price NULLS LAST, idx LIMIT 3)) AS picks FROM wl")
for key, by, down in (("o01_sort_price_up", "price", False), ("o01_sort_price_down", "price", True), ("o01_sort_title", "title", False)):
    Q[key] = wl(lambda b, by=by, down=down: W.ranked(b, by, down))
    S[key] = oracle("wl", f"SELECT idx, row_number() OVER (ORDER BY {by} {'DESC' if down else 'ASC'} NULLS LAST, idx) AS pos FROM wl")
Q["o02_page"] = wl(lambda b: W.page(b, 3).select("idx"))
S["o02_page"] = oracle("wl", "SELECT idx FROM wl ORDER BY idx LIMIT 100 OFFSET 200")
Q["c03_title_key"] = wl(lambda b: b.select("idx", W.title_key(F.concat("title", F.lit(" (Vol. 2) [new]"))).alias("key")))
S["c03_title_key"] = oracle("wl", "SELECT idx, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS key FROM wl")


def reading(b):
    return W.reading_state(b, b.where("idx % 9 = 0").select("idx", F.lit(1).alias("n")), b.where("idx % 50 = 1").select("title", F.col("idx").alias("n")))


Q["j09_reading_state"] = wl(reading)
S["j09_reading_state"] = oracle("wl", "SELECT idx, CASE WHEN idx % 9 = 0 OR title IN (SELECT title FROM wl WHERE idx % 50 = 1) THEN 'reading' ELSE 'unread' END AS state FROM wl")


def matched(b):
    right = b.select(F.col("idx").alias("id"), F.when(F.col("idx") % 3 == 0, F.concat("title", F.lit(" extra"))).when(F.col("idx") % 3 == 1, F.concat("title", F.lit(" more"))).otherwise(F.col("title")).alias("title"))
    return W.match_titles(b.select(F.col("idx").alias("id"), "title"), right)


Q["j10_title_match"] = wl(matched)
S["j10_title_match"] = oracle("wl", """+a AS (SELECT idx AS l, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS k FROM wl), b AS (SELECT min(idx) AS r, regexp_replace(lower(CASE idx % 3 WHEN 0 THEN title || ' extra' WHEN 1 THEN title || ' more' ELSE title END), '[^a-z0-9]', '', 'g') AS k FROM wl GROUP BY 2), d AS (SELECT DISTINCT k FROM a WHERE length(k) >= 5),
m AS (SELECT d.k, arg_min(r, (d.k <> b.k, r)) AS r, bool_or(d.k = b.k) AS exact FROM d JOIN b ON starts_with(d.k, b.k) OR starts_with(b.k, d.k) WHERE length(b.k) >= 5 GROUP BY d.k) SELECT l, r, exact FROM a JOIN m ON a.k = m.k""")
Q["g08_day_rollup"] = rd(W.month_summary)
S["g08_day_rollup"] = oracle("rd", "SELECT read_on, count(*) AS books, coalesce(sum(pages), 0) AS pages, count(*) FILTER (WHERE pages IS NULL) AS unknown FROM rd GROUP BY read_on UNION ALL SELECT NULL, count(*), coalesce(sum(pages), 0), count(*) FILTER (WHERE pages IS NULL) FROM rd")
Q["g09_year_months"] = rd(lambda r: W.year_summary(r, 1998))
S["g09_year_months"] = oracle("rd", "+m AS (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS month), o AS (SELECT CAST(month(read_on) AS INTEGER) AS month, count(*) AS books, sum(pages) AS pages FROM rd WHERE year(read_on) = 1998 GROUP BY 1) SELECT m.month, coalesce(books, 0) AS books, CAST(coalesce(pages, 0) AS BIGINT) AS pages FROM m LEFT JOIN o ON m.month = o.month")
Q["g10_totals_unknown"] = rd(lambda r: r.agg(F.sum("pages").alias("pages"), F.count_if(F.col("pages").isNull()).alias("unknown")))
S["g10_totals_unknown"] = oracle("rd", "SELECT sum(pages) AS pages, count(*) FILTER (WHERE pages IS NULL) AS unknown FROM rd")
Q["g12_automatic_records"] = rd(lambda r: W.automatic_records(r.select("book", "read_on"), r.where("book % 4 = 0"), r.where("book % 10 = 7")))
S["g12_automatic_records"] = oracle("rd", "SELECT book, read_on FROM rd WHERE book NOT IN (SELECT book FROM rd WHERE book % 4 = 0) AND book NOT IN (SELECT book FROM rd WHERE book % 10 = 7)")
Q["k05_snapshot_retention"] = rd(lambda r: W.keep_newest(r.select(F.col("book").alias("id"), F.col("read_on").alias("at")), 12, F.col("id") % 5000 == 1))
S["k05_snapshot_retention"] = oracle("rd", "SELECT id, \"at\" FROM (SELECT book AS id, read_on AS \"at\", row_number() OVER (ORDER BY read_on DESC, book DESC) AS r FROM rd) WHERE r <= 12 OR id % 5000 = 1")

KIND = "ECONOMY"


def begun(b):
    """The list with tags and reading states."""
    return b.withColumns({"tag": F.when(F.col("idx") % 3 == 0, "seen").when(F.col("idx") % 3 == 1, "want"), "reading": F.when(F.col("idx") % 4 > 0, F.col("idx") % 4 == 1)})


Q["f07_purchased_unread"] = wl(lambda b: W.filtered(begun(b), "purchased", "Ａ  brand#1", reading="unread", tag="untagged", also=("label",)).select("idx"))
S["f07_purchased_unread"] = oracle("wl", "SELECT idx FROM wl WHERE purchased AND idx % 3 = 2 AND idx % 4 <> 1 AND contains(lower(title || ' ' || label), 'a') AND contains(lower(title || ' ' || label), 'brand#1')")
Q["f07_kind_and_mark"] = wl(lambda b: W.filtered(begun(b), None, kind=KIND, tag="seen", reading="unread", mark=F.col("price") < 1000).select("idx"))
S["f07_kind_and_mark"] = oracle("wl", f"SELECT idx FROM wl WHERE kind = '{KIND}' AND idx % 3 = 0 AND price < 1000")
