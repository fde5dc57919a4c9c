"""Library and merge queries with their oracle SQL."""

from pyspark.sql import functions as F

from lectern.operators import library as L
from lectern.operators import merge as M
from lectern.operators import wishlist as W

from . import adapters as A
from .adapters import oracle

Q, S = {}, {}


def hl(f):
    return lambda spark, d: f(A.highlights(spark, d))


def vs(f):
    return lambda spark, d: f(A.versions(spark, d))




def tech():
    return L.technical(A.title_of(F.col("book")))


Q["f01_live_highlights"] = hl(lambda h: L.live(h).select("id", "book", "favorite"))
S["f01_live_highlights"] = oracle("hl", "SELECT id, book, favorite FROM hl WHERE NOT deleted")
Q["f02_points"] = hl(lambda h: L.points(h, tech()).select("id", "book"))
S["f02_points"] = oracle("hl", "SELECT id, book FROM hl WHERE NOT deleted AND book NOT IN ('src10', 'src11', 'src12', 'src13', 'src14')")
Q["f03_technical_books"] = hl(lambda h: h.select("book").distinct().select("book", L.technical(A.title_of(F.col("book")), F.when(F.col("book") == "src11", F.lit(False))).alias("technical")))
S["f03_technical_books"] = oracle("hl", "SELECT DISTINCT book, book IN ('src10', 'src12', 'src13', 'src14') AS technical FROM hl")
Q["f04_search_all_words"] = hl(lambda h: L.search(h, "the src3").select("id", "book"))
S["f04_search_all_words"] = oracle("hl", "SELECT id, book FROM hl WHERE NOT deleted AND contains(lower(text || chr(10) || book), 'the') AND contains(lower(text || chr(10) || book), 'src3')")
Q["g01_book_counts"] = hl(L.book_counts)
S["g01_book_counts"] = oracle("hl", "SELECT book, count(*) AS n, max(id) AS last_id FROM hl WHERE NOT deleted GROUP BY book")
Q["g02_library_stats"] = hl(lambda h: L.stats(h, tech()))
S["g02_library_stats"] = oracle("hl", "SELECT count(*) FILTER (WHERE NOT deleted) AS live, count(*) FILTER (WHERE deleted) AS deleted, count(*) FILTER (WHERE NOT deleted AND favorite) AS favorites, count(*) FILTER (WHERE NOT deleted AND book IN ('src10', 'src11', 'src12', 'src13', 'src14')) AS technical, count(DISTINCT CASE WHEN NOT deleted THEN book END) AS books FROM hl")
Q["g03_status_counts"] = lambda spark, d: L.status_counts(A.versions(spark, d).select(F.col("user").alias("group"), F.col("field").alias("status")), ["click", "error", "purchase", "signup"])
S["g03_status_counts"] = oracle("vs", 'SELECT "user" AS "group", count(*) FILTER (WHERE field = \'click\') AS click, count(*) FILTER (WHERE field = \'error\') AS error, count(*) FILTER (WHERE field = \'purchase\') AS purchase, count(*) FILTER (WHERE field = \'signup\') AS signup FROM vs GROUP BY "user"')
Q["w04_book_order"] = hl(lambda h: L.live(h).select("id", "book", F.row_number().over(L.Window.partitionBy("book").orderBy(*L.in_book())).cast("long").alias("pos")))
S["w04_book_order"] = oracle("hl", "SELECT id, book, row_number() OVER (PARTITION BY book ORDER BY location NULLS LAST, id) AS pos FROM hl WHERE NOT deleted")
Q["w05_neighbours_in_book"] = hl(L.neighbours)
S["w05_neighbours_in_book"] = oracle("hl", "SELECT id, book, lag(id) OVER (PARTITION BY book ORDER BY location NULLS LAST, id) AS prev_id, lead(id) OVER (PARTITION BY book ORDER BY location NULLS LAST, id) AS next_id FROM hl WHERE NOT deleted")
JOINABLE = "+nx AS (SELECT id, book, chapter, location, text, lead(id) OVER w AS next_id, lead(chapter) OVER w AS nc, lead(location) OVER w AS nl FROM hl WHERE NOT deleted WINDOW w AS (PARTITION BY book ORDER BY location NULLS LAST, id)), jc AS (SELECT id, book, next_id FROM nx WHERE next_id IS NOT NULL AND right(rtrim(text, ' ' || chr(9) || chr(10) || chr(13)), 1) NOT IN ('。', '．', '.', '！', '!', '？', '?', '」', '』', '）', ')', ']', '］', '}', '｝', '】', '》', '〉', '〕', chr(34), '”', chr(39), '’', '…', '‥') AND chapter = nc AND nl <= location + 25)"
Q["f19_join_candidates"] = hl(lambda h: L.join_candidates(h, 25))
S["f19_join_candidates"] = oracle("hl", JOINABLE + " SELECT * FROM jc")
Q["g17_join_candidate_counts"] = hl(lambda h: L.join_candidates(h, 25).groupBy("book").agg(F.count("*").alias("n")))
S["g17_join_candidate_counts"] = oracle("hl", JOINABLE + " SELECT book, count(*) AS n FROM jc GROUP BY book")
Q["f22_trash"] = hl(L.trash)
S["f22_trash"] = oracle("hl", "SELECT book, count(*) FILTER (WHERE deleted) AS n_deleted, count(*) FILTER (WHERE NOT deleted) AS n_live FROM hl GROUP BY book HAVING count(*) FILTER (WHERE deleted) > 0")
Q["f23_daily_picks"] = hl(lambda h: L.daily_picks(L.points(h, tech()), "2024-05-01", 10, h.where("id % 2 = 0")).select("id", "book"))
S["f23_daily_picks"] = oracle("hl", "SELECT id, book FROM hl WHERE NOT deleted AND book NOT IN ('src10', 'src11', 'src12', 'src13', 'src14') ORDER BY CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END, md5('2024-05-01' || CAST(id AS VARCHAR)), id LIMIT 10")
Q["j15_contained_points"] = hl(lambda h: L.contained(h, 40))
S["j15_contained_points"] = oracle("hl", "SELECT id, keeper FROM (SELECT a.id, b.id AS keeper, row_number() OVER (PARTITION BY a.id ORDER BY length(b.text) DESC, b.id) AS r FROM hl a JOIN hl b ON a.book = b.book AND NOT a.deleted AND NOT b.deleted AND abs(a.location - b.location) <= 40 AND (length(b.text) > length(a.text) OR (length(b.text) = length(a.text) AND b.id < a.id)) AND contains(b.text, a.text)) WHERE r = 1")


def notes(h):
    spans = h.select("id", "book", F.col("location").alias("start"), (F.col("location") + 5 + F.col("id") % 60).alias("end"), F.floor(F.col("location") / 400).alias("page"))
    own = h.select("id", "book", (F.col("location") + 9).alias("at"), F.floor(F.col("location") / 400).alias("page"))
    return L.attach_notes(own, spans)


Q["s04_attach_notes"] = hl(notes)
S["s04_attach_notes"] = oracle("hl", """+n AS (SELECT id AS note, book, location + 9 AS "at", floor(location / 400) AS page FROM hl), s AS (SELECT id AS highlight, book, location AS "start", location + 5 + id % 60 AS "end", floor(location / 400) AS page FROM hl),
m AS (SELECT note, highlight, CASE WHEN "at" = "end" THEN 0 ELSE 1 END AS level FROM n JOIN s ON n.book = s.book AND "at" BETWEEN "start" AND "end" UNION ALL SELECT note, highlight, 2 FROM n JOIN s ON n.book = s.book AND n.page = s.page)
SELECT note, highlight, level FROM (SELECT *, row_number() OVER (PARTITION BY note ORDER BY level, highlight) AS r FROM m) WHERE r = 1""")
Q["g11_first_highlight"] = lambda spark, d: W.first_days(A.read(spark, d, "events").select(F.col("user_id").alias("book"), F.col("ts").alias("at")))
S["g11_first_highlight"] = "SELECT user_id AS book, min(CAST(ts + INTERVAL 9 HOUR AS DATE)) AS first_on FROM events GROUP BY user_id"

KEYS = ["user", "field"]
LAST = 'row_number() OVER (PARTITION BY "user", field ORDER BY updated DESC, value DESC NULLS LAST, id DESC)'
Q["m01_last_writer"] = vs(lambda v: M.last_writer(v, KEYS, "updated", ["value", "id"]).select(*KEYS, "updated", "value", "gone"))
S["m01_last_writer"] = oracle("vs", f'SELECT "user", field, updated, value, gone FROM (SELECT *, {LAST} AS r FROM vs) WHERE r = 1')
Q["m02_sticky_delete"] = vs(lambda v: M.sticky_delete(v, KEYS, "updated", ["value", "id"]).select(*KEYS, "updated", "value", "gone"))
S["m02_sticky_delete"] = oracle("vs", f'SELECT a."user", a.field, updated, value, g.gone FROM (SELECT *, {LAST} AS r FROM vs) a JOIN (SELECT "user", field, bool_or(gone) AS gone FROM vs GROUP BY "user", field) g ON a."user" = g."user" AND a.field = g.field WHERE r = 1')


def groups(v):
    rows = v.select("user", "id", "updated", "value", "field", F.when(F.col("replica") == 1, F.col("updated")).alias("own_clock"))
    return M.field_groups(rows, ["user"], {"imported": (["value"], ["updated", "id"]), "edited": (["field"], ["own_clock", "id"])})


Q["m03_field_groups"] = vs(groups)
S["m03_field_groups"] = oracle("vs", '+a AS (SELECT "user", value, row_number() OVER (PARTITION BY "user" ORDER BY updated DESC, id DESC) AS r FROM vs), b AS (SELECT "user", field, row_number() OVER (PARTITION BY "user" ORDER BY updated DESC, id DESC) AS r FROM vs WHERE replica = 1) SELECT a."user", value, field FROM a LEFT JOIN b ON a."user" = b."user" AND b.r = 1 WHERE a.r = 1')
Q["m05_source_union"] = vs(lambda v: M.union_sets(v, "user", "field").select("user", F.array_join("field", "+").alias("fields")))
S["m05_source_union"] = oracle("vs", 'SELECT "user", string_agg(field, \'+\' ORDER BY field) AS fields FROM (SELECT DISTINCT "user", field FROM vs) GROUP BY "user"')
Q["m08_first_reads"] = vs(lambda v: M.first_seen(v, "user", "updated"))
S["m08_first_reads"] = oracle("vs", 'SELECT "user", min(updated) AS updated FROM vs GROUP BY "user"')


def upsert(v):
    side = lambda r: M.last_writer(v.where(F.col("replica") == r), KEYS, "updated", ["value", "id"]).select(*KEYS, F.when(F.col("id") % 4 != 0, F.col("value")).alias("value"))
    return M.fill_blanks(side(0), side(1), KEYS, ["value"])


Q["m10_import_fill"] = vs(upsert)
S["m10_import_fill"] = oracle("vs", f"""+s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY replica, "user", field ORDER BY updated DESC, value DESC NULLS LAST, id DESC) AS r FROM vs) WHERE r = 1),
b AS (SELECT "user", field, CASE WHEN id % 4 <> 0 THEN value END AS value FROM s WHERE replica = 0), i AS (SELECT "user", field, CASE WHEN id % 4 <> 0 THEN value END AS value FROM s WHERE replica = 1)
SELECT coalesce(b."user", i."user") AS "user", coalesce(b.field, i.field) AS field, coalesce(b.value, i.value) AS value, CASE WHEN b."user" IS NULL THEN 'added' WHEN i."user" IS NOT NULL AND b.value IS NULL AND i.value IS NOT NULL THEN 'filled' ELSE 'kept' END AS change FROM b FULL JOIN i ON b."user" = i."user" AND b.field = i.field""")


def clamped(v):
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    return v.select("id", M.clamp_clock(F.when(F.col("id") % 17 != 0, F.col("updated")), now).alias("stamp"))


Q["t07_clock_policy"] = vs(clamped)
S["t07_clock_policy"] = oracle("vs", "SELECT id, CASE WHEN id % 17 = 0 THEN TIMESTAMP '1970-01-01' WHEN updated > TIMESTAMP '2024-01-21' THEN TIMESTAMP '2024-01-20' ELSE updated END AS stamp FROM vs")


def reports(v):
    state = F.when(F.col("field") == "signup", "login").when(F.col("field") == "error", "error").otherwise("ok")
    return v.select("id", F.col("user").alias("source"), F.col("updated").alias("at"), state.alias("state"), "field")


Q["t06_carry_forward"] = vs(lambda v: L.carried(reports(v), F.col("field") == "purchase"))
S["t06_carry_forward"] = oracle("vs", 'SELECT id, max(CASE WHEN field = \'purchase\' THEN updated END) OVER (PARTITION BY "user" ORDER BY updated, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_ok FROM vs')


Q["t05_health_status"] = vs(lambda v: L.health(reports(v), F.lit("2024-01-23").cast("timestamp_ntz"), "1 DAY").withColumnRenamed("source", "user"))
S["t05_health_status"] = oracle("vs", """SELECT "user", CASE WHEN updated < TIMESTAMP '2024-01-20' THEN 'stale' WHEN field = 'signup' THEN 'login' WHEN field = 'error' THEN 'error' ELSE 'ok' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY updated DESC, id DESC) AS r FROM vs) WHERE r = 1""")


def imported(h):
    """Points as they are, and an import that brings them again, longer and shorter ones among them."""
    place = lambda t, i, x: t.select(i.alias("id"), "book", F.col("location").alias("start"), (F.col("location") + 5).alias("end"), x.alias("text"), "deleted")
    i, t = F.col("id"), F.col("text")
    here = place(h.where("id % 3 > 0"), i, t)
    long = place(h.where("id % 10 = 1"), i + 1000000, F.concat(t, F.lit(" and more")))
    short = place(h.where("id % 10 = 2"), i + 2000000, F.substring(t, F.lit(1), F.length(t) - 5))
    return here, place(h, i, t).unionByName(long).unionByName(short).drop("deleted")


Q["m10_import_changes"] = hl(lambda h: L.import_changes(*imported(h)))
#: Texts of the tables are in a normal form but for case and white space.
S["m10_import_changes"] = oracle("hl", """+nt AS (SELECT *, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS norm FROM hl), e AS (SELECT id, book, location AS s, text, deleted, norm FROM nt WHERE id % 3 > 0),
i AS (SELECT id, book, location AS s, text FROM hl UNION ALL SELECT id + 1000000, book, location, text || ' and more' FROM hl WHERE id % 10 = 1 UNION ALL SELECT id + 2000000, book, location, substr(text, 1, length(text) - 5) FROM hl WHERE id % 10 = 2),
n AS (SELECT *, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS norm FROM i WHERE id NOT IN (SELECT id FROM e)),
m AS (SELECT n.id, bool_or(length(e.text) > length(n.text) AND contains(e.norm, n.norm)) AS inside, min(CASE WHEN NOT e.deleted AND length(e.text) < length(n.text) AND contains(n.norm, e.norm) THEN e.id END) AS former FROM n JOIN e ON n.book = e.book AND abs(n.s - e.s) <= 5 GROUP BY n.id)
SELECT id, CASE WHEN deleted THEN 'gone' ELSE 'known' END AS change, CAST(NULL AS BIGINT) AS former FROM e UNION ALL
SELECT n.id, CASE WHEN inside THEN 'contained' WHEN former IS NOT NULL THEN 'extends' ELSE 'added' END, CASE WHEN NOT inside THEN former END FROM n LEFT JOIN m ON n.id = m.id""")


Q["j15_moved_notes"] = hl(lambda h: L.without_contained(h.withColumn("note", F.when(F.col("id") % 4 == 0, F.concat(F.lit("n"), "id")).otherwise(""))).select("id", "note"))
S["j15_moved_notes"] = oracle("hl", """+lv AS (SELECT * FROM hl WHERE NOT deleted), p AS (SELECT a.id, arg_min(b.id, (-length(b.text), b.id)) AS keeper FROM lv a JOIN lv b ON a.book = b.book AND abs(a.location - b.location) <= 1 AND a.id <> b.id AND (length(b.text) > length(a.text) OR (length(b.text) = length(a.text) AND b.id < a.id)) AND contains(b.text, a.text) GROUP BY a.id),
m AS (SELECT p.keeper, arg_min('n' || p.id, (-length(lv.text), p.id)) AS note FROM p JOIN lv ON p.id = lv.id WHERE p.id % 4 = 0 GROUP BY p.keeper)
SELECT lv.id, CASE WHEN lv.id % 4 = 0 THEN 'n' || lv.id ELSE coalesce(m.note, '') END AS note FROM lv LEFT JOIN m ON lv.id = m.keeper WHERE lv.id NOT IN (SELECT id FROM p)""")
