"""Queries over thoughts, notes and answers, with their oracle SQL."""

from pyspark.sql import functions as F

from lectern.operators import notes as N

from . import adapters as A
from .adapters import oracle

Q, S = {}, {}


def thoughts(spark, d):
    """Turns of conversations as thoughts of users and notes of assistants."""
    c = A.read(spark, d, "conversations")
    i = F.col("conv_id") * 1000 + F.col("turn")
    status = F.element_at(F.array(*[F.lit(s) for s in ("inbox", "done", "discarded", "inbox")]), (i % 4 + 1).cast("int"))
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), (n % 300).cast("int"))
    return c.select(i.alias("id"), "role", F.concat(F.lit("\n "), "text").alias("text"), F.substring("text", 1, 20).alias("title"), F.col("text").alias("body"), status.alias("status"), (i % 11 == 0).alias("deleted"), day(i).alias("created"), day(i + i % 2).alias("updated"), F.when(i % 3 == 0, "line").alias("from_kind"))


T = "WITH r AS (SELECT conv_id * 1000 + turn AS id, role, text FROM conversations), t AS (SELECT *, ['inbox', 'done', 'discarded', 'inbox'][id % 4 + 1] AS status, id % 11 = 0 AS deleted, DATE '2024-01-01' + CAST(id % 300 AS INTEGER) AS created, DATE '2024-01-01' + CAST((id + id % 2) % 300 AS INTEGER) AS updated, id % 3 = 0 AS line FROM r)"
Q["x03_point_thoughts"] = lambda spark, d: N.point_thoughts(thoughts(spark, d)).select("id", "status")
S["x03_point_thoughts"] = T + " SELECT id, status FROM t WHERE NOT deleted AND status <> 'discarded'"
Q["x03_inbox"] = lambda spark, d: N.inbox(thoughts(spark, d)).select("id", "pos")
S["x03_inbox"] = T + " SELECT id, row_number() OVER (ORDER BY created DESC, id) AS pos FROM t WHERE NOT deleted AND status = 'inbox'"
Q["x03_notes_for_analysis"] = lambda spark, d: N.notes_for_analysis(thoughts(spark, d)).select("id")
S["x03_notes_for_analysis"] = T + " SELECT id FROM t WHERE NOT deleted AND NOT (line AND updated = created)"
Q["f06_search_notes"] = lambda spark, d: N.search_notes(thoughts(spark, d), "THE  an").select("id", "pos")
S["f06_search_notes"] = T + ", h AS (SELECT *, lower(regexp_replace(substr(text, 1, 20) || ' ' || text, '\\s+', ' ', 'g')) AS hay FROM t) SELECT id, row_number() OVER (ORDER BY updated DESC, id) AS pos FROM h WHERE NOT deleted AND contains(hay, 'the') AND contains(hay, 'an')"


def sorted_out(spark, d):
    t = thoughts(spark, d)
    return N.note_from_thought(t.select("id", "text", "status", "deleted", "created", "updated"), t.where("id % 3 = 0").select("id", (F.col("id") + 7).alias("note")), F.lit("2025-01-01").cast("date"))


Q["x04_notes_from_thoughts"] = lambda spark, d: sorted_out(spark, d)[0].select("id", "title", F.get("evidence", F.lit(0)).alias("evidence"))
S["x04_notes_from_thoughts"] = T + ", f AS (SELECT id, trim(coalesce(list_filter(string_split(chr(10) || ' ' || text, chr(10)), lambda x: trim(x) <> '')[1], chr(10) || ' ' || text)) AS s FROM t WHERE id % 3 = 0 AND NOT deleted AND status = 'inbox') SELECT id + 7 AS id, CASE WHEN length(s) > 40 THEN substr(s, 1, 39) || '…' ELSE s END AS title, id AS evidence FROM f"
Q["x04_thoughts_done"] = lambda spark, d: sorted_out(spark, d)[1].select("id", "status", "updated")
S["x04_thoughts_done"] = T + " SELECT id, CASE WHEN m THEN 'done' ELSE status END AS status, CASE WHEN m THEN DATE '2025-01-01' ELSE updated END AS updated FROM (SELECT *, id % 3 = 0 AND NOT deleted AND status = 'inbox' AS m FROM t)"


def split(p):
    """Every hundredth vector asks; of the others every fifth is a note and some are kept answers."""
    ends = p.where("id % 100 > 0").withColumn("answer_to", F.when(F.col("id") % 7 == 0, "ask").when(F.col("id") % 7 == 1, "line"))
    return p.where("id % 100 = 0"), ends.where("id % 5 > 0"), ends.where("id % 5 = 0")


RANK = "sm AS (SELECT b.id AS query, a.id, round(sum(a.x * b.x), 6) AS sim FROM px a JOIN px b ON a.i = b.i AND b.id % 100 = 0 AND a.id % 100 > 0 GROUP BY b.id, a.id)"
Q["a12_points_and_notes"] = lambda spark, d: N.semantic_rank(*split(A.points(spark, d))).select("query", "kind", "id", "sim")
S["a12_points_and_notes"] = oracle("px", "+" + RANK + ", o AS (SELECT *, CASE WHEN id % 5 = 0 THEN 'note' ELSE 'point' END AS kind, row_number() OVER (PARTITION BY query ORDER BY sim DESC, id % 5 = 0, id) AS r FROM sm) SELECT query, kind, id, sim FROM o WHERE r <= 30")


def context(spark, d):
    asked, points, _ = split(A.points(spark, d))
    return N.ask(asked, points, 0.2, 0.15)


ASK = RANK + ", o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, id) AS n FROM sm WHERE id % 5 > 0 AND id % 7 > 0), cx AS (SELECT query, CAST(n AS INTEGER) AS n, id, sim FROM o WHERE n <= 8 AND sim >= 0.15 AND query IN (SELECT query FROM o GROUP BY query HAVING max(sim) >= 0.2))"
Q["a13_ask_points"] = lambda spark, d: context(spark, d).select("query", F.col("n").cast("int").alias("n"), "id", "sim")
S["a13_ask_points"] = oracle("px", "+" + ASK + " SELECT query, n, id, sim FROM cx")


def answers(spark, d):
    """Answers to the queries: some not answerable, some without or with wrong numbers."""
    a = A.points(spark, d).where("id % 100 = 0")
    k = F.col("id") / 100
    return a.select(F.col("id").alias("query"), F.when(k % 5 == 4, "no").otherwise(" True").alias("answerable"), F.concat(F.lit(" As said [2] and [77]"), F.when(k % 3 == 0, F.lit(" [1]")).otherwise("")).alias("answer"), F.when(k % 2 == 0, F.array(F.lit(9), F.lit(3), F.lit(2))).alias("used"), F.lit(8).alias("count"))


Q["c26_read_answers"] = lambda spark, d: N.read_answers(answers(spark, d)).select("query", "answerable", "answer", F.array_join(F.col("used").cast("array<string>"), ",").alias("used"))
S["c26_read_answers"] = "SELECT vec_id AS query, vec_id // 100 % 5 <> 4 AS answerable, 'As said [2] and [77]' || CASE WHEN vec_id // 100 % 3 = 0 THEN ' [1]' ELSE '' END AS answer, CASE WHEN vec_id // 100 % 3 = 0 THEN '1,' ELSE '' END || '2' || CASE WHEN vec_id // 100 % 2 = 0 THEN ',3' ELSE '' END AS used FROM embeddings WHERE vec_id % 100 = 0"


def memos(spark, d):
    labels = A.points(spark, d).where("id % 4 > 0").select("id", F.concat(F.lit("Book "), "id").alias("label"))
    read = N.read_answers(answers(spark, d)).withColumn("used", F.when(F.col("query") % 200 == 0, F.col("used")).otherwise(F.array().cast("array<int>")))
    return N.memo_texts(read, context(spark, d), labels)


Q["x14_memo_texts"] = memos
S["x14_memo_texts"] = oracle("px", "+" + ASK + """, a AS (SELECT DISTINCT id AS query, id // 100 AS k FROM px WHERE id % 100 = 0 AND id // 100 % 5 <> 4), m AS (
  SELECT a.query, k, string_agg('[' || n || '] Book ' || cx.id, ' / ' ORDER BY n) FILTER (WHERE cx.id % 4 > 0 AND (a.query % 200 > 0 OR n = 2 OR (n = 1 AND k % 3 = 0) OR (n = 3 AND k % 2 = 0))) AS cites FROM a LEFT JOIN cx ON a.query = cx.query GROUP BY a.query, k)
SELECT query, 'As said [2] and [77]' || CASE WHEN k % 3 = 0 THEN ' [1]' ELSE '' END || coalesce(chr(10) || chr(10) || CASE WHEN query % 200 = 0 THEN '根拠' ELSE 'AI に渡した点' END || ': ' || cites, '') AS text FROM m""")


def changed(spark, d):
    """Rows of even ids, edited by the events of their user: signups add, errors delete."""
    e = A.read(spark, d, "events")
    op = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "error", "delete").otherwise("update")
    edits = e.select(F.col("user_id").alias("id"), F.struct("ts", "event_id").alias("at"), op.alias("op"), F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("title"), F.when(F.col("event_id") % 2 > 0, F.col("event_id")).alias("body"))
    zero = F.struct(F.lit("2000-01-01").cast("timestamp_ntz").alias("ts"), F.lit(0).cast("long").alias("event_id"))
    rows = e.where("user_id % 2 = 0").groupBy(F.col("user_id").alias("id")).agg(F.lit(False).alias("deleted")).select("id", (F.col("id") % 14 == 0).alias("deleted"), zero.alias("created"), zero.alias("updated"), F.lit("first").alias("title"), F.lit(-1).cast("long").alias("body"))
    return N.edited(rows, edits, ["title", "body"])


Q["m22_edited_notes"] = lambda spark, d: changed(spark, d).select("id", "deleted", F.col("created.event_id").alias("created"), F.col("updated.event_id").alias("updated"), "title", "body")
S["m22_edited_notes"] = """WITH e AS (SELECT user_id AS id, event_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, event_type AS type, CASE WHEN event_id % 3 > 0 THEN event_type END AS title, CASE WHEN event_id % 2 > 0 THEN event_id END AS body FROM events),
b AS (SELECT id, CASE WHEN id % 2 = 0 THEN 0 ELSE min(CASE WHEN type = 'signup' THEN r END) END AS began FROM e WHERE id % 14 > 0 GROUP BY id), x AS (SELECT e.id, min(r) AS ended FROM e JOIN b ON e.id = b.id WHERE type = 'error' AND r > began GROUP BY e.id),
l AS (SELECT e.*, b.began, x.ended FROM e JOIN b ON e.id = b.id LEFT JOIN x ON e.id = x.id WHERE r >= began AND (ended IS NULL OR r < ended) AND type <> 'error' AND (type <> 'signup' OR (e.id % 2 > 0 AND r = began))),
g AS (SELECT id, max(r) AS last, arg_max(title, r) FILTER (WHERE title IS NOT NULL) AS title, arg_max(body, r) FILTER (WHERE body IS NOT NULL) AS body FROM l GROUP BY id)
SELECT id, true AS deleted, CAST(0 AS BIGINT) AS created, CAST(0 AS BIGINT) AS updated, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS BIGINT) AS body FROM (SELECT DISTINCT user_id AS id FROM events WHERE user_id % 14 = 0)
UNION ALL SELECT b.id, x.ended IS NOT NULL, CASE WHEN b.id % 2 = 0 THEN 0 ELSE s.k END, coalesce(z.k, u.k, 0), CASE WHEN x.ended IS NULL THEN coalesce(g.title, CASE WHEN b.id % 2 = 0 THEN 'first' END) END, CASE WHEN x.ended IS NULL THEN coalesce(g.body, CASE WHEN b.id % 2 = 0 THEN -1 END) END
FROM b LEFT JOIN x ON b.id = x.id LEFT JOIN g ON b.id = g.id LEFT JOIN e s ON s.id = b.id AND s.r = b.began LEFT JOIN e z ON z.id = b.id AND z.r = x.ended LEFT JOIN e u ON u.id = b.id AND u.r = g.last WHERE b.began IS NOT NULL"""
