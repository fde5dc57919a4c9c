"""Queries over catalogues, landed pages, the inbox, followed jobs and identifiers, with their
oracle SQL. Files and pages are made from the tables, then read by the readers."""

from pyspark.sql import functions as F

from lectern.functions import ids as I
from lectern.sources import catalogues as C
from lectern.sources import exports as E
from lectern.streaming import inbox, jobs

from . import adapters as A

Q, S = {}, {}

Q["c10_short_hash"] = lambda spark, d: A.read(spark, d, "part").select("p_partkey", I.short_hash(F.col("p_name")).alias("hash"), F.round(I.seeded(F.col("p_partkey"), F.col("p_size")), 9).alias("random"))
#: Folds a name's units, and walks the generator's stride.
S["c10_short_hash"] = """WITH u AS (SELECT p_partkey, p_partkey AS seed, p_size, list_transform(string_split(p_name, ''), lambda c: CAST(ascii(c) AS HUGEINT)) AS u FROM part),
f AS (SELECT *, list_reduce(u, lambda h, c: xor(CAST(h AS HUGEINT), c) * 2654435761 % 4294967296, CAST(3735928559 AS HUGEINT)) AS a, list_reduce(u, lambda h, c: xor(CAST(h AS HUGEINT), c) * 1597334677 % 4294967296, CAST(1103547991 AS HUGEINT)) AS b FROM u),
g AS (SELECT *, xor(xor(a, a >> 16) * 2246822507 % 4294967296, xor(b, b >> 13) * 3266489909 % 4294967296) AS c FROM f),
n AS (SELECT *, CAST(4294967296 * (xor(xor(b, b >> 16) * 2246822507 % 4294967296, xor(c, c >> 13) * 3266489909 % 4294967296) % 2097152) + c AS BIGINT) AS n, (seed + (CAST(p_size AS BIGINT) + 1) * 1831565813) % 4294967296 AS s FROM g),
t AS (SELECT *, xor(CAST(s AS HUGEINT), CAST(s AS HUGEINT) >> 15) * (CAST(s AS HUGEINT) | 1) % 4294967296 AS t FROM n), v AS (SELECT *, xor(t, (t + xor(t, t >> 7) * (t | 61)) % 4294967296) AS v FROM t)
SELECT p_partkey, ltrim(array_to_string(list_transform(range(12), lambda i: substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST(n // CAST(power(36, 11 - i) AS BIGINT) % 36 AS BIGINT) + 1, 1)), ''), '0') AS hash, round(CAST(xor(v, v >> 14) AS DOUBLE) / 4294967296, 9) AS random FROM v"""


def answers(spark, d):
    """Answers around a JSON object: thoughts, fences, notes in brackets, and some that break off."""
    t = A.read(spark, d, "orders")
    k = F.col("o_orderkey")
    item = F.concat(F.lit('{"key": '), k.cast("string"), F.lit(', "text": "a } or ] \\" ", "list": [1, {"b": 2}]}'))
    said = F.when(k % 5 == 0, F.concat(F.lit("<think>{\"key\": 0}</think>"), item)).when(k % 5 == 1, F.concat(F.lit("Here:\n```json\n"), item, F.lit("\n```\n{}")))
    return t.select("o_orderkey", item.alias("item"), said.when(k % 5 == 2, F.concat(F.lit("[note] {form} "), item, F.lit(" {}"))).when(k % 5 == 3, F.concat(F.lit("cut: "), F.substring(item, 1, 30))).otherwise(F.concat(F.lit(" "), item, F.lit("\n"))).alias("answer"))


Q["c18_salvaged_json"] = lambda spark, d: answers(spark, d).select("o_orderkey", I.salvaged_json(F.col("answer")).alias("json"))
S["c18_salvaged_json"] = r"""SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 3 THEN '{"key": ' || o_orderkey || ', "text": "a } or ] \" ", "list": [1, {"b": 2}]}' END AS json FROM orders"""


def store_pages(spark, d):
    """A page of results for each brand: every seventh card stands in a paid place, every eleventh
    says so, every thirteenth is a paper book, and every fifth holds another card."""
    p = A.read(spark, d, "part").select("p_partkey", "p_brand")
    k = F.col("p_partkey")
    asin = F.when(k % 13 == 0, F.lpad(k.cast("string"), 10, "4")).otherwise(F.concat(F.lit("B0"), F.lpad(k.cast("string"), 8, "0")))
    card = F.concat(F.lit('<div data-asin="'), asin, F.lit('"><p>price<span>'), F.when(k % 11 == 0, "Sponsored").otherwise("1"), F.lit("</span>"), F.when(k % 5 == 0, '<i data-asin="B0INNER000">x</i>').otherwise(""), F.lit("</div>"))
    card = F.when(k % 7 == 0, F.concat(F.lit('<div class="row AdHolder">'), card, F.lit("</div>"))).otherwise(card)
    rows = p.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", card.alias("c")))).alias("c"))
    return rows.select(F.col("p_brand").alias("name"), F.concat(F.lit('<html><div data-asin="B0OUTSIDE0">top</div><div class="s-main-slot list">'), F.array_join(F.transform("c", lambda x: x["c"]), "</em>"), F.lit("</div></html>")).alias("html"))


Q["s17_store_search"] = lambda spark, d: C.store_search(C.elements(store_pages(spark, d))).select("name", "asin", F.col("pos").cast("long").alias("pos"))
S["s17_store_search"] = "SELECT p_brand AS name, 'B0' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS asin, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS pos FROM part WHERE p_partkey % 13 > 0 AND p_partkey % 11 > 0 AND p_partkey % 7 > 0"


def wish_pages(spark, d):
    """A wish-list page for each brand; every third title is cut, with the whole one on its cover."""
    p = A.read(spark, d, "part").select("p_partkey", "p_brand", "p_name", "p_type")
    k = F.col("p_partkey")
    said = F.when(k % 3 == 0, F.concat(F.substring("p_name", 1, 5), F.lit("…"))).otherwise(F.col("p_name"))
    card = F.concat(F.lit('<li class="group__book"><img alt="'), F.when(k % 3 < 2, F.col("p_name")).otherwise("cover"), F.lit('"><div class="detail__title"><a href="/books/'), k.cast("string"), F.lit('">'), said, F.lit('</a></div><ul class="detail__authors"><li><a>'), F.col("p_type"), F.lit("</a></li><li><a>B</a></li></ul></li>"))
    rows = p.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", card.alias("c")))).alias("c"))
    return rows.select(F.col("p_brand").alias("name"), F.concat(F.lit("<ul>"), F.array_join(F.transform("c", lambda x: x["c"]), ""), F.lit("</ul>")).alias("html"))


Q["s16_wish_list_page"] = lambda spark, d: C.wish_list_page(C.elements(wish_pages(spark, d))).select("name", "title", "author", "book")
S["s16_wish_list_page"] = "SELECT p_brand AS name, p_name AS title, p_type || '、B' AS author, CAST(p_partkey AS VARCHAR) AS book FROM part"


def rss(spark, d):
    """An answer of a catalogue for each brand, in RSS; every sixth item is no book."""
    p, k = A.read(spark, d, "part"), F.col("p_partkey")
    item = F.concat(F.lit("<item><title>short</title><dc:title>"), F.col("p_name"), F.lit(" &amp; more</dc:title><link>"), F.when(k % 2 == 0, "https").otherwise("http"), F.lit("://c/"), k.cast("string"), F.lit("</link><dc:creator>"), F.col("p_type"), F.lit(", A, 1867-1916</dc:creator><category>"), F.when(k % 6 == 0, "映像").otherwise("図書"), F.lit('</category><dc:identifier xsi:type="dcndl:ISBN">978-'), k.cast("string"), F.lit("</dc:identifier></item>"))
    rows = p.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("c")))).alias("c"))
    return rows.select(F.col("p_brand").alias("name"), F.concat(F.lit("<rss><channel>"), F.array_join(F.transform("c", lambda x: x["c"]), ""), F.lit("</channel></rss>")).alias("text"))


Q["s19_catalogue_rss"] = lambda spark, d: C.catalogue_rss(rss(spark, d)).select("name", "title", "authors", "link", "isbn")
S["s19_catalogue_rss"] = "SELECT p_brand AS name, p_name || ' & more' AS title, p_type || ' A' AS authors, CASE WHEN p_partkey % 2 = 0 THEN 'https://c/' || p_partkey ELSE '' END AS link, '978' || p_partkey AS isbn FROM part WHERE p_partkey % 6 > 0"


def mark_files(spark, d):
    """Mark files by day of order; those of some days are broken."""
    o = A.read(spark, d, "orders")
    k = F.col("o_orderkey")
    tag = F.element_at(F.array(*[F.lit(x) for x in ("seen", "want", "skipped")], F.lit(None).cast("string")), (k % 4 + 1).cast("int"))
    mark = F.struct(F.concat(F.lit("C"), F.col("o_custkey")).alias("asin"), tag.alias("tag"), (k % 7).cast("string").alias("rating"))
    day = o.groupBy(F.date_format("o_orderdate", "yyyyMMdd").alias("day")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", mark.alias("m")))).alias("m"))
    text = F.to_json(F.struct(F.lit("marks").alias("format"), F.transform("m", lambda x: x["m"]).alias("items")))
    return day.select(F.concat("day", F.lit(".json")).alias("file"), F.when(F.endswith("day", F.lit("13")), F.substring(text, 1, 25)).otherwise(text).alias("text"))


Q["t01_inbox"] = lambda spark, d: inbox.current(inbox.marks_of(inbox.read_files(mark_files(spark, d))))
S["t01_inbox"] = "WITH o AS (SELECT *, strftime(CAST(o_orderdate AS DATE), '%Y%m%d') AS day FROM orders), l AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY day DESC, o_orderkey DESC) AS r FROM o WHERE NOT ends_with(day, '13')) SELECT 'C' || o_custkey AS asin, ['seen', 'want', 'skipped'][o_orderkey % 4 + 1] AS tag, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 7 BETWEEN 1 AND 5 THEN CAST(o_orderkey % 7 AS INTEGER) END AS rating FROM l WHERE r = 1 AND o_orderkey % 4 < 3"


def polls(spark, d):
    """Answers to polls: events of a user, an hour counted as a second."""
    e = A.read(spark, d, "events")
    state = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "stopped").otherwise("running")
    ts = F.timestamp_micros((F.unix_micros(F.col("ts").cast("timestamp")) / 3600).cast("long"))
    return e.select(F.col("user_id").alias("job"), F.col("event_id").alias("id"), ts.alias("ts"), state.alias("state"))


Q["t12_job_outcomes"] = lambda spark, d: jobs.outcomes_batch(polls(spark, d), 20.0, 2).select("job", F.unix_micros("began").alias("began"), F.unix_micros("ended").alias("ended"), "outcome")
#: Follows each job row by row.
S["t12_job_outcomes"] = """WITH RECURSIVE p AS (SELECT user_id AS job, event_id AS id, CAST(trunc(epoch_us(CAST(ts AS TIMESTAMP)) / 3600.0) AS BIGINT) AS us, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'stopped' ELSE 'running' END AS state FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY us, id) AS r FROM p), e AS (SELECT max(us) AS last FROM p),
s AS (
  SELECT DISTINCT job, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS began, CAST(0 AS BIGINT) AS last, 0 AS bad, CAST([] AS STRUCT(began BIGINT, ended BIGINT, outcome VARCHAR)[]) AS found FROM p
  UNION ALL
  SELECT job, r, CASE WHEN state IN ('running', 'failed') AND bad < 2 THEN began END, us, bad,
    list_concat(found, CASE WHEN state IN ('running', 'failed') AND bad < 2 THEN [] ELSE [{'began': began, 'ended': us, 'outcome': CASE state WHEN 'done' THEN 'done' WHEN 'failed' THEN 'lost' ELSE 'interrupted' END}] END)
  FROM (
    SELECT n.job, n.r, n.us, n.state, CASE WHEN lost OR a.began IS NULL THEN n.us ELSE a.began END AS began, CASE WHEN n.state <> 'failed' THEN 0 WHEN lost OR a.began IS NULL THEN 1 ELSE a.bad + 1 END AS bad,
      list_concat(a.found, CASE WHEN lost THEN [{'began': a.began, 'ended': a.last, 'outcome': 'lost'}] ELSE [] END) AS found
    FROM (SELECT s.*, n.us AS now, s.began IS NOT NULL AND n.us > s.last + CAST((least(30.0, 1.5 * power(2, s.bad)) + 20) * 1000000 AS BIGINT) AS lost FROM s JOIN n ON n.job = s.job AND n.r = s.r + 1) a JOIN n ON n.job = a.job AND n.r = a.r + 1)
), z AS (SELECT s.* FROM s JOIN (SELECT job, max(r) AS r FROM n GROUP BY job) m ON s.job = m.job AND s.r = m.r), f AS (
  SELECT job, unnest(list_concat(found, CASE WHEN began IS NOT NULL AND e.last > z.last + CAST((least(30.0, 1.5 * power(2, bad)) + 20) * 1000000 AS BIGINT) THEN [{'began': began, 'ended': z.last, 'outcome': 'lost'}] ELSE [] END)) AS x FROM z, e
) SELECT job, x.began AS began, x.ended AS ended, x.outcome AS outcome FROM f"""


def note_files(spark, d):
    """A note file for each brand: chapters by type, some items of two lines, some without an id."""
    p, k = A.read(spark, d, "part"), F.col("p_partkey")
    item = F.concat(F.lit("- "), F.col("p_name"), F.when(k % 3 == 0, "\n    and more").otherwise(""), F.when(k % 4 > 0, F.concat(F.lit(" ^h"), k)).otherwise(""), F.when(k % 2 == 0, "\n  - メモ: mine").otherwise(""), F.when(k % 5 == 0, "\n  - タグ: #a #b #a").otherwise(""), F.when(k % 7 == 0, "\n  - ★").otherwise(""), F.lit("\n"))
    part = p.groupBy("p_brand", "p_type").agg(F.concat(F.lit("## "), F.col("p_type"), F.lit("\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("t")))), lambda x: x["t"]), "")).alias("t"))
    rows = part.groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_type", "t"))), lambda x: x["t"]), "\n").alias("t"))
    return rows.select(F.col("p_brand").alias("name"), F.concat(F.lit("---\nbookId: "), F.col("p_brand"), F.lit("\ntitle: T\n---\n"), F.col("t")).alias("text"))


Q["s22_note_files"] = lambda spark, d: E.note_file(note_files(spark, d)).select("book", "id", "text", "note", F.array_join("tags", ",").alias("tags"), "star", "chapter")
S["s22_note_files"] = "SELECT p_brand AS book, CASE WHEN p_partkey % 4 > 0 THEN 'h' || p_partkey END AS id, p_name || CASE WHEN p_partkey % 3 = 0 THEN chr(10) || 'and more' ELSE '' END AS text, CASE WHEN p_partkey % 2 = 0 THEN 'mine' END AS note, CASE WHEN p_partkey % 5 = 0 THEN 'a,b' ELSE '' END AS tags, p_partkey % 7 = 0 AS star, p_type AS chapter FROM part"
