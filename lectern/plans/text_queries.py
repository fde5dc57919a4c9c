"""Queries over text and date functions with their oracle SQL."""

from pyspark.sql import functions as F

from lectern.functions import dates as D
from lectern.functions import text as T

from . import adapters as A

Q, S = {}, {}


def of(table, f):
    return lambda spark, d: f(A.read(spark, d, table))


Q["c01_normalize_text"] = of("documents", lambda t: t.select("doc_id", F.md5(T.normalize_text(F.concat(F.lit("  A\u200b\u3000"), F.col("text")))).alias("h")))
S["c01_normalize_text"] = r"SELECT doc_id, md5(lower(trim('a ' || regexp_replace(text, '\s+', ' ', 'g')))) AS h FROM documents"
Q["c03_book_key"] = of("part", lambda t: t.select("p_partkey", T.book_key(F.concat(F.lit("Ａ・"), F.col("p_name"), F.lit(" -- 第２版!"))).alias("key")))
S["c03_book_key"] = "SELECT p_partkey, 'a' || regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') || '第2版' AS key FROM part"
Q["c05_iso_stamp"] = of("events", lambda t: t.select("event_id", D.iso_stamp(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 5 == 0, "").otherwise("Z")), F.lit("2024-01-10T00:00:00Z")).alias("stamp")))
S["c05_iso_stamp"] = "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' WHEN date_trunc('second', ts) > TIMESTAMP '2024-01-11' THEN '2024-01-10T00:00:00Z' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS stamp FROM events"
Q["c06_loose_date"] = of("orders", lambda t: t.select("o_orderkey", D.loose_date(F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy年M月d日 '午後'3:04:05")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy/M/d")).otherwise(F.concat(F.year("o_orderdate"), F.lit("-02-30")))).cast("timestamp_ntz").alias("at")))
S["c06_loose_date"] = "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL '15:04:05' HOUR TO SECOND WHEN 1 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END AS \"at\" FROM orders".replace("INTERVAL '15:04:05' HOUR TO SECOND", "INTERVAL 54245 SECOND")
Q["c07_annotated_on"] = of("orders", lambda t: t.select("o_orderkey", D.annotated_on(F.date_format("o_orderdate", "EEEE MMMM d, yyyy")).alias("day"), D.add_months(F.year("o_orderdate"), F.month("o_orderdate"), -7)["month"].cast("int").alias("month")))
S["c07_annotated_on"] = "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(month(o_orderdate - INTERVAL 7 MONTH) AS INTEGER) AS month FROM orders"
Q["c11_subtitle"] = of("part", lambda t: t.select("p_partkey", T.without_repeated_subtitle(F.concat("p_name", F.lit(": "), F.when(F.col("p_partkey") % 2 == 0, F.substring_index("p_name", " ", 1)).otherwise(F.lit("other")))).alias("title")))
S["c11_subtitle"] = "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || ': other' END AS title FROM part"
Q["c12_label"] = of("part", lambda t: t.select("p_partkey", T.label(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(" 文庫 12)"), F.when(F.col("p_partkey") % 3 == 0, "【上】").otherwise(""))).alias("label")))
S["c12_label"] = "SELECT p_partkey, p_brand || ' 文庫' AS label FROM part"
Q["c13_color_name"] = of("part", lambda t: t.select("p_partkey", T.color_name(F.concat(F.lit("#"), F.lpad(F.lower(F.hex(F.col("p_partkey") * 7919 % 16777216)), 6, "0"))).alias("color")))
S["c13_color_name"] = """WITH a AS (SELECT p_partkey, p_partkey * 7919 % 16777216 AS v FROM part), c AS (SELECT p_partkey, (v // 65536) / 255.0 AS r, (v // 256 % 256) / 255.0 AS g, (v % 256) / 255.0 AS b FROM a),
h AS (SELECT p_partkey, greatest(r, g, b) - least(r, g, b) AS d, 60 * CASE WHEN greatest(r, g, b) = r THEN (g - b) / nullif(greatest(r, g, b) - least(r, g, b), 0) WHEN greatest(r, g, b) = g THEN (b - r) / (greatest(r, g, b) - least(r, g, b)) + 2 ELSE (r - g) / (greatest(r, g, b) - least(r, g, b)) + 4 END AS u FROM c), w AS (SELECT p_partkey, d, CASE WHEN u < 0 THEN u + 360 ELSE u END AS u FROM h)
SELECT p_partkey, CASE WHEN d < 0.08 THEN '' WHEN u < 20 OR u >= 345 THEN 'red' WHEN u < 40 THEN 'orange' WHEN u < 70 THEN 'yellow' WHEN u < 170 THEN 'green' WHEN u < 260 THEN 'blue' WHEN u < 300 THEN 'purple' ELSE 'pink' END AS color FROM w"""
Q["c14_expanded_end"] = of("orders", lambda t: t.select("o_orderkey", T.expanded_end(F.col("o_orderkey") + 1000, F.lpad(((F.col("o_orderkey") + 37) % 100).cast("string"), 2, "0")).alias("last")))
S["c14_expanded_end"] = "SELECT o_orderkey, o_orderkey + 1037 AS last FROM orders"
Q["c15_points_text"] = of("part", lambda t: t.select("p_partkey", T.points_of(F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit("獲得, "), F.format_number(F.col("p_partkey") * 3, 0), F.lit("pt (1%)"))).otherwise("none")).alias("points"), T.publisher_of(F.concat(F.lit("出版社 : "), "p_brand", F.lit("; 第2版 (2020/10/14)"))).alias("publisher")))
S["c15_points_text"] = "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_partkey * 3 END AS points, p_brand AS publisher FROM part"
Q["c17_store_ids"] = of("part", lambda t: t.select("p_partkey", T.store_id_of_url(F.concat(F.lit("https://store.example/x/dp/"), F.when(F.col("p_partkey") % 2 == 0, "B0").otherwise("48"), F.lpad(F.col("p_partkey").cast("string"), 8, "0"), F.lit("?ref=1"))).alias("asin")).withColumn("electronic", T.is_store_id(F.col("asin"))))
S["c17_store_ids"] = "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'B0' ELSE '48' END || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS asin, p_partkey % 2 = 0 AS electronic FROM part"
Q["c19_effective_price"] = of("part", lambda t: t.select("p_partkey", F.round(T.effective_price(F.when(F.col("p_partkey") % 6 != 0, F.col("p_retailprice")), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size"))), 2).alias("price")))
S["c19_effective_price"] = "SELECT p_partkey, CASE WHEN p_partkey % 6 <> 0 THEN round(p_retailprice - CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE 0 END, 2) END AS price FROM part"
Q["c21_escape_markdown"] = of("part", lambda t: t.select("p_partkey", T.escape_markdown(F.concat(F.lit("- #"), "p_name", F.lit(" [x](y)"))).alias("text"), T.note_file_name(F.concat("p_name", F.lit(": a/b?. "))).alias("file")))
S["c21_escape_markdown"] = r"SELECT p_partkey, '\- \#' || p_name || ' \[x\]\(y\)' AS text, p_name || '_ a_b_.md' AS file FROM part"
Q["c22_embed_text"] = of("orders", lambda t: t.select("o_orderkey", T.embed_text(F.col("o_orderpriority"), F.when(F.col("o_orderkey") % 2 == 0, ""), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus"))).alias("text")))
S["c22_embed_text"] = "SELECT o_orderkey, o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN chr(10) || o_orderstatus ELSE '' END AS text FROM orders"
Q["c23_one_line"] = of("documents", lambda t: t.select("doc_id", T.one_line(F.col("text"), 80).alias("line")))
S["c23_one_line"] = r"SELECT doc_id, CASE WHEN length(l) > 80 THEN substr(l, 1, 79) || '…' ELSE l END AS line FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\x00-\x1f\x7f-\x{9f}\x{200b}-\x{200d}\x{feff}]', ' ', 'g'), '\s+', ' ', 'g')) AS l FROM documents)"
Q["c24_title_candidates"] = of("part", lambda t: t.select("p_partkey", F.array_join(T.title_candidates(F.concat("p_name", F.lit(" (series): sub"))), "|").alias("names")))
S["c24_title_candidates"] = "SELECT p_partkey, p_name || ' (series): sub|' || p_name || ' : sub|' || p_name || CASE WHEN length(split_part(p_name, ' ', 2)) > length(split_part(p_name, ' ', 1)) THEN '|' || split_part(p_name, ' ', 2) ELSE '|' || split_part(p_name, ' ', 1) END AS names FROM part"
Q["c25_atom_time"] = of("orders", lambda t: t.select("o_orderkey", D.atom_time(F.when(F.col("o_orderkey") % 3 == 0, "never").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))).alias("at")))
S["c25_atom_time"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '1970-01-01T00:00:00+00:00' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') END AS \"at\" FROM orders"
Q["c26_cited"] = of("orders", lambda t: t.select("o_orderkey", F.array_join(T.cited(F.concat(F.lit("so [3] and ["), F.col("o_orderkey") % 15, F.lit("] and [3] or [99]")), 12).cast("array<string>"), ",").alias("used")))
S["c26_cited"] = "SELECT o_orderkey, CASE WHEN k BETWEEN 1 AND 2 THEN k || ',3' WHEN k BETWEEN 4 AND 12 THEN '3,' || k ELSE '3' END AS used FROM (SELECT o_orderkey, o_orderkey % 15 AS k FROM orders)"
