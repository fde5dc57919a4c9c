"""Queries over sources and over the batch form of streams, with their oracle SQL."""

from pyspark.sql import functions as F

from lectern.sources import parsers as P
from lectern.streaming import ticks as T

from . import adapters as A
from .adapters import oracle

Q, S = {}, {}

Q["t03_change_events"] = lambda spark, d: T.change_events_batch(A.price_history(spark, d))
S["t03_change_events"] = oracle("ph", """+a AS (SELECT *, lag(ku) OVER (PARTITION BY asin ORDER BY ts, id) AS was FROM ph WHERE ku OR price IS NOT NULL), b AS (SELECT *, lag(price) OVER (PARTITION BY asin ORDER BY ts, id) AS prev FROM ph WHERE NOT ku AND price IS NOT NULL)
SELECT asin, id, CASE WHEN ku THEN 'joined' ELSE 'left' END AS kind, CAST(NULL AS DOUBLE) AS prev, CAST(NULL AS DOUBLE) AS price FROM a WHERE was IS NOT NULL AND was <> ku UNION ALL SELECT asin, id, CASE WHEN price < prev THEN 'drop' ELSE 'rise' END, prev, price FROM b WHERE prev <> price""")
Q["s05_html_blocks"] = lambda spark, d: P.html_blocks(A.read(spark, d, "pages")).groupBy("page_id", "tag").agg(F.count("*").alias("n"))
S["s05_html_blocks"] = "SELECT page_id, lower(tag) AS tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<(p|h1|h2|li)(?:\\s[^>]*)?>.*?</(?:p|h1|h2|li)>', 1)) AS tag FROM pages) GROUP BY 1, 2"
Q["s10_fold_annotations"] = lambda spark, d: P.fold_annotations(A.read(spark, d, "events"), ["user_id"], "event_id", "event_type")
S["s10_fold_annotations"] = "SELECT user_id, arg_min(event_type, event_id) AS color, arg_max(event_type, event_id) AS chapter FROM events GROUP BY user_id"
Q["c27_url_host"] = lambda spark, d: A.read(spark, d, "pages").select("page_id", F.lower(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)).alias("host"))
S["c27_url_host"] = "SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages"
