"""The driver's tables as the tables of a reading library, for Spark and for oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asin, id, ts, price, ku, campaign): failed scrapes have no price, unlimited rows price 0."""
    kind = F.col("event_type")
    price = F.when(kind == "error", None).when(kind == "signup", 0.0).otherwise(F.round("value", 2))
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("asin"), F.col("event_id").alias("id"), "ts", price.alias("price"), (kind == "signup").alias("ku"), F.when(kind == "purchase", F.col("props")).alias("campaign"))


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asin, title, wanted, purchased, target)."""
    c = read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("asin"), F.col("c_name").alias("title"), (F.col("c_acctbal") > 0).alias("wanted"), (F.col("c_mktsegment") == "BUILDING").alias("purchased"), F.when(F.col("c_custkey") % 3 == 0, F.round(F.abs("c_acctbal") / 100, 2)).alias("target"))


def highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, book, chapter, location, text, favorite, deleted) of documents and their labels."""
    d, t = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    t = t.select("doc_id", (F.col("quality") == 1).alias("favorite"), (F.col("toxic") == 1).alias("deleted"))
    d = d.select("doc_id", "source", "lang", "n_chars", "text").join(t, "doc_id", "left")
    return d.select(F.col("doc_id").alias("id"), F.col("source").alias("book"), F.col("lang").alias("chapter"), F.col("n_chars").alias("location"), "text", F.coalesce("favorite", F.lit(False)).alias("favorite"), F.coalesce("deleted", F.lit(False)).alias("deleted"))


def title_of(book):
    """The title of a highlight's book: those of five sources are technical."""
    return F.when(book.isin("src10", "src11", "src12", "src13", "src14"), F.concat(F.lit("Ｌearning SQL, "), book)).otherwise(F.concat(F.lit("The javanese digital sea "), book))


def wishlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, title, price, label, kind, size, ku, wanted, purchased)."""
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(k.alias("idx"), F.col("p_name").alias("title"), F.when(k % 7 != 0, F.round("p_retailprice", 2)).alias("price"), F.col("p_brand").alias("label"), F.col("p_type").alias("kind"), F.col("p_size").alias("size"), (k % 11 == 0).alias("ku"), (k % 2 == 0).alias("wanted"), (k % 5 == 0).alias("purchased"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, read_on, pages): pages are unknown for every ninth book."""
    o = read(spark, sf_dir, "orders")
    pages = F.when(F.col("o_orderkey") % 9 != 0, (F.col("o_orderkey") % 700 + 20).cast("long"))
    return o.select(F.col("o_orderkey").alias("book"), F.col("o_orderdate").cast("date").alias("read_on"), pages.alias("pages"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, line, source, v): unit vectors in double precision."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("line"), (F.col("vec_id") % 7).alias("source"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user, field, replica, updated, value, gone, id): states of one key on two devices."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("user"), F.col("event_type").alias("field"), (F.col("event_id") % 2).alias("replica"), F.col("ts").alias("updated"), F.round("value", 2).alias("value"), (F.col("event_id") % 13 == 0).alias("gone"), F.col("event_id").alias("id"))


#: The same tables as common table expressions.
CTE = {
    "ph": "ph AS (SELECT user_id AS asin, event_id AS id, ts, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'signup' THEN 0.0 ELSE round(value, 2) END AS price, event_type = 'signup' AS ku, CASE WHEN event_type = 'purchase' THEN props END AS campaign FROM events)",
    "bk": "bk AS (SELECT c_custkey AS asin, c_name AS title, c_acctbal > 0 AS wanted, c_mktsegment = 'BUILDING' AS purchased, CASE WHEN c_custkey % 3 = 0 THEN round(abs(c_acctbal) / 100, 2) END AS target FROM customer)",
    "hl": "hl AS (SELECT d.doc_id AS id, d.source AS book, d.lang AS chapter, d.n_chars AS location, d.text, coalesce(l.quality = 1, false) AS favorite, coalesce(l.toxic = 1, false) AS deleted FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)",
    "wl": "wl AS (SELECT p_partkey AS idx, p_name AS title, CASE WHEN p_partkey % 7 <> 0 THEN round(p_retailprice, 2) END AS price, p_brand AS label, p_type AS kind, p_size AS size, p_partkey % 11 = 0 AS ku, p_partkey % 2 = 0 AS wanted, p_partkey % 5 = 0 AS purchased FROM part)",
    "rd": "rd AS (SELECT o_orderkey AS book, CAST(o_orderdate AS DATE) AS read_on, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderkey % 700 + 20 AS BIGINT) END AS pages FROM orders)",
    "vs": "vs AS (SELECT user_id AS \"user\", event_type AS field, event_id % 2 AS replica, ts AS updated, round(value, 2) AS value, event_id % 13 = 0 AS gone, event_id AS id FROM events)",
    "pt": "pt AS (SELECT vec_id AS id, label AS line, vec_id % 7 AS source, embedding AS v FROM embeddings)",
    "px": "px AS (SELECT vec_id AS id, label AS line, vec_id % 7 AS source, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)",
}


def oracle(names: str, body: str) -> str:
    return "WITH " + ", ".join(CTE[n] for n in names.split()) + (", " if body.lstrip().startswith("+") else " ") + body.lstrip().removeprefix("+")
