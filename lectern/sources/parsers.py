"""Readers of reading exports: Spark splits the files, expressions take the fields apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.dates import annotated_on, loose_date
from lectern.functions.text import clean_text
from lectern.operators.library import attach_notes

# Words of the clippings format, by language.
KINDS = {"highlight": ("Highlight", "ハイライト", "Markierung", "surlignement", "subrayado"), "note": ("Note", "メモ", "Notiz", "note", "nota"), "bookmark": ("Bookmark", "ブックマーク", "Lesezeichen", "signet", "marcador")}

BOOK = T.StructType(
    [
        T.StructField("asin", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("lastAnnotated", T.StringType()),
        T.StructField("highlights", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("text", "note", "location", "page", "color")]))),
    ]
)


# What stands before the time of an entry.
ADDED = "(?i)(?:Added on|作成日[:：]?|追加日[:：]?|Hinzugefügt am|Añadido el|Ajouté le|Aggiunto in data|Toegevoegd op|Adicionado:?|添加于)\\s*(.+)$"


def read_clippings(spark: SparkSession, path: str) -> DataFrame:
    """(title, author, kind, location, location_end, page, text) of clippings files, one
    record per entry between rules of equal signs; bookmarks and empty texts are dropped."""
    raw = spark.read.text(path, lineSep="==========")
    return parse_clippings(raw.select(F.col("value").alias("entry")))


def parse_clippings(entries: DataFrame) -> DataFrame:
    e = F.regexp_replace(F.regexp_replace("entry", "[\\uFEFF\r]", ""), "^[=\\s]+", "")
    lines = F.split(e, "\n")
    head, meta = F.get(lines, F.lit(0)), F.get(lines, F.lit(1))
    body = F.array_join(F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0))), "\n")
    text = F.regexp_replace(body, r"^\s+|\s+$", "")
    kind = F.lit(None).cast("string")
    for name in ("bookmark", "note", "highlight"):
        kind = F.when(meta.rlike("|".join(KINDS[name])), name).otherwise(kind)
    span = r"(?:location|loc\.|Location|位置No\.|位置)\s*([0-9,]+)(?:-([0-9]+))?"
    number = lambda i: F.regexp_replace(F.regexp_extract(meta, span, i), ",", "").try_cast("long")
    start, last = number(1), F.regexp_extract(meta, span, 2)
    # an abbreviated end, 1234-56, repeats the leading digits of the start; 1298-05 carries
    unit = F.pow(F.lit(10), F.length(last)).cast("long")
    tail = last.try_cast("long")
    end = F.when(F.length(last) < F.length(start.cast("string")), F.floor(start / unit) * unit + tail + F.when(tail < start % unit, unit).otherwise(0)).otherwise(tail)
    author = F.regexp_extract(head, r"\(((?:[^()]|\([^()]*\))*)\)\s*$", 1)
    title = F.trim(F.regexp_replace(head, r"\((?:[^()]|\([^()]*\))*\)\s*$", ""))
    page = F.regexp_extract(meta, r"(?:page|ページ|Seite)\s*([0-9ivxlc]+)", 1)
    rows = entries.select(title.alias("title"), author.alias("author"), kind.alias("kind"), start.alias("location"), F.coalesce(end, start).cast("long").alias("location_end"), F.nullif(page, F.lit("")).alias("page"), loose_date(F.regexp_extract(meta, ADDED, 1)).alias("at"), text.alias("text"))
    return rows.where("kind in ('highlight', 'note') and text <> ''")


def with_notes(entries: DataFrame) -> DataFrame:
    """(title, author, kind, location, location_end, page, at, text, note): notes joined to the
    highlight whose range ends at them, or holds them, or shares their page where both have no
    place; the others stay rows of their own."""
    e = entries.withColumn("id", F.xxhash64("title", "kind", "location", "page", "text"))
    h, n = e.where("kind = 'highlight'"), e.where("kind = 'note'")
    spans = h.select("id", F.col("title").alias("book"), F.col("location").alias("start"), F.coalesce("location_end", "location").alias("end"), F.when(F.col("location").isNull(), F.col("page")).alias("page"))
    own = n.select("id", F.col("title").alias("book"), F.col("location").alias("at"), F.when(F.col("location").isNull(), F.col("page")).alias("page"))
    found = attach_notes(own, spans).where("highlight is not null")
    said = found.join(n.select(F.col("id").alias("note"), F.col("location").alias("place"), "text"), "note").groupBy(F.col("highlight").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n").alias("note"))
    rest = n.join(found.select(F.col("note").alias("id")), "id", "left_anti").withColumn("note", F.lit(""))
    return h.join(said, "id", "left").withColumn("note", F.coalesce("note", F.lit(""))).unionByName(rest).drop("id")


def read_notebook(spark: SparkSession, path: str) -> DataFrame:
    """One row per highlight of notebook JSON, with the day of the book's last one; a note without
    a text stands for itself; empty ones and books without any are dropped."""
    raw = spark.read.schema(T.StructType([T.StructField("books", T.ArrayType(BOOK))])).json(path, multiLine=True)
    b = raw.select(F.explode("books").alias("b")).select("b.asin", "b.title", "b.author", "b.lastAnnotated", F.explode("b.highlights").alias("h"))
    location = F.regexp_replace("h.location", ",", "").try_cast("long")
    said = clean_text(F.coalesce(F.nullif("h.text", F.lit("")), "h.note"))
    own = F.coalesce("h.text", F.lit("")) != ""
    rows = b.select("asin", "title", "author", annotated_on(F.col("lastAnnotated")).alias("annotated_on"), F.when(own, "highlight").otherwise("note").alias("kind"), said.alias("text"), F.when(own, F.coalesce("h.note", F.lit(""))).otherwise("").alias("note"), location.alias("location"), "h.page", "h.color")
    return rows.where("text <> ''")


def html_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", tags: str = "p|h1|h2|li") -> DataFrame:
    """(page_id, pos, tag, text, heading): the marked-up blocks of each page in order, each
    with the heading it stands under."""
    pattern = rf"(?is)<({tags})(?:\s[^>]*)?>(.*?)</\1>"
    tag = F.regexp_extract_all(html_col, F.lit(pattern), F.lit(1))
    body = F.regexp_extract_all(html_col, F.lit(pattern), F.lit(2))
    rows = pages.select(F.col(id_col).alias("page_id"), F.posexplode(F.arrays_zip(tag.alias("tag"), body.alias("body"))).alias("pos", "b"))
    text = F.trim(F.regexp_replace(F.regexp_replace("b.body", "<[^>]*>", ""), r"[ \n\t\r]+", " "))
    rows = rows.select("page_id", "pos", F.lower("b.tag").alias("tag"), text.alias("text"))
    w = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("heading", F.last(F.when(F.col("tag").startswith("h"), F.col("text")), ignorenulls=True).over(w))


def fold_annotations(blocks: DataFrame, keys: list[str], order: str, heading: str) -> DataFrame:
    """One row per annotation listed twice: its first heading is the colour, its last the chapter."""
    return blocks.groupBy(*keys).agg(F.min_by(heading, order).alias("color"), F.max_by(heading, order).alias("chapter"))
