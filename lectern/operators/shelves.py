"""Upserts of mappings and marks, unique-only matches and recommendation inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import numbered


def unique_match(rows: DataFrame, known: DataFrame, key: str, value: str) -> DataFrame:
    """Adds `value` where the key maps to exactly one distinct value."""
    one = known.groupBy(key).agg(F.countDistinct(value).alias("n"), F.min(value).alias(value)).where("n = 1").drop("n")
    return rows.join(one, key, "left")


def fill_truncated(rows: DataFrame, full: DataFrame, width: int) -> DataFrame:
    """(id, title): titles cut at `width` take the full title if exactly one distinct full
    title begins with them; an equi-join on the first `width` characters."""
    f = full.select(F.substring("title", 1, width).alias("head"), "title").distinct()
    one = f.groupBy("head").agg(F.count("*").alias("n"), F.min("title").alias("full")).where("n = 1")
    out = rows.join(one, F.col("title") == F.col("head"), "left")
    return out.select("id", F.when(F.length("title") >= width, F.coalesce("full", "title")).otherwise(F.col("title")).alias("title"))


def upsert_mapping(base: DataFrame, incoming: DataFrame, key: str, flags: list[str], fields: list[str]) -> DataFrame:
    """Flags are or-ed, blank fields filled, new keys inserted; rows without a key rejected."""
    b, i = base.where(F.col(key).isNotNull()).alias("b"), incoming.where(F.col(key).isNotNull()).alias("i")
    out = b.join(i, F.col(f"b.{key}") == F.col(f"i.{key}"), "full")
    either = lambda c: F.coalesce(F.col(f"b.{c}"), F.lit(False)) | F.coalesce(F.col(f"i.{c}"), F.lit(False))
    return out.select(F.coalesce(f"b.{key}", f"i.{key}").alias(key), *[either(c).alias(c) for c in flags], *[F.coalesce(F.col(f"b.{c}"), F.col(f"i.{c}")).alias(c) for c in fields])


def import_marks(marks: DataFrame, items: DataFrame) -> DataFrame:
    """Marks after a file of items (asin, n, tag, rating): the last of duplicates wins, null
    fields leave what is there, an empty tag clears it, marks left empty go."""
    w = Window.partitionBy("asin").orderBy(F.col("n").desc())
    last = items.withColumn("r", F.row_number().over(w)).where("r = 1").select("asin", F.col("tag").alias("new_tag"), F.col("rating").alias("new_rating"))
    out = marks.join(last, "asin", "full")
    tag = F.nullif(F.coalesce("new_tag", "tag"), F.lit(""))
    rating = F.when(tag == "seen", F.coalesce("new_rating", "rating"))
    return out.select("asin", tag.alias("tag"), rating.alias("rating")).where("tag is not null or rating is not null")


def merge_local_marks(local: DataFrame, saved: DataFrame) -> DataFrame:
    """(asin, tag, outcome): local marks newer than the saved ones win."""
    out = local.alias("l").join(saved.alias("s"), "asin", "full")
    newer = F.col("l.at").isNotNull() & (F.col("s.at").isNull() | (F.col("l.at") > F.col("s.at")))
    outcome = F.when(F.col("l.at").isNull(), "kept").when(newer, "applied").otherwise("skipped")
    return out.select("asin", F.when(newer, F.col("l.tag")).otherwise(F.col("s.tag")).alias("tag"), outcome.alias("outcome"))


def publishable(tag: Column, rating: Column, allowed: tuple[str, ...] = ("want", "seen")) -> Column:
    """Listed tags only; a rating of 1 to 5 only beside `seen`."""
    shown = F.when(tag.isin(*allowed), tag)
    return F.struct(shown.alias("tag"), F.when((shown == "seen") & rating.between(1, 5), rating).alias("rating"))


def work_list(books: DataFrame, done: DataFrame, seen: DataFrame, start: int = 1) -> DataFrame:
    """Books still to be looked at, from position `start` on."""
    rest = books.where("not manga and not purchased").join(done.select("asin"), "asin", "left_anti").join(seen.select("asin"), "asin", "left_anti")
    return numbered(rest.select("asin"), [(F.col("asin"), False)]).where(F.col("pos") >= start).select("asin", "pos")


def seen_inputs(marks: DataFrame, per_kind: int = 60) -> DataFrame:
    """(kind, asin, pos): the newest seen books of each kind, by rating and title."""
    newest = Window.partitionBy("kind").orderBy(F.col("at").desc(), F.col("asin").desc())
    top = marks.where("tag = 'seen'").withColumn("r", F.row_number().over(newest)).where(F.col("r") <= per_kind)
    shown = Window.partitionBy("kind").orderBy(F.col("rating").desc_nulls_last(), "title", "asin")
    return top.select("kind", "asin", F.row_number().over(shown).cast("long").alias("pos"))


def candidate_pool(found: DataFrame, excluded: DataFrame, per_query: int = 5) -> DataFrame:
    """(query, asin): new candidates, each under its first query, a few per query."""
    fresh = found.join(excluded.select("asin"), "asin", "left_anti")
    first = fresh.groupBy("asin").agg(F.min(F.struct("query", "pos")).alias("b")).select("asin", "b.query", "b.pos")
    w = Window.partitionBy("query").orderBy("pos", "asin")
    return first.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_query).select("query", "asin")


def evidence_overlap(notes: DataFrame, wanted: list[int]) -> DataFrame:
    """(note, any, all): notes citing any, or all, of some points."""
    hit = notes.where(F.col("point").isin(*wanted)).groupBy("note").agg(F.countDistinct("point").alias("n"))
    return hit.select("note", F.lit(True).alias("any"), (F.col("n") == len(set(wanted))).alias("all"))


def auto_recompute(changed: DataFrame, most: int = 10, hours: int = 24) -> DataFrame:
    """(user, due): ten changes, or any change and a day since the last run."""
    return changed.select("user", ((F.col("n") >= most) | ((F.col("n") > 0) & (F.col("hours") >= hours))).alias("due"))
