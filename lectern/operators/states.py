"""States of a library kept on several devices: merges with clocks per field group, upserts,
marks, snapshots that lose members, and records applied to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _newest(fields: list[str], clock: str, tie: str) -> Column:
    """The fields of the version with the latest clock; versions without one never win."""
    return F.max_by(F.struct(*fields), F.when(F.col(clock).isNotNull(), F.struct(clock, tie)))


def merge_highlights(versions: DataFrame) -> DataFrame:
    """(id, text, original, edited_at, tags, deleted, next) of versions with the clocks updated,
    user_at and edited_at. Imported text is the newest; an edited text goes by its own clock; the user's
    fields go together by theirs. A version replaced at import (next without joined) stays
    replaced wherever it comes from; points joined by the user follow the user's clock."""
    forced = F.when(F.col("next").isNotNull() & ~F.col("joined"), F.col("next"))
    user = F.coalesce(_newest(["tags", "deleted", "next", "joined"], "user_at", "content"), F.struct(F.lit(None).cast("string").alias("tags"), F.lit(False).alias("deleted"), F.lit(None).cast("long").alias("next"), F.lit(False).alias("joined")))
    m = versions.groupBy("id").agg(
        _newest(["text"], "updated", "content").alias("imported"),
        F.max_by(F.struct("text", "original"), F.when(F.col("edited_at").isNotNull(), F.struct("edited_at", "content"))).alias("edited"),
        F.max("edited_at").alias("edited_at"),
        user.alias("user"),
        F.min(forced).alias("forced"),
    )
    joined = F.when(F.col("user.joined"), F.col("user.next"))
    goal = F.coalesce("forced", joined)
    return m.select(
        "id",
        F.coalesce("edited.text", "imported.text").alias("text"),
        F.col("edited.original").alias("original"),
        "edited_at",
        F.col("user.tags").alias("tags"),
        (F.col("user.deleted") | goal.isNotNull()).alias("deleted"),
        goal.alias("next"),
    )


def hand_over(points: DataFrame) -> DataFrame:
    """(id, tags, user_at): a replaced point's edits pass to the live point that replaced it where
    they are newer; of several the newest pass."""
    given = points.where("next is not null and user_at is not null").groupBy(F.col("next").alias("goal")).agg(F.max_by(F.struct("tags", "user_at"), F.struct("user_at", "id")).alias("given"))
    rows = points.join(given, F.col("id") == F.col("goal"), "left")
    newer = ~F.col("deleted") & F.col("given").isNotNull() & (F.col("user_at").isNull() | (F.col("given.user_at") > F.col("user_at")))
    return rows.select("id", *[F.when(F.coalesce(newer, F.lit(False)), F.col(f"given.{c}")).otherwise(F.col(c)).alias(c) for c in ("tags", "user_at")])


def merge_thoughts(versions: DataFrame) -> DataFrame:
    """(id, text, status, favorite, deleted): three clocks, and a delete that sticks."""
    groups = {"text": "text_at", "status": "status_at", "favorite": "favorite_at"}
    picks = [F.max_by(F.col(f), F.when(F.col(c).isNotNull(), F.struct(c, f))).alias(f) for f, c in groups.items()]
    return versions.groupBy("id").agg(*picks, F.max("deleted").alias("deleted"))


def collection(versions: DataFrame, keys: list[str], fields: list[str], most: int | None = None) -> DataFrame:
    """Links, reactions, stars, assignments, dismissals or outlines of several devices: the newest
    by key, deletes stick, live ones first up to a limit."""
    best = versions.groupBy(*keys).agg(F.max_by(F.struct("at", *fields), F.struct("at", *fields)).alias("b"), F.max("deleted").alias("deleted"))
    out = best.select(*keys, "b.*", "deleted")
    return out if most is None else out.orderBy("deleted", F.col("at").desc(), *keys).limit(most)


def newer_analysis(local: DataFrame, incoming: DataFrame) -> DataFrame:
    """The snapshot that was made last; the local one on ties."""
    both = local.withColumn("rank", F.lit(1)).unionByName(incoming.withColumn("rank", F.lit(0)))
    best = both.agg(F.max(F.struct(F.greatest("created", F.coalesce("recommended", "created")).alias("fresh"), "rank", "created", "recommended", "name")).alias("b"))
    return best.select("b.name", "b.fresh")


def get_or_create(known: DataFrame, wanted: DataFrame, key: str = "paid_id") -> DataFrame:
    """Known rows and new ones for keys not there; null keys are rejected, repeats made once."""
    new = wanted.where(F.col(key).isNotNull()).join(known.select(key), key, "left_anti").groupBy(key).agg(F.min("title").alias("title"))
    return known.select(key, "title", F.lit(False).alias("new")).unionByName(new.select(key, "title", F.lit(True).alias("new")))


def set_fields(rows: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows with the fields that a change names; fields that are null in it stay."""
    c = changes.select(key, *[F.col(f).alias(f"new_{f}") for f in fields])
    return rows.join(c, key, "left").select(*[F.coalesce(f"new_{n}", n).alias(n) if n in fields else F.col(n) for n in rows.columns])


def effective_marks(saved: DataFrame, local: DataFrame) -> DataFrame:
    """(asin, tag, own): local marks over saved ones; local ones that say what is saved already
    can go."""
    both = saved.withColumnRenamed("tag", "old").join(local.withColumnRenamed("tag", "mine"), "asin", "full")
    return both.select("asin", F.coalesce("mine", "old").alias("tag"), (F.col("mine").isNotNull() & ~F.col("mine").eqNullSafe(F.col("old"))).alias("own"))


def apply_record_changes(records: DataFrame, changes: DataFrame) -> DataFrame:
    """(book, read_on): 'read' sets the day, 'remove' and 'exclude' take the record away; the
    last change of a book holds."""
    last = changes.groupBy("book").agg(F.max_by(F.struct("action", "on"), "seq").alias("c"))
    both = records.join(last, "book", "full")
    day = F.when(F.col("c.action") == "read", F.col("c.on")).when(F.col("c").isNull(), F.col("read_on"))
    return both.select("book", day.alias("read_on")).where("read_on is not null")


def apply_notes(points: DataFrame, notes: DataFrame) -> DataFrame:
    """(id, note, star, changed): a note file's rows change only the fields that differ; rows
    missing in the file stay as they are."""
    n = notes.select("id", F.col("note").alias("new_note"), F.col("star").alias("new_star"), F.lit(True).alias("listed"))
    rows = points.join(n, "id", "left")
    listed = F.coalesce("listed", F.lit(False))
    changed = listed & (~F.col("note").eqNullSafe(F.col("new_note")) | ~F.col("star").eqNullSafe(F.col("new_star")))
    return rows.select("id", F.when(listed, F.col("new_note")).otherwise(F.col("note")).alias("note"), F.when(listed, F.col("new_star")).otherwise(F.col("star")).alias("star"), changed.alias("changed"))


def changed_files(files: DataFrame, written: DataFrame, last_sync: Column) -> DataFrame:
    """Files edited after the last synchronisation whose content is not what was written then."""
    rows = files.join(written.select("name", F.col("hash").alias("was")), "name", "left")
    return rows.where((F.col("edited") > last_sync) & ~F.col("hash").eqNullSafe(F.col("was"))).select("name")


def edit(rows: DataFrame, edits: DataFrame, now: str) -> DataFrame:
    """Row edits (id, action, text): 'text' replaces the text and keeps the first original, 'delete'
    and 'restore' set the tombstone, 'add' brings a row; unknown ids of other actions are ignored."""
    last = lambda a: F.max_by("text", F.when(F.col("action") == a, F.col("seq")))
    tomb = F.max_by("action", F.when(F.col("action").isin("delete", "restore"), F.col("seq")))
    e = edits.groupBy("id").agg(last("text").alias("new"), last("add").alias("added"), tomb.alias("tomb"))
    both = rows.join(e, "id", "full").where(F.col("text").isNotNull() | F.col("added").isNotNull())
    base = F.coalesce("text", "added")
    replaced = F.col("new").isNotNull() & (F.col("new") != base)
    return both.select(
        "id",
        F.coalesce("new", base).alias("text"),
        F.when(replaced, F.coalesce("original", base)).otherwise(F.col("original")).alias("original"),
        F.when(F.col("tomb") == "delete", True).when(F.col("tomb") == "restore", False).otherwise(F.coalesce("deleted", F.lit(False))).alias("deleted"),
        F.when(F.col("new").isNotNull() | F.col("added").isNotNull() | F.col("tomb").isNotNull(), F.lit(now)).otherwise(F.col("updated")).alias("updated"),
    )


def toggle(rows: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """(keys, on): a wanted key turns off where it is on, and on where it is not."""
    w = wanted.select(*keys, F.lit(True).alias("w")).distinct()
    both = rows.select(*keys, "on").join(w, keys, "full")
    return both.select(*keys, F.when(F.col("w"), ~F.coalesce("on", F.lit(False))).otherwise(F.col("on")).alias("on"))


def joined_points(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """Two neighbours as one: (id, text, tags, start, end), and which ids it replaces."""
    a, b = points.alias("a"), points.alias("b")
    met = pairs.join(a, F.col("first") == F.col("a.id")).join(b, F.col("second") == F.col("b.id"))
    return met.select(
        F.col("a.id").alias("id"),
        F.concat("a.text", "b.text").alias("text"),
        F.array_distinct(F.concat("a.tags", "b.tags")).alias("tags"),
        F.least("a.start", "b.start").alias("start"),
        F.greatest("a.end", "b.end").alias("end"),
        F.array("a.id", "b.id").alias("replaces"),
    )


def migrated(rows: DataFrame, added: dict[str, Column]) -> DataFrame:
    """A table with further columns; as many rows as before or an error."""
    out = rows.withColumns({n: c for n, c in added.items() if n not in rows.columns})
    if out.count() != rows.count():
        raise ValueError("the migration changed the number of rows")
    return out
