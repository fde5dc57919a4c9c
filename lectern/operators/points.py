"""Points of a library (highlights and thoughts): search, removal, edits waiting for analysis,
evidence, links and what a screen shows of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import normalize_text, search_words

#: Fixed order in which reasons of removal are listed.
REASONS = ("technical", "deleted", "book-deleted", "discarded", "replaced", "thought-deleted", "missing")
#: Fixed order of sources.
SOURCES = ("kindle", "playbooks", "paper")


def tagged(tags: Column) -> Column:
    """Tags as they are searched for, with a number sign."""
    return F.concat_ws(" ", F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.concat(F.lit("#"), t)))


def matching(rows: DataFrame, query: str, *fields: Column, tags: bool = True) -> DataFrame:
    """Rows that hold every word of the query in their fields taken together; words that begin
    with a number sign are left out where tags do not count."""
    hay = normalize_text(F.concat_ws(" ", *fields))
    for word in search_words(query):
        if tags or not word.startswith("#"):
            rows = rows.where(F.contains(hay, F.lit(word)))
    return rows


def search_highlights(highlights: DataFrame, books: DataFrame, query: str = "", source: str = "", favorite: bool = False, edited: bool = False, book: str = "") -> DataFrame:
    """Live highlights with their books, filtered, newest first. A highlight whose book is
    missing stays live."""
    b = books.select(F.col("book"), "title", "author", F.col("deleted").alias("book_deleted"))
    rows = highlights.join(b, "book", "left").where(~F.coalesce("deleted", F.lit(False)) & ~F.coalesce("book_deleted", F.lit(False)))
    for wanted, test in ((source, F.col("source") == source), (favorite, F.col("favorite")), (edited, F.col("edited_at").isNotNull()), (book, F.col("book") == book)):
        rows = rows.where(test) if wanted else rows
    rows = matching(rows, query, F.col("text"), F.col("note"), F.col("chapter"), F.col("title"), F.col("author"), tagged(F.col("tags")))
    return rows.orderBy(F.col("at").desc(), "id")


def search_points(highlights: DataFrame, thoughts: DataFrame, books: DataFrame, query: str = "", source: str = "", favorite: bool = False, edited: bool = False) -> DataFrame:
    """(id, kind, at): highlights and thoughts together. Thoughts have no source but 'thought'
    and are never edited."""
    h = search_highlights(highlights, books, query, "" if source == "thought" else source, favorite, edited).select("id", F.lit("highlight").alias("kind"), "at")
    t = matching(thoughts.where(~F.col("deleted")), query, F.col("text"), tagged(F.col("tags")))
    t = (t.where("favorite") if favorite else t).select("id", F.lit("thought").alias("kind"), "at")
    if source == "thought":
        return t.orderBy(F.col("at").desc(), "id")
    both = h if source or edited else h.unionByName(t)
    return both.orderBy(F.col("at").desc(), "id")


def pending(points: DataFrame, members: DataFrame, isolated: DataFrame) -> DataFrame:
    """Points in no line and not among the isolated ones."""
    seen = members.select("id").unionByName(isolated.select("id"))
    return points.join(seen, "id", "left_anti")


def removed(analysed: DataFrame, library: DataFrame, books: DataFrame, current: DataFrame) -> DataFrame:
    """(id, reason, place): analysed points that are no points now, and why; `place` is the
    reason's rank."""
    gone = analysed.select("id").distinct().join(current.select("id"), "id", "left_anti")
    p = library.select("id", "book", "thought", "deleted", "next", F.lit(True).alias("known"))
    b = books.select("book", F.col("deleted").alias("book_deleted"))
    rows = gone.join(p, "id", "left").join(b, "book", "left")
    reason = F.when(F.col("known").isNull(), "missing").when(F.col("thought") & F.col("deleted"), "thought-deleted").when(F.col("thought"), "discarded")
    reason = reason.when(F.col("next").isNotNull(), "replaced").when(F.coalesce("book_deleted", F.lit(False)), "book-deleted").when(F.col("deleted"), "deleted").otherwise("technical")
    place = F.array_position(F.array(*[F.lit(r) for r in REASONS]), F.col("reason")).cast("int")
    return rows.select("id", reason.alias("reason")).withColumn("place", place)


def refetch(listed: DataFrame, known: DataFrame, last_top: Column) -> DataFrame:
    """Listed books whose date changed, or is the newest or last time's newest."""
    newest = listed.agg(F.max("on").alias("newest"))
    rows = listed.join(known.select("id", F.col("on").alias("was")), "id", "left").join(F.broadcast(newest), F.col("on") <= F.col("newest"))
    return rows.where(~F.col("on").eqNullSafe(F.col("was")) | (F.col("on") == F.col("newest")) | (F.col("on") == last_top)).select("id", "on")


def to_look_up(books: DataFrame, tried: DataFrame) -> DataFrame:
    """Books without a number that were not looked up yet."""
    return books.where(F.col("isbn").isNull()).join(tried.select("id"), "id", "left_anti")


def recent_picks(picks: DataFrame, today: Column, kept: int = 3) -> DataFrame:
    """(id, recent): picks of the last days; those of today are kept but not recent."""
    age = F.datediff(today, F.col("on"))
    return picks.where(age.between(0, kept)).groupBy("id").agg(F.max(age >= 1).alias("recent"))


def starred(stars: DataFrame, lines: DataFrame, running: bool) -> DataFrame:
    """(line, state): present, missing, or waiting while an analysis runs."""
    known = lines.select("line", F.lit(True).alias("known")).distinct()
    absent = "waiting" if running else "missing"
    return stars.join(known, "line", "left").select("line", F.when(F.col("known"), "present").otherwise(absent).alias("state"))


def visible_far(analysis: DataFrame, reactions: DataFrame) -> DataFrame:
    """(id, kept): far connections of the analysis and those found interesting, first wins,
    without the wrong ones."""
    wrong = reactions.where("reaction = 'wrong'").select("id")
    kept = reactions.where("reaction = 'interesting'").select("id", F.lit(True).alias("kept"))
    both = analysis.select("id", F.lit(False).alias("kept")).unionByName(kept)
    return both.join(wrong, "id", "left_anti").groupBy("id").agg(F.min("kept").alias("kept"))


def unread(discoveries: DataFrame, reads: DataFrame, previous: Column) -> DataFrame:
    """(id, fresh): discoveries without a reading; fresh ones are of the current run."""
    return discoveries.join(reads.select("id"), "id", "left_anti").select("id", (F.col("found_at") > previous).alias("fresh"))


def same_spot(a: DataFrame, b: DataFrame, width: int = 64) -> DataFrame:
    """(a, b): ranges of one book that overlap or touch, or share a page where one has no place.
    Ranges meet in bins, once per pair."""
    bins = F.explode(F.sequence(F.floor((F.col("start") - 1) / width), F.floor((F.col("end") + 1) / width)))
    left = a.where("start is not null").withColumn("bin", bins).alias("x")
    right = b.where("start is not null").withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width)))).alias("y")
    near = (F.col("x.start") <= F.col("y.end") + 1) & (F.col("y.start") <= F.col("x.end") + 1)
    # the pair is reported in the first bin that both reach
    first = F.greatest(F.floor((F.col("x.start") - 1) / width), F.floor(F.col("y.start") / width))
    met = left.join(right, (F.col("x.book") == F.col("y.book")) & (F.col("x.bin") == F.col("y.bin")) & near & (F.col("x.bin") == first)).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    x, y = a.alias("x"), b.alias("y")
    placeless = F.col("x.start").isNull() | F.col("y.start").isNull()
    paged = x.join(y, (F.col("x.book") == F.col("y.book")) & (F.col("x.page") == F.col("y.page")) & placeless).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    return met.unionByName(paged)


def partners(points: DataFrame) -> DataFrame:
    """(id, partner): the first member of the point's line that comes from another source."""
    p = points.select("line", F.col("id").alias("other"), F.col("source").alias("theirs"))
    # the two lowest of different sources answer every member of the line
    low = p.groupBy("line", "theirs").agg(F.min("other").alias("other"))
    met = points.join(low, "line").where("source <> theirs")
    return met.groupBy("id").agg(F.min("other").alias("partner"))


def former_ids(current: DataFrame) -> DataFrame:
    """(current, former): every id that has become another, by what it is now."""
    return current.where("id <> current").select("current", F.col("id").alias("former"))


def missing_evidence(notes: DataFrame, points: DataFrame) -> DataFrame:
    """(note, missing): how many cited points are not there; notes without any are kept."""
    known = points.select(F.col("id").alias("cited"), F.lit(1).alias("known")).distinct()
    rows = notes.select("note", F.explode_outer("evidence").alias("cited")).join(known, "cited", "left")
    return rows.groupBy("note").agg(F.count_if(F.col("cited").isNotNull() & F.col("known").isNull()).alias("missing"))


def judged_counts(judged: DataFrame) -> DataFrame:
    """(id, n): how often a point was in a judged pair."""
    ends = judged.select(F.explode(F.array("a", "b")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("n"))


def cites(notes: DataFrame, current: DataFrame, wanted: DataFrame) -> DataFrame:
    """Notes that cite a wanted point, both taken to what they are now."""
    now = current.select(F.col("id").alias("cited"), "current")
    goal = wanted.select(F.col("id").alias("cited")).join(now, "cited", "left").select(F.coalesce("current", "cited").alias("goal")).distinct()
    cited = notes.select("note", F.explode("evidence").alias("cited")).join(now, "cited", "left").select("note", F.coalesce("current", "cited").alias("goal"))
    return cited.join(goal, "goal", "left_semi").select("note").distinct()


def unlink(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links without those between two ends, whichever way round."""
    key = lambda a, b: [F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")]
    gone = pairs.select(*key("a", "b")).distinct()
    return links.withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b")).join(gone, ["lo", "hi"], "left_anti").drop("lo", "hi")


def changed_since(rows: DataFrame, before: DataFrame) -> DataFrame:
    """(group, changed): whether the content of a group differs from a stored fingerprint; groups
    without one count as changed."""
    now = fingerprints(rows)
    return now.join(before.select("group", F.col("print").alias("was")), "group", "left").select("group", (~F.col("print").eqNullSafe(F.col("was"))).alias("changed"))


def fingerprints(rows: DataFrame) -> DataFrame:
    """(group, print): a digest of a group's members and their texts, free of order."""
    member = F.concat_ws(":", F.col("member"), F.md5(F.coalesce("text", F.lit(""))))
    return rows.groupBy("group").agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list(member))), 256).alias("print"))


def stale_vectors(points: DataFrame, stored: DataFrame) -> DataFrame:
    """Points whose text is not the one that their stored vector stands for."""
    own = points.select("id", F.md5("text").alias("hash"))
    return own.join(stored.select("id", F.col("hash").alias("was")), "id", "left").where(~F.col("hash").eqNullSafe(F.col("was"))).select("id")


def union_first(*tables: DataFrame) -> DataFrame:
    """Rows of several tables by id; the first table that has an id wins."""
    every = None
    for n, t in enumerate(tables):
        t = t.withColumn("_n", F.lit(n))
        every = t if every is None else every.unionByName(t)
    rest = [c for c in every.columns if c not in ("id", "_n")]
    best = every.groupBy("id").agg(F.min_by(F.struct(*rest), "_n").alias("b"))
    return best.select("id", "b.*")


def ranked_union(a: Column, b: Column, order: tuple[str, ...] = SOURCES) -> Column:
    """The union of two sets of names: known ones in their fixed order, then the others by name."""
    known = F.array(*[F.lit(x) for x in order])
    both = F.array_distinct(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))
    return F.concat(F.array_intersect(known, both), F.array_sort(F.array_except(both, known)))


def source_list(**flags: Column) -> Column:
    """The names whose flags hold, in the order given."""
    return F.filter(F.array(*[F.when(c, name) for name, c in flags.items()]), lambda x: x.isNotNull())


def retained(rows: DataFrame, most: int) -> DataFrame:
    """Live rows first, then the newest tombstones, at most so many."""
    return rows.orderBy("deleted", F.col("at").desc(), F.col("id").desc()).limit(most)


def unsynced(rows: DataFrame, last_sync: str | None) -> DataFrame:
    """Rows edited after the last synchronisation; all where none is known."""
    return rows if last_sync is None else rows.where(F.col("at") > F.lit(last_sync).cast("timestamp_ntz"))
