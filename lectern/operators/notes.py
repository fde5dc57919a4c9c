"""Thoughts and notes: what is live, what is searched and by meaning, answers from points and the
memos that keep them, and notes made from thoughts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import truncate

from .order import numbered
from .points import matching
from .vectors import ask_context, search

#: Ids of notes lie behind those of points where both are ranked together.
NOTES_FROM = 1 << 40


def live(rows: DataFrame) -> DataFrame:
    return rows.where(~F.coalesce("deleted", F.lit(False)))


def point_thoughts(thoughts: DataFrame) -> DataFrame:
    """Thoughts that count as points: live ones that were not thrown away."""
    return live(thoughts).where(F.col("status") != "discarded")


def inbox(thoughts: DataFrame) -> DataFrame:
    """Live thoughts still to be sorted, with their place: newest first, then by id."""
    return numbered(live(thoughts).where(F.col("status") == "inbox"), [(F.col("created"), True), (F.col("id"), False)])


def unedited_draft() -> Column:
    """Whether a note is a line's draft that nobody has touched since."""
    return F.coalesce((F.col("from_kind") == "line") & (F.col("updated") == F.col("created")), F.lit(False))


def notes_for_analysis(notes: DataFrame) -> DataFrame:
    """Live notes in the reader's own words: drafts of lines only once they were edited."""
    return live(notes).where(~unedited_draft())


def search_notes(notes: DataFrame, query: str) -> DataFrame:
    """Live notes that hold every word in title or body, with their place: last changed first."""
    return numbered(matching(live(notes), query, F.col("title"), F.col("body")), [(F.col("updated"), True), (F.col("id"), False)])


def note_from_thought(thoughts: DataFrame, asked: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(notes, thoughts): a note of each asked thought (id, note: the new id) that lies in the
    inbox, its first line as the title and itself as evidence; these thoughts are then done. Asked
    ones that are elsewhere give no note, so asking twice makes one."""
    open_ = live(thoughts).where(F.col("status") == "inbox").join(asked.groupBy("id").agg(F.min("note").alias("note")), "id")
    first = F.get(F.filter(F.split("text", "\n"), lambda t: F.trim(t) != ""), F.lit(0))
    notes = open_.select(F.col("note").alias("id"), truncate(F.trim(F.coalesce(first, F.col("text"))), 40).alias("title"), F.col("text").alias("body"), F.array("id").alias("evidence"), F.lit("thought").alias("from_kind"), now.alias("created"), now.alias("updated"))
    done = thoughts.join(open_.select("id", F.lit(True).alias("moved")), "id", "left")
    moved = F.coalesce("moved", F.lit(False))
    return notes, done.withColumns({"status": F.when(moved, "done").otherwise(F.col("status")), "updated": F.when(moved, now).otherwise(F.col("updated"))}).drop("moved")


def semantic_rank(queries: DataFrame, points: DataFrame, notes: DataFrame, n: int = 30) -> DataFrame:
    """(query, kind, id, sim, rank): the n points and notes (id, v) closest to each query (id, v)
    together; points before notes, then the lower id, among equals."""
    ends = points.select("id", "v").unionByName(notes.select((F.col("id") + NOTES_FROM).alias("id"), "v"))
    found = search(queries.select((-F.col("id") - 1).alias("id"), "v"), ends, n)  # no end has a query's number
    note = F.col("id") >= NOTES_FROM
    return found.select((-F.col("query") - 1).alias("query"), F.when(note, "note").otherwise("point").alias("kind"), F.when(note, F.col("id") - NOTES_FROM).otherwise(F.col("id")).alias("id"), "sim", "rank")


def ask(queries: DataFrame, points: DataFrame, gate: float = 0.58, level: float = 0.5, most: int = 8) -> DataFrame:
    """(query, n, id, sim): the points that an answer may rest on, numbered from 1 by closeness:
    none if the closest is below the gate. Kept answers (answer_to 'ask') were made from points
    and are no ground for the next; notes are not asked."""
    own = points.where(F.coalesce(F.col("answer_to") != "ask", F.lit(True)))
    ranked = search(queries.select((-F.col("id") - 1).alias("id"), "v"), own.select("id", "v"), 2 * most)
    fit = ask_context(ranked, gate, level, most)
    return fit.join(ranked.select("query", "id", "rank"), ["query", "id"]).select((-F.col("query") - 1).alias("query"), F.col("rank").alias("n"), "id", "sim")


def read_answers(answers: DataFrame, most: int = 1200) -> DataFrame:
    """(query, answerable, answer, used): answers (query, answerable as a text, answer, used, count)
    as they may be trusted: an answer there must be, called answerable; used are the numbers given
    or in brackets that name one of the points."""
    said = F.substring(F.trim(F.coalesce("answer", F.lit(""))), 1, most)
    inline = F.transform(F.regexp_extract_all(said, F.lit(r"\[([0-9]{1,2})\]"), F.lit(1)), lambda x: x.cast("int"))
    numbers = F.filter(F.concat(F.coalesce("used", F.array().cast("array<int>")), inline), lambda x: x.between(1, F.col("count")))
    yes = (F.lower(F.trim(F.coalesce("answerable", F.lit("")))) == "true") & (said != "")
    return answers.select("query", yes.alias("answerable"), said.alias("answer"), F.array_sort(F.array_distinct(numbers)).alias("used"))


# What a memo calls its sources, given by the answer or else handed to it.
GROUNDS, HANDED = "根拠", "AI に渡した点"


def memo_texts(answers: DataFrame, context: DataFrame, labels: DataFrame) -> DataFrame:
    """(query, text): answers that can be kept, with the places (label by id) of the points they rest
    on: those they name, or all they were given. Points that are gone are left out."""
    rows = answers.where("answerable").join(context.select("query", "n", "id"), "query", "left")
    rows = rows.where((F.size("used") == 0) | F.col("n").isNull() | F.array_contains("used", F.col("n"))).join(labels.select("id", "label"), "id", "left")
    cite = F.when(F.col("label").isNotNull(), F.struct("n", F.concat(F.lit("["), "n", F.lit("] "), "label").alias("t")))
    got = rows.groupBy("query", "answer", (F.size("used") > 0).alias("cited")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(cite)), lambda x: x["t"]), " / ").alias("cites"))
    tail = F.concat(F.lit("\n\n"), F.when(F.col("cited"), GROUNDS).otherwise(HANDED), F.lit(": "), F.col("cites"))
    return got.select("query", F.when(F.col("cites") != "", F.concat("answer", tail)).otherwise(F.col("answer")).alias("text"))


def edited(rows: DataFrame, edits: DataFrame, fields: list[str]) -> DataFrame:
    """Rows (id, deleted, created, updated and `fields`) after edits (id, at, op and `fields`, null
    where untouched). `add` begins a row that is not there; `update` changes what it touches;
    `delete` leaves a tombstone without fields, and what comes after it is void, as are edits of
    rows that are missing or deleted. Edits of a row are taken by time, adds first among equals."""
    rank = F.when(F.col("op") == "add", 0).when(F.col("op") == "update", 1).otherwise(2)
    there = rows.select("id", F.col("deleted").alias("was_gone"), F.col("created").alias("was_created"), F.col("updated").alias("was_updated"), *[F.col(f).alias("was_" + f) for f in fields], F.lit(True).alias("there"))
    log = edits.withColumn("rank", rank).join(there.select("id", "there", "was_gone"), "id", "left").where(~F.coalesce("was_gone", F.lit(False)))
    began = log.where("op = 'add' and there is null").groupBy("id").agg(F.min("at").alias("began"))
    log = log.join(began, "id", "left").where(F.col("there").isNotNull() | (F.col("at") >= F.col("began")))
    log = log.where((F.col("op") != "add") | F.col("there").isNull() & (F.col("at") == F.col("began")))
    ended = log.where("op = 'delete'").groupBy("id").agg(F.min("at").alias("ended"))
    log = log.join(ended, "id", "left").where(F.col("ended").isNull() | (F.col("at") < F.col("ended")) | (F.col("at") == F.col("ended")) & (F.col("rank") <= 2))
    order = F.struct("at", "rank")
    said = log.where("op <> 'delete'")
    last = said.groupBy("id").agg(F.max("at").alias("changed"), *[F.max_by(f, F.when(F.col(f).isNotNull(), order)).alias("new_" + f) for f in fields])
    out = there.join(last, "id", "full").join(began, "id", "left").join(ended, "id", "left")
    gone = F.coalesce("was_gone", F.lit(False)) | F.col("ended").isNotNull()
    return out.select(
        "id", gone.alias("deleted"), F.coalesce("was_created", "began").alias("created"), F.coalesce("ended", F.greatest("changed", "was_updated")).alias("updated"),
        *[F.when(~gone, F.coalesce("new_" + f, "was_" + f)).alias(f) for f in fields],
    )
