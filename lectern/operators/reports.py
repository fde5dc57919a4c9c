"""Small relational pieces of screens and jobs: lookups of points, drafts, outline materials, page
labels and limits per kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import numbered, total_in_group

#: The letter that ids of a kind begin with, before 1 to 40 small letters and digits.
ID_LETTERS = {"highlight": "h", "thought": "t", "note": "n", "outline": "o", "link": "k", "discovery": "d", "far": "f"}


def id_kind(c: Column) -> Column:
    """What an id names by its form; null for none."""
    out = F.lit(None).cast("string")
    for kind, letter in ID_LETTERS.items():
        out = F.when(F.substring(c, 1, 1) == letter, kind).otherwise(out)
    return F.when(c.rlike("^[a-z][0-9a-z]{1,40}$"), out)


def is_point(c: Column) -> Column:
    """Highlights and thoughts are points."""
    return F.coalesce(id_kind(c).isin("highlight", "thought"), F.lit(False))


def is_link_end(c: Column) -> Column:
    """A link joins points and notes; so does a far connection."""
    return is_point(c) | F.coalesce(id_kind(c) == "note", F.lit(False))


def point_states(asked: DataFrame, points: DataFrame, current: DataFrame) -> DataFrame:
    """(id, current, state): missing, discarded, deleted or live, of what an id is now."""
    now = asked.join(current.select("id", F.col("current").alias("now")), "id", "left").withColumn("now", F.coalesce("now", "id"))
    known = points.select(F.col("id").alias("now"), "deleted", "discarded", F.lit(True).alias("known"))
    state = F.when(F.col("known").isNull(), "missing").when(F.col("deleted"), "deleted").when(F.col("discarded"), "discarded").otherwise("live")
    return now.join(known, "now", "left").select("id", F.col("now").alias("current"), state.alias("state"))


def merged_tables(base: DataFrame, incoming: DataFrame, key: str, fields: list[str], stamp: str) -> DataFrame:
    """All keys of two tables; fields come from the newer side, from the other where that side
    has none; the base wins ties."""
    b, i = base.alias("b"), incoming.alias("i")
    met = b.join(i, F.col(f"b.{key}") == F.col(f"i.{key}"), "full")
    theirs = F.coalesce(F.col(f"i.{stamp}") > F.col(f"b.{stamp}"), F.col(f"b.{key}").isNull())
    pick = lambda f: F.when(theirs, F.coalesce(f"i.{f}", f"b.{f}")).otherwise(F.coalesce(f"b.{f}", f"i.{f}"))
    return met.select(F.coalesce(f"b.{key}", f"i.{key}").alias(key), *[pick(f).alias(f) for f in fields], F.greatest(f"b.{stamp}", f"i.{stamp}").alias(stamp))


def limited(rows: DataFrame, group: str, order: list[Column], limits: dict[str, int]) -> DataFrame:
    """The first rows of each group, as many as the group's limit; groups without one are
    left out."""
    top = F.lit(0)
    for g, n in limits.items():
        top = F.when(F.col(group) == g, n).otherwise(top)
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= top).drop("_r")


def outline_materials(points: DataFrame, most: int = 20) -> DataFrame:
    """(outline, id, pos): points of an outline's sources taken in turn, each once, at most so
    many."""
    per_source = Window.partitionBy("outline", "source").orderBy("place", "id")
    once = points.groupBy("outline", "id").agg(F.min(F.struct("source", "place")).alias("f")).select("outline", "id", "f.*")
    turn = once.withColumn("turn", F.row_number().over(per_source))
    pos = F.row_number().over(Window.partitionBy("outline").orderBy("turn", "source", "id"))
    return turn.withColumn("pos", pos).where(F.col("pos") <= most).select("outline", "id", "pos")


def note_drafts(lines: DataFrame, members: DataFrame) -> DataFrame:
    """(line, title, evidence): a draft note of each line with its points in order."""
    own = members.groupBy("line").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("evidence"))
    return lines.join(own, "line").select("line", F.col("name").alias("title"), "evidence")


def far_links(far: DataFrame, reactions: DataFrame) -> DataFrame:
    """(a, b, at): interesting far connections as links between their ends, in a fixed order."""
    kept = reactions.where("reaction = 'interesting'").select("id", "at")
    return far.join(kept, "id").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "at")


#: What addresses and titles of block pages hold, with the label each stands for,
#: and the length below which a page's text is suspicious.
BLOCKED_URLS = {"/errors/validatecaptcha": "captcha", "/ap/cvf/": "robot_check", "/robot": "robot_check", "ref=cs_503_link": "robot_check"}
BLOCKED_TITLES = {"captcha": "captcha", "robot check": "robot_check", "ロボット": "robot_check", "不審なアクセス": "access_denied", "sorry": "access_denied", "verify": "access_denied", "エラーが発生しました": "access_denied"}
SHORT_PAGE = 200


def page_label(url: Column, title: Column, body: Column) -> Column:
    """ok, or what a landed page is instead: by its address, then by its title (where "captcha"
    counts before all else, and what stands first in the list before the rest), then suspicious if
    its text is short."""
    out = F.when(F.length(F.coalesce(body, F.lit(""))) < SHORT_PAGE, "suspicious").otherwise("ok")
    for where, marks in ((F.lower(F.coalesce(title, F.lit(""))), BLOCKED_TITLES), (F.lower(F.coalesce(url, F.lit(""))), BLOCKED_URLS)):
        for mark, label in reversed(marks.items()):
            out = F.when(F.contains(where, F.lit(mark)), label).otherwise(out)
    return out


def first_unsponsored(cards: DataFrame) -> DataFrame:
    """(query, asin): the first candidate that is no advertisement, unless any card of the query
    shows a block."""
    g = cards.groupBy("query").agg(F.min_by("asin", F.when(~F.col("sponsored"), F.col("pos"))).alias("asin"), F.max("blocked").alias("blocked"))
    return g.where("not blocked and asin is not null").select("query", "asin")


def distinct_names(rows: DataFrame) -> DataFrame:
    """(id, name): the first of equal names by id keeps it, the k-th repeat gets the k-th number
    from 2 on that no name of the table bears already, as ` (2)`.

    Of a name's numbers that are taken, in order t1, t2, ..., exactly tj - 1 - j free ones stand
    before tj, so the k-th repeat passes those taken for which that is less than k: a running
    count over taken numbers and repeats together, without a task for all of a name."""
    rows = rows.select("id", "name")
    key = [(F.col("id"), False)]
    repeats = total_in_group(rows, "name", key, F.lit(1), "n").withColumn("k", F.col("n") - 1)
    form = r"^(?s)(.*) \(([1-9][0-9]{0,8})\)$"
    made = rows.select(F.regexp_extract("name", form, 1).alias("name"), F.regexp_extract("name", form, 2).try_cast("long").alias("t")).where("t >= 2").distinct()
    taken = total_in_group(made, "name", [(F.col("t"), False)], F.lit(1), "j").select("name", (F.col("t") - 1 - F.col("j")).alias("k"), F.lit(1).alias("taken"), F.col("t").alias("id"))
    both = repeats.select("name", "k", F.lit(0).alias("taken"), "id").unionByName(taken)
    passed = total_in_group(both, "name", [(F.col("k"), False), (F.col("taken"), False), (F.col("id"), False)], F.col("taken"), "passed")
    shown = F.concat("name", F.lit(" ("), F.col("k") + 1 + F.col("passed"), F.lit(")"))
    return passed.where("taken = 0").select("id", F.when(F.col("k") == 0, F.col("name")).otherwise(shown).alias("name"))


def vector_cache(rows: DataFrame, width: int) -> DataFrame:
    """(id, v): stored vectors of the right width; those with missing or non-finite numbers are
    dropped and made anew."""
    fine = (F.size("v") == width) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.coalesce(fine, F.lit(False)))


def empty_export(pages: DataFrame) -> DataFrame:
    """(name, why): pages whose annotations are hidden, or that have none."""
    hidden = F.col("html").rlike("(?i)display\\s*:\\s*none|hidden")
    return pages.select("name", F.when(F.col("n") > 0, "filled").when(hidden, "hidden").otherwise("empty").alias("why"))


def batches(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Rows with the number of the batch that they are fetched in, in the order of a key that tells
    them apart: every batch but the last holds `size`."""
    numbered_ = numbered(rows, [(F.col(key), False)], "_n")
    return numbered_.withColumn("batch", F.floor((F.col("_n") - 1) / size)).drop("_n")


# How often a check runs without a word on it, and the limits of what it may report.
INTERVAL, LONGEST, COUNTS, ERROR_CHARS = 15, 1440, 100_000, 300
REPORT = "ok boolean, needLogin boolean, added bigint, fetched bigint, intervalMin string, error string"


def health_reports(reports: DataFrame) -> DataFrame:
    """(id, ok, need_login, added, fetched, interval, error) of reports (id, body: JSON). One with a
    field of another form, or a number beyond its limits, is dropped as a whole; fields that are not
    known are left out, control characters go from the error's text."""
    read = reports.select("id", F.from_json("body", REPORT, {"mode": "PERMISSIVE"}).alias("r"), F.try_parse_json("body").alias("v"))
    said = lambda f: F.try_variant_get("v", f"$.{f}", "string")
    kinds = {"ok": "BOOLEAN", "needLogin": "BOOLEAN", "added": "BIGINT", "fetched": "BIGINT", "error": "STRING"}
    fine = F.col("r.ok").isNotNull()
    for field, kind in kinds.items():
        own = F.schema_of_variant(F.try_variant_get("v", f"$.{field}", "variant"))
        fine = fine & (said(field).isNull() | (own == kind))
    limits = lambda c: F.coalesce(F.col(c), F.lit(0)).between(0, COUNTS)
    minutes = F.coalesce(F.trim("r.intervalMin").try_cast("bigint"), F.when(F.col("r.intervalMin").isNull(), F.lit(INTERVAL).cast("bigint")))
    rows = read.where(fine & limits("r.added") & limits("r.fetched") & minutes.between(1, LONGEST))
    plain = F.regexp_replace(F.coalesce("r.error", F.lit("")), r"\p{Cntrl}", "")
    return rows.select("id", F.col("r.ok").alias("ok"), F.coalesce("r.needLogin", F.lit(False)).alias("need_login"), F.coalesce("r.added", F.lit(0)).alias("added"), F.col("r.fetched").alias("fetched"), minutes.alias("interval"), F.substring(plain, 1, ERROR_CHARS).alias("error"))


def seen_picks(kept: DataFrame) -> DataFrame:
    """(owner, day, id) of kept histories (owner, text) of what was shown when; what cannot be read
    counts for nothing."""
    days = kept.select("owner", F.explode(F.from_json("text", "array<struct<day:string,ids:array<string>>>")).alias("e"))
    return days.where("e.day is not null").select("owner", "e.day", F.explode("e.ids").alias("id")).where("id is not null")


def shuffle_seeds(kept: DataFrame, day: Column) -> DataFrame:
    """(owner, seed): the seed that was chosen for that day, empty for another day's or none."""
    r = F.from_json("text", "struct<day:string,seed:string>")
    return kept.select("owner", F.coalesce(F.when(r["day"] == day, r["seed"]), F.lit("")).alias("seed"))
