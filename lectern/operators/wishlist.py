"""Wish-list filters, facets, sorts and matching, and reading-record rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import normalize_text, search_words, title_key

from .order import numbered


def shelf(name: str) -> Column:
    """Purchased books stand on that shelf only."""
    if name == "purchased":
        return F.col("purchased")
    return ~F.col("purchased") & (F.col("wanted") if name == "wanted" else ~F.col("wanted"))


def filtered(books: DataFrame, shelf_name: str | None = None, words: str = "", ku: bool | None = None, label: str | None = None, least: float | None = None, most: float | None = None, tag: str = "", kind: str = "", reading: str = "", mark: Column | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """All conditions together; an inverted price range is ignored and flagged. Words are looked
    up in the title and the columns `also`, whatever their width and case; tag `untagged` asks for none;
    reading (`unread` or `reading`) counts on the shelf of purchased books only; `mark` is a
    price mark's test."""
    out = books
    if shelf_name:
        out = out.where(shelf(shelf_name))
    if shelf_name == "purchased" and reading in ("unread", "reading"):
        begun = F.coalesce("reading", F.lit(False))
        out = out.where(begun if reading == "reading" else ~begun)
    hay = normalize_text(F.concat_ws(" ", "title", *[F.col(c).cast("string") for c in also]))
    for word in search_words(words):
        out = out.where(F.contains(hay, F.lit(word)))
    if tag:
        held = F.coalesce("tag", F.lit(""))
        out = out.where(held == ("" if tag == "untagged" else tag))
    if kind:
        out = out.where(F.col("kind") == kind)
    if mark is not None:
        out = out.where(F.coalesce(mark, F.lit(False)))
    if ku is not None:
        out = out.where(F.col("ku") == ku)
    if label:
        out = out.where(F.col("label") == label)
    inverted = least is not None and most is not None and least > most
    if not inverted:
        out = out.where(F.col("price") >= least) if least is not None else out
        out = out.where(F.col("price") <= most) if most is not None else out
    return out.withColumn("range_ignored", F.lit(inverted))


def facets(books: DataFrame, **marks: Column) -> DataFrame:
    """(facet, n): how many books each named mark holds for; a book may count under several."""
    held = F.filter(F.array(*[F.when(c, name) for name, c in marks.items()]), lambda x: x.isNotNull())
    return books.select(F.explode(held).alias("facet")).groupBy("facet").agg(F.count("*").alias("n"))


def stop_reason(manga: Column, purchased: Column, seen: Column) -> Column:
    """Why a book's price is no longer looked up; the first reason holds."""
    return F.when(manga, "manga").when(purchased, "purchased").when(seen, "seen")


def is_manga(label: Column, override: Column, pattern: str = r"(?i)コミック|comic|ジャンプ|マガジン|まんが|manga") -> Column:
    """A kind set by hand wins over the guess by the label."""
    return F.coalesce(override, F.coalesce(label, F.lit("")).rlike(pattern))


def seen_summary(marks: DataFrame) -> DataFrame:
    """(kind, seen, rated): read books of each kind, and those with stars."""
    return marks.groupBy("kind").agg(F.count_if("seen").alias("seen"), F.count_if(F.col("seen") & (F.col("rating") > 0)).alias("rated"))


def first_days(stamps: DataFrame, zone: str = "Asia/Tokyo") -> DataFrame:
    """(book, first_on): the day of the first highlight in a time zone."""
    return stamps.groupBy("book").agg(F.min(F.from_utc_timestamp(F.col("at").cast("timestamp"), zone).cast("date")).alias("first_on"))


def label_counts(books: DataFrame) -> DataFrame:
    return books.groupBy("label").agg(F.count("*").alias("n"))


def totals(books: DataFrame) -> DataFrame:
    return books.agg(F.round(F.sum("price"), 2).alias("total"), F.count("price").alias("priced"), F.count_if(F.col("price").isNull()).alias("unpriced"))


def summary(books: DataFrame, top: int = 3, dropped: Column | None = None) -> DataFrame:
    """Counts, with those of unlimited books and of dropped prices, and the best unlimited picks
    (cheapest first) as text."""
    fell = F.coalesce(dropped, F.lit(False)) if dropped is not None else F.lit(False)
    place = F.struct(F.col("price").isNull().alias("none"), "price", "idx")
    none = F.lit(None).cast(books.where("ku").select(place.alias("p")).schema["p"].dataType)
    rows = books.select(F.lit(1).alias("n"), F.col("ku").cast("int").alias("ku"), fell.cast("int").alias("fell"), none.alias("p"))
    picks = books.where("ku").orderBy(F.col("price").asc_nulls_last(), "idx").limit(top).select(F.lit(0).alias("n"), F.lit(0).alias("ku"), F.lit(0).alias("fell"), place.alias("p"))
    best = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["idx"].cast("string")), ",")
    return rows.unionByName(picks).agg(F.sum("n").alias("n"), F.sum("ku").alias("n_ku"), F.sum("fell").alias("n_dropped"), best.alias("picks"))


def ranked(books: DataFrame, by: str, descending: bool = False) -> DataFrame:
    """Position under a sort; missing values stand last either way, input order breaks ties."""
    return numbered(books.select("idx", by), [(F.col(by), descending), (F.col("idx"), False)]).select("idx", "pos")


def page(books: DataFrame, number: int, size: int = 100) -> DataFrame:
    return books.orderBy("idx").offset((number - 1) * size).limit(size)


def match_titles(left: DataFrame, right: DataFrame, least: int = 5) -> DataFrame:
    """(l, r, exact): equal keys before prefixes of `least` characters or more, either way.

    Distinct keys meet, each with its first row, on their first `least` characters: an equi-join
    whose size follows the number of different titles.
    """
    a = left.select(F.col("id").alias("l"), title_key(F.col("title")).alias("a")).where(F.length("a") >= least)
    b = right.select(F.col("id").alias("r"), title_key(F.col("title")).alias("b")).where(F.length("b") >= least)
    x, y = a.select("a").distinct(), b.groupBy("b").agg(F.min("r").alias("r"))
    met = x.join(y, (F.substring("a", 1, least) == F.substring("b", 1, least)) & (F.startswith(F.col("a"), F.col("b")) | F.startswith(F.col("b"), F.col("a"))))
    best = met.groupBy("a").agg(F.min(F.struct((F.col("a") != F.col("b")).alias("loose"), "r")).alias("m"))
    return a.join(best, "a").select("l", F.col("m.r").alias("r"), (~F.col("m.loose")).alias("exact"))


def reading_state(books: DataFrame, by_id: DataFrame, by_title: DataFrame) -> DataFrame:
    """(idx, state): looked up by id, else by title (its first entry)."""
    first = by_title.groupBy("title").agg(F.min("n").alias("by_title"))
    out = books.join(by_id.select("idx", F.col("n").alias("by_id")), "idx", "left").join(first, "title", "left")
    return out.select("idx", F.when(F.coalesce("by_id", "by_title").isNull(), "unread").otherwise("reading").alias("state"))


def month_summary(records: DataFrame) -> DataFrame:
    """(read_on, books, pages, unknown): days, and a null day for the total."""
    return records.rollup("read_on").agg(F.count("*").alias("books"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"), F.count_if(F.col("pages").isNull()).alias("unknown"))


def year_summary(records: DataFrame, year: int) -> DataFrame:
    """Twelve months, empty ones included."""
    months = records.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    own = records.where(F.year("read_on") == year).groupBy(F.month("read_on").alias("month")).agg(F.count("*").alias("books"), F.sum("pages").alias("pages"))
    return months.join(own, "month", "left").select("month", F.coalesce("books", F.lit(0)).cast("long").alias("books"), F.coalesce("pages", F.lit(0)).cast("long").alias("pages"))


def automatic_records(first_dates: DataFrame, manual: DataFrame, excluded: DataFrame) -> DataFrame:
    """First highlight dates become records unless a book has its own record or is excluded."""
    return first_dates.join(manual.select("book"), "book", "left_anti").join(excluded.select("book"), "book", "left_anti")


def keep_newest(rows: DataFrame, n: int, pinned: Column) -> DataFrame:
    """The newest n snapshots, and the pinned ones."""
    top = rows.orderBy(F.col("at").desc(), F.col("id").desc()).limit(n)
    return top.unionByName(rows.where(pinned).join(F.broadcast(top.select("id")), "id", "left_anti"))
