"""What is written out: feed entries, Markdown of books and outlines, mark exports, price texts;
and small states that screens and reports ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.dates import atom_time
from lectern.functions.text import escape_markdown


def xml(c: Column) -> Column:
    """Text with the marks of XML replaced."""
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def atom_entries(events: DataFrame) -> DataFrame:
    """(asin, kind, entry): events (asin, at, kind, title) as entries of a feed."""
    at = atom_time(F.date_format("at", "yyyy-MM-dd HH:mm:ss"))
    entry = F.concat(F.lit("<entry><id>tag:"), xml(F.col("asin").cast("string")), F.lit(":"), F.col("kind"), F.lit("</id><title>"), xml(F.col("title")), F.lit("</title><updated>"), at, F.lit("</updated></entry>"))
    return events.select("asin", "kind", entry.alias("entry"))


#: Links of books, the number of entries, and the name space of feeds.
BOOK_URL, NEWEST, ATOM = "https://www.amazon.co.jp/dp/", 50, "http://www.w3.org/2005/Atom"


def atom_feed(events: DataFrame, site: str, name: str, title: str, author: str, otherwise: Column | None = None, most: int = NEWEST) -> DataFrame:
    """One row (feed): the newest `most` events (id, asin, at, title) as a feed, newest first; equal
    data give equal text. Without events it is dated by `otherwise`. Only these few meet in a list."""
    site = site if site.endswith("/") else site + "/"
    time = lambda c: atom_time(F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    link = F.when(F.col("asin").cast("string").rlike("^[A-Z0-9]{10}$"), F.concat(F.lit(BOOK_URL), F.col("asin").cast("string"))).otherwise(site)
    entry = F.concat(
        F.lit(f" <entry>\n  <id>{site}{name}#"), xml(F.col("id").cast("string")), F.lit("</id>\n  <title>"), xml(F.col("title")), F.lit("</title>\n  <updated>"), time("at"),
        F.lit('</updated>\n  <link rel="alternate" href="'), link, F.lit('" />\n </entry>\n'),
    )
    top = events.orderBy(F.desc("at"), F.desc("id")).limit(most).select(F.struct("at", "id", entry.alias("entry")).alias("e"))
    rows = F.reverse(F.array_sort(F.collect_list("e")))
    head = f'<?xml version="1.0" encoding="utf-8"?>\n<feed xmlns="{ATOM}">\n <id>{site}{name}</id>\n <title>{title}</title>\n <link rel="self" href="{site}{name}" />\n <link rel="alternate" href="{site}" />\n <updated>'
    newest = F.coalesce(F.get("rows", F.lit(0))["at"], otherwise if otherwise is not None else F.lit(None).cast("timestamp"))
    body = F.concat(F.lit(head), time(newest), F.lit(f"</updated>\n <author>\n  <name>{author}</name>\n </author>\n"), F.array_join(F.transform("rows", lambda e: e["entry"]), ""), F.lit("</feed>\n"))
    return top.agg(rows.alias("rows")).select(body.alias("feed"))


def wishlist_items(books: DataFrame) -> DataFrame:
    """(asin, item): each book of the published list as JSON with its 23 fields. Unlimited books
    and those not fetched have no price; what moves with a price (its trend, the price before
    points, points and campaign) is only there with one, the reason only without."""
    unlimited = F.coalesce("is_unlimited", F.lit(False))
    price = F.when(~unlimited, F.col("actual_price"))
    priced = price.isNotNull()
    said = lambda c, other: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(other))
    flags = F.filter(F.array(F.when(F.col("from_store"), "kindle"), F.when(F.col("from_reader"), "bookmeter")), lambda x: x.isNotNull())
    fields = {
        "asin": said("asin", ""), "title": said("title", "(unknown)"), "price": price, "ku": unlimited, "wanted": F.coalesce("wanted", F.lit(False)), "purchased": F.coalesce("purchased", F.lit(False)),
        "sources": flags, "kind": F.col("kind"), "tag": F.col("tag"), "rating": F.col("rating"), "scraped_at": F.col("scraped_at"),
        "price_prev": F.when(priced, F.col("trend.prev")), "price_changed_at": F.when(priced, F.col("trend.changed_at")), "price_low": F.when(priced, F.col("trend.low")), "price_low_at": F.when(priced, F.col("trend.low_at")),
        "target_price": F.col("target_price"), "price_history": F.coalesce("history", F.array().cast(books.schema["history"].dataType)), "price_reason": F.when(~priced, F.col("reason")),
        "bookmeter_id": F.when(F.col("reader_id").rlike("^[0-9]{1,12}$"), F.col("reader_id")), "publisher": F.nullif(F.trim("publisher"), F.lit("")),
        "sell_price": F.when(priced, F.col("sell_price")), "points": F.when(priced, F.coalesce("points", F.lit(0))).otherwise(0), "campaign": F.when(priced, F.coalesce("campaign", F.lit(""))).otherwise(""),
    }
    return books.select(F.col("asin"), F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"}).alias("item"))


def wishlist_header(books: DataFrame, name: str = "wishlist", version: int = 1) -> DataFrame:
    """One row: the form, its version and when any book was last fetched."""
    return books.agg(F.lit(name).alias("format"), F.lit(version).alias("version"), F.max("scraped_at").alias("last_scraped"))


def book_markdown(points: DataFrame) -> DataFrame:
    """(book, text): a book's points under its chapters, chapters by their first place."""
    chapter = points.groupBy("book", "chapter").agg(F.min("location").alias("first"), F.array_sort(F.collect_list(F.struct("location", "id", F.concat(F.lit("- "), "text").alias("t")))).alias("l"))
    part = F.concat(F.lit("## "), "chapter", F.lit("\n"), F.array_join(F.transform("l", lambda x: x["t"]), "\n"))
    return chapter.groupBy("book").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "chapter", part.alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))


def outline_markdown(parts: DataFrame) -> DataFrame:
    """(outline, text): headings and their points in order, marks of Markdown escaped."""
    line = F.concat(F.when(F.col("heading"), "## ").otherwise("- "), escape_markdown(F.col("text")))
    return parts.groupBy("outline").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("t")))), lambda x: x["t"]), "\n").alias("text"))


def marks_export(marks: DataFrame, fields: list[str]) -> DataFrame:
    """(asin, item): only the fields that were touched, as JSON; rows without any are left out."""
    item = F.to_json(F.struct(*[F.when(F.array_contains("touched", f), F.col(f)).alias(f) for f in fields]))
    return marks.where(F.size(F.array_intersect("touched", F.array(*[F.lit(f) for f in fields]))) > 0).select("asin", item.alias("item"))


def inbox_marks(marks: DataFrame, most: int = 2000, title_chars: int = 200) -> DataFrame:
    """(asin, title, tag, rating) for the inbox: at most so many by position, short titles, stars
    only of read books."""
    top = marks.orderBy("pos").limit(most)
    return top.select("asin", F.substring("title", 1, title_chars).alias("title"), "tag", F.when((F.col("tag") == "seen") & F.col("rating").between(1, 5), F.col("rating")).alias("rating"))


def price_text(price: Column, ku: Column, reason: Column) -> Column:
    """What is shown for a price."""
    return F.when(ku, "Kindle Unlimited").when(price.isNull(), F.concat(F.lit("no price"), F.coalesce(F.concat(F.lit(" ("), reason, F.lit(")")), F.lit("")))).otherwise(F.concat(F.lit("¥"), F.format_number(price.cast("long"), 0)))


def result_kind(price: Column, ku: Column, error: Column) -> Column:
    """What came of looking a price up."""
    return F.when(error, "error").when(ku, "unlimited").when(price.isNotNull(), "priced").otherwise("unpriced")


def price_ticks(scrapes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(history rows, reasons): effective prices of scrapes, and why there is none."""
    price = F.when(~F.col("ku"), F.col("sell") - F.coalesce("points", F.lit(0)))
    rows = scrapes.withColumn("price", price)
    return rows.select("asin", "ts", "price", "ku"), rows.where("price is null and not ku").select("asin", "ts", "reason")


def freshness(snapshots: DataFrame) -> DataFrame:
    """(name, fresh): the later of when a snapshot was made and when it recommended."""
    return snapshots.select("name", F.greatest("created", "recommended").alias("fresh"))


def assignments(rows: DataFrame) -> DataFrame:
    """(id, line): the newest assignment of a thought; a null line means that it has none."""
    return rows.groupBy("id").agg(F.max_by("line", F.struct("at", F.col("line").isNotNull(), "line")).alias("line")).where("line is not null")


def dismissed_sets(sets: DataFrame, current: DataFrame) -> DataFrame:
    """(set, ids): the points of dismissed sets by what they are now."""
    now = current.select(F.col("id").alias("member"), "current")
    rows = sets.select("set", F.explode("ids").alias("member")).join(now, "member", "left")
    return rows.groupBy("set").agg(F.array_sort(F.collect_set(F.coalesce("current", "member"))).alias("ids"))


def flags_from_origin(books: DataFrame) -> DataFrame:
    """(asin, kindle, bookmeter): source flags of old rows, from what they hold; set ones stay."""
    return books.select("asin", F.coalesce("kindle", F.col("sample").isNotNull()).alias("kindle"), F.coalesce("bookmeter", F.col("reader_id").isNotNull()).alias("bookmeter"))


def recommendation_note(picks: DataFrame) -> DataFrame:
    """(run, note): empty, unverified if no pick was found to exist, else nothing."""
    n = picks.groupBy("run").agg(F.count("asin").alias("n"), F.count_if(F.col("state") == "verified").alias("sure"))
    return n.select("run", F.when(F.col("n") == 0, "empty").when(F.col("sure") == 0, "unverified").alias("note"))
