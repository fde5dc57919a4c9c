"""Readers of sample lists (XML), library catalogues (RSS and JSON) and landed pages of stores and
wish lists.

XML and JSON are read by Spark's own readers with a schema and a column for what is broken. Pages
of HTML become rows, one for each element with the interval it spans, and what lies within what
is told by windows in the order of the page.
"""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import is_store_id, nfkc
from lectern.operators.shared import written

# The kind of content and of origin that make an item a sample, and what stands for
# an absent field.
SAMPLE_CONTENT, SAMPLE_ORIGIN, UNKNOWN = "EBSP", "Sample", "(不明)"
ITEM = "ASIN string, title string, cde_contenttype string, origins struct<origin:array<struct<type:string>>>, _broken string"


def samples(spark: SparkSession, path: str) -> DataFrame:
    """(asin, title) of the samples in a store's metadata files. Items that are broken are left
    out (`broken_items`)."""
    rows = _items(spark, path).where("_broken is null")
    text = lambda c: F.coalesce(F.trim(c), F.lit(UNKNOWN))
    sample = (F.trim("cde_contenttype") == SAMPLE_CONTENT) & F.exists("origins.origin", lambda o: F.trim(o["type"]) == SAMPLE_ORIGIN)
    return rows.where(F.coalesce(sample, F.lit(False))).select(text("ASIN").alias("asin"), text("title").alias("title"))


def broken_items(spark: SparkSession, path: str) -> DataFrame:
    """(item, asin): what the files hold between the marks of an item that is no XML, and its number
    if that could be read."""
    return _items(spark, path).where("_broken is not null").select(F.col("_broken").alias("item"), F.col("ASIN").alias("asin"))


def _items(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", "meta_data").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken")
    return reader.schema(ITEM).load(path)


# A catalogue's category of books, and the marks of roles behind names.
BOOKS, ROLES = "図書", "著編訳監修"
RSS = "title string, link string, category array<string>, `dc:title` string, `dc:creator` array<string>, `dc:date` array<string>, `dc:identifier` array<struct<_VALUE:string, `_xsi:type`:string>>, _broken string"
JSON = "`@graph` array<struct<items:array<struct<title:string, `@id`:string, `dc:creator`:string, `dc:date`:string, `dcterms:hasPart`:string, `cinii:ownerCount`:string>>>>"


def https_only(c: Column) -> Column:
    return F.when(F.startswith(c, F.lit("https://")), c).otherwise("")


def catalogue_rss(answers: DataFrame) -> DataFrame:
    """(name, pos, title, authors, published, link, isbn) of the books in catalogue answers (name,
    text). Items of other categories, and items that are no XML, are left out; life years behind
    names go."""
    items = answers.select("name", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?s)<item>.*?</item>"), F.lit(0))).alias("pos", "item"))
    read = items.select("name", "pos", F.from_xml("item", RSS, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("i")).where("i._broken is null")
    kind = F.coalesce(F.size("i.category") <= 0, F.lit(True)) | F.array_contains("i.category", BOOKS)

    def name(c: Column) -> Column:
        parts = F.transform(F.split(c, ","), lambda p: F.trim(p))
        years = F.element_at(parts, -1).rlike("^[0-9]{4}-([0-9]{4})?$") & (F.size(parts) > 1)
        return F.trim(F.array_join(F.when(years, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts), " "))

    isbn = F.get(F.filter("i.`dc:identifier`", lambda x: x["_xsi:type"] == "dcndl:ISBN"), F.lit(0))["_VALUE"]
    blank = lambda c: F.coalesce(c, F.lit(""))
    return read.where(F.coalesce(kind, F.lit(True))).select(
        "name", "pos", blank(F.coalesce(F.nullif(F.trim("i.`dc:title`"), F.lit("")), F.trim("i.title"))).alias("title"),
        blank(F.array_join(F.transform("i.`dc:creator`", name), ", ")).alias("authors"), blank(F.trim(F.get("i.`dc:date`", F.lit(0)))).alias("published"),
        https_only(blank(F.trim("i.link"))).alias("link"), blank(F.replace(isbn, F.lit("-"), F.lit(""))).alias("isbn"),
    )


def catalogue_json(answers: DataFrame) -> DataFrame:
    """(name, pos, title, authors, published, link, isbn, owners) of the books in catalogue answers
    as JSON; items without a title, and answers that are no JSON, are left out."""
    items = answers.select("name", F.from_json("text", JSON).alias("a")).select("name", F.posexplode(F.get("a.`@graph`", F.lit(0))["items"]).alias("pos", "i"))
    people = F.filter(F.transform(F.split(F.coalesce("i.`dc:creator`", F.lit("")), ";"), lambda p: F.trim(F.rtrim(F.trim(p), F.lit(ROLES)))), lambda p: p != "")
    blank = lambda c: F.coalesce(c, F.lit(""))
    rows = items.select(
        "name", "pos", F.trim(blank(F.col("i.title"))).alias("title"), F.array_join(people, ", ").alias("authors"), blank(F.col("i.`dc:date`")).alias("published"), https_only(blank(F.col("i.`@id`"))).alias("link"),
        F.upper(F.regexp_extract(blank(F.col("i.`dcterms:hasPart`")), r'(?i)"urn:isbn:([0-9x]{10,13})"', 1)).alias("isbn"), F.coalesce(F.col("i.`cinii:ownerCount`").try_cast("int"), F.lit(0)).alias("owners"),
    )
    return rows.where("title <> ''")


VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset(("script", "style", "noscript", "template", "textarea"))
ELEMENTS = "name string, start int, end int, tag string, classes array<string>, attrs map<string,string>, said string"


class _Spans(HTMLParser):
    """Elements with the interval of events that they span, and the texts between them. An end
    tag closes what was left open within its element; one without an element is nothing. `done`
    holds those whose end is known."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.done: list[tuple] = []
        self.open: list[list] = []
        self.count: dict[str, int] = {}
        self.n = 0

    def add(self, tag, attrs, said=None, stays=False):
        self.n += 1
        known = {k: v or "" for k, v in attrs}
        row = [self.n, self.n, tag, known.get("class", "").split(), list(known.items()), said]
        (self.open if stays else self.done).append(row)

    def handle_starttag(self, tag, attrs):
        stays = tag not in VOID
        self.add(tag, attrs, stays=stays)
        if tag in HIDDEN:
            self.set_cdata_mode(tag)
        if stays:
            self.count[tag] = self.count.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.add(tag, attrs)

    def handle_endtag(self, tag):
        if self.count.get(tag):
            self.n += 1
            self.shut(self.n, tag)

    def shut(self, end, tag=None):
        """Ends what is open, up to the last element of the tag."""
        while self.open:
            row = self.open.pop()
            row[1] = end
            self.count[row[2]] -= 1
            self.done.append(row)
            if row[2] == tag:
                break

    def handle_data(self, data):
        if not (self.open and self.open[-1][2] in HIDDEN):
            self.add("#text", [], data)


def _spans(html: str, most: int = 4096, piece: int = 1 << 16):
    """The rows of a page, at most about so many at a time; pieces are cut before a tag, where no
    text is cut."""
    spans, at = _Spans(), 0
    while at < len(html):
        to = html.find("<", at + piece)
        to = len(html) if to < 0 else to
        spans.feed(html[at:to])
        at = to
        if len(spans.done) >= most:
            yield spans.done
            spans.done = []
    spans.close()
    spans.shut(spans.n + 1)
    yield spans.done


def elements(pages: DataFrame) -> DataFrame:
    """(name, start, end, tag, classes, attrs, said): a row for each element of pages (name, html),
    and one, tagged #text, for each text that is shown. One lies within another of its page if
    its interval does; two intervals of a page never cross."""

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.map_(pa.string(), pa.string()), pa.string()]
        names = ["name", "start", "end", "tag", "classes", "attrs", "said"]
        for batch in batches:
            for i in range(len(batch)):
                name = batch.column("name")[i].as_py()
                for rows in _spans(batch.column("html")[i].as_py() or ""):
                    columns = zip(*rows) if rows else [()] * len(kinds)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], names=names)

    return pages.select("name", "html").mapInArrow(run, ELEMENTS)


def _upto(last: int = 0):
    """The elements of a page that begin no later than a row does (last -1: earlier)."""
    return Window.partitionBy("name").orderBy("start").rangeBetween(Window.unboundedPreceding, last)


def _behind():
    return Window.partitionBy("name").orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, 0)


def _inside(kind: Column) -> Column:
    """Whether a row lies within an element of the kind: the one that reaches farthest, of those
    that began, reaches its end. (Intervals never cross.)"""
    return F.coalesce(F.max(F.when(kind, F.col("end"))).over(_upto()) >= F.col("end"), F.lit(False))


def _around(rows: DataFrame, outer: Column, inner: Column) -> DataFrame:
    """The rows `inner`, once for each of the rows `outer` around them, that one's start as `around`.

    Outer elements of one depth (as many others are open) lie side by side. So an inner row asks at
    each depth that is open there for the last one begun, and no pair is made that does not hold.
    """
    begin = F.struct(F.col("start").alias("at"), F.lit(0).alias("k"), F.lit(1).alias("step"))
    met = F.struct(F.col("start").alias("at"), F.lit(1).alias("k"), F.lit(0).alias("step"))
    end = F.struct(F.col("end").alias("at"), F.lit(2).alias("k"), F.lit(-1).alias("step"))
    none = F.array().cast("array<struct<at:int,k:int,step:int>>")
    events = F.concat(F.when(outer, F.array(begin, end)).otherwise(none), F.when(inner, F.array(met)).otherwise(none))
    walk = Window.partitionBy("name").orderBy("e.at", "e.k").rowsBetween(Window.unboundedPreceding, 0)
    deep = rows.withColumn("e", F.explode(events)).withColumn("depth", F.sum("e.step").over(walk)).where("e.k < 2 and depth > 0")
    levels = F.when(F.col("e.k") == 0, F.array(F.col("depth"))).otherwise(F.sequence(F.lit(1).cast("long"), F.col("depth")))
    side = Window.partitionBy("name", "level").orderBy("e.at", "e.k").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("e.k") == 0, F.col("start")), ignorenulls=True).over(side)
    return deep.withColumn("level", F.explode(levels)).withColumn("around", last).where("e.k = 1").drop("e", "depth", "level")


# The class of the list of results, classes of paid places and what is written on them.
RESULTS, PAID_CLASSES, PAID_TEXTS = "s-main-slot", ("AdHolder", "sp-sponsored-result"), ("スポンサー", "Sponsored")


def store_search(els: DataFrame) -> DataFrame:
    """(name, asin, pos) of the electronic books that store pages found, in order: outermost
    elements with a product number within the list of results. A card is paid for, and left out, if
    a paid place lies around it or within it or its text says so. Pages without a list give none."""
    asin = F.upper(F.trim(F.element_at("attrs", "data-asin")))
    texts = F.coalesce((F.col("tag") == "#text") & F.greatest(*[F.contains("said", F.lit(t)) for t in PAID_TEXTS]), F.lit(False))
    paid = F.arrays_overlap("classes", F.array(*[F.lit(c) for c in PAID_CLASSES])) | texts
    rows = els.select("name", "start", "end", F.array_contains("classes", RESULTS).alias("list"), F.when(asin != "", asin).alias("asin"), paid.alias("paid"))
    rows = rows.where("list or asin is not null or paid").withColumn("marked", F.col("asin").isNotNull() & _inside(F.col("list")))
    outermost = F.col("marked") & F.coalesce(F.max(F.when(F.col("marked"), F.col("end"))).over(_upto(-1)) < F.col("start"), F.lit(True))
    began = F.coalesce(F.max(F.when(F.col("paid"), F.col("end"))).over(_upto()) >= F.col("start"), F.lit(False))
    begins = F.coalesce(F.min(F.when(F.col("paid"), F.col("start"))).over(_behind()) <= F.col("end"), F.lit(False))
    cards = rows.withColumn("card", outermost).withColumn("sold", began).withColumn("sold", F.col("sold") | begins)
    free = cards.where(F.col("card") & ~F.col("sold") & is_store_id(F.col("asin")))
    once = free.groupBy("name", "asin").agg(F.min("start").alias("start"))
    return once.select("name", "asin", F.row_number().over(Window.partitionBy("name").orderBy("start")).alias("pos"))


# Classes of a wish list's cards and of what they hold, and the mark of a cut title.
CARD, TITLE, AUTHORS, CUT = "group__book", "detail__title", "detail__authors", "…"


def wish_list_page(els: DataFrame) -> DataFrame:
    """(name, pos, title, author, book) of the cards of wish-list pages: the title's link (in full
    from the cover's text where it is cut), the authors' links and the book's number, empty where
    the link is of another form. Cards without a title are left out."""
    tag, held = F.col("tag"), lambda c: F.array_contains("classes", c)
    marks = {"card": (tag == "li") & held(CARD), "heads": held(TITLE), "people": held(AUTHORS), "link": tag == "a", "text": tag == "#text", "image": tag == "img"}
    rows = els.select("name", "start", "end", *(c.alias(n) for n, c in marks.items()), F.element_at("attrs", "href").alias("href"), F.trim(F.element_at("attrs", "alt")).alias("alt"), "said")
    rows = written(rows.where(" or ".join(marks)), "elements")  # pages are read once
    links = rows.where("link or heads or people").withColumns({"heads": _inside(F.col("heads")), "people": _inside(F.col("people"))}).where("link and (heads or people)")
    shown = _around(rows.where("link or text"), F.col("link"), F.col("text")).groupBy("name", F.col("around").alias("start"))
    shown = shown.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "said"))), lambda t: t["said"]), "").alias("said"))
    links = links.drop("said").join(shown, ["name", "start"], "left").withColumn("said", F.trim(F.coalesce("said", F.lit(""))))
    cards = rows.where("card").withColumns({"link": F.lit(False), "image": F.lit(False), "heads": F.lit(False), "people": F.lit(False)})
    own = _around(cards.unionByName(links.withColumn("card", F.lit(False)).select(cards.columns)), F.col("card"), F.col("link")).withColumnRenamed("around", "start5")
    title = own.where("heads").groupBy("name", "start5").agg(F.min_by(F.struct("said", "href"), "start").alias("t"))
    names = own.where("people").groupBy("name", "start5").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "said"))), lambda t: t["said"]), "、").alias("author"))
    covers = _around(rows.where("card or image"), F.col("card"), F.col("image")).groupBy("name", F.col("around").alias("start5")).agg(F.min_by("alt", "start").alias("alt"))
    rows = title.join(names, ["name", "start5"], "left").join(covers, ["name", "start5"], "left")
    said = F.col("t.said")
    head = F.substring(said, F.lit(1), F.length(said) - len(CUT))
    longer = F.endswith(said, F.lit(CUT)) & F.startswith("alt", head) & (F.length("alt") > F.length(head))
    path = F.regexp_replace(F.coalesce(F.trim("t.href"), F.lit("")), "^https://bookmeter[.]com/", "/")
    book = F.when(F.startswith(path, F.lit("/books/")), F.substring(path, 8, 100))
    return rows.select(
        "name", F.row_number().over(Window.partitionBy("name").orderBy("start5")).alias("pos"),
        F.when(longer, F.col("alt")).otherwise(said).alias("title"), F.coalesce("author", F.lit("")).alias("author"), F.when(book.rlike("^[0-9]{1,12}$"), book).otherwise("").alias("book"),
    )
