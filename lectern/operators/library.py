"""Highlights of a library: live rows, order within a book, search, counts, joins by place."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import normalize_text, search_words

from .shared import written

# Words and phrases of technical books' titles, publishers named like one of
# them, marks that end a sentence, and characters a place of a book holds.
TECH_WORDS = "sql mysql postgresql php python javascript typescript java ruby rails golang rust c++ c# html css linux unix git github docker kubernetes aws azure gcp tcp/ip http api react vue laravel devops"
TECH_PHRASES = "データベース db設計 プログラミング プログラマ ソフトウェア フロントエンド バックエンド インフラ ネットワーク入門 オブジェクト指向 アルゴリズム データ構造 機械学習 深層学習 ディープラーニング コマンドライン シェルスクリプト itエンジニア 要件定義 システム設計 システム開発 aiのしくみ web技術 webを支える コンピュータ 情報処理 テスト駆動 リファクタリング"
TECH_PUBLISHERS = "新書 文庫 研究所 ビジネス新書 文芸文庫 エディターズ"
ENDS = "。．.！!？?」』）)]］}｝】》〉〕\"”'’…‥"
CHARS_PER_PLACE = 30


def _any(words: str) -> str:
    return "|".join(re.escape(w) for w in words.split())


def live(highlights: DataFrame) -> DataFrame:
    return highlights.where(~F.coalesce("deleted", F.lit(False)))


def technical(title: Column, override: Column | None = None) -> Column:
    """An explicit mark wins over the guess by the title's words and phrases; words stand
    between characters that are no letters."""
    t = F.regexp_replace(normalize_text(title), f"php(?:{_any(TECH_PUBLISHERS)})", "")
    guess = t.rlike(f"(?:^|[^a-z])(?:{_any(TECH_WORDS)})(?![a-z])|{_any(TECH_PHRASES)}")
    return guess if override is None else F.coalesce(override, guess)


def points(highlights: DataFrame, is_technical: Column) -> DataFrame:
    """Live highlights of books that are not technical."""
    return live(highlights).where(~is_technical)


def search(highlights: DataFrame, query: str, fields: tuple[str, ...] = ("text", "book")) -> DataFrame:
    """Rows that hold every word of the query somewhere in their fields, newest first."""
    hay = normalize_text(F.concat_ws("\n", *fields))
    out = live(highlights)
    for word in search_words(query):
        out = out.where(F.contains(hay, F.lit(word)))
    return out.orderBy(F.col("id").desc())


def in_book(order: str = "location") -> list[Column]:
    return [F.col(order).asc_nulls_last(), F.col("id").asc()]


def neighbours(highlights: DataFrame) -> DataFrame:
    """(id, prev_id, next_id) in book order."""
    w = Window.partitionBy("book").orderBy(*in_book())
    return live(highlights).select("id", "book", F.lag("id").over(w).alias("prev_id"), F.lead("id").over(w).alias("next_id"))


def join_candidates(highlights: DataFrame, gap: int = 1) -> DataFrame:
    """(id, next_id): points that stop in mid-sentence right before the next one."""
    w = Window.partitionBy("book").orderBy(*in_book())
    rows = live(highlights).select("id", "book", "chapter", "location", "text", F.lead("id").over(w).alias("next_id"), F.lead("chapter").over(w).alias("next_chapter"), F.lead("location").over(w).alias("next_location"))
    open_end = ~F.substring(F.regexp_replace("text", r"\s+$", ""), -1, 1).isin(*ENDS)
    near = (F.col("chapter") == F.col("next_chapter")) & (F.col("next_location") <= F.col("location") + gap)
    return rows.where(F.col("next_id").isNotNull() & open_end & near).select("id", "book", "next_id")


def book_counts(highlights: DataFrame) -> DataFrame:
    return live(highlights).groupBy("book").agg(F.count("*").alias("n"), F.max("id").alias("last_id"))


def stats(highlights: DataFrame, is_technical: Column) -> DataFrame:
    is_live = ~F.col("deleted")
    return highlights.agg(F.count_if(is_live).alias("live"), F.count_if("deleted").alias("deleted"), F.count_if(is_live & F.col("favorite")).alias("favorites"), F.count_if(is_live & is_technical).alias("technical"), F.countDistinct(F.when(is_live, F.col("book"))).alias("books"))


def daily_picks(rows: DataFrame, day: str, n: int = 5, seen: DataFrame | None = None) -> DataFrame:
    """n points by the hash of day and id; points seen lately come last."""
    late = F.lit(0)
    if seen is not None:
        rows = rows.join(seen.select("id", F.lit(1).alias("late")).distinct(), "id", "left")
        late = F.coalesce("late", F.lit(0))
    return rows.orderBy(late, F.md5(F.concat(F.lit(day), F.col("id").cast("string"))), "id").limit(n)


def trash(highlights: DataFrame) -> DataFrame:
    """(book, n_deleted, n_live) of books with deleted points."""
    return highlights.groupBy("book").agg(F.count_if("deleted").alias("n_deleted"), F.count_if(~F.col("deleted")).alias("n_live")).where("n_deleted > 0")


# Marks of a text: the least hash of each run of RUN grams of GRAM bytes. A part of that length or
# more has marks, and its container has all of them.
GRAM, RUN = 8, 64


def _marks(text: str):
    import numpy as np

    data = np.frombuffer(text.encode(), np.uint8)
    if len(data) < GRAM + RUN - 1:
        return np.zeros(0, np.int64)
    least = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, GRAM)).view(np.uint64).ravel()
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0x9E3779B97F4A7C15)):
        least = (least ^ (least >> np.uint64(shift))) * np.uint64(factor)
    step = 1
    while step < RUN:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    return np.unique(least).view(np.int64)


def _marked(texts: DataFrame) -> DataFrame:
    """(key, mark) of texts (key, text): a row for each mark."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keys, texts = batch.column("key").to_pylist(), batch.column("text").to_pylist()
            for i in range(0, len(keys), 256):
                marks = [_marks(t) for t in texts[i : i + 256]]
                own = [k for k, m in zip(keys[i : i + 256], marks) for _ in range(len(m))]
                yield pa.RecordBatch.from_arrays([pa.array(own, batch.schema.field("key").type), pa.array(np.concatenate(marks))], names=["key", "mark"])

    return texts.select("key", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"key {texts.schema['key'].dataType.simpleString()}, mark long")


def contained(highlights: DataFrame, gap: int = 1) -> DataFrame:
    """(id, keeper): points whose text lies in a longer one at the same place of the book. The
    longest container (then the smallest id) keeps the note; of equal texts the smallest id.

    Equal texts of a place count once. A text meets those that hold its rarest mark; one too short
    for marks meets what stands near it, in bins of gap + 1 places. Texts come to these pairs only.
    """
    rows = live(highlights).where(F.col("location").isNotNull() & F.col("book").isNotNull() & F.col("text").isNotNull())
    rows = rows.select("id", "book", "location", F.length("text").alias("n"), F.sha2("text", 256).alias("d"), "text")
    place = ["book", "location", "n", "d"]
    once = written(rows.groupBy(*place).agg(F.min_by("text", "id").alias("text"), F.min("id").alias("key"), (F.octet_length(F.first("text")) < GRAM + RUN - 1).alias("short")), "places")
    slim = once.select("key", "book", "location", "n", "d", "short", F.floor(F.col("location") / (gap + 1)).alias("bin"))
    at = lambda t, n, *more: t.select(*[F.col(c).alias(c + n) for c in ("key", "location", "n", *more)], "book")
    near = F.abs(F.col("location") - F.col("location2")) <= gap
    longer = F.col("n2") > F.col("n")

    marks = written(_marked(once.where("not short")).join(slim.select("key", "book", "location", "n"), "key"), "marks")
    seen = marks.groupBy("book", "mark").agg(F.count("*").alias("seen"))
    rarest = marks.select("key", "book", "mark").join(seen, ["book", "mark"]).groupBy("key").agg(F.min(F.struct("seen", "mark"))["mark"].alias("mark"))
    asked = rarest.join(slim.select("key", "book", "location", "n"), "key")
    by_mark = asked.join(at(marks, "2", "mark").withColumnRenamed("mark2", "mark"), ["book", "mark"]).where(near & longer).select("key", "key2", "n2")
    bins = F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1))
    around = slim.withColumn("bin", bins)
    by_place = slim.where("short").join(at(around, "2", "bin").withColumnRenamed("bin2", "bin"), ["book", "bin"]).where(near & longer).select("key", "key2", "n2")
    inner, outer = once.select("key", F.col("text").alias("inner")), once.select(F.col("key").alias("key2"), F.col("text").alias("outer"))
    met = by_mark.unionByName(by_place).join(inner, "key").join(outer, "key2").where(F.contains("outer", "inner"))
    best = met.groupBy("key").agg(F.min(F.struct((-F.col("n2")).alias("n"), F.col("key2").alias("id")))["id"].alias("longer"))

    same = slim.join(at(around, "2", "d", "bin").withColumnsRenamed({"d2": "d", "bin2": "bin"}), ["book", "d", "bin"]).where(near & (F.col("n2") == F.col("n")))
    own = same.groupBy("key").agg(F.min("key2").alias("first")).join(best, "key", "left").join(slim.select("key", "book", "location", "n", "d"), "key")
    keeper = F.coalesce("longer", F.when(F.col("first") < F.col("id"), F.col("first")))
    return rows.select("id", *place).join(own, place).select("id", keeper.alias("keeper")).where("keeper is not null")


def without_contained(highlights: DataFrame, gap: int = 1) -> DataFrame:
    """The live points that lie in no longer one of their place, with their notes; a point without
    a note takes that of the longest one it holds (then of the lowest id) that has any."""
    pairs = contained(highlights, gap)
    rows = live(highlights)
    notes = rows.where(F.col("note") != "").select("id", "note", F.length("text").alias("n"))
    moved = pairs.join(notes, "id").groupBy("keeper").agg(F.min_by("note", F.struct((-F.col("n")).alias("n"), "id")).alias("moved")).withColumnRenamed("keeper", "id")
    kept = rows.join(pairs.select("id"), "id", "left_anti").join(moved, "id", "left")
    return kept.withColumn("note", F.coalesce(F.nullif("note", F.lit("")), "moved", F.lit(""))).drop("moved")


def import_changes(existing: DataFrame, incoming: DataFrame, width: int = 64) -> DataFrame:
    """(id, change, former): what an import does with each of its points (id, book, start, end,
    text), given those there are (with deleted): `known` and `gone` ones stay as they are; one that
    lies in a longer point of the same spot is `contained`; one that holds a shorter live point of
    the same spot, the one with the lowest id, `extends` it (former); the others are `added`.

    Spots overlap, and are dealt to bins of `width` places; without places two points never share
    one. Texts are compared as `normalize_text` leaves them."""
    here = existing.select("id", F.col("deleted").alias("there"))
    known = incoming.join(here, "id").select("id", F.when(F.col("there"), "gone").otherwise("known").alias("change"), F.lit(None).cast(incoming.schema["id"].dataType).alias("former"))
    new = incoming.join(here, "id", "left_anti")

    def dealt(rows: DataFrame, n: str) -> DataFrame:
        last = F.coalesce("end", "start")
        bins = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(last / width)))
        return rows.where("start is not null").select(F.col("id").alias("id" + n), "book", F.col("start").alias("s" + n), last.alias("e" + n), normalize_text(F.col("text")).alias("t" + n), F.length("text").alias("n" + n), *(["deleted"] if n == "2" else []), bins.alias("bin"))

    a, b = dealt(new, "1"), dealt(existing, "2")
    met = a.join(b, ["book", "bin"]).where((F.col("s1") <= F.col("e2")) & (F.col("s2") <= F.col("e1")))
    longer = (F.col("n2") > F.col("n1")) & F.contains("t2", "t1")
    shorter = ~F.col("deleted") & (F.col("n2") < F.col("n1")) & F.contains("t1", "t2")
    found = met.groupBy(F.col("id1").alias("id")).agg(F.max(longer).alias("inside"), F.min(F.when(shorter, F.col("id2"))).alias("former"))
    change = F.when(F.col("inside"), "contained").when(F.col("former").isNotNull(), "extends").otherwise("added")
    rest = new.select("id").join(found, "id", "left").select("id", change.alias("change"), F.when(change == "extends", F.col("former")).alias("former"))
    return known.unionByName(rest)


def status_counts(rows: DataFrame, statuses: list[str]) -> DataFrame:
    """Per group the number of rows with each status, zeros included."""
    return rows.groupBy("group").pivot("status", statuses).count().na.fill(0)


def health(reports: DataFrame, now: Column, interval: str) -> DataFrame:
    """(source, status): none without any report, stale after three intervals, else what the last
    report says."""
    last = reports.groupBy("source").agg(F.max_by("state", F.struct("at", "id")).alias("state"), F.max("at").alias("at"))
    stale = F.col("at") < now - F.expr(f"INTERVAL {interval}") * 3
    return last.select("source", F.when(F.col("at").isNull(), "none").when(stale, "stale").when(F.col("state").isin("login", "error"), F.col("state")).otherwise("ok").alias("status"))


def carried(reports: DataFrame, good: Column) -> DataFrame:
    """(id, last_ok): when a source was last well, as of each report."""
    w = Window.partitionBy("source").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    return reports.select("id", F.last(F.when(good, F.col("at")), ignorenulls=True).over(w).alias("last_ok"))


def attach_notes(notes: DataFrame, highlights: DataFrame) -> DataFrame:
    """(note, highlight, level) by exact end (0), containing range (1), same page (2); of a level
    the lowest highlight.

    Ranges and places that are the same meet once, in bins of `WIDTH` places; a page is known by
    its lowest highlight.
    """
    h = highlights.select(F.col("id").alias("highlight"), F.col("book").alias("hb"), "start", "end", F.col("page").alias("hp"))
    spans = h.groupBy("hb", "start", "end").agg(F.min("highlight").alias("highlight"))
    binned = spans.where("start <= end").withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / WIDTH), F.floor(F.col("end") / WIDTH))))
    n = notes.select(F.col("id").alias("note"), "book", "at", "page")
    places = n.select("book", "at").distinct().withColumn("nbin", F.floor(F.col("at") / WIDTH))
    met = places.join(binned, (F.col("book") == F.col("hb")) & (F.col("nbin") == F.col("bin")) & F.col("at").between(F.col("start"), F.col("end")))
    inside = met.groupBy("book", "at").agg(F.min(F.when(F.col("at") == F.col("end"), F.col("highlight"))).alias("ends"), F.min("highlight").alias("holds"))
    paged = h.groupBy(F.col("hb").alias("book"), F.col("hp").alias("page")).agg(F.min("highlight").alias("first"))
    all_ = n.join(inside, ["book", "at"], "left").join(paged, ["book", "page"], "left")
    best = F.coalesce(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(k).alias("level"), F.col(c).alias("highlight"))) for k, c in enumerate(("ends", "holds", "first"))])
    return all_.groupBy("note").agg(F.min(best).alias("b")).select("note", F.col("b.highlight").alias("highlight"), F.col("b.level").alias("level"))


WIDTH = 64
