"""Readers of export files on small fixtures."""

import datetime
import io
import zipfile

from pyspark.sql import functions as F

from lectern.functions import dates, text
from lectern.sources import exports as E

DAY = datetime.date


def files(spark, *rows):
    return spark.createDataFrame([(n, t) for n, t in rows], "name string, text string")


def test_encodings_and_formats(spark):
    raw = [("a.txt", "日本".encode("utf-16")), ("b.txt", b"\xfe\xff" + "日本".encode("utf-16-be")), ("c.txt", b"\xef\xbb\xbf" + "日本".encode()), ("d.txt", "日本".encode("shift_jis")), ("e.txt", b"\xff\xfa\x80\xff")]
    got = {r.name: r.t for r in spark.createDataFrame(raw, "name string, content binary").select("name", E.decode_text("content").alias("t")).collect()}
    assert [got[n] for n in ("a.txt", "b.txt", "c.txt", "d.txt")] == ["日本"] * 4 and got["e.txt"]
    kinds = files(spark, ("x.TXT", "Book\n- Your Highlight on page 1\n==========\n"), ("x.html", '<div class="noteHeading">x</div><div class="noteText">y</div>'), ("y.html", "<table></table>"), ("n.json", '{"format": "my/kindle-notebook"}'), ("l.json", '{"highlights": {}}'), ("b.json", "[{}]"), ("m.md", "| ![Cover Image](x) | *T* |"), ("q.md", "# mine"), ("z.docx", "PK"))
    got = {r.name: r.f for r in kinds.select("name", E.format_of(F.col("name"), F.col("text")).alias("f")).collect()}
    assert got == {"x.TXT": "clippings", "x.html": "export-html", "y.html": "annotation-html", "n.json": "notebook", "l.json": "backup", "b.json": "books", "m.md": "annotation-markdown", "q.md": "unknown", "z.docx": "annotation-docx"}


def packed(**entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries.items():
            z.writestr(name.replace("__", "/"), data)
    return out.getvalue()


def test_archives(spark):
    inner = packed(**{"deep.txt": b"3"})
    outer = packed(**{"a.txt": b"1", "d__b.txt": b"2", ".hidden": b"x", "in.zip": inner})
    rows = [("o.zip", outer), ("plain.txt", b"0"), ("bad.zip", b"PK\x03\x04 nothing"), ("w.docx", packed(x=b"y"))]
    got = {r.name: (bytes(r.content) if r.content is not None else None, r.error) for r in E.unpacked(spark.createDataFrame(rows, "name string, content binary")).collect()}
    assert {n: c for n, (c, e) in got.items() if e is None and n != "w.docx"} == {"o.zip/a.txt": b"1", "o.zip/d/b.txt": b"2", "o.zip/in.zip/deep.txt": b"3", "plain.txt": b"0"}
    assert got["bad.zip"][0] is None and "BadZipFile" in got["bad.zip"][1] and got["w.docx"][1] is None


def test_export_html(spark):
    head = lambda t, c="": f'<div class="noteHeading"><span class="highlight_{c}">{c}</span>{t}</div>'
    body = lambda t: f'<div class="noteText">{t}</div>'
    html = "".join(['<div class="bookTitle">The &amp; Book</div><div class="authors">Ann</div><div class="sectionHeading">One</div>', head("Highlight - Page 3 · Location 1,200", "blue"), body("First words , here"), head("Note - Location 1,201"), body("my note"), head("Note - Location 1,202"), body("more"), head("Note - Location 1,300"), body("far"), head("Note - Location 1,200"), body("after far"), head("Bookmark - Location 5"), body("gone"), '<div class="sectionHeading">Two</div>', head("Highlight - Location 9"), body(""), head("Highlight - Location 10", "pink"), body("( Last")])
    got = E.export_html(files(spark, ("e.html", html), ("none.html", "<p>x</p>"))).orderBy("pos").collect()
    assert [(r.kind, r.text, r.note, r.color, r.location, r.page, r.chapter) for r in got] == [
        ("highlight", "First words, here", "my note\nmore", "blue", 1200, "3", "One"),
        ("note", "far", "", "", 1300, "", "One"),
        ("note", "after far", "", "", 1200, "", "One"),
        ("highlight", "(Last", "", "pink", 10, "", "Two"),
    ]
    assert {(r.title, r.author) for r in got} == {("The & Book", "Ann")}


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(rows, heading="Chapter 1"):
    p = lambda t, fill="", style="": f'<w:p><w:pPr>{f"<w:pStyle w:val={chr(34)}{style}{chr(34)}/>" if style else ""}</w:pPr><w:r><w:rPr>{f"<w:shd w:fill={chr(34)}{fill}{chr(34)}/>" if fill else ""}</w:rPr><w:t>{t}</w:t></w:r></w:p>'
    table = "".join("<w:tr>" + "".join(f"<w:tc>{''.join(p(*x) for x in cell)}</w:tc>" for cell in row) + "</w:tr>" for row in rows)
    return packed(**{"word__document.xml": f"<w:document {W}><w:body>{p('Book', '', 'Heading1')}{p(heading, '', 'Heading2')}<w:tbl>{table}</w:tbl></w:body></w:document>"})


def test_annotation_documents(spark):
    rows = [[[("icon",)], [("Shaded words", "FFE082"), ("a note",), ("January 5, 2023",)], [("12",)]], [[("icon",)], [("Plain words",), ("second",), ("2023年2月3日",)], [("iv",)]], [[("icon",)], [("no date here",)], [("3",)]]]
    html = "<style>.c1{background-color:#ffe082}</style><h2>Yellow</h2><table><tr><td>i</td><td><p><span class='c1'>Twice</span></p><p>March 4, 2024</p></td><td>7</td></tr></table><h2>Chapter 9</h2><table><tr><td>i</td><td><p><span class='c1'>Twice</span></p><p>March 4, 2024</p></td><td>7</td></tr></table>"
    parts = E.blocks(spark.createDataFrame([("a.docx", docx(rows)), ("b.html", html.encode()), ("c.docx", b"broken")], "name string, content binary"))
    assert [r.error for r in parts.where("name = 'c.docx'").collect()] == ["BadZipFile"]
    got = {(r.name, r.text): (r.note, r.on, r.page, r.color, r.chapter) for r in E.annotations(parts).collect()}
    assert got == {
        ("a.docx", "Shaded words"): ("a note", DAY(2023, 1, 5), "12", "yellow", "Chapter 1"),
        ("a.docx", "Plain words"): ("second", DAY(2023, 2, 3), "iv", "", "Chapter 1"),
        ("b.html", "Twice"): ("", DAY(2024, 3, 4), "7", "yellow", "Chapter 9"),
    }


def test_markdown_annotations(spark):
    md = "| ![Cover Image](c.png) | *My \\*Book\\** |\n# 3 notes\n## Blue\n| ![x][i1] *Some \\[text\\]* my note January 5, 2023 [12](https://play.google.com/books/reader?id=a) |\n| --- |\n## Chapter 2\n| *Some \\[text\\]* my note January 5, 2023 [12](https://x/y) |\n| plain 2023/2/30 [4](https://x/y) |\n| no date [5](https://x/y) |"
    got = {r.text: (r.note, r.on, r.page, r.color, r.chapter) for r in E.markdown_annotations(files(spark, ("m.md", md))).collect()}
    assert got == {"Some [text]": ("my note", DAY(2023, 1, 5), "12", "blue", "Chapter 2"), "plain": ("", None, "4", "", "Chapter 2")}


def test_json_files(spark):
    new = '{"format": "b", "library": {"books": {"b1": {"title": "T"}}, "highlights": {"h1": {"text": "x"}, "h2": null, "__proto__": {}}}}'
    old = '{"books": {"b2": {"title": "U"}}, "highlights": {}, "analysis": {}}'
    got = {(r.name, r.kind, r.id) for r in E.backup(files(spark, ("new", new), ("old", old), ("bad", "{"))).collect()}
    assert got == {("new", "books", "b1"), ("new", "highlights", "h1"), ("old", "books", "b2")}
    assert [(r.title, r.text) for r in E.book_list(files(spark, ("l", '[{"title": "T", "highlights": [{"text": "a"}, {"text": ""}]}]'))).collect()] == [("T", "a")]
    wishes = '{"version": 1, "books": [{"asin": "A", "title": "T", "price": 5}, {"asin": "B", "title": "U", "price": -1, "ku": true}, {"title": ""}]}'
    assert [(r["index"], r.asin, r.price, r.ku) for r in E.wish_list(files(spark, ("w", wishes), ("v2", wishes.replace("1,", "2,", 1)))).orderBy("index").collect()] == [(0, "A", 5.0, False), (1, "B", None, True)]
    marks = '{"items": [{"asin": "A", "tag": "seen", "rating": 4}, {"asin": "B", "tag": "want", "rating": 4}, {"asin": "", "tag": "seen"}, {"asin": "C", "tag": "seen", "rating": 9}]}'
    assert [(r.asin, r.rating) for r in E.marks_file(files(spark, ("m", marks))).orderBy("asin").collect()] == [("A", 4), ("B", None), ("C", None)]
    records = '{"records": [{"title": "T", "readOn": "2024-02-29", "pages": 10}, {"title": "U", "readOn": "2023-02-29"}, {"title": "V"}]}'
    assert [(r.title, r.read_on, r.pages) for r in E.records_file(files(spark, ("r", records))).collect()] == [("T", DAY(2024, 2, 29), 10)]
    note = "# Book\n- First point ^p1\n  - Note: mine\n  - Tags: #a, b #a\n  - ★\n- no id\n  - Note: new\n- Second ^p-2\n"
    got = E.note_file(files(spark, ("n", note))).orderBy("pos")
    assert [(r.id, r.text, r.note, r.tags, r.star, r.chapter, r.book) for r in got.collect()] == [("p1", "First point", "mine", ["a", "b"], True, "Book", ""), (None, "no id", "new", [], False, "Book", ""), ("p-2", "Second", None, [], False, "Book", "")]
    front = "\ufeff---\r\nbookId: b1\r\ntitle: A: title\r\nauthor:\r\n---\r\n- before ^h0\r\n## One\r\n- two\r\n    lines ^h1\r\n  - メモ: 自分\r\n  - メモ: later\r\n  - タグ: #x #y\r\n\r\nloose text\r\n### Two\r\n  - メモ: of nothing\r\n- ^h9\r\n-  \r\n- last ^H ^h2 \r\n"
    got = E.note_file(files(spark, ("f", front), ("open", "---\nbookId: b2\n- x"))).orderBy("name", "pos").collect()
    assert [(r.book, r.title, r.author, r.id, r.text, r.note, r.tags, r.chapter) for r in got] == [
        ("b1", "A: title", "", "h0", "before", None, [], ""), ("b1", "A: title", "", "h1", "two\nlines", "later", ["x", "y"], "One"), ("b1", "A: title", "", None, "^h9", None, [], "Two"), ("b1", "A: title", "", "h2", "last ^H", None, [], "Two"), ("", "", "", None, "x", None, [], ""),
    ]


def test_loose_dates(spark):
    at = datetime.datetime
    want = {
        "2023年1月2日 月曜日 午後3:04:05": at(2023, 1, 2, 15, 4, 5), "2023年1月2日 午前12:10": at(2023, 1, 2, 0, 10), "２０２３年１月２日": at(2023, 1, 2), "2023-02-30": None, "2023/2/3 4:05": at(2023, 2, 3, 4, 5),
        "Sunday, January 1, 2023 12:34:56 PM": at(2023, 1, 1, 12, 34, 56), "1 January 2023 12:34:56": at(2023, 1, 1, 12, 34, 56), "Monday, 3 Mar 2024 1:02:03 am": at(2024, 3, 3, 1, 2, 3), "": None, "never": None,
    }
    df = spark.createDataFrame([(k,) for k in want], "s string").select("s", dates.loose_date(F.col("s")).cast("timestamp_ntz").alias("at"))
    assert {r.s: r.at for r in df.collect()} == want


def test_unicode_text(spark):
    row = spark.range(1).select(text.title_key(F.lit("ファスト＆スロー（上） 【合本版】 Vol.1")).alias("key"), text.decode_entities(F.lit("&lt;&#x41;&#66; &eacute;&nbsp;&bogus; &#99999999;")).alias("ent"), text.mask_credentials(F.lit("see //me:pw@host and https://tok@x.example/a@b")).alias("mask"), text.label(F.lit("夜と霧 (みすず文庫 し 4-1)【上】")).alias("label"), text.normalize_text(F.lit(None).cast("string")).alias("none")).first()
    assert (row.key, row.ent, row.mask, row.label, row.none) == ("ファストスローvol1", "<AB é &bogus; &#99999999;", "see //***@host and https://***@x.example/a@b", "みすず文庫", "")


def test_series_and_publishers(spark):
    """Catalogue numbers, branches and what is no series; names of publishers."""
    series = {
        "本 (岩波文庫 赤435-5)": "岩波文庫", "本 (文春文庫 し 4-1)": "文春文庫", "本 (日経文庫 E 52)": "日経文庫", "本 (平凡社新書0911)": "平凡社新書", "本 (中公文庫ま-1-1)": "中公文庫",
        "本 (岩波新書 新赤版 1234)": "岩波新書", "本 (文庫) [Kindle版]": "文庫", "本 (文庫)【電子書籍限定特典付き】": "文庫", "本 (日本経済新聞出版)": "日本経済新聞出版", "本 (上)": "", "本 (第2巻)": "", "本 (Vol.)": "", "本": "", "本 (a(b))": "", None: "",
    }
    df = spark.createDataFrame([(k,) for k in series], "s string")
    assert {r.s: r.v for r in df.select("s", text.label(F.col("s")).alias("v")).collect()} == series
    names = {"出版社 \u200f : \u200e 光文社; 第2版 (2020/10/14)": "光文社", "Publisher: A & B (May 1, 2020)": "A & B", "光文社 (東京)": "光文社 (東京)", "PUBLISHER:X": "X", "a:b": "a:b", "": "", None: "", "y" * 130: "y" * 100}
    df = spark.createDataFrame([(k,) for k in names], "s string")
    assert {r.s: r.v for r in df.select("s", text.publisher_of(F.col("s")).alias("v")).collect()} == names


def test_headings_and_days(spark):
    heads = {
        "ハイライト(黄色) - 第1章 始まり > 位置 1,234": ("highlight", 1234, "", "第1章 始まり"), "メモ - 位置No. 12": ("note", 12, "", ""), "Note - Page xii · Location 30": ("note", 30, "xii", ""),
        "Highlight(yellow) - Part A - B > Page 7": ("highlight", None, "7", "Part A - B"), "Bookmark - Page 9": ("bookmark", None, "9", ""), "ブックマーク - 位置3": ("bookmark", 3, "", ""), "": ("highlight", None, "", ""), "Notation - x > y > Seite 4": ("highlight", None, "4", "x > y"),
    }
    df = spark.createDataFrame([(k,) for k in heads], "s string").select("s", E.read_heading(F.col("s")).alias("h"))
    assert {r.s: tuple(r.h) for r in df.collect()} == heads
    days = {"2023年1月2日": True, "2023年 1月 2日": True, "January 1, 2023": True, "Mar. 1, 2023": True, "3 mars 2024": True, "2024/1/2": True, "2024-01-02": True, "on 2024-01-02": False, "2024": False, "": False, None: False}
    df = spark.createDataFrame([(k,) for k in days], "s string").select("s", dates.is_day(F.col("s")).alias("d"))
    assert {r.s: r.d for r in df.collect()} == days
    on = {"2023年3月4日": datetime.date(2023, 3, 4), "Sunday March 5, 2023": datetime.date(2023, 3, 5), "2023年2月30日": None, "2023-03-04": None, "": None}
    df = spark.createDataFrame([(k,) for k in on], "s string").select("s", dates.annotated_on(F.col("s")).alias("d"))
    assert {r.s: r.d for r in df.collect()} == on
