"""Catalogues, landed pages, the inbox, followed jobs, releases, ids and salvaged JSON."""

import datetime
import json
import shutil

import pytest
from pyspark.sql import functions as F

from lectern.functions import ids
from lectern.operators import releases
from lectern.sources import catalogues as C
from lectern.streaming import inbox, jobs


def cyrb53(s, seed=0):
    m = 0xFFFFFFFF
    units = [int.from_bytes(s.encode("utf-16-be", "surrogatepass")[i : i + 2], "big") for i in range(0, 2 * len(s.encode("utf-16-be", "surrogatepass")) // 2, 2)]
    a, b = 0xDEADBEEF ^ seed, 0x41C6CE57 ^ seed
    for u in units:
        a, b = (a ^ u) * 2654435761 & m, (b ^ u) * 1597334677 & m
    a = ((a ^ a >> 16) * 2246822507 & m) ^ ((b ^ b >> 13) * 3266489909 & m)
    b = ((b ^ b >> 16) * 2246822507 & m) ^ ((a ^ a >> 13) * 3266489909 & m)
    n, out = (b & 0x1FFFFF) * 2**32 + a, ""
    while n:
        n, d = divmod(n, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
    return out or "0"


def mulberry(seed, n):
    m, out = 0xFFFFFFFF, []
    a = seed & m
    for _ in range(n):
        a = a + 0x6D2B79F5 & m
        t = (a ^ a >> 15) * (a | 1) & m
        t ^= t + ((t ^ t >> 7) * (t | 61) & m) & m
        out.append(((t ^ t >> 14) & m) / 2**32)
    return out


def test_hash_and_generator(spark):
    words = ["", "a", "revenge", "日本語", "emoji \U0001f600!", "x" * 300]
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "s string")
    got = {r.s: (r.h, r.k) for r in df.select("s", ids.short_hash(F.col("s")).alias("h"), ids.short_hash(F.col("s"), 7).alias("k")).collect()}
    assert got == {w: (cyrb53(w), cyrb53(w, 7)) for w in words} | {None: (None, None)}
    for seed in (0, 1, 42, 2**32 - 1):
        rows = spark.range(50).select(ids.seeded(F.lit(seed), F.col("id")).alias("x")).collect()
        assert [r.x for r in rows] == mulberry(seed, 50)


def test_salvaged_json(spark):
    want = {
        '{"a": 1}': '{"a": 1}', "[1, 2]": "[1, 2]", 'sure:\n```json\n{"a": [1]}\n```\nbye': '{"a": [1]}', '<think>{"no": 1}</think> {"yes": "}"}': '{"yes": "}"}', 'lost</think>{"a": 2}': '{"a": 2}',
        'see [note] {"a": "x]\\"}"} end': '{"a": "x]\\"}"}', '{"a": {"b": [1, {"c": 2}]': None, "{name, summary} form: [3]": "[3]", "nothing": None, "": None, None: None, '"text"': '"text"', 'x {"a": 1} {"b": 2}': '{"a": 1}', "12 items": None, "1} x": None, "1] x": None, "1, 2": None, "7": "7",
    }
    df = spark.createDataFrame([(k,) for k in want], "s string").select("s", ids.salvaged_json(F.col("s")).alias("j"))
    assert {r.s: r.j for r in df.collect()} == want
    long = spark.range(1).select(ids.salvaged_json(F.concat(F.repeat(F.lit("["), 50000), F.lit(' {"a": 1}'))).alias("j")).first()
    assert long.j is None


def test_samples(spark, tmp_path):
    item = lambda asin, kind, origin, extra="": f"<meta_data><ASIN>{asin}</ASIN>{extra}<cde_contenttype>{kind}</cde_contenttype><origins><origin><type>Purchase</type></origin><origin><type>{origin}</type></origin></origins></meta_data>"
    body = item("B1", "EBSP", "Sample", "<title> One &amp; two </title>") + item("B2", "EBOK", "Sample") + item("B3", " EBSP ", "Purchase") + item("B4", "EBSP", " Sample ") + "<meta_data><ASIN>B5</ASIN><title>broken</meta_data>"
    (tmp_path / "a.xml").write_text(f"<response><add_update_list>{body}</add_update_list></response>")
    assert sorted(map(tuple, C.samples(spark, str(tmp_path)).collect())) == [("B1", "One & two"), ("B4", "(不明)")]
    assert "B5" in C.broken_items(spark, str(tmp_path)).first().item


def test_catalogues(spark):
    rss = """<rss><channel><title>t</title><item><title>Short</title><link>https://x.jp/1</link><dc:title>Long &amp; title</dc:title><dc:creator>夏目, 漱石, 1867-1916</dc:creator><dc:creator>B</dc:creator>
<category>図書</category><dc:date xsi:type="d">2001</dc:date><dc:identifier xsi:type="dcndl:JPNO">9</dc:identifier><dc:identifier xsi:type="dcndl:ISBN">978-4-00-1</dc:identifier></item>
<item><title>Film</title><category>映像</category></item><item><title>Plain</title><link>http://x.jp/2</link></item><item><title>bad</item></channel></rss>"""
    got = [tuple(r)[2:] for r in C.catalogue_rss(spark.createDataFrame([("a", rss), ("none", "x")], "name string, text string")).orderBy("pos").collect()]
    assert got == [("Long & title", "夏目 漱石, B", "2001", "https://x.jp/1", "9784001"), ("Plain", "", "", "", "")]
    one = {"title": " T ", "@id": "https://c/1", "dc:creator": "山田太郎著 ; 佐藤花子編訳", "dc:date": "1999", "dcterms:hasPart": [{"@id": "urn:isbn:400x"}, {"@id": "urn:isbn:400000000x"}], "cinii:ownerCount": "12"}
    answers = [("a", json.dumps({"@graph": [{"items": [one, {"title": ""}, {"title": "U", "dcterms:hasPart": {"@id": "urn:isbn:9784000000000"}}]}]})), ("b", "{"), ("c", "{}")]
    got = [tuple(r)[2:] for r in C.catalogue_json(spark.createDataFrame(answers, "name string, text string")).orderBy("pos").collect()]
    assert got == [("T", "山田太郎, 佐藤花子", "1999", "https://c/1", "400000000X", 12), ("U", "", "", "", "9784000000000", 0)]


def test_store_search(spark):
    """Paid places around and within cards, cards within cards, other lists, unclosed and stray tags."""
    card = lambda asin, inner="": f'<div data-asin="{asin}"><p>t<span>{inner}</span></div>'
    a = [f"B0{n:08d}" for n in range(12)]
    page = f"""<div class="top">{card(a[0])}</div><div class="x s-main-slot y"></span>
      <div class="AdHolder"><div>{card(a[1])}</div></div>{card(a[2])}{card(a[3], '<b class="sp-sponsored-result">x</b>')}{card(a[4], "スポンサー")}
      <div data-asin="{a[5]}">out<div data-asin="{a[6]}">in</div></div>{card("4000000001")}{card(a[2])}{card("b0abcdefgh")}<noscript>{card(a[7])}</noscript>
      <script>var x = "Sponsored";</script><img data-asin="{a[8]}"><li>open{card(a[9])}</div><div>{card(a[10])}</div>"""
    els = C.elements(spark.createDataFrame([("p", page), ("q", card(a[0])), ("e", None)], "name string, html string"))
    got = [(r.name, r.asin) for r in C.store_search(els).orderBy("name", "pos").collect()]
    assert got == [("p", x) for x in (a[2], a[5], "B0ABCDEFGH", a[8], a[9])]


def test_wish_list_pages(spark):
    page = """<ul><li class="group__book"><img alt="A long title in full"><div class="detail__title"><a href="/books/12">A long ti…</a></div><ul class="detail__authors"><li><a>X</a></li><li><a>Y <b>Z</b></a></li></ul></li>
      <li class="group__book"><img alt="other"><div class="detail__title"><a href="https://evil.example/books/3">B…</a></div></li><li class="group__book"><p>no title</p></li></ul>"""
    got = [tuple(r)[1:] for r in C.wish_list_page(C.elements(spark.createDataFrame([("w", page)], "name string, html string"))).orderBy("pos").collect()]
    assert got == [(1, "A long title in full", "X、Y Z", "12"), (2, "B…", "", "")]


def marks(*items):
    return json.dumps({"format": "marks", "items": [dict(zip(("asin", "tag", "rating"), i)) for i in items]})


def test_inbox(spark, tmp_path, monkeypatch):
    """Name order, quarantine, late files, and a batch that dies half way."""
    box, folder = tmp_path / "in", str(tmp_path / "state")
    box.mkdir()
    (box / "02.json").write_text(marks(("A", "seen", 4), ("B", "want", 5)))
    (box / "01.json").write_text(marks(("A", "want", None), ("C", "seen", 9), ("", "seen", 1)))
    (box / "03.json").write_text("{broken")
    (box / "04.json").write_text('{"format": "other", "items": []}')
    (box / "05.tmp").write_text(marks(("A", "skipped", None)))
    inbox.follow(spark, str(box), folder).awaitTermination()
    now = lambda: {tuple(r) for r in inbox.current(inbox.applied(spark, folder)).collect()}
    assert now() == {("A", "seen", 4), ("B", "want", None), ("C", "seen", None)}
    assert {r.file for r in inbox.quarantined(spark, folder).collect()} == {"03.json", "04.json"}
    (box / "06.json").write_text("﻿" + marks(("B", None, None), ("D", "seen", 2)))
    (box / "00.json").write_text(marks(("A", "skipped", None), ("E", "want", None)))
    whole = inbox.apply_batch

    def dies(files, batch, where):
        whole(files.limit(1), batch, where)
        raise RuntimeError("killed")

    monkeypatch.setattr(inbox, "apply_batch", dies)
    with pytest.raises(Exception, match="killed"):
        inbox.follow(spark, str(box), folder).awaitTermination()
    monkeypatch.setattr(inbox, "apply_batch", whole)
    for _ in range(2):
        inbox.follow(spark, str(box), folder).awaitTermination()
        assert now() == {("A", "seen", 4), ("C", "seen", None), ("D", "seen", 2), ("E", "want", None)}
    assert inbox.applied(spark, folder).count() == 8


def test_jobs_as_stream_and_batch(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [(1, at(k), "running") for k in range(0, 12, 3)] + [(1, at(12), "done"), (1, at(14), "error")] + [(2, at(k), "failed") for k in range(8)] + [(3, at(0), "running"), (3, at(40), "running"), (3, at(41), "stopped")]
    rows += [(4, at(5), "failed"), (4, at(6), "failed"), (4, at(15), "running"), (4, at(16), "running"), (5, at(90), "running")]
    rows = [(j, i, t, s) for i, (j, t, s) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))]
    polls = spark.createDataFrame(rows, "job long, id long, ts timestamp, state string")
    second = lambda t: int((t - at(0)).total_seconds())
    read = lambda df: {(r.job, second(r.began), second(r.ended), r.outcome) for r in df.collect()}
    want = {(1, 0, 12, "done"), (1, 14, 14, "error"), (2, 0, 7, "lost"), (3, 0, 0, "lost"), (3, 40, 41, "interrupted"), (4, 5, 16, "lost")}
    assert read(jobs.outcomes_batch(polls)) == want
    folder = tmp_path / "polls"
    for n, cut in enumerate((0, 6, 13, 30, 80)):  # files in order of time
        part = polls.where(F.col("ts") >= F.lit(at(cut)))
        part = part.where(F.col("ts") < F.lit(at((6, 13, 30, 80, 999)[n])))
        part.coalesce(1).write.parquet(str(tmp_path / "one"), mode="overwrite")
        folder.mkdir(exist_ok=True)
        shutil.copy(next((tmp_path / "one").glob("part-*.parquet")), folder / f"{n}.parquet")
    stream = spark.readStream.schema(polls.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = jobs.outcomes(stream).writeStream.format("memory").queryName("outcomes").outputMode("append").option("checkpointLocation", str(tmp_path / "checkpoint")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert read(spark.table("outcomes")) == want
    assert jobs.outcomes_batch(polls.limit(0)).count() == 0


def test_releases(spark, tmp_path):
    path = str(tmp_path / "site")
    assert releases.published(spark, path) is None
    releases.publish(spark.range(10), path)
    reader = releases.published(spark, path)
    broken = spark.range(10).select(F.raise_error(F.lit("boom")).cast("long").alias("id"))
    for bad in (broken, spark.range(4), spark.range(0)):
        with pytest.raises(Exception, match="boom|refusing"):
            releases.publish(bad, path)
        assert releases.published(spark, path).count() == 10
    releases.publish(spark.range(4), path, allow_shrink=True)
    assert releases.published(spark, path).count() == 4 and reader.count() == 10
    assert len(releases.drop_old(spark, path, keep=1)) == 3 and releases.published(spark, path).count() == 4
