"""Registered queries against their oracle SQL on the smallest tables, and properties."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import graph, library, merge, prices
from lectern.plans import adapters, catalog
from lectern.sources import parsers
from lectern.streaming import ticks

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = pytest.importorskip("duckdb").connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(df):
    def plain(v):
        v = v.tolist() if hasattr(v, "tolist") else v
        if v is None or str(v) in ("NaT", "<NA>", "nan"):
            return None
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return None if math.isnan(v) else round(float(v), 5)
        return v if isinstance(v, bool) else str(v).removesuffix(" 00:00:00")

    df = df[sorted(df.columns)]
    return list(df.columns), sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_oracle(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(catalog.ORACLE_SQL[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_merge_is_free_of_order(spark):
    r = random.Random(2)
    versions = [(r.randrange(5), r.randrange(4), r.randrange(3), r.random() < 0.1) for _ in range(60)]
    want = None
    for _ in range(3):
        r.shuffle(versions)
        df = spark.createDataFrame(versions, "k long, at long, v long, gone boolean")
        half = merge.sticky_delete(df.limit(30), ["k"], "at", ["v"])
        got = sorted(map(tuple, merge.sticky_delete(df, ["k"], "at", ["v"]).collect()))
        again = sorted(map(tuple, merge.sticky_delete(half.unionByName(df), ["k"], "at", ["v"]).select("k", "at", "v", "gone").collect()))
        assert got == again and (want is None or got == want)
        want = got


def test_trend_by_loop(spark):
    h = adapters.price_history(spark, SF)
    got = {r.asin: (r.prev, r.low, r.low_at) for r in prices.trend(h).collect()}
    by = {}
    for r in h.where("not ku and price is not null").orderBy("ts", "id").collect():
        by.setdefault(r.asin, []).append(r)
    for asin, rs in by.items():
        prev, low, low_at = None, rs[0].price, None
        for a, b in zip(rs, rs[1:]):
            if a.price != b.price:
                prev = a.price
            if b.price < low:
                low, low_at = b.price, b.ts
        assert got[asin] == (prev, low, low_at)


def test_stream_equals_batch(spark, tmp_path):
    h = adapters.price_history(spark, SF).where("asin < 40").withColumn("ts", F.col("ts").cast("timestamp"))
    parts = h.randomSplit([1.0], seed=1)[0].orderBy("ts", "id").collect()
    folder = tmp_path / "in"
    for i in range(2):
        half = parts[: len(parts) // 2] if i == 0 else parts[len(parts) // 2 :]
        spark.createDataFrame(half, h.schema).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(h.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = ticks.change_events(stream).writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.asin, r.id, r.kind, r.prev, r.price) for r in spark.table("changes").collect()}
    want = {(r.asin, r.id, r.kind, r.prev, r.price) for r in ticks.change_events_batch(h).collect()}
    assert got == want and want


def test_clippings(spark, tmp_path):
    text = (
        "﻿A Book (Part (One)) (Writer, Some)\r\n- Your Highlight on page 12 | location 1,234-56 | Added on Monday\r\n\r\nFirst words\r\n==========\r\n"
        "A Book (Part (One)) (Writer, Some)\r\n- Your Note on location 1298-05\r\n\r\nMy note\r\n==========\r\n"
        "Other\r\n- Your Bookmark on location 5\r\n\r\n\r\n==========\r\n"
    )
    (tmp_path / "c.txt").write_text(text, encoding="utf-8")
    got = parsers.read_clippings(spark, str(tmp_path / "c.txt")).collect()
    assert [(r.title, r.author, r.kind, r.location, r.location_end, r.page, r.text) for r in got] == [
        ("A Book (Part (One))", "Writer, Some", "highlight", 1234, 1256, "12", "First words"),
        ("A Book (Part (One))", "Writer, Some", "note", 1298, 1305, None, "My note"),
    ]


def test_clippings_with_notes(spark):
    entry = lambda kind, place, text: (f"Book (Ann)\n- Your {kind} on {place} | Added on Sunday, January 1, 2023 12:34:56 PM\n\n{text}\n",)
    rows = [entry("Highlight", "location 10-20", "one"), entry("Highlight", "location 30-40", "two"), entry("Note", "location 20", "at end"), entry("Note", "location 33", "inside"), entry("Note", "location 99", "alone")]
    got = parsers.with_notes(parsers.parse_clippings(spark.createDataFrame(rows, "entry string"))).orderBy("location").collect()
    assert [(r.kind, r.text, r.note) for r in got] == [("highlight", "one", "at end"), ("highlight", "two", "inside"), ("note", "alone", "")]
    assert {str(r["at"]) for r in got} == {"2023-01-01 12:34:56"}


def test_notebook(spark, tmp_path):
    (tmp_path / "n.json").write_text('{"books": [{"asin": "A", "title": "T", "highlights": [{"text": "x", "location": "1,020"}, {"note": "only"}]}, {"asin": "B", "highlights": []}]}')
    got = parsers.read_notebook(spark, str(tmp_path / "n.json")).collect()
    assert [(r.asin, r.kind, r.text, r.note, r.location) for r in got] == [("A", "highlight", "x", "", 1020), ("A", "note", "only", "", None)]


def test_pointers_and_guard(spark):
    p = spark.createDataFrame([(1, 2), (2, 3), (3, None), (4, 5)], "id long, next long")
    assert {r.id: r.current for r in graph.current_ids(p).collect()} == {1: 3, 2: 3, 3: 3, 4: 5}
    prices.shrink_guard(5, 9)
    with pytest.raises(ValueError):
        prices.shrink_guard(4, 9)


def test_search_needs_every_word(spark):
    df = spark.createDataFrame([(1, "b", "Red sun", False), (2, "b", "red", False), (3, "sun", "RED", True)], "id long, book string, text string, deleted boolean")
    assert [r.id for r in library.search(df, "red SUN").collect()] == [1]
