"""Operators without an oracle, and those whose plans are cut into ranges or blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import analysis, graph, order, points, reports, vectors


def test_positions_and_running_totals(spark):
    """Many ranges, ties, nulls last both ways, against a sort in memory."""
    r = random.Random(1)
    rows = [(i, r.choice([None, 1.5, 2.5, 3.0]), r.choice(["a", "b", None]), r.randint(0, 5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, x double, s string, v int")
    for down in (False, True):
        got = {x.id: (x.pos, x.total) for x in order.running_total(order.numbered(df, [(F.col("x"), down), (F.col("s"), not down), (F.col("id"), down)]), [(F.col("x"), down), (F.col("s"), not down), (F.col("id"), down)], F.col("v"), "total").collect()}
        key = lambda v, d: (v is None, 0 if v is None else (-v if d else v) if not isinstance(v, str) else (-ord(v) if d else ord(v)))
        total = 0
        for n, x in enumerate(sorted(rows, key=lambda x: (key(x[1], down), key(x[2], not down), -x[0] if down else x[0])), 1):
            total += x[3]
            assert got[x[0]] == (n, total)
    assert order.numbered(df.limit(0), [(F.col("id"), False)]).count() == 0


@pytest.fixture()
def cloud(spark, monkeypatch):
    """Vectors in several blocks of centroids, queries and members."""
    monkeypatch.setattr(vectors, "FEW", 7)
    monkeypatch.setattr(vectors, "BLOCK", 9)
    r = np.random.default_rng(5)
    v = r.normal(size=(120, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, None if i % 10 == 9 else i % 11, i % 4, v[i].tolist()) for i in range(120)]
    return v, spark.createDataFrame(rows, "id long, line long, source long, v array<double>")


def test_search_in_blocks(spark, cloud):
    v, df = cloud
    sims = np.round(v @ v.T, 6)
    skip = [(q, q + 1) for q in range(0, 100, 5)]
    for pairs in ([], skip):
        got = {}
        found = vectors.search(df.where("id % 5 = 0"), df, 6, spark.createDataFrame(pairs, "query long, id long") if pairs else None)
        for x in found.orderBy("query", "rank").collect():
            got.setdefault(x.query, []).append(x.id)
        for q in range(0, 120, 5):
            others = sorted((i for i in range(120) if i != q and (q, i) not in pairs), key=lambda i: (-sims[q, i], i))
            assert got[q] == others[:6]


def test_neighbours_in_blocks(cloud):
    v, df = cloud
    centre = {x.line: np.array(x.c) for x in vectors.centroids(df.where("line is not null")).collect()}
    got = {}
    for x in vectors.neighbours(df, vectors.centroids(df.where("line is not null")), 4, 3).orderBy("id", "rank").collect():
        got.setdefault(x.id, []).append(x.other)
    line = [None if i % 10 == 9 else i % 11 for i in range(120)]
    for i in range(120):
        near = sorted(centre, key=lambda c: (-round(float(v[i] @ centre[c]), 9), c))[:3]
        cand = [j for j in range(120) if (line[j] is None or line[j] in near) and j % 4 != i % 4]
        assert got[i] == sorted(cand, key=lambda j: (-round(float(v[i] @ v[j]), 6), j))[:4]


def test_required_kinds(spark):
    rows = [(i, k, i) for i, k in enumerate("aaabac")]
    df = spark.createDataFrame(rows, "id long, kind string, pos long")
    got = lambda *kinds: [(x.id, x.kind) for x in analysis.with_required(df, kinds, 3).orderBy("pos").collect()]
    assert got("b", "c") == [(0, "a"), (5, "c"), (3, "b")]
    assert got("z") == [(0, "a"), (1, "a"), (2, "a")]


def test_pointers_stop_after_ten_hops(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(15)] + [(15, None)], "id long, next long")
    assert {r.id: r.current for r in graph.current_ids(chain).collect()} == {i: min(i + 10, 15) for i in range(16)}


def test_round_robin(spark):
    lists = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "x"), (2, 1, "y"), (2, 2, "z")], "lst int, k int, item string")
    assert [r.item for r in graph.interleave(lists).orderBy("pos").collect()] == list("axbyz")


def test_rebuild_rule():
    assert analysis.rebuild(10, None, True, 3) and analysis.rebuild(150, 100, True, 3) and not analysis.rebuild(139, 100, True, 3)
    assert not analysis.rebuild(70, 40, True, 1) and analysis.rebuild(80, 40, True, 1) and analysis.rebuild(5, 5, False, 1) and analysis.rebuild(5, 5, True, 0)


def test_search_folds_widths(spark):
    rows = spark.createDataFrame([(1, "Ｐｙｔｈｏｎ　入門", ["仕事"]), (2, "other", None)], "id long, text string, tags array<string>")
    assert [r.id for r in points.matching(rows, "python #仕事", F.col("text"), points.tagged(F.col("tags"))).collect()] == [1]


def test_names_never_repeat(spark):
    """Repeats take the free numbers; names that look made stay, whatever their number."""
    r = random.Random(11)
    names = [r.choice(["a", "a", "a", "b", "a (2)", "a (3)", "a (5)", "b (2)", "a (3) (2)", "a (02)", "a (1)", "c\nd", ""]) for _ in range(120)] + ["a", "a", "a", "a (3)"]
    rows = list(enumerate(names))
    r.shuffle(rows)
    got = {x.id: x.name for x in reports.distinct_names(spark.createDataFrame(rows, "id long, name string")).collect()}
    given, seen, want = set(names), set(), {}
    for i, name in enumerate(names):
        n, made = 1, name
        if name in seen:
            while made in given or made in want.values():
                n += 1
                made = f"{name} ({n})"
        seen.add(name)
        want[i] = made
    assert got == want and len(set(got.values())) == len(names)
    few = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "a (3)")], "id long, name string")
    assert [x.name for x in reports.distinct_names(few).orderBy("id").collect()] == ["a", "a (2)", "a (4)", "a (3)"]
