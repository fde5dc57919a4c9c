"""Large groups, long pages and crowded places: what is met stays in proportion to the rows."""

import math
import random

from pyspark.sql import functions as F

from lectern.sources import catalogues as C


def test_pages_come_in_pieces():
    """A long page is never held as one list, and pieces change nothing."""
    rng = random.Random(5)
    page = "".join(rng.choice(("<div class='a'>", "</div>", "<p>", "text &amp; more", "<br>", "<a href=x>", "</a>", "<script>if (a < b) x</script>", "</li>")) for _ in range(30000))
    pieces = list(C._spans(page, 100, 50))
    assert max(map(len, pieces)) < 10000 and len(pieces) > 50
    (whole,) = C._spans(page, 1 << 30, 1 << 30)
    assert sorted(map(str, (r for p in pieces for r in p))) == sorted(map(str, whole))


def test_elements_around(spark):
    """Nested and void elements against all pairs of intervals."""
    rng = random.Random(2)
    pages = [(str(n), "".join(rng.choice(("<li class='x'>", "<a>", "</a>", "</li>", "t", "<img>", "<b>", "</b>")) for _ in range(60))) for n in range(6)]
    rows = C.elements(spark.createDataFrame(pages, "name string, html string")).select("name", "start", "end", "tag").persist()
    got = C._around(rows, F.col("tag").isin("li", "img"), F.col("tag").isin("#text", "li", "img")).select("name", "start", "around").collect()
    inside = {(r.name, r.start) for r in rows.withColumn("in", C._inside(F.col("tag") == "a")).where("in").collect()}
    all_ = rows.collect()
    held = lambda a, b: a.name == b.name and b.start <= a.start <= b.end and a.end <= b.end
    want = [(a.name, a.start, b.start) for a in all_ for b in all_ if a.tag in ("#text", "li", "img") and b.tag in ("li", "img") and held(a, b)]
    assert sorted(map(tuple, got)) == sorted(want) and want
    assert inside == {(a.name, a.start) for a in all_ if any(b.tag == "a" and held(a, b) for b in all_)}
    rows.unpersist()


def test_grams_are_counted_in_their_row(spark):
    """Repeated ids, null and short texts; no task holds a table of grams to count them."""
    from collections import Counter

    from lectern.operators import vectors as V

    rows = [(1, "abab"), (1, "ab c"), (2, None), (3, "x"), (4, "aaaa"), (5, "")]
    got = V.grams(spark.createDataFrame(rows, "id long, text string"))
    want = Counter((i, t.replace(" ", "")[k : k + n]) for i, t in rows if t for n in (2, 3) for k in range(len(t.replace(" ", "")) - n + 1))
    assert {(r.id, r.gram): r.tf for r in got.collect()} == dict(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "gram" not in plan[plan.index("Aggregate") :].split("\n")[0]


def broadcasts(rows):
    """Joins of a plan that send a whole side through the driver."""
    return rows._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_weights_send_no_grams_to_the_driver(spark, tmp_path):
    """A file far under the broadcast threshold, whose grams are far over it."""
    from lectern.operators import vectors as V

    n = 2000
    path = str(tmp_path / "titles")
    spark.range(n).selectExpr("id", "repeat(concat('blue ring ', id % 50), 20) as text").write.parquet(path)
    rows = spark.read.parquet(path)
    w = V.tfidf(V.grams(rows), n)
    assert not broadcasts(w)
    got = {r.gram: (r.n, r.w) for r in w.where("id % 50 < 2").groupBy("gram").agg(F.count("*").alias("n"), F.round(F.max("w"), 9).alias("w")).collect()}
    at = lambda tf, df: round((1 + math.log(tf)) * (math.log((n + 1) / (df + 1)) + 1), 9)
    assert got["bl"] == (80, at(20, n)) and got["g0"] == (40, at(20, n // 50)) and got["1b"] == (40, at(19, n // 10))


def test_same_titles_meet_once(spark):
    """Copies of a title: counts without pairs, and the first copies among the closest."""
    from lectern.operators import analysis as N
    from lectern.operators import vectors as V

    n = 20000  # 400 million pairs
    rows = spark.range(n).selectExpr("id", "element_at(array('blue ring', 'blue bolt', 'hot bolt'), cast(id % 3 as int) + 1) as title", "'B' as author")
    left = rows.withColumn("title", F.substring_index("title", " ", 1))
    got = {r.l % 3: r.n for r in N.title_match_counts(left, rows).collect()}
    size = [len(range(k, n, 3)) for k in range(3)]
    assert got == {0: size[0] + size[1], 1: size[0] + size[1]}
    w = V.tfidf(V.grams(rows, text_col="title"), n)
    top = N.closest_titles(w.where("id % 100 = 0"), w, 4).collect()
    assert len(top) == 4 * n // 100 and all(r.sim == 1.0 and r.id % 3 == r.profile % 3 and r.id < 12 for r in top)


def test_titles_meet_in_blocks(spark, monkeypatch, tmp_path):
    """Blocks and slices of any size against all pairs: copies, ties, grams of one side only; nothing
    is broadcast, however small the file."""
    import pyarrow as pa
    import pyarrow.compute as pc

    from lectern.operators import analysis as N
    from lectern.operators import vectors as V

    rng = random.Random(8)
    known = [{rng.choice("abcdefghij"): float(rng.randint(1, 3)) for _ in range(rng.randint(1, 5))} for _ in range(60)]
    titles = {i: rng.choice(known) for i in range(-40, 160)}
    profile = {i: {**rng.choice(known), **({"q": 2.0} if i % 3 == 0 else {})} for i in range(30)} | {30: {"z": 1.0}}
    size = lambda t: math.sqrt(sum(w * w for w in t.values()))
    sim = lambda a, b: round(sum(a[g] * b[g] for g in a if g in b) / size(a) / size(b), 6)
    want = {(p, t, s) for p, a in profile.items() for s, t in sorted((-sim(a, b), t) for t, b in titles.items() if a.keys() & b.keys())[:7]}
    for name, rows in (("p", profile), ("t", titles)):
        spark.createDataFrame([(i, g, w) for i, t in rows.items() for g, w in t.items()], "id long, gram string, w double").write.parquet(str(tmp_path / name))
    read = [spark.read.parquet(str(tmp_path / name)) for name in "pt"]
    assert not broadcasts(N.closest_titles(*read, 7))
    for sizes in ((20, 30), (40, 1 << 18), (1 << 20, 1 << 18)):
        monkeypatch.setattr(N, "PROFILE_GRAMS", sizes[0])
        monkeypatch.setattr(N, "TITLE_GRAMS", sizes[1])
        got = N.closest_titles(*read, 7).collect()
        assert {(r.profile, r.id, -r.sim) for r in got} == want and len(got) == len(want) and 30 not in {r.profile for r in got}
    rows = [(asks, i, g, w / size(t)) for asks, side in ((True, profile), (False, titles)) for i, t in side.items() for g, w in t.items()]
    block = pa.table(dict(zip(("asks", "key", "gram", "x"), map(list, zip(*rows)))))
    for cells in (1, 300, 1 << 22):
        monkeypatch.setattr(V, "CELLS", cells)
        got = N._titles_of_block(7)(block).to_pylist()
        assert {(r["p"], r["t"], -r["sim"]) for r in got} == want and len(got) == len(want)
    for side in (block["asks"], pc.invert(block["asks"])):
        assert N._titles_of_block(7)(block.filter(side)).num_rows == 0


def test_search_holds_the_best_only(spark, monkeypatch):
    """Slices of any size give what all similarities together give, ties and bad numbers too."""
    import numpy as np

    from lectern.operators import vectors as V

    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (120, 3)).astype(float)
    v[7] = np.nan
    rows = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in enumerate(v)], "id long, v array<double>").repartition(3)
    got = []
    for cells in (1, 50, 1 << 22):
        monkeypatch.setattr(V, "CELLS", cells)
        got.append(sorted(map(tuple, V.search(rows.where("id % 40 = 0"), rows, 6).collect())))
    sims = v[::40] @ v.T
    want = [(40 * q, i, s, r + 1) for q, row in enumerate(sims) for r, (s, i) in enumerate(sorted((-s, i) for i, s in enumerate(row) if i != 40 * q and s == s)[:6])]
    assert got[0] == got[1] == got[2] == sorted((q, i, -s, r) for q, i, s, r in want)
    peak = []
    real = np.partition
    monkeypatch.setattr(np, "partition", lambda a, *k, **o: peak.append(a.size) or real(a, *k, **o))
    monkeypatch.setattr(V, "CELLS", 1000)
    for own in V._slices(5000, 40):
        V._best(np.zeros((40, own.stop - own.start)), np.arange(own.stop - own.start), 3, 6)
    assert max(peak) <= 1000


def test_contained_by_marks(spark):
    """Copies, short texts, parts of long ones and common lines against all pairs."""
    from lectern.operators import library as L

    rng = random.Random(4)
    line = "A line that stands in very many of the texts of this book, word for word, and is no part of its own."
    long_ = ["".join(rng.choice("abcdé ") for _ in range(400)) + line for _ in range(6)]
    texts = long_ + [t[a : a + n] for t in long_ for a, n in ((0, 30), (50, 90), (100, 200), (300, 201), (10, 70))] + [line, "", "x"]
    rows = [(i, rng.choice("pq"), rng.randrange(8), rng.choice(texts), rng.random() < 0.1) for i in range(400)] + [(900, "p", None, line, False), (901, "p", 1, None, False)]
    for gap in (0, 3):
        got = L.contained(spark.createDataFrame(rows, "id long, book string, location long, text string, deleted boolean"), gap).collect()
        live = [r for r in rows if not r[4] and r[2] is not None and r[3] is not None]
        want = {}
        for a in live:
            fits = [(-len(b[3]), b[0]) for b in live if a[1] == b[1] and abs(a[2] - b[2]) <= gap and a[3] in b[3] and (len(b[3]) > len(a[3]) or (len(b[3]) == len(a[3]) and b[0] < a[0]))]
            if fits:
                want[a[0]] = min(fits)[1]
        assert {r.id: r.keeper for r in got} == want and len(got) == len(want)


def test_crowded_page_of_notes(spark):
    """20,000 notes on a page with as many highlights, 400 million pairs."""
    from lectern.operators import library as L

    n = 20000
    h = spark.range(n).selectExpr("id", "'b' as book", "id % 10 * 3 as start", "id % 10 * 3 + 1 as end", "0 as page")
    notes = spark.range(n).selectExpr("id", "'b' as book", "id % 40 as at", "0 as page")
    got = L.attach_notes(notes, h).groupBy(F.col("note") % 40, "highlight", "level").count().collect()
    want = {k: (k // 3, int(k % 3 == 0)) if k % 3 < 2 and k < 30 else (0, 2) for k in range(40)}
    assert {r[0]: (r.highlight, r.level) for r in got} == want and len(got) == 40


def test_former_ids_meet_no_other(spark):
    """Ids on both sides of 100,000."""
    from lectern.plans import cluster_queries as Q

    ids = [*range(120), *range(99900, 100200)]
    p = spark.createDataFrame([(i, i % 10, i % 7, [1.0]) for i in ids], "id long, line long, source long, v array<double>")
    after, before, _, former = Q.snapshots(p)
    assert not {r.former for r in former.collect()} & set(ids)
    got = {(r.point, r.state) for r in Q.G.connected(*Q.moved(p)).collect()}
    assert got == {(i, "extended" if i % 27 == 0 and i % 10 != 5 else "connected") for i in ids if i % 10 != 4 and (i % 10 == 5 or i % 9 == 0)}


def test_blocked_pages_have_a_reason(spark):
    from lectern.functions.text import status_reason

    rows = spark.createDataFrame([(200, True), (404, True), (None, True), (503, False), (404, False), (None, None)], "c int, b boolean")
    assert [r[0] for r in rows.select(status_reason(F.col("c"), F.col("b"))).collect()] == ["blocked"] * 3 + ["page_error", "not_found", "no_price"]


def test_discoveries_meet_in_blocks(spark, monkeypatch):
    """Blocks of any size find the same, null vectors stand last."""
    from lectern.operators import analysis as N

    rng = random.Random(6)
    rows = [(1, i, i, rng.randrange(3), None if i % 11 == 0 else [float(rng.randrange(-2, 3)) for _ in range(2)]) for i in range(90)]
    after = spark.createDataFrame(rows, "line long, id long, place long, source long, v array<double>")
    before, lone = after.where("id % 3 > 0").select("line", "id"), after.where("id % 6 = 0").select("id")
    former = spark.createDataFrame([], "id long, former long")
    want = set()
    for _, i, place, source, v in rows:
        if i % 3 == 0:
            fits = [(s == source, float("inf") if v is None or w is None else -sum(x * y for x, y in zip(v, w)), j) for _, j, _, s, w in rows if j != i and (i % 6 == 0 or s != source)]
            want.add((frozenset((i, min(fits)[2]))))
    for size in (7, 1000):
        monkeypatch.setattr(N, "BLOCK", size)
        got = N.discoveries(after, before, lone, former, 1000).collect()
        assert {frozenset((r.a, r.b)) for r in got} == want and len(got) == len(want)


def test_label_computes_each_step_once(spark):
    from lectern.functions.text import label

    rows = spark.range(1).select(F.concat(F.lit("a (S 文庫 12)【上】"), F.col("id").cast("string"), F.lit(" (T 版)")).alias("t")).select(label(F.col("t")).alias("v"))
    assert rows._jdf.queryExecution().analyzed().toString().count("translate(") == 2
