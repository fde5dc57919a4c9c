"""Clusters of limited size: points to lines, lines to planes, and what a new analysis takes over
from the one before.

Assignment under a limit is deferred acceptance, stated by cutoffs: every point goes to the best
cluster whose cutoff it passes; a cluster chosen by more points than it has room for raises its
cutoff to the last it can keep; repeat until no cutoff moves. As points and clusters rank pairs
by one order (or clusters by arrival), the outcome is that of placing pairs one by one from the
best down, and no state but one cutoff a cluster goes from round to round. Centres, cutoffs and
sums are one row a cluster; points never leave the executors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import numbered
from .shared import written
from .vectors import _slices, dot, nearest_centroid, normalised

OVERSAMPLED = 2
PASSES = 5


def _matrix(centres: DataFrame) -> tuple[list, np.ndarray]:
    """Keys and vectors of the centres (line, c), in the order of their keys."""
    rows = centres.select("line", "c").orderBy("line").collect()
    return [r[0] for r in rows], np.array([r[1] for r in rows], float)


def similarities(points: DataFrame, matrix: np.ndarray) -> DataFrame:
    """(id, sims): each point's similarity to the rows of a matrix, rounded to nine places."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for own in _slices(len(pdf), 8 * len(matrix)):
                part = pdf.iloc[own]
                yield pd.DataFrame({"id": part["id"], "sims": list(np.round(np.stack(part["v"]) @ matrix.T, 9))})

    return points.select("id", "v").mapInPandas(run, "id long, sims array<double>")


def matched(sims: DataFrame, room: list[int], least: float | None = None, by_arrival: bool = False) -> DataFrame:
    """(id, c, sim): points of (id, sims) in clusters with so much room each, c their place in
    `sims`. Clusters prefer the most similar, the lowest id among equals, or by arrival the lowest
    id. Pairs below `least`, or without any similarity then, are no pairs; points that find no
    room are left out."""
    size = len(room)
    cuts: list[tuple[float, int] | None] = [None if n > 0 else (np.inf, 0) for n in room]
    keys = [(F.col("c"), False), (F.col("id"), False)] if by_arrival else [(F.col("c"), False), (F.col("sim"), True), (F.col("id"), False)]
    while True:
        level = F.lit([float(-np.inf if c is None else c[0]) for c in cuts])
        last = F.lit([2**62 if c is None else int(c[1]) for c in cuts])

        def passes(p: Column) -> Column:
            at, end = F.get(level, p["c"]), F.get(last, p["c"])
            fine = (at < float("inf")) & (F.col("id") <= end) if by_arrival else (-p["down"] > at) | ((-p["down"] == at) & (F.col("id") <= end))
            return fine if least is None else fine & (-p["down"] >= least) & (p["down"] < 0)

        pairs = F.transform("sims", lambda s, c: F.struct((-s).alias("down"), c.alias("c")))
        best = sims.select("id", F.array_min(F.filter(pairs, passes)).alias("b")).where("b is not null")
        chosen = best.select("id", F.col("b.c").alias("c"), (-F.col("b.down")).alias("sim"))
        count = {r.c: r.n for r in chosen.groupBy("c").agg(F.count("*").alias("n")).collect()}
        over = sorted(c for c, n in count.items() if n > room[c])
        if not over:
            return chosen
        start, at = {}, 0
        for c in over:
            start[c] = at
            at += count[c]
        last_kept = F.lit([start.get(c, 0) + room[c] for c in range(size)])
        places = numbered(chosen.where(F.col("c").isin(over)), keys)
        for r in places.where(F.col("pos") == F.get(last_kept, F.col("c"))).collect():
            cuts[r.c] = (-np.inf, r.id) if by_arrival else (r.sim, r.id)


def assign_capped(points: DataFrame, centres: DataFrame, cap: int) -> DataFrame:
    """(id, line, sim): every point in one line of at most `cap`, as if all pairs were placed from
    the most similar down (then by id and line). Room for all is needed: cap * lines >= points."""
    keys, matrix = _matrix(centres)
    sims = written(similarities(points, matrix), "similarities")
    placed = matched(sims, [cap] * len(keys))
    return placed.select("id", F.get(F.lit(keys), "c").cast("long").alias("line"), "sim")


def _unit(rows: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(n > 0, n, 1)


def _sums(members: DataFrame) -> dict:
    """{line: (sum of vectors, members)} of (line, v), added up by position before the shuffle."""
    flat = members.select("line", F.posexplode("v").alias("i", "x")).groupBy("line", "i").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    rows = flat.groupBy("line").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"), F.max("n").alias("n")).collect()
    return {r.line: (np.array([p["x"] for p in r.s]), r.n) for r in rows}


def spread_start(points: DataFrame, k: int) -> np.ndarray:
    """k vectors to start from: passes over the points take about twice k each, with chances that
    grow with the squared distance from what is taken (settled by hashes of the ids), and a
    weighted choice among these few is made in the same way."""
    uniform = lambda n: F.pmod(F.xxhash64(F.lit(n), F.col("id")), F.lit(1 << 52)) / float(1 << 52)
    first = points.orderBy(F.xxhash64(F.lit(0), "id"), "id").limit(1).select("v").collect()
    centres = np.array([r.v for r in first], float)
    if not len(centres):
        return centres

    def far(matrix):
        def run(batches):
            import pandas as pd

            for pdf in batches:
                for own in _slices(len(pdf), len(matrix)):
                    part = pdf.iloc[own]
                    s = np.stack(part["v"]) @ matrix.T
                    yield pd.DataFrame({"id": part["id"], "w": np.maximum(0.0, 1.0 - s.max(axis=1)) ** 2, "near": s.argmax(axis=1)})

        return points.select("id", "v").mapInPandas(run, "id long, w double, near long")

    for n in range(1, PASSES + 1):
        w = far(centres)
        total = w.agg(F.sum("w")).first()[0] or 0.0
        if total <= 1e-12:
            break
        new = w.where(uniform(n) < OVERSAMPLED * k * F.col("w") / total).join(points, "id").orderBy("id").select("v").collect()
        centres = np.vstack([centres, *[np.array([r.v], float) for r in new]])
    near = {r.near: r["count"] for r in far(centres).groupBy("near").count().collect()}
    weight = np.array([near.get(i, 0) for i in range(len(centres))], float)
    random = np.random.default_rng(42)
    chosen = [int(weight.argmax())]
    best = np.full(len(centres), np.inf)
    while len(chosen) < min(k, len(centres)):
        best = np.minimum(best, np.maximum(0.0, 1.0 - centres @ centres[chosen[-1]]))
        share = weight * best**2
        if share.sum() <= 1e-12:
            break
        chosen.append(int(random.choice(len(centres), p=share / share.sum())))
    return centres[chosen]


def kmeans(points: DataFrame, k: int, rounds: int = 30, most: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """((id, line, sim), centres): clusters on the sphere, of at most `most` points each where
    given. A cluster without points keeps its centre. Stops when no centre moves."""
    spark = points.sparkSession
    centres = spread_start(points, k)
    n = points.count()
    cap = None if most is None else max(most, -(-n // max(len(centres), 1)))
    own = None
    for _ in range(rounds):
        table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "line long, c array<double>")
        if cap is not None and cap < n:
            own = assign_capped(points, table, cap)
        else:
            own = nearest_centroid(points, table).withColumnRenamed("best", "line")
        own = written(own, "assigned")
        new = centres.copy()
        for line, (total, _) in _sums(own.select("id", "line").join(points.select("id", "v"), "id")).items():
            new[line] = _unit(total[None])[0]
        moved = not np.allclose(new, centres, atol=1e-9)
        centres = new
        if not moved:
            break
    return own, centres


def group_points(points: DataFrame, target: int = 5, least: int = 2, most_groups: int = 60, rounds: int = 30) -> DataFrame:
    """(id, line): lines of about `target` points and at most two and a half times their mean
    size, numbered by falling size. Points farther from their centre than the mean less 1.5
    deviations of all, and lines of fewer than `least`, are isolated: line null."""
    n = points.count()
    if n < least:
        return points.select("id", F.lit(None).cast("long").alias("line"))
    k = max(1, min(most_groups, int(n / target + 0.5)))
    own, centres = kmeans(points, k, rounds, -(-5 * n // (2 * k)))
    sims = similarities(points, centres).join(own.select("id", "line"), "id").select("id", "line", F.get("sims", F.col("line").cast("int")).alias("sim"))
    sims = written(sims, "own-similarity")
    low = sims.agg((F.avg("sim") - 1.5 * F.stddev_pop("sim")).alias("low")).first().low
    close = sims.where(F.col("sim") >= low)
    size = close.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    rank = size.select("line", (F.row_number().over(Window.orderBy(F.desc("n"), "line")) - 1).cast("long").alias("pos"))  # most_groups rows
    kept = close.join(F.broadcast(rank), "line").select("id", F.col("pos").alias("line"))
    return points.select("id").join(kept, "id", "left")


def _folded(sums: dict, order: list) -> dict:
    """{group: group it went into}: groups of one go to the closest other, in order, until none is
    left or all are one."""
    groups = [[g, sums[g][0].copy(), sums[g][1], [g]] for g in order]
    while len(groups) > 1 and (lone := next((g for g in groups if g[2] == 1), None)):
        groups.remove(lone)
        close = [float(_unit(lone[1][None])[0] @ _unit(g[1][None])[0]) for g in groups]
        into = groups[int(np.argmax(close))]
        into[1], into[2], into[3] = into[1] + lone[1], into[2] + lone[2], into[3] + lone[3]
    return {m: g[0] for g in groups for m in g[3]}


def _renamed(col: str, names: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col(col)) if names else F.col(col)


def group_lines(lines: DataFrame, most_planes: int = 8, rounds: int = 30) -> DataFrame:
    """(id, plane): lines (id, v) in about the root of their number of planes, of at most 1.6
    times their mean size; a plane of one line goes into the closest other."""
    n = lines.count()
    if n <= 2:
        return lines.select("id", F.lit(0).cast("long").alias("plane"))
    k = max(2, min(most_planes, int(n**0.5 + 0.5)))
    own, _ = kmeans(lines, k, rounds, -(-8 * n // (5 * k)))
    sums = _sums(own.select("id", "line").join(lines.select("id", "v"), "id"))
    names = _folded(sums, sorted(sums))
    return own.select("id", _renamed("line", names).cast("long").alias("plane"))


def left_out(points: DataFrame, sums: DataFrame) -> DataFrame:
    """(id, line, loo): how close each member (id, line, v) is to its line's sum without itself;
    1 where nothing else is in it."""
    met = points.join(sums, "line")
    vs, vv = dot(F.col("v"), F.col("s")), dot(F.col("v"), F.col("v"))
    rest = F.sqrt(F.greatest(dot(F.col("s"), F.col("s")) - 2 * vs + vv, F.lit(0.0)))
    return met.select("id", "line", F.when(rest > 1e-7, (vs - vv) / rest).otherwise(1.0).alias("loo"))


def _sum_table(members: DataFrame) -> DataFrame:
    flat = members.select("line", F.posexplode("v").alias("i", "x")).groupBy("line", "i").agg(F.sum("x").alias("x"))
    return flat.groupBy("line").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("s"))


def carry_lines(points: DataFrame, before: DataFrame, isolated: DataFrame, target: int = 5, most: int = 12, most_groups: int = 60, least: int = 2, rounds: int = 30) -> DataFrame:
    """(id, line, fresh) after points came and went; line null for isolated ones.

    `points` (id, v) as they are, `before` (line, id) and `isolated` (id) of the analysis before.
    Lines keep their members and numbers; those with fewer than `least` left dissolve. New points
    join the closest line with room (`most` members) that is close enough: the mean less 1.5
    deviations of how close members are to their line without themselves. Then the isolated ones of
    before try the lines that grew. New points left over make new lines with the rest, by the same
    closeness. A point in two lines before counts for the lower number."""
    points = points.select("id", "v")
    ids = points.select("id")
    own = before.groupBy("id").agg(F.min("line").alias("line")).join(ids, "id", "left_semi")
    fit = own.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("line")
    kept = written(own.join(fit, "line", "left_semi").join(points, "id").select("id", "line", "v"), "kept")
    known = before.select("id").unionByName(isolated.select("id")).distinct()
    fresh = points.join(known, "id", "left_anti").select("id", F.lit(True).alias("new"))
    free = written(points.join(kept.select("id"), "id", "left_anti").join(fresh, "id", "left").select("id", "v", F.coalesce("new", F.lit(False)).alias("new")), "free")
    sums = _sums(kept)
    lines = sorted(sums)
    joined, level = None, None
    if lines:
        loo = left_out(kept, _sum_table(kept)).agg((F.avg("loo") - 1.5 * F.stddev_pop("loo")).alias("low")).first()
        level = loo.low
        centre = _unit(np.array([sums[x][0] for x in lines]))
        room = [most - sums[x][1] for x in lines]
        new = similarities(free.where("new"), centre)
        joined = written(matched(written(new, "new-points"), room, level, True).select("id", F.get(F.lit(lines), "c").cast("long").alias("line")), "joined")
        grown = _sums(joined.join(points, "id").select("line", "v"))
        if grown:
            moved = sorted(grown)
            centre = _unit(np.array([sums[x][0] + grown[x][0] for x in moved]))
            room = [most - sums[x][1] - grown[x][1] for x in moved]
            old = written(similarities(free.where("not new"), centre), "old-points")
            joined = joined.unionByName(matched(old, room, level, True).select("id", F.get(F.lit(moved), "c").cast("long").alias("line")))
    out = kept.select("id", "line", F.lit(False).alias("fresh"))
    if joined is not None:
        out = out.unionByName(joined.select("id", "line", F.lit(False).alias("fresh")))
    out = written(out, "carried")
    rest = written(free.join(out.select("id"), "id", "left_anti"), "rest")
    n, n_new = rest.agg(F.count("*"), F.count_if("new")).first()
    top = max(lines, default=-1)
    if most_groups > len(lines) and n >= least and n_new:
        made = group_points(rest, target, least, most_groups - len(lines), rounds).where("line is not null").join(rest, "id")
        if level is not None:
            made = written(made, "made")
            close = left_out(made, _sum_table(made)).where(F.col("loo") >= level).select("id")
            made = made.join(close, "id", "left_semi")
        good = made.groupBy("line").agg(F.count("*").alias("n"), F.max("new").alias("new")).where((F.col("n") >= least) & F.col("new"))
        number = good.select("line", (F.row_number().over(Window.orderBy(F.desc("n"), "line")) + top).cast("long").alias("as"))  # most_groups rows
        out = out.unionByName(made.join(F.broadcast(number), "line").select("id", F.col("as").alias("line"), F.lit(True).alias("fresh")))
    return ids.join(out, "id", "left").select("id", "line", F.coalesce("fresh", F.lit(False)).alias("fresh"))


def carry_planes(lines: DataFrame, before: DataFrame, most_planes: int = 8, rounds: int = 30) -> DataFrame:
    """(id, plane) of the lines (id, v) after those of before (plane, id): planes keep the lines
    that still exist, new lines go to the closest plane, a plane of one line into the closest
    other. Without planes that live on all lines are grouped anew."""
    lines = lines.select("id", "v")
    own = before.groupBy("id").agg(F.min("plane").alias("plane")).join(lines, "id").select("id", F.col("plane").alias("line"), "v")
    own = written(own, "kept-lines")
    sums = _sums(own)
    if not sums:
        return group_lines(lines, most_planes, rounds)
    planes = sorted(sums)
    new = lines.join(own.select("id"), "id", "left_anti")
    table = lines.sparkSession.createDataFrame([(p, _unit(sums[p][0][None])[0].tolist()) for p in planes], "line long, c array<double>")
    met = nearest_centroid(new, table).select("id", F.col("best").alias("line")).join(lines, "id").select("id", "line", "v")
    all_ = written(own.unionByName(met), "planes")
    names = _folded(_sums(all_), planes)
    return all_.select("id", _renamed("line", names).cast("long").alias("plane"))


def dominant(pairs: DataFrame, most: int) -> DataFrame:
    """(a, b, sim): pairs taken from the most similar down (then by a and b), each end once, at
    most so many. In rounds: a pair that is the best of both its ends is taken, with all such
    pairs at once, and what touches them goes; the first `most` in order are those of the loop."""
    left = written(pairs.select("a", "b", "sim"), "pairs")
    found = None
    while True:
        key = F.struct((-F.col("sim")).alias("down"), "a", "b")
        ends = left.select(F.explode(F.array("a", "b")).alias("end"), key.alias("k")).groupBy("end").agg(F.min("k").alias("k"))
        best = ends.groupBy("k").agg(F.count("*").alias("n")).where("n = 2").select("k.a", "k.b", (-F.col("k.down")).alias("sim"))
        best = written(best, "best")
        if not best.take(1):
            break
        found = best if found is None else found.unionByName(best)
        used = best.select(F.explode(F.array("a", "b")).alias("end"))
        left = written(left.join(used, left["a"] == used["end"], "left_anti").join(used, left["b"] == used["end"], "left_anti"), "pairs")
    if found is None:
        return pairs.select("a", "b", "sim").limit(0)
    return found.orderBy(F.desc("sim"), "a", "b").limit(most)


def far_slots(band: DataFrame, most: int = 10, notes: int = 3, isolated: int = 5) -> DataFrame:
    """(a, b, sim, slot): pairs (a, b, sim, note, isolated) to be judged: first up to `notes` with
    a note, then up to `isolated` in all with an isolated point, then up to `most` of any kind,
    each end once."""
    out, left, taken = None, band, 0
    for slot, limit, rows in (("note", min(most, notes), F.col("note")), ("isolated", min(most, isolated), F.col("isolated")), ("any", most, F.lit(True))):
        if limit <= taken:
            continue
        got = written(dominant(left.where(rows), limit - taken).withColumn("slot", F.lit(slot)), "slots")
        out = got if out is None else out.unionByName(got)
        taken += got.count()
        used = got.select(F.explode(F.array("a", "b")).alias("end"))
        left = left.join(used, left["a"] == used["end"], "left_anti").join(used, left["b"] == used["end"], "left_anti")
    return out
