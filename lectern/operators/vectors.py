"""Vector and text-similarity operators in double precision.

Points are rows (id, line, source, v). Centroids and queries are sent to all tasks in blocks
of `FEW`, which may be any number of blocks; points are compared with a block as matrices, an
Arrow batch at a time, and only the best per row are kept. Lines are compared with lines'
members in blocks of `BLOCK` rows. A task holds at most `CELLS` similarities at a time.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import normalize_text

from .order import running_total

FEW = 4096
BLOCK = 16_384
CELLS = 1 << 22  # similarities held at a time


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def centroids(points: DataFrame) -> DataFrame:
    """(line, c): normalised vector sums, added up by position before the shuffle."""
    flat = points.select("line", F.posexplode("v").alias("i", "x")).groupBy("line", "i").agg(F.sum("x").alias("x"))
    whole = flat.groupBy("line").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("c"))
    return whole.select("line", normalised(F.col("c")).alias("c"))


def _blocks(few: DataFrame, key: str, vector: str):
    """(keys, matrix) of a table in blocks of `FEW` rows, ordered by key."""
    keys, rows = [], []
    for r in few.select(key, vector).orderBy(key).toLocalIterator():
        keys.append(r[0])
        rows.append(r[1])
        if len(keys) == FEW:
            yield np.array(keys), np.array(rows, float)
            keys, rows = [], []
    if keys:
        yield np.array(keys), np.array(rows, float)


def _ranked(row: np.ndarray, key: np.ndarray, sim: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (row, key, similarity) the n highest of each row; the lowest key wins ties."""
    order = np.lexsort((key, -sim, row))
    row, key, sim = row[order], key[order], sim[order]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    fine = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)])) < n
    return row[fine], key[fine], sim[fine]


def _best(sims: np.ndarray, keys: np.ndarray, n: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, similarity) of the n highest of each row, rounded; the lowest key wins ties. What
    may be among them once rounded is found first, and only that is sorted."""
    sims[np.isnan(sims)] = -np.inf
    least = np.full((len(sims), 1), -np.inf)
    if sims.shape[1] > n:
        least = np.partition(sims, sims.shape[1] - n, axis=1)[:, -n][:, None] - 2.0 * 10.0**-digits
    row, at = np.nonzero((sims >= least) & (sims > -np.inf))
    return _ranked(row, keys[at], np.round(sims[row, at], digits), n)


def _slices(n: int, width: int):
    """Slices of n rows, of at most `CELLS` similarities to `width` others (one row at least)."""
    step = max(1, CELLS // max(width, 1))
    return [slice(i, i + step) for i in range(0, n, step)]


def merged_top(parts: DataFrame, key: str, other: str, n: int) -> DataFrame:
    """(key, other, sim, rank): the n most similar of partial results; the lowest wins ties."""
    list_ = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("down"), F.col(other).alias("k")))), 1, n)
    top = parts.groupBy(key).agg(list_.alias("t")).select(key, F.posexplode("t").alias("r", "t"))
    return top.select(key, F.col("t.k").alias(other), (-F.col("t.down")).alias("sim"), (F.col("r") + 1).alias("rank"))


def closest(points: DataFrame, centres: DataFrame, n: int) -> DataFrame:
    """(id, centre, sim, rank): the n closest centres (line, c) of every point."""
    parts = None
    for keys, matrix in _blocks(centres, "line", "c"):

        def run(batches, keys=keys, matrix=matrix):
            import pandas as pd

            for pdf in batches:
                for own in _slices(len(pdf), len(keys)):
                    part = pdf.iloc[own]
                    row, key, sim = _best(np.stack(part["v"]) @ matrix.T, keys, n, 9)
                    yield pd.DataFrame({"id": part["id"].to_numpy()[row], "centre": key, "sim": sim})

        part = points.select("id", "v").mapInPandas(run, "id long, centre long, sim double")
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        return points.sparkSession.createDataFrame([], "id long, centre long, sim double, rank int")
    return merged_top(parts, "id", "centre", n)


def search(queries: DataFrame, points: DataFrame, n: int, skip: DataFrame | None = None) -> DataFrame:
    """(query, id, sim, rank): the n points most similar to each query (id, v), itself and the
    skipped pairs (query, id) left out. Every task sends on the best n per query of its points, and
    holds no more than these and one slice of similarities."""
    parts = None
    for keys, matrix in _blocks(queries, "id", "v"):
        most = n
        if skip is not None:  # so many more are kept as a query skips at most
            most += int(skip.groupBy("query").count().agg(F.max("count")).first()[0] or 0)

        def run(batches, keys=keys, matrix=matrix, most=most):
            import pandas as pd

            best = tuple(np.zeros(0, t) for t in (np.int64, np.int64, float))
            for pdf in batches:
                for own in _slices(len(pdf), len(keys)):
                    part = pdf.iloc[own]
                    ids = part["id"].to_numpy()
                    sims = matrix @ np.stack(part["v"]).T
                    sims[keys[:, None] == ids[None, :]] = -np.inf
                    best = _ranked(*map(np.concatenate, zip(best, _best(sims, ids, most, 6))), most)
            for i in range(0, len(best[0]), 10_000):
                row, other, sim = (x[i : i + 10_000] for x in best)
                yield pd.DataFrame({"query": keys[row], "id": other, "sim": sim})

        part = points.select("id", "v").mapInPandas(run, "query long, id long, sim double")
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        return points.sparkSession.createDataFrame([], "query long, id long, sim double, rank int")
    if skip is not None:
        parts = parts.join(skip.select("query", "id"), ["query", "id"], "left_anti")
    return merged_top(parts, "query", "id", n)


def nearest_centroid(points: DataFrame, centres: DataFrame) -> DataFrame:
    """(id, best, sim): the closest centre, the lowest on ties."""
    return closest(points, centres, 1).select("id", F.col("centre").alias("best"), "sim")


def line_similarities(points: DataFrame, centres: DataFrame) -> DataFrame:
    """(id, line, sim) to the own line's centroid."""
    met = points.join(centres, "line")
    return met.select("id", "line", dot(F.col("v"), F.col("c")).alias("sim"))


def line_stats(points: DataFrame, centres: DataFrame) -> DataFrame:
    """(line, median, mean, sd): the lower median, and population moments."""
    s = line_similarities(points, centres)
    return s.groupBy("line").agg(F.round(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY sim)"), 6).alias("median"), F.round(F.avg("sim"), 6).alias("mean"), F.round(F.stddev_pop("sim"), 6).alias("sd"))


def outliers(points: DataFrame, centres: DataFrame, width: float = 1.5) -> DataFrame:
    """Points farther from their line than mean - width * sd."""
    w = Window.partitionBy("line")
    s = line_similarities(points, centres).withColumn("limit", F.avg("sim").over(w) - width * F.stddev_pop("sim").over(w))
    return s.where("sim < limit").select("id", "line")


def _top_of_block(n: int):
    """The n most similar members of other sources for each visitor of a block of a line."""

    def run(pdf):
        import pandas as pd

        q, m = pdf[pdf["visitor"]], pdf[~pdf["visitor"]]
        if not len(q) or not len(m):
            return pd.DataFrame({"id": [], "other": [], "sim": []})
        members, source, ids = np.stack(m["v"]).T, m["source"].to_numpy(), m["id"].to_numpy()
        out = []
        for own in _slices(len(q), len(m)):
            part = q.iloc[own]
            sims = np.stack(part["v"]) @ members
            sims[part["source"].to_numpy()[:, None] == source[None, :]] = -np.inf
            row, other, sim = _best(sims, ids, n, 6)
            out.append(pd.DataFrame({"id": part["id"].to_numpy()[row], "other": other, "sim": sim}))
        return pd.concat(out)

    return run


def neighbours(points: DataFrame, centres: DataFrame, n: int = 5, lines: int = 8) -> DataFrame:
    """(id, other, sim, rank): nearest points of other sources among the members of the
    `lines` closest lines and the isolated points (those without a line).

    A point visits its lines; members and visitors of a line meet in blocks, so large lines
    are many tasks, and each block sends on the best n per visitor.
    """
    lone = F.coalesce(F.col("line").cast("long"), F.lit(-1)).alias("line")
    near = closest(points, centres, lines).select("id", F.col("centre").alias("line"))
    near = near.unionByName(points.select("id", F.lit(-1).cast("long").alias("line")))
    size = points.groupBy(lone).agg(F.ceil(F.count("*") / F.lit(float(BLOCK))).cast("int").alias("blocks"))
    visits = near.groupBy("line").agg(F.ceil(F.count("*") / F.lit(float(BLOCK))).cast("int").alias("calls"))
    plan = size.join(visits, "line")
    own = F.xxhash64("id")
    members = points.select("id", "source", "v", lone).join(plan, "line").withColumn("block", F.pmod(own, F.col("blocks")).cast("int"))
    members = members.withColumn("call", F.explode(F.sequence(F.lit(0), F.col("calls") - 1))).withColumn("visitor", F.lit(False))
    guests = near.join(points.select("id", "source", "v"), "id").join(plan, "line").withColumn("call", F.pmod(own, F.col("calls")).cast("int"))
    guests = guests.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("visitor", F.lit(True))
    columns = ["line", "block", "call", "visitor", "id", "source", "v"]
    met = members.select(columns).unionByName(guests.select(columns)).groupBy("line", "block", "call").applyInPandas(_top_of_block(n), "id long, other long, sim double")
    return merged_top(met.distinct(), "id", "other", n)


def ask_context(ranked: DataFrame, gate: float = 0.58, level: float = 0.5, most: int = 8) -> DataFrame:
    """Per query nothing unless its best reaches the gate, else what reaches the level."""
    fit = ranked.groupBy("query").agg(F.max("sim").alias("best")).where(F.col("best") >= gate).select("query")
    return ranked.join(fit, "query", "left_semi").where((F.col("sim") >= level) & (F.col("rank") <= most)).select("query", "id", "sim")


def band(pairs: DataFrame, low: float = 0.15, high: float = 0.45) -> DataFrame:
    """Pairs whose similarity lies between the values at floor(low * m) and floor(high * m)."""
    upto = running_total(pairs.groupBy("sim").agg(F.count("*").alias("n")), [(F.col("sim"), False)], F.col("n"), "upto")
    m = F.broadcast(pairs.agg(F.count("*").alias("m")))
    at = lambda r: F.floor(F.lit(r) * F.col("m"))
    # the value at an index is the least one that reaches beyond it
    cuts = upto.join(m, F.col("upto") <= F.col("m")).agg(F.min(F.when(F.col("upto") > at(low), F.col("sim"))).alias("lo"), F.min(F.when(F.col("upto") > at(high), F.col("sim"))).alias("hi"))
    return pairs.join(F.broadcast(cuts), F.col("sim").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def grams(texts: DataFrame, id_col: str = "id", text_col: str = "text", sizes: tuple[int, ...] = (2, 3)) -> DataFrame:
    """(id, gram, tf): character n-grams of the normalised text without white space and
    punctuation of any script. An id's grams are counted within its own row, sorted; no task
    holds a table of them."""
    plain = F.regexp_replace(normalize_text(F.col(text_col)), r"[\s\p{P}\p{S}]", "")

    def of_size(p: Column, n: int) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length(p) - (n - 1)), lambda i: F.substring(p, i, F.lit(n)))
        return F.when(F.length(p) >= n, cut).otherwise(F.array().cast("array<string>"))

    whole = texts.select(F.col(id_col).alias("id"), plain.alias("p")).groupBy("id").agg(F.collect_list("p").alias("p"))
    rows = whole.select("id", F.array_sort(F.flatten(F.transform("p", lambda p: F.concat(*[of_size(p, n) for n in sizes])))).alias("g"))
    begins = F.filter(F.sequence(F.lit(0), F.size("g") - 1), lambda i: (i == 0) | (F.get("g", i) != F.get("g", i - 1)))
    rows = rows.where(F.size("g") > 0).withColumn("at", begins)
    runs = F.transform("at", lambda i, k: F.struct(F.get("g", i).alias("gram"), (F.coalesce(F.get("at", k + 1), F.size("g")) - i).cast("long").alias("tf")))
    return rows.select("id", F.explode(runs).alias("r")).select("id", "r.gram", "r.tf")


def tfidf(grams_df: DataFrame, n_texts: int) -> DataFrame:
    """(id, gram, w): (1 + ln tf) * (ln((N + 1) / (df + 1)) + 1), less for grams of one text. Both
    sides meet sorted: a plan judges grams by the columns of their texts, which are far smaller, and
    would send all of them through the driver."""
    df = grams_df.groupBy("gram").agg(F.count("*").alias("df"))
    w = (1 + F.log("tf")) * (F.log(F.lit(n_texts + 1.0) / (F.col("df") + 1)) + 1) * F.when(F.col("df") > 1, 1.0).otherwise(0.3)
    return grams_df.join(df.hint("merge"), "gram").select("id", "gram", w.alias("w"))


def related(points: DataFrame, centres: DataFrame, most: int = 12) -> DataFrame:
    """(line, id, sim, rank): points of other lines whose second-closest line (their own left out)
    is this one and that are as close to it as its own median member."""
    own = points.select("id", F.col("line").cast("long").alias("own"))
    two = closest(points, centres, 2).join(own, "id").where("centre <> own")
    second = two.groupBy("id").agg(F.min_by(F.struct("centre", "sim"), "rank").alias("b")).select("id", F.col("b.centre").alias("line"), F.col("b.sim").alias("sim"))
    low = line_similarities(points, centres).groupBy("line").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY sim)").alias("median"))
    fine = second.join(low, "line").where(F.col("sim") >= F.round("median", 9))
    return merged_top(fine.select("line", "id", "sim"), "line", "id", most)


def left_out_limits(points: DataFrame, centres: DataFrame, width: float = 1.5) -> DataFrame:
    """(id, line, limit): for each member the mean less `width` deviations of the others'
    similarities to their line, from sums over the line."""
    s = line_similarities(points, centres)
    sums = s.groupBy("line").agg(F.sum("sim").alias("s"), F.sum(F.col("sim") ** 2).alias("q"), F.count("*").alias("n"))
    rest = s.join(sums, "line").where("n > 1")
    mean = (F.col("s") - F.col("sim")) / (F.col("n") - 1)
    spread = F.sqrt(F.greatest((F.col("q") - F.col("sim") ** 2) / (F.col("n") - 1) - mean**2, F.lit(0.0)))
    return rest.select("id", "line", (mean - width * spread).alias("limit"))


def sunflower(points: DataFrame, gap: float = 1.0) -> DataFrame:
    """(id, x, y): the members of a line in a spiral by id, each turned by the golden angle."""
    k = F.row_number().over(Window.partitionBy("line").orderBy("id")) - 1
    angle = k * (math.pi * (3 - math.sqrt(5)))
    r = gap * F.sqrt(k + F.lit(0.5))
    return points.select("id", (r * F.cos(angle)).alias("x"), (r * F.sin(angle)).alias("y"))
