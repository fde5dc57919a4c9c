"""Pointers, snapshots and edges of the knowledge graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import numbered, running_total, total_in_group

HOPS = 10


def current_ids(pointers: DataFrame, hops: int = HOPS) -> DataFrame:
    """(id, current): `next` followed while there is one, at most `hops` times. Steps of one, two,
    four and so on hops are made by joining a step with itself, and those that add up to
    `hops` are chained."""

    def chain(first: DataFrame, then: DataFrame) -> DataFrame:
        step = then.select(F.col("id").alias("at"), F.col("current").alias("to"))
        return first.join(step, F.col("current") == F.col("at"), "left").select("id", F.coalesce("to", "current").alias("current"))

    power = pointers.select("id", F.coalesce("next", "id").alias("current"))
    out = None
    while hops:
        if hops & 1:
            out = power if out is None else chain(out, power)
        hops >>= 1
        if hops:
            power = chain(power, power)
    return out


def newest_per_peer(links: DataFrame) -> DataFrame:
    """(node, peer, at): both directions of every link, the newest per pair."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("peer"), "at").unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("peer"), "at"))
    return both.groupBy("node", "peer").agg(F.max("at").alias("at"))


def with_former(points: DataFrame, former: DataFrame | None, key: str) -> DataFrame:
    """Rows once for their own id and once for each id that theirs replaced (id, former), as `alias`."""
    own = points.withColumn("alias", F.col(key))
    if former is None:
        return own
    return own.unionByName(points.join(former.select(F.col("id").alias(key), F.col("former").alias("alias")), key))


def diff(before: DataFrame, after: DataFrame, former: DataFrame | None = None) -> DataFrame:
    """(line, state, n_new): lines added, removed, grown or kept between two snapshots of (line,
    point). A point that only replaced one of the line is none of its new ones."""
    was = with_former(after.select("line", "point"), former, "point").join(before.select("line", F.col("point").alias("alias")), ["line", "alias"]).select("line", "point").distinct()
    now = after.join(was.withColumn("was", F.lit(1)), ["line", "point"], "left").groupBy("line").agg(F.count("*").alias("n_is"), F.count_if(F.col("was").isNull()).alias("n_new"))
    met = before.groupBy("line").agg(F.count("*").alias("n_was")).join(now, "line", "full").na.fill(0)
    state = F.when(F.col("n_was") == 0, "added").when(F.col("n_is") == 0, "removed").when(F.col("n_new") > 0, "grown").otherwise("kept")
    return met.select("line", state.alias("state"), "n_new")


def connected(before: DataFrame, after: DataFrame, former: DataFrame) -> DataFrame:
    """(point, line, state): points in a line that were in none before: connected, or extended
    where they replaced a point that was in one."""
    members = before.select(F.col("point").alias("alias")).distinct()
    new = after.join(members, after["point"] == members["alias"], "left_anti")
    longer = new.join(former, new["point"] == former["id"]).select("line", "point", F.col("former").alias("alias")).join(members, "alias").select("line", "point").distinct()
    return new.join(longer.withColumn("longer", F.lit(True)), ["line", "point"], "left").select("point", "line", F.when(F.col("longer"), "extended").otherwise("connected").alias("state"))


def main_plane(evidence: DataFrame, planes: DataFrame) -> DataFrame:
    """(note, plane): the plane a note's evidence hits most often, the lowest on ties."""
    n = evidence.join(planes, "point").groupBy("note", "plane").agg(F.count("*").alias("n"))
    best = n.groupBy("note").agg(F.max(F.struct("n", (-F.col("plane")).alias("k"))).alias("b"))
    return best.select("note", (-F.col("b.k")).alias("plane"))


def tree_edges(planes: DataFrame, members: DataFrame) -> DataFrame:
    """(src, dst, kind): edges from planes to lines (plane, line) and from lines to points
    (line, point), each once."""
    a = planes.select(F.concat(F.lit("p"), "plane").alias("src"), F.concat(F.lit("l"), "line").alias("dst"), F.lit("plane").alias("kind"))
    b = members.select(F.concat(F.lit("l"), "line").alias("src"), F.concat(F.lit("h"), "point").alias("dst"), F.lit("line").alias("kind"))
    return a.unionByName(b).distinct()


def interleave(lists: DataFrame) -> DataFrame:
    """(item, pos): the first of each list, then the seconds and so on; rows (lst, k, item), k in
    the order of the list and unique in it."""
    place = total_in_group(lists.select("lst", "k", "item"), "lst", [(F.col("k"), False)], F.lit(1), "_n")
    return numbered(place, [(F.col("_n"), False), (F.col("lst"), False)]).select("item", "pos")


def keep_with_quota(rows: DataFrame, n: int) -> DataFrame:
    """Newest rows while fewer than n unmarked ones came before; marked ones do not count."""
    counted = F.when(F.col("wrong"), 0).otherwise(1)
    return running_total(rows, [(F.col("at"), True), (F.col("id"), True)], counted, "k").where(F.col("k") <= n).drop("k")
