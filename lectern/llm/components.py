"""Connected components over an edge table that never leaves the executors."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, new_path, release, written


PART_ROWS = 100_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges`; root is the smallest node reachable.

    Alternating large-star and small-star contraction. Each round rewrites every edge at
    most once, so rows never exceed the input's; rounds grow with the logarithm of the
    graph's size, and a round takes a task for each PART_ROWS edges, no more. Smallest
    neighbours are grouped minima that come back by a join, so a node with very many edges is
    first reduced where its edges are and then split by a skewed join. Each round is written to the shared folder, so an executor's loss costs one round at
    most, and replaces the one before; its first half is kept on the executors' disks and made
    anew if it is lost. Loops and null ends are ignored; an empty table gives
    no rows.
    """
    spark = edges.sparkSession
    last: list[str] = []
    parts = None

    def kept(df: DataFrame) -> DataFrame:
        last.append(new_path(spark, "components"))
        out = written(df if parts is None else df.coalesce(parts), "components", last[-1])
        for old in last[:-1]:
            drop_path(spark, old)
        del last[:-1]
        return out

    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = kept(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    parts = max(1, -(-e.count() // PART_ROWS))  # edges never become more, so this bounds all rounds
    state = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = large.coalesce(parts).persist(StorageLevel.DISK_ONLY)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        e = kept(large.join(low, "u").select(F.explode(ends).alias("e")).select("e.u", "e.v").where("u <> v").distinct())
        large.unpersist()
        release(spark)  # a round's plans and shuffles go with it, on the driver too
        seen = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1000003)).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots).distinct()
