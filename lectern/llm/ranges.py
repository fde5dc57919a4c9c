"""Rows in the order of a key over a whole table: dealt to ranges, written once, each range with
its neighbours' nearest rows, so that a sweep in order sees across the cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written


def in_ranges(rows: DataFrame, keys: list[str], name: str, parts: int | None = None) -> DataFrame:
    """`rows` with `part`, the number of their range in the order of `keys`, as a written table:
    the cuts hold for everything that reads it. Keys must tell rows apart, so that equal rows
    of a hot key spread over ranges."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(parts, *keys).withColumn("part", F.spark_partition_id()), name)


def with_neighbours(ranged: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """The ranges, each in one task and in the order of `keys`, with `ghost` rows: the last row of
    the range before and the first of the range after. The window runs over two rows a range."""
    parts = parts or int(ranged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [c for c in ranged.columns if c != "part"]
    row = F.struct(*keys, *[c for c in names if c not in keys])
    edges = ranged.groupBy("part").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    w = Window.orderBy("part")
    near = edges.select("part", F.array(F.lag("last").over(w), F.lead("first").over(w)).alias("near"))
    ghosts = near.select("part", F.explode("near").alias("g")).where("g is not null")
    ghosts = ghosts.select("part", *[F.col(f"g.{c}").alias(c) for c in names], F.lit(True).alias("ghost"))
    both = ranged.withColumn("ghost", F.lit(False)).unionByName(ghosts)
    return both.repartition(parts, "part").sortWithinPartitions("part", *keys)
