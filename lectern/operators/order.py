"""Positions and running totals over a whole table without sending it through one task.

Rows are dealt to as many ranges of the sort key as the session has shuffle partitions, and
written once, so that the cuts hold; totals of the ranges before are added to the running totals
inside each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written


def running_total(rows: DataFrame, keys: list[tuple[Column, bool]], value: Column, name: str) -> DataFrame:
    """`rows` with the running sum of `value` in the order of `keys` ((column, descending) with
    nulls last, ending in one that tells rows apart)."""
    names = [f"_k{i}" for i in range(len(keys))]
    rows = rows.withColumns({n: c for n, (c, _) in zip(names, keys)}).withColumn("_v", value)
    order = [F.col(n).desc_nulls_last() if d else F.col(n).asc_nulls_last() for n, (_, d) in zip(names, keys)]
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(rows.repartitionByRange(ranges, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sums = rows.groupBy("_part").agg(F.sum("_v").alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(before), F.lit(0))).select("_part", "_before")
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(F.broadcast(sums), "_part").withColumn(name, (F.sum("_v").over(inside) + F.col("_before")).cast("long"))
    return out.drop("_part", "_v", "_before", *names)


def numbered(rows: DataFrame, keys: list[tuple[Column, bool]], name: str = "pos") -> DataFrame:
    """`rows` with their position, from 1, in the order of `keys`."""
    return running_total(rows, keys, F.lit(1), name)


def total_in_group(rows: DataFrame, group: str, keys: list[tuple[Column, bool]], value: Column, name: str) -> DataFrame:
    """The running sum of `value` within the group, which may be any share of the table: the
    running sum over all less what stood before the group."""
    all_ = running_total(rows.withColumn("_add", value), [(F.col(group), False), *keys], F.col("_add"), "_all")
    first = all_.groupBy(F.col(group).alias("_g")).agg(F.min(F.col("_all") - F.col("_add")).alias("_first"))
    return all_.join(first, F.col(group).eqNullSafe(F.col("_g"))).withColumn(name, F.col("_all") - F.col("_first")).drop("_all", "_add", "_g", "_first")
