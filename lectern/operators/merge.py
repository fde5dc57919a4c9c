"""Convergence of records edited on several devices: every rule is free of the order in
which versions arrive, so each is one aggregation by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_writer(versions: DataFrame, keys: list[str], stamp: str, tie: list[str]) -> DataFrame:
    """The newest version per key; equal stamps by content."""
    rest = [c for c in versions.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(stamp, *[c for c in tie if c != stamp]))
    return versions.groupBy(*keys).agg(best.alias("b")).select(*keys, *[F.col(f"b.{c}").alias(c) for c in rest])


def sticky_delete(versions: DataFrame, keys: list[str], stamp: str, tie: list[str], gone: str = "gone") -> DataFrame:
    """Last writer wins, but a key once deleted stays deleted."""
    rest = [c for c in versions.columns if c not in keys and c != gone]
    best = F.max_by(F.struct(*rest), F.struct(stamp, *[c for c in tie if c != stamp]))
    return versions.groupBy(*keys).agg(best.alias("b"), F.max(gone).alias(gone)).select(*keys, *[F.col(f"b.{c}").alias(c) for c in rest], gone)


def field_groups(versions: DataFrame, keys: list[str], groups: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    """Groups of fields, each with clocks of its own: {name: (fields, clock columns)}; null
    clocks never win over set ones."""
    aggs = []
    for name, (fields, clock) in groups.items():
        aggs.append(F.max_by(F.struct(*fields), F.when(F.col(clock[0]).isNotNull(), F.struct(*clock))).alias(name))
    return versions.groupBy(*keys).agg(*aggs).select(*keys, *[F.col(f"{n}.{f}").alias(f) for n, (fields, _) in groups.items() for f in fields])


def fill_blanks(base: DataFrame, incoming: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Import: new keys are inserted, blank fields filled, set ones kept. `change` says which."""
    b, i = base.alias("b"), incoming.alias("i")
    blank = lambda c: F.nullif(c.cast("string"), F.lit("")).isNull()
    out = b.join(i, [F.col(f"b.{k}") == F.col(f"i.{k}") for k in keys], "full")
    here, there = F.col(f"b.{keys[0]}").isNotNull(), F.col(f"i.{keys[0]}").isNotNull()
    filled = [F.when(blank(F.col(f"b.{f}")), F.col(f"i.{f}")).otherwise(F.col(f"b.{f}")).alias(f) for f in fields]
    any_fill = F.lit(False)
    for f in fields:
        any_fill = any_fill | (blank(F.col(f"b.{f}")) & ~blank(F.col(f"i.{f}")))
    change = F.when(~here, "added").when(there & any_fill, "filled").otherwise("kept")
    return out.select(*[F.coalesce(F.col(f"b.{k}"), F.col(f"i.{k}")).alias(k) for k in keys], *filled, change.alias("change"))


def first_seen(reads: DataFrame, key: str, at: str) -> DataFrame:
    return reads.groupBy(key).agg(F.min(at).alias(at))


def union_sets(versions: DataFrame, key: str, members: str) -> DataFrame:
    """Set union in a fixed order."""
    return versions.groupBy(key).agg(F.array_sort(F.collect_set(members)).alias(members))


def clamp_clock(stamp: Column, now: Column, slack_hours: int = 24) -> Column:
    """Times more than a day ahead count as now; missing ones as the oldest."""
    late = stamp > now + F.expr(f"INTERVAL {slack_hours} HOURS")
    return F.when(stamp.isNull(), F.lit("1970-01-01").cast("timestamp_ntz")).when(late, now).otherwise(stamp)
