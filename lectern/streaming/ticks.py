"""Price ticks as a stream: per-book state turns them into change events as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "asin long, id long, ts timestamp, kind string, prev double, price double, low double"
STATE = "price double, low double, ku int"


def _step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    price, low, ku = state.get if state.exists else (None, None, None)
    rows = pd.concat(list(batches)).sort_values(["ts", "id"])
    out = []
    for r in rows.itertuples(index=False):
        known = r.price is not None and r.price == r.price
        if not (r.ku or known):
            continue  # a failed scrape changes nothing
        if ku is not None and bool(ku) != bool(r.ku):
            out.append((key[0], r.id, r.ts, "joined" if r.ku else "left", None, None, low))
        ku = int(r.ku)
        if r.ku:
            continue
        if price is not None and price != r.price:
            out.append((key[0], r.id, r.ts, "drop" if r.price < price else "rise", price, r.price, min(low, r.price)))
        price, low = r.price, r.price if low is None else min(low, r.price)
    state.update((price, low, ku))
    yield pd.DataFrame(out, columns=["asin", "id", "ts", "kind", "prev", "price", "low"])


def change_events(ticks: DataFrame) -> DataFrame:
    """Changes of price and of the unlimited state, in order of time per book. Ticks of a
    book are taken in the order of (ts, id) within a micro-batch."""
    rows = ticks.select("asin", "id", F.col("ts").cast("timestamp").alias("ts"), "price", "ku")
    return rows.groupBy("asin").applyInPandasWithState(_step, EVENTS, STATE, "append", GroupStateTimeout.NoTimeout)


def change_events_batch(history: DataFrame) -> DataFrame:
    """The same events of a finished history, by windows."""
    from pyspark.sql import Window

    w = Window.partitionBy("asin").orderBy("ts", "id")
    ok = history.where("ku or price is not null")
    state = ok.withColumn("was", F.lag("ku").over(w)).where("was is not null and was <> ku").select("asin", "id", F.when(F.col("ku"), "joined").otherwise("left").alias("kind"), F.lit(None).cast("double").alias("prev"), F.lit(None).cast("double").alias("price"))
    paid = history.where("not ku and price is not null").withColumn("prev", F.lag("price").over(w)).where("prev is not null and prev <> price")
    return state.unionByName(paid.select("asin", "id", F.when(F.col("price") < F.col("prev"), "drop").otherwise("rise").alias("kind"), "prev", "price"))
