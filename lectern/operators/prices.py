"""Latest prices, price changes and state transitions over an append-only price history.

Every operator works per book by windows ordered by (ts, id), so one shuffle by book serves
all of them. Null prices are failed scrapes; unlimited rows (`ku`) carry price 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEWEST = 50


def latest(history: DataFrame) -> DataFrame:
    """Rows of the latest time per book; ties all stay."""
    w = Window.partitionBy("asin").orderBy(F.col("ts").desc())
    return history.withColumn("r", F.rank().over(w)).where("r = 1").drop("r")


def with_latest(books: DataFrame, history: DataFrame) -> DataFrame:
    """Every book with its latest price, if any; a null asin never matches."""
    return books.join(latest(history), "asin", "left")


def trend(history: DataFrame) -> DataFrame:
    """(asin, current, prev, changed_at, low, low_at) over paid prices.

    prev is the price before the last change; low_at is null when the first price is
    already the lowest, else the first time of the lowest.
    """
    paid = history.where("not ku and price is not null")
    w = Window.partitionBy("asin").orderBy("ts", "id")
    p = paid.select("asin", "ts", "id", "price", F.lag("price").over(w).alias("before"), F.row_number().over(w).alias("n"))
    changed = F.col("before").isNotNull() & (F.col("before") != F.col("price"))
    at = F.struct("ts", "id")
    agg = p.groupBy("asin").agg(
        F.max_by("price", at).alias("current"),
        F.max_by(F.when(changed, F.col("before")), F.when(changed, at)).alias("prev"),
        F.max(F.when(changed, F.col("ts"))).alias("changed_at"),
        F.min(F.struct("price", "ts", "id", "n")).alias("least"),
    )
    low_at = F.when(F.col("least.n") > 1, F.col("least.ts"))
    return agg.select("asin", "current", "prev", "changed_at", F.col("least.price").alias("low"), low_at.alias("low_at"))


def newest(history: DataFrame, n: int = NEWEST) -> DataFrame:
    """The newest n rows of each book."""
    w = Window.partitionBy("asin").orderBy(F.col("ts").desc(), F.col("id").desc())
    return history.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")


def history_lists(history: DataFrame, n: int = NEWEST) -> DataFrame:
    """(asin, n_points, points): the newest rows in time order as text; unlimited rows show
    no price, campaigns only beside a price."""
    shown = F.when(~F.col("ku"), F.col("price"))
    campaign = F.when(shown.isNotNull() & (F.coalesce("campaign", F.lit("")) != ""), F.lit("*")).otherwise("")
    one = F.concat_ws("", F.col("id").cast("string"), F.lit(":"), F.coalesce((shown * 100).cast("long").cast("string"), F.lit("-")), campaign)
    return newest(history, n).groupBy("asin").agg(F.count("*").alias("n_points"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "id", one.alias("s")))), lambda x: x["s"]), " ").alias("points"))


def transitions(history: DataFrame, state: Column, eligible: Column) -> DataFrame:
    """(asin, at): when the state a book is in now began, given an opposite row before.

    Looks at the eligible rows among the newest; books not in the state now are left out.
    """
    w = Window.partitionBy("asin").orderBy("ts", "id")
    rows = newest(history).where(eligible).select("asin", "ts", "id", state.alias("s"))
    rows = rows.withColumn("before", F.lag("s").over(w))
    began = F.when(F.col("s") & (F.col("before") == False), F.col("ts"))  # noqa: E712
    agg = rows.groupBy("asin").agg(F.max_by("s", F.struct("ts", "id")).alias("now"), F.max(began).alias("at"))
    return agg.where("now and at is not null").select("asin", "at")


def joined_unlimited(history: DataFrame) -> DataFrame:
    return transitions(history, F.col("ku"), F.col("ku") | F.col("price").isNotNull())


def left_unlimited(history: DataFrame) -> DataFrame:
    return transitions(history, ~F.col("ku"), F.col("ku") | F.col("price").isNotNull())


def campaign_started(history: DataFrame) -> DataFrame:
    return transitions(history, F.coalesce("campaign", F.lit("")) != "", ~F.col("ku") & F.col("price").isNotNull())


def target_reached(history: DataFrame, targets: DataFrame) -> DataFrame:
    met = history.join(targets.where("target is not null").select("asin", "target"), "asin")
    return transitions(met, F.col("price") <= F.col("target"), ~F.col("ku") & F.col("price").isNotNull())


def change_events(books: DataFrame, history: DataFrame) -> DataFrame:
    """(asin, at, kind) of all five kinds of events in one pass over each book's rows: the last
    change of a paid price, and where the state a book is in now began among its newest rows."""
    targets = books.select("asin", "target")
    h = history.join(targets, "asin", "left")
    forward = Window.partitionBy("asin").orderBy("ts", "id")
    earlier = forward.rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("r", F.row_number().over(Window.partitionBy("asin").orderBy(F.col("ts").desc(), F.col("id").desc())))
    known, paid, lately = F.col("price").isNotNull(), ~F.col("ku") & F.col("price").isNotNull(), F.col("r") <= NEWEST
    states = {
        "joined": (F.col("ku") | known, F.col("ku")),
        "left": (F.col("ku") | known, ~F.col("ku")),
        "campaign": (paid, F.coalesce("campaign", F.lit("")) != ""),
        "target": (paid & F.col("target").isNotNull(), F.col("price") <= F.col("target")),
    }
    h = h.withColumns({f"s_{k}": F.when(lately & fit, state) for k, (fit, state) in states.items()} | {"paid": F.when(paid, F.col("price"))})
    h = h.withColumns({f"b_{k}": F.last(f"s_{k}", ignorenulls=True).over(earlier) for k in states} | {"before": F.last("paid", ignorenulls=True).over(earlier)})
    at = F.struct("ts", "id")
    changed = F.col("paid").isNotNull() & F.col("before").isNotNull() & (F.col("before") != F.col("paid"))
    aggs = [F.max_by("paid", F.when(F.col("paid").isNotNull(), at)).alias("current"), F.max_by("before", F.when(changed, at)).alias("prev"), F.max(F.when(changed, F.col("ts"))).alias("changed_at")]
    for k in states:
        aggs += [F.max_by(f"s_{k}", F.when(F.col(f"s_{k}").isNotNull(), at)).alias(f"now_{k}"), F.max(F.when(F.col(f"s_{k}") & ~F.col(f"b_{k}"), F.col("ts"))).alias(f"at_{k}")]
    g = h.groupBy("asin").agg(*aggs)
    kind = F.when(F.col("current") < F.col("prev"), "drop").otherwise("rise")
    found = [F.when(F.col("changed_at").isNotNull(), F.struct(F.col("changed_at").alias("at"), kind.alias("kind")))]
    found += [F.when(F.col(f"now_{k}") & F.col(f"at_{k}").isNotNull(), F.struct(F.col(f"at_{k}").alias("at"), F.lit(k).alias("kind"))) for k in states]
    return g.select("asin", F.explode(F.filter(F.array(*found), lambda e: e.isNotNull())).alias("e")).select("asin", "e.at", "e.kind")


def feed(books: DataFrame, history: DataFrame, picked: bool = True, limit: int = 50) -> DataFrame:
    """The newest events of all kinds; only wanted, unpurchased books where `picked`. The
    filter comes before the limit."""
    events = change_events(books, history)
    if picked:
        events = events.join(books.where("wanted and not purchased").select("asin"), "asin", "left_semi")
    return events.orderBy(F.col("at").desc(), F.col("asin").desc(), F.col("kind").desc()).limit(limit)


def missing_reason(books: DataFrame, history: DataFrame, reasons: DataFrame) -> DataFrame:
    """(asin, reason) of books without a price: unlimited, never scraped, the recorded reason
    if it is of the latest scrape, else unknown."""
    last = latest(history).groupBy("asin").agg(F.max("ts").alias("ts"), F.bool_or("ku").alias("ku"), F.max("price").alias("price"))
    b = books.join(last, "asin", "left").join(reasons.select("asin", F.col("ts").alias("r_ts"), "reason"), "asin", "left")
    b = b.where(F.col("price").isNull() | F.col("ku"))
    reason = F.when(F.col("ku"), "ku").when(F.col("ts").isNull(), "not_scraped").when(F.col("r_ts") == F.col("ts"), F.col("reason")).otherwise("unknown")
    return b.select("asin", reason.alias("reason"))


def sparkline(history: DataFrame, width: float = 100.0, height: float = 20.0) -> DataFrame:
    """(asin, id, x, y): paid points scaled to a box; books with fewer than two are left out."""
    w = Window.partitionBy("asin")
    p = history.where("not ku and price is not null").withColumn("n", F.count("*").over(w))
    t = F.unix_micros(F.col("ts").cast("timestamp")).cast("double")
    lo, hi, first, last = F.min("price").over(w), F.max("price").over(w), F.min(t).over(w), F.max(t).over(w)
    x = F.when(last > first, (t - first) / (last - first) * width).otherwise(0.0)
    y = F.when(hi > lo, (hi - F.col("price")) / (hi - lo) * height).otherwise(height / 2)
    return p.where("n >= 2").select("asin", "id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


def shrink_guard(new_rows: int, published: int) -> None:
    """Refuse to publish nothing, or less than half of what is published."""
    if new_rows == 0 or new_rows * 2 < published:
        raise ValueError(f"refusing to publish {new_rows} rows over {published}")
