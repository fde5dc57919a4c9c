"""Far connections: ids of pairs, judgement by answers that may fail, and what becomes of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.ids import short_hash
from lectern.functions.text import one_line, says_something

IDEA_CHARS, EXPLANATION_CHARS = 40, 300
FAILURES, UNREADABLE = 2, 2


def far_id(a: Column, b: Column) -> Column:
    """The id of a pair, whichever end comes first."""
    return F.concat(F.lit("f"), short_hash(F.concat_ws("|", F.least(a, b), F.greatest(a, b))))


def discovery_id(kind: Column, line: Column, a: Column, b: Column) -> Column:
    return F.concat(F.lit("d"), short_hash(F.concat_ws("|", kind, line, F.least(a, b), F.greatest(a, b))))


def verdict(shared: Column, idea: Column, explanation: Column) -> Column:
    """shared, with an idea and an explanation; apart, if the answer says so; else unreadable."""
    said = F.lower(F.trim(F.coalesce(shared, F.lit(""))))
    whole = says_something(idea) & says_something(explanation)
    return F.when((said == "true") & whole, "shared").when(said == "false", "apart").otherwise("unreadable")


def judged(answers: DataFrame) -> DataFrame:
    """(run, a, b, verdict, idea, explanation) of the answers (run, pos, a, b, failed, shared, idea,
    explanation) of each run's pairs, in order. A pair whose answer failed was not judged; after
    FAILURES in a row the run ends, and what stands behind is left for the next."""
    # verdicts are told before runs meet, so that only texts that are asked for are dealt and sorted
    read = answers.withColumn("verdict", verdict(F.col("shared"), F.col("idea"), F.col("explanation")))
    w = Window.partitionBy("run").orderBy("pos")
    row = F.sum(F.col("failed").cast("int")).over(w.rowsBetween(1 - FAILURES, 0))
    ended = F.max(row >= FAILURES).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = read.withColumn("ended", F.coalesce(ended, F.lit(False))).where(~F.col("ended") & ~F.col("failed"))
    text = lambda c, n: F.when(F.col("verdict") == "shared", one_line(F.col(c), n)).otherwise("").alias(c)
    return rows.select("run", "a", "b", "verdict", text("idea", IDEA_CHARS), text("explanation", EXPLANATION_CHARS))


def to_judge(pairs: DataFrame, before: DataFrame) -> DataFrame:
    """Pairs (a, b) not to be left alone: those with a readable verdict are known, those with
    UNREADABLE unreadable ones would only fail again."""
    done = before.groupBy("a", "b").agg(F.max(F.col("verdict") != "unreadable").alias("known"), F.count("*").alias("n"))
    gone = done.where(F.col("known") | (F.col("n") >= UNREADABLE)).select("a", "b")
    return pairs.join(gone, ["a", "b"], "left_anti")


def far_discoveries(found: DataFrame, at: Column) -> DataFrame:
    """(id, kind, name, reason, a, b, at): judged pairs with something in common, as discoveries."""
    shared = found.where("verdict = 'shared'")
    ends = [F.col(c).cast("string") for c in ("a", "b")]
    return shared.select(discovery_id(F.lit("far"), F.lit(""), *ends).alias("id"), F.lit("far").alias("kind"), F.col("idea").alias("name"), F.col("explanation").alias("reason"), "a", "b", at.alias("at"))


def has_changes(states: DataFrame, joined: DataFrame) -> DataFrame:
    """One row (changed): whether a snapshot differs from the one before, by its lines' states and
    the points that joined (state `connected`)."""
    either = states.where("state <> 'kept'").select(F.lit(1).alias("x")).unionByName(joined.where("state = 'connected'").select(F.lit(1).alias("x")))
    return either.agg((F.count("*") > 0).alias("changed"))
