"""Outcomes of jobs that are followed by polling, as a stream with event-time timers and as a batch.

A row is an answer to a poll: (job, id, ts, state), state being `running`, `failed` (no answer) or
one that ends the job. A job is `lost` after so many failures in a row, or when nothing is heard
of it for the wait that its failures allow: the poll interval, doubled with each, up to a limit.
What ends a job is its outcome: `done`, `error`, or `interrupted` for any other. The next row of a
job begins a new run of it.

Both forms fold a job's rows in order with a state of three numbers; the stream keeps it between
micro-batches, the batch reads the rows sorted, so no job is ever held as a list.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FAILURES = 8
INTERVAL, LONGEST = 1.5, 30.0
OUT = "job long, began timestamp, ended timestamp, outcome string"
STATE = "began long, last long, failures int"
NAMES = ["job", "began", "ended", "outcome"]
ENDS = {"done": "done", "error": "error", "failed": "lost"}


class Run:
    """A run of a job: microseconds of its first and last answer, and failures in a row."""

    def __init__(self, job: int, slack: float, most: int, began: int | None = None, last: int = 0, failures: int = 0):
        self.job, self.slack, self.most = job, slack, most
        self.began, self.last, self.failures = began, last, failures

    def due(self) -> int:
        """When the wait for the next answer is over."""
        return self.last + int((min(LONGEST, INTERVAL * 2**self.failures) + self.slack) * 1e6)

    def ended(self, outcome: str) -> tuple:
        row = (self.job, pd.Timestamp(self.began, unit="us"), pd.Timestamp(self.last, unit="us"), outcome)
        self.began = None
        return row

    def silent(self, now: int) -> Iterator[tuple]:
        if self.began is not None and now > self.due():
            yield self.ended("lost")

    def answer(self, now: int, state: str) -> Iterator[tuple]:
        yield from self.silent(now)
        if self.began is None:
            self.began, self.failures = now, 0
        self.last, self.failures = now, self.failures + 1 if state == "failed" else 0
        if state not in ("running", "failed") or self.failures >= self.most:
            yield self.ended(ENDS.get(state, "interrupted"))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=NAMES).astype({"began": "datetime64[us]", "ended": "datetime64[us]"})


def outcomes(polls: DataFrame, slack: float = 5.0, most: int = FAILURES, late: str = "0 seconds") -> DataFrame:
    """The outcomes of a stream of answers, each as soon as it is known; a run of which nothing is
    heard any more ends by its timer once the watermark has passed."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, out = Run(int(key[0]), slack, most, *(state.get if state.exists else ())), []
        if state.hasTimedOut:
            out.append(run.ended("lost"))
        else:
            for r in pd.concat(list(batches)).sort_values(["us", "id"]).itertuples(index=False):
                out += run.answer(int(r.us), r.state)
        if run.began is not None:
            state.update((run.began, run.last, run.failures))
            state.setTimeoutTimestamp(max(run.due() // 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield _frame(out)

    ts = F.col("ts").cast("timestamp")
    rows = polls.select("job", "id", ts.alias("ts"), F.unix_micros(ts).alias("us"), "state").withWatermark("ts", late)
    return rows.groupBy("job").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def outcomes_batch(polls: DataFrame, slack: float = 5.0, most: int = FAILURES) -> DataFrame:
    """The outcomes of a finished history. What was still going on when it ends is lost if its wait
    is over by then, and left out else."""
    rows = polls.select("job", "id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "state")
    end = rows.agg(F.max("us")).first()[0]

    def fold(batches):
        run = None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if run is None or run.job != r.job:
                    out += run.silent(end) if run else ()
                    run = Run(r.job, slack, most)
                out += run.answer(r.us, r.state)
            yield _frame(out)
        if run:
            yield _frame(list(run.silent(end)))

    return rows.repartition("job").sortWithinPartitions("job", "us", "id").mapInPandas(fold, OUT)
