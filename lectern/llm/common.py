"""Shared helpers: tables in the cluster's shared folder, scans and row identities."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset a local session,
    whose tasks run on this machine, gets a temporary one; a cluster gets an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: No marker file beside a step's table: nobody waits for it, and on file systems without a native
#: library the driver starts a process for each.
UNMARKED = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Cut lineage: write the rows to the shared folder once and read them back."""
    path = path or new_path(df.sparkSession, name)
    df.write.options(**UNMARKED).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Collect what finished steps left on the driver. Spark removes shuffle files and broadcasts
    only once the objects that stand for them are collected, so many short steps in a row
    otherwise keep their files, and their plans, until memory runs short."""
    gc.collect()
    spark._jvm.java.lang.System.gc()


BATCH_MB = 4


def short_batches(spark: SparkSession) -> None:
    """Lower the session's limit for a batch sent to Python to BATCH_MB. Whole texts are long, and
    a batch is held several times over: by the task, by Arrow outside its heap, and by the worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower().rstrip("b")
    unit = {"k": 1 / 1024, "m": 1, "g": 1024}.get(now[-1])
    size = float(now[:-1]) * unit if unit else float(now) / (1 << 20)
    if not 0 < size <= BATCH_MB:
        spark.conf.set(key, f"{BATCH_MB}m")


def lean(run):
    """`run`, a function over batches, in a worker that returns what it has freed. Workers live on
    from task to task, several beside each executor; large blocks go back to the system at once,
    small ones when the task ends."""

    def task(batches):
        import ctypes

        import pyarrow as pa

        pa.set_memory_pool(pa.system_memory_pool())
        libc = ctypes.CDLL(None)
        tune, trim = getattr(libc, "mallopt", None), getattr(libc, "malloc_trim", None)  # glibc's
        if tune:
            tune(-3, 1 << 20)  # M_MMAP_THRESHOLD
        try:
            yield from run(batches)
        finally:
            if trim:
                trim(0)

    return task


def runs(batches, keys: list[str], values: list[str]):
    """(key, rows) of each run of equal keys in batches that come sorted by key; a run may
    span batches. Memory follows the longest run."""
    key, rows = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in (*keys, *values)]
        for row in zip(*columns):
            now, rest = row[: len(keys)], row[len(keys) :]
            if now != key:
                if rows:
                    yield key, rows
                key, rows = now, []
            rows.append(rest)
    if rows:
        yield key, rows


def record_batches(rows, names: list[str], types: list, most: int = 8192):
    """Tuples as Arrow batches of at most so many rows."""
    import pyarrow as pa

    out: list[tuple] = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    for row in rows:
        out.append(row)
        if len(out) == most:
            yield batch()
            out.clear()
    if out:
        yield batch()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: str = "text") -> Column:
    """The text itself; null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def thinned(df: DataFrame, key: Column, rows: int, among: int) -> DataFrame:
    """About four times `rows` of `among` rows, those with low hashes of `key`: what a
    bounded sample is then taken from, so that tasks need not each send a whole sample."""
    share = min(1.0, 4.0 * rows / max(among, 1))
    return df if share >= 1 else df.where(F.pmod(F.xxhash64(F.lit(11), key), F.lit(1_000_000)) < int(share * 1_000_000) + 1)


def crc_mod(col: str, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo `modulus`; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % modulus, F.lit(0))
