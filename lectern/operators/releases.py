"""Published tables that change as a whole: staged files, a guard, and one rename that swaps them in.

A release is a folder of its own below `releases`; the file CURRENT names the one that readers see.
A write that fails, or is refused because too much would vanish, leaves CURRENT as it was. The
file system's rename replaces the file at once, on HDFS and on local disks alike.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .prices import shrink_guard

CURRENT = "CURRENT"


def _files(spark: SparkSession, path: str):
    fs = spark._jvm.org.apache.hadoop.fs
    return fs.FileContext.getFileContext(fs.Path(path).toUri(), spark._jsc.hadoopConfiguration()), fs


def _current(spark: SparkSession, path: str) -> str | None:
    """The name of the release that readers see."""
    _, fs = _files(spark, path)
    where = fs.Path(f"{path}/{CURRENT}")
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where):
        return None
    stream = system.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()


def published(spark: SparkSession, path: str) -> DataFrame | None:
    """What is published; None before the first release."""
    name = _current(spark, path)
    return None if name is None else spark.read.parquet(f"{path}/releases/{name}")


def publish(rows: DataFrame, path: str, allow_shrink: bool = False) -> str:
    """Stage the rows, check their number against what is published, and swap them in. Returns the
    release's name."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    rows.write.parquet(f"{path}/releases/{name}")
    before = published(spark, path)
    if not allow_shrink:
        shrink_guard(spark.read.parquet(f"{path}/releases/{name}").count(), 0 if before is None else before.count())
    context, fs = _files(spark, path)
    staged = fs.Path(f"{path}/{CURRENT}.{name}")
    out = staged.getFileSystem(spark._jsc.hadoopConfiguration()).create(staged, True)
    try:
        out.write(bytearray(name.encode()))
    finally:
        out.close()
    replace = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    replace[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(staged, fs.Path(f"{path}/{CURRENT}"), replace)
    return name


def drop_old(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete releases but the current one and the newest `keep` others; returns their names."""
    _, fs = _files(spark, path)
    where = fs.Path(f"{path}/releases")
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where):
        return []
    current = _current(spark, path)
    found = sorted(((s.getModificationTime(), s.getPath().getName()) for s in system.listStatus(where)), reverse=True)
    gone = [name for _, name in found if name != current][keep:]
    for name in gone:
        system.delete(fs.Path(f"{path}/releases/{name}"), True)
    return gone
