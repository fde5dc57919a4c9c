"""An inbox of mark files as a stream: files are applied in the order of their names, bad ones go
to quarantine, and a batch that is run again changes nothing.

Each micro-batch writes two tables of its own, named by its number and replaced if the batch is run
again after a crash: what its files say, and which files could not be read. What holds at any
time is a fold over all that was applied, by the names of the files and not by when they came, so
a late file does not undo a newer one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = "marks"
FILE = "format string, items array<struct<asin:string,tag:string,rating:string>>"
APPLIED = "file string, pos int, asin string, tag string, rating int"
TAGS = ("seen", "skipped", "want")


def read_files(files: DataFrame) -> DataFrame:
    """(file, items) of whole files (file, text); items is null where a file is no list of marks."""
    plain = F.regexp_replace("text", "^﻿", "")
    read = files.select("file", F.from_json(plain, FILE).alias("f"))
    return read.select("file", F.when(F.col("f.format") == FORMAT, F.col("f.items")).alias("items"))


def marks_of(read: DataFrame) -> DataFrame:
    """APPLIED: the marks of readable files. A mark needs a book; a tag that is none is null and
    takes the mark away; stars are only for what was read."""
    items = read.where("items is not null").select("file", F.posexplode("items").alias("pos", "i"))
    tag = F.when(F.col("i.tag").isin(*TAGS), F.col("i.tag"))
    stars = F.col("i.rating").try_cast("int")
    rows = items.select("file", "pos", F.trim("i.asin").alias("asin"), tag.alias("tag"), F.when((tag == "seen") & stars.between(1, 5), stars).alias("rating"))
    return rows.where("asin <> ''")


def apply_batch(files: DataFrame, batch: int, folder: str) -> None:
    """One micro-batch of whole files (file, text)."""
    read = read_files(files).persist()
    marks_of(read).write.mode("overwrite").parquet(f"{folder}/applied/batch={batch}")
    read.where("items is null").select("file").write.mode("overwrite").parquet(f"{folder}/quarantine/batch={batch}")
    read.unpersist()


def follow(spark: SparkSession, inbox: str, folder: str, pattern: str = "*.json", at_once: int = 100):
    """The running query over an inbox folder; `folder` holds its tables and its checkpoint, and
    `at_once` bounds the files a batch takes, so a flood waits in the inbox."""
    files = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", at_once).option("pathGlobFilter", pattern).load(inbox)
    named = files.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.col("value").alias("text"))
    return named.writeStream.foreachBatch(lambda df, n: apply_batch(df, n, folder)).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def applied(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(APPLIED).parquet(f"{folder}/applied")


def quarantined(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("file string").parquet(f"{folder}/quarantine")


def current(rows: DataFrame) -> DataFrame:
    """(asin, tag, rating): the last mark of each book by file and place in it; books whose mark was
    taken away are left out."""
    last = rows.groupBy("asin").agg(F.max_by(F.struct("tag", "rating"), F.struct("file", "pos")).alias("m"))
    return last.where("m.tag is not null").select("asin", "m.tag", "m.rating")
