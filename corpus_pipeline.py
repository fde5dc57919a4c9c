"""A corpus pipeline of five stages, each written as Parquet and read by the next.

Toxic documents go, one document of each group of near copies stays, documents that hold
benchmark items go, secrets are replaced by a mark, and what is left is encoded.
Documents without an id are kept by every filter. Rows repeated in full share an id and
count as one document, all of whose rows stay or go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import byte_bpe, decontaminate, ngram_join, secrets, toxicity
from lectern.llm.common import crc_mod, new_path, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half; learnt from the labels op3 learns from."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    return toxicity.keep_clean(docs, model)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group at five words and 0.8."""
    found = ngram_join.jaccard_components(docs, 5, 4, 5)
    gone = found.where("component <> doc").select(F.col("doc").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced."""
    return secrets.redact_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document left."""
    import public_tokenizers as P

    return byte_bpe.encode_documents(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


STAGES = [
    ("toxicity", toxic_out),
    ("ngram_join", near_copies_out),
    ("decontaminate", leaks_out),
    ("secrets", secrets_out),
    ("byte_bpe", encoded),
]

#: The stages learn and sketch, so SQL has no form for their rows; tests compare them with
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
