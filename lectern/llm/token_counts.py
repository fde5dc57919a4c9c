"""Token counts through a digest cache.

Every text is keyed by the digest of its normalised content and the digest of the
tokenizer file. Keys already in the cache keep their stored count; each distinct missing
text is encoded once and its count is appended. Normalisation must not change the count,
so it only turns null into the empty text.

A tokenizer that never joins a white space to what stands before it (byte-level BPE with its
own pattern) encodes a text piece by piece, each piece from white space to the next: a task has
the library encode a piece once and adds up counts. Other tokenizers get whole texts.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows are kept;
an empty table gives no rows; columns of the input other than the id and the text are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, new_path, table, whole_text, written

SHARE = 1024
#: Pieces whose counts a task keeps, and the longest of them.
KNOWN, PIECE_CHARS = 1 << 19, 64
CHUNK_CHARS = 1_000_000
#: Pieces begin at a plain white space behind what is none. Python's white space holds all that the
#: tokenizers' does, and more; the others of it begin no piece.
PIECE = re.compile(r"\s*\S+(?:[^\S \t\n\r]\s*\S*)*|\s+")
CUT = re.compile(r"(?<=\S)[ \t\n\r]")
CACHE_SCHEMA = "tok string, digest binary, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """Version of a tokenizer: the digest of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _counter(path: str):
    """A function list[str] -> list[int] of a tokenizer file (.json or .model)."""
    if path.endswith(".json"):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        encode = getattr(tok, "encode_batch_fast", tok.encode_batch)
        return lambda texts: [len(e) for e in encode(texts, add_special_tokens=False)]
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(ids) for ids in sp.encode(texts, num_threads=1)]


def encodes_pieces(path: str) -> bool:
    """Whether the counts of a text's pieces (`PIECE`) add up to the text's: nothing changes the text
    beforehand, the byte-level pattern cuts it (no alternative of it goes from other characters on
    to white space), and no added token holds or takes white space or looks at what is beside it."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cut, model, after = spec.get("pre_tokenizer") or {}, spec["model"], spec.get("post_processor") or {}
    plain = spec.get("normalizer") is None and model.get("type") == "BPE" and not model.get("dropout") and after.get("type", "ByteLevel") == "ByteLevel"
    own = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
    return plain and own and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in spec.get("added_tokens", []))


def slices(text: str, chars: int = CHUNK_CHARS):
    """(start, end) of parts of about so many characters, each of whole pieces."""
    at = 0
    while len(text) - at > chars and (cut := CUT.search(text, at + chars)):
        yield at, cut.start()
        at = cut.start()
    yield at, len(text)


def by_pieces(count):
    """A counter of texts from one of pieces. What it has counted it keeps, up to KNOWN pieces."""
    known: dict[str, int] = {}

    def run(texts: list[str]) -> list[int]:
        sums, held, size = [0] * len(texts), [], 0

        def add():
            new = list({p for _, pieces in held for p in pieces if p not in known})
            counted = dict(zip(new, count(new)))
            for i, pieces in held:
                sums[i] += sum(known[p] if p in known else counted[p] for p in pieces)
            if len(known) + len(counted) > KNOWN:
                known.clear()
            known.update((p, n) for p, n in counted.items() if len(p) <= PIECE_CHARS)
            held.clear()

        for i, text in enumerate(texts):
            for a, b in slices(text):
                held.append((i, PIECE.findall(text, a, b)))
                size += b - a
                if size > CHUNK_CHARS:
                    add()
                    size = 0
        add()
        return sums

    return run


def _encode_batches(path: str, chunk_chars: int = CHUNK_CHARS):
    in_pieces = encodes_pieces(path)

    def run(batches):
        import pyarrow as pa

        count = by_pieces(_counter(path)) if in_pieces else _counter(path)
        for batch in batches:
            counts: list[int] = []
            part, size = [], 0
            for text in batch.column("text").to_pylist():
                part.append(text)
                size += len(text)
                if size > chunk_chars:
                    counts += count(part)
                    part, size = [], 0
            counts += count(part) if part else []
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return run


def read_cache(spark: SparkSession, cache_path: str, tok: str) -> DataFrame:
    """Stored counts of one tokenizer version; a cache that is not there yet is empty."""
    from pyspark.errors import AnalysisException

    try:
        cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        cache = spark.createDataFrame([], CACHE_SCHEMA)
    return cache.where(F.col("tok") == tok).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def fill_cache(docs: DataFrame, tokenizer_path: str, cache_path: str, text_col: str = "text") -> str:
    """Encode each distinct text that the cache lacks and append its count; returns the
    tokenizer's version. Texts are dealt by digest after each task has kept one per digest."""
    tok = tokenizer_digest(tokenizer_path)
    keyed = docs.select(whole_text(text_col).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    distinct = keyed.groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(read_cache(docs.sparkSession, cache_path, tok).select("digest"), "digest", "left_anti")
    counted = misses.mapInArrow(_encode_batches(tokenizer_path), "digest binary, n_tokens long")
    counted.select(F.lit(tok).alias("tok"), "digest", "n_tokens").write.mode("append").parquet(cache_path)
    return tok


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row, filling the cache on the way.

    Counts come back by a join on the digest alone. Digests that take more than one row in
    `SHARE` are fewer than `SHARE`, so their counts are sent to all tasks and their rows stay
    where they are; the others are dealt by digest.
    """
    tok = fill_cache(docs, tokenizer_path, cache_path, text_col)
    counts = read_cache(docs.sparkSession, cache_path, tok)
    keyed = docs.select(F.col(id_col), whole_text(text_col).alias("text"))
    slim = written(keyed.select(id_col, F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    common = slim.groupBy("digest").count().where(F.col("count") > -(-slim.count() // SHARE)).select("digest")
    hot = written(common.join(counts, "digest"), "common")
    by_key = slim.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(counts, "digest")
    found = slim.join(F.broadcast(hot), "digest").unionByName(by_key)
    return found.select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents. A tenth of them is counted into the cache beforehand, so the
    query meets stored counts and misses alike."""
    import public_tokenizers

    docs, path, cache = table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), new_path(spark, "token-cache")
    fill_cache(docs.where(crc_mod("doc_id", 10) == 0), path, cache)
    return count_tokens(docs, path, cache)
