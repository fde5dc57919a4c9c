"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score over the words in it
and over these words' beginnings (so that words built on an offending stem count),
and the document's score is their noisy-or, 1 - prod(1 - p), so one offending sentence is
enough. Only documents carry labels; the gradient of the noisy-or passes them on to the
sentences, which then tell where a document offends.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of other scripts' bytes;
general, Latin-1 and CJK punctuation separates them. Sentences end at `.`, `!`, `?` and line
ends; pieces of white space are none, but a text without any other is one sentence. Words,
beginnings and sentences are found on whole byte buffers and known features looked up by
hash, so a text is touched once.

The classifier is fitted on at most `SAMPLE` labelled documents, chosen by the hash of
their ids; its features are the words and beginnings whose document frequency differs
between the labels by at least `Z` standard errors, `FEATURES` at most. Scoring covers every
whole text and moves no rows.

Defined results: null and empty texts are one sentence without words; labels that are null
are left out, several labels of a document count by majority (ties are toxic); without
labels every score is 0, with labels of one kind only the bias is learnt; repeated rows are
scored alike; an empty table gives no rows; further columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash
from .common import crc_mod, lean, short_batches, table, whole_text

SAMPLE = 20_000
FEATURES = 4096
Z = 4.0
STEMS = range(4, 9)
COUNTED = 1 << 21
SIEVE_BITS = 20
_WHOLE = np.uint64(0x5851F42D4C957F2D)
_INSIDE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_MARK = np.isin(np.arange(256), np.frombuffer(b".!?\n", np.uint8))
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


@dataclass
class Model:
    """Weights of features, known by their sorted hashes, and the bias of every sentence."""

    features: np.ndarray
    weights: np.ndarray
    bias: float


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def word_hash(word: bytes) -> int:
    """The feature of a whole word."""
    return int(wordhash.Words(np.frombuffer(word, np.uint8), np.array([0, len(word)])).hash[0] ^ _WHOLE)


def stem_hash(stem: bytes) -> int:
    """The feature of words that begin so."""
    return word_hash(stem) ^ int(_WHOLE)


def inside_words(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to words."""
    inside = _INSIDE[data]
    lead, then = data[:-2], data[1:-1]
    mark = ((lead == 0xE2) & ((then == 0x80) | (then == 0x81))) | ((lead == 0xE3) & (then == 0x80))
    for at, size in ((np.flatnonzero(mark), 3), (np.flatnonzero(data[:-1] == 0xC2), 2)):
        for k in range(size):
            inside[at + k] = False
    return inside


class Sentences(wordhash.Words):
    """Words of some documents and their sentences: sentence s of document `doc[s]` spans bytes
    `first[s]` to `last[s]`, and word w lies in sentence `home[w]`."""

    def __init__(self, data: np.ndarray, doc_starts: np.ndarray):
        super().__init__(data, doc_starts, inside_words(data))
        begins = np.zeros(len(data) + 1, np.int64)
        marks = np.flatnonzero(_MARK[data])
        begins[marks + 1] = 1
        begins[doc_starts[:-1]] = 1
        piece = np.cumsum(begins)[:-1]
        starts = np.flatnonzero(begins[:-1])
        said = np.zeros(len(starts) + 1, bool)
        said[piece[~(_BLANK | _MARK)[data]]] = True
        rows = len(doc_starts) - 1
        first = starts[said[1:]]
        end = np.append(starts[1:], len(data))[said[1:]]
        doc = np.searchsorted(doc_starts, first, "right") - 1
        last = end - (_MARK[data[end - 1]] if len(end) else 0)
        silent = np.setdiff1d(np.arange(rows), doc)
        self.number = np.cumsum(said)[piece] - 1 if len(data) else piece
        self.home = self.number[self.start]
        self.first = np.concatenate([first, doc_starts[:-1][silent]])
        self.last = np.concatenate([last, doc_starts[1:][silent]])
        self.doc = np.concatenate([doc, silent])
        self.rows, self.doc_starts = rows, doc_starts

    def features(self):
        """(words by number, features) of one kind after the other."""
        yield np.arange(len(self.hash)), self.hash ^ _WHOLE
        for size in STEMS:
            yield self.beginnings(size)

    def spans(self, chosen: np.ndarray) -> list[tuple[int, int]]:
        """Character spans of sentences within their documents."""
        chars = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
        base = chars[self.doc_starts[self.doc[chosen]]]
        return list(zip((chars[self.first[chosen]] - base).tolist(), (chars[self.last[chosen]] - base).tolist()))


def _frequencies(batches):
    """Rows of feature, p and n: toxic documents and documents with it, as far as a task has
    counted when its table is full."""
    import pyarrow as pa

    held: list[tuple] = []

    def frame():
        if not held:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, names=["feature", "p", "n"])
        values, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        sums = [np.bincount(at, np.concatenate([h[i] for h in held]), len(values)).astype(np.int64) for i in (1, 2)]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), *map(pa.array, sums)], names=["feature", "p", "n"])

    size = 0
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
        for row, s in wordhash.chunks(batch.column("text"), kind=Sentences):
            words, found = (np.concatenate(x) for x in zip(*s.features()))
            doc = np.searchsorted(s.bounds, words, "right") - 1
            order = np.lexsort((found, doc))
            doc, found = doc[order], found[order]
            once = np.append(True, (np.diff(doc) > 0) | (found[1:] != found[:-1])) if len(doc) else np.zeros(0, bool)
            doc, found = doc[once], found[once]
            values, at = np.unique(found, return_inverse=True)
            held.append((values, np.bincount(at, toxic[row + doc], len(values)), np.bincount(at, minlength=len(values))))
            size += len(values)
            if size > COUNTED:
                yield frame()
                size = 0
    yield frame()


class Lookup:
    """Finds the known features of sentences: a sieve of bits first, then the sorted hashes."""

    def __init__(self, features: np.ndarray):
        self.features = features
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[features >> np.uint64(64 - SIEVE_BITS)] = True

    def __call__(self, s: Sentences) -> tuple[np.ndarray, np.ndarray]:
        """(sentence, feature by number), each once."""
        who, which = [], []
        for words, found in s.features():
            hit = np.flatnonzero(self.sieve[found >> np.uint64(64 - SIEVE_BITS)])
            at = np.minimum(np.searchsorted(self.features, found[hit]), max(len(self.features) - 1, 0))
            sure = self.features[at] == found[hit] if len(hit) else np.zeros(0, bool)
            who.append(s.home[words[hit[sure]]])
            which.append(at[sure])
        size = max(len(self.features), 1)
        pairs = np.unique(np.concatenate(who) * size + np.concatenate(which))
        return pairs // size, pairs % size


def _bags(features: np.ndarray):
    """Rows of toxic, plain (sentences without known features) and the others: how many features each
    has, and the features, as bytes; these rows meet on the driver."""

    def run(batches):
        import pyarrow as pa

        lookup = Lookup(features)
        for batch in batches:
            toxic, out = batch.column("toxic").to_pylist(), []
            for row, s in wordhash.chunks(batch.column("text"), kind=Sentences):
                who, which = lookup(s)
                own: list[dict] = [{} for _ in range(s.rows)]
                for sentence, feature in zip(who.tolist(), which.tolist()):
                    own[s.doc[sentence]].setdefault(sentence, []).append(feature)
                total = np.bincount(s.doc, minlength=s.rows)
                for d, bags in enumerate(own):
                    sizes, found = [len(b) for b in bags.values()], [f for b in bags.values() for f in b]
                    out.append((toxic[row + d], float(total[d] - len(bags)), np.array(sizes, "<i4").tobytes(), np.array(found, "<i4").tobytes()))
            types = {"toxic": pa.int32(), "plain": pa.float64(), "sizes": pa.binary(), "features": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types.values())], names=list(types))

    return run


def coded_bags(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document of each sentence, sentence of each feature, feature) of rows of `_bags`."""
    sizes = [np.frombuffer(r["sizes"], "<i4") for r in rows]
    every = np.concatenate([np.zeros(0, "<i4"), *sizes])
    doc = np.repeat(np.arange(len(rows)), [len(x) for x in sizes])
    feat = np.concatenate([np.zeros(0, "<i4"), *(np.frombuffer(r["features"], "<i4") for r in rows)])
    return doc, np.repeat(np.arange(len(every)), every), feat.astype(np.int64)


class NoisyOr:
    """Mean negative log-likelihood of labelled bags, and its gradient. Bags are lists of sentences'
    features, or their arrays (`coded_bags`)."""

    def __init__(self, toxic: np.ndarray, plain: np.ndarray, bags, features: int, decay: float = 1e-3):
        self.toxic, self.plain, self.size, self.decay = toxic, plain, features, decay
        if isinstance(bags, tuple):
            self.doc, self.sent, self.feat = bags
            return
        self.doc = np.array([d for d, b in enumerate(bags) for _ in b], np.int64)
        self.sent = np.array([s for s, x in enumerate(x for b in bags for x in b) for _ in x], np.int64)
        self.feat = np.array([f for b in bags for x in b for f in x], np.int64)

    def __call__(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        n = len(self.toxic)
        z = theta[-1] + np.bincount(self.sent, theta[self.feat], len(self.doc))
        total = np.maximum(np.bincount(self.doc, softplus(z), n) + self.plain * softplus(theta[-1]), 1e-12)
        loss = np.where(self.toxic == 1, -np.log(-np.expm1(-total)), total).sum() / n + self.decay * (theta[:-1] ** 2).sum() / (2 * n)
        slope = np.where(self.toxic == 1, -1.0 / np.expm1(np.minimum(total, 500.0)), 1.0) / n
        dz = slope[self.doc] / (1.0 + np.exp(-z))
        grad = np.append(np.bincount(self.feat, dz[self.sent], self.size) + self.decay * theta[:-1] / n, dz.sum() + (slope * self.plain).sum() / (1.0 + np.exp(-theta[-1])))
        return float(loss), grad


def fit_bags(toxic: np.ndarray, plain: np.ndarray, bags, features: int, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient descent (Adam) on the noisy-or likelihood."""
    likelihood, rate = NoisyOr(toxic, plain, bags, features), 0.05
    theta = np.zeros(features + 1)
    theta[-1] = -6.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        grad = likelihood(theta)[1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return theta[:-1], float(theta[-1])


def fit(docs: DataFrame, labels: DataFrame, train=None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learn from labelled documents for whose id `train` (a column, default all) holds."""
    short_batches(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if train is not None:
        known = known.where(train)
    known = known.groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    # at most `sample` short rows are sent to all tasks
    bags = texts.join(F.broadcast(chosen), "id").select("toxic", "text").persist()
    try:
        size = bags.groupBy("toxic").count().collect()
        total = {r["toxic"]: r["count"] for r in size}
        pos, neg = total.get(1, 0), total.get(0, 0)
        if not pos + neg:
            return Model(np.zeros(0, np.uint64), np.zeros(0), -np.inf)
        by_word = bags.mapInArrow(lean(_frequencies), "feature long, p long, n long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
        rate_p, rate_n = (F.col("p") + 0.5) / (pos + 1.0), (F.col("n") - F.col("p") + 0.5) / (neg + 1.0)
        pooled = (F.col("n") + 1.0) / (pos + neg + 2.0)
        z = (rate_p - rate_n) / F.sqrt(pooled * (1 - pooled) * (1.0 / (pos + 1) + 1.0 / (neg + 1)))
        best = by_word.where("n >= 3").select("feature", F.abs(z).alias("z")).where(F.col("z") >= Z).orderBy(F.desc("z"), "feature").limit(FEATURES)
        known = np.sort(np.array([r["feature"] for r in best.collect()], np.int64).view(np.uint64))
        rows = bags.mapInArrow(lean(_bags(known)), "toxic int, plain double, sizes binary, features binary").collect()
    finally:
        bags.unpersist()
    toxic, plain = np.array([r["toxic"] for r in rows], np.int64), np.array([r["plain"] for r in rows], float)
    weights, bias = fit_bags(toxic, plain, coded_bags(rows), len(known))
    return Model(known, weights, bias)


class Scorer:
    """Noisy-or scores of documents and the scores of their sentences."""

    def __init__(self, model: Model):
        self.model, self.lookup = model, Lookup(model.features)

    def __call__(self, s: Sentences) -> tuple[np.ndarray, np.ndarray]:
        who, which = self.lookup(s)
        z = self.model.bias + np.bincount(who, self.model.weights[which], len(s.doc)) if len(who) else np.full(len(s.doc), self.model.bias)
        return -np.expm1(-np.bincount(s.doc, softplus(z), s.rows)), z


def _score(model: Model, level: float):
    def run(batches):
        import pyarrow as pa

        scorer = Scorer(model)
        least = np.log(level) - np.log1p(-level)
        for batch in batches:
            scores, spans = [], [[] for _ in range(batch.num_rows)]
            for row, s in wordhash.chunks(batch.column("text"), kind=Sentences):
                own, z = scorer(s)
                scores.append(own)
                bad = np.flatnonzero(z >= least)
                if len(bad):
                    for d, (a, b), p in zip(s.doc[bad].tolist(), s.spans(bad), (1.0 / (1.0 + np.exp(-z[bad]))).tolist()):
                        spans[row + d].append({"start": a, "end": b, "score": p})
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            scores = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores), pa.array(spans, kind)], names=["id", "score", "sentences"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", level: float = 0.5) -> DataFrame:
    """(id, score, sentences): the noisy-or and the spans of sentences at `level` or more."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    out = texts.mapInArrow(lean(_score(model, level)), f"id {kind}, score double, sentences array<struct<start:int,end:int,score:double>>")
    return out.withColumnRenamed("id", id_col)


def _clean(model: Model, text_col: str, threshold: float):
    def run(batches):
        import pyarrow as pa

        scorer = Scorer(model)
        for batch in batches:
            scores = [scorer(s)[0] for _, s in wordhash.chunks(batch.column(text_col), kind=Sentences)]
            yield batch.filter(pa.array(np.concatenate(scores) < threshold, pa.bool_())) if scores else batch

    return run


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose score is below the threshold."""
    return docs.mapInArrow(lean(_clean(model, text_col, threshold)), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    found = score(docs, model)
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("sentences").cast("long").alias("n_offending"))
