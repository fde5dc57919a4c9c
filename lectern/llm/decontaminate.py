"""Benchmark decontamination: near occurrences of benchmark items inside documents.

Words are symbols. An item of w words leaks where a stretch of a document lies within edit
distance floor((1 - similarity) * w) of it.

1. Windows of each item size slide over every document, one start per word. A window
   within edit distance d of an item shares at least w - 2 - 3d word triples with it; windows
   that share so many with no item are sieved out without loss.
2. CGK random walks embed the windows left and the items: at each of 3w steps the current
   word is written and a random bit of (step, word) says whether to move on. Edit distance
   becomes Hamming distance. Several independent walks share the repetitions.
3. Bit sampling generates the candidates: each repetition looks a few sampled positions of a
   window up among the samples of all items of its size, and those that agree on a whole sample
   are its candidates. The repetitions follow from the target recall.
4. Candidates are verified by exact edit distance over the window with d words more on
   either side, any stretch of which may match.

Items shorter than `min_words` allow no edit worth the name; they are found where their words
stand in a document exactly, by the hash of their word sequence.

The benchmark is sent to all tasks in blocks of bounded size, a few of them at a time;
documents are read once per block and nothing is shuffled.

Defined results: null or empty texts and items without words match nothing; repeated rows and
repeated items are reported each; an empty benchmark or document table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce
from math import ceil, log

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash
from .common import lean, table, written

SIMILARITY = 0.8
MIN_WORDS = 8
RECALL = 0.99
AGREE = 0.45  # share of embedded positions at which a window at the allowed distance agrees, measured
SAMPLED = 3
STEPS = 3
WALKS = 3
AT_ONCE = 4
BLOCK_BYTES = 8 << 20
TABLE_BITS = 22
OUT = "doc_id long, item_id long, edit_distance int, n_words int, start_word long"


def repetitions(recall: float = RECALL, agree: float = AGREE, sampled: int = SAMPLED) -> int:
    return ceil(log(1 - recall) / log(1 - agree**sampled))


def triple_hashes(words: np.ndarray) -> np.ndarray:
    return wordhash.mix(words[:-2] * wordhash.MULT[20] + words[1:-1] * wordhash.MULT[21] + words[2:] * wordhash.MULT[22])


def cgk(windows: np.ndarray, seed: int = 1) -> np.ndarray:
    """CGK embedding of rows of word hashes into STEPS times as many words; a walk past
    the end writes zeros."""
    n, w = windows.shape
    padded = np.concatenate([windows, np.zeros((n, 1), np.uint64)], 1)
    at, rows = np.zeros(n, np.int64), np.arange(n)
    out = np.empty((n, STEPS * w), np.uint64)
    for step in range(STEPS * w):
        now = padded[rows, at]
        out[:, step] = now
        salt = np.uint64((step + 1) * 0x9E3779B97F4A7C15 * (2 * seed + 1) % 2**64)
        at = np.minimum(at + (wordhash.mix(now ^ salt) & np.uint64(1)).astype(np.int64), w)
    return out


def edit_distance_within(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance of `item` to any stretch of `text`, and where that ends."""
    prev = np.arange(len(item) + 1)
    best, end = int(prev[-1]), 0
    ramp = np.arange(len(item) + 1)
    for j, word in enumerate(text.tolist()):
        row = np.empty_like(prev)
        row[0] = 0
        row[1:] = np.minimum(prev[1:] + 1, prev[:-1] + (item != np.uint64(word)))
        row = np.minimum.accumulate(row - ramp) + ramp
        if row[-1] < best:
            best, end = int(row[-1]), j + 1
        prev = row
    return best, end


def sequences(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    total = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        total += words[k : len(words) - n + 1 + k] * wordhash.MULT[40 + k]
    return wordhash.mix(total)


class Matcher:
    """A block of benchmark items, ready to be searched for."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY, min_words: int = MIN_WORDS):
        self.items: list[tuple[int, np.ndarray, int]] = []
        self.triples: list[np.ndarray] = []
        self.least: list[int] = []
        self.need: dict[int, int] = {}
        self.postings: dict[int, list[int]] = {}
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.short: dict[int, dict[int, list[int]]] = {}
        for item_id, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            words = wordhash.Words(raw, np.array([0, len(raw)])).hash
            w = len(words)
            if w < max(min_words, 3):
                if w:
                    self.short.setdefault(w, {}).setdefault(int(sequences(words, w)[0]), []).append(item_id)
                continue
            allowed = int((1 - similarity) * w + 1e-9)
            own = np.unique(triple_hashes(words))
            for t in own.tolist():
                self.postings.setdefault(t, []).append(len(self.items))
            self.need[w] = max(1, w - 2 - 3 * allowed)
            self.least.append(max(1, self.need[w] - (w - 2 - len(own))))
            self.items.append((item_id, words, allowed))
            self.triples.append(own)
            self.table[own >> np.uint64(64 - TABLE_BITS)] = True
        rng = np.random.Generator(np.random.PCG64(7))
        self.samples = {w: rng.integers(0, STEPS * w, (repetitions(), SAMPLED)) for w in sorted(self.need)}
        #: per size, the samples of all items of that size: sorted keys and their items
        self.keys: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for w in self.samples:
            own = [i for i, (_, words, _) in enumerate(self.items) if len(words) == w]
            keys = self._keys(np.stack([self.items[i][1] for i in own]))
            order = np.argsort(keys, axis=None, kind="stable")
            self.keys[w] = keys.ravel()[order], np.repeat(own, keys.shape[1])[order]

    def _keys(self, windows: np.ndarray) -> np.ndarray:
        """One key per repetition of every row of words."""
        sample = self.samples[windows.shape[1]]
        out = np.empty((len(windows), len(sample)), np.uint64)
        for walk in range(WALKS):
            own = np.arange(walk, len(sample), WALKS)
            embedded = cgk(windows, walk + 1)
            out[:, own] = (embedded[:, sample[own]] * wordhash.MULT[30 : 30 + SAMPLED]).sum(2, dtype=np.uint64)
        return wordhash.mix(out + np.arange(len(sample), dtype=np.uint64) * wordhash.MULT[33])

    def _windows(self, w: int, voted: list[int], words: np.ndarray, triples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and words of the windows of one size that share enough triples with some item."""
        starts = np.zeros(0, np.int64)
        for i in voted:
            sums = np.concatenate([[0], np.cumsum(np.isin(triples, self.triples[i]))])
            if len(words) < w:  # a document shorter than the item is one window
                starts = np.union1d(starts, np.zeros(int(sums[-1] >= self.need[w]), np.int64))
            else:
                starts = np.union1d(starts, np.flatnonzero(sums[w - 2 :] - sums[: len(sums) - w + 2] >= self.need[w]))
        padded = np.concatenate([words, np.zeros(max(0, w - len(words)), np.uint64)])
        return starts, padded[starts[:, None] + np.arange(w)]

    def search(self, words: np.ndarray, triples: np.ndarray, hit: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, words of the item, start) of the items found in a document;
        hit[i] says whether triple i may be one of the block."""
        votes: dict[int, int] = {}
        for t in np.unique(triples[hit]).tolist():
            for i in self.postings.get(t, ()):
                votes[i] = votes.get(i, 0) + 1
        sizes = defaultdict(list)
        for i, v in votes.items():
            if v >= self.least[i]:
                sizes[len(self.items[i][1])].append(i)
        found = []
        for w, voted in sorted(sizes.items()):
            starts, windows = self._windows(w, voted, words, triples)
            met: dict[int, list[int]] = {}
            known, owners = self.keys[w]
            for at in range(0, len(starts), 4096):
                keys = self._keys(windows[at : at + 4096])
                lo, hi = np.searchsorted(known, keys, "left"), np.searchsorted(known, keys, "right")
                rows, reps = np.nonzero(hi > lo)
                for row, a, b in zip(rows.tolist(), lo[rows, reps].tolist(), hi[rows, reps].tolist()):
                    for i in owners[a:b].tolist():
                        met.setdefault(i, []).append(int(starts[at + row]))
            for i, own in sorted(met.items()):
                d, start = self._verified(i, np.unique(own), words)
                if d <= self.items[i][2]:
                    found.append((self.items[i][0], d, w, start))
        return found

    def _verified(self, i: int, starts: np.ndarray, words: np.ndarray) -> tuple[int, int]:
        """Least edit distance of an item at its candidate windows, and where."""
        _, own, allowed = self.items[i]
        w = len(own)
        best = (allowed + 1, 0)
        for run in np.split(starts, np.flatnonzero(np.diff(starts) > w) + 1):
            a, b = max(0, int(run[0]) - allowed), int(run[-1]) + w + allowed
            d, end = edit_distance_within(own, words[a:b])
            best = min(best, (d, max(0, a + end - w)))
        return best

    def search_short(self, words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item_id, 0, words of the item, start) of short items, once a document."""
        found = {}
        for w, table in self.short.items():
            hashes = sequences(words, w)
            at = np.flatnonzero(np.isin(hashes, np.array(list(table), np.uint64)))
            doc = np.searchsorted(bounds, at, "right") - 1
            inside = at + w <= bounds[doc + 1]
            for k, d in zip(at[inside].tolist(), doc[inside].tolist()):
                for item_id in table[int(hashes[k])]:
                    found.setdefault((d, item_id, w), k - int(bounds[d]))
        # items that are repeated in the benchmark are reported each
        return [(d, i, 0, w, start) for (d, i, w), start in found.items() for _ in range(max(1, sum(ids.count(i) for ids in self.short[w].values())))]


def _documents_with_windows(hit: np.ndarray, bounds: np.ndarray, need: dict[int, int]) -> np.ndarray:
    """Documents that may hold a window with enough triples, of some of the sizes."""
    sums = np.concatenate([[0], np.cumsum(hit, dtype=np.int32)])
    inside = sums[np.minimum(bounds, len(hit))]
    docs = np.flatnonzero(np.diff(inside) >= min(need.values()))
    if not len(docs):
        return docs
    begun = np.zeros(len(hit), bool)
    for w, least in need.items():
        span = min(w - 2, len(hit))
        begun[: len(hit) - span + 1] |= sums[span:] - sums[: len(sums) - span] >= least
    # a window may begin in the document before, where that one's triples do no harm
    starts = np.flatnonzero(begun)
    ends = np.minimum(starts + max(need), len(hit))
    near = np.zeros(len(bounds), np.int64)
    np.add.at(near, np.maximum(np.searchsorted(bounds, starts, "right") - 1, 0), 1)
    np.add.at(near, np.minimum(np.searchsorted(bounds, ends, "right"), len(near) - 1), -1)
    return docs[np.cumsum(near)[docs] > 0]


def _matches(matcher: Matcher, column):
    """(row, item_id, distance, words, start) of every item found in a column of texts."""
    shift = np.uint64(64 - TABLE_BITS)
    for first, w in wordhash.chunks(column):
        if matcher.short and len(w.hash):
            for k, *found in matcher.search_short(w.hash, w.bounds):
                yield first + k, *found
        if len(w.hash) < 3 or not matcher.items:
            continue
        triples = triple_hashes(w.hash)
        hit = matcher.table[triples >> shift]
        cuts = w.bounds[1:-1]
        for back in (1, 2):
            at = cuts - back
            hit[at[(at >= 0) & (at < len(hit))]] = False
        for k in _documents_with_windows(hit, w.bounds, matcher.need).tolist():
            a, b = int(w.bounds[k]), int(w.bounds[k + 1])
            for found in matcher.search(w.hash[a:b], triples[a : b - 2], hit[a : b - 2]):
                yield first + k, *found


def _search(items: list[tuple[int, str]], similarity: float, min_words: int):
    def run(batches):
        import pyarrow as pa

        matcher = Matcher(items, similarity, min_words)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = [(ids[k], *x) for k, *x in _matches(matcher, batch.column("text"))]
            cols = list(zip(*rows)) or [[]] * 5
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "item_id", "edit_distance", "n_words", "start_word"])

    return run


def find_leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, edit_distance, n_words, start_word) of every item found."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts: list[DataFrame] = []
    for block in blocks(items, item_col, item_text):
        if len(parts) >= AT_ONCE:  # the driver holds no more blocks than these
            parts = [written(reduce(DataFrame.unionByName, parts), "leaks")]
        parts.append(texts.mapInArrow(lean(_search(block, similarity, min_words)), OUT))
    return reduce(DataFrame.unionByName, parts)


def blocks(items: DataFrame, item_col: str = "item_id", item_text: str = "text"):
    """The items in lists of about BLOCK_BYTES, one at least."""
    block: list[tuple[int, str]] = []
    size = 0
    for row in items.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t")).where("t is not null").toLocalIterator():
        if block and size + len(row.t) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row.i, row.t))
        size += len(row.t)
    yield block


def _without(items: list[tuple[int, str]], similarity: float, min_words: int, text_col: str):
    def run(batches):
        import pyarrow as pa

        matcher = Matcher(items, similarity, min_words)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[k for k, *_ in _matches(matcher, batch.column(text_col))]] = False
            yield batch.filter(pa.array(keep))

    return run


def drop_leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, min_words: int = MIN_WORDS, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, in which no item is found."""
    for n, block in enumerate(blocks(items)):
        if n and n % AT_ONCE == 0:
            docs = written(docs, "clean")
        docs = docs.mapInArrow(lean(_without(block, similarity, min_words, text_col)), docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
