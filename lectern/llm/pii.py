"""Personal data by patterns and a skip-chain conditional random field.

Patterns find e-mail and IP addresses, card and telephone numbers that hold by themselves.
The other tokens with digits or an at sign are undecided; a conditional random field labels
them. Its nodes are the matches and the undecided tokens of a document; neighbours are tied
along the text, and repeated or similar tokens (equal letters and digits, or one number
ending another) are tied by skip edges however far apart, each to its next occurrence.
Loopy message passing with the matches as evidence then brings the labels of one document
into agreement, and undecided tokens with a sure label become further spans. Every text with
an undecided token takes part, be there a match in it or not.

Both kinds of edges form paths: the text itself, and the occurrences of each key in order.
Messages along all paths of a kind are found exactly in one pass, given those of the other kinds,
so evidence crosses a whole text, and all repeats of a token, in a single round. Rounds follow
until beliefs settle, `ROUNDS` at most; the work is in proportion to the text whatever the weights.

Weights are trained here by pseudo-likelihood on at most `SAMPLE` distinct texts of up to
`MOST_NODES` nodes, with the patterns' matches as distant labels, which undecided repeats of them share. All texts with a match compete for the sample, so matches
are learnt from however rare they are. Scoring covers every whole text and moves no rows.

Defined results: null and empty texts have no spans; equal rows have equal results; without
any match in the table nothing is added; an empty table gives no rows; further columns are
ignored. Spans are in code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, whole_text, written

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 4000
MOST_NODES = 2000
LEVEL = 0.9
SETTLED = 1e-4
ROUNDS, DAMPED = 50, 5
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
# for the JVM: every text with a match holds one of these
MAYBE = r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+\.[A-Za-z0-9-]|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|[0-9](?:[\x20-]?[0-9]){11}|\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = re.compile(r"\S+")
EDGE = ".,;:!?()[]{}<>\"'"
OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of local@domain, leftmost first. Each has one at sign, so the signs are
    visited in turn and the local part is read back from there."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and LOCAL.match(text, start - 1):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            free = m.end()
        else:
            # a failing sign ends the run, so no later local part reaches past it
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of the patterns' matches, sorted."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


class Graph:
    """Nodes of one text: spans, shapes, evidence (label or -1) and edges."""

    def __init__(self, text: str, base: list[tuple[int, int, int]]):
        merged: list[tuple[int, int]] = []
        for a, _, b in base:
            if merged and a < merged[-1][1]:
                merged[-1] = (merged[-1][0], max(merged[-1][1], b))
            else:
                merged.append((a, b))
        starts = [a for a, _ in merged]
        nodes = [(a, b, k + 1) for a, k, b in base]
        for m in TOKEN.finditer(text):
            word = m.group()
            if "@" not in word and not DIGIT.search(word):
                continue
            a = m.start() + len(word) - len(word.lstrip(EDGE))
            b = a + len(word.strip(EDGE))
            k = bisect_left(starts, b)
            if a < b and not (k and merged[k - 1][1] > a):
                nodes.append((a, b, -1))
        nodes.sort()
        self.spans = [(a, b) for a, b, _ in nodes]
        self.label = np.array([x for *_, x in nodes], np.int64)
        self.shape = np.array([shape(text[a:b]) for a, b in self.spans], float).reshape(len(nodes), SHAPES)
        self.chain = [(i, i + 1) for i in range(len(nodes) - 1)]
        self.repeats: list[list[tuple[int, int]]] = [[], []]
        last: dict[str, int] = {}
        for i, (a, b) in enumerate(self.spans):
            keys = similar_keys(text[a:b])
            before = [last.get(k) for k in keys]
            for kind, j in enumerate(before):
                if j is not None and j not in before[:kind]:
                    self.repeats[kind].append((j, i))
            last |= dict.fromkeys(keys, i)
        self.skip = sorted(set(self.repeats[0] + self.repeats[1]), key=lambda e: (e[1], e[0]))


def similar_keys(word: str) -> list[str]:
    """Similar tokens share a key: their letters and digits, or their last nine digits."""
    plain = "".join(c for c in word.lower() if c.isalnum())
    digits = "".join(c for c in plain if c.isdigit())
    return [plain, "#" + digits[-9:]] if len(digits) >= 9 else [plain]


SHAPES = 14


def shape(word: str) -> list[float]:
    digits = sum(c.isdigit() for c in word)
    letters = sum(c.isalpha() for c in word)
    dots, size = word.count("."), len(word)
    return [1.0, float("@" in word), float("+" in word), float(dots == 3), float(0 < dots < 3), float("-" in word or " " in word), float("(" in word), float(letters == 0), float(0 < letters <= digits), float(letters > digits), float(digits < 7), float(7 <= digits < 12), float(12 <= digits <= 19), float(size > 24)]


class Weights:
    def __init__(self, unary: np.ndarray, chain: float, skip: float):
        self.unary, self.chain, self.skip = unary, chain, skip


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


def taught(g: Graph) -> np.ndarray:
    """Distant labels: matches have their kind, undecided tokens that repeat a match (over any
    number of skip edges) have its kind too, all others are none."""
    own = g.label.copy()
    for edges in (g.skip, g.skip[::-1]):
        for i, j in edges:
            if own[i] > 0 > own[j]:
                own[j] = own[i]
            elif own[j] > 0 > own[i]:
                own[i] = own[j]
    return np.maximum(own, 0)


def fit_graphs(graphs: list[Graph], rounds: int = 300, rate: float = 0.1, decay: float = 1e-3) -> Weights:
    """Pseudo-likelihood: each node given its neighbours' labels (see `taught`)."""
    labels = len(KINDS) + 1
    x, y, near, tied = [], [], [], []
    for g in graphs:
        own = taught(g)
        for edges, into in ((g.chain, near), (g.skip, tied)):
            n = np.zeros((len(own), labels))
            for i, j in edges:
                n[i, own[j]] += 1
                n[j, own[i]] += 1
            into.append(n)
        x.append(g.shape)
        y.append(own)
    x, y, near, tied = (np.concatenate(v) for v in (x, y, near, tied))
    unary, pair = np.zeros((SHAPES, labels)), np.zeros(2)
    goal = np.eye(labels)[y]
    for _ in range(rounds):
        d = (_softmax(x @ unary + pair[0] * near + pair[1] * tied) - goal) / len(y)
        unary -= rate * 10 * (x.T @ d + decay * unary)
        pair -= rate * 10 * (np.array([(d * near).sum(), (d * tied).sum()]) + decay * pair)
    return Weights(unary, float(pair[0]), float(pair[1]))


def paths_of(edges: list[tuple[int, int]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, joint) of edges of which no node begins or ends two: the nodes, path by path, and
    whether each is tied to the next in that order."""
    after = np.full(n, -1)
    first = np.ones(n, bool)
    if edges:
        i, j = np.array(edges).T
        after[i] = j
        first[j] = False
    path = np.full(n, -1)
    path[first] = np.arange(first.sum())
    for i, j in edges:  # edges come in the order of their ends, so a path is known from its start
        path[j] = path[i]
    order = np.lexsort((np.arange(n), path))
    joint = np.zeros(n, bool)
    joint[:-1] = after[order[:-1]] == order[1:]
    return order, joint


def _arriving(u: np.ndarray, joint: np.ndarray, gain: float) -> np.ndarray:
    """The message into each node from the one before it, along paths of nodes with likelihoods
    `u`; even where no edge is. A path is cut into about as many blocks as a block has nodes: what
    each block makes of any message is found for all blocks at once, then the messages into the
    blocks one after the other, then those within them, again at once."""
    n, labels = u.shape
    size = int(np.ceil(np.sqrt(n)))
    blocks = -(-n // size)
    u = np.concatenate([u, np.ones((blocks * size - n, labels))]).reshape(blocks, size, labels)
    joint = np.concatenate([joint, np.zeros(blocks * size - n, bool)]).reshape(blocks, size)
    made = np.broadcast_to(np.eye(labels), (blocks, labels, labels))
    for t in range(size):
        x = u[:, t, :, None] * made
        made = np.where(joint[:, t, None, None], x.sum(1, keepdims=True) + gain * x, 1.0)
        made = made / made.max((1, 2), keepdims=True)
    into = np.full((blocks, labels), 1.0 / labels)
    for k in range(blocks - 1):
        m = made[k] @ into[k]
        into[k + 1] = m / m.sum()
    out = np.empty_like(u)
    for t in range(size):
        out[:, t] = into
        x = u[:, t] * into
        m = np.where(joint[:, t, None], x.sum(1, keepdims=True) + gain * x, 1.0)
        into = m / m.sum(1, keepdims=True)
    return out.reshape(-1, labels)[:n]


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum(-1, keepdims=True)


def posteriors(g: Graph, w: Weights) -> np.ndarray:
    """Label probabilities by loopy sum-product, a kind of paths after the other (see above);
    from the DAMPED-th round on messages move half way, against those that swing."""
    local = g.shape @ w.unary
    held = g.label >= 0
    local[held] = -50.0
    local[held, g.label[held]] = 50.0
    own = _softmax(local)
    n = len(own)
    kinds = [(g.chain, w.chain)] + [(e, w.skip) for e in g.repeats]
    paths = [(*paths_of(e, n), np.expm1(pull)) for e, pull in kinds if e]
    sent = [np.ones((2, *own.shape)) for _ in paths]
    belief = own
    for r in range(ROUNDS if paths else 0):
        for k, (order, joint, gain) in enumerate(paths):
            u = own.copy()
            for j, m in enumerate(sent):
                if j != k:
                    u = _scaled(u * m[0] * m[1] + 1e-300)
            u = u[order]
            back = np.concatenate([joint[-2::-1], [False]]) if n > 1 else joint
            new = np.empty_like(sent[k])
            new[0, order] = _arriving(u, joint, gain)
            new[1, order] = _arriving(u[::-1], back, gain)[::-1]
            sent[k] = new if r < DAMPED else _scaled(np.sqrt(new * sent[k]))
        before, belief = belief, own
        for m in sent:
            belief = _scaled(belief * m[0] * m[1] + 1e-300)
        if np.abs(belief - before).max() < SETTLED:
            break
    return belief


def find(text: str, weights: Weights | None, level: float = LEVEL) -> tuple[list, list]:
    """Base spans and all spans of one text."""
    base = base_spans(text)
    if weights is None or not ("@" in text or DIGIT.search(text)):
        return base, base
    g = Graph(text, base)
    if (g.label < 0).any():
        p = posteriors(g, weights)
        kind = p[:, 1:].argmax(1)
        more = [(*g.spans[i][:1], int(kind[i]), g.spans[i][1]) for i in np.flatnonzero((g.label < 0) & (p[np.arange(len(p)), kind + 1] >= level))]
        return base, sorted(base + more)
    return base, base


def _marks(batches):
    """Rows of h and held: whether the patterns match; texts that cannot match come as null."""
    import pyarrow as pa

    for batch in batches:
        held = [t is not None and bool(base_spans(t)) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(held, pa.bool_())], names=["h", "held"])


def _graphs(last: dict[bool, int]):
    """Graphs of texts up to the last hash among those with matches or without; a task sends
    each on once."""

    def run(batches):
        import pandas as pd

        seen: set[int] = set()
        for pdf in batches:
            rows = []
            for t, h in zip(pdf["text"], pdf["h"].tolist()):
                if h in seen or h > last[bool(base := base_spans(t))]:
                    continue
                seen.add(h)
                g = Graph(t, base)
                if len(g.label) > MOST_NODES:
                    continue
                rows.append((h, g.label.tolist(), g.shape.ravel().tolist(), [i for e in g.skip for i in e]))
            yield pd.DataFrame(rows, columns=["h", "label", "shape", "skip"]).astype({"h": "int64"})

    return run


def fit(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Weights | None:
    """Weights from at most `sample` distinct texts with a digit or an at sign, by hash. Texts
    with a match are chosen among all those of the table, half the sample at least where there
    are as many; None only where the whole table has no match."""
    texts = docs.select(whole_text(text_col).alias("text")).where(F.col("text").rlike("[0-9@]"))
    texts = texts.withColumn("h", F.xxhash64("text"))
    maybe = F.col("text").rlike(MAYBE)
    marks = texts.select("h", F.when(maybe, F.col("text")).alias("text")).mapInArrow(_marks, "h long, held boolean").distinct()
    marks = written(marks, "pii-marks")
    low = {x: [r.h for r in marks.where(F.col("held") == x).select("h").orderBy("h").limit(sample).collect()] for x in (True, False)}
    if not low[True]:
        return None
    others = min(len(low[False]), max(sample // 2, sample - len(low[True])))
    low = {True: low[True][: sample - others], False: low[False][:others]}
    last = {x: h[-1] if h else -(2**63) - 1 for x, h in low.items()}
    chosen = F.col("h") <= last[False] if low[False] else F.lit(False)
    chosen = texts.where(chosen | (maybe & (F.col("h") <= last[True])))
    rows = chosen.mapInPandas(_graphs(last), "h long, label array<int>, shape array<double>, skip array<int>").dropDuplicates(["h"]).collect()
    graphs = []
    for r in sorted(rows, key=lambda r: r["h"]):
        g = Graph("", [])
        g.label = np.array(r["label"], np.int64)
        g.shape = np.array(r["shape"], float).reshape(-1, SHAPES)
        g.chain = [(i, i + 1) for i in range(len(g.label) - 1)]
        g.skip = list(zip(r["skip"][::2], r["skip"][1::2]))
        graphs.append(g)
    return fit_graphs(graphs)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(weights: Weights | None):
    def run(batches):
        import pyarrow as pa

        clean = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            counts, digests, spans = [[], [], [], []], [], []
            for text in batch.column("text").to_pylist():
                base, every = find(text, weights)
                for k in range(4):
                    counts[k].append(sum(x[1] == k for x in base))
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest() if base else clean)
                spans.append(listed(every))
            columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in OUT.split(", ")])

    return run


def scan(docs: DataFrame, weights: Weights | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(_scan(weights), OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, fit(docs))
