"""The audit against removing documents one by one, and polynomials against sums over orders."""

import random
from itertools import permutations

from pyspark.sql import functions as F

from lectern.llm import filter_audit


def by_hand(docs, labels):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    rows = {}
    for i, t, s in docs:
        t = t or ""
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t) if x]
        up = sum("A" <= c <= "Z" for c in t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * up > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and first[t] < i}
        rows.setdefault(s or "", []).append((fails, *labels.get(i, (0, 0))))
    out = {}
    for part, own in rows.items():
        removed = {}
        for o in map("".join, permutations("ABCDE")):
            left = own
            for k, f in enumerate(o, 1):
                here = [d for d in left if d[0][f]]
                left = [d for d in left if not d[0][f]]
                removed[f] = removed.get(f, 0) + len(here)
                out[part, o, k] = [len(left), len(here), sum(d[0][f] for d in own) - len(here), sum(d[0][f] and sum(d[0].values()) == 1 for d in own), sum(d[1] for d in here), sum(d[2] for d in here), f]
        for key, v in out.items():
            if key[0] == part:
                v[6] = removed[v[6]]
    return {k: tuple(v) for k, v in out.items()}


NAMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit(spark):
    r = random.Random(2)
    bases = [" ".join(r.choice(["sun", "Moon", "RIVER", "a$", "x"]) + (str(r.randrange(400)) if wide else "") for _ in range(n)) for n in (3, 150, 199, 200, 260) for wide in (0, 1, 1)] + ["", " \t\n", None, "Ünï \U0001f600 é" * 60, "lower words only " * 80]
    docs = [(i if i % 17 else None, r.choice(bases), r.choice(["p", "q", "", None])) for i in range(300)]
    docs += docs[5:15] + [(5, docs[5][1], "q")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 300, 2)]
    labels += [(2, 1, 1), (None, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({"part": F.lit("clash"), "mask": F.lit(3), "n": F.lit(1)})
    marks = {}
    for i, q, t in labels:
        if i is not None:
            a, b = marks.get(i, (0, 0))
            marks[i] = (max(a, int(q == 1)), max(b, int(t == 1)))
    got = filter_audit.audit(filter_audit.mask_counts(filter_audit.failure_masks(df, "source"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert {(x.part, x.filter_order, x.step): tuple(x[n] for n in NAMES) for x in got.collect()} == by_hand(docs, marks)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.mask_counts(filter_audit.failure_masks(docs, "source"), labels)).count() == 0


def test_parts_without_failures(spark):
    counts = spark.createDataFrame([("p", 0, 7, 2, 1)], "part string, mask int, n long, good long, toxic long")
    got = filter_audit.audit(counts).collect()
    assert len(got) == 600 and {tuple(x[n] for n in NAMES) for x in got} == {(7, 0, 0, 0, 0, 0, 0)}
