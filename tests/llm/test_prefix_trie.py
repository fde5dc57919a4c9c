"""The trie against dictionaries of prefixes, cut into few and many ranges; odd rows."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lectern.llm import prefix_trie as trie


def nodes_of(convs):
    """{(conv_id, depth): the other columns} by prefixes."""
    at = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            at.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for p in at:
        if p:
            children.setdefault(p[:-1], []).append(p)

    def under(p):
        own = (len(at[p]) - 1) * len(p[-1][1].encode()) if p else 0
        below = [under(q) for q in children.get(p, [])]
        return sum(b[0] for b in below) or 1, own + sum(b[1] for b in below)

    out = {}
    for p, members in at.items():
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(p))
        out[min(members), len(p)] = (min(at[p[:-1]]) if p else None, len(members), len(children.get(p, [])), *under(p), hashlib.sha256(ends.encode()).hexdigest())
    return out


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c in own:
        h = (zlib.crc32(str(c).encode()) & 0xFFFFFFFF) % 9
        out[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    return out


NAMES = ("parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def as_dict(df):
    rows = df.collect()
    got = {(x.conv_id, x.depth): tuple(x[n] for n in NAMES) for x in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_trie(spark, parts):
    """A hot first turn, a hot conversation whose run spans ranges, deep chains and plain ones."""
    r = random.Random(parts)
    rows = []
    for c in range(300):
        if c % 3 == 0:
            turns = ["hot", "same", "end"]
        elif c % 3 == 1:
            turns = ["hot"] + [r.choice("ab") for _ in range(r.randrange(6))]
        else:
            turns = [r.choice("xyz") * r.randrange(3) for _ in range(r.randrange(1, 12))]
        rows += [(c, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(turns)]
    rows += [(998, k, "user", "deep" + str(k % 3)) for k in range(120)] + [(999, k, "user", "deep" + str(k % 3)) for k in range(130)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert as_dict(trie.trie(trie.rebuilt(df), parts)) == nodes_of(rebuilt(rows))
    plain = {}
    for c, _, role, text in rows:
        plain.setdefault(c, []).append((role, text))
    assert as_dict(trie.trie(trie.turn_arrays(df), parts)) == nodes_of(plain)


def test_pieces_of_a_hot_run(spark):
    """Ids of a run that spans ranges are hashed in order, range by range."""
    df = spark.range(500).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.lit("ü").alias("text"))
    got = as_dict(trie.trie(trie.turn_arrays(df), 6))
    ends = hashlib.sha256(",".join(map(str, range(500))).encode()).hexdigest()
    assert got == {(0, 0): (None, 500, 1, 1, 998, hashlib.sha256(b"").hexdigest()), (0, 1): (0, 500, 0, 1, 998, ends)}


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 2, "user", "x" * 200000), (1, 2, "user", "x" * 200000), (2, 0, "", ""), (None, 0, "user", "lost"), (7, 5, "user", "late"), (7, -1, "system", "é"), (10, 0, "user", "only"), (-3, 0, "user", "negative")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"path": F.lit("clash"), "part": F.lit(1), "depth": F.lit(1)})
    plain = {c: [(r, t) for *_, r, t in sorted((t is not None, t or 0, r or "", x or "") for k, t, r, x in rows if k == c)] for c in (1, 2, 7, 10, -3)}
    assert as_dict(trie.trie(trie.turn_arrays(df), 4)) == nodes_of(plain)
    turnless = trie.rebuilt(df).where("size(turns) = 0").count()
    assert turnless and as_dict(trie.trie(trie.rebuilt(df), 4))
    assert trie.trie(trie.rebuilt(df.limit(0))).count() == 0
