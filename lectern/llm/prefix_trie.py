"""Conversation prefix trie: shared beginnings of conversations as the nodes of a tree.

A conversation is an array of turns, each a 128-bit digest of role and text. The arrays are
sorted over the whole table (range by range, `ranges.py`); then a node of the trie is an interval
of neighbours that share its turns, and the longest common prefix (LCP) of neighbours says where
nodes begin and end. A sweep over a range keeps the stack of nodes that hold the current array,
pops those longer than the LCP with the next array and folds them into their parents.

All a node tells is a sum or a minimum over its rows once the LCP with the row before (L) and
after (M) is known:

* a row begins the nodes deeper than L, each a new child of the node above it;
* a row's array is a childless node, and this its last row, if M is less than its depth;
* a node counted n times saves (n - 1) times the bytes of its last turn: n per row, less one
  where the node begins.

So nodes that reach over the cut of a range, those on the stack at its first or last row, are
emitted as partial sums and stitched by a grouped sum over their key; the two neighbour rows of
each range give L and M at the cuts. Ids of conversations that end at such a node are sent on
in pieces and hashed in order, piece by piece. A parent's id is looked up within the range, so
a node with very many children is no hot key.

Defined results: null roles and texts are empty; rows without a conv_id are left out; equal
`turn` are taken by digest, and rows repeated in full are turns of their own; a conversation
without turns is a member of the root only; an empty table gives no nodes; further columns are
ignored. An array of one conversation is one record (16 bytes a turn): texts are not kept, so very
long ones cost nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import record_batches, table, written
from .ranges import in_ranges, with_neighbours

DIGEST = 16
FAMILY = 5
MOST_SHARED = 8
PIECE = 4096
ROOT = b"\0" * DIGEST
CLOSED, OPEN, ENDS = 0, 1, 2


def turn_arrays(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns in order, as structs ending in their digest and bytes."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    turns = rows.where("conv_id is not null").select("conv_id", F.struct(F.col("turn").isNotNull(), F.coalesce(F.col("turn"), F.lit(0)), digest.alias("digest"), F.octet_length(text).alias("bytes")).alias("t"))
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def rebuilt(rows: DataFrame) -> DataFrame:
    """(conv_id, turns) as the contract rebuilds them: a family of five shares the beginning of
    its first conversation."""
    own = turn_arrays(rows)
    base = own.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, MOST_SHARED).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 9).cast("int")
    all_ = own.join(base, F.col("conv_id") - F.col("conv_id") % FAMILY == F.col("base"), "left")
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    head = F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", F.lit(1), h))
    return all_.select("conv_id", F.concat(head, rest).alias("turns"))


SWEPT = "kind int, part int, key binary, above binary, depth long, conv_id long, n long, children long, leaves long, saved long, ends string, seq int, piece string"


class _Node:
    __slots__ = ("key", "size", "left", "new", "conv", "n", "children", "leaves", "saved", "ids")

    def __init__(self, key, size, left, new):
        self.key, self.size, self.left, self.new = key, size, left, new
        self.conv, self.n, self.children, self.leaves, self.saved, self.ids = None, 0, 0, 0, 0, []


def _lcp(a: bytes | None, b: bytes | None) -> int:
    """Turns two arrays share at their beginnings; -1 where there is no neighbour."""
    if a is None or b is None:
        return -1
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // DIGEST
    k = 0
    while a[k : k + DIGEST] == b[k : k + DIGEST]:
        k += DIGEST
    return k // DIGEST


def _hash_of(ids: list[int]) -> str:
    import hashlib

    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def _sweep_range(part: int, rows):
    """Rows of SWEPT for one range: (path, sizes, conv_id, ghost) in order."""
    import hashlib

    stack: list[_Node] = []
    before, last = None, None

    def pop(right: bool):
        v, depth = stack.pop(), len(stack)
        v.saved += v.n * v.size - (v.size if v.new else 0)
        above = None
        if stack:
            up = stack[-1]
            above = up.key
            up.conv = v.conv if up.conv is None else min(up.conv, v.conv)
            up.n, up.leaves, up.saved, up.children = up.n + v.n, up.leaves + v.leaves, up.saved + v.saved, up.children + v.new
        kind = OPEN if right or v.left else CLOSED
        yield (kind, part, v.key, above, depth, v.conv, v.n, v.children, v.leaves, v.saved, None if kind == OPEN else _hash_of(v.ids), None, None)
        if kind == OPEN:
            for k in range(0, len(v.ids), PIECE):
                yield (ENDS, part, v.key, None, depth, None, 0, 0, 0, 0, None, k // PIECE, ",".join(map(str, v.ids[k : k + PIECE])))

    for path, sizes, conv, ghost in rows:
        if ghost and last is None:
            before = path
            continue
        first = last is None
        shared = _lcp(before if first else last, path)
        if not first:
            if shared < len(last) // DIGEST:
                stack[-1].leaves += 1
            while len(stack) - 1 > shared:
                yield from pop(ghost and len(stack) - 1 <= shared)
        if ghost:
            while stack:
                yield from pop(True)
            return
        while len(stack) <= len(path) // DIGEST:
            d = len(stack)
            key = hashlib.md5(stack[-1].key + path[(d - 1) * DIGEST : d * DIGEST]).digest() if d else ROOT
            stack.append(_Node(key, sizes[d - 1] if d else 0, first and d <= shared, not first or d > shared))
        top = stack[-1]
        top.n += 1
        top.conv = conv if top.conv is None else min(top.conv, conv)
        top.ids.append(conv)
        last = path
    if stack:
        stack[-1].leaves += 1
    while stack:
        yield from pop(False)


def sweep(batches):
    import pyarrow as pa

    names = [x.split()[0] for x in SWEPT.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    types = [kinds[x.split()[1]] for x in SWEPT.split(", ")]

    def rows():
        # a range is read as a stream; what is held is its stack
        it = (r for b in batches for r in zip(*[b.column(c).to_pylist() for c in ("part", "path", "sizes", "conv_id", "ghost")]))
        row = next(it, None)
        while row is not None:
            part, rest = row[0], []

            def one():
                nonlocal row
                while row is not None and row[0] == part:
                    yield row[1:]
                    row = next(it, None)

            yield from _sweep_range(part, one())
            while row is not None and row[0] == part:
                row = next(it, None)

    yield from record_batches(rows(), names, types)


def hash_pieces(batches):
    """(key, ends): the digest of a key's ids, from pieces in order."""
    import hashlib

    import pyarrow as pa

    schema = [pa.binary(), pa.string()]

    def rows():
        key, digest = None, None
        for b in batches:
            for k, piece in zip(b.column("key").to_pylist(), b.column("piece").to_pylist()):
                if k != key:
                    if key is not None:
                        yield key, digest.hexdigest()
                    key, digest = k, hashlib.sha256(piece.encode())
                else:
                    digest.update(b"," + piece.encode())
        if key is not None:
            yield key, digest.hexdigest()

    yield from record_batches(rows(), ["key", "ends"], schema)


def trie(arrays: DataFrame, parts: int | None = None) -> DataFrame:
    """The nodes of (conv_id, turns); each conv_id once. `parts`: ranges, by default the
    session's shuffle partitions."""
    keys = ["path", "conv_id"]
    flat = arrays.select(F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("path"), F.transform("turns", lambda t: t["bytes"]).alias("sizes"), "conv_id")
    ranged = in_ranges(flat, keys, "paths", parts)
    swept = written(with_neighbours(ranged, keys, parts).mapInArrow(sweep, SWEPT), "swept")
    numbers = ("n", "children", "leaves", "saved")
    closed = swept.where(F.col("kind") == CLOSED).select("part", "key", "above", "depth", "conv_id", *numbers, "ends")
    touched = swept.where(F.col("kind") == OPEN)
    open_ = touched.groupBy("key").agg(F.min("part").alias("part"), F.min("above").alias("above"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in numbers])
    pieces = swept.where(F.col("kind") == ENDS).select("key", "part", "seq", "piece")
    n = parts or int(arrays.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = pieces.repartition(n, "key").sortWithinPartitions("key", "part", "seq").select("key", "piece").mapInArrow(hash_pieces, "key binary, ends string")
    open_ = written(open_.join(hashed, "key", "left").withColumn("ends", F.coalesce("ends", F.sha2(F.lit(""), 256))), "stitched")
    nodes = closed.unionByName(open_)
    in_part = touched.select("part", "key").join(open_.select("key", "conv_id"), "key")
    ids = closed.select("part", "key", "conv_id").unionByName(in_part).select(F.col("part").alias("part2"), F.col("key").alias("above2"), F.col("conv_id").alias("parent"))
    found = nodes.join(ids, (F.col("part") == F.col("part2")) & (F.col("above") == F.col("above2")), "left")
    return found.select(
        "conv_id",
        "depth",
        F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.col("ends").alias("ends_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(table(spark, sf_dir, "conversations")))


#: Nodes as prefixes of the rebuilt arrays, each joined with all its descendants.
ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, list([coalesce(role, ''), coalesce(text, '')] ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (
  SELECT *, CAST(xor(4294967295, list_reduce(
    list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda crc, c: list_reduce(range(8), lambda s, i: xor(s >> 1, CASE WHEN s & 1 = 1 THEN 3988292384 ELSE 0 END), xor(crc, c)), 4294967295)) % 9 AS INTEGER) AS h FROM t
), r AS (
  SELECT a.conv_id, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS turns
  FROM h a LEFT JOIN t b ON b.conv_id = a.conv_id - a.conv_id % 5
), d AS (SELECT unnest(range(0, 1 + (SELECT max(len(turns)) FROM r))) AS depth), p AS (
  SELECT r.conv_id, d.depth, r.turns[1:d.depth] AS path, len(r.turns) = d.depth AS ends FROM r JOIN d ON d.depth <= len(r.turns)
), n AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256,
    CASE WHEN depth > 0 THEN (count(*) - 1) * strlen(path[-1][2]) ELSE 0 END AS own
  FROM p GROUP BY path, depth
), c AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1
), k AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM n LEFT JOIN c USING (path)
), s AS (
  SELECT k.path[1:d.depth] AS path, sum(own) AS saved, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM k JOIN d ON d.depth <= k.depth GROUP BY 1
)
SELECT k.conv_id, CAST(k.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, k.ends_sha256
FROM k JOIN s USING (path) LEFT JOIN n u ON k.depth > 0 AND u.path = k.path[1:k.depth - 1]
"""
