"""Near-duplicate embeddings by dual traversal of cover trees.

On the unit sphere cos(x, y) >= t means a distance of sqrt(2 - 2t) at most. The upper levels
of a cover tree are built over a sample and sent to all tasks; their leaves are the nodes of
the whole table: each vector goes to its nearest one, and each node's covering radius is then
taken over all its vectors, so bounds are exact whatever the sample. The number of nodes grows
with the table (a node is meant to hold `HOME` vectors) up to `NODES`, beyond which nodes grow.
A vector visits each later node whose radius may reach it.

Within a node both its vectors and its visitors are dealt in blocks of bounded size, and
every task holds two blocks at most. Each block gets a cover tree of its own (centres of a
level are at least the next radius apart, the levels' radii halve as far as `FAN` children
allow, and children hold what their parent held), and a dual traversal descends both trees
together: a pair of nodes goes, with all below it, once the angle of its centres exceeds
both covering radii and the threshold. What is left at the leaves is compared: first along
the `NARROW` directions in which the block spreads most, whose distance never exceeds the whole
one, then what may still be near, exactly.

Where vectors point everywhere no tree prunes, and every pair is compared: that work is
quadratic, and a block grows with the table (up to `BLOCK`) so that fewer copies are dealt.

A task sends on link counts and a spanning forest, never the pairs. Equal vectors are one
class with a weight. Vectors of floats stay floats until they are compared.

Defined results: vectors that are null, zero, empty or hold null or non-finite components
link with nothing; vectors of different lengths do not link; repeated rows link and count
each other; an empty table gives no rows; labels and other columns are ignored. Rows without an id
are kept with null results.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import lean, table, thinned, written
from .components import connected_components

HOME = 8192
BLOCK = 32768
BLOCK_MB = 16
SPREAD = 8
NODES = 16384
PER_NODE = 16
FAN = 16
LEAF = 1024
NARROW = 22
TILE = 512, 2048
SLACK = 1e-6


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def angle(far):
    """Of unit vectors at such distances. Angles add up along a path, and more tightly than distances."""
    return 2.0 * np.arcsin(np.minimum(np.asarray(far) / 2.0, 1.0))


class CoverTree:
    """Nodes over rows of unit vectors: `centre` (a row), `radius` (exact covering radius),
    `children` and, at leaves, `members` (rows). The first child keeps its parent's centre;
    the others are the rows farthest from all children before them, while these are farther
    than half the parent's radius and `FAN` is not reached."""

    def __init__(self, rows: np.ndarray, leaf: int = LEAF):
        self.rows = rows
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.members: list[np.ndarray] = []
        todo = [self._node(0, np.arange(len(rows)))] if len(rows) else []
        while todo:
            node = todo.pop()
            own = self.members[node]
            if len(own) <= leaf or self.radius[node] <= SLACK:
                continue
            here = rows[own]
            near = distance(here, rows[self.centre[node]][None])[:, 0]
            owner, centres = np.zeros(len(own), np.int64), [self.centre[node]]
            while len(centres) < FAN and near.max() > self.radius[node] / 2:
                centres.append(int(own[near.argmax()]))
                d = distance(here, rows[centres[-1]][None])[:, 0]
                d[near.argmax()] = 0.0
                owner[d < near] = len(centres) - 1
                near = np.minimum(near, d)
            order = np.argsort(owner, kind="stable")
            cuts = np.searchsorted(owner[order], np.arange(len(centres) + 1))
            kids = [self._node(c, own[order[a:b]]) for c, a, b in zip(centres, cuts[:-1], cuts[1:]) if b > a]
            self.children[node], self.members[node] = kids, own[:0]
            todo += kids

    def _node(self, centre: int, members: np.ndarray) -> int:
        self.centre.append(centre)
        self.radius.append(float(distance(self.rows[members], self.rows[centre][None]).max()))
        self.children.append([])
        self.members.append(members)
        return len(self.centre) - 1

    def leaves(self) -> list[int]:
        return [i for i, kids in enumerate(self.children) if not kids]

    def below(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The children of all nodes in one array, where each node's begin, and how many they are."""
        n = np.array([len(k) for k in self.children], np.int64)
        return np.array([c for k in self.children for c in k] or [0], np.int64), np.cumsum(n) - n, n

    def places(self) -> np.ndarray:
        """Each row's place in an order in which every leaf is one range."""
        order = np.concatenate([self.members[i] for i in self.leaves()]) if self.centre else np.zeros(0, np.int64)
        out = np.empty(len(order), np.int64)
        out[order] = np.arange(len(order))
        return out


def dual_pairs(x: CoverTree, y: CoverTree, eps: float):
    """Blocks (rows of x, rows of y) that may hold pairs at distance eps or less. Pairs of nodes
    descend in the tree with the larger radius and go, with all that they hold, once their
    covering radii cannot bridge their centres' distance."""
    if not (len(x.centre) and len(y.centre)):
        return
    cx, cy = (t.rows[t.centre] for t in (x, y))
    rx, ry = (angle(t.radius) for t in (x, y))
    (kids_x, from_x, n_x), (kids_y, from_y, n_y) = x.below(), y.below()
    reach = float(angle(eps)) + SLACK
    a = b = np.zeros(1, np.int64)
    done = []
    while len(a):
        near = np.concatenate([np.einsum("ij,ij->i", cx[a[k : k + 8192]], cy[b[k : k + 8192]]) for k in range(0, len(a), 8192)])
        alive = np.arccos(np.clip(near, -1.0, 1.0)) <= reach + rx[a] + ry[b]
        a, b = a[alive], b[alive]
        ends = (n_x[a] == 0) & (n_y[b] == 0)
        done.append((a[ends], b[ends]))
        a, b = a[~ends], b[~ends]
        down_x = (n_x[a] > 0) & ((n_y[b] == 0) | (rx[a] >= ry[b]))
        n = np.where(down_x, n_x[a], n_y[b])
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        a, b, down_x = np.repeat(a, n), np.repeat(b, n), np.repeat(down_x, n)
        a, b = np.where(down_x, kids_x[np.where(down_x, from_x[a] + nth, 0)], a), np.where(down_x, b, kids_y[np.where(down_x, 0, from_y[b] + nth)])
    a, b = (np.concatenate(c) for c in zip(*done))
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    met: dict[bytes, tuple[list[int], np.ndarray]] = {}
    for i, others in zip(a[np.flatnonzero(np.diff(a, prepend=-1))].tolist(), np.split(b, np.flatnonzero(np.diff(a)) + 1)):
        others = np.sort(others)
        met.setdefault(others.tobytes(), ([], others))[0].append(i)
    for leaves, others in met.values():  # leaves that meet the same go together
        yield np.concatenate([x.members[i] for i in leaves]), np.concatenate([y.members[j] for j in others.tolist()])


def _vectors(column, kind: str) -> np.ndarray:
    """Vectors of an Arrow column of bytes without nulls."""
    import pyarrow as pa

    column = pa.concat_arrays(column.cast(pa.binary()).chunks) if isinstance(column, pa.ChunkedArray) else column.cast(pa.binary())
    at = np.frombuffer(column.buffers()[1], "<i4")[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], kind, (at[-1] - at[0]) // np.dtype(kind).itemsize, at[0]).reshape(len(column), -1).astype("<f8")


def _assign(centres: np.ndarray, kind: str):
    """Adds the nearest node and its distance."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if len(batch):
                d = distance(unit(_vectors(batch.column("v"), kind)), centres)
                node = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node.astype("int32")), pa.array(d[np.arange(len(d)), node])], names=["cls", "weight", "v", "node", "far"])

    return lean(run)


def _guests(batch, centres: np.ndarray, radii: np.ndarray, eps: float, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(row, host) of the vectors that may lie near another, later node's vectors."""
    d = distance(unit(_vectors(batch.column("v"), kind)), centres)
    later = np.arange(len(centres))[None, :] > batch.column("node").to_numpy()[:, None]
    reach = np.minimum(angle(radii) + float(angle(eps)) + SLACK, math.pi)
    return np.nonzero(later & (d <= np.where(radii < 0, -1.0, 2.0 * np.sin(reach / 2.0) + SLACK)))


def _guest_counts(centres: np.ndarray, radii: np.ndarray, eps: float, kind: str):
    def run(batches):
        import pyarrow as pa

        total = np.zeros(len(centres), np.int64)
        for batch in batches:
            if len(batch):
                total += np.bincount(_guests(batch, centres, radii, eps, kind)[1], minlength=len(centres))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total).astype("int32")), pa.array(total[total > 0])], names=["node", "n"])

    return lean(run)


def _visits(centres: np.ndarray, radii: np.ndarray, blocks: np.ndarray, guest_blocks: np.ndarray, eps: float, kind: str):
    """Rows dealt to tasks (node, lo, hi): block lo of a node meets block hi of it, or block
    -1 - hi of its guests. `side` is 0 for block lo and 1 for what it meets."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not len(batch):
                continue
            cls, node = batch.column("cls").to_numpy(), batch.column("node").to_numpy()
            who, host = _guests(batch, centres, radii, eps, kind)
            own = cls % blocks[node]
            every = np.arange(len(batch))
            parts = []

            def deal(rows, at, n):
                each = np.repeat(np.arange(len(rows)), n)
                return rows[each], at[each], np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)

            i, at, other = deal(every, node, blocks[node])
            parts.append((i, at, np.minimum(own[i], other), np.maximum(own[i], other), (own[i] > other).astype(int)))
            i, at, other = deal(every, node, guest_blocks[node])
            parts.append((i, at, own[i], -1 - other, np.zeros(len(i), int)))
            i, at, other = deal(who, host, blocks[host])
            parts.append((i, at, other, -1 - cls[i] % guest_blocks[at], np.ones(len(i), int)))
            i, at, lo, hi, side = (np.concatenate(x) for x in zip(*parts))
            for a in range(0, len(i), 8192):
                cut = slice(a, a + 8192)
                got = batch.select(["cls", "weight", "v"]).take(pa.array(i[cut]))
                yield pa.RecordBatch.from_arrays([*got.columns, *(pa.array(x[cut].astype("int32")) for x in (at, lo, hi, side))], names=["cls", "weight", "v", "node", "lo", "hi", "side"])

    return lean(run)


def _directions(rows: np.ndarray) -> np.ndarray:
    """Orthonormal columns, about those along which the rows spread most. Any will do: a distance
    along some of a space's directions never exceeds the whole one."""
    spread = rows - rows.mean(0)
    out = np.linalg.qr(np.random.default_rng(0).normal(size=(rows.shape[1], NARROW)))[0]
    for _ in range(2):
        out = np.linalg.qr(spread.T @ (spread @ out))[0]
    return out


def near_rows(x: np.ndarray, y: np.ndarray, cosine: float):
    """A function of two sorted index arrays that yields (i, j), rows of x and y of that cosine or more,
    sorted by i; if `later`, those with i < j. Tiles of half the squared distance along a few directions come first, by one product in single
    precision: (x, -xx / 2, 1) times (y, 1, -yy / 2) for what x and y are along them. What is left is compared whole,
    many pairs as a tile of single precision with a margin; double precision settles the rest."""
    margin = max(1e-4, 2.0 ** -22 * x.shape[1])
    basis = _directions(x) if x.shape[1] > NARROW + 2 and len(x) else None
    thin_x, thin_y = (rows if basis is None else rows @ basis for rows in (x, y))
    half_x, half_y = (-0.5 * np.einsum("ij,ij->i", thin, thin) for thin in (thin_x, thin_y))
    thin_x, thin_y = np.c_[thin_x, half_x, np.ones(len(x))].astype("f4"), np.c_[thin_y, np.ones(len(y)), half_y].astype("f4")
    short_x, short_y = x.astype("f4"), y.astype("f4")
    product, passed = np.empty(TILE[0] * TILE[1], "f4"), np.empty(TILE[0] * TILE[1], bool)

    def of(p: np.ndarray, q: np.ndarray, later: bool):
        for a in range(0, len(p), TILE[0]):
            own = p[a : a + TILE[0]]
            for b in range(np.searchsorted(q, own[0]) if later else 0, len(q), TILE[1]):
                part = q[b : b + TILE[1]]
                at, on = (slice(k[0], k[-1] + 1) if (np.diff(k) == 1).all() else k for k in (part, own))
                shape, n = (len(own), len(part)), len(own) * len(part)
                tile, mask = product[:n].reshape(shape), passed[:n].reshape(shape)
                np.greater_equal(np.matmul(thin_x[on], thin_y[at].T, out=tile), cosine - 1.0 - margin, out=mask)
                hits = np.flatnonzero(mask)
                if not len(hits):
                    continue
                sure = np.zeros(len(hits), bool)
                if len(hits) > n // 64:
                    np.greater_equal(np.matmul(short_x[on], short_y[at].T, out=tile), cosine - margin, out=mask)
                    hits = np.flatnonzero(mask)
                    sure = tile.ravel()[hits] >= cosine + margin
                i, j = own[hits // len(part)], part[hits % len(part)]
                unsettled = np.flatnonzero(~sure)
                for c in range(0, len(unsettled), 1 << 14):
                    k = unsettled[c : c + (1 << 14)]
                    sure[k] = np.einsum("ij,ij->i", x[i[k]], y[j[k]]) >= cosine
                if later:
                    sure &= i < j
                if sure.any():
                    yield i[sure], j[sure]

    return of


def _link(cosine: float, eps: float, kind: str):
    """Link counts and a spanning forest of one task."""

    def run(group):
        import pyarrow as pa

        side, cls, weight = (group.column(c).to_numpy() for c in ("side", "cls", "weight"))
        rows = unit(_vectors(group.column("v"), kind))
        counts = np.zeros(len(rows), np.int64)
        parent = np.arange(len(rows))

        def find(a: int) -> int:
            while parent[a] != a:
                parent[a] = parent[parent[a]]
                a = parent[a]
            return a

        home, other = (np.flatnonzero(side == s) for s in (0, 1))
        same = group.column("lo")[0] == group.column("hi")[0]
        tree = CoverTree(rows[home])
        met = tree if same else CoverTree(rows[other])
        # from here on rows stand in their trees' order, so that leaves are ranges
        place, place_met = tree.places(), met.places()
        home = home[np.argsort(place)]
        second = home if same else other[np.argsort(place_met)]
        near = near_rows(rows[home], rows[second], cosine)
        for x, y in dual_pairs(tree, met, eps):
            x, y = np.sort(place[x]), np.sort(place_met[y])
            for i, j in near(x, y, same):
                i, j = home[i], second[j]
                counts += np.bincount(i, weight[j], len(rows)).astype(np.int64)
                counts += np.bincount(j, weight[i], len(rows)).astype(np.int64)
                # what one row links with is tied together as a chain
                i = np.where(np.diff(i, prepend=-1) == 0, np.roll(j, 1), i)
                apart = parent[i] != parent[j]
                for edge in np.unique(i[apart] * len(rows) + j[apart]).tolist():
                    u, w = find(edge // len(rows)), find(edge % len(rows))
                    if u != w:
                        u, w = (u, w) if cls[u] < cls[w] else (w, u)
                        parent[w] = u
        roots = np.array([cls[find(i)] for i in range(len(rows))], np.int64)
        used = np.flatnonzero((counts > 0) | (roots != cls))
        return pa.table({"cls": cls[used], "links": counts[used], "root": roots[used]})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """(id, n_links, component, kept) of every row."""
    eps = math.sqrt(2.0 - 2.0 * cosine)
    v = F.transform(F.col(col), lambda x: x.cast("double") + F.lit(0.0))
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    kind = "<f4" if vectors.schema[col].dataType == ArrayType(FloatType(), vectors.schema[col].dataType.containsNull) else "<f8"
    v = v.cast("array<float>") if kind == "<f4" else v
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(fine, v).alias("v"))
    key = F.when(F.col("v").isNotNull() & F.col("id").isNotNull(), F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b")))
    rows = rows.withColumn("key", key)
    classes = rows.where("key is not null").groupBy("key").agg(F.min("id").alias("cls"), F.count("*").alias("weight"), F.first("v").alias("v"))
    packed = written(classes.mapInArrow(_pack(kind), "key struct<a long, b long>, cls long, weight long, v binary, width int"), "vectors")
    found = None
    for r in packed.groupBy("width").count().collect():
        part = _of_width(packed.where(F.col("width") == r["width"]).select("cls", "weight", "v"), r["count"], r["width"], cosine, eps, kind)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "cls long, links long, root long")
    found = written(found, "links")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    labels = connected_components(found, "cls", "root")
    own = packed.select("key", "cls", "weight").join(links, "cls", "left").join(labels.withColumnRenamed("node", "cls"), "cls", "left")
    own = own.select("key", F.coalesce("root", "cls").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = rows.select("id", "key").join(own, "key", "left")
    n_links = F.when(F.col("id").isNotNull(), F.coalesce("n_links", F.lit(0)).cast("long"))
    return out.select("id", n_links.alias("n_links"), F.coalesce("component", "id").alias("component"), (F.col("id") == F.coalesce("component", "id")).alias("kept"))


def _pack(kind: str):
    """Vectors as bytes, with their length."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = batch.column("v").offsets.to_numpy()
            flat = batch.column("v").values.to_numpy(zero_copy_only=False).astype(kind)
            data = [flat[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            columns = [batch.column(c) for c in ("key", "cls", "weight")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(data, pa.binary()), pa.array(at[1:] - at[:-1], pa.int32())], names=["key", "cls", "weight", "v", "width"])

    return lean(run)


def _of_width(packed: DataFrame, count: int, width: int, cosine: float, eps: float, kind: str) -> DataFrame:
    """Links among class representatives of one vector length."""
    block = min(BLOCK, max(HOME, count // SPREAD), max(256, (BLOCK_MB << 20) // (8 * width)))
    nodes = min(NODES, -(-count // block))
    size = PER_NODE * nodes
    sample = thinned(packed, F.col("cls"), size, count).orderBy(F.xxhash64("cls")).limit(size).select("v").collect()
    upper = CoverTree(unit(np.stack([np.frombuffer(r.v, kind).astype("<f8") for r in sample])), leaf=PER_NODE)
    centres = upper.rows[[upper.centre[i] for i in upper.leaves()][:nodes]]
    dealt = written(packed.mapInArrow(_assign(centres, kind), "cls long, weight long, v binary, node int, far double"), "nodes")
    sizes = dealt.groupBy("node").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()
    radii, blocks, guest_blocks = np.full(len(centres), -9.0), np.ones(len(centres), np.int64), np.zeros(len(centres), np.int64)
    for r in sizes:
        radii[r.node], blocks[r.node] = r.far, -(-r.n // block)
    for r in dealt.mapInArrow(_guest_counts(centres, radii, eps, kind), "node int, n long").groupBy("node").agg(F.sum("n").alias("n")).collect():
        guest_blocks[r.node] = -(-r.n // block)
    visits = dealt.drop("far").mapInArrow(_visits(centres, radii, blocks, guest_blocks, eps, kind), "cls long, weight long, v binary, node int, lo int, hi int, side int")
    return visits.groupBy("node", "lo", "hi").applyInArrow(_link(cosine, eps, kind), "cls long, links long, root long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")
