"""Exact Jaccard join of word n-gram sets by vertical partitioning.

The global order of n-grams (that of their 64-bit hashes) is cut into fragments. The
fragments serve twice:

1. Candidates. Sets with Jaccard similarity t or more differ in at most
   (1 - t) / (1 + t) * (|x| + |y|) n-grams, so among one fragment more than that they agree on
   a whole fragment. Each set is dealt by the hashes of its largest fragments. Sets that meet
   are tied together if a parity sketch (about a bit per n-gram, whose Hamming distance never
   exceeds the sets' difference) leaves a link possible; the groups so tied hold all links.
2. Overlaps. Inside the groups every fragment is a task of its own, which counts the partial
   overlaps of probes and members there; the partial counts are then summed per pair, and
   pairs that reach the threshold are links.

Equal sets are one class from the start. The fragments that sets must agree on depend on
their size, so sizes are cut into bands; a set near the end of its band also takes part in
the next. Small groups compare all their members in one block. In large ones all members
first meet a few hubs; those that the hubs do not bring together alone meet all others, in
blocks. Tasks send on a spanning forest of links, never the links.

Defined results: null and empty texts and texts without words have no n-grams and link
with nothing; equal rows link; an empty table gives no rows; rows without an id are kept
with a null component and link with nothing; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash
from .common import lean, runs, table, written
from .components import connected_components

BAND = 4
BLOCK = 256
BUCKET = 1024
HUBS = 8
FRAGMENTS = 4
SENT_ROWS = 1 << 20


def differing(total: int, num: int, den: int) -> int:
    """Most n-grams in which sets of `total` n-grams together can differ and be linked."""
    return (total * (den - num)) // (den + num)


def band(n: int) -> int:
    """Band b holds the sizes from BAND ** b to BAND ** (b + 1) - 1."""
    b = 0
    while BAND ** (b + 1) <= n:
        b += 1
    return b


def class_id(grams: np.ndarray) -> int:
    """64-bit identity of a set."""
    total = int(np.bitwise_xor.reduce(wordhash.mix(grams + wordhash.MULT[7])))
    other = int(np.add.reduce(wordhash.mix(grams * wordhash.MULT[8])))
    return int(np.array([(total * 3 + other) % 2**64], np.uint64).view(np.int64)[0])


def cut(grams: np.ndarray, count: int) -> np.ndarray:
    """Where the fragments of a set begin and end."""
    edges = np.arange(1, count, dtype=np.uint64) * np.uint64(2**64 // count)
    return np.concatenate([[0], np.searchsorted(grams, edges), [len(grams)]])


def signatures(grams: np.ndarray, num: int, den: int) -> np.ndarray:
    """Hashes of the set's largest fragments in its own band and, if a set linked to it may
    lie there, in the next.

    A set of n links with sets of n * den / num at most, so they differ in `most` fragments
    at most. They agree on some, and the largest of these is among the `most + 1` largest of
    either set. Only those are given: small fragments would tie unrelated sets together.

    Where all the fragments they agree on are empty, both sets have `most` others at most.
    Sets with so few are also dealt by n-grams: linked sets share all but
    n - ceil(n * num / den) of their n, so the least shared one is among the first ones.
    """
    n = len(grams)
    reach = n * den // num
    most = differing(n + reach, num, den)
    first = n + num * -n // den + 1
    found = []
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(wordhash.mix(grams ^ wordhash.MULT[9]), out=sums[1:])
    for b in range(band(n), band(reach) + 1):
        salt = np.uint64((b + 1) * int(wordhash.MULT[11]) % 2**64)
        differ = differing(2 * (BAND ** (b + 1) - 1), num, den)
        count = differ + 2 * differ // 5 + 2
        at = cut(grams, count)
        sizes = (at[1:] - at[:-1]) * count + np.arange(count)  # equal sizes: by position
        large = np.argpartition(sizes, count - most - 1)[count - most - 1 :]
        large = large[sizes[large] >= count]
        part = sums[at[1:][large]] - sums[at[:-1][large]]
        found.append(wordhash.mix(part + large.astype(np.uint64) * wordhash.MULT[10] + salt))
        if np.count_nonzero(at[1:] > at[:-1]) <= most:
            found.append(wordhash.mix(wordhash.mix(grams[:first]) + salt))
    return np.concatenate(found)


def sketch(grams: np.ndarray) -> bytes:
    """Parities of how many n-grams fall on each bit. Sets that differ in d n-grams have
    sketches that differ in d bits at most, and folding two halves keeps that true."""
    bits = 1 << max(6, int(len(grams) - 1).bit_length())
    held = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(held.astype(np.uint8), bitorder="little").tobytes()


def may_link(x: tuple, y: tuple, num: int, den: int) -> bool:
    """Whether two (size, bits, sketch as a number) may belong to linked sets."""
    (n, bits, a), (m, more, b) = sorted((x, y))
    if n * den < m * num:
        return False
    while more > bits:
        more //= 2
        b = (b >> more) ^ (b & ((1 << more) - 1))
    return (a ^ b).bit_count() <= differing(n + m, num, den)


def _sets(k: int):
    """Rows of doc, n_shingles, cls and sketch of each text."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sizes, classes, marks = [], [], []
            for _, w in wordhash.chunks(batch.column("text")):
                for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist()):
                    g = wordhash.shingles(w.hash[a:b], k)
                    sizes.append(len(g))
                    classes.append(class_id(g) if len(g) else None)
                    marks.append(sketch(g) if len(g) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(marks, pa.binary())], names=["doc", "n_shingles", "cls", "sketch"])

    return run


def _signatures(k: int, num: int, den: int):
    """Rows of sig and cls; a task sends each class on once."""

    def run(batches):
        import pyarrow as pa

        seen: set[int] = set()
        for batch in batches:
            sigs, classes, sizes = [], [], []
            for _, w in wordhash.chunks(batch.column("text")):
                for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist()):
                    g = wordhash.shingles(w.hash[a:b], k)
                    if not len(g) or (c := class_id(g)) in seen:
                        continue
                    seen.add(c)
                    s = signatures(g, num, den)
                    sigs.append(s)
                    classes.append(c)
                    sizes.append(len(s))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.repeat(np.array(classes, np.int64), sizes))], names=["sig", "cls"])

    return run


def _fragments(k: int):
    """Rows of cls, its group's columns, its size n, f and the n-grams of fragment f as bytes.
    A task sends each class on once; a text of another class with the same id is left out."""

    def run(batches):
        import pyarrow as pa

        seen: set[int] = set()
        for batch in batches:
            rows = []
            at = 0
            known = list(zip(*(batch.column(c).to_pylist() for c in ("cls", "grp", "size", "probes", "chosen"))))
            for _, w in wordhash.chunks(batch.column("text")):
                for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist()):
                    cls = known[at][0]
                    if b > a and cls not in seen and class_id(g := wordhash.shingles(w.hash[a:b], k)) == cls:
                        seen.add(cls)
                        ends = cut(g, FRAGMENTS).tolist()
                        rows += [(*known[at], len(g), f, g[ends[f] : ends[f + 1]].tobytes()) for f in range(FRAGMENTS)]
                    at += 1
            columns = list(zip(*rows)) or [[]] * 8
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["cls", "grp", "size", "probes", "chosen", "n", "f", "grams"])

    return run


def forest(pairs: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links (pairs of positions in ids), as (id, smallest id of its
    tree)."""
    parent = list(range(len(ids)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in pairs.tolist():
        i, j = find(i), find(j)
        if i != j:
            a, b = (i, j) if ids[i] < ids[j] else (j, i)
            parent[b] = a
    return [(int(ids[x]), int(ids[find(x)])) for x in range(len(ids)) if find(x) != x]


def tie(rows: list[tuple], num: int, den: int) -> list[tuple[int, int]]:
    """Components of rows (cls, probe, size, sketch) under `may_link`, where one of two rows
    must be a probe, as (cls, cls). A row meets each component until one of it fits."""
    found: list[tuple[int, int]] = []
    parts: list[tuple[int, list, list]] = []
    for cls, probe, n, mark in sorted(rows, key=lambda r: not r[1]):
        own = (n, 8 * len(mark), int.from_bytes(mark, "little"))
        home = (cls, [], [])
        apart = []
        for part in parts:
            if any(may_link(own, x, num, den) for x in part[2 if probe else 1]):
                found.append((cls, part[0]))
                home = (part[0], home[1] + part[1], home[2] + part[2])
            else:
                apart.append(part)
        home[2].append(own)
        if probe:
            home[1].append(own)
        parts = [*apart, home]
    return found


def _tied(num: int, den: int):
    """Candidate ties of rows that come sorted by bucket and block."""

    def run(batches):
        import pyarrow as pa

        found: list[tuple[int, int]] = []
        frame = lambda: pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])
        for _, rows in runs(batches, ["sig", "pc", "mc"], ["cls", "probe", "n", "sketch"]):
            if len(rows) > 1:
                found += tie(rows, num, den)
            if len(found) > 4096:
                yield frame()
                found = []
        yield frame()

    return run


def dealt(rows: DataFrame, block: int) -> DataFrame:
    """`rows` (with the columns cls, size and probes of their group, and chosen) dealt so that each
    chosen row, a probe, meets each row of its group: chunk pc of probes meets chunk mc of all.
    A group of one chunk stays whole and is sent on once."""
    n_p, n_m = (F.greatest(F.ceil(F.col(c) / F.lit(float(block))).cast("int"), F.lit(1)) for c in ("probes", "size"))
    kept = [c for c in rows.columns if c not in ("size", "probes", "chosen")]
    h = F.xxhash64(F.lit(3), "cls")
    rows = rows.withColumns({"_p": n_p, "_m": n_m}).withColumns({"_op": F.pmod(h, F.col("_p")).cast("int"), "_om": F.pmod(h, F.col("_m")).cast("int")})
    as_one = F.transform(F.sequence(F.lit(0), F.col("_p") - 1), lambda p: F.struct(p.alias("pc"), F.col("_om").alias("mc"), (F.col("chosen") & (F.col("_op") == p)).alias("probe")))
    # a probe is a probe in its own chunk of all already
    others = F.filter(F.sequence(F.lit(0), F.col("_m") - 1), lambda m: F.col("chosen") & (m != F.col("_om")))
    as_probe = F.transform(others, lambda m: F.struct(F.col("_op").alias("pc"), m.alias("mc"), F.lit(True).alias("probe")))
    return rows.withColumn("_d", F.explode(F.concat(as_one, as_probe))).select(*kept, "_d.pc", "_d.mc", "_d.probe")


def by_run(rows: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    """`run` over the rows, dealt by the keys and sorted by them."""
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lean(run), schema)


def buckets(sigs: DataFrame, sets: DataFrame) -> DataFrame:
    """(sig, cls, n, sketch, size, hub) of the classes that meet in a signature; of buckets with
    the same members one is kept."""
    often = sigs.groupBy("sig").count().where("count > 1").select("sig")
    shared = written(sigs.join(often, "sig").distinct(), "shared")
    known = shared.groupBy("sig").agg(F.count("*").alias("size"), F.min("cls").alias("hub"), F.bit_xor(F.xxhash64(F.lit(4), "cls")).alias("members"))
    kept = known.where("size > 1").groupBy("size", "hub", "members").agg(F.min("sig").alias("sig")).select("sig", "size", "hub")
    marks = sets.where("cls is not null").groupBy("cls").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    return written(shared.join(kept, "sig").join(marks, "cls"), "buckets")


def ties(met: DataFrame, num: int, den: int) -> DataFrame:
    """Candidate ties (a, b) whose components hold all links. A bucket of up to BUCKET classes
    is one block; in larger ones all meet the hub, and those that it may not link with meet all."""

    def tied(rows: DataFrame) -> DataFrame:
        rows = dealt(rows.select("sig", "cls", "n", "sketch", "size", "probes", "chosen"), BUCKET)
        return by_run(rows, ["sig", "pc", "mc"], _tied(num, den), "a long, b long")

    small = F.col("size") <= BUCKET
    one_block = met.withColumn("probes", F.when(small, F.col("size")).otherwise(1)).withColumn("chosen", small | (F.col("cls") == F.col("hub")))
    first = written(tied(one_block), "ties")
    large = met.where(~small)
    if large.isEmpty():
        return first
    ends = F.explode(F.array(F.struct(F.col("a").alias("cls"), F.col("b").alias("hub")), F.struct(F.col("b").alias("cls"), F.col("a").alias("hub"))))
    joined = first.select(ends.alias("e")).select("e.*").distinct()
    left = large.where("cls <> hub").join(joined, ["cls", "hub"], "left_anti").select("sig", "cls", F.lit(True).alias("chosen"))
    again = large.join(left.groupBy("sig").agg(F.count("*").alias("probes")), "sig").join(left, ["sig", "cls"], "left")
    return first.unionByName(tied(again.withColumn("chosen", F.coalesce("chosen", F.lit(False)))))


def _partial(batches):
    """The partial overlaps of the probes with all rows of one fragment, as a matrix."""
    import pyarrow as pa

    keys = ["grp", "pc", "mc", "f"]
    names = [*keys, "cls", "n", "probe", "sums"]
    types = [pa.int64(), *[pa.int32()] * 3, *[pa.binary()] * 4]
    out: list[tuple] = []
    size = 0
    frame = lambda: pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=names)
    for key, rows in runs(batches, keys, ["cls", "n", "probe", "grams"]):
        if len(rows) < 2:
            continue
        rows.sort(key=lambda r: r[0])
        sets = [np.frombuffer(r[3], np.uint64) for r in rows]
        own = [i for i, r in enumerate(rows) if r[2]]
        sums = partial_overlaps(sets, own)
        head = [np.array([r[i] for r in rows], t).tobytes() for i, t in enumerate((np.int64, np.int64, np.uint8))]
        out.append((*key, *head, sums.tobytes()))
        size += sums.nbytes
        if size > 1 << 22 or len(out) > 2000:
            yield frame()
            out, size = [], 0
    yield frame()


def partial_overlaps(sets: list[np.ndarray], own: list[int], width: int = 1 << 22) -> np.ndarray:
    """How many n-grams of one fragment the sets `own` share with each set."""
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    who = np.repeat(np.arange(len(sets)), [len(g) for g in sets])
    order = np.argsort(at, kind="stable")
    at, who = at[order], who[order]
    step = max(1, width // len(sets))
    sums = np.zeros((len(own), len(sets)), np.int32)
    for lo in range(0, len(values), step):
        a, b = np.searchsorted(at, [lo, lo + step])
        held = np.zeros((len(sets), min(step, len(values) - lo)), np.float32)
        held[who[a:b], at[a:b] - lo] = 1
        sums += np.rint(held[own] @ held.T).astype(np.int32)
    return sums


def _summed(num: int, den: int):
    """The partial overlaps added per pair, and a spanning forest of the pairs that link."""

    def run(batches):
        import pyarrow as pa

        found: list[tuple[int, int]] = []
        for _, rows in runs(batches, ["grp", "pc", "mc"], ["cls", "n", "probe", "sums"]):
            ids, sizes, probe = (np.frombuffer(x, t) for x, t in zip(rows[0][:3], (np.int64, np.int64, np.uint8)))
            own = np.flatnonzero(probe)
            shared = sum(np.frombuffer(r[3], np.int32) for r in rows).reshape(len(own), len(ids))
            pairs = np.argwhere(shared * (num + den) >= num * (sizes[own][:, None] + sizes[None, :]))
            pairs[:, 0] = own[pairs[:, 0]]
            found += forest(pairs[pairs[:, 0] != pairs[:, 1]], ids)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def overlapping(texts: DataFrame, members: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (a, b), as forests, of the chosen members with all of their group."""
    # sent to all tasks only where it is known to be small
    sent = F.broadcast(members) if members.count() <= SENT_ROWS else members
    picked = texts.join(sent, "doc").select("cls", "grp", "size", "probes", "chosen", "text")
    parts = picked.mapInArrow(lean(_fragments(k)), "cls long, grp long, size long, probes long, chosen boolean, n long, f int, grams binary")
    matrices = by_run(dealt(parts, BLOCK), ["grp", "pc", "mc", "f"], _partial, "grp long, pc int, mc int, f int, cls binary, n binary, probe binary, sums binary")
    return by_run(matrices, ["grp", "pc", "mc"], _summed(num, den), "a long, b long")


def links(texts: DataFrame, groups: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (a, b) of classes, as forests, from groups (cls, grp, doc). Small groups are one
    block; in large ones all meet the hubs, and what these leave apart meets all."""
    sized = groups.groupBy("grp").agg(F.count("*").alias("size"))
    spread = F.xxhash64(F.lit(5), "cls")
    hubs = groups.groupBy("grp", F.pmod(spread, F.lit(HUBS)).alias("_")).agg(F.min_by("cls", spread).alias("cls")).select("cls", F.lit(True).alias("is_hub"))
    small = F.col("size") <= BLOCK
    members = groups.join(sized, "grp").join(hubs, "cls", "left")
    members = members.withColumns({"chosen": small | F.coalesce("is_hub", F.lit(False)), "probes": F.when(small, F.col("size")).otherwise(F.lit(HUBS).cast("long"))})
    members = written(members.select("cls", "grp", "doc", "size", "probes", "chosen"), "members")
    first = written(overlapping(texts, members, k, num, den), "links")
    large = members.where(~small)
    if large.isEmpty():
        return first
    roots = connected_components(first).withColumnRenamed("node", "cls")
    own = large.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    main = own.groupBy("grp", "root").count().groupBy("grp").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
    own = own.join(main, "grp").select("cls", "grp", "doc", "size", (F.col("root") != F.col("main")).alias("chosen"))
    left = own.groupBy("grp").agg(F.sum(F.col("chosen").cast("long")).alias("probes")).where("probes > 0")
    again = written(own.join(left, "grp"), "members")
    return first.unionByName(overlapping(texts, again, k, num, den))


def jaccard_components(docs: DataFrame, k: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n_shingles, component) of every row: documents linked when their k-word
    shingle sets have Jaccard similarity num/den or more."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    sets = texts.mapInArrow(lean(_sets(k)), "doc long, n_shingles long, cls long, sketch binary")
    sets = written(sets.withColumn("cls", F.when(F.col("doc").isNotNull(), F.col("cls"))), "sets")
    sigs = texts.where("doc is not null").select("text").mapInArrow(lean(_signatures(k, num, den)), "sig long, cls long")
    tied = connected_components(ties(buckets(sigs, sets), num, den))
    reps = sets.where("cls is not null").groupBy("cls").agg(F.min("doc").alias("doc"))
    groups = written(tied.select(F.col("node").alias("cls"), F.col("root").alias("grp")).join(reps, "cls"), "groups")
    labels = connected_components(links(texts, groups, k, num, den))
    named = reps.withColumnRenamed("doc", "low").join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = named.groupBy("root").agg(F.min("low").alias("component"))
    by_class = named.join(least, "root").select("cls", "component")
    return sets.join(by_class, "cls", "left").select("doc", "n_shingles", F.coalesce("component", "doc").alias("component"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(table(spark, sf_dir, "documents"), 4, 85, 100)
    return found.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
