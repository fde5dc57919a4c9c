"""Byte-level BPE encoding and decoding with ranked merges folded by Spark functions.

Texts are cut into words by the tokenizer's pattern. Every task numbers the distinct
words of its documents as it meets them; Spark higher-order functions fold the ranked merges
over the byte array of each new word, looking pairs up in a rank map; the documents
then take their words' ids, and decoding concatenates the ids' byte pieces. Words never leave
their task, so nothing is shuffled, and a table of KNOWN words begins anew.

A symbol (one byte, or one token of the rank file) is written as one character: bytes as
U+0000 to U+00FF, the token of rank r as U+0100 + r (or past the surrogates). A word is then a short
string, a merge replaces two characters by one, and comparing characters compares ranks.

The rank map holds, for every pair of symbols that form a token, that token's character; it is
an array of small maps indexed by the pair's CRC-32, since Spark searches a map from its
start. It is one row that is sent to all tasks: as a literal it would stand in every form of the
plan, and in its texts, which together take hundreds of megabytes of the driver. The literal is
the faster one (a third less CPU), so a query that has the driver to itself takes it (`sent`).

A step of the fold looks at all pairs left, so a word costs the square of its length; words
of more than LONG bytes (texts without spaces) are merged by the same ranks with a heap.

Defined results: null and empty texts have no ids; equal rows are encoded alike; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash
from .common import lean, short_batches, table, whole_text

BUCKETS = 1 << 16
CHUNK = 4096
DOCS = 1024
TOGETHER = 3
KNOWN = 1 << 20
LONG = 512
#: Signs in rising order, for the places of a word.
PLACES = "".join(chr(0x100 + i) for i in range(LONG))
NONE = "￿"
OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _char(rank: int) -> str:
    code = rank + 256
    return chr(code if code < 0xD800 else code + 0x2800)


def _rank(code: int) -> int:
    return code - 256 if code < 0xD800 else code - 0x2800 - 256


def symbol(token: bytes, rank: int) -> str:
    return chr(token[0]) if len(token) == 1 else _char(rank)


def with_rank_map(rows: DataFrame, ranks: dict[bytes, int], sent: bool = True) -> DataFrame:
    """Adds `merges`, the pairs that merge, an array<map<pair, merged symbol>>: a row that is sent
    to all tasks, or a literal."""
    buckets: list[dict[str, str]] = [{} for _ in range(BUCKETS)]
    symbols = {t: symbol(t, r) for t, r in ranks.items()}
    for token, made in symbols.items():
        for cut in range(1, len(token)):
            a, b = symbols.get(token[:cut]), symbols.get(token[cut:])
            if a is not None and b is not None:
                buckets[zlib.crc32((a + b).encode()) % BUCKETS][a + b] = made
    coded, kind = json.dumps(buckets, ensure_ascii=False), "array<map<string,string>>"
    if not sent:
        return rows.withColumn("merges", F.from_json(F.lit(coded), kind))
    one = rows.sparkSession.createDataFrame([(coded,)], "merges string").coalesce(1)
    return rows.crossJoin(F.broadcast(one.select(F.from_json("merges", kind).alias("merges"))))


def fold_merges(word: Column, merges: Column) -> Column:
    """The symbols of one word: its bytes with the lowest-ranked, leftmost pair merged
    again and again until none is left, which a mark at the end then tells later steps.

    A step merges all occurrences of the best pair, which would follow one another anyway: what
    a merge makes ranks behind it, as all tokens do that a file's own merges can reach. Pairs
    compare as texts of the merged symbol, the place and the pair."""

    def best_pair(state: Column) -> Column:
        def at(i: Column) -> Column:
            pair = F.substring(state, i, F.lit(2))
            bucket = F.get(merges, F.crc32(pair).bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))
            return F.concat(F.try_element_at(bucket, pair), F.substring(F.lit(PLACES), i, F.lit(1)), pair)

        return F.array_min(F.transform(F.sequence(F.lit(1), F.length(state) - 1), at))

    def merge(state: Column, _) -> Column:
        def apply(best: Column) -> Column:
            joined = F.replace(state, F.substring(best, F.lit(3), F.lit(2)), F.substring(best, F.lit(1), F.lit(1)))
            return F.when(best.isNull(), F.concat(state, F.lit(NONE))).otherwise(joined)

        over = (F.length(state) < 2) | F.endswith(state, F.lit(NONE))
        return F.when(over, state).otherwise(F.get(F.transform(F.array(best_pair(state)), apply), F.lit(0)))

    data = F.encode(word, "UTF-8")
    start = F.decode(data, "ISO-8859-1")
    steps = F.when(F.octet_length(word) > 1, F.sequence(F.lit(2), F.octet_length(word))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, merge, lambda state: F.replace(state, F.lit(NONE)))


def merge_with_heap(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one very long word: lowest-ranked, leftmost pairs first, as in the fold."""
    from heapq import heapify, heappop, heappush

    if data in ranks:
        return [ranks[data]]
    n = len(data)
    part = [data[i : i + 1] for i in range(n)]
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

    def entry(i: int):
        j = after[i]
        rank = ranks.get(part[i] + part[j]) if j < n else None
        return None if rank is None else (rank, i, len(part[i]), len(part[j]))

    heap = [e for e in map(entry, range(n)) if e]
    heapify(heap)
    while heap:
        _, i, size_i, size_j = heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or len(part[i]) != size_i or len(part[j]) != size_j:
            continue
        part[i] += part[j]
        alive[j] = False
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and (e := entry(k)):
                heappush(heap, e)
    return [ranks[part[i]] for i in range(n) if alive[i]]


def java_pattern(pattern: str) -> str:
    """The pattern for Java, whose classes cover Unicode only when asked to."""
    return "(?U)" + pattern


class WordTable:
    """Numbers of the words a task has met, held in flat arrays: their bytes, and their 64-bit
    hashes in order. A word that a hash alone would mistake is told by its bytes and goes without a
    place in the table, so it is new every time."""

    def __init__(self):
        import numpy as np

        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.words, self.size = [], 0

    def meet(self, words):
        """(number of each of an array of distinct words, which of them are new)."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        h = wordhash.text_hashes(words)
        at = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == h if len(self.hashes) else np.zeros(len(h), bool)
        number = np.zeros(len(h), np.int32)
        if known.any():
            number[known] = self.numbers[at[known]]
            if len(self.words) > 1:
                self.words = [pa.concat_arrays(self.words)]
            known[known] = pc.equal(self.words[0].take(pa.array(number[known])), words.filter(pa.array(known))).to_numpy(zero_copy_only=False)
        new = np.flatnonzero(~known)
        number[new] = np.arange(self.size, self.size + len(new), dtype=np.int32)
        self.size += len(new)
        self.words.append(words.take(pa.array(new)))
        once, first = np.unique(h[new], return_index=True)
        place = np.searchsorted(self.hashes, once)
        free = place == len(self.hashes)
        free[~free] = self.hashes[place[~free]] != once[~free]
        self.hashes = np.insert(self.hashes, place[free], once[free])
        self.numbers = np.insert(self.numbers, place[free], number[new][first[free]])
        return number, new


def _blocks(batches):
    """Documents with their words -> rows of the words that the task has not met yet, then a row
    with the documents as numbers of words; an empty row where the table of words is full and
    begins anew. Documents are taken DOCS at a time, so what is held beside the table is small."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    names = ["words", "ids", "offsets", "positions", "whole", "long"]
    types = [pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.string())]
    known = WordTable()

    def row(*values):
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)

    for batch in batches:
        for first in range(0, batch.num_rows, DOCS):
            words, ids = batch.column("words").slice(first, DOCS), batch.column("doc_id").slice(first, DOCS)
            coded = words.flatten().dictionary_encode()
            number, at = known.meet(coded.dictionary)
            new = coded.dictionary.take(pa.array(at))
            short = pc.less_equal(pc.binary_length(new), LONG)
            folded = pc.if_else(short, new, pa.scalar(None, pa.string()))
            for i in range(0, len(new), CHUNK):
                part, rest = folded[i : i + CHUNK], new[i : i + CHUNK].filter(pc.invert(short[i : i + CHUNK]))
                words_ = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part)
                yield pa.RecordBatch.from_arrays([words_, *(pa.array([None], t) for t in types[1:-1]), pa.array([rest.to_pylist()], types[-1])], names=names)
            offsets = np.concatenate([[0], np.cumsum(np.diff(words.offsets.to_numpy()))]).astype("<i8")
            positions = number[coded.indices.to_numpy()].astype("<i4")
            whole = ids.is_valid().to_numpy(zero_copy_only=False).astype("u1")
            yield row(None, ids.fill_null(0).to_numpy().astype("<i8").tobytes(), offsets.tobytes(), positions.tobytes(), whole.tobytes(), None)
            if known.size > KNOWN:
                known = WordTable()
                yield row(*[None] * len(types))


class Tokens:
    """Tables of a rank file for whole arrays of symbols and ids."""

    def __init__(self, ranks: dict[bytes, int]):
        import numpy as np

        self.ranks = ranks
        self.symbol_of = {r: symbol(t, r) for t, r in ranks.items()}
        codes = np.array([ord(c) for c in self.symbol_of.values()])
        self.rank_of_code = np.zeros(int(codes.max()) + 1, "<u4")
        self.rank_of_code[codes] = list(self.symbol_of)
        sizes = np.zeros(max(ranks.values()) + 2, np.int64)
        for t, r in ranks.items():
            sizes[r + 1] = len(t)
        self.piece_at = np.cumsum(sizes)
        by_rank = {r: t for t, r in ranks.items()}
        self.pieces = np.frombuffer(b"".join(by_rank.get(r, b"") for r in range(len(sizes) - 1)), np.uint8)

    def ids(self, symbols: str):
        import numpy as np

        return self.rank_of_code[np.frombuffer(symbols.encode("utf-32-le"), "<u4")]


def spread(starts, sizes):
    """Positions of consecutive runs, each of a start and a size."""
    import numpy as np

    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class _Known:
    """Ids and bytes of numbered words, in flat arrays."""

    def __init__(self):
        import numpy as np

        self.parts: list[list] = [[np.zeros(0, t)] for t in ("<u4", np.int64, np.uint8, np.int64)]
        self.starts = None

    def add(self, *arrays):
        for into, x in zip(self.parts, arrays):
            into.append(x)
        self.starts = None

    def take(self, numbers):
        """The ids and the bytes of words, one after the other."""
        import numpy as np

        if self.starts is None:
            self.parts = [[np.concatenate(x)] for x in self.parts]
            self.flat, self.n_ids, self.pieces, self.n_bytes = (x[0] for x in self.parts)
            self.starts, self.first = np.cumsum(self.n_ids) - self.n_ids, np.cumsum(self.n_bytes) - self.n_bytes
        ids = self.flat[spread(self.starts[numbers], self.n_ids[numbers])]
        return ids, self.pieces[spread(self.first[numbers], self.n_bytes[numbers])]


def _assemble(ranks_path: str):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        tokens, known = Tokens(read_ranks(ranks_path)), _Known()
        for batch in batches:
            for row in batch.to_pylist():
                if row["symbols"] is not None:
                    very_long = iter(row["long"] or ())
                    own = [s if s is not None else "".join(tokens.symbol_of[i] for i in merge_with_heap(next(very_long).encode(), tokens.ranks)) for s in row["symbols"]]
                    n_ids = np.array([len(s) for s in own], np.int64)
                    ids = tokens.ids("".join(own))
                    # the words' bytes, by concatenating their ids' pieces
                    lengths = tokens.piece_at[ids + 1] - tokens.piece_at[ids]
                    ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(n_ids)])]
                    known.add(ids, n_ids, tokens.pieces[spread(tokens.piece_at[ids], lengths)], np.diff(ends))
                    continue
                if row["ids"] is None:
                    known = _Known()
                    continue
                docs, whole = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["whole"], "u1")
                offsets, positions = np.frombuffer(row["offsets"], "<i8"), np.frombuffer(row["positions"], "<i4")
                out: list[tuple] = []
                for k, doc in enumerate(docs.tolist()):
                    ids, decoded = known.take(positions[offsets[k] : offsets[k + 1]])
                    out.append((doc if whole[k] else None, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded.tobytes()).hexdigest()))
                if out:
                    a, b, c, d = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c), pa.array(d)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_words(words: DataFrame, ranks_path: str, word: str = "word") -> DataFrame:
    """(word, ids array<int>) of a table of words of up to LONG bytes, by the fold alone."""
    ranks = read_ranks(ranks_path)
    singles = F.lit([ranks[bytes([i])] for i in range(256)])
    code = F.transform(F.split(fold_merges(F.col(word), F.col("merges")), ""), lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("int"))
    to_id = F.transform(code, lambda c: F.when(c < 256, F.get(singles, c)).when(c < 0xD800, c - 256).otherwise(c - 0x2900))
    return with_rank_map(words.select(word), ranks).select(word, F.when(F.col(word) == "", F.array().cast("array<int>")).otherwise(to_id).alias("ids"))


def decode_ids(ids: DataFrame, ranks_path: str, col: str = "ids") -> DataFrame:
    """Adds `decoded` (binary): the ids' byte pieces, concatenated."""
    by_rank = {r: t for t, r in read_ranks(ranks_path).items()}
    pieces = F.from_json(F.lit(json.dumps([by_rank.get(i, b"").hex() for i in range(max(by_rank) + 1)])), "array<string>")
    return ids.withColumn("decoded", F.unhex(F.array_join(F.transform(col, lambda i: F.get(pieces, i)), "")))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", sent: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    short_batches(docs.sparkSession)
    words = F.regexp_extract_all(whole_text(text_col), F.lit(java_pattern(pattern)), F.lit(0))
    cut = docs.select(F.col(id_col).cast("long").alias("doc_id"), words.alias("words"))
    # several partitions a task, as far as all cores stay busy: the more a task reads, the fewer words it folds
    parts = cut.rdd.getNumPartitions()
    cut = cut.coalesce(max(1, min(parts, max(2 * docs.sparkSession.sparkContext.defaultParallelism, parts // TOGETHER))))
    blocks = cut.mapInArrow(lean(_blocks), "words array<string>, ids binary, offsets binary, positions binary, whole binary, long array<string>")
    folded = with_rank_map(blocks, read_ranks(ranks_path), sent).select(F.transform("words", lambda w: fold_merges(w, F.col("merges"))).alias("symbols"), "ids", "offsets", "positions", "whole", "long")
    return folded.mapInArrow(lean(_assemble(ranks_path)), OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return encode_documents(table(spark, sf_dir, "documents"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, sent=False)
