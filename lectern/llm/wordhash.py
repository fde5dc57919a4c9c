"""Words of Arrow text columns and their 64-bit hashes, computed on whole byte buffers.

A word is a run of bytes outside \\x20 and \\x09-\\x0D, with A-Z lower-cased. Its hash is a
polynomial over random byte values modulo 2**64, finished by a bit mixer, so equal words
have equal hashes everywhere and different ones collide with a chance near 2**-64.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
MULT = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_R = int(_RNG.integers(1, 2**62)) * 2 + 1
_POWERS: list = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
CHUNK_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n + 1:
        size = max(n + 1, CHUNK_BYTES + 1)
        for k, r in enumerate((_R, pow(_R, -1, 2**64))):
            x = np.full(size, r, np.uint64)
            x[0] = 1
            _POWERS[k] = np.cumprod(x)
    return _POWERS[0], _POWERS[1]


class Words:
    """The words of some documents: `hash`, byte positions `start` and `end` within `data`,
    and `bounds`, so that document k has words bounds[k] to bounds[k + 1]."""

    def __init__(self, data: np.ndarray, doc_starts: np.ndarray, inside: np.ndarray | None = None):
        """`inside` tells the bytes of words; by default all but spaces are."""
        n = len(data)
        self.data = data
        solid = np.append(~_SPACE[data] if inside is None else inside, False)
        before = np.empty(n + 1, bool)
        before[0] = False
        before[1:] = solid[:-1]
        cuts = doc_starts[doc_starts <= n]
        begin = solid & ~before
        begin[cuts] |= solid[cuts]
        stop = before & ~solid
        stop[cuts] |= before[cuts]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(stop)
        self.bounds = np.searchsorted(self.start, doc_starts)
        up, self._down = _powers(n)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[:n], out=self._sums[1:])
        self.hash = self._hash(self.start, self.end)

    def _hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._down[start])

    def beginnings(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of `size` bytes or more, by number, and the hashes of their first bytes."""
        long = np.flatnonzero(self.end - self.start >= size)
        return long, self._hash(self.start[long], self.start[long] + size)


def _buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an Arrow string array without nulls."""
    import pyarrow as pa

    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def chunks(column, chunk_bytes: int = CHUNK_BYTES, kind=Words):
    """(first row, Words or another kind) for runs of whole rows of about `chunk_bytes`. Memory
    follows the larger of that and the longest text. Null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    at, data = _buffers(column)
    row, rows = 0, len(column)
    while row < rows:
        last = max(row + 1, int(np.searchsorted(at, at[row] + chunk_bytes, "right")) - 1)
        last = min(last, rows)
        yield row, kind(data[at[row] : at[last]], at[row : last + 1] - at[row])
        row = last


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of one document's word hashes; with
    fewer words the whole sequence is one shingle, without words there is none."""
    n = len(words)
    if n == 0:
        return words
    m = min(n, k)
    acc = np.full(n - m + 1, np.uint64(m), np.uint64)
    for j in range(m):
        acc += words[j : n - m + 1 + j] * MULT[j]
    return np.unique(mix(acc))


_EXACT = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def text_hashes(column) -> np.ndarray:
    """64-bit hashes of the texts of an Arrow string array without nulls, case and all."""
    at, data = _buffers(column)
    data = data[at[0] : at[-1]] if len(data) else data
    at = at - at[0]
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_EXACT[data] * up[: len(data)], out=sums[1:])
    size = np.diff(at).astype(np.uint64)
    return mix((sums[at[1:]] - sums[at[:-1]]) * down[at[:-1]] + size * np.uint64(_R))
