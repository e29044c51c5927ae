"""Vectorised words, word hashes and n-gram hashes of Arrow text columns.

The operators on words (suffix arrays, n-gram joins) run on these NumPy arrays inside Spark
tasks.  Texts are taken from the Arrow buffers without a Python string per row, in slices
of bounded size, so memory follows ``SLICE_BYTES`` and the longest single text.

Words are maximal runs of bytes outside a separator set.  Bytes of multi-byte UTF-8
characters are never separators, so byte runs equal character runs.  Hashes have 64 bits
and depend on content alone (equal on every executor and in every run).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at a time (a longer single text is taken alone).
SLICE_BYTES = 1 << 21
_BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_C1 = np.uint64(0xBF58476D1CE4E5B9)
_C2 = np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0xD6E8FEB86659FD93)

_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Separators: ASCII white space.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Separators: all ASCII but digits and letters.
NON_ALNUM = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])

#: Byte maps: as they are, and with A-Z in lower case.
VERBATIM = np.arange(256, dtype=np.uint8)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= _C1
    x ^= x >> np.uint64(27)
    x *= _C2
    x ^= x >> np.uint64(31)
    return x


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, _BLOCK + 4096)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS


class Slice:
    """Some consecutive rows of a text column: their bytes, row ``i`` being
    ``buf[offsets[i]:offsets[i + 1]]`` (null rows are empty)."""

    __slots__ = ("first", "buf", "offsets", "starts", "ends", "bounds")

    def __init__(self, first: int, buf: np.ndarray, offsets: np.ndarray):
        self.first, self.buf, self.offsets = first, buf, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def split(self, separators: np.ndarray) -> "Slice":
        """Find the words: ``starts`` / ``ends`` (byte places) and ``bounds``
        (words of row ``i`` are ``bounds[i]:bounds[i + 1]``)."""
        word = ~separators[self.buf]
        inner = self.offsets[1:-1]
        first = np.empty(len(word) + 1, bool)
        first[0], first[-1] = True, True
        first[1:-1] = ~word[:-1]
        first[inner] = True
        last = np.empty(len(word), bool)
        if len(word):
            last[-1] = True
            last[:-1] = ~word[1:]
            last[inner[inner > 0] - 1] = True
        self.starts = np.flatnonzero(word & first[:-1])
        self.ends = np.flatnonzero(word & last) + 1
        self.bounds = np.searchsorted(self.starts, self.offsets)
        return self

    def hashes(self, to: np.ndarray = VERBATIM) -> np.ndarray:
        """A 64-bit hash of every word, its bytes mapped by ``to``."""
        table = _BYTE[to]
        starts, ends = self.starts, self.ends
        out = np.empty(len(starts), np.uint64)
        i = 0
        while i < len(starts):
            at = starts[i]
            j = max(i + 1, int(np.searchsorted(ends, at + _BLOCK, "right")))
            part = table[self.buf[at:ends[j - 1]]]
            up, down = _powers(len(part) + 1)
            part *= up[:len(part)]
            total = np.empty(len(part) + 1, np.uint64)
            total[0] = 0
            np.cumsum(part, out=total[1:])
            s = starts[i:j] - at
            out[i:j] = (total[ends[i:j] - at] - total[s]) * down[s]
            i = j
        return mix(out)


def slices(column, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut an Arrow string column into slices of at most ``limit`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column, wide = column.cast(pa.large_string()), True
    _, places, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(places, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    if column.null_count:
        dead = np.asarray(column.is_null())
        if lengths[dead].any():
            column = column.fill_null("")
            yield from slices(column, limit)
            return
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield Slice(i, raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        i = j


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each place on; ``len(h) - k + 1`` values,
    those that run over a row's end included."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = h[:n].copy()
    for j in range(1, k):
        g *= _STEP
        g += h[j:n + j]
    return mix(g)


def whole(h: np.ndarray) -> np.uint64:
    """Hash of one sequence of any length, apart from those of ``grams``."""
    with np.errstate(over="ignore"):
        g = np.uint64(len(h)) * _C2
        for x in h:
            g = g * _STEP + x
    return mix(np.array([g], np.uint64))[0]
