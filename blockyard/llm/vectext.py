"""Vectorised work on the UTF-8 bytes of a batch of texts.

Python workers handle texts as one byte buffer with offsets; words, hashes and
n-grams come from array operations, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one array operation covers; longer texts form a slice of their own.
SLICE = 2 << 20

_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_ODD = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over a 64-bit word."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class _Powers:
    def __init__(self, base: int):
        self.base, self.have = base, np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.have) < n:
            out = np.full(max(n, SLICE + 1), self.base, dtype=np.uint64)
            out[0] = 1
            self.have = np.multiply.accumulate(out)
        return self.have[:n]


_POW, _INV = _Powers(_P), _Powers(_PINV)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buffer and offsets of a string or binary column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]]
    return buf, off - off[0]


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows (first, last, buffer, offsets) of about ``limit`` bytes each, no row divided."""
    buf, off = text_bytes(column)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def pieces(column: pa.Array, limit: int, overlap: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """Like ``slices`` with each row longer than ``limit`` cut: (first row, last row, place in the row, buffer, offsets).

    Pieces of a row share ``overlap`` bytes with the piece before, so every
    string of ``overlap + 1`` bytes starts in exactly one piece as a whole.
    """
    for i, j, buf, off in slices(column, limit):
        if len(buf) <= limit:
            yield i, j, 0, buf, off
            continue
        for at in range(0, max(1, len(buf) - overlap), limit - overlap):
            own = buf[at : at + limit]
            yield i, j, at, own, np.array([0, len(own)])


def runs(member: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes within each text: starts, ends, text of each run."""
    if not len(member):
        z = np.empty(0, np.int64)
        return z, z, z
    begin = member.copy()
    begin[1:] &= ~member[:-1]
    inner = off[1:-1]
    inner = inner[inner < len(member)]
    begin[inner] = member[inner]
    last = member.copy()
    last[:-1] &= ~member[1:]
    last[inner - 1] |= member[inner - 1] & (inner > 0)
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def _span_sum(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _BYTE) -> np.ndarray:
    """Polynomial of the bytes of each span; those of neighbours add up to that of both."""
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(values[buf] * _POW.upto(len(buf)), out=total[1:])
    return (total[ends] - total[starts]) * _INV.upto(len(buf) + 1)[starts]


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _BYTE) -> np.ndarray:
    """64-bit hash of the bytes of each span; another table of ``values`` gives an independent one."""
    return mix(_span_sum(buf, starts, ends, values) + (ends - starts).astype(np.uint64) * np.uint64(_P))


#: Classes of ``tokens`` for words: runs without white space.
WORDS = np.where(SPACES, 0, 1).astype(np.uint8)


def _class_runs(kind: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of one class within each text; class 0 is left out."""
    edge = np.empty(len(kind) + 1, dtype=bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[off] = True
    at = np.flatnonzero(edge)
    inside = kind[at[:-1]] > 0
    return at[:-1][inside], at[1:][inside]


def tokens(buf: np.ndarray, off: np.ndarray, classes: np.ndarray = WORDS, lower: bool = True, limit: int = SLICE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and start of each maximal run of bytes of one class; class 0 separates.

    ``lower`` hashes A-Z as a-z.  A buffer over ``limit`` is worked on piece by
    piece, and a run that a cut divides is put together again, so memory beyond
    the result is bounded however long a text or a run is.
    """
    if not len(buf):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    sums, sizes, starts_, kinds = [], [], [], []
    for at in range(0, len(buf), limit):
        own = buf[at : at + limit]
        kind = classes[own]
        inner = off[(off > at) & (off < at + len(own))] - at
        starts, ends = _class_runs(kind, inner)
        part = _span_sum(LOWER[own] if lower else own, starts, ends)
        size, kind, starts = ends - starts, kind[starts], starts + at
        if sizes and len(starts) and starts[0] == at and starts_[-1][-1] + sizes[-1][-1] == at and kinds[-1] == kind[0] and not (off == at).any():
            power = np.uint64(pow(_P, int(sizes[-1][-1]), 1 << 64))
            sums[-1][-1:] += part[:1] * power
            sizes[-1][-1] += size[0]
            part, size, starts, kind = part[1:], size[1:], starts[1:], kind[1:]
        if len(starts):
            sums.append(part)
            sizes.append(size)
            starts_.append(starts)
            kinds.append(kind[-1])
    if not sums:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    start = np.concatenate(starts_)
    return mix(np.concatenate(sums) + np.concatenate(sizes).astype(np.uint64) * np.uint64(_P)), np.searchsorted(off, start, side="right") - 1, start


def words(buf: np.ndarray, off: np.ndarray, limit: int = SLICE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word: lower-cased runs without white space."""
    return tokens(buf, off, limit=limit)[:2]


def shingles(word: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text; of fewer words, the sequence as one."""
    bounds = np.searchsorted(doc, np.arange(n_docs + 1))
    n = len(word)
    h = np.zeros(max(0, n - k + 1), dtype=np.uint64)
    for j in range(k):
        h += word[j : n - k + 1 + j] * _ODD[j]
    h = mix(h)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(h[a : b - k + 1]))
        elif b > a:
            own = (word[a:b] * _ODD[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([own], dtype=np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


class Table:
    """Fixed map from 64-bit keys to positions, with vectorised lookup (open addressing)."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 2).bit_length())
        size = 1 << self.bits
        self.keys = np.zeros(size, dtype=np.uint64)
        self.at = np.full(size, -1, dtype=np.int32)
        keys = keys.astype(np.uint64)
        todo = np.arange(len(keys), dtype=np.int32)
        slot = self._slot(keys)
        while len(todo):
            free = self.at[slot] < 0
            self.at[slot[free]] = todo[free]  # of several, the last one written stays
            won = self.at[slot] == todo
            self.keys[slot[won]] = keys[todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(_P)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, or -1."""
        keys = keys.astype(np.uint64, copy=False)
        slot = self._slot(keys)
        out = np.full(len(keys), -1, dtype=np.int32)
        todo = None
        while True:
            k, s = (keys, slot) if todo is None else (keys[todo], slot[todo])
            at = self.at[s]
            hit = (self.keys[s] == k) & (at >= 0)
            if todo is None:
                out[hit] = at[hit]
                todo = np.flatnonzero((at >= 0) & ~hit)
            else:
                out[todo[hit]] = at[hit]
                todo = todo[(at >= 0) & ~hit]
            if not len(todo):
                return out
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
