"""Byte-level BPE with two tiers, and its inverse.

Texts are split into pre-tokens by array operations over their characters'
classes.  A minimal perfect hash resolves the pre-tokens that are vocabulary
entries as a whole, all of a slice at once.  The rest are merged with a heap over
linked bytes, in O(n log n) however long the pre-token is, each different one
once a slice; a Python worker keeps a bounded memo of them.
"""

from __future__ import annotations

import base64
import gc
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vectext
from .common import small_batches, tidy

#: Pre-tokens in each of a memo's two generations.
TOKENS = 150_000
MASK = (1 << 64) - 1


#: The pattern that ``Splitter`` knows; others are run as expressions.
KNOWN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens of more bytes are merged by themselves, without hash or memo.
LONG = 64
#: Bytes of text split at once; longer texts are cut before spaces.
PIECE = 1 << 20

_SECOND = np.random.default_rng(97).integers(1, 1 << 63, 256, dtype=np.uint64)


def two_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each span."""
    return vectext.span_hash(buf, starts, ends), vectext.span_hash(buf, starts, ends, _SECOND)


class PerfectHash:
    """Minimal perfect hash by hash and displace; maps each key to 0..n-1.

    Buckets of about two keys are placed largest first: a bucket tries
    displacements until its keys fall on free slots.  Buckets of one key take a
    free slot directly.  A lookup is verified, so strangers give -1.
    """

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 2)
        shift = np.zeros(self.buckets, dtype=np.int64)
        slots = np.full(n, -1, dtype=np.int64)
        if len(set(keys)) != n:
            raise ValueError("keys must be distinct")
        self.keys, self.size = keys, np.array([len(k) for k in keys], dtype=np.int64)
        ends = np.cumsum(self.size)
        self.first, self.second = two_hashes(np.frombuffer(b"".join(keys), np.uint8), ends - self.size, ends)
        filed: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, x in enumerate((self.first % np.uint64(self.buckets)).tolist()):
            filed[x].append(i)
        order = sorted((b for b in range(self.buckets) if filed[b]), key=lambda b: -len(filed[b]))
        one, step = self.second.tolist(), (self.first >> np.uint64(20) | np.uint64(1)).tolist()
        free = None
        for b in order:
            own = filed[b]
            if len(own) == 1:
                if free is None:
                    free = np.flatnonzero(slots < 0).tolist()
                at = free.pop()
                slots[at], shift[b] = own[0], -1 - at
                continue
            d = 0
            while True:
                at = {((one[i] + d * step[i]) & MASK) % n for i in own}
                if len(at) == len(own) and all(slots[s] < 0 for s in at):
                    break
                d += 1
            for i in own:
                slots[((one[i] + d * step[i]) & MASK) % n] = i
            shift[b] = d
        self.shift, self.slots = shift, slots

    def find(self, first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Index in the list of keys, or -1, of spans given by their hashes and sizes."""
        if not self.n or not len(first):
            return np.full(len(first), -1, dtype=np.int64)
        d = self.shift[(first % np.uint64(self.buckets)).astype(np.int64)]
        far = second + d.astype(np.uint64) * (first >> np.uint64(20) | np.uint64(1))
        i = self.slots[np.where(d < 0, -1 - d, (far % np.uint64(self.n)).astype(np.int64))]
        return np.where((self.first[i] == first) & (self.second[i] == second) & (self.size[i] == size), i, -1)

    def get(self, key: bytes) -> int:
        """Index of one key, or -1, compared byte by byte."""
        end = np.array([len(key)])
        (i,) = self.find(*two_hashes(np.frombuffer(key, np.uint8), np.array([0]), end), end)
        return int(i) if i >= 0 and self.keys[i] == key else -1


class Splitter:
    """Pre-tokens of ``KNOWN`` by array operations; ``kinds`` has the class of every character."""

    SPACE, LETTER, NUMBER, OTHER = range(4)

    def __init__(self):
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        self.kinds = np.full(0x110000, self.OTHER, dtype=np.uint8)
        for kind, pattern in ((self.SPACE, r"\s+"), (self.LETTER, r"\p{L}+"), (self.NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                self.kinds[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
        self.kinds[0xD800:0xE000] = self.OTHER

    @staticmethod
    def characters(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points of UTF-8 bytes and where each begins."""
        at = np.flatnonzero((buf & 0xC0) != 0x80)
        point = buf[at].astype(np.int32)
        if len(at) == len(buf):
            return point, at
        lead = point.copy()
        for low, high, more, bits in ((0xC0, 0xE0, 1, 0x1F), (0xE0, 0xF0, 2, 0x0F), (0xF0, 0x100, 3, 0x07)):
            own = np.flatnonzero((lead >= low) & (lead < high))
            value = lead[own] & bits
            for k in range(1, more + 1):
                value = value << 6 | (buf[at[own] + k] & 0x3F)
            point[own] = value
        return point, at

    def __call__(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pre-tokens of the texts, in bytes."""
        point, at = self.characters(buf)
        m = len(point)
        if not m:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        kind = self.kinds[point]
        text = np.searchsorted(at, off)
        first = np.zeros(m + 1, dtype=bool)
        first[text] = True
        start = first.copy()
        start[1:m] |= kind[1:] != kind[:-1]
        # what follows white space takes a last blank along; any other last one stands alone
        b = np.flatnonzero(start[1:m] & ~first[1:m] & (kind[:-1] == self.SPACE)) + 1
        start[b - 1] = True
        start[b[point[b - 1] == 32]] = False
        # an apostrophe that begins a pre-token takes certain letters along
        q = np.flatnonzero(start[:m] & (point == 39))
        if len(q):
            end = text[np.searchsorted(text, q, side="right")]
            one, two = point[np.minimum(q + 1, m - 1)], point[np.minimum(q + 2, m - 1)]
            short = np.isin(one, [ord(c) for c in "stmd"]) & (q + 2 <= end)
            pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            pair &= q + 3 <= end
            start[q[short | pair] + 1] = False
            start[q[short] + 2] = True
            start[q[pair] + 3] = True
        begin = at[np.flatnonzero(start[:m])]
        return begin, np.append(begin[1:], len(buf))


def load_ranks(path: str) -> list[tuple[bytes, int]]:
    """Vocabulary file of lines ``base64 rank``; read on the driver only."""
    with open(path, "rb") as f:
        return [(base64.b64decode(a), int(b)) for a, b in (x.split() for x in f if x.strip())]


class Decoder:
    """Bytes of ids: the vocabulary end to end, with where each id's bytes begin."""

    def __init__(self, ranks: list[tuple[bytes, int]]):
        n = max((r for _, r in ranks), default=-1) + 1
        self.size, self.start = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
        self.data = np.frombuffer(b"".join(k for k, _ in ranks), dtype=np.uint8)
        own = np.array([r for _, r in ranks], dtype=np.int64)
        self.size[own] = [len(k) for k, _ in ranks]
        self.start[own] = np.cumsum(self.size[own]) - self.size[own]

    def __call__(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Binary array of the lists ``ids[ends[i]:ends[i + 1]]``; unknown ids raise."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size) or self.size[ids].min() < 0):
            raise ValueError("unknown id")
        sizes = self.size[ids]
        at = np.concatenate([[0], np.cumsum(sizes)])
        place = np.arange(at[-1]) + np.repeat(self.start[ids] - at[:-1], sizes)
        return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(at[ends].astype(np.int64)), pa.py_buffer(self.data[place])]).cast(pa.binary())


class Encoder:
    """Ranks and pattern, ready to encode; the vocabulary has a fixed size and is broadcast."""

    def __init__(self, ranks: list[tuple[bytes, int]], pattern: str):
        self.hash = PerfectHash([k for k, _ in ranks])
        self.rank = np.array([r for _, r in ranks], dtype=np.int32)
        self.pattern = pattern
        self.split = Splitter() if pattern == KNOWN else None
        self.ranks = dict(ranks)  # of the merges' results
        self.pairs = [self.ranks.get(bytes((i >> 8, i & 255)), -1) for i in range(1 << 16)]
        self.decoder = Decoder(ranks)

    def merge(self, piece: bytes) -> list[int]:
        """Lowest rank first, leftmost first, over a linked list of parts.

        A heap entry is a rank and a part's start in one number; it holds as long
        as the part and the one after it still join to that rank.
        """
        n, get = len(piece), self.ranks.get
        keep = list if n < 1 << 16 else lambda numbers: array("i", numbers)  # arrays take a tenth of the memory
        after, before = keep(range(1, n + 2)), keep(range(-1, n))
        pairs = self.pairs
        joined = keep(pairs[a << 8 | b] for a, b in zip(piece, piece[1:]))
        joined.append(-1)
        heap = [r << 32 | i for i, r in enumerate(joined) if r >= 0]
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            i = entry & 0xFFFFFFFF
            if joined[i] != entry >> 32:
                continue
            mid = after[i]
            stop = after[i] = after[mid]
            joined[mid] = -1
            r = -1
            if stop < n:
                before[stop] = i
                r = get(piece[i : after[stop]], -1)
                if r >= 0:
                    heapq.heappush(heap, r << 32 | i)
            joined[i] = r
            p = before[i]
            if p >= 0:
                joined[p] = r = get(piece[p:stop], -1)
                if r >= 0:
                    heapq.heappush(heap, r << 32 | p)
        out, i = [], 0
        while i < n:
            r = get(piece[i : after[i]])
            if r is None:
                raise ValueError(f"no rank for byte {piece[i : after[i]]!r}")
            out.append(r)
            i = after[i]
        return out


class Memo:
    """What ``make`` gives for bytes, in two generations of ``size`` entries."""

    def __init__(self, make, size: int):
        self.make, self.size, self.new, self.old = make, size, {}, {}

    def __call__(self, key: bytes) -> list[int]:
        out = self.new.get(key)
        if out is None:
            out = self.old.get(key) or self.make(key)
            if len(self.new) >= self.size:
                self.new, self.old = {}, self.new
            self.new[key] = out
        return out


def cuts(buf: np.ndarray, limit: int) -> list[int]:
    """Places about ``limit`` bytes apart where a text can be cut: before a blank that follows none; long runs are not cut."""
    out, at = [0], 0
    while len(buf) - at > limit:
        own = buf[at + limit // 2 : at + limit]
        found = np.flatnonzero((own[1:] == 32) & (own[:-1] != 32) & (own[:-1] < 128) & (own[:-1] > 32))
        if not len(found):  # look on, piece by piece
            step = at + limit
            while step < len(buf) and not len(found):
                own = buf[step - 1 : step + limit]
                found = np.flatnonzero((own[1:] == 32) & (own[:-1] != 32) & (own[:-1] < 128) & (own[:-1] > 32))
                place, step = step - 1, step + limit
            if not len(found):
                break
            at = place + int(found[0]) + 1
        else:
            at = at + limit // 2 + int(found[-1]) + 1
        out.append(at)
    return [*out, len(buf)]


class TextEncoder:
    """Ids of a column of texts, as one array and where each text's end."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        self.memo = Memo(encoder.merge, TOKENS)
        self.find = regex.compile(encoder.pattern).findall if encoder.split is None else None
        gc.freeze()  # the memo holds no cycles; else each collection walks through it

    def _resolve(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, and how many each has."""
        e, size = self.encoder, ends - starts
        first, second = two_hashes(buf, starts, ends)
        found = e.hash.find(first, second, size)
        count = np.ones(len(starts), dtype=np.int64)
        miss = np.flatnonzero((found < 0) & (size <= LONG))
        long = np.flatnonzero((found < 0) & (size > LONG))
        raw = buf.tobytes()
        # each different pre-token once; of equal first hashes all must have one second hash
        _, one, at = np.unique(first[miss], return_index=True, return_inverse=True)
        own = miss[one]
        if len(own) and not ((second[own][at] == second[miss]).all() and (size[own][at] == size[miss]).all()):
            own, at = miss, np.arange(len(miss))
        a, b = starts[own].tolist(), ends[own].tolist()
        lists = [self.memo(raw[x:y]) for x, y in zip(a, b)]
        lists += [e.merge(raw[x:y]) for x, y in zip(starts[long].tolist(), ends[long].tolist())]
        at = np.concatenate([at, np.arange(len(own), len(lists))])
        rest = np.concatenate([miss, long])
        lengths = np.array([len(x) for x in lists], dtype=np.int64)
        flat = np.fromiter((i for x in lists for i in x), np.int32, int(lengths.sum()))
        count[rest] = lengths[at]
        place = np.cumsum(count) - count
        out = np.empty(int(count.sum()), dtype=np.int32)
        hit = np.flatnonzero(found >= 0)
        out[place[hit]] = e.rank[found[hit]]
        n = count[rest]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(place[rest], n) + inner] = flat[np.repeat((np.cumsum(lengths) - lengths)[at], n) + inner]
        return out, count

    def _spans(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.encoder.split is not None:
            return self.encoder.split(buf, off)
        sizes = []
        for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
            sizes += [len(t.encode("utf-8")) for t in self.find(buf[a:b].tobytes().decode("utf-8"))]
        ends = np.cumsum(sizes, dtype=np.int64) if sizes else np.empty(0, np.int64)
        return ends - np.array(sizes, dtype=np.int64), ends

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = [np.empty(0, np.int32)], []
        for i, j, buf, off in vectext.slices(column, PIECE):
            places = cuts(buf, PIECE) if len(buf) > PIECE and self.encoder.split is not None else [0, len(buf)]
            n = np.zeros(j - i, dtype=np.int64)
            for a, b in zip(places[:-1], places[1:]):
                part = off if len(places) == 2 else np.array([0, b - a])
                starts, ends = self._spans(buf[a:b], part)
                own, count = self._resolve(buf[a:b], starts, ends)
                n += np.bincount(np.searchsorted(part, starts, side="right") - 1, count, j - i).astype(np.int64)
                ids.append(own)
            counts.append(n)
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)


#: The process's encoder and its memo, which stay with a worker from task to task; one at most,
#: and the encoder knows nothing of it, so the last one goes when another comes.
_current: list[tuple[Encoder, TextEncoder]] = []


def text_encoder(encoder: Encoder) -> TextEncoder:
    if not _current or _current[0][0] is not encoder:
        _current[:] = []
        _current.append((encoder, TextEncoder(encoder)))
    return _current[0][1]


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with ids (array of int) and the bytes they decode to, in place of ``text``.

    A null text counts as empty and gives no ids and no bytes.  Special tokens
    are ordinary text.  Columns of these names are replaced.  Each row is worked
    on by itself; nothing is shuffled.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(Encoder(load_ranks(ranks_path), pattern))
    kept = [f for f in docs.schema.fields if f.name not in (text, ids, decoded)]
    schema = T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType(), False)), T.StructField(decoded, T.BinaryType())])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value
        texts = text_encoder(encoder)
        for batch in batches:
            flat, ends = texts(batch.column(-1))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
            cols = [batch.column(k) for k in range(len(names))] + [lists, encoder.decoder(flat, ends)]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, ids, decoded])

    return docs.select(*[f"`{n}`" for n in names], F.col(f"`{text}`").alias("_text")).mapInArrow(tidy(run), schema)


def decode(docs: DataFrame, ranks_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the bytes of each id list; null lists give no bytes, unknown ids raise."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(Decoder(load_ranks(ranks_path)))
    kept = [f for f in docs.schema.fields if f.name != decoded]
    names = [f.name for f in kept]

    def run(batches):
        back = shared.value
        for batch in batches:
            own = [np.array(x or (), dtype=np.int64) for x in batch.column(ids).to_pylist()]
            raw = back(np.concatenate(own) if own else np.empty(0, np.int64), np.cumsum([0, *map(len, own)]))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], raw], names=[*names, decoded])

    return docs.select(*[f"`{n}`" for n in names]).mapInArrow(tidy(run), T.StructType([*kept, T.StructField(decoded, T.BinaryType())]))
