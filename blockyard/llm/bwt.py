"""Burrows-Wheeler transforms of string collections and their merge.

Each shard's strings are suffix-sorted by themselves.  ``merge`` then interleaves
the transforms: starting from any order of the shards, each round deals the
current interleave out by the symbols of the transforms, stably, which orders it
by one symbol more.  Blocks of equal prefixes come along, and the round in which
a block splits is the common prefix there.  No suffix is sorted again.  A shard
alone needs no rounds: the ranks that sorted it give its common prefixes.
"""

from __future__ import annotations

import numpy as np


class Shard:
    """Suffix order and transform of some strings, given end to end with a 0 after each.

    Symbols are whole numbers above 0.  Strings' ends differ from each other and
    come first, in order.
    """

    def __init__(self, symbols: np.ndarray):
        self.symbols = symbols
        n = len(symbols)
        stop = symbols == 0
        rank = symbols.astype(np.int64) + int(stop.sum())
        rank[stop] = np.arange(int(stop.sum()))
        self.levels: list[np.ndarray] = []  # ranks by the first 1, 2, 4 ... symbols
        step, order = 1, np.argsort(rank)
        while n:
            # ranks grow to cover twice the length, until all differ
            key = rank[order]
            new = np.empty(n, np.int64)
            new[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            if new[order[-1]] == n - 1:
                break
            self.levels.append(new.astype(np.int32))
            ahead = np.zeros(n, np.int64)
            ahead[: n - step] = new[step:] + 1
            rank = new * (n + 1) + ahead
            order = np.argsort(rank)
            step *= 2
        self.order = order
        before = symbols[order - 1] if n else symbols
        self.bwt = np.where((order == 0), 0, before) if n else symbols

    def common(self, depth: int) -> np.ndarray:
        """Common prefix of each suffix with the one before it in order, at most ``depth``."""
        n = len(self.order)
        out = np.zeros(n, np.int32)
        if n < 2:
            return out
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        for k in range(len(self.levels) - 1, -1, -1):
            # the last ranks differ all, so a prefix is shorter than their length, and equal symbols never reach an end
            same = (self.levels[k][a] == self.levels[k][b]).astype(np.int32) << k
            a += same
            b += same
            out[1:] += same
        return np.minimum(out, depth)


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merged order of all suffixes by their first ``depth`` symbols.

    Returns the shard and the place in it of each suffix in merged order, the
    block of equal prefixes it is in, and the common prefix with the suffix
    before it (at most ``depth``).  Prefixes that reach a string's end are equal
    to no other.
    """
    sizes = [len(s.bwt) for s in shards]
    n = sum(sizes)
    kind = np.uint8 if len(shards) < 256 else np.uint16
    z = np.repeat(np.arange(len(shards), dtype=kind), sizes)
    if not n:
        e = np.empty(0, np.int64)
        return e, e, e, e
    if len(shards) == 1:
        common = shards[0].common(depth)
        return z, shards[0].order, np.cumsum(common < depth, dtype=np.int32) - 1, common
    symbols = np.concatenate([s.bwt for s in shards])
    block = np.zeros(n, dtype=np.int32)
    common = np.full(n, depth, dtype=np.int32)
    common[0] = 0
    seen = np.zeros(n, dtype=bool)
    seen[0] = True
    for h in range(depth):
        read = np.argsort(z, kind="stable")  # where each shard's transform goes on being read
        sym = np.empty(n, dtype=symbols.dtype)
        sym[read] = symbols
        deal = np.argsort(sym, kind="stable")
        ends = int(np.searchsorted(sym[deal], 0, side="right"))
        deal[:ends] = deal[:ends][np.argsort(z[deal[:ends]], kind="stable")]
        z, block, sym = z[deal], block[deal], sym[deal]
        new = np.empty(n, dtype=bool)
        new[0] = False
        new[1:] = (sym[1:] != sym[:-1]) | (block[1:] != block[:-1])
        new[1:ends] = True
        block = np.cumsum(new, dtype=np.int32)
        first = new & ~seen
        common[first] = h
        seen |= first
        if block[-1] == n - 1:
            break
    place = np.empty(n, np.int64)
    place[np.argsort(z, kind="stable")] = np.concatenate([s.order for s in shards])
    return z, place, block, common


def repeated(strings: list[np.ndarray], length: int, per_shard: int = 200_000) -> np.ndarray:
    """For each symbol of the strings, laid end to end: does a string of ``length`` symbols
    that starts there start anywhere else too?"""
    total = sum(map(len, strings))
    out = np.zeros(total, dtype=bool)
    if not total:
        return out
    small = max(int(s.max()) if len(s) else 0 for s in strings) < 32767
    kind = np.int16 if small else np.int32
    shards, offsets, own, size, at = [], [], [], 0, 0
    back = []  # for each shard the position of each symbol in ``out``, or -1 for an end

    def close():
        nonlocal own, size
        if own:
            text, pos = [], []
            for s, p in own:
                text += [s.astype(kind), np.zeros(1, kind)]
                pos += [np.arange(p, p + len(s)), np.full(1, -1)]
            shards.append(Shard(np.concatenate(text)))
            back.append(np.concatenate(pos))
        own, size = [], 0

    for s in strings:
        own.append((s, at))
        at, size = at + len(s), size + len(s) + 1
        if size >= per_shard:
            close()
    close()
    z, place, _, common = merge(shards, length)
    # an interval of suffixes whose neighbours have ``length`` symbols in common is a repeated string
    many = common >= length
    many[:-1] |= many[1:].copy()
    base = np.concatenate([[0], np.cumsum([len(b) for b in back])])
    pos = np.concatenate(back)[base[z[many]] + place[many]]
    out[pos[pos >= 0]] = True
    return out
