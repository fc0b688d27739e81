"""Language-model scores by context-tree weighting over bytes.

Each byte is coded as eight binary decisions, high bit first.  A node of the
tree belongs to a context (the last 0 to DEPTH bytes) and the bits of the byte
decided so far; it holds counts of zeros and ones over the training texts and
their Krichevsky-Trofimov block probability.  A node's weighted probability is
half its own and half the product of its children's, so all depths are mixed
with the weights that the training data give them.

The corpus is counted whole, as (DEPTH + 1)-grams summed by Spark, and every
context is a node of its own.  The tree is never in one place: grams are dealt
by the last SPLIT bytes of their context, so that a task holds whole branches
and weighs them from the leaves up; what lies above them has at most 256 to the
power of SPLIT - 1 contexts at any corpus size and is weighed on the driver.
With its weights a second pass tabulates the probability of each gram.  Grams
that occur only in texts that are not learned take part with count zero, which
leaves every weight as it is and gives them the prediction of their deepest
known context.

The ``PAIRS`` most frequent grams travel with the scorer; the others are joined
to their probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectext
from .common import materialize, scratched, sized, small_batches, tidy

DEPTH = 5
#: Bytes of context by which the tree's branches are dealt.
SPLIT = 3
#: Grams (a context and a byte) that travel with the scorer; the others are joined.
PAIRS = 600_000
#: Grams whose branches a task weighs at a time; a branch is never divided.
CHUNK = 100_000
#: Most frequent words that travel with the scorer; counts of the others are joined.
WORDS = 300_000
#: Rows of a side that is broadcast at most, beside what travels with the scorer.
SIDE = 200_000
#: Distinct grams that a counting task holds before it hands them on.
HELD = 1_500_000

_GAMMA = np.array([1 / 12, -1 / 360, 1 / 1260, -1 / 1680])


def lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0, to about 1e-12."""
    x = np.asarray(x, dtype=np.float64)
    low = np.zeros_like(x)
    for i in range(8):
        low += np.log(x + i)
    y = x + 8
    r, y2 = 1 / y, y * y
    series = np.zeros_like(x)
    for c in _GAMMA:
        series += c * r
        r = r / y2
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - low


def kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log block probability of a zeros and b ones by the KT estimator."""
    return lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - np.log(np.pi)


def grams(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each byte, itself and the DEPTH bytes before it, packed; zeros before a text's start."""
    out = np.zeros(len(buf), dtype=np.int64)
    since = np.arange(len(buf)) - np.repeat(off[:-1], np.diff(off)) if len(buf) else out
    for d in range(DEPTH, -1, -1):
        out <<= 8
        if d == 0:
            out |= buf
        else:
            out[d:] |= np.where(since[d:] >= d, buf[:-d], 0)
    return out


def gram_pieces(buf: np.ndarray, off: np.ndarray, limit: int = vectext.SLICE) -> Iterator[tuple[int, np.ndarray]]:
    """Where each piece of the buffer begins, and its ``grams``; a text over ``limit`` bytes, which has the buffer alone, is cut."""
    if len(buf) <= limit:
        yield 0, grams(buf, off)
        return
    for at in range(0, len(buf), limit):
        before = min(at, DEPTH)
        own = buf[at - before : at + limit]
        yield at, grams(own, np.array([0, len(own)]))[before:]


def _counts(docs: DataFrame) -> DataFrame:
    """Partial counts of words (kind 0) and grams (kind 1) over whole texts: n in learned ones, m in all.

    Words are those of learned texts, grams those of all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kind, held):
            key, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return [(key, *(np.bincount(at, np.concatenate([h[i] for h in held])).astype(np.int64) for i in (1, 2)))], kind

        def rows(kind, *held):
            for i in range(0, len(held[0]), 65536):
                own = [x[i : i + 65536] for x in held]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own[0]), kind, np.int32)), *map(pa.array, own)], names=["kind", "key", "n", "m"])

        held = {0: [], 1: []}
        size = {0: 0, 1: 0}
        for batch in batches:
            learned = batch.column("_learn").to_numpy(zero_copy_only=False).astype(bool)
            for i, j, buf, off in vectext.slices(batch.column("_text")):
                word, doc = vectext.words(buf, off)
                taught = learned[i:j]
                word = word[taught[doc]]
                learnt = np.repeat(taught, np.diff(off))
                for kind, own, use in ((0, word.view(np.int64), None), *((1, g, learnt[at : at + len(g)]) for at, g in gram_pieces(buf, off))):
                    if not len(own):
                        continue
                    key, at, m = np.unique(own, return_inverse=True, return_counts=True)
                    n = m if use is None or use.all() else np.bincount(at, use).astype(np.int64)
                    held[kind].append((key, n, m))
                    size[kind] += len(key)
                    if size[kind] > HELD:
                        held[kind], _ = out(kind, held[kind])
                        size[kind] = len(held[kind][0][0])
                        if size[kind] > HELD // 2:
                            yield from rows(kind, *held[kind][0])
                            held[kind], size[kind] = [], 0
        for kind in (0, 1):
            if held[kind]:
                yield from rows(kind, *out(kind, held[kind])[0][0])

    small_batches(docs.sparkSession)
    own = docs.select(F.coalesce("_learn", F.lit(False)).alias("_learn"), F.col("_text").cast("binary").alias("_text"))
    return own.mapInArrow(tidy(run), "kind int, key long, n long, m long")


def _threshold(counts: DataFrame, limit: int, pairs: Column) -> int:
    """Least power of two such that contexts that frequent hold at most ``limit`` pairs."""
    levels = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).agg(F.sum(pairs).alias("p")).orderBy(F.desc("level")).collect()  # at most 63 rows
    total, least = 0, 62
    for r in levels:
        total += r["p"]
        if total > limit:
            break
        least = r["level"]
    return 1 << least


class Tree:
    """The tree in one place, for counts that fit: log10 of each byte's probability by its deepest kept context."""

    def __init__(self, pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """``pairs``: for each depth the context, the byte and its count; depth 0 holds all bytes."""
        self.depth = len(pairs) - 1
        self.contexts = [np.unique(c) for c, _, _ in pairs]
        if not len(self.contexts[0]):
            self.contexts[0] = np.zeros(1, np.int64)
        nodes = []  # for each depth: keys, zeros, ones
        for ctx, byte, n in pairs:
            key, one = [], []
            for bit in range(8):
                key.append((ctx << 8) | (1 << bit) | (byte >> (8 - bit)))
                one.append(byte >> (7 - bit) & 1)
            key, at = np.unique(np.concatenate(key) if len(ctx) else np.empty(0, np.int64), return_inverse=True)
            n8, one = np.tile(n, 8).astype(np.float64), np.concatenate(one) if len(ctx) else np.empty(0)
            b = np.bincount(at, n8 * one, len(key))
            nodes.append((key, np.bincount(at, n8, len(key)) - b, b))
        self.nodes = nodes
        below = None  # log weighted probability of the next depth's nodes
        self.own, self.rest, self.weight = [], [], []
        for d in range(self.depth, -1, -1):
            key, a, b = nodes[d]
            block = kt(a, b)
            self.own.append((b + 0.5) / (a + b + 1))
            if d == self.depth:
                self.rest.append(self.own[-1])
                self.weight.append(np.ones(len(key)))
                below = block
            else:
                ckey, ca, cb = nodes[d + 1]
                # a child's context has one more byte on its far (high) side
                parent = (ckey >> 8 & ((1 << 8 * d) - 1)) << 8 | (ckey & 255)
                at = np.searchsorted(key, parent)
                # float sums of whole numbers below 2^53 are exact
                ra = a - np.bincount(at, ca, len(key))
                rb = b - np.bincount(at, cb, len(key))
                split = np.bincount(at, below, len(key)) + kt(ra, rb)
                both = np.logaddexp(block, split) - np.log(2)
                self.rest.append((rb + 0.5) / (ra + rb + 1))
                self.weight.append(np.exp(block - np.log(2) - both))
                below = both
        for x in (self.own, self.rest, self.weight):
            x.reverse()
        keep = [(c << 8 | x) for c, x, _ in pairs]
        self.pairs = [vectext.Table(k) for k in keep]
        self.logs = [self.log10(d, c, x).astype(np.float32) for d, (c, x, _) in enumerate(pairs)]
        self.deep = [vectext.Table(c) for c in self.contexts]

    def log10(self, depth: int, ctx: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """log10 probability of each byte whose deepest kept context has ``depth`` bytes."""
        out = np.zeros(len(ctx))
        for bit in range(8):
            prefix = (1 << bit) | (byte >> (8 - bit))
            one = byte >> (7 - bit) & 1
            p = None
            for d in range(depth, -1, -1):
                key, a, b = self.nodes[d]
                want = (ctx & ((1 << 8 * d) - 1)) << 8 | prefix
                at = np.minimum(np.searchsorted(key, want), max(0, len(key) - 1))
                seen = key[at] == want if len(key) else np.zeros(len(want), bool)
                if p is None:
                    p = self.rest[d][at] if len(key) else np.full(len(want), 0.5)
                    p = np.where(seen, p, 0.5)
                    if d == self.depth or not len(key):
                        continue
                if len(key):
                    w, k = np.where(seen, self.weight[d][at], 0.5), np.where(seen, self.own[d][at], 0.5)
                    p = w * k + (1 - w) * p
            out += np.log10(np.where(one, p, 1 - p))
        return out

    def score(self, gram: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each gram after the bytes before it."""
        out = np.zeros(len(gram))
        ctx, byte = gram >> 8, gram & 255
        todo = np.arange(len(gram))
        for d in range(self.depth, -1, -1):
            c = ctx[todo] & ((1 << 8 * d) - 1)
            here = self.deep[d].find(c) >= 0 if d else np.ones(len(todo), bool)
            own, c = todo[here], c[here]
            at = self.pairs[d].find(c << 8 | byte[own])
            known = at >= 0
            out[own[known]] = self.logs[d][at[known]]
            if not known.all():
                out[own[~known]] = self.log10(d, c[~known], byte[own[~known]])
            todo = todo[~here]
            if not len(todo):
                break
        return out


class Level:
    """Nodes of one depth: for each bit those of a context and the byte's bits before it, with weights."""

    def __init__(self, pair: np.ndarray, n: np.ndarray):
        """``pair``: contexts and bytes, packed, ascending and distinct; ``n`` their counts."""
        self.pair, self.n = pair, n
        self.node, self.start, self.zeros, self.ones = [], [], [], []
        for bit in range(8):
            head = pair >> (8 - bit)
            new = np.ones(len(pair), dtype=bool)
            new[1:] = head[1:] != head[:-1]
            start = np.flatnonzero(new)
            ones = np.add.reduceat(n * (pair >> (7 - bit) & 1), start)
            self.node.append((np.cumsum(new) - 1).astype(np.int32))
            self.start.append(start)
            self.zeros.append(np.add.reduceat(n, start) - ones)
            self.ones.append(ones)

    def above(self, depth: int) -> Level:
        """The level of ``depth`` over this one; ``up`` has each pair's place in it."""
        pair, self.up = np.unique(self.pair & ((1 << 8 * (depth + 1)) - 1), return_inverse=True)
        return Level(pair, np.bincount(self.up, self.n, len(pair)))

    def weigh(self, below: list[np.ndarray] | None) -> list[np.ndarray]:
        """Log weighted probabilities of the nodes, given the sums of their children's; leaves have none."""
        self.weight, out = [], []
        for bit in range(8):
            block = kt(self.zeros[bit], self.ones[bit])
            both = block if below is None else np.logaddexp(block, below[bit]) - np.log(2)
            self.weight.append(np.ones(len(block)) if below is None else np.exp(block - np.log(2) - both))
            out.append(both)
        return out

    def mix(self, known: list[np.ndarray], left: list[np.ndarray]) -> None:
        """Probability of a one that the depths down to this give, and the weight left for deeper ones."""
        self.known, self.left = [], []
        for bit, (w, a, b) in enumerate(zip(self.weight, self.zeros, self.ones)):
            self.known.append(known[bit] + left[bit] * w * (b + 0.5) / (a + b + 1))
            self.left.append(left[bit] * (1 - w))

    def mix_under(self, parent: Level, up: np.ndarray) -> None:
        """``mix`` below ``parent``, in which ``up`` is the place of each pair."""
        at = [parent.node[bit][up[self.start[bit]]] for bit in range(8)]
        self.mix([parent.known[bit][at[bit]] for bit in range(8)], [parent.left[bit][at[bit]] for bit in range(8)])


def _climb(level: Level, depth: int, top: int, below: list[np.ndarray] | None) -> tuple[list[Level], list[np.ndarray]]:
    """The levels from ``depth`` up to ``top``, weighed, and the top one's log weighted probabilities."""
    levels = [level]
    value = level.weigh(below)
    for d in range(depth - 1, top - 1, -1):
        parent = level.above(d)
        sums = [np.bincount(parent.node[bit][level.up[level.start[bit]]], value[bit], len(parent.start[bit])) for bit in range(8)]
        value = parent.weigh(sums)
        level = parent
        levels.append(level)
    return levels, value


def _branches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Grams, n and m of whole branches at a time, grams ascending; the rows come branch by branch."""

    def out(key, n, m):
        order = np.argsort(key)
        return key[order], n[order].astype(np.float64), m[order]

    held, size, limit = [], 0, CHUNK
    for batch in batches:
        own = tuple(batch.column(c).to_numpy() for c in ("key", "n", "m"))
        if not len(own[0]):
            continue
        held.append(own)
        size += len(own[0])
        if size >= limit:
            whole = [np.concatenate(x) for x in zip(*held)]
            branch = _branch(whole[0])
            cut = int(np.flatnonzero(branch != branch[-1])[-1]) + 1 if branch[0] != branch[-1] else 0
            if cut:
                yield out(*(x[:cut] for x in whole))
            held, size = [tuple(x[cut:] for x in whole)], size - cut
            limit = CHUNK if cut else 2 * size
    if held:
        yield out(*(np.concatenate(x) for x in zip(*held)))


def _branch(key: np.ndarray) -> np.ndarray:
    return key >> 8 & ((1 << 8 * SPLIT) - 1)


def _model(grams: DataFrame) -> DataFrame:
    """key, m and log10 probability of every gram, by the tree of the counts n; a scratch table."""
    spark = grams.sparkSession
    branch = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * SPLIT) - 1))
    dealt = grams.withColumn("branch", branch).repartition("branch").sortWithinPartitions("branch").select("key", "n", "m")
    top = SPLIT - 1

    def lift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n, _ in _branches(batches):
            levels, value = _climb(Level(key, n), DEPTH, SPLIT, None)
            low = levels[-1]
            mask = (1 << 8 * (top + 1)) - 1
            pair, up = np.unique(low.pair & mask, return_inverse=True)
            kinds, keys, values = [np.full(len(pair), -1, np.int32)], [pair], [np.bincount(up, low.n)]
            for bit in range(8):
                node, at = np.unique((low.pair[low.start[bit]] & mask) >> (8 - bit), return_inverse=True)
                kinds.append(np.full(len(node), bit, np.int32))
                keys.append(node)
                values.append(np.bincount(at, value[bit]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (kinds, keys, values)], names=["bit", "key", "value"])

    small_batches(spark)
    lifted = dealt.mapInArrow(tidy(lift), "bit int, key long, value double").groupBy("bit", "key").agg(F.sum("value").alias("value"))
    # Contexts of ``top`` bytes and what lies under each of their nodes: a number that the alphabet bounds.
    rows = materialize(lifted, "ctw-trunk").toArrow()
    bits, keys, values = (rows.column(c).to_numpy() for c in ("bit", "key", "value"))
    trunk = None
    if len(keys):
        found = []
        for bit in range(-1, 8):
            own = np.flatnonzero(bits == bit)
            own = own[np.argsort(keys[own])]
            found.append((keys[own], values[own]))
        trunk = Level(*found[0])
        levels, _ = _climb(trunk, top, 0, [v for _, v in found[1:]])
        root = levels[-1]
        root.mix([0.0] * 8, [1.0] * 8)
        for parent, level in zip(levels[::-1], levels[-2::-1]):
            level.mix_under(parent, level.up)
    shared = spark.sparkContext.broadcast(trunk)

    def tabulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n, m in _branches(batches):
            levels, _ = _climb(Level(key, n), DEPTH, SPLIT, None)
            low, leaf = levels[-1], levels[0]
            low.mix_under(shared.value, np.searchsorted(shared.value.pair, low.pair & ((1 << 8 * (top + 1)) - 1)))
            for parent, level in zip(levels[::-1], levels[-2::-1]):
                level.mix_under(parent, level.up)
            log = np.zeros(len(key))
            for bit in range(8):
                one = leaf.known[bit][leaf.node[bit]]
                log += np.log10(np.where(key >> (7 - bit) & 1, one, 1 - one))
            for i in range(0, len(key), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 65536]) for x in (key, m, log)], names=["key", "m", "log"])

    return materialize(dealt.mapInArrow(tidy(tabulate), "key long, m long, log double"), "ctw-model")


def _rarest(key: np.ndarray, doc: np.ndarray, n: int) -> pa.ListArray:
    """For each of ``n`` texts its distinct keys and how often each occurs."""
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(key)))
    starts = np.searchsorted(doc[first], np.arange(n + 1)).astype(np.int32)
    items = pa.StructArray.from_arrays([pa.array(key[first].view(np.int64)), pa.array(times.astype(np.int32))], names=["w", "t"])
    return pa.ListArray.from_arrays(pa.array(starts), items)


@scratched
def score(docs: DataFrame, learn: Column, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), pairs: int = PAIRS, words: int = WORDS) -> DataFrame:
    """Scores of every row of ``docs`` by a model of those that meet ``learn``.

    Columns: id, ``keep``, n_bytes, score (log10 probability of the text's
    bytes), bits_per_byte (code length), and the word baseline: n_tokens,
    n_known, train_tokens, base_score.  A token is a lower-cased word or the end
    of the text; words are told apart by 64-bit hashes.  Null texts are empty:
    score 0, one token.  A text begins in the context of zero bytes.  Rows are
    independent, repeated rows score alike; a corpus with nothing to learn from
    gives every bit one half.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id).alias("_id"), learn.alias("_learn"), *[F.col(k).alias(f"_keep{i}") for i, k in enumerate(keep)], F.col(text).alias("_text"))
    train = base.where("_learn")
    counts = materialize(_counts(base).groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "ctw-counts")
    vocabulary = counts.where("kind = 0").select("key", "n")
    ends = train.count()
    sums = vocabulary.agg(F.sum("n"), F.count("*")).first()
    total, distinct = (sums[0] or 0) + ends, sums[1] + (ends > 0)
    model = _model(counts.where("kind = 1").select("key", "n", "m"))
    seldom = _threshold(model.select(F.col("m").alias("n")), pairs, F.lit(1))
    often = model.where(F.col("m") >= seldom).select("key", "log").toArrow()  # at most ``pairs``
    least = _threshold(vocabulary, words, F.lit(1))
    rows = vocabulary.where(F.col("n") >= least).toArrow()  # at most ``words``
    shared = spark.sparkContext.broadcast(tuple(t.column(c).to_numpy() for t, c in ((often, "key"), (often, "log"), (rows, "key"), (rows, "n"))))
    floor = total + 0.1 * (distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, logs, word, often = shared.value
        table, usual = vectext.Table(word.view(np.uint64)), vectext.Table(gram.view(np.uint64))
        value = np.log10((often + 0.1) / floor)
        end = np.log10((ends + 0.1) / floor)
        for batch in batches:
            for i, j, buf, off in vectext.slices(batch.column("_text")):
                n = j - i
                log, odd, owners = np.zeros(n), [], []
                for begin, own in gram_pieces(buf, off):
                    at = usual.find(own.view(np.uint64))
                    owner = np.searchsorted(off, np.arange(begin, begin + len(own)), side="right") - 1
                    known = np.flatnonzero(at >= 0)
                    log += np.bincount(owner[known], logs[at[known]], n)
                    new = np.flatnonzero(at < 0)
                    odd.append(own[new])
                    owners.append(owner[new])
                grammar = _rarest(np.concatenate(odd), np.concatenate(owners), n)
                h, doc = vectext.words(buf, off)
                at = table.find(h)
                hit = at >= 0
                known = np.bincount(doc[hit], minlength=n) + (ends > 0)
                likely = np.bincount(doc[hit], value[at[hit]], n) + end
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_row").slice(i, n), pa.array(np.diff(off)), pa.array(log), pa.array(np.bincount(doc, minlength=n) + 1), pa.array(known), pa.array(likely), _rarest(h[~hit], doc[~hit], n), grammar, *[batch.column(c).slice(i, n) for c in carried]],
                    names=["_row", "n_bytes", "score", "n_tokens", "_known", "_base", "_rare", "_odd", *carried],
                )

    carried = ["_id", *[f"_keep{i}" for i in range(len(keep))]]
    kinds = {f.name: f.dataType.simpleString() for f in base.schema.fields}
    schema = "_row long, n_bytes long, score double, n_tokens long, _known long, _base double, _rare array<struct<w:bigint,t:int>>, _odd array<struct<w:bigint,t:int>>, " + ", ".join(f"{c} {kinds[c]}" for c in carried)
    numbered = base.select(F.monotonically_increasing_id().alias("_row"), *carried, F.col("_text").cast("binary").alias("_text"))
    out = materialize(numbered.mapInArrow(tidy(run), schema), "ctw-rows")

    # words too rare to travel with the scorer
    rare = out.select("_row", F.explode("_rare").alias("r")).select("_row", "r.w", "r.t")
    found = rare.join(sized(vocabulary.where(F.col("n") < least), SIDE), rare["w"] == vocabulary["key"], "left")
    gain = F.sum(F.col("t") * F.log10((F.coalesce("n", F.lit(0)) + 0.1) / floor))
    sums = materialize(found.groupBy("_row").agg(gain.alias("_more"), F.sum(F.when(F.col("n") > 0, F.col("t")).otherwise(0)).alias("_seen")), "ctw-rare")
    # and grams
    odd = out.select("_row", F.explode("_odd").alias("r")).select("_row", "r.w", "r.t")
    priced = odd.join(sized(model.where(F.col("m") < seldom).select("key", "log"), SIDE), F.col("w") == F.col("key"))
    logs = materialize(priced.groupBy("_row").agg(F.sum(F.col("t") * F.col("log")).alias("_log")), "ctw-odd")
    out = out.drop("_rare", "_odd").join(sized(sums, SIDE), "_row", "left").join(sized(logs, SIDE), "_row", "left")
    return out.select(
        F.col("_id").alias(id),
        *[F.col(f"_keep{i}").alias(k) for i, k in enumerate(keep)],
        "n_bytes",
        "n_tokens",
        (F.col("_known") + F.coalesce("_seen", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("_base") + F.coalesce("_more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("_log", F.lit(0.0))).alias("score"),
        F.when(F.col("n_bytes") > 0, -(F.col("score") + F.coalesce("_log", F.lit(0.0))) / F.log10(F.lit(2.0)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
