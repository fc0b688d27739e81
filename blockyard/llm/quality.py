"""Quality scores: random-indexing word vectors, pooled, then a small network.

Every word has a sparse random index vector, drawn from its hash.  A word's
vector is the sum of the index vectors of its neighbours over the whole corpus.
Words are filed in 2^BITS buckets by hash, so the table of vectors has a fixed
size and can be broadcast; its rows are summed by Spark.  Documents
pool the vectors of their words (mean and spread) and a two-layer network turns
the pool into a probability, whose temperature is fitted on rows held out from
the training of the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vectext
from .common import least_by_hash, materialize, scratched, sized, small_batches, tidy

#: Words that share a bucket share a vector; README has the accuracy for larger tables.
BITS, DIMS, NONZERO, WINDOW = 14, 32, 2, 2
#: Labelled rows that the network is fitted on at most, chosen by a hash of the id.
SAMPLE = 20_000
EXTRA = 4
#: Tokens pooled at once; each one's vector is held meanwhile.
CHUNK = 1 << 16
WIDTH = 2 * DIMS + EXTRA

# Tokens are runs of one class: letters (and all bytes over 127), digits, the rest.
_CLASS = np.full(256, 3, dtype=np.uint8)
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1
_CLASS[48:58] = 2
_CLASS[vectext.SPACES] = 0


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each run of letters, digits or signs; case counts."""
    return vectext.tokens(buf, off, _CLASS, lower=False)[:2]


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def _index(h: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and signs of the index vector's entries that are not zero."""
    out = []
    for i in range(NONZERO):
        x = (h >> np.uint64(8 * i)).astype(np.int64)
        out.append((x % DIMS, (x >> 6 & 1) * 2 - 1))
    return out


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """2^BITS x DIMS table over all documents, rows of unit length; 2 MB whatever the corpus."""
    names, buckets = [f"c{i}" for i in range(DIMS)], 1 << BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(buckets * DIMS)
        for batch in batches:
            for _, _, buf, off in vectext.slices(batch.column("_text")):
                h, doc = tokens(buf, off)
                for k in range(0, len(h), CHUNK):
                    # pairs whose first token is one of the chunk's
                    own, at = h[k : k + CHUNK + WINDOW], doc[k : k + CHUNK + WINDOW]
                    b = _bucket(own)
                    for place, sign in _index(own):
                        for d in range(1, WINDOW + 1):
                            n = max(0, min(CHUNK, len(own) - d))
                            near = (at[d : n + d] == at[:n]).astype(np.int64)
                            table += np.bincount(b[d : n + d] * DIMS + place[:n], near * sign[:n], buckets * DIMS)
                            table += np.bincount(b[:n] * DIMS + place[d : n + d], near * sign[d : n + d], buckets * DIMS)
        table = table.reshape(buckets, DIMS).astype(np.int64)
        own = np.flatnonzero(table.any(axis=1))
        for k in range(0, len(own), 4096):
            part = own[k : k + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(part), *[pa.array(table[part, i]) for i in range(DIMS)]], names=["b", *names])

    small_batches(docs.sparkSession)
    parts = docs.select(F.col(text).cast("binary").alias("_text")).mapInArrow(tidy(run), "b long, " + ", ".join(f"{n} long" for n in names))
    rows = parts.groupBy("b").agg(*[F.sum(n).alias(n) for n in names]).toArrow()  # at most 2^BITS rows
    out = np.zeros((buckets, DIMS), dtype=np.float32)
    if rows.num_rows:
        v = np.stack([rows.column(n).to_numpy() for n in names], axis=1).astype(np.float64)
        out[rows.column("b").to_numpy()] = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    return out


def pool(h: np.ndarray, doc: np.ndarray, n: int, table: np.ndarray) -> np.ndarray:
    """Means and spreads of the vectors of each of ``n`` texts' tokens, its length, variety, strength and repetition."""
    out = np.zeros((n, WIDTH))
    count = np.bincount(doc, minlength=n).astype(np.float64)
    sums, squares = np.zeros((n, DIMS)), np.zeros((n, DIMS))
    for k in range(0, len(h), CHUNK):
        own = doc[k : k + CHUNK]
        v = table[_bucket(h[k : k + CHUNK])]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        sums[own[first]] += np.add.reduceat(v, first, axis=0, dtype=np.float64)
        squares[own[first]] += np.add.reduceat(v * v, first, axis=0, dtype=np.float64)
    some = np.flatnonzero(count)
    c = count[some, None]
    mean = sums[some] / c
    out[some, :DIMS] = mean
    out[some, DIMS : 2 * DIMS] = np.sqrt(np.maximum(squares[some] / c - mean * mean, 0))
    order = np.lexsort((h, doc))
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    out[some, 2 * DIMS] = np.log1p(c[:, 0]) / 10
    out[some, 2 * DIMS + 1] = np.bincount(doc[order][new], minlength=n)[some] / c[:, 0]
    out[some, 2 * DIMS + 2] = np.linalg.norm(mean, axis=1)
    out[some, 2 * DIMS + 3] = np.bincount(doc, again, n)[some] / c[:, 0]
    return out.astype(np.float32)


def pooled(docs: DataFrame, vectors: np.ndarray, text: str = "text", into: str = "pool") -> DataFrame:
    """``docs`` without the text, with the pooled vector: means, spreads, length and variety.

    Empty and null texts pool to zeros.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(vectors)
    kept = [f for f in docs.schema.fields if f.name not in (text, into)]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in vectext.slices(batch.column(-1)):
                out = pool(*tokens(buf, off), j - i, shared.value)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * WIDTH, WIDTH, dtype=np.int32)), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(i, j - i) for k in range(len(names))], lists], names=[*names, into])

    schema = T.StructType([*kept, T.StructField(into, T.ArrayType(T.FloatType()))])
    return docs.select(*[f"`{n}`" for n in names], F.col(f"`{text}`").cast("binary").alias("_text")).mapInArrow(tidy(run), schema)


class Network:
    """Two layers in numpy, trained by Adam with a fixed seed; ``temperature`` divides the logit."""

    def __init__(self, hidden: int = 32, epochs: int = 80, rate: float = 0.003, decay: float = 1e-4, seed: int = 5):
        self.hidden, self.epochs, self.rate, self.decay, self.seed = hidden, epochs, rate, decay, seed
        self.temperature = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1)
        return z @ self.w2 + self.b2

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(np.asarray(x, dtype=np.float64)) / self.temperature, -40, 40)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        rng = np.random.default_rng(self.seed)
        x, y = np.asarray(x, dtype=np.float64), np.asarray(y, dtype=np.float64)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        d, h = x.shape[1], self.hidden
        self.w1, self.b1 = rng.normal(0, 1 / np.sqrt(d), (d, h)), np.zeros(h)
        self.w2, self.b2 = rng.normal(0, 1 / np.sqrt(h), h), np.log((y.mean() + 0.01) / (1.01 - y.mean()))
        order = rng.permutation(len(y))
        held = order[: len(y) // 5] if len(y) >= 50 else order[:0]
        train = order[len(held) :]
        xs = (x - self.mean) / self.scale
        names = ["w1", "b1", "w2", "b2"]
        m = {k: np.zeros_like(getattr(self, k)) for k in names}
        v = {k: np.zeros_like(getattr(self, k)) for k in names}
        step = 0
        for _ in range(self.epochs):
            rng.shuffle(train)
            for s in range(0, len(train), 256):
                b = train[s : s + 256]
                z = np.tanh(xs[b] @ self.w1 + self.b1)
                p = 1 / (1 + np.exp(-np.clip(z @ self.w2 + self.b2, -40, 40)))
                g = (p - y[b]) / len(b)
                back = np.outer(g, self.w2) * (1 - z * z)
                grads = {"w1": xs[b].T @ back + self.decay * self.w1, "b1": back.sum(axis=0), "w2": z.T @ g + self.decay * self.w2, "b2": g.sum()}
                step += 1
                for k in names:
                    m[k] = 0.9 * m[k] + 0.1 * grads[k]
                    v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
                    setattr(self, k, getattr(self, k) - self.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8))
        if len(held):
            z = self.logits(x[held])
            loss = lambda t: np.mean(np.logaddexp(0, z / t) - y[held] * z / t)
            self.temperature = float(min(np.geomspace(0.5, 10, 60), key=loss))
        return self


def sample_labels(labels: DataFrame, id: str, label: str, learn: Column, limit: int) -> DataFrame:
    """At most ``limit`` labelled ids to learn from, the least by hash; null labels and ids are left out."""
    usable = labels.where(learn & F.col(label).isNotNull() & F.col(id).isNotNull())
    own = usable.groupBy(F.col(id).alias("_lid")).agg(F.max(label).cast("double").alias("_y"))
    return materialize(least_by_hash(own, "_lid", limit, usable.count()), "labels")


@scratched
def score(docs: DataFrame, labels: DataFrame, learn: Column, id: str = "doc_id", text: str = "text", label: str = "quality", limit: int = SAMPLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, ``keep``, score, pool for each row of ``docs``: probability that the label is 1.

    ``learn`` is a condition on the labels' id; only labels that meet it are
    looked at, of several of an id the greatest.  Word vectors come from all
    texts.  The network is fitted on at most ``limit`` labelled ids and ``limit``
    rows of theirs, the least by a hash of the id.  With no labels to learn from
    or with one class only, the score is the smoothed share of label 1 (0.5
    without any).  Null and empty texts pool to zeros and get the score of that.
    Other columns are ignored.
    """
    held = [f"_keep{i}" for i in range(len(keep))]
    base = docs.select(F.col(id).alias("_id"), *[F.col(k).alias(x) for k, x in zip(keep, held)], F.col(text).alias("_text"))
    pools = materialize(pooled(base, word_vectors(base, "_text"), "_text", "_pool"), "quality-pools")
    chosen = sized(sample_labels(labels, id, label, learn, limit))
    rows = pools.join(chosen, F.col("_id") == F.col("_lid")).select("_lid", "_y", "_pool").orderBy(F.xxhash64("_lid"), "_lid").limit(limit).toArrow()
    rows = rows.sort_by("_lid")
    y = rows.column("_y").to_numpy()
    n = len(y)
    back = [F.col("_id").alias(id), *[F.col(x).alias(k) for k, x in zip(keep, held)]]
    if n == 0 or y.min() == y.max():
        return pools.select(*back, F.lit((float(y.sum()) + 1) / (n + 2)).alias("score"), F.col("_pool").alias("pool"))
    x = rows.column("_pool").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, WIDTH)
    net = Network().fit(x, y)
    names = ["_id", *held, "_pool"]

    def run(batches):
        for batch in batches:
            pool = batch.column("_pool").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, WIDTH)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(net.predict(pool))], names=[*names, "_score"])

    schema = T.StructType([*[pools.schema[c] for c in names], T.StructField("_score", T.DoubleType())])
    return pools.select(*names).mapInArrow(tidy(run), schema).select(*back, F.col("_score").alias("score"), F.col("_pool").alias("pool"))
