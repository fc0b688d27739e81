"""Toxicity by multiple-instance learning: sentences, noisy-or, document labels.

A sentence's probability is a logistic function of the words it holds; a
document is toxic if any sentence is, or for a reason that no sentence shows
(noisy-or with a leak).  Only document labels are known, and the gradient of the
document's likelihood trains the sentence model, which then locates the
sentences.

Words that toxic documents hold no more often than chance have no weight, and a
sentence without any other is never toxic, so length alone never makes a
document toxic.  All labelled documents are counted to judge words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vectext
from .common import least_by_hash, materialize, scratched, sized, small_batches, tidy

#: Labelled documents of either label that the model is fitted on at most, the least by a hash of the id.
SAMPLE = 8_000
#: A word is evidence if toxic documents hold it more often than chance by this many standard deviations,
EXCESS = 4.0
#: or, where fewer documents hold it, if chance does so no more often than that: the exact binomial.
LEAST_DOCS = 6
#: Words that alone make a sentence toxic with less than this probability are left out after a first fit.
LEAST_ALONE = 0.05
SPAN_LIMIT = 0.5

_LETTERS = np.zeros(256, dtype=np.uint8)
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = 1
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


def instances(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word (lower-cased run of letters), its sentence, and the sentences' bounds.

    A sentence ends after ``.``, ``!``, ``?`` or a line end, and with its text.
    """
    word, _, starts = vectext.tokens(buf, off, _LETTERS)
    cuts = np.unique(np.concatenate([off, np.flatnonzero(_STOP[buf]) + 1]))
    return word, np.searchsorted(cuts, starts, side="right") - 1, cuts


class NoisyOr:
    """Weights of the words that are evidence, the bias of a sentence with any, and the leak."""

    def __init__(self, words: np.ndarray | None = None, epochs: int = 400, rate: float = 0.05, decay: float = 0.15):
        self.words = np.empty(0, np.uint64) if words is None else np.asarray(words).view(np.uint64)
        self.table = vectext.Table(self.words)
        self.epochs, self.rate, self.decay = epochs, rate, decay
        self.weights, self.bias, self.leak = np.zeros(len(self.words)), -2.0, 0.0

    def find(self, word: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (sentence, place of a known word) pairs, by sentence."""
        at = self.table.find(word)
        known = np.flatnonzero(at >= 0)
        key = np.unique(sentence[known] * max(1, len(self.words)) + at[known])
        return key // max(1, len(self.words)), key % max(1, len(self.words))

    def loss(self, w: np.ndarray, b: float, leak: float, doc, row, word, y, c, plain) -> tuple[float, np.ndarray, float, float]:
        """Weighted negative log likelihood and its gradient by weights, bias and the leak's logit.

        ``doc``: document of each sentence; ``row``, ``word``: sentence and
        word of each pair; ``y``, ``c``: label and weight of each document;
        ``plain``: weights of the clean and the toxic documents without evidence.
        """
        z = np.clip(b + np.bincount(row, w[word], len(doc)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        o = 1 / (1 + np.exp(-leak))
        none = np.bincount(doc, np.log1p(-p), len(y)) + math.log1p(-o)  # log probability of no cause at all
        q = np.clip(-np.expm1(none), 1e-12, 1.0)
        # d loss / d z of a cause is p for label 0 and -p (1 - q) / q for label 1
        slope = c * np.where(y > 0, -np.exp(none) / q, 1.0)
        g = p * slope[doc]
        value = -(c * np.where(y > 0, np.log(q), none)).sum() - plain[0] * math.log1p(-o) - plain[1] * math.log(o)
        total = c.sum() + plain.sum()
        gw = np.bincount(word, g[row], len(w)) + self.decay * w
        return (value + self.decay * (w @ w) / 2) / total, gw / total, g.sum() / total, (o * slope.sum() + plain[0] * o - plain[1] * (1 - o)) / total

    def fit(self, doc, sentence, word, y, c, plain) -> NoisyOr:
        """Distinct (document, sentence, word) triples, words by place; other arguments as for ``loss``."""
        y, c, plain = (np.asarray(x, dtype=np.float64) for x in (y, c, plain))
        order = np.lexsort((sentence, doc))
        doc, sentence, word = doc[order], sentence[order], word[order]
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (sentence[1:] != sentence[:-1])
        row, owner = np.cumsum(new) - 1, doc[new]
        rate = (c @ y + plain[1]) / max(c.sum() + plain.sum(), 1e-9)
        x = [np.ones(len(self.words)), -2.0, math.log(min(max(rate / 4, 1e-6), 0.9))]
        m, v = [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]
        for t in range(1, self.epochs + 1):
            _, *grads = self.loss(*x, owner, row, word, y, c, plain)
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g**2
                x[k] = x[k] - self.rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-9)
        self.weights, self.bias, self.leak = x[0], float(x[1]), float(1 / (1 + np.exp(-x[2])))
        return self

    def sentences(self, word: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sentences that hold evidence, and their probabilities; all others have none."""
        own, at = self.find(word, sentence)
        own, row = np.unique(own, return_inverse=True)
        z = self.bias + np.bincount(row, self.weights[at], len(own))
        return own, 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _word_counts(rows: DataFrame) -> DataFrame:
    """w, n, t: documents that hold each word, and toxic ones among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column("_y").to_numpy()
            for i, j, buf, off in vectext.slices(batch.column("_text")):
                word, doc, _ = vectext.tokens(buf, off, _LETTERS)
                order = np.lexsort((word, doc))
                word, doc = word[order], doc[order]
                new = np.ones(len(word), dtype=bool)
                new[1:] = (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])
                own, at, n = np.unique(word[new], return_inverse=True, return_counts=True)
                t = np.bincount(at, y[i:j][doc[new]], len(own)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n), pa.array(t)], names=["w", "n", "t"])

    return rows.select("_y", "_text").mapInArrow(tidy(run), "w long, n long, t long").groupBy("w").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))


def _unlikely(rate: float) -> list[int]:
    """The n * LEAST_DOCS + t, n below LEAST_DOCS, of which chance is as rare as a normal excess of EXCESS."""
    rarely = math.erfc(EXCESS / math.sqrt(2)) / 2
    tail = lambda n, t: sum(math.comb(n, k) * rate**k * (1 - rate) ** (n - k) for k in range(t, n + 1))
    return [n * LEAST_DOCS + t for n in range(1, LEAST_DOCS) for t in range(1, n + 1) if tail(n, t) <= rarely]


def _evident(counts: DataFrame, rate: float) -> DataFrame:
    """The words that toxic documents hold more often than chance."""
    excess = (F.col("t") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    few = (F.col("n") * LEAST_DOCS + F.col("t")).isin(_unlikely(rate))
    return counts.where(F.when(F.col("n") >= LEAST_DOCS, excess >= EXCESS).otherwise(few))


def _hits(rows: DataFrame, model: NoisyOr) -> DataFrame:
    """_lid, _y and the (sentence, word) pairs of evidence of each document that has any."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    pair = pa.struct([("s", pa.int64()), ("w", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in vectext.slices(batch.column("_text")):
                word, sentence, cuts = instances(buf, off)
                s, w = shared.value.find(word, sentence)
                at = np.searchsorted(s, np.searchsorted(cuts, off)).astype(np.int32)
                items = pa.StructArray.from_arrays([pa.array(s), pa.array(w)], fields=list(pair))
                out = pa.RecordBatch.from_arrays([batch.column(c).slice(i, j - i) for c in ("_row", "_y")] + [pa.ListArray.from_arrays(pa.array(at), items)], names=["_row", "_y", "_pairs"])
                yield out.filter(pa.array(np.diff(at) > 0))

    return rows.mapInArrow(tidy(run), "_row long, _y double, _pairs array<struct<s:bigint,w:bigint>>")


@scratched
def train(docs: DataFrame, labels: DataFrame, learn: Column, id: str = "doc_id", text: str = "text", label: str = "toxic", limit: int = SAMPLE) -> NoisyOr:
    """Fit on at most ``limit`` labelled documents of either label that hold evidence; without both labels the model stays silent.

    Null labels and ids teach nothing; of several labels of an id the greatest
    counts.  Documents that share an id are each learned with its label.  All
    labelled documents count when words are judged, when the two labels are
    weighed and for the leak.
    """
    spark = docs.sparkSession
    small_batches(spark)
    every = labels.where(learn & F.col(label).isNotNull() & F.col(id).isNotNull()).groupBy(F.col(id).alias("_lid")).agg(F.max(label).cast("double").alias("_y"))
    every = materialize(every, "toxic-labels")
    own = docs.select(F.col(id).alias("_id"), F.col(text).cast("binary").alias("_text"))
    rows = own.join(sized(every), F.col("_id") == F.col("_lid")).select(F.xxhash64("_lid").alias("_row"), "_y", "_text")
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("_y"), F.lit(0.0)).alias("t")).first()
    if not 0 < total["t"] < total["n"]:
        return NoisyOr()
    found = _evident(_word_counts(rows), total["t"] / total["n"]).toArrow().sort_by("w")
    n = found.column("n")
    model = NoisyOr(found.column("w").to_numpy())

    hits = materialize(_hits(rows, model), "toxic-hits")
    held = {r["_y"]: r["n"] for r in hits.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    got = pa.concat_tables([least_by_hash(hits.where(F.col("_y") == y), "_row", limit, held.get(y, 0)).toArrow() for y in (0.0, 1.0)])
    y = got.column("_y").to_numpy()
    # each label's documents stand for all of theirs
    weight = np.array([held.get(k, 0) / max(1, (y == k).sum()) for k in (0.0, 1.0)])
    plain = np.array([total["n"] - total["t"], total["t"]]) - [held.get(0.0, 0), held.get(1.0, 0)]
    lists = got.column("_pairs").combine_chunks()
    flat, at = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    doc = np.repeat(np.arange(len(y)), np.diff(at))
    sentence, word = flat.field("s").to_numpy(), flat.field("w").to_numpy()
    model.fit(doc, sentence, word, y, weight[y.astype(int)], plain)
    # Words that the labels do not call for: many weak sentences would add up to a toxic text.
    strong = np.flatnonzero(1 / (1 + np.exp(-(model.weights + model.bias))) >= LEAST_ALONE)
    place = np.full(len(n), -1)
    place[strong] = np.arange(len(strong))
    kept = place[word] >= 0
    some = np.flatnonzero(np.bincount(doc[kept], minlength=len(y)))
    row = np.full(len(y), -1)
    row[some] = np.arange(len(some))
    c = weight[y.astype(int)]
    without = np.array([c[(y == k) & (row < 0)].sum() for k in (0.0, 1.0)])
    model = NoisyOr(model.words[strong])
    return model.fit(row[doc[kept]], sentence[kept], place[word[kept]], y[some], c[some], plain + without)


def score(docs: DataFrame, model: NoisyOr, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, score, spans: the document's probability and its offending sentences.

    ``spans`` holds (start, end, score) in bytes of the UTF-8 text for sentences
    of probability 0.5 or more.  Null and empty texts, and others without
    evidence, score the leak.  Whole texts are read, rows are independent of
    each other; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])
    schema = T.StructType([T.StructField("_id", docs.schema[id].dataType), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for i, j, buf, off in vectext.slices(batch.column("_text")):
                word, sentence, cuts = instances(buf, off)
                own, p = m.sentences(word, sentence)
                doc = np.searchsorted(off, cuts[own], side="right") - 1
                total = -np.expm1(np.bincount(doc, np.log1p(-p), j - i) + math.log1p(-m.leak))
                bad = np.flatnonzero(p >= SPAN_LIMIT)
                at = np.searchsorted(doc[bad], np.arange(j - i + 1)).astype(np.int32)
                items = pa.StructArray.from_arrays([pa.array(cuts[own[bad]] - off[doc[bad]]), pa.array(cuts[own[bad] + 1] - off[doc[bad]]), pa.array(p[bad])], names=["start", "end", "score"])
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(i, j - i), pa.array(total), pa.ListArray.from_arrays(pa.array(at), items)], names=["_id", "score", "spans"])

    out = docs.select(F.col(id).alias("_id"), F.col(text).cast("binary").alias("_text")).mapInArrow(tidy(run), schema)
    return out.withColumnRenamed("_id", id)
