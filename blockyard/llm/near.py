"""Near-duplicate groups by circulant MinHash, banding and exact verification.

A first permutation scatters shingles over 2^32 places; a second one, read at
the place shifted circularly by k, gives signature coordinate k.  Both are
bijective mixers of machine words, so no table bounds the places, and sets of
millions of shingles still differ in their signatures.

Texts with the same shingle set form one class at once, and only classes are
compared.  In each band bucket every class is compared with one leader drawn by
hash; classes that this leaves outside a bucket's largest component are then
compared with it, and with each other, in blocks bounded by classes and by
shingles.  So no bucket gives all its pairs, none is held whole by a task, and
no link between classes of a bucket is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vectext
from .common import fresh, materialize, release, scratched, sized, small_batches, tidy
from .components import components

#: 26 bands of 5 coordinates find a pair of similarity 0.8 with probability 0.99997.
BANDS, ROWS = 26, 5
#: Classes, and shingles of classes, that one comparison task holds on either side.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20

_rng = np.random.default_rng(7919)
_MIX = _rng.integers(1, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)
_SHIFTS = (np.arange(BANDS * ROWS) + 1).astype(np.uint32)
#: Shingles whose coordinates are computed at once.
_STEP = 1024


def _second(x: np.ndarray, spare: np.ndarray) -> None:
    """The second permutation, a bijection of 32-bit words, in place."""
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        np.multiply(x, np.uint32(factor), out=x)
    np.right_shift(x, np.uint32(16), out=spare)
    np.bitwise_xor(x, spare, out=x)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """BANDS * ROWS coordinates of each set: the least value of the shifted permutation over it; empty sets give the largest."""
    out = np.full((len(sets), len(_SHIFTS)), np.iinfo(np.uint32).max, dtype=np.uint32)
    size = [len(s) for s in sets]
    if not sum(size):
        return out
    # the hash's finaliser is the first permutation, its high half the place
    place = np.concatenate([(s >> np.uint64(32)).astype(np.uint32) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    x, spare = np.empty((2, _STEP, len(_SHIFTS)), dtype=np.uint32)
    for i in range(0, len(place), _STEP):
        own, n = owner[i : i + _STEP], min(_STEP, len(place) - i)
        np.add(place[i : i + n, None], _SHIFTS, out=x[:n])
        _second(x[:n], spare[:n])
        first = np.flatnonzero(np.diff(own, prepend=-1))
        least = np.minimum.reduceat(x[:n], first, axis=0)
        out[own[first]] = np.minimum(out[own[first]], least)
    return out


def signature(own: np.ndarray) -> np.ndarray:
    return signatures([own])[0]


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    h = (rows * _MIX).sum(axis=1, dtype=np.uint64)
    return vectext.mix(h + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _sets(docs: DataFrame, text: str, k: int, bands: bool) -> DataFrame:
    """Row, fingerprint of the shingle set and its size, with band keys or the set itself."""
    last = "_bands" if bands else "_set"
    schema = T.StructType([T.StructField("_row", T.LongType()), T.StructField("_id", docs.schema["_id"].dataType), T.StructField("_fp", T.BinaryType()), T.StructField("_size", T.LongType()), T.StructField(last, T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids = batch.column("_row"), batch.column("_id")
            for i, j, buf, off in vectext.slices(batch.column("_text")):
                sets = vectext.shingles(*vectext.words(buf, off), j - i, k)
                fps = [hashlib.md5(s).digest() if len(s) else None for s in sets]
                more = [s.view(np.int64) for s in sets]
                if bands:
                    more = [band_keys(g) if len(s) else s.view(np.int64) for s, g in zip(sets, signatures(sets))]
                flat = np.concatenate(more) if more else np.empty(0, np.int64)
                ends = np.cumsum([0, *map(len, more)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [rows.slice(i, j - i), ids.slice(i, j - i), pa.array(fps, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    names=["_row", "_id", "_fp", "_size", last],
                )

    small_batches(docs.sparkSession)
    return docs.select("_row", "_id", F.col(text).cast("binary").alias("_text")).mapInArrow(tidy(run), schema)


def _similar(shared, a, b, percent: int):
    """Intersection and union compared in whole numbers."""
    return 100 * shared >= percent * (a + b - shared)


def _blocked(members: DataFrame, percent: int) -> DataFrame:
    """Links between classes of different components within each bucket, found block by block."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        one = bool(pdf["_i"].iat[0] == pdf["_j"].iat[0])
        i, sets = pdf["_i"].iat[0], [np.asarray(s).view(np.uint64) for s in pdf["_set"]]
        fp, comp, side = pdf["_fp"].tolist(), pdf["_comp"].tolist(), (pdf["_block"] == i).tolist()
        size = [len(s) for s in sets]
        every = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        found, merged = [], {c: c for c in comp}

        def root(c):
            while merged[c] != c:
                merged[c] = c = merged[merged[c]]
            return c

        for n in range(len(sets)):
            if not one and not side[n]:
                continue
            at = np.searchsorted(every, sets[n])
            upto = np.searchsorted(every, sets[n], side="right")
            hits = np.concatenate([np.arange(a, b) for a, b in zip(at, upto)]) if len(at) else np.empty(0, int)
            shared = np.bincount(owner[hits], minlength=len(sets))
            for m in np.flatnonzero(shared):
                if m == n or (not one and side[m]) or root(comp[m]) == root(comp[n]):
                    continue
                if _similar(int(shared[m]), size[n], size[m], percent):
                    found.append((fp[n], fp[m]))
                    merged[root(comp[m])] = root(comp[n])
        out = pd.DataFrame(found, columns=["u", "v"])
        del every, owner, order, sets
        release()
        return out

    return members.groupBy("_bucket", "_i", "_j").applyInPandas(run, "u binary, v binary")


def _groups(docs: DataFrame, id: str, text: str, k: int, percent: int) -> DataFrame:
    """_row, _id, _size, _component of each row of ``docs``; _row is a hash of its id and text."""
    base = docs.select(F.xxhash64(F.col(id), F.col(text)).alias("_row"), F.col(id).alias("_id"), F.col(text).alias("_text"))
    rows = materialize(_sets(base, "_text", k, True), "near-rows")
    classes = rows.where("_size > 0").groupBy("_fp", "_size").agg(F.min("_row").alias("_row"), F.min("_id").alias("_least"), F.min("_bands").alias("_bands"))
    classes = materialize(classes, "near-classes")

    buckets = classes.select("_fp", "_size", "_row", F.explode("_bands").alias("_band"))
    pick = F.min(F.struct(F.xxhash64("_fp", "_band").alias("h"), F.col("_fp").alias("fp"), F.col("_size").alias("size")))
    leaders = buckets.groupBy("_band").agg(pick.alias("l"), F.count("*").alias("n")).where("n > 1")
    leaders = materialize(leaders.select("_band", F.col("l.fp").alias("_lead"), F.col("l.size").alias("_lead_size")), "near-leaders")
    buckets = materialize(buckets.join(sized(leaders), "_band"), "near-buckets")
    # each class with the leader of each of its buckets, every pair once
    pairs = buckets.where("_fp != _lead").select(F.greatest("_fp", "_lead").alias("a"), F.least("_fp", "_lead").alias("b"), F.greatest("_size", "_lead_size").alias("x"), F.least("_size", "_lead_size").alias("y"))
    pairs = pairs.where(f"100 * y >= {percent} * x").distinct()

    # full sets of the classes that share a bucket with any other; whatever else has the same hash does no harm
    chosen = materialize(buckets.select("_row").distinct(), "near-chosen")
    sets = _sets(base.join(sized(chosen), "_row", "left_semi"), "_text", k, False).where("_size > 0").select("_fp", "_set").dropDuplicates(["_fp"])
    sets = materialize(sets, "near-sets")
    one = pairs.join(sets.select(F.col("_fp").alias("a"), F.col("_set").alias("_a")), "a").select("a", "b", "_a")
    both = one.join(sets.select(F.col("_fp").alias("b"), F.col("_set").alias("_b")), "b")
    both = both.withColumn("_n", F.size(F.array_intersect("_a", "_b")))
    links = both.where(_similar(F.col("_n"), F.size("_a"), F.size("_b"), percent)).select(F.col("a").alias("u"), F.col("b").alias("v"))
    links = materialize(links, "near-links")
    found = materialize(components(links), "near-components")

    # buckets whose classes are in several components still
    names = found.select(F.col("node").alias("_fp"), "component")
    named = buckets.join(sized(names), "_fp", "left").withColumn("_comp", F.coalesce("component", "_fp")).select("_fp", "_size", "_band", "_comp")
    sizes = named.groupBy("_band", "_comp").agg(F.count("*").alias("n"), F.sum("_size").alias("s"), F.bit_xor(F.xxhash64("_fp")).alias("x"))
    main = F.max_by(F.struct("_comp", "s"), F.struct("n", "_comp"))
    mixed = sizes.groupBy("_band").agg(F.sum("n").alias("_n"), F.sum("s").alias("_s"), F.max("n").alias("_main"), main["_comp"].alias("_dom"), main["s"].alias("_main_s"), F.count("*").alias("c"), F.bit_xor("x").alias("_bucket"))
    mixed = mixed.where("c > 1 and _n > 2")  # of two, both were compared
    mixed = materialize(mixed.groupBy("_bucket", "_n", "_s", "_main", "_main_s", "_dom").agg(F.min("_band").alias("_band")), "near-mixed")
    if not mixed.isEmpty():
        # Classes outside the bucket's largest component meet that, and each other, block by block.
        count = lambda n, s: F.greatest(F.ceil(n / BLOCK), F.ceil(s / BLOCK_SHINGLES)).cast("int")
        m = named.join(sized(mixed), "_band").withColumns({"_in": F.col("_comp") == F.col("_dom"), "_inner": count(F.col("_main"), F.col("_main_s")), "_outer": count(F.col("_n") - F.col("_main"), F.col("_s") - F.col("_main_s"))})
        m = m.withColumn("_block", F.pmod(F.xxhash64("_fp"), F.when(F.col("_in"), F.col("_inner")).otherwise(F.col("_outer"))).cast("int"))
        outer, inner = F.sequence(F.lit(0), F.col("_outer") - 1), F.sequence(F.lit(0), F.col("_inner") - 1)
        pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
        met = F.transform(outer, lambda i: pair(i, -F.col("_block") - 1))
        own = F.concat(F.transform(inner, lambda j: pair(F.col("_block"), -j - 1)), F.transform(outer, lambda i: pair(F.least(i, F.col("_block")), F.greatest(i, F.col("_block")))))
        m = m.withColumn("_to", F.explode(F.when(F.col("_in"), met).otherwise(own)))
        m = m.select("_fp", "_comp", "_bucket", F.when(F.col("_in"), -F.col("_block") - 1).otherwise(F.col("_block")).alias("_block"), F.col("_to.i").alias("_i"), F.col("_to.j").alias("_j"))
        more = materialize(_blocked(m.join(sets, "_fp"), percent), "near-more")
        if not more.isEmpty():
            found = materialize(components(links.unionByName(more)), "near-components")

    names = sized(found.select(F.col("node").alias("_fp"), "component"))
    least = classes.select("_fp", "_least").join(names, "_fp", "left").select("_fp", "_least", F.coalesce("component", "_fp").alias("_comp"))
    of_comp = least.groupBy("_comp").agg(F.min("_least").alias("_id"))
    by_class = materialize(least.join(of_comp, "_comp").select("_fp", F.col("_id").alias("_least")), "near-by-class")
    out = rows.select("_row", "_id", "_fp", "_size").join(sized(by_class), "_fp", "left")
    component = F.when(F.col("_fp").isNull(), F.col("_id")).otherwise(F.col("_least"))
    return out.select("_row", "_id", "_size", component.alias("_component"))


@scratched
def near_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    Two texts are linked if their sets of distinct k-word shingles have at least
    ``percent`` of their union in common; links are confirmed on the full sets.
    ``component_id`` is the smallest id reachable over links, ``kept`` marks the
    row that has it (of rows repeated whole, every one).  ``docs`` is read twice; rows are found
    again by their ids and texts, whatever their order.  A text of fewer than k
    words is one shingle; a null or blank text has an empty set, is linked with
    nothing and is its own component.  Rows with a null id get the component of
    their texts and are not kept unless no row of the component has an id.
    """
    out = _groups(docs, id, text, k, percent)
    return out.select(F.col("_id").alias(id), F.col("_size").alias("n_shingles"), F.col("_component").alias("component_id"), F.col("_id").eqNullSafe(F.col("_component")).alias("kept"))


@scratched
def drop_near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, that of the smallest id.

    Rows are judged one by one, also where they share an id; of rows repeated
    whole every one stays.  A row with a null id stays if no row of its group
    has an id, texts without words stay.  Columns stay as they are.
    """
    gone_id, gone_row = fresh(docs.columns, "_gone", "_row")
    found = _groups(docs.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{text}`").alias("_text")), "_id", "_text", k, percent)
    gone = found.where(~F.col("_id").eqNullSafe(F.col("_component"))).select(F.col("_id").alias(gone_id), F.col("_row").alias(gone_row)).distinct()
    gone = sized(materialize(gone, "near-gone"))
    own = F.xxhash64(F.col(f"`{id}`"), F.col(f"`{text}`"))
    return docs.join(gone, F.col(f"`{id}`").eqNullSafe(F.col(gone_id)) & (own == F.col(gone_row)), "left_anti")
