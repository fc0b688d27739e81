"""Removal of long strings that occur more than once anywhere in the corpus.

A text that occurs twice as a whole repeats in all its windows; one of its
copies is looked at for the others' sake.

Every window of ``length`` bytes picks the ``core``-byte string with the least
hash in it (leftmost of equals).  Equal windows pick equal cores at equal
places, so repeats are decided core by core, and all that belongs to cores that
occur once is settled by one aggregation.  Windows with the same pick make a
segment.  A segment that occurs twice as a whole repeats in all its windows.

What is left are segments that share a core and differ around it.  They are
fetched, the core is put in as one symbol, and shards of them are indexed by
their Burrows-Wheeler transforms.  Intervals of windows with a common prefix of
full length repeat; a shard holds whole cores, so only the transforms of a core
that is larger than one are merged for that.  Where very many different
segments share a core, their windows are dealt to longer cores first: those
with most of their bytes before the core by the bytes just before it, the
others by the bytes just after it, which halves what the transforms have still
to compare.  That ends, for any text, when a core is a whole window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bwt, vectext
from .common import drop_table, materialize, numbered, scratched, sized, small_batches, tidy

LENGTH, CORE = 400, 300
#: Different segments of one core that go through one merge; of more, the core grows first.
SEGMENTS = 2000
#: Symbols of whole cores that are indexed at once, and at most in one shard: only what goes beyond, for a large core, is merged.
MERGED, SHARD = 200_000, 400_000
#: Rows and bytes of files of a side that is broadcast. Lists of segments take seven times their files' bytes in memory, and the driver holds the side more than once.
SIDE_ROWS, SIDE_BYTES = 200_000, 8 << 20
#: Bytes of text scanned at once; longer texts are cut in overlapping pieces.
PIECE = 1 << 18


def _side(df: DataFrame) -> DataFrame:
    return sized(df, SIDE_ROWS, SIDE_BYTES)


def _least(hashes: np.ndarray, w: int) -> np.ndarray:
    """Position of the least value, leftmost of equals, of each run of ``w`` values."""
    n = len(hashes)
    # the position in a span of 2w takes the low bits, so that minima of values are minima of pairs
    bits = max(1, int(n).bit_length())
    packed = (hashes >> np.uint64(bits) << np.uint64(bits)) | np.arange(n, dtype=np.uint64)
    pad = -n % w
    full = np.concatenate([packed, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, w)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - w + 1
    best = np.minimum(back[:m], ahead[w - 1 : w - 1 + m])
    return (best & np.uint64((1 << bits) - 1)).astype(np.int64)


def segments(buf: np.ndarray, off: np.ndarray, length: int, core: int):
    """Text, first and last window start, core start, core hash and two digest halves of each segment."""
    w = length - core + 1
    n = len(buf) - core + 1
    if n < w:
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),) * 3
    at = np.arange(n)
    h = vectext.span_hash(buf, at, at + core)
    pick = _least(h, w)  # for windows 0 .. len - length
    valid = np.zeros(len(pick), dtype=bool)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        valid[a : max(a, b - length + 1)] = True
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (pick[1:] != pick[:-1])
    inner = off[1:-1]
    inner = inner[inner < len(pick)]
    first[inner] = valid[inner]
    last = valid.copy()
    last[:-1] &= ~valid[1:] | first[1:]
    lo, hi = np.flatnonzero(first), np.flatnonzero(last)
    p, key = pick[lo], h[pick[lo]]
    del at, h, pick, valid, first, last
    # the digest stands for the segment's bytes and the core's place in them
    raw, digest = memoryview(buf), xxhash.xxh3_128_digest
    both = b"".join([digest(raw[a:b], k) for a, b, k in zip(lo.tolist(), (hi + length).tolist(), (p - lo).tolist())])
    seg = np.frombuffer(both, np.int64).reshape(-1, 2)
    return np.searchsorted(off, lo, side="right") - 1, lo, hi, p, key, seg[:, 0], seg[:, 1]


def _scan(base: DataFrame, length: int, core: int, piece: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("_row").to_numpy()
            for i, j, at, buf, off in vectext.pieces(batch.column("_text"), piece, length - 1):
                doc, lo, hi, p, key, seg, seg2 = segments(buf, off, length, core)
                if len(lo):
                    yield pa.RecordBatch.from_arrays(
                        [*map(pa.array, (rows[i:j][doc], lo - off[doc] + at, (hi - lo).astype(np.int32), (p - lo).astype(np.int32), key.view(np.int64), seg, seg2))],
                        names=["_row", "_lo", "_more", "_at", "_core", "_seg", "_seg2"],
                    )

    return base.select("_row", F.col("_text").cast("binary").alias("_text")).mapInArrow(tidy(run), "_row long, _lo long, _more int, _at int, _core long, _seg long, _seg2 long")


def _around(base: DataFrame, chosen: DataFrame, length: int, core: int) -> DataFrame:
    """The bytes before and after the core of each chosen segment, which ``_n`` numbers; a text's own are fewer than its bytes."""
    by_row = materialize(chosen.groupBy("_row").agg(F.collect_list(F.struct("_lo", "_more", "_at", "_core", "_n")).alias("_want")), "repeat-want")
    joined = base.join(_side(by_row), "_row").select(F.col("_text").cast("binary").alias("_text"), "_want")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column("_want")
            flat = want.flatten()
            lo, more, at, own, n = (flat.field(c).to_numpy() for c in ("_lo", "_more", "_at", "_core", "_n"))
            bounds = (want.offsets.to_numpy() - want.offsets[0].as_py()).tolist()
            for i, text in enumerate(batch.column("_text")):
                t = memoryview(text.as_buffer())
                for k in range(bounds[i], bounds[i + 1], 1000):
                    s = slice(k, min(k + 1000, bounds[i + 1]))
                    a, p, b = lo[s], lo[s] + at[s], lo[s] + more[s] + length
                    left = [bytes(t[x:y]) for x, y in zip(a.tolist(), p.tolist())]
                    right = [bytes(t[x + core : y]) for x, y in zip(p.tolist(), b.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(own[s]), pa.array(n[s]), pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["_core", "_n", "_left", "_right"])

    found = joined.mapInArrow(tidy(run), "_core long, _n long, _left binary, _right binary")
    return found.select(F.encode(F.hex("_core"), "US-ASCII").alias("_core"), "_n", "_left", "_right", F.lit(0).alias("_from"), F.lit(length - core).alias("_need"))


def _merged(texts: DataFrame) -> DataFrame:
    """(_n, _a, _b): runs of repeated windows of each segment, by transforms; whole cores at a time."""

    def solve(cores, number, left, right, moved, need):
        symbol, strings = {}, []
        for c, a, b in zip(cores, left, right):
            s = np.empty(len(a) + 1 + len(b), np.int32)
            s[: len(a)] = np.frombuffer(a, np.uint8)
            s[len(a)] = symbol.setdefault(c, 256 + len(symbol))
            s[len(a) + 1 :] = np.frombuffer(b, np.uint8)
            strings.append(s + 1)
        found = bwt.repeated(strings, need[0] + 1, SHARD)
        sizes = np.array([len(s) for s in strings])
        start = np.cumsum(sizes) - sizes
        edge = np.diff(found.astype(np.int8), prepend=0, append=0)
        edge[start[1:]] = np.where(found[start[1:]] & found[start[1:] - 1], 2, edge[start[1:]])  # a run ends with its segment
        begin, end = np.flatnonzero((edge == 1) | (edge == 2)), np.flatnonzero((edge == -1) | (edge == 2))
        own = np.searchsorted(start, begin, side="right") - 1
        shift = np.asarray(moved)[own] - start[own]
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(number, np.int64)[own]), pa.array((begin + shift).astype(np.int32)), pa.array((end - 1 + shift).astype(np.int32))], names=["_n", "_a", "_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = ([], [], [], [], [], []), 0
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("_core", "_n", "_left", "_right", "_from", "_need")]):
                if size and (row[5] != held[5][-1] or (size >= MERGED and row[0] != held[0][-1])):
                    yield solve(*held)
                    held, size = ([], [], [], [], [], []), 0
                for x, v in zip(held, row):
                    x.append(v)
                size += len(row[2]) + len(row[3]) + 2
        if size:
            yield solve(*held)

    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.repartition(tasks, "_core").sortWithinPartitions("_need", "_core")
    return dealt.select("_core", "_n", "_left", "_right", "_from", "_need").mapInArrow(tidy(run), "_n long, _a int, _b int")


def _longer(texts: DataFrame) -> DataFrame:
    """The same windows under longer cores: half of them with more bytes before the core, half with more after it."""
    need, left, right = F.col("_need"), F.col("_left"), F.col("_right")
    before = need - F.floor(need / 2).cast("int")  # bytes that the first half has before the core at least
    after = need - before + 1  # and the second half after it
    n_left, n_right = F.octet_length(left), F.octet_length(right)
    cut = lambda c, at, n: F.substring(c, (at + 1).cast("int"), n.cast("int"))
    rest = F.greatest(F.lit(0), n_left - before + 1)
    first = texts.where(n_left >= before).select(
        F.concat(F.encode(F.lit("<"), "US-ASCII"), cut(left, n_left - before, before), "_core").alias("_core"), "_n", cut(left, F.lit(0), n_left - before).alias("_left"), cut(right, F.lit(0), F.least(n_right, need - before)).alias("_right"), "_from", (need - before).alias("_need")
    )
    second = texts.where(n_right >= after).select(
        F.concat(F.encode(F.lit(">"), "US-ASCII"), "_core", cut(right, F.lit(0), after)).alias("_core"), "_n", cut(left, rest, n_left - rest).alias("_left"), cut(right, after, F.least(n_right - after, need - after)).alias("_right"), (F.col("_from") + rest).alias("_from"), (need - after).alias("_need")
    )
    return first.unionByName(second)


def _repeated(texts: DataFrame, most: int) -> DataFrame:
    """(_n, _a, _b): first and last of each run of windows of segment ``_n`` that another one has too."""
    hits = None
    while True:
        # a core of one segment is compared with nothing
        sizes = texts.groupBy("_core").agg(F.count("*").alias("_d")).where("_d > 1")
        sizes = materialize(sizes, "repeat-sizes")
        shared = materialize(texts.join(_side(sizes), "_core"), "repeat-texts")
        # a core that is a whole window needs no more comparison
        found = shared.where("_need = 0").select("_n", F.col("_from").alias("_a"), F.col("_from").alias("_b"))
        found = found.unionByName(_merged(shared.where((F.col("_need") > 0) & (F.col("_d") <= most))))
        found = materialize(found, "repeat-hits")
        hits = found if hits is None else hits.unionByName(found)
        hot = shared.where((F.col("_need") > 0) & (F.col("_d") > most)).drop("_d")
        if hot.isEmpty():
            drop_table(texts)
            drop_table(shared)
            return hits
        longer = materialize(_longer(hot), "repeat-longer")
        drop_table(texts)
        drop_table(shared)
        texts = longer


def _joined_spans(ranges: DataFrame) -> DataFrame:
    """Maximal runs of covered bytes of each row, from (row, start, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own in batch.column("_ranges").to_pylist():
                runs = []
                for a, b in sorted((x["a"], x["b"]) for x in own):
                    if runs and a <= runs[-1]["end"]:
                        runs[-1]["end"] = max(runs[-1]["end"], b)
                    else:
                        runs.append({"start": a, "end": b})
                out.append(runs)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(out, kind)], names=["_row", "spans"])

    grouped = ranges.groupBy("_row").agg(F.collect_set(F.struct(F.col("_a").alias("a"), F.col("_b").alias("b"))).alias("_ranges"))
    return grouped.mapInArrow(tidy(run), "_row long, spans array<struct<start:bigint,end:bigint>>")


def repeated_spans(base: DataFrame, length: int = LENGTH, core: int = CORE, most: int = SEGMENTS, piece: int = PIECE) -> DataFrame:
    """(_row, spans): bytes covered by strings of ``length`` that start anywhere else too; rows without any are left out.

    ``base`` is a table with _row (unique, the same on each reading) and _text.
    """
    digest = F.sha2(F.col("_text").cast("binary"), 256).alias("_digest")
    size = F.octet_length("_text").cast("long").alias("_size")
    long = materialize(base.where(size >= length).select("_row", digest, size), "repeat-long")
    firsts = long.groupBy("_digest", "_size").agg(F.min("_row").alias("_first"), F.count("*").alias("n")).where("n > 1")
    firsts = materialize(firsts.select("_digest", "_size", "_first"), "repeat-firsts")
    copies = _side(materialize(long.join(_side(firsts), ["_digest", "_size"]).select("_row", "_size", "_first"), "repeat-copies"))
    drop_table(long)
    once = base.join(copies.where("_row != _first"), "_row", "left_anti")
    found = materialize(_scan(once, length, core, piece), "repeat-segments")
    cores = found.groupBy("_core").agg(F.count("*").alias("n")).where("n > 1").select("_core")
    shared = materialize(found.join(materialize(cores, "repeat-cores"), "_core", "left_semi"), "repeat-shared")
    drop_table(found)
    kinds = shared.groupBy("_core", "_seg", "_seg2").agg(F.count("*").alias("_times"), F.min(F.struct("_row", "_lo", "_more", "_at")).alias("_one"))
    kinds = materialize(kinds, "repeat-kinds")
    # cores with different segments of which one at least is not settled
    open_cores = kinds.groupBy("_core").agg(F.count("*").alias("_d"), F.min("_times").alias("m")).where("_d > 1 and m = 1").select("_core")
    open_cores = _side(materialize(open_cores, "repeat-open"))
    chosen = kinds.join(open_cores, "_core", "left_semi").select("_core", "_times", "_one.*")
    chosen = materialize(chosen.withColumn("_n", F.monotonically_increasing_id()), "repeat-chosen")
    hits = _repeated(materialize(_around(base, chosen, length, core), "repeat-around"), most)
    single = chosen.where("_times = 1").select("_n", "_row", "_lo")
    fine = hits.join(single, "_n").select("_row", (F.col("_lo") + F.col("_a")).alias("_a"), (F.col("_lo") + F.col("_b") + length).alias("_b"))
    whole = materialize(kinds.where("_times > 1").select("_core", "_seg", "_seg2"), "repeat-whole")
    coarse = shared.join(whole, ["_core", "_seg", "_seg2"], "left_semi").select("_row", F.col("_lo").alias("_a"), (F.col("_lo") + F.col("_more") + length).alias("_b"))
    # a copied text is covered whole, whatever was found in the one that was looked at
    spans = _joined_spans(coarse.unionByName(fine).join(copies, "_row", "left_anti"))
    whole_text = copies.select("_row", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("_size").alias("end"))).alias("spans"))
    return materialize(spans.unionByName(whole_text), "repeat-spans")


@scratched
def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, core: int = CORE, most: int = SEGMENTS, piece: int = PIECE) -> DataFrame:
    """id, n_bytes, spans, kept for each row of ``docs``.

    ``spans`` are the maximal runs (start, end) of UTF-8 bytes covered by a
    string of ``length`` bytes that also starts somewhere else, in the same text
    or another, overlaps included; ``kept`` are the other bytes.  Both copies of
    a repeated row count.  Null texts are empty; shorter texts than ``length``
    keep all.  ``docs`` is read once; texts over ``piece`` bytes are worked on in
    overlapping pieces.  Segments are told apart by 128-bit digests, what is left
    of them by their bytes.  Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = numbered(docs.select(F.col(id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")), "repeat-docs")
    spans = repeated_spans(base.select("_row", "_text"), length, core, most, piece)
    rows = base.join(_side(spans), "_row", "left").select("_id", F.col("_text").cast("binary").alias("_text"), "spans")
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for t, own in zip(batch.column("_text"), batch.column("spans").to_pylist()):
                t = t.as_py()
                if own:
                    at, parts = 0, []
                    for s in own:
                        parts.append(t[at : s["start"]])
                        at = s["end"]
                    t = b"".join([*parts, t[at:]])
                kept.append(t)
            lengths = pa.compute.binary_length(batch.column("_text")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), lengths, batch.column("spans"), pa.array(kept, pa.binary())], names=[id, "n_bytes", "spans", "kept"])

    out = rows.mapInArrow(tidy(run), f"`{id}` {kind}, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")
    return out.withColumn("spans", F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")))
