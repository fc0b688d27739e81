"""Benchmark passages inside documents, by size-partitioned MinHash containment.

A document's shingles are first restricted to those of any benchmark item, which
changes no containment; signatures of whole documents would need some 16 / J
coordinates, thousands for a short item in a long document.  What is left is
filed by size; for each pair of a document's size class and an item's, the
containment threshold gives a Jaccard threshold, and that the number of MinHash
coordinates that find a pair with probability 1 - 1e-7.  Where that number
passes ``COORDINATES`` (a document that holds over eight times the item's
shingles, many items that is), pairs come from single shingles instead, which
misses nothing.  Candidates are confirmed on exact shingle sets.  DataFrame code
only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, fresh, materialize, scratched, sized, table_bytes, text_digest, words

#: Coordinates at most; 160 reach pairs in which the document has up to eight times the item's shingles.
COORDINATES = 160
MISS = 1e-7
#: Benchmark shingles, about, that travel to a scan of the documents at a time.
UNIVERSE = 800_000


def coordinates(doc_class: int, item_class: int, percent: int) -> int:
    """MinHash coordinates for documents of 2^d to 2^(d+1)-1 shingles and items of 2^i and more; 0: cannot contain."""
    most, least, t = 2 ** (doc_class + 1) - 1, 2**item_class, percent / 100
    if most < t * least:
        return 0
    jaccard = min(1.0, t / (most / least + 1 - t))
    return 1 if jaccard >= 1 else math.ceil(math.log(MISS) / math.log(1 - jaccard))


def _gram(ws: str, i: Column, k: int) -> list[Column]:
    return [F.element_at(ws, i + j) for j in range(k)]


def _class(n: Column) -> Column:
    return F.floor(F.log2(n)).cast("int")


def _positions(rows: DataFrame, ws: str, k: int, *keep: str) -> DataFrame:
    """One row per k-word shingle of ``rows``: its hash _h, with ``ws``, its place _i and other columns."""
    at = rows.where(F.size(ws) >= k).select(*keep, ws, F.explode(F.sequence(F.lit(1), F.size(ws) - k + 1)).alias("_i"))
    return at.withColumn("_h", F.xxhash64(F.lit(k), *_gram(ws, F.col("_i"), k)))


def _spelt(ws: str, k: int) -> Column:
    return F.concat_ws(" ", *_gram(ws, F.col("_i"), k))


def _minhashes(own: Column, n: int) -> Column:
    """Array over coordinates of the shingle number with the least hash."""
    least = lambda j: F.array_min(F.transform(own, lambda s: F.struct(F.xxhash64(s, j).alias("h"), s.alias("s"))))["s"]
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), least)


def _found(
    docs: DataFrame, items: DataFrame, id: str, text: str, item_id: str, item_text: str, k: int, percent: int
) -> DataFrame | None:
    """_id, _doc (the text's digest), _item, _n, _ni of each pair; None without items."""
    bench = items.select(F.col(item_id).alias("_item"), words(F.col(item_text)).alias("_ws")).where(F.size("_ws") > 0)
    bench = materialize(bench.withColumn("_row", F.monotonically_increasing_id()), "leak-items")
    lengths = [r[0] for r in bench.select(F.least(F.size("_ws"), F.lit(k)).alias("k")).distinct().orderBy("k").collect()]  # at most k of them
    if not lengths:
        return None
    own = None
    for n in lengths:
        part = bench if n == k else bench.where(F.size("_ws") == n)
        grams = _positions(part, "_ws", n, "_row", "_item").select("_row", "_item", "_h", _spelt("_ws", n).alias("_gram")).distinct()
        own = grams if own is None else own.unionByName(grams)
    own = materialize(own.withColumn("_s", F.xxhash64("_gram", "_h")), "leak-grams")
    sets = own.groupBy("_row", "_item").agg(F.collect_set("_s").alias("_set")).withColumn("_ni", F.size("_set"))
    sets = materialize(sets, "leak-sets")
    universe = materialize(own.select("_h", F.col("_gram").alias("_g"), "_s").distinct(), "leak-universe")

    base = docs.select(F.col(id).alias("_id"), text_digest(F.col(text)).alias("_doc"), words(F.col(text)).alias("_dw"))
    # Documents meet the benchmark block by block, each block small enough to travel; their shingles are never shuffled.
    blocks = max(1, math.ceil(universe.count() / UNIVERSE), math.ceil(table_bytes(universe) / BROADCAST_BYTES))
    hits = None
    for n in lengths:
        for b in range(blocks):
            known = universe if blocks == 1 else universe.where(F.pmod(F.col("_s"), F.lit(blocks)) == b)
            # spelt after the lookup, for the few that are found; as a join key it would be spelt for all
            part = _positions(base, "_dw", n, "_doc", "_id").join(F.broadcast(known), "_h").where(F.coalesce(_spelt("_dw", n) == F.col("_g"), F.lit(False)))
            part = part.select("_doc", "_id", "_s")
            hits = part if hits is None else hits.unionByName(part)
    held = hits.groupBy("_doc", "_id").agg(F.collect_set("_s").alias("_x"))
    held = materialize(held.withColumns({"_nx": F.size("_x"), "_d": F.monotonically_increasing_id()}), "leak-held")

    # which of a document's size classes needs how many coordinates for which items
    dc = [r[0] for r in held.select(_class(F.col("_nx")).alias("c")).distinct().collect()]  # at most 64 each
    ic = [r[0] for r in sets.select(_class(F.col("_ni")).alias("c")).distinct().collect()]
    need = {(d, i): coordinates(d, i, percent) for d in dc for i in ic}
    rule = F.create_map(*[x for (d, i), n in need.items() for x in (F.lit(d * 64 + i), F.lit(n))]) if need else F.create_map(F.lit(-1), F.lit(0))
    most = max([n for n in need.values() if n <= COORDINATES], default=1)

    by_hash = sized(materialize(sets.select("_row", "_ni", F.posexplode(_minhashes(F.col("_set"), most)).alias("_j", "_m")), "leak-coordinates"))
    by_gram = sized(materialize(sets.select("_row", "_ni", F.explode("_set").alias("_m")), "leak-by-gram"))
    n = F.try_element_at(rule, _class(F.col("_nx")) * 64 + _class(F.col("_ni")))
    probe = held.select("_d", "_nx", F.posexplode(_minhashes(F.col("_x"), most)).alias("_j", "_m"))
    cand = probe.join(by_hash, ["_j", "_m"]).where((n <= COORDINATES) & (F.col("_j") < n)).select("_d", "_row").distinct()
    cand = materialize(cand, "leak-candidates").join(held.select("_d", "_x"), "_d").join(sized(sets.select("_row", "_set")), "_row")
    cand = cand.select("_d", "_row", F.size(F.array_intersect("_x", "_set")).cast("long").alias("_n"))
    large = F.array(*[F.lit(d) for d in dc if any(need[d, i] > COORDINATES for i in ic)]).cast("array<int>")
    rest = held.where(F.array_contains(large, _class(F.col("_nx")))).select("_d", "_nx", F.explode("_x").alias("_m")).join(by_gram, "_m").where(n > COORDINATES)
    rest = rest.groupBy("_d", "_row").agg(F.count("*").alias("_n"))
    sure = cand.unionByName(rest).join(sized(sets.select("_row", "_item", "_ni")), "_row").where(100 * F.col("_n") >= percent * F.col("_ni"))
    return materialize(sure.join(held.select("_d", "_doc", "_id"), "_d").select("_id", "_doc", "_item", "_n", "_ni"), "leak-found")


@scratched
def contained(
    docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 5, percent: int = 80
) -> DataFrame:
    """Pairs of a document and an item of whose distinct k-word shingles it holds ``percent`` or more.

    Columns: id, item_id, n_shared, n_item, containment; each pair once.  Words
    are lower-cased runs without white space.  An item of fewer than k words is
    one shingle, looked for as that run of words.  Null and blank texts hold
    nothing and are held by nothing.  Rows that share an id are judged one by
    one and reported once.  Other columns are ignored.
    """
    found = _found(docs, items, id, text, item_id, item_text, k, percent)
    if found is None:
        schema = f"`{id}` {docs.schema[id].dataType.simpleString()}, `{item_id}` {items.schema[item_id].dataType.simpleString()}, n_shared long, n_item long, containment double"
        return docs.sparkSession.createDataFrame([], schema)
    out = found.groupBy("_id", "_item").agg(F.max(F.struct((F.col("_n") / F.col("_ni")).alias("c"), "_n", "_ni")).alias("m"))
    return out.select(F.col("_id").alias(id), F.col("_item").alias(item_id), F.col("m._n").cast("long").alias("n_shared"), F.col("m._ni").cast("long").alias("n_item"), F.col("m.c").alias("containment"))


@scratched
def drop_contaminated(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, as ``contained`` has it.

    Rows that share an id, or have none, go one by one; columns stay as they are.
    """
    found = _found(docs, items, id, text, item_id, item_text, k, percent)
    if found is None:
        return docs
    leak, digest = fresh(docs.columns, "_leak", "_digest")
    gone = sized(materialize(found.select(F.col("_id").alias(leak), F.col("_doc").alias(digest)).distinct(), "leak-ids"))
    return docs.join(gone, F.col(f"`{id}`").eqNullSafe(F.col(leak)) & (text_digest(F.col(f"`{text}`")) == F.col(digest)), "left_anti")
