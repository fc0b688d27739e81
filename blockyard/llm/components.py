"""Connected components by alternating large-star and small-star steps.

Edges stay in distributed tables; each step is one aggregation and one join, and
the number of steps grows with the logarithm of the longest path.  A table of
few edges is solved by one task instead, since each step costs the driver the
same however few there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_table, fits, materialize, tidy

#: Edges, and bytes of their files, that one task solves.
EDGES, EDGE_BYTES = 500_000, 32 << 20


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges that come."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    n = sum(b.num_rows for b in held)
    ends = pa.concat_arrays([b.column(c) for c in ("u", "v") for b in held]).dictionary_encode()
    order = pa.compute.array_sort_indices(ends.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    own = rank[ends.indices.to_numpy()]
    least = np.arange(len(order))
    while True:
        a, b = least[own[:n]], least[own[n:]]
        if (a == b).all():
            break
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while (least[least] != least).any():
            least = least[least]
    nodes = ends.dictionary.take(order)
    yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(least))], names=["node", "component"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (u, v); the result holds edges with u > v, each once."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        both = both.where("v > u")  # each larger neighbour is hung on the least one
    else:
        both = edges
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = both.join(least, "u").where("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
    if not large:
        hung = hung.unionByName(least.select("u", F.col("m").alias("v")))
    return hung.where("u != v").distinct()


def components(edges: DataFrame, at_once: int = EDGES) -> DataFrame:
    """(node, component) for each node of ``edges(u, v)``; component: the least node reachable.

    Edges may point either way, repeat, or join a node to itself; nodes need an
    order.  Rows with a null end are ignored.  No edges give no rows.  Up to
    ``at_once`` different edges are solved by one task, with the same result.
    """
    own = edges.where("u is not null and v is not null and u != v")
    now = materialize(own.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges")
    if fits(now, at_once, EDGE_BYTES):
        kind = edges.schema["u"].dataType
        return now.coalesce(1).mapInArrow(tidy(_solve), T.StructType([T.StructField("node", kind), T.StructField("component", kind)]))
    while True:
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not sign[0]:
            break
        nxt = materialize(_star(_star(now, True), False), "cc-edges")
        drop_table(now)
        now = nxt
        if now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() == sign:
            break
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
