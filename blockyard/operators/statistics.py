"""Terrain statistics over chunked voxel frames.

A chunked frame has chunk_x, chunk_z, local x and z (0 to 15), y, block_id and
block_data; positions without a row are air.  Only layers 0 to 127 are counted.
All counts are grouped sums, so Spark adds up each partition before it shuffles
and the most frequent block is no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import blocks
from ..functions.cells import block_types, is_class, items

CHUNK = ("chunk_x", "chunk_z")
LAYERS, SIDE = 128, 16
#: Layers below this count as underground.
DEEP = 60


def counted(voxels: DataFrame) -> DataFrame:
    """The rows that statistics look at."""
    return voxels.where(F.col("y").between(0, LAYERS - 1))


def densify_chunks(voxels: DataFrame, chunks: DataFrame | None = None, ground: int = 0, layers: int = LAYERS) -> DataFrame:
    """Every position of the chunks' lowest ``layers`` layers, empty ones written out: air, or stone below ``ground``.

    Rows are gathered by column of blocks, 128 at most, so the sparse rows are
    shuffled and not the dense ones.  ``chunks`` (chunk_x, chunk_z) defaults to
    those that have a row.
    """
    own = voxels.select(*CHUNK).distinct() if chunks is None else chunks.select(*CHUNK).distinct()
    i = F.explode(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)))
    columns = own.select(*CHUNK, i.alias("i")).select(*CHUNK, (F.col("i") % SIDE).cast("bigint").alias("x"), F.floor(F.col("i") / SIDE).alias("z"))
    cell = F.struct("y", "block_id", "block_data")
    held = counted(voxels).where(F.col("y") < layers).groupBy(*CHUNK, "x", "z").agg(F.map_from_entries(F.collect_list(F.struct(F.col("y").cast("int"), cell))).alias("_m"))
    rows = columns.join(held, [*CHUNK, "x", "z"], "left")
    rows = rows.select(*CHUNK, "x", "z", "_m", F.explode(F.sequence(F.lit(0), F.lit(layers - 1))).alias("_y"))
    got = F.try_element_at("_m", F.col("_y"))
    kinds = dict(voxels.dtypes)
    empty = F.when(F.col("_y") < ground, blocks.STONE).otherwise(blocks.AIR)
    value = lambda c, other: F.coalesce(got[c], other).cast(kinds[c]).alias(c)
    return rows.select(*CHUNK, "x", F.col("_y").cast(kinds["y"]).alias("y"), "z", value("block_id", empty), value("block_data", F.lit(0)))


def _with_air(counts: DataFrame, chunks: DataFrame, positions: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts of explicit cells with air filled up to what the chunks hold."""
    total = chunks.select(*CHUNK).distinct().agg((F.count("*") * positions).alias("_all"))
    if by:
        total = total.select("_all", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(LAYERS - 1).cast("bigint"))).alias("y"))
    said = counts.where(F.col("block_id") != blocks.AIR)
    used = said.groupBy(*by).agg(F.sum("n").alias("_used"))
    joined = total.join(used, list(by), "left") if by else total.crossJoin(used)  # one row with one row
    air = joined.select(*by, F.lit(blocks.AIR).cast("bigint").alias("block_id"), (F.col("_all") - F.coalesce("_used", F.lit(0))).alias("n")).where("n > 0")
    return said.unionByName(air)


def total_counts(voxels: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """block_id, n.  With ``chunks``, air that has no row is counted too."""
    out = counted(voxels).groupBy(F.col("block_id").cast("bigint").alias("block_id")).agg(F.count("*").alias("n"))
    return out if chunks is None else _with_air(out, chunks, SIDE * SIDE * LAYERS)


def layer_counts(voxels: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """y, block_id, n.  With ``chunks``, air that has no row is counted too."""
    out = counted(voxels).groupBy(F.col("y").cast("bigint").alias("y"), F.col("block_id").cast("bigint").alias("block_id")).agg(F.count("*").alias("n"))
    return out if chunks is None else _with_air(out, chunks, SIDE * SIDE, ("y",))


def exposure(voxels: DataFrame, target: int = blocks.AIR) -> DataFrame:
    """Underground cells off the chunk's border, with ``exposed``: is any of the six neighbours ``target``?

    ``voxels`` must be dense up to layer DEEP; higher ones are not looked at.  One shuffle by chunk serves the three windows; a
    chunk has a fixed size, so no partition of a window grows with the data.
    The cell below layer 0 does not count.
    """
    own = counted(voxels).where(F.col("y") <= DEEP).repartition(*CHUNK)
    checks = []
    for axis, rest in (("x", ("y", "z")), ("y", ("x", "z")), ("z", ("x", "y"))):
        w = W.partitionBy(*CHUNK, *rest).orderBy(axis)
        for shift, at in ((F.lag, -1), (F.lead, 1)):
            near = shift(F.struct(axis, "block_id")).over(w)
            checks.append((near[axis] == F.col(axis) + at) & (near["block_id"] == target))
    marked = own.withColumns({f"_n{i}": F.coalesce(c, F.lit(False)) for i, c in enumerate(checks)})
    exposed = F.array_contains(F.array(*[f"_n{i}" for i in range(6)]), True)
    inner = F.col("x").between(1, SIDE - 2) & F.col("z").between(1, SIDE - 2) & (F.col("y") < DEEP)
    return marked.where(inner).select(*voxels.columns, exposed.alias("exposed"))


def exposure_counts(voxels: DataFrame) -> DataFrame:
    """block_id, exposed, n over ``exposure``."""
    return exposure(voxels).groupBy(F.col("block_id").cast("bigint").alias("block_id"), "exposed").agg(F.count("*").alias("n"))


def topmost(voxels: DataFrame, terrain: bool = False) -> DataFrame:
    """The highest block of each column that has one; with ``terrain``, opaque blocks and liquids only."""
    use = is_class(F.col("block_id"), "opaque", "liquid") if terrain else F.col("block_id") != blocks.AIR
    return counted(voxels).where(use).groupBy(*CHUNK, "x", "z").agg(F.max_by("block_id", "y").alias("block_id"), F.max("y").alias("y"))


def topmost_counts(voxels: DataFrame, terrain: bool = False) -> DataFrame:
    """block_id, n over ``topmost``."""
    return topmost(voxels, terrain).groupBy(F.col("block_id").cast("bigint").alias("block_id")).agg(F.count("*").alias("n"))


def spawner_counts(tile_entities: DataFrame) -> DataFrame:
    """entity_id, n; spawners without a mob are left out."""
    return tile_entities.where(F.col("entity_id").isNotNull()).groupBy("entity_id").agg(F.count("*").alias("n"))


def chest_counts(tile_entities: DataFrame) -> DataFrame:
    """item_id, name, n: items in chests, summed over stacks; unknown items are named by their number."""
    held = tile_entities.select(F.explode("items").alias("i")).select(F.col("i.id").cast("bigint").alias("item_id"), F.col("i.count").alias("c"))
    sums = held.groupBy("item_id").agg(F.sum("c").cast("bigint").alias("n"))
    return named_items(sums)


def named_items(rows: DataFrame, item: str = "item_id") -> DataFrame:
    """``rows`` with the item's name; the lookup has a fixed size."""
    table = F.broadcast(items(rows.sparkSession).withColumnRenamed("item_id", "_item"))
    joined = rows.join(table, F.col(item) == F.col("_item"), "left").drop("_item")
    return joined.withColumn("name", F.coalesce("name", F.concat(F.lit("unknown-"), F.col(item).cast("string"))))


def named_blocks(rows: DataFrame, block: str = "block_id") -> DataFrame:
    """``rows`` with the block's name, null for numbers without a block."""
    table = block_types(rows.sparkSession).select(F.col("block_id").alias("_id"), "name")
    return rows.join(F.broadcast(table), F.col(block) == F.col("_id"), "left").drop("_id")


def counters(chunks: DataFrame) -> DataFrame:
    """regions, chunks, rejected, absent from (region_file, present, populated); unpopulated chunks are rejected.

    A slot that is absent is counted apart and is no failure.
    """
    here, good = F.col("present"), F.coalesce("populated", F.lit(False))
    return chunks.agg(
        F.count_distinct("region_file").alias("regions"),
        F.count_if(here & good).alias("chunks"),
        F.count_if(here & ~good).alias("rejected"),
        F.count_if(~here).alias("absent"),
    )


def merged(*parts: DataFrame) -> DataFrame:
    """Histograms (any key columns and n) added up; also the parts of one frame, whose keys then repeat."""
    keys = [c for c in parts[0].columns if c != "n"]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*keys).agg(F.sum("n").alias("n"))


def highest_type(counts: DataFrame) -> DataFrame:
    """The greatest block_id with a count above 0."""
    return counts.where("n > 0").agg(F.max("block_id").alias("highest"))


def all_types(counts: DataFrame) -> DataFrame:
    """block_id, name, n for all 256 numbers, zeros written out."""
    spark = counts.sparkSession
    ids = spark.range(256).withColumnRenamed("id", "block_id")
    return named_blocks(ids.join(counts, "block_id", "left").select("block_id", F.coalesce("n", F.lit(0)).alias("n"))).select("block_id", "name", "n")


def layer_matrix(counts: DataFrame, highest: int) -> DataFrame:
    """One row for each of the 128 layers, one column for each number up to ``highest``."""
    spark = counts.sparkSession
    wide = counts.groupBy("y").pivot("block_id", list(range(highest + 1))).agg(F.sum("n"))
    rows = spark.range(LAYERS).withColumnRenamed("id", "layer").join(wide, F.col("layer") == F.col("y"), "left").drop("y")
    return rows.select("layer", *[F.coalesce(F.col(f"`{i}`"), F.lit(0)).alias(str(i)) for i in range(highest + 1)])


def summary(counters_row: DataFrame, when: Column | None = None) -> DataFrame:
    """date, regions, chunks, rejected, blocks and the same as text with grouped digits."""
    out = counters_row.withColumns({"date": F.current_timestamp() if when is None else when, "blocks": F.col("chunks") * (SIDE * SIDE * LAYERS)})
    return out.select("date", "regions", "chunks", "rejected", "blocks", F.format_number("blocks", 0).alias("blocks_text"))


def write_csv(rows: DataFrame, path: str) -> None:
    """One CSV folder with a header."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def tables(voxels: DataFrame, tile_entities: DataFrame, chunks: DataFrame) -> tuple[list[tuple[str, DataFrame, Column]], list[DataFrame]]:
    """Name, rows and column to sum of the seven tables of the statistics, and what is kept for them; ``chunks`` has all slots."""
    good = chunks.where(F.col("present") & F.coalesce("populated", F.lit(False)))
    # Histograms of some hundred rows each, used twice.
    shown = exposure_counts(densify_chunks(voxels, good, layers=DEEP + 1)).persist()
    by_layer = layer_counts(voxels, good).persist()
    totals = merged(by_layer.select("block_id", "n"))
    highest = highest_type(totals).first()[0] or 0
    sides = [(name, all_types(shown.where(F.col("exposed") == side).drop("exposed"))) for name, side in (("adjacent", True), ("nonadjacent", False))]
    matrix = layer_matrix(by_layer, highest)
    n = F.col("n")
    out = [
        ("total", all_types(totals), n),
        *[(name, rows, n) for name, rows in sides],
        ("topmost", all_types(topmost_counts(voxels)), n),
        ("layers", matrix, sum((F.col(str(i)) for i in range(1, highest + 1)), F.col("0"))),
        ("spawners", spawner_counts(tile_entities), n),
        ("chests", chest_counts(tile_entities), n),
    ]
    return out, [shown, by_layer]


def write_all(voxels: DataFrame, tile_entities: DataFrame, chunks: DataFrame, path: str) -> None:
    """The seven tables and the summary as CSV folders under ``path``; ``chunks`` has all slots."""
    every, kept = tables(voxels, tile_entities, chunks)
    for name, rows, _ in every:
        order = [c for c in ("block_id", "layer") if c in rows.columns]
        write_csv(rows.orderBy(*order) if order else rows, f"{path}/{name}")
    write_csv(summary(counters(chunks)), f"{path}/summary")
    for rows in kept:
        rows.unpersist()


def ground_level(store: DataFrame, by: tuple[str, ...] = (), ground: int = 0) -> DataFrame:
    """The natural ground level of each store, from the weights of its layers.

    Cells that have no row weigh as air, or as stone below ``ground``.  The level
    is above the last layer of positive weight under the first negative one.
    Without rows the level is 0.
    """
    spark: SparkSession = store.sparkSession
    table = spark.createDataFrame(sorted(blocks.WEIGHTS.items()), "_b int, _w int")
    rows = store.join(F.broadcast(table), F.col("block_id") == F.col("_b"), "left")
    layer = rows.groupBy(*by, "y").agg(
        F.sum(F.coalesce("_w", F.lit(0))).alias("w"), F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("z").alias("z0"), F.max("z").alias("z1")
    )
    # One entry for each layer: no more than a store is high.
    whole = layer.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("y", F.struct("w", "n")))).alias("m"),
        F.min("y").alias("y0"),
        F.max("y").alias("y1"),
        ((F.max("x1") - F.min("x0") + 1) * (F.max("z1") - F.min("z0") + 1)).alias("area"),
    )
    weight = lambda y: F.coalesce(F.try_element_at("m", y)["w"], F.lit(0)) + (F.col("area") - F.coalesce(F.try_element_at("m", y)["n"], F.lit(0))) * F.when(
        y < ground, blocks.WEIGHTS[blocks.STONE]
    ).otherwise(blocks.WEIGHTS[blocks.AIR])
    weights = whole.withColumn("ws", F.when(F.col("y0").isNotNull(), F.transform(F.sequence("y0", "y1"), weight)))
    at = weights.withColumn("first", F.coalesce(F.array_min(F.filter(F.transform("ws", lambda w, i: F.when(w < 0, i)), F.isnotnull)), F.size("ws")))
    below = F.array_max(F.filter(F.transform("ws", lambda w, i: F.when((w >= 1) & (i < F.col("first")), i)), F.isnotnull))
    level = F.when(F.col("first") == 0, 0).otherwise(F.greatest(F.lit(1), F.coalesce(below + 1, F.lit(1))))
    return at.select(*by, F.coalesce(F.col("y0") + level, F.lit(0)).cast("bigint").alias("ground_level"))
