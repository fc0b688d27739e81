"""Deterministic voxels derived from ``lineitem``, so that SQL can check the voxel operators.

Of the rows that fall on one position the greatest by (order, line, part,
supplier) wins, as a later write would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blocks

#: Chunks along either side of the view.
CHUNKS = 4
POSITION = ("chunk_x", "chunk_z", "x", "y", "z")
#: What each part of a position stays below, whatever its sign.
_BELOW = {"chunk_x": CHUNKS, "chunk_z": CHUNKS, "x": 16, "y": 128, "z": 16}


def _winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each position with the row that wins it.

    The greatest order of each position, a number, is found by hashing; only its
    rows are compared whole, which takes sorting.  There are 524,288 positions at
    most (of keys from 0), so the orders are broadcast and all rows stay where
    they are.
    """
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order, line = F.col("l_orderkey"), F.col("l_linenumber").cast("bigint")
    at = {
        "chunk_x": F.floor(order / 128) % CHUNKS,
        "chunk_z": line % CHUNKS,
        "x": F.col("l_partkey") % 16,
        "y": order % 128,
        "z": F.col("l_suppkey") % 16,
    }
    row = F.struct(order.alias("o"), line.alias("l"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_quantity").cast("bigint").alias("q"), F.col("l_returnflag").alias("f"))
    keyed = rows.select(*[c.cast("bigint").alias(k) for k, c in at.items()], row.alias("w"))
    place = F.lit(0).cast("bigint")
    for k, n in _BELOW.items():
        place = place * (2 * n) + F.coalesce(F.col(k), F.lit(n)) + (n - 1)  # one number for each position, nulls too
    keyed = keyed.withColumn("_place", place)
    best = keyed.groupBy("_place").agg(F.max("w.o").alias("_best"))
    last = keyed.join(F.broadcast(best), "_place").where(F.col("w.o").isNull() | (F.col("w.o") == F.col("_best")))
    return last.groupBy(*POSITION).agg(F.max("w").alias("w"))


def _cells(winners: DataFrame, *more) -> DataFrame:
    block = (F.col("w.p") * 7 + F.col("w.l")) % (blocks.LAST_ID + 1)
    return winners.select(*POSITION, block.alias("block_id"), (F.col("w.q") % 16).alias("block_data"), *more)


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_x, chunk_z, x, y, z, block_id, block_data, all bigint; x and z are local to the chunk."""
    return _cells(_winners(spark, sf_dir))


def world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x, y, z, block_id, block_data in world coordinates."""
    return to_world(voxels(spark, sf_dir))


def to_world(chunked: DataFrame) -> DataFrame:
    """A chunked frame with x and z counted over the world: local + 16 times the chunk's."""
    out = chunked.withColumns({"x": F.col("x") + 16 * F.col("chunk_x"), "z": F.col("z") + 16 * F.col("chunk_z")})
    return out.drop("chunk_x", "chunk_z")


def to_chunks(store: DataFrame) -> DataFrame:
    """A world frame with chunk_x and chunk_z, and x and z local to the chunk."""
    return store.withColumns({"chunk_x": F.floor(F.col("x") / 16), "chunk_z": F.floor(F.col("z") / 16), "x": F.pmod(F.col("x"), F.lit(16)), "z": F.pmod(F.col("z"), F.lit(16))})


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region_file, chunk_x, chunk_z, present, populated: a slot table for the view's chunks.

    Regions are pairs of chunks along x; chunks (1, 1) and (2, 3) are unpopulated, (3, 3) is absent.
    """
    at = spark.range(CHUNKS * CHUNKS).select((F.col("id") % CHUNKS).alias("chunk_x"), F.floor(F.col("id") / CHUNKS).alias("chunk_z"))
    absent = (F.col("chunk_x") == 3) & (F.col("chunk_z") == 3)
    bare = ((F.col("chunk_x") == 1) & (F.col("chunk_z") == 1)) | ((F.col("chunk_x") == 2) & (F.col("chunk_z") == 3))
    return at.select(F.concat(F.lit("r."), F.floor(F.col("chunk_x") / 2).cast("string"), F.lit(".mca")).alias("region_file"), "*", (~absent).alias("present"), (~absent & ~bare).alias("populated"))


def tile_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spawners and chests of the view: position, id, entity_id, items.

    A spawner's mob is the row's return flag; a chest holds the lines of the
    row's order (item: part mod 400, count: quantity).
    """
    cells = _cells(_winners(spark, sf_dir), F.col("w.o").alias("o"), F.col("w.f").alias("f")).where(F.col("block_id").isin(blocks.SPAWNER, blocks.CHEST))
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_orderkey").alias("o"), F.struct((F.col("l_partkey") % 400).alias("id"), F.col("l_quantity").cast("bigint").alias("count")).alias("i")
    )
    wanted = cells.where(F.col("block_id") == blocks.CHEST).select("o").distinct()
    held = line.join(F.broadcast(wanted), "o", "left_semi").groupBy("o").agg(F.collect_list("i").alias("items"))  # an order has a few lines
    out = cells.join(held, "o", "left")
    chest = F.col("block_id") == blocks.CHEST
    return out.select(
        *POSITION, "block_id", F.when(chest, "Chest").otherwise("Monster Spawner").alias("id"), F.when(~chest, F.col("f")).alias("entity_id"), F.when(chest, F.col("items")).alias("items")
    )
