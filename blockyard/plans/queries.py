"""The registered queries of the voxel operators over the voxel view."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells, describe, extents
from ..functions.blocks import ID
from ..functions.extents import Box
from ..operators import statistics, store, transforms
from ..sources import nbt, schematic
from . import part_view
from . import voxel_view as view

#: Cuboids and cells that are arguments of the queries.
REGION = Box(8, 39, 20, 59, 8, 39)
TARGET = (0, 70, 0)
SMALL = Box(10, 25, 30, 45, 10, 25)


def _populated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Voxels of the populated chunks, and those chunks; a table of 16 rows, so the filter is a broadcast."""
    good = view.chunks(spark, sf_dir).where("populated").select("chunk_x", "chunk_z")
    return view.voxels(spark, sf_dir).join(F.broadcast(good), ["chunk_x", "chunk_z"], "left_semi"), good


def a1_total_counts(spark, sf_dir):
    return statistics.total_counts(*_populated(spark, sf_dir))


def a2_layer_counts(spark, sf_dir):
    return statistics.layer_counts(*_populated(spark, sf_dir))


def _exposure(spark, sf_dir):
    """Over ground of stone up to layer 30, so that some cells have no air about them."""
    return statistics.exposure_counts(statistics.densify_chunks(*_populated(spark, sf_dir), ground=30, layers=statistics.DEEP + 1))


def a3_exposed_counts(spark, sf_dir):
    return _exposure(spark, sf_dir).where("exposed").drop("exposed")


def a4_enclosed_counts(spark, sf_dir):
    return _exposure(spark, sf_dir).where("not exposed").drop("exposed")


def a5_topmost_counts(spark, sf_dir):
    return statistics.topmost_counts(_populated(spark, sf_dir)[0])


def a6_topmost_terrain_counts(spark, sf_dir):
    return statistics.topmost_counts(_populated(spark, sf_dir)[0], terrain=True)


def a7_spawner_counts(spark, sf_dir):
    return statistics.spawner_counts(view.tile_entities(spark, sf_dir))


def a8_chest_counts(spark, sf_dir):
    return statistics.chest_counts(view.tile_entities(spark, sf_dir)).select("item_id", "name", "n")


def a9_counters(spark, sf_dir):
    return statistics.counters(view.chunks(spark, sf_dir))


def a10_merged_counts(spark, sf_dir):
    part = view.voxels(spark, sf_dir).groupBy("chunk_x", "chunk_z", "block_id").agg(F.count("*").alias("n"))
    return statistics.merged(part.select("block_id", "n"))


def a12_extents(spark, sf_dir):
    e = store.extents(view.voxels(spark, sf_dir), by=("chunk_x", "chunk_z"))
    x = F.col("extents")
    return e.select("chunk_x", "chunk_z", "extents.*", extents.width(x).alias("width"), extents.height(x).alias("height"), extents.length(x).alias("length"))


def a15_ground_level(spark, sf_dir):
    return statistics.ground_level(view.voxels(spark, sf_dir), by=("chunk_x", "chunk_z"))


def a16_highest_type(spark, sf_dir):
    return statistics.highest_type(statistics.total_counts(view.voxels(spark, sf_dir)))


def k1_all_types(spark, sf_dir):
    return statistics.all_types(a1_total_counts(spark, sf_dir))


def k2_layer_matrix(spark, sf_dir):
    return statistics.layer_matrix(a2_layer_counts(spark, sf_dir), 175)


def k4_summary(spark, sf_dir):
    return statistics.summary(a9_counters(spark, sf_dir)).drop("date")


def p6_within_region(spark, sf_dir):
    return store.crop(view.world(spark, sf_dir), REGION).agg(F.count("*").alias("n"), F.sum("block_id").cast("bigint").alias("ids"))


def p18_tile_entity_fits(spark, sf_dir):
    te = view.tile_entities(spark, sf_dir)
    # Half of the chests become furnaces, which expect another type.
    new = te.withColumn("block_id", F.when((F.col("block_id") == ID["chest"]) & (F.col("y") % 2 == 0), ID["furnace"]).otherwise(F.col("block_id")))
    fits = cells.tile_entity_fits(F.col("id"), F.col("expected"))
    return store.with_expected(new).groupBy("id", "expected", fits.alias("fits")).agg(F.count("*").alias("n"))


def p20_non_empty(spark, sf_dir):
    return store.drop_empty(view.world(spark, sf_dir), 40).agg(F.count("*").alias("n"), F.sum("y").cast("bigint").alias("ys"))


def j1_cells_with_tile_entities(spark, sf_dir):
    te = view.to_world(view.tile_entities(spark, sf_dir)).select("x", "y", "z", "id", "entity_id", F.size(F.coalesce("items", F.array().cast("array<struct<id:bigint,count:bigint>>"))).cast("bigint").alias("n_stacks"))
    return store.with_tile_entities(view.world(spark, sf_dir), te)


def j2_named_counts(spark, sf_dir):
    return describe.short(statistics.total_counts(view.voxels(spark, sf_dir)), "name")


def _overlay_of(spark, sf_dir):
    """Part of the store elsewhere, every fifth cell a hole and every seventh air."""
    part = store.shifted(store.crop(view.world(spark, sf_dir), SMALL), 12, 10, 3)
    pick = F.col("x") + F.col("y") + F.col("z")
    hole, air = pick % 5 == 0, pick % 7 == 0
    return part.withColumns({"block_id": F.when(hole | air, 0).otherwise(F.col("block_id")), "block_data": F.when(hole, 16).when(air, 0).otherwise(F.col("block_data"))})


def j4_overlay(spark, sf_dir):
    return store.overlay(view.world(spark, sf_dir), _overlay_of(spark, sf_dir), SMALL.offset(12, 10, 3))


def j5_copy_region(spark, sf_dir):
    w = view.world(spark, sf_dir)
    return store.copy_region(w, w, SMALL, TARGET)


def j7_side_torches(spark, sf_dir):
    return store.torch_blocks(view.world(spark, sf_dir)).select("x", "y", "z", "block_id")


def j7_top_torches(spark, sf_dir):
    return store.torch_blocks(view.world(spark, sf_dir), side=False).select("x", "y", "z", "block_id")


def v1_read_cells(spark, sf_dir):
    return store.read_cells(view.world(spark, sf_dir), store.grid(spark, Box(0, 7, 0, 63, 0, 7)), ground=32)


def v2_write_cells(spark, sf_dir):
    w = view.world(spark, sf_dir)
    line = store.grid(spark, Box(10, 25, 33, 33, 12, 12)).withColumns({"block_id": F.col("x") % 3, "block_data": F.lit(0)})
    return store.write_cells(w, line)


def v3_keep_fitting(spark, sf_dir):
    te = view.to_world(view.tile_entities(spark, sf_dir)).select("x", "y", "z", "id")
    over = store.grid(spark, Box(0, 63, 0, 63, 0, 31)).withColumn("block_id", F.when(F.col("x") % 2 == 0, F.lit(ID["chest"])).otherwise(F.lit(1)))
    return store.keep_fitting(te, over)


def v5_fill(spark, sf_dir):
    return store.fill(view.world(spark, sf_dir), SMALL, 4, 2)


def v6_crop(spark, sf_dir):
    return store.crop(view.world(spark, sf_dir), SMALL)


def v11_changed_extents(spark, sf_dir):
    w = view.world(spark, sf_dir)
    return store.changed_extents(w, store.fill(w, SMALL, 1)).select("extents.*", "n_changed")


def v13_densify(spark, sf_dir):
    return store.densify(view.world(spark, sf_dir), SMALL, ground=38)


def v18_float_and_settle(spark, sf_dir):
    rest, floating = store.lift(view.world(spark, sf_dir), SMALL)
    return store.settle(rest, floating, (5, 7, -2))


def v19_layer_slice(spark, sf_dir):
    return store.layer_slice(view.world(spark, sf_dir), 40, 4, 50, 4, 50)


def g2_move(spark, sf_dir):
    return transforms.move(view.world(spark, sf_dir), 3, 4, 5)


def g3_flip_x(spark, sf_dir):
    return transforms.flip_x(view.world(spark, sf_dir))


def g4_flip_y(spark, sf_dir):
    return transforms.flip_y(view.world(spark, sf_dir))


def g5_rotate_180(spark, sf_dir):
    return transforms.rotate_180(view.world(spark, sf_dir))


def g6_rotate_right(spark, sf_dir):
    return transforms.rotate_right(view.world(spark, sf_dir))


def g7_rotate_left(spark, sf_dir):
    return transforms.rotate_left(view.world(spark, sf_dir))


def g8_trim(spark, sf_dir):
    return transforms.trim(view.world(spark, sf_dir))


def g9_command_chain(spark, sf_dir):
    return transforms.trim(transforms.run_commands(view.world(spark, sf_dir), ["--rotr", "-x", "move", "1", "2", "3"]))


def x6_facing_counts(spark, sf_dir):
    table = F.broadcast(cells.facings(spark))
    v = view.voxels(spark, sf_dir)
    return v.join(table, ["block_id", "block_data"]).groupBy("direction").agg(F.count("*").alias("n"))


def x10_class_counts(spark, sf_dir):
    v = view.voxels(spark, sf_dir)
    kinds = ("opaque", "transparent", "liquid", "item", "tile_entity", "power_source", "power_sink", "vegetable", "ore", "rail", "piston", "stair")
    return v.agg(*[F.count_if(cells.is_class(F.col("block_id"), k)).alias(k) for k in kinds], F.count_if(cells.is_air(F.col("block_id"), F.col("block_data"))).alias("air"))


def x13_wire_power(spark, sf_dir):
    v = view.voxels(spark, sf_dir).where(F.col("block_id") == ID["redstone_wire"])
    return v.groupBy(cells.wire_power(F.col("block_id"), F.col("block_data")).cast("bigint").alias("power")).agg(F.count("*").alias("n"))


def t2_long_descriptions(spark, sf_dir):
    v = view.voxels(spark, sf_dir).groupBy("block_id", "block_data").agg(F.count("*").alias("n"))
    return describe.long(v).groupBy("description").agg(F.sum("n").alias("n"))


def t6_spawner_texts(spark, sf_dir):
    te = view.tile_entities(spark, sf_dir).where(F.col("block_id") == ID["mob_spawner"]).withColumn("block_data", F.lit(0))
    return describe.long(te, entity_id="entity_id").groupBy("description").agg(F.count("*").alias("n"))


def u2_extent_intersections(spark, sf_dir):
    e = store.extents(view.world(spark, sf_dir).withColumn("part", F.col("y") % 5), by=("part",))
    both = e.select("part", extents.intersection(F.col("extents"), SMALL.column()).alias("i"), extents.union(F.col("extents"), SMALL.column()).alias("u"))
    return both.select("part", *[F.col(f"i.{s}").alias(f"i_{s}") for s in extents.SIDES], *[F.col(f"u.{s}").alias(f"u_{s}") for s in extents.SIDES])


def k5_schematic_round_trip(spark, sf_dir):
    """Each chunk written as a schematic and read again."""
    v = view.voxels(spark, sf_dir).withColumn("store", F.format_string("c%d.%d", "chunk_x", "chunk_z"))
    files = schematic.encoded(v).select(F.col("store").alias("path"), "content")
    return schematic.stores(files).groupBy("store").agg(F.count("*").alias("n"), F.sum("block_id").cast("bigint").alias("ids"), F.sum("block_data").cast("bigint").alias("data"), F.max("y").alias("top"))


def k6_circuit_round_trip(spark, sf_dir):
    """Each chunk written as a circuit file and read again: only circuit parts survive, solid blocks as one kind."""
    v = view.voxels(spark, sf_dir).withColumn("store", F.format_string("c%d.%d", "chunk_x", "chunk_z"))
    files = schematic.encoded(v, "circuit").select(F.col("store").alias("path"), "content")
    return schematic.stores(files).groupBy("block_id").agg(F.count("*").alias("n"))


def k9_nbt_round_trip(spark, sf_dir):
    """One document for each part, encoded and parsed to a node table; counted by path."""
    parts = part_view.parts(spark, sf_dir).select(F.col("p_partkey").cast("string").alias("path"), F.to_json(F.struct("p_name", "p_size", "p_retailprice")).alias("j"))

    def run(batches):
        for batch in batches:
            raw = [nbt.dumps("part", json.loads(j)) for j in batch.column("j").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(raw, pa.binary())], names=["path", "content"])

    nodes = nbt.nodes(parts.mapInArrow(run, "path string, content binary"), root_name="part")
    value = F.coalesce(F.length("string_val"), F.col("long_val"), F.floor("double_val"), F.col("child_count").cast("bigint"))
    return nodes.groupBy("path", nbt.tag_name(F.col("tag_type")).alias("type")).agg(F.count("*").alias("n"), F.sum(value).cast("bigint").alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        a1_total_counts, a2_layer_counts, a3_exposed_counts, a4_enclosed_counts, a5_topmost_counts, a6_topmost_terrain_counts, a7_spawner_counts, a8_chest_counts, a9_counters, a10_merged_counts,
        a12_extents, a15_ground_level, a16_highest_type, k1_all_types, k2_layer_matrix, k4_summary, p6_within_region, p18_tile_entity_fits, p20_non_empty, j1_cells_with_tile_entities,
        j2_named_counts, j4_overlay, j5_copy_region, j7_side_torches, j7_top_torches, v1_read_cells, v2_write_cells, v3_keep_fitting, v5_fill, v6_crop, v11_changed_extents, v13_densify,
        v18_float_and_settle, v19_layer_slice, g2_move, g3_flip_x, g4_flip_y, g5_rotate_180, g6_rotate_right, g7_rotate_left, g8_trim, g9_command_chain, x6_facing_counts, x10_class_counts,
        x13_wire_power, t2_long_descriptions, t6_spawner_texts, u2_extent_intersections, k5_schematic_round_trip, k6_circuit_round_trip, k9_nbt_round_trip,
    )
}
