"""The registered queries of region files, the tagged format, extents and tables of directions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blocks, cells, describe, extents
from ..functions.blocks import ID
from ..functions.extents import Box
from ..operators import statistics, store, transforms
from ..sources import nbt, region, schematic
from . import part_view, region_view
from . import voxel_view as view

#: Cuboids that are arguments of the queries.
OUTER, CLIP = Box(0, 40, 0, 90, 0, 40), Box(5, 29, 10, 41, 3, 17)


def _slots(spark: SparkSession, sf_dir: str, legacy: bool = False) -> DataFrame:
    return region.region_chunks(region_view.files(spark, sf_dir, legacy))


def _chunks(spark: SparkSession, sf_dir: str, legacy: bool = False) -> DataFrame:
    return region.chunks(_slots(spark, sf_dir, legacy))


def s3_slots(spark, sf_dir):
    """Every slot of every file, what its header word says and whether its chunk can be read."""
    return _slots(spark, sf_dir).select("region_file", F.col("local_x").cast("bigint").alias("local_x"), F.col("local_z").cast("bigint").alias("local_z"), "present", "status")


def s6_chunk_status(spark, sf_dir):
    """What reading each slot that is there gives."""
    return _chunks(spark, sf_dir).groupBy("region_file", "status").agg(F.count("*").alias("n"))


def s9_chunk_headers(spark, sf_dir):
    """Coordinates, times, counts and unknown keys of each chunk."""
    heads = region.chunk_headers(_chunks(spark, sf_dir)).where("status = 'ok'").drop("status", "local_x", "local_z")
    return heads.withColumns({c: F.col(c).cast("bigint") for c in ("n_entities", "n_tile_entities")})


def s10_section_cells(spark, sf_dir):
    """The cells of all sections."""
    return region.voxels(_chunks(spark, sf_dir)).drop("region_file")


def v15_written_sections(spark, sf_dir):
    """The cells of all sections after a layer of each chunk is written, in part where no section was."""
    layer = spark.range(4 * 4 * 16 * 16).select(*[(F.floor(F.col("id") / n) % m).alias(c) for c, n, m in (("chunk_x", 1, 4), ("chunk_z", 4, 4), ("x", 16, 16), ("z", 256, 16))])
    writes = layer.select("chunk_x", "chunk_z", "x", F.when(F.col("z") % 2 == 0, 70).otherwise(200).alias("y"), "z", (F.col("x") % 3).alias("block_id"), (F.col("z") % 4).alias("block_data"))
    return region.voxels(region.write_cells(_chunks(spark, sf_dir), writes)).drop("region_file")


def s7_legacy_cells(spark, sf_dir):
    """The cells of the older layout, one tall block for each chunk."""
    return region.voxels(_chunks(spark, sf_dir, True)).select("chunk_x", "chunk_z", "x", "y", "z", "block_id", "block_data")


def s12_tile_entities(spark, sf_dir):
    """Tile entities at their places in the chunk and the world."""
    out = region.tile_entities(_chunks(spark, sf_dir))
    stacks = F.when(F.col("items").isNotNull(), F.size("items")).cast("bigint")
    return out.select("chunk_x", "chunk_z", "x", "y", "z", "world_x", "world_z", "id", "entity_id", "custom_name", "command", stacks.alias("n_stacks"), F.aggregate("items", F.lit(0).cast("bigint"), lambda a, i: a + i["count"]).alias("n_items"))


def p13_entities(spark, sf_dir):
    """Entities with their positions; items and horses with theirs."""
    return region.entities(_chunks(spark, sf_dir)).select("chunk_x", "chunk_z", "id", "x", "y", "z", "item", "chested", "saddle", "armor")


def p5_find_blocks(spark, sf_dir):
    """Chests and spawners found in the files, with what is in them."""
    out = region.find_blocks(_chunks(spark, sf_dir), [ID["chest"], ID["mob_spawner"]])
    return out.select("world_x", "y", "world_z", "block_id", "block_data", "id", "entity_id")


def p21_command_blocks(spark, sf_dir):
    return region.command_blocks(_chunks(spark, sf_dir)).drop("region_file")


def k12_chunk_dumps(spark, sf_dir):
    """What a dump prints of each chunk, with its entities and tile entities."""
    return region.dump_lines(_chunks(spark, sf_dir)).groupBy("region_file", "line").agg(F.count("*").alias("n"), F.min("number").cast("bigint").alias("first"))


def a9_file_counters(spark, sf_dir):
    """The counters of the statistics from the files' slots."""
    slots = _slots(spark, sf_dir).where("status in ('ok', 'absent')")
    return statistics.counters(region.slot_table(slots, region.chunks(slots)))


def s19_inflated_sizes(spark, sf_dir):
    """Bytes of one document for each part, packed and unpacked again in every way."""
    parts = part_view.parts(spark, sf_dir).select("p_name")
    twice = nbt.Codec(lambda b: b + b, lambda b: b[: len(b) // 2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            how, size = [], []
            for name in batch.column(0).to_pylist():
                for packing in ("none", "gzip", "zlib", "deflate", twice):
                    raw = nbt.dumps("part", {"p_name": name}, compression=packing)
                    how.append("own" if packing is twice else packing)
                    size.append(len(nbt.inflate(raw, "auto" if packing in ("gzip", "zlib") else packing)))
            yield pa.RecordBatch.from_arrays([pa.array(how), pa.array(size, pa.int64())], names=["packing", "size"])

    return parts.mapInArrow(run, "packing string, size bigint").groupBy("packing").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def _documents(spark, sf_dir, only: Column | None = None) -> DataFrame:
    """path, content: one document for each part, or for those that ``only`` holds for, keys not in order, one of them a list."""
    own = F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("Size"), F.col("p_partkey").alias("key")))
    parts = part_view.parts(spark, sf_dir, only).select(F.col("p_partkey").cast("string").alias("path"), own.alias("j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = []
            for j in batch.column("j").to_pylist():
                d = json.loads(j)
                raw.append(nbt.dumps("part", {"name": d["name"], "Size": d["Size"], "a.b": [d["Size"], d["Size"] + 1], "long text": d["name"] * 9}))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(raw, pa.binary())], names=["path", "content"])

    return parts.mapInArrow(run, "path string, content binary")


def k12_dump_lines(spark, sf_dir):
    """Each document as indented lines, keys in order without regard to case."""
    lines = nbt.tree_text(nbt.nodes(_documents(spark, sf_dir), ordered=True))
    return lines.select("doc", F.col("node_id").cast("bigint").alias("node_id"), "line")


def n8_display_names(spark, sf_dir):
    """What the tree calls each node, its path and whether it can be renamed."""
    nodes = nbt.nodes(_documents(spark, sf_dir))
    rows = nodes.select("path", nbt.display_name().alias("display_name"), nbt.name_editable().alias("editable"), F.col("tag_type").isin(*nbt.NUMBERS).alias("number"), nbt.tag_name(F.col("element_type")).alias("items"))
    return rows.groupBy("path", "display_name", "editable", "number", "items").agg(F.count("*").alias("n"))


def n6_coerced_trees(spark, sf_dir):
    """Trees whose tags were changed, written and read again: numbers take the new widths, lists one type."""
    nodes = nbt.nodes(_documents(spark, sf_dir))
    kind = F.when(F.col("path") == "part.Size", nbt.LONG).otherwise(F.col("tag_type"))
    item = F.when(F.col("path") == "part.a.b", nbt.DOUBLE).otherwise(F.col("element_type"))
    files = nbt.encoded(nodes.withColumns({"tag_type": kind, "element_type": item}))
    again = nbt.nodes(files, doc="doc").where("path not in ('part.name', 'part.long text')")
    value = F.coalesce("double_val", F.col("long_val").cast("double"))
    return again.groupBy("path", nbt.tag_name(F.col("tag_type")).alias("type")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def n9_validity(spark, sf_dir):
    """Which values can be written: lists of one type can, mixed lists and texts of 65,536 bytes cannot."""
    parts = part_view.parts(spark, sf_dir).select("p_size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = []
            for n in batch.column(0).to_pylist():
                items = [nbt.tag(n), nbt.tag("x")] if n % 3 == 0 else [nbt.tag(n), nbt.tag(n + 1)]
                own.append(nbt.is_valid({"list": nbt.Tag(nbt.LIST, items), "text": "x" * (65535 + (n % 3 == 1))}))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(own)], names=["p_size", "valid"])

    return parts.mapInArrow(run, "p_size bigint, valid boolean").groupBy("p_size", "valid").agg(F.count("*").alias("n"))


def n14_edited_tree(spark, sf_dir):
    """One document after a value is added and two are taken out."""
    nodes = nbt.nodes(_documents(spark, sf_dir, F.col("p_partkey") == 1))  # a filter on documents that are made already would make them all
    number = {r["path"]: r["node_id"] for r in nodes.collect()}
    grown = nbt.insert_node(nodes, "1", 0, "new", {"k": 7})
    left = nbt.remove_node(nbt.remove_node(grown, "1", number["part.name"]), "1", number["part.a.b[0]"])
    return left.select("path", nbt.tag_name(F.col("tag_type")).alias("type"), F.col("ordinal").cast("bigint").alias("ordinal"), F.col("child_count").cast("bigint").alias("child_count"), "long_val")


def n2_mapped_values(spark, sf_dir):
    """A map from mob to number for each chunk, every value doubled."""
    te = view.tile_entities(spark, sf_dir).where(F.col("entity_id").isNotNull()).groupBy("chunk_x", "chunk_z", "entity_id").agg(F.count("*").alias("n"))
    held = te.groupBy("chunk_x", "chunk_z").agg(F.map_from_entries(F.collect_list(F.struct("entity_id", "n"))).alias("m"))
    return held.select("chunk_x", "chunk_z", F.explode(F.transform_values("m", lambda _, n: 2 * n)).alias("entity_id", "n"))


def _boxes(spark, sf_dir) -> DataFrame:
    """chunk_x, chunk_z, part and the extents ``e`` of each fifth of each chunk, in world coordinates."""
    rows = view.voxels(spark, sf_dir).withColumns({"x": F.col("x") + 16 * F.col("chunk_x"), "z": F.col("z") + 16 * F.col("chunk_z"), "part": F.floor(F.col("y") / 26)})
    return store.extents(rows, by=("chunk_x", "chunk_z", "part")).withColumnRenamed("extents", "e")


def p7_extent_predicates(spark, sf_dir):
    """Which extents lie in a cuboid, meet one, hold its corner, are equal to themselves or empty."""
    e, outer, clip = F.col("e"), OUTER.column(), CLIP.column()
    return _boxes(spark, sf_dir).select(
        "chunk_x", "chunk_z", "part", extents.within(e, outer).alias("within"), extents.intersects(e, clip).alias("meets"),
        extents.contains(e, F.lit(20), F.lit(30), F.lit(10)).alias("holds"), e.eqNullSafe(outer).alias("equal"), extents.intersection(e, clip).isNull().alias("apart_is_empty"),
    )


def g12_corners(spark, sf_dir):
    """Corners of extents, moved."""
    moved = extents.offset(F.col("e"), F.lit(3), F.lit(-2), F.col("part"))
    low, high = extents.minimum(moved), extents.maximum(moved)
    at = Box.at(1, 2, 3, 4, 5, 6)
    return _boxes(spark, sf_dir).select(
        "chunk_x", "chunk_z", "part", *[low[c].alias(f"low_{c}") for c in "xyz"], *[high[c].alias(f"high_{c}") for c in "xyz"], extents.width(moved).alias("width"),
        (extents.width(at.column()) * 100 + extents.height(at.column()) * 10 + extents.length(at.column())).alias("size_at"),
    )


def g11_steps(spark, sf_dir):
    """Every torch's position one step in each direction."""
    torch = view.world(spark, sf_dir).where(F.col("block_id") == ID["torch"])
    ways = []
    for way in cells.STEPS:
        x, y, z = extents.step(F.col("x"), F.col("y"), F.col("z"), way)
        ways.append(F.struct(F.lit(way).alias("way"), x.alias("x"), y.alias("y"), z.alias("z")))
    return torch.select(F.explode(F.array(*ways)).alias("s")).select("s.*")


def x8_directions(spark, sf_dir):
    """Every direction turned and mirrored."""
    rows = [(w, cells.opposite(w), cells.mirror(w, "ns"), cells.mirror(w, "ew"), cells.mirror(w, "ud"), cells.turn(w, 1), cells.turn(w, 3)) for w in cells.DIRECTIONS]
    return spark.createDataFrame(rows, "way string, opposite string, north_south string, east_west string, up_down string, clockwise string, anticlockwise string")


def x9_rails(spark, sf_dir):
    """Every rail shape turned and flipped."""
    rows = [(s, cells.rail_turn(s), cells.rail_turn(s, 3), cells.rail_mirror(s, "ew"), cells.rail_mirror(s, "ns")) for s in range(10)]
    return spark.createDataFrame(rows, "shape bigint, clockwise bigint, anticlockwise bigint, east_west bigint, north_south bigint")


def x16_cell_numbers(spark, sf_dir):
    """Hash, text and equality of the cells that occur, and their standard tile entity."""
    kinds = view.voxels(spark, sf_dir).select("block_id", "block_data").distinct()
    b, d = F.col("block_id"), F.col("block_data")
    other = F.struct(b, F.pmod(d, F.lit(8)).alias("block_data"))
    return kinds.select("block_id", "block_data", cells.cell_hash(b, d).alias("hash"), cells.cell_text(b, d).alias("text"), cells.same_cell(F.struct(b, d), other).alias("same"), cells.standard_tile_entity().isNull().alias("no_tile_entity"))


def x11_solid_and_wire(spark, sf_dir):
    """Blocks by name, class and weight."""
    types = cells.block_types(spark)
    return types.select(F.col("block_id").cast("bigint").alias("block_id"), "name", "is_solid", F.col("ground_weight").cast("bigint").alias("ground_weight"), "tile_entity")


def v4_set_tile_entities(spark, sf_dir):
    """Tile entities after new ones are set on chests and others are taken away; all fit their blocks."""
    te = view.to_world(view.tile_entities(spark, sf_dir)).select("x", "y", "z", "id")
    changes = te.where("y % 2 = 0").withColumn("id", F.when(F.col("x") % 2 == 0, F.col("id")))
    return store.set_tile_entities(te, changes, view.world(spark, sf_dir))


def v10_bulk_write(spark, sf_dir):
    """Three writes at once, later ones over earlier."""
    w = view.world(spark, sf_dir)
    batch = lambda box, block: store.grid(spark, box).withColumns({"block_id": F.lit(block), "block_data": F.lit(1)})
    after, _ = store.bulk_write(w, [batch(Box(0, 9, 5, 9, 0, 9), 3), batch(Box(5, 14, 5, 9, 5, 14), 4), batch(Box(7, 8, 7, 8, 7, 8), 0)])
    return after


def v10_bulk_change(spark, sf_dir):
    """The one record of what those writes changed."""
    w = view.world(spark, sf_dir)
    batch = lambda box, block: store.grid(spark, box).withColumns({"block_id": F.lit(block), "block_data": F.lit(1)})
    return store.bulk_write(w, [batch(Box(0, 9, 5, 9, 0, 9), 3), batch(Box(5, 14, 5, 9, 5, 14), 4)])[1].select("extents.*", "n_changed")


def v7_parts(spark, sf_dir):
    """The cubes of 16 cells that are not empty, within a cuboid."""
    return store.parts(view.world(spark, sf_dir), CLIP).select("px", "py", "pz", "extents.*", "n")


def v17_clamped_layers(spark, sf_dir):
    """Layers brought into what each kind of store can have."""
    box = Box(0, 3, 10, 20, 0, 3)
    y = F.col("y") * 7 - 300
    return view.world(spark, sf_dir).select("y").distinct().select("y", store.clamp_layer(y, "sparse", box).alias("sparse"), store.clamp_layer(y, "anvil").alias("anvil"), store.clamp_layer(y, "legacy").alias("legacy"))


def v21_scribble(spark, sf_dir):
    """What random writes into an empty store keep to."""
    empty = view.world(spark, sf_dir).where(F.lit(False))
    out = store.scribble(empty, OUTER, seed=5)
    w, h, n = OUTER.size
    inside = OUTER.holds(F.col("x"), F.col("y"), F.col("z")) & F.col("block_id").between(1, blocks.LAST_ID) & (F.col("block_data") == 0)
    return out.agg((F.count("*") <= w * h * n // 50).alias("few"), (F.count("*") > w * h * n // 60).alias("many"), F.every(inside).alias("inside"), (F.count_distinct("x", "y", "z") == F.count("*")).alias("distinct"))


def v16_cells(spark, sf_dir):
    """Single cells read by position, with the ground below."""
    w = view.world(spark, sf_dir)
    rows = [(x, y, z, *store.cell_at(w, x, y, z, ground=20)) for x, y, z in ((0, 0, 0), (3, 50, 7), (100, 10, 0), (100, 30, 0))]
    return spark.createDataFrame(rows, "x bigint, y bigint, z bigint, block_id bigint, block_data bigint")


def v18_centred(spark, sf_dir):
    """Floating content put down round a position."""
    w = view.world(spark, sf_dir)
    rest, floating = store.lift(w, CLIP)
    return store.settle(rest, floating, store.centred(store.box_of(floating), 30, 40, 30))


def j5_legacy_copy(spark, sf_dir):
    """A copy that moves the other way, as an older convention has it."""
    w = view.world(spark, sf_dir)
    return store.copy_region(w, w, CLIP, (15, 20, 6), legacy_offset=True)


def g1_load_over(spark, sf_dir):
    """Another store's cells over this one, at the origin (G1)."""
    w = view.world(spark, sf_dir)
    return transforms.load_over(w, store.crop(w, CLIP))


def k15_selection(spark, sf_dir):
    """A selection as a schematic, and what is in it."""
    part = store.crop(view.world(spark, sf_dir), CLIP).withColumn("store", F.lit("selection"))
    files = schematic.encoded(part).select(F.col("store").alias("path"), "content")
    return schematic.stores(files).where("block_id <> 0 or block_data <> 0").select(*[F.col(c).cast("bigint").alias(c) for c in ("x", "y", "z", "block_id", "block_data")])


def t5_sign_texts(spark, sf_dir):
    """Texts of signs from the lines that are not empty."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name", F.col("n_nationkey").cast("bigint").alias("n_nationkey"))
    lines = F.array(F.col("n_name"), F.lit(""), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey").cast("string")).otherwise(F.lit("")), F.lit(""))
    lines = F.when(F.col("n_nationkey") % 5 == 0, F.array(F.lit(""), F.lit(""))).otherwise(lines)
    rows = n.withColumns({"lines": lines, "block_id": F.lit(ID["sign_post"]), "block_data": F.lit(3)})
    return describe.long(rows, lines="lines").select("n_nationkey", "description", describe.sign_text(F.col("lines")).alias("text"))


def t6_mob_names(spark, sf_dir):
    """Friendly names of mobs, other ids as they are."""
    rows = spark.createDataFrame([(m,) for m in (*sorted(describe.MOBS), "Herobrine")], "mob string")
    return rows.select("mob", describe.mob_name(F.col("mob")).alias("name"))


def k3_written_tables(spark, sf_dir):
    """Every table of the statistics over the files, as the job writes them: name of the table and its sums (K1-K4)."""
    read = _slots(spark, sf_dir).persist()  # the files are made once for all tables
    table, slots = region.chunks(read), read.where("status in ('ok', 'absent')")
    voxels = region.voxels(table).drop("region_file")
    good = table.where("status = 'ok' and populated").select(F.col("x_pos").alias("chunk_x"), F.col("z_pos").alias("chunk_z"))
    voxels = voxels.join(good, ["chunk_x", "chunk_z"], "left_semi")
    tiles = region.tile_entities(table).join(good, ["chunk_x", "chunk_z"], "left_semi")
    out = None
    for name, rows, n in statistics.tables(voxels, tiles, region.slot_table(slots, table))[0]:
        part = rows.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.sum(n).cast("bigint").alias("total"))
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {
    f.__name__: f
    for f in (
        s3_slots, s6_chunk_status, s9_chunk_headers, s10_section_cells, v15_written_sections, s7_legacy_cells, s12_tile_entities, p13_entities, p5_find_blocks, p21_command_blocks, k12_chunk_dumps, a9_file_counters, s19_inflated_sizes,
        k12_dump_lines, n8_display_names, n6_coerced_trees, n9_validity, n14_edited_tree, n2_mapped_values, p7_extent_predicates, g12_corners, g11_steps, x8_directions, x9_rails, x16_cell_numbers,
        x11_solid_and_wire, v4_set_tile_entities, v10_bulk_write, v10_bulk_change, v7_parts, v17_clamped_layers, v21_scribble, v16_cells, v18_centred, j5_legacy_copy, g1_load_over, k15_selection,
        t5_sign_texts, t6_mob_names, k3_written_tables,
    )
}
