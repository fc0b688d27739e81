"""Block stores as DataFrames: reading, writing, filling, copying, overlaying.

A store is a sparse frame with x, y, z, block_id and block_data, at most one row
for each position; positions without a row hold the empty cell, which is air at
and above the ground level and stone below it.  Frames with several stores name
the columns that tell them apart in ``by``.  Nothing is changed in place: each
function returns a new lazy frame, so an undo is the frame from before.

Writes are one anti join on the position and a union, so a small set of changes
is broadcast and a large one shuffled by position, as Spark's size estimate says.
Filling and overlaying a cuboid need no join for what lies outside it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blocks
from ..functions.cells import is_air, is_class, is_hole, tile_entity_fits
from ..functions.extents import Box, bounds

POSITION = ("x", "y", "z")
CELL = ("block_id", "block_data")


def empty_id(y: Column, ground: int | Column) -> Column:
    return F.when(y < ground, blocks.STONE).otherwise(blocks.AIR)


def is_empty(ground: int | Column = 0) -> Column:
    """Whether a row holds what a missing row means."""
    return (F.col("block_id") == empty_id(F.col("y"), ground)) & (F.col("block_data") == 0)


def drop_empty(store: DataFrame, ground: int | Column = 0) -> DataFrame:
    """The same store without rows that say nothing."""
    return store.where(~is_empty(ground))


def grid(spark: SparkSession, box: Box) -> DataFrame:
    """x, y, z of every position of the cuboid; generated in parallel, never on the driver."""
    w, h, n = box.size
    i = F.col("id")
    rows = spark.range(w * h * n)
    if box.empty:
        return rows.select(*[i.alias(c) for c in POSITION])
    return rows.select((i % w + box.minX).alias("x"), (F.floor(i / (w * n)) + box.minY).alias("y"), (F.floor(i / w) % n + box.minZ).alias("z"))


def _like(rows: DataFrame, store: DataFrame) -> DataFrame:
    """``rows`` with the store's columns and types; columns it lacks are null."""
    have = set(rows.columns)
    return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in store.schema.fields])


def read_cells(store: DataFrame, points: DataFrame, ground: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """``points`` with the cell at each; the empty cell where the store has none."""
    cells = store.select(*by, *POSITION, *CELL)
    out = points.join(cells, [*by, *POSITION], "left")
    kinds = dict(store.dtypes)
    return out.withColumns(
        {
            "block_data": F.coalesce("block_data", F.lit(0).cast(kinds["block_data"])),
            "block_id": F.coalesce("block_id", empty_id(F.col("y"), ground).cast(kinds["block_id"])),
        }
    )


def write_cells(store: DataFrame, changes: DataFrame, ground: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """The store after writing ``changes`` (at most one row for each position)."""
    kept = store.join(changes.select(*by, *POSITION), [*by, *POSITION], "left_anti")
    return kept.unionByName(_like(drop_empty(changes, ground), store))


def cell_at(store: DataFrame, x: int, y: int, z: int, ground: int = 0) -> tuple[int, int]:
    """Block and data at one position."""
    row = store.where((F.col("x") == x) & (F.col("y") == y) & (F.col("z") == z)).select(*CELL).first()
    return tuple(row) if row else (blocks.STONE if y < ground else blocks.AIR, 0)


def bulk_write(store: DataFrame, batches: Sequence[DataFrame], ground: int = 0, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The store after several writes, later ones over earlier, and the one record of what changed, as ``changed_extents`` has it."""
    every = None
    for n, rows in enumerate(batches):
        own = _like(rows, store).withColumn("_turn", F.lit(n))
        every = own if every is None else every.unionByName(own)
    if every is None:
        return store, changed_extents(store, store, by)
    rest = [c for c in store.columns if c not in (*by, *POSITION)]
    last = every.groupBy(*by, *POSITION).agg(F.max_by(F.struct(*rest), "_turn").alias("_c")).select(*by, *POSITION, "_c.*")
    after = write_cells(store, last, ground, by)
    return after, changed_extents(store, after, by)


def parts(store: DataFrame, box: Box | None = None, side: int = 16, ground: int = 0) -> DataFrame:
    """The cubes of ``side`` cells that hold any non-empty cell, of the store or of ``box``: their cuboid and number of cells."""
    rows = drop_empty(store if box is None else crop(store, box), ground)
    at = [F.floor(F.col(c) / side).alias(f"p{c}") for c in POSITION]
    return rows.groupBy(*at).agg(bounds().alias("extents"), F.count("*").alias("n"))


def visit_parts(store: DataFrame, visit: Callable[[Box], bool], box: Box | None = None, side: int = 16, ground: int = 0) -> bool:
    """Call ``visit`` with the cuboid of each part, by y, z and x, until it gives False; whether all were visited.

    The cuboids are fetched a partition at a time, so what comes after a stop is not.
    """
    for r in parts(store, box, side, ground).orderBy("py", "pz", "px").toLocalIterator():
        if not visit(Box(*r["extents"])):
            return False
    return True


def fill(store: DataFrame, box: Box, block: int, data: int = 0, ground: int = 0) -> DataFrame:
    """The store with one cell in the whole cuboid."""
    kept = store.where(~box.holds(*map(F.col, POSITION)))
    new = grid(store.sparkSession, box).withColumns({"block_id": F.lit(block), "block_data": F.lit(data)})
    if (block, data) == (blocks.AIR, 0) and box.minY >= ground:
        return kept
    return kept.unionByName(_like(drop_empty(new, ground), store))


def crop(store: DataFrame, box: Box) -> DataFrame:
    """The part of the store inside the cuboid."""
    return store.where(box.holds(*map(F.col, POSITION)))


def shifted(store: DataFrame, dx: int, dy: int, dz: int) -> DataFrame:
    return store.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy, "z": F.col("z") + dz})


def copy_region(store: DataFrame, source: DataFrame, box: Box, target: tuple[int, int, int], legacy_offset: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """The store with the source's non-air cells of ``box``, its least corner put at ``target``.

    ``legacy_offset`` moves the other way, by the same distance.
    """
    if box.empty:
        return store
    sign = -1 if legacy_offset else 1
    dx, dy, dz = (sign * (t - m) for t, m in zip(target, (box.minX, box.minY, box.minZ)))
    part = crop(source, box).where(~is_air(F.col("block_id"), F.col("block_data")))
    part = _like(shifted(part, dx, dy, dz), store)
    return store.join(part.select(*by, *POSITION), [*by, *POSITION], "left_anti").unionByName(part)


def overlay(store: DataFrame, over: DataFrame, box: Box, by: Sequence[str] = ()) -> DataFrame:
    """Two stores seen as one: inside ``box`` the overlay's cell wins, air too, unless it is a hole.

    ``over`` is in the store's coordinates (shift it first).
    """
    inside = box.holds(*map(F.col, POSITION))
    hole = is_hole(F.col("block_id"), F.col("block_data"))
    holes = over.where(inside & hole).select(*by, *POSITION)
    seen = store.where(inside).join(holes, [*by, *POSITION], "left_semi")
    top = _like(over.where(inside & ~hole & ~is_air(F.col("block_id"), F.col("block_data"))), store)
    return store.where(~inside).unionByName(seen).unionByName(top)


def densify(store: DataFrame, box: Box, ground: int = 0) -> DataFrame:
    """Every position of the cuboid with its cell, empty ones written out."""
    return read_cells(crop(store, box), grid(store.sparkSession, box), ground)


def extents(store: DataFrame, ground: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """One row for each store (one in all without ``by``): the cuboid round its non-empty cells."""
    return drop_empty(store, ground).groupBy(*by).agg(bounds().alias("extents"))


def box_of(store: DataFrame, ground: int = 0) -> Box:
    """The cuboid as a value: one aggregation, six numbers come back."""
    e = extents(store, ground).first()["extents"]
    return Box(*e) if e else Box(0, -1, 0, -1, 0, -1)


def layers(kind: str, box: Box | None = None) -> tuple[int, int]:
    """Least and greatest layer that a store can have: sparse stores reach 128 beyond their extents."""
    if kind == "sparse":
        return (box.minY - 128, box.maxY + 128) if box and not box.empty else (-128, 128)
    return (0, 255) if kind == "anvil" else (0, 127)


def clamp_layer(y: Column, kind: str, box: Box | None = None) -> Column:
    low, high = layers(kind, box)
    return F.greatest(F.least(y, F.lit(high)), F.lit(low))


def layer_slice(store: DataFrame, y: int, min_x: int, max_x: int, min_z: int, max_z: int) -> DataFrame:
    """The cells of one layer within a rectangle."""
    return crop(store, Box(min_x, max_x, y, y, min_z, max_z))


def with_tile_entities(store: DataFrame, tile_entities: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Each cell with its tile entity, if it has one."""
    return store.join(tile_entities, [*by, *POSITION], "left")


def with_expected(cells: DataFrame, into: str = "expected") -> DataFrame:
    """``cells`` with the type that a tile entity of the block must have; a lookup of fixed size."""
    spark = cells.sparkSession
    table = spark.createDataFrame(sorted(blocks.TILE_ENTITIES.items()), f"_b int, `{into}` string")
    return cells.join(F.broadcast(table), F.col("block_id") == F.col("_b"), "left").drop("_b")


def keep_fitting(tile_entities: DataFrame, cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The tile entities after ``cells`` are written over them: those go whose new block expects another type.

    A block without an expected type accepts any tile entity.
    """
    new = with_expected(cells.select(*by, *POSITION, "block_id")).withColumnRenamed("expected", "_expected").withColumn("_new", F.lit(True))
    out = tile_entities.join(new.drop("block_id"), [*by, *POSITION], "left")
    fits = F.col("_new").isNull() | F.col("_expected").isNull() | tile_entity_fits(F.col("id"), F.col("_expected"))
    return out.where(fits).select(*tile_entities.columns)


def set_tile_entities(tile_entities: DataFrame, changes: DataFrame, cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The tile entities after writing ``changes``; a null id removes; one that does not fit its cell raises."""
    kept = tile_entities.join(changes.select(*by, *POSITION), [*by, *POSITION], "left_anti")
    new = with_expected(changes.join(cells.select(*by, *POSITION, "block_id"), [*by, *POSITION], "left"))
    fits = F.col("expected").isNull() | tile_entity_fits(F.col("id"), F.col("expected"))
    checked = F.when(fits, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("tile entity does not fit block "), F.col("block_id").cast("string"))))
    new = new.withColumn("id", checked).where(F.col("id").isNotNull())
    return kept.unionByName(_like(new, tile_entities))


def lift(store: DataFrame, box: Box, ground: int = 0) -> tuple[DataFrame, DataFrame]:
    """What stays after a cuboid is taken out, and what was in it, as floating content."""
    return fill(store, box, blocks.AIR, 0, ground), crop(store, box)


def settle(store: DataFrame, floating: DataFrame, offset: tuple[int, int, int], ground: int = 0) -> DataFrame:
    """Floating content written into the store at its offset; air in it does not overwrite."""
    box = box_of(floating, ground)
    return copy_region(store, floating, box, (box.minX + offset[0], box.minY + offset[1], box.minZ + offset[2]))


def centred(box: Box, x: int, y: int, z: int) -> tuple[int, int, int]:
    """Offset that puts the centre of the cuboid at a position."""
    w, h, n = box.size
    return x - box.minX - w // 2, y - box.minY - h // 2, z - box.minZ - n // 2


def scribble(store: DataFrame, box: Box, seed: int = 0) -> DataFrame:
    """Random writes, a fiftieth of the volume and five at least: ids 0 to 175, data 0; test input."""
    w, h, n = box.size
    count = max(5, w * h * n // 50) if not box.empty else 0
    at = lambda salt, side: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(max(1, side)))
    rows = store.sparkSession.range(count).select("id", (at(1, w) + box.minX).alias("x"), (at(2, h) + box.minY).alias("y"), (at(3, n) + box.minZ).alias("z"), at(4, blocks.LAST_ID + 1).alias("block_id"))
    last = rows.groupBy(*POSITION).agg(F.max_by("block_id", "id").alias("block_id")).withColumn("block_data", F.lit(0))
    return write_cells(store, last)


def changed_extents(before: DataFrame, after: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row for each store that differs: the cuboid round all changed positions and their number."""
    a = before.select(*by, *POSITION, F.struct(*CELL).alias("_a"))
    b = after.select(*by, *POSITION, F.struct(*CELL).alias("_b"))
    diff = a.join(b, [*by, *POSITION], "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    return diff.groupBy(*by).agg(bounds().alias("extents"), F.count("*").alias("n_changed")).where("n_changed > 0")


def neighbours_of(store: DataFrame, ways: Sequence[str], cells: Column) -> DataFrame:
    """Positions next to cells that meet a condition, along ``ways`` seen from the position, each once."""
    from ..functions.cells import STEPS

    steps = F.array(*[F.struct(*[F.lit(-s).alias(c) for c, s in zip("xyz", STEPS[w])]) for w in ways])
    hits = store.where(cells).withColumn("_s", F.explode(steps))
    return hits.select(*[(F.col(c) + F.col("_s")[c]).alias(c) for c in POSITION]).distinct()


def torch_blocks(store: DataFrame, side: bool = True) -> DataFrame:
    """Solid cells with a redstone torch on any side, or with one on top."""
    solid = is_class(F.col("block_id"), "opaque", "transparent") & (F.col("block_id") != blocks.AIR)
    torch = F.col("block_id").isin(blocks.ID["redstone_torch_off"], blocks.ID["redstone_torch_on"])
    ways = ("north", "south", "east", "west") if side else ("up",)
    return store.where(solid).join(neighbours_of(store, ways, torch), [*POSITION], "left_semi")
