"""Functions of a cell (block id, block data), in Python and as DataFrame columns.

A family of blocks keeps its facing in a few bits of the data, each with its own
code.  ``facing`` and ``turned_to`` read and write it; rotations and flips are
built from them, with rails, logs, sign posts and floor levers apart.  The
column forms join a small table of the cells that an operation changes.

Facing up or down is left alone by rotations (also where a family has no such
value, its default is written).  Cells whose data names no direction are given
their family's default, so operations on those are not inverses of each other.
"""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from .blocks import ID

DIRECTIONS = ("north", "south", "east", "west", "up", "down", "unknown")
#: Step of each direction along x, y, z.
STEPS = {"north": (0, 0, -1), "south": (0, 0, 1), "east": (1, 0, 0), "west": (-1, 0, 0), "up": (0, 1, 0), "down": (0, -1, 0)}


class Family:
    """Blocks that share a code for their facing: direction of each value, bits used, default."""

    def __init__(self, names: tuple[str, ...], mask: int, read: dict[int, str], default: int):
        self.ids = frozenset(ID[n] for n in names)
        self.mask, self.read, self.default = mask, read, default
        self.write = {}
        for value, way in read.items():
            self.write.setdefault(way, value)


# Bits, codes and default of each family of blocks that face a direction.
FAMILIES = {
    "attached": Family(("torch", "redstone_torch_off", "redstone_torch_on"), 7, {1: "east", 2: "west", 3: "south", 4: "north", 5: "down", 6: "down"}, 5),
    "lever": Family(("lever",), 7, {1: "east", 2: "west", 3: "south", 4: "north", 6: "down", 5: "down"}, 6),
    "button": Family(("stone_button", "wooden_button"), 7, {1: "east", 2: "west", 3: "south", 4: "north", 5: "down", 6: "down"}, 2),
    "door": Family(("wooden_door", "iron_door", "gate"), 3, {0: "west", 1: "south", 2: "east", 3: "north"}, 3),
    "stairs": Family(("wooden_stairs", "cobblestone_stairs", "brick_stairs", "stone_brick_stairs", "nether_brick_stairs", "sandstone_stairs", "spruce_wood_stairs", "birch_wood_stairs", "jungle_wood_stairs"), 3, {0: "east", 1: "west", 2: "south", 3: "north"}, 3),
    "container": Family(("chest", "ladder", "wall_sign", "furnace", "burning_furnace", "dispenser", "ender_chest"), 7, {2: "north", 3: "south", 4: "west", 5: "east"}, 2),
    "pumpkin": Family(("pumpkin", "jack_o_lantern"), 3, {0: "south", 1: "east", 2: "north", 3: "west"}, 2),
    "bed": Family(("bed", "redstone_repeater_on", "redstone_repeater_off", "end_portal_frame", "cocoa_pod"), 3, {0: "north", 1: "east", 2: "south", 3: "west"}, 0),
    "piston": Family(("piston", "sticky_piston", "piston_head"), 7, {0: "down", 1: "up", 2: "north", 3: "south", 4: "west", 5: "east"}, 3),
    "trapdoor": Family(("trapdoor",), 3, {0: "north", 1: "south", 2: "west", 3: "east"}, 1),
    "hook": Family(("tripwire_hook",), 3, {0: "south", 1: "west", 2: "north", 3: "east"}, 0),
}
FAMILY = {i: f for f in FAMILIES.values() for i in f.ids}

_AROUND = ("north", "east", "south", "west")


def turn(way: str, quarter: int) -> str:
    """Direction after clockwise quarter turns seen from above; up and down stay."""
    return _AROUND[(_AROUND.index(way) + quarter) % 4] if way in _AROUND else way


def mirror(way: str, axis: str) -> str:
    """Opposite along one axis: ``ns``, ``ew`` or ``ud``."""
    for a, b in {"ns": ("north", "south"), "ew": ("east", "west"), "ud": ("up", "down")}[axis],:
        return b if way == a else a if way == b else way
    return way


def opposite(way: str) -> str:
    return mirror(mirror(mirror(way, "ns"), "ew"), "ud")


def facing(block: int, data: int) -> str:
    f = FAMILY.get(block)
    return f.read.get(data & f.mask, "unknown") if f else "unknown"


def turned_to(block: int, data: int, way: str) -> int:
    """Data of the block when it faces ``way``, or its default where it cannot."""
    f = FAMILY.get(block)
    if not f:
        return data
    if f is FAMILIES["lever"] and way not in _AROUND:
        value = data & f.mask if data & f.mask in (5, 6) else f.default
    elif f is FAMILIES["button"] and way == "down":
        value = f.default
    else:
        value = f.write.get(way, f.default)
    return data & ~f.mask | value


# Fixed values of rails: two straight, four rising, four curves; a quarter turn maps each to the next of its cycle.
_RAIL_CYCLES = ((0, 1), (2, 5, 3, 4), (6, 7, 8, 9))
_RAIL_TURN = {c[i]: c[(i + 1) % len(c)] for c in _RAIL_CYCLES for i in range(len(c))}
_RAIL_MIRROR = {4: 5, 5: 4, 6: 9, 9: 6, 7: 8, 8: 7}


def rail_turn(shape: int, quarter: int = 1) -> int:
    return reduce(lambda s, _: _RAIL_TURN.get(s, s), range(quarter % 4), shape)


def rail_mirror(shape: int, axis: str) -> int:
    """The ``ew`` flip is the table; ``ns`` is that between quarter turns."""
    if axis == "ew":
        return _RAIL_MIRROR.get(shape, shape)
    return rail_turn(_RAIL_MIRROR.get(rail_turn(shape), rail_turn(shape)), 3)


def _rail(block: int, data: int, f) -> int:
    mask = 15 if block == ID["rail"] else 7
    return data & ~mask | f(data & mask) & mask


def rotate(block: int, data: int, quarter: int) -> int:
    """Data after clockwise quarter turns."""
    quarter %= 4
    if block in blocks.CLASSES["rail"]:
        return _rail(block, data, lambda s: rail_turn(s, quarter))
    if block == ID["sign_post"]:
        return data & ~15 | (data + 4 * quarter) & 15
    odd = quarter % 2 == 1
    if block == ID["log"]:
        return data ^ 12 if odd and data & 12 in (4, 8) else data
    way = facing(block, data)
    if block == ID["lever"] and way == "down":
        return data & ~7 | 11 - (data & 7) if odd else data
    return turned_to(block, data, turn(way, quarter))


def flip(block: int, data: int, axis: str) -> int:
    """Data after a flip along ``ns`` or ``ew``."""
    if block in blocks.CLASSES["rail"]:
        return _rail(block, data, lambda s: rail_mirror(s, axis))
    return turned_to(block, data, mirror(facing(block, data), axis))


OPERATIONS = {
    "rotate_clockwise": lambda b, d: rotate(b, d, 1),
    "rotate_anticlockwise": lambda b, d: rotate(b, d, 3),
    "rotate_180": lambda b, d: rotate(b, d, 2),
    "flip_east_west": lambda b, d: flip(b, d, "ew"),
    "flip_north_south": lambda b, d: flip(b, d, "ns"),
}


@cache
def changes(operation: str) -> tuple[tuple[int, int, int], ...]:
    """Cells (id, data) and the new data, for all that the operation changes; internal high bits stay."""
    f = OPERATIONS[operation]
    return tuple((b, d, n) for b in range(256) for d in range(256) if (n := d & 0xF0 | f(b, d & 15)) != d)


def transformed(cells: DataFrame, operation: str, block: str = "block_id", data: str = "block_data") -> DataFrame:
    """``cells`` with the data column transformed; a broadcast join with at most 65,536 fixed rows."""
    kind = cells.schema[data].dataType
    spark = cells.sparkSession
    table = spark.createDataFrame(changes(operation), "_b int, _d int, _n int")
    on = (F.col(block) == F.col("_b")) & (F.col(data) == F.col("_d"))
    joined = cells.join(F.broadcast(table), on, "left")
    return joined.withColumn(data, F.coalesce(F.col("_n").cast(kind), F.col(data))).drop("_b", "_d", "_n")


def facings(spark: SparkSession) -> DataFrame:
    """(block_id, block_data, direction) for every cell with a direction; fixed size."""
    rows = [(b, d, w) for b in FAMILY for d in range(16) if (w := facing(b, d)) != "unknown"]
    return spark.createDataFrame(sorted(rows), "block_id int, block_data int, direction string")


def block_types(spark: SparkSession) -> DataFrame:
    """One row for each id 0 to 255: name, classes, weight of the ground test, expected tile entity."""
    kinds = list(blocks.CLASSES)
    rows = [
        (i, blocks.NAMES.get(i), *[i in blocks.CLASSES[k] for k in kinds], i in blocks.CLASSES["opaque"] | blocks.CLASSES["transparent"] and i != blocks.AIR, blocks.WEIGHTS.get(i, 0), blocks.TILE_ENTITIES.get(i))
        for i in range(256)
    ]
    schema = "block_id int, name string, " + ", ".join(f"is_{k} boolean" for k in kinds) + ", is_solid boolean, ground_weight int, tile_entity string"
    return spark.createDataFrame(rows, schema)


def items(spark: SparkSession) -> DataFrame:
    """(item_id, name): blocks below 256, then items and discs."""
    rows = [*blocks.NAMES.items(), *blocks.ITEMS.items()]
    return spark.createDataFrame(rows, "item_id int, name string")


def is_class(block: Column, *kinds: str) -> Column:
    """Whether the block is of any of the classes."""
    return block.isin(sorted(set().union(*[blocks.CLASSES[k] for k in kinds])))


def is_air(block: Column, data: Column) -> Column:
    return (block == blocks.AIR) & (data.bitwiseAND(blocks.HOLE_BIT) == 0)


def is_hole(block: Column, data: Column) -> Column:
    return (block == blocks.AIR) & (data.bitwiseAND(blocks.HOLE_BIT) != 0)


def wire_power(block: Column, data: Column) -> Column:
    return F.when(block == ID["redstone_wire"], data.bitwiseAND(15)).otherwise(0)


def tile_entity_fits(kind: Column, expected: Column) -> Column:
    """A missing tile entity fits anything; one that is there must have the expected type."""
    return kind.isNull() | F.coalesce(kind == expected, F.lit(False))


def same_cell(a: Column, b: Column) -> Column:
    """Whether two cells are equal, tile entities too: structs of block_id, block_data and what else tells them apart."""
    return a.eqNullSafe(b)


def cell_hash(block: Column, data: Column, tile_entity_hash: Column | None = None) -> Column:
    """A cell's number for hashing: the id, the data from bit 8 up, the tile entity's hash from bit 16 up."""
    own = block.cast("long").bitwiseOR(F.shiftleft(data.cast("long"), 8))
    return own if tile_entity_hash is None else own.bitwiseOR(F.shiftleft(tile_entity_hash.cast("long"), 16))


def cell_text(block: Column, data: Column) -> Column:
    return F.format_string("{ ID: %d, data: 0x%X }", block.cast("long"), data.cast("long"))


def standard_tile_entity() -> Column:
    """What a new cell of a block has as its tile entity: none, for every block."""
    return F.lit(None).cast("string")
