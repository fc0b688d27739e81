"""Texts for people: short and long descriptions of cells.

What a cell's id and data say is a table of at most 4,096 rows, made once and
broadcast; what its tile entity says is a column expression.
"""

from __future__ import annotations

from functools import cache
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks, cells
from .blocks import ID

# Texts that depend on the data, in the order of the data.
WOODS = ("leafy", "conifer", "birch", "leafy (buggy)")
GRASSES = ("dead shrub", "tall grass", "fern")
WOOLS = ("white", "orange", "magenta", "light blue", "yellow", "light green", "pink", "gray", "light gray", "cyan", "purple", "blue", "brown", "dark green", "red", "black")
SLABS = ("stone", "sandstone", "wood", "cobblestone", "brick", "stone brick", "stone")
SILVERFISH = ("Stone", "Cobblestone", "Stone brick")
POTS = ("empty", "red flower", "yellow flower", "oak sapling", "spruce sapling", "birch sapling", "jungle sapling", "red mushroom", "brown mushroom", "cactus", "dead shrub", "fern")
MOBS = {
    "CaveSpider": "cave spider", "Chicken": "chicken", "Cow": "cow", "Creeper": "creeper", "Enderman": "enderman", "Giant": "giant", "Pig": "pig", "PigZombie": "pig zombie",
    "Sheep": "sheep", "Silverfish": "silverfish", "Skeleton": "skeleton", "Slime": "slime", "Spider": "spider", "Squid": "squid", "Wolf": "wolf", "Zombie": "zombie",
}


def fill(template: str | Column, **values: Column) -> Column:
    """A template with each ``<$name$>`` replaced by a value; null if any value is null."""
    out = F.lit(template) if isinstance(template, str) else template
    for name, v in values.items():
        out = F.replace(out, F.lit(f"<${name}$>"), v.cast("string"))
    return out


def grouped(number: Column) -> Column:
    """A whole number as text with grouped digits."""
    return F.format_number(number, 0)


class Part(NamedTuple):
    """What some bits of the data say: a text for each value of ``data & mask``; other values say nothing."""

    mask: int
    texts: dict[int, str]


def _in_order(mask: int, texts: tuple[str, ...]) -> Part:
    return Part(mask, dict(enumerate(texts)))


_LEVEL = Part(7, {i: f"level {8 - i}" for i in range(8)})
_ON_OFF, _OPEN = Part(8, {0: "off", 8: "on"}), Part(4, {0: "closed", 4: "open"})
_WOOD, _SLAB, _PRESSED = _in_order(3, WOODS), _in_order(15, SLABS), Part(1, {0: "off", 1: "on"})
_HALF, _STANDING = Part(8, {0: "bottom", 8: "top"}), Part(7, {5: "standing"})
_ALWAYS_ON, _ALWAYS_OFF = Part(0, {0: "on"}), Part(0, {0: "off"})
_DELAY = Part(12, {4 * i: f"delay: {i + 1}" for i in range(4)})

#: The parts of each block's text; those that say something are joined by commas.
PARTS: dict[str, tuple[Part, ...]] = {
    "water": (_LEVEL,), "lava": (_LEVEL,), "log": (_WOOD,), "leaves": (_WOOD, Part(4, {4: "permanent"})), "bed": (Part(8, {0: "foot", 8: "head"}),),
    "powered_rail": (Part(8, {8: "powered"}),), "tall_grass": (_in_order(15, GRASSES),), "piston_head": (Part(8, {8: "sticky"}),), "cloth": (_in_order(15, WOOLS),),
    "double_slab": (_SLAB,), "single_slab": (_SLAB,), "soil": (Part(15, {0: "dry"} | {i: f"wetness {i}" for i in range(1, 16)}),), "redstone_wire": (Part(15, {0: "off"} | {i: f"power level {i}" for i in range(1, 16)}),),
    "burning_furnace": (Part(0, {0: "burning"}),), "wooden_door": (_HALF, _OPEN), "iron_door": (_HALF, _OPEN), "lever": (_ON_OFF,), "stone_button": (_ON_OFF,), "wooden_button": (_ON_OFF,),
    "stone_pressure_plate": (_PRESSED,), "wooden_pressure_plate": (_PRESSED,), "glowing_redstone_ore": (Part(0, {0: "glowing"}),),
    "redstone_torch_on": (_ALWAYS_ON, _STANDING), "redstone_torch_off": (_ALWAYS_OFF, _STANDING), "redstone_lamp_on": (_ALWAYS_ON,), "redstone_lamp_off": (_ALWAYS_OFF,),
    "cake": (Part(7, {i: f"{6 - i} slices" for i in range(8)}),), "redstone_repeater_on": (_ALWAYS_ON, _DELAY), "redstone_repeater_off": (_ALWAYS_OFF, _DELAY), "trapdoor": (_OPEN,), "gate": (_OPEN,),
    "stone_with_silverfish": (_in_order(15, SILVERFISH),), "tripwire_hook": (Part(12, {0: "disconnected", 4: "connected", 8: "active", 12: "active"}),), "tripwire": (Part(4, {4: "live"}),), "flower_pot": (_in_order(15, POTS),),
}


def detail(block: int, data: int) -> str | None:
    """What the data say besides the direction; None if nothing."""
    said = [part.texts[data & part.mask] for part in PARTS.get(blocks.WORDS.get(block, ""), ()) if data & part.mask in part.texts]
    return ", ".join(said) or None


@cache
def details() -> tuple[tuple[int, int, str | None, str | None], ...]:
    """(block, data, detail, direction) of every cell of which there is anything to say."""
    out = []
    for b in sorted(blocks.NAMES):
        for d in range(16):
            way = cells.facing(b, d)
            standing = b in (ID["redstone_torch_on"], ID["redstone_torch_off"]) and d & 7 == 5
            way = None if way == "unknown" or standing else way
            if (text := detail(b, d)) is not None or way is not None:
                out.append((b, d, text, way))
    return tuple(out)


def sign_text(lines: Column) -> Column:
    """The lines that are not empty, joined and quoted; "empty" if there are none."""
    said = F.filter(F.coalesce(lines, F.expr("cast(array() as array<string>)")), lambda t: F.length(t) > 0)
    return F.when(F.size(said) > 0, F.concat(F.lit("“"), F.array_join(said, " / "), F.lit("”"))).otherwise("empty")


def mob_name(mob: Column) -> Column:
    """A friendly name, or the id as it is."""
    table = F.create_map(*[F.lit(x) for kv in MOBS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, mob), mob)


def short(rows: DataFrame, into: str = "description", block: str = "block_id") -> DataFrame:
    """``rows`` with the block's name; null for ids without one."""
    table = rows.sparkSession.createDataFrame(sorted(blocks.NAMES.items()), f"_b int, `{into}` string")
    return rows.join(F.broadcast(table), F.col(block) == F.col("_b"), "left").drop("_b")


def long(rows: DataFrame, into: str = "description", entity_id: str | None = None, note: str | None = None, record: str | None = None, lines: str | None = None) -> DataFrame:
    """``rows`` with the name, details in parentheses, and the direction.

    The last four name columns of the tile entity, where ``rows`` has them: a
    spawner's mob, a note block's pitch, a jukebox's record, a sign's lines.
    Unknown ids read "Unknown (ID n)".
    """
    spark = rows.sparkSession
    table = spark.createDataFrame(details(), "_db int, _dd int, _detail string, _way string")
    on = (F.col("block_id") == F.col("_db")) & (F.col("block_data").bitwiseAND(15) == F.col("_dd"))
    out = short(rows, "_name").join(F.broadcast(table), on, "left")
    b = F.col("block_id")
    null = F.lit(None).cast("string")
    own = F.col("_detail")
    own = F.when(b == ID["mob_spawner"], mob_name(F.col(entity_id)) if entity_id else null).otherwise(own)
    own = F.when(b == ID["note_block"], fill("note <$pitch$>", pitch=F.col(note)) if note else null).otherwise(own)
    own = F.when((b == ID["jukebox"]), F.when(F.col(record) != 0, fill("record <$n$>", n=F.col(record))) if record else null).otherwise(own)
    own = F.when(b.isin(ID["sign_post"], ID["wall_sign"]), sign_text(F.col(lines)) if lines else F.lit("empty")).otherwise(own)
    way = F.concat(F.lit("facing "), F.col("_way"))
    extra = F.when(own.isNull(), way).when(way.isNull(), own).otherwise(F.concat(own, F.lit(", "), way))
    text = F.when(F.col("_name").isNull(), fill("Unknown (ID <$id$>)", id=b)).when(extra.isNull(), F.col("_name")).otherwise(F.concat(F.col("_name"), F.lit(" ("), extra, F.lit(")")))
    return out.withColumn(into, text).drop("_name", "_db", "_dd", "_detail", "_way")
