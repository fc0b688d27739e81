"""Region files: 32 x 32 slots of compressed chunks, and the chunks in them.

Files are read by Spark's own ``binaryFile`` reader, so any store that Spark can
open will do; a file is one task's work.  The header says which slots are there,
and slots that a caller does not want are never inflated.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import nbt

SECTOR, SLOTS = 4096, 1024
#: Modes of compression in a slot's fifth byte.
MODES = {1: "gzip", 2: "zlib"}
#: Keys of a chunk's compound that readers know.
KNOWN_KEYS = (
    "Blocks", "Data", "SkyLight", "BlockLight", "HeightMap", "Entities", "TileEntities", "LastUpdate", "xPos", "zPos", "TerrainPopulated", "V", "Biomes", "InhabitedTime", "LightPopulated", "Sections",
)
BULK_KEYS = ("Blocks", "Data", "SkyLight", "BlockLight", "Sections", "TileEntities", "xPos", "zPos")

SLOT_SCHEMA = "region_file string, local_x int, local_z int, present boolean, status string, compression int, payload binary"
_ITEM = "struct<id:string,count:bigint,damage:bigint,slot:bigint>"
CHUNK_SCHEMA = (
    "region_file string, local_x int, local_z int, status string, x_pos bigint, z_pos bigint, last_update bigint, inhabited_time bigint, populated boolean, "
    "sections array<struct<y:int,blocks:binary,data:binary>>, "
    f"entities array<struct<id:string,pos:array<double>,item:{_ITEM},chested:boolean,saddle:{_ITEM},armor:{_ITEM},body:string>>, "
    f"tile_entities array<struct<id:string,x:bigint,y:bigint,z:bigint,entity_id:string,custom_name:string,command:string,note:bigint,record:bigint,lines:array<string>,items:array<{_ITEM}>,body:string>>, "
    "keys array<string>, metadata string"
)


def slots(data: bytes) -> Iterator[tuple[int, int, str, int | None, bytes | None]]:
    """(x, z, status, mode, payload) of every slot; status: ok, absent or what is wrong.

    Files shorter than the header have no slots.  A chunk may end where the file
    ends; a payload is its length less the mode byte.
    """
    if len(data) < 2 * SECTOR:
        return
    for i, word in enumerate(struct.unpack(f">{SLOTS}I", data[:SECTOR])):
        z, x, at = i // 32, i % 32, (word >> 8) * SECTOR
        if not at:
            yield x, z, "absent", None, None
        elif at + 5 > len(data):
            yield x, z, "out of range", None, None
        else:
            size, mode = struct.unpack_from(">IB", data, at)
            if mode not in MODES:
                yield x, z, "unknown compression", mode, None
            elif size < 1 or at + 4 + size > len(data):
                yield x, z, "truncated", mode, None
            else:
                yield x, z, "ok", mode, data[at + 5 : at + 4 + size]


EXTENSIONS = (".mca", ".mcr")


def open_regions(spark: SparkSession, paths: Sequence[str] | str, most: int | None = None) -> DataFrame:
    """path, content of the region files under folders (not in folders below them) or of files named.

    ``.mca`` and ``.mcr`` count, in either case; others in a folder are left out,
    a file named itself with another extension raises.  ``most`` takes so many
    files only, the first by path.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    own = [paths] if isinstance(paths, str) else list(paths)
    for path in own:
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(conf)
        if not path.lower().endswith(EXTENSIONS) and fs.exists(at) and fs.getFileStatus(at).isFile():
            raise ValueError(f"no region file: {path}")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[mM][cC][aArR]").load(own)
    if most is not None:
        first = [r["path"] for r in files.select("path").orderBy("path").limit(most).collect()]
        files = files.where(F.col("path").isin(first))
    return files.select("path", "content")


def region_chunks(files: DataFrame, present_only: bool = False, wanted: Sequence[tuple[int, int]] | None = None) -> DataFrame:
    """One row for each slot of (path, content) rows, payloads still compressed."""
    pick = None if wanted is None else frozenset(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = [s for s in slots(raw.as_py() or b"") if (not present_only or s[2] != "absent") and (pick is None or s[:2] in pick)]
                for i in range(0, len(rows), 64):
                    x, z, status, mode, payload = zip(*rows[i : i + 64])
                    n = len(x)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * n), pa.array(x, pa.int32()), pa.array(z, pa.int32()), pa.array([s != "absent" for s in status]), pa.array(status), pa.array(mode, pa.int32()), pa.array(payload, pa.binary())],
                        names=["region_file", "local_x", "local_z", "present", "status", "compression", "payload"],
                    )

    return files.select("path", "content").mapInArrow(run, SLOT_SCHEMA)


def _int(v, default=None):
    return int(v) if isinstance(v, (int, float)) else default


def _item(d) -> dict | None:
    if not isinstance(d, dict):
        return None
    who = d.get("id")
    return {"id": None if who is None else str(who), "count": _int(d.get("Count"), 0), "damage": _int(d.get("Damage"), 0), "slot": _int(d.get("Slot"))}


def _json(d: dict) -> str:
    return json.dumps(d, sort_keys=True, ensure_ascii=False, default=lambda b: b.hex() if isinstance(b, bytes) else str(b))


def _dicts(v) -> list[dict]:
    return [d for d in v if isinstance(d, dict)] if isinstance(v, list) else []


def entity(d: dict) -> dict:
    pos = d.get("Pos")
    out = {"id": d.get("id") if isinstance(d.get("id"), str) else None, "pos": [float(p) for p in pos] if isinstance(pos, list) and len(pos) == 3 else None}
    return out | {"item": _item(d.get("Item")), "chested": bool(d.get("ChestedHorse", 0)), "saddle": _item(d.get("SaddleItem")), "armor": _item(d.get("ArmorItem")), "body": _json(d)}


def tile_entity(d: dict) -> dict:
    text = lambda k: d[k] if isinstance(d.get(k), str) else None
    mob = text("EntityId") if text("EntityId") is not None else text("EntityID")
    rest = {k: v for k, v in d.items() if k not in ("x", "y", "z")}
    return {
        "id": text("id"), "x": _int(d.get("x"), 0), "y": _int(d.get("y"), 0), "z": _int(d.get("z"), 0), "entity_id": mob, "custom_name": text("CustomName"), "command": text("Command"),
        "note": _int(d.get("note")), "record": _int(d.get("Record")), "lines": [text(f"Text{i}") or "" for i in range(1, 5)] if any(f"Text{i}" in d for i in range(1, 5)) else None,
        "items": [_item(i) for i in _dicts(d.get("Items"))] if "Items" in d else None, "body": _json(rest),
    }


def chunk_record(payload: bytes, compression: str) -> dict:
    """The fields of one chunk's bytes; raises NBTError if they are not a chunk's."""
    _, root = nbt.loads(payload, compression=compression)
    level = root.value.get("Level")
    if level is None or level.kind != nbt.COMPOUND:
        raise nbt.NBTError("Level compound is missing")
    d = nbt.plain(level)
    sections = []
    for s in _dicts(d.get("Sections")):
        if "Add" in s:
            raise nbt.NBTError("section with Add is not supported")
        if len(s.get("Blocks", b"")) != 4096 or len(s.get("Data", b"")) != 2048:
            raise nbt.NBTError("section of wrong size")
        sections.append({"y": _int(s.get("Y"), 0), "blocks": s["Blocks"], "data": s["Data"]})
    if isinstance(d.get("Blocks"), bytes):  # the older layout, one tall block: cut into sections of the newer one
        if len(d["Blocks"]) != 32768 or len(d.get("Data", b"")) != 16384:
            raise nbt.NBTError("chunk of wrong size")
        sections += legacy_sections(d["Blocks"], d["Data"])
    return {
        "x_pos": _int(d.get("xPos"), 0), "z_pos": _int(d.get("zPos"), 0), "last_update": _int(d.get("LastUpdate"), 0), "inhabited_time": _int(d.get("InhabitedTime"), 0),
        "populated": bool(d.get("TerrainPopulated", 0)), "sections": sections, "entities": [entity(e) for e in _dicts(d.get("Entities"))],
        "tile_entities": [tile_entity(e) for e in _dicts(d.get("TileEntities"))], "keys": list(d), "metadata": _json({k: v for k, v in d.items() if k not in BULK_KEYS}),
    }


def unpack_nibbles(data: np.ndarray, high_first: bool = False) -> np.ndarray:
    """Two values a byte, the low half first unless ``high_first``."""
    low, high = data & 15, data >> 4
    return np.stack([high, low] if high_first else [low, high], axis=-1).reshape(*data.shape[:-1], -1)


def pack_nibbles(values: np.ndarray) -> np.ndarray:
    return (values[..., 0::2] & 15 | (values[..., 1::2] & 15) << 4).astype(np.uint8)


def legacy_sections(blocks: bytes, data: bytes) -> list[dict]:
    """A 16 x 128 x 16 chunk in order x, z, y as eight sections in order y, z, x."""
    ids = np.frombuffer(blocks, np.uint8).reshape(16, 16, 128).transpose(2, 1, 0)
    low = unpack_nibbles(np.frombuffer(data, np.uint8).reshape(16, 16, 64)).transpose(2, 1, 0)
    return [{"y": y, "blocks": ids[16 * y : 16 * y + 16].tobytes(), "data": pack_nibbles(low[16 * y : 16 * y + 16].reshape(-1)).tobytes()} for y in range(8)]


def chunks(slots_of: DataFrame) -> DataFrame:
    """The chunk table of ``region_chunks`` rows; absent slots are left out.

    ``status`` is ok, or why a slot or its chunk cannot be read, with nulls in
    the other columns.
    """
    schema = T._parse_datatype_string(CHUNK_SCHEMA)
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                row = dict.fromkeys(kind.names) | {k: r[k] for k in ("region_file", "local_x", "local_z", "status")}
                if r["status"] == "ok":
                    try:
                        row |= chunk_record(r["payload"], MODES[r["compression"]])
                    except nbt.NBTError as e:
                        row["status"] = str(e)
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return slots_of.where("present").select("region_file", "local_x", "local_z", "status", "compression", "payload").mapInArrow(run, schema)


VOXEL_SCHEMA = "region_file string, chunk_x bigint, chunk_z bigint, x bigint, y bigint, z bigint, block_id bigint, block_data bigint"


def voxels(chunk_table: DataFrame, dense: bool = False, high_first: bool = False, ids: Sequence[int] | None = None) -> DataFrame:
    """One row for each cell of the chunks' sections; air (0, 0) is left out unless ``dense``.

    x and z are local to the chunk.  Sections that are missing give no rows.
    With ``ids`` only cells of those blocks leave the section's array.
    """
    wanted = None if ids is None else np.isin(np.arange(256), list(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, cx, cz, sections in zip(*[c.to_pylist() for c in batch.columns]):
                for s in sections or ():
                    ids = np.frombuffer(s["blocks"], np.uint8).astype(np.int64)
                    low = unpack_nibbles(np.frombuffer(s["data"], np.uint8), high_first).astype(np.int64)
                    i = np.arange(4096) if dense else np.flatnonzero(ids | low) if wanted is None else np.flatnonzero(wanted[ids])
                    if not len(i):
                        continue
                    n = len(i)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file] * n, pa.string()), *[pa.array(np.asarray(v, np.int64)) for v in (np.full(n, cx), np.full(n, cz), i & 15, (i >> 8) + 16 * s["y"], i >> 4 & 15, ids[i], low[i])]],
                        names=["region_file", "chunk_x", "chunk_z", "x", "y", "z", "block_id", "block_data"],
                    )

    return chunk_table.where("status = 'ok'").select("region_file", "x_pos", "z_pos", "sections").mapInArrow(run, VOXEL_SCHEMA)


def write_cells(chunk_table: DataFrame, changes: DataFrame) -> DataFrame:
    """The chunk table with cells of its sections written: (chunk_x, chunk_z, x, y, z, block_id, block_data), local x and z, y from 0 to 255.

    At most one row for each position.  Sections that a write needs are made;
    chunks that cannot be read, or are not there, take no writes.
    """
    cell = F.struct(*[F.col(c).cast("int").alias(c) for c in ("x", "y", "z", "block_id", "block_data")])
    own = changes.groupBy("chunk_x", "chunk_z").agg(F.collect_list(cell).alias("_writes"))  # a chunk has 65,536 cells at most
    joined = chunk_table.join(own, (F.col("x_pos") == F.col("chunk_x")) & (F.col("z_pos") == F.col("chunk_z")) & (F.col("status") == "ok"), "left")
    names = chunk_table.columns
    kind = pa.list_(pa.struct([("y", pa.int32()), ("blocks", pa.binary()), ("data", pa.binary())]))

    def written(sections: list[dict], writes: list[dict]) -> list[dict]:
        held = {s["y"]: (np.frombuffer(s["blocks"], np.uint8).copy(), unpack_nibbles(np.frombuffer(s["data"], np.uint8)).copy()) for s in sections}
        for w in writes:
            ids, low = held.setdefault(w["y"] >> 4, (np.zeros(4096, np.uint8), np.zeros(4096, np.uint8)))
            i = (w["y"] & 15) << 8 | w["z"] << 4 | w["x"]
            ids[i], low[i] = w["block_id"], w["block_data"] & 15
        return [{"y": y, "blocks": ids.tobytes(), "data": pack_nibbles(low).tobytes()} for y, (ids, low) in sorted(held.items())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [s if not w else written(s or [], w) for s, w in zip(batch.column("sections").to_pylist(), batch.column("_writes").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(new, kind) if n == "sections" else batch.column(n) for n in names], names=names)

    return joined.select(*names, "_writes").mapInArrow(run, chunk_table.schema)


def tile_entities(chunk_table: DataFrame) -> DataFrame:
    """One row for each tile entity, x and z made local to its chunk; position in the world in world_x, world_z."""
    rows = chunk_table.where("status = 'ok'").select("region_file", F.col("x_pos").alias("chunk_x"), F.col("z_pos").alias("chunk_z"), F.posexplode("tile_entities").alias("ordinal", "t"))
    rest = [f"t.{c}" for c in ("id", "entity_id", "custom_name", "command", "note", "record", "lines", "items", "body")]
    local = lambda a: (F.col(f"t.{a}") - 16 * F.col(f"chunk_{a}")).alias(a)
    return rows.select("region_file", "chunk_x", "chunk_z", "ordinal", local("x"), F.col("t.y").alias("y"), local("z"), F.col("t.x").alias("world_x"), F.col("t.z").alias("world_z"), *rest)


def entities(chunk_table: DataFrame) -> DataFrame:
    """One row for each entity with its place in the list and, of three numbers, its position."""
    rows = chunk_table.where("status = 'ok'").select("region_file", F.col("x_pos").alias("chunk_x"), F.col("z_pos").alias("chunk_z"), F.posexplode("entities").alias("ordinal", "e"))
    at = lambda i: F.try_element_at("e.pos", F.lit(i))
    thing = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.coalesce(F.col(f"{c}.id"), F.lit("")), F.lit(":"), F.col(f"{c}.damage").cast("string")))
    is_item, is_horse = F.col("e.id") == "Item", F.col("e.id") == "EntityHorse"
    stack = F.concat(F.col("e.item.count").cast("string"), F.lit(" x "), thing("e.item"))
    return rows.select(
        "region_file", "chunk_x", "chunk_z", "ordinal", F.col("e.id").alias("id"), at(1).alias("x"), at(2).alias("y"), at(3).alias("z"),
        F.when(is_item, stack).alias("item"), F.when(is_horse, F.col("e.chested")).alias("chested"), F.when(is_horse, thing("e.saddle")).alias("saddle"), F.when(is_horse, thing("e.armor")).alias("armor"), F.col("e.body").alias("body"),
    )


def unknown_keys(keys: Column, known: Sequence[str] = KNOWN_KEYS) -> Column:
    """Keys that are not among ``known``, in order without regard to case, joined by ", "; null if none."""
    rest = F.array_except(keys, F.array(*map(F.lit, known)))
    low = F.transform(F.array_sort(F.transform(rest, lambda k: F.struct(F.lower(k).alias("l"), k.alias("k")))), lambda s: s["k"])
    return F.when(F.size(rest) > 0, F.array_join(low, ", "))


def chunk_headers(chunk_table: DataFrame) -> DataFrame:
    """What a dump says of each chunk: coordinates, times, counts, unknown keys."""
    return chunk_table.select(
        "region_file", "local_x", "local_z", "status", "x_pos", "z_pos", (F.col("x_pos") * 16).alias("world_x"), (F.col("z_pos") * 16).alias("world_z"), "last_update", "inhabited_time", "populated",
        F.size("entities").alias("n_entities"), F.size("tile_entities").alias("n_tile_entities"), unknown_keys(F.col("keys")).alias("unknown_keys"),
    )


def short_number(c: Column) -> Column:
    """A number with six significant digits at most, as dumps have it: plain from 0.0001 to 999,999, else with an exponent."""
    rounded = F.format_string("%.5e", c.cast("double"))
    value = rounded.cast("double")
    plain = F.regexp_replace(F.format_string("%.9f", value), r"\.?0+$", "")
    small = (value != 0) & (F.abs(value) < 1e-4)
    return F.when((F.abs(value) >= 1e6) | small, F.regexp_replace(rounded, r"\.?0+e", "e")).otherwise(plain)


def _thing(c: Column) -> Column:
    return F.concat(F.coalesce(c["id"], F.lit("(null)")), F.lit(":"), c["damage"].cast("string"))


def _numbered_lines(things: Column, lines: Callable[[Column], list[Column]]) -> Column:
    """An array of lines: each thing's place, then its lines; those that are null are left out."""
    one = F.transform(things, lambda e, i: F.concat(F.array(F.concat(F.lit("    "), i.cast("string"), F.lit(":"))), F.filter(F.array(*lines(e)), F.isnotnull)))
    return F.flatten(one)


def dump_lines(chunk_table: DataFrame) -> DataFrame:
    """region_file, local_x, local_z, number, line: what a dump prints of each chunk, or why it cannot be read."""
    indent = lambda *parts: F.concat(F.lit("      "), *parts)
    text = lambda c: c.cast("string")
    at = lambda x, y, z: indent(F.lit("Coordinates: "), short_number(x), F.lit(", "), short_number(y), F.lit(", "), short_number(z))

    def of_entity(e: Column) -> list[Column]:
        item, horse, pos = e["id"] == "Item", e["id"] == "EntityHorse", e["pos"]
        stack = indent(text(F.coalesce(e["item"]["count"], F.lit(0))), F.lit(" x "), F.coalesce(_thing(e["item"]), F.lit("(null):0")))
        return [
            indent(F.lit("ID: "), F.coalesce(e["id"], F.lit("(null)"))), F.when(pos.isNotNull(), at(F.try_element_at(pos, F.lit(1)), F.try_element_at(pos, F.lit(2)), F.try_element_at(pos, F.lit(3)))), F.when(item, stack),
            F.when(horse & e["chested"], indent(F.lit("Chested: true"))), F.when(horse & e["saddle"].isNotNull(), indent(F.lit("Saddle: "), _thing(e["saddle"]))), F.when(horse & e["armor"].isNotNull(), indent(F.lit("Armor: "), _thing(e["armor"]))),
        ]

    def of_tile(e: Column) -> list[Column]:
        return [indent(F.lit("ID: "), F.coalesce(e["id"], F.lit("(null)"))), at(e["x"], e["y"], e["z"])]

    x, z = F.col("x_pos"), F.col("z_pos")
    unknown = unknown_keys(F.col("keys"))
    some = lambda c, word, lines: F.when(F.size(c) > 0, F.concat(F.array(F.concat(F.lit(f"  {word}: "), text(F.size(c)))), _numbered_lines(F.col(c), lines))).otherwise(F.array().cast("array<string>"))
    head = F.array(
        F.concat(F.lit("  Coordinates: "), text(x), F.lit(", "), text(z), F.lit(" ("), text(x * 16), F.lit(", "), text(z * 16), F.lit(")")),
        F.concat(F.lit("  LastUpdate: "), text(F.col("last_update"))), F.concat(F.lit("  InhabitedTime: "), text(F.col("inhabited_time"))),
    )
    word = F.when(F.contains(unknown, F.lit(", ")), "  Unknown keys: ").otherwise("  Unknown key: ")
    tail = F.filter(F.array(F.when(~F.col("populated"), "  Terrain unpopulated"), F.concat(word, unknown)), F.isnotnull)
    good = F.concat(head, some("entities", "Entities", of_entity), some("tile_entities", "TileEntities", of_tile), tail)
    lines = F.when(F.col("status") == "ok", good).otherwise(F.array(F.concat(F.lit("  ERROR PARSING CHUNK: "), F.col("status"))))
    return chunk_table.select("region_file", "local_x", "local_z", F.posexplode(lines).alias("number", "line"))


def find_blocks(chunk_table: DataFrame, ids: Sequence[int]) -> DataFrame:
    """Cells of the given ids with their world position and tile entity, if any.

    Sections without such a byte give no rows, so the join sees hits only.
    """
    hits = voxels(chunk_table, ids=ids)
    own = tile_entities(chunk_table).drop("ordinal", "world_x", "world_z")
    out = hits.join(own, ["region_file", "chunk_x", "chunk_z", "x", "y", "z"], "left")
    return out.withColumns({"world_x": F.col("x") + 16 * F.col("chunk_x"), "world_z": F.col("z") + 16 * F.col("chunk_z")})


def command_blocks(chunk_table: DataFrame) -> DataFrame:
    """World position, custom name and command of every command block."""
    return find_blocks(chunk_table, [137]).select("region_file", F.col("world_x").alias("x"), "y", F.col("world_z").alias("z"), "custom_name", "command")


def slot_table(slots_of: DataFrame, chunk_table: DataFrame) -> DataFrame:
    """region_file, present, populated for the counters of the statistics."""
    done = chunk_table.where("status = 'ok'").select("region_file", "local_x", "local_z", "populated", F.col("x_pos").alias("chunk_x"), F.col("z_pos").alias("chunk_z"))
    return slots_of.select("region_file", "local_x", "local_z", "present").join(done, ["region_file", "local_x", "local_z"], "left")
