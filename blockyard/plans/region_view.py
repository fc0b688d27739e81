"""The voxel view as the bytes of region files, so that SQL can check what readers make of them.

Chunk (x, z) of the view goes to slot (x, z) of its region; the absent one has
no slot.  Three more slots are broken: an unknown compression, a place outside
the file, and a length that goes past its end.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import nbt, region
from . import voxel_view as view

#: Slots (x, z) of every file that cannot be read: the offset word and what stands there.
BROKEN = {(10, 0): "unknown compression", (11, 0): "out of range", (12, 0): "truncated"}
#: Blocks of whose cells the view makes entities: items on rails, horses on tnt, zombies on bookshelves.
ITEM_AT, HORSE_AT, ZOMBIE_AT = 66, 46, 47


def _entities(cells: dict[str, np.ndarray]) -> list[dict]:
    out = []
    for b, d, x, y, z in zip(*[cells[k].tolist() for k in ("b", "d", "x", "y", "z")]):
        pos = [float(x), float(y), float(z)]
        if b == ITEM_AT:
            out.append({"id": "Item", "Pos": pos, "Item": {"id": nbt.Tag(nbt.SHORT, 256 + d), "Count": nbt.Tag(nbt.BYTE, y % 64), "Damage": nbt.Tag(nbt.SHORT, z)}})
        elif b == HORSE_AT:
            out.append({"id": "EntityHorse", "Pos": pos, "ChestedHorse": nbt.Tag(nbt.BYTE, d % 2), "SaddleItem": {"id": nbt.Tag(nbt.SHORT, 329), "Damage": nbt.Tag(nbt.SHORT, d)}})
        elif b == ZOMBIE_AT:
            out.append({"id": "Zombie", "Pos": pos})
    return out


def _tile_entities(tiles: list[dict], cells: dict[str, np.ndarray], x0: int, z0: int) -> list[dict]:
    out = []
    for t in tiles:
        own = {"id": t["id"], "x": x0 + t["x"], "y": t["y"], "z": z0 + t["z"]}
        if t["items"] is not None:
            own["Items"] = [{"id": i["id"], "Count": nbt.Tag(nbt.BYTE, i["count"]), "Damage": nbt.Tag(nbt.SHORT, 0), "Slot": nbt.Tag(nbt.BYTE, n)} for n, i in enumerate(t["items"])]
        if t["entity_id"] is not None:
            own["EntityID"] = t["entity_id"]
        out.append(own)
    for i in np.flatnonzero(cells["b"] == 137):
        x, y, z, d = (int(cells[k][i]) for k in "xyzd")
        out.append({"id": "Control", "x": x0 + x, "y": y, "z": z0 + z, "CustomName": "@", "Command": f"say {d}"})
    return out


def _payload(x: int, z: int, populated: bool, cells: dict[str, np.ndarray], tiles: list[dict], legacy: bool) -> bytes:
    level = {
        "xPos": x, "zPos": z, "LastUpdate": nbt.Tag(nbt.LONG, len(cells["b"])), "InhabitedTime": nbt.Tag(nbt.LONG, 10 * x + z), "TerrainPopulated": nbt.Tag(nbt.BYTE, int(populated)),
        "Entities": _entities(cells), "TileEntities": _tile_entities(tiles, cells, 16 * x, 16 * z),
    }
    if x == z:
        level |= {"zeta": 1, "Alpha": "a"}
    if legacy:
        ids, low = np.zeros((16, 16, 128), np.uint8), np.zeros((16, 16, 128), np.uint8)
        at = cells["x"], cells["z"], cells["y"]
        ids[at], low[at] = cells["b"], cells["d"]
        level |= {"Blocks": ids.tobytes(), "Data": region.pack_nibbles(low).tobytes()}
    else:
        ids, low = np.zeros((8, 16, 16, 16), np.uint8), np.zeros((8, 16, 16, 16), np.uint8)
        at = cells["y"] // 16, cells["y"] % 16, cells["z"], cells["x"]
        ids[at], low[at] = cells["b"], cells["d"]
        level["Sections"] = [{"Y": nbt.Tag(nbt.BYTE, y), "Blocks": ids[y].tobytes(), "Data": region.pack_nibbles(low[y].reshape(-1)).tobytes()} for y in range(8) if ids[y].any() or low[y].any()]
    return nbt.dumps("", {"Level": level}, compression="none")


def region_bytes(chunks: dict[tuple[int, int], bytes]) -> bytes:
    """A file of chunks by slot, packed by gzip and zlib in turns, and of the broken slots."""
    header, body = bytearray(2 * region.SECTOR), bytearray()

    def put(x: int, z: int, size: int, mode: int, data: bytes) -> None:
        struct.pack_into(">I", header, 4 * (32 * z + x), (2 + len(body) // region.SECTOR) << 8 | 1)
        body.extend(struct.pack(">IB", size, mode) + data)
        body.extend(bytes(-len(body) % region.SECTOR))

    for (x, z), raw in sorted(chunks.items()):
        mode = 1 + (x + z) % 2
        data = nbt.deflate(raw, region.MODES[mode])
        put(x, z, len(data) + 1, mode, data)
    put(10, 0, 1, 9, b"")
    struct.pack_into(">I", header, 4 * 11, 0xFFFFFF << 8 | 1)
    put(12, 0, 1 << 30, 2, b"")
    return bytes(header + body)


def files(spark: SparkSession, sf_dir: str, legacy: bool = False) -> DataFrame:
    """path, content of the view's regions.  A chunk's cells and a region's chunks are bounded, so each is one task's work."""
    cell = F.struct(F.col("x"), F.col("y"), F.col("z"), F.col("block_id").alias("b"), F.col("block_data").alias("d"))
    cells = view.voxels(spark, sf_dir).groupBy("chunk_x", "chunk_z").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    tile = F.struct("x", "y", "z", "id", "entity_id", F.array_sort("items").alias("items"))
    tiles = view.tile_entities(spark, sf_dir).groupBy("chunk_x", "chunk_z").agg(F.array_sort(F.collect_list(tile)).alias("tiles"))
    chunks = view.chunks(spark, sf_dir).where("present").join(cells, ["chunk_x", "chunk_z"], "left").join(tiles, ["chunk_x", "chunk_z"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = []
            held = batch.column("cells")
            for i, (x, z, good, tiles) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("chunk_x", "chunk_z", "populated", "tiles")])):
                flat = held[i].values
                own = {k: flat.field(k).to_numpy() if flat is not None else np.empty(0, np.int64) for k in "xyzbd"}
                raw.append(_payload(x, z, good, own, tiles or [], legacy))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("region_file", "chunk_x", "chunk_z")], pa.array(raw, pa.binary())], names=["region_file", "chunk_x", "chunk_z", "payload"])

    packed = chunks.select("region_file", "chunk_x", "chunk_z", "populated", "cells", "tiles").mapInArrow(run, "region_file string, chunk_x bigint, chunk_z bigint, payload binary")

    def whole(group: pa.Table) -> pa.Table:
        own = {(r["chunk_x"] % 32, r["chunk_z"] % 32): r["payload"] for r in group.to_pylist()}
        return pa.table({"path": [group.column("region_file")[0].as_py()], "content": pa.array([region_bytes(own)], pa.binary())})

    out = packed.groupBy("region_file").applyInArrow(whole, "path string, content binary")
    return out.withColumn("path", F.replace("path", F.lit(".mca"), F.lit(".mcr"))) if legacy else out
