"""Schematics and redstone circuit files: bytes to cells and back.

A schematic is a tagged compound with one byte of id and one of data for each
cell, in order y, z, x.  A circuit file has a short header and two planes of
bytes, type and state, in order y, x and z from the greatest down to 1.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions import blocks
from ..functions.blocks import ID
from . import nbt
from .region import _dicts, _int, tile_entity

ROOT, GROUND_KEY = "Schematic", "se.jens.ayton GroundLevel"
SCHEMA = {
    "Width": "short", "Length": "short", "Height": "short", "Materials": "string", "Blocks": "data", "Data": "data", GROUND_KEY: "short", "Entities": [{}], "TileEntities": [{}],
}
CELL_SCHEMA = "store string, x bigint, y bigint, z bigint, block_id bigint, block_data bigint"
Cells = dict[str, np.ndarray]

# Fixed values of the circuit format: cell types.
AIR, FILLED, WIRE, TORCH, LEVER, BUTTON, DOOR_BOTTOM, DOOR_TOP, PLATE, HOLE = 0, 1, 2, 3, 4, 5, 6, 7, 8, 11
# and bits of the state byte: what is switched on, and which way a cell faces.
LIVE, PLATE_LIVE = 0x10, 0x01
WEST, EAST, SOUTH, NORTH, FACING, STRENGTH = 0x20, 0x40, 0x60, 0x80, 0xE0, 0x0F
#: Data of torches, levers and buttons by the way they face; a door's by the opposite of what the file says.
_ATTACHED = {EAST: 1, WEST: 2, SOUTH: 3, NORTH: 4}
_DOOR = {EAST: 0, NORTH: 1, WEST: 2, SOUTH: 3}


class FormatError(ValueError):
    """Bytes that are no such file; says why."""


def _planes(shape: tuple[int, ...], x: int, y: int, z: int) -> list[np.ndarray]:
    """Index arrays x, y, z of a raster whose axes have the given numbers."""
    grid = np.indices(shape, dtype=np.int64).reshape(len(shape), -1)
    return [grid[x], grid[y], grid[z]]


def read_schematic(data: bytes) -> tuple[Cells, list[dict], int | None]:
    """All cells, tile entities and the ground level if the file has one; data keep their low four bits."""
    try:
        _, root = nbt.loads(data, ROOT, SCHEMA)
    except nbt.NBTError as e:
        raise FormatError(f"no schematic: {e}") from None
    d = nbt.plain(root)
    w, h, n = (_int(d.get(k), 0) for k in ("Width", "Height", "Length"))
    size = w * h * n
    ids, low = d.get("Blocks", b""), d.get("Data", b"")
    if len(ids) < size or len(low) < size:
        raise FormatError("planes are cut off")
    x, y, z = _planes((h, n, w), 2, 0, 1)
    cells = {"x": x, "y": y, "z": z, "block_id": np.frombuffer(ids, np.uint8)[:size].astype(np.int64), "block_data": (np.frombuffer(low, np.uint8)[:size] & 15).astype(np.int64)}
    return cells, [tile_entity(t) for t in _dicts(d.get("TileEntities"))], _int(d.get(GROUND_KEY))


def write_schematic(cells: Cells, tile_entities: Sequence[dict] = (), ground: int = 0, size: tuple[int, int, int] | None = None) -> bytes:
    """Bytes of cells whose least corner is the origin; missing ones are air, or stone below the ground.

    ``tile_entities`` are compounds with x, y and z.  Entities are always empty.
    """
    w, h, n = size or tuple(int(cells[c].max()) + 1 if len(cells[c]) else 0 for c in "xyz")
    if max(w, h, n) > 32767:
        raise FormatError("a side is over 32767")
    ids, low = np.zeros((h, n, w), np.uint8), np.zeros((h, n, w), np.uint8)
    ids[: max(0, min(h, ground))] = blocks.STONE
    ids[cells["y"], cells["z"], cells["x"]] = cells["block_id"]
    low[cells["y"], cells["z"], cells["x"]] = np.asarray(cells["block_data"]) & 15
    root = {"Width": w, "Length": n, "Height": h, "Materials": "Alpha", "Blocks": ids.tobytes(), "Data": low.tobytes(), "Entities": nbt.Tag(nbt.LIST, [], nbt.COMPOUND), "TileEntities": list(tile_entities) or nbt.Tag(nbt.LIST, [], nbt.COMPOUND)}
    if ground:
        root[GROUND_KEY] = ground
    return nbt.dumps(ROOT, root, SCHEMA)


def _circuit_cell(kind: int, state: int) -> tuple[int, int]:
    way, live = state & FACING, state & LIVE
    if kind == FILLED:
        return ID["cobblestone"], 0
    if kind in (DOOR_BOTTOM, DOOR_TOP):
        return ID["iron_door"], (8 if kind == DOOR_TOP else 0) | (4 if live else 0) | _DOOR.get(way, 0)
    if kind == WIRE:
        return ID["redstone_wire"], state & STRENGTH
    if kind == TORCH:
        return ID["redstone_torch_on" if live else "redstone_torch_off"], _ATTACHED.get(way, 5)
    if kind in (BUTTON, LEVER):
        return ID["stone_button" if kind == BUTTON else "lever"], _ATTACHED.get(way, 5) | (8 if live else 0)
    if kind == PLATE:
        return ID["wooden_pressure_plate"], state & PLATE_LIVE
    return blocks.AIR, 0


def _circuit_bytes(block: int, data: int) -> tuple[int, int]:
    attached = {v: k for k, v in _ATTACHED.items()} | {5: 0, 6: 0}
    if block in (ID["wooden_door"], ID["iron_door"]):
        way = {v: k for k, v in _DOOR.items()}[data & 3]
        return DOOR_TOP if data & 8 else DOOR_BOTTOM, (LIVE if data & 4 else 0) | way
    if block == ID["redstone_wire"]:
        return WIRE, data & STRENGTH
    if block in (ID["redstone_torch_on"], ID["redstone_torch_off"]):
        return TORCH, (LIVE if block == ID["redstone_torch_on"] else 0) | attached.get(data & 7, FACING)
    if block in (ID["lever"], ID["stone_button"]):
        return LEVER if block == ID["lever"] else BUTTON, (LIVE if data & 8 else 0) | attached.get(data & 7, FACING)
    if block in (ID["wooden_pressure_plate"], ID["stone_pressure_plate"]):
        return PLATE, PLATE_LIVE if data & 1 else 0
    return FILLED if block in blocks.CLASSES["opaque"] else AIR, 0


def read_circuit(data: bytes) -> Cells:
    """All cells of a circuit file; z runs from the length down to 1, as the format has it."""
    if len(data) < 11 or data[:4] != b"RedS":
        raise FormatError("no circuit file")
    if data[4] != 1:
        raise FormatError(f"unknown version {data[4]}")
    h, w, n = struct.unpack(">3H", data[5:11])
    size = h * w * n
    if not size:
        raise FormatError("empty document")
    if len(data) < 11 + 2 * size:
        raise FormatError("planes are cut off")
    kind, state = np.frombuffer(data, np.uint8, size, 11), np.frombuffer(data, np.uint8, size, 11 + size)
    code, at = np.unique(kind.astype(np.int64) << 8 | state, return_inverse=True)
    cell = np.array([_circuit_cell(int(c) >> 8, int(c) & 255) for c in code], dtype=np.int64)[at]
    x, y, z = _planes((h, w, n), 1, 0, 2)
    return {"x": x, "y": y, "z": n - z, "block_id": cell[:, 0], "block_data": cell[:, 1]}


def write_circuit(cells: Cells, size: tuple[int, int, int] | None = None) -> bytes:
    """Bytes of cells whose least corner is (0, 0, 0); missing ones are air."""
    w, h, n = size or tuple(int(cells[c].max()) + 1 if len(cells[c]) else 0 for c in "xyz")
    if max(w, h, n) > 65535:
        raise FormatError("a side is over 65535")
    kind, state = np.zeros((h, w, n), np.uint8), np.zeros((h, w, n), np.uint8)
    code, at = np.unique(np.asarray(cells["block_id"]) << 8 | np.asarray(cells["block_data"]), return_inverse=True)
    both = np.array([_circuit_bytes(int(c) >> 8, int(c) & 255) for c in code], dtype=np.uint8).reshape(-1, 2)[at]
    where = cells["y"], cells["x"], n - 1 - np.asarray(cells["z"])
    kind[where], state[where] = both[:, 0], both[:, 1]
    return b"RedS\1" + struct.pack(">3H", h, w, n) + kind.tobytes() + state.tobytes()


def read_any(name: str, data: bytes) -> tuple[Cells, list[dict], int | None]:
    """By the bytes: circuit files begin with their own mark, all else is a schematic."""
    return (read_circuit(data), [], None) if data[:4] == b"RedS" else read_schematic(data)


def stores(files: DataFrame, keep_air: bool = False) -> DataFrame:
    """store (the path), x, y, z, block_id, block_data of (path, content) rows; air only if ``keep_air``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                cells, _, _ = read_any(path, raw.as_py() or b"")
                i = np.arange(len(cells["x"])) if keep_air else np.flatnonzero(cells["block_id"] | cells["block_data"])
                for k in range(0, len(i), 65536):
                    part = i[k : k + 65536]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part), pa.string()), *[pa.array(cells[c][part]) for c in ("x", "y", "z", "block_id", "block_data")]], names=["store", "x", "y", "z", "block_id", "block_data"])

    return files.select("path", "content").mapInArrow(run, CELL_SCHEMA)


def open_stores(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """path, content of schematic and circuit files."""
    return spark.read.format("binaryFile").load(list([paths] if isinstance(paths, str) else paths)).select("path", "content")


def encoded(cells: DataFrame, kind: str = "schematic", ground: int = 0) -> DataFrame:
    """store, content: each store of a (store, x, y, z, block_id, block_data) frame as a file's bytes.

    Stores are moved so that their least corner is the origin.  A store is a
    file, so it is one task's work; the formats bound its sides.
    """
    if kind not in ("schematic", "circuit"):
        raise ValueError(f"unknown kind {kind!r}")

    def run(group: pa.Table) -> pa.Table:
        c = {k: group.column(k).to_numpy().astype(np.int64) for k in ("x", "y", "z", "block_id", "block_data")}
        low = int(c["y"].min())
        for k in "xyz":
            c[k] = c[k] - c[k].min()
        raw = write_circuit(c) if kind == "circuit" else write_schematic(c, ground=max(0, ground - low))
        return pa.table({"store": pa.array([group.column("store")[0].as_py()], pa.string()), "content": pa.array([raw], pa.binary())})

    return cells.select(F.col("store").cast("string").alias("store"), "x", "y", "z", "block_id", "block_data").groupBy("store").applyInArrow(run, "store string, content binary")


class _Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class _FileWriter(DataSourceWriter):
    """Writes each row's bytes beside its name and renames all of them once every task has ended well."""

    def __init__(self, folder: str):
        if "://" in folder and not folder.startswith("file://"):
            raise ValueError(f"{folder}: files are written to a mounted folder only")
        self.folder, self.run = folder.removeprefix("file://"), uuid.uuid4().hex

    def write(self, rows):
        import os

        done = []
        os.makedirs(self.folder, exist_ok=True)
        for name, content in rows:
            final = os.path.join(self.folder, os.path.basename(name))
            part = f"{final}.{uuid.uuid4().hex}.part"
            with open(part, "wb") as f:
                f.write(content)
            done.append((part, final))
        return _Written(done)

    def commit(self, messages):
        import os

        for m in messages:
            for part, final in m.files if m else ():
                os.replace(part, final)

    def abort(self, messages):
        import os

        for m in messages:
            for part, _ in m.files if m else ():
                if os.path.exists(part):
                    os.remove(part)


class BlobFiles(DataSource):
    """Sink ``blob_files``: (name, content) rows as files of a folder that all executors share."""

    @classmethod
    def name(cls) -> str:
        return "blob_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _FileWriter(self.options["path"])


def save(files: DataFrame, folder: str) -> None:
    """Write (name, content) rows as files."""
    files.sparkSession.dataSource.register(BlobFiles)
    files.select("name", "content").write.format("blob_files").mode("append").option("path", folder).save()
