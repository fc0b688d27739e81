"""Binary formats: round trips, damaged input, and what readers make of them."""

import gzip
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from blockyard.plans import format_queries, part_view, queries
from blockyard.sources import nbt, region, schematic


def big_document():
    t = nbt.Tag
    return t(nbt.COMPOUND, {
        "shortTest": t(nbt.SHORT, 32767), "longTest": t(nbt.LONG, 2**63 - 1), "floatTest": t(nbt.FLOAT, struct.unpack(">f", struct.pack(">f", 0.49823147))[0]),
        "stringTest": t(nbt.STRING, "HELLO WORLD THIS IS A TEST STRING ÅÄÖ!"), "intTest": t(nbt.INT, 2**31 - 1),
        "nested": t(nbt.COMPOUND, {"ham": t(nbt.COMPOUND, {"name": t(nbt.STRING, "Hampus"), "value": t(nbt.FLOAT, 0.75)})}),
        "longs": t(nbt.LIST, [t(nbt.LONG, i) for i in range(11, 16)], nbt.LONG), "byteTest": t(nbt.BYTE, 127),
        "compounds": t(nbt.LIST, [t(nbt.COMPOUND, {"created-on": t(nbt.LONG, 1264099775885)})] * 2, nbt.COMPOUND),
        "bytes": t(nbt.BYTES, bytes((n * n * 255 + n * 7) % 100 for n in range(1000))), "doubleTest": t(nbt.DOUBLE, 0.4931287132182315),
        "ints": t(nbt.INTS, [1, -2, 3]), "nothing": t(nbt.LIST, [], nbt.END),
    })


@pytest.mark.parametrize("how", ["none", "gzip", "zlib", "deflate"])
def test_nbt_round_trip_keeps_values_and_types(how):
    raw = nbt.dumps("Level", big_document(), compression=how)
    assert nbt.loads(raw, "Level", compression=how) == ("Level", big_document())
    assert nbt.dumps("Level", nbt.loads(raw, compression=how)[1], compression=how) == raw


def test_nbt_known_bytes():
    raw = bytes.fromhex("0a000b68656c6c6f20776f726c64080004") + b"name" + bytes.fromhex("0009") + b"Bananrama" + b"\0"
    name, root = nbt.loads(raw, "hello world", compression="none")
    assert nbt.plain(root) == {"name": "Bananrama"} and nbt.dumps(name, root, compression="none") == raw


def test_nbt_schema_and_errors():
    raw = nbt.dumps("a", {"n": 5, "s": "x"}, {"n": "short"}, compression="none")
    assert nbt.loads(raw, schema={"n": "long"}, compression="none")[1].value["n"] == nbt.Tag(nbt.SHORT, 5)
    with pytest.raises(nbt.NBTError, match="a.s"):
        nbt.loads(raw, schema={"s": "int"}, compression="none")
    for i in range(len(raw)):
        with pytest.raises(nbt.NBTError):
            nbt.loads(raw[:i], compression="none")
    with pytest.raises(nbt.NBTError):
        nbt.loads(raw, "b", compression="none")
    with pytest.raises(nbt.NBTError):
        nbt.dumps("", 5)
    assert nbt.loads(nbt.dumps("", 5, fragments=True), fragments=True)[1] == nbt.Tag(nbt.INT, 5)
    mixed = nbt.Tag(nbt.LIST, [nbt.Tag(nbt.INT, 1), nbt.Tag(nbt.STRING, "x")], nbt.INT)
    assert not nbt.is_valid({"l": mixed}) and not nbt.is_valid({"t": "x" * 65536}) and nbt.is_valid({"t": "x" * 65535, "l": []})
    with pytest.raises(nbt.NBTError):
        nbt.inflate(gzip.compress(b"x" * 1000)[:-9])


def test_node_table_round_trip(spark):
    raw = nbt.dumps("Level", big_document())
    files = spark.createDataFrame([("a", raw), ("b", nbt.dumps("", {"x": 1})), ("c", None), ("d", b"junk")], "path string, content binary")
    nodes = nbt.nodes(files, permissive=True)
    got = {r["doc"]: bytes(r["content"]) for r in nbt.encoded(nodes.where("doc in ('a', 'b')")).collect()}
    assert nbt.inflate(got["a"]) == nbt.inflate(raw)
    assert nodes.where("doc = 'd' and tag_type is null").count() == 1
    grown = nbt.insert_node(nodes.where("doc = 'a'"), "a", 0, "new", {"k": [1, 2]})
    grown = nbt.remove_node(grown, "a", nodes.where("doc = 'a' and name = 'nested'").first()["node_id"])
    ((_, content),) = nbt.encoded(grown).collect()
    d = nbt.plain(nbt.loads(bytes(content))[1])
    assert d["new"] == {"k": [1, 2]} and "nested" not in d and len(d) == 13
    lines = [r["line"] for r in nbt.tree_text(nodes.where("doc = 'b'")).orderBy("node_id").collect()]
    assert lines == ["compound : (1 entries)", "\tint x: 1"]


def test_removing_nodes_goes_by_the_tree_and_not_by_paths(spark):
    raw = nbt.dumps("", {"a": {"k": 1}, "a.b": 2, "a[0]": 3, "l": [{"x": 1}, {"x": 2}, {"x": 3}]})
    table = nbt.nodes(spark.createDataFrame([("d", raw), ("e", raw)], "path string, content binary"))
    number = {r["path"]: r["node_id"] for r in table.where("doc = 'd'").collect() if r["name"] == "a" or r["path"] == "root.l[0]"}
    left = nbt.remove_node(nbt.remove_node(table, "d", number["root.a"]), "d", number["root.l[0]"])
    rows = {(r["doc"], r["path"]): r for r in left.collect()}
    assert sorted(p for d, p in rows if d == "d") == ["root", "root.a.b", "root.a[0]", "root.l", "root.l[0]", "root.l[0].x", "root.l[1]", "root.l[1].x"]
    assert rows["d", "root"]["child_count"] == 3 and rows["d", "root.l"]["child_count"] == 2 and rows["e", "root.l"]["child_count"] == 3
    got = {r["doc"]: nbt.plain(nbt.loads(bytes(r["content"]))[1]) for r in nbt.encoded(left).collect()}
    assert got == {"d": {"a.b": 2, "a[0]": 3, "l": [{"x": 2}, {"x": 3}]}, "e": nbt.plain(nbt.loads(raw)[1])}
    with pytest.raises(nbt.NBTError):
        nbt.remove_node(table, "d", 0)


def test_own_codec_and_order_of_keys():
    codec = nbt.Codec(lambda b: b[::-1], lambda b: b[::-1])
    raw = nbt.dumps("r", {"b": 1, "A": 2, "c": {"z": 1, "Y": 2}}, compression=codec)
    name, root = nbt.loads(raw, compression=codec)
    assert raw == nbt.dumps("r", {"b": 1, "A": 2, "c": {"z": 1, "Y": 2}}, compression="none")[::-1]
    own = nbt.sorted_compounds(root).value
    assert name == "r" and list(own) == ["A", "b", "c"] and list(own["c"].value) == ["Y", "z"]


def chunk_bytes(x, z, cells, populated=1, **more):
    sections = {}
    for (cx, y, cz), (b, d) in cells.items():
        ids, low = sections.setdefault(y // 16, (np.zeros(4096, np.uint8), np.zeros(4096, np.uint8)))
        i = (y % 16) * 256 + cz * 16 + cx
        ids[i], low[i] = b, d
    level = {"xPos": x, "zPos": z, "LastUpdate": nbt.Tag(nbt.LONG, 9), "TerrainPopulated": nbt.Tag(nbt.BYTE, populated), "Sections": [{"Y": nbt.Tag(nbt.BYTE, y), "Blocks": ids.tobytes(), "Data": region.pack_nibbles(low).tobytes()} for y, (ids, low) in sections.items()]}
    return nbt.dumps("", {"Level": level | more}, compression="none")


def region_bytes(slots):
    """A region file from {(x, z): (mode, payload)}; a payload may be raw bytes of a broken slot."""
    header, body = bytearray(8192), bytearray()
    for (x, z), (mode, data) in slots.items():
        packed = gzip.compress(data) if mode == 1 else zlib.compress(data)
        struct.pack_into(">I", header, 4 * (z * 32 + x), (2 + len(body) // 4096) << 8 | 1)
        body += struct.pack(">IB", len(packed) + 1, mode) + packed
        body += bytes(-len(body) % 4096)
    return bytes(header), bytes(body)


CELLS = {(0, 0, 0): (7, 0), (15, 100, 15): (137, 3), (4, 20, 5): (54, 2), (5, 20, 5): (52, 0)}
TILES = [
    {"id": "Control", "x": 16 * 3 + 15, "y": 100, "z": -16 + 15, "CustomName": "@", "Command": "say hi"},
    {"id": "Chest", "x": 52, "y": 20, "z": -11, "Items": [{"id": 264, "Count": nbt.Tag(nbt.BYTE, 3), "Damage": nbt.Tag(nbt.SHORT, 0), "Slot": nbt.Tag(nbt.BYTE, 0)}]},
    {"id": "MobSpawner", "x": 53, "y": 20, "z": -11, "EntityID": "Zombie"},
]


@pytest.fixture(scope="module")
def regions(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("regions")
    entities = [{"id": "Item", "Pos": [1.0, 2.0, 3.0], "Item": {"id": "minecraft:egg", "Count": 2, "Damage": 5}}, {"id": "EntityHorse", "Pos": [1.0], "ChestedHorse": 1, "SaddleItem": {"id": 329, "Damage": 0}}]
    good = chunk_bytes(3, -1, CELLS, TileEntities=TILES, Entities=entities, zeta=1, Alpha=2)
    header, body = region_bytes({(3, 31): (2, good), (0, 0): (1, chunk_bytes(0, 0, {(1, 1, 1): (1, 0)}, populated=0)), (1, 0): (2, b"no chunk"), (2, 0): (3, b"x")})
    # the last slot ends with the file; another points behind it
    header = bytearray(header)
    struct.pack_into(">I", header, 4 * 40, 999999 << 8 | 1)
    (folder / "r.0.0.MCA").write_bytes(bytes(header) + body.rstrip(b"\0"))
    (folder / "short.mca").write_bytes(b"x" * 100)
    (folder / "other.txt").write_bytes(b"x")
    return region.region_chunks(region.open_regions(spark, str(folder)))


def test_region_slots_and_chunks(regions):
    assert regions.count() == 1024
    status = {(r["local_x"], r["local_z"]): r["status"] for r in regions.where("present").collect()}
    assert status == {(3, 31): "ok", (0, 0): "ok", (1, 0): "ok", (2, 0): "unknown compression", (8, 1): "out of range"}
    chunks = region.chunks(regions)
    heads = {(r["local_x"], r["local_z"]): r for r in region.chunk_headers(chunks).collect()}
    h = heads[3, 31]
    assert (h["x_pos"], h["world_z"], h["n_entities"], h["n_tile_entities"], h["unknown_keys"]) == (3, -16, 2, 3, "Alpha, zeta")
    assert heads[1, 0]["status"] != "ok"
    (row,) = region.slot_table(regions, chunks).groupBy().agg({"populated": "count"}).collect()
    assert row[0] == 2


def test_short_numbers(spark):
    want = {0.0: "0", 1.0: "1", -12.5: "-12.5", 100.0: "100", 123456.7: "123457", 1234567.0: "1.23457e+06", 0.0001: "0.0001", 0.00001234: "1.234e-05", 999999.5: "1e+06", 1 / 3: "0.333333", -2e10: "-2e+10"}
    assert all("%g" % k == v for k, v in want.items())
    got = spark.createDataFrame([(k,) for k in want], "c double").select("c", region.short_number(region.F.col("c")).alias("t")).collect()
    assert {r["c"]: r["t"] for r in got} == want


def test_region_voxels_finds_and_entities(regions):
    chunks = region.chunks(regions)
    lines = [r["line"] for r in region.dump_lines(chunks).where("local_x = 3").orderBy("number").collect()]
    assert lines[:2] == ["  Coordinates: 3, -1 (48, -16)", "  LastUpdate: 9"] and lines[-1] == "  Unknown keys: Alpha, zeta"
    assert lines[3:12] == ["  Entities: 2", "    0:", "      ID: Item", "      Coordinates: 1, 2, 3", "      2 x minecraft:egg:5", "    1:", "      ID: EntityHorse", "      Chested: true", "      Saddle: 329:0"]
    got = {(r["x"], r["y"], r["z"]): (r["block_id"], r["block_data"]) for r in region.voxels(chunks).where("chunk_x = 3").collect()}
    assert got == CELLS
    (c,) = region.command_blocks(chunks).collect()
    assert (c["x"], c["y"], c["z"], c["custom_name"], c["command"]) == (63, 100, -1, "@", "say hi")
    (chest,) = region.find_blocks(chunks, [54]).collect()
    assert chest["items"][0]["id"] == "264" and chest["items"][0]["count"] == 3
    mobs = [r["entity_id"] for r in region.find_blocks(chunks, [52]).collect()]
    assert mobs == ["Zombie"]
    item, horse = region.entities(chunks).orderBy("ordinal").collect()
    assert item["item"] == "2 x minecraft:egg:5" and (item["x"], item["z"]) == (1.0, 3.0)
    assert horse["chested"] and horse["saddle"] == "329:0" and horse["x"] is None
    assert region.region_chunks(regions.sparkSession.createDataFrame([], "path string, content binary")).count() == 0


def test_region_files_are_told_by_their_extension(regions, spark, tmp_path):
    (tmp_path / "r.0.0.txt").write_bytes(b"x")
    with pytest.raises(ValueError):
        region.open_regions(spark, str(tmp_path / "r.0.0.txt"))
    ids, low = np.zeros((16, 16, 128), np.uint8), np.zeros((16, 16, 128), np.uint8)  # x, z, y
    ids[3, 5, 100], low[3, 5, 100] = 54, 7
    chunk = nbt.dumps("", {"Level": {"xPos": 1, "zPos": 2, "TerrainPopulated": nbt.Tag(nbt.BYTE, 1), "Blocks": ids.tobytes(), "Data": region.pack_nibbles(low).tobytes()}}, compression="none")
    (tmp_path / "r.0.0.mcr").write_bytes(b"".join(region_bytes({(1, 2): (2, chunk)})))
    (tmp_path / "r.1.0.mca").write_bytes(b"".join(region_bytes({(0, 0): (1, chunk_bytes(32, 0, {(0, 0, 0): (1, 0)}))})))
    files = region.open_regions(spark, [str(tmp_path / "r.0.0.mcr"), str(tmp_path / "r.1.0.mca")])
    got = region.voxels(region.chunks(region.region_chunks(files))).select("chunk_x", "chunk_z", "x", "y", "z", "block_id", "block_data").collect()
    assert sorted(map(tuple, got)) == [(1, 2, 3, 100, 5, 54, 7), (32, 0, 0, 0, 0, 1, 0)]
    (one,) = region.open_regions(spark, str(tmp_path), most=1).select("path").collect()
    assert one["path"].endswith("r.0.0.mcr")


def test_legacy_chunk_matches_sections():
    rng = np.random.default_rng(3)
    ids, low = rng.integers(0, 256, (16, 16, 128), np.uint8), rng.integers(0, 16, (16, 16, 128), np.uint8)  # x, z, y
    got = region.legacy_sections(ids.tobytes(), region.pack_nibbles(low).tobytes())
    for x, y, z in rng.integers(0, [16, 128, 16], (200, 3)):
        s = got[y // 16]
        i = (y % 16) * 256 + z * 16 + x
        assert s["blocks"][i] == ids[x, z, y] and region.unpack_nibbles(np.frombuffer(s["data"], np.uint8))[i] == low[x, z, y]


def cells_of(rng, n=40):
    at = np.unique(rng.integers(0, [4, 5, 6], (n, 3)), axis=0)
    return {"x": at[:, 0], "y": at[:, 1], "z": at[:, 2], "block_id": rng.integers(1, 176, len(at)), "block_data": rng.integers(0, 16, len(at))}


def test_schematic_round_trip_and_ground():
    c = cells_of(np.random.default_rng(1))
    raw = schematic.write_schematic(c, [{"id": "Chest", "x": 1, "y": 2, "z": 3}], ground=2, size=(4, 5, 6))
    got, tiles, ground = schematic.read_schematic(raw)
    assert ground == 2 and tiles[0]["id"] == "Chest" and len(got["x"]) == 120
    seen = {p[:3]: p[3:] for p in zip(*[got[k].tolist() for k in ("x", "y", "z", "block_id", "block_data")])}
    for p in zip(*[c[k].tolist() for k in ("x", "y", "z", "block_id", "block_data")]):
        assert seen.pop(p[:3]) == p[3:]
    assert all(v == (1 if p[1] < 2 else 0, 0) for p, v in seen.items())
    for bad in (b"", b"junk", nbt.dumps("Schematic", {"Width": 9, "Length": 9, "Height": 9, "Blocks": b"x", "Data": b"x"})):
        with pytest.raises(schematic.FormatError):
            schematic.read_schematic(bad)


def test_circuit_round_trip():
    every = [(55, d) for d in range(16)] + [(t, d) for t in (75, 76) for d in range(1, 6)] + [(69, d) for d in (1, 2, 3, 4, 9, 12)] + [(77, 1), (77, 12), (72, 0), (72, 1), (4, 0)] + [(71, d) for d in range(16)]
    n = len(every)
    c = {"x": np.arange(n), "y": np.zeros(n, int), "z": np.ones(n, int), "block_id": np.array([b for b, _ in every]), "block_data": np.array([d for _, d in every])}
    got = schematic.read_circuit(schematic.write_circuit(c))
    here = got["z"] == 2  # the reader counts z from 1
    assert list(zip(got["block_id"][here].tolist(), got["block_data"][here].tolist())) == every
    ok = schematic.write_circuit(c)
    for bad in (b"", b"RedX" + ok[4:], ok[:4] + b"\2" + ok[5:], ok[:-1], ok[:5] + bytes(6) + ok[11:]):
        with pytest.raises(schematic.FormatError):
            schematic.read_circuit(bad)


def test_known_bytes_of_a_circuit_file():
    # height 1, width 2, length 1: a solid block and a lit wire of strength 9
    cells = {"x": np.array([0, 1]), "y": np.array([0, 0]), "z": np.array([0, 0]), "block_id": np.array([4, 55]), "block_data": np.array([0, 9])}
    raw = b"RedS\x01" + bytes.fromhex("0001 0002 0001") + bytes([schematic.FILLED, schematic.WIRE]) + bytes([0, 9])
    assert schematic.write_circuit(cells) == raw
    got = schematic.read_circuit(raw)
    assert [got[c].tolist() for c in ("x", "y", "z", "block_id", "block_data")] == [[0, 1], [0, 0], [1, 1], [4, 55], [0, 9]]


def test_known_bytes_of_a_schematic():
    def entry(kind, name, body):
        return bytes([kind]) + struct.pack(">H", len(name)) + name + body

    # order of cells: y, then z, then x
    ids, low = bytes([1, 2, 3, 4]), bytes([0, 1, 2, 3])
    body = entry(2, b"Width", struct.pack(">h", 1)) + entry(2, b"Length", struct.pack(">h", 2)) + entry(2, b"Height", struct.pack(">h", 2)) + entry(8, b"Materials", struct.pack(">H", 5) + b"Alpha")
    body += entry(7, b"Blocks", struct.pack(">i", 4) + ids) + entry(7, b"Data", struct.pack(">i", 4) + low) + entry(9, b"Entities", b"\x0a" + struct.pack(">i", 0)) + entry(9, b"TileEntities", b"\x0a" + struct.pack(">i", 0))
    raw = entry(10, b"Schematic", body + b"\0")
    got, _, ground = schematic.read_schematic(gzip.compress(raw))
    cells = dict(zip(zip(*[got[c].tolist() for c in "xyz"]), zip(got["block_id"].tolist(), got["block_data"].tolist())))
    assert cells == {(0, 0, 0): (1, 0), (0, 0, 1): (2, 1), (0, 1, 0): (3, 2), (0, 1, 1): (4, 3)} and ground is None
    assert nbt.inflate(schematic.write_schematic(got)) == raw


def test_big_document_by_the_bytes():
    # every kind of tag, laid out by hand
    text = "HELLO WORLD THIS IS A TEST STRING ÅÄÖ!".encode()
    name = lambda n: struct.pack(">H", len(n)) + n
    body = b"\x02" + name(b"shortTest") + struct.pack(">h", 32767) + b"\x04" + name(b"longTest") + struct.pack(">q", 2**63 - 1) + b"\x05" + name(b"floatTest") + struct.pack(">f", 0.49823147)
    body += b"\x08" + name(b"stringTest") + name(text) + b"\x03" + name(b"intTest") + struct.pack(">i", 2**31 - 1) + b"\x09" + name(b"listTest (long)") + b"\x04" + struct.pack(">i", 5) + struct.pack(">5q", 11, 12, 13, 14, 15)
    body += b"\x01" + name(b"byteTest") + b"\x7f" + b"\x06" + name(b"doubleTest") + struct.pack(">d", 0.4931287132182315) + b"\x0b" + name(b"ints") + struct.pack(">i2i", 2, 1, -2)
    raw = b"\x0a" + name(b"Level") + body + b"\0"
    root_name, root = nbt.loads(gzip.compress(raw))
    d = nbt.plain(root)
    assert (root_name, d["shortTest"], d["longTest"], d["intTest"], d["byteTest"], d["listTest (long)"], d["ints"]) == ("Level", 32767, 2**63 - 1, 2**31 - 1, 127, [11, 12, 13, 14, 15], [1, -2])
    assert d["stringTest"].encode() == text and abs(d["floatTest"] - 0.49823147) < 1e-7 and d["doubleTest"] == 0.4931287132182315
    assert nbt.dumps(root_name, root, compression="none") == raw


def test_files_are_written_whole(spark, tmp_path):
    rows = spark.createDataFrame([(f"f{i}", bytes([i]) * i) for i in range(5)], "name string, content binary")
    schematic.save(rows, str(tmp_path / "out"))
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == {f"f{i}": bytes([i]) * i for i in range(5)}


def test_encoding_does_not_call_python_for_each_document(spark):
    files = spark.createDataFrame([(f"d{i}", nbt.dumps("r", {"n": i, "l": [i / 2, 2.5] if i % 2 else [], "t": "x" * (i % 3), "b": b"ab"})) for i in range(300)], "path string, content binary")
    made = nbt.encoded(nbt.nodes(files).orderBy("node_id", "doc"))
    assert "FlatMapGroupsInArrow" not in made._jdf.queryExecution().toString()
    assert {r["doc"]: nbt.inflate(bytes(r["content"])) for r in made.collect()} == {r["path"]: nbt.inflate(bytes(r["content"])) for r in files.collect()}


class Batches:
    """A frame of these batches as far as ``nodes`` goes: mapInArrow gives what the function gives."""

    def __init__(self, *batches):
        self.batches = batches

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return list(run(iter(self.batches)))


def test_small_documents_share_a_batch_of_nodes(spark):
    raw = nbt.dumps("part", {"a": 1, "l": ["x", "y"], "t": "text"})
    files = [pa.RecordBatch.from_arrays([pa.array([f"{k}.{i}" for i in range(1500)]), pa.array([raw] * 1500, pa.binary())], names=["path", "content"]) for k in "ab"]
    out = nbt.nodes(Batches(*files))
    assert len(out) == 2 and max(b.num_rows for b in out) <= nbt.BATCH_ROWS
    rows = [r for b in out for r in b.to_pylist()]
    assert rows == [r for k in "ab" for i in range(1500) for r in nbt.node_rows(f"{k}.{i}", *nbt.loads(raw))]
    large = nbt.dumps("", {"t": nbt.Tag(nbt.BYTES, bytes(nbt.BATCH_BYTES))})
    assert len(nbt.nodes(Batches(pa.RecordBatch.from_arrays([pa.array(list("abc")), pa.array([large] * 3, pa.binary())], names=["path", "content"])))) == 3


def test_edits_take_one_job_each(spark):
    raw = nbt.dumps("", {"l": [{"x": i} for i in range(60)], "k": 1})
    table = nbt.nodes(spark.createDataFrame([("d", raw)], "path string, content binary"))
    first = table.where("path = 'root.l[0]'").first()["node_id"]
    spark.sparkContext.setJobGroup("edits", "edits")
    try:
        left = nbt.insert_node(nbt.remove_node(table, "d", first), "d", 0, "new", 7)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("edits")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 3  # one to remove, an aggregate's two stages to insert
    rows = {r["path"]: r for r in left.collect()}
    assert [rows[f"root.l[{i}].x"]["long_val"] for i in range(59)] == list(range(1, 60)) and "root.l[59]" not in rows and len(rows) == 59 * 2 + 4


@pytest.mark.parametrize("name", ["n6_coerced_trees", "n8_display_names", "k12_dump_lines", "k9_nbt_round_trip", "s19_inflated_sizes", "n9_validity"])
def test_documents_are_dealt_out_by_their_number(spark, monkeypatch, name):
    monkeypatch.setattr(part_view, "TASK_ROWS", 50)
    out = (queries.QUERIES | format_queries.QUERIES)[name](spark, "/root/testdata/sf0.001")
    assert re.search(r"Exchange hashpartitioning\(p_partkey#\d+L, 4\)", out._jdf.queryExecution().executedPlan().toString())


def test_one_document_is_picked_before_documents_are_made(spark):
    out = format_queries.n14_edited_tree(spark, "/root/testdata/sf0.001")
    assert "EqualTo(p_partkey,1)" in out._jdf.queryExecution().executedPlan().toString()
