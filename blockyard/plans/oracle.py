"""DuckDB SQL for the registered queries, written apart from the operators.

Cells that an operation changes, facings and descriptions are values that the
SQL takes from the library's tables: it checks how they are applied, and the
unit tests check the tables.
"""

from __future__ import annotations

from ..functions import blocks, cells, describe

_VIEW = """
w AS (SELECT (l_orderkey // 128) % 4 AS chunk_x, l_linenumber % 4 AS chunk_z, l_partkey % 16 AS x, l_orderkey % 128 AS y, l_suppkey % 16 AS z,
  l_orderkey AS o, l_linenumber AS l, l_partkey AS p, l_suppkey AS s, CAST(l_quantity AS BIGINT) AS q, l_returnflag AS f FROM lineitem),
v AS (SELECT CAST(chunk_x AS BIGINT) AS chunk_x, CAST(chunk_z AS BIGINT) AS chunk_z, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(z AS BIGINT) AS z,
  CAST((p * 7 + l) % 176 AS BIGINT) AS block_id, CAST(q % 16 AS BIGINT) AS block_data, o, f
  FROM (SELECT *, row_number() OVER (PARTITION BY chunk_x, chunk_z, x, y, z ORDER BY o DESC, l DESC, p DESC, s DESC, q DESC, f DESC) AS rn FROM w) WHERE rn = 1),
g AS (SELECT chunk_x * 16 + x AS x, y, chunk_z * 16 + z AS z, block_id, block_data FROM v)"""
_SLOTS = """
slot AS (SELECT 'r.' || (cx // 2) || '.mca' AS region_file, cx AS chunk_x, cz AS chunk_z, NOT (cx = 3 AND cz = 3) AS present,
  NOT ((cx = 3 AND cz = 3) OR (cx = 1 AND cz = 1) OR (cx = 2 AND cz = 3)) AS populated FROM range(4) a(cx), range(4) b(cz)),
pop AS (SELECT chunk_x, chunk_z FROM slot WHERE populated),
d AS (SELECT c.chunk_x, c.chunk_z, i.x, j.y, k.z, coalesce(v.block_id, 0) AS block_id
  FROM pop c CROSS JOIN range(16) i(x) CROSS JOIN range(128) j(y) CROSS JOIN range(16) k(z)
  LEFT JOIN v ON v.chunk_x = c.chunk_x AND v.chunk_z = c.chunk_z AND v.x = i.x AND v.y = j.y AND v.z = k.z)"""
_TILES = """
lines AS (SELECT l_orderkey AS o, l_partkey % 400 AS item, CAST(l_quantity AS BIGINT) AS c FROM lineitem),
te AS (SELECT chunk_x * 16 + x AS x, y, chunk_z * 16 + z AS z, block_id, o, CASE WHEN block_id = 54 THEN 'Chest' ELSE 'Monster Spawner' END AS id,
  CASE WHEN block_id = 52 THEN f END AS entity_id FROM v WHERE block_id IN (52, 54))"""
_PART = "part AS (SELECT * FROM g)"
_SMALL = "x BETWEEN 10 AND 25 AND y BETWEEN 30 AND 45 AND z BETWEEN 10 AND 25"


def _sql(body: str, *ctes: str) -> str:
    return "WITH " + ",".join([_VIEW, *ctes]) + "\n" + body


def _text(v: str | None) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


def _values(name: str, columns: str, rows) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else _text(v) for v in r) + ")" for r in rows) + ")"


_NAMES = _values("names", "id, name", sorted(blocks.NAMES.items()))
_ITEMS = _values("items", "id, name", sorted((blocks.NAMES | blocks.ITEMS).items()))


def _changes(name: str, operation: str) -> str:
    return _values(name, "b, d, n", [c for c in cells.changes(operation) if c[1] < 16])


def _turn(x: str, z: str, operation: str) -> str:
    body = f"""SELECT {x} AS x, p.y, {z} AS z, p.block_id, coalesce(t.n, p.block_data)::BIGINT AS block_data
FROM p CROSS JOIN e LEFT JOIN t ON t.b = p.block_id AND t.d = p.block_data"""
    return _sql(body, _PART, "p AS (SELECT * FROM part WHERE NOT (block_id = 0 AND block_data = 0))", "e AS (SELECT min(x) x0, max(x) x1, min(y) y0, min(z) z0, max(z) z1 FROM p)", _changes("t", operation))


_BACK_X, _BACK_Z = "e.x1 - (p.x - e.x0)", "e.z1 - (p.z - e.z0)"
_COUNT = "CAST(count(*) AS BIGINT) AS n"
_NEAR_AIR = """
filled AS (SELECT d.* REPLACE (CASE WHEN v.block_id IS NULL AND d.y < 30 THEN 1 ELSE d.block_id END AS block_id)
  FROM d LEFT JOIN v ON v.chunk_x = d.chunk_x AND v.chunk_z = d.chunk_z AND v.x = d.x AND v.y = d.y AND v.z = d.z),
air AS (SELECT DISTINCT chunk_x, chunk_z, x + dx AS x, y + dy AS y, z + dz AS z FROM filled,
  (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) o(dx, dy, dz) WHERE block_id = 0),
inner_cells AS (SELECT * FROM filled WHERE y < 60 AND x BETWEEN 1 AND 14 AND z BETWEEN 1 AND 14)"""
_EXPOSED = f"SELECT block_id, {_COUNT} FROM inner_cells {{}} JOIN air USING (chunk_x, chunk_z, x, y, z) GROUP BY 1"
_TORCH = """SELECT DISTINCT a.x, a.y, a.z, a.block_id FROM g a JOIN g b ON {}
WHERE b.block_id IN (75, 76) AND a.block_id IN ({})"""
_SOLID = ", ".join(str(i) for i in sorted((blocks.CLASSES["opaque"] | blocks.CLASSES["transparent"]) - {blocks.AIR}))
_EXTENT = "min({0}) {0}0, max({0}) {0}1"
_KINDS = ("opaque", "transparent", "liquid", "item", "tile_entity", "power_source", "power_sink", "vegetable", "ore", "rail", "piston", "stair")
_DETAILS = _values("details", "b, d, detail, way", describe.details())
_OVER = """
over AS (SELECT x + 12 AS x, y + 10 AS y, z + 3 AS z, block_id, block_data FROM g WHERE {small}),
o AS (SELECT x, y, z, CASE WHEN (x + y + z) % 5 = 0 OR (x + y + z) % 7 = 0 THEN 0 ELSE block_id END AS block_id,
  CASE WHEN (x + y + z) % 5 = 0 THEN 16 WHEN (x + y + z) % 7 = 0 THEN 0 ELSE block_data END AS block_data FROM over)""".replace("{small}", _SMALL)
_CHUNK_EXTENT = """SELECT chunk_x, chunk_z, min(x) AS "minX", max(x) AS "maxX", min(y) AS "minY", max(y) AS "maxY", min(z) AS "minZ", max(z) AS "maxZ",
  max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height, max(z) - min(z) + 1 AS length FROM v WHERE NOT (block_id = 0 AND block_data = 0) GROUP BY 1, 2"""
_GROUND = """, lay AS (SELECT v.chunk_x, v.chunk_z, y, sum(coalesce(w.w, 0)) AS s, count(*) AS n FROM v LEFT JOIN wt w ON w.id = v.block_id GROUP BY 1, 2, 3),
box AS (SELECT chunk_x, chunk_z, min(y) AS y0, max(y) AS y1, (max(x) - min(x) + 1) * (max(z) - min(z) + 1) AS area FROM v GROUP BY 1, 2),
ws AS (SELECT b.chunk_x, b.chunk_z, y0, r.i, coalesce(s, 0) + (area - coalesce(n, 0)) * -8 AS w
  FROM box b CROSS JOIN range(128) r(i) LEFT JOIN lay ON lay.chunk_x = b.chunk_x AND lay.chunk_z = b.chunk_z AND lay.y = b.y0 + r.i WHERE b.y0 + r.i <= b.y1),
f AS (SELECT chunk_x, chunk_z, y0, coalesce(min(CASE WHEN w < 0 THEN i END), count(*)) AS g0 FROM ws GROUP BY 1, 2, 3),
l AS (SELECT f.chunk_x, f.chunk_z, f.y0, f.g0, max(CASE WHEN ws.i < f.g0 AND ws.w >= 1 THEN ws.i END) AS i FROM f JOIN ws USING (chunk_x, chunk_z) GROUP BY 1, 2, 3, 4)
SELECT chunk_x, chunk_z, CAST(y0 + CASE WHEN g0 = 0 THEN 0 ELSE greatest(1, coalesce(i + 1, 1)) END AS BIGINT) AS ground_level FROM l"""
_LONG = """SELECT CASE WHEN name IS NULL THEN 'Unknown (ID ' || block_id || ')' WHEN extra IS NULL THEN name ELSE name || ' (' || extra || ')' END AS description, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT block_id, names.name, c.n, CASE WHEN block_id IN (63, 68) THEN concat_ws(', ', 'empty', 'facing ' || way) WHEN detail IS NULL THEN 'facing ' || way WHEN way IS NULL THEN detail ELSE detail || ', facing ' || way END AS extra
  FROM (SELECT block_id, block_data, count(*) AS n FROM v GROUP BY 1, 2) c LEFT JOIN names ON names.id = c.block_id LEFT JOIN details t ON t.b = c.block_id AND t.d = c.block_data) GROUP BY 1"""
_LAYERS = ", ".join(f'CAST(count(*) FILTER (WHERE d.block_id = {i}) AS BIGINT) AS "{i}"' for i in range(176))
_INTERSECT = """SELECT part, CASE WHEN ok THEN a0 END AS "i_minX", CASE WHEN ok THEN a1 END AS "i_maxX", CASE WHEN ok THEN b0 END AS "i_minY", CASE WHEN ok THEN b1 END AS "i_maxY", CASE WHEN ok THEN c0 END AS "i_minZ", CASE WHEN ok THEN c1 END AS "i_maxZ",
  least(x0, 10) AS "u_minX", greatest(x1, 25) AS "u_maxX", least(y0, 30) AS "u_minY", greatest(y1, 45) AS "u_maxY", least(z0, 10) AS "u_minZ", greatest(z1, 25) AS "u_maxZ"
FROM (SELECT *, a0 <= a1 AND b0 <= b1 AND c0 <= c1 AS ok FROM (
  SELECT *, greatest(x0, 10) a0, least(x1, 25) a1, greatest(y0, 30) b0, least(y1, 45) b1, greatest(z0, 10) c0, least(z1, 25) c1 FROM (
    SELECT y % 5 AS part, min(x) x0, max(x) x1, min(y) y0, max(y) y1, min(z) z0, max(z) z1 FROM g WHERE NOT (block_id = 0 AND block_data = 0) GROUP BY 1)))"""

ORACLE_SQL = {
    "a1_total_counts": _sql(f"SELECT block_id, {_COUNT} FROM d GROUP BY 1", _SLOTS),
    "a2_layer_counts": _sql(f"SELECT y, block_id, {_COUNT} FROM d GROUP BY 1, 2", _SLOTS),
    "a3_exposed_counts": _sql(_EXPOSED.format("SEMI"), _SLOTS, _NEAR_AIR),
    "a4_enclosed_counts": _sql(_EXPOSED.format("ANTI"), _SLOTS, _NEAR_AIR),
    "a5_topmost_counts": _sql(f"SELECT block_id, {_COUNT} FROM (SELECT arg_max(block_id, y) AS block_id FROM d WHERE block_id <> 0 GROUP BY chunk_x, chunk_z, x, z) GROUP BY 1", _SLOTS),
    "a6_topmost_terrain_counts": _sql(
        f"SELECT block_id, {_COUNT} FROM (SELECT arg_max(block_id, y) AS block_id FROM d WHERE block_id IN ({', '.join(map(str, sorted(blocks.CLASSES['opaque'] | blocks.CLASSES['liquid'])))}) GROUP BY chunk_x, chunk_z, x, z) GROUP BY 1",
        _SLOTS,
    ),
    "a7_spawner_counts": _sql(f"SELECT entity_id, {_COUNT} FROM te WHERE entity_id IS NOT NULL GROUP BY 1", _TILES),
    "a8_chest_counts": _sql(
        "SELECT item AS item_id, coalesce(any_value(name), 'unknown-' || item) AS name, CAST(sum(c) AS BIGINT) AS n FROM te JOIN lines USING (o) LEFT JOIN items ON items.id = item WHERE block_id = 54 GROUP BY item", _TILES, _ITEMS
    ),
    "a9_counters": _sql("SELECT count(DISTINCT region_file) AS regions, count(*) FILTER (WHERE populated) AS chunks, count(*) FILTER (WHERE present AND NOT populated) AS rejected, count(*) FILTER (WHERE NOT present) AS absent FROM slot", _SLOTS),
    "a10_merged_counts": _sql(f"SELECT block_id, {_COUNT} FROM v GROUP BY 1"),
    "a12_extents": _sql(_CHUNK_EXTENT),
    "a15_ground_level": "WITH " + _VIEW + ", " + _values("wt", "id, w", sorted(blocks.WEIGHTS.items())) + _GROUND,
    "a16_highest_type": _sql("SELECT max(block_id) AS highest FROM v"),
    "k1_all_types": _sql("SELECT r.block_id, name, coalesce(n, 0) AS n FROM range(256) r(block_id) LEFT JOIN (SELECT block_id, count(*) AS n FROM d GROUP BY 1) c USING (block_id) LEFT JOIN names ON names.id = r.block_id", _SLOTS, _NAMES),
    "k2_layer_matrix": _sql(f"SELECT layer, {_LAYERS} FROM range(128) r(layer) LEFT JOIN d ON d.y = r.layer GROUP BY 1", _SLOTS),
    "k4_summary": _sql(
        "SELECT regions, chunks, rejected, chunks * 32768 AS blocks, format('{:,}', chunks * 32768) AS blocks_text FROM (SELECT count(DISTINCT region_file) AS regions, count(*) FILTER (WHERE populated) AS chunks, count(*) FILTER (WHERE present AND NOT populated) AS rejected FROM slot)",
        _SLOTS,
    ),
    "p6_within_region": _sql(f"SELECT {_COUNT}, CAST(sum(block_id) AS BIGINT) AS ids FROM g WHERE x BETWEEN 8 AND 39 AND y BETWEEN 20 AND 59 AND z BETWEEN 8 AND 39"),
    "p18_tile_entity_fits": _sql(
        f"SELECT id, expected, id = expected AS fits, {_COUNT} FROM (SELECT id, CASE WHEN block_id = 54 AND y % 2 = 0 THEN 'Furnace' WHEN block_id = 54 THEN 'Chest' ELSE 'Monster Spawner' END AS expected FROM te) GROUP BY 1, 2, 3", _TILES
    ),
    "p20_non_empty": _sql(f"SELECT {_COUNT}, CAST(sum(y) AS BIGINT) AS ys FROM g WHERE NOT (block_data = 0 AND block_id = CASE WHEN y < 40 THEN 1 ELSE 0 END)"),
    "j1_cells_with_tile_entities": _sql(
        "SELECT part.*, te.id, entity_id, CASE WHEN te.id IS NOT NULL THEN coalesce(c.n, 0) END AS n_stacks FROM part LEFT JOIN te ON te.x = part.x AND te.y = part.y AND te.z = part.z LEFT JOIN (SELECT o, count(*) AS n FROM lines GROUP BY 1) c ON c.o = te.o AND te.block_id = 54",
        _PART,
        _TILES,
    ),
    "j2_named_counts": _sql("SELECT block_id, n, name FROM (SELECT block_id, count(*) AS n FROM v GROUP BY 1) LEFT JOIN names ON names.id = block_id", _NAMES),
    "j4_overlay": _sql(
        """SELECT * FROM part WHERE NOT (x BETWEEN 22 AND 37 AND y BETWEEN 40 AND 55 AND z BETWEEN 13 AND 28)
UNION ALL SELECT part.* FROM part JOIN o ON o.x = part.x AND o.y = part.y AND o.z = part.z WHERE o.block_data = 16
UNION ALL SELECT * FROM o WHERE block_data <> 16 AND NOT block_id = 0""",
        _PART,
        _OVER,
    ),
    "j5_copy_region": _sql(
        "SELECT * FROM dst ANTI JOIN src USING (x, y, z) UNION ALL SELECT * FROM src",
        "dst AS (SELECT * FROM g)",
        f"src AS (SELECT x - 10 AS x, y + 40 AS y, z - 10 AS z, block_id, block_data FROM g WHERE {_SMALL} AND block_id <> 0)",
    ),
    "j7_side_torches": _sql(_TORCH.format("a.y = b.y AND abs(a.x - b.x) + abs(a.z - b.z) = 1", _SOLID)),
    "j7_top_torches": _sql(_TORCH.format("a.x = b.x AND a.z = b.z AND b.y = a.y + 1", _SOLID)),
    "v1_read_cells": _sql(
        "SELECT i.x, j.y, k.z, coalesce(block_id, CASE WHEN j.y < 32 THEN 1 ELSE 0 END) AS block_id, coalesce(block_data, 0) AS block_data FROM range(8) i(x) CROSS JOIN range(64) j(y) CROSS JOIN range(8) k(z) LEFT JOIN g ON g.x = i.x AND g.y = j.y AND g.z = k.z"
    ),
    "v2_write_cells": _sql(
        f"SELECT * FROM g WHERE NOT (x BETWEEN 10 AND 25 AND y = 33 AND z = 12) UNION ALL SELECT x, 33, 12, x % 3, 0 FROM range(10, 26) r(x) WHERE x % 3 <> 0",
    ),
    "v3_keep_fitting": _sql("SELECT x, y, z, id FROM te WHERE NOT (y < 64 AND z < 32 AND x % 2 = 0 AND id <> 'Chest')", _TILES),
    "v5_fill": _sql(f"SELECT * FROM part WHERE NOT ({_SMALL}) UNION ALL SELECT x, y, z, 4, 2 FROM range(10, 26) i(x), range(30, 46) j(y), range(10, 26) k(z)", _PART),
    "v6_crop": _sql(f"SELECT * FROM g WHERE {_SMALL}"),
    "v11_changed_extents": _sql(
        """SELECT min(x) AS "minX", max(x) AS "maxX", min(y) AS "minY", max(y) AS "maxY", min(z) AS "minZ", max(z) AS "maxZ", count(*) AS n_changed
FROM range(10, 26) i(x) CROSS JOIN range(30, 46) j(y) CROSS JOIN range(10, 26) k(z) LEFT JOIN g USING (x, y, z) WHERE block_id IS DISTINCT FROM 1 OR block_data IS DISTINCT FROM 0"""
    ),
    "v13_densify": _sql(
        "SELECT x, y, z, coalesce(block_id, CASE WHEN y < 38 THEN 1 ELSE 0 END) AS block_id, coalesce(block_data, 0) AS block_data FROM range(10, 26) i(x) CROSS JOIN range(30, 46) j(y) CROSS JOIN range(10, 26) k(z) LEFT JOIN g USING (x, y, z)"
    ),
    "v18_float_and_settle": _sql(
        f"SELECT * FROM rest ANTI JOIN up USING (x, y, z) UNION ALL SELECT * FROM up", _PART, f"rest AS (SELECT * FROM part WHERE NOT ({_SMALL}))", f"up AS (SELECT x + 5 AS x, y + 7 AS y, z - 2 AS z, block_id, block_data FROM part WHERE {_SMALL} AND block_id <> 0)"
    ),
    "v19_layer_slice": _sql("SELECT * FROM g WHERE y = 40 AND x BETWEEN 4 AND 50 AND z BETWEEN 4 AND 50"),
    "g2_move": _sql("SELECT x - 3 AS x, y + 5 AS y, z + 4 AS z, block_id, block_data FROM part WHERE NOT (block_id = 0 AND block_data = 0)", _PART),
    "g3_flip_x": _turn("p.x", _BACK_Z, "flip_east_west"),
    "g4_flip_y": _turn(_BACK_X, "p.z", "flip_north_south"),
    "g5_rotate_180": _turn(_BACK_X, _BACK_Z, "rotate_180"),
    "g6_rotate_right": _turn(_BACK_Z, "p.x", "rotate_clockwise"),
    "g7_rotate_left": _turn("p.z", _BACK_X, "rotate_anticlockwise"),
    "g8_trim": _sql(
        "SELECT p.x - x0 AS x, p.y - y0 AS y, p.z - z0 AS z, block_id, block_data FROM p, e", _PART, "p AS (SELECT * FROM part WHERE NOT (block_id = 0 AND block_data = 0))", "e AS (SELECT min(x) x0, min(y) y0, min(z) z0 FROM p)"
    ),
    "g9_command_chain": _sql(
        """SELECT c.z1 - p.z AS x, p.y - y0 AS y, c.x1 - p.x AS z, p.block_id, coalesce(f.n, coalesce(t.n, p.block_data))::BIGINT AS block_data
FROM p CROSS JOIN c LEFT JOIN t ON t.b = p.block_id AND t.d = p.block_data LEFT JOIN f ON f.b = p.block_id AND f.d = coalesce(t.n, p.block_data)""",
        _PART,
        "p AS (SELECT * FROM part WHERE NOT (block_id = 0 AND block_data = 0))",
        "c AS (SELECT max(x) x1, min(y) y0, max(z) z1 FROM p)",
        _changes("t", "rotate_clockwise"),
        _changes("f", "flip_east_west"),
    ),
    "x6_facing_counts": _sql(f"SELECT way AS direction, {_COUNT} FROM v JOIN fc ON fc.b = block_id AND fc.d = block_data GROUP BY 1", _values("fc", "b, d, way", [(b, d, w) for b in sorted(cells.FAMILY) for d in range(16) if (w := cells.facing(b, d)) != "unknown"])),
    "x10_class_counts": _sql("SELECT " + ", ".join(f"count(*) FILTER (WHERE block_id IN ({', '.join(map(str, sorted(blocks.CLASSES[k])))})) AS {k}" for k in _KINDS) + ", count(*) FILTER (WHERE block_id = 0 AND (block_data & 16) = 0) AS air FROM v"),
    "x13_wire_power": _sql(f"SELECT block_data & 15 AS power, {_COUNT} FROM v WHERE block_id = 55 GROUP BY 1"),
    "t2_long_descriptions": _sql(_LONG, _NAMES, _DETAILS),
    "t6_spawner_texts": _sql(f"SELECT 'Mob spawner (' || entity_id || ')' AS description, {_COUNT} FROM te WHERE block_id = 52 GROUP BY 1", _TILES),
    "u2_extent_intersections": _sql(_INTERSECT),
    "k5_schematic_round_trip": _sql(
        "SELECT 'c' || chunk_x || '.' || chunk_z AS store, count(*) AS n, CAST(sum(block_id) AS BIGINT) AS ids, CAST(sum(block_data) AS BIGINT) AS data, max(y) - min(y0) AS top FROM (SELECT *, min(y) OVER (PARTITION BY chunk_x, chunk_z) AS y0 FROM v) WHERE NOT (block_id = 0 AND block_data = 0) GROUP BY 1"
    ),
    "k6_circuit_round_trip": _sql(
        f"""SELECT CAST(b AS BIGINT) AS block_id, {_COUNT} FROM (SELECT CASE WHEN block_id IN (64, 71) THEN 71 WHEN block_id IN (55, 75, 76, 69, 77) THEN block_id WHEN block_id IN (70, 72) THEN 72
WHEN block_id IN ({', '.join(map(str, sorted(blocks.CLASSES['opaque'])))}) THEN 4 END AS b FROM v) WHERE b IS NOT NULL GROUP BY 1"""
    ),
    "k9_nbt_round_trip": """SELECT path, type, count(*) AS n, CAST(sum(value) AS BIGINT) AS total FROM (
SELECT 'part' AS path, 'compound' AS type, 3 AS value FROM part UNION ALL SELECT 'part.p_name', 'string', length(p_name) FROM part
UNION ALL SELECT 'part.p_size', 'int', p_size FROM part UNION ALL SELECT 'part.p_retailprice', 'double', floor(p_retailprice) FROM part) GROUP BY 1, 2""",
}
