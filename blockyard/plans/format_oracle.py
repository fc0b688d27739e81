"""DuckDB SQL for the queries of ``format_queries``, written apart from the operators.

Directions, rails, mobs and cells' numbers are typed here by hand; names, classes
and weights of blocks are the library's tables, which unit tests check.
"""

from __future__ import annotations

from ..functions import blocks
from .oracle import _SLOTS, _TILES, _sql, _values

_OUTER = "x0 >= 0 AND x1 <= 40 AND y0 >= 0 AND y1 <= 90 AND z0 >= 0 AND z1 <= 40"
_CLIP = "x BETWEEN 5 AND 29 AND y BETWEEN 10 AND 41 AND z BETWEEN 3 AND 17"
_HERE = "SELECT * FROM v WHERE NOT (chunk_x = 3 AND chunk_z = 3)"
_FILES = """
files AS (SELECT 'r.' || f || '.mca' AS region_file, f, x AS local_x, z AS local_z FROM range(2) a(f), range(32) b(x), range(32) c(z)),
state AS (SELECT *, CASE WHEN local_x = 10 AND local_z = 0 THEN 'unknown compression' WHEN local_x = 11 AND local_z = 0 THEN 'out of range'
  WHEN local_x = 12 AND local_z = 0 THEN 'truncated' WHEN local_x // 2 = f AND local_x < 4 AND local_z < 4 AND NOT (local_x = 3 AND local_z = 3) THEN 'ok' ELSE 'absent' END AS status FROM files)"""
_BOXES = """
fifth AS (SELECT chunk_x, chunk_z, y // 26 AS part, min(x + 16 * chunk_x) x0, max(x + 16 * chunk_x) x1, min(y) y0, max(y) y1, min(z + 16 * chunk_z) z0, max(z + 16 * chunk_z) z1
  FROM v WHERE NOT (block_id = 0 AND block_data = 0) GROUP BY 1, 2, 3)"""
_TILE_ROWS = """
stack AS (SELECT o, count(*) AS n, sum(c) AS c FROM lines GROUP BY 1),
tiles AS (SELECT v.chunk_x, v.chunk_z, v.x, v.y, v.z, CASE WHEN block_id = 54 THEN 'Chest' WHEN block_id = 52 THEN 'Monster Spawner' ELSE 'Control' END AS id, CASE WHEN block_id = 52 THEN f END AS entity_id,
  CASE WHEN block_id = 137 THEN '@' END AS custom_name, CASE WHEN block_id = 137 THEN 'say ' || block_data END AS command,
  CASE WHEN block_id = 54 THEN stack.n END AS n_stacks, CASE WHEN block_id = 54 THEN CAST(stack.c AS BIGINT) END AS n_items, block_id, block_data
  FROM v LEFT JOIN stack ON stack.o = v.o AND v.block_id = 54 WHERE block_id IN (52, 54, 137) AND NOT (v.chunk_x = 3 AND v.chunk_z = 3))"""
# What each direction becomes: opposite, north-south, east-west, up-down, clockwise, anticlockwise.
_WAYS = [
    ("north", "south", "south", "north", "north", "east", "west"), ("south", "north", "north", "south", "south", "west", "east"), ("east", "west", "east", "west", "east", "south", "north"),
    ("west", "east", "west", "east", "west", "north", "south"), ("up", "down", "up", "up", "down", "up", "up"), ("down", "up", "down", "down", "up", "down", "down"), ("unknown",) * 7,
]
# Rail shapes: 0 north-south, 1 east-west, rising 2 east, 3 west, 4 north, 5 south, curves 6 south-east, 7 south-west, 8 north-west, 9 north-east.
# The east-west flip is that of the older axes, along z; north-south is along x.
_RAILS = [(0, 1, 1, 0, 0), (1, 0, 0, 1, 1), (2, 5, 4, 2, 3), (3, 4, 5, 3, 2), (4, 2, 3, 5, 4), (5, 3, 2, 4, 5), (6, 7, 9, 9, 7), (7, 8, 6, 8, 6), (8, 9, 7, 7, 9), (9, 6, 8, 6, 8)]
_MOBS = [
    ("CaveSpider", "cave spider"), ("Chicken", "chicken"), ("Cow", "cow"), ("Creeper", "creeper"), ("Enderman", "enderman"), ("Giant", "giant"), ("Pig", "pig"), ("PigZombie", "pig zombie"), ("Sheep", "sheep"),
    ("Silverfish", "silverfish"), ("Skeleton", "skeleton"), ("Slime", "slime"), ("Spider", "spider"), ("Squid", "squid"), ("Wolf", "wolf"), ("Zombie", "zombie"), ("Herobrine", "Herobrine"),
]
_TYPES = _values(
    "types", "block_id, name, is_solid, ground_weight, tile_entity",
    [(i, blocks.NAMES.get(i), int(i in blocks.CLASSES["opaque"] | blocks.CLASSES["transparent"] and i != 0), blocks.WEIGHTS.get(i, 0), blocks.TILE_ENTITIES.get(i)) for i in range(256)],
)
_BULK = """
b AS (SELECT x, y, z, CASE WHEN x BETWEEN 7 AND 8 AND y BETWEEN 7 AND 8 AND z BETWEEN 7 AND 8 AND {last} THEN 0 WHEN x >= 5 AND z >= 5 THEN 4 ELSE 3 END AS block_id, 1 AS block_data
  FROM range(15) i(x), range(5, 10) j(y), range(15) k(z) WHERE (x < 10 AND z < 10) OR (x >= 5 AND z >= 5))"""


def _big(*columns: str) -> str:
    return ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in columns)


def _steps() -> str:
    ways = [("north", 0, 0, -1), ("south", 0, 0, 1), ("east", 1, 0, 0), ("west", -1, 0, 0), ("up", 0, 1, 0), ("down", 0, -1, 0)]
    return _values("s", "way, dx, dy, dz", ways)


ORACLE_SQL = {
    "s3_slots": f"WITH {_FILES} SELECT region_file, local_x, local_z, status <> 'absent' AS present, status FROM state",
    "s6_chunk_status": f"WITH {_FILES} SELECT region_file, status, count(*) AS n FROM state WHERE status <> 'absent' GROUP BY 1, 2",
    "s9_chunk_headers": _sql(
        """SELECT region_file, s.chunk_x AS x_pos, s.chunk_z AS z_pos, 16 * s.chunk_x AS world_x, 16 * s.chunk_z AS world_z, coalesce(n, 0) AS last_update, 10 * s.chunk_x + s.chunk_z AS inhabited_time, populated,
  coalesce(e, 0) AS n_entities, coalesce(t, 0) AS n_tile_entities, CASE WHEN s.chunk_x = s.chunk_z THEN 'Alpha, zeta' END AS unknown_keys
FROM slot s LEFT JOIN (SELECT chunk_x, chunk_z, count(*) AS n, count(*) FILTER (WHERE block_id IN (46, 47, 66)) AS e, count(*) FILTER (WHERE block_id IN (52, 54, 137)) AS t FROM v GROUP BY 1, 2) c USING (chunk_x, chunk_z) WHERE present""",
        _SLOTS,
    ),
    "s10_section_cells": _sql(f"SELECT chunk_x, chunk_z, x, y, z, block_id, block_data FROM ({_HERE}) WHERE NOT (block_id = 0 AND block_data = 0)"),
    "v15_written_sections": _sql(
        f"""SELECT * FROM (SELECT chunk_x, chunk_z, x, y, z, block_id, block_data FROM ({_HERE}) ANTI JOIN l USING (chunk_x, chunk_z, x, y, z) UNION ALL SELECT * FROM l WHERE NOT (chunk_x = 3 AND chunk_z = 3))
WHERE NOT (block_id = 0 AND block_data = 0)""",
        "l AS (SELECT chunk_x, chunk_z, x, CASE WHEN z % 2 = 0 THEN 70 ELSE 200 END::BIGINT AS y, z, x % 3 AS block_id, z % 4 AS block_data FROM range(4) a(chunk_x), range(4) b(chunk_z), range(16) c(x), range(16) e(z))",
    ),
    "s7_legacy_cells": _sql(f"SELECT chunk_x, chunk_z, x, y, z, block_id, block_data FROM ({_HERE}) WHERE NOT (block_id = 0 AND block_data = 0)"),
    "s12_tile_entities": _sql("SELECT chunk_x, chunk_z, x, y, z, x + 16 * chunk_x AS world_x, z + 16 * chunk_z AS world_z, id, entity_id, custom_name, command, n_stacks, n_items FROM tiles", _TILES, _TILE_ROWS),
    "p13_entities": _sql(
        f"""SELECT chunk_x, chunk_z, CASE block_id WHEN 66 THEN 'Item' WHEN 46 THEN 'EntityHorse' ELSE 'Zombie' END AS id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z,
  CASE WHEN block_id = 66 THEN (y % 64) || ' x ' || (256 + block_data) || ':' || z END AS item, CASE WHEN block_id = 46 THEN block_data % 2 = 1 END AS chested,
  CASE WHEN block_id = 46 THEN '329:' || block_data END AS saddle, CAST(NULL AS VARCHAR) AS armor FROM ({_HERE}) WHERE block_id IN (46, 47, 66)"""
    ),
    "p5_find_blocks": _sql("SELECT x + 16 * chunk_x AS world_x, y, z + 16 * chunk_z AS world_z, block_id, block_data, id, entity_id FROM tiles WHERE block_id <> 137", _TILES, _TILE_ROWS),
    "p21_command_blocks": _sql("SELECT x + 16 * chunk_x AS x, y, z + 16 * chunk_z AS z, custom_name, command FROM tiles WHERE block_id = 137", _TILES, _TILE_ROWS),
    "k12_chunk_dumps": _sql(
        """SELECT region_file, line, count(*) AS n, CAST(min(number) AS BIGINT) AS first FROM (
  SELECT region_file, chunk_x, chunk_z, line, row_number() OVER (PARTITION BY region_file, chunk_x, chunk_z ORDER BY part, i, k) - 1 AS number FROM printed)
GROUP BY 1, 2""",
        _SLOTS,
        _TILES,
        _TILE_ROWS,
        """c AS (SELECT s.*, coalesce(n, 0) AS n FROM slot s LEFT JOIN (SELECT chunk_x, chunk_z, count(*) AS n FROM v GROUP BY 1, 2) USING (chunk_x, chunk_z) WHERE present)""",
        """e AS (SELECT *, row_number() OVER (PARTITION BY chunk_x, chunk_z ORDER BY x, y, z) - 1 AS i FROM v WHERE block_id IN (46, 47, 66) AND NOT (chunk_x = 3 AND chunk_z = 3))""",
        """t AS (SELECT *, row_number() OVER (PARTITION BY chunk_x, chunk_z ORDER BY block_id = 137, x, y, z) - 1 AS i FROM tiles)""",
        """printed AS (
  SELECT region_file, chunk_x, chunk_z, 0 AS part, 0 AS i, 0 AS k, '  Coordinates: ' || chunk_x || ', ' || chunk_z || ' (' || 16 * chunk_x || ', ' || 16 * chunk_z || ')' AS line FROM c
  UNION ALL SELECT region_file, chunk_x, chunk_z, 1, 0, 0, '  LastUpdate: ' || n FROM c UNION ALL SELECT region_file, chunk_x, chunk_z, 2, 0, 0, '  InhabitedTime: ' || (10 * chunk_x + chunk_z) FROM c
  UNION ALL SELECT any_value(region_file), chunk_x, chunk_z, 3, 0, 0, '  Entities: ' || count(*) FROM e JOIN c USING (chunk_x, chunk_z) GROUP BY chunk_x, chunk_z
  UNION ALL SELECT region_file, chunk_x, chunk_z, 4, i, 0, '    ' || i || ':' FROM e JOIN c USING (chunk_x, chunk_z)
  UNION ALL SELECT region_file, chunk_x, chunk_z, 4, i, 1, '      ID: ' || CASE block_id WHEN 66 THEN 'Item' WHEN 46 THEN 'EntityHorse' ELSE 'Zombie' END FROM e JOIN c USING (chunk_x, chunk_z)
  UNION ALL SELECT region_file, chunk_x, chunk_z, 4, i, 2, '      Coordinates: ' || x || ', ' || y || ', ' || z FROM e JOIN c USING (chunk_x, chunk_z)
  UNION ALL SELECT region_file, chunk_x, chunk_z, 4, i, 3, '      ' || (y % 64) || ' x ' || (256 + block_data) || ':' || z FROM e JOIN c USING (chunk_x, chunk_z) WHERE block_id = 66
  UNION ALL SELECT region_file, chunk_x, chunk_z, 4, i, 4, '      Chested: true' FROM e JOIN c USING (chunk_x, chunk_z) WHERE block_id = 46 AND block_data % 2 = 1
  UNION ALL SELECT region_file, chunk_x, chunk_z, 4, i, 5, '      Saddle: 329:' || block_data FROM e JOIN c USING (chunk_x, chunk_z) WHERE block_id = 46
  UNION ALL SELECT any_value(region_file), chunk_x, chunk_z, 5, 0, 0, '  TileEntities: ' || count(*) FROM t JOIN c USING (chunk_x, chunk_z) GROUP BY chunk_x, chunk_z
  UNION ALL SELECT region_file, chunk_x, chunk_z, 6, i, 0, '    ' || i || ':' FROM t JOIN c USING (chunk_x, chunk_z)
  UNION ALL SELECT region_file, chunk_x, chunk_z, 6, i, 1, '      ID: ' || id FROM t JOIN c USING (chunk_x, chunk_z)
  UNION ALL SELECT region_file, chunk_x, chunk_z, 6, i, 2, '      Coordinates: ' || (x + 16 * chunk_x) || ', ' || y || ', ' || (z + 16 * chunk_z) FROM t JOIN c USING (chunk_x, chunk_z)
  UNION ALL SELECT region_file, chunk_x, chunk_z, 7, 0, 0, '  Terrain unpopulated' FROM c WHERE NOT populated
  UNION ALL SELECT region_file, chunk_x, chunk_z, 8, 0, 0, '  Unknown keys: Alpha, zeta' FROM c WHERE chunk_x = chunk_z
  UNION ALL SELECT 'r.' || f || '.mca', x, -1, 0, 0, 0, '  ERROR PARSING CHUNK: ' || s FROM range(2) r(f), (VALUES (10, 'unknown compression'), (11, 'out of range'), (12, 'truncated')) b(x, s))""",
    ),
    "a9_file_counters": _sql("SELECT 2::BIGINT AS regions, count(*) FILTER (WHERE populated) AS chunks, count(*) FILTER (WHERE present AND NOT populated) AS rejected, (2 * 1024 - 6 - count(*) FILTER (WHERE present))::BIGINT AS absent FROM slot", _SLOTS),
    "s19_inflated_sizes": "SELECT h AS packing, count(*) AS n, CAST(sum(1 + 2 + 4 + 1 + 2 + 6 + 2 + strlen(p_name) + 1) AS BIGINT) AS bytes FROM part, (VALUES ('none'), ('gzip'), ('zlib'), ('deflate'), ('own')) w(h) GROUP BY 1",
    "k12_dump_lines": """SELECT CAST(p_partkey AS VARCHAR) AS doc, CAST(i AS BIGINT) AS node_id, CASE i WHEN 0 THEN 'compound part: (4 entries)' WHEN 1 THEN chr(9) || 'list a.b: (2 entries)' WHEN 2 THEN chr(9) || chr(9) || 'int: ' || p_size
  WHEN 3 THEN chr(9) || chr(9) || 'int: ' || (p_size + 1) WHEN 4 THEN chr(9) || 'string long text: "' || CASE WHEN length(p_name) * 9 > 100 THEN repeat(p_name, 9)[:95] || '...' ELSE repeat(p_name, 9) END || '"'
  WHEN 5 THEN chr(9) || 'string name: "' || p_name || '"' ELSE chr(9) || 'int Size: ' || p_size END AS line FROM part, range(7) r(i)""",
    "n8_display_names": """SELECT path, display_name, editable, number, items, n FROM (SELECT count(*) AS n FROM part), (VALUES ('part', 'part', true, false, NULL), ('part.name', 'name', true, false, NULL), ('part.Size', 'Size', true, true, NULL),
  ('part.a.b', 'a.b', true, false, 'int'), ('part.a.b[0]', '0', false, true, NULL), ('part.a.b[1]', '1', false, true, NULL), ('part.long text', 'long text', true, false, NULL)) w(path, display_name, editable, number, items)""",
    "n6_coerced_trees": """SELECT path, type, count(*) AS n, sum(v) AS total FROM (SELECT 'part' AS path, 'compound' AS type, CAST(NULL AS DOUBLE) AS v FROM part UNION ALL SELECT 'part.Size', 'long', p_size FROM part
UNION ALL SELECT 'part.a.b', 'list', NULL FROM part UNION ALL SELECT 'part.a.b[0]', 'double', p_size FROM part UNION ALL SELECT 'part.a.b[1]', 'double', p_size + 1 FROM part) GROUP BY 1, 2""",
    "n9_validity": "SELECT CAST(p_size AS BIGINT) AS p_size, p_size % 3 = 2 AS valid, count(*) AS n FROM part GROUP BY 1, 2",
    "n14_edited_tree": """SELECT path, type, CAST(ordinal AS BIGINT) AS ordinal, CAST(child_count AS BIGINT) AS child_count, CASE path WHEN 'part.Size' THEN p_size WHEN 'part.a.b[0]' THEN p_size + 1 WHEN 'part.new.k' THEN 7 END::BIGINT AS long_val FROM part,
  (VALUES ('part', 'compound', 0, 4), ('part.Size', 'int', 0, 0), ('part.a.b', 'list', 1, 1), ('part.a.b[0]', 'int', 0, 0), ('part.long text', 'string', 2, 0), ('part.new', 'compound', 3, 1), ('part.new.k', 'int', 0, 0)) w(path, type, ordinal, child_count) WHERE p_partkey = 1""",
    "n2_mapped_values": _sql("SELECT chunk_x, chunk_z, f AS entity_id, 2 * count(*) AS n FROM v WHERE block_id = 52 GROUP BY 1, 2, 3"),
    "p7_extent_predicates": _sql(
        f"""SELECT chunk_x, chunk_z, part, {_OUTER} AS within, meets, 20 BETWEEN x0 AND x1 AND 30 BETWEEN y0 AND y1 AND 10 BETWEEN z0 AND z1 AS holds, x0 = 0 AND x1 = 40 AND y0 = 0 AND y1 = 90 AND z0 = 0 AND z1 = 40 AS equal, NOT meets AS apart_is_empty
FROM (SELECT *, x0 <= 29 AND x1 >= 5 AND y0 <= 41 AND y1 >= 10 AND z0 <= 17 AND z1 >= 3 AS meets FROM fifth)""",
        _BOXES,
    ),
    "g12_corners": _sql("SELECT chunk_x, chunk_z, part, x0 + 3 AS low_x, y0 - 2 AS low_y, z0 + part AS low_z, x1 + 3 AS high_x, y1 - 2 AS high_y, z1 + part AS high_z, x1 - x0 + 1 AS width, 456::BIGINT AS size_at FROM fifth", _BOXES),
    "g11_steps": _sql("SELECT way, x + dx AS x, y + dy AS y, z + dz AS z FROM g, s WHERE block_id = 50", _steps()),
    "x8_directions": "WITH " + _values("w", "way, opposite, north_south, east_west, up_down, clockwise, anticlockwise", _WAYS) + " SELECT * FROM w",
    "x9_rails": "WITH " + _values("w", "shape, clockwise, anticlockwise, east_west, north_south", _RAILS) + f" SELECT {_big('shape', 'clockwise', 'anticlockwise', 'east_west', 'north_south')} FROM w",
    "x16_cell_numbers": _sql(
        "SELECT block_id, block_data, block_id + 256 * block_data AS hash, format('{{ ID: {}, data: 0x{:X} }}', block_id, block_data) AS text, block_data < 8 AS same, true AS no_tile_entity FROM (SELECT DISTINCT block_id, block_data FROM v)"
    ),
    "x11_solid_and_wire": f"WITH {_TYPES} SELECT {_big('block_id', 'ground_weight')}, name, is_solid = 1 AS is_solid, tile_entity FROM types",
    "v4_set_tile_entities": _sql("SELECT x, y, z, id FROM te WHERE y % 2 <> 0 OR x % 2 = 0", _TILES),
    "v10_bulk_write": _sql("SELECT g.* FROM g ANTI JOIN b USING (x, y, z) UNION ALL SELECT * FROM b", _BULK.format(last="true")),
    "v10_bulk_change": _sql(
        """SELECT min(x) AS "minX", max(x) AS "maxX", min(y) AS "minY", max(y) AS "maxY", min(z) AS "minZ", max(z) AS "maxZ", count(*) AS n_changed FROM b LEFT JOIN g USING (x, y, z)
WHERE g.block_id IS DISTINCT FROM b.block_id OR g.block_data IS DISTINCT FROM b.block_data""",
        _BULK.format(last="false"),
    ),
    "v7_parts": _sql(
        f"""SELECT x // 16 AS px, y // 16 AS py, z // 16 AS pz, min(x) AS "minX", max(x) AS "maxX", min(y) AS "minY", max(y) AS "maxY", min(z) AS "minZ", max(z) AS "maxZ", count(*) AS n
FROM g WHERE {_CLIP} AND NOT (block_id = 0 AND block_data = 0) GROUP BY 1, 2, 3"""
    ),
    "v17_clamped_layers": _sql("SELECT y, greatest(least(7 * y - 300, 148), -118) AS sparse, greatest(least(7 * y - 300, 255), 0) AS anvil, greatest(least(7 * y - 300, 127), 0) AS legacy FROM (SELECT DISTINCT y FROM g)"),
    "v21_scribble": 'SELECT true AS few, true AS many, true AS inside, true AS "distinct"',
    "v16_cells": _sql("SELECT CAST(p.x AS BIGINT) AS x, CAST(p.y AS BIGINT) AS y, CAST(p.z AS BIGINT) AS z, coalesce(block_id, CASE WHEN p.y < 20 THEN 1 ELSE 0 END) AS block_id, coalesce(block_data, 0) AS block_data FROM p LEFT JOIN g USING (x, y, z)", _values("p", "x, y, z", [(0, 0, 0), (3, 50, 7), (100, 10, 0), (100, 30, 0)])),
    "v18_centred": _sql(
        "SELECT rest.* FROM rest ANTI JOIN up USING (x, y, z) UNION ALL SELECT * FROM up",
        f"rest AS (SELECT * FROM g WHERE NOT ({_CLIP}))",
        f"e AS (SELECT 30 - min(x) - (max(x) - min(x) + 1) // 2 AS dx, 40 - min(y) - (max(y) - min(y) + 1) // 2 AS dy, 30 - min(z) - (max(z) - min(z) + 1) // 2 AS dz FROM g WHERE {_CLIP} AND NOT (block_id = 0 AND block_data = 0))",
        f"up AS (SELECT x + dx AS x, y + dy AS y, z + dz AS z, block_id, block_data FROM g, e WHERE {_CLIP} AND block_id <> 0)",
    ),
    "j5_legacy_copy": _sql("SELECT g.* FROM g ANTI JOIN up USING (x, y, z) UNION ALL SELECT * FROM up", f"up AS (SELECT x - 10 AS x, y - 10 AS y, z - 3 AS z, block_id, block_data FROM g WHERE {_CLIP} AND block_id <> 0)"),
    "g1_load_over": _sql(
        "SELECT g.* FROM g ANTI JOIN up USING (x, y, z) UNION ALL SELECT * FROM up",
        f"e AS (SELECT min(x) AS x0, min(y) AS y0, min(z) AS z0 FROM g WHERE {_CLIP} AND NOT (block_id = 0 AND block_data = 0))",
        f"up AS (SELECT x - x0 AS x, y - y0 AS y, z - z0 AS z, block_id, block_data FROM g, e WHERE {_CLIP} AND block_id <> 0)",
    ),
    "k15_selection": _sql(
        f"SELECT x - min(x) OVER () AS x, y - min(y) OVER () AS y, z - min(z) OVER () AS z, block_id, block_data FROM g WHERE {_CLIP} QUALIFY NOT (block_id = 0 AND block_data = 0)"
    ),
    "t5_sign_texts": """SELECT n_nationkey, 'Sign post (' || text || ')' AS description, text FROM (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'empty'
  WHEN n_nationkey % 2 = 0 THEN '“' || n_name || ' / ' || n_nationkey || '”' ELSE '“' || n_name || '”' END AS text FROM nation)""",
    "t6_mob_names": "WITH " + _values("w", "mob, name", _MOBS) + " SELECT * FROM w",
    "k3_written_tables": _sql(
        """SELECT 'total' AS name, 256::BIGINT AS rows, (SELECT count(*) FROM d)::BIGINT AS total UNION ALL SELECT 'layers', 128, (SELECT count(*) FROM d)
UNION ALL SELECT 'adjacent', 256, (SELECT count(*) FROM deep SEMI JOIN air0 USING (chunk_x, chunk_z, x, y, z)) UNION ALL SELECT 'nonadjacent', 256, (SELECT count(*) FROM deep ANTI JOIN air0 USING (chunk_x, chunk_z, x, y, z))
UNION ALL SELECT 'topmost', 256, (SELECT count(*) FROM (SELECT DISTINCT chunk_x, chunk_z, x, z FROM d WHERE block_id <> 0))
UNION ALL SELECT 'spawners', count(DISTINCT f), count(*) FROM here WHERE block_id = 52
UNION ALL SELECT 'chests', count(DISTINCT item), CAST(sum(c) AS BIGINT) FROM here JOIN lines USING (o) WHERE block_id = 54""",
        _SLOTS,
        _TILES,
        "here AS (SELECT v.* FROM v SEMI JOIN pop USING (chunk_x, chunk_z))",
        "air0 AS (SELECT DISTINCT chunk_x, chunk_z, x + dx AS x, y + dy AS y, z + dz AS z FROM d, (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) o(dx, dy, dz) WHERE block_id = 0)",
        "deep AS (SELECT * FROM d WHERE y < 60 AND x BETWEEN 1 AND 14 AND z BETWEEN 1 AND 14)",
    ),
}
