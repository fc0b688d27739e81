"""Every query over the voxel view against its SQL, on the smallest tables."""

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from blockyard.functions import blocks, cells
from blockyard.plans import format_oracle, format_queries, oracle, queries

QUERIES = queries.QUERIES | format_queries.QUERIES
ORACLE_SQL = oracle.ORACLE_SQL | format_oracle.ORACLE_SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in ("lineitem", "part", "nation"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sql, name):
    df = QUERIES[name](spark, DATA)
    found = sql.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=key) == sorted(found.fetchall(), key=key)


def test_every_known_block_has_one_primary_class_and_a_weight():
    for i in blocks.NAMES:
        assert sum(i in blocks.CLASSES[k] for k in blocks.PRIMARY) == 1, i
    assert set(blocks.WEIGHTS) == set(range(blocks.LAST_ID + 1))


def test_turns_and_flips():
    for b, f in cells.FAMILY.items():
        for d in range(16):
            way = cells.facing(b, d)
            if way in ("north", "south", "east", "west") and cells.turned_to(b, d, way) == d:
                assert cells.rotate(b, cells.rotate(b, d, 1), 3) == d and cells.rotate(b, cells.rotate(b, d, 1), 1) == cells.rotate(b, d, 2)
                assert cells.flip(b, cells.flip(b, d, "ew"), "ew") == d
                assert cells.facing(b, cells.rotate(b, d, 1)) == cells.turn(way, 1)
    for rail in blocks.CLASSES["rail"]:
        for d in range(10 if rail == blocks.ID["rail"] else 6):
            assert cells.rotate(rail, cells.rotate(rail, d, 1), 3) == d


def test_rest_works_without_the_corpus_operators():
    code = "import sys; sys.modules['blockyard.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert set(q) == set(e.oracle_sql()) and q"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], check=True)
