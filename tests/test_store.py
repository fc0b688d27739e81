"""Stores: early stops, checks that raise, and the tables of the statistics as files."""

import itertools
import math
import re

import pytest
from pyspark.sql import functions as F

from blockyard.functions.extents import Box
from blockyard.operators import statistics, store, transforms
from blockyard.plans import voxel_view as view
from blockyard.plans import format_queries, queries

DATA = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame(rows, "x long, y long, z long, block_id long, block_data long")


def test_visits_stop_early(spark):
    s = frame(spark, [(0, 0, 0, 1, 0), (20, 0, 0, 1, 0), (0, 40, 0, 0, 0), (0, 50, 3, 2, 1)])
    seen = []
    assert store.visit_parts(s, lambda box: seen.append(box) is None) and [b.minY for b in seen] == [0, 0, 50]
    seen.clear()
    assert not store.visit_parts(s, lambda box: seen.append(box)) and len(seen) == 1 and seen[0] == Box(0, 0, 0, 0, 0, 0)


def test_tile_entities_that_do_not_fit_raise(spark):
    cells = frame(spark, [(0, 0, 0, 54, 0), (1, 0, 0, 1, 0)])
    none = spark.createDataFrame([], "x long, y long, z long, id string")
    good = spark.createDataFrame([(0, 0, 0, "Chest"), (1, 0, 0, "Anything")], "x long, y long, z long, id string")
    assert store.set_tile_entities(none, good, cells).count() == 2
    bad = spark.createDataFrame([(0, 0, 0, "Furnace")], "x long, y long, z long, id string")
    with pytest.raises(Exception, match="does not fit"):
        store.set_tile_entities(none, bad, cells).collect()


def test_union_with_an_empty_cuboid(spark):
    from blockyard.functions import extents

    a, none = Box(0, 1, 2, 3, 4, 5).column(), Box(0, -1, 0, -1, 0, -1).column()
    (r,) = spark.range(1).select(extents.union(a, none).alias("l"), extents.union(none, a).alias("r"), extents.union(none, none).alias("n"), extents.intersection(a, none).alias("i"), extents.within(none, a).alias("w"), extents.intersects(none, a).alias("m")).collect()
    assert tuple(r["l"]) == tuple(r["r"]) == (0, 1, 2, 3, 4, 5) and r["n"] is None and r["i"] is None and r["w"] is False and r["m"] is False


def test_bulk_write_of_nothing(spark):
    s = frame(spark, [(0, 0, 0, 1, 0)])
    after, change = store.bulk_write(s, [])
    assert after.collect() == s.collect() and change.collect() == []


def test_chain_measures_once_and_matches_single_steps(spark):
    s = frame(spark, [(3, 1, 7, 50, 1), (9, 2, 8, 54, 2), (4, 1, 7, 0, 0)])
    words = ["--rotr", "-x", "-m", "1", "2", "3", "rotl", "--rot180", "-y"]
    by_hand = transforms.flip_y(transforms.rotate_180(transforms.rotate_left(transforms.move(transforms.flip_x(transforms.rotate_right(s)), 1, 2, 3))))
    assert sorted(map(tuple, transforms.run_commands(s, words).collect())) == sorted(map(tuple, by_hand.collect()))
    for bad in (["--rotr", "nowhere"], ["move", "1", "2"], ["--in", "x"]):
        with pytest.raises(ValueError):
            transforms.run_commands(s, bad)
    assert transforms.run_commands(s, ["--in", "f", "-r"], load=lambda name: frame(spark, [(5, 5, 5, 1, 0)])).count() == 3


def test_the_statistics_job_writes_its_tables(spark, tmp_path):
    slots = view.chunks(spark, DATA)
    voxels, good = queries._populated(spark, DATA)
    tiles = view.tile_entities(spark, DATA).join(good, ["chunk_x", "chunk_z"], "left_semi")
    statistics.write_all(voxels, tiles, slots, str(tmp_path))
    read = lambda name: spark.read.csv(f"{tmp_path}/{name}", header=True, inferSchema=True)
    total = read("total")
    assert total.count() == 256 and total.columns == ["block_id", "name", "n"]
    chunks = good.count()
    assert total.agg(F.sum("n")).first()[0] == chunks * 32768
    layers = read("layers")
    assert layers.count() == 128 and layers.select(F.sum("0")).first()[0] == total.where("block_id = 0").first()["n"]
    both = read("adjacent").agg(F.sum("n")).first()[0] + read("nonadjacent").agg(F.sum("n")).first()[0]
    assert both == chunks * 14 * 14 * 60
    assert read("topmost").agg(F.sum("n")).first()[0] <= chunks * 256
    (summary,) = read("summary").collect()
    assert (summary["regions"], summary["chunks"], summary["blocks"]) == (2, chunks, chunks * 32768)
    assert read("spawners").count() == statistics.spawner_counts(tiles).count() and read("chests").count() == statistics.chest_counts(tiles).count()


@pytest.mark.parametrize("name", ["a4_enclosed_counts", "s12_tile_entities", "p13_entities", "p5_find_blocks", "p21_command_blocks", "n14_edited_tree", "k15_selection"])
def test_queries_have_something_to_show(spark, name):
    assert not (queries.QUERIES | format_queries.QUERIES)[name](spark, DATA).isEmpty()


def test_winners_are_found_by_hashing_and_nulls_and_signs_are_kept(spark, tmp_path):
    numbers = [None, -300, -1, 0, 1, 17, 130, 2**62]
    rows = [(o, p, s, line, float(q), "RAN"[q % 3]) for q, (o, p, s, line) in enumerate(itertools.product(numbers, (None, -1, 1, 17, 33), (None, -17, 1), (None, -1, 1, 5)))]
    spark.createDataFrame(rows + rows[::7], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = view._winners(spark, str(tmp_path))
    assert re.search(r" HashAggregate\(keys=\[_place", got._jdf.queryExecution().executedPlan().toString())
    best = {}
    low = lambda v: (v is not None, v or 0)
    rem = lambda v, n: None if v is None else int(math.fmod(v, n))
    for o, p, s, line, q, f in rows:
        at = (None if o is None else rem(math.floor(o / 128), 4), rem(line, 4), rem(p, 16), rem(o, 128), rem(s, 16))
        best[at] = max(best.get(at, ()), (low(o), low(line), low(p), low(s), int(q), f))
    assert {tuple(r[c] for c in view.POSITION): (*map(low, r["w"][:4]), *r["w"][4:]) for r in got.collect()} == best


def test_lines_are_not_shuffled_to_find_those_of_chests(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = view.tile_entities(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert re.search(r"BroadcastHashJoin \[o#\d+L\], \[o#\d+L\], LeftSemi", plan)
