"""Connected components, by one task and by steps, against brute force."""

import random

import pytest

from blockyard.llm import components


def brute(edges):
    least = {x: x for e in edges if None not in e for x in e}
    while True:
        before = dict(least)
        for u, v in edges:
            if u is not None and v is not None:
                least[u] = least[v] = min(least[u], least[v])
        if before == least:
            return {x: c for x, c in least.items() if any(x in e and e[0] != e[1] and None not in e for e in edges)}


@pytest.mark.parametrize("at_once", [components.EDGES, 0])
@pytest.mark.parametrize("kind, make", [("binary", lambda n: n.to_bytes(2, "big")), ("long", lambda n: n - 40), ("string", lambda n: f"é{n}" if n % 3 else str(n))])
def test_components_match_brute_force(spark, at_once, kind, make):
    rng = random.Random(3)
    edges = [(make(i), make(i + 1)) for i in range(200, 230)]  # a path
    edges += [tuple(make(rng.randrange(120)) for _ in "uv") for _ in range(60)] + [(make(7), None), (None, None), (make(300), make(300))]
    edges += edges[:5]
    got = components.components(spark.createDataFrame(edges, f"u {kind}, v {kind}"), at_once).collect()
    as_key = bytes if kind == "binary" else lambda x: x
    assert len(got) == len({as_key(r["node"]) for r in got})
    assert {as_key(r["node"]): as_key(r["component"]) for r in got} == brute(edges)


@pytest.mark.parametrize("at_once", [components.EDGES, 0])
def test_no_edges_give_no_rows(spark, at_once):
    assert components.components(spark.createDataFrame([(None, b"a")], "u binary, v binary"), at_once).collect() == []


def test_few_edges_are_one_table_and_one_task(spark, monkeypatch):
    made, write = [], components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, name: made.append(name) or write(df, name))
    edges = [(i, i + 1) for i in range(300)]
    out = components.components(spark.createDataFrame(edges, "u long, v long").repartition(7))
    assert {r["component"] for r in out.collect()} == {0} and len(made) == 1 and out.rdd.getNumPartitions() == 1
