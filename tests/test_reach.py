"""Strong components, cycles, closures and deep trees beside a brute-force version."""

import random

import pytest
from pyspark.sql import functions as F

from opsframe.operators import graph, reach
from opsframe.plans import storage


def brute(pairs):
    """Nodes that each node leads to."""
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set())
    met = {}
    for root in out:
        seen, todo = set(), [root]
        while todo:
            for n in out[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        met[root] = seen
    return met


def parts(pairs):
    met = brute(pairs)
    return {n: min([m for m in met if n in met[m] and m in met[n]] + [n]) for n in met}


def graphs():
    rng = random.Random(3)
    yield "loose", [(rng.randrange(60), rng.randrange(60)) for _ in range(70)]
    yield "dense", [(rng.randrange(40), rng.randrange(40)) for _ in range(200)]
    yield "rings", [(k, (k + 1) % 9) for k in range(9)] + [(20 + k, 20 + (k + 1) % 4) for k in range(4)] + [(3, 20), (50, 3), (22, 60), (60, 61)]
    yield "ring with tails", [(k, (k + 1) % 5) for k in range(5)] + [(10, 2), (11, 10), (4, 12), (12, 13), (13, 3), (7, 7), (7, 8)]
    yield "chain with ways back", [(k, k + 1) for k in range(80)] + [(k, k - 5) for k in range(10, 80, 17)]
    both = [(a, b) for a in range(8) for b in range(8) if a != b and (a + 2 * b) % 5]
    yield "two kernels", both + [(a + 20, b + 20) for a, b in both] + [(1, 21), (2, 22), (1, 22), (3, 23)]
    yield "none", []


@pytest.mark.parametrize("name, pairs", list(graphs()), ids=[n for n, _ in graphs()])
def test_components(spark, name, pairs):
    df = spark.createDataFrame([*pairs, *pairs[:2], (None, 1), (2, None)], "a long, b long")
    assert {r["node"]: r["component"] for r in reach.strong_components(df, "a", "b").collect()} == parts(pairs)


@pytest.mark.parametrize("pairs", [dict(graphs())["dense"][:60], dict(graphs())["ring with tails"]])
def test_cycles_and_closure(spark, pairs):
    df = spark.createDataFrame([*pairs, *pairs[:2], (None, 1), (2, None)], "a long, b long")
    want = parts(pairs)
    cyclic = {(r["a"], r["b"]) for r in reach.cyclic_edges(df, "a", "b").collect()}
    assert cyclic == {(a, b) for a, b in pairs if want[a] == want[b]}
    met = brute(pairs)
    assert {(r["root"], r["node"]) for r in reach.closure(df, "a", "b").collect()} == {(a, b) for a in met for b in met[a]}


def counted(monkeypatch):
    """The number of written rounds so far."""
    seen, plain = [], storage.write_step
    monkeypatch.setattr(storage, "write_step", lambda df, name="step": seen.append(name) or plain(df, name))
    return seen


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    seen = counted(monkeypatch)
    chain = spark.range(10_000).selectExpr("id AS a", "id + 1 AS b")
    assert reach.strong_components(chain, "a", "b").where("node != component").count() == 0
    assert len(seen) <= 20
    seen.clear()
    ring = chain.unionByName(spark.createDataFrame([(9_000, 1_000), (50, 40)], "a long, b long"))
    sizes = reach.strong_components(ring, "a", "b").groupBy("component").count().where("count > 1").collect()
    assert sorted((r["component"], r["count"]) for r in sizes) == [(40, 11), (1_000, 8_001)]
    assert seen.count("chain") <= 40


def test_deep_tree_nests_in_few_rounds(spark, monkeypatch):
    levels = spark.range(5_000).select(
        F.lit(0).cast("long").alias("root"), (F.col("id") + 1).cast("int").alias("level"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    seen = counted(monkeypatch)
    rows = graph.nest(levels, "a", "b").where("node IN (1, 2, 4999, 5000)").collect()
    assert seen.count("tree") <= 13
    assert {r["node"]: (r["parent"], len(r["path"])) for r in rows} == {1: (0, 2), 2: (1, 3), 4999: (4998, 5000), 5000: (4999, 5001)}
    assert all(r["path"] == [str(k) for k in range(r["node"] + 1)] for r in rows)


def test_hub_with_a_third_of_the_edges(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("a"), (F.col("id") + 1).alias("b"))
    pairs = [(r["a"], r["b"]) for r in rows.collect()]
    got = {r["node"]: r["component"] for r in reach.strong_components(rows, "a", "b").collect()}
    assert got == parts(pairs)
