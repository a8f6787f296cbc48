"""Containment labels: against walking the forest, with hot folders, deep chains and several parents."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.graph import PropertyGraph
from weftgraph.operators import containment
from weftgraph.schema import edge_columns, node_columns


def graph(spark, parents: dict[str, list[str]]) -> PropertyGraph:
    nodes = spark.createDataFrame([(x,) for x in parents], "id string").select(node_columns(node_id=F.col("id"), kind_label=F.lit("Class")))
    edges = spark.createDataFrame([(p, x) for x, ps in parents.items() for p in ps], "a string, b string").select(edge_columns(F.col("a"), F.col("b"), "CONTAINS"))
    return PropertyGraph(nodes, edges)


def brute(parents: dict[str, list[str]]) -> dict[str, tuple[int, int, int]]:
    """(depth, first, last) by a walk in the order of names."""
    best = {x: min(ps, key=lambda p: (p.startswith("Package:"), p)) if ps else None for x, ps in parents.items()}
    below, out, number = {}, {}, 0
    for x in sorted(best):
        below.setdefault(best[x], []).append(x)
    stack = [(x, 0, False) for x in reversed(below.get(None, []))]
    while stack:
        x, depth, done = stack.pop()
        if done:
            out[x] = (depth, out[x][1], number - 1)
            continue
        out[x] = (depth, number, None)
        number += 1
        stack.append((x, depth, True))
        stack += [(c, depth + 1, False) for c in reversed(below.get(x, []))]
    return out


def shapes():
    rng = random.Random(8)
    names = [f"n{k:04d}" for k in range(300)]
    yield {x: [names[rng.randrange(k)]] if k and rng.random() < 0.95 else [] for k, x in enumerate(names)}
    yield {x: [names[0]] if k else [] for k, x in enumerate(names)}  # one folder with all
    yield {x: [names[k - 1]] if k else [] for k, x in enumerate(names)}  # a chain
    two = {x: [names[rng.randrange(k)]] if k else [] for k, x in enumerate(names)}
    yield two | {"Package:p": []} | {x: [*two[x], "Package:p"] for x in names[50:90]} | {"Package:q": [], "only": ["Package:q"]}
    yield {"a": []}


@pytest.mark.parametrize("parents", list(shapes()), ids=["random", "folder", "chain", "packages", "one"])
def test_labels_and_ranges(spark, tmp_path, monkeypatch, parents):
    rows = containment.labels(graph(spark, parents))
    want = brute(parents)
    assert {r.node_id: (r.depth, r.first, r.last) for r in rows.collect()} == want
    stored = containment.write_labels(rows, f"file://{tmp_path}/labels")
    some = sorted(want)[::7]
    for few in (containment.FEW, 0):  # ranges in a filter, and the walk's order
        monkeypatch.setattr(containment, "FEW", few)
        for itself in (True, False):
            got = sorted(r.node_id for r in containment.inside(stored, spark.createDataFrame([(x,) for x in [*some, "none"]], "node_id string"), itself).collect())
            ends = [want[x][1:] for x in some]
            assert got == sorted(x for x, (_, first, _) in want.items() if any(a + (not itself) <= first <= b for a, b in ends))
    assert containment.inside(stored, spark.createDataFrame([("none",)], "node_id string")).count() == 0


def test_one_range_is_one_filter(spark, tmp_path):
    parents = {f"n{k:05d}": [f"n{(k - 1) // 20:05d}"] if k else [] for k in range(5000)}
    stored = containment.write_labels(containment.labels(graph(spark, parents)), f"file://{tmp_path}/labels")
    below = containment.inside(stored, spark.createDataFrame([("n00003",)], "node_id string"))
    plan = below._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(first" in plan and "LessThanOrEqual(first" in plan and "Join" not in plan and "Exchange" not in plan


def test_a_cycle_is_an_error(spark):
    with pytest.raises(ValueError):
        containment.labels(graph(spark, {"a": ["b"], "b": ["a"]}))
