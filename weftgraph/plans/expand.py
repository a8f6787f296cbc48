"""Bounded expansion over edges, the one operation that Catalyst has no node for.

spread  nodes by least number of hops from any of a set of seeds: a row per node and no path at all
reach   the same from each seed (a shortest walk repeats no edge, so this needs no paths)
nearest the least of the shortest paths that lead to each node
ways    how many paths lead to each node of an acyclic graph, summed level by level
trails  every walk that repeats no edge, with its nodes: for results that show depths, counts or paths
closure (ancestor, descendant) pairs of all nodes, without a bound

Steps meet the edges as they are: nodes, not edges, are made distinct, so that a small frontier is broadcast and no level shuffles
all edges. Expansion runs level by level over staged frontiers, so no level is computed twice; each level is anti-joined with
what is known, so cycles end. Levels already known are merged in pairs of like size, so a plan reads log2(depth)
tables and a row is written log2(depth) times. The first ``UNROLL`` levels of a bounded expansion are one plan.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.staging import staged, unstaged

UNROLL = 2  # levels that one plan may hold
MANY = 32  # levels whose sums one plan may hold


def _hops(edges: DataFrame, reverse: bool) -> DataFrame:
    a, b = ("dst", "src") if reverse else ("src", "dst")
    return edges.select(F.col(a).alias("_from"), F.col(b).alias("_to"), F.col("edge_id").alias("_edge"))


def trails_between(edges: DataFrame, a: DataFrame, b: DataFrame, most: int, wanted: int) -> DataFrame:
    """(nodes, depth) of trails from the one node of ``a`` to that of ``b``: all of the least length, of the next, and so on
    up to ``most`` hops, until ``wanted`` are found.

    A step goes only to nodes from which the goal can still be met in time, so little is made beyond the shortest paths.
    """
    left = spread(edges, b, most, reverse=True).unionByName(b.select("node", F.lit(0).alias("depth"))).groupBy("node").agg(F.min("depth").alias("left"))
    hops = edges.select(F.col("src").alias("_from"), F.col("dst").alias("node"), F.col("edge_id").alias("_edge")).join(left, "node")
    hops = staged(hops, "hops-ahead")
    out, have = [], 0
    for length in range(1, most + 1):
        at = a.select(F.col("node").alias("_at"), F.array("node").alias("nodes"), F.array().cast("array<bigint>").alias("edges"))
        for depth in range(1, length + 1):
            step = at.join(hops, at["_at"] == hops["_from"]).where((F.col("left") <= length - depth) & ~F.array_contains("edges", F.col("_edge")))
            at = step.select(F.col("node").alias("_at"), F.concat("nodes", F.array("node")).alias("nodes"), F.concat("edges", F.array("_edge")).alias("edges"))
            if depth % UNROLL == 0 and depth < length:
                at = staged(at, "trails")
                if at.isEmpty():
                    break
        found = staged(at.join(b.select(F.col("node").alias("_at")), "_at", "left_semi").select("nodes", F.lit(length).alias("depth")), "trails-found")
        out.append(found)
        have += found.count()
        if have >= wanted:
            break
    return reduce(DataFrame.unionByName, out)


def trails(edges: DataFrame, seeds: DataFrame, least: int, most: int, reverse: bool = False) -> DataFrame:
    """(start, node, depth, nodes, edges) of all trails of ``least`` to ``most`` hops from ``seeds`` (node).

    ``nodes`` leads from the start to the node. One row per trail.
    """
    hops = _hops(edges, reverse)
    at = staged(seeds.select(F.col("node").alias("start")).distinct(), "seeds")  # so that the planner knows how few they are, as it does of each level
    at = at.select("start", F.col("start").alias("node"), F.array("start").alias("nodes"), F.array().cast("array<bigint>").alias("edges"))
    levels = [at.withColumn("depth", F.lit(0))] if least == 0 else []
    for depth in range(1, most + 1):
        step = at.join(hops, at["node"] == hops["_from"]).where(~F.array_contains("edges", F.col("_edge")))
        at = step.select("start", F.col("_to").alias("node"), F.concat("nodes", F.array("_to")).alias("nodes"), F.concat("edges", F.array("_edge")).alias("edges"))
        if depth < most:
            at = staged(at, "trails")
            if at.isEmpty():
                break
        if depth >= least:
            levels.append(at.withColumn("depth", F.lit(depth)))
    if not levels:
        return at.withColumn("depth", F.lit(0)).limit(0).select("start", "node", "depth", "nodes", "edges")
    return reduce(DataFrame.unionByName, levels).select("start", "node", "depth", "nodes", "edges")


class _Known:
    """The levels so far, in staged tables of which each holds more levels than the next."""

    def __init__(self) -> None:
        self.tables: list[tuple[int, DataFrame]] = []

    def add(self, level: DataFrame) -> list[DataFrame]:
        """Takes a level in; returns the tables that it no longer needs."""
        count, table, old = 1, level, []
        while self.tables and self.tables[-1][0] <= count:
            more, before = self.tables.pop()
            merged = staged(before.unionByName(table), "known")
            old += [before, table]
            count, table = count + more, merged
        self.tables.append((count, table))
        return old

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, (t for _, t in self.tables))


def _levels(at: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str], most: int | None) -> DataFrame:
    """Rows of ``step(at)`` and so on, by the level that first has their ``keys``, until nothing new comes."""
    known, old, depth = _Known(), [], 0
    at = staged(at, "seeds")  # so that the planner knows how few they are
    while most is None or depth < most:
        depth += 1
        new = step(at)
        for _, table in known.tables:
            new = new.join(table.select(keys), keys, "left_anti")
        at = staged(new.withColumn("depth", F.lit(depth)), "frontier")
        unstaged(*old)  # among them the frontier that has just been left
        if at.isEmpty() and known.tables:
            break
        old = known.add(at)
        if at.isEmpty():
            break
    return known.all()


def reach(edges: DataFrame, seeds: DataFrame, most: int | None = None, reverse: bool = False) -> DataFrame:
    """(start, node, depth): nodes reached in 1 or more hops from each seed (node), with the least number of hops.

    A start that lies on a cycle is reached like any other node.
    """
    hops = _hops(edges, reverse).select("_from", "_to")
    first = seeds.select(F.col("node").alias("start")).distinct()
    at = first.select("start", F.col("start").alias("node"))
    step = lambda x: x.join(hops, x["node"] == hops["_from"]).select("start", F.col("_to").alias("node")).distinct()
    if most is not None and most <= UNROLL:
        levels = []
        for depth in range(1, most + 1):
            at = step(at)
            levels.append(at.withColumn("depth", F.lit(depth)))
        return reduce(DataFrame.unionByName, levels).groupBy("start", "node").agg(F.min("depth").alias("depth"))
    return _levels(at, step, ["start", "node"], most)


def spread(edges: DataFrame, seeds: DataFrame, most: int | None = None, reverse: bool = False) -> DataFrame:
    """(node, depth): nodes reached in 1 or more hops from any seed (node), with the least number of hops."""
    hops = _hops(edges, reverse).select("_from", "_to")
    step = lambda x: x.join(hops, x["node"] == hops["_from"]).select(F.col("_to").alias("node")).distinct()
    return _levels(seeds.select("node").distinct(), step, ["node"], most)


def nearest(edges: DataFrame, seed: DataFrame, most: int, name: Column, reverse: bool = False) -> DataFrame:
    """(node, path, depth): the shortest path from the one seed (node) to each node; of equally long ones that whose text is least.

    ``path`` joins ``name`` (of the column node) by ' > ', the far end first when ``reverse``, else last. Such a path is
    made of its neighbour's, so one is kept for each node. Forward, the text of the far end decides last.
    """
    hops = _hops(edges, reverse).select("_from", "_to")
    longer = F.concat(name, F.lit(" > "), "path") if reverse else F.concat("path", F.lit(" > "), name)

    def step(x: DataFrame) -> DataFrame:
        by = x.join(hops, x["node"] == hops["_from"]).groupBy(F.col("_to").alias("node")).agg(F.min("path").alias("path"))
        return by.select("node", longer.alias("path"))

    return _levels(seed.select("node", name.alias("path")), step, ["node"], most)


def ways(edges: DataFrame, seed: DataFrame, reverse: bool = False) -> DataFrame:
    """(node, paths): in how many ways each node is reached from the one seed (node); null beyond 64 bits.

    Of a graph with cycles, which hierarchies have not, walks of up to as many hops as there are nodes are counted
    (or of ``MANY`` hops, if that is more).
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    hops = edges.select(F.col(a).alias("_from"), F.col(b).alias("_to"))
    total = lambda rows: rows.groupBy("node").agg(F.try_sum("n").alias("n"))
    at, levels, depth, most = seed.select("node", F.lit(1).cast("bigint").alias("n")), [], 0, MANY
    while depth < most:
        depth += 1
        at = staged(total(at.join(hops, at["node"] == hops["_from"]).select(F.col("_to").alias("node"), "n")), "ways")
        if at.isEmpty():
            break
        levels.append(at)
        if len(levels) == MANY:
            levels = [staged(total(reduce(DataFrame.unionByName, levels)), "ways")]
        if depth == MANY:
            most = max(MANY, spread(edges, seed, None, reverse).count())
    return total(reduce(DataFrame.unionByName, levels or [at])).select("node", F.col("n").alias("paths"))


def closure(edges: DataFrame, zero: DataFrame | None = None) -> DataFrame:
    """(start, node, depth) of every node with an edge; with ``zero`` (node) also each of these to itself, at depth 0."""
    out = reach(edges, edges.select(F.col("src").alias("node")))
    if zero is None:
        return out
    own = zero.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth"))
    return own.unionByName(out).groupBy("start", "node").agg(F.min("depth").alias("depth"))
