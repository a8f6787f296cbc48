"""What staging leaves to the session."""

from __future__ import annotations

import re

from weftgraph.plans.staging import BROADCAST, staged


def test_broadcasts_are_bounded(spark):
    """A table of 10 compressed MB of names is some 100 MB in the driver."""
    staged(spark.range(3), "small")
    assert int(spark.conf.get(BROADCAST).rstrip("b")) <= 2 << 20


def test_own_threshold_stays(spark):
    other = spark.newSession()
    other.conf.set(BROADCAST, "262144")
    staged(other.range(3), "small")
    assert other.conf.get(BROADCAST) == "262144"


def test_a_small_frontier_shuffles_no_edges(spark, monkeypatch):
    """Each level meets the edges by a broadcast of its nodes; edges that repeat change nothing."""
    from weftgraph.plans import expand

    plans = []
    keep = expand.staged

    def seen(df, name):
        if name == "frontier":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString())
        return keep(df, name)

    monkeypatch.setattr(expand, "staged", seen)
    edges = keep(spark.range(200_000).selectExpr("concat('n', id) AS src", "concat('n', id + 1) AS dst", "id AS edge_id"), "edges")
    seeds = edges.where("src = 'n7'").selectExpr("src AS node")
    rows = expand.spread(edges.unionByName(edges), seeds, 3).collect()
    assert sorted((r.node, r.depth) for r in rows) == [("n10", 3), ("n8", 1), ("n9", 2)]
    assert all("BroadcastHashJoin" in p and "SortMergeJoin" not in p for p in plans)


def test_rows_lie_in_folders_of_their_kind(spark):
    """Who asks for one kind of rows opens no file of another; columns keep their order."""
    rows = spark.createDataFrame([("call", "a", 1), ("symbol", "b", 2), (None, "c", 3)], "what string, name string, k int").select("name", "what", "k")
    out = staged(rows, "staging", by="what")
    assert out.columns == ["name", "what", "k"]
    assert sorted((r.name, r.what, r.k) for r in out.collect()) == [("a", "call", 1), ("b", "symbol", 2), ("c", None, 3)]
    plan = out.where("what = 'call'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(what" in plan and out.where("what = 'call'").collect()[0].name == "a"


def _last_plan(spark) -> str:
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    return runs.apply(runs.size() - 1).physicalPlanDescription()


def test_rows_of_few_folders_are_not_sorted(spark):
    """A task holds a file open for each kind of rows; the session's own setting is as it was."""
    out = staged(spark.range(1000).selectExpr("concat('kind', id % 3) AS what", "id"), "kinds", by="what")
    assert "Sort" not in _last_plan(spark) and out.count() == 1000
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_a_call_is_settled_by_one_shuffle(spark):
    from weftgraph.operators.resolve import by_ladder

    rows = [("a", 1, 0, 5, "x"), ("a", 1, 0, 5, "x"), ("a", 1, 0, 3, "y"), ("a", 1, 0, 3, "z"), ("b", 1, 0, 2, None), ("b", 1, 0, 7, "x")]
    out = by_ladder(spark.createDataFrame(rows, "caller string, line int, col int, priority int, callee string"))
    assert sorted(map(tuple, out.collect())) == [("a", 1, 0, "x", 5), ("b", 1, 0, "x", 7)]
    assert out._jdf.queryExecution().sparkPlan().toString().count("Exchange") + out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") <= 2


def test_names_are_settled_by_one_shuffle_of_what_they_may_be(spark):
    """A name that several types have, one that none has, and one that a single type has."""
    from weftgraph.graph import PropertyGraph
    from weftgraph.operators.build import _nothing_imported
    from weftgraph.operators.resolve import type_targets
    from weftgraph.schema import node_columns
    from pyspark.sql import functions as F

    types = spark.createDataFrame([("n.A", "A"), ("m.A", "A"), ("m.B", "B")], "full string, short string")
    nodes = types.select(node_columns(node_id=F.concat(F.lit("Class:"), "full"), kind_label=F.lit("Class"), full_name=F.col("full"), name=F.col("short"), file_path=F.lit("/r/x.java")))
    g = PropertyGraph(nodes, PropertyGraph.empty(spark).edges)
    rows = spark.createDataFrame([("/r/y.java", "k.C", t) for t in ("A", "B", "Gone", "n.A")], "file_path string, full_name string, target string")
    out = type_targets(g, rows, _nothing_imported(g), "java", "/r")
    assert sorted((r.target, r.dst, r.b, r.known) for r in out.collect()) == [("A", None, None, True), ("B", "Class:m.B", "Class", True), ("Gone", None, None, False), ("n.A", "Class:n.A", "Class", True)]
    assert "count(distinct" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_levels_of_trails_shuffle_no_edges(spark, monkeypatch):
    from weftgraph.plans import expand

    plans = []
    keep = expand.staged

    def seen(df, name):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return keep(df, name)

    monkeypatch.setattr(expand, "staged", seen)
    edges = keep(spark.range(200_000).selectExpr("concat('n', id) AS src", "concat('n', id + 1) AS dst", "id AS edge_id"), "edges")
    out = expand.trails(edges, edges.where("src = 'n7'").selectExpr("src AS node"), 1, 3)
    plans.append(out._jdf.queryExecution().sparkPlan().toString())
    assert sorted((r.node, r.depth) for r in out.collect()) == [("n10", 3), ("n8", 1), ("n9", 2)]
    assert all("SortMergeJoin" not in p for p in plans) and "BroadcastHashJoin" in plans[-1]


def test_the_star_graph_is_read_by_type(spark, sf_dir):
    """One table of calls is not read for what else there is, and executors' memory holds no copy of the graph."""
    from weftgraph.sources.star import star_graph

    g = star_graph(spark, sf_dir)
    assert not g.edges.storageLevel.useMemory and not g.nodes.storageLevel.useMemory
    plan = g.edge("CALLS")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"PartitionFilters: \[[^\]]*type#", plan)) == 2


def test_siblings_are_not_gathered_to_be_told_apart(spark):
    """As many rows as methods times classes: they are made distinct, not made so by an aggregate of them all."""
    from weftgraph.graph import PropertyGraph
    from weftgraph.operators.lookup import siblings
    from weftgraph.schema import edge_columns, node_columns
    from pyspark.sql import functions as F

    named = spark.createDataFrame([("Class", c) for c in ("a.A", "a.B", "a.C")] + [("Interface", "a.I")], "label string, fn string")
    nodes = named.select(node_columns(node_id=F.concat("label", F.lit(":"), "fn"), kind_label=F.col("label"), full_name=F.col("fn")))
    said = spark.createDataFrame([(c,) for c in ("a.A", "a.B", "a.C", "a.C")], "c string")
    g = PropertyGraph(nodes, said.select(edge_columns(F.concat(F.lit("Class:"), "c"), F.lit("Interface:a.I"), "IMPLEMENTS")))
    out = siblings(g, spark.createDataFrame([("a.A.m", "a.I", "a.A"), ("a.B.m", "a.I", "a.B")], "of string, interface string, owner string"))
    assert sorted(map(tuple, out.collect())) == [("a.A.m", "a.B"), ("a.A.m", "a.C"), ("a.B.m", "a.A"), ("a.B.m", "a.C")]
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()
