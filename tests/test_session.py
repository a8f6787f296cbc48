"""The session object and reports over the graph of the star-schema tables."""

from __future__ import annotations

import json

import pytest

from weftgraph.operators import dml, reports
from weftgraph.queries import symbols
from weftgraph.session import CodeGraph, Disk
from weftgraph.sources.star import star_graph


@pytest.fixture(scope="module")
def code(spark, sf_dir, tmp_path_factory):
    g = star_graph(spark, sf_dir)
    paths = [r.file_path for r in g.label("Method").select("file_path").distinct().collect() if r.file_path]
    texts = spark.createDataFrame([(p, "\n".join(f"line {k}" for k in range(1, 600))) for p in paths], "path string, text string")
    return CodeGraph(g, texts, str(tmp_path_factory.mktemp("log") / "calls.jsonl")), symbols(spark, sf_dir)


def test_lookups(code):
    c, s = code
    assert len(c.list_projects()["results"]) == 5 and "CALLS" in c.get_schema()["edges"]
    found = c.search_symbols("m", limit=3, kind="Method")
    assert len(found["results"]) == 3 and found["_truncated"] and found["_total"] > 3
    at = c.find_callers(s.target)["results"]
    assert at and c.find_usages(s.target)["results"] == at
    assert {r["what"] for r in c.find_usages(s.cls)["results"]} <= {"references", "callers"}
    assert c.find_implementations(s.ifc)["results"] and c.get_hierarchy(s.ifc)["results"]
    assert all(r["depth"] <= 2 for r in c.find_callees(s.start, depth=2)["results"])
    lines = [json.loads(x) for x in open(c.log)]
    assert {"tool", "bytes", "ms", "ts", "args"} == set(lines[0]) and len(lines) >= 7


def test_sources(code):
    c, s = code
    row = c.graph.nodes.where("full_name = '%s'" % s.target).first()
    got = c.read_symbol(s.target)
    assert got["source"] is None or got["source"].split("\n")[0] == f"line {row.line}" and len(got["source"].split("\n")) == 11
    assert c.read_symbol(s.cls, max_lines=50)["members"]
    assert "line 1" in {r.declaration for r in reports.parent_line(c.graph, c.texts, s.target).collect()}


def test_reports(code):
    c, s = code
    text = c.get_context_for(s.target).text()
    assert text.startswith(f"# {s.target}") and "## members" in text
    assert "constructor" in c.get_context_for(s.cls, members_only=True).parts
    found = c.assess_impact(s.target)
    assert len(found.parts["direct callers"]) <= reports.DIRECT and "contract" in found.parts
    totals = c.analyze_change_impact(s.target)
    assert totals["n_affected"] >= totals["n_direct"]
    arch = c.get_architecture()
    assert arch["stats"]["total_files"] == 10 and arch["hotspots"]
    dead = c.find_dead_code(limit=2)
    assert len(dead["methods"]) == 2 and dead["truncated"] == (dead["count"] > 2) and 0 <= c.find_untested()["ratio"] <= 1


def test_edit_reports(code):
    c, s = code
    found = c.get_edit_context(s.target)
    assert found.parts["direct callers"] and "tests" in found.parts and "contract" in found.parts
    found = c.get_edit_context(s.cls)
    top = {r["method"]: r["n_callers"] for r in found.parts["callers"]}
    assert top and len(top) <= reports.TYPE_METHODS and found.parts["interfaces"]
    each = {m: c.find_callers(m, limit=0)["results"] for m in top}
    assert all(len(each[m]) == n for m, n in top.items())
    assert all(len([r for r in found.parts["callers"] if r["method"] == m]) == min(n, reports.TYPE_CALLERS) for m, n in top.items())
    found = c.get_method_context(s.start)
    assert found.parts["callees"] and "summaries" in found.parts


def test_answers_warn_and_sync(code):
    c, s = code
    spark = c.graph.spark
    path = c.graph.nodes.where("full_name = '%s'" % s.cls).first().file_path
    late = lambda: spark.createDataFrame([(path, "2100-01-01 00:00:00"), ("/other", "2100-01-01 00:00:00")], "path string, t string").selectExpr("path", "to_timestamp(t) AS modified")
    warned = CodeGraph(c.graph, disk=Disk(late))
    assert path in warned.get_hierarchy(s.cls)["_warning"] and "_warning" not in CodeGraph(c.graph, disk=Disk(lambda: late().limit(0))).get_hierarchy(s.cls)
    calls, stored = [], dml.set_commit(c.graph, "/ASIA/", "abc")
    synced = lambda g: calls.append(1) or g
    for head, dirty, n in (("abc", [], 0), ("abc", ["/other"], 0), ("abc", [path], 1), ("def", [], 1), (None, [path], 0)):
        calls.clear()
        rows = spark.createDataFrame([(x,) for x in dirty], "path string")
        CodeGraph(stored, disk=Disk(late, lambda head=head: head, lambda rows=rows: rows, synced)).list_projects()
        assert len(calls) == n, (head, dirty)
    calls.clear()
    assert CodeGraph(c.graph, disk=Disk(late, lambda: "abc", lambda: None, synced)).list_projects() and not calls  # its commit is not known


def test_free_queries(code):
    c, _ = code
    assert c.execute_query("SELECT count(*) AS n FROM nodes WHERE kind_label = :k", {"k": "Repository"})["results"] == [{"n": 5}]
    with pytest.raises(ValueError, match="reading"):
        c.execute_query("DROP VIEW nodes")


def test_summaries_and_replacement(code):
    c, s = code
    assert {"full_name": s.target, "summary": "new"} in c.set_summary(s.target, "new").list_summarized()["results"]
    path = c.graph.label("Class").where("full_name = '%s'" % s.cls).first().file_path
    same = dml.replace_file(c.graph, path, c.graph)
    assert {r.node_id for r in same.nodes.collect()} == {r.node_id for r in c.graph.nodes.collect()}
    assert same.edges.count() == c.graph.edges.count()


def test_trees(spark):
    assert reports.path_tree(["a > b > c", "a > b > d", "e"]) == ["a", "  b", "    c", "    d", "e"]
    assert reports.depth_tree("r", [("x", 1), ("y", 2)]) == ["r", "  x", "    y"]
    rows = spark.createDataFrame([("a > b",), ("a > c",)], "path string")
    assert {(r.prefix, r.depth) for r in reports.prefixes(rows).collect()} == {("a", 1), ("a > b", 2), ("a > c", 2)}
    assert reports.without_nulls(spark.sql("SELECT 1 AS a, CAST(NULL AS string) AS b")).first().value == '{"a":1}'
