"""Small graphs with known answers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weftgraph.graph import PropertyGraph
from weftgraph.operators import audit, derive, dml, impact, lookup, resolve, sync, traversal
from weftgraph.plans import expand
from weftgraph.plans.expand import closure, nearest, reach, spread, trails, trails_between, ways
from weftgraph.schema import EDGE_FIELDS, NODE_DDL, edge_columns


def edges_of(spark, rows, type_="CALLS", label="Method"):
    df = spark.createDataFrame(rows, "a string, b string")
    return df.select(edge_columns(F.concat(F.lit(f"{label}:"), "a"), F.concat(F.lit(f"{label}:"), "b"), type_))


def node(label, full_name, **more):
    return {"node_id": f"{label}:{full_name}", "labels": [label], "kind_label": label, "full_name": full_name, "name": full_name.rsplit(".", 1)[-1], "file_path": "/r/src/a.py", "line": 1, "end_line": 9, **more}


def graph(spark, nodes, *edges):
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(NODE_DDL)
    rows = [tuple(n.get(f.name) for f in schema) for n in nodes]
    g = PropertyGraph.empty(spark)
    return PropertyGraph(spark.createDataFrame(rows, schema), g.edges.unionByName(edges[0]) if len(edges) == 1 else g.with_edges(*edges).edges)


def between(spark, rows):
    """Edges of (src id, dst id, type)."""
    df = spark.createDataFrame(rows, "a string, b string, t string")
    out = None
    for t in {r[2] for r in rows}:
        part = df.where(F.col("t") == t).select(edge_columns(F.col("a"), F.col("b"), t))
        out = part if out is None else out.unionByName(part)
    return out


LOOPS = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "a")]


def test_trails_repeat_no_edge(spark):
    seeds = spark.createDataFrame([("Method:a",)], "node string")
    rows = trails(edges_of(spark, LOOPS), seeds, 1, 4).select("depth", "node").collect()
    found = {}
    for r in rows:
        found.setdefault(r.depth, []).append(r.node[-1])
    assert {k: sorted(v) for k, v in found.items()} == {1: ["a", "b"], 2: ["b", "c"], 3: ["a", "c", "d"], 4: ["a", "a", "d"]}


def test_reach_and_closure_end_on_cycles(spark):
    e = edges_of(spark, LOOPS)
    seeds = spark.createDataFrame([("Method:a",)], "node string")
    assert {(r.node[-1], r.depth) for r in reach(e, seeds).collect()} == {("a", 1), ("b", 1), ("c", 2), ("d", 3)}
    assert {(r.node[-1], r.depth) for r in reach(e, seeds, 2).collect()} == {("a", 1), ("b", 1), ("c", 2)}
    assert closure(e).count() == 12
    assert reach(e.limit(0), seeds).count() == 0 and trails(e.limit(0), seeds, 1, 5).count() == 0


def test_expansions_against_brute_force(spark):
    import random
    from collections import defaultdict

    rng = random.Random(3)
    rows = sorted({(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(40)})
    e = edges_of(spark, rows).withColumn("edge_id", F.xxhash64("src", "dst"))
    after = defaultdict(list)
    for k, (a, b) in enumerate(rows):
        after[a].append((k, b))
    paths = []  # every trail from n0 of up to 5 hops
    todo = [(("n0",), ())]
    while todo:
        nodes, used = todo.pop()
        for k, b in after[nodes[-1]]:
            if k not in used:
                paths.append((*nodes, b))
                if len(used) < 4:
                    todo.append(((*nodes, b), (*used, k)))
    depth = {n: min(len(p) - 1 for p in paths if p[-1] == n) for n in {p[-1] for p in paths}}
    seed = spark.createDataFrame([("Method:n0",)], "node string")
    bare = F.substr("node", F.lit(8))
    assert {(r.node[7:], r.depth) for r in spread(e, seed, 5).collect()} == set(depth.items())
    best = {n: min(" > ".join(p) for p in paths if p[-1] == n and len(p) - 1 == d) for n, d in depth.items()}
    assert {(r.node[7:], r.depth, r.path) for r in nearest(e, seed, 5, bare).collect()} == {(n, depth[n], best[n]) for n in depth}
    for goal in ("n1", "n5", "n0"):
        want = sorted((len(p) - 1, " > ".join(p)) for p in paths if p[-1] == goal)
        end = spark.createDataFrame([(f"Method:{goal}",)], "node string")
        for k in (1, 4, 1000):
            got = sorted((r.depth, " > ".join(x[7:] for x in r.nodes)) for r in trails_between(e, seed, end, 5, k).collect())
            assert got[:k] == want[:k] and (k < 1000 or got == want)


def test_a_chain_has_no_bound_and_levels_stay_few(spark, monkeypatch):
    written = []
    real = expand.staged
    monkeypatch.setattr(expand, "staged", lambda df, name: written.append(name) or real(df, name))
    chain = edges_of(spark, [(f"c{k}", f"c{k + 1}") for k in range(25)], "INHERITS", "Class")
    g = PropertyGraph(spark.createDataFrame([(f"Class:c{k}", f"c{k}") for k in range(26)], "node_id string, full_name string").withColumns({"kind_label": F.lit("Class")}), chain)
    top = spark.createDataFrame([("Class:c0",)], "node string")
    assert {(r.node, r.depth) for r in spread(chain, top).collect()} == {(f"Class:c{k}", k) for k in range(1, 26)}
    assert written.count("frontier") == 26 and written.count("known") <= 25
    assert {(r.relation, r.full_name, r.paths) for r in lookup.hierarchy(g, "c0").collect()} == {("parent", f"c{k}", 1) for k in range(1, 26)}
    diamonds = [(f"d{k}", f"{x}{k}") for k in range(17) for x in "lr"] + [(f"{x}{k}", f"d{k + 1}") for k in range(17) for x in "lr"]  # 34 levels, more than one plan sums
    found = {r.node[6:]: r.paths for r in ways(edges_of(spark, diamonds, "INHERITS", "Class"), spark.createDataFrame([("Class:d0",)], "node string")).collect()}
    assert len(found) == 51 and all(found[f"d{k}"] == 2**k for k in range(1, 18))


def test_dense_graph_makes_few_rows_a_level(spark, monkeypatch):
    """60 methods that all call each other: 59^8 trails, but no level of an analysis has more rows than there are methods or calls."""
    rows = [(f"m{a}", f"m{b}") for a in range(60) for b in range(60) if a != b] + [("root", "m3")]
    nodes = [node("Method", f"m{k}") for k in range(60)] + [node("Method", "root")]
    g = graph(spark, nodes, edges_of(spark, rows))
    largest = []
    real = expand.staged

    def counted(df, name):
        out = real(df, name)
        largest.append(out.count())
        return out

    monkeypatch.setattr(expand, "staged", counted)
    assert [(r.entry, r.depth, r.path) for r in traversal.entry_points(g, "m7").collect()] == [("root", 2, "root > m3 > m7")]
    assert impact.change_impact(g, "m7").where("role = 'direct'").count() == 59
    assert max(largest) <= 61
    assert [r.path for r in traversal.trace(g, "root", "m9", limit=5).collect()][:2] == ["root > m3 > m9", "root > m3 > m0 > m9"]
    assert max(largest) <= 60 * 61


def test_callers_through_interface_and_diamond(spark):
    nodes = [node("Interface", "n.I"), node("Class", "n.A"), node("Class", "n.B"), node("Class", "n.C"), node("Class", "n.D"),
             node("Method", "n.I.f"), node("Method", "n.A.f"), node("Method", "n.B.f"), node("Method", "n.t", file_path="/r/tests/t.py"), node("Method", "n.u")]
    own = [("Interface:n.I", "Method:n.I.f", "CONTAINS"), ("Class:n.A", "Method:n.A.f", "CONTAINS"), ("Class:n.B", "Method:n.B.f", "CONTAINS"),
           ("Class:n.A", "Interface:n.I", "IMPLEMENTS"), ("Class:n.B", "Class:n.A", "INHERITS"), ("Class:n.C", "Class:n.A", "INHERITS"),
           ("Class:n.D", "Class:n.B", "INHERITS"), ("Class:n.D", "Class:n.C", "INHERITS"), ("Method:n.u", "Method:n.I.f", "CALLS"), ("Method:n.t", "Method:n.u", "CALLS")]
    g = derive.all_derived(graph(spark, nodes, between(spark, own)))
    assert {r.full_name for r in lookup.callers(g, "n.A.f").collect()} == {"n.u"}
    assert lookup.callers(g, "n.A.f", dispatch=False).count() == 0
    assert {r.full_name for r in lookup.callees(g, "n.u").collect()} == {"n.I.f", "n.A.f"}
    assert {r.full_name for r in lookup.implementations(g, "n.I").collect()} == {"n.A", "n.B", "n.C", "n.D"}
    assert {r.full_name for r in lookup.implementations(g, "I").collect()} == {"n.A", "n.B", "n.C", "n.D"}
    assert {(r.relation, r.full_name, r.paths) for r in lookup.hierarchy(g, "n.D").collect()} == {("parent", "n.B", 1), ("parent", "n.C", 1), ("parent", "n.A", 2)}
    assert {(r.src, r.dst) for r in g.edge("OVERRIDES").collect()} == {("Method:n.B.f", "Method:n.A.f")}
    assert {r.full_name for r in impact.test_coverage(g, "n.A.f").collect()} == {"n.t"}
    assert [r.path for r in traversal.trace(g, "n.t", "n.A.f").collect()] == ["n.t > n.u > n.I.f > n.A.f"]
    # the test's caller is a test, so u is the entry; a method is never its own
    assert [r.entry for r in traversal.entry_points(g, "n.A.f").collect()] == ["n.u"]
    assert traversal.entry_points(g, "n.t").count() == 0


def test_dead_code_rules(spark):
    cls = [node("Class", "n.A", external_bases="[]"), node("Class", "n.Ext", external_bases='["x"]'), node("Class", "n.Ent", attributes='["entity"]'), node("Class", "n.AppOptions")]
    m = [node("Method", "n.A.plain"), node("Method", "n.A.again"), node("Method", "n.A.A"), node("Method", "n.A.main"), node("Method", "n.A.virt", attributes='["virtual"]'),
         node("Method", "n.A.async_like", attributes='["HttpGetAsync"]'), node("Method", "n.A.stub", stub=True), node("Method", "n.A.abs", is_abstract=True),
         node("Method", "n.Ext.m"), node("Method", "n.Ext.s", is_static=True), node("Method", "n.Ent.getX"), node("Method", "n.Ent.work"), node("Method", "n.AppOptions.configure"),
         node("Method", "n.A.vend", file_path="/r/vendor/x.py"), node("Method", "n.A.tested", file_path="/r/tests/x.py"), node("Method", "n.A.nopath", file_path=None)]
    own = [(f"Class:{x['full_name'].rsplit('.', 1)[0]}", x["node_id"], "CONTAINS") for x in m] + [("Method:n.A.again", "Method:n.A.again", "CALLS")]
    g = graph(spark, cls + m, between(spark, own))
    dead = {r.full_name for r in audit.dead_code(g, 0).collect()}
    assert dead == {"n.A.plain", "n.A.async_like", "n.Ext.s", "n.Ent.work"}  # a call of oneself is a call
    stats = audit.audit_stats(g).first()
    assert (stats.total_methods, stats.dead_count, stats.dead_ratio) == (5, 4, 0.8)
    assert audit.dead_code(g, 0, exclude_pattern="plain").count() == 3
    empty = PropertyGraph.empty(spark)
    assert audit.audit_stats(empty).first().dead_ratio == 0.0


def test_search_terms():
    assert lookup.search_term("def my_function(") == "my_function"
    assert lookup.search_term("static") == "static"
    assert lookup.search_term("class {") == "class {"
    assert lookup.search_term("public async Task<Foo> Load(") == "Task"
    assert lookup.search_term("a.b.C") == "a.b.C"


def test_resolve_one(spark):
    g = graph(spark, [node("Class", "n.A"), node("Method", "n.x.A"), node("Interface", "p.B"), node("Class", "q.B")], PropertyGraph.empty(spark).edges)
    assert lookup.resolve_one(g, "A") == "n.A"
    assert lookup.resolve_one(g, "B", prefer="interface") == "p.B"
    with pytest.raises(LookupError, match="ambiguous"):
        lookup.resolve_one(g, "B")
    with pytest.raises(LookupError, match="no symbol"):
        lookup.resolve_one(g, "Zzz")
    with pytest.raises(ValueError, match="kind"):
        lookup.search(g, "x", kind="Endpoint")


def test_read_only_sql(spark):
    g = graph(spark, [node("Class", "n.A")], PropertyGraph.empty(spark).edges)
    assert g.sql("WITH x AS (SELECT * FROM nodes) SELECT count(*) AS n FROM x WHERE name = 'DROP'").first().n == 0
    for bad in ("DROP VIEW nodes", "INSERT INTO nodes SELECT * FROM nodes", "CREATE TABLE t AS SELECT 1", "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x"):
        with pytest.raises(ValueError, match="reading"):
            g.sql(bad)


def test_write_and_read(spark, tmp_path):
    g = graph(spark, [node("Class", "n.A"), node("Class", "n.B")], between(spark, [("Class:n.A", "Class:n.B", "INHERITS")]))
    g.write(str(tmp_path / "g"))
    again = PropertyGraph.read(spark, str(tmp_path / "g"))
    assert again.nodes.count() == 2
    plan = again.edge("INHERITS")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and again.edge("INHERITS").count() == 1


def test_upserts_are_idempotent(spark):
    g = graph(spark, [node("Class", "n.A", summary="s", language="python"), node("Class", "n.B")], between(spark, [("Class:n.A", "Class:n.B", "INHERITS")]))
    rows = spark.createDataFrame([("Class:n.A", "java", ["Class"]), ("Class:n.C", "java", ["Class"])], "node_id string, language string, labels array<string>")
    once = dml.upsert_nodes(g, rows)
    twice = dml.upsert_nodes(once, rows)
    assert sorted(map(str, once.nodes.collect())) == sorted(map(str, twice.nodes.collect()))
    a = once.nodes.where("node_id = 'Class:n.A'").first()
    assert (a.summary, a.language, a.labels) == ("s", "java", ["Class"])
    again = dml.upsert_edges(g, g.edges.select(*EDGE_FIELDS))
    assert again.edges.count() == 1


def test_shared_package_survives_orphan_deletion(spark):
    nodes = [{"node_id": "File:/f", "labels": ["File"], "kind_label": "File", "path": "/f", "file_path": "/f", "name": "f"}, node("Package", "p", file_path=None), node("Class", "p.A", file_path="/f"), node("Class", "p.B", file_path="/g")]
    g = graph(spark, nodes, between(spark, [("File:/f", "Package:p", "CONTAINS"), ("Package:p", "Class:p.A", "CONTAINS"), ("Package:p", "Class:p.B", "CONTAINS")]))
    keep = spark.createDataFrame([("nothing",)], "full_name string")
    assert {r.full_name for r in dml.delete_orphans(g, "/f", keep).nodes.collect()} == {None, "p", "p.B"}
    assert {r.full_name for r in dml.delete_file(g, "/f").nodes.collect()} == set()


def test_overload_ladder_and_division(spark):
    g = graph(spark, [node("Method", "n.f(int)"), node("Method", "n.g(int)"), node("Method", "n.g(str)"), node("Method", "n.h"), node("Method", "n.h(int)")], PropertyGraph.empty(spark).edges)
    names = spark.createDataFrame([("n.f",), ("n.g",), ("n.h",)], "wanted string")
    assert {(r.wanted, r.node_id) for r in resolve.overloads(g, names).collect()} == {("n.f", "Method:n.f(int)"), ("n.h", "Method:n.h")}
    c = spark.createDataFrame([("m", 1, 0, 0, "x"), ("m", 1, 0, 0, "y"), ("m", 1, 0, 1, "z"), ("m", 2, 0, 2, "w")], "caller string, line int, col int, priority int, callee string")
    assert {(r.line, r.callee) for r in resolve.by_ladder(c).collect()} == {(1, "z"), (2, "w")}


def test_structural_dispatch(spark):
    nodes = [node("Interface", "n.P", language="python"), node("Class", "n.Full"), node("Class", "n.Half"), *(node("Method", f"n.{c}.{m}") for c in ("P", "Full", "Half") for m in ("f", "g") if (c, m) != ("Half", "g"))]
    own = [(f"{'Interface' if c == 'P' else 'Class'}:n.{c}", f"Method:n.{c}.{m}", "CONTAINS") for c in ("P", "Full", "Half") for m in ("f", "g") if (c, m) != ("Half", "g")]
    g = graph(spark, nodes, between(spark, own))
    assert {(r.src, r.dst) for r in derive.structural_dispatch(g).collect()} == {("Method:n.P.f", "Method:n.Full.f"), ("Method:n.P.g", "Method:n.Full.g")}


def test_changes(spark):
    rows = [("A", None, "/a.py"), ("D", "/a.py", None), ("R90", "/old.py", "/new.py"), ("D", "/old.py", None), ("M", None, "/x.md"), ("D", "/gone.py", None)]
    out = sync.change_set(spark.createDataFrame(rows, "status string, old_path string, new_path string"), (".py",))
    assert {(r.path, r.action, r.old_path) for r in out.collect()} == {("/a.py", "reindex", None), ("/new.py", "rename", "/old.py"), ("/gone.py", "delete", None)}
    assert sync.strategy(None, "h", 0) == "full" and sync.strategy("a", "b", 3) == "git" and sync.strategy(None, "b", 3) == "mtime"


def test_shown_graph_loses_orphans(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("lone",)], "full_name string")
    links = spark.createDataFrame([("a", "b"), ("b", "c")], "source string, target string")
    kept, left = traversal.without_orphans(nodes, links, spark.createDataFrame([("c",)], "full_name string"))
    assert {r.full_name for r in kept.collect()} == {"a", "b", "lone"} and left.count() == 1


def test_timeout(spark):
    g = PropertyGraph.empty(spark)
    slow = spark.range(4_000_000_000).selectExpr("sum(sqrt(id) * sin(id)) AS s")
    with pytest.raises(TimeoutError):
        g.collect_within(slow, 1.0)


def test_after_sync_matches_again(spark):
    nodes = [node("Method", "n.serve"), node("Method", "n.ask"), node("Method", "n.test_it", file_path="/r/tests/t.py", language="python", name="test_it"), {"node_id": "Repository:/r", "labels": ["Repository"], "kind_label": "Repository", "path": "/r"}]
    ends = [{"node_id": f"Endpoint:GET {x}", "labels": ["Endpoint"], "kind_label": "Endpoint", "name": f"GET {x}", "route": x, "http_method": "GET"} for x in ("/api/a", "/a", "/gone")]
    own = [("Method:n.serve", "Endpoint:GET /api/a", "SERVES"), ("Method:n.ask", "Endpoint:GET /a", "HTTP_CALLS"), ("Method:n.test_it", "Method:n.ask", "CALLS"), ("Repository:/r", "Endpoint:GET /api/a", "CONTAINS"), ("Repository:/r", "Endpoint:GET /gone", "CONTAINS")]
    out = derive.after_sync(graph(spark, nodes + ends, between(spark, own)))
    assert {(r.src, r.type, r.dst) for r in out.edges.collect()} == {
        ("Method:n.serve", "SERVES", "Endpoint:GET /api/a"), ("Method:n.ask", "HTTP_CALLS", "Endpoint:GET /api/a"), ("Method:n.test_it", "CALLS", "Method:n.ask"),
        ("Method:n.test_it", "TESTS", "Method:n.ask"), ("Repository:/r", "CONTAINS", "Endpoint:GET /api/a"),
    }
    assert {r.node_id for r in out.label("Endpoint").collect()} == {"Endpoint:GET /api/a"}


def test_upserted_edges_are_not_shuffled_by_their_ends(spark):
    """missing ends are found among the distinct ends; rows with their call sites are shuffled by their keys alone."""
    import re

    from weftgraph.operators import dml
    from weftgraph.schema import EDGE_DDL, EDGE_FIELDS, NODE_FIELDS, edge_columns

    rdd = spark.sparkContext.parallelize([(x,) for x in "abc"])  # of unknown size, so nothing of it is broadcast by its size
    nodes = spark.createDataFrame(rdd, "node_id string").select(*(F.col(c) if c == "node_id" else F.lit(None).cast(t).alias(c) for c, t in NODE_FIELDS.items()))
    rows = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "gone"), ("gone", "c"), (None, "c")], "src string, dst string").select(edge_columns(F.col("src"), F.col("dst"), "CALLS"))
    out = dml.upsert_edges(PropertyGraph(nodes, spark.createDataFrame([], EDGE_DDL)), rows.select(*EDGE_FIELDS)).edges
    assert [(r.src, r.dst) for r in out.collect()] == [("a", "b")]
    assert not re.search(r"hashpartitioning\((src|dst)#\d+, \d+\)", out._jdf.queryExecution().executedPlan().toString())
