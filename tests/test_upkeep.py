"""Delta rules of derived edges: against making all of them anew, on random graphs, and in rows that follow the change."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.graph import PropertyGraph
from weftgraph.operators import upkeep
from weftgraph.plans.staging import staged
from weftgraph.schema import EDGE_DDL, EDGE_FIELDS, NODE_DDL, NODE_FIELDS

NAMES = ["get", "put", "run", "on_callback", "test_a", "test_b", "close"]
ROUTES = ["/a", "/a/{id}", "/api/a", "/b/{x}/c", "/v/b"]


class Repo:
    """Random files with types, methods and what they say of each other, as rows of a graph."""

    def __init__(self, seed: int, files: int, types: int = 4):
        self.rng = random.Random(seed)
        self.all_types = [f"f{k}.{kind}{n}" for k in range(files) for n, kind in enumerate("CCIA"[:types])]
        self.files = {}
        for k in range(files):
            self.write(k)

    def write(self, k: int) -> None:
        rng, path = self.rng, f"/r/{'tests/' if k % 4 == 0 else ''}f{k}.py"
        nodes, edges = {f"File:{path}": {"kind_label": "File", "path": path, "name": path}}, {}
        for full in [t for t in self.all_types if t.startswith(f"f{k}.") and rng.random() < 0.8]:
            label = "Interface" if full.split(".")[1][0] == "I" else "Class"
            nodes[f"{label}:{full}"] = {"kind_label": label, "full_name": full, "name": full.split(".")[1], "file_path": path, "language": rng.choice(["python", "python", "java"])}
            edges[f"File:{path}", "CONTAINS", f"{label}:{full}"] = None
            for name in rng.sample(NAMES, rng.randrange(4)):
                m = f"Method:{full}.{name}"
                nodes[m] = {"kind_label": "Method", "full_name": f"{full}.{name}", "name": name, "file_path": path, "line": rng.randrange(9), "language": rng.choice(["python", "typescript", "java"]),
                            "is_abstract": rng.random() < 0.4, "attributes": rng.choice(['["test"]', "[]"])}
                edges[f"{label}:{full}", "CONTAINS", m] = None
                for _ in range(rng.randrange(3)):
                    edges[m, "CALLS", f"Method:{rng.choice(self.all_types)}.{rng.choice(NAMES)}"] = [(rng.randrange(9), 1)]
                if rng.random() < 0.3:
                    end = f"Endpoint:GET {rng.choice(ROUTES)}"
                    nodes[end] = {"kind_label": "Endpoint", "route": end[13:], "http_method": "GET", "name": end[9:]}
                    edges[m, rng.choice(["SERVES", "HTTP_CALLS"]), end] = None
            for _ in range(rng.choice([0, 0, 1, 2])):
                other = rng.choice(self.all_types)
                to = ("Interface:" if other.split(".")[1][0] == "I" else "Class:") + other
                edges[f"{label}:{full}", "INHERITS" if to.startswith(label) else "IMPLEMENTS", to] = None
        self.files[k] = path, nodes, {e: v for e, v in edges.items() if e[0] != e[2] and e[:2] != ("Interface", "IMPLEMENTS")}

    def rows(self, which=None):
        nodes, edges = {}, {}
        for k, (_, n, e) in self.files.items():
            if which is None or k in which:
                nodes |= n
                edges |= e
        return nodes, edges

    def graph(self, spark, which=None, ends=None) -> PropertyGraph:
        nodes, edges = self.rows(which)
        nodes["Repository:/r"] = {"kind_label": "Repository", "path": "/r", "name": "r"}
        have = set(nodes) | set(ends or ())
        label = lambda v: v | {"labels": [v["kind_label"]]}
        n = spark.createDataFrame([tuple(label(v | {"node_id": i}).get(c) for c in NODE_FIELDS) for i, v in nodes.items()], NODE_DDL)
        e = spark.createDataFrame([(a, b, t, None, sites, 0) for (a, t, b), sites in edges.items() if a in have and b in have], EDGE_DDL)
        e = e.withColumn("edge_id", F.xxhash64("src", "type", "dst", F.lit("")))
        return PropertyGraph(staged(n, "n"), staged(e.select(*EDGE_FIELDS), "e"))


def plain(rows):
    return sorted({(r.rule, r.src, r.type, r.dst, repr(r.call_sites)) for r in rows.collect()})


@pytest.mark.parametrize(("seed", "literals"), [(1, 200), (3, 3)])
def test_changes_equal_making_all_anew(spark, monkeypatch, seed, literals):
    monkeypatch.setattr(upkeep, "LITERALS", literals)
    repo = Repo(seed, 9)
    facts = repo.graph(spark)
    rows = staged(upkeep.derived(facts), "derived")
    paths = {k: v[0] for k, v in repo.files.items()}
    changed = repo.rng.sample(sorted(paths), 2)
    gone = [k for k in repo.rng.sample(sorted(paths), 2) if k not in changed][:1]
    for k in changed:
        repo.write(k)
    for k in gone:
        del repo.files[k]
    as_frame = lambda ks: spark.createDataFrame([(paths[k],) for k in ks], "path string")
    fresh = repo.graph(spark, changed, repo.rows()[0])
    change = upkeep.files_change(facts, as_frame(changed), as_frame(gone), fresh)
    new = change.applied(facts).staged()
    # Facts: what the files that are left say. Edges of other files into symbols that are new are theirs to find when they are read again.
    nodes, edges = repo.rows()
    own = {x for k in changed for x in repo.files[k][1]}
    before = {(r.src, r.type, r.dst) for r in facts.edges.collect()}
    want = {e for e in edges if e[0] in nodes and e[2] in nodes and (e in before or e[0] in own)}
    assert {(r.src, r.type, r.dst) for r in new.edges.collect()} == want
    ends = {r.node_id for r in new.label("Endpoint").collect()}
    assert {r.node_id for r in new.nodes.collect()} - ends == {*nodes, "Repository:/r"} - ends
    came, went = upkeep.derived_change(facts, change, rows)
    anew = staged(upkeep.derived(new), "derived")
    keys = ["rule", "src", "type", "dst"]
    kept = rows.join(went.select(keys), keys, "left_anti").join(came.select(keys), keys, "left_anti").unionByName(came)
    assert plain(kept) == plain(anew)
    assert len({r.rule for r in anew.collect()}) >= 7
    both = [{(r.src, r.type, r.dst) for r in upkeep.combined(new, x).edges.collect()} for x in (kept, anew)]
    assert both[0] == both[1]


def test_a_stream_keeps_a_stored_graph_up_to_date(spark, tmp_path):
    """A file of many changes: what is written follows its neighbourhood, and the graph equals one that is made anew."""
    from weftgraph.sources.store import GraphStore
    from weftgraph.streaming.reindex import Upkeep

    repo = Repo(7, 120)
    keeper = Upkeep(GraphStore(spark, f"file://{tmp_path}/facts"), GraphStore(spark, f"file://{tmp_path}/derived"))
    keeper.start(repo.graph(spark))
    assert keeper.versions() == [1]
    repo.write(5)
    path = repo.files[5][0]
    events = spark.sql(f"SELECT '{path}' AS path, 'create' AS event, timestamp'2024-01-01' AS ts UNION ALL SELECT '{path}', 'modify', timestamp'2024-01-02'")
    for _ in range(2):  # a batch that is run again
        keeper.apply(lambda paths: repo.graph(spark, [5], repo.rows()[0]))(events, 0)
        assert keeper.versions() == [1, 2]
    whole = keeper.facts.read(2)
    want = upkeep.combined(whole, staged(upkeep.derived(whole), "derived"))
    edges = lambda g: {(r.src, r.type, r.dst) for r in g.edges.collect()}
    assert edges(keeper.read()) == edges(want)
    total = keeper.facts.read(2).edges.count() + keeper.derived.read(2).edges.count()
    wrote = sum(spark.read.parquet(f"file://{tmp_path}/{s}/d00000002-00000001/edges").count() for s in ("facts", "derived"))
    assert total > 1000 and wrote < total / 10
    keeper.apply(lambda paths: 1 / 0)(events.limit(0), 1)
    assert keeper.versions() == [1, 2]


def test_stored_tables_answer_by_key(spark, tmp_path):
    """Few keys go down to the readers as values; sorted pages and Bloom filters let them skip rows."""
    n = 60_000
    nodes = spark.range(n).selectExpr("concat('Method:m', lpad(id, 6, '0')) AS node_id", "concat('m', lpad(id, 6, '0')) AS full_name", "concat('/r/', id % 997) AS file_path")
    from weftgraph.schema import edge_columns, node_columns

    g = PropertyGraph(nodes.select(node_columns(**{c: F.col(c) for c in nodes.columns}, kind_label=F.lit("Method"))), nodes.select(edge_columns(F.col("node_id"), F.reverse("node_id"), "CALLS")))
    g.write(f"file://{tmp_path}/g")
    g = PropertyGraph.read(spark, f"file://{tmp_path}/g")
    keys = upkeep.Keys.of(spark.createDataFrame([(f"Method:m{k:06d}",) for k in (5, 700, 59_000)], "node string"))
    rows = upkeep.only(g.edge("CALLS"), "src", keys)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "In(src" in plan.replace("`", "") and rows.count() == 3
    many = upkeep.Keys.of(nodes.select(F.col("node_id").alias("node")))
    assert many.values is None and upkeep.only(g.edge("CALLS"), "src", many).count() == n
