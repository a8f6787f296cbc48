"""Routes, source trees, the Python parser and the stream of file events."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import predicates as P
from weftgraph.functions import routes
from weftgraph.operators import build
from weftgraph.sources import files, python_source
from weftgraph.streaming import debounce


def matched(spark, defs, calls):
    d = spark.createDataFrame([(*x, k) for k, x in enumerate(defs)], "route string, http_method string, handler string, def_ord bigint")
    c = spark.createDataFrame([(*x, "caller", 1, 0, k) for k, x in enumerate(calls)], "route string, http_method string, caller string, line int, col int, call_ord bigint")
    return [(r.ep_route, r.matched, r.handler) for r in routes.match_calls(d, c).orderBy("call_ord").collect()]


@pytest.mark.parametrize(
    ("defs", "call", "want"),
    [
        ([("/items", "GET", "h")], ("/items", "GET"), ("/items", True, "h")),
        ([("/items/{id}", "GET", "h")], ("/items/{itemId}", "GET"), ("/items/{id}", True, "h")),
        ([("/items", "GET", "h")], ("/items", "POST"), ("/items", False, None)),
        ([("/api/items", "GET", "h")], ("/items", "GET"), ("/api/items", True, "h")),
        ([("/api/v2/items", "GET", "h")], ("{base}/items", "GET"), ("/api/v2/items", True, "h")),
        ([("/items/{id}", "GET", "h")], ("/items/7", "GET"), ("/items/7", False, None)),
        ([("/items/{id}", "GET", "h")], ("/items", "GET"), ("/items", False, None)),
        ([("/a/{x}", "GET", "first"), ("/a/{y}", "GET", "second")], ("/a/{z}", "GET"), ("/a/{x}", True, "first")),
        ([("/api/a", "GET", "api"), ("/a", "GET", "plain")], ("/a", "GET"), ("/a", True, "plain")),
    ],
)
def test_route_cases(spark, defs, call, want):
    assert matched(spark, defs, [call]) == [want]


def test_route_forms(spark):
    row = spark.range(1).select(
        routes.normalised(F.lit("api/[x]"), F.lit("{id:int}/")).alias("a"), routes.normalised(F.lit("api"), F.lit("~/root")).alias("b"), routes.normalised(F.lit(""), F.lit("")).alias("c"),
        routes.flask_params(F.lit("/u/<int:id>/<name>")).alias("d"), routes.express_params(F.lit("/u/:id/x")).alias("e"),
    ).first()
    assert tuple(row) == ("/api/[x]/{id}", "/root", "/", "/u/{id}/{name}", "/u/{id}/x")


def test_paths(spark):
    test = ["/a/tests/x.py", "/a/MyTests/x.cs", "/a/__tests__/x", "/x/a.spec.ts", "/x/a_test.go", "/a/src/test/B.java", "/a/latest/x.py"]
    rows = spark.createDataFrame([(x,) for x in [*test, "/a/prod/x.py", "", None]], "p string").select("p", P.is_test(F.col("p")).alias("t"), P.is_vendored(F.concat("p", F.lit("/node_modules/z"))).alias("v")).collect()
    assert [r.t for r in rows] == [True] * 7 + [False, False, None] and rows[0].v


def test_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    for n in range(3):
        (tmp_path / "src" / f"m{n}.py").write_text(f"x = {n}\ny = 1\n")
    (tmp_path / "src" / "one.ts").write_text("x" * 600)
    (tmp_path / "build").mkdir()
    (tmp_path / "build" / "z.py").write_text("z = 1")
    tree = files.tree(spark, str(tmp_path))
    assert tree.count() == 5
    assert [(r.language, r.files) for r in files.detect_languages(tree).collect()] == [("python", 4)]
    below = tree.select(P.relative(F.col("path"), F.lit(str(tmp_path))).alias("path"))
    rules = files.ignore_rules("m*.py\n!m1.py\n")
    kept = {r.path for r in below.where(~files.is_ignored(F.col("path"), rules)).collect()}
    assert kept == {"src/m1.py", "src/one.ts"}
    assert files.contents(spark, str(tmp_path), ".ts").where(files.is_minified(F.col("text"))).count() == 1
    assert files.glob_pattern("a/**/{b,c}*.ts") == r"a/(?:.*/)?(?:b|c)[^/]*\.ts"


def test_ignore_rules_as_written(spark):
    rules = files.nested_rules([("", "*.[oa]\n\\#odd\n\\!not\nlog[0-9].txt\n[!x]y\nkeep\\*\nlib/\n"), ("sub", "!b.o\n/only.txt\n"), ("lib/deep", "!z.py\n"), ("sub/in", "b.o\n")])
    paths = {"a.o": True, "x/a.a": True, "a.c": False, "#odd": True, "!not": True, "log7.txt": True, "logx.txt": False, "zy": True, "xy": False, "keep*": True, "keeps": False, "sub/b.o": False, "b.o": True,
             "sub/in/b.o": True, "sub/only.txt": True, "sub/x/only.txt": False, "only.txt": False, "lib/deep/z.py": True}
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.path: r.i for r in rows.select("path", files.is_ignored(F.col("path"), rules, ()).alias("i")).collect()} == paths
    refs = spark.createDataFrame([("/r/a.c",), ("/r/a.o",), ("/q/a.c",), ("/r2/a.c",)], "file_path string")
    assert [r.file_path for r in files.own_references(refs, "/r/", rules).collect()] == ["/r/a.c"]


SOURCE = '''
from abc import ABC, abstractmethod
import requests

class Animal(ABC):
    legs: Legs
    @abstractmethod
    def speak(self) -> str: ...

class Dog(Animal, Extern):
    def speak(self) -> str:
        return helper()
    @app.get("/dogs/{id}")
    async def fetch(self, other: Animal):
        self.client = Client()
        return requests.post(f"{base}/cats/{other}")

def helper():
    return 1
'''


def test_python_graph(spark):
    rows = spark.createDataFrame([("/r/pkg/zoo.py", SOURCE), ("/r/bad.py", "def ("), ("/r/empty.py", None)], "path string, text string")
    staging = python_source.staging(rows, "/r").cache()
    assert staging.where("what = 'error'").count() == 1
    assert [(r.kind, r.target) for r in staging.where("what = 'endpoint'").collect()] == [("GET", "/dogs/{id}")]
    assert [(r.kind, r.target) for r in staging.where("what = 'client_call'").collect()] == [("POST", "{base}/cats/{other}")]
    assert [(r.name, r.target) for r in staging.where("what = 'assignment'").collect()] == [("client", "Client")]
    g = build.python_graph(staging, "/r")
    kinds = {(r.kind_label, r.full_name) for r in g.nodes.collect()}
    assert {("Interface", "pkg.zoo.Animal"), ("Class", "pkg.zoo.Dog"), ("Method", "pkg.zoo.Dog.fetch"), ("Field", "pkg.zoo.Animal.legs"), ("Class", "pkg.zoo")} <= kinds
    edges = {(r.src, r.type, r.dst) for r in g.edges.collect()}
    assert ("Class:pkg.zoo.Dog", "IMPLEMENTS", "Interface:pkg.zoo.Animal") in edges
    assert ("Method:pkg.zoo.Dog.fetch", "REFERENCES", "Interface:pkg.zoo.Animal") in edges
    assert ("Method:pkg.zoo.Dog.speak", "CALLS", "Method:pkg.zoo.helper") in edges
    assert ("Directory:/r/pkg", "CONTAINS", "File:/r/pkg/zoo.py") in edges and ("Repository:/r", "CONTAINS", "File:/r/bad.py") in edges
    assert g.nodes.where("full_name = 'pkg.zoo.Dog'").first().external_bases == '["Extern"]'
    refs = spark.createDataFrame([("pkg.zoo.helper", "/r/pkg/zoo.py", 12, 15), ("pkg.zoo.helper", "/r/pkg/zoo.py", 18, 4), ("pkg.zoo.helper", "/r/pkg/zoo.py", 3, 0)], "callee string, file_path string, line int, col int")
    calls = {(r.src, r.dst) for r in build.calls_from_references(g, refs).collect()}
    assert calls == {("Method:pkg.zoo.Dog.speak", "Method:pkg.zoo.helper"), ("Class:pkg.zoo", "Method:pkg.zoo.helper")}


def test_debounce_stream_equals_batch(spark, tmp_path):
    rows = [("/a", "create", "2024-01-01 00:00:00.0"), ("/a", "delete", "2024-01-01 00:00:00.3"), ("/a", "modify", "2024-01-01 00:00:01.0"), ("/b", "modify", "2024-01-01 00:00:00.1"), ("/z", "modify", "2024-01-01 01:00:00.0")]
    events = spark.createDataFrame(rows, "path string, event string, t string").select("path", "event", F.col("t").cast("timestamp").alias("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = {(r.path, r.event, r.events) for r in debounce.debounced(events).collect()}
    assert batch == {("/a", "delete", 2), ("/a", "modify", 1), ("/b", "modify", 1), ("/z", "modify", 1)}
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    got = []
    q = debounce.run(stream, lambda df, _: got.extend((r.path, r.event, r.events) for r in df.collect()), str(tmp_path / "ck"), available_now=True)
    q.awaitTermination(90)
    assert not q.isActive and set(got) == batch - {("/z", "modify", 1)}  # the last burst is open until the watermark passes it
    assert debounce.watched(events.withColumn("path", F.concat("path", F.lit(".py"))), (".py",), "/b").count() == 4


def test_stream_reindexes_a_stored_graph(spark, tmp_path):
    """Two batches of events: a file changes, one is deleted, one comes in; a batch run again changes nothing."""
    from weftgraph.sources.store import GraphStore
    from weftgraph.streaming.reindex import applier

    disk = {"/r/a.py": "def one():\n    return two()\n\ndef two(): pass\n", "/r/p/b.py": "def three(): pass\n"}

    def parsed(paths=None):
        rows = spark.createDataFrame(list(disk.items()), "path string, text string")
        rows = rows if paths is None else rows.join(paths, "path", "left_semi")
        return build.python_graph(python_source.staging(rows, "/r"), "/r")

    store = GraphStore(spark, f"file://{tmp_path}/store")
    assert store.versions() == [] and store.read().nodes.count() == 0
    store.write(parsed(), 1)
    names = lambda: {r.full_name for r in store.read().label("Method").collect()}
    assert names() == {"a.one", "a.two", "p.b.three"}
    disk |= {"/r/a.py": "def one():\n    return 1\n", "/r/q/c.py": "def four(): pass\n"}
    del disk["/r/p/b.py"]
    events = spark.sql("SELECT * FROM VALUES ('/r/a.py', 'modify', timestamp'2024-01-01'), ('/r/p/b.py', 'delete', timestamp'2024-01-01'), ('/r/q/c.py', 'create', timestamp'2024-01-01') AS t(path, event, ts)")
    apply = applier(store, parsed)
    for _ in range(2):
        apply(events, 0)
        assert store.versions() == [1, 2] and names() == {"a.one", "q.c.four"}
    g = store.read()
    assert g.edge("CALLS").count() == 0 and ("Directory:/r/q", "File:/r/q/c.py") in {(r.src, r.dst) for r in g.edge("CONTAINS").collect()}
    apply(events.limit(0), 1)
    assert store.versions() == [1, 2]


def test_store_writes_what_differs(spark, tmp_path):
    """Versions of random graphs: each reads as it was written, a change writes few rows, and old folders go once no version needs them."""
    import random

    from weftgraph.graph import PropertyGraph
    from weftgraph.schema import EDGE_FIELDS, edge_columns, node_columns
    from weftgraph.sources.store import GraphStore

    rng, store = random.Random(1), GraphStore(spark, f"file://{tmp_path}/store", chain=2)
    names = {f"n{k}": 1 for k in range(40)}
    links = {(f"n{k}", f"n{(k * 7 + 1) % 40}", "CALLS", k % 3 or None) for k in range(40)}
    folder = lambda: sorted(x.name for x in (tmp_path / "store").iterdir())
    seen = []
    for version in range(1, 7):
        if version > 1:
            names.pop(rng.choice(sorted(names)))
            names[rng.choice(sorted(names))] = version
            names[f"new{version}"] = version
            links -= set(rng.sample(sorted(links, key=str), 2))
            links |= {(f"new{version}", "n1", "CALLS", None), (f"new{version}", "n1", "REFERENCES", version)}
        nodes = spark.createDataFrame(sorted(names.items()), "id string, at int").select(node_columns(node_id=F.col("id"), kind_label=F.lit("Method"), full_name=F.col("id"), line=F.col("at"), labels=F.array(F.lit("Method"))))
        rows = spark.createDataFrame(sorted(links, key=str), "a string, b string, t string, k int")
        edges = [rows.where(F.col("t") == t).select(edge_columns(F.col("a"), F.col("b"), t, F.col("k").cast("string"))) for t in ("CALLS", "REFERENCES")]
        graph = PropertyGraph(nodes, edges[0].unionByName(edges[1]))
        for _ in range(2):
            store.write(graph, version, version - 1 if version > 1 else None)
        seen.append(folder())
        got = store.read()
        assert got.edges.columns == [*EDGE_FIELDS]
        assert sorted((r.node_id, r.line) for r in got.nodes.collect()) == sorted(names.items())
        assert sorted(((r.src, r.dst, r.type, r.kind) for r in got.edges.collect()), key=str) == sorted(((a, b, t, None if k is None else str(k)) for a, b, t, k in links), key=str)
        assert store.versions()[-2:] == [x for x in (version - 1, version) if x]
    assert seen[2] == ["d00000002-00000001", "d00000003-00000002", "v00000001"] and "v00000004" in seen[3] and seen[5] == ["d00000005-00000004", "d00000006-00000005", "v00000004"]
    assert spark.read.parquet(f"file://{tmp_path}/store/d00000006-00000005/nodes").count() <= 4


JAVA_LOCALS = {
    "a/S.java": "package a;\nimport b.Repo;\nclass S {\n Repo repo;\n Repo mk() { return repo; }\n void go(Repo q) {\n  Repo r = new Repo();\n  r.save(1);\n  q.save(2);\n  repo.save(3);\n  mk().save(4);\n  Util.help();\n"
                "  new Repo().save(5);\n  this.repo.next().save(6);\n  for (Repo each : all()) { each.save(7); }\n  unknown.save(8);\n }\n}\nclass Util { static void help() {} static void help(int n) {} }",
    "b/Repo.java": "package b;\nclass Base { void save(int n) {} }\nclass Repo extends Base { Repo next() { return this; } }", "c/Other.java": "package c;\nclass Other { void save(int n) {} void next() {} }",
}
PYTHON_LOCALS = {
    "app/m.py": "from app.s import S, make\nclass H:\n    def __init__(self, s: 'S | None'):\n        self.s = s\n    def go(self, q: S):\n        q.put(2)\n        self.s.put(3)\n        t = self.s\n        t.put(4)\n        make().put(5)\n        u = make()\n        u.nxt().put(6)\n"
                "def top():\n    s = S()\n    s.put(1)\n    def inner():\n        s.put(7)\n    with S() as w:\n        w.put(8)\n    v = top2()\n    v.put(9)\ndef top2():\n    return top3()\ndef top3():\n    return top2() or S()\ndef loop(a):\n    b = a\n    a = b\n    a.put(1)\n",
    "app/s.py": "class S:\n    def put(self, n): pass\n    def nxt(self) -> 'S': return self\ndef make():\n    x = S()\n    return x\n", "app/o.py": "class O:\n    def put(self, n): pass\n    def nxt(self): pass\n",
}
SCRIPT_LOCALS = {
    "m.ts": "import { S } from './s';\nexport function top(q: S) {\n const s = new S();\n s.put(1);\n q.put(2);\n const u = mk();\n u.put(3);\n let w: S;\n w.put(4);\n}\nfunction mk() { return new S(); }\n",
    "s.ts": "export class S { put(n: number) {} }", "o.ts": "export class O { put(n: number) {} }",
}


@pytest.mark.parametrize(("language", "files", "want"), [
    ("java", JAVA_LOCALS, {("a.S.go(Repo)", "b.Base.save(int)"): 7, ("a.S.go(Repo)", "a.S.mk()"): 1, ("a.S.go(Repo)", "a.Util.help()"): 1, ("a.S.go(Repo)", "b.Repo.next()"): 1}),
    ("python", PYTHON_LOCALS, {("app.m.H.go", "app.s.S.put"): 5, ("app.m.H.go", "app.s.S.nxt"): 1, ("app.m.H.go", "app.s.make"): 2, ("app.m.top", "app.s.S.put"): 2, ("app.m.top.inner", "app.s.S.put"): 1,
                               ("app.m.top", "app.m.top2"): 1, ("app.m.top2", "app.m.top3"): 1, ("app.m.top3", "app.m.top2"): 1}),
    ("typescript", SCRIPT_LOCALS, {("m.top", "s.S.put"): 4, ("m.top", "m.mk"): 1}),
])
def test_calls_go_by_types_of_locals_parameters_and_results(spark, language, files, want):
    """Receivers that no declaration of a field types; 'save' and 'put' are methods of two classes, so names alone say nothing."""
    from weftgraph.sources import brace_source

    rows = spark.createDataFrame([(f"/r/{k}", v) for k, v in files.items()], "path string, text string")
    g = build.source_graph((python_source if language == "python" else brace_source).staging(rows, "/r"), "/r", language)
    got = {(r.src.split(":", 1)[1], r.dst.split(":", 1)[1]): len(r.call_sites) for r in g.edge("CALLS").collect()}
    assert got == want


def test_recorded_answers(spark):
    """Places of a protocol as places of texts: file URIs, lines from 0, columns in UTF-16 units."""
    import json

    from weftgraph.sources import answers

    at = lambda uri, line, character: {"uri": uri, "range": {"start": {"line": line, "character": character}}}
    texts = spark.createDataFrame([("/r/a b/x+y.py", "\U0001f600\U0001f600é = f()\r\nplain f()\n"), ("/r/bin/x.py", "f()"), ("/r/c.py", None)], "path string, text string")
    told = [{"callee": "m.f", "result": [at("file:///r/a%20b/x+y.py", 0, 8), at("file:///r/a%20b/x+y.py", 1, 6), at("file:///r/a%20b/x+y.py", 1, 6), at("file:///r/a%20b/x+y.py", 0, 3), at("file:///r/bin/x.py", 0, 0), at("file:///other/x.py", 0, 0),
                                            at("http://r/x.py", 0, 0), at("file://localhost/r/c.py", 4, 7)]}, {"callee": "m.g", "result": None}]
    rows = spark.createDataFrame([(json.dumps(x),) for x in told] + [("no json",), (None,)], "value string")
    got = sorted(map(tuple, answers.references(rows, texts, "/r/").collect()))
    assert got == [("m.f", "/r/a b/x+y.py", 1, 1), ("m.f", "/r/a b/x+y.py", 1, 6), ("m.f", "/r/a b/x+y.py", 2, 6), ("m.f", "/r/c.py", 5, 7)]
    asked = [{"caller": "m.go", "at": at("file:///r/a%20b/x+y.py", 0, 8), "callee": "Method:m.f"}, {"caller": "m.go", "at": at("file:///r/bin/x.py", 0, 8), "callee": "Method:m.f"}, {"caller": "m.go", "at": at("file:///r/c.py", 0, 0), "callee": None}]
    rows = spark.createDataFrame([(json.dumps(x),) for x in asked], "value string")
    assert list(map(tuple, answers.definitions(rows, texts, "/r").collect())) == [("m.go", 1, 6, "Method:m.f")]
    assert answers.references(rows.limit(0), texts, "/r").count() == 0


def test_one_split_is_parsed_by_many_tasks(spark):
    """A small table of many files is one split: its parsing must not be one task, nor its rows one batch a file."""
    texts = spark.range(0, 400, 1, 1).select(F.concat(F.lit("/r/f"), "id", F.lit(".py")).alias("path"), F.lit("def f():\n    a.b.c()\n").alias("text"))
    rows = python_source.staging(texts, "/r")
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 8
    assert rows.where("what = 'call'").groupBy("name", "target").count().collect() == [("c", "a.b.c", 400)]


def test_names_are_looked_up_once(spark, monkeypatch):
    """One look-up serves receivers and calls; base types alone need neither of them."""
    from weftgraph.operators import resolve
    from weftgraph.operators import types as receiver_types
    from weftgraph.plans.staging import staged

    asked = []
    keep = resolve.type_targets
    monkeypatch.setattr(resolve, "type_targets", lambda *a: asked.append(1) or keep(*a))
    texts = spark.createDataFrame([("/r/a.py", "class A(B):\n    def f(self): self.g()\n    def g(self): pass\nclass B: pass\n")], "path string, text string")
    g = build.source_graph(python_source.staging(texts, "/r"), "/r", "python")
    assert [(r.src, r.dst) for r in g.edge("CALLS").collect()] == [("Method:a.A.f", "Method:a.A.g")]
    assert len(asked) == 3  # of bases, of references, and of all else
    monkeypatch.setattr(receiver_types, "receivers", None)
    _, _, edges, _ = build.typed_structure(staged(python_source.staging(texts, "/r"), "staging", by="what"), "/r", "python")
    assert [(r.src, r.dst, r.type) for r in edges.collect()] == [("Class:a.A", "Class:a.B", "INHERITS")]


def test_folders_are_made_once(spark, monkeypatch):
    """Nodes and edges of a tree are made of one table of folders and files."""
    from weftgraph.plans.staging import staged

    made = []
    monkeypatch.setattr(build, "staged", lambda df, name, **k: made.append(name) or staged(df, name, **k))
    texts = spark.createDataFrame([("/r/x/a.py", "def f(): pass\n"), ("/r/b.py", "")], "path string, text string")
    g = build.structure(python_source.staging(texts, "/r"), "/r", "python")
    assert made.count("folders") == 1
    assert sorted(r.path for r in g.label("File").collect()) == ["/r/b.py", "/r/x/a.py"]
    held = {(r.src, r.dst) for r in g.edge("CONTAINS").collect()}
    assert {("Repository:/r", "File:/r/b.py"), ("Repository:/r", "Directory:/r/x"), ("Directory:/r/x", "File:/r/x/a.py")} <= held


def test_kinds_and_columns_are_those_of_all_staging_rows(spark):
    """who needs some kinds and columns of staging rows gets the same values as by filtering them all, and Python's search for cycles goes on behind it."""
    import gc

    text = "import os\nclass A(B):\n    x: C\n    def f(self, a: D, *, b=1) -> E:\n        return g(a)\n"
    files_ = spark.createDataFrame([("/r/a.py", text), ("/r/b.py", "def ("), ("/r/c.py", None)], "path string, text string")
    kinds, columns = ("base", "call", "error"), ("what", "file_path", "target", "line")
    some = python_source.staging(files_, "/r", kinds, columns).select(*columns)
    every = python_source.staging(files_, "/r").where(F.col("what").isin(*kinds)).select(*columns)
    assert sorted(map(repr, some.collect())) == sorted(map(repr, every.collect())) and some.count() == 3
    assert files_.select("path").mapInPandas(lambda batches: (b.assign(path=str(gc.isenabled())) for b in batches), "path string").distinct().collect() == [("True",)]


@pytest.mark.parametrize("listed", ["", "self", "self, a: x.Y", "a, b: C", "a: Optional[C]", "a, b=1", "a, /, b", "*a, **k", "a, *, b: C=None"])
def test_parameters_read_as_the_unparser_writes_them(listed):
    """plain lists of parameters are written without the unparser."""
    import ast

    args = ast.parse(f"def f({listed}): pass").body[0].args
    assert python_source._parameters(args) == ast.unparse(args)


def test_a_reference_without_a_column_has_one_caller(spark):
    """each place is met with the methods around it once; one without a column is inside of its method and not in the module as well."""
    text = "def helper():\n    pass\ndef user():\n    return helper()\nhelper()\n"
    g = build.structure(python_source.staging(spark.createDataFrame([("/r/a.py", text)], "path string, text string"), "/r"), "/r", "python").staged()
    refs = spark.createDataFrame([("a.helper", "/r/a.py", 4, None), ("a.helper", "/r/a.py", 5, 0), ("a.helper", "/r/a.py", 5, 0), ("a.helper", "/r/a.py", 1, 4)], "callee string, file_path string, line int, col int")
    got = build.reference_sites(g, refs).select("src", "line", "col").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == [("Method:a.user", 4, None), ("Class:a", 5, 0)]


def test_calls_alone_are_those_of_the_graph(spark, monkeypatch):
    """Imports, fields that are inherited, results, stubs and a class that two files hold: the calls need no folders and no CONTAINS edges."""
    from weftgraph.sources import brace_source

    base = "package a;\nclass Repo { void save(int n) { } void save(int n, int m) { } Repo next() { return this; } }\nclass Base { Repo repo; RestTemplate http; void go() { http.put(1); } }\n"
    user = "package b;\nimport a.Repo;\nimport a.Base;\nclass User extends Base { Repo mk() { return new Repo(); } void run(int n, Repo q) { repo.save(1); q.save(1, 2); var v = mk(); v.next().save(3); lost.save(4); go(); } }\n"
    texts = spark.createDataFrame([("/r/a/Base.java", base), ("/r/a/Twice.java", "package a;\nclass Twice { void one() { one(); } }\n"), ("/r/c/Twice.java", "package a;\nclass Twice { void one() { one(); } }\n"), ("/r/b/User.java", user)], "path string, text string")
    parts = []
    keep = build.staged
    with monkeypatch.context() as m:
        m.setattr(build, "staged", lambda df, name, by=None: parts.append(name) or keep(df, name, by))
        got = build.source_calls(brace_source.staging(texts, "/r", build.CALL_KINDS, build.CALL_COLUMNS), "/r", "java")
        got = {(r.src, r.dst, len(r.call_sites)) for r in got.collect()}
    assert not {"folders", "symbols", "edges"} & set(parts)
    want = build.source_graph(brace_source.staging(texts, "/r"), "/r", "java").edge("CALLS").collect()
    run = "Method:b.User.run(int,Repo)"
    assert got == {(r.src, r.dst, len(r.call_sites)) for r in want} == {
        (run, "Method:a.Repo.save(int)", 2), (run, "Method:a.Repo.save(int,int)", 1), (run, "Method:b.User.mk()", 1), (run, "Method:a.Repo.next()", 1), (run, "Method:a.Base.go()", 1),
        ("Method:a.Twice.one()", "Method:a.Twice.one()", 1), ("Method:a.Base.go()", "Method:a.Base.http.put", 1)}
