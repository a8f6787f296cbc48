"""Java, C# and TypeScript sources: staging rows of small files with known answers, broken texts, and the graphs they give."""

from __future__ import annotations

import random

import pytest

from pyspark.sql import functions as F

from weftgraph.functions import texts
from weftgraph.operators import build, imports
from weftgraph.sources import brace_source, python_source

JAVA = '''package com.shop.api;
import com.shop.model.Order;
import com.shop.util.*;
/* class Ghost {} */
@RestController
@RequestMapping("/api/orders")
public class OrderController extends BaseController<Order> implements Auditable, Closeable {
    private static final String URL = "http://stock/api";
    private final OrderService service, other;
    @GetMapping("/{id}")
    public Order get(@PathVariable long id, List<Order> more) {
        String s = "} class Fake {"; // }
        return service.find(id);
    }
    @RequestMapping(value = "/all", method = {RequestMethod.GET, RequestMethod.POST})
    List<Order> all() { return restTemplate.getForObject(URL + "/items/" + id, List.class); }
    public OrderController(OrderService service) { this.service = service; new Helper(1); }
    abstract void close();
    enum State { OPEN, DONE; State next() { return DONE; } }
    record Point(int x, Order y) {}
}
'''
MODEL = "package com.shop.model;\npublic class Order { long find(long id) { return client.get().uri(Paths.STOCK + \"/left\").retrieve(); } }\ninterface Auditable { void log(String s); }\n"
CSHARP = '''using System;
using Json = Newtonsoft.Json;
namespace Shop.Api
{
    [ApiController, Route("api/[controller]")]
    public class UsersController : ControllerBase, IAudit
    {
        public string Name { get; set; } = "x";
        public int Total => items.Count;
        private readonly IStore _store = new Store();
        [HttpGet("{id:int}")]
        public async Task<User> Get(int id, [FromQuery] Page<User> page) { var r = await _client.GetFromJsonAsync<User>($"/stock/{id}"); return Map(r); }
        [HttpPost] public IActionResult Add(User u) => Ok(u);
        [HttpDelete("~/gone/{id}")] public void Drop(int id) { }
        public static void Map(WebApplication app) { app.MapGet("/ping/{id}", () => 1); }
    }
    public interface IAudit { void Log(string s); }
    public record User(int Id, Page<User> Rest);
    enum E { A, B }
}
'''
SCRIPT = '''
import express, { Router as R, type Foo } from 'express';
import { Food, ROOT } from "./sub/food";
import { Pet } from '@/lib/pet'
import './side';
const BASE = '/api/v1'
export interface Animal { name: string; speak(a: Food): Sound; }
export abstract class Dog extends Base<Animal> implements Animal, Pet {
  private legs: Leg[] = [];
  owner?: Person
  static count = 0;
  constructor(private api: Api) { super(); }
  async fetchIt(id: string): Promise<Bone> {
    const r = /[{"]/.test(id);
    await axios.post(`${BASE}/bones/${id}`, { a: 1 });
    return helper(id);
  }
  handler = async (e: Evt) => { this.fetchIt(e.id); }
}
export function helper(x: string): Bone { return fetch(ROOT + '/x', { method: 'DELETE' }); }
const arrow = (a: Food): Bone => { helper('a'); };
export const short = async x => helper(x);
app.get('/users/:id', helper);
router.post('/users', (req, res) => { arrow(req.body) });
enum Color { Red, Green }
'''


def rows(path: str, text: str, what: str, *columns: str) -> list[tuple]:
    return [tuple(r.get(c) for c in columns) for r in brace_source.parse(path, text, "/r") if r["what"] == what]


def test_java():
    own = "com.shop.api.OrderController"
    symbols = {n: (k, t) for n, k, t in rows("/r/a/O.java", JAVA, "symbol", "full_name", "kind", "type_name")}
    assert symbols == {
        own: ("class", None), f"{own}.URL": ("field", "String"), f"{own}.service": ("field", "OrderService"), f"{own}.other": ("field", "OrderService"), f"{own}.get(long,List)": ("method", "Order"),
        f"{own}.all()": ("method", "List<Order>"), f"{own}.OrderController(OrderService)": ("method", symbols[f"{own}.OrderController(OrderService)"][1]), f"{own}.close()": ("method", "void"),
        f"{own}.State": ("enum", None), f"{own}.State.next()": ("method", "State"), f"{own}.Point": ("record", None), f"{own}.Point.x": ("property", "int"), f"{own}.Point.y": ("property", "Order"),
    }
    assert rows("/r/a/O.java", JAVA, "base", "target", "col") == [("BaseController", 0), ("Auditable", 1), ("Closeable", 2)]
    assert rows("/r/a/O.java", JAVA, "endpoint", "full_name", "kind", "target") == [(f"{own}.get(long,List)", "GET", "/api/orders/{id}"), (f"{own}.all()", "GET", "/api/orders/all"), (f"{own}.all()", "POST", "/api/orders/all")]
    assert rows("/r/a/O.java", JAVA, "client_call", "full_name", "kind", "target") == [(f"{own}.all()", "GET", "http://stock/api/items/{id}")]
    assert rows("/r/a/O.java", JAVA, "call", "target", "line") == [("service.find", 13), ("restTemplate.getForObject", 16), ("Helper", 17)]
    assert rows("/r/a/O.java", JAVA, "import", "target", "kind") == [("com.shop.model.Order", "Order"), ("com.shop.util", "*")]
    assert [n for n, a in rows("/r/a/O.java", JAVA, "symbol", "name", "is_abstract") if a] == ["close"]


def test_csharp():
    own = "Shop.Api.UsersController"
    symbols = {n: k for n, k in rows("/r/U.cs", CSHARP, "symbol", "full_name", "kind")}
    assert symbols == {
        own: "class", f"{own}.Name": "property", f"{own}.Total": "property", f"{own}._store": "field", f"{own}.Get(int,Page)": "method", f"{own}.Add(User)": "method", f"{own}.Drop(int)": "method",
        f"{own}.Map(WebApplication)": "method", "Shop.Api.IAudit": "interface", "Shop.Api.IAudit.Log(string)": "method", "Shop.Api.User": "record", "Shop.Api.User.Id": "property",
        "Shop.Api.User.Rest": "property", "Shop.Api.E": "enum",
    }
    assert rows("/r/U.cs", CSHARP, "endpoint", "kind", "target") == [("GET", "/api/users/{id:int}"), ("POST", "/api/users"), ("DELETE", "/gone/{id}"), ("GET", "/ping/{id}")]
    assert rows("/r/U.cs", CSHARP, "client_call", "kind", "target") == [("GET", "/stock/{id}")]
    assert rows("/r/U.cs", CSHARP, "import", "target", "name", "kind") == [("System", "System", "*"), ("Newtonsoft.Json", "Json", "Json")]
    assert rows("/r/V.cs", "namespace A.B;\nclass C { int x; }", "symbol", "full_name") == [("A.B.C",), ("A.B.C.x",)]


def test_typescript():
    symbols = {n.removeprefix("web.d"): k for n, k in rows("/r/web/d.ts", SCRIPT, "symbol", "full_name", "kind")}
    assert symbols == {
        "": "module", ".Animal": "interface", ".Animal.name": "field", ".Animal.speak": "method", ".Dog": "abstract_class", ".Dog.legs": "field", ".Dog.owner": "field", ".Dog.count": "field",
        ".Dog.constructor": "method", ".Dog.fetchIt": "method", ".Dog.handler": "method", ".helper": "method", ".arrow": "method", ".short": "method", ".Color": "enum",
    }
    assert rows("/r/web/d.ts", SCRIPT, "endpoint", "full_name", "kind", "target") == [("web.d.helper", "GET", "/users/:id"), ("web.d", "POST", "/users")]
    assert rows("/r/web/d.ts", SCRIPT, "client_call", "full_name", "kind", "target") == [("web.d.Dog.fetchIt", "POST", "/api/v1/bones/{id}"), ("web.d.helper", "DELETE", "{ROOT}/x")]
    assert ("web.d.Dog.handler", "this.fetchIt") in rows("/r/web/d.ts", SCRIPT, "call", "full_name", "target")
    assert rows("/r/web/d.ts", SCRIPT, "import", "target", "kind", "name")[:3] == [("express", "default", "express"), ("express", "Router", "R"), ("express", "Foo", "Foo")]


@pytest.mark.parametrize(("path", "text"), [("/r/O.java", JAVA), ("/r/U.cs", CSHARP), ("/r/d.ts", SCRIPT)])
def test_any_text_is_read(path, text):
    chance = random.Random(7)
    for k in range(0, len(text), 7):
        brace_source.parse(path, text[:k], "/r")
        brace_source.parse(path, text[k:], "/r")
    for _ in range(200):
        broken = list(text)
        for _ in range(chance.randint(1, 30)):
            broken[chance.randrange(len(broken))] = chance.choice(["", "{", "}", "(", ")", "<", ">", '"', "'", "`", ";", "=", "=>", "/", "[", "]", ",", ":", "@", "$"])
        brace_source.parse(path, "".join(broken), "/r")
    brace_source.parse(path, "class A{" * 5000, "/r")
    assert brace_source.parse("/r/none.txt", text, "/r") == []


def test_aliases():
    config = '{ // paths\n "compilerOptions": {"paths": {"@/*": ["./src/*"], "~lib": ["x"], "#/*": ["own/*",],}, /* end */ }}'
    assert imports.path_aliases(config) == (("@/", "src/"), ("#/", "own/"))
    assert imports.path_aliases(config, "web") == (("@/", "web/src/"), ("#/", "web/own/"))
    assert imports.path_aliases("nothing") == () and imports.path_aliases("[]") == ()


GROUPS = '''namespace Shop;
public class Create : Endpoint<Request, Response> {
    public override void Configure() { Verbs(Http.POST, Http.PUT); Routes("/a", "/b/{id}"); Get("c"); }
    public override async Task HandleAsync(Request r, CancellationToken c) { Get("/not/a/route"); await http.PostAsync("/stock", r); }
}
public class Todos : EndpointGroupBase {
    public override void Map(WebApplication app) { app.MapGroup(this).MapGet(All).MapPost(Add, "{id}").MapDelete("/x", () => 1); }
    public Task<List<Todo>> All(ISender s) => s.Send();
    public int Add(ISender s) { return 1; }
}
'''


def test_configured_endpoints():
    handle, todos = "Shop.Create.HandleAsync(Request,CancellationToken)", "Shop.Todos"
    assert set(rows("/r/G.cs", GROUPS, "endpoint", "full_name", "kind", "target")) == {
        *((handle, v, t) for v in ("POST", "PUT") for t in ("/a", "/b/{id}")), (handle, "GET", "/c"),
        (f"{todos}.All(ISender)", "GET", "/"), (f"{todos}.Add(ISender)", "POST", "/{id}"), (f"{todos}.Map(WebApplication)", "DELETE", "/x"),
    }
    assert rows("/r/G.cs", GROUPS, "client_call", "full_name", "kind", "target") == [(handle, "POST", "/stock")]


def test_python_views_and_constants(spark):
    text = "from .base import ROOT\nclass ItemViewSet(viewsets.ModelViewSet):\n    def list(self): pass\n    def retrieve(self): pass\n    def other(self): pass\nclass PingView(APIView):\n    async def post(self): return requests.get(ROOT + '/x')\n@api_view(['GET', 'PUT'])\ndef health(r): pass\n"
    staging = python_source.staging(spark.createDataFrame([("/r/p/v.py", text), ("/r/p/base.py", "ROOT = '/stock'\n")], "path string, text string"), "/r")
    found = {(r.full_name, r.kind, r.target) for r in staging.where("what = 'endpoint'").collect()}
    assert found == {("p.v.ItemViewSet.list", "GET", "/item"), ("p.v.ItemViewSet.retrieve", "GET", "/item/{id}"), ("p.v.PingView.post", "POST", "/ping"), ("p.v.health", "GET", "/health"), ("p.v.health", "PUT", "/health")}
    assert ("Method:p.v.PingView.post", "HTTP_CALLS", "Endpoint:GET /stock/x") in edges(build.python_graph(staging, "/r"))


def test_texts(spark):
    html = "<p>a &lt;b&gt; <b>c</b><!-- <i>gone</i> --></p>\n <br/> d&nbsp;&amp;e 1 < 2"
    row = spark.range(1).select(texts.markup_text(F.lit(html)).alias("t"), texts.version(F.lit("2.x")).alias("v"), texts.at_least(F.lit("none"), 0, 1).alias("a"), texts.symbol_kind(F.lit("java"), F.lit(99)).alias("k")).first()
    assert (row.t, row.v, row.a, row.k) == ("a <b> c d &e 1 < 2", [2], False, None)


def edges(g) -> set[tuple]:
    return {(r.src, r.type, r.dst) for r in g.edges.collect()}


def test_java_graph(spark):
    texts = [("/r/a/O.java", JAVA), ("/r/m/Order.java", MODEL), ("/r/m/Paths.java", 'package com.shop.model;\nclass Paths { static final String STOCK = "/stock"; }'), ("/r/Empty.java", ""), ("/r/Null.java", None)]
    g = build.source_graph(brace_source.staging(spark.createDataFrame(texts, "path string, text string"), "/r"), "/r", "java")
    found, own = edges(g), "com.shop.api.OrderController"
    assert {
        ("Package:com.shop.api", "CONTAINS", f"Class:{own}"), (f"Class:{own}", "IMPLEMENTS", "Interface:com.shop.model.Auditable"), ("File:/r/a/O.java", "IMPORTS", "Class:com.shop.model.Order"),
        (f"Method:{own}.get(long,List)", "CALLS", "Method:com.shop.model.Order.find(long)"), (f"Method:{own}.get(long,List)", "SERVES", "Endpoint:GET /api/orders/{id}"),
        ("Method:com.shop.model.Order.find(long)", "HTTP_CALLS", "Endpoint:GET /stock/left"), ("Repository:/r", "CONTAINS", "Endpoint:GET /stock/left"),
    } <= found
    assert g.nodes.where(f"full_name = '{own}'").first().external_bases == '["BaseController","Closeable"]'
    assert g.nodes.groupBy("node_id").count().where("count > 1").count() == 0


def test_typescript_graph(spark):
    texts = [("/r/web/d.ts", SCRIPT), ("/r/web/sub/food.ts", "export class Food { }\nexport const ROOT = '/api/users'\n"), ("/r/src/lib/pet.tsx", "export interface Pet { walk(): void }"),
             ("/r/src/use/index.ts", "import { Dog } from '../../web/d'\nimport * as all from '@/lib/pet'\n")]
    g = build.source_graph(brace_source.staging(spark.createDataFrame(texts, "path string, text string"), "/r"), "/r", "typescript", imports.path_aliases('{"compilerOptions": {"paths": {"@/*": ["./src/*"]}}}'))
    assert {
        ("File:/r/web/d.ts", "IMPORTS", "Class:web.sub.food.Food"), ("File:/r/web/d.ts", "IMPORTS", "Interface:src.lib.pet.Pet"), ("File:/r/src/use/index.ts", "IMPORTS", "Class:web.d.Dog"),
        ("File:/r/src/use/index.ts", "IMPORTS", "Class:src.lib.pet"), ("Class:web.d.Dog", "IMPLEMENTS", "Interface:src.lib.pet.Pet"), ("Method:web.d.helper", "SERVES", "Endpoint:GET /users/{id}"),
        ("Method:web.d.helper", "HTTP_CALLS", "Endpoint:DELETE /api/users/x"), ("Method:web.d.Dog.handler", "CALLS", "Method:web.d.Dog.fetchIt"),
    } <= edges(g)
    empty = build.source_graph(brace_source.staging(spark.createDataFrame([], "path string, text string"), "/r"), "/r", "csharp")
    assert empty.nodes.count() == 1 and empty.edges.count() == 0


def _graph(spark, language, files, **more):
    rows = spark.createDataFrame([(f"/r/{k}", v) for k, v in files.items()], "path string, text string")
    source = python_source if language == "python" else brace_source
    return build.source_graph(source.staging(rows, "/r"), "/r", language, **more)


def _edges(g, type_):
    return {(r.src.split(":", 1)[1], r.dst.split(":", 1)[1]) for r in g.edge(type_).collect()}


def test_each_cache_implements_its_own_interface(spark):
    files = {f"{n}/{f}.cs": f"namespace {n};\npublic {k}" for n in ("Alpha", "Beta", "Gamma") for f, k in (("Cache", "class Cache : ICache { public void Get(int k) { Load(k); } void Load(int k) { } }"), ("ICache", "interface ICache { void Get(int k); }"))}
    files["Delta/User.cs"] = "using Beta;\nnamespace Delta;\npublic class User : Cache, Unknown { private readonly ICache store; void Go() { store.Get(1); this.Get(2); Gamma.Cache.Make(); } }\npublic class Lost : Hidden.ICache { }"
    files["Gamma/More.cs"] = "namespace Gamma;\npublic class Far : Alpha.Cache { }\npublic class Two : Far, Cache { }"
    g = _graph(spark, "csharp", files)
    assert _edges(g, "IMPLEMENTS") == {(f"{n}.Cache", f"{n}.ICache") for n in ("Alpha", "Beta", "Gamma")}
    assert _edges(g, "INHERITS") == {("Delta.User", "Beta.Cache"), ("Gamma.Far", "Alpha.Cache"), ("Gamma.Two", "Gamma.Far")}  # only the first base is a class's
    assert {r.full_name: r.external_bases for r in g.nodes.where("external_bases IS NOT NULL").collect()} == {"Delta.User": '["Unknown"]'}
    assert _edges(g, "CALLS") == {(f"{n}.Cache.Get(int)", f"{n}.Cache.Load(int)") for n in ("Alpha", "Beta", "Gamma")} | {("Delta.User.Go()", "Beta.ICache.Get(int)"), ("Delta.User.Go()", "Beta.Cache.Get(int)")}


def test_python_calls_go_by_scope_field_assignment_and_import(spark):
    files = {
        "app/store.py": "class Store:\n    def save(self): pass\n    def load(self): return self.save()\ndef make(): pass\n",
        "app/other.py": "class Store:\n    def save(self): pass\ndef make(): pass\ndef go():\n    def inner(): pass\n    inner()\n    make()\n",
        "app/main.py": "from typing import TYPE_CHECKING\nfrom app.store import Store, make as build\nimport app.other as o\nif TYPE_CHECKING:\n    build()\nclass Base:\n    db: Store\n    def shared(self): pass\n"
                       "class Main(Base):\n    def __init__(self):\n        self.two = o.Store()\n    def run(self):\n        self.db.save()\n        self.two.save()\n        self.shared()\n        build()\n        o.make()\n        shared()\no.go()\n",
    }
    g = _graph(spark, "python", files)
    calls = _edges(g, "CALLS")
    run = {b for a, b in calls if a == "app.main.Main.run"}
    assert run == {"app.store.Store.save", "app.other.Store.save", "app.main.Base.shared", "app.store.make", "app.other.make"}
    assert ("app.store.Store.load", "app.store.Store.save") in calls and ("app.other.go", "app.other.go.inner") in calls and ("app.other.go", "app.other.make") in calls
    assert ("app.main", "app.other.go") in calls and ("app.main", "app.store.make") not in calls  # what is for compile time alone calls nothing
    assert _edges(g, "INHERITS") == {("app.main.Main", "app.main.Base")}


def test_java_stubs_markers_and_definitions(spark):
    files = {"a/Svc.java": "package a;\nimport b.Repo;\nclass Svc { private RestTemplate http; private Repo repo; void go(int n) { http.getForObject(\"/x\"); this.http.noSuch(); repo.find(n); odd.find(2); } }",
             "b/Repo.java": "package b;\ninterface Repo { Item find(int n); }", "c/Repo.java": "package c;\ninterface Repo { Item find(int n); }"}
    g = _graph(spark, "java", files)
    assert _edges(g, "CALLS") == {("a.Svc.go(int)", "a.Svc.http.getForObject"), ("a.Svc.go(int)", "b.Repo.find(int)")}
    stub = g.nodes.where("stub").first()
    assert (stub.full_name, stub.name, stub.file_path, stub.language) == ("a.Svc.http.getForObject", "getForObject", "", "java")
    site = g.nodes.sparkSession.createDataFrame([("a.Svc.go(int)", "Method:c.Repo.find(int)")], "caller string, callee string")
    rows = spark.createDataFrame([(f"/r/{k}", v) for k, v in files.items()], "path string, text string")
    staging = brace_source.staging(rows, "/r")
    odd = staging.where("what = 'call' AND target = 'odd.find'").select("line", "col")
    g = build.source_graph(staging, "/r", "java", definitions=site.crossJoin(odd).select("caller", "line", "col", "callee"))
    assert ("a.Svc.go(int)", "c.Repo.find(int)") in _edges(g, "CALLS")
    marks = spark.createDataFrame([("/r/a/Svc.java", "Svc.go", '["Override","static"]'), ("/r/b/Repo.java", "find", '["abstract"]'), ("/r/b/Repo.java", "Nope", "[]"), ("/r/a/Svc.java", "go", '["late"]')], "file_path string, name string, attributes string")
    out = {r.full_name: (r.attributes, r.is_static, r.is_abstract) for r in build.with_attributes(g, marks.where("attributes <> '[\"late\"]'")).label("Method").collect()}
    assert out["a.Svc.go(int)"] == ('["Override","static"]', True, False) and out["b.Repo.find(int)"][::2] == ('["abstract"]', True) and out["c.Repo.find(int)"][0] == "[]"


def test_markup_elements_call_components(spark):
    files = {"ui/hello.tsx": "export function Hello(p: Props) { return <b>hi</b>; }\nexport const Big = () => { return (<Hello name={1} />); };",
             "ui/app.tsx": "import { Hello } from './hello';\nimport { Big as Large } from './hello';\nexport function App() { const n = a < Hello; return <div>{ok ? <Hello /> : <Large>x</Large>}</div>; }"}
    g = _graph(spark, "typescript", files)
    assert _edges(g, "CALLS") == {("ui.hello.Big", "ui.hello.Hello"), ("ui.app.App", "ui.hello.Hello"), ("ui.app.App", "ui.hello.Big")}
    staging = brace_source.staging(spark.createDataFrame([(f"/r/{k}", v) for k, v in files.items()], "path string, text string"), "/r")
    elements = staging.where("kind = 'element'")
    refs = spark.createDataFrame([("ui.hello.Hello", "/r/ui/app.tsx", 1, 9), ("ui.hello.Hello", "/r/ui/hello.tsx", 1, 16), ("ui.hello.Big", "/r/ui/app.tsx", 2, 9)], "callee string, file_path string, line int, col int")
    calls = {(r.src, r.dst) for r in build.calls_from_references(g, refs, elements=elements).collect()}
    assert calls == {("Method:ui.app.App", "Method:ui.hello.Hello"), ("Class:ui.app", "Method:ui.hello.Big")}
    blocks = spark.createDataFrame([("/r/ui/app.tsx", 2, 2)], "file_path string, line int, end_line int")
    calls = {(r.src, r.dst) for r in build.calls_from_references(g, refs, blocks, elements).collect()}
    assert calls == {("Method:ui.app.App", "Method:ui.hello.Hello")}


def test_long_headers_and_brackets_lose_nothing():
    many = ", ".join(f"Type{k}" for k in range(40))
    text = f"class A {{ void f() {{ make<{many}>(1); }} }}"
    assert [r["name"] for r in brace_source.parse("/r/a.cs", text, "/r") if r["what"] == "call"] == ["make"]
    kinds = "|".join(f"{{a{k}: string}}" for k in range(60))
    rows = brace_source.parse("/r/a.ts", f"export const f = (x: number): {kinds} => {{ return g(x); }};", "/r")
    assert [r["full_name"] for r in rows if r["what"] == "symbol" and r["kind"] == "method"] == ["a.f"]
    rows = brace_source.parse("/r/b.cs", "class B { void g() { if (x [ [ [ [ ( ; } void h() { k(); } }", "/r")
    assert {"B.g()", "B.h()"} <= {r["full_name"] for r in rows if r["what"] == "symbol"}
