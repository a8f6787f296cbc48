"""Edges that follow from other edges, as set operations. all_derived() runs them in the order of their needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.predicates import has_attribute, is_test
from weftgraph.functions.routes import match_calls
from weftgraph.graph import PropertyGraph
from weftgraph.plans.expand import closure, reach
from weftgraph.plans.staging import staged
from weftgraph.schema import EDGE_FIELDS, edge_columns, node_columns, node_id

CSHARP_TESTS = ("Fact", "Theory", "TestMethod", "DataTestMethod", "Test", "TestCase")
INHERITED_LEVELS = 5

# Interfaces of repositories whose methods a framework supplies, and these methods.
REPOSITORY_BASES = ("JpaRepository", "CrudRepository", "PagingAndSortingRepository", "MongoRepository", "ReactiveCrudRepository")
REPOSITORY_METHODS = ("save", "saveAll", "saveAndFlush", "findById", "findAll", "findAllById", "existsById", "count", "delete", "deleteAll", "deleteById",
                      "deleteAllById", "deleteAllInBatch", "deleteInBatch", "flush", "getOne", "getReferenceById")


def _members(g: PropertyGraph, label: str) -> DataFrame:
    """(owner, name, method): methods of classes or interfaces. Of equal names in one owner the last full name counts."""
    owners = g.label(label).select(F.col("node_id").alias("owner"))
    methods = g.label("Method").select(F.col("node_id").alias("method"), "name", "full_name")
    rows = g.edge("CONTAINS").select(F.col("src").alias("owner"), F.col("dst").alias("method")).join(owners, "owner").join(methods, "method")
    return rows.groupBy("owner", "name").agg(F.max_by("method", "full_name").alias("method"))


def transitive_implements(g: PropertyGraph) -> DataFrame:
    """IMPLEMENTS of the interfaces that an implemented interface inherits from."""
    interfaces = g.label("Interface").select(F.col("node_id").alias("node"))
    have = g.edge("IMPLEMENTS").select(F.col("src").alias("cls"), F.col("dst").alias("start"))
    up = reach(g.edge("INHERITS"), have.select(F.col("start").alias("node")), INHERITED_LEVELS).join(interfaces, "node", "left_semi")
    new = have.join(up, "start").select("cls", F.col("node").alias("ifc")).distinct()
    new = new.join(have.withColumnRenamed("start", "ifc"), ["cls", "ifc"], "left_anti")
    return new.select(edge_columns(F.col("cls"), F.col("ifc"), "IMPLEMENTS"))


def method_implements(g: PropertyGraph) -> tuple[DataFrame, DataFrame]:
    """Method IMPLEMENTS by name over classes' IMPLEMENTS, and the inverse DISPATCHES_TO."""
    pairs = g.edge("IMPLEMENTS").select(F.col("src").alias("cls"), F.col("dst").alias("ifc"))
    own = _members(g, "Class").withColumnsRenamed({"owner": "cls", "method": "m"})
    contract = _members(g, "Interface").withColumnsRenamed({"owner": "ifc", "method": "im"})
    hit = pairs.join(own, "cls").join(contract, ["ifc", "name"]).select("m", "im").distinct()
    return hit.select(edge_columns(F.col("m"), F.col("im"), "IMPLEMENTS")), hit.select(edge_columns(F.col("im"), F.col("m"), "DISPATCHES_TO"))


def abstract_dispatch(g: PropertyGraph) -> DataFrame:
    """DISPATCHES_TO from an abstract method to the method of that name in a direct heir."""
    abstract = g.label("Method").where("is_abstract").select(F.col("node_id").alias("pm"))
    up = g.edge("INHERITS").select(F.col("src").alias("child"), F.col("dst").alias("parent"))
    members = _members(g, "Class")
    parents = members.withColumnsRenamed({"owner": "parent", "method": "pm"}).join(abstract, "pm", "left_semi")
    hit = up.join(parents, "parent").join(members.withColumnsRenamed({"owner": "child", "method": "cm"}), ["child", "name"]).select("pm", "cm").distinct()
    return hit.select(edge_columns(F.col("pm"), F.col("cm"), "DISPATCHES_TO"))


def structural_dispatch(g: PropertyGraph) -> DataFrame:
    """DISPATCHES_TO of Python interfaces to classes that have all their methods without saying so: a relational division.

    Candidates are the classes that have an interface's rarest method, so that names that everything has ("get", "run")
    multiply nothing; each is then held against the whole contract.
    """
    python = g.label("Interface").where("language = 'python'").select(F.col("node_id").alias("ifc"))
    contract = staged(_members(g, "Interface").withColumnsRenamed({"owner": "ifc", "method": "im"}).join(python, "ifc", "left_semi"), "contracts")
    own = staged(_members(g, "Class").withColumnsRenamed({"owner": "cls", "method": "m"}), "members")
    often = own.groupBy("name").agg(F.count(F.lit(1)).alias("often"))
    rarest = contract.join(often, "name", "left").groupBy("ifc").agg(
        F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "name")).alias("r"), F.count(F.lit(1)).alias("need")
    ).select("ifc", "r.name", "need")
    said = g.edge("IMPLEMENTS").select(F.col("src").alias("cls"), F.col("dst").alias("ifc"))
    pairs = own.join(rarest, "name").select("cls", "ifc", "need").join(said, ["cls", "ifc"], "left_anti")
    shared = staged(pairs.join(contract, "ifc").join(own, ["cls", "name"]), "shared-methods")
    full = shared.groupBy("cls", "ifc").agg(F.count(F.lit(1)).alias("have"), F.min("need").alias("need")).where("have = need")
    return shared.join(full.select("cls", "ifc"), ["cls", "ifc"], "left_semi").select("im", "m").distinct().select(edge_columns(F.col("im"), F.col("m"), "DISPATCHES_TO"))


def overrides(g: PropertyGraph) -> DataFrame:
    """OVERRIDES of equal names along INHERITS of classes, at any distance."""
    classes = g.label("Class").select(F.col("node_id").alias("node"))
    up = g.edge("INHERITS").join(classes.withColumnRenamed("node", "src"), "src", "left_semi")
    pairs = closure(up).select(F.col("start").alias("child"), F.col("node").alias("parent")).where("child <> parent")
    methods = g.label("Method").select(F.col("node_id").alias("method"), "name")
    members = g.edge("CONTAINS").select(F.col("src").alias("owner"), F.col("dst").alias("method")).join(methods, "method")
    members = members.join(classes.withColumnRenamed("node", "owner"), "owner", "left_semi")
    hit = pairs.join(members.withColumnsRenamed({"owner": "child", "method": "cm"}), "child").join(members.withColumnsRenamed({"owner": "parent", "method": "pm"}), ["parent", "name"])
    return hit.where("cm <> pm").select("cm", "pm").distinct().select(edge_columns(F.col("cm"), F.col("pm"), "OVERRIDES"))


def tests(g: PropertyGraph) -> DataFrame:
    """TESTS from CALLS of test methods in test files to other methods; what makes a test method differs by language."""
    m = g.label("Method").select("node_id", "name", "file_path", "language", "attributes")
    a, lang = F.col("attributes"), F.col("language")
    rule = (
        F.when(lang == "python", F.startswith("name", F.lit("test_"))).when(lang == "typescript", True)
        .when(lang == "csharp", has_attribute(a, CSHARP_TESTS)).when(lang == "java", has_attribute(a, ("test",))).otherwise(False)
    )
    callers = m.where(is_test(F.col("file_path")) & rule).select(F.col("node_id").alias("src"))
    callees = m.where(~is_test(F.col("file_path"))).select(F.col("node_id").alias("dst"))
    hit = g.edge("CALLS").select("src", "dst").join(callers, "src", "left_semi").join(callees, "dst", "left_semi")
    return hit.select(edge_columns(F.col("src"), F.col("dst"), "TESTS"))


def callback_calls(g: PropertyGraph) -> DataFrame:
    """CALLS from an owner to its methods whose names end in 'callback'."""
    m = g.label("Method").where("lower(name) LIKE '%callback'").select(F.col("node_id").alias("dst"))
    owners = g.label("Class", "Method").select(F.col("node_id").alias("src"))
    hit = g.edge("CONTAINS").select("src", "dst").join(m, "dst", "left_semi").join(owners, "src", "left_semi")
    return hit.select(edge_columns(F.col("src"), F.col("dst"), "CALLS"))


def repository_stubs(g: PropertyGraph) -> PropertyGraph:
    """Stub methods of interfaces that inherit from a framework's repository: (nodes, CONTAINS edges)."""
    bases = g.nodes.where(F.col("name").isin(*REPOSITORY_BASES)).select(F.col("node_id").alias("dst"))
    heirs = g.edge("INHERITS").select("src", "dst").join(bases, "dst", "left_semi").select(F.col("src").alias("node_id")).distinct()
    ifc = g.label("Interface").join(heirs, "node_id", "left_semi").select(F.col("node_id").alias("owner"), "full_name", "language")
    rows = ifc.select("*", F.explode(F.array(*map(F.lit, REPOSITORY_METHODS))).alias("stub_name")).withColumn("fn", F.concat("full_name", F.lit("."), "stub_name"))
    have = g.label("Method").select(F.col("full_name").alias("fn"))
    rows = rows.join(have, "fn", "left_anti")
    nodes = rows.select(node_columns(node_id=node_id("Method", F.col("fn")), labels=F.array(F.lit("Method")), kind_label=F.lit("Method"), full_name=F.col("fn"), name=F.col("stub_name"),
                                     signature=F.concat("stub_name", F.lit("()")), file_path=F.lit(""), line=F.lit(0), end_line=F.lit(0), language=F.col("language"), stub=F.lit(True)))
    return PropertyGraph(nodes, rows.select(edge_columns(F.col("owner"), node_id("Method", F.col("fn")), "CONTAINS")))


def endpoint_nodes(ends: DataFrame) -> DataFrame:
    """Nodes of endpoints (http_method, route)."""
    name = F.concat("http_method", F.lit(" "), "route")
    return ends.select(node_columns(node_id=node_id("Endpoint", name), labels=F.array(F.lit("Endpoint")), kind_label=F.lit("Endpoint"), name=name, route=F.col("route"), http_method=F.col("http_method")))


def http_edges(definitions: DataFrame, calls: DataFrame) -> PropertyGraph:
    """Endpoint nodes with SERVES and HTTP_CALLS edges from definitions and client calls."""
    matched = match_calls(definitions, calls)
    served = definitions.select("http_method", "route", "handler")
    ends = served.select("http_method", "route").unionByName(matched.select("http_method", F.col("ep_route").alias("route"))).distinct()
    key = lambda r: node_id("Endpoint", F.concat("http_method", F.lit(" "), r))
    nodes = endpoint_nodes(ends)
    # Of equal endpoints the first definition serves.
    first = definitions.groupBy("http_method", "route").agg(F.min_by("handler", "def_ord").alias("handler"))
    serves = first.select(edge_columns(node_id("Method", F.col("handler")), key(F.col("route")), "SERVES"))
    site = F.struct(F.col("line").cast("int").alias("line"), F.col("col").cast("int").alias("col"))
    by = matched.groupBy("caller", "http_method", "ep_route").agg(F.array_sort(F.collect_set(site)).alias("sites"))
    return PropertyGraph(nodes, serves.unionByName(by.select(edge_columns(node_id("Method", F.col("caller")), key(F.col("ep_route")), "HTTP_CALLS", call_sites=F.col("sites")))))


def definitions_from_graph(g: PropertyGraph) -> tuple[DataFrame, DataFrame]:
    """Definitions and calls as the edges have them (calls stand at their method's line, column 0), to match anew after a sync."""
    ep = g.label("Endpoint").select(F.col("node_id").alias("dst"), "route", "http_method")
    m = g.label("Method").select(F.col("node_id").alias("src"), F.col("full_name").alias("fn"), "line")
    served = g.edge("SERVES").select("src", "dst").join(ep, "dst").join(m, "src")
    called = g.edge("HTTP_CALLS").select("src", "dst").join(ep, "dst").join(m, "src")
    order = F.xxhash64("http_method", "route", "fn")
    return (
        served.select("route", "http_method", F.col("fn").alias("handler"), order.alias("def_ord")),
        called.select("route", "http_method", F.col("fn").alias("caller"), "line", F.lit(0).alias("col"), order.alias("call_ord")),
    )


def after_sync(g: PropertyGraph) -> PropertyGraph:
    """The graph with its HTTP edges matched anew and TESTS built anew, as files came and went. Endpoints that nothing serves or
    calls any more go; new ones belong to the first repository."""
    http = http_edges(*definitions_from_graph(g))
    ends = staged(http.nodes, "endpoints")
    kept = g.edges.where(~F.col("type").isin("SERVES", "HTTP_CALLS", "TESTS"))
    old = g.label("Endpoint").select(F.col("node_id").alias("dst"))
    held = kept.join(old, "dst", "left_semi").join(ends.select(F.col("node_id").alias("dst")), "dst", "left_semi").select(*EDGE_FIELDS)
    other = kept.join(old, "dst", "left_anti").select(*EDGE_FIELDS)
    fresh = ends.select("node_id").join(held.select(F.col("dst").alias("node_id")), "node_id", "left_anti")
    root = F.broadcast(g.label("Repository").agg(F.min("node_id").alias("repo")))  # one row
    more = fresh.join(root).where("repo IS NOT NULL").select(edge_columns(F.col("repo"), F.col("node_id"), "CONTAINS"))
    nodes = g.nodes.where("kind_label <> 'Endpoint'").unionByName(ends.select(g.nodes.columns))
    return PropertyGraph(nodes, other.unionByName(held).unionByName(more)).with_edges(http.edges, tests(g))


def all_derived(g: PropertyGraph, http: PropertyGraph | None = None) -> PropertyGraph:
    """The graph with every derived edge."""
    more = derived(g, http)
    return PropertyGraph(g.nodes.unionByName(more.nodes) if http is not None else g.nodes, g.edges.unionByName(more.edges))


def derived(g: PropertyGraph, http: PropertyGraph | None = None) -> PropertyGraph:
    """What all_derived() adds to the graph: derived edges, and the endpoints of ``http`` with theirs. Classes' IMPLEMENTS come first, as
    methods' follow from them; TESTS last."""
    more = staged(transitive_implements(g), "implements")
    with_types = g.with_edges(more)
    implements, _ = method_implements(with_types)
    implements = staged(implements, "method-implements")
    dispatch = implements.select(edge_columns(F.col("dst"), F.col("src"), "DISPATCHES_TO"))
    dispatches = dispatch.unionByName(abstract_dispatch(g)).unionByName(structural_dispatch(with_types)).dropDuplicates(["src", "dst"]).select(*EDGE_FIELDS)
    out = PropertyGraph(g.nodes.limit(0), more).with_edges(implements, dispatches, overrides(g), tests(g), callback_calls(g))
    if http is not None:
        root = g.label("Repository").agg(F.min("node_id").alias("repo"))
        ends = http.nodes.select(F.col("node_id").alias("ep"))
        held = root.join(ends).select(edge_columns(F.col("repo"), F.col("ep"), "CONTAINS"))  # one repository
        out = PropertyGraph(http.nodes, out.edges.unionByName(http.edges).unionByName(held))
    return out
