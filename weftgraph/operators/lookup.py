"""Point lookups, name search and one-hop patterns. Every function returns a DataFrame unless it says otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.predicates import decoded, is_test, simple_name
from weftgraph.graph import PropertyGraph
from weftgraph.operators.containment import inside
from weftgraph.plans.expand import reach, spread, ways
from weftgraph.plans.staging import staged
from weftgraph.schema import LABEL_ORDER, REFERENCE_KINDS, SEARCHABLE_KINDS

TYPES = ("Class", "Interface")
NODE = ("full_name", "name", "kind_label", "file_path", "line")

# Words of languages that a search query loses.
KEYWORDS = (
    "def", "class", "function", "async", "await", "public", "private", "protected", "static", "void", "abstract", "virtual", "readonly", "return", "new",
    "var", "let", "const", "interface", "enum", "struct", "namespace", "import", "from", "package", "final", "synchronized", "export", "type", "sealed",
    "partial", "extends", "implements",
)


def _as(df: DataFrame, role: str, *columns: str) -> DataFrame:
    """node_id as ``role`` and the other columns with the role before them."""
    return df.select(F.col("node_id").alias(role), *(F.col(c).alias(f"{role}_{c}") for c in columns))


def _rank(labels: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LABEL_ORDER)), labels)


def symbol(g: PropertyGraph, full_name: str) -> DataFrame:
    """The node of a full name; of several, the one whose label comes first."""
    rows = g.nodes.where(F.col("full_name") == full_name).withColumn("_rank", _rank(F.col("kind_label")))
    return rows.orderBy("_rank", "node_id").limit(1).select(*NODE, "language")


def source_info(g: PropertyGraph, full_name: str) -> DataFrame:
    return g.nodes.where((F.col("full_name") == full_name) & (F.col("file_path") != "")).select("full_name", "file_path", "line", "end_line")


def search_term(query: str) -> str:
    """The longest word of a query that is no keyword and no syntax; the query itself where nothing is left."""
    plain = re.sub(r"[(){}\[\]:;=@,<>]", " ", query)
    words = plain.split()
    if query.strip() == plain.strip() and len(words) == 1:
        return query
    return max((w for w in words if w.lower() not in KEYWORDS), key=len, default=query)


def search(g: PropertyGraph, query: str, kind: str | None = None, namespace: str | None = None, file_path: str | None = None, language: str | None = None) -> DataFrame:
    """Nodes whose names hold the term; if none does, regardless of case. Both in one pass: the better tier wins."""
    if kind is not None and kind not in SEARCHABLE_KINDS:
        raise ValueError(f"unknown kind {kind!r}")
    term = search_term(query)
    rows = g.nodes.where("full_name IS NOT NULL")
    for column, value in (("file_path", file_path), ("language", language)):
        rows = rows.where(F.col(column) == value) if value else rows
    rows = rows.where(F.array_contains("labels", kind)) if kind else rows
    rows = rows.where(F.startswith("full_name", F.lit(namespace))) if namespace else rows
    name, low = F.col("name"), F.lower("name")
    tier = F.when(F.contains(name, F.lit(term)), 0).when(F.contains(low, F.lit(term.lower())), 1)
    rows = rows.withColumn("tier", tier).where("tier IS NOT NULL")
    best = rows.agg(F.min("tier").alias("best"))
    exact = F.when(F.when(F.col("tier") == 0, name == term).otherwise(low == term.lower()), 0).otherwise(1)
    rows = rows.join(F.broadcast(best), F.col("tier") == F.col("best"))  # one row
    return rows.select(*NODE, "language", exact.alias("rank")).orderBy("rank", "name", "full_name")


def resolve(g: PropertyGraph, name: str) -> DataFrame:
    """Full names that a name may mean: itself, else those that end in it; types before others."""
    fn = F.col("full_name")
    tier = F.when(fn == name, 0).when(F.endswith(fn, F.lit("." + name)), F.when(F.col("kind_label").isin(*TYPES), 1).otherwise(2))
    rows = g.nodes.withColumn("tier", tier).where("tier IS NOT NULL")
    best = rows.agg(F.min("tier").alias("best"))
    return rows.join(F.broadcast(best), F.col("tier") == F.col("best")).select("full_name", "labels").distinct()  # one row


def resolve_one(g: PropertyGraph, name: str, prefer: str | None = None) -> str:
    """The one full name that is meant. ``prefer``: 'concrete' or 'interface', by the label or else by the owner's label."""
    found = resolve(g, name)
    rows = [r.full_name for r in found.select("full_name").distinct().orderBy("full_name").limit(11).collect()]
    if len(rows) > 1 and prefer:
        label = "Class" if prefer == "concrete" else "Interface"
        direct = [r.full_name for r in found.where(F.array_contains("labels", label)).limit(2).collect()]
        owners = of_owner(g, found.select("full_name"), label)
        rows = direct if len(direct) == 1 else [r.full_name for r in owners.limit(11).collect()] or rows
    if len(rows) == 1:
        return rows[0]
    if not rows:
        raise LookupError(f"no symbol {name!r}; similar: {', '.join(r.full_name for r in similar(g, name).collect())}")
    raise LookupError(f"{name!r} is ambiguous: {', '.join(rows[:10])}")


def of_owner(g: PropertyGraph, names: DataFrame, label: str) -> DataFrame:
    """Those of ``names`` (full_name) whose owner has the label."""
    owners = g.label(label).select(F.col("node_id").alias("src"))
    held = g.edge("CONTAINS").select("src", "dst").join(owners, "src", "left_semi").select(F.col("dst").alias("node_id"))
    return g.nodes.join(names, "full_name", "left_semi").join(held, "node_id", "left_semi").select("full_name").distinct()


def similar(g: PropertyGraph, name: str, limit: int = 5) -> DataFrame:
    """'Did you mean': names that hold the last segment, exact ones first."""
    simple = name.rsplit(".", 1)[-1]
    rows = g.nodes.where(F.col("full_name").isNotNull() & F.contains("name", F.lit(simple)))
    rows = rows.groupBy("full_name").agg(F.min(F.when(F.col("name") == simple, 0).otherwise(1)).alias("rank"))
    return rows.orderBy("rank", "full_name").limit(limit)


def symbol_kind(g: PropertyGraph) -> DataFrame:
    from weftgraph.graph import main_label

    return g.nodes.where("full_name IS NOT NULL").select("full_name", main_label(F.col("labels")).alias("kind"))


def _hop(g: PropertyGraph, type_: str, full_name: str | None = None, forward: bool = True, labels: tuple[str, ...] = ()) -> DataFrame:
    """Nodes one hop from a symbol, with ``of`` as that symbol's full name; of all symbols where no name is given."""
    here, there = ("src", "dst") if forward else ("dst", "src")
    start = g.nodes.where(F.col("full_name") == full_name) if full_name is not None else g.nodes.where("full_name IS NOT NULL")
    start = start.select(F.col("node_id").alias(here), F.col("full_name").alias("of"))
    ends = g.label(*labels) if labels else g.nodes
    rows = g.edge(type_).select("src", "dst", F.col("kind").alias("ref_kind")).join(start, here)
    return rows.join(ends.withColumnRenamed("node_id", there), there)


def containing_type(g: PropertyGraph, full_name: str | None = None) -> DataFrame:
    return _hop(g, "CONTAINS", full_name, False, TYPES).select("of", *NODE)


def members(g: PropertyGraph, full_name: str | None = None) -> DataFrame:
    return _hop(g, "CONTAINS", full_name).select("of", *NODE, "signature", "type_name")


def constructor(g: PropertyGraph, full_name: str | None = None) -> DataFrame:
    owners = g.nodes.select(F.col("full_name").alias("of"), F.col("name").alias("owner_name")).where("of IS NOT NULL").distinct()
    return members(g, full_name).join(owners, "of").where("name = owner_name").select("of", "full_name", "line", "signature")


def implemented_interfaces(g: PropertyGraph, full_name: str | None = None) -> DataFrame:
    return _hop(g, "IMPLEMENTS", full_name, True, ("Interface",)).select("of", "full_name", "name")


def type_references(g: PropertyGraph, full_name: str | None = None, kind: str | None = None) -> DataFrame:
    if kind is not None and kind not in REFERENCE_KINDS:
        raise ValueError(f"unknown kind of reference {kind!r}")
    rows = _hop(g, "REFERENCES", full_name, False)
    return (rows.where(F.col("ref_kind") == kind) if kind else rows).select("of", "full_name", "ref_kind", "file_path", "line")


def field_dependencies(g: PropertyGraph, full_name: str | None = None) -> DataFrame:
    rows = _hop(g, "CONTAINS", full_name, True, ("Field",)).where("type_name <> ''")
    return rows.select("of", "full_name", "name", "type_name", F.array_join(decoded(F.col("attributes")), ",").alias("annotations"))


def called_members(g: PropertyGraph, method: str, dependency: str) -> DataFrame:
    owned = _hop(g, "CONTAINS", dependency).select(F.col("full_name"), "name")
    called = _hop(g, "CALLS", method, True, ("Method",)).select("full_name")
    return owned.join(called, "full_name", "left_semi").distinct()


def referenced_types(g: PropertyGraph, cls: str) -> DataFrame:
    """Types that members of a class refer to."""
    own = g.nodes.where(F.col("full_name") == cls).select(F.col("node_id").alias("owner"))
    held = g.edge("CONTAINS").select(F.col("src").alias("owner"), F.col("dst").alias("src")).join(own, "owner")
    deps = g.edge("REFERENCES").select("src", F.col("dst").alias("node_id")).join(held, "src").select("node_id").distinct()
    return g.label(*TYPES).join(deps, "node_id", "left_semi").select("node_id", *NODE)


def relevant_types(g: PropertyGraph, cls: str, method: str) -> DataFrame:
    """Those of them with a method that ``method`` calls."""
    m = g.label("Method").where(F.col("full_name") == method).select(F.col("node_id").alias("src"))
    callees = g.edge("CALLS").join(m, "src", "left_semi").select("dst").distinct()
    owners = g.edge("CONTAINS").select(F.col("src").alias("node_id"), "dst").join(callees, "dst", "left_semi").select("node_id").distinct()
    return referenced_types(g, cls).join(owners, "node_id", "left_semi").select(*NODE)


def symbol_map(g: PropertyGraph, *labels: str) -> DataFrame:
    """(file_path, line) -> full_name; of several at one place the last name."""
    rows = g.label(*(labels or ("Method",))).where("file_path IS NOT NULL AND line IS NOT NULL")
    return rows.groupBy("file_path", "line").agg(F.max("full_name").alias("full_name"))


def overlaid(base: DataFrame, fresh: DataFrame) -> DataFrame:
    """A symbol map with the places of ``fresh`` taken from there."""
    keys = ["file_path", "line"]
    return base.join(fresh, keys, "left_anti").select(*keys, "full_name").unionByName(fresh.select(*keys, "full_name"))


def stale_files(g: PropertyGraph, disk: DataFrame) -> DataFrame:
    """Files changed since they were indexed; ``disk``: path, modified (timestamp)."""
    rows = g.label("File").select("path", "last_indexed").join(disk, "path")
    return rows.where("last_indexed IS NULL OR modified > last_indexed").select("path", "last_indexed", "modified")


def _methods(g: PropertyGraph) -> DataFrame:
    return g.label("Method").select(F.col("node_id").alias("src"), "full_name", "name", "file_path", "line")


def caller_edges(g: PropertyGraph, full_name: str | None = None, dispatch: bool = True) -> DataFrame:
    """(of, src, branch, call_sites): callers of a method (0), of an interface method it implements (1), of what dispatches to it (2)."""
    target = g.label("Method")
    target = (target.where(F.col("full_name") == full_name) if full_name is not None else target).select(F.col("node_id").alias("m"), F.col("full_name").alias("of"))
    ways = target.select("of", F.col("m").alias("dst"), F.lit(0).alias("branch"))
    if dispatch:
        up = g.edge("IMPLEMENTS").select(F.col("src").alias("m"), "dst").join(target, "m").select("of", "dst", F.lit(1).alias("branch"))
        from_ = g.edge("DISPATCHES_TO").select(F.col("dst").alias("m"), F.col("src").alias("dst")).join(target, "m").select("of", "dst", F.lit(2).alias("branch"))
        ways = ways.unionByName(up).unionByName(from_)
    return g.edge("CALLS").select("src", "dst", "call_sites").join(ways, "dst")


def callers(g: PropertyGraph, full_name: str | None = None, dispatch: bool = True, exclude_tests: bool = False) -> DataFrame:
    """Methods that call a method, each once, by the nearest branch; with the call sites of that branch."""
    rows = caller_edges(g, full_name, dispatch).groupBy("of", "src").agg(F.min("branch").alias("branch"), F.min_by("call_sites", F.struct("branch", "dst")).alias("call_sites"))
    rows = rows.join(_methods(g), "src")
    rows = rows.where(~is_test(F.col("file_path"))) if exclude_tests else rows
    lines = F.array_join(F.array_sort(F.array_distinct(F.transform("call_sites", lambda x: x["line"]))).cast("array<string>"), ", ")
    return rows.select("of", "full_name", "file_path", "line", "branch", lines.alias("site_lines"))


def callees(g: PropertyGraph, full_name: str | None = None, dispatch: bool = True) -> DataFrame:
    """Methods that a method calls, directly (0) or where a call is dispatched to (1)."""
    start = g.label("Method")
    start = (start.where(F.col("full_name") == full_name) if full_name is not None else start).select(F.col("node_id").alias("src"), F.col("full_name").alias("of"))
    direct = g.edge("CALLS").select("src", "dst").join(start, "src").select("of", "dst")
    rows = direct.withColumn("branch", F.lit(0))
    if dispatch:
        on = g.edge("DISPATCHES_TO").select(F.col("src").alias("dst"), F.col("dst").alias("to"))
        rows = rows.unionByName(direct.join(on, "dst").select("of", F.col("to").alias("dst"), F.lit(1).alias("branch")))
    rows = rows.groupBy("of", "dst").agg(F.min("branch").alias("branch"))
    return rows.join(_methods(g).withColumnRenamed("src", "dst"), "dst").select("of", "full_name", "name", "file_path", "line", "branch")


def implementations(g: PropertyGraph, full_name: str) -> DataFrame:
    """Classes that implement an interface themselves or through a class they inherit from; where none has the full name, all that end in it."""
    exact = g.nodes.withColumn("tier", F.when(F.col("full_name") == full_name, 0).when(F.endswith("full_name", F.lit("." + full_name)), 1)).where("tier IS NOT NULL")
    direct = g.edge("IMPLEMENTS").select(F.col("src").alias("node"), F.col("dst").alias("node_id")).join(exact.select("node_id", "tier"), "node_id")
    direct = direct.join(direct.agg(F.min("tier").alias("best")).hint("broadcast"), F.col("tier") == F.col("best")).select("node").distinct()  # one row
    heirs = spread(g.edge("INHERITS"), direct, reverse=True).select("node")
    return g.label("Class", "Method").join(direct.unionByName(heirs).distinct().withColumnRenamed("node", "node_id"), "node_id", "left_semi").select(*NODE)


def hierarchy(g: PropertyGraph, full_name: str) -> DataFrame:
    """(relation, full_name, paths): parents, children and implements of a type. ``paths`` counts the ways to a parent or child through a diamond."""
    own = g.nodes.where(F.col("full_name") == full_name).select(F.col("node_id").alias("node"))
    up, down = ways(g.edge("INHERITS"), own), ways(g.edge("INHERITS"), own, reverse=True)
    name = g.nodes.select(F.col("node_id").alias("node"), "full_name", "kind_label")
    parents = up.join(name, "node").where(F.col("kind_label").isin(*TYPES)).select(F.lit("parent").alias("relation"), "full_name", "paths")
    impl = g.edge("IMPLEMENTS").select("src", "dst")
    said = impl.join(own.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), F.lit(1).cast("bigint").alias("paths"))
    children = down.unionByName(said).join(name, "node").where("kind_label <> 'Method'").groupBy("full_name").agg(F.max("paths").alias("paths"))
    ifcs = impl.join(own.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node")).join(name, "node").where("kind_label = 'Interface'")
    return parents.unionByName(children.select(F.lit("child").alias("relation"), "full_name", "paths")).unionByName(ifcs.select(F.lit("implements").alias("relation"), "full_name", F.lit(1).cast("bigint").alias("paths")))


def neighborhood(g: PropertyGraph, full_name: str) -> DataFrame:
    """(full_name, type, direction) of all direct neighbours with a full name."""
    own = g.nodes.where(F.col("full_name") == full_name).select("node_id")
    out = g.edges.join(own.withColumnRenamed("node_id", "src"), "src", "left_semi").select(F.col("dst").alias("node_id"), "type", F.lit("out").alias("direction"))
    into = g.edges.join(own.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select(F.col("src").alias("node_id"), "type", F.lit("in").alias("direction"))
    return out.unionByName(into).join(g.nodes.where("full_name IS NOT NULL AND full_name <> ''"), "node_id").select("full_name", "kind_label", "type", "direction").distinct()


def endpoints(g: PropertyGraph, route: str | None = None, http_method: str | None = None, language: str | None = None) -> DataFrame:
    """One row per endpoint and handler; with a language only those served in it."""
    ep = g.label("Endpoint").select(F.col("node_id").alias("dst"), "route", "http_method")
    ep = ep.where(F.contains("route", F.lit(route))) if route is not None else ep
    ep = ep.where(F.col("http_method") == http_method) if http_method is not None else ep
    handlers = g.edge("SERVES").select("src", "dst").join(g.label("Method").select(F.col("node_id").alias("src"), F.col("full_name").alias("handler"), "file_path", "line", "language"), "src")
    rows = ep.join(handlers, "dst", "left" if language is None else "inner")
    rows = rows.where(F.col("language") == language) if language is not None else rows
    return rows.select("route", "http_method", F.col("handler").isNotNull().alias("has_server"), "handler", "file_path", "line", "language").orderBy("route", "http_method", "handler")


def endpoint_dependency(g: PropertyGraph, route: str, http_method: str) -> DataFrame:
    """(role, full_name): the first handler and all callers of one endpoint."""
    ep = g.label("Endpoint").where((F.col("route") == route) & (F.col("http_method") == http_method)).select(F.col("node_id").alias("dst"))
    names = g.label("Method").select(F.col("node_id").alias("src"), "full_name")
    handler = g.edge("SERVES").join(ep, "dst", "left_semi").join(names, "src").agg(F.min("full_name").alias("full_name")).where("full_name IS NOT NULL")
    callers_ = g.edge("HTTP_CALLS").join(ep, "dst", "left_semi").join(names, "src").select("full_name").distinct()
    return handler.select(F.lit("handler").alias("role"), "full_name").unionByName(callers_.select(F.lit("caller").alias("role"), "full_name"))


def served_endpoint(g: PropertyGraph, full_name: str | None = None) -> DataFrame:
    """The endpoint of each handler; of several the first by route and method."""
    rows = _hop(g, "SERVES", full_name, True, ("Endpoint",)).groupBy("of").agg(F.min(F.struct("route", "http_method")).alias("e"))
    return rows.select("of", "e.route", "e.http_method")


def http_callers(g: PropertyGraph, full_name: str | None = None) -> DataFrame:
    """Methods that call, over HTTP, the endpoint that a method serves."""
    ep = _hop(g, "SERVES", full_name, True, ("Endpoint",)).select("of", F.col("dst").alias("ep"), F.col("route").alias("ep_route"))
    calls = g.edge("HTTP_CALLS").select("src", F.col("dst").alias("ep")).join(ep, "ep")
    return calls.join(_methods(g), "src").select("of", "full_name", "file_path", F.col("ep_route").alias("route"))


def tests_for(g: PropertyGraph, full_name: str | None = None) -> DataFrame:
    return _hop(g, "TESTS", full_name, False, ("Method",)).select("of", "full_name", "file_path", "line")


def interface_contract(g: PropertyGraph, full_name: str | None = None) -> DataFrame:
    """(of, contract, interface, owner): the interface method that a method, or one it overrides, implements under its simple name; the first by name."""
    m = g.label("Method")
    m = (m.where(F.col("full_name") == full_name) if full_name is not None else m).select(F.col("node_id").alias("start"), F.col("full_name").alias("of"))
    m = m.withColumn("simple", simple_name(F.col("of")))
    up = reach(g.edge("OVERRIDES"), m.select(F.col("start").alias("node"))).select("start", F.col("node").alias("base"))
    bases = m.select("start", F.col("start").alias("base")).unionByName(up).distinct()
    contract = g.label("Method").select(F.col("node_id").alias("dst"), F.col("full_name").alias("contract"), F.col("name").alias("contract_name"))
    held = g.edge("CONTAINS").select(F.col("src").alias("owner_id"), F.col("dst").alias("held"))
    names = g.nodes.select(F.col("node_id").alias("owner_id"), F.col("full_name").alias("owner")).where("owner IS NOT NULL")
    owners = held.join(names, "owner_id").select("held", "owner")
    rows = bases.join(m, "start").join(g.edge("IMPLEMENTS").select(F.col("src").alias("base"), "dst"), "base").join(contract, "dst").where("contract_name = simple")
    rows = rows.join(owners.withColumnsRenamed({"held": "dst", "owner": "interface"}), "dst").join(owners.withColumnsRenamed({"held": "start", "owner": "class"}), "start")
    best = rows.groupBy("of").agg(F.min(F.struct("interface", "contract", F.col("class").alias("cls"))).alias("b"))
    return best.select("of", "b.interface", "b.contract", F.col("b.cls").alias("owner"))


def siblings(g: PropertyGraph, contract: DataFrame) -> DataFrame:
    """(of, sibling): other classes that implement the interface of interface_contract()'s rows."""
    ids = g.nodes.select("node_id", "full_name")
    impl = g.edge("IMPLEMENTS").select("src", "dst").join(ids.withColumnsRenamed({"node_id": "dst", "full_name": "interface"}), "dst")
    impl = impl.join(g.label("Class").select(F.col("node_id").alias("src"), F.col("full_name").alias("sibling")), "src").select("interface", "sibling")
    impl = staged(impl.distinct(), "implementers")  # classes are few beside methods: broadcast where they are, so that an interface's methods do not meet in one task
    # One row a method here, and a class once an interface there: pairs are distinct as they are made.
    return contract.join(impl, "interface").where("sibling <> owner").select("of", "sibling")


def summaries(g: PropertyGraph, repo: str | None = None, labels: DataFrame | None = None) -> DataFrame:
    """``labels``: containment.labels() of the graph."""
    rows = g.nodes.where(F.array_contains(F.col("labels"), "Summarized"))
    if repo is not None:
        top = g.label("Repository").where(F.col("path") == repo.rstrip("/")).select(F.col("node_id").alias("node"))
        if labels is not None:
            below = inside(labels, top.withColumnRenamed("node", "node_id"), itself=False)
        else:
            below = spread(g.edge("CONTAINS"), top).select(F.col("node").alias("node_id"))
        rows = rows.join(below, "node_id", "left_semi")
    return rows.select("full_name", "summary").distinct()


def projects(g: PropertyGraph) -> DataFrame:
    return g.label("Repository").select("path", "name", F.array_join("languages", ",").alias("languages"))


def page(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of ordered rows; a limit of 0 or less means all."""
    rows = rows.offset(offset) if offset else rows
    return rows.limit(limit) if limit > 0 else rows


def first_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
