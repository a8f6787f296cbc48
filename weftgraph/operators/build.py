"""Nodes and edges from staging rows: structure, base types, references, attributes, calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import routes
from weftgraph.functions.predicates import decoded, simple_name
from weftgraph.graph import PropertyGraph
from weftgraph.operators import resolve, types
from weftgraph.operators.derive import http_edges
from weftgraph.operators.imports import Aliases, import_edges, packages, resolved, visible_constants, with_constants
from weftgraph.plans.staging import staged
from weftgraph.schema import edge_columns, node_columns, node_id
from weftgraph.sources.files import ancestors

SPAN_LINES = 64  # of a bucket of lines
LABEL_OF_KIND = {"class": "Class", "abstract_class": "Class", "enum": "Class", "record": "Class", "module": "Class", "const_object": "Class", "interface": "Interface",
                 "method": "Method", "property": "Property", "field": "Field"}


def label_of(kind: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in LABEL_OF_KIND.items() for x in kv))[kind]


def distinct_symbols(staging: DataFrame) -> DataFrame:
    """The symbol rows with their label, one for each label and full name.

    Rows whose name no other row has, by its hash, stay where they are; only the rest is shuffled whole.
    """
    rows = staging.where("what = 'symbol'").withColumn("label", label_of(F.col("kind"))).where("label IS NOT NULL").withColumn("_key", F.xxhash64("label", "full_name"))
    again = staged(rows.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_key"), "repeated-names")
    once = rows.join(again, "_key", "left_anti").drop("_key")
    return once.unionByName(rows.join(again, "_key", "left_semi").drop("_key").dropDuplicates(["label", "full_name"]))


def structure(staging: DataFrame, repo: str, language: str) -> PropertyGraph:
    """Repository, folders, files and symbols with CONTAINS: folders by the chain above each file, symbols below their parent or file."""
    spark, root = staging.sparkSession, repo.rstrip("/")
    chain = staging.select(F.col("file_path").alias("path")).distinct().select("path", F.filter(ancestors(F.col("path")), lambda d: F.startswith(d, F.lit(root + "/"))).alias("dirs"))
    steps = chain.select("path", F.concat(F.array(F.lit(root)), "dirs", F.array("path")).alias("c"))
    pairs = steps.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda k: F.struct(F.get("c", k - 1).alias("a"), F.get("c", k).alias("b"), (k == F.size("c") - 1).alias("leaf")))).alias("p")).select("p.*").distinct()
    pairs = staged(pairs, "folders")  # nodes and edges are made of them
    files = pairs.where("leaf").select(F.col("b").alias("path"))
    dirs = pairs.where("NOT leaf").select(F.col("b").alias("path")).distinct()
    last = lambda c: F.substring_index(c, "/", -1)
    repo_node = spark.range(1).select(node_columns(node_id=F.lit(f"Repository:{root}"), labels=F.array(F.lit("Repository")), kind_label=F.lit("Repository"), name=F.lit(root.rsplit("/", 1)[-1]),
                                                   path=F.lit(root), languages=F.array(F.lit(language))))
    dir_nodes = dirs.select(node_columns(node_id=node_id("Directory", F.col("path")), labels=F.array(F.lit("Directory")), kind_label=F.lit("Directory"), name=last("path"), path=F.col("path")))
    file_nodes = files.select(node_columns(node_id=node_id("File", F.col("path")), labels=F.array(F.lit("File")), kind_label=F.lit("File"), name=last("path"), path=F.col("path"),
                                           file_path=F.col("path"), language=F.lit(language)))
    symbols = staged(distinct_symbols(staging), "symbols")  # of rows with equal names nodes and edges keep the same one
    ident = F.concat("label", F.lit(":"), "full_name")
    symbol_nodes = symbols.select(node_columns(
        node_id=ident, labels=F.array("label"), kind_label=F.col("label"), language=F.lit(language),
        **{c: F.col(c) for c in ("full_name", "name", "kind", "file_path", "line", "end_line", "signature", "type_name", "attributes", "is_abstract", "is_static", "is_classmethod", "is_async")},
    ))
    up = F.when(F.col("a") == root, F.concat(F.lit("Repository:"), "a")).otherwise(F.concat(F.lit("Directory:"), "a"))
    held = pairs.select(edge_columns(up, F.when(F.col("leaf"), F.concat(F.lit("File:"), "b")).otherwise(F.concat(F.lit("Directory:"), "b")), "CONTAINS"))
    parents = symbols.select(F.col("full_name").alias("parent"), ident.alias("pid"))
    below = symbols.join(parents, "parent", "left").select(F.coalesce("pid", F.concat(F.lit("File:"), "file_path")).alias("a"), ident.alias("b"))
    return PropertyGraph.of([repo_node, dir_nodes, file_nodes, symbol_nodes], [held, below.select(edge_columns(F.col("a"), F.col("b"), "CONTAINS"))])


def unique_names(g: PropertyGraph, *labels: str) -> DataFrame:
    """(name, node_id, kind_label) of simple names that one node alone has."""
    rows = g.label(*labels).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node_id", "kind_label")).alias("x"))
    return rows.where("n = 1").select("name", "x.node_id", "x.kind_label")


def base_types(g: PropertyGraph, bases: DataFrame, imported: DataFrame | None = None, language: str = "", root: str = "") -> tuple[DataFrame, DataFrame]:
    """(edges, external) of base rows (file_path, full_name, target, col): INHERITS between likes, IMPLEMENTS from class to interface.

    A base is the type that its name stands for at its place. In C# and TypeScript only the first base (col 0) can be a
    base class. What no type is called goes to external (full_name, external_bases as JSON text); a name that several
    types have, none of which the place sees, gives neither.
    """
    imported = imported if imported is not None else _nothing_imported(g)
    here = g.label("Class", "Interface").where("kind IS NULL OR kind <> 'module'").select("full_name", F.col("node_id").alias("src"), F.col("kind_label").alias("a"))
    named = resolve.type_targets(g, bases, imported, language, root)
    rows = staged(bases.join(named, ["file_path", "full_name", "target"]).join(here, "full_name"), "bases")
    known = rows.where("dst IS NOT NULL AND src <> dst")
    first = F.lit(language not in ("csharp", "typescript")) | (F.col("a") == "Interface") | (F.col("col") == 0)
    edges = known.where((F.col("a") == F.col("b")) & first).select("src", "dst").distinct().select(edge_columns(F.col("src"), F.col("dst"), "INHERITS")).unionByName(
        known.where("a = 'Class' AND b = 'Interface'").select("src", "dst").distinct().select(edge_columns(F.col("src"), F.col("dst"), "IMPLEMENTS"))
    )
    external = rows.where("NOT known").groupBy("full_name").agg(F.to_json(F.array_sort(F.collect_set("target"))).alias("external_bases"))
    return edges, external


def _nothing_imported(g: PropertyGraph) -> DataFrame:
    return g.nodes.sparkSession.createDataFrame([], "file_path string, name string, dst string, full string, label string")


def type_references(g: PropertyGraph, refs: DataFrame, defining: DataFrame | None = None, imported: DataFrame | None = None, language: str = "", root: str = "") -> DataFrame:
    """REFERENCES of (full_name, target, kind, file_path, line, col): by unique simple name, else by the symbol that
    ``defining`` (file_path, line, col, node_id) names for the place, else by what the name stands for there."""
    rows = refs.withColumn("name", simple_name(F.col("target"))).join(g.nodes.select("full_name", F.col("node_id").alias("src")), "full_name")
    rows = rows.join(unique_names(g, "Class", "Interface").select("name", F.col("node_id").alias("named")), "name", "left")
    if defining is not None:
        rows = rows.join(defining.withColumnRenamed("node_id", "defined"), ["file_path", "line", "col"], "left")
    else:
        rows = rows.withColumn("defined", F.lit(None).cast("string"))
    seen = resolve.type_targets(g, refs, imported if imported is not None else _nothing_imported(g), language, root).where("dst IS NOT NULL").select("file_path", "full_name", "target", F.col("dst").alias("seen"))
    rows = rows.join(seen, ["file_path", "full_name", "target"], "left")
    hit = rows.select("src", F.coalesce("named", "defined", "seen").alias("dst"), "kind").where("dst IS NOT NULL AND src <> dst").distinct()
    return hit.select(edge_columns(F.col("src"), F.col("dst"), "REFERENCES", F.col("kind")))


#: Markers that are flags of a symbol.
FLAGS = {"is_abstract": ("abstractmethod", "ABC", "Protocol", "abstract"), "is_static": ("staticmethod", "static"), "is_classmethod": ("classmethod",), "is_async": ("async",)}


def attributes_for(g: PropertyGraph, rows: DataFrame) -> DataFrame:
    """(node_id, attributes) of marker rows (file_path, name, attributes as JSON text): in their file the symbols called 'Parent.name'
    so, else those called so simply; parameters in a symbol's name do not count."""
    n = g.nodes.where("full_name IS NOT NULL").select("node_id", "file_path", F.regexp_replace("name", r"\(.*$", "").alias("simple"), F.regexp_replace("full_name", r"\(.*$", "").alias("fn"))
    n = n.withColumn("qualified", F.when(F.contains("fn", F.lit(".")), F.substring_index("fn", ".", -2)))
    by = lambda c, rank: rows.join(n.withColumn("name", F.col(c)), ["file_path", "name"]).select("file_path", "name", "attributes", "node_id", F.lit(rank).alias("rank"))
    hits = by("qualified", 0).unionByName(by("simple", 1))
    best = hits.groupBy("file_path", "name").agg(F.min("rank").alias("rank"))
    hits = hits.join(best, ["file_path", "name", "rank"])
    return hits.groupBy("node_id").agg(F.max_by("attributes", F.struct("name", "attributes")).alias("attributes"))


def with_attributes(g: PropertyGraph, rows: DataFrame) -> PropertyGraph:
    """The graph with the attributes of marker rows, and the flags that follow from them."""
    found = attributes_for(g, rows).withColumnRenamed("attributes", "_attributes")
    nodes = g.nodes.join(found, "node_id", "left")
    for flag, marks in FLAGS.items():
        nodes = nodes.withColumn(flag, F.when(F.arrays_overlap(decoded(F.col("_attributes")), F.array(*map(F.lit, marks))), True).otherwise(F.col(flag)))
    return PropertyGraph(nodes.withColumn("attributes", F.coalesce("_attributes", "attributes")).select(g.nodes.columns), g.edges)


def enclosing(points: DataFrame, spans: DataFrame) -> DataFrame:
    """The innermost span (file_path, full_name, line, end_line) around each point (file_path, at and any other columns).

    Both sides are cut into buckets of lines, so the join is an equi-join and a span meets only points near it.
    """
    p = points.withColumn("_b", F.floor(F.col("at") / SPAN_LINES))
    s = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("line") / SPAN_LINES), F.floor(F.col("end_line") / SPAN_LINES))))
    hit = p.withColumn("_p", F.monotonically_increasing_id()).join(s, ["file_path", "_b"]).where("at BETWEEN line AND end_line")
    best = Window.partitionBy("_p").orderBy(F.desc("line"), F.asc("end_line"), F.asc("full_name"))
    return hit.withColumn("_n", F.row_number().over(best)).where("_n = 1").select(*points.columns, "full_name")


def last_start(points: DataFrame, starts: DataFrame) -> DataFrame:
    """The last start (file_path, full_name, line) at or before each point (file_path, at): an as-of join as one window over both."""
    both = points.select("file_path", F.col("at"), F.lit(None).cast("string").alias("full_name"), F.lit(1).alias("k")).unionByName(
        starts.select("file_path", F.col("line").alias("at"), "full_name", F.lit(0).alias("k"))
    )
    w = Window.partitionBy("file_path").orderBy("at", "k", "full_name").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("full_name", F.last("full_name", ignorenulls=True).over(w)).where("k = 1").select("file_path", "at", "full_name")


def calls_from_references(g: PropertyGraph, references: DataFrame, compile_time: DataFrame | None = None, elements: DataFrame | None = None) -> DataFrame:
    """CALLS of reference_sites(). Each pair is one edge with all its sites."""
    return _calls(reference_sites(g, references, compile_time, elements))


def reference_sites(g: PropertyGraph, references: DataFrame, compile_time: DataFrame | None = None, elements: DataFrame | None = None) -> DataFrame:
    """(src, dst, line, col) of references (callee, file_path, line, col): the innermost method around the place calls; where there is none, the
    methods of the file that use the callee as a markup element, of ``elements`` (file_path, name, full_name, line, col); else the
    file's module, unless the place lies in ``compile_time`` (file_path, line, end_line).
    The line that declares the callee is no call."""
    keys, target = ["callee", "file_path", "ref_line", "col"], ["dst", "own_path", "own_line"]
    spans = g.label("Method").where("full_name IS NOT NULL").select("file_path", F.col("node_id").alias("src"), "full_name", "line", "end_line")
    spans = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("line") / SPAN_LINES), F.floor(F.col("end_line") / SPAN_LINES))))
    places = references.select("callee", "file_path", F.col("line").alias("ref_line"), "col").withColumn("_b", F.floor(F.col("ref_line") / SPAN_LINES))
    near = places.join(spans, ["file_path", "_b"], "left")
    around = F.when(F.col("ref_line").between(F.col("line"), F.col("end_line")), F.struct(-F.col("line"), "end_line", "full_name"))
    near = near.groupBy("file_path", "_b", "callee", "ref_line", "col").agg(F.min_by("src", around).alias("src"))  # as the join has dealt them
    m = g.label("Method", "Class").select(F.col("full_name").alias("callee"), F.col("node_id").alias("dst"), F.col("file_path").alias("own_path"), F.col("line").alias("own_line"))
    elsewhere = ~((F.col("file_path") == F.col("own_path")) & (F.col("ref_line") == F.col("own_line")))
    rows = staged(near.join(m, "callee").where(elsewhere).select("src", *keys, *target), "references")  # read for what lies inside of methods and for what does not
    inside, outside = rows.where("src IS NOT NULL"), rows.where("src IS NULL").drop("src")
    if elements is not None:
        callers = g.label("Method").select("full_name", F.col("node_id").alias("src"))
        used = elements.select("file_path", F.col("name").alias("simple"), "full_name", F.col("line").alias("at_line"), F.col("col").alias("at_col")).join(callers, "full_name")
        hit = staged(outside.withColumn("simple", simple_name(F.col("callee"))).join(used, ["file_path", "simple"]).select(*keys, *target, "src", "at_line", "at_col"), "element-calls")
        inside = inside.unionByName(hit.select("src", "callee", "file_path", F.col("at_line").alias("ref_line"), F.col("at_col").alias("col"), *target).where(elsewhere))
        outside = outside.join(hit.select(keys), keys, "left_anti")
    if compile_time is not None:
        blocks = compile_time.select("file_path", F.lit("").alias("full_name"), "line", "end_line")
        only = enclosing(outside.withColumn("at", F.col("ref_line")), blocks).select(keys)
        outside = outside.join(only, keys, "left_anti")
    modules = g.label("Class").where("kind = 'module'").select("file_path", F.col("node_id").alias("src"))
    hit = inside.unionByName(outside.join(modules, "file_path").select("src", *keys, *target))
    return hit.select("src", "dst", F.col("ref_line").alias("line"), "col")


def _calls(sites: DataFrame) -> DataFrame:
    """CALLS of (src, dst, line, col), with the distinct sites of each pair."""
    site = F.struct(F.col("line").cast("int").alias("line"), F.col("col").cast("int").alias("col"))
    by = sites.groupBy("src", "dst").agg(F.array_sort(F.collect_set(site)).alias("sites"))
    return by.select(edge_columns(F.col("src"), F.col("dst"), "CALLS", call_sites=F.col("sites")))


def http_rows(staging: DataFrame, language: str) -> tuple[DataFrame, DataFrame]:
    """(definitions, calls) of staging rows, as derive.http_edges() takes them: routes in normal form, in the order of the sources."""
    raw = F.coalesce("target", F.lit(""))
    served = {"python": routes.flask_params, "typescript": routes.express_params}.get(language, lambda c: c)(raw)
    order = F.concat_ws("|", "file_path", F.lpad(F.col("line").cast("string"), 10, "0"), F.lpad(F.col("col").cast("string"), 10, "0"), "kind", "target", "full_name")
    ends, asked = staging.where("what = 'endpoint'"), staging.where("what = 'client_call'")
    definitions = ends.select(routes.normalised(F.lit(""), served).alias("route"), F.col("kind").alias("http_method"), F.col("full_name").alias("handler"), order.alias("def_ord"))
    calls = asked.select("file_path", raw.alias("route"), F.col("kind").alias("http_method"), F.col("full_name").alias("caller"), "line", "col", order.alias("call_ord"))
    return definitions.dropDuplicates(["def_ord"]), calls.dropDuplicates(["call_ord"])


def typed_structure(staging: DataFrame, repo: str, language: str, aliases: Aliases = (), root: str | None = None) -> tuple[PropertyGraph, DataFrame, DataFrame, DataFrame]:
    """(graph, imported, edges, external) of staged rows: structure, packages and markers, what imports stand for (imports.resolved()), and base_types()."""
    root = root or repo
    g = structure(staging, repo, language)
    if language in ("java", "csharp"):
        spaces = packages(g, staging)
        g = PropertyGraph(g.nodes.unionByName(spaces.nodes), g.edges.unionByName(spaces.edges))
    marks = staging.where("what = 'marker' AND name IS NOT NULL").select("file_path", "name", "attributes")
    if not marks.isEmpty():
        g = with_attributes(g, marks)
    g = g.staged()
    imported = staged(resolved(g, staging, root, language, aliases), "imported-names")
    edges, external = base_types(g, staging.where("what = 'base'").select("file_path", "full_name", "target", "col"), imported, language, root)
    return g, imported, staged(edges, "base-edges"), external


def _source_calls(g: PropertyGraph, staging: DataFrame, imported: DataFrame, language: str, root: str, definitions: DataFrame | None, references: DataFrame | None) -> tuple[DataFrame, PropertyGraph]:
    """(calls, stubs) of source_graph(); ``g`` needs its base types."""
    up = staged(resolve.inherited(g), "type-ancestors")
    rows = resolve.call_sites(staging)
    owners = staged(resolve.owners(types.scopes(staging), g), "scope-owners")
    inferred, named = types.receivers(g, staging, imported, language, root, up, resolve.receiver_names(staging, rows), owners)
    found = resolve.call_candidates(g, staging, imported, language, root, inferred, up, rows, named, owners)
    if definitions is not None:
        found = found.unionByName(definitions.select("caller", "line", "col", F.lit(resolve.DEFINED).alias("priority"), "callee"))
    settled = staged(resolve.by_ladder(found), "settled-calls")
    callers = g.label("Method", "Class").select(F.col("full_name").alias("caller"), "kind_label")
    sites = settled.join(callers, "caller").select(F.concat("kind_label", F.lit(":"), "caller").alias("src"), F.col("callee").alias("dst"), "line", "col")
    if references is not None:
        blocks = staging.where("what = 'compile_time'").select("file_path", "line", "end_line")
        marks = staging.where("what = 'call' AND kind = 'element'").select("file_path", "name", "full_name", "line", "col")
        sites = sites.unionByName(reference_sites(g, references, blocks, marks))
    return _calls(sites), resolve.external_stubs(g, staging, settled) if language == "java" else PropertyGraph.empty(staging.sparkSession)


#: What source_calls() reads of staging rows.
CALL_KINDS = ("symbol", "import", "base", "binding", "assignment", "call", "compile_time", "error")
CALL_COLUMNS = ("what", "file_path", "full_name", "name", "kind", "line", "end_line", "col", "parent", "target", "type_name", "args")


def source_calls(staging: DataFrame, repo: str, language: str, aliases: Aliases = (), definitions: DataFrame | None = None, root: str | None = None, references: DataFrame | None = None) -> DataFrame:
    """The CALLS of source_graph() by the same rules, for those who need no more: of the graph only symbols and base types are made, and
    staging rows need only CALL_KINDS and CALL_COLUMNS."""
    root = root or repo
    staging = staged(staging.where(F.col("what").isin(*CALL_KINDS)).select(*CALL_COLUMNS), "staging", by="what")
    fields = {"node_id": F.concat("label", F.lit(":"), "full_name"), "kind_label": F.col("label")} | {c: F.col(c) for c in ("full_name", "name", "kind", "file_path", "line", "end_line")}
    shown = list(fields)
    symbols = distinct_symbols(staging).select(*(c.alias(n) for n, c in fields.items()))
    g = PropertyGraph(staged(symbols, "nodes", by="kind_label"), PropertyGraph.empty(staging.sparkSession).edges)
    if language in ("java", "csharp") and not staging.where("what = 'import'").isEmpty():  # only imports ask for packages
        g = g.with_nodes(staged(packages(g, staging).nodes.select(*shown), "packages"))
    imported = staged(resolved(g, staging, root, language, aliases), "imported-names")
    edges, _ = base_types(g, staging.where("what = 'base'").select("file_path", "full_name", "target", "col"), imported, language, root)
    calls, stubs = _source_calls(g.with_edges(staged(edges, "base-edges")), staging, imported, language, root, definitions, references)
    return calls.unionByName(stubs.edges)


def source_graph(staging: DataFrame, repo: str, language: str, aliases: Aliases = (), definitions: DataFrame | None = None, root: str | None = None, references: DataFrame | None = None) -> PropertyGraph:
    """A whole graph of one language's staging rows: structure, packages, markers, base types, references, imports, HTTP
    endpoints, and calls: each of the method that its name stands for at its place (see resolve.call_candidates).

    ``definitions`` (caller, line, col, callee) of a language server come before what names say, and its ``references``
    (callee, file_path, line, col) add calls, with markup elements as callers and without what is for compile time alone
    (sources.answers makes both of recorded answers). ``root`` is the folder that modules are named from, where that is not ``repo``.
    """
    root = root or repo
    staging = staged(staging, "staging", by="what")  # parsed once, read by each step
    g, imported, edges, external = typed_structure(staging, repo, language, aliases, root)
    refs = type_references(g, staging.where("what = 'type_ref'").select("full_name", "target", "kind", "file_path", "line", "col"), None, imported, language, root)
    calls, stubs = _source_calls(g.with_edges(edges), staging, imported, language, root, definitions, references)
    served, asked = http_rows(staging, language)
    http = http_edges(served, with_constants(asked, visible_constants(staging, repo, language, aliases)))
    # An edge needs its method: what a module itself serves or asks for is an endpoint without one.
    http_held = http.edges.join(g.label("Method").select(F.col("node_id").alias("src")), "src", "left_semi").select(http.edges.columns)
    below_repo = http.nodes.select(edge_columns(F.lit(f"Repository:{repo.rstrip('/')}"), F.col("node_id"), "CONTAINS"))
    nodes = g.nodes.join(external.withColumnRenamed("external_bases", "_e"), "full_name", "left").withColumn("external_bases", F.coalesce("_e", "external_bases")).drop("_e")
    nodes = nodes.select(g.nodes.columns).unionByName(http.nodes).unionByName(stubs.nodes.join(g.nodes.select("node_id"), "node_id", "left_anti").select(g.nodes.columns))
    return PropertyGraph(nodes, g.edges).with_edges(edges, refs, calls, stubs.edges, import_edges(imported), http_held, below_repo)


def python_graph(staging: DataFrame, repo: str) -> PropertyGraph:
    return source_graph(staging, repo, "python")
