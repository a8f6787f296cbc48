"""Audits of whole graphs: dead and untested code, status, architecture, usages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import predicates as P
from weftgraph.graph import PropertyGraph
from weftgraph.operators.containment import inside
from weftgraph.plans.expand import reach

SYMBOLS = ("Class", "Interface", "Method", "Property", "Field", "Package", "Endpoint")


def _flags(g: PropertyGraph) -> DataFrame:
    """(node_id, edge and owner flags) of methods, in one aggregation over the edges that touch them."""
    owner = g.label("Class", "Interface", "Package", "File").select(
        F.col("node_id").alias("src"), F.col("kind_label").alias("o_label"), F.col("name").alias("o_name"), F.col("attributes").alias("o_attributes"), F.col("external_bases").alias("o_bases")
    )
    m = g.label("Method").select(F.col("node_id").alias("dst"), F.col("name").alias("m_name"), F.coalesce("is_static", F.lit(False)).alias("m_static"))
    held = g.edge("CONTAINS").select("src", "dst").join(m, "dst").join(owner, "src")
    name, own, cls = F.col("m_name"), F.col("o_name"), F.col("o_label") == "Class"
    typed = F.col("o_label").isin("Class", "Interface")
    constructor = typed & ((own == name) | F.startswith(name, F.concat(own, F.lit("("))) | F.startswith(own, F.concat(name, F.lit("<"))))
    ending = P.full_match(own, ".*(?:" + "|".join(P.CONFIGURE_ENDINGS) + ")")
    configuring = cls & name.isin(*P.CONFIGURE_METHODS) & (ending | own.isin(*P.CONFIGURE_CLASSES))
    accessor = F.startswith(name, F.lit("get")) | F.startswith(name, F.lit("set")) | F.startswith(name, F.lit("is"))
    external = cls & (F.coalesce("o_bases", F.lit("[]")) != "[]") & ~F.col("m_static")
    framework = cls & P.has_attribute(F.col("o_attributes"), P.FRAMEWORK_CLASS_ATTRIBUTES)
    entity = cls & P.has_attribute(F.col("o_attributes"), P.ENTITY_ATTRIBUTES) & accessor
    out_of_owner = F.coalesce((F.col("o_label") == "Interface") | constructor | configuring | external | framework | entity, F.lit(False))
    owned = held.select(F.col("dst").alias("node_id"), out_of_owner.alias("excluded"), F.lit(False).alias("called"), F.lit(False).alias("tested"))
    into = g.edge("IMPLEMENTS", "DISPATCHES_TO", "CALLS", "TESTS").select(
        F.col("dst").alias("node_id"), F.col("type").isin("IMPLEMENTS", "DISPATCHES_TO").alias("excluded"), (F.col("type") == "CALLS").alias("called"), (F.col("type") == "TESTS").alias("tested")
    )
    out = g.edge("SERVES", "OVERRIDES").select(F.col("src").alias("node_id"), F.lit(True).alias("excluded"), F.lit(False).alias("called"), F.lit(False).alias("tested"))
    rows = owned.unionByName(into).unionByName(out)
    return rows.groupBy("node_id").agg(*(F.bool_or(c).alias(c) for c in ("excluded", "called", "tested")))


def candidates(g: PropertyGraph, exclude_pattern: str = "", exclude_file_pattern: str = "", subdirectory: str = "") -> DataFrame:
    """Methods that audits judge, with ``called`` and ``tested``: neither tests nor framework entries, nor reached by dispatch.

    A null file path fails the test of paths, as it does in a query language with three-valued logic.
    """
    path, attributes = F.col("file_path"), F.col("attributes")
    name = F.col("name")
    rows = g.label("Method").where(
        ~P.is_test(path) & ~P.is_vendored(path) & ~name.isin(*P.FRAMEWORK_METHODS) & ~F.startswith(name, F.lit("main("))
        & ~P.has_attribute(attributes, P.FRAMEWORK_ATTRIBUTES) & ~P.has_attribute(attributes, ("virtual",))
        & ~F.coalesce("stub", F.lit(False)) & ~F.coalesce("is_abstract", F.lit(False))
    )
    if exclude_pattern:
        rows = rows.where(~P.full_match(F.col("full_name"), P.wrapped(exclude_pattern)))
    if exclude_file_pattern:
        rows = rows.where(~P.full_match(path, P.wrapped(exclude_file_pattern)))
    if subdirectory:
        rows = rows.where(P.in_subdirectory(path, subdirectory))
    rows = rows.join(_flags(g), "node_id", "left").where(~F.coalesce("excluded", F.lit(False)))
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return rows.select("node_id", "full_name", "file_path", "line", flag("called"), flag("tested"))


def dead_code(g: PropertyGraph, limit: int = 15, offset: int = 0, **filters: str) -> DataFrame:
    """A page of methods that nothing calls."""
    rows = candidates(g, **filters).where("NOT called").select("full_name", "file_path", "line").orderBy("file_path", "full_name")
    return rows.offset(offset).limit(limit) if limit > 0 else rows.offset(offset)


def untested(g: PropertyGraph, limit: int = 15, offset: int = 0, **filters: str) -> DataFrame:
    """A page of methods that no test method calls."""
    rows = candidates(g, **filters).where("NOT tested").select("full_name", "file_path", "line").orderBy("file_path", "full_name")
    return rows.offset(offset).limit(limit) if limit > 0 else rows.offset(offset)


def audit_stats(g: PropertyGraph, **filters: str) -> DataFrame:
    """Counts and ratios behind both pages, in one pass."""
    rows = candidates(g, **filters).agg(
        F.count(F.lit(1)).alias("total_methods"), F.count_if(~F.col("called")).alias("dead_count"), F.count_if(~F.col("tested")).alias("untested_count")
    )
    ratio = lambda c: F.when(F.col("total_methods") > 0, F.round(F.col(c) / F.col("total_methods"), 4)).otherwise(0.0)
    return rows.select("*", ratio("dead_count").alias("dead_ratio"), ratio("untested_count").alias("untested_ratio"))


def _below(g: PropertyGraph, repo: str, labels: DataFrame | None = None) -> DataFrame:
    top = g.label("Repository").where(F.col("path") == repo.rstrip("/")).select(F.col("node_id").alias("node"))
    if labels is not None:
        return g.nodes.join(inside(labels, top.withColumnRenamed("node", "node_id"), itself=False), "node_id", "left_semi")
    return g.nodes.join(reach(g.edge("CONTAINS"), top).select(F.col("node").alias("node_id")), "node_id", "left_semi")


def index_status(g: PropertyGraph, repo: str, labels: DataFrame | None = None) -> DataFrame:
    """(label, n): files, symbols and each label of a repository's symbols. ``labels``: containment.labels() of the graph."""
    rows = _below(g, repo, labels).select("node_id", "kind_label", "labels")
    symbols = rows.where("kind_label NOT IN ('File', 'Directory')")
    counts = rows.agg(F.count_if(F.col("kind_label") == "File").alias("File"), F.count_if(~F.col("kind_label").isin("File", "Directory")).alias("Symbols"))
    wide = counts.select(F.explode(F.create_map(F.lit("files"), "File", F.lit("symbols"), "Symbols")).alias("label", "n"))
    by = symbols.select(F.explode("labels").alias("label")).where("label <> 'Summarized'").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return wide.unionByName(by)


def packages(g: PropertyGraph, limit: int = 50) -> DataFrame:
    """Packages by their symbols."""
    held = g.edge("CONTAINS").select("src", F.col("dst").alias("id")).join(g.nodes.select(F.col("node_id").alias("id"), "kind_label", F.col("file_path").alias("path_of")), "id")
    p = g.label("Package").select(F.col("node_id").alias("src"), F.col("full_name").alias("package"))
    rows = p.join(held, "src", "left").groupBy("package").agg(
        F.count_distinct(F.when(F.col("kind_label").isin("Class", "Interface"), F.col("path_of"))).alias("file_count"),
        F.count_distinct(F.when(F.col("kind_label").isin("Class", "Interface", "Method", "Property", "Field"), F.col("id"))).alias("symbol_count"),
    )
    return rows.orderBy(F.desc("symbol_count"), "package").limit(limit)


def hotspots(g: PropertyGraph, limit: int = 10) -> DataFrame:
    """Methods with the most callers, tests and vendored code aside."""
    m = g.label("Method").select(F.col("node_id").alias("dst"), "full_name", "file_path", "line").where(~P.is_test(F.col("file_path")) & ~P.is_vendored(F.col("file_path")))
    callers = g.label("Method").select(F.col("node_id").alias("src"))
    n = g.edge("CALLS").select("src", "dst").join(callers, "src", "left_semi").groupBy("dst").agg(F.count_distinct("src").alias("inbound_callers"))
    return m.join(n, "dst").select("full_name", "file_path", "line", "inbound_callers").orderBy(F.desc("inbound_callers"), "full_name").limit(limit)


def service_map(g: PropertyGraph, limit: int = 100) -> DataFrame:
    ep = g.label("Endpoint").select(F.col("node_id").alias("dst"), "route", "http_method")
    m = g.label("Method").select(F.col("node_id").alias("src"), F.col("full_name").alias("handler"), "file_path")
    return g.edge("SERVES").select("src", "dst").join(ep, "dst").join(m, "src").select("route", "http_method", "handler", "file_path").orderBy("route", "http_method", "handler").limit(limit)


def files_by_language(g: PropertyGraph) -> DataFrame:
    return g.label("File").where("language IS NOT NULL").groupBy("language").agg(F.count(F.lit(1)).alias("files"))


def graph_stats(g: PropertyGraph) -> DataFrame:
    label = F.col("kind_label")
    n = lambda c: F.count_if(c)
    return g.nodes.agg(n((label == "File") & F.col("language").isNotNull()).alias("total_files"), n(label.isin(*SYMBOLS)).alias("total_symbols"),
                       n(label == "Package").alias("total_packages"), n(label == "Endpoint").alias("total_endpoints"))


def class_usages(g: PropertyGraph, cls: str, names: int = 5) -> DataFrame:
    """(what, item, n, sample): references to a class by file, and callers of its methods. One plan for all of them."""
    own = g.nodes.where(F.col("full_name") == cls).select(F.col("node_id").alias("dst"))
    m = g.nodes.select(F.col("node_id").alias("src"), "full_name", "file_path")
    refs = g.edge("REFERENCES").select("src", "dst").join(own, "dst", "left_semi").join(m, "src")
    sample: Column = F.array_join(F.slice(F.array_sort(F.collect_set("full_name")), 1, names), ",")
    by_file = refs.groupBy(F.col("file_path").alias("item")).agg(F.count_distinct("full_name").alias("n"), sample.alias("sample"))
    held = g.edge("CONTAINS").select(F.col("src").alias("cls"), "dst").join(own.withColumnRenamed("dst", "cls"), "cls", "left_semi").select("dst")
    methods = g.label("Method").select(F.col("node_id").alias("dst"), F.col("full_name").alias("item"))
    calls = g.edge("CALLS").select("src", "dst").join(held, "dst", "left_semi").join(methods, "dst").join(m.join(g.label("Method").select(F.col("node_id").alias("src")), "src", "left_semi"), "src")
    by_method = calls.groupBy("item").agg(F.count_distinct("full_name").alias("n"), sample.alias("sample"))
    return by_file.select(F.lit("references").alias("what"), "*").unionByName(by_method.select(F.lit("callers").alias("what"), "*"))


def call_resolution(g: PropertyGraph) -> DataFrame:
    """How many call edges and call sites there are, and of how many methods any call is known."""
    calls = g.edge("CALLS").agg(F.count(F.lit(1)).alias("call_edges"), F.sum(F.size("call_sites")).cast("bigint").alias("call_sites"), F.count_distinct("src").alias("callers"))
    total = g.label("Method").agg(F.count(F.lit(1)).alias("methods"))
    return calls.join(total).select("call_edges", "call_sites", "callers", "methods", F.round(F.col("callers") / F.col("methods"), 4).alias("resolved_ratio"))  # one row each
