"""Upserts and deletes as functions from graph to graph. Nothing is changed in place; write() the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import PropertyGraph
from weftgraph.operators.containment import inside
from weftgraph.plans.expand import reach
from weftgraph.plans.staging import staged
from weftgraph.schema import EDGE_FIELDS, NODE_FIELDS, edge_columns, node_columns, node_id

FLAGS = ("is_abstract", "is_static", "is_classmethod", "is_async")
OWNED_EDGES = ("CALLS", "INHERITS", "IMPLEMENTS", "DISPATCHES_TO", "OVERRIDES", "REFERENCES", "TESTS", "SERVES", "HTTP_CALLS", "IMPORTS")


def upsert_nodes(g: PropertyGraph, rows: DataFrame, order: str | None = None) -> PropertyGraph:
    """MERGE by node_id. Values of ``rows`` win where they are not null; other properties stay. Of several rows of a
    key the last by ``order`` wins (by default the largest). Labels and languages are added to those there are."""
    seq = F.col(order) if order else F.lit(0)
    have = [c for c in NODE_FIELDS if c in rows.columns]
    new = rows.select(*have, seq.alias("_seq")).select(*(F.col(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in NODE_FIELDS.items()), "_seq", F.lit(1).alias("_new"))
    both = g.nodes.select(*NODE_FIELDS, F.lit(0).alias("_seq"), F.lit(0).alias("_new")).unionByName(new)
    out: list[Column] = []
    for c, t in NODE_FIELDS.items():
        if c == "node_id":
            continue
        if t == "array<string>":
            out.append(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c))
        else:
            out.append(F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("_new", "_seq", F.col(c).cast("string")))).alias(c))
    merged = both.groupBy("node_id").agg(*out)
    empty = [c for c, t in NODE_FIELDS.items() if t == "array<string>"]
    merged = merged.withColumns({c: F.when(F.size(c) > 0, F.col(c)) for c in empty})
    return PropertyGraph(merged.select(*NODE_FIELDS), g.edges)


def upsert_edges(g: PropertyGraph, rows: DataFrame, dedupe_sites: bool = True) -> PropertyGraph:
    """MERGE by (src, type, dst, kind). Edges whose ends are missing are not written. Call sites are added to those there are;
    with ``dedupe_sites`` each is kept once, so that a second run changes nothing."""
    # Few ends are missing: these, made of the distinct ends, meet the rows, so that rows with their call sites are not shuffled by either end.
    ends = rows.select(F.col("src").alias("node_id")).unionByName(rows.select(F.col("dst").alias("node_id"))).distinct()
    missing = staged(ends.join(g.nodes.select("node_id"), "node_id", "left_anti"), "missing-ends")
    new = rows.where("src IS NOT NULL AND dst IS NOT NULL")
    for end in ("src", "dst"):
        new = new.join(missing.withColumnRenamed("node_id", end), end, "left_anti")
    both = g.edges.select(*EDGE_FIELDS).unionByName(new.select(*EDGE_FIELDS))
    sites = F.flatten(F.collect_list("call_sites"))
    sites = F.array_sort(F.array_distinct(sites) if dedupe_sites else sites)
    both = both.repartition("src", "dst", "type", "kind")  # before they are gathered: hardly two rows of a task have a key in common
    merged = both.groupBy("src", "dst", "type", "kind").agg(F.max(F.col("call_sites").isNotNull()).alias("_has"), sites.alias("_sites"), F.min("edge_id").alias("edge_id"))
    return PropertyGraph(g.nodes, merged.withColumn("call_sites", F.when(F.col("_has"), F.col("_sites"))).select(*EDGE_FIELDS))


def add_references(g: PropertyGraph, rows: DataFrame) -> PropertyGraph:
    """References (source, target, kind by full name). A target that is missing becomes a library class first."""
    missing = rows.select(F.col("target").alias("full_name")).distinct().join(g.nodes.where("full_name IS NOT NULL").select("full_name"), "full_name", "left_anti")
    stubs = missing.select(node_columns(node_id=node_id("Class", F.col("full_name")), labels=F.array(F.lit("Class")), kind_label=F.lit("Class"), full_name=F.col("full_name"),
                                        name=F.substring_index("full_name", ".", -1), kind=F.lit("class"), library=F.lit(True)))
    out = PropertyGraph(g.nodes.unionByName(stubs), g.edges)
    named = out.nodes.where("full_name IS NOT NULL").select("node_id", "full_name", "kind_label")
    ends = rows.join(named.select(F.col("full_name").alias("source"), F.col("node_id").alias("s")), "source").join(
        named.where("kind_label IN ('Class', 'Interface')").select(F.col("full_name").alias("target"), F.col("node_id").alias("t")), "target"
    )
    return upsert_edges(out, ends.select(edge_columns(F.col("s"), F.col("t"), "REFERENCES", F.col("kind"))))


def update_properties(g: PropertyGraph, rows: DataFrame) -> PropertyGraph:
    """``rows``: full_name and any properties, e.g. attributes, external_bases or one of FLAGS; null leaves a property as it is."""
    keyed = g.nodes.select("node_id", "full_name").join(rows, "full_name").drop("full_name")
    return upsert_nodes(g, keyed)


def set_summaries(g: PropertyGraph, rows: DataFrame, now: Column | None = None) -> PropertyGraph:
    """``rows``: full_name, summary. Adds the label Summarized."""
    stamp = F.current_timestamp() if now is None else now
    return update_properties(g, rows.select("full_name", "summary", stamp.alias("summary_updated_at"), F.array(F.lit("Summarized")).alias("labels")))


def remove_summaries(g: PropertyGraph, names: DataFrame) -> PropertyGraph:
    gone = names.select("full_name").distinct().withColumn("_gone", F.lit(True))
    rows = g.nodes.join(gone, "full_name", "left")
    hit = F.coalesce("_gone", F.lit(False))
    rows = rows.withColumns({
        "labels": F.when(hit, F.array_remove("labels", "Summarized")).otherwise(F.col("labels")),
        "summary": F.when(~hit, F.col("summary")), "summary_updated_at": F.when(~hit, F.col("summary_updated_at")),
    })
    return PropertyGraph(rows.select(*NODE_FIELDS), g.edges)


def summary_table(g: PropertyGraph) -> DataFrame:
    """What must outlive a rebuild; set_summaries() puts it back."""
    return g.nodes.where("summary IS NOT NULL").select("full_name", "summary")


def delete_nodes(g: PropertyGraph, ids: DataFrame) -> PropertyGraph:
    """Without the nodes of ``ids`` (node_id) and without their edges."""
    edges = g.edges.join(ids.select(F.col("node_id").alias("src")), "src", "left_anti").join(ids.select(F.col("node_id").alias("dst")), "dst", "left_anti")
    return PropertyGraph(g.nodes.join(ids.select("node_id"), "node_id", "left_anti").select(*NODE_FIELDS), edges.select(*EDGE_FIELDS))


def _under(g: PropertyGraph, label: str, path: str, labels: DataFrame | None = None) -> DataFrame:
    """(node_id): by containment labels where they are given, else level by level."""
    top = g.label(label).where(F.col("path") == path).select(F.col("node_id").alias("node"))
    if labels is not None:
        return inside(labels, top.withColumnRenamed("node", "node_id"))
    return top.unionByName(reach(g.edge("CONTAINS"), top).select("node")).distinct().withColumnRenamed("node", "node_id")


def delete_file(g: PropertyGraph, path: str, labels: DataFrame | None = None) -> PropertyGraph:
    """A file with all that it contains. ``labels``, here and below: containment.labels() of the graph."""
    return delete_nodes(g, _under(g, "File", path, labels))


def delete_project(g: PropertyGraph, path: str, labels: DataFrame | None = None) -> PropertyGraph:
    return delete_nodes(g, _under(g, "Repository", path.rstrip("/"), labels))


def delete_orphans(g: PropertyGraph, path: str, keep: DataFrame, labels: DataFrame | None = None) -> PropertyGraph:
    """Symbols of a file that ``keep`` (full_name) lacks. Only those whose own file it is: packages are shared."""
    held = _under(g, "File", path, labels)
    gone = g.nodes.join(held, "node_id", "left_semi").where((F.col("file_path") == path) & (F.col("kind_label") != "File")).join(keep, "full_name", "left_anti")
    return delete_nodes(g, gone.select("node_id"))


def delete_outgoing(g: PropertyGraph, path: str, labels: DataFrame | None = None) -> PropertyGraph:
    """Edges that start in a file, but for CONTAINS."""
    held = _under(g, "File", path, labels).withColumnRenamed("node_id", "src").withColumn("_own", F.lit(True))
    edges = g.edges.join(held, "src", "left").where(F.col("_own").isNull() | ~F.col("type").isin(*OWNED_EDGES))
    return PropertyGraph(g.nodes, edges.select(*EDGE_FIELDS))


def delete_orphan_endpoints(g: PropertyGraph) -> PropertyGraph:
    """Endpoints that nothing serves or calls."""
    used = g.edge("SERVES", "HTTP_CALLS").select(F.col("dst").alias("node_id"))
    return delete_nodes(g, g.label("Endpoint").join(used, "node_id", "left_anti").select("node_id"))


def rename_file(g: PropertyGraph, old: str, new: str) -> PropertyGraph:
    """A file under another path, with its symbols' file paths and the ends of its edges."""
    own = F.col("path") == old
    name = F.lit(new.rsplit("/", 1)[-1])
    is_file = (F.col("kind_label") == "File") & F.coalesce(own, F.lit(False))
    nodes = g.nodes.withColumns({
        "node_id": F.when(is_file, node_id("File", F.lit(new))).otherwise(F.col("node_id")), "name": F.when(is_file, name).otherwise(F.col("name")),
        "path": F.when(is_file, F.lit(new)).otherwise(F.col("path")), "file_path": F.when(F.col("file_path") == old, F.lit(new)).otherwise(F.col("file_path")),
    })
    moved = lambda c: F.when(F.col(c) == f"File:{old}", F.lit(f"File:{new}")).otherwise(F.col(c))
    edges = g.edges.withColumns({"src": moved("src"), "dst": moved("dst")})
    edge_id = F.xxhash64("src", "type", "dst", F.coalesce("kind", F.lit("")))
    return PropertyGraph(nodes.select(*NODE_FIELDS), edges.withColumn("edge_id", edge_id).select(*EDGE_FIELDS))


def set_commit(g: PropertyGraph, repo: str, commit: str) -> PropertyGraph:
    hit = (F.col("kind_label") == "Repository") & (F.col("path") == repo.rstrip("/"))
    return PropertyGraph(g.nodes.withColumn("last_indexed_commit", F.when(hit, F.lit(commit)).otherwise(F.col("last_indexed_commit"))), g.edges)


def replace_file(g: PropertyGraph, path: str, fresh: PropertyGraph) -> PropertyGraph:
    """One file as ``fresh`` has it: its symbols and what starts in them. Symbols that are gone go with their edges;
    edges of other files into symbols that stay are kept, and so are properties that ``fresh`` does not set."""
    own = _under(fresh, "File", path)
    mine = fresh.nodes.join(own, "node_id", "left_semi").where((F.col("file_path") == path) | (F.col("path") == path))
    trimmed = delete_outgoing(delete_orphans(g, path, mine.where("full_name IS NOT NULL").select("full_name")), path)
    edges = fresh.edges.join(own.withColumnRenamed("node_id", "src"), "src", "left_semi")
    return upsert_edges(upsert_nodes(trimmed, mine), edges)


def _held_by(g: PropertyGraph, paths: DataFrame) -> DataFrame:
    """(file, node_id): the files of ``paths`` (path) with all that they contain."""
    top = g.label("File").join(paths.select("path").distinct(), "path", "left_semi").select(F.col("node_id").alias("node"))
    own = top.select(F.col("node").alias("file"), F.col("node").alias("node_id"))
    return own.unionByName(reach(g.edge("CONTAINS"), top).select(F.col("start").alias("file"), F.col("node").alias("node_id"))).distinct()


def delete_files(g: PropertyGraph, paths: DataFrame, labels: DataFrame | None = None) -> PropertyGraph:
    """delete_file() for any number of paths in one plan."""
    if labels is not None:
        return delete_nodes(g, inside(labels, g.label("File").join(paths.select("path").distinct(), "path", "left_semi").select("node_id")))
    return delete_nodes(g, _held_by(g, paths).select("node_id").distinct())


def replace_files(g: PropertyGraph, paths: DataFrame, fresh: PropertyGraph) -> PropertyGraph:
    """replace_file() for any number of paths in one plan; files that are new come in with their folders."""
    wanted = paths.select("path").distinct()
    mine = fresh.nodes.join(wanted.withColumnRenamed("path", "file_path"), "file_path", "left_semi").select(*NODE_FIELDS)
    held = _held_by(g, wanted).select("node_id").distinct()
    gone = g.nodes.join(held, "node_id", "left_semi").join(wanted.withColumnRenamed("path", "file_path"), "file_path", "left_semi")
    gone = gone.where("kind_label <> 'File'").join(mine.select("node_id"), "node_id", "left_anti").select("node_id")
    left = delete_nodes(g, gone)
    starts = held.withColumnRenamed("node_id", "src").withColumn("_own", F.lit(True))
    kept = left.edges.join(starts, "src", "left").where(F.col("_own").isNull() | ~F.col("type").isin(*OWNED_EDGES)).select(*EDGE_FIELDS)
    folders = fresh.label("Directory", "Repository")
    ids = mine.select("node_id").unionByName(folders.select("node_id")).withColumnRenamed("node_id", "src")
    edges = fresh.edges.join(ids.distinct(), "src", "left_semi")
    return upsert_edges(upsert_nodes(PropertyGraph(left.nodes, kept), mine.unionByName(folders.select(*NODE_FIELDS))), edges)
