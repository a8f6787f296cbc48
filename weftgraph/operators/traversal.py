"""Paths over calls and over all edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.predicates import HTTP_VERB_ATTRIBUTES, full_match, is_test, mentions
from weftgraph.graph import PropertyGraph
from weftgraph.plans.expand import nearest, spread, trails, trails_between
from weftgraph.schema import EDGE_TYPES

CALLING = ("CALLS", "DISPATCHES_TO")
MAX_DEPTH, MAX_EXPLORE = 10, 50
MAX_PATHS, MAX_ENTRIES = 10, 100


def clamp(depth: int, most: int = MAX_DEPTH) -> int:
    return max(1, min(depth, most))


def _node(g: PropertyGraph, full_name: str, *labels: str) -> DataFrame:
    rows = g.label(*labels) if labels else g.nodes
    return rows.where(F.col("full_name") == full_name).select(F.col("node_id").alias("node"))


def _name(node_id: Column) -> Column:
    """A node id without its label: a full name."""
    return F.regexp_replace(node_id, r"^[A-Za-z]+:", "")


def _names(ids: str) -> Column:
    return F.transform(ids, _name)


def trace(g: PropertyGraph, start: str, end: str, max_depth: int = 6, limit: int = MAX_PATHS) -> DataFrame:
    """Call paths between two methods, shortest first; no path is made that is longer than the last one wanted."""
    found = trails_between(g.edge(*CALLING), _node(g, start, "Method"), _node(g, end, "Method"), clamp(max_depth), limit)
    return found.select("depth", F.array_join(_names("nodes"), " > ").alias("path")).orderBy("depth", "path").limit(limit)


def entry_points(g: PropertyGraph, method: str, max_depth: int = 8, exclude_pattern: str = "", exclude_tests: bool = True, limit: int = MAX_ENTRIES) -> DataFrame:
    """(entry, path): roots of calls and attributed controllers that reach a method, by their shortest (then least) path.

    A root has no caller but excluded ones. The method itself is never its own entry.
    """
    depth = clamp(max_depth)
    best = nearest(g.edge(*CALLING), _node(g, method, "Method"), depth, _name(F.col("node")), reverse=True).withColumnRenamed("node", "node_id")
    entries = g.label("Method").select("node_id", "full_name", "file_path", "attributes").join(best, "node_id")
    visible = g.nodes.select(F.col("node_id").alias("src"), F.col("full_name").alias("caller"), F.col("file_path").alias("caller_path"))
    if exclude_pattern:
        entries = entries.where(~full_match(F.col("full_name"), exclude_pattern))
        visible = visible.where(~full_match(F.col("caller"), exclude_pattern))
    if exclude_tests:
        entries = entries.where(~is_test(F.col("file_path")))
        visible = visible.where(~is_test(F.col("caller_path")))
    called = g.edge("CALLS").select("src", F.col("dst").alias("node_id")).join(visible, "src", "left_semi").select("node_id").distinct()
    controllers = g.nodes.where(mentions(F.col("attributes"), ("ApiController",))).select(F.col("node_id").alias("src"))
    held = g.edge("CONTAINS").select("src", F.col("dst").alias("node_id")).join(controllers, "src", "left_semi").select("node_id").distinct()
    roots = entries.join(called, "node_id", "left_anti").select("node_id")
    verbs = entries.where(mentions(F.col("attributes"), HTTP_VERB_ATTRIBUTES)).select("node_id")
    chosen = roots.unionByName(verbs).unionByName(entries.join(held, "node_id", "left_semi").select("node_id")).distinct()
    return entries.join(chosen, "node_id", "left_semi").select(F.col("full_name").alias("entry"), "depth", "path").orderBy("depth", "entry").limit(limit)


def call_depth(g: PropertyGraph, method: str, max_depth: int = 3) -> DataFrame:
    """(full_name, file_path, depth): callees by every depth at which a trail meets them. Trails are many in a dense graph; ``max_depth`` bounds them."""
    found = trails(g.edge(*CALLING), _node(g, method, "Method"), 1, clamp(max_depth))
    m = g.label("Method").select(F.col("node_id").alias("node"), "full_name", "file_path")
    return found.join(m, "node").select("full_name", "file_path", "depth").distinct()


def dependencies(g: PropertyGraph, full_name: str, max_depth: int = 1) -> DataFrame:
    """(full_name, depth), one row per trail over REFERENCES."""
    found = trails(g.edge("REFERENCES"), _node(g, full_name), 1, min(max_depth, 5))
    return found.join(g.nodes.select(F.col("node_id").alias("node"), "full_name", "kind_label"), "node").select("full_name", "kind_label", "depth")


def explore(g: PropertyGraph, full_name: str, depth: int = 1) -> DataFrame:
    """(source, target, type) of edges within ``depth`` hops out of, or into, a symbol, between nodes with full names.

    An edge is on such a path when its near end is less than ``depth`` hops away; nodes without a full name are
    walked through but not shown.
    """
    depth = clamp(depth, MAX_EXPLORE)
    edges = g.edge(*EDGE_TYPES)
    own = _node(g, full_name)
    named = g.nodes.where("full_name IS NOT NULL AND full_name <> ''").select("node_id", "full_name")
    out = []
    for reverse in (False, True):
        near = own if depth == 1 else own.unionByName(spread(edges, own, depth - 1, reverse).select("node")).distinct()
        out.append(edges.join(near.withColumnRenamed("node", "dst" if reverse else "src"), "dst" if reverse else "src", "left_semi").select("src", "dst", "type"))
    links = out[0].unionByName(out[1]).distinct()
    links = links.join(named.withColumnsRenamed({"node_id": "src", "full_name": "source"}), "src").join(named.withColumnsRenamed({"node_id": "dst", "full_name": "target"}), "dst")
    return links.select("source", "target", "type").distinct()


def transitive_callers(g: PropertyGraph, method: str) -> DataFrame:
    """Callers exactly two hops away that are neither direct callers nor the method itself."""
    m = _node(g, method, "Method")
    found = trails(g.edge("CALLS"), m, 2, 2, reverse=True).select("node").distinct()
    direct = g.edge("CALLS").join(m.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("node"))
    found = found.join(direct, "node", "left_anti").join(m, "node", "left_anti")
    return g.label("Method").join(found.withColumnRenamed("node", "node_id"), "node_id", "left_semi").select("full_name", "file_path", "line")


def without_orphans(nodes: DataFrame, links: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A shown graph (full_name; source, target) after nodes are removed: links go with them, and nodes that lose their last link."""
    kept = links.join(removed.withColumnRenamed("full_name", "source"), "source", "left_anti").join(removed.withColumnRenamed("full_name", "target"), "target", "left_anti")
    ends = lambda x: x.select(F.col("source").alias("full_name")).unionByName(x.select(F.col("target").alias("full_name"))).distinct()
    lost = ends(links).join(ends(kept), "full_name", "left_anti")
    return nodes.join(removed, "full_name", "left_anti").join(lost, "full_name", "left_anti"), kept
