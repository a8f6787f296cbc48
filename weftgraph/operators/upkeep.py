"""Derived edges kept up to date: from what has changed in the facts to what changes in what follows from them.

Facts are a graph as parsers give it; derived edges are rows (rule, edge) beside it, each with the rule that made it, so
one edge may follow from several rules and goes once none of them holds it. ``derived()`` makes all rows of a graph, and
``derived_change()`` only those that a change of the facts touches. Every rule works alike:

1. Changed keys in, affected keys out: the owners of changed methods, their heirs, their implementers, their callers.
   What connects them may be old or new, so both graphs' edges are asked.
2. The affected keys' surroundings, as a small graph: the keys, what they inherit from and implement, and the methods
   of all these.
3. The rule itself (``derive``) on that small graph. Of its rows those of the affected keys are the new ones; the rows
   of these keys that there were before and are not among them are gone.

So a batch makes rows in proportion to the neighbourhood of what has changed, and asks the stored tables only for
rows by key: up to ``LITERALS`` keys go down to the Parquet readers as values (tables lie sorted by these keys, and have
Bloom filters for others), more as a semi-join.

A method lies in one class or interface, as in sources; of two owners each would have to be named as changed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import routes
from weftgraph.graph import PropertyGraph
from weftgraph.operators import derive, dml
from weftgraph.plans.staging import staged
from weftgraph.schema import EDGE_FIELDS, NODE_FIELDS, edge_columns

LITERALS = 200  # keys that a filter may hold
LIST = 10  # of a list of values that Parquet readers take as equalities
KEY = ["src", "type", "dst", "_kind"]
RULES = ("implements", "method_implements", "abstract_dispatch", "structural_dispatch", "overrides", "tests", "callbacks", "serves", "http_calls")


@dataclass(frozen=True)
class Keys:
    """A set of keys, as a table (node) and, where they are few, as values."""

    frame: DataFrame
    values: list[str] | None

    @classmethod
    def of(cls, *sets: DataFrame | Keys) -> Keys:
        """The union of sets; more than ``LITERALS`` are staged and never reach the driver."""
        frames = [s.frame if isinstance(s, Keys) else s.select("node") for s in sets]
        rows = reduce(DataFrame.unionByName, frames).where("node IS NOT NULL").distinct()
        found = [r[0] for r in rows.limit(LITERALS + 1).collect()]
        if len(found) > LITERALS:
            return cls(staged(rows, "keys"), None)
        return cls(rows.sparkSession.createDataFrame([(x,) for x in found], "node string"), found)

    def __bool__(self) -> bool:
        return self.values != []


def only(rows: DataFrame, column: str, keys: Keys) -> DataFrame:
    """The rows whose ``column`` is among ``keys``: by a filter that readers understand, or a semi-join."""
    if keys.values is None:
        return rows.join(keys.frame.select(F.col("node").alias(column)), column, "left_semi").select(rows.columns)
    if not keys.values:
        return rows.where(F.lit(False))
    lists = [F.col(column).isin(keys.values[k : k + LIST]) for k in range(0, len(keys.values), LIST)]
    return rows.where(reduce(Column.__or__, lists))


def _as(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(F.col(column).alias("node"))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_kind", F.coalesce("kind", F.lit("")))


def _less(rows: DataFrame, other: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    return _keyed(rows).join(_keyed(other).select(*KEY, *more), [*KEY, *more], "left_anti").select(rows.columns)


@dataclass(frozen=True)
class Change:
    """New and changed nodes and edges, and those that are gone, as whole rows."""

    nodes: DataFrame
    nodes_gone: DataFrame
    edges: DataFrame
    edges_gone: DataFrame

    def staged(self) -> Change:
        return Change(*(staged(x, "change") for x in (self.nodes, self.nodes_gone, self.edges, self.edges_gone)))

    def applied(self, g: PropertyGraph) -> PropertyGraph:
        ids = self.nodes.select("node_id").unionByName(self.nodes_gone.select("node_id"))
        edges = _less(g.edges.select(*EDGE_FIELDS), self.edges.unionByName(self.edges_gone))
        return PropertyGraph(g.nodes.select(*NODE_FIELDS).join(F.broadcast(ids) if _few(ids) else ids, "node_id", "left_anti").unionByName(self.nodes), edges.unionByName(self.edges))


def _few(rows: DataFrame) -> bool:
    return rows.limit(100_001).count() <= 100_000


def files_change(g: PropertyGraph, changed: DataFrame, gone: DataFrame, fresh: PropertyGraph) -> Change:
    """What replacing the files ``changed`` (path) by what ``fresh`` has of them, and deleting the files ``gone`` (path), does to the facts ``g``.

    As dml.replace_files() and dml.delete_files() have it: symbols that are gone go with their edges, edges of other files
    into symbols that stay are kept, and so are properties that ``fresh`` does not set.
    """
    files = Keys.of(_as(changed, "path"), _as(gone, "path"))
    old = only(g.nodes, "file_path", files).unionByName(only(g.label("File").where("file_path IS NULL"), "path", files))
    old = staged(old.select(*NODE_FIELDS), "old-symbols")
    of_file = F.coalesce("file_path", F.when(F.col("kind_label") == "File", F.col("path")))
    own = fresh.nodes.withColumn("node", of_file)
    mine = own.join(_as(changed, "path").distinct(), "node", "left_semi").select(*NODE_FIELDS)
    # Folders, packages, endpoints and stubs belong to no file: they come in where they are not yet.
    shared = staged(own.where("coalesce(node, '') = ''").select(*NODE_FIELDS), "shared-nodes")
    have = staged(only(g.nodes, "node_id", Keys.of(_as(shared, "node_id"))).select("node_id"), "known-nodes")
    mine = staged(mine.unionByName(shared.join(have, "node_id", "left_anti")), "fresh-symbols")
    kept = old.join(mine.select("node_id"), "node_id", "left_semi")
    nodes = staged(dml.upsert_nodes(PropertyGraph(kept, g.edges.where(F.lit(False))), mine).nodes, "new-symbols")
    nodes_gone = staged(old.join(mine.select("node_id"), "node_id", "left_anti").select(*NODE_FIELDS), "gone-symbols")

    starts, lost = Keys.of(_as(old, "node_id")), Keys.of(_as(nodes_gone, "node_id"))
    before = only(g.edges, "src", starts).unionByName(only(g.edges, "dst", lost)).select(*EDGE_FIELDS)
    before = staged(before.dropDuplicates(["src", "type", "dst", "kind"]), "old-edges")
    sources = mine.select("node_id").unionByName(shared.select("node_id")).distinct().withColumnRenamed("node_id", "src")
    after = staged(fresh.edges.join(sources, "src", "left_semi").select(*EDGE_FIELDS), "fresh-edges")
    ends = Keys.of(_as(after, "dst"))
    there = only(g.nodes, "node_id", ends).select("node_id").join(nodes_gone.select("node_id"), "node_id", "left_anti")
    there = there.unionByName(nodes.select("node_id")).distinct()
    after = staged(after.join(there.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select(*EDGE_FIELDS), "new-edges")
    same = before.join(after, ["src", "type", "dst"]).where(before["kind"].eqNullSafe(after["kind"]) & before["call_sites"].eqNullSafe(after["call_sites"])).select(before["src"], before["type"], before["dst"], before["kind"])
    fresh_ones = _less(after, same)
    held = only(g.edges, "src", Keys.of(_as(shared, "node_id"))).select(*EDGE_FIELDS)  # a folder holds what it held
    return Change(nodes, nodes_gone, _less(fresh_ones, _less(held, before)), _less(before, after)).staged()


class _World:
    """A change between two graphs, with the sets of keys that rules start from."""

    def __init__(self, old: PropertyGraph, change: Change):
        self.old, self.change, self.new = old, change, change.applied(old)
        self.implements_now: DataFrame = change.edges.where(F.lit(False))  # classes' derived IMPLEMENTS after the change

    @cached_property
    def changed_nodes(self) -> Keys:
        return Keys.of(_as(self.change.nodes, "node_id"), _as(self.change.nodes_gone, "node_id"))

    def changed_edges(self, *types: str) -> DataFrame:
        return self.change.edges.unionByName(self.change.edges_gone).where(F.col("type").isin(*types))

    def both(self, *types: str) -> DataFrame:
        """Edges of either graph."""
        return self.old.edge(*types).select(*EDGE_FIELDS).unionByName(self.change.edges.where(F.col("type").isin(*types)))

    @cached_property
    def owners(self) -> Keys:
        """Changed classes and interfaces, and those that have, or had, a changed method."""
        held = only(self.both("CONTAINS"), "dst", self.changed_nodes)
        return Keys.of(_as(self.changed_edges("CONTAINS"), "src"), _as(held, "src"), self.changed_nodes)

    def methods_of(self, owners: Keys) -> Keys:
        """What either graph has below ``owners`` (node)."""
        return Keys.of(_as(only(self.both("CONTAINS"), "src", owners), "dst"))

    def around(self, tops: Keys, more: DataFrame | None = None) -> PropertyGraph:
        """The new graph's part of ``tops`` (node): they, what they contain, and the INHERITS and IMPLEMENTS that start in them; with further edges."""
        edges = staged(only(self.new.edge("CONTAINS", "INHERITS", "IMPLEMENTS"), "src", tops).select(*EDGE_FIELDS), "around-edges")
        ids = Keys.of(tops, _as(edges.where("type = 'CONTAINS'"), "dst"))
        nodes = staged(only(self.new.nodes, "node_id", ids).select(*NODE_FIELDS), "around-nodes")
        return PropertyGraph(nodes, edges if more is None else edges.unionByName(more))


def _walk(edges: DataFrame, seeds: Keys, reverse: bool = False, most: int | None = None) -> Keys:
    """``seeds`` and what is reached from them, level by level; each level asks for the edges of its frontier alone."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    known = at = seeds
    depth = 0
    while at and (most is None or depth < most):
        depth += 1
        at = Keys.of(_as(only(edges, a, at), b).distinct().join(known.frame, "node", "left_anti"))
        known = Keys.of(known, at) if at else known
    return known


# Rules: (column of a row by which it belongs to a key, these keys as nodes, new rows).

Part = tuple[str, Keys, DataFrame]


def _implements(w: _World) -> Part:
    below = _walk(w.both("INHERITS"), Keys.of(_as(w.changed_edges("INHERITS"), "src"), w.changed_nodes), reverse=True, most=derive.INHERITED_LEVELS)
    keys = Keys.of(_as(w.changed_edges("IMPLEMENTS"), "src"), _as(only(w.both("IMPLEMENTS"), "dst", below), "src"))
    starts = Keys.of(_as(only(w.new.edge("IMPLEMENTS"), "src", keys), "dst"))
    g = w.around(Keys.of(keys, _walk(w.new.edge("INHERITS"), starts, most=derive.INHERITED_LEVELS)))
    return "src", keys, only(derive.transitive_implements(g), "src", keys)


def _method_implements(w: _World, implements: DataFrame, moved: DataFrame) -> Part:
    """``implements``: the derived IMPLEMENTS of classes, old and new; ``moved``: those of them that came or went."""
    both = w.both("IMPLEMENTS").unionByName(implements)
    keys = Keys.of(w.owners, _as(w.changed_edges("IMPLEMENTS").unionByName(moved), "src"), _as(only(both, "dst", w.owners), "src"))
    methods = w.methods_of(keys)
    said = only(w.implements_now, "src", keys)
    starts = Keys.of(_as(only(w.new.edge("IMPLEMENTS"), "src", keys).select(*EDGE_FIELDS).unionByName(said), "dst"))
    g = w.around(Keys.of(keys, starts), said)
    rows, _ = derive.method_implements(g)
    return "src", methods, only(rows, "src", methods)


def _abstract(w: _World) -> Part:
    keys = Keys.of(w.owners, _as(w.changed_edges("INHERITS"), "src"), _as(only(w.both("INHERITS"), "dst", w.owners), "src"))
    methods = w.methods_of(keys)
    g = w.around(Keys.of(keys, _as(only(w.new.edge("INHERITS"), "src", keys), "dst")))
    return "dst", methods, only(derive.abstract_dispatch(g), "dst", methods)


def _named(w: _World, owners: Keys, label: str) -> Keys:
    """The names of the methods of those of ``owners`` that have the label, as (node)."""
    tops = Keys.of(_as(only(w.new.label(label), "node_id", owners), "node_id"))
    inside = w.around(tops)
    return Keys.of(_as(inside.label("Method"), "name"))


def _holders(w: _World, names: Keys, label: str) -> Keys:
    """Nodes of the label that have a method of one of the names."""
    methods = Keys.of(_as(only(w.new.label("Method"), "name", names), "node_id"))
    tops = Keys.of(_as(only(w.new.edge("CONTAINS"), "dst", methods), "src"))
    return Keys.of(_as(only(w.new.label(label), "node_id", tops), "node_id"))


def _structural(w: _World, implements: DataFrame, moved: DataFrame) -> list[Part]:
    """Rows belong to a class by their method, and to an interface by its method; either may have changed."""
    keys = Keys.of(w.owners, _as(w.changed_edges("IMPLEMENTS").unionByName(moved), "src"))
    changed = Keys.of(_as(only(w.new.label("Interface"), "node_id", w.owners), "node_id"))
    classes = Keys.of(keys, _rarest_holders(w, changed))
    g = w.around(Keys.of(classes, _holders(w, _named(w, keys, "Class"), "Interface"), changed), only(w.implements_now, "src", classes))
    rows = staged(derive.structural_dispatch(g), "structural")
    of_classes, of_interfaces = w.methods_of(keys), w.methods_of(w.owners)
    return [("dst", of_classes, only(rows, "dst", of_classes)), ("src", of_interfaces, only(rows, "src", of_interfaces))]


def _rarest_holders(w: _World, interfaces: Keys) -> Keys:
    """Classes that have the rarest of the method names of an interface: none other can have them all."""
    g = w.around(interfaces)
    names = g.edge("CONTAINS").select(F.col("src").alias("ifc"), F.col("dst").alias("node_id")).join(g.label("Method").select("node_id", "name"), "node_id").select("ifc", "name").distinct()
    names = staged(names, "contract-names")
    named = only(w.new.label("Method"), "name", Keys.of(_as(names, "name"))).groupBy("name").agg(F.count(F.lit(1)).alias("often"))
    rarest = names.join(named, "name").groupBy("ifc").agg(F.min(F.struct("often", "name")).alias("r")).select(F.col("r.name").alias("node"))
    return _holders(w, Keys.of(rarest), "Class")


def _overrides(w: _World) -> Part:
    keys = _walk(w.both("INHERITS"), Keys.of(w.owners, _as(w.changed_edges("INHERITS"), "src")), reverse=True)
    methods = w.methods_of(keys)
    g = w.around(_walk(w.new.edge("INHERITS"), keys))
    return "src", methods, only(derive.overrides(g), "src", methods)


def _tests(w: _World) -> Part:
    keys = Keys.of(_as(w.changed_edges("CALLS"), "src"), w.changed_nodes, _as(only(w.both("CALLS"), "dst", w.changed_nodes), "src"))
    calls = staged(only(w.new.edge("CALLS"), "src", keys).select(*EDGE_FIELDS), "calls")
    nodes = only(w.new.label("Method"), "node_id", Keys.of(keys, _as(calls, "dst"))).select(*NODE_FIELDS)
    return "src", keys, only(derive.tests(PropertyGraph(nodes, calls)), "src", keys)


def _callbacks(w: _World) -> Part:
    keys = Keys.of(w.changed_nodes, _as(w.changed_edges("CONTAINS"), "dst"), _as(only(w.both("CONTAINS"), "src", w.changed_nodes), "dst"))
    held = staged(only(w.new.edge("CONTAINS"), "dst", keys).select(*EDGE_FIELDS), "holders")
    nodes = only(w.new.nodes, "node_id", Keys.of(keys, _as(held, "src"))).select(*NODE_FIELDS)
    return "dst", keys, only(derive.callback_calls(PropertyGraph(nodes, held)), "dst", keys)


def _shapes(ends: DataFrame) -> DataFrame:
    return ends.select(F.concat_ws(" ", "http_method", routes.shape(F.col("route"))).alias("node"))


def _http(w: _World) -> tuple[Part, Part]:
    """SERVES belong to their endpoint, HTTP_CALLS to their caller: one whose calls, or the definitions that these could reach, have changed."""
    touched = w.changed_nodes
    tries = F.explode(F.array(*(F.concat(F.lit(p), routes.strip_base(F.col("route"))) for p in routes.PREFIXES))).alias("route")
    serving = staged(w.changed_edges("SERVES").unionByName(only(w.both("SERVES"), "src", touched)).unionByName(only(w.both("SERVES"), "dst", touched)), "changed-serves")
    served = Keys.of(_as(serving, "dst"))
    known = w.old.label("Endpoint").select(*NODE_FIELDS).unionByName(w.change.nodes.where("kind_label = 'Endpoint'"))
    shapes = Keys.of(_shapes(only(known, "node_id", served)))
    # Shapes are no stored column: endpoints, of which there are few beside methods, are all looked at.
    tried = known.select("node_id", "http_method", tries)
    tried = tried.select("node_id", F.concat_ws(" ", "http_method", routes.shape(F.col("route"))).alias("node"))
    near = Keys.of(_as(tried.join(shapes.frame, "node", "left_semi"), "node_id"))
    calling = w.changed_edges("HTTP_CALLS").unionByName(only(w.both("HTTP_CALLS"), "src", touched)).unionByName(only(w.both("HTTP_CALLS"), "dst", Keys.of(near, touched)))
    keys = Keys.of(_as(calling, "src"))
    calls = staged(only(w.new.edge("HTTP_CALLS"), "src", keys).select(*EDGE_FIELDS), "http-calls")
    asked = Keys.of(_as(calls, "dst"))
    ends = w.new.label("Endpoint").select("node_id", "http_method", tries)
    wanted = Keys.of(_shapes(only(ends, "node_id", asked)), shapes)
    reachable = w.new.label("Endpoint").withColumn("node", F.concat_ws(" ", "http_method", routes.shape(F.col("route")))).join(wanted.frame, "node", "left_semi").select(*NODE_FIELDS)
    serves = staged(only(w.new.edge("SERVES"), "dst", Keys.of(served, _as(reachable, "node_id"))).select(*EDGE_FIELDS), "http-serves")
    edges = serves.unionByName(calls)
    nodes = only(w.new.nodes, "node_id", Keys.of(_as(edges, "src"), _as(edges, "dst"))).select(*NODE_FIELDS)
    g = PropertyGraph(staged(nodes, "http-nodes"), edges)
    found = staged(derive.http_edges(*derive.definitions_from_graph(g)).edges, "http")
    return ("dst", served, only(found.where("type = 'SERVES'"), "dst", served)), ("src", keys, only(found.where("type = 'HTTP_CALLS'"), "src", keys))


def _marked(rows: DataFrame, rule: str) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), *EDGE_FIELDS)


def derived(g: PropertyGraph) -> DataFrame:
    """(rule, edge) of all that follows from the facts ``g``."""
    up = staged(derive.transitive_implements(g), "implements")
    with_types = g.with_edges(up)
    implements, _ = derive.method_implements(with_types)
    http = staged(derive.http_edges(*derive.definitions_from_graph(g)).edges, "http")
    found = {
        "implements": up, "method_implements": implements, "abstract_dispatch": derive.abstract_dispatch(g), "structural_dispatch": derive.structural_dispatch(with_types),
        "overrides": derive.overrides(g), "tests": derive.tests(g), "callbacks": derive.callback_calls(g), "serves": http.where("type = 'SERVES'"), "http_calls": http.where("type = 'HTTP_CALLS'"),
    }
    return reduce(DataFrame.unionByName, (_marked(found[r].select(*EDGE_FIELDS), r) for r in RULES))


def derived_change(old: PropertyGraph, change: Change, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new, gone): what the change of the facts ``old`` does to the derived ``rows`` (rule, edge). Both staged."""
    w = _World(old, change)
    new, gone = [], []

    def settle(rule: str, column: str, keys: Keys, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
        fresh = staged(_marked(fresh, rule), f"new-{rule}")
        before = staged(only(rows.where(F.col("rule") == rule), column, keys).select("rule", *EDGE_FIELDS), f"old-{rule}")
        same = before.join(fresh, ["src", "type", "dst"]).where(before["call_sites"].eqNullSafe(fresh["call_sites"])).select(before["src"], before["type"], before["dst"], before["kind"])
        new.append(staged(_less(fresh, same), f"came-{rule}"))
        gone.append(staged(_less(before, fresh), f"went-{rule}"))
        return new[-1], gone[-1]

    said = rows.where("rule = 'implements'").select(*EDGE_FIELDS)
    came, went = settle("implements", *_implements(w))
    moved = came.unionByName(went).select(*EDGE_FIELDS)
    w.implements_now = _less(said, moved).unionByName(came.select(*EDGE_FIELDS))
    ever = said.unionByName(came.select(*EDGE_FIELDS))
    settle("method_implements", *_method_implements(w, ever, moved))
    settle("abstract_dispatch", *_abstract(w))
    for part in _structural(w, ever, moved):
        settle("structural_dispatch", *part)
    settle("overrides", *_overrides(w))
    settle("tests", *_tests(w))
    settle("callbacks", *_callbacks(w))
    serves, calls = _http(w)
    settle("serves", *serves)
    settle("http_calls", *calls)
    merged: Callable[[list[DataFrame]], DataFrame] = lambda xs: staged(reduce(DataFrame.unionByName, xs).dropDuplicates(["rule", "src", "type", "dst"]), "derived-change")
    return merged(new), merged(gone)


def combined(facts: PropertyGraph, rows: DataFrame) -> PropertyGraph:
    """The graph of the facts and of what follows from them. Of HTTP edges and endpoints only what the rules have matched counts."""
    own = facts.edges.where(~F.col("type").isin("SERVES", "HTTP_CALLS") & ~((F.col("type") == "CONTAINS") & F.startswith("dst", F.lit("Endpoint:")))).select(*EDGE_FIELDS)
    dispatch = rows.where("rule = 'method_implements'").select(edge_columns(F.col("dst"), F.col("src"), "DISPATCHES_TO"))
    more = rows.select(*EDGE_FIELDS).unionByName(dispatch).dropDuplicates(["src", "type", "dst"])
    ends = rows.where("rule IN ('serves', 'http_calls')").select(F.col("dst").alias("node_id")).distinct()
    root = F.broadcast(facts.label("Repository").agg(F.min("node_id").alias("repo")))  # one row
    held = ends.join(root).where("repo IS NOT NULL").select(edge_columns(F.col("repo"), F.col("node_id"), "CONTAINS"))
    method, route = F.substring_index(F.substring("node_id", 10, 1 << 20), " ", 1), F.regexp_replace("node_id", r"^Endpoint:\S* ", "")
    made = derive.endpoint_nodes(ends.select(method.alias("http_method"), route.alias("route")))
    nodes = facts.nodes.where("kind_label <> 'Endpoint'").select(*NODE_FIELDS).unionByName(made.select(*NODE_FIELDS))
    return PropertyGraph(nodes, own.unionByName(_less(more, own)).unionByName(held))
