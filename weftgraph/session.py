"""One object for people and tools: names are resolved, results limited, calls logged if wanted."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import PropertyGraph
from weftgraph.operators import audit, dml, impact, lookup, reports, sync, traversal
from weftgraph.schema import EDGE_FIELDS, EDGE_TYPES, LABEL_ORDER, NODE_FIELDS
from weftgraph.sources.files import tree

LIMIT = 50


@dataclass(frozen=True)
class Disk:
    """The state of the sources, asked for before each call: the commit they are at, the files with their times (path, modified),
    and which of these have uncommitted changes (path). ``sync`` makes a graph that is up to date; without it, answers only warn."""

    files: Callable[[], DataFrame]
    head: Callable[[], str | None] = lambda: None
    dirty: Callable[[], DataFrame | None] = lambda: None
    sync: Callable[[PropertyGraph], PropertyGraph] | None = None


class CodeGraph:
    """``texts`` (path, text) lets sources be read; ``log`` is a file that gets a JSON line per call; ``disk`` keeps the graph up to date."""

    def __init__(self, graph: PropertyGraph, texts: DataFrame | None = None, log: str | None = None, disk: Disk | None = None):
        self.graph, self.texts, self.log, self.disk = graph, texts, log, disk

    def refresh(self) -> bool:
        """Sync the graph if it is behind the disk; whether it was. Every call does so first."""
        if self.disk is None or self.disk.sync is None:
            return False
        row = self.graph.label("Repository").agg(F.max("last_indexed_commit").alias("commit")).first()
        if not sync.stale(self.graph, self.disk.files(), row.commit, self.disk.head(), self.disk.dirty()):
            return False
        self.graph = self.disk.sync(self.graph)
        return True

    def warning(self, full_name: str) -> str | None:
        """That the file of a symbol was changed after it was indexed."""
        if self.disk is None:
            return None
        at = lookup.source_info(self.graph, full_name).select(F.col("file_path").alias("path"))
        row = lookup.stale_files(self.graph, self.disk.files()).join(at, "path", "left_semi").first()
        return None if row is None else f"{row.path} was changed after it was indexed; this answer may be out of date"

    @contextmanager
    def _logged(self, tool: str, **args) -> Iterator[Callable[[object], None]]:
        size, start = [0], time.perf_counter()
        yield lambda out: size.__setitem__(0, len(json.dumps(out, default=str)))
        if self.log:
            entry = {"tool": tool, "bytes": size[0], "ms": round(1000 * (time.perf_counter() - start)), "ts": time.time(), "args": args}
            with Path(self.log).open("a") as f:
                f.write(json.dumps(entry, default=str) + "\n")

    def _answer(self, tool: str, rows: DataFrame, limit: int = LIMIT, **args) -> dict:
        with self._logged(tool, **args) as done:
            out = reports.limited(rows, limit)
            if isinstance(args.get("name"), str) and (said := self.warning(self._name(args["name"], fresh=False))):
                out["_warning"] = said
            done(out)
        return out

    def _name(self, name: str, prefer: str | None = None, fresh: bool = True) -> str:
        if fresh:
            self.refresh()
        return lookup.resolve_one(self.graph, name, prefer)

    # Lookups
    def get_schema(self) -> dict:
        return {"labels": list(LABEL_ORDER), "edges": list(EDGE_TYPES), "node_properties": dict(NODE_FIELDS), "edge_properties": dict(EDGE_FIELDS)}

    def list_projects(self) -> dict:
        self.refresh()
        return self._answer("list_projects", lookup.projects(self.graph), 0)

    def index_status(self, repo: str) -> dict:
        self.refresh()
        return self._answer("index_status", audit.index_status(self.graph, repo), 0, repo=repo)

    def search_symbols(self, query: str, limit: int = LIMIT, **filters) -> dict:
        self.refresh()
        return self._answer("search_symbols", lookup.search(self.graph, query, **filters), limit, query=query, **filters)

    def read_symbol(self, name: str, max_lines: int = reports.MAX_LINES) -> dict:
        if self.texts is None:
            raise ValueError("no texts were given")
        return reports.read_symbol(self.graph, self.texts, self._name(name), max_lines)

    def find_implementations(self, name: str, limit: int = LIMIT) -> dict:
        return self._answer("find_implementations", lookup.implementations(self.graph, self._name(name, "interface")).orderBy("full_name"), limit, name=name)

    def get_hierarchy(self, name: str) -> dict:
        return self._answer("get_hierarchy", lookup.hierarchy(self.graph, self._name(name)).orderBy("relation", "full_name"), 0, name=name)

    def find_callers(self, name: str, exclude_tests: bool = False, limit: int = LIMIT) -> dict:
        return self._answer("find_callers", lookup.callers(self.graph, self._name(name, "concrete"), exclude_tests=exclude_tests).orderBy("branch", "full_name"), limit, name=name)

    def find_callees(self, name: str, depth: int | None = None, limit: int = LIMIT) -> dict:
        full = self._name(name, "concrete")
        rows = lookup.callees(self.graph, full).orderBy("branch", "full_name") if depth is None else traversal.call_depth(self.graph, full, depth).orderBy("depth", "full_name")
        return self._answer("find_callees", rows, limit, name=name, depth=depth)

    def find_usages(self, name: str, kind: str | None = None, exclude_tests: bool = False, limit: int = LIMIT) -> dict:
        """Callers of a method; references to a type by file with callers of its methods, or its references of one kind."""
        full = self._name(name)
        label = lookup.symbol(self.graph, full).first().kind_label
        if kind is not None:
            rows = lookup.type_references(self.graph, full, kind).orderBy("full_name")
        elif label == "Method":
            rows = lookup.callers(self.graph, full, exclude_tests=exclude_tests).orderBy("branch", "full_name")
        elif label in lookup.TYPES:
            rows = audit.class_usages(self.graph, full).orderBy("what", "n", "item", ascending=[False, False, True])
        else:
            rows = lookup.neighborhood(self.graph, full).where("direction = 'in'").orderBy("full_name", "type")
        return self._answer("find_usages", rows, limit, name=name, kind=kind)

    def find_dependencies(self, name: str, depth: int = 1, limit: int = LIMIT) -> dict:
        return self._answer("find_dependencies", traversal.dependencies(self.graph, self._name(name), depth).orderBy("depth", "full_name"), limit, name=name, depth=depth)

    # Paths
    def trace_call_chain(self, start: str, end: str, max_depth: int = 6) -> list[str]:
        rows = traversal.trace(self.graph, self._name(start), self._name(end), max_depth).collect()
        return reports.path_tree([r.path for r in rows])

    def find_entry_points(self, name: str, max_depth: int = 8, exclude_pattern: str = "", exclude_tests: bool = True) -> dict:
        return self._answer("find_entry_points", traversal.entry_points(self.graph, self._name(name), max_depth, exclude_pattern, exclude_tests), 0, name=name)

    def explore(self, name: str, depth: int = 1) -> dict:
        return self._answer("explore", traversal.explore(self.graph, self._name(name), depth).orderBy("source", "target", "type"), 0, name=name, depth=depth)

    def expand_node(self, name: str) -> dict:
        return self._answer("expand_node", lookup.neighborhood(self.graph, self._name(name)).orderBy("full_name", "type"), 0, name=name)

    # Reports
    def get_context_for(self, name: str, members_only: bool = False) -> reports.Report:
        return reports.context(self.graph, self._name(name), self.texts, members_only)

    def assess_impact(self, name: str) -> reports.Report:
        return reports.assessment(self.graph, self._name(name, "concrete"))

    def analyze_change_impact(self, name: str) -> dict:
        found = impact.change_impact(self.graph, self._name(name, "concrete"))
        return self._answer("analyze_change_impact", found.orderBy("role", "full_name"), 0, name=name) | impact.impact_totals(found).first().asDict()

    def find_tests_for(self, name: str) -> dict:
        """Direct tests; where there are none, tests that reach the method."""
        full = self._name(name, "concrete")
        direct = lookup.tests_for(self.graph, full).select("full_name", "file_path")
        return self._answer("find_tests_for", direct if not direct.isEmpty() else impact.test_coverage(self.graph, full), 0, name=name)

    def get_method_context(self, name: str) -> reports.Report:
        return reports.method_context(self.graph, self._name(name, "concrete"), self.texts)

    def get_edit_context(self, name: str) -> reports.Report:
        """What a change of a method or type needs to know."""
        full = self._name(name)
        kind = lookup.symbol(self.graph, full).first()
        return (reports.type_edit if kind is not None and kind.kind_label in lookup.TYPES else reports.method_edit)(self.graph, full, self.texts)

    # Audits
    def get_architecture(self, limit: int = 10, max_packages: int = 50, max_endpoints: int = 100) -> dict:
        self.refresh()
        g = self.graph
        parts = {"packages": audit.packages(g, max_packages), "hotspots": audit.hotspots(g, limit), "http_service_map": audit.service_map(g, max_endpoints), "files_by_language": audit.files_by_language(g)}
        return {k: [r.asDict() for r in v.collect()] for k, v in parts.items()} | {"stats": audit.graph_stats(g).first().asDict()}

    def find_dead_code(self, limit: int = 15, offset: int = 0, **filters) -> dict:
        return self._page("dead", audit.dead_code, limit, offset, filters)

    def find_untested(self, limit: int = 15, offset: int = 0, **filters) -> dict:
        return self._page("untested", audit.untested, limit, offset, filters)

    def _page(self, what: str, rows: Callable[..., DataFrame], limit: int, offset: int, filters: dict) -> dict:
        self.refresh()
        stats = audit.audit_stats(self.graph, **filters).first()
        found = stats[f"{what}_count"]
        return {"methods": [r.asDict() for r in rows(self.graph, limit, offset, **filters).collect()], "total_methods": stats.total_methods, "count": found,
                "ratio": stats[f"{what}_ratio"], "truncated": 0 < limit < found - offset}

    def find_http_endpoints(self, limit: int = LIMIT, **filters) -> dict:
        self.refresh()
        return self._answer("find_http_endpoints", lookup.endpoints(self.graph, **filters), limit, **filters)

    def trace_http_dependency(self, route: str, http_method: str) -> dict:
        self.refresh()
        return self._answer("trace_http_dependency", lookup.endpoint_dependency(self.graph, route, http_method).orderBy("role", "full_name"), 0, route=route, http_method=http_method)

    # Free queries, summaries, changes
    def execute_query(self, sql: str, args: dict | None = None, limit: int = LIMIT) -> dict:
        return {"results": [r.asDict(recursive=True) for r in self.graph.collect_within(lookup.page(self.graph.sql(sql, args), limit))]}

    def set_summary(self, name: str, text: str) -> CodeGraph:
        rows = self.graph.spark.createDataFrame([(self._name(name), text)], "full_name string, summary string")
        return CodeGraph(dml.set_summaries(self.graph, rows), self.texts, self.log, self.disk)

    def list_summarized(self, repo: str | None = None) -> dict:
        return self._answer("list_summarized", lookup.summaries(self.graph, repo).orderBy("full_name"), 0, repo=repo)

    def changes_on_disk(self, repo: str) -> DataFrame:
        """(path, action) of files below a repository against the disk."""
        return sync.graph_diff(self.graph.below(repo), tree(self.graph.spark, repo))
