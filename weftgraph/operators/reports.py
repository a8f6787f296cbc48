"""Reports put together from other operators, and trees for people to read.

Each part of a report is a DataFrame of bounded size by the time it is collected: limits are pushed into the plans.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from weftgraph.functions.predicates import is_test, short_ref
from weftgraph.graph import PropertyGraph
from weftgraph.operators import impact, lookup, traversal
from weftgraph.plans.expand import spread
from weftgraph.sources.files import line_range

DIRECT, TRANSITIVE, TESTS, ENDPOINT_CALLERS = 15, 10, 5, 5
TYPE_METHODS, TYPE_CALLERS = 10, 10
MAX_LINES = 200


def limited(rows: DataFrame, limit: int) -> dict:
    """Rows of a result; where there are more than ``limit``, with their total. A limit of 0 or less means all."""
    if limit <= 0:
        return {"results": [r.asDict(recursive=True) for r in rows.collect()]}
    found = rows.limit(limit + 1).collect()
    out: dict = {"results": [r.asDict(recursive=True) for r in found[:limit]]}
    if len(found) > limit:
        out |= {"_total": rows.count(), "_truncated": True}
    return out


def without_nulls(rows: DataFrame) -> DataFrame:
    """One JSON text a row, without null properties."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "true"}).alias("value"))


def source(g: PropertyGraph, texts: DataFrame, full_name: str) -> DataFrame:
    """(full_name, file_path, line, end_line, source) from ``texts`` (path, text)."""
    at = lookup.source_info(g, full_name)
    return at.join(texts.withColumnRenamed("path", "file_path"), "file_path").select(
        "full_name", "file_path", "line", "end_line", line_range(F.col("text"), F.col("line"), F.col("end_line")).alias("source")
    )


def read_symbol(g: PropertyGraph, texts: DataFrame, full_name: str, max_lines: int = MAX_LINES) -> dict:
    """A symbol's source; of one with too many lines the list of its members instead."""
    at = lookup.source_info(g, full_name).first()
    if at is None:
        return {"full_name": full_name, "source": None}
    if 0 < max_lines < at.end_line - at.line + 1:
        rows = lookup.members(g, full_name).orderBy("line", "full_name").collect()
        return {"full_name": full_name, "lines": at.end_line - at.line + 1, "members": [member_line(r) for r in rows]}
    row = source(g, texts, full_name).first()
    return {"full_name": full_name, "source": row.source if row else None}


def member_line(row: Row) -> str:
    return f"{row.signature or row.name}{': ' + row.type_name if row.type_name else ''} [{row.line}]"


def parent_line(g: PropertyGraph, texts: DataFrame, full_name: str) -> DataFrame:
    """The line that declares the type around a symbol."""
    owner = lookup.containing_type(g, full_name).select("file_path", "line", "full_name")
    rows = owner.join(texts.withColumnRenamed("path", "file_path"), "file_path")
    return rows.select("full_name", F.rtrim(line_range(F.col("text"), F.col("line"), F.col("line"))).alias("declaration"))


@dataclass
class Report:
    title: str
    parts: dict[str, list[dict]] = field(default_factory=dict)

    def add(self, name: str, rows: DataFrame, limit: int = 0) -> Report:
        self.parts[name] = [r.asDict(recursive=True) for r in (rows.limit(limit) if limit else rows).collect()]
        return self

    def text(self) -> str:
        lines = [f"# {self.title}"]
        for name, rows in self.parts.items():
            if rows:
                lines += ["", f"## {name}", *("- " + ", ".join(f"{k}: {v}" for k, v in r.items() if v not in (None, "")) for r in rows)]
        return "\n".join(lines)


def context(g: PropertyGraph, full_name: str, texts: DataFrame | None = None, members_only: bool = False) -> Report:
    """What a reader of a symbol needs: source, owner and members, interfaces, callees, referenced types, summaries."""
    report = Report(full_name)
    kind = lookup.symbol(g, full_name).first()
    if kind is None:
        raise LookupError(f"no symbol {full_name!r}")
    is_type = kind.kind_label in lookup.TYPES
    owner = lookup.containing_type(g, full_name).first()
    top = full_name if is_type or owner is None else owner.full_name
    if members_only:
        report.add("constructor", lookup.constructor(g, top).select("full_name", "signature", "line"))
    elif texts is not None:
        report.add("source", source(g, texts, full_name).select("file_path", "line", "source"))
    report.add("members", lookup.members(g, top).select("full_name", "signature", "type_name", "line").orderBy("line", "full_name"))
    report.add("interfaces", lookup.implemented_interfaces(g, top).select("full_name"))
    if not members_only:
        if not is_type:
            report.add("callees", lookup.callees(g, full_name).select("full_name", "file_path", "line").orderBy("full_name"))
        report.add("types", traversal.dependencies(g, full_name).select("full_name", "kind_label").distinct().orderBy("full_name"))
    names = {r["full_name"] for part in report.parts.values() for r in part if r.get("full_name")} | {full_name, top}
    wanted = g.spark.createDataFrame([(x,) for x in sorted(names)], "full_name string")
    return report.add("summaries", lookup.summaries(g).join(F.broadcast(wanted), "full_name").orderBy("full_name"))  # names that the report already shows


def assessment(g: PropertyGraph, method: str) -> Report:
    """What a change of a method may break: callers with call sites, their callers, tests, the contract, the endpoint."""
    report = Report(f"Impact of {method}")
    direct = lookup.callers(g, method, exclude_tests=True).select("full_name", short_ref(F.col("full_name")).alias("short"), "file_path", "site_lines")
    report.add("direct callers", direct.orderBy("full_name"), DIRECT)
    report.add("transitive callers", traversal.transitive_callers(g, method).orderBy("full_name"), TRANSITIVE)
    report.add("tests", lookup.tests_for(g, method).select("full_name", "file_path", "line").orderBy("full_name"), TESTS)
    if not report.parts["tests"]:
        report.add("tests", impact.test_coverage(g, method).orderBy("full_name"), TESTS)
    contract = lookup.interface_contract(g, method)
    report.add("contract", contract).add("siblings", lookup.siblings(g, contract).orderBy("sibling"))
    report.add("endpoint", lookup.served_endpoint(g, method))
    return report.add("endpoint callers", lookup.http_callers(g, method).orderBy("full_name"), ENDPOINT_CALLERS)


def method_context(g: PropertyGraph, method: str, texts: DataFrame | None = None) -> Report:
    """To understand a method: source, contract, callees, the types it refers to, summaries of it and its type."""
    report = Report(method)
    if texts is not None:
        report.add("source", source(g, texts, method).select("file_path", "line", "source"))
    report.add("contract", lookup.interface_contract(g, method))
    report.add("callees", lookup.callees(g, method).select("full_name", "file_path", "line").orderBy("full_name"))
    report.add("types", traversal.dependencies(g, method).select("full_name", "kind_label").distinct().orderBy("full_name"))
    return _summarized(g, report, [method, *_owner(g, method)])


def method_edit(g: PropertyGraph, method: str, texts: DataFrame | None = None) -> Report:
    """To change a method: source, contract, endpoint, callers, the constructor's types that it uses, tests, summaries."""
    report, owner = Report(method), _owner(g, method)
    if texts is not None:
        report.add("source", source(g, texts, method).select("file_path", "line", "source"))
    report.add("contract", lookup.interface_contract(g, method)).add("endpoint", lookup.served_endpoint(g, method))
    report.add("direct callers", lookup.callers(g, method).select("full_name", "file_path", "site_lines").orderBy("full_name"), DIRECT)
    for cls in owner:
        report.add("dependencies in use", lookup.relevant_types(g, cls, method).select("full_name", "file_path").orderBy("full_name"))
    report.add("tests", impact.test_coverage(g, method).orderBy("full_name"))
    interfaces = [r.full_name for cls in owner for r in lookup.implemented_interfaces(g, cls).collect()]
    return _summarized(g, report, [method, *owner, *interfaces])


def busiest_members(g: PropertyGraph, type_name: str, methods: int = TYPE_METHODS, callers: int = TYPE_CALLERS) -> DataFrame:
    """(method, n_callers, caller, file_path, site_lines): of a type's methods with most callers, the first callers by name."""
    own = lookup.members(g, type_name).where("kind_label = 'Method'").select(F.col("full_name").alias("method"))
    held = g.label("Method").select("node_id", "full_name").join(F.broadcast(own.withColumnRenamed("method", "full_name")), "full_name", "left_semi")  # members of one type
    rows = lookup.callers(g).join(held.select(F.col("full_name").alias("of")), "of", "left_semi").select(F.col("of").alias("method"), F.col("full_name").alias("caller"), "file_path", "site_lines")
    each = Window.partitionBy("method")
    counted = rows.withColumn("n_callers", F.count(F.lit(1)).over(each)).withColumn("_k", F.row_number().over(each.orderBy("caller")))
    top = counted.select("method", "n_callers").distinct().orderBy(F.desc("n_callers"), "method").limit(methods)
    return counted.where(F.col("_k") <= callers).join(F.broadcast(top.select("method")), "method", "left_semi").select("method", "n_callers", "caller", "file_path", "site_lines")


def type_edit(g: PropertyGraph, type_name: str, texts: DataFrame | None = None) -> Report:
    """To change a type: source, interfaces, the busiest methods with callers, the constructor's types, tests, summaries."""
    report = Report(type_name)
    is_class = lookup.symbol(g, type_name).where("kind_label = 'Class'").count() > 0
    if texts is not None:
        report.add("source", source(g, texts, type_name).select("file_path", "line", "source"))
    interfaces = lookup.implemented_interfaces(g, type_name).select("full_name")
    if is_class:
        report.add("interfaces", interfaces.orderBy("full_name"))
    report.add("callers", busiest_members(g, type_name).orderBy(F.desc("n_callers"), "method", "caller"))
    if is_class:
        report.add("dependencies", lookup.referenced_types(g, type_name).select("full_name", "file_path").orderBy("full_name"))
    report.add("tests", tests_of_type(g, type_name).orderBy("full_name"))
    return _summarized(g, report, [type_name, *(r.full_name for r in interfaces.collect())])


def tests_of_type(g: PropertyGraph, type_name: str) -> DataFrame:
    """Test methods that reach a method of a type, or an interface method that one implements, within four calls."""
    own = g.nodes.where(F.col("full_name") == type_name).select(F.col("node_id").alias("src"))
    held = g.edge("CONTAINS").join(own, "src", "left_semi").select(F.col("dst").alias("node"))
    up = g.edge("IMPLEMENTS").join(held.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node"))
    back = spread(g.edge("CALLS"), held.unionByName(up), 4, reverse=True).select(F.col("node").alias("node_id"))
    return g.label("Method").where(is_test(F.col("file_path"))).join(back, "node_id", "left_semi").select("full_name", "file_path")


def _owner(g: PropertyGraph, full_name: str) -> list[str]:
    row = lookup.containing_type(g, full_name).first()
    return [row.full_name] if row is not None else []


def _summarized(g: PropertyGraph, report: Report, names: list[str]) -> Report:
    wanted = g.spark.createDataFrame([(x,) for x in sorted(set(names))], "full_name string")
    return report.add("summaries", lookup.summaries(g).join(F.broadcast(wanted), "full_name").orderBy("full_name"))  # a symbol, its type and that type's interfaces


def path_tree(paths: list[str], sep: str = " > ") -> list[str]:
    """Paths as lines of one tree that shares their beginnings."""
    root: dict = {}
    for path in paths:
        at = root
        for step in path.split(sep):
            at = at.setdefault(step, {})
    lines: list[str] = []

    def walk(at: dict, depth: int) -> None:
        for name, below in at.items():
            lines.append("  " * depth + name)
            walk(below, depth + 1)

    walk(root, 0)
    return lines


def depth_tree(root: str, rows: list[tuple[str, int]]) -> list[str]:
    """(name, depth) in the order of a walk, as lines of a tree."""
    return [root, *("  " * depth + name for name, depth in rows)]


def prefixes(paths: DataFrame, sep: str = " > ") -> DataFrame:
    """The nodes of the tree of ``paths`` (path): every distinct beginning, with its depth."""
    steps = F.split("path", sep)
    each = F.explode(F.sequence(F.lit(1), F.size(steps))).alias("depth")
    return paths.select(steps.alias("s"), each).select(F.array_join(F.slice("s", 1, F.col("depth")), sep).alias("prefix"), "depth").distinct()
