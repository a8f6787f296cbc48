"""Staging rows from Python sources, by the standard library's parser in one Arrow pass over the files.

Other languages come as staging tables of the same shape (see STAGING), from whatever parser a user has.
"""

from __future__ import annotations

import ast
import gc
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.shipping import arrow_map

#: Columns of every staging row; ``what`` tells the tables apart.
STAGING = (
    "what string, file_path string, full_name string, name string, kind string, line int, end_line int, col int, signature string, parent string, "
    "target string, attributes string, is_abstract boolean, is_static boolean, is_classmethod boolean, is_async boolean, type_name string, args int"
)
FIELDS = [x.strip().split(" ") for x in STAGING.split(",")]
_SCHEMA = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[t]) for n, t in FIELDS])
TASKS_A_CORE = 4  # of parsing, so that no core waits long for the last one
BATCH_ROWS = 4096  # staging rows that go back at once
VERBS = ("get", "post", "put", "delete", "patch", "head", "options")
# Classes whose methods are endpoints by their names.
VIEWSETS = ("ModelViewSet", "ViewSet", "ReadOnlyModelViewSet", "GenericViewSet")
VIEWSET_ROUTES = {"list": ("GET", ""), "create": ("POST", ""), "retrieve": ("GET", "/{id}"), "update": ("PUT", "/{id}"), "partial_update": ("PATCH", "/{id}"), "destroy": ("DELETE", "/{id}")}
VIEWS = ("APIView", "GenericAPIView")
VIEW_VERBS = ("get", "post", "put", "delete", "patch")
CLIENTS = ("requests", "httpx", "client", "session")


def module_name(path: str, root: str) -> str:
    return path.removeprefix(root.rstrip("/") + "/").removesuffix(".py").replace("/", ".").removesuffix(".__init__")


def _text(node: ast.AST) -> str:
    """The source of an expression; dotted names, which most are, need no unparser."""
    parts, at = [], node
    while isinstance(at, ast.Attribute):
        parts.append(at.attr)
        at = at.value
    return ".".join((at.id, *reversed(parts))) if isinstance(at, ast.Name) else ast.unparse(node)


def _route(node: ast.expr) -> str:
    """An address from an expression: literals as they are, all else as '{expression}'."""
    if isinstance(node, ast.Constant):
        return str(node.value)
    if isinstance(node, ast.JoinedStr):
        return "".join(_route(v.value if isinstance(v, ast.FormattedValue) else v) for v in node.values)
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
        return _route(node.left) + _route(node.right)
    return "{" + _text(node) + "}"


def _parameters(node: ast.arguments) -> str:
    """The source of a parameter list; lists of plain names, with or without plain types, need no unparser."""
    if node.posonlyargs or node.vararg or node.kwonlyargs or node.kwarg or node.defaults:
        return ast.unparse(node)
    return ", ".join(f"{a.arg}: {_text(a.annotation)}" if a.annotation else a.arg for a in node.args)


def _decorator(node: ast.expr) -> str:
    return _text(node.func if isinstance(node, ast.Call) else node).rsplit(".", 1)[-1].lower()


def _json(names: list[str]) -> str:
    return json.dumps(names) if names else "[]"


def chain(node: ast.expr) -> str:
    """What a receiver or value is made of: names, attributes and calls without arguments; '?' for all else."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return f"{chain(node.value)}.{node.attr}"
    if isinstance(node, ast.Call):
        return f"{chain(node.func)}()"
    return chain(node.value) if isinstance(node, ast.Await | ast.NamedExpr) else "?"


def named_types(node: ast.expr | None) -> list[str]:
    """The types of an annotation: of unions and Optional each, of other type arguments none."""
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        try:
            return named_types(ast.parse(node.value, mode="eval").body)
        except SyntaxError:
            return []
    if isinstance(node, ast.BinOp):
        return named_types(node.left) + named_types(node.right)
    if isinstance(node, ast.Subscript):
        if _text(node.value).rsplit(".", 1)[-1] in ("Optional", "Union", "Annotated", "Final"):
            inner = node.slice.elts if isinstance(node.slice, ast.Tuple) else [node.slice]
            return [t for x in inner for t in named_types(x)]
        return named_types(node.value)
    return [_text(node)] if isinstance(node, ast.Name | ast.Attribute) else []


LEAVES = frozenset((ast.Name, ast.Constant, ast.Load, ast.Store, ast.Del, ast.alias, ast.Pass))  # nodes without nodes that a visit would tell of
SCALARS = frozenset(("ctx", "op", "ops", "id", "attr", "arg", "asname", "module", "level", "type_comment", "conversion", "simple", "is_async"))  # fields without such nodes, whatever holds them
_VISITORS: dict[type, Callable] = {}
_HELD: dict[type, tuple[str, ...]] = {}  # the other fields


def _held(kind: type) -> tuple[str, ...]:
    found = _HELD.get(kind)
    if found is None:
        found = _HELD[kind] = tuple(x for x in kind._fields if x not in SCALARS)
    return found


class _Visitor(ast.NodeVisitor):
    """Symbols, imports, bases, attributes, type references, calls, assignments and HTTP routes of one module."""

    def __init__(self, path: str, module: str):
        self.path, self.rows, self.scope = path, [], [(module, "module")]

    def add(self, what: str, **values) -> None:
        values["what"], values["file_path"] = what, self.path
        self.rows.append(values)

    def visit(self, node: ast.AST) -> None:
        kind = type(node)
        if kind not in LEAVES:
            known = _VISITORS.get(kind)
            if known is None:
                known = _VISITORS[kind] = getattr(_Visitor, f"visit_{kind.__name__}", _Visitor.generic_visit)
            known(self, node)

    def generic_visit(self, node: ast.AST) -> None:
        """As the base class does, but for the look at nodes that hold no others."""
        for name in _held(type(node)):
            held = getattr(node, name, None)
            if held.__class__ is list:
                for x in held:
                    if x.__class__ not in LEAVES and isinstance(x, ast.AST):
                        self.visit(x)
            elif held.__class__ not in LEAVES and isinstance(held, ast.AST):
                self.visit(held)

    @property
    def owner(self) -> str:
        return self.scope[-1][0]

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        full = f"{self.owner}.{node.name}"
        bases = [_text(b).split("[")[0] for b in node.bases]
        kind = "interface" if any(b.rsplit(".", 1)[-1] in ("ABC", "Protocol") for b in bases) or any(k.arg == "metaclass" and _text(k.value).endswith("ABCMeta") for k in node.keywords) else "class"
        self.add("symbol", full_name=full, name=node.name, kind=kind, line=node.lineno, end_line=node.end_lineno, col=node.col_offset, parent=self.owner,
                 attributes=_json([_decorator(d) for d in node.decorator_list]))
        for n, b in enumerate(bases):
            self.add("base", full_name=full, target=b, line=node.lineno, col=n)
        self._views(node, full, {b.rsplit(".", 1)[-1] for b in bases})
        self._inside(node, full, "class")

    def _views(self, node: ast.ClassDef, full: str, bases: set[str]) -> None:
        """Endpoints of view classes: methods by name, below the class's name without its ending."""
        if bases.isdisjoint((*VIEWSETS, *VIEWS)):
            return
        short = next((node.name.removesuffix(e) for e in ("ViewSet", "View") if node.name.endswith(e) and node.name != e), node.name).lower()
        by_name = VIEWSET_ROUTES if not bases.isdisjoint(VIEWSETS) else {v: (v.upper(), "") for v in VIEW_VERBS}
        for f in node.body:
            if isinstance(f, ast.FunctionDef | ast.AsyncFunctionDef) and f.name in by_name:
                verb, rest = by_name[f.name]
                self.add("endpoint", full_name=f"{full}.{f.name}", kind=verb, target=f"/{short}{rest}", line=f.lineno, col=0)

    def _function(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        full, marks = f"{self.owner}.{node.name}", [_decorator(d) for d in node.decorator_list]
        in_class = self.scope[-1][1] == "class"
        self.add("symbol", full_name=full, name=node.name, kind="property" if "property" in marks else "method", line=node.lineno, end_line=node.end_lineno, col=node.col_offset, parent=self.owner,
                 signature=f"{node.name}({_parameters(node.args)})", attributes=_json(marks), is_abstract="abstractmethod" in marks, is_static="staticmethod" in marks or not in_class,
                 is_classmethod="classmethod" in marks, is_async=isinstance(node, ast.AsyncFunctionDef), type_name=_text(node.returns) if node.returns else "")
        for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]:
            if a.annotation:
                self._types(full, a.annotation, "parameter")
                self._bind(full, a.arg, a, types=a.annotation)
        for t in named_types(node.returns):
            self.add("binding", full_name=full, name="()", kind="type", target=t, line=node.lineno, col=node.col_offset)
        if node.returns:
            self._types(full, node.returns, "return_type")
        for d in node.decorator_list:
            if isinstance(d, ast.Call) and isinstance(d.func, ast.Name) and d.func.id == "api_view" and d.args and isinstance(d.args[0], ast.List | ast.Tuple):
                for e in d.args[0].elts:
                    if isinstance(e, ast.Constant):
                        self.add("endpoint", full_name=full, kind=str(e.value).upper(), target=f"/{node.name}", line=node.lineno, col=0)
            if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str):
                verb = d.func.attr.lower()
                verbs = [verb] if verb in VERBS else [e.value for k in d.keywords if k.arg == "methods" and isinstance(k.value, ast.List) for e in k.value.elts if isinstance(e, ast.Constant)] or ["get"] if verb == "route" else []
                for v in verbs:
                    self.add("endpoint", full_name=full, kind=v.upper(), target=d.args[0].value, line=node.lineno, col=0)
        self._inside(node, full, "function")

    def _inside(self, node: ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef, full: str, kind: str) -> None:
        """All below a definition belongs to it, but for its decorators, which the scope around it calls."""
        for d in node.decorator_list:
            self.visit(d)
        self.scope.append((full, kind))
        for name in _held(type(node)):
            if name != "decorator_list":
                held = getattr(node, name, None)
                for x in held if held.__class__ is list else (held,):
                    if isinstance(x, ast.AST):
                        self.visit(x)
        self.scope.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def _types(self, owner: str, node: ast.expr, kind: str) -> None:
        for x in (node,) if isinstance(node, ast.Name) else ast.walk(node):
            name = x.id if isinstance(x, ast.Name) else x.attr if isinstance(x, ast.Attribute) else None
            if name and name[:1].isupper():
                self.add("type_ref", full_name=owner, target=name, kind=kind, line=x.lineno, col=x.col_offset)

    def _bind(self, owner: str, name: str, at: ast.AST, types: ast.expr | None = None, value: ast.expr | None = None) -> None:
        """What a name may stand for in a function: the types that it is declared with, or the value that it is given."""
        for t in named_types(types):
            self.add("binding", full_name=owner, name=name, kind="type", target=t, line=at.lineno, col=at.col_offset)
        if value is not None and "?" not in (made := chain(value)):
            self.add("binding", full_name=owner, name=name, kind="value", target=made, line=at.lineno, col=at.col_offset)

    def visit_Return(self, node: ast.Return) -> None:
        if node.value is not None:
            self._bind(self.owner, "()", node, value=node.value)
        self.generic_visit(node)

    def visit_With(self, node: ast.With | ast.AsyncWith) -> None:
        for x in node.items:
            if isinstance(x.optional_vars, ast.Name):
                self._bind(self.owner, x.optional_vars.id, x.optional_vars, value=x.context_expr)
        self.generic_visit(node)

    visit_AsyncWith = visit_With

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        if self.scope[-1][1] == "class" and isinstance(node.target, ast.Name):
            full = f"{self.owner}.{node.target.id}"
            self.add("symbol", full_name=full, name=node.target.id, kind="field", line=node.lineno, end_line=node.end_lineno, col=node.col_offset, parent=self.owner, type_name=_text(node.annotation))
            self._types(full, node.annotation, "field_type")
        elif isinstance(node.target, ast.Name):
            self._bind(self.owner, node.target.id, node, node.annotation, node.value)
        self.generic_visit(node)

    def visit_Assign(self, node: ast.Assign) -> None:
        for t in node.targets:
            value = node.value.value if isinstance(node.value, ast.Constant) else None
            if isinstance(t, ast.Name) and self.scope[-1][1] != "class":
                self._bind(self.owner, t.id, node, value=node.value)
            if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self" and not isinstance(node.value, ast.Call):
                self._bind(self.owner, f"self.{t.attr}", node, value=node.value)
            if len(self.scope) == 1 and isinstance(t, ast.Name) and isinstance(value, str) and ("/" in value or value.startswith("http")):
                self.add("constant", name=t.id, target=value)
            if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self" and isinstance(node.value, ast.Call):
                cls = next((n for n, k in reversed(self.scope) if k == "class"), self.owner)
                self.add("assignment", full_name=cls, name=t.attr, target=_text(node.value.func), line=node.lineno - 1, col=node.value.col_offset)
        self.generic_visit(node)

    def visit_Call(self, node: ast.Call) -> None:
        target = _text(node.func)
        # At the name that is called, so that the calls of a chain have places of their own.
        here = (node.func.end_lineno, node.func.end_col_offset - len(node.func.attr)) if isinstance(node.func, ast.Attribute) else (node.lineno, node.col_offset)
        self.add("call", full_name=self.owner, name=target.rsplit(".", 1)[-1], target=chain(node.func), line=here[0], col=here[1], args=len(node.args) + len(node.keywords))
        head, _, verb = target.rpartition(".")
        if verb in VERBS and head.rsplit(".", 1)[-1].lstrip("_") in CLIENTS and node.args and isinstance(node.args[0], ast.Constant | ast.JoinedStr | ast.BinOp):
            self.add("client_call", full_name=self.owner, kind=verb.upper(), target=_route(node.args[0]), line=node.lineno, col=node.col_offset)
        self.generic_visit(node)

    def visit_If(self, node: ast.If) -> None:
        """What stands in 'if TYPE_CHECKING:' is for compile time alone: its calls are none."""
        if _text(node.test).rsplit(".", 1)[-1] != "TYPE_CHECKING":
            return self.generic_visit(node)
        self.add("compile_time", line=node.lineno, end_line=max(x.end_lineno for x in node.body))
        start = len(self.rows)
        for x in node.body:
            self.visit(x)
        self.rows[start:] = [r for r in self.rows[start:] if r["what"] != "call"]
        for x in node.orelse:
            self.visit(x)

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.add("import", target=a.name, name=a.asname or a.name, line=node.lineno)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        base = "." * node.level + (node.module or "")
        for a in node.names:
            self.add("import", target=f"{base}.{a.name}" if base.strip(".") else base + a.name, name=a.asname or a.name, line=node.lineno)


def parse(path: str, text: str, root: str) -> list[dict]:
    """Rows of one file; a file that does not parse gives one row of what 'error'."""
    module = module_name(path, root)
    try:
        parsed = ast.parse(text)
    except (SyntaxError, ValueError) as e:
        return [{"what": "error", "file_path": path, "name": type(e).__name__}]
    v = _Visitor(path, module)
    v.add("symbol", full_name=module, name=module.rsplit(".", 1)[-1], kind="module", line=1, end_line=text.count("\n") + 1, col=0)
    v.visit(parsed)
    return v.rows


def spread_rows(files: DataFrame, parse: Callable[[str, str, str], list[dict]], root: str, kinds: tuple[str, ...] | None = None, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Staging rows that ``parse`` (path, text, root) makes of ``files`` (path, text); with ``kinds`` only rows of these (what), with
    ``columns`` only these columns, for those who need no others.

    Files are dealt to the tasks by their paths: reading takes a thousandth of what parsing takes, so a table of a few MB, which is one
    split, would be parsed by one task. Rows of many files go back in one batch. Python's search for cycles is run by batch, not by count of
    objects: trees and rows are many and hold none, and what was there before is left out of it.
    """
    fields = [f for f in _SCHEMA if columns is None or f.name in columns]
    kept = None if kinds is None else frozenset(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        searched = gc.isenabled()
        gc.collect()
        gc.freeze()
        gc.disable()
        try:
            for b in batches:
                for path, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    found = parse(path, text or "", root)
                    rows += found if kept is None else [r for r in found if r["what"] in kept]
                    if len(rows) >= BATCH_ROWS:
                        yield _batch(rows, fields)
                        rows = []
                        gc.collect()
            if rows:
                yield _batch(rows, fields)
        finally:
            gc.unfreeze()
            if searched:
                gc.enable()

    tasks = TASKS_A_CORE * files.sparkSession.sparkContext.defaultParallelism
    schema = ", ".join(" ".join(x) for x in FIELDS if columns is None or x[0] in columns)
    return arrow_map(files.select("path", "text").where(F.col("path").isNotNull()).repartition(tasks, "path"), run, schema)


def _batch(rows: list[dict], fields: list[pa.Field]) -> pa.RecordBatch:
    columns: dict[str, list] = {f.name: [None] * len(rows) for f in fields}
    if len(fields) < len(_SCHEMA):
        for name, values in columns.items():
            for k, r in enumerate(rows):
                if name in r:
                    values[k] = r[name]
    else:
        for k, r in enumerate(rows):  # a row has a third of the columns
            for name, value in r.items():
                columns[name][k] = value
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in fields], schema=pa.schema(fields))


def staging(files: DataFrame, root: str, kinds: tuple[str, ...] | None = None, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Staging rows of ``files`` (path, text); ``kinds`` and ``columns`` as in spread_rows()."""
    return spread_rows(files, parse, root, kinds, columns)
