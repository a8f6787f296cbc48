"""Staging rows from Java, C# and TypeScript sources, in one Arrow pass over the files.

One reader serves the three: a lexer knows comments and literals, brackets are paired once, and declarations are read
from the header before each body. It needs no compiler and takes any text; what a header does not say (types that are
inferred, names that are bound elsewhere) is not guessed. Rows have the columns of python_source.STAGING.

- Full names are package or namespace, types, member; methods of Java and C# carry their parameter types, as overloads
  differ in nothing else. A TypeScript module is its path below the root, with dots.
- Import rows: target is what is imported (module or namespace), name the local name, kind the exported name if any.
- Constant rows: name, and target as the value of a string constant that looks like an address.
- Null and empty texts give the module row of a TypeScript file and nothing otherwise; unpaired brackets reach to the end.
"""

from __future__ import annotations

import json
import re
from typing import NamedTuple

from pyspark.sql import DataFrame

from weftgraph.sources.files import LANGUAGES
from weftgraph.sources.python_source import spread_rows

# How frameworks spell HTTP methods.
SPRING = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH"}
JAXRS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")
ASPNET = {"HttpGet": "GET", "HttpPost": "POST", "HttpPut": "PUT", "HttpDelete": "DELETE", "HttpPatch": "PATCH"}
MINIMAL_API = {"MapGet": "GET", "MapPost": "POST", "MapPut": "PUT", "MapDelete": "DELETE", "MapPatch": "PATCH"}
CONFIGURED = {"Get": "GET", "Post": "POST", "Put": "PUT", "Delete": "DELETE", "Patch": "PATCH"}
CONFIGURED_BASES = ("Endpoint", "EndpointWithoutRequest", "EndpointWithMapper")
REST_TEMPLATE = {"getForObject": "GET", "getForEntity": "GET", "postForObject": "POST", "postForEntity": "POST", "put": "PUT", "delete": "DELETE", "patchForObject": "PATCH"}
HTTP_CLIENT = {"GetAsync": "GET", "GetStringAsync": "GET", "GetByteArrayAsync": "GET", "GetStreamAsync": "GET", "GetFromJsonAsync": "GET", "PostAsync": "POST", "PostAsJsonAsync": "POST",
               "PutAsync": "PUT", "PutAsJsonAsync": "PUT", "DeleteAsync": "DELETE", "PatchAsync": "PATCH", "PatchAsJsonAsync": "PATCH"}
SCRIPT_VERBS = {"get": "GET", "post": "POST", "put": "PUT", "delete": "DELETE", "patch": "PATCH"}
# Words of the three languages.
TYPE_WORDS = ("class", "interface", "enum", "record", "struct")
MODIFIERS = ("public", "private", "protected", "internal", "static", "final", "abstract", "sealed", "partial", "async", "override", "virtual", "readonly", "const", "export", "default", "declare",
             "synchronized", "native", "transient", "volatile", "extern", "unsafe", "new", "required", "let", "var", "function", "get", "set", "ref", "out", "in", "params", "this")
MARKUP_AFTER = ("(", "{", "}", ">", "=>", "?", ":", "&", "|", "=", ",", ";")  # signs after which '<' opens an element
#: Words that begin a statement and are no type.
STATEMENTS = frozenset("return throw new else case goto await yield package import using if for while switch do try catch finally break continue default assert instanceof typeof delete in of out ref this super base".split())
NOT_CALLED = ("if", "for", "foreach", "while", "switch", "catch", "return", "using", "lock", "synchronized", "typeof", "sizeof", "nameof", "function", "super", "base", "this", "fixed", "await", "throw", "when", "default")

SERVERS = ("app", "router", "server", "fastify")  # a receiver with such a name, or ending in it, registers routes
LITERAL = r'\$?@\$?"(?:[^"]|"")*"|\$?"""(?:.*?)"""|\$?"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`'
TOKEN = re.compile(rf"[^\S\n]*(?:(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>{LITERAL})|(?P<name>[^\W\d]\w*|[$][\w$]*)|(?P<number>\d[\w.]*)|(?P<op>=>|->|::|\?\.|.))", re.DOTALL)
KINDS = ("", "skip", "text", "name", "number", "op")  # by their groups in TOKEN
REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
BRACKETS = frozenset("()[]{}")
BEFORE_REGEX = frozenset((*"(=,:[!&|?{};", "return"))
PAIRS = {"(": ")", "[": "]", "{": "}"}


class Token(NamedTuple):
    kind: str
    text: str
    line: int
    col: int


def tokens(text: str, script: bool) -> list[Token]:
    out, at, line, start, end = [], 0, 1, 0, len(text)
    add, make, token = out.append, tuple.__new__, Token
    while at < end:
        for m in TOKEN.finditer(text, at):  # up to a literal of a regular expression, which only what stands before it tells from a division
            group, after = m.lastindex, m.end()
            found = m[group]
            at = after - len(found)
            if script and found == "/" and (not out or out[-1].text in BEFORE_REGEX):
                r = REGEX.match(text, at)
                if r:
                    add(token("regex", "", line, at - start))
                    at = r.end()
                    break
            if group > 1:
                add(make(token, (KINDS[group], found, line, at - start)))
            if group < 3 and "\n" in found:  # no other kind has any
                line, start = line + found.count("\n"), at + found.rindex("\n") + 1
            at = after
    return out


def literal(token: Token) -> str:
    """The value of a string token; what is interpolated shows as '{expression}'."""
    body = token.text.lstrip("$@")
    body = body[3:-3] if body.startswith('"""') and len(body) >= 6 else body[1:-1]
    return body.replace("${", "{") if token.text.startswith("`") else body


class _Reader:
    def __init__(self, path: str, text: str, language: str, module: str):
        self.path, self.language, self.script, self.module = path, language, language == "typescript", module
        self.t, self.rows = tokens(text, language == "typescript"), []
        self.n, self.signs, self.names = len(self.t), ["" if x[0] == "text" else x[1] for x in self.t], [x[1] if x[0] == "name" else "" for x in self.t]
        self.close, opened, waiting = [self.n] * self.n, [], dict.fromkeys(")]}", 0)
        self.open: dict[int, int] = {}
        for k, x in enumerate(self.signs):
            if x not in BRACKETS:
                continue
            if x in PAIRS:
                opened.append(k)
                waiting[PAIRS[x]] += 1
            elif waiting[x]:
                while PAIRS[self.signs[opened[-1]]] != x:
                    waiting[PAIRS[self.signs[opened.pop()]]] -= 1
                waiting[x] -= 1
                self.open[k] = opened[-1]
                self.close[opened.pop()] = k
        self.lines = text.count("\n") + 1
        self.constants = self._constants()
        self.configured: dict | None = None  # of a class that declares its endpoints in Configure()

    def add(self, what: str, **values) -> None:
        self.rows.append({"what": what, "file_path": self.path, **values})

    def op(self, k: int) -> str:
        return self.signs[k] if 0 <= k < self.n else ""

    def name(self, k: int) -> str:
        return self.names[k] if 0 <= k < self.n else ""

    def kind(self, k: int) -> str:
        return self.t[k].kind if 0 <= k < len(self.t) else ""

    def last_line(self, k: int) -> int:
        return self.t[k].line if k < len(self.t) else self.lines

    def _constants(self) -> dict[str, str]:
        """String constants of the file that look like addresses, by name (the last one wins)."""
        found = {}
        for k in range(1, len(self.t) - 1):
            if self.signs[k] == "=" and self.t[k + 1].kind == "text" and self.name(k - 1) and (k + 2 == len(self.t) or self.op(k + 2) in (";", ",") or self.t[k + 2].line > self.t[k + 1].line):
                value = literal(self.t[k + 1])
                if "/" in value or value.startswith("http"):
                    found[self.name(k - 1)] = value
        return found

    # --- pieces -----------------------------------------------------------------------------------------------

    def split(self, a: int, b: int) -> list[tuple[int, int]]:
        """Spans between top-level commas; '<...>' of types counts as a bracket."""
        out, start, k, angle = [], a, a, 0
        while k < b:
            x = self.op(k)
            if x in PAIRS:
                k = self.close[k]
            elif x == "<":
                angle += 1
            elif x == ">":
                angle = max(0, angle - 1)
            elif x == "," and not angle:
                out.append((start, k))
                start = k + 1
            k += 1
        return [*out, (start, b)] if b > a else []

    def words(self, a: int, b: int) -> str:
        """Source text of tokens, without spaces except between words."""
        out = ""
        for x in self.t[a : min(b, len(self.t))]:
            out += " " + x.text if out and (out[-1].isalnum() or out[-1] in "_>])") and x.kind in ("name", "number") else x.text
        return out

    def value(self, a: int, b: int) -> str | None:
        """A route from an expression: literals and known constants joined, other names as '{name}'; None without any literal."""
        out, known = "", False
        for k in range(a, b):
            x = self.t[k]
            if x.kind == "text":
                out, known = out + literal(x), True
            elif x.kind == "name" and self.op(k + 1) not in (".", "(", "?."):
                held = self.constants.get(x.text)
                out, known = out + (held if held is not None else "{" + x.text + "}"), known or held is not None
            elif x.kind == "name" or x.text in ("+", ".", "?."):
                continue
            else:
                return None
        return re.sub(r"\{(\w+)\}", lambda m: self.constants.get(m[1], m[0]), out) if known else None

    def args(self, k: int) -> list[tuple[int, int]]:
        return self.split(k + 1, self.close[k])

    def mark_route(self, mark: tuple[str, int]) -> str:
        """The route of a marker's value or path argument (or its first unnamed one)."""
        if self.op(mark[1]) != "(":
            return ""
        for a, b in self.args(mark[1]):
            if self.op(a + 1) == "=":
                if self.name(a) not in ("value", "path"):
                    continue
                a += 2
            if self.op(a) == "{":
                a, b = a + 1, min(self.close[a], b)
                a, b = (self.split(a, b) or [(a, b)])[0]
            return self.value(a, b) or ""
        return ""

    def marks(self, k: int, end: int) -> tuple[list[tuple[str, int]], int]:
        """Annotations, decorators and attributes before a declaration: (name, index of its '(' or -1)."""
        found = []
        while k < end:
            if self.op(k) == "@" and self.name(k + 1) and self.name(k + 1) != "interface":
                k += 2
                while self.op(k) == "." and self.name(k + 1):
                    k += 2
                found.append((self.name(k - 1), k if self.op(k) == "(" else -1))
                k = self.close[k] + 1 if self.op(k) == "(" else k
            elif self.language == "csharp" and self.op(k) == "[":
                for a, b in self.split(k + 1, self.close[k]):
                    p = next((p for p in range(a, b) if self.op(p) == "("), -1)
                    n = next((self.name(p2) for p2 in range((p if p > 0 else b) - 1, a - 1, -1) if self.name(p2)), "")
                    found.append((n.removesuffix("Attribute"), p))
                k = self.close[k] + 1
            else:
                break
        return found, k

    def header(self, k: int, end: int, in_type: bool) -> int:
        """Where the header that starts at ``k`` ends: at '{', ';', '=', '=>', '}' or, in TypeScript classes, at a line's end."""
        first = k
        while k < end:
            x = self.op(k)
            if x in ("(", "["):
                k = self.close[k] + 1
                continue
            if x == "{" and self.script and self.op(k - 1) in (":", "|", "&", "<", ",") and k > first:
                k = self.close[k] + 1
                continue
            if x in ("{", ";", "}", "=") or (x == "=>" and not (self.script and self.op(k - 1) == ")" and ":" in {self.op(p) for p in range(first, k)} and in_type)):
                return k
            if self.script and in_type and k > first and self.t[k].line > self.t[k - 1].line and self.op(k - 1) not in (":", "|", "&", ",", "<", ".") and x not in ("|", "&", ".", ",", ":") \
                    and self.name(k - 1) not in ("extends", "implements"):
                return k
            k += 1
        return end

    def types(self, owner: str, a: int, b: int, kind: str) -> None:
        for k in range(a, min(b, len(self.t))):
            x = self.t[k]
            if x.kind == "name" and x.text[:1].isupper() and self.op(k + 1) != "." and len(x.text) > 1:
                self.add("type_ref", full_name=owner, target=x.text, kind=kind, line=x.line, col=x.col)

    def plain(self, a: int, b: int) -> list[int]:
        """Tokens at depth 0 of brackets and type arguments."""
        out, angle, k, signs, n = [], 0, a, self.signs, self.n
        while k < b:
            x = signs[k] if k < n else ""
            if x in PAIRS:
                out += [k] if not angle else []
                k = self.close[k] + 1
                continue
            if x == "<":
                angle += 1
            elif x == ">":
                angle -= angle > 0
            elif not angle:
                out.append(k)
            k += 1
        return out

    # --- declarations -----------------------------------------------------------------------------------------

    def file(self) -> list[dict]:
        if self.script:
            self.add("symbol", full_name=self.module, name=self.module.rsplit(".", 1)[-1], kind="module", line=1, end_line=self.lines, col=0)
        for name, value in self.constants.items():
            self.add("constant", name=name, target=value)
        self.declarations(0, len(self.t), self.module if self.script else "", None, [])
        return self.rows

    def declarations(self, k: int, end: int, owner: str, kind: str | None, routes: list[str]) -> None:
        """Declarations of a file, a namespace (kind None) or a type's body."""
        while k < end:
            marks, k = self.marks(k, end)
            if k >= end:
                break
            if kind is None and self.name(k) in ("package", "namespace") and self.name(k + 1):
                stop = self.header(k, end, False)
                space = self.words(k + 1, stop)
                space = f"{owner}.{space}" if owner else space
                if self.op(stop) == "{":
                    self.declarations(stop + 1, self.close[stop], space, None, [])
                    k = self.close[stop] + 1
                else:
                    owner, k = space, stop + 1
                continue
            if kind is None and (self.name(k) in ("import", "using") or self.name(k) == "export" and self.op(k + 1) in ("{", "*")):
                k = self.imports(k, end)
                continue
            stop = self.header(k, end, kind is not None)
            if stop == k:  # a bracket or sign of no declaration
                if self.script and kind is None and self.op(k) == "{":
                    self.body(k + 1, self.close[k], owner)
                k = self.close[k] + 1 if self.op(k) in PAIRS else k + 1
                continue
            k = self.declaration(k, stop, end, owner, kind, marks, routes)

    def imports(self, k: int, end: int) -> int:
        stop = k + 1
        while stop < end and self.op(stop) != ";" and self.t[stop].kind != "text":
            stop = self.close[stop] + 1 if self.op(stop) in PAIRS and self.script else stop + 1
        line = self.t[k].line
        if not self.script:
            a = k + 1 + (self.name(k + 1) == "static")
            alias = self.name(a) if self.op(a + 1) == "=" else ""
            target = self.words(a + 2 * bool(alias), stop)
            self.add("import", target=target.removesuffix(".*"), name=alias or target.rsplit(".", 1)[-1], kind="*" if self.language == "csharp" and not alias or target.endswith(".*") else target.rsplit(".", 1)[-1], line=line)
            return stop + 1
        if stop >= end or self.t[stop].kind != "text":
            return min(stop + 1, end)
        target = literal(self.t[stop])
        before = len(self.rows)
        p = k + 1 + (self.name(k + 1) == "type" and self.op(k + 2) != ",")
        while p < stop:
            if self.op(p) == "{":
                for a, b in self.split(p + 1, self.close[p]):
                    if b > a:
                        a += self.name(a) == "type" and b - a > 1 and self.name(a + 1) != "as"
                        self.add("import", target=target, kind=self.name(a), name=self.name(b - 1), line=line)
                p = self.close[p]
            elif self.op(p) == "*" and self.name(p + 1) == "as":
                self.add("import", target=target, kind="*", name=self.name(p + 2), line=line)
                p += 2
            elif self.name(p) and self.name(p) != "from":
                self.add("import", target=target, kind="default", name=self.name(p), line=line)
            p += 1
        if len(self.rows) == before:
            self.add("import", target=target, line=line)
        return stop + 1 + (self.op(stop + 1) == ";")

    def after(self, stop: int, end: int) -> int:
        """The token after a value or body that begins at ``stop``."""
        if self.op(stop) == "{":
            return self.close[stop] + 1
        if self.op(stop) not in ("=", "=>", ";", "}"):  # the line ended the declaration
            return stop
        k = stop
        while k < end and self.op(k) not in (";", "}"):
            if self.script and k > stop + 1 and self.t[k].line > self.t[k - 1].line and self.op(k - 1) not in tuple("=,+:?|&(.") + ("=>",) and self.op(k) not in tuple(".?:+|&,)=") + ("?.",):
                return k
            k = self.close[k] + 1 if self.op(k) in PAIRS else k + 1
        return k + 1 if self.op(k) == ";" else max(k, stop + 1)

    def declaration(self, k: int, stop: int, end: int, owner: str, kind: str | None, marks: list[tuple[str, int]], routes: list[str]) -> int:
        flat = self.plain(k, stop)
        words = [self.name(p) for p in flat]
        at = next((n for n in range(len(flat) - 2, -1, -1) if words[n] in TYPE_WORDS and words[n + 1] and (n == 0 or words[n - 1] in (*MODIFIERS, "record") or self.op(flat[n - 1]) == "@")), None)
        names = json.dumps([m for m, _ in marks]) if marks else "[]"
        if at is not None and (words[at] != "record" or self.op(flat[at + 2] if at + 2 < len(flat) else stop) in ("(", "{", ":", ";") or "implements" in words):
            return self.type(k, stop, flat, words, at, owner, marks, names)
        call = next((n for n, p in enumerate(flat) if self.op(p) == "(" and n and words[n - 1] and ":" not in {self.op(q) for q in flat[:n]}), None)
        value_is_function = self._arrow(stop + 1, end) if self.script and self.op(stop) == "=" else None
        if call is not None and (self.op(stop) != "=" or not self.script) and (kind is not None or "function" in words[:call]):
            return self.method(k, stop, end, flat, words, call, owner, kind, marks, names, routes)
        if value_is_function is not None and words and any(words):
            n = next((n for n in range(len(words)) if words[n] and words[n] not in MODIFIERS), None)
            if n is not None:
                return self.function_value(k, stop, end, words[n], owner, names, value_is_function, words)
        finish = self.after(stop, end)
        if kind is None:
            if self.script:
                self.body(k, finish, owner)
            return finish
        self.fields(k, stop, finish, flat, words, owner, names)
        return finish

    def type(self, k: int, stop: int, flat: list[int], words: list[str], at: int, owner: str, marks: list[tuple[str, int]], names: str) -> int:
        name = words[at + 1]
        full = f"{owner}.{name}" if owner else name
        kind = {"interface": "interface", "enum": "enum", "record": "record"}.get(words[at], "record" if at and words[at - 1] == "record" else "abstract_class" if "abstract" in words[:at] else "class")
        last = self.close[stop] if self.op(stop) == "{" else stop
        self.add("symbol", full_name=full, name=name, kind=kind, line=self.t[flat[at + 1]].line, end_line=self.last_line(last), col=self.t[flat[at + 1]].col, parent=owner or None, attributes=names,
                 is_abstract="abstract" in words[:at], is_static="static" in words[:at])
        n = 0
        for p in flat[at + 2 :]:
            before = self.op(p - 1) if self.op(p - 1) in (":", ",") else self.name(p - 1)
            if self.name(p) in ("where", "permits"):
                break
            if self.name(p) and self.name(p) not in ("extends", "implements") and (before in (":", ",", "extends", "implements") or self.op(p - 1) == "."):
                if self.op(p + 1) == ".":
                    continue
                target, q = self.name(p), p - 1
                while self.op(q) == "." and self.name(q - 1):
                    target, q = f"{self.name(q - 1)}.{target}", q - 2
                self.add("base", full_name=full, target=target, line=self.t[p].line, col=n)
                n += 1
        if words[at] == "record" or kind == "record":
            p = next((p for p in flat[at + 2 :] if self.op(p) == "("), None)
            for a, b in self.args(p) if p is not None else []:
                _, a = self.marks(a, b)
                if b - a >= 2 and self.name(b - 1):
                    self.add("symbol", full_name=f"{full}.{self.name(b - 1)}", name=self.name(b - 1), kind="property", line=self.t[b - 1].line, end_line=self.t[b - 1].line, col=self.t[b - 1].col, parent=full, type_name=self.words(a, b - 1))
                    self.types(f"{full}.{self.name(b - 1)}", a, b - 1, "property_type")
        if self.op(stop) != "{":
            return stop + 1
        a = stop + 1
        if words[at] == "enum":
            a = last if self.language != "java" else next((p + 1 for p in self.plain(a, last) if self.op(p) == ";"), last)
        prefixes = [self.mark_route(m) for m in marks if m[0] in ("RequestMapping", "Path", "Route")]
        routes = [r.replace("[controller]", name.removesuffix("Controller").lower()) for r in prefixes]
        above, start = self.configured, len(self.rows)
        bases = [self.name(p) for p in flat[at + 2 :]]
        self.configured = {"verbs": [], "routes": []} if self.language == "csharp" and any(b in CONFIGURED_BASES for b in bases) else None
        self.declarations(a, last, full, kind, routes or [""])
        self.handlers(full, start)
        self.configured = above
        return last + 1

    def handlers(self, cls: str, start: int) -> None:
        """Endpoints registered by a member's simple name get its full name; those of Configure() belong to HandleAsync."""
        methods = {}
        for r in self.rows[start:]:
            if r["what"] == "symbol" and r.get("kind") == "method" and r.get("parent") == cls:
                methods.setdefault(r["name"], r["full_name"])
        for verb in self.configured["verbs"] if self.configured else []:
            for route, x in self.configured["routes"]:
                self.add("endpoint", full_name=cls, kind=verb, target=route, line=x.line, col=x.col, parent="HandleAsync")
        for r in self.rows[start:]:
            if r["what"] == "endpoint" and r.get("parent") in methods:
                r["full_name"] = methods[r.pop("parent")]

    def method(self, k: int, stop: int, end: int, flat: list[int], words: list[str], call: int, owner: str, kind: str | None, marks: list[tuple[str, int]], names: str, routes: list[str]) -> int:
        name, opened = words[call - 1], flat[call]
        here = self.t[flat[call - 1]]
        head = set(words[: call - 1])
        kinds = []
        for a, b in self.args(opened):
            _, a = self.marks(a, b)
            eq = next((p for p in self.plain(a, b) if self.op(p) == "="), b)
            colon = next((p for p in self.plain(a, eq) if self.op(p) == ":"), None)
            while self.name(a) in MODIFIERS and a < eq - 1:
                a += 1
            kinds.append((colon + 1, eq) if self.script and colon is not None else (eq, eq) if self.script else (a, max(a, eq - 1)))
        shown = [self.words(a, b) for a, b in kinds]
        shown = ",".join((re.sub(r"<.*>", "", x) if "<" in x else x).rsplit(".", 1)[-1] for x in shown)
        full = f"{owner}.{name}" if self.script else f"{owner}.{name}({shown})"
        body = self.op(stop) == "{" or self.op(stop) == "=>"
        finish = self.after(stop, end) if body or self.op(stop) == "=" else stop + (self.op(stop) == ";") if self.op(stop) != "}" else stop
        after = next((n for n in range(call + 1, len(flat)) if self.op(flat[n]) == ":"), None)
        if self.script:
            result = (flat[after] + 1, stop) if after is not None else (stop, stop)
        else:
            first = next((p for p in flat[: call - 1] if self.name(p) not in MODIFIERS and self.op(p) != "<"), flat[call - 1])
            result = (first, flat[call - 1])
        self.add("symbol", full_name=full, name=name, kind="method", line=here.line, end_line=self.last_line(max(k, finish - 1)), col=here.col, parent=owner or None, attributes=names, signature=f"{name}({self.words(opened + 1, self.close[opened])})",
                 is_abstract="abstract" in head or (kind == "interface" and not body), is_static="static" in head or kind is None, is_classmethod=False, is_async="async" in head, type_name=self.words(*result))
        for (a, b), (start, stop_at) in zip(kinds, self.args(opened), strict=True):
            self.types(full, a, b, "parameter")
            _, start = self.marks(start, stop_at)
            while self.script and self.name(start) in MODIFIERS and start < stop_at - 1:
                start += 1
            if b > a:
                self.bind(full, self.name(start) if self.script else self.name(b), self.t[a], self.words(a, b))
        self.types(full, *result, "return_type")
        if result[1] > result[0]:
            self.bind(full, "()", here, self.words(*result))
        self.served(full, marks, routes, here)
        if body:
            self.body(stop + 1, self.close[stop] if self.op(stop) == "{" else finish, full)
        return max(finish, stop)

    def _arrow(self, k: int, end: int) -> int | None:
        """The '=>' or 'function' of a function value that starts at ``k``."""
        k += self.name(k) == "async"
        if self.name(k) == "function":
            return next((p for p in range(k, min(end, k + 4)) if self.op(p) == "("), None)
        if self.op(k) == "(":
            p = self.close[k] + 1
            while p < end and self.op(p) not in ("=>", ";", "=", ")", "}") and (self.op(p) != "{" or self.op(p - 1) in (":", "|", "&", "<", ",")):
                p = self.close[p] + 1 if self.op(p) in PAIRS else p + 1
            return p if self.op(p) == "=>" else None
        return k + 1 if self.name(k) and self.op(k + 1) == "=>" else None

    def function_value(self, k: int, stop: int, end: int, name: str, owner: str, names: str, arrow: int, words: list[str]) -> int:
        full, finish = f"{owner}.{name}", self.after(stop, end)
        if self.op(arrow) == "=>" and self.op(arrow + 1) == "{":
            finish = max(self.close[arrow + 1] + 1, stop + 1)
        here = next(x for x in self.t[k:stop] if x.text == name)
        self.add("symbol", full_name=full, name=name, kind="method", line=here.line, end_line=self.last_line(finish - 1), col=here.col, parent=owner, attributes=names, signature=self.words(stop + 1, arrow), is_abstract=False,
                 is_static=True, is_classmethod=False, is_async=self.name(stop + 1) == "async")
        opened = next((p for p in range(stop + 1, arrow + 1) if self.op(p) == "("), None)
        if opened is not None:
            self.types(full, opened + 1, self.close[opened], "parameter")
            self.types(full, self.close[opened] + 1, arrow, "return_type")
        self.body(arrow + 1, finish, full)
        return finish

    def fields(self, k: int, stop: int, finish: int, flat: list[int], words: list[str], owner: str, names: str) -> None:
        block = self.op(stop) == "{"
        if block and not self.script and not (set(self.name(p) for p in range(stop + 1, min(stop + 4, self.close[stop]))) & {"get", "set", "init"}):
            self.body(stop + 1, self.close[stop], owner)  # an initialiser
            return
        kind = "property" if block or (self.language == "csharp" and self.op(stop) == "=>") else "field"
        colon = next((n for n, p in enumerate(flat) if self.op(p) == ":"), None) if self.script else None
        commas = [n for n, p in enumerate(flat) if self.op(p) == ","] if not self.script else []
        ends = [colon] if colon is not None else [*commas, len(flat)]
        declared = [n - 1 - (self.op(flat[n - 1]) in ("?", "!")) for n in ends if n]
        shown = [n for n in declared if n >= 0 and words[n] and words[n] not in MODIFIERS]
        if not shown:
            return
        lead = next((n for n, w in enumerate(words) if w not in MODIFIERS), 0)
        a, b = (flat[colon] + 1, stop) if colon is not None else (flat[lead], flat[shown[0]])
        if not self.script and b <= a:
            return
        for n in shown:
            x, full = self.t[flat[n]], f"{owner}.{words[n]}"
            self.add("symbol", full_name=full, name=words[n], kind=kind, line=x.line, end_line=self.last_line(max(k, finish - 1)), col=x.col, parent=owner, attributes=names, is_static="static" in words,
                     type_name=self.words(a, b) if b > a else "")
            if b > a:
                self.types(full, a, b, f"{kind}_type")
        self.body(stop, finish, owner)

    # --- bodies -----------------------------------------------------------------------------------------------

    def served(self, handler: str, marks: list[tuple[str, int]], routes: list[str], here: Token) -> None:
        """Endpoints that markers of a method declare, below each route of its type."""
        own = next((self.mark_route(m) for m in marks if m[0] in ("Path", "Route")), "")
        found = []
        for m in marks:
            if m[0] in SPRING or m[0] in ASPNET:
                found.append((SPRING.get(m[0]) or ASPNET[m[0]], self.mark_route(m) or (own if m[0] in ASPNET else "")))
            elif self.language == "java" and m[0] in JAXRS:
                found.append((m[0], own))
            elif m[0] == "RequestMapping":
                inside = [self.name(p) for p in range(m[1], self.close[m[1]]) if self.name(p) in JAXRS] if m[1] >= 0 else []
                found += [(v, self.mark_route(m)) for v in inside or ["GET"]]
        for verb, route in found:
            for prefix in routes or [""]:
                joined = route if route.startswith("~") else "/".join(x.strip("/") for x in (prefix, route) if x.strip("/"))
                self.add("endpoint", full_name=handler, kind=verb, target="/" + joined.lstrip("~/"), line=here.line, col=0)

    def body(self, k: int, end: int, owner: str) -> None:
        """Calls, and HTTP routes that calls register or ask for."""
        for p in range(k, min(end, self.n)):
            if not self.names[p]:
                continue
            x = self.t[p]
            self.local(p, end, owner)
            if x.text in NOT_CALLED:
                continue
            opened = p + 1
            if self.op(opened) == "<":  # type arguments: names, dots, commas and angles up to '('
                q, depth = opened, 0
                while q < end and (self.name(q) or self.op(q) in tuple("<>.,?[]")):
                    depth += (self.op(q) == "<") - (self.op(q) == ">")
                    q += 1
                    if not depth:
                        break
                opened = q
            if self.script and self.op(p - 1) == "<" and x.text[:1].isupper() and (self.op(p - 2) in MARKUP_AFTER or self.name(p - 2) == "return"):
                self.add("call", full_name=owner, name=x.text, target=x.text, line=x.line, col=x.col, kind="element")  # <Name ...> of markup
            if self.op(opened) != "(":
                continue
            chain, q = x.text, p - 1
            while self.op(q) in (".", "?.", "::") and self.name(q - 1):
                chain, q = f"{self.name(q - 1)}.{chain}", q - 2
            self.add("call", full_name=owner, name=x.text, target=self.chain(p), line=x.line, col=x.col, args=len(self.args(opened)))
            self.http(p, opened, chain, owner)

    def chain(self, p: int) -> str:
        """The name at ``p`` with what it is called on: names, and calls without their arguments; '?' for all else."""
        out, q = self.name(p), p - 1
        while self.op(q) in (".", "?.", "::"):
            call = self.op(q - 1) == ")" and q - 1 in self.open
            at = self.open[q - 1] - 1 if call else q - 1
            if not self.name(at):
                return f"?.{out}"
            out, q = f"{self.name(at)}{'()' * call}.{out}", at - 1
        return f"new {out}" if self.name(q) == "new" and "." in out else out

    def made(self, k: int, end: int) -> str:
        """The value that starts at ``k`` as a chain, or '' where it is none: 'new T(...)' is 'new T()'."""
        new = self.name(k) == "new"
        k += new or self.name(k) == "await"
        out = ""
        while self.name(k) and k < end:
            out += self.name(k)
            k += 1
            if self.op(k) == "<" and new:  # type arguments
                depth = 0
                while k < end and (self.name(k) or self.op(k) in tuple("<>.,?[]")):
                    depth += (self.op(k) == "<") - (self.op(k) == ">")
                    k += 1
                    if not depth:
                        break
            if self.op(k) == "(":
                out, k = out + "()", self.close[k] + 1
            if self.op(k) not in (".", "?."):
                break
            out, k = out + ".", k + 1
        if not out or out.endswith(".") or not (k >= end or self.op(k) in (";", ",", ")", "}") or self.script and self.t[k].line > self.t[k - 1].line):
            return ""
        return f"new {out}" if new else out

    def bind(self, owner: str, name: str, x: Token, of_type: str = "", value: str = "") -> None:
        """What a name may stand for in a method: the type that it is declared with, or the value that it is given."""
        for kind, target in (("type", of_type), ("value", value)):
            if name and target and target not in ("var", "let", "const", "void"):
                self.add("binding", full_name=owner, name=name, kind=kind, target=target, line=x.line, col=x.col)

    def local(self, p: int, end: int, owner: str) -> None:
        """A local that is declared or given a value at ``p``, and what a method of a script returns."""
        x, before = self.t[p], p - 1
        starts = self.op(before) in ("{", "}", ";", "(", ")", "=>", ":") or before < 0 or self.script and self.t[before].line < x.line
        if x.text == "return":
            if self.script and (value := self.made(p + 1, end)):
                self.bind(owner, "()", x, value=value)
        elif self.script and self.name(before) in ("const", "let", "var"):
            typed = self.op(p + 1) == ":"
            stop = p + 1
            while typed and stop < end and self.op(stop) not in ("=", ";", ")"):
                stop = self.close[stop] + 1 if self.op(stop) in PAIRS else stop + 1
            self.bind(owner, x.text, x, self.words(p + 2, stop) if typed else "", self.made(stop + 1, end) if self.op(stop) == "=" else "")
        elif (starts or self.name(before) == "final") and x.text not in STATEMENTS:
            q = p + 1
            while self.op(q) == "." and self.name(q + 1):
                q += 2
            if self.op(q) == "<":
                depth, r = 0, q
                while r < end and (self.name(r) or self.op(r) in tuple("<>.,?[]")):
                    depth += (self.op(r) == "<") - (self.op(r) == ">")
                    r += 1
                    if not depth:
                        break
                q = q if depth else r
            while self.op(q) == "[" and self.op(q + 1) == "]":
                q += 2
            if not self.script and self.name(q) and self.name(q) not in STATEMENTS and self.op(q + 1) in ("=", ";", ":", ",", ")"):
                self.bind(owner, self.name(q), x, self.words(p, q), self.made(q + 2, end) if self.op(q + 1) == "=" else "")
            elif q == p + 1 and self.op(q) == "=":
                self.bind(owner, x.text, x, value=self.made(q + 1, end))

    def http(self, p: int, opened: int, chain: str, owner: str) -> None:
        args = self.args(opened)
        if not args:
            return
        word, receiver, x = self.t[p].text, chain.rpartition(".")[0].rsplit(".", 1)[-1], self.t[p]
        verb = None
        if self.script:
            if chain == "fetch":
                verb = "GET"
                for q in range(args[1][0], args[1][1]) if len(args) > 1 else []:
                    if self.name(q) == "method" and self.op(q + 1) == ":" and self.kind(q + 2) == "text":
                        verb = literal(self.t[q + 2]).upper()
            elif receiver or self.op(p - 1) in (".", "?."):
                verb = SCRIPT_VERBS.get(word)
        elif self.language == "csharp" and self.configured is not None and not receiver and owner.endswith(".Configure()"):
            self.configure(word, args, x, owner)
        elif word in MINIMAL_API and self.language == "csharp":
            route = next((r for r in (self.value(*a) for a in args) if r is not None), "")
            named = next((self.name(b - 1) for a, b in args if self.name(b - 1) and all(self.name(q) or self.op(q) == "." for q in range(a, b))), None)
            self.add("endpoint", full_name=owner, kind=MINIMAL_API[word], target="/" + route.lstrip("/"), line=x.line, col=x.col, parent=named)
        elif self.language == "csharp":
            verb = HTTP_CLIENT.get(word)
        elif "rest" in receiver.lower():
            verb = REST_TEMPLATE.get(word)
        elif word == "uri":  # builders: client.get().uri("...") and newBuilder().uri(URI.create("...")).GET()
            q = p - 2
            while q > 1 and self.op(q) == ")" and self.op(q - 1) == "(":
                verb = verb or SCRIPT_VERBS.get(self.name(q - 2))
                q -= 4
            q = self.close[opened] + 1
            while verb is None and self.op(q) == "." and self.op(q + 2) == "(":
                verb = self.name(q + 1) if self.name(q + 1) in JAXRS else None
                q = self.close[q + 2] + 1
            if self.name(args[0][0]) == "URI" and self.op(args[0][0] + 3) == "(":
                args = self.args(args[0][0] + 3) or args
        route = self.value(*args[0]) if verb else None
        if route is None or not route.startswith(("/", "http", "{")) and not (self.language == "csharp" and route):
            return
        registers = self.script and len(args) > 1 and receiver.lower().endswith(SERVERS)
        if registers:
            a, b = args[-1]
            handler = f"{self.module}.{self.name(a)}" if b - a == 1 and self.name(a) else owner
            self.add("endpoint", full_name=handler, kind=verb, target=route, line=x.line, col=x.col)
        else:
            self.add("client_call", full_name=owner, kind=verb, target=route, line=x.line, col=x.col)


    def configure(self, word: str, args: list[tuple[int, int]], x: Token, owner: str) -> None:
        """A call in Configure(): Get("/x") is an endpoint; Verbs(...) and Routes(...) give each verb each route."""
        found = [r for r in (self.value(*a) for a in args) if r is not None]
        if word == "Verbs":
            self.configured["verbs"] += [self.name(b - 1).upper() for _, b in args if self.name(b - 1).upper() in JAXRS]
        elif word == "Routes":
            self.configured["routes"] += [("/" + r.lstrip("/"), x) for r in found]
        elif word in CONFIGURED and found:
            self.add("endpoint", full_name=owner, kind=CONFIGURED[word], target="/" + found[0].lstrip("/"), line=x.line, col=x.col, parent="HandleAsync")


def parse(path: str, text: str, root: str) -> list[dict]:
    """Rows of one file, by the language of its extension; other files have none."""
    dot = path.rfind(".")
    language = LANGUAGES.get(path[dot:].lower()) if dot >= 0 else None
    if language not in ("java", "csharp", "typescript"):
        return []
    module = path[:dot].removeprefix(root.rstrip("/") + "/").strip("/").replace("/", ".")
    try:
        return _Reader(path, text, language, module).file()
    except RecursionError as e:  # types nested a thousand deep
        return [{"what": "error", "file_path": path, "name": type(e).__name__}]


def staging(files: DataFrame, root: str, kinds: tuple[str, ...] | None = None, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Staging rows of ``files`` (path, text); ``kinds`` and ``columns`` as in spread_rows()."""
    return spread_rows(files, parse, root, kinds, columns)
