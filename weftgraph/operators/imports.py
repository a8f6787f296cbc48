"""What import rows name: path aliases, relative modules, and edges from files to symbols and packages.

An import gives candidates of full names, the likeliest first; one equi-join with the symbols settles all of them.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import PropertyGraph
from weftgraph.plans.staging import staged
from weftgraph.schema import edge_columns, node_columns, node_id

Aliases = tuple[tuple[str, str], ...]
_COMMENT = re.compile(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', re.DOTALL)
_LAST_COMMA = re.compile(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])')


def path_aliases(config: str, folder: str = "") -> Aliases:
    """(prefix, folder below the root) of a compiler configuration with comments: {"@/*": ["./src/*"]} is ('@/', 'src/').
    Only patterns that end in '/*' count, each with its first target; a configuration that does not parse has none."""
    keep = lambda m: m[1] or ""
    try:
        read = json.loads(_LAST_COMMA.sub(keep, _COMMENT.sub(keep, config)))
        paths = read.get("compilerOptions", {}).get("paths", {})
    except (ValueError, AttributeError):
        return ()
    above = folder.strip("/") + "/" if folder.strip("/") not in ("", ".") else ""
    return tuple((k.removesuffix("*"), above + v[0].removesuffix("*").removeprefix("./")) for k, v in paths.items() if k.endswith("/*") and v)


def _folded(path: Column) -> Column:
    """A path without '.' and '..' segments."""
    step = lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x.isin("", "."), acc).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def script_module(file_path: Column, target: Column, root: str, aliases: Aliases = ()) -> Column:
    """The module that a TypeScript import names, as its path below the root with dots; null for packages of others."""
    below = F.substring(file_path, len(root.rstrip("/")) + 2, 1 << 20)
    folder = F.regexp_replace(below, "[^/]*$", "")
    path = F.when(F.startswith(target, F.lit(".")), F.concat(folder, target))
    for prefix, real in aliases:
        path = path.when(F.startswith(target, F.lit(prefix)), F.concat(F.lit(real), F.substring(target, len(prefix) + 1, 1 << 20)))
    return F.translate(F.regexp_replace(_folded(path), r"\.(ts|tsx|js|jsx)$", ""), "/", ".")


def python_name(file_path: Column, target: Column, root: str) -> Column:
    """A Python import's full name; leading dots count folders up from the file's own."""
    below = F.substring(file_path, len(root.rstrip("/")) + 2, 1 << 20)
    folders = F.filter(F.split(F.regexp_replace(below, "[^/]*$", ""), "/"), lambda x: x != "")
    dots = F.length(F.regexp_extract(target, r"^(\.*)", 1))
    base = F.slice(folders, F.lit(1), F.greatest(F.size(folders) - dots + 1, F.lit(0)))
    rest = F.regexp_replace(target, r"^\.+", "")
    return F.when(dots == 0, target).otherwise(F.array_join(F.concat(base, F.array(rest)), "."))


def _candidates(language: str, root: str, aliases: Aliases) -> Column:
    target = F.col("target")
    if language == "python":
        full = python_name(F.col("file_path"), target, root)
        return F.array(full, F.regexp_replace(full, r"\.[^.]*$", ""))
    if language == "typescript":
        module = script_module(F.col("file_path"), target, root, aliases)
        member = lambda m: F.concat(m, F.lit("."), F.col("kind"))
        index = F.concat(module, F.lit(".index"))
        return F.array(member(module), member(index), module, index)
    return F.array(target, F.regexp_replace(target, r"\.[^.]*$", "")) if language == "java" else F.array(target)


def resolved(g: PropertyGraph, staging: DataFrame, repo: str, language: str, aliases: Aliases = ()) -> DataFrame:
    """(file_path, name, dst, full, label): what the names that imports bring in stand for, by the first candidate that the graph knows."""
    rows = staging.where("what = 'import' AND target IS NOT NULL").select("file_path", "target", "kind", F.coalesce("name", F.lit("")).alias("name")).distinct()
    tried = rows.select("file_path", "target", "kind", "name", F.posexplode(_candidates(language, repo, aliases)).alias("_try", "full_name")).where("full_name IS NOT NULL")
    tried = staged(tried, "import-candidates")  # symbols that no import names are left out
    known = g.label("Class", "Interface", "Method", "Package").join(tried.select("full_name").distinct(), "full_name", "left_semi").groupBy("full_name").agg(F.min(F.struct(F.col("node_id").alias("dst"), F.col("full_name").alias("full"), F.col("kind_label").alias("label"))).alias("x"))
    best = tried.join(known, "full_name").groupBy("file_path", "target", "kind", "name").agg(F.min_by("x", "_try").alias("x"))
    return best.select("file_path", "name", "x.dst", "x.full", "x.label").distinct()


def import_edges(imported: DataFrame) -> DataFrame:
    """IMPORTS from files to what resolved() found; imports of what the graph does not know give no edge."""
    return imported.select("file_path", "dst").distinct().select(edge_columns(node_id("File", F.col("file_path")), F.col("dst"), "IMPORTS"))


def packages(g: PropertyGraph, staging: DataFrame) -> PropertyGraph:
    """Package nodes for what top-level types name as their parent, with CONTAINS to those types."""
    symbols = staging.where("what = 'symbol'").select("full_name", "parent").distinct()
    loose = symbols.where("parent IS NOT NULL").join(symbols.select(F.col("full_name").alias("parent")), "parent", "left_anti")
    held = staged(loose.join(g.label("Class", "Interface").select("full_name", F.col("node_id").alias("dst")), "full_name").select("parent", "dst"), "types-of-packages")
    names = held.select("parent").distinct()
    nodes = names.select(node_columns(node_id=node_id("Package", F.col("parent")), labels=F.array(F.lit("Package")), kind_label=F.lit("Package"), full_name=F.col("parent"), name=F.col("parent")))
    return PropertyGraph(nodes, held.select(edge_columns(node_id("Package", F.col("parent")), F.col("dst"), "CONTAINS")))


def visible_constants(staging: DataFrame, repo: str, language: str, aliases: Aliases = ()) -> DataFrame:
    """(file_path, name, value): address constants that a file can use without their owner's name: its own, and those it imports.
    Java and C# reach constants through types, so there a name that one file alone declares is visible to all that ask for it."""
    own = staging.where("what = 'constant'").groupBy("file_path", "name").agg(F.max("target").alias("value"))
    if language in ("java", "csharp"):
        only = own.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("value")).where("n = 1").select("name", "value")
        asking = staging.where("what = 'client_call'").select("file_path", F.regexp_extract(F.coalesce("target", F.lit("")), r"^\{(\w+)\}", 1).alias("name")).distinct()
        more = asking.join(only, "name").select("file_path", "name", "value")
    else:
        below = F.regexp_replace(F.substring("file_path", len(repo.rstrip("/")) + 2, 1 << 20), r"\.\w+$", "")
        declared = own.select(F.concat(F.translate(below, "/", "."), F.lit("."), F.col("name")).alias("full"), "value")
        wanted = python_name(F.col("file_path"), F.col("target"), repo) if language == "python" else F.concat(script_module(F.col("file_path"), F.col("target"), repo, aliases), F.lit("."), F.col("kind"))
        asked = staging.where("what = 'import'").select("file_path", "name", wanted.alias("full"))
        more = asked.join(declared, "full").select("file_path", "name", "value")
    ranked = own.withColumn("r", F.lit(0)).unionByName(more.withColumn("r", F.lit(1)))
    return ranked.groupBy("file_path", "name").agg(F.min(F.struct("r", "value")).alias("x")).select("file_path", "name", "x.value")


def with_constants(calls: DataFrame, constants: DataFrame) -> DataFrame:
    """Client calls (file_path, route, ...) with a leading '{name}' replaced by the constant (file_path, name, value) that
    their file sees; a name that is not known stays as it is."""
    lead = F.regexp_extract("route", r"^\{(\w+)\}", 1)
    held = constants.select("file_path", F.col("name").alias("_name"), F.col("value").alias("_value"))
    joined = calls.withColumn("_name", F.when(lead != "", lead)).join(held, ["file_path", "_name"], "left")
    out = F.when(F.col("_value").isNotNull(), F.concat("_value", F.regexp_replace("route", r"^\{\w+\}", ""))).otherwise(F.col("route"))
    return joined.withColumn("route", out).select(calls.columns)
