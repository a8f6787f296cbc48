"""Source trees as DataFrames: listing, languages, ignore rules, contents, search in texts."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Languages by extension, and folders that are never read.
LANGUAGES = {".py": "python", ".java": "java", ".cs": "csharp", ".ts": "typescript", ".tsx": "typescript", ".js": "typescript", ".jsx": "typescript"}
IGNORED_DIRS = ("node_modules", ".git", "__pycache__", "venv", ".venv", "bin", "obj", "build", "dist", "target", ".idea", ".vscode", "vendor")
LEAST_FILES = 3  # of a language that counts
MINIFIED_LINE = 500


def tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, modified, size) of all files under ``root`` that are not empty; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return rows.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def contents(spark: SparkSession, root: str, extension: str) -> DataFrame:
    """(path, text) of the files with an extension, one row a file."""
    rows = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{extension}").text(root)
    return rows.select(F.regexp_replace("_metadata.file_path", "^file:/*", "/").alias("path"), F.col("value").alias("text"))


def language_of(path: Column) -> Column:
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.create_map(*pairs)[F.concat(F.lit("."), F.lower(F.substring_index(path, ".", -1)))]


def detect_languages(files: DataFrame, least: int = LEAST_FILES) -> DataFrame:
    """(language, files), most files first."""
    rows = files.withColumn("language", language_of(F.col("path"))).where("language IS NOT NULL")
    return rows.groupBy("language").agg(F.count(F.lit(1)).alias("files")).where(F.col("files") >= least).orderBy(F.desc("files"), "language")


def ignore_rules(text: str, prefix: str = "") -> list[tuple[int, bool, str]]:
    """A .gitignore as (order, negated, pattern of a whole relative path).

    '\\#', '\\!' and any other sign after a backslash stand for themselves; blanks at a line's end do not count
    unless the last one is escaped.
    """
    out = []
    for n, line in enumerate(text.splitlines()):
        kept = line.rstrip()
        if kept.endswith("\\") and kept != line:
            kept += " "
        line = kept
        if not line or line.startswith("#"):
            continue
        negated, line = line.startswith("!"), line.removeprefix("!")
        folder, line = line.endswith("/") and not line.endswith("\\/"), line.rstrip("/")
        anchored = "/" in line
        body = _glob(line.lstrip("/"))
        start = re.escape(prefix.strip("/") + "/") if prefix.strip("/") else ""
        out.append((n, negated, f"^{start}{'' if anchored else '(?:.*/)?'}{body}{'/.*' if folder else '(?:/.*)?'}$"))
    return out


def nested_rules(found: Iterable[tuple[str, str]]) -> list[tuple[int, bool, str]]:
    """The rules of all ignore files of a tree, given as (folder below the root, text): a deeper file's come later, so they win.
    Files in folders that rules from above them ignore do not count."""
    out: list[tuple[int, bool, str]] = []
    for folder, text in sorted(found, key=lambda x: (x[0].strip("/").count("/") if x[0].strip("/") else -1, x[0])):
        above = False
        for _, negated, pattern in out:
            if re.match(pattern, folder.strip("/") + "/") or re.match(pattern, folder.strip("/")):
                above = not negated
        if not above:
            out += [(len(out) + k, negated, pattern) for k, (_, negated, pattern) in enumerate(ignore_rules(text, folder))]
    return out


def _glob(pattern: str) -> str:
    """A glob as a regular expression: '**' crosses folders, '{a,b}' is a choice, '[a-z]' a class, '[!a]' what is not in it."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\" and k + 1 < len(pattern):
            out, k = out + re.escape(pattern[k + 1]), k + 2
            continue
        if c == "[" and (end := pattern.find("]", k + 2 + (pattern[k + 1 : k + 2] in ("!", "^")))) > 0:
            body = pattern[k + 1 : end]
            sign = "^/" if body[:1] in ("!", "^") else ""
            body = body[1:] if sign else body
            out, k = out + "[" + sign + re.sub(r"([\\\[\]^&~|])", r"\\\1", body) + "]", end + 1
            continue
        if pattern.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
            continue
        if pattern.startswith("**", k):
            out, k = out + ".*", k + 2
            continue
        if c == "{" and "}" in pattern[k:]:
            end = pattern.index("}", k)
            out, k = out + "(?:" + "|".join(_glob(x) for x in pattern[k + 1 : end].split(",")) + ")", end + 1
            continue
        out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
        k += 1
    return out


glob_pattern = _glob


def is_ignored(path: Column, rules: list[tuple[int, bool, str]], dirs: tuple[str, ...] = IGNORED_DIRS) -> Column:
    """Whether the fixed folders or the last rule that matches drop a relative path."""
    fixed = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, dirs)))
    if not rules:
        return fixed
    last = F.lit(False)
    for _, negated, pattern in sorted(rules):
        last = F.when(path.rlike(pattern), F.lit(not negated)).otherwise(last)
    return fixed | last


def own_references(references: DataFrame, root: str, rules: list[tuple[int, bool, str]] = (), dirs: tuple[str, ...] = IGNORED_DIRS) -> DataFrame:
    """References (file_path, ...) that lie below ``root`` and are not ignored there: what a language server finds elsewhere goes."""
    top = root.rstrip("/") + "/"
    below = F.substring("file_path", len(top) + 1, 1 << 20)
    return references.where(F.startswith("file_path", F.lit(top)) & ~is_ignored(below, list(rules), dirs))


def is_minified(text: Column) -> Column:
    return F.length(F.trim(F.substring_index(text, "\n", 1))) > MINIFIED_LINE


def line_range(text: Column, first: Column, last: Column) -> Column:
    """Lines ``first`` to ``last``, counted from 1, both included."""
    return F.array_join(F.slice(F.split(text, "\n"), first, F.greatest(last - first + 1, F.lit(0))), "\n")


def grep(texts: DataFrame, pattern: str, before: int = 0, after: int = 0) -> DataFrame:
    """(path, line, text, tag) of lines that match, with their surroundings; tag is match or context."""
    rows = texts.select("path", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    hit = F.col("text").rlike(pattern)
    if not before and not after:
        return rows.where(hit).withColumn("tag", F.lit("match"))
    near = Window.partitionBy("path").orderBy("line").rowsBetween(-after, before)
    rows = rows.withColumn("hit", hit).withColumn("near", F.max(hit).over(near))
    return rows.where("near").select("path", "line", "text", F.when(F.col("hit"), "match").otherwise("context").alias("tag"))


def replaced(text: Column, pattern: str, replacement: str, once: bool = False) -> Column:
    """Replacement with $1 backreferences; ``once``: null where the pattern matches more than once."""
    out = F.regexp_replace(text, pattern, replacement)
    return F.when(F.regexp_count(text, F.lit(pattern)) <= 1, out) if once else out


def ancestors(path: Column) -> Column:
    """All folders above a path, outermost first."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    n = F.size(parts) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, k), "/")))).otherwise(F.array().cast("array<string>"))


def relative_paths(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, root, below) of ``paths`` (path) under the longest of many ``roots`` (root) that each lies in; with none, the path as it is.

    A path meets its own ancestors alone: an equi-join, however many roots there are.
    """
    known = roots.select(F.regexp_replace("root", "/+$", "").alias("root")).distinct()
    above = paths.select("path").distinct().select("path", F.explode(ancestors(F.col("path"))).alias("root")).join(known, "root")
    best = above.groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    below = F.when(F.col("root").isNotNull(), F.substr("path", F.length("root") + 2)).otherwise(F.col("path"))
    return paths.select("path").join(best, "path", "left").select("path", "root", below.alias("below"))


def with_any(path: Column, endings: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.endswith(path, F.lit(x)) for x in endings))
