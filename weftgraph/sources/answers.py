"""Recorded answers of language servers as tables: what only a compiler knows, from JSON rows, in the form that builds take.

A row is one answer: the symbol that was asked about, and what came back. Places are those of the protocol: file URIs,
lines from 0, and columns in UTF-16 units, which become lines from 1 and columns in code points of the file's text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.sources.files import own_references

PLACE = "struct<uri: string, range: struct<start: struct<line: int, character: int>>>"
REFERENCES = f"struct<callee: string, result: array<{PLACE}>>"
DEFINITIONS = f"struct<caller: string, at: {PLACE}, callee: string>"


def path_of(uri):
    """'file:///a%20b/c.py' gives '/a b/c.py'; other schemes give null."""
    plain = F.regexp_extract(uri, r"^file://(?:localhost)?(/.*)$", 1)
    return F.when(plain != "", F.try_url_decode(F.replace(plain, F.lit("+"), F.lit("%2B"))))


def placed(rows: DataFrame, place: str) -> DataFrame:
    """``rows`` with file_path, line (from 1) and character of the column ``place`` in its stead; places in no file go."""
    at = F.col(place)
    found = rows.withColumns({"file_path": path_of(at["uri"]), "line": at["range"]["start"]["line"] + 1, "character": at["range"]["start"]["character"]})
    return found.drop(place).where("file_path IS NOT NULL")


def code_points(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """``rows`` (file_path, line, character, ...) with ``col``, counted in code points of the line in ``texts`` (path, text).

    Only lines that some row names are kept of the texts; where a line is not there the column stays as it is.
    """
    wanted = rows.select("file_path", "line").distinct()
    files = texts.select(F.col("path").alias("file_path"), "text").join(wanted.select("file_path").distinct(), "file_path", "left_semi")
    lines = files.select("file_path", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("at", "held")).withColumn("line", F.col("at") + 1).drop("at").join(wanted, ["file_path", "line"], "left_semi")
    # Of the units before a column, each first half of a pair is one too many. Units are four hexadecimal digits.
    units = F.hex(F.encode("held", "UTF-16BE"))
    head = F.regexp_replace(F.substring(units, F.lit(1), 4 * F.col("character")), "(.{4})", "$1 ")
    col = F.col("character") - F.regexp_count(head, F.lit(r"\bD[89AB]"))
    return rows.join(lines, ["file_path", "line"], "left").withColumn("col", F.coalesce(col, "character")).drop("held", "character")


def references(answers: DataFrame, texts: DataFrame, root: str, rules: list[tuple[int, bool, str]] = ()) -> DataFrame:
    """(callee, file_path, line, col) of ``answers`` (value: JSON text of REFERENCES): the references that lie in the repository at ``root``
    and are not ignored there."""
    rows = answers.select(F.from_json("value", REFERENCES).alias("a")).select("a.callee", F.explode("a.result").alias("place"))
    own = own_references(placed(rows, "place"), root, list(rules))
    return code_points(own, texts).select("callee", "file_path", "line", "col").distinct()


def definitions(answers: DataFrame, texts: DataFrame, root: str, rules: list[tuple[int, bool, str]] = ()) -> DataFrame:
    """(caller, line, col, callee) of ``answers`` (value: JSON text of DEFINITIONS): what calls in the repository are calls of."""
    rows = answers.select(F.from_json("value", DEFINITIONS).alias("a")).select("a.caller", "a.callee", "a.at").where("callee IS NOT NULL")
    own = own_references(placed(rows, "at"), root, list(rules))
    return code_points(own, texts).select("caller", "line", "col", "callee").distinct()
