"""Plain text from markup, versions, and kinds of symbols from the numbers that language servers use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds by number; a number that a language lacks names nothing to keep.
KINDS = {
    "csharp": {3: "namespace", 5: "class", 6: "method", 7: "property", 8: "field", 9: "method", 10: "enum", 11: "interface", 12: "method"},
    "java": {3: "namespace", 4: "namespace", 5: "class", 6: "method", 7: "property", 8: "field", 9: "method", 10: "enum", 11: "interface", 12: "method", 14: "field"},
    "python": {2: "module", 3: "namespace", 5: "class", 6: "method", 7: "property", 8: "field", 9: "method", 12: "method"},
    "typescript": {2: "module", 3: "namespace", 5: "class", 6: "method", 7: "property", 8: "field", 9: "method", 10: "enum", 11: "interface", 12: "method"},
}
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}


def symbol_kind(language: Column, number: Column) -> Column:
    """The kind of a server's symbol, null where it is to be skipped."""
    pairs = [F.lit(x) for lang, kinds in KINDS.items() for n, kind in kinds.items() for x in (f"{lang} {n}", kind)]
    return F.try_element_at(F.create_map(*pairs), F.concat(language, F.lit(" "), number.cast("string")))


def markup_text(html: Column) -> Column:
    """Text between tags, joined by one space; comments go, common character references are decoded."""
    bare = F.regexp_replace(html, r"(?s)<!--.*?-->|<[!/?a-zA-Z][^>]*>", "\n")
    for name, value in ENTITIES.items():
        bare = F.replace(bare, F.lit(f"&{name};"), F.lit(value))
    bare = F.replace(F.replace(bare, F.lit("&#39;"), F.lit("'")), F.lit("&amp;"), F.lit("&"))
    parts = F.filter(F.transform(F.split(F.translate(bare, "\u00a0", " "), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(parts, " ")


def version(text: Column) -> Column:
    """The leading numbers of a version: '1.2.3rc1' is [1, 2, 3], '2.x' is [2]."""
    lead = F.regexp_extract(text, r"^(\d+(?:\.\d+)*)", 1)
    return F.when(lead == "", F.array().cast("array<int>")).otherwise(F.split(lead, r"\.").cast("array<int>"))


def at_least(text: Column, *numbers: int) -> Column:
    """Whether a version is ``numbers`` or later; numbers that it lacks count as 0."""
    have = version(text)
    padded = F.slice(F.concat(have, F.array_repeat(F.lit(0), len(numbers))), 1, len(numbers))
    return padded >= F.array(*map(F.lit, numbers))


def iso_time(text: Column) -> Column:
    """A time from ISO text, with or without a zone (none means UTC) and fractions; null where it is none."""
    return F.try_to_timestamp(F.regexp_replace(F.regexp_replace(text, "T", " "), r"^([^+Z]*)$", "$1Z"))
