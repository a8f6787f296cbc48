"""License scans by canonical digest lookup.

A text is brought to a canonical form (ASCII lower case; lines that state a copyright dropped; everything but
letters and digits to one space; equivalent spellings to one) and its SHA-256 is joined with the
digests of known licences. Two grains use the same lookup: the entire text, and every entire line
against notices of one line. The catalogue is a fixed list of the package, with the usual titles, wordings and
lines of reserved rights (or the caller's, which is broadcast only up to ``CATALOGUE_LIMIT`` rows and joined by shuffle beyond that).

Rows: null text counts as empty and has the digest of ''; repeated rows are answered each; an empty
table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import ascii_lower, numbered, stage, text_or_empty
from weftgraph.llm.license_texts import EQUIVALENT, HEADS, LONG, NOTICES, TITLED, WHOLE

#: A line that states a copyright; one that goes on about notices or holders, as texts have where they are wrapped so, is the group that stays.
COPYRIGHT_LINE = (
    r"(?m)^[^\n0-9a-z]*(?:(copyright +(?:notices?|holders?|owners?|laws?|licen[sc]es?|statements?|disclaimers?|interests?|and|or|in|is|of|to)\b[^\n]*)"
    r"|(?:copyright|\(c\)(?: *copyright| *[<\[]|[^\n]*[12][0-9]{3})|©)[^\n]*)$"
)
OTHER = r"[^0-9a-z\n\x{80}-\x{10FFFF}]+"
CATALOGUE_LIMIT = 10_000


def canonical_lines(text: Column) -> Column:
    """The canonical form with line breaks kept. Each costly step runs only on texts that it can change."""
    low = ascii_lower(text)
    marks = F.contains(low, F.lit("copyright")) | F.contains(low, F.lit("(c)")) | F.contains(low, F.lit("©"))
    out = F.when(marks, F.regexp_replace(low, COPYRIGHT_LINE, "$1")).otherwise(low)
    out = F.regexp_replace(out, OTHER, " ")
    variants = F.lit(False)
    for a, _ in EQUIVALENT:
        variants |= F.contains(low, F.lit(a.split(" ")[-1] if " " in a else a))
    same = out
    for a, b in EQUIVALENT:
        same = F.regexp_replace(same, rf"\b{a}\b", b)
    return F.when(variants, same).otherwise(out)


def canonical(lines: Column) -> Column:
    """One line: the digest of an entire text is taken of this."""
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def catalogue(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """(license_id, digest) of (license_id, text) pairs."""
    texts = spark.createDataFrame(rows, "license_id string, text string")
    digest = F.sha2(canonical(canonical_lines(F.col("text"))), 256)
    return texts.select("license_id", digest.alias("digest")).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def _small(rows: list, df: DataFrame) -> DataFrame:
    return F.broadcast(df) if len(rows) <= CATALOGUE_LIMIT else df


def license_scan(docs: DataFrame, texts: list[tuple[str, str]] | None = None, notices: list[tuple[str, str]] | None = None,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, canonical_sha256, license_id (of the entire text, or null), notice_ids (comma-joined, of entire lines, or null)."""
    spark = docs.sparkSession
    notices = NOTICES if notices is None else notices
    long = LONG if texts is None else []
    texts = [*WHOLE, *TITLED, *notices] if texts is None else texts
    lines = canonical_lines(text_or_empty(text_col))
    # A line can only equal a notice if the text has the notice's rarest word; that keeps most texts from being split.
    held = F.contains(F.col("_lines"), F.lit("licens")) | F.contains(F.col("_lines"), F.lit("released")) if notices is NOTICES else F.lit(True)
    rows = numbered(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), lines.alias("_lines")))
    rows = stage(
        rows.select("_rid", "doc_id", F.sha2(canonical(F.col("_lines")), 256).alias("digest"),
                    F.when(held, F.transform(F.split("_lines", "\n"), lambda x: F.sha2(F.trim(x), 256))).alias("line_digests")),
        "license-digests",
    )
    known = catalogue(spark, texts)
    if long:
        known = known.unionByName(spark.createDataFrame(long, "license_id string, digest string"))
    known = _small(texts, known)
    hits = rows.where("line_digests IS NOT NULL").select("_rid", F.explode("line_digests").alias("digest"))
    hits = hits.join(_small(notices, catalogue(spark, notices)), "digest").groupBy("_rid").agg(F.collect_set("license_id").alias("ids"))
    hits = hits.select("_rid", F.array_join(F.array_sort("ids"), ",").alias("notice_ids"))
    out = rows.drop("line_digests").join(known, "digest", "left").join(hits, "_rid", "left")
    return out.select("doc_id", F.col("digest").alias("canonical_sha256"), "license_id", "notice_ids")


def _oracle() -> str:
    def canon(x: str) -> str:
        x = f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        x = f"regexp_replace({x}, '{COPYRIGHT_LINE}', '\\1', 'g')"
        x = f"regexp_replace({x}, '{OTHER}', ' ', 'g')"
        for a, b in EQUIVALENT:
            x = f"regexp_replace({x}, '\\b{a}\\b', '{b}', 'g')"
        return x

    def values(rows) -> str:
        return ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in rows)

    whole = "sha256(trim(regexp_replace(c, '[ \\n]+', ' ', 'g')))"
    return f"""
WITH w(license_id, text) AS (VALUES {values(WHOLE)}), n(license_id, text) AS (VALUES {values(NOTICES)}), h(license_id, head) AS (VALUES {values(HEADS)}), far(license_id, digest) AS (VALUES {values(LONG)}),
t AS (FROM w UNION ALL FROM n UNION ALL SELECT license_id, head || chr(10) || chr(10) || text FROM w JOIN h USING (license_id)),
tc AS (SELECT license_id, {canon('text')} AS c FROM t), nc AS (SELECT license_id, {canon('text')} AS c FROM n),
td AS (SELECT digest, min(license_id) AS license_id FROM (SELECT {whole} AS digest, license_id FROM tc UNION ALL SELECT digest, license_id FROM far) GROUP BY 1),
nd AS (SELECT {whole} AS digest, min(license_id) AS license_id FROM nc GROUP BY 1),
d AS (SELECT row_number() OVER () AS rid, doc_id, {canon("coalesce(text, '')")} AS c FROM documents),
l AS (SELECT rid, sha256(trim(unnest(string_split(c, chr(10))))) AS digest FROM d),
hit AS (SELECT rid, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notice_ids FROM l JOIN nd USING (digest) GROUP BY rid),
own AS (SELECT rid, doc_id, {whole} AS digest FROM d)
SELECT doc_id, digest AS canonical_sha256, license_id, notice_ids FROM own LEFT JOIN td USING (digest) LEFT JOIN hit USING (rid)
"""


ORACLE = _oracle()
