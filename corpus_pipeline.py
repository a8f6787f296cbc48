"""A corpus from raw documents: five stages, each an operator of weftgraph.llm at work.

quality     documents whose probability of the best grade is under one half go
near_dedup  one document of each group of near copies (linked from ``NEAR`` on) stays
decontaminate  documents that repeat benchmark items go
mixing      sources are brought to their target weights: whole copies, and a sample
sharding    each document gets its shard

A stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet into the shared
folder and hands the next stage what it reads there. All but the last keep the columns of documents.

Rows: null text is judged as an empty one, kept by near_dedup (it links with nothing) and by decontaminate (it
repeats nothing), and has no words to mix, so it comes as often as its source's certain copies and its draw say;
null ids and null sources are allowed; rows repeated with one id and text leave one in near_dedup; of equal ids
with different texts each row is judged by itself; an empty table stays empty in every stage; further columns,
whatever their names, pass through, but that the last stage replaces those named like its outputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import decontaminate, mixing, near_dedup, quality, sharding
from weftgraph.llm.common import numbered, read_table, stage, unstage, unused

NEAR = 80  # per cent of five-word shingles; the 85 of op4 is that query's own


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits on the labelled documents among ``docs``; null text is judged as an empty one."""
    model = quality.fit_quality(docs, read_table(spark, sf_dir, "labels"))
    prefix = "_judged_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    scored = quality.score_quality(docs, model, carry=docs.columns, prefix=prefix)
    return scored.where(f"{prefix}kept").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the row with the least id stays; rows are told apart by number, not by id."""
    row = unused(docs.columns, "_row")
    rows = stage(numbered(docs, row), "near-dedup-input")
    gone = near_dedup.near_dedup(rows, row_col=row, similarity=NEAR).where(~F.col("stays")).select(F.col("_rid").alias(row))
    return rows.join(gone, row, "left_anti").select(docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Judges each row; rows repeated with one id and different texts are told apart by a number."""
    row = unused(docs.columns, "_row")
    rows = stage(numbered(docs, row), "decontaminate-input")
    found = decontaminate.decontaminate(rows.select(F.col(row).alias("doc_id"), "text"), read_table(spark, sf_dir, "benchmark"))
    gone = found.where("contaminated").select(F.col("doc_id").alias(row))
    return rows.join(gone, row, "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document taken k times is k rows."""
    return mixing.repeat_rows(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(docs)


STAGES = [
    ("quality", keep_good),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_benchmark),
    ("mixing", mix),
    ("sharding", shard),
]

#: Signatures and the classifier have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            unstage(before)
        before = docs
    return docs
