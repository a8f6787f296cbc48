"""Exact dedup against a persistent digest index, bucketed and sorted by digest.

A batch is reduced to one row per digest (partial sums before the shuffle, so a text that makes
up a third of all rows is no hot key), anti-joined by sort-merge with the index, and what is new
is appended. The index side of that join is neither shuffled nor, while it has one file per
bucket, sorted. A new index gets as many buckets as its first batch needs, of ``BUCKET_ROWS``
digests each; one that has outgrown them, or has many files a bucket, is written anew by rebucketed().

Rows: null text counts as empty; equal texts of a batch keep the row with the largest id; texts
already in the index keep the row that entered first; a null id never wins over another; rows
repeated with one id share one verdict; an empty table gives an empty result; other columns of
the input are ignored, so clashing names do no harm.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import ascii_lower, new_path, stage, text_or_empty, unstage

INDEX_SCHEMA = "text_sha256 string, keep_id bigint"
BUCKET_ROWS = 2_000_000  # of some 80 bytes each
BUCKETS = (64, 1 << 16)  # of a new index, at least and at most


def buckets_for(rows: int) -> int:
    """A power of two, so that indexes of different sizes have buckets that divide each other."""
    need = 1 << max(0, -(-rows // BUCKET_ROWS) - 1).bit_length()
    return min(BUCKETS[1], max(BUCKETS[0], need))


class DigestIndex:
    """The index is a bucketed external table: ``path`` outlives the session, ``open`` finds it again."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS[0], table: str | None = None):
        self.spark, self.buckets = spark, buckets
        self.path = path or new_path(spark, "digest-index")
        self.table = table or f"weft_digest_index_{uuid.uuid4().hex}"
        if not spark.catalog.tableExists(self.table):
            spark.sql(
                f"CREATE TABLE {self.table} ({INDEX_SCHEMA}) USING parquet CLUSTERED BY (text_sha256) "
                f"SORTED BY (text_sha256) INTO {buckets} BUCKETS LOCATION '{self.path}'"
            )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def rebucketed(self, buckets: int | None = None) -> DigestIndex:
        """The same digests in a new index, one file a bucket, with as many buckets as they need now."""
        new = DigestIndex(self.spark, buckets=buckets or buckets_for(self.rows().count()))
        new.append(self.rows())
        return new

    def forget(self) -> None:
        """Take the table out of the catalogue; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def append(self, groups: DataFrame) -> None:
        """Add the digests of ``groups`` that the index lacks."""
        fresh = groups.select("text_sha256", "keep_id").join(self.rows().select("text_sha256").hint("merge"), "text_sha256", "left_anti")
        (
            fresh.repartition(self.buckets, "text_sha256")
            .write.mode("append").format("parquet").option("path", self.path)
            .bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").saveAsTable(self.table)
        )
        self.spark.catalog.refreshTable(self.table)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.sha2(ascii_lower(text_or_empty(text_col)), 256).alias("text_sha256"))


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size (rows of this batch), kept, text_sha256."""
    rows = stage(digests(docs, id_col, text_col), "digests")
    groups = stage(rows.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "digest-groups")
    given, index = index, index or DigestIndex(docs.sparkSession, buckets=buckets_for(groups.count()))
    index.append(groups)
    resolved = stage(groups.drop("keep_id").join(index.rows().hint("merge"), "text_sha256"), "digest-verdicts")
    unstage(groups)
    if given is None:
        index.forget()
    return rows.join(resolved, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


ORACLE = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
           FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
