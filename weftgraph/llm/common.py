"""What the operators share: staged tables, text normalisation and names of columns."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.plans.shipping import arrow_map as arrow_map  # the operators take these from here
from weftgraph.plans.staging import new_path as new_path
from weftgraph.plans.staging import staged as stage  # noqa: F401
from weftgraph.plans.staging import unstaged as unstage  # noqa: F401

#: Text patterns of the operators' contracts, for Java and RE2 alike.
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; pure ASCII text takes the fast path."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def numbered(df: DataFrame, name: str = "_rid") -> DataFrame:
    """A number per row; stage() the result before using it twice."""
    return df.withColumn(name, F.monotonically_increasing_id())


def unused(columns: list[str], name: str) -> str:
    """``name``, or a longer one that no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def filesystem_of(path: str) -> tuple:
    """Arrow's file system of a path or URI as Spark has them, and the path in it, for reading ranges and writing files within tasks."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if colon and scheme in ("s3a", "s3n"):
        path = f"s3:{rest}"
    elif colon and scheme == "file":
        path = "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(path)


#: Of rows that stand for files: tasks of one job at most.
MOST_TASKS = 100_000


def one_task_each(rows: DataFrame) -> DataFrame:
    """Few small rows that mean much work, a task each."""
    return rows.repartition(max(1, min(rows.count(), MOST_TASKS)))
