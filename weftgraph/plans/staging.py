"""Cut a plan by writing it to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LEFT: dict[str, SparkSession] = {}
BROADCAST = "spark.sql.autoBroadcastJoinThreshold"
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
OPEN_FOLDERS = "32"  # that a task may write to at once; rows of more folders are sorted by them first, as Spark does by default for any number
BROADCAST_BYTES = "2097152b"  # in place of Spark's default of 10 MB, which counts compressed bytes: names take ten times that in the driver


def bound_broadcasts(spark: SparkSession) -> None:
    """From now on the session broadcasts only small tables, unless it has a threshold of its own."""
    if spark.conf.get(BROADCAST) in ("10485760b", "10485760"):
        spark.conf.set(BROADCAST, BROADCAST_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a temporary folder for a local master, and an error for a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='weft-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; what is left there goes when the driver ends."""
    path = f"{shared_dir(spark)}/weft/{name}-{uuid.uuid4().hex}"
    _LEFT[path] = spark
    return path


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written as Parquet and read again: no lineage to recompute, and any executor may be lost. Rows lie in a folder for each
    value of the column ``by``, so that who asks for one value reads no other."""
    spark = df.sparkSession
    bound_broadcasts(spark)
    path = new_path(spark, name)
    if by and spark.conf.get(WRITERS) == "0":  # else each task sorts all its rows by their folders
        spark.conf.set(WRITERS, OPEN_FOLDERS)
        try:
            df.write.partitionBy(by).parquet(path)
        finally:
            spark.conf.set(WRITERS, "0")
    else:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out = out.select(df.columns) if by else out  # the column of folders comes last
    out._weft_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def unstaged(*tables: DataFrame) -> None:
    """Remove staged tables that no later step reads."""
    for df in tables:
        path = getattr(df, "_weft_path", None)
        if path and _LEFT.pop(path, None):
            _delete(df.sparkSession, path)


@atexit.register
def _clean() -> None:
    for path, spark in list(_LEFT.items()):
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the session has ended before
            return
