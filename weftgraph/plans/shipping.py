"""Python functions on executors that need not have this package installed."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = "512"  # in place of Spark's default of 10,000: a batch of long texts must fit in memory and under 2 GB


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, whatever their own Python path holds."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="weft-package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in package.rglob("*.py"):
            z.write(f, f"{package.name}/{f.relative_to(package)}")
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


def arrow_map(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """mapInArrow() with this package on the executors."""
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, BATCH_ROWS)
    return df.mapInArrow(function, schema)
