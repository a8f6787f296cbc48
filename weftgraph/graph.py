"""A property graph as two DataFrames, with views and guarded SQL over them."""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from weftgraph.plans.staging import staged
from weftgraph.schema import EDGE_DDL, EDGE_FIELDS, LABEL_ORDER, NODE_DDL, NODE_FIELDS

TIMEOUT_S = 10.0  # of an ad-hoc query


def filtered(writer: DataFrameWriter, *columns: str) -> DataFrameWriter:
    """With Bloom filters of the columns, as large as their values need."""
    writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
    for c in columns:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    return writer


@dataclass(frozen=True)
class PropertyGraph:
    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def of(cls, nodes: list[DataFrame], edges: list[DataFrame]) -> PropertyGraph:
        return cls(reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges))

    @classmethod
    def empty(cls, spark: SparkSession) -> PropertyGraph:
        return cls(spark.createDataFrame([], NODE_DDL), spark.createDataFrame([], EDGE_DDL))

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> PropertyGraph:
        return cls(spark.read.schema(NODE_DDL).parquet(f"{path}/nodes"), spark.read.schema(EDGE_DDL).parquet(f"{path}/edges").select(*EDGE_FIELDS))

    def write(self, path: str, files_per_type: int = 8) -> None:
        """Edges lie by type, so a filter on type prunes folders; both are sorted by what lookups ask for, so pages can be skipped, and
        have Bloom filters for other keys, so row groups can."""
        nodes = self.nodes.select(*NODE_FIELDS).sortWithinPartitions("kind_label", "full_name").write.mode("overwrite")
        filtered(nodes, "node_id", "file_path").partitionBy("kind_label").parquet(f"{path}/nodes")
        spread = F.pmod(F.xxhash64("src"), F.lit(files_per_type))
        rows = self.edges.select(*EDGE_FIELDS).repartition("type", spread).sortWithinPartitions("type", "src")
        filtered(rows.write.mode("overwrite"), "dst").partitionBy("type").parquet(f"{path}/edges")

    def cached(self) -> PropertyGraph:
        """Kept in memory, and on disk where that ends; lost parts are computed again from their sources."""
        level = StorageLevel.MEMORY_AND_DISK
        return PropertyGraph(self.nodes.persist(level), self.edges.persist(level))

    def staged(self) -> PropertyGraph:
        """Computed now and read from the shared folder from then on."""
        return PropertyGraph(staged(self.nodes, "nodes"), staged(self.edges, "edges"))

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def label(self, *labels: str) -> DataFrame:
        return self.nodes.where(F.col("kind_label").isin(*labels))

    def edge(self, *types: str) -> DataFrame:
        return self.edges.where(F.col("type").isin(*types))

    def with_edges(self, *more: DataFrame) -> PropertyGraph:
        """The graph with more edges: a union, to which the caller adds no edge that is there."""
        return PropertyGraph(self.nodes, reduce(DataFrame.unionByName, (self.edges, *more)))

    def with_nodes(self, *more: DataFrame) -> PropertyGraph:
        return PropertyGraph(reduce(DataFrame.unionByName, (self.nodes, *more)), self.edges)

    def below(self, repo: str) -> PropertyGraph:
        """The nodes whose file lies in a repository, and the edges among them."""
        root = repo.rstrip("/") + "/"
        nodes = self.nodes.where(F.startswith(F.coalesce("file_path", "path", F.lit("")), F.lit(root)))
        ids = nodes.select("node_id")
        edges = self.edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
        return PropertyGraph(nodes, edges.select(*EDGE_FIELDS))

    def register(self) -> None:
        """Views nodes and edges for SQL."""
        self.nodes.createOrReplaceTempView("nodes")
        self.edges.createOrReplaceTempView("edges")

    def sql(self, text: str, args: dict | None = None) -> DataFrame:
        """A reading query over the views; anything that could write is refused by its parsed plan, not by its words."""
        require_read_only(self.spark, text)
        self.register()
        return self.spark.sql(text, args=args or {})

    def collect_within(self, df: DataFrame, seconds: float = TIMEOUT_S) -> list:
        """Rows of ``df``; past the time the jobs are cancelled and TimeoutError is raised."""
        context, tag, late = self.spark.sparkContext, f"weft-{uuid.uuid4().hex}", threading.Event()

        def stop() -> None:
            late.set()
            context.cancelJobsWithTag(tag)

        timer = threading.Timer(seconds, stop)
        context.addJobTag(tag)
        timer.start()
        try:
            return df.collect()
        except Exception:
            if late.is_set():
                raise TimeoutError(f"the query took more than {seconds} s") from None
            raise
        finally:
            timer.cancel()
            context.removeJobTag(tag)


def require_read_only(spark: SparkSession, text: str) -> None:
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    java = spark.sparkContext._jvm.java.lang.Class
    logical = "org.apache.spark.sql.catalyst.plans.logical."
    while plan.getClass().getSimpleName() == "UnresolvedWith":
        plan = plan.child()
    for name in ("Command", "ParsedStatement", "UnaryParsedStatement"):
        if java.forName(logical + name).isInstance(plan):
            raise ValueError("only reading queries are allowed")


def main_label(labels: Column) -> Column:
    """The label that stands for a node."""
    return F.coalesce(*(F.when(F.array_contains(labels, x), F.lit(x)) for x in LABEL_ORDER))
