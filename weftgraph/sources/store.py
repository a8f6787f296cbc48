"""A graph as numbered versions in one folder, so that a change is a new version and a retry writes the same one.

A version is whole (``v00000007``), or holds what differs from an earlier one (``d00000007-00000006``): new and changed rows, and
those that are gone. Reading lays the differences over the whole version that they start from, of each key the newest;
what is written follows the size of a change, not that of the graph. After ``chain`` differences comes a whole version.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.graph import PropertyGraph
from weftgraph.schema import EDGE_DDL, EDGE_FIELDS, NODE_DDL, NODE_FIELDS

NODE_KEYS, EDGE_KEYS = ["node_id"], ["src", "type", "dst", "_kind"]


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_kind", F.coalesce("kind", F.lit("")))


def difference(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Rows of ``new`` that ``old`` has not, or has otherwise, and rows of ``old`` whose keys are gone (``_gone``)."""
    before, after = (_keyed(x).select(*keys, F.struct(*fields).alias(name)) for x, name in ((old, "_old"), (new, "_new")))
    both = before.join(after, keys, "full_outer").where(~F.col("_old").eqNullSafe(F.col("_new")))
    return both.select(F.coalesce("_new", "_old").alias("_row"), F.col("_new").isNull().alias("_gone")).select("_row.*", "_gone")


def overlaid(base: DataFrame, differences: list[DataFrame], keys: list[str], fields: list[str]) -> DataFrame:
    """``base`` with the differences, in their order, laid over it."""
    if not differences:
        return base.select(*fields)
    rows = reduce(DataFrame.unionByName, (_keyed(x).withColumn("_at", F.lit(k)) for k, x in enumerate(differences)))
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*fields, "_gone"), "_at").alias("_row"))
    kept = _keyed(base).join(newest.select(*keys), keys, "left_anti").select(*fields)
    return kept.unionByName(newest.select("_row.*").where("NOT _gone").select(*fields))


@dataclass
class GraphStore:
    spark: SparkSession
    root: str
    keep: int = 2  # versions that stay for readers that have begun
    chain: int = 8  # differences between two whole versions

    def _files(self):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _folders(self) -> dict[int, tuple[str, int | None]]:
        """Folder of each complete version, and the version that it differs from. Edges, written last, have Spark's mark of success."""
        fs, where = self._files()
        if not fs.exists(where):
            return {}
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        found: dict[int, tuple[str, int | None]] = {}
        for name in sorted(x.getPath().getName() for x in fs.listStatus(where)):  # a whole version comes last and wins
            number, _, since = name[1:].partition("-")
            if name[0] in "vd" and number.isdigit() and fs.exists(path(f"{self.root}/{name}/edges/_SUCCESS")):
                found[int(number)] = (name, int(since) if since else None)
        return found

    def _way(self, version: int, folders: dict[int, tuple[str, int | None]]) -> list[int] | None:
        """The whole version that ``version`` starts from, and the differences up to it; None where one is missing."""
        way, at = [], version
        while at in folders:
            way.append(at)
            if folders[at][1] is None:
                return way[::-1]
            at = folders[at][1]
        return None

    def versions(self) -> list[int]:
        """Versions that can be read."""
        folders = self._folders()
        return sorted(v for v in folders if self._way(v, folders))

    def read(self, version: int | None = None) -> PropertyGraph:
        folders, have = self._folders(), self.versions()
        if not have:
            return PropertyGraph.empty(self.spark)
        whole, *later = self._way(have[-1] if version is None else version, folders)
        base = PropertyGraph.read(self.spark, f"{self.root}/{folders[whole][0]}")
        part = lambda v, what, ddl: self.spark.read.schema(f"{ddl}, _gone boolean").parquet(f"{self.root}/{folders[v][0]}/{what}")
        nodes = overlaid(base.nodes, [part(v, "nodes", NODE_DDL) for v in later], NODE_KEYS, [*NODE_FIELDS])
        return PropertyGraph(nodes, overlaid(base.edges, [part(v, "edges", EDGE_DDL) for v in later], EDGE_KEYS, [*EDGE_FIELDS]))

    def write(self, graph: PropertyGraph, version: int, since: int | None = None) -> None:
        """``graph`` as ``version``: whole, or as what differs from the version ``since``."""
        way = None if since is None else self._way(since, self._folders())
        if way is None or len(way) > self.chain:
            graph.write(f"{self.root}/v{version:08d}")
        else:
            old, path = self.read(since), f"{self.root}/d{version:08d}-{since:08d}"
            difference(old.nodes, graph.nodes, NODE_KEYS, [*NODE_FIELDS]).write.mode("overwrite").parquet(f"{path}/nodes")
            difference(old.edges, graph.edges, EDGE_KEYS, [*EDGE_FIELDS]).write.mode("overwrite").parquet(f"{path}/edges")
        self._drop_old(version)

    def write_change(self, version: int, since: int, nodes: DataFrame, nodes_gone: DataFrame, edges: DataFrame, edges_gone: DataFrame) -> None:
        """``version`` as the version ``since`` with new and changed rows, and without others: nothing else is read, but where the chain ends."""
        path = f"{self.root}/d{version:08d}-{since:08d}"
        for rows, gone, fields, what in ((nodes, nodes_gone, NODE_FIELDS, "nodes"), (edges, edges_gone, EDGE_FIELDS, "edges")):
            both = rows.select(*fields, F.lit(False).alias("_gone")).unionByName(gone.select(*fields, F.lit(True).alias("_gone")))
            both.write.mode("overwrite").parquet(f"{path}/{what}")
        if len(self._way(version, self._folders()) or ()) > self.chain + 1:
            self.read(version).write(f"{self.root}/v{version:08d}")
        self._drop_old(version)

    def _drop_old(self, version: int) -> None:
        fs, _ = self._files()
        folders = self._folders()
        latest = [v for v in self.versions() if v <= version][-self.keep :]
        needed = {x for v in latest for x in self._way(v, folders)}
        for old_version in [v for v in folders if v <= version and v not in needed]:
            fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folders[old_version][0]}"), True)
