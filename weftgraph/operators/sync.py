"""Which files changed: differences of a graph against a disk, and folded version-control changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import PropertyGraph


def disk_diff(indexed: DataFrame, disk: DataFrame) -> DataFrame:
    """(path, action) by a full outer join. ``indexed``: path, last_indexed; ``disk``: path, modified (timestamps)."""
    rows = indexed.select("path", "last_indexed", F.lit(True).alias("i")).join(disk.select("path", "modified", F.lit(True).alias("d")), "path", "full_outer")
    action = (
        F.when(F.col("d").isNull(), "delete").when(F.col("i").isNull(), "reindex")
        .when(F.col("last_indexed").isNull() | (F.col("modified") > F.col("last_indexed")), "reindex").otherwise("unchanged")
    )
    return rows.select("path", action.alias("action"))


def graph_diff(g: PropertyGraph, disk: DataFrame) -> DataFrame:
    return disk_diff(g.label("File").select("path", "last_indexed"), disk)


def change_set(changes: DataFrame, extensions: tuple[str, ...] = ()) -> DataFrame:
    """(path, action, old_path) of change rows (status, old_path, new_path) of any number of lists.

    Status letters: A, M, D, R (with a score or without). A path that any list adds or modifies is reindexed even if
    another deletes it; sources of renames are not deleted on their own.
    """
    s = F.substring("status", 1, 1)
    wide = changes.select(
        F.explode(F.filter(F.array(
            F.when(s.isin("A", "M", "T", "C"), F.struct(F.col("new_path").alias("path"), F.lit("reindex").alias("action"), F.lit(None).cast("string").alias("old_path"))),
            F.when(s == "D", F.struct(F.coalesce("old_path", "new_path").alias("path"), F.lit("delete").alias("action"), F.lit(None).cast("string").alias("old_path"))),
            F.when(s == "R", F.struct(F.col("new_path").alias("path"), F.lit("rename").alias("action"), F.col("old_path").alias("old_path"))),
        ), lambda x: x.isNotNull())).alias("x")
    ).select("x.*")
    if extensions:
        wide = wide.where(F.concat(F.lit("."), F.substring_index("path", ".", -1)).isin(*extensions))
    rank = F.when(F.col("action") == "rename", 0).when(F.col("action") == "reindex", 1).otherwise(2)
    best = wide.groupBy("path").agg(F.min(F.struct(rank.alias("r"), "action", "old_path")).alias("b")).select("path", "b.action", "b.old_path")
    moved = best.where("action = 'rename'").select(F.col("old_path").alias("path")).distinct()
    return best.where("action <> 'delete'").unionByName(best.where("action = 'delete'").join(moved, "path", "left_anti"))


def sync_counts(diff: DataFrame) -> DataFrame:
    n = lambda a: F.count_if(F.col("action") == a).alias(f"n_{a}")
    return diff.agg(n("delete"), n("reindex"), n("unchanged"))


def strategy(last_commit: str | None, head: str | None, indexed_files: int) -> str:
    """'full' for what was never indexed, 'git' where both commits are known, else 'mtime'."""
    if not indexed_files:
        return "full"
    return "git" if last_commit and head else "mtime"


def stale(g: PropertyGraph, disk: DataFrame | None, stored: str | None, head: str | None, dirty: DataFrame | None = None) -> bool:
    """Whether a graph needs a sync before it is asked: its commit (``stored``) is not the disk's (``head``), or one of the
    files with uncommitted changes (``dirty``: path) was changed after it was indexed (``disk``: path, modified). A
    graph whose commit is not known is left alone."""
    if stored is None or head is None:
        return False
    if stored != head:
        return True
    if disk is None or dirty is None:
        return False
    rows = g.label("File").select("path", "last_indexed").join(disk.select("path", "modified"), "path").join(dirty.select("path"), "path", "left_semi")
    return not rows.where("last_indexed IS NULL OR modified > last_indexed").isEmpty()
