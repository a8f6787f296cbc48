"""Interval labels of the containment forest: what lies below a node is one range of numbers.

Each node gets its number in a walk of the forest (``first``) and the last number below it (``last``), so b lies in a just
when a.first < b.first <= a.last. Deletes, status counts and summaries then filter by a range, without a loop over levels;
tables written in the order of ``first`` let readers skip all else.

Labels are made by pointer doubling, in log2(depth) rounds of equi-joins: first the sizes of all subtrees (a node adds
up what is less than 2^k below it, and points 2^k up), then each node's distance in the walk from its parent (one, and
the sizes of the siblings before it), then the sum of these distances up to the root in the same way. Running sums over
siblings go by ranges of (parent, node), so a folder may hold any number of entries.

A node that several contain (a type lies in its file and in its package) is below the one that is no package, then the least.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.graph import PropertyGraph
from weftgraph.plans.staging import staged, unstaged

FEW = 64  # ranges that a filter may hold


def forest(g: PropertyGraph) -> DataFrame:
    """(node, parent): every node, with null for the parent of a root."""
    package = F.startswith("src", F.lit("Package:"))
    up = g.edge("CONTAINS").where("src <> dst").groupBy(F.col("dst").alias("node")).agg(F.min_by("src", F.struct(package, "src")).alias("parent"))
    return g.nodes.select(F.col("node_id").alias("node")).join(up, "node", "left")


def _before(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` over earlier rows of the same ``by``, in ranges, so that no group is gathered."""
    placed = rows.repartitionByRange(F.col(by), F.col(order)).sortWithinPartitions(by, order).withColumn("_at", F.monotonically_increasing_id())
    placed = staged(placed.withColumn("_part", F.shiftright("_at", 33)), "placed")
    sums = placed.groupBy(by, "_part").agg(F.sum(value).alias("_sum"))
    earlier = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = sums.select(by, "_part", earlier(Window.partitionBy(by).orderBy("_part"), "_sum").alias("_carried"))  # a row for each partition that a group reaches into
    within = placed.withColumn("_within", earlier(Window.partitionBy("_part", by).orderBy("_at"), value))
    return within.join(carried, [by, "_part"]).withColumn("before", F.col("_within") + F.col("_carried")).drop("_at", "_part", "_within", "_carried")


def labels(g: PropertyGraph) -> DataFrame:
    """(node_id, parent, depth, first, last) of every node, staged. The CONTAINS edges must be free of cycles."""
    nodes = g.nodes.count()
    rows = staged(forest(g).select("node", "parent", F.col("parent").alias("up"), F.lit(1).cast("bigint").alias("size"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth")), "subtrees")
    for _ in range(nodes.bit_length() + 1):
        if rows.where("up IS NOT NULL").isEmpty():
            break
        given = rows.where("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(F.sum("size").alias("more"))
        above = rows.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("higher"))
        grown = rows.join(given, "node", "left").join(above, "up", "left")
        new = staged(grown.select("node", "parent", F.col("next").alias("up"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"), (F.col("depth") + F.coalesce("higher", F.lit(0))).alias("depth")), "subtrees")
        unstaged(rows)
        rows = new
    else:
        raise ValueError("the CONTAINS edges have a cycle")
    held = _before(rows.select("node", "parent", "size", "depth", F.coalesce("parent", F.lit("")).alias("_group")), "_group", "node", "size")
    at = F.col("before") + F.when(F.col("parent").isNull(), 0).otherwise(1)
    walk = staged(held.select("node", "parent", "size", "depth", F.col("parent").alias("up"), at.alias("first")), "walk")
    unstaged(rows)
    while not walk.where("up IS NOT NULL").isEmpty():
        above = walk.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("first").alias("more"))
        new = walk.join(above, "up", "left")
        new = staged(new.select("node", "parent", "size", "depth", F.col("next").alias("up"), (F.col("first") + F.coalesce("more", F.lit(0))).alias("first")), "walk")
        unstaged(walk)
        walk = new
    return walk.select(F.col("node").alias("node_id"), "parent", "depth", "first", (F.col("first") + F.col("size") - 1).alias("last"))


def write_labels(rows: DataFrame, path: str) -> DataFrame:
    """Labels as Parquet in the order of the walk, read back: a range of numbers is a few row groups."""
    rows.repartitionByRange("first").sortWithinPartitions("first").write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def inside(rows: DataFrame, tops: DataFrame, itself: bool = True) -> DataFrame:
    """(node_id) of the labels ``rows`` that lie below any of ``tops`` (node_id), and with ``itself`` these too.

    Few tops are ranges in a filter, which readers understand. More are met in the order of the walk: a node lies in
    one of those that start before it when the largest of their ends is no less than its number.
    """
    ends = rows.join(tops.select("node_id").distinct(), "node_id", "left_semi").select("first", "last")
    few = ends.limit(FEW + 1).collect()
    low = F.lit(0 if itself else 1)
    if len(few) <= FEW:
        if not few:
            return rows.select("node_id").limit(0)
        within = [F.col("first").between(F.lit(r[0]) + low, F.lit(r[1])) for r in few]
        return rows.where(reduce(Column.__or__, within)).select("node_id")
    starts = ends.select("first", F.lit(None).cast("string").alias("node_id"), "last", F.lit(0 if itself else 1).alias("kind"))
    both = rows.select("first", "node_id", F.lit(None).cast("bigint").alias("last"), F.lit(1 - (0 if itself else 1)).alias("kind")).unionByName(starts)
    placed = both.repartitionByRange("first", "kind").sortWithinPartitions("first", "kind").withColumn("_at", F.monotonically_increasing_id())
    placed = staged(placed.withColumn("_part", F.shiftright("_at", 33)), "placed")
    most = placed.groupBy("_part").agg(F.max("last").alias("_most"))  # a row a partition
    carried = most.select("_part", F.max("_most").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    so_far = F.max("last").over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    known = placed.withColumn("_end", so_far).join(F.broadcast(carried), "_part").withColumn("_end", F.greatest("_end", "_carried"))
    return known.where("node_id IS NOT NULL AND _end >= first").select("node_id")
