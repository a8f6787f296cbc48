"""Debounced file events applied to a stored graph, a version per micro-batch.

``Upkeep`` keeps facts and what follows from them side by side, and a batch makes, reads by key and writes what its files touch
(operators/upkeep.py). ``applier`` replaces files in a graph that is whole, and derives HTTP edges and TESTS of all of it anew.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import PropertyGraph
from weftgraph.operators import derive, dml, upkeep
from weftgraph.schema import EDGE_FIELDS
from weftgraph.sources.store import GraphStore


def applier(store: GraphStore, parse: Callable[[DataFrame], PropertyGraph], rebuild: Callable[[PropertyGraph], PropertyGraph] | None = derive.after_sync) -> Callable[[DataFrame, int], None]:
    """A function for debounce.run(). ``parse`` makes a graph of changed paths; ``rebuild`` derives edges anew, by default
    HTTP matches and TESTS.

    Batch n writes version n + 2, as what differs from the last one below it, so a batch that is run again gives the same
    version.
    """

    def apply(changes: DataFrame, batch: int) -> None:
        target = batch + 2  # version 1 is the graph that the stream starts from
        have = [v for v in store.versions() if v < target]
        base = store.read(have[-1]) if have else PropertyGraph.empty(store.spark)
        changes = changes.persist()
        try:
            if changes.isEmpty():
                return
            last = changes.groupBy("path").agg({"ts": "max"}).withColumnRenamed("max(ts)", "ts")
            now = changes.join(last, ["path", "ts"]).select("path", "event").distinct()
            gone = now.where("event = 'delete'").select("path")
            fresh = now.where("event <> 'delete'").select("path").distinct()
            left = dml.delete_files(base, gone).staged()
            out = dml.replace_files(left, fresh, parse(fresh).staged()).staged()
            store.write(rebuild(out) if rebuild else out, target, since=have[-1] if have else None)
        finally:
            changes.unpersist()

    return apply


def _last_events(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changed, gone) paths by the last event of each."""
    now = changes.groupBy("path").agg(F.max(F.struct("ts", "event")).alias("last")).select("path", "last.event")
    return now.where("event <> 'delete'").select("path"), now.where("event = 'delete'").select("path")


@dataclass
class Upkeep:
    """Two stores: ``facts`` as parsers give them, and ``derived`` edges, whose kind there is the rule that made them.

    Both have the same versions. A batch writes the facts first, and counts once the derived edges are written too; run
    again it starts from the last version below its own that both have, so it writes the same.
    """

    facts: GraphStore
    derived: GraphStore

    def start(self, graph: PropertyGraph, version: int = 1) -> None:
        self.facts.write(graph, version)
        rows = upkeep.derived(graph).withColumn("kind", F.col("rule")).select(*EDGE_FIELDS)
        self.derived.write(PropertyGraph(graph.nodes.limit(0), rows), version)

    def versions(self) -> list[int]:
        have = set(self.derived.versions())
        return [v for v in self.facts.versions() if v in have]

    def rules(self, version: int) -> DataFrame:
        """(rule, edge) of a version."""
        edges = self.derived.read(version).edges
        return edges.withColumn("rule", F.col("kind")).withColumn("kind", F.lit(None).cast("string")).select("rule", *EDGE_FIELDS)

    def read(self, version: int | None = None) -> PropertyGraph:
        """The whole graph of a version."""
        at = self.versions()[-1] if version is None else version
        return upkeep.combined(self.facts.read(at), self.rules(at))

    def apply(self, parse: Callable[[DataFrame], PropertyGraph]) -> Callable[[DataFrame, int], None]:
        """A function for debounce.run(): batch n makes version n + 2. ``parse`` makes a graph of changed paths."""

        def run(changes: DataFrame, batch: int) -> None:
            target = batch + 2  # version 1 is the graph that the stream starts from
            have = [v for v in self.versions() if v < target]
            if not have:
                raise ValueError("start() has not been called")
            changes = changes.persist()
            try:
                if changes.isEmpty():
                    return
                changed, gone = _last_events(changes)
                base = self.facts.read(have[-1])
                change = upkeep.files_change(base, changed, gone, parse(changed).staged())
                came, went = upkeep.derived_change(base, change, self.rules(have[-1]))
                self.facts.write_change(target, have[-1], change.nodes, change.nodes_gone, change.edges, change.edges_gone)
                as_edges = lambda rows: rows.withColumn("kind", F.col("rule")).select(*EDGE_FIELDS)
                nothing = base.nodes.limit(0)
                self.derived.write_change(target, have[-1], nothing, nothing, as_edges(came), as_edges(went))
            finally:
                changes.unpersist()

        return run
