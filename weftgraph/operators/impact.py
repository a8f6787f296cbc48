"""What a change touches: callers, tests, callees, and references to types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.predicates import is_test
from weftgraph.graph import PropertyGraph
from weftgraph.operators.lookup import callees
from weftgraph.plans.expand import spread


def targets(g: PropertyGraph, method: str) -> DataFrame:
    """A method and the interface methods that it implements."""
    own = g.label("Method").where(F.col("full_name") == method).select(F.col("node_id").alias("node"))
    up = g.edge("IMPLEMENTS").join(own.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node"))
    return own.unionByName(up).distinct()


def change_impact(g: PropertyGraph, method: str) -> DataFrame:
    """(role, full_name, file_path): direct callers, transitive callers (2 to 4 hops), tests (1 to 4 hops) and callees."""
    goal = targets(g, method)
    back = spread(g.edge("CALLS"), goal, 4, reverse=True).withColumnRenamed("depth", "least")
    m = g.label("Method").select(F.col("node_id").alias("node"), "full_name", "file_path")
    rows = back.join(m, "node")
    test = F.coalesce(is_test(F.col("file_path")), F.lit(False))
    other = F.col("full_name") != method
    direct = rows.where((F.col("least") == 1) & ~test).select(F.lit("direct").alias("role"), "full_name", "file_path")
    near = rows.where("least = 1").select("full_name")
    far = rows.where((F.col("least") >= 2) & ~test & other).join(near, "full_name", "left_anti").select(F.lit("transitive").alias("role"), "full_name", "file_path")
    tests = rows.where(test).select(F.lit("test").alias("role"), "full_name", "file_path")
    down = callees(g, method, dispatch=False).select(F.lit("callee").alias("role"), "full_name", "file_path")
    return direct.unionByName(far).unionByName(tests).unionByName(down).distinct()


def impact_totals(impact: DataFrame) -> DataFrame:
    """Counts by role, and of all names that are affected."""
    count = lambda role: F.count_distinct(F.when(F.col("role") == role, F.col("full_name"))).alias(f"n_{role}")
    affected = F.count_distinct(F.when(F.col("role") != "callee", F.col("full_name"))).alias("n_affected")
    return impact.agg(count("direct"), count("transitive"), count("test"), count("callee"), affected)


def test_coverage(g: PropertyGraph, method: str) -> DataFrame:
    """Test methods that call a method, or an interface method that it implements, within four hops."""
    back = spread(g.edge("CALLS"), targets(g, method), 4, reverse=True).select(F.col("node").alias("node_id"))
    return g.label("Method").where(is_test(F.col("file_path"))).join(back, "node_id", "left_semi").select("full_name", "file_path")


def type_impact(g: PropertyGraph, type_name: str) -> DataFrame:
    """References to a type and to the interfaces it implements, each as prod or test."""
    own = g.nodes.where(F.col("full_name") == type_name).select(F.col("node_id").alias("dst"))
    ifcs = g.label("Interface").select(F.col("node_id").alias("dst"))
    up = g.edge("IMPLEMENTS").join(own.withColumnRenamed("dst", "src"), "src", "left_semi").select("dst").join(ifcs, "dst", "left_semi")
    refs = g.edge("REFERENCES").select("src", "dst", F.col("kind").alias("ref_kind")).join(own.unionByName(up).distinct(), "dst", "left_semi")
    names = g.nodes.where("full_name IS NOT NULL").select(F.col("node_id").alias("src"), "full_name", "file_path")
    context: Column = F.when(is_test(F.col("file_path")), "test").otherwise("prod")
    return refs.join(names, "src").select("full_name", "file_path", "ref_kind", context.alias("context"))


def layering_violations(g: PropertyGraph, layer: str = "Controllers", forbidden: str = "DbContext") -> DataFrame:
    """Methods of classes of one layer that call what belongs to another layer."""
    cls = g.label("Class").where(F.contains("file_path", F.lit(layer))).select(F.col("node_id").alias("src"), F.col("full_name").alias("controller"))
    held = g.edge("CONTAINS").select("src", F.col("dst").alias("m")).join(cls, "src").select("m", "controller")
    m = g.label("Method").select(F.col("node_id").alias("m"), F.col("full_name").alias("method"))
    bad = g.label("Method").where(F.contains("full_name", F.lit(forbidden))).select(F.col("node_id").alias("dst"), F.col("full_name").alias("callee"))
    return g.edge("CALLS").select(F.col("src").alias("m"), "dst").join(bad, "dst").join(held, "m").join(m, "m").select("controller", "method", "callee")


def untested_services(g: PropertyGraph, layer: str = "/Services/") -> DataFrame:
    """Classes of a layer that implement something and that no test reaches within three calls."""
    said = g.edge("IMPLEMENTS").select(F.col("src").alias("node_id"))
    cls = g.label("Class").where(F.contains("file_path", F.lit(layer))).join(said, "node_id", "left_semi")
    starts = g.label("Method").where(is_test(F.col("file_path"))).select(F.col("node_id").alias("node"))
    hit = spread(g.edge("CALLS"), starts, 3).select(F.col("node").alias("dst"))
    tested = g.edge("CONTAINS").join(hit, "dst", "left_semi").select(F.col("src").alias("node_id"))
    return cls.join(tested, "node_id", "left_anti").select("full_name", "name", "file_path")
