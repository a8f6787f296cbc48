"""HTTP routes: normal forms, and matching of clients' calls to servers' endpoints as an equi-join.

A route's shape is its segments with parameters as '{}'. A call and an endpoint match when method and shape are
equal, which says the same as comparing segment by segment (parameter with parameter, or equal literals).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Prefixes that a client may leave out, in the order in which they are tried.
PREFIXES = ("", "/api", "/api/v1", "/api/v2")


def strip_base(route: Column) -> Column:
    """Without a leading variable for the base address: '{base}/x' is '/x'."""
    return F.regexp_replace(route, r"^\{[^}]+\}/", "/")


def segments(route: Column) -> Column:
    return F.filter(F.split(route, "/"), lambda s: s != "")


def shape(route: Column) -> Column:
    return F.array_join(F.transform(segments(route), lambda s: F.when(s.rlike(r"^\{[^}]+\}$"), "{}").otherwise(s)), "/")


def normalised(class_route: Column, method_route: Column) -> Column:
    """Class and method parts joined; '~' overrides the class part; constraints '{x:int}' lose theirs; one slash between segments."""
    own = F.startswith(method_route, F.lit("~"))
    joined = F.when(own, F.substring(method_route, 2, 1 << 20)).otherwise(F.concat_ws("/", F.lit(""), class_route, method_route))
    plain = F.regexp_replace(joined, r"\{([^}:]+):[^}]*\}", "{$1}")
    out = F.regexp_replace(F.concat(F.lit("/"), plain), "/+", "/")
    return F.when(F.length(out) > 1, F.regexp_replace(out, "/$", "")).otherwise(out)


def flask_params(route: Column) -> Column:
    return F.regexp_replace(route, r"<(?:[^:<>]+:)?([^<>]+)>", "{$1}")


def express_params(route: Column) -> Column:
    return F.regexp_replace(route, r":([A-Za-z_][A-Za-z0-9_]*)", "{$1}")


def match_calls(definitions: DataFrame, calls: DataFrame) -> DataFrame:
    """Every call with the endpoint it is taken to reach: (call columns, ep_route, matched, handler, def_ord).

    ``definitions``: route, http_method, handler, def_ord (unique). ``calls``: route, http_method, caller, line,
    col, call_ord (unique). A call tries its route with each prefix in order, and takes the first definition that
    fits; a call that fits none is an endpoint of its own, under its raw route.
    """
    first = Window.partitionBy("http_method", "_shape").orderBy("def_ord")
    defs = definitions.withColumn("_shape", shape(F.col("route"))).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    defs = defs.select("http_method", "_shape", F.col("route").alias("ep_route"), "handler", "def_ord")
    tried = F.posexplode(F.array(*(F.concat(F.lit(p), strip_base(F.col("route"))) for p in PREFIXES))).alias("_try", "_route")
    wide = calls.select("*", tried).withColumn("_shape", shape(F.col("_route")))
    hits = wide.join(defs, ["http_method", "_shape"]).groupBy("call_ord").agg(F.min_by(F.struct("ep_route", "handler", "def_ord"), "_try").alias("hit"))
    out = calls.join(hits, "call_ord", "left")
    return out.select(*calls.columns, F.coalesce("hit.ep_route", "route").alias("ep_route"), F.col("hit").isNotNull().alias("matched"), "hit.handler", "hit.def_ord")


def conflicts(definitions: DataFrame) -> DataFrame:
    """(http_method, route, n) of routes that more than one definition serves."""
    return definitions.groupBy("http_method", "route").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
