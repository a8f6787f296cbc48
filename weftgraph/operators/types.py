"""Types of locals, parameters, fields and results, as a system of constraints that spreads to a fixpoint.

Everything that can have a type is a key: a chain of names and calls in the method that it stands in ('E|method|a.b()'), a
variable ('V|method|name'), a field ('F|class.name') and a result ('R|method'). Declarations and constructors give keys
their first types. A constraint (source, target) says that the target has every type of the source: what is assigned,
handed on or returned. Which field or method 'a.b' means hangs on the types of 'a', so these constraints come as types
are found: a key's new type leads, by the members of that type and of what it inherits from, to new constraints.

Each round takes only what is new (types, and constraints that they lead to), and the rounds end when nothing is: there
are finitely many keys and types. Rounds follow the longest chain of assignments and calls, not the size of the source. All
steps are equi-joins on keys; only members that some chain names are looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import PropertyGraph
from weftgraph.operators import resolve
from weftgraph.plans.staging import staged, unstaged

SELF = ("self", "this", "cls")


def _key(kind: str, *parts: str | Column) -> Column:
    return F.concat_ws("|", F.lit(kind), *parts)


def _union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def plain(chain: Column) -> Column:
    """A chain with one name for the object that a method belongs to."""
    return F.regexp_replace(chain, r"^(self|cls)\b", "this")


def chains(rows: DataFrame) -> DataFrame:
    """Distinct (file_path, scope, chain) of ``rows`` with all chains that they begin with: 'a.b()' also gives 'a.b' and 'a'."""
    parts = F.split("chain", r"\.")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))
    every = F.flatten(F.transform(heads, lambda h: F.array(h, F.regexp_replace(h, r"\(\)$", ""))))
    return rows.select("file_path", "scope", F.explode(F.array_distinct(every)).alias("chain")).where("chain NOT LIKE '%?%' AND chain <> ''").distinct()


def scopes(staging: DataFrame) -> DataFrame:
    """Distinct (scope): callers, and what gives values to names."""
    rows = staging.where("what = 'call' AND name IS NOT NULL OR what = 'binding' AND kind = 'value'")
    return rows.select(F.col("full_name").alias("scope")).distinct()


def receiver_types(g: PropertyGraph, staging: DataFrame, imported: DataFrame, language: str, root: str) -> DataFrame:
    """(file_path, caller, chain, type): the types of what calls are made on, 'r' of 'r.save()' as well as 'mk()' of 'mk().save()'.

    ``g`` needs its base types. ``this`` stands for self and cls.
    """
    return receivers(g, staging, imported, language, root)[0]


def receivers(g: PropertyGraph, staging: DataFrame, imported: DataFrame, language: str, root: str, up: DataFrame | None = None, also: DataFrame | None = None,
              owners: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """receiver_types(), and resolve.type_targets() of what it asks for and of ``also`` (file_path, full_name, target): names are looked up once for
    all that need them. ``up`` is resolve.inherited() of ``g``, and ``owners`` resolve.owners() of scopes(), staged, where those are made already.

    Only what some chain asks for is given types: variables that it names, and fields and results whose names are members in it.
    """
    script = language in ("python", "typescript")
    full_types = resolve.types_of(g)
    up = staged(resolve.inherited(g), "type-ancestors") if up is None else up
    owners = staged(resolve.owners(scopes(staging), g), "scope-owners") if owners is None else owners
    owners = owners.select("scope", F.col("owner").alias("around"), "type")
    calls = staging.where("what = 'call' AND name IS NOT NULL AND target LIKE '%.%'")
    on = calls.select("file_path", F.col("full_name").alias("scope"), plain(F.substr("target", F.lit(1), F.length("target") - F.length("name") - 1)).alias("chain"))
    bound = staging.where("what = 'binding'").select("file_path", F.col("full_name").alias("scope"), plain(F.col("name")).alias("name"), "kind", "target")
    bound = bound.withColumn("target", F.when(F.col("kind") == "value", plain(F.col("target"))).otherwise(F.col("target")))
    values = bound.where("kind = 'value'")
    exprs = staged(chains(_union(on, values.select("file_path", "scope", F.col("target").alias("chain")))), "chains")
    expr = _key("E", "scope", "chain")

    # Variables: of the scope itself, else of the functions around it.
    is_name = ~F.col("chain").contains(".") & ~F.col("chain").contains("(") & ~F.col("chain").isin("this", "super") & ~F.startswith("chain", F.lit("new "))
    names = exprs.where(is_name)
    around = F.explode(resolve.prefixes(F.col("scope")) if script else F.array("scope"))
    looked = names.select("file_path", "scope", "chain", around.alias("holder"))
    asked = looked.select(F.col("holder").alias("scope"), F.col("chain").alias("name")).distinct()
    asked = staged(asked, "asked-variables")
    variables = bound.where("name NOT LIKE '%.%' AND name <> '()'").join(asked.select("name").distinct(), "name", "left_semi")  # most parameters are no receivers
    variables = staged(variables.join(asked, ["scope", "name"], "left_semi"), "bound-variables")
    held = variables.select(F.col("scope").alias("holder"), F.col("name").alias("chain")).distinct()
    if script:
        lead = looked.join(held, ["holder", "chain"]).groupBy("file_path", "scope", "chain").agg(F.max_by("holder", F.length("holder")).alias("holder"))
        lead = staged(lead, "variables")
        free = names.join(lead.select("file_path", "scope", "chain"), ["file_path", "scope", "chain"], "left_anti")
    else:
        found = staged(looked.join(held.withColumn("found", F.lit(True)), ["holder", "chain"], "left").select("file_path", "scope", "chain", "holder", "found"), "variables")
        lead, free = found.where("found").drop("found"), found.where("found IS NULL").drop("holder", "found")

    # Members: 'a.b' and 'a.b()' hang on 'a'; in languages without a receiver for one's own, so do 'b' and 'b()' on 'this'.
    called = exprs.where(F.col("chain").rlike(r"^\w+\(\)$")).withColumn("member", F.regexp_replace("chain", r"\(\)$", ""))
    parts = exprs.where("chain LIKE '%.%'").withColumn("last", F.substring_index("chain", ".", -1))
    base = F.substr("chain", F.lit(1), F.length("chain") - F.length("last") - 1)
    members = parts.select(_key("E", "scope", base).alias("key"), expr.alias("target"), "last")
    mine = _union(free, called.select(free.columns)) if not script else None
    if mine is not None:
        members = members.unionByName(mine.select(_key("E", "scope", F.lit("this")).alias("key"), expr.alias("target"), F.col("chain").alias("last")))
    members = staged(members, "members-of-chains")
    wanted = staged(members.select("last").distinct(), "wanted-members")

    # First types: declared ones, those that are constructed, and classes that are named as such.
    by_last = lambda rows, name: rows.withColumn("last", name).join(wanted, "last", "left_semi").drop("last")
    fields = staging.where("what = 'symbol' AND kind IN ('field', 'property') AND coalesce(type_name, '') <> ''").select("file_path", F.col("parent").alias("full_name"), F.col("type_name").alias("target"), _key("F", F.concat_ws(".", "parent", "name")).alias("key"))
    made = staging.where("what = 'assignment'").select("file_path", "full_name", "target", _key("F", F.concat_ws(".", "full_name", "name")).alias("key"))
    fields, made = (by_last(x, F.substring_index("key", ".", -1)) for x in (fields, made))
    results = bound.where("name = '()'")
    if not script:  # a result is a member's; functions that are called by their names alone are found under other names as well
        results = by_last(results, F.concat(F.substring_index(resolve.bare(F.col("scope")), ".", -1), F.lit("()")))
    variable, result = _key("V", "scope", "name"), _key("R", "scope")
    declared = _union(*(x.where("kind = 'type'").select("file_path", F.col("scope").alias("full_name"), "target", k.alias("key")) for x, k in ((variables, variable), (results, result))))
    built = exprs.where("chain LIKE 'new %()'" if not script else "chain LIKE '%()'")
    built = built.select("file_path", F.col("scope").alias("full_name"), F.regexp_replace("chain", r"^new |\(\)$", "").alias("target"), expr.alias("key"))
    if language == "typescript":
        built = built.where("key LIKE '%|new %'")
    statics = free.select("file_path", F.col("scope").alias("full_name"), F.col("chain").alias("target"), expr.alias("key"))
    said = staged(_union(fields, made, declared, built, statics), "first-types")
    asked = said.select("file_path", "full_name", "target")
    named = staged(resolve.type_targets(g, asked if also is None else asked.unionByName(also), imported, language, root).where("dst IS NOT NULL"), "named-types")
    first = said.join(named, ["file_path", "full_name", "target"]).select("key", F.col("dst").alias("type"))
    own = exprs.where("chain IN ('this', 'super', 'super()')").join(owners, "scope").select(expr.alias("key"), "type")
    facts = [first, own]
    if mine is not None:
        facts.append(mine.select("scope").distinct().join(owners, "scope").select(_key("E", "scope", F.lit("this")).alias("key"), "type"))
    facts = staged(_union(*facts), "key-types")  # these and the constraints may repeat: what is found of them is made distinct

    # Constraints that are known from the start: variables, values, and functions that are called by their names alone.
    value = _key("E", "scope", "target").alias("source")
    assigned = [x.where("kind = 'value'").select(value, k.alias("target")) for x, k in ((variables, variable), (results, result))]
    into_fields = values.where("name LIKE 'this.%' AND name NOT LIKE 'this.%.%'").join(owners, "scope").select(value, _key("F", F.concat_ws(".", "around", F.substring("name", 6, 1 << 20))).alias("target"))
    into_fields = staged(by_last(into_fields, F.substring_index("target", ".", -1)), "values-of-fields")
    read = lead.select(_key("V", "holder", "chain").alias("source"), expr.alias("target"))
    methods = g.label("Method").select("full_name", resolve.bare(F.col("full_name")).alias("bare"), resolve.bare(F.col("name")).alias("member"))
    known = [*assigned, into_fields, read]
    if script:
        tried = called.select("scope", "chain", "member", F.explode(resolve.prefixes(F.col("scope"))).alias("p"))
        tried = tried.join(full_types.select(F.col("full").alias("p")), "p", "left_anti").withColumn("bare", F.concat("p", F.lit("."), "member")).join(methods.select("bare", "full_name"), "bare")
        near = tried.groupBy("scope", "chain").agg(F.max_by("full_name", F.length("p")).alias("full_name"))
        stands = imported.where("label <> 'Package'").select("file_path", F.col("name").alias("member"), F.col("full").alias("bare"))
        brought = called.join(stands, ["file_path", "member"]).join(methods.select("bare", "full_name"), "bare").select("scope", "chain", "full_name")
        known += [x.select(_key("R", "full_name").alias("source"), expr.alias("target")) for x in (near, brought)]
    constraints = staged(_union(*known), "constraints")

    # What types have under the names that are asked for: of their own, by full names; where not, of the nearest types that they inherit from.
    has_fields = _union(fields.select("key"), made.select("key"), into_fields.select(F.col("target").alias("key"))).distinct().withColumn("path", F.substring("key", 3, 1 << 20))
    last = F.substring_index("path", ".", -1)
    has_fields = has_fields.select(F.substr("path", F.lit(1), F.length("path") - F.length(last) - 1).alias("full"), last.alias("last"), F.col("key").alias("source"))
    has_methods = methods.withColumn("last", F.concat("member", F.lit("()"))).join(wanted, "last", "left_semi")
    has_methods = has_methods.select(F.substr("bare", F.lit(1), F.length("bare") - F.length("member") - 1).alias("full"), "last", _key("R", "full_name").alias("source"))
    has = staged(_union(has_fields, has_methods), "members-of-types")
    above = up.select("type", resolve.type_of_id(F.col("type")).alias("below"), resolve.type_of_id(F.col("ancestor")).alias("full"), "depth").join(has, "full")
    above = staged(above.select("type", "below", "last", "depth", "source"), "members-above")
    above = above.join(has.select(F.col("full").alias("below"), "last"), ["below", "last"], "left_anti")
    nearest = above.groupBy("type", "last").agg(F.min("depth").alias("depth"))
    lent = staged(above.join(nearest, ["type", "last", "depth"]).select("type", "last", "source").distinct(), "members-inherited")

    new = facts
    while True:
        at = new.join(members, "key").select("type", "last", "target")
        through = at.withColumn("full", resolve.type_of_id(F.col("type"))).join(has, ["full", "last"]).select("source", "target").unionByName(at.join(lent, ["type", "last"]).select("source", "target"))
        through = staged(through.distinct().join(constraints, ["source", "target"], "left_anti"), "found-constraints")
        by = lambda rows, links: rows.join(links.select(F.col("source").alias("key"), "target"), "key").select(F.col("target").alias("key"), "type")
        more = _union(by(new, constraints), by(facts, through)).distinct().join(facts, ["key", "type"], "left_anti")
        more = staged(more, "more-types")
        if more.isEmpty():
            break
        old = facts, constraints
        facts, constraints = staged(facts.unionByName(more), "key-types"), staged(constraints.unionByName(through), "constraints")
        unstaged(*old, through)
        new = more
    found = on.withColumn("key", expr).join(facts, "key").select("file_path", F.col("scope").alias("caller"), "chain", "type")
    return found.repartition("file_path", "caller", "chain").distinct(), named  # dealt as those who join them need it
