"""What names in source files mean: the type or method that a name stands for at its place.

A name gives full names that it could stand for, by the rules of scopes and imports, each with a rank; one equi-join
with the symbols finds those that exist, and the lowest rank counts. So a simple name that a thousand namespaces have is
never joined with all of them. Where the lowest rank names several symbols, nothing is chosen.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.predicates import simple_name
from weftgraph.graph import PropertyGraph
from weftgraph.plans.expand import reach
from weftgraph.plans.staging import staged
from weftgraph.schema import edge_columns, node_columns, node_id

EXACT, IMPORTED, SCOPE, SAME_FILE, PACKAGE, UNIQUE = range(6)  # ranks of a type's name
DEFINED, OWN, INFERRED, TYPED, ASSIGNED, STATIC, NEAR, FROM_IMPORT, ONLY = range(9)  # ranks of a call
SELVES = ("self", "this", "cls", "base", "super", "super()")
LEAST_RANK_STEP = 1000  # ranks of one kind are told apart by distance below this

# Types of frameworks whose methods count as called, by the type of the field that is their receiver.
EXTERNAL_METHODS = {
    "RestTemplate": ("exchange", "getForObject", "getForEntity", "postForObject", "postForEntity", "put", "delete", "patchForObject", "execute", "headForHeaders", "optionsForAllow"),
    "MongoTemplate": ("save", "insert", "find", "findById", "findOne", "findAll", "count", "remove", "update", "updateFirst", "updateMulti", "upsert", "exists", "aggregate", "query"),
    "JdbcTemplate": ("query", "queryForObject", "queryForList", "queryForMap", "queryForRowSet", "update", "batchUpdate", "execute"),
    "KafkaTemplate": ("send", "sendDefault", "flush", "executeInTransaction"),
    "RabbitTemplate": ("send", "convertAndSend", "convertSendAndReceive", "receiveAndConvert", "receive", "execute", "invoke"),
    "ObjectMapper": ("writeValueAsString", "writeValueAsBytes", "readValue", "readTree", "convertValue", "treeToValue", "valueToTree"),
    "WebClient": ("get", "post", "put", "delete", "patch", "head", "options", "method", "mutate", "build"),
    "DiscoveryClient": ("getInstances", "getServices", "description"),
}


def bare(name: Column) -> Column:
    """Without parameters, type arguments, array and null signs."""
    return F.regexp_replace(name, r"[<(\[?].*$", "")


def prefixes(dotted: Column) -> Column:
    """'a.b.c' gives ['a', 'a.b', 'a.b.c']."""
    parts = F.split(dotted, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))


def module_of(file_path: Column, root: str) -> Column:
    """The file's path below the root without its ending, with dots."""
    below = F.substring(file_path, len(root.rstrip("/")) + 2, 1 << 20)
    return F.translate(F.regexp_replace(below, r"\.\w+$", ""), "/", ".")


def types_of(g: PropertyGraph) -> DataFrame:
    """(full, dst, b, type_file, type_name): classes and interfaces, but no modules."""
    rows = g.label("Class", "Interface").where("kind IS NULL OR kind <> 'module'")
    return rows.select(F.col("full_name").alias("full"), F.col("node_id").alias("dst"), F.col("kind_label").alias("b"), F.col("file_path").alias("type_file"), bare(F.col("name")).alias("type_name"))


def type_of_id(node: Column) -> Column:
    """The full name of a type by its node_id."""
    return F.substr(node, F.instr(node, ":") + 1)


def last_names(g: PropertyGraph) -> DataFrame:
    """(last, type_name, n): what full names of types end with, and how many types are so called; staged, as a few names are broadcast."""
    return staged(types_of(g).groupBy(simple_name(F.col("full")).alias("last"), "type_name").agg(F.count(F.lit(1)).alias("n")), "names-of-types")


def _without(rows: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    other = found.select(*(F.col(k).alias(f"_{k}") for k in key))
    return rows.join(other, reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key)), "left_anti")


def type_targets(g: PropertyGraph, rows: DataFrame, imported: DataFrame, language: str, root: str) -> DataFrame:
    """(file_path, full_name, target, dst, b, known) of distinct names (file_path, full_name, target) that symbols full_name use.

    ``imported`` (file_path, name, full, label): what names stand for in a file. ``known``: some type has that name, even
    where dst is null because it cannot be told which.

    Only names that some type's full name ends with are tried in scopes, and only what is found in none (EXACT to SCOPE) is looked for
    in its file, in packages and among all types.
    """
    key = ["file_path", "full_name", "target"]
    rows = staged(rows.select(*key).distinct().withColumn("clean", bare(F.col("target"))).withColumn("simple", simple_name(F.col("clean"))), "type-names")
    types, lasts = types_of(g), last_names(g)
    likely = rows.join(lasts.select(F.explode(F.array("last", "type_name")).alias("simple")).distinct(), "simple", "left_semi")
    scope = prefixes(bare(F.col("full_name")))
    if language in ("python", "typescript"):  # a module does not see what packages above it declare
        scope = F.filter(scope, lambda p: F.length(p) >= F.length(module_of(F.col("file_path"), root)))
    rank = lambda r, near=0: (F.lit(r).alias("rank"), (F.lit(near) if isinstance(near, int) else near).alias("near"))
    exact = likely.where(F.contains("clean", F.lit("."))).select(*key, *rank(EXACT), F.col("clean").alias("full"))
    scoped = likely.select(*key, "clean", F.explode(scope).alias("p")).select(*key, F.length("p").alias("n"), F.concat("p", F.lit("."), "clean").alias("full"))
    names = imported.where("label <> 'Package'").select("file_path", F.col("name").alias("p"), F.col("full").alias("stands"))
    lead = rows.select(*key, "clean", F.explode(prefixes(F.col("clean"))).alias("p")).join(names, ["file_path", "p"])
    by_name = lead.select(*key, *rank(IMPORTED, -F.length("p")), F.concat("stands", F.substr("clean", F.length("p") + 1)).alias("full"))
    first = exact.unionByName(by_name).join(types.select("full", "dst", "b"), "full").select(*key, "rank", "near", "dst", "b")
    first = staged(_lowest(first, key), "names-told")
    # Of scopes the longest prefix counts, which its length tells; numbers are aggregated without a sort.
    scoped = scoped.join(types.select("full", F.col("b").alias("label")), "full")
    longest = scoped.groupBy(*key).agg(*(F.max(F.when(F.col("label") == x, F.col("n"))).alias(x) for x in ("Class", "Interface")))
    n = F.greatest("Class", "Interface")
    label = F.when(F.col("Class").eqNullSafe(F.col("Interface")), None).when(F.col("Class") == n, "Class").otherwise("Interface")  # null where it is both
    within = longest.withColumn("b", label).select(*key, F.concat("b", F.lit(":"), F.substr(bare(F.col("full_name")), F.lit(1), n), F.lit("."), bare(F.col("target"))).alias("dst"), "b")
    first = staged(first.unionByName(_without(within, first, key)), "names-in-scopes")

    called = lasts.groupBy(F.col("type_name").alias("simple")).agg(F.sum("n").alias("n"))
    rest = staged(_without(likely, first, key), "names-elsewhere")
    held = imported.where("label = 'Package'").select("file_path", F.col("full").alias("package")).distinct()
    by_package = rest.join(held, "file_path").select(*key, *rank(PACKAGE), F.concat("package", F.lit("."), "clean").alias("full"))
    by_package = by_package.join(types.select("full", "dst", "b"), "full").select(*key, "rank", "near", "dst", "b")
    here = rest.join(types.select(F.col("type_file").alias("file_path"), F.col("type_name").alias("simple"), "dst", "b"), ["file_path", "simple"])
    only = rest.join(called.where("n = 1").select("simple"), "simple").join(types.select(F.col("type_name").alias("simple"), "dst", "b"), "simple")
    many = rest.join(called.where("n > 1").select("simple"), "simple")
    none = lambda t: F.lit(None).cast(t)
    second = by_package.unionByName(here.select(*key, *rank(SAME_FILE), "dst", "b")).unionByName(only.select(*key, *rank(UNIQUE), "dst", "b"))
    second = second.unionByName(many.select(*key, none("int").alias("rank"), F.lit(0).alias("near"), none("string").alias("dst"), none("string").alias("b")))
    second = staged(_lowest(second, key), "names-found-elsewhere")
    known = first.unionByName(second)
    unknown = _without(rows, known, key).select(*key, none("string").alias("dst"), none("string").alias("b"), F.lit(False).alias("known"))
    return known.select(*key, "dst", "b", F.lit(True).alias("known")).unionByName(unknown)


def _lowest(hits: DataFrame, key: list[str]) -> DataFrame:
    """(*key, dst, b) of ``hits`` (*key, rank, near, dst, b): what the lowest rank names, or null where that is not one; one shuffle by name. Hits without a rank
    say only that there is such a name."""
    best = hits.repartition(*key).groupBy(*key, "rank", "near").agg((F.min("dst") == F.max("dst")).alias("one"), F.min(F.struct("dst", "b")).alias("x"))
    first = F.min(F.when(F.col("rank").isNotNull(), F.struct("rank", "near", "one", "x")))
    best = best.groupBy(*key).agg(first.alias("y")).withColumn("x", F.when(F.col("y.one"), F.col("y.x")))
    return best.select(*key, "x.dst", "x.b")


def ancestors(g: PropertyGraph) -> DataFrame:
    """(type, ancestor, depth): every type with itself, at depth 0, and with what it inherits from."""
    own = types_of(g).select(F.col("dst").alias("type"), F.col("dst").alias("ancestor"), F.lit(0).alias("depth"))
    return own.unionByName(inherited(g))


def inherited(g: PropertyGraph) -> DataFrame:
    """(type, ancestor, depth) of what types inherit from: ancestors() without the types themselves, which need no join."""
    up = g.edge("INHERITS", "IMPLEMENTS").where("src NOT LIKE 'Method:%'")
    above = reach(up, up.select(F.col("src").alias("node"))).select(F.col("start").alias("type"), F.col("node").alias("ancestor"), "depth")
    held = types_of(g).select(F.col("dst").alias("ancestor"))
    return above.where("type <> ancestor").join(held, "ancestor").select("type", "ancestor", "depth")


def owners(scopes: DataFrame, g: PropertyGraph) -> DataFrame:
    """(scope, owner, type) of distinct ``scopes`` (scope): the type around each, the longest of its prefixes that is one."""
    types = types_of(g).select(F.col("full").alias("owner"), F.col("b").alias("label"))
    lasts = last_names(g).select("last").distinct()
    every = scopes.select("scope", F.explode(prefixes(bare(F.col("scope")))).alias("owner"))
    likely = every.withColumn("last", simple_name(F.col("owner"))).join(lasts, "last", "left_semi").drop("last")
    around = likely.join(types, "owner").select("scope", F.struct(F.length("owner").alias("n"), (F.col("label") == "Interface").alias("i")).alias("x"))
    best = around.groupBy("scope").agg(F.max("x.n").alias("n"), F.max(F.when(F.col("x.i"), F.col("x.n"))).alias("i"))  # numbers, which are aggregated without a sort
    best = best.select("scope", F.substr(bare(F.col("scope")), F.lit(1), F.col("n")).alias("owner"), F.when(F.col("i") == F.col("n"), "Interface:").otherwise("Class:").alias("label"))
    return best.select("scope", "owner", F.concat("label", "owner").alias("type"))


def call_sites(staging: DataFrame) -> DataFrame:
    """Call rows (file_path, caller, line, col, name, args) with what each is called on (receiver), and whether that is the caller's own (held)."""
    receiver = F.regexp_replace(F.substr("target", F.lit(1), F.greatest(F.lit(0), F.length("target") - F.length("name") - 1)), r"^(self|this)\.", "")
    rows = staging.where("what = 'call' AND name IS NOT NULL").withColumn("target", F.coalesce("target", "name"))
    return staged(rows.select("file_path", F.col("full_name").alias("caller"), "line", "col", "name", "args", receiver.alias("receiver"), F.col("target").rlike(r"^(self|this)\.").alias("held")), "call-sites")


def _said(staging: DataFrame) -> DataFrame:
    """(file_path, full_name, name, target, rank): the types that fields and assigned attributes of a type name."""
    fields = staging.where("what = 'symbol' AND kind IN ('field', 'property') AND coalesce(type_name, '') <> ''").select("file_path", F.col("parent").alias("full_name"), "name", F.col("type_name").alias("target"), F.lit(TYPED).alias("rank"))
    return fields.unionByName(staging.where("what = 'assignment'").select("file_path", "full_name", "name", "target", F.lit(ASSIGNED).alias("rank")))


def receiver_names(staging: DataFrame, rows: DataFrame) -> DataFrame:
    """(file_path, full_name, target): names of which call_candidates() asks what types they are. ``rows``: call_sites()."""
    statics = rows.where("receiver <> '' AND NOT held").select("file_path", F.col("caller").alias("full_name"), F.col("receiver").alias("target"))
    return _said(staging).select("file_path", "full_name", "target").unionByName(statics)


def call_candidates(g: PropertyGraph, staging: DataFrame, imported: DataFrame, language: str, root: str, inferred: DataFrame | None = None, up: DataFrame | None = None,
                    rows: DataFrame | None = None, named: DataFrame | None = None, around: DataFrame | None = None) -> DataFrame:
    """(caller, line, col, priority, callee) of call rows: every method that a call could mean, the likeliest with the lowest priority; rows may repeat.

    ``g`` needs its base types: a receiver's method may be inherited. ``inferred`` (file_path, caller, chain, type): what
    types.receiver_types() says of receivers; ``up``: inherited(), ``rows``: call_sites(), ``named``: type_targets() of receiver_names() and
    any others, ``around``: owners() of the callers and any others, each staged, where those are made already.
    """
    site = ["caller", "line", "col", "name", "args"]
    rows = call_sites(staging) if rows is None else rows
    if around is None:
        around = staged(owners(rows.select(F.col("caller").alias("scope")).distinct(), g), "callers")
    own = around.withColumnRenamed("scope", "caller")

    # Types of the receivers: of fields and assigned attributes of that type, and types named as such.
    if named is None:
        named = staged(type_targets(g, receiver_names(staging, rows), imported, language, root).where("dst IS NOT NULL"), "named-types")
    said = _said(staging)
    kept = said.join(named, ["file_path", "full_name", "target"]).select(F.col("full_name").alias("owner"), F.col("name").alias("receiver"), "rank", F.col("dst").alias("type")).distinct()
    kept = staged(kept, "typed-fields")

    up = staged(inherited(g), "type-ancestors") if up is None else up
    above = up.select("type", type_of_id(F.col("ancestor")).alias("above"), "depth")
    selves = rows.where(F.col("receiver").isin(*SELVES) | (F.col("receiver") == "") & (F.lit(language in ("java", "csharp")) | F.col("held"))).join(own, "caller")
    on_types = selves.select(*site, F.lit(OWN).alias("rank"), "type")
    # Fields may be inherited as well.
    asking = rows.where("receiver <> ''").join(kept.select("receiver").distinct(), "receiver", "left_semi").join(own, "caller").select(*site, "receiver", "owner", "type")
    heirs = asking.drop("owner").join(above.withColumnRenamed("above", "owner"), "type").drop("depth").unionByName(asking)
    on_types = on_types.unionByName(heirs.drop("type").join(kept, ["owner", "receiver"]).select(*site, "rank", "type"))
    static = rows.where("receiver <> '' AND NOT held").join(named.select("file_path", F.col("full_name").alias("caller"), F.col("target").alias("receiver"), F.col("dst").alias("type")), ["file_path", "caller", "receiver"])
    on_types = on_types.unionByName(static.select(*site, F.lit(STATIC).alias("rank"), "type"))
    if inferred is not None:
        chain = F.when(F.col("held") & (F.col("receiver") != ""), F.concat(F.lit("this."), "receiver")).otherwise(F.regexp_replace("receiver", r"^cls\b", "this"))
        told = rows.where("receiver <> ''").withColumn("chain", chain).join(inferred, ["file_path", "caller", "chain"])
        on_types = on_types.unionByName(told.where(~F.col("receiver").isin(*SELVES)).select(*site, F.lit(INFERRED).alias("rank"), "type"))
    on_types = staged(on_types, "types-of-receivers")
    levels = on_types.select(*site, "rank", F.lit(0).alias("depth"), type_of_id(F.col("type")).alias("owner")).unionByName(on_types.join(above, "type").select(*site, "rank", "depth", F.col("above").alias("owner")))
    wanted = levels.select(*site, (F.col("rank") * LEAST_RANK_STEP + F.col("depth")).alias("priority"), F.concat("owner", F.lit("."), "name").alias("wanted"))

    free = rows.where("receiver = '' AND NOT held")
    if language in ("python", "typescript"):  # functions of the module, and those inside the caller
        types = types_of(g).select(F.col("full").alias("p"))
        module = module_of(F.col("file_path"), root)
        module = F.regexp_replace(module, r"\.__init__$", "") if language == "python" else module
        near = F.filter(prefixes(bare(F.col("caller"))), lambda p: F.length(p) >= F.length(module))
        scopes = free.select(*site, F.explode(near).alias("p")).join(types, "p", "left_anti")  # a class is no scope of its methods
        wanted = wanted.unionByName(scopes.select(*site, (F.lit(NEAR * LEAST_RANK_STEP + LEAST_RANK_STEP - 1) - F.least(F.length("p"), F.lit(LEAST_RANK_STEP - 1))).alias("priority"), F.concat("p", F.lit("."), "name").alias("wanted")))
    stands = imported.where("label <> 'Package'").select("file_path", F.col("name").alias("p"), F.col("full").alias("stands"))
    chain = rows.where("NOT held").withColumn("chain", F.when(F.col("receiver") == "", F.col("name")).otherwise(F.concat("receiver", F.lit("."), "name")))
    lead = chain.select("file_path", *site, "chain", F.explode(prefixes(F.col("chain"))).alias("p")).join(stands, ["file_path", "p"])
    wanted = wanted.unionByName(lead.select(*site, F.lit(FROM_IMPORT * LEAST_RANK_STEP).alias("priority"), F.concat("stands", F.substr("chain", F.length("p") + 1)).alias("wanted")))

    called = staged(rows.select("name").distinct(), "called-names")  # methods that no call names are left out
    lasts = called.select(simple_name(F.col("name")).alias("last")).unionByName(stands.select(simple_name(F.col("stands")).alias("last"))).distinct()
    found = wanted.join(_variants(g, lasts), "wanted").select(*site, "priority", _fitting().alias("callee")).where("callee IS NOT NULL")
    methods = g.label("Method").select(bare(F.col("name")).alias("name"), F.col("node_id").alias("callee")).join(called, "name", "left_semi")
    single = staged(methods.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("name"), "single-names")
    single = staged(methods.join(single, "name"), "single-methods")
    found = found.unionByName(rows.join(single, "name").select(*site, F.lit(ONLY * LEAST_RANK_STEP).alias("priority"), "callee"))
    return found.select("caller", "line", "col", "priority", "callee")


def _variants(g: PropertyGraph, lasts: DataFrame | None = None) -> DataFrame:
    """(wanted, variants) of methods by their names without parameters, with what follows these; with ``lasts`` (last) only of names that end so."""
    m = g.label("Method").select(F.regexp_replace("full_name", r"\(.*$", "").alias("wanted"), "full_name")
    if lasts is not None:
        m = m.withColumn("last", simple_name(F.col("wanted"))).join(lasts, "last", "left_semi")
    return m.select("wanted", F.substr("full_name", F.length("wanted") + 1).alias("rest")).groupBy("wanted").agg(F.collect_list("rest").alias("variants"))


def _fitting() -> Column:
    """Of _variants(): the method called exactly so, or the only one, or the only one that takes ``args`` arguments."""
    listed = lambda rest: F.regexp_extract(rest, r"\((.*)\)$", 1)
    takes = lambda rest: F.when(listed(rest) == "", 0).otherwise(F.size(F.split(listed(rest), ",")))
    fits = F.filter("variants", lambda v: takes(v) == F.col("args"))
    first = lambda c: F.get(c, F.lit(0))
    rest = F.when(F.array_contains("variants", ""), F.lit("")).when(F.size("variants") == 1, first("variants")).when(F.size(fits) == 1, first(fits))
    return F.concat(F.lit("Method:"), "wanted", rest)


def overloads(g: PropertyGraph, names: DataFrame) -> DataFrame:
    """(wanted, node_id) of ``names`` (wanted, and args where a call says how many): methods called exactly ``wanted``, or the only one
    called 'wanted(...)', or the only one of these that takes so many."""
    by_args = "args" in names.columns
    names = (names if by_args else names.withColumn("args", F.lit(None).cast("int"))).select("wanted", "args").distinct()
    rows = names.join(_variants(g), "wanted")
    return rows.select("wanted", *(["args"] if by_args else []), _fitting().alias("node_id")).where("node_id IS NOT NULL")


def by_ladder(candidates: DataFrame) -> DataFrame:
    """One callee per call site of ``candidates`` (caller, line, col, priority, callee): the lowest priority that names exactly one."""
    site = ["caller", "line", "col"]
    per = candidates.repartition(*site).groupBy(*site, "priority").agg(F.min("callee").alias("callee"), F.max("callee").alias("last")).where("callee = last")  # one shuffle for both steps
    return per.groupBy(*site).agg(F.min_by("callee", "priority").alias("callee"), F.min("priority").alias("priority"))


def external_stubs(g: PropertyGraph, staging: DataFrame, settled: DataFrame, methods: dict[str, tuple[str, ...]] = EXTERNAL_METHODS, language: str = "java") -> PropertyGraph:
    """Stub methods of frameworks with the CALLS to them: of call rows that are not ``settled`` (caller, line, col), whose receiver
    is a field of the caller's class, of an allowed type with such a method. A stub is called class.receiver.method."""
    spark = staging.sparkSession
    allowed = spark.createDataFrame([(t, m) for t, ms in methods.items() for m in ms], "type_name string, name string")
    calls = staging.where("what = 'call'").select(F.col("full_name").alias("caller"), "line", "col", "name", F.coalesce("target", F.lit("")).alias("target"))
    chain = F.split(F.regexp_replace("target", r"^this\.", ""), r"\.")
    calls = calls.withColumn("chain", chain).where(F.size("chain") == 2).withColumn("receiver", F.col("chain")[0]).withColumn("owner", F.regexp_replace(F.regexp_replace("caller", r"\(.*$", ""), r"\.[^.]*$", ""))
    fields = staging.where("what = 'symbol' AND kind = 'field'").select(F.col("parent").alias("owner"), F.col("name").alias("receiver"), bare(F.col("type_name")).alias("type_name")).distinct()
    fields = staged(fields.join(F.broadcast(allowed.select("type_name").distinct()), "type_name", "left_semi"), "external-fields")
    hit = calls.join(fields, ["owner", "receiver"]).join(F.broadcast(allowed), ["type_name", "name"]).withColumn("fn", F.concat_ws(".", "owner", "receiver", "name"))  # some 70 rows
    callers = g.label("Method").select(F.col("full_name").alias("caller"), F.col("node_id").alias("src"))
    hit = staged(hit, "external-candidates").join(settled.select("caller", "line", "col"), ["caller", "line", "col"], "left_anti")
    hit = staged(hit.join(callers, "caller").select("src", "line", "col", "fn", "name"), "external-calls")
    stubs = hit.select("fn", "name").distinct()
    nodes = stubs.select(node_columns(node_id=node_id("Method", F.col("fn")), labels=F.array(F.lit("Method")), kind_label=F.lit("Method"), full_name=F.col("fn"), name=F.col("name"), signature=F.col("name"),
                                      file_path=F.lit(""), end_line=F.lit(0), language=F.lit(language), is_abstract=F.lit(False), is_static=F.lit(False), stub=F.lit(True)))
    site = F.struct(F.col("line").cast("int").alias("line"), F.col("col").cast("int").alias("col"))
    edges = hit.groupBy("src", "fn").agg(F.array_sort(F.collect_set(site)).alias("sites"))
    return PropertyGraph(nodes, edges.select(edge_columns(F.col("src"), node_id("Method", F.col("fn")), "CALLS", call_sites=F.col("sites"))))
