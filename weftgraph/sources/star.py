"""A property graph made from the star-schema tables, the same on every run.

regions, nations and suppliers are repositories, directories and files; brands are packages; brand and type make
a class, the type an interface; parts are methods and fields; pages give HTTP routes. Each pair of neighbouring
lines of an order is a call between their parts' methods, from the brand of the lower number to that of the higher
and within a brand in the order of the lines: about 30 calls a method, with cycles inside the brands. Types, interfaces and brands inherit along chains and trees without cycles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.graph import PropertyGraph
from weftgraph.operators import derive
from weftgraph.plans.staging import staged
from weftgraph.schema import edge_columns, node_columns, node_id

EXTENSIONS = (("python", ".py"), ("java", ".java"), ("csharp", ".cs"), ("typescript", ".ts"))  # by supplier key modulo 4
VERBS = ("GET", "POST", "PUT", "DELETE")


def _pick(n: Column, values: tuple) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s_suppkey, repo, dir, path, name, language)."""
    place = _read(spark, sf_dir, "nation").join(_read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("s_suppkey")
    sub = F.when(k % 5 == 0, "tests/").when(k % 11 == 7, "vendor/").otherwise("")
    name = F.concat(F.regexp_replace("s_name", "#", "_"), _pick(k, tuple(e for _, e in EXTENSIONS)))
    base = F.concat(F.lit("/"), F.col("r_name"), F.lit("/"), F.col("n_name"))
    rows = _read(spark, sf_dir, "supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select("s_suppkey", F.concat(F.lit("/"), "r_name").alias("repo"), base.alias("dir"), F.concat(base, F.lit("/"), sub, name).alias("path"),
                       name.alias("name"), _pick(k, tuple(x for x, _ in EXTENSIONS)).alias("language"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part with its class, method and file."""
    k = F.col("p_partkey")
    rows = _read(spark, sf_dir, "part").withColumn("class_name", F.concat("p_brand", F.lit("."), "p_type"))
    method = (
        F.when(k % 50 == 7, F.col("p_type")).when(k % 97 == 5, F.lit("main")).when(k % 19 == 3, F.concat(F.lit("get"), F.floor(k / 8).cast("string")))
        .when(k % 59 == 11, F.lit("configure")).otherwise(F.concat(F.lit("m"), F.floor(k / 8).cast("string")))
    )
    rows = rows.withColumn("method_name", method).withColumn("method", F.concat("class_name", F.lit("."), "method_name"))
    suppliers = _read(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("suppliers"))
    rows = rows.join(F.broadcast(suppliers)).withColumn("s_suppkey", k % F.col("suppliers"))  # one row
    return rows.join(files(spark, sf_dir).select("s_suppkey", "path", "language"), "s_suppkey")


def endpoint_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """route, http_method, handler, def_ord."""
    k, rows = F.col("page_id"), _routes(spark, sf_dir)
    route = F.concat(F.when(k % 3 == 0, "/api").otherwise(""), F.lit("/"), F.col("seg"), F.lit("/{id}"))
    out = rows.where(k % 2 == 0).select(route.alias("route"), _pick(F.floor(k / 2), VERBS).alias("http_method"), "method", k.alias("def_ord"))
    return out.withColumnRenamed("method", "handler")


def client_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """route, http_method, caller, line, col, call_ord."""
    k, rows = F.col("page_id"), _routes(spark, sf_dir)
    seg = F.col("seg")
    forms = [F.concat(F.lit("{baseUrl}/"), seg, F.lit("/{x}")), F.concat(F.lit("/"), seg, F.lit("/{pid}")), F.concat(F.lit("/"), seg, F.lit("/list")),
             F.concat(F.lit("/api/"), seg, F.lit("/{q}")), F.concat(F.lit("/v9/"), seg, F.lit("/{q}"))]
    route = F.element_at(F.array(*forms), (k % 5 + 1).cast("int"))
    return rows.where(k % 2 == 1).select(route.alias("route"), _pick(F.floor(k / 2), VERBS).alias("http_method"), F.col("method").alias("caller"),
                                         k.cast("int").alias("line"), F.lit(0).alias("col"), k.alias("call_ord"))


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://[^/]+/([a-z]+)", 1).alias("seg"))
    n = _read(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("n"))
    pages = pages.where("seg <> ''").join(F.broadcast(n)).withColumn("p_partkey", (F.col("page_id") * 3) % F.col("n"))  # one row
    return pages.join(parts(spark, sf_dir).select("p_partkey", "method"), "p_partkey")


def base_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Nodes and the edges that an extractor would find; see derive.all_derived() for the rest."""
    f, p = staged(files(spark, sf_dir), "files"), staged(parts(spark, sf_dir), "parts")
    k = F.col("p_partkey")
    languages = F.array(*(F.lit(x) for x in sorted(x for x, _ in EXTENSIONS)))
    path = F.concat(F.lit("/"), "r_name")
    repos = _read(spark, sf_dir, "region").select(node_columns(node_id=node_id("Repository", path), labels=F.array(F.lit("Repository")), kind_label=F.lit("Repository"),
                                                               name=F.col("r_name"), path=path, languages=languages))
    dirs = f.select("dir", "repo").distinct()
    dir_nodes = dirs.select(node_columns(node_id=node_id("Directory", F.col("dir")), labels=F.array(F.lit("Directory")), kind_label=F.lit("Directory"),
                                         name=F.substring_index("dir", "/", -1), path=F.col("dir")))
    indexed = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s_suppkey") * 60)
    file_nodes = f.select(node_columns(node_id=node_id("File", F.col("path")), labels=F.array(F.lit("File")), kind_label=F.lit("File"), name=F.col("name"),
                                       path=F.col("path"), file_path=F.col("path"), language=F.col("language"), last_indexed=indexed))
    packages = p.select("p_brand").distinct().select(node_columns(node_id=node_id("Package", F.col("p_brand")), labels=F.array(F.lit("Package")),
                                                                  kind_label=F.lit("Package"), full_name=F.col("p_brand"), name=F.col("p_brand")))
    c = p.groupBy("p_brand", "p_type", "class_name").agg(F.min(F.struct(k.alias("k"), "path", "language")).alias("of"))
    c = c.select("p_brand", "p_type", "class_name", "of.k", "of.path", "of.language")
    ck = F.col("k")
    class_attributes = F.when(ck % 10 == 0, '["service"]').when(ck % 10 == 1, '["ApiController"]').when(ck % 10 == 2, '["entity"]').otherwise("[]")
    class_nodes = c.select(node_columns(
        node_id=node_id("Class", F.col("class_name")), labels=F.array(F.lit("Class")), kind_label=F.lit("Class"), full_name=F.col("class_name"), name=F.col("p_type"),
        kind=F.lit("class"), file_path=F.col("path"), line=F.lit(1), end_line=F.lit(500), language=F.col("language"), attributes=class_attributes,
        external_bases=F.when(ck % 13 == 5, '["ext.Base"]').otherwise("[]"),
    ))
    types = c.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
    ifc = F.concat(F.lit("api."), "p_type")
    ifc_language = F.when(F.length("p_type") % 2 == 0, "python").otherwise("java")
    ifc_path = F.concat(F.lit("/api/"), "p_type", F.when(F.length("p_type") % 2 == 0, ".py").otherwise(".java"))
    ifc_nodes = types.select(node_columns(node_id=node_id("Interface", ifc), labels=F.array(F.lit("Interface")), kind_label=F.lit("Interface"), full_name=ifc,
                                          name=F.concat(F.lit("I"), "p_type"), kind=F.lit("interface"), file_path=ifc_path, line=F.lit(1), end_line=F.lit(99), language=ifc_language))
    m = p.groupBy("class_name", "method_name", "method").agg(F.min(F.struct(k.alias("k"), "p_size", "path", "language")).alias("of"))
    m = m.select("class_name", "method_name", "method", "of.*")
    attributes = (
        F.when(ck % 16 == 0, '["HttpGet"]').when(ck % 16 == 1, '["test"]').when(ck % 16 == 2, '["override"]').when(ck % 16 == 3, '["Fact"]')
        .when(ck % 16 == 4, '["virtual"]').when(ck % 16 == 5, '["HttpGetAsync"]').when(ck % 16 != 6, "[]")
    )
    summarized = ck % 100 == 0
    method_nodes = m.select(node_columns(
        node_id=node_id("Method", F.col("method")), labels=F.when(summarized, F.array(F.lit("Method"), F.lit("Summarized"))).otherwise(F.array(F.lit("Method"))),
        kind_label=F.lit("Method"), full_name=F.col("method"), name=F.col("method_name"), signature=F.concat("method_name", F.lit("()")),
        file_path=F.when(ck % 41 == 0, "").otherwise(F.col("path")), line=F.col("p_size"), end_line=F.col("p_size") + 10, language=F.col("language"), attributes=attributes,
        is_abstract=ck % 23 == 0, is_static=ck % 3 == 0, stub=ck % 41 == 0, summary=F.when(summarized, F.concat(F.lit("about "), "method")),
    ))
    shared = p.where("method_name LIKE 'm%' AND method_name <> 'main' AND floor(p_partkey / 8) % 5 = 0").select("p_type", "method_name").distinct()
    ifc_method = F.concat(F.lit("api."), "p_type", F.lit("."), "method_name")
    ifc_methods = shared.select(node_columns(node_id=node_id("Method", ifc_method), labels=F.array(F.lit("Method")), kind_label=F.lit("Method"), full_name=ifc_method,
                                             name=F.col("method_name"), signature=F.concat("method_name", F.lit("()")), file_path=ifc_path, line=F.lit(5), end_line=F.lit(6),
                                             language=ifc_language, attributes=F.lit("[]"), is_abstract=F.lit(False), is_static=F.lit(False), stub=F.lit(False)))
    fields = p.withColumn("field", F.concat("class_name", F.lit(".f"), k.cast("string")))
    type_name = F.when(k % 10 == 0, ifc).otherwise("")
    field_nodes = fields.select(node_columns(
        node_id=node_id("Field", F.col("field")), labels=F.array(F.lit("Field")), kind_label=F.lit("Field"), full_name=F.col("field"), name=F.concat(F.lit("f"), k.cast("string")),
        type_name=type_name, file_path=F.col("path"), line=F.col("p_size"), end_line=F.col("p_size"), language=F.col("language"),
        attributes=F.when(k % 20 == 0, "not json").when(k % 15 == 0, '["autowired","lazy"]'),
    ))
    nodes = [repos, dir_nodes, file_nodes, packages, class_nodes, ifc_nodes, method_nodes, ifc_methods, field_nodes]

    def contains(df: DataFrame, a: Column, b: Column) -> DataFrame:
        return df.select(edge_columns(a, b, "CONTAINS"))

    cls, mth = node_id("Class", F.col("class_name")), node_id("Method", F.col("method"))
    brand = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    parent = F.concat(F.lit("Brand#"), F.floor(brand / 2).cast("string"), F.lit("."), "p_type")
    known = c.select(F.col("class_name").alias("parent"))
    inherits = c.where(brand >= 2).withColumn("parent", parent).join(known, "parent")
    by_type = Window.orderBy("p_type")  # a handful of types
    chain = types.withColumn("before", F.lag("p_type").over(by_type)).where("before IS NOT NULL")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    lines = lines.withColumn("next", F.lead("l_partkey").over(order)).where("next IS NOT NULL")
    of = p.select("p_partkey", "method", brand.alias("brand"))
    calls = lines.join(of.withColumnsRenamed({"p_partkey": "l_partkey", "method": "a", "brand": "a_brand"}), "l_partkey").join(of.withColumnsRenamed({"p_partkey": "next", "method": "b", "brand": "b_brand"}), "next")
    ahead = F.col("a_brand") <= F.col("b_brand")
    calls = calls.withColumns({"caller": F.when(ahead, F.col("a")).otherwise(F.col("b")), "callee": F.when(ahead, F.col("b")).otherwise(F.col("a"))})
    site = F.struct(F.col("l_orderkey").cast("int").alias("line"), F.col("l_linenumber").cast("int").alias("col"))
    calls = calls.groupBy("caller", "callee").agg(F.array_sort(F.collect_set(site)).alias("sites"))
    total = _read(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("parts"))
    other = p.select(F.col("p_partkey").alias("other"), F.col("class_name").alias("other_class"), F.col("p_brand").alias("other_brand"))
    refs = p.join(F.broadcast(total)).withColumn("other", (k * 7 + 3) % F.col("parts")).join(other, "other")  # one row
    ref_kind = _pick(F.col("p_size"), ("parameter", "return_type", "property_type", "field_type"))
    method_refs = refs.select("method", "other_class", ref_kind.alias("kind")).distinct()
    imports = refs.select("path", "other_brand").distinct()
    edges = [
        contains(dirs, node_id("Repository", F.col("repo")), node_id("Directory", F.col("dir"))),
        contains(f, node_id("Directory", F.col("dir")), node_id("File", F.col("path"))),
        contains(c, node_id("File", F.col("path")), cls),
        contains(c, node_id("Package", F.col("p_brand")), cls),
        contains(m, cls, mth),
        contains(shared, node_id("Interface", ifc), node_id("Method", ifc_method)),
        contains(fields, cls, node_id("Field", F.col("field"))),
        inherits.select(edge_columns(cls, node_id("Class", F.col("parent")), "INHERITS")),
        chain.select(edge_columns(node_id("Interface", ifc), node_id("Interface", F.concat(F.lit("api."), "before")), "INHERITS")),
        c.select(edge_columns(cls, node_id("Interface", ifc), "IMPLEMENTS")),
        calls.select(edge_columns(node_id("Method", F.col("caller")), node_id("Method", F.col("callee")), "CALLS", call_sites=F.col("sites"))),
        method_refs.select(edge_columns(mth, node_id("Class", F.col("other_class")), "REFERENCES", F.col("kind"))),
        fields.where(k % 10 == 0).select(edge_columns(node_id("Field", F.col("field")), node_id("Interface", ifc), "REFERENCES", F.lit("field_type"))),
        imports.select(edge_columns(node_id("File", F.col("path")), node_id("Package", F.col("other_brand")), "IMPORTS")),
    ]
    return PropertyGraph.of(nodes, edges)


_GRAPHS: dict[tuple[str, str], PropertyGraph] = {}


def star_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The whole graph, derived edges included, made once a session. Nodes and edges are written once, in folders of their labels and types, and
    read from there: queries ask for some types, and a copy in the executors' memory would take it from their sorts and aggregates."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _GRAPHS:
        base = _in_folders(base_graph(spark, sf_dir), "base")
        http = derive.http_edges(endpoint_definitions(spark, sf_dir), client_calls(spark, sf_dir)).staged()
        more = _in_folders(derive.derived(base, http), "derived")
        _GRAPHS[key] = PropertyGraph(base.nodes.unionByName(more.nodes), base.edges.unionByName(more.edges))
    return _GRAPHS[key]


def _in_folders(g: PropertyGraph, name: str) -> PropertyGraph:
    return PropertyGraph(staged(g.nodes, f"{name}-nodes", by="kind_label"), staged(g.edges, f"{name}-edges", by="type"))
