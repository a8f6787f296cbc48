"""Every operator as a query over the star-schema tables, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import predicates as P
from weftgraph.functions import routes, texts
from weftgraph.graph import PropertyGraph, require_read_only
from weftgraph.operators import audit, build, containment, derive, dml, impact, imports, lookup, reports, resolve, sync, traversal
from weftgraph.oracle import ATTRIBUTES_OF_FRAMEWORKS, CLASSES_OF_ENTITIES, CLASSES_OF_FRAMEWORKS, METHODS_OF_FRAMEWORKS, REPOSITORY_METHODS, attribute, levels, over_graph, test, vendored
from weftgraph.plans.expand import trails
from weftgraph.plans.staging import staged
from weftgraph.schema import EDGE_FIELDS, edge_columns, node_id
from weftgraph.sources import answers, brace_source, files, python_source, star
from weftgraph.streaming.debounce import debounced


@dataclass(frozen=True)
class Symbols:
    """The symbols that point queries ask for: the method with most callers, the one with most callees, the target's first caller, class and interface."""

    target: str
    start: str
    caller: str
    cls: str
    ifc: str


_SYMBOLS: dict[tuple[str, str], Symbols] = {}


def symbols(spark: SparkSession, sf_dir: str) -> Symbols:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SYMBOLS:
        calls = star.star_graph(spark, sf_dir).edge("CALLS")
        most = lambda c: calls.groupBy(c).count().orderBy(F.desc("count"), c).first()[0].removeprefix("Method:")
        target = most("dst")
        cls = target.rsplit(".", 1)[0]
        caller = calls.where(F.col("dst") == f"Method:{target}").agg(F.min("src")).first()[0].removeprefix("Method:")
        _SYMBOLS[key] = Symbols(target, most("src"), caller, cls, "api." + cls.split(".")[1])
    return _SYMBOLS[key]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    if name in QUERIES:
        raise ValueError(f"there is a query {name} already")
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql


def on_graph(name: str, run: Callable[[PropertyGraph, Symbols], DataFrame], sql: str | None = None) -> None:
    _register(name, lambda spark, sf_dir: run(star.star_graph(spark, sf_dir), symbols(spark, sf_dir)), None if sql is None else over_graph(sql))


def on_tables(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None, graph: bool = False) -> None:
    _register(name, run, None if sql is None else over_graph(sql) if graph else sql)


# The graph itself
on_graph("graph_nodes", lambda g, s: g.nodes.groupBy("kind_label").agg(F.count(F.lit(1)).alias("n")), "SELECT label AS kind_label, count(*) AS n FROM n GROUP BY 1")
on_graph("graph_edges", lambda g, s: g.edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")), "SELECT type, count(*) AS n FROM e GROUP BY 1")
on_graph(
    "sql_surface",
    lambda g, s: g.sql("SELECT n.language, count(*) AS n FROM edges e JOIN nodes n ON n.node_id = e.src WHERE e.type = :type GROUP BY n.language", {"type": "CALLS"}),
    "SELECT n.language, count(*) AS n FROM call JOIN n ON n.id = call.src GROUP BY 1",
)

# Point lookups and search
NODE = "x.full_name, x.name, x.label AS kind_label, x.file_path, x.line"
on_graph("symbol", lambda g, s: lookup.symbol(g, s.target), f"SELECT {NODE}, x.language FROM n x JOIN tgt ON x.full_name = tgt.fn")
on_graph("source_info", lambda g, s: lookup.source_info(g, s.target), "SELECT full_name, file_path, line, end_line FROM n JOIN tgt ON full_name = fn WHERE file_path <> ''")
on_graph("search_exact", lambda g, s: lookup.search(g, "def m1("), f"SELECT {NODE}, x.language, CASE WHEN name = 'm1' THEN 0 ELSE 1 END AS rank FROM n x WHERE full_name IS NOT NULL AND contains(name, 'm1')")
on_graph(
    "search_fallback", lambda g, s: lookup.search(g, "class economy {", kind="Class"),
    f"SELECT {NODE}, x.language, CASE WHEN lower(name) = 'economy' THEN 0 ELSE 1 END AS rank FROM n x WHERE label = 'Class' AND contains(lower(name), 'economy')",
)
on_graph(
    "search_filtered", lambda g, s: lookup.search(g, "m", kind="Method", namespace="Brand#1", language="python"),
    f"SELECT {NODE}, x.language, CASE WHEN name = 'm' THEN 0 ELSE 1 END AS rank FROM n x WHERE label = 'Method' AND contains(name, 'm') AND starts_with(full_name, 'Brand#1') AND language = 'python'",
)
on_graph(
    "resolve_suffix", lambda g, s: lookup.resolve(g, "ECONOMY").select("full_name", F.array_join("labels", ",").alias("labels")),
    "SELECT DISTINCT full_name, label AS labels FROM n WHERE full_name LIKE '%.ECONOMY' AND label IN ('Class', 'Interface')",
)
on_graph(
    "resolve_member", lambda g, s: lookup.resolve(g, "m1").select("full_name", F.array_join("labels", ",").alias("labels")),
    "SELECT DISTINCT full_name, CASE WHEN summary IS NULL THEN label ELSE label || ',Summarized' END AS labels FROM n WHERE full_name LIKE '%.m1'",
)
on_graph("prefer_owner", lambda g, s: lookup.of_owner(g, lookup.resolve(g, "m0").select("full_name"), "Class"),
         "SELECT DISTINCT n.full_name FROM n JOIN con ON con.dst = n.id JOIN n o ON o.id = con.src AND o.label = 'Class' WHERE n.full_name LIKE '%.m0'")
on_graph("similar_names", lambda g, s: lookup.similar(g, "x.m10"),
         "SELECT full_name, min(CASE WHEN name = 'm10' THEN 0 ELSE 1 END) AS rank FROM n WHERE full_name IS NOT NULL AND contains(name, 'm10') GROUP BY 1 ORDER BY rank, full_name LIMIT 5")
on_graph("symbol_kinds", lambda g, s: lookup.symbol_kind(g).groupBy("kind").agg(F.count(F.lit(1)).alias("n")), "SELECT label AS kind, count(*) AS n FROM n WHERE full_name IS NOT NULL GROUP BY 1")
on_graph("containing_type", lambda g, s: lookup.containing_type(g), f"SELECT y.full_name AS of, {NODE} FROM con JOIN n x ON x.id = con.src AND x.label IN ('Class', 'Interface') JOIN n y ON y.id = con.dst WHERE y.full_name IS NOT NULL")
on_graph("members", lambda g, s: lookup.members(g, s.cls), f"SELECT cls.fn AS of, {NODE}, x.signature, x.type_name FROM con JOIN cls ON con.src = cls.id JOIN n x ON x.id = con.dst")
on_graph("constructor", lambda g, s: lookup.constructor(g), "SELECT o.full_name AS of, x.full_name, x.line, x.signature FROM con JOIN n o ON o.id = con.src JOIN n x ON x.id = con.dst WHERE x.name = o.name AND o.full_name IS NOT NULL")
on_graph("implemented_interfaces", lambda g, s: lookup.implemented_interfaces(g), "SELECT a.full_name AS of, b.full_name, b.name FROM impl JOIN n a ON a.id = impl.src JOIN n b ON b.id = impl.dst AND b.label = 'Interface'")
on_graph("type_references", lambda g, s: lookup.type_references(g), "SELECT b.full_name AS of, a.full_name, kind AS ref_kind, a.file_path, a.line FROM e JOIN n a ON a.id = src JOIN n b ON b.id = dst WHERE type = 'REFERENCES'")
on_graph("type_references_kind", lambda g, s: lookup.type_references(g, s.cls, "parameter"),
         "SELECT b.full_name AS of, a.full_name, kind AS ref_kind, a.file_path, a.line FROM typed JOIN n a ON a.id = src JOIN n b ON b.id = dst JOIN cls ON cls.id = dst WHERE type = 'REFERENCES' AND kind = 'parameter'")
on_graph("field_dependencies", lambda g, s: lookup.field_dependencies(g),
         "SELECT o.full_name AS of, x.full_name, x.name, x.type_name, CASE WHEN x.attributes LIKE '[%' THEN 'autowired,lazy' ELSE '' END AS annotations FROM con JOIN n o ON o.id = con.src JOIN n x ON x.id = con.dst AND x.label = 'Field' WHERE x.type_name <> ''")
on_graph("called_members", lambda g, s: lookup.called_members(g, s.caller, s.cls), "SELECT DISTINCT x.full_name, x.name FROM con JOIN cls ON con.src = cls.id JOIN call ON call.dst = con.dst JOIN n x ON x.id = con.dst WHERE call.src = (SELECT min(src) FROM call JOIN tgt ON dst = id)")
DEPS = "SELECT DISTINCT e.dst AS id FROM con JOIN cls ON con.src = cls.id JOIN e ON e.src = con.dst AND e.type = 'REFERENCES'"
on_graph("referenced_types", lambda g, s: lookup.referenced_types(g, s.cls).drop("node_id"), f"SELECT {NODE} FROM n x JOIN ({DEPS}) d ON x.id = d.id WHERE x.label IN ('Class', 'Interface')")
on_graph("relevant_types", lambda g, s: lookup.relevant_types(g, s.cls, s.target),
         f"SELECT {NODE} FROM n x JOIN ({DEPS}) d ON x.id = d.id WHERE x.label IN ('Class', 'Interface') AND EXISTS (SELECT 1 FROM con JOIN call ON call.dst = con.dst JOIN tgt ON tgt.id = call.src WHERE con.src = x.id)")
SMAP = "SELECT file_path, line, max(full_name) AS full_name FROM n WHERE label = 'Method' AND file_path IS NOT NULL AND line IS NOT NULL GROUP BY 1, 2"
on_graph("symbol_map", lambda g, s: lookup.symbol_map(g), SMAP)
on_graph("symbol_map_overlay", lambda g, s: lookup.overlaid(lookup.symbol_map(g), lookup.symbol_map(g, "Field")),
         f"SELECT * FROM ({SMAP}) a WHERE NOT EXISTS (SELECT 1 FROM n x WHERE x.label = 'Field' AND x.file_path = a.file_path AND x.line = a.line) UNION ALL SELECT file_path, line, max(full_name) FROM n WHERE label = 'Field' GROUP BY 1, 2")
on_graph("relative_paths", lambda g, s: g.label("File").select("path", P.relative(F.col("path"), F.lit("/ASIA/")).alias("below")), "SELECT path, CASE WHEN path LIKE '/ASIA/%' THEN substr(path, 7) ELSE path END AS below FROM n WHERE label = 'File'")
on_graph("short_refs", lambda g, s: g.label("Method").select("full_name", P.short_ref(F.col("full_name")).alias("short")), "SELECT full_name, split_part(full_name, '.', 2) || '.' || split_part(full_name, '.', 3) AS short FROM n WHERE label = 'Method'")
on_graph("projects", lambda g, s: lookup.projects(g), "SELECT path, name, 'csharp,java,python,typescript' AS languages FROM n WHERE label = 'Repository'")
on_graph("summaries", lambda g, s: lookup.summaries(g), "SELECT full_name, summary FROM n WHERE summary IS NOT NULL")
CLOSE = ", below(id) AS (SELECT dst FROM con WHERE src = 'Repository:/ASIA' UNION SELECT con.dst FROM below JOIN con ON con.src = below.id) "
on_graph("summaries_below", lambda g, s: lookup.summaries(g, "/ASIA/"), CLOSE + "SELECT full_name, summary FROM n JOIN below USING (id) WHERE summary IS NOT NULL")

on_graph("summaries_by_labels", lambda g, s: lookup.summaries(g, "/ASIA/", containment.labels(g)), CLOSE + "SELECT full_name, summary FROM n JOIN below USING (id) WHERE summary IS NOT NULL")
on_graph("containment_labels", lambda g, s: containment.labels(g).select("node_id", "depth", (F.col("last") - F.col("first")).alias("inside")),
         """, up AS (SELECT dst AS id, arg_min(src, (CASE WHEN src LIKE 'Package:%' THEN 1 ELSE 0 END, src)) AS parent FROM con GROUP BY dst),
         above(id, top, k) AS (SELECT id, id, 0 FROM n UNION ALL SELECT above.id, up.parent, k + 1 FROM above JOIN up ON up.id = above.top)
         SELECT n.id AS node_id, d.k AS depth, i.inside FROM n JOIN (SELECT id, max(k)::INT AS k FROM above GROUP BY id) d USING (id) JOIN (SELECT top AS id, count(*) - 1 AS inside FROM above GROUP BY top) i USING (id)""")  # fmt: skip
on_graph("nested_roots", lambda g, s: files.relative_paths(g.label("File").select("path"), g.label("Directory", "Repository").where("node_id NOT LIKE '%A'").select(F.col("path").alias("root"))),
         """, r AS (SELECT path AS root FROM n WHERE label IN ('Directory', 'Repository') AND id NOT LIKE '%A')
         SELECT f.path, max_by(root, length(root)) AS root, CASE WHEN count(root) = 0 THEN f.path ELSE substr(f.path, max(length(root)) + 2) END AS below
         FROM (SELECT path FROM n WHERE label = 'File') f LEFT JOIN r ON starts_with(f.path, root || '/') GROUP BY f.path""")  # fmt: skip

# One-hop patterns
WAYS = """, ways AS (SELECT x.id AS m, x.id AS dst, 0 AS branch FROM n x WHERE label = 'Method'
  UNION ALL SELECT src, dst, 1 FROM e WHERE type = 'IMPLEMENTS' AND src LIKE 'Method:%' UNION ALL SELECT dst, src, 2 FROM e WHERE type = 'DISPATCHES_TO'),
cal AS (SELECT w.m, a.id AS caller, min(branch) AS branch FROM ways w JOIN call ON call.dst = w.dst JOIN n a ON a.id = call.src GROUP BY 1, 2) """
on_graph("callers", lambda g, s: lookup.callers(g).drop("site_lines"), WAYS + "SELECT substr(m, 8) AS of, x.full_name, x.file_path, x.line, branch FROM cal JOIN n x ON x.id = caller")
on_graph("callers_of_one", lambda g, s: lookup.callers(g, s.target, exclude_tests=True).drop("site_lines"),
         WAYS + f"SELECT substr(m, 8) AS of, x.full_name, x.file_path, x.line, branch FROM cal JOIN n x ON x.id = caller JOIN tgt ON tgt.id = m WHERE NOT {test('x.file_path')}")
on_graph("call_site_lines", lambda g, s: lookup.callers(g, s.target, dispatch=False).select("full_name", "site_lines"),
         "SELECT caller AS full_name, list_aggregate(list_sort(list_distinct(list_transform(sites, lambda x: x[1]))), 'string_agg', ', ') AS site_lines FROM calls JOIN tgt ON callee = fn")
on_graph("callees", lambda g, s: lookup.callees(g),
         """, way AS (SELECT src, dst, 0 AS branch FROM call UNION ALL SELECT call.src, e.dst, 1 FROM call JOIN e ON e.src = call.dst AND e.type = 'DISPATCHES_TO')
         SELECT substr(src, 8) AS of, x.full_name, x.name, x.file_path, x.line, min(branch) AS branch FROM way JOIN n x ON x.id = way.dst GROUP BY ALL""")  # fmt: skip
on_graph("implementations", lambda g, s: lookup.implementations(g, s.ifc),
         f", d AS (SELECT src AS id FROM impl JOIN ifc ON ifc.id = dst UNION SELECT a FROM inhc JOIN impl ON impl.src = inhc.b JOIN ifc ON ifc.id = impl.dst) SELECT {NODE} FROM n x JOIN d USING (id) WHERE label = 'Class'")
on_graph("hierarchy", lambda g, s: lookup.hierarchy(g, s.cls).drop("paths"),
         "SELECT 'parent' AS relation, substr(b, 7) AS full_name FROM inhc JOIN cls ON a = id UNION ALL SELECT 'child', substr(a, 7) FROM inhc JOIN cls ON b = id UNION ALL SELECT 'implements', substr(dst, 11) FROM impl JOIN cls ON src = id")
on_graph("hierarchy_interface", lambda g, s: lookup.hierarchy(g, s.ifc).drop("paths"),
         "SELECT 'parent' AS relation, substr(b, 11) AS full_name FROM inhc JOIN ifc ON a = id UNION ALL (SELECT 'child', substr(a, 11) FROM inhc JOIN ifc ON b = id UNION SELECT 'child', substr(src, 7) FROM impl JOIN ifc ON dst = id)")
on_graph("neighborhood", lambda g, s: lookup.neighborhood(g, s.target),
         "SELECT DISTINCT x.full_name, x.label AS kind_label, type, 'out' AS direction FROM e JOIN tgt ON src = tgt.id JOIN n x ON x.id = dst WHERE x.full_name <> '' UNION SELECT x.full_name, x.label, type, 'in' FROM e JOIN tgt ON dst = tgt.id JOIN n x ON x.id = src WHERE x.full_name <> ''")
EPS = "SELECT ep.route, ep.http_method, h.id IS NOT NULL AS has_server, h.full_name AS handler, h.file_path, h.line, h.language FROM n ep {j} JOIN (SELECT e.dst, x.* FROM e JOIN n x ON x.id = e.src WHERE type = 'SERVES') h ON h.dst = ep.id WHERE ep.label = 'Endpoint' {w}"
on_graph("http_endpoints", lambda g, s: lookup.endpoints(g), EPS.format(j="LEFT", w=""))
on_graph("http_endpoints_filtered", lambda g, s: lookup.endpoints(g, "/en/", "GET", "python"), EPS.format(j="", w="AND contains(ep.route, '/en/') AND ep.http_method = 'GET' AND h.language = 'python'"))
on_graph("http_dependency", lambda g, s: lookup.endpoint_dependency(g, "/api/en/{id}", "PUT"),
         "SELECT 'handler' AS role, min(substr(src, 8)) AS full_name FROM e WHERE type = 'SERVES' AND dst = 'Endpoint:PUT /api/en/{id}' HAVING count(*) > 0 UNION ALL SELECT DISTINCT 'caller', substr(src, 8) FROM e WHERE type = 'HTTP_CALLS' AND dst = 'Endpoint:PUT /api/en/{id}'")
on_graph("served_endpoint", lambda g, s: lookup.served_endpoint(g),
         "SELECT substr(src, 8) AS of, min((x.route, x.http_method))[1] AS route, min((x.route, x.http_method))[2] AS http_method FROM e JOIN n x ON x.id = dst WHERE type = 'SERVES' GROUP BY src")
on_graph("http_callers", lambda g, s: lookup.http_callers(g),
         "SELECT substr(s.src, 8) AS of, x.full_name, x.file_path, ep.route FROM e s JOIN e h ON h.dst = s.dst AND h.type = 'HTTP_CALLS' JOIN n x ON x.id = h.src JOIN n ep ON ep.id = s.dst WHERE s.type = 'SERVES'")
on_graph("tests_for", lambda g, s: lookup.tests_for(g), "SELECT substr(dst, 8) AS of, x.full_name, x.file_path, x.line FROM tst JOIN n x ON x.id = src")
CONTRACT = """, base AS (SELECT id AS m, id AS b FROM n WHERE label = 'Method' UNION SELECT src, dst FROM ovr), bases(m, b) AS (SELECT * FROM base UNION SELECT bases.m, ovr.dst FROM bases JOIN ovr ON ovr.src = bases.b),
con1 AS (SELECT substr(bases.m, 8) AS of, min((o.full_name, k.full_name, oc.full_name)) AS x FROM bases JOIN mimpl ON mimpl.src = bases.b JOIN n k ON k.id = mimpl.dst AND k.name = regexp_extract(bases.m, '([^.]+)$', 1)
  JOIN con c1 ON c1.dst = k.id JOIN n o ON o.id = c1.src AND o.full_name IS NOT NULL JOIN con c2 ON c2.dst = bases.m JOIN n oc ON oc.id = c2.src AND oc.full_name IS NOT NULL GROUP BY bases.m) """
on_graph("interface_contract", lambda g, s: lookup.interface_contract(g), CONTRACT + "SELECT of, x[1] AS interface, x[2] AS contract, x[3] AS owner FROM con1")
on_graph("contract_siblings", lambda g, s: lookup.siblings(g, lookup.interface_contract(g)).groupBy("of").agg(F.count(F.lit(1)).alias("n"), F.min("sibling").alias("first")),
         CONTRACT + "SELECT of, count(DISTINCT substr(impl.src, 7)) AS n, min(substr(impl.src, 7)) AS first FROM con1 JOIN impl ON impl.dst = 'Interface:' || x[1] AND substr(impl.src, 7) <> x[3] GROUP BY of")

# Traversal
CD = ", cd AS (SELECT src, dst FROM e WHERE type IN ('CALLS', 'DISPATCHES_TO')) "


def walk(start: str, edges: str, most: int, reverse: bool = False) -> str:
    a, b = ("dst", "src") if reverse else ("src", "dst")
    return f""", ed AS MATERIALIZED (SELECT row_number() OVER (ORDER BY src, dst) AS i, src, dst FROM {edges}),
w AS (SELECT id AS start, id AS node, [id] AS nodes, []::BIGINT[] AS es, 0 AS depth FROM {start}
  UNION ALL SELECT w.start, ed.{b}, list_append(w.nodes, ed.{b}), list_append(w.es, ed.i), w.depth + 1 FROM w JOIN ed ON ed.{a} = w.node WHERE NOT list_contains(w.es, ed.i) AND w.depth < {most}) """


NAMES = "list_aggregate(list_transform({x}, lambda y: regexp_replace(y, '^[A-Za-z]+:', '')), 'string_agg', ' > ')"
on_graph("call_trails", lambda g, s: trails(g.edge("CALLS"), g.label("Method").where(F.col("full_name") == s.start).select(F.col("node_id").alias("node")), 1, 3).groupBy("depth").agg(F.count(F.lit(1)).alias("n")),
         walk("sta", "call", 3) + "SELECT depth, count(*) AS n FROM w WHERE depth > 0 GROUP BY depth")
# All trails of the least length and of one more are made; that holds the ten shortest.
on_graph("trace_calls", lambda g, s: traversal.trace(g, s.start, s.target),
         CD + levels("(SELECT id AS node FROM tgt)", "cd", 6, reverse=True) + f""", left_ AS MATERIALIZED (SELECT node, min(depth) AS k FROM (SELECT * FROM lv UNION ALL SELECT id, 0 FROM tgt) GROUP BY node), top AS (SELECT min(depth) + 1 AS most FROM lv JOIN sta ON lv.node = sta.id),
         ed AS MATERIALIZED (SELECT row_number() OVER (ORDER BY src, dst) AS i, src, dst, k FROM cd JOIN left_ ON dst = node),
         w AS (SELECT id AS node, [id] AS nodes, []::BIGINT[] AS es, 0 AS depth FROM sta
           UNION ALL SELECT dst, list_append(w.nodes, dst), list_append(w.es, ed.i), w.depth + 1 FROM w JOIN ed ON ed.src = w.node, top WHERE w.depth + 1 + k <= least(6, most) AND NOT list_contains(w.es, ed.i))
         SELECT depth, {NAMES.format(x='nodes')} AS path FROM w JOIN tgt ON node = tgt.id WHERE depth > 0 ORDER BY depth, path LIMIT 10""")  # fmt: skip
ENTRY = f"""SELECT x.full_name AS entry, depth, lv.path FROM lv JOIN n x ON x.id = lv.node
  WHERE NOT {test('x.file_path')} AND (NOT EXISTS (SELECT 1 FROM call JOIN n y ON y.id = call.src WHERE call.dst = x.id AND NOT {test('y.file_path')})
    OR regexp_matches(x.attributes, 'HttpGet|HttpPost|HttpPut|HttpDelete|HttpPatch') OR EXISTS (SELECT 1 FROM con JOIN n y ON y.id = con.src WHERE con.dst = x.id AND contains(y.attributes, 'ApiController')))
  ORDER BY depth, entry LIMIT 100"""
on_graph("entry_points", lambda g, s: traversal.entry_points(g, s.target), CD + levels("(SELECT id AS node, fn AS path FROM tgt)", "cd", 8, reverse=True, path="regexp_replace({node}, '^[A-Za-z]+:', '') || ' > ' || min(path)") + ENTRY)
on_graph("call_depth", lambda g, s: traversal.call_depth(g, s.start, 3), CD + walk("sta", "cd", 3) + "SELECT DISTINCT x.full_name, x.file_path, depth FROM w JOIN n x ON x.id = node WHERE depth > 0")
on_graph("dependencies", lambda g, s: traversal.dependencies(g, s.target, 3), walk("tgt", "(SELECT src, dst FROM e WHERE type = 'REFERENCES')", 3) + "SELECT x.full_name, x.label AS kind_label, depth FROM w JOIN n x ON x.id = node WHERE depth > 0")
on_graph("explore", lambda g, s: traversal.explore(g, s.cls, 2),
         """, o1 AS (SELECT src, dst, type FROM e JOIN cls ON src = id), o2 AS (SELECT e.src, e.dst, e.type FROM e WHERE src IN (SELECT dst FROM o1)),
         i1 AS (SELECT src, dst, type FROM e JOIN cls ON dst = id), i2 AS (SELECT e.src, e.dst, e.type FROM e WHERE dst IN (SELECT src FROM i1)),
         l2 AS (SELECT * FROM o1 UNION SELECT * FROM o2 UNION SELECT * FROM i1 UNION SELECT * FROM i2)
         SELECT DISTINCT a.full_name AS source, b.full_name AS target, type FROM l2 JOIN n a ON a.id = l2.src JOIN n b ON b.id = l2.dst WHERE a.full_name <> '' AND b.full_name <> ''""")  # fmt: skip
on_graph("transitive_callers", lambda g, s: traversal.transitive_callers(g, s.target),
         walk("tgt", "call", 2, True) + "SELECT DISTINCT x.full_name, x.file_path, x.line FROM w JOIN n x ON x.id = node WHERE depth = 2 AND node NOT IN (SELECT src FROM call JOIN tgt ON dst = id) AND node NOT IN (SELECT id FROM tgt)")

# Impact
BACK = levels("(SELECT id AS node FROM goal)", "call", 4, reverse=True) + f", b AS (SELECT depth AS lo, x.full_name, x.file_path, coalesce({test('x.file_path')}, false) AS t FROM lv JOIN n x ON x.id = node), imp AS (SELECT 'direct' AS role, full_name, file_path FROM b WHERE lo = 1 AND NOT t UNION SELECT 'transitive', full_name, file_path FROM b WHERE lo >= 2 AND NOT t AND full_name <> (SELECT fn FROM tgt) AND full_name NOT IN (SELECT full_name FROM b WHERE lo = 1) UNION SELECT 'test', full_name, file_path FROM b WHERE t UNION SELECT 'callee', x.full_name, x.file_path FROM call JOIN tgt ON src = id JOIN n x ON x.id = dst) "
on_graph("change_impact", lambda g, s: impact.change_impact(g, s.target), BACK + "SELECT * FROM imp")
on_graph("change_impact_totals", lambda g, s: impact.impact_totals(impact.change_impact(g, s.target)),
         BACK + "SELECT count(DISTINCT full_name) FILTER (role = 'direct') AS n_direct, count(DISTINCT full_name) FILTER (role = 'transitive') AS n_transitive, count(DISTINCT full_name) FILTER (role = 'test') AS n_test, count(DISTINCT full_name) FILTER (role = 'callee') AS n_callee, count(DISTINCT full_name) FILTER (role <> 'callee') AS n_affected FROM imp")
on_graph("test_coverage", lambda g, s: impact.test_coverage(g, s.target), BACK + "SELECT full_name, file_path FROM imp WHERE role = 'test'")
on_graph("type_impact", lambda g, s: impact.type_impact(g, s.cls),
         f"SELECT x.full_name, x.file_path, kind AS ref_kind, CASE WHEN {test('x.file_path')} THEN 'test' ELSE 'prod' END AS context FROM typed JOIN n x ON x.id = src WHERE type = 'REFERENCES' AND dst IN (SELECT id FROM cls UNION SELECT dst FROM impl JOIN cls ON src = id) AND x.full_name IS NOT NULL")
on_graph("layering_violations", lambda g, s: impact.layering_violations(g, "tests/", "PROMO"),
         "SELECT o.full_name AS controller, a.full_name AS method, b.full_name AS callee FROM call JOIN n b ON b.id = call.dst AND contains(b.full_name, 'PROMO') JOIN n a ON a.id = call.src JOIN con ON con.dst = a.id JOIN n o ON o.id = con.src AND o.label = 'Class' AND contains(o.file_path, 'tests/')")
# Over calls with two places or more: over all calls, every class is reached.
on_graph("untested_services", lambda g, s: impact.untested_services(PropertyGraph(g.nodes, g.edges.where("type <> 'CALLS' OR size(call_sites) >= 2")), "/NATION_1"),
         ", twice AS MATERIALIZED (SELECT src, dst FROM e WHERE type = 'CALLS' AND n_sites >= 2)" + levels(f"(SELECT id AS node FROM n WHERE label = 'Method' AND {test('file_path')})", "twice", 3)
         + "SELECT full_name, name, file_path FROM n WHERE label = 'Class' AND contains(file_path, '/NATION_1') AND id IN (SELECT src FROM e WHERE type = 'IMPLEMENTS') AND id NOT IN (SELECT con.src FROM con JOIN lv ON lv.node = con.dst)")

# Audits
NOT_CALLED = "NOT EXISTS (SELECT 1 FROM e z WHERE z.dst = x.id AND z.type = 'CALLS')"
NOT_TESTED = "NOT EXISTS (SELECT 1 FROM e z WHERE z.dst = x.id AND z.type = 'TESTS')"
BASE = f""", cand AS (SELECT x.*, EXISTS (SELECT 1 FROM e z WHERE z.dst = x.id AND z.type = 'CALLS') AS called, EXISTS (SELECT 1 FROM e z WHERE z.dst = x.id AND z.type = 'TESTS') AS tested FROM n x WHERE label = 'Method'
  AND NOT {test('file_path')} AND NOT {vendored('file_path')} AND name NOT IN ({', '.join(repr(x) for x in METHODS_OF_FRAMEWORKS)}) AND NOT starts_with(name, 'main(')
  AND NOT {attribute('attributes', [*ATTRIBUTES_OF_FRAMEWORKS, 'virtual'])} AND NOT coalesce(stub, false) AND NOT coalesce(is_abstract, false)
  AND NOT EXISTS (SELECT 1 FROM e z WHERE (z.dst = x.id AND z.type IN ('IMPLEMENTS', 'DISPATCHES_TO')) OR (z.src = x.id AND z.type IN ('SERVES', 'OVERRIDES')))
  AND NOT EXISTS (SELECT 1 FROM con JOIN n o ON o.id = con.src WHERE con.dst = x.id AND (o.label = 'Interface' OR o.label = 'Class' AND (o.name = x.name OR starts_with(x.name, o.name || '(') OR starts_with(o.name, x.name || '<')
    OR x.name IN ('configure', 'Configure', 'ConfigureServices') AND (regexp_full_match(o.name, '.*(?:Configuration|Configurer|Adapter|Options)') OR o.name IN ('Startup', 'Program'))
    OR coalesce(o.external_bases, '[]') <> '[]' AND NOT coalesce(x.is_static, false) OR {attribute('o.attributes', CLASSES_OF_FRAMEWORKS)}
    OR {attribute('o.attributes', CLASSES_OF_ENTITIES)} AND (starts_with(x.name, 'get') OR starts_with(x.name, 'set') OR starts_with(x.name, 'is')))))) """
on_graph("dead_code", lambda g, s: audit.dead_code(g, 15, 5), BASE + "SELECT full_name, file_path, line FROM cand WHERE NOT called ORDER BY file_path, full_name LIMIT 15 OFFSET 5")
on_graph("dead_code_all", lambda g, s: audit.dead_code(g, 0, exclude_pattern="Brand#2", exclude_file_pattern=r"\.ts", subdirectory="NATION_1[0-9]"),
         BASE + r"SELECT full_name, file_path, line FROM cand WHERE NOT called AND NOT regexp_full_match(full_name, '.*Brand#2.*') AND NOT regexp_full_match(file_path, '.*\.ts.*') AND regexp_full_match(file_path, '.*/NATION_1[0-9]/.*|.*/NATION_1[0-9]$')")
on_graph("untested", lambda g, s: audit.untested(g), BASE + "SELECT full_name, file_path, line FROM cand WHERE NOT tested ORDER BY file_path, full_name LIMIT 15")
on_graph("audit_stats", lambda g, s: audit.audit_stats(g),
         BASE + "SELECT count(*) AS total_methods, count(*) FILTER (NOT called) AS dead_count, count(*) FILTER (NOT tested) AS untested_count, CASE WHEN count(*) > 0 THEN round(count(*) FILTER (NOT called) / count(*), 4) ELSE 0.0 END AS dead_ratio, CASE WHEN count(*) > 0 THEN round(count(*) FILTER (NOT tested) / count(*), 4) ELSE 0.0 END AS untested_ratio FROM cand")
on_graph("index_status", lambda g, s: audit.index_status(g, "/ASIA"),
         CLOSE + ", x AS (SELECT * FROM n JOIN below USING (id)) SELECT 'files' AS label, count(*) FILTER (label = 'File') AS n FROM x UNION ALL SELECT 'symbols', count(*) FILTER (label NOT IN ('File', 'Directory')) FROM x UNION ALL SELECT label, count(*) FROM x WHERE label NOT IN ('File', 'Directory') GROUP BY label")
on_graph("index_status_by_labels", lambda g, s: audit.index_status(g, "/ASIA", containment.labels(g)),
         CLOSE + ", x AS (SELECT * FROM n JOIN below USING (id)) SELECT 'files' AS label, count(*) FILTER (label = 'File') AS n FROM x UNION ALL SELECT 'symbols', count(*) FILTER (label NOT IN ('File', 'Directory')) FROM x UNION ALL SELECT label, count(*) FROM x WHERE label NOT IN ('File', 'Directory') GROUP BY label")
on_graph("packages", lambda g, s: audit.packages(g, 10),
         "SELECT k.full_name AS package, count(DISTINCT x.file_path) FILTER (x.label IN ('Class', 'Interface')) AS file_count, count(DISTINCT x.id) FILTER (x.label IN ('Class', 'Interface', 'Method', 'Property', 'Field')) AS symbol_count FROM n k LEFT JOIN con ON con.src = k.id LEFT JOIN n x ON x.id = con.dst WHERE k.label = 'Package' GROUP BY k.full_name ORDER BY symbol_count DESC, package LIMIT 10")
on_graph("hotspots", lambda g, s: audit.hotspots(g, 10),
         f"SELECT x.full_name, x.file_path, x.line, count(DISTINCT call.src) AS inbound_callers FROM call JOIN n x ON x.id = call.dst WHERE NOT {test('x.file_path')} AND NOT {vendored('x.file_path')} GROUP BY ALL ORDER BY inbound_callers DESC, x.full_name LIMIT 10")
on_graph("service_map", lambda g, s: audit.service_map(g), "SELECT ep.route, ep.http_method, x.full_name AS handler, x.file_path FROM e JOIN n ep ON ep.id = dst JOIN n x ON x.id = src WHERE type = 'SERVES' ORDER BY route, http_method, handler LIMIT 100")
on_graph("files_by_language", lambda g, s: audit.files_by_language(g), "SELECT language, count(*) AS files FROM n WHERE label = 'File' GROUP BY 1")
on_graph("graph_stats", lambda g, s: audit.graph_stats(g),
         "SELECT count(*) FILTER (label = 'File') AS total_files, count(*) FILTER (label IN ('Class', 'Interface', 'Method', 'Property', 'Field', 'Package', 'Endpoint')) AS total_symbols, count(*) FILTER (label = 'Package') AS total_packages, count(*) FILTER (label = 'Endpoint') AS total_endpoints FROM n")
on_graph("class_usages", lambda g, s: audit.class_usages(g, s.cls),
         """SELECT 'references' AS what, x.file_path AS item, count(DISTINCT x.full_name) AS n, list_aggregate(list_sort(list(DISTINCT x.full_name))[1:5], 'string_agg', ',') AS sample FROM e JOIN cls ON dst = cls.id JOIN n x ON x.id = src WHERE type = 'REFERENCES' GROUP BY 2
         UNION ALL SELECT 'callers', y.full_name, count(DISTINCT x.full_name), list_aggregate(list_sort(list(DISTINCT x.full_name))[1:5], 'string_agg', ',') FROM con JOIN cls ON con.src = cls.id JOIN call ON call.dst = con.dst JOIN n y ON y.id = con.dst JOIN n x ON x.id = call.src GROUP BY 2""")  # fmt: skip
on_graph("call_resolution", lambda g, s: audit.call_resolution(g),
         "SELECT (SELECT count(*) FROM call) AS call_edges, (SELECT sum(n_sites) FROM e WHERE type = 'CALLS')::BIGINT AS call_sites, (SELECT count(DISTINCT src) FROM call) AS callers, (SELECT count(*) FROM n WHERE label = 'Method') AS methods, round((SELECT count(DISTINCT src) FROM call) / (SELECT count(*) FROM n WHERE label = 'Method'), 4) AS resolved_ratio")

# Derived edges
PAIR = ["src", "dst"]
on_graph("derive_transitive_implements", lambda g, s: derive.transitive_implements(PropertyGraph(g.nodes, g.edges.where("type <> 'IMPLEMENTS' OR concat('api.', substring_index(src, '.', -1)) = substr(dst, 11)"))).select(*PAIR), "SELECT src, dst FROM impl EXCEPT SELECT src, dst FROM impl0")
on_graph("derive_method_implements", lambda g, s: derive.method_implements(g)[0].select(*PAIR), "SELECT * FROM mimpl")
on_graph("derive_dispatch", lambda g, s: g.edge("DISPATCHES_TO").select(*PAIR), "SELECT * FROM disp")
on_graph("derive_abstract_dispatch", lambda g, s: derive.abstract_dispatch(g).select(*PAIR),
         "SELECT DISTINCT pm.method AS src, cm.method AS dst FROM inh JOIN mem pm ON pm.owner = inh.dst AND pm.olabel = 'Class' AND pm.is_abstract JOIN mem cm ON cm.owner = inh.src AND cm.olabel = 'Class' AND cm.name = pm.name")


def _protocols(g: PropertyGraph) -> PropertyGraph:
    """Interfaces cut down to the method that comes first by name, and that no class says to implement."""
    interfaces = g.label("Interface").select(F.col("node_id").alias("src"))
    held = g.edge("CONTAINS").join(interfaces, "src", "left_semi").join(g.nodes.select(F.col("node_id").alias("dst"), "name"), "dst")
    first = held.groupBy("src").agg(F.min_by("dst", "name").alias("dst"))
    other = g.edges.where("type <> 'IMPLEMENTS' OR dst NOT LIKE 'Interface:%'").join(held.select("src", "dst"), PAIR, "left_anti")
    return PropertyGraph(g.nodes, other.unionByName(g.edges.join(first, PAIR, "left_semi")))


on_graph("derive_structural_dispatch", lambda g, s: derive.structural_dispatch(_protocols(g)).select(*PAIR),
         """, fst AS (SELECT owner, min(mem.name) AS name FROM mem JOIN n ON n.id = owner WHERE olabel = 'Interface' AND n.language = 'python' GROUP BY owner)
         SELECT DISTINCT b.method AS src, a.method AS dst FROM fst JOIN mem b ON b.owner = fst.owner AND b.name = fst.name JOIN mem a ON a.olabel = 'Class' AND a.name = fst.name""")  # fmt: skip
on_graph("derive_overrides", lambda g, s: derive.overrides(g).select(*PAIR), "SELECT * FROM ovr")
on_graph("derive_tests", lambda g, s: derive.tests(g).select(*PAIR), "SELECT * FROM tst")
on_graph("derive_callbacks", lambda g, s: derive.callback_calls(PropertyGraph(g.nodes.withColumn("name", F.when(F.col("name") == "configure", F.lit("onCallback")).otherwise(F.col("name"))), g.edges)).select(*PAIR),
         "SELECT con.src, con.dst FROM con JOIN n x ON x.id = con.dst JOIN n o ON o.id = con.src AND o.label = 'Class' WHERE x.name = 'configure'")
on_graph(
    "derive_repository_stubs",
    lambda g, s: derive.repository_stubs(PropertyGraph(g.nodes.withColumn("name", F.when(F.col("full_name") == "api.ECONOMY", F.lit("CrudRepository")).otherwise(F.col("name"))), g.edges)).nodes.select("full_name", "name", "language"),
    "SELECT substr(src, 11) || '.' || m AS full_name, m AS name, n.language FROM inh JOIN n ON n.id = inh.src, (SELECT unnest([" + ", ".join(f"'{x}'" for x in REPOSITORY_METHODS) + "]) AS m) WHERE dst = 'Interface:api.ECONOMY'",
)
on_graph("unique_names", lambda g, s: build.unique_names(g, "Method").select("name", "node_id"), "SELECT name, min(id) AS node_id FROM n WHERE label = 'Method' GROUP BY name HAVING count(*) = 1")

# Routes
on_tables("route_matching", lambda spark, d: routes.match_calls(star.endpoint_definitions(spark, d), star.client_calls(spark, d)), "SELECT * FROM matched", graph=True)
on_tables("route_conflicts", lambda spark, d: routes.conflicts(star.endpoint_definitions(spark, d)), "SELECT http_method, route, count(*) AS n FROM defs GROUP BY 1, 2 HAVING count(*) >= 2", graph=True)


def _rematch(g: PropertyGraph, s: Symbols) -> DataFrame:
    out = derive.http_edges(*derive.definitions_from_graph(g))
    return out.edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


on_graph("route_rematch_from_graph", _rematch, "SELECT type, count(*) AS n FROM e WHERE type IN ('SERVES', 'HTTP_CALLS') GROUP BY type")


# Upserts and deletes
def _sizes(g: PropertyGraph) -> DataFrame:
    return g.nodes.groupBy(F.col("kind_label").alias("what")).agg(F.count(F.lit(1)).alias("n")).unionByName(g.edges.groupBy(F.col("type").alias("what")).agg(F.count(F.lit(1)).alias("n")))


SIZES = "SELECT label AS what, count(*) AS n FROM {n} GROUP BY 1 UNION ALL SELECT type, count(*) FROM {e} GROUP BY 1"


def _upsert(g: PropertyGraph, s: Symbols) -> DataFrame:
    """A method loses nothing by an upsert of other properties; a new one comes in; a second run changes nothing."""
    old = g.label("Method").where("summary IS NOT NULL").select("node_id", F.lit("x()").alias("signature"), F.array(F.lit("Extra")).alias("labels"))
    new = g.label("Package").select(node_id("Method", F.concat("full_name", F.lit(".fresh"))).alias("node_id"), F.lit("fresh()").alias("signature"), F.array(F.lit("Method")).alias("labels"))
    rows = old.unionByName(new)
    out = dml.upsert_nodes(dml.upsert_nodes(g, rows), rows)
    return out.nodes.where("signature IN ('x()', 'fresh()')").select("node_id", "signature", "summary", F.array_join("labels", ",").alias("labels"))


on_graph("upsert_nodes", _upsert, "SELECT id AS node_id, 'x()' AS signature, summary, 'Extra,Method,Summarized' AS labels FROM n WHERE summary IS NOT NULL UNION ALL SELECT 'Method:' || full_name || '.fresh', 'fresh()', NULL, 'Method' FROM n WHERE label = 'Package'")


def _upsert_edges(g: PropertyGraph, s: Symbols) -> DataFrame:
    """Call sites are merged, an edge without an end is not written."""
    calls = g.edge("CALLS")
    more = calls.withColumn("call_sites", F.array(F.struct(F.lit(-1).alias("line"), F.lit(0).alias("col")))).select(*EDGE_FIELDS)
    lost = calls.limit(1).select(edge_columns(F.col("src"), F.lit("Method:nowhere"), "CALLS"))
    out = dml.upsert_edges(dml.upsert_edges(PropertyGraph(g.nodes, calls.select(*EDGE_FIELDS)), more.unionByName(lost)), more)
    return out.edges.select("src", "dst", F.size("call_sites").cast("bigint").alias("sites"))


on_graph("upsert_edges", _upsert_edges, "SELECT src, dst, (n_sites + 1)::BIGINT AS sites FROM e WHERE type = 'CALLS'")
on_graph("reference_stubs", lambda g, s: dml.add_references(g, g.label("Package").select(F.lit(s.target).alias("source"), F.concat(F.lit("lib."), "name").alias("target"), F.lit("parameter").alias("kind"))).nodes.where("library").select("full_name", "name", "kind_label"),
         "SELECT 'lib.' || name AS full_name, name, 'Class' AS kind_label FROM n WHERE label = 'Package'")
FILE = ", fil AS (SELECT file_path AS path FROM cls JOIN n USING (id)), fb(id) AS (SELECT 'File:' || path FROM fil UNION SELECT con.dst FROM fb JOIN con ON con.src = fb.id) "


def _file(g: PropertyGraph, s: Symbols) -> str:
    return g.label("Class").where(F.col("full_name") == s.cls).select("file_path").first()[0]


def _without(ids: str) -> str:
    return SIZES.format(n=f"(SELECT * FROM n WHERE id NOT IN ({ids}))", e=f"(SELECT * FROM e WHERE src NOT IN ({ids}) AND dst NOT IN ({ids}))")


on_graph("delete_file", lambda g, s: _sizes(dml.delete_file(g, _file(g, s))), FILE + _without("SELECT id FROM fb"))
on_graph("delete_project", lambda g, s: _sizes(dml.delete_project(g, "/ASIA/")), CLOSE + _without("SELECT id FROM below UNION ALL SELECT 'Repository:/ASIA'"))
on_graph("delete_file_by_labels", lambda g, s: _sizes(dml.delete_file(g, _file(g, s), containment.labels(g))), FILE + _without("SELECT id FROM fb"))
on_graph("delete_project_by_labels", lambda g, s: _sizes(dml.delete_project(g, "/ASIA/", containment.labels(g))), CLOSE + _without("SELECT id FROM below UNION ALL SELECT 'Repository:/ASIA'"))
on_graph("delete_orphans", lambda g, s: _sizes(dml.delete_orphans(g, _file(g, s), g.label("Class").select("full_name"))),
         FILE + _without("SELECT fb.id FROM fb JOIN n USING (id) JOIN fil ON n.file_path = fil.path WHERE label NOT IN ('File', 'Class')"))
on_graph("delete_outgoing", lambda g, s: _sizes(dml.delete_outgoing(g, _file(g, s))), FILE + SIZES.format(n="n", e="(SELECT * FROM e WHERE type = 'CONTAINS' OR src NOT IN (SELECT id FROM fb))"))
on_graph("delete_orphan_endpoints", lambda g, s: _sizes(dml.delete_orphan_endpoints(PropertyGraph(g.nodes, g.edges.where("type <> 'SERVES'")))),
         ", oe AS (SELECT id FROM n WHERE label = 'Endpoint' AND id NOT IN (SELECT dst FROM e WHERE type = 'HTTP_CALLS')) " + SIZES.format(n="(SELECT * FROM n WHERE id NOT IN (SELECT id FROM oe))", e="(SELECT * FROM e WHERE type <> 'SERVES' AND dst NOT IN (SELECT id FROM oe))"))
on_graph("rename_file", lambda g, s: dml.rename_file(g, _file(g, s), "/moved/here.py").nodes.where("file_path = '/moved/here.py'").select("node_id", "name"),
         FILE + "SELECT CASE WHEN label = 'File' THEN 'File:/moved/here.py' ELSE id END AS node_id, CASE WHEN label = 'File' THEN 'here.py' ELSE name END AS name FROM n JOIN fil ON n.file_path = fil.path")
on_graph("summary_round_trip", lambda g, s: dml.summary_table(dml.set_summaries(dml.remove_summaries(g, g.label("Method").select("full_name")), dml.summary_table(g).where("full_name < 'Brand#2'"), F.lit(None).cast("timestamp"))),
         "SELECT full_name, summary FROM n WHERE summary IS NOT NULL AND full_name < 'Brand#2'")
on_graph("commit_bookmark", lambda g, s: dml.set_commit(g, "/ASIA/", "abc").label("Repository").select("path", "last_indexed_commit"), "SELECT path, CASE WHEN path = '/ASIA' THEN 'abc' END AS last_indexed_commit FROM n WHERE label = 'Repository'")

# Changes
EVENTS = "SELECT '/f' || (user_id % 40) AS path, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'modify' END AS event, ts FROM events"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "delete").otherwise("modify")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("/f"), (F.col("user_id") % 40).cast("string")).alias("path"), kind.alias("event"), "ts")


on_tables("debounce", lambda spark, d: debounced(_events(spark, d), "15 minutes"),
          f"""WITH v AS ({EVENTS}), g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 15 MINUTE THEN 0 ELSE 1 END AS fresh FROM v WINDOW w AS (PARTITION BY path ORDER BY ts)),
          k AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM g)
          SELECT path, max((ts, event))[2] AS event, max(ts) AS ts, count(*) AS events FROM k GROUP BY path, burst""")  # fmt: skip


def _visits(spark: SparkSession, sf_dir: str, event: str, when, name: str) -> DataFrame:
    """A path for each user who did so, with a time."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("event_type") == event)
    return rows.groupBy(F.concat(F.lit("/f"), F.col("user_id").cast("string")).alias("path")).agg(when("ts").alias(name))


on_tables("sync_by_time", lambda spark, d: sync.disk_diff(_visits(spark, d, "view", F.min, "last_indexed"), _visits(spark, d, "purchase", F.max, "modified")),
          "WITH i AS (SELECT '/f' || user_id AS path, min(ts) AS l FROM events WHERE event_type = 'view' GROUP BY 1), d AS (SELECT '/f' || user_id AS path, max(ts) AS m FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT coalesce(i.path, d.path) AS path, CASE WHEN d.path IS NULL THEN 'delete' WHEN i.path IS NULL OR m > l THEN 'reindex' ELSE 'unchanged' END AS action FROM i FULL JOIN d ON i.path = d.path")
CHANGES = "SELECT ['A', 'M', 'D', 'R100'][p_partkey % 4 + 1] AS status, CASE WHEN p_partkey % 4 >= 2 THEN '/' || p_brand || '/' || (p_partkey % 300) || '.py' END AS old_path, CASE WHEN p_partkey % 4 <> 2 THEN '/' || p_type || '/' || (p_partkey % 500) || CASE WHEN p_partkey % 3 = 0 THEN '.md' ELSE '.py' END END AS new_path FROM part"


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    old = F.concat(F.lit("/"), "p_brand", F.lit("/"), (k % 300).cast("string"), F.lit(".py"))
    new = F.concat(F.lit("/"), "p_type", F.lit("/"), (k % 500).cast("string"), F.when(k % 3 == 0, ".md").otherwise(".py"))
    status = F.element_at(F.array(*map(F.lit, ("A", "M", "D", "R100"))), (k % 4 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(status.alias("status"), F.when(k % 4 >= 2, old).alias("old_path"), F.when(k % 4 != 2, new).alias("new_path"))


on_tables("sync_by_commits", lambda spark, d: sync.change_set(_changes(spark, d), (".py",)),
          f"""WITH ch AS ({CHANGES}), x AS (SELECT CASE WHEN status = 'D' THEN old_path ELSE new_path END AS path, CASE WHEN status = 'D' THEN 2 WHEN status LIKE 'R%' THEN 0 ELSE 1 END AS r, CASE WHEN status LIKE 'R%' THEN old_path END AS old_path FROM ch),
          b AS (SELECT path, min((r, old_path)) AS m FROM x WHERE path LIKE '%.py' GROUP BY path)
          SELECT path, ['rename', 'reindex', 'delete'][m[1] + 1] AS action, m[2] AS old_path FROM b WHERE m[1] <> 2 OR path NOT IN (SELECT m[2] FROM b WHERE m[1] = 0)""")  # fmt: skip
on_graph("stale_files", lambda g, s: lookup.stale_files(g, g.label("File").select("path", F.timestamp_seconds(F.lit(1_700_000_000) + F.length("path") * 100).alias("modified"))).select("path"),
         "SELECT path FROM f WHERE 1700000000 + length(path) * 100 > 1700000000 + s_suppkey * 60")


# Texts
def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), "text")


on_tables("text_grep", lambda spark, d: files.grep(_texts(spark, d), "(?i)licensed under").select("path", "line", "text"),
          "WITH l AS (SELECT '/d' || doc_id || '.py' AS path, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1))::INTEGER AS line FROM documents) SELECT path, line, text FROM l WHERE regexp_matches(text, '(?i)licensed under')")
on_tables("text_grep_context", lambda spark, d: files.grep(_texts(spark, d), "(?i)licensed under", 1, 2).groupBy("tag").agg(F.count(F.lit(1)).alias("n")),
          """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents), h AS (SELECT *, regexp_matches(text, '(?i)licensed under') AS hit FROM l),
          c AS (SELECT *, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near FROM h) SELECT CASE WHEN hit THEN 'match' ELSE 'context' END AS tag, count(*) AS n FROM c WHERE near GROUP BY 1""")  # fmt: skip
on_tables("text_lines", lambda spark, d: _texts(spark, d).select("path", files.line_range(F.col("text"), F.lit(2), F.lit(4)).alias("source")),
          "SELECT '/d' || doc_id || '.py' AS path, coalesce(list_aggregate(string_split(text, chr(10))[2:4], 'string_agg', chr(10)), '') AS source FROM documents")
on_tables("text_minified", lambda spark, d: _texts(spark, d).groupBy(files.is_minified(F.col("text")).alias("minified")).agg(F.count(F.lit(1)).alias("n")),
          "SELECT length(trim(split_part(text, chr(10), 1))) > 500 AS minified, count(*) AS n FROM documents GROUP BY 1")
on_tables("text_replace", lambda spark, d: _texts(spark, d).select("path", F.length(files.replaced(F.col("text"), r"(\w+)@(\w+)", "$2 at $1")).alias("n")),
          r"SELECT '/d' || doc_id || '.py' AS path, length(regexp_replace(text, '([A-Za-z0-9_]+)@([A-Za-z0-9_]+)', '\2 at \1', 'g'))::INTEGER AS n FROM documents")
on_graph("detect_languages", lambda g, s: files.detect_languages(g.label("File").select("path"), 1), "SELECT language, count(*) AS files FROM n WHERE label = 'File' GROUP BY 1")
RULES = files.ignore_rules("# build output\n*.cs\n!*7.cs\nvendor/\n/ASIA/**/*2.py\n")
on_graph("ignored_files", lambda g, s: g.label("File").select("path", files.is_ignored(F.substring("path", 2, 999), RULES, ("NATION_3",)).alias("ignored")),
         "SELECT path, path LIKE '%/NATION_3/%' OR CASE WHEN regexp_matches(path, '^/ASIA/(.*/)?[^/]*2\\.py$') OR path LIKE '%/vendor/%' THEN true WHEN path LIKE '%7.cs' THEN false ELSE path LIKE '%.cs' END AS ignored FROM n WHERE label = 'File'")
on_graph("folder_chain", lambda g, s: g.label("File").select(F.explode(files.ancestors(F.col("path"))).alias("folder")).distinct(),
         "SELECT DISTINCT regexp_extract(path, x, 0) AS folder FROM n, (VALUES ('^/[^/]+'), ('^/[^/]+/[^/]+'), ('^/[^/]+/[^/]+/[^/]+')) t(x) WHERE label = 'File' AND regexp_matches(path, x || '/')")
on_tables("route_normal_forms", lambda spark, d: spark.read.parquet(f"{d}/pages.parquet").select("page_id", routes.normalised(F.lit("api/{v:int}/"), F.concat(F.lit("/"), F.col("page_id").cast("string"), F.lit("//{id:long}/"))).alias("route")),
          "SELECT page_id, '/api/{v}/' || page_id || '/{id}' AS route FROM pages")


def _entry_of_usages(g: PropertyGraph, s: Symbols) -> DataFrame:
    """Places of methods joined to the method around them: intervals, one row per place."""
    spans = g.label("Method").where("file_path <> ''").select("file_path", "full_name", "line", "end_line")
    points = g.label("Field").select("file_path", F.col("line").alias("at"), F.col("full_name").alias("field"))
    return build.enclosing(points, spans)


on_graph("enclosing_method", _entry_of_usages,
         "SELECT file_path, \"at\", field, full_name FROM (SELECT y.file_path, y.line AS \"at\", y.full_name AS field, x.full_name, row_number() OVER (PARTITION BY y.id ORDER BY x.line DESC, x.end_line, x.full_name) AS r FROM n y JOIN n x ON x.label = 'Method' AND x.file_path = y.file_path AND y.line BETWEEN x.line AND x.end_line WHERE y.label = 'Field') WHERE r = 1")
on_graph("last_start", lambda g, s: build.last_start(g.label("Field").select("file_path", F.col("line").alias("at")).distinct(), g.label("Method").where("file_path <> ''").select("file_path", "full_name", "line")),
         "SELECT y.file_path, y.\"at\", (SELECT x.full_name FROM n x WHERE x.label = 'Method' AND x.file_path = y.file_path AND x.line <= y.\"at\" ORDER BY x.line DESC, x.full_name DESC LIMIT 1) AS full_name FROM (SELECT DISTINCT file_path, line AS \"at\" FROM n WHERE label = 'Field') y")


# Sources of three languages, written from the parts and read back
def _written(spark: SparkSession, sf_dir: str, extension: str, *lines: str) -> DataFrame:
    """(path, text) of one source file a part; '{k}' is its key and '{b}' its brand without '#'."""
    text = F.lit("\n".join(lines))
    text = F.replace(F.replace(text, F.lit("{k}"), F.col("p_partkey").cast("string")), F.lit("{b}"), F.regexp_replace("p_brand", "#", ""))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("/r/"), F.regexp_replace("p_brand", "#", ""), F.lit("/f"), F.col("p_partkey").cast("string"), F.lit(extension)).alias("path"), text.alias("text"))


def _java_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _written(spark, sf_dir, ".java", "package shop.{b}; // class Ghost {}", "public class P{k} extends Base<Item> {", "  private final Store store = new Store(\"}\");", "  @GetMapping(\"/{k}\")", "  List<Item> load(int n, Map<String, Item> m) { return store.find(n); }", "}")
    return brace_source.staging(texts, "/r").where("what = 'symbol'").select("full_name", "kind", "line", "end_line", "type_name")


on_tables("source_java_symbols", _java_symbols,
          """WITH p AS (SELECT 'shop.' || replace(p_brand, '#', '') || '.P' || p_partkey AS f FROM part)
          SELECT f AS full_name, 'class' AS kind, 2 AS line, 6 AS end_line, NULL AS type_name FROM p UNION ALL SELECT f || '.store', 'field', 3, 3, 'Store' FROM p UNION ALL SELECT f || '.load(int,Map)', 'method', 5, 5, 'List<Item>' FROM p""")  # fmt: skip


CSHARP = ("namespace {b}.N{k};", "public interface IStore<T> { T Load(int id); }", "public enum Mode { On, Off }", "public class Store : IStore<Item> {", "  public Item Last { get; set; }", "  private readonly Mode mode = Mode.On;", "  public Item Load(int id) { return Last; }", "  public static async Task Run(string[] a, List<Item> b) { }", "}")
SCRIPT = ("export interface Shape { area(): number; }", "export class Box implements Shape {", "  private size: Size = 1;", "  area(): number { return this.size; }", "}", "export const make = (x: number): Box => new Box();", "export async function run(a: string): Promise<void> { }", "type Id = string;", "enum Mode { On, Off }")
SNAKE = ("class Store:", "    size: Size", "    @property", "    def last(self) -> Item:", "        return self.kept", "    @staticmethod", "    async def run(a, b=1):", "        pass", "def top():", "    class Inner:", "        pass")


def _symbols_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols of a file of each language, for every part."""
    out = None
    for language, extension, lines in (("csharp", ".cs", CSHARP), ("typescript", ".ts", SCRIPT), ("python", ".py", SNAKE)):
        rows = (python_source if language == "python" else brace_source).staging(_written(spark, sf_dir, extension, *lines), "/r").where("what = 'symbol'")
        rows = rows.select(F.lit(language).alias("language"), "full_name", "kind", "line", "end_line", F.coalesce("type_name", F.lit("")).alias("type_name"), F.coalesce("is_async", F.lit(False)).alias("is_async"))
        out = rows if out is None else out.unionByName(rows)
    return out


on_tables("source_symbols", _symbols_of,
          """WITH p AS (SELECT replace(p_brand, '#', '') AS b, p_partkey AS k FROM part), x AS (SELECT unnest([
            ('csharp', '.IStore', 'interface', 2, 2, '', false), ('csharp', '.IStore.Load(int)', 'method', 2, 2, 'T', false), ('csharp', '.Mode', 'enum', 3, 3, '', false), ('csharp', '.Store', 'class', 4, 9, '', false),
            ('csharp', '.Store.Last', 'property', 5, 5, 'Item', false), ('csharp', '.Store.mode', 'field', 6, 6, 'Mode', false), ('csharp', '.Store.Load(int)', 'method', 7, 7, 'Item', false), ('csharp', '.Store.Run(string[],List)', 'method', 8, 8, 'Task', true),
            ('typescript', '', 'module', 1, 9, '', false), ('typescript', '.Shape', 'interface', 1, 1, '', false), ('typescript', '.Shape.area', 'method', 1, 1, 'number', false), ('typescript', '.Box', 'class', 2, 5, '', false), ('typescript', '.Box.size', 'field', 3, 3, 'Size', false),
            ('typescript', '.Box.area', 'method', 4, 4, 'number', false), ('typescript', '.make', 'method', 6, 6, '', false), ('typescript', '.run', 'method', 7, 7, 'Promise<void>', true), ('typescript', '.Mode', 'enum', 9, 9, '', false),
            ('python', '', 'module', 1, 11, '', false), ('python', '.Store', 'class', 1, 8, '', false), ('python', '.Store.size', 'field', 2, 2, 'Size', false), ('python', '.Store.last', 'property', 4, 5, 'Item', false),
            ('python', '.Store.run', 'method', 7, 8, '', true), ('python', '.top', 'method', 9, 11, '', false), ('python', '.top.Inner', 'class', 10, 11, '', false)]) AS y)
          SELECT y[1] AS language, b || CASE y[1] WHEN 'csharp' THEN '.N' ELSE '.f' END || k || y[2] AS full_name, y[3] AS kind, y[4] AS line, y[5] AS end_line, y[6] AS type_name, y[7] AS is_async FROM p, x""")  # fmt: skip


def _csharp_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _written(spark, sf_dir, ".cs", "namespace {b};", "[Route(\"api/[controller]\")]", "public class P{k}Controller {", "  [HttpGet(\"{id:int}/{k}\")] public Item Get(int id) => Load(id);", "  public void Ask() { http.PostAsync(\"/api/p{k}/\" + id, null); }", "}")
    found = build.http_rows(staged(brace_source.staging(texts, "/r"), "staging", by="what"), "csharp")
    ends = found[0].select(F.lit("serves").alias("what"), "http_method", "route", F.col("handler").alias("method"))
    return ends.unionByName(found[1].select(F.lit("asks").alias("what"), "http_method", "route", F.col("caller").alias("method")))


on_tables("source_csharp_routes", _csharp_routes,
          """WITH p AS (SELECT replace(p_brand, '#', '') || '.P' || p_partkey || 'Controller' AS c, p_partkey AS k FROM part)
          SELECT 'serves' AS what, 'GET' AS http_method, '/api/p' || k || '/{id}/' || k AS route, c || '.Get(int)' AS method FROM p UNION ALL SELECT 'asks', 'POST', '/api/p' || k || '/{id}', c || '.Ask()' FROM p""")  # fmt: skip


def _script_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file imports a class by a relative path and a function by an alias."""
    texts = _written(spark, sf_dir, ".ts", "import { C{k} } from '../{b}/./f{k}';", "import { make as m } from '@/{b}/f{k}';", "export class C{k} { run(a: number): void { m(a) } }", "export const make = (x) => x;")
    rows = staged(brace_source.staging(texts, "/r"), "staging", by="what")
    g = build.structure(rows, "/r", "typescript").staged()
    return imports.import_edges(imports.resolved(g, rows, "/r", "typescript", (("@/", ""),))).select("src", "dst", "type")


on_tables("source_script_imports", _script_imports,
          """WITH p AS (SELECT replace(p_brand, '#', '') AS b, p_partkey AS k FROM part)
          SELECT 'File:/r/' || b || '/f' || k || '.ts' AS src, 'Method:' || b || '.f' || k || '.make' AS dst, 'IMPORTS' AS type FROM p UNION ALL SELECT 'File:/r/' || b || '/f' || k || '.ts', 'Class:' || b || '.f' || k || '.C' || k, 'IMPORTS' FROM p""")  # fmt: skip
on_tables("protocol_kinds", lambda spark, d: spark.read.parquet(f"{d}/part.parquet").select("p_partkey", texts.symbol_kind(F.when(F.col("p_partkey") % 2 == 0, "java").otherwise("python"), F.col("p_partkey") % 16).alias("kind")),
          """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CASE p_partkey % 16 WHEN 4 THEN 'namespace' WHEN 6 THEN 'method' WHEN 8 THEN 'field' WHEN 10 THEN 'enum' WHEN 12 THEN 'method' WHEN 14 THEN 'field' END
          ELSE CASE p_partkey % 16 WHEN 3 THEN 'namespace' WHEN 5 THEN 'class' WHEN 7 THEN 'property' WHEN 9 THEN 'method' END END AS kind FROM part""")  # fmt: skip
on_tables("versions_at_least", lambda spark, d: spark.read.parquet(f"{d}/part.parquet").select("p_partkey", texts.at_least(F.concat(F.lit("1."), (F.col("p_partkey") % 30).cast("string"), F.lit(".4rc1")), 1, 9, 5).alias("recent")),
          "SELECT p_partkey, p_partkey % 30 > 9 AS recent FROM part")
on_tables("iso_times", lambda spark, d: spark.read.parquet(f"{d}/events.parquet").select("event_id", (F.unix_micros(texts.iso_time(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+02:00'")))).alias("micros"), texts.iso_time(F.col("event_type")).isNull().alias("none")),
          "SELECT event_id, epoch_us(ts) - 7200000000 AS micros, true AS none FROM events")
on_tables("route_parameters", lambda spark, d: spark.read.parquet(f"{d}/pages.parquet").select("page_id", routes.flask_params(F.concat(F.lit("/u/<int:id>/"), F.col("page_id").cast("string"), F.lit("/<name>"))).alias("flask"), routes.express_params(F.concat(F.lit("/u/:id/"), F.col("page_id").cast("string"))).alias("express")),
          "SELECT page_id, '/u/{id}/' || page_id || '/{name}' AS flask, '/u/{id}/' || page_id AS express FROM pages")


# Calls on locals, parameters, results and fields: five forms of a file, so that neighbouring parts differ
def _varied(spark: SparkSession, sf_dir: str, extension: str, shared: str, forms: tuple[str, ...]) -> DataFrame:
    """(path, text) as _written(), with the part's own of several forms behind what all share."""
    texts = _written(spark, sf_dir, extension, shared)
    form = F.element_at(F.array(*map(F.lit, forms)), (F.regexp_extract("path", r"/f(\d+)\.", 1).cast("int") % len(forms)) + 1)
    return texts.select("path", F.concat("text", form).alias("text"))


JAVA_SHARED = "package {b}.n{k};\nclass Repo { void save(int n) { } Repo next() { return this; } }\nclass Other { void save(int n) { } }\nclass Util { static void help() { } static void help(int n) { } }\n"
JAVA_FORMS = (
    "class S { Repo mk() { return new Repo(); } void go() { Repo r = new Repo(); r.save(1); } }",
    "class S { Repo mk() { return new Repo(); } void go(Repo q) { q.save(2); } }",
    "class S { Repo mk() { return new Repo(); } void go() { var v = mk(); v.next().save(3); } }",
    "class S { Repo mk() { return new Repo(); } void go() { for (Other o : all) { o.save(4); Util.help(); Util.help(1); } } }",
    "class S { Repo mk() { return new Repo(); } void go() { var x = new Repo(); x = new Other(); x.save(5); } }",
)
PYTHON_SHARED = "class S:\n    def put(self, n): pass\n    def nxt(self) -> 'S': return self\nclass O:\n    def put(self, n): pass\ndef make():\n    x = S()\n    return x\n"
PYTHON_FORMS = (
    "def go():\n    s = S()\n    s.put(1)\n",
    "def go(q: O):\n    q.put(2)\n",
    "def go():\n    make().nxt().put(3)\n",
    "class H:\n    def __init__(self, s: S):\n        self.s = s\n    def go(self):\n        t = self.s\n        t.put(4)\n",
    "def go(f):\n    s = S()\n    if f:\n        s = O()\n    s.put(5)\n",
)


def _local_calls(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    java = language == "java"
    texts = _varied(spark, sf_dir, ".java", JAVA_SHARED, JAVA_FORMS) if java else _varied(spark, sf_dir, ".py", PYTHON_SHARED, PYTHON_FORMS)
    rows = (brace_source if java else python_source).staging(texts, "/r", build.CALL_KINDS, build.CALL_COLUMNS)
    return build.source_calls(rows, "/r", language).select("src", "dst", F.size("call_sites").alias("sites"))


on_tables("source_local_calls", lambda spark, d: _local_calls(spark, d, "java"),
          """WITH p AS (SELECT replace(p_brand, '#', '') || '.n' || p_partkey || '.' AS n, p_partkey % 5 AS form FROM part),
          x(form, a, b) AS (VALUES (0, 'S.go()', 'Repo.save(int)'), (1, 'S.go(Repo)', 'Repo.save(int)'), (2, 'S.go()', 'S.mk()'), (2, 'S.go()', 'Repo.next()'), (2, 'S.go()', 'Repo.save(int)'),
            (3, 'S.go()', 'Other.save(int)'), (3, 'S.go()', 'Util.help()'), (3, 'S.go()', 'Util.help(int)'))
          SELECT 'Method:' || n || a AS src, 'Method:' || n || b AS dst, 1 AS sites FROM p JOIN x USING (form)""")  # fmt: skip
on_tables("source_python_local_calls", lambda spark, d: _local_calls(spark, d, "python"),
          """WITH p AS (SELECT replace(p_brand, '#', '') || '.f' || p_partkey || '.' AS n, p_partkey % 5 AS form FROM part),
          x(form, a, b) AS (VALUES (0, 'go', 'S.put'), (1, 'go', 'O.put'), (2, 'go', 'make'), (2, 'go', 'S.nxt'), (2, 'go', 'S.put'), (3, 'H.go', 'S.put'))
          SELECT 'Method:' || n || a AS src, 'Method:' || n || b AS dst, 1 AS sites FROM p JOIN x USING (form)""")  # fmt: skip


# What sources of many equal names mean: each part has a namespace of its own with the same simple names
def _resolved(spark: SparkSession, sf_dir: str, language: str, extension: str, *lines: str) -> PropertyGraph:
    rows = _written(spark, sf_dir, extension, *lines)
    return build.source_graph((python_source if language == "python" else brace_source).staging(rows, "/r"), "/r", language)


CACHES = ("namespace {b}.N{k};", "public interface ICache { void Get(int k); }", "public class Cache : ICache, Gone {", "  private readonly ICache next;", "  public void Get(int k) { Load(k); next.Get(k); }", "  void Load(int k) { }", "}")
IN_N = "WITH p AS (SELECT replace(p_brand, '#', '') || '.N' || p_partkey AS n FROM part) "


def _base_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = staged(brace_source.staging(_written(spark, sf_dir, ".cs", *CACHES), "/r"), "staging", by="what")
    g, _, edges, external = build.typed_structure(rows, "/r", "csharp")
    told = g.nodes.join(external, "full_name").select(F.col("node_id").alias("src"), external["external_bases"].alias("dst"), F.lit("EXTERNAL").alias("type"))
    return edges.select("src", "dst", "type").unionByName(told)


on_tables("source_base_types", _base_rows,
          IN_N + "SELECT 'Class:' || n || '.Cache' AS src, 'Interface:' || n || '.ICache' AS dst, 'IMPLEMENTS' AS type FROM p UNION ALL SELECT 'Class:' || n || '.Cache', '[\"Gone\"]', 'EXTERNAL' FROM p")
on_tables("source_calls", lambda spark, d: _resolved(spark, d, "csharp", ".cs", *CACHES).edge("CALLS").select("src", "dst", F.element_at("call_sites", 1)["line"].alias("line")),
          IN_N + "SELECT 'Method:' || n || '.Cache.Get(int)' AS src, 'Method:' || n || '.Cache.Load(int)' AS dst, 5 AS line FROM p UNION ALL SELECT 'Method:' || n || '.Cache.Get(int)', 'Method:' || n || '.ICache.Get(int)', 5 FROM p")
STUBBED = ("package {b}.n{k};", "class Svc {", "  private RestTemplate http;", "  private Own own;", "  void go(int n) { http.getForObject(\"/x\"); this.http.put(n); http.other(); own.put(n); }", "}", "class Own { void put(int n) { } }")


def _stub_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _resolved(spark, sf_dir, "java", ".java", *STUBBED)
    return g.edge("CALLS").select("src", "dst").join(g.nodes.select(F.col("node_id").alias("dst"), F.coalesce("stub", F.lit(False)).alias("stub")), "dst").select("src", "dst", "stub")


on_tables("source_stubs", _stub_rows,
          """WITH p AS (SELECT replace(p_brand, '#', '') || '.n' || p_partkey || '.' AS n FROM part), x AS (SELECT unnest([('Svc.http.getForObject', true), ('Svc.http.put', true), ('Own.put(int)', false)]) AS y)
          SELECT 'Method:' || n || 'Svc.go(int)' AS src, 'Method:' || n || y[1] AS dst, y[2] AS stub FROM p, x""")  # fmt: skip


def _attribute_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers by 'Type.method' and by simple names; files hold both."""
    rows = _written(spark, sf_dir, ".java", *STUBBED)
    g = build.structure(staged(brace_source.staging(rows, "/r"), "staging", by="what"), "/r", "java").staged()
    marks = F.explode(F.array(F.struct(F.lit("Own.put").alias("name"), F.lit('["static"]').alias("attributes")), F.struct(F.lit("go").alias("name"), F.lit('["Override","abstract"]').alias("attributes")), F.struct(F.lit("nope").alias("name"), F.lit("[]").alias("attributes"))))
    out = build.with_attributes(g, rows.select(F.col("path").alias("file_path"), marks.alias("m")).select("file_path", "m.*"))
    return out.label("Method").select("full_name", "attributes", "is_static", "is_abstract")


on_tables("source_attributes", _attribute_rows,
          """WITH p AS (SELECT replace(p_brand, '#', '') || '.n' || p_partkey || '.' AS n FROM part)
          SELECT n || 'Own.put(int)' AS full_name, '["static"]' AS attributes, true AS is_static, false AS is_abstract FROM p UNION ALL SELECT n || 'Svc.go(int)', '["Override","abstract"]', false, true FROM p""")  # fmt: skip
PYTHON = ("from abc import ABC", "import requests", "URL = '/items/{k}'", "class Store(ABC):", "    size: Size", "    def save(self, x: Item) -> Item:", "        return x", "class Job(Store):", "    def __init__(self):", "        self.kept = Store()", "    @app.get('/jobs/{k}')",
          "    async def run(self):", "        self.kept.save(1)", "        self.save(2)", "        helper()", "        requests.post(URL, 1)", "def helper():", "    pass")
IN_F = "WITH p AS (SELECT replace(p_brand, '#', '') || '.f' || p_partkey || '.' AS n, p_partkey AS k FROM part) "


def _python_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ("base", "type_ref", "assignment", "call", "endpoint", "client_call", "compile_time", "error")  # all but symbols, imports, constants and bindings
    rows = python_source.staging(_written(spark, sf_dir, ".py", *PYTHON), "/r", kinds, ("what", "full_name", "name", "kind", "target", "line"))
    return rows.select("what", "full_name", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("target", F.lit("")).alias("target"), F.coalesce("line", F.lit(-1)).alias("line"))


on_tables("source_python_rows", _python_rows,
          IN_F + """, x AS (SELECT unnest([('base', 'Store', '', '', 'ABC', 4), ('base', 'Job', '', '', 'Store', 8), ('type_ref', 'Store.size', '', 'field_type', 'Size', 5), ('type_ref', 'Store.save', '', 'parameter', 'Item', 6), ('type_ref', 'Store.save', '', 'return_type', 'Item', 6),
            ('assignment', 'Job', 'kept', '', 'Store', 9), ('call', 'Job.__init__', 'Store', '', 'Store', 10), ('call', 'Job', 'get', '', 'app.get', 11), ('call', 'Job.run', 'save', '', 'self.kept.save', 13), ('call', 'Job.run', 'save', '', 'self.save', 14), ('call', 'Job.run', 'helper', '', 'helper', 15),
            ('call', 'Job.run', 'post', '', 'requests.post', 16)]) AS y)
          SELECT y[1] AS what, n || y[2] AS full_name, y[3] AS name, y[4] AS kind, y[5] AS target, y[6] AS line FROM p, x UNION ALL SELECT 'endpoint', n || 'Job.run', '', 'GET', '/jobs/' || k, 12 FROM p""")  # fmt: skip
on_tables("source_python_calls", lambda spark, d: _resolved(spark, d, "python", ".py", *PYTHON).edge("CALLS", "INHERITS", "IMPLEMENTS").select("src", "dst", "type"),
          IN_F + """SELECT 'Method:' || n || 'Job.run' AS src, 'Method:' || n || 'Store.save' AS dst, 'CALLS' AS type FROM p UNION ALL SELECT 'Method:' || n || 'Job.run', 'Method:' || n || 'helper', 'CALLS' FROM p
          UNION ALL SELECT 'Class:' || n || 'Job', 'Interface:' || n || 'Store', 'IMPLEMENTS' FROM p""")  # fmt: skip


def _constant_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module asks for an address that another declares."""
    one = _written(spark, sf_dir, ".py", "BASE = '/api/{k}'")
    two = _written(spark, sf_dir, ".py", "import requests", "from {b}.f{k} import BASE as at", "def ask():", "    requests.get(at + '/x')").withColumn("path", F.regexp_replace("path", "/f([0-9]+)", "/g$1"))
    rows = staged(python_source.staging(one.unionByName(two), "/r"), "staging", by="what")
    _, asked = build.http_rows(rows, "python")
    return imports.with_constants(asked, imports.visible_constants(rows, "/r", "python")).select("caller", "route", "http_method")


on_tables("source_constants", _constant_calls, "SELECT replace(p_brand, '#', '') || '.g' || p_partkey || '.ask' AS caller, '/api/' || p_partkey || '/x' AS route, 'GET' AS http_method FROM part")


def _reference_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to a function of each file: its own line, one inside a method, one in the module."""
    rows = _written(spark, sf_dir, ".py", "def helper():", "    pass", "def user():", "    return helper()", "helper()")
    g = build.structure(staged(python_source.staging(rows, "/r", ("symbol", "error")), "staging", by="what"), "/r", "python")
    g = PropertyGraph(staged(g.nodes, "nodes", by="kind_label"), g.edges)  # nodes are read several times, CONTAINS edges never
    callee = F.concat(F.translate(F.regexp_replace(F.substring("path", 4, 999), r"\.py$", ""), "/", "."), F.lit(".helper"))
    places = F.explode(F.array(*(F.struct(F.lit(a).alias("line"), F.lit(b).alias("col")) for a, b in ((1, 4), (4, 11), (5, 0), (5, 0)))))
    refs = rows.select(callee.alias("callee"), F.col("path").alias("file_path"), places.alias("at")).select("callee", "file_path", "at.line", "at.col")
    return build.calls_from_references(g, files.own_references(refs, "/r")).select("src", "dst", F.size("call_sites").alias("sites"))


on_tables("source_reference_calls", _reference_calls,
          "WITH p AS (SELECT replace(p_brand, '#', '') || '.f' || p_partkey AS n FROM part) SELECT 'Method:' || n || '.user' AS src, 'Method:' || n || '.helper' AS dst, 1 AS sites FROM p UNION ALL SELECT 'Class:' || n, 'Method:' || n || '.helper', 1 FROM p")


def _recorded_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers about a function of each file, as a server gives them: in the file, behind a character of two UTF-16 units, outside of the root, in ignored folders, in a block for
    compile time, and in no file. The graph is built of sources and answers together."""
    rows = _written(spark, sf_dir, ".py", "def helper(*a):", "    pass", "def user(f):", "    return f('\U0001f600', helper)", "if TYPE_CHECKING:", "    helper", "later = helper")
    callee = F.concat(F.translate(F.regexp_replace(F.substring("path", 4, 999), r"\.py$", ""), "/", "."), F.lit(".helper"))
    below = F.substring("path", 4, 999)
    places = ((F.col("path"), 0, 4), (F.col("path"), 3, 19), (F.col("path"), 5, 4), (F.col("path"), 6, 8), (F.concat(F.lit("/else/"), below), 3, 18), (F.concat(F.lit("/r/node_modules/"), below), 3, 18), (F.concat(F.lit("/rr/"), below), 6, 8))
    place = lambda uri, line, character: F.struct(uri.alias("uri"), F.struct(F.struct(F.lit(line).alias("line"), F.lit(character).alias("character")).alias("start")).alias("range"))
    found = [place(F.concat(F.lit("file://"), path), line, character) for path, line, character in places] + [place(F.lit("untitled:1"), 3, 18)]
    told = rows.select(F.to_json(F.struct(callee.alias("callee"), F.array(*found).alias("result"))).alias("value"))
    staging = python_source.staging(rows, "/r")
    g = build.source_graph(staging, "/r", "python", references=answers.references(told, rows, "/r"))
    site = F.element_at("call_sites", 1)
    return g.edge("CALLS").select("src", "dst", F.size("call_sites").alias("sites"), site["line"].alias("line"), site["col"].alias("col"))


on_tables("source_recorded_references", _recorded_references,
          """WITH p AS (SELECT replace(p_brand, '#', '') || '.f' || p_partkey AS n FROM part)
          SELECT 'Method:' || n || '.user' AS src, 'Method:' || n || '.helper' AS dst, 1 AS sites, 4 AS line, 18 AS col FROM p UNION ALL SELECT 'Class:' || n, 'Method:' || n || '.helper', 1, 7, 8 FROM p""")  # fmt: skip


def _overload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file has a method in two variants, and another in one."""
    rows = _written(spark, sf_dir, ".java", "package {b}.n{k};", "class A { void two(int a) { } void two(String a) { } void one(int a) { } }")
    g = build.structure(staged(brace_source.staging(rows, "/r"), "staging", by="what"), "/r", "java").staged()
    names = g.label("Class").select(F.explode(F.array(F.concat("full_name", F.lit(".one")), F.concat("full_name", F.lit(".two")))).alias("wanted"))
    return resolve.overloads(g, names)


on_tables("source_overloads", _overload_rows, "WITH p AS (SELECT replace(p_brand, '#', '') || '.n' || p_partkey || '.A.one' AS w FROM part) SELECT w AS wanted, 'Method:' || w || '(int)' AS node_id FROM p")


def _place_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of names that many namespaces have, by what a language server says of their places."""
    rows = _written(spark, sf_dir, ".cs", "namespace {b}.N{k};", "public class Item { public Item Make() { return null; } }")
    staging = staged(brace_source.staging(rows, "/r"), "staging", by="what")
    g = build.structure(staging, "/r", "csharp").staged()
    refs = staging.where("what = 'type_ref'").select("full_name", "target", "kind", "file_path", "line", "col")
    defining = refs.select("file_path", "line", "col", F.concat(F.lit("Class:"), F.regexp_replace("full_name", r"\.Make\(\)$", "")).alias("node_id"))
    return build.type_references(g, refs, defining).select("src", "dst", "kind")


on_tables("source_type_refs", _place_rows, IN_N + "SELECT 'Method:' || n || '.Item.Make()' AS src, 'Class:' || n || '.Item' AS dst, 'return_type' AS kind FROM p")


def _reindexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file is written anew: one function goes, one comes, and a caller in another file stays."""
    first = _written(spark, sf_dir, ".py", "def old():", "    pass", "def kept():", "    pass")
    caller = _written(spark, sf_dir, ".py", "from {b}.f{k} import kept", "def call():", "    kept()").withColumn("path", F.regexp_replace("path", "/f([0-9]+)", "/g$1"))
    later = _written(spark, sf_dir, ".py", "def kept():", "    fresh()", "def fresh():", "    pass")
    g = build.python_graph(python_source.staging(first.unionByName(caller), "/r"), "/r").staged()
    out = dml.replace_files(g, later.select("path"), build.python_graph(python_source.staging(later, "/r"), "/r").staged())
    return out.edge("CALLS").select("src", "dst").unionByName(out.label("Method").select("node_id", F.lit("").alias("dst")).toDF("src", "dst"))


on_tables("reindex_files", _reindexed,
          """WITH p AS (SELECT 'Method:' || replace(p_brand, '#', '') || '.' AS n, p_partkey AS k FROM part)
          SELECT n || 'g' || k || '.call' AS src, n || 'f' || k || '.kept' AS dst FROM p UNION ALL SELECT n || 'f' || k || '.kept', n || 'f' || k || '.fresh' FROM p
          UNION ALL SELECT n || 'f' || k || x, '' FROM p, (VALUES ('.kept'), ('.fresh')) t(x) UNION ALL SELECT n || 'g' || k || '.call', '' FROM p""")  # fmt: skip


# Reports, trees, guarded queries
on_graph("json_rows", lambda g, s: reports.without_nulls(g.label("Package", "Class").select("full_name", "file_path", "line")),
         """SELECT '{"full_name":"' || full_name || '"' || coalesce(',"file_path":"' || file_path || '"', '') || coalesce(',"line":' || line, '') || '}' AS value FROM n WHERE label IN ('Package', 'Class')""")  # fmt: skip


def _numbered_texts(g: PropertyGraph) -> DataFrame:
    return g.label("File").select("path", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(600)), lambda k: F.concat(F.lit("line "), k.cast("string"))), "\n").alias("text"))


def _parts(report: reports.Report) -> DataFrame:
    spark = SparkSession.active()
    return spark.createDataFrame([(name, len(rows), min((r["full_name"] for r in rows if r.get("full_name")), default="")) for name, rows in report.parts.items()], "part string, n long, first string")


on_graph("symbol_source", lambda g, s: reports.source(g, _numbered_texts(g), s.cls).select("full_name", "line", "end_line", F.sha2("source", 256).alias("digest")),
         "SELECT fn AS full_name, line, end_line, sha256((SELECT string_agg('line ' || k, chr(10) ORDER BY k) FROM range(1, 501) t(k))) AS digest FROM n JOIN cls USING (id)")
on_graph("parent_line", lambda g, s: reports.parent_line(g, _numbered_texts(g), s.target), "SELECT fn AS full_name, 'line 1' AS declaration FROM cls")
on_graph("read_symbol", lambda g, s: SparkSession.active().createDataFrame([(x,) for x in reports.read_symbol(g, _numbered_texts(g), s.cls)["members"]], "member string"),
         "SELECT coalesce(x.signature, x.name) || CASE WHEN coalesce(x.type_name, '') <> '' THEN ': ' || x.type_name ELSE '' END || ' [' || x.line || ']' AS member FROM con JOIN cls ON con.src = cls.id JOIN n x ON x.id = con.dst")
on_graph("report_context", lambda g, s: _parts(reports.context(g, s.target)),
         f"""SELECT 'members' AS part, count(*) AS n, min(full_name) AS first FROM n JOIN con ON con.dst = id JOIN cls ON con.src = cls.id UNION ALL SELECT 'interfaces', count(*), min(x.full_name) FROM impl JOIN cls ON src = cls.id JOIN n x ON x.id = impl.dst
         UNION ALL SELECT 'callees', count(*), coalesce(min(substr(dst, 8)), '') FROM (SELECT call.dst FROM call JOIN tgt ON src = tgt.id UNION SELECT disp.dst FROM call JOIN tgt ON call.src = tgt.id JOIN disp ON disp.src = call.dst)
         UNION ALL SELECT 'types', count(DISTINCT x.full_name), coalesce(min(x.full_name), '') FROM e JOIN tgt ON src = tgt.id JOIN n x ON x.id = e.dst WHERE type = 'REFERENCES'
         UNION ALL SELECT 'summaries', count(*), coalesce(min(full_name), '') FROM n WHERE summary IS NOT NULL AND id IN (SELECT con.dst FROM con JOIN cls ON con.src = cls.id UNION SELECT call.dst FROM call JOIN tgt ON src = tgt.id UNION SELECT disp.dst FROM call JOIN tgt ON call.src = tgt.id JOIN disp ON disp.src = call.dst UNION SELECT id FROM tgt)""")  # fmt: skip
on_graph("report_structure", lambda g, s: _parts(reports.context(g, s.cls, members_only=True)),
         """SELECT 'members' AS part, count(*) AS n, min(x.full_name) AS first FROM con JOIN cls ON con.src = cls.id JOIN n x ON x.id = con.dst UNION ALL SELECT 'interfaces', count(*), min(x.full_name) FROM impl JOIN cls ON src = cls.id JOIN n x ON x.id = impl.dst
         UNION ALL SELECT 'constructor', count(*), coalesce(min(x.full_name), '') FROM con JOIN cls ON con.src = cls.id JOIN n o ON o.id = cls.id JOIN n x ON x.id = con.dst AND x.name = o.name
         UNION ALL SELECT 'summaries', count(*), coalesce(min(x.full_name), '') FROM con JOIN cls ON con.src = cls.id JOIN n x ON x.id = con.dst WHERE x.summary IS NOT NULL""")  # fmt: skip
on_graph("report_impact", lambda g, s: _parts(reports.assessment(g, s.target)).where("part IN ('direct callers', 'transitive callers', 'tests')"),
         WAYS + BACK + f""", dc AS (SELECT DISTINCT x.full_name FROM cal JOIN n x ON x.id = caller JOIN tgt ON tgt.id = m WHERE NOT {test('x.file_path')}),
         tc AS (SELECT DISTINCT b.src FROM call a JOIN tgt ON a.dst = tgt.id JOIN call b ON b.dst = a.src WHERE (a.src, a.dst) <> (b.src, b.dst) AND b.src NOT IN (SELECT src FROM call JOIN tgt ON dst = tgt.id) AND b.src NOT IN (SELECT id FROM tgt)),
         direct AS (SELECT DISTINCT substr(src, 8) AS full_name FROM tst JOIN tgt ON dst = tgt.id), ts AS (SELECT full_name FROM direct UNION SELECT full_name FROM imp WHERE role = 'test' AND NOT EXISTS (SELECT 1 FROM direct))
         SELECT 'direct callers' AS part, least(count(*), 15) AS n, min(full_name) AS first FROM dc UNION ALL SELECT 'transitive callers', least(count(*), 10), min(substr(src, 8)) FROM tc UNION ALL SELECT 'tests', least(count(*), 5), coalesce(min(full_name), '') FROM ts""")  # fmt: skip
on_graph("busiest_members", lambda g, s: reports.busiest_members(g, s.cls),
         WAYS + """, k AS (SELECT substr(m, 8) AS method, x.full_name AS caller, x.file_path, caller AS cid, m, branch FROM cal JOIN n x ON x.id = caller WHERE m IN (SELECT con.dst FROM con JOIN cls ON con.src = cls.id)),
         t AS (SELECT method, count(*) AS n_callers FROM k GROUP BY method ORDER BY n_callers DESC, method LIMIT 10), r AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY caller) AS i FROM k),
         site AS (SELECT 'Method:' || caller AS cid, 'Method:' || callee AS did, list_aggregate(list_sort(list_distinct(list_transform(sites, lambda x: x[1]))), 'string_agg', ', ') AS lines FROM calls)
         SELECT r.method, n_callers, r.caller, r.file_path, (SELECT site.lines FROM ways w JOIN site ON site.cid = r.cid AND site.did = w.dst WHERE w.m = r.m AND w.branch = r.branch ORDER BY w.dst LIMIT 1) AS site_lines FROM r JOIN t USING (method) WHERE i <= 10""")  # fmt: skip
on_graph("tests_of_type", lambda g, s: reports.tests_of_type(g, s.cls),
         levels("(SELECT con.dst AS node FROM con JOIN cls ON con.src = cls.id UNION SELECT mimpl.dst FROM con JOIN cls ON con.src = cls.id JOIN mimpl ON mimpl.src = con.dst)", "call", 4, reverse=True)
         + f"SELECT x.full_name, x.file_path FROM lv JOIN n x ON x.id = lv.node WHERE {test('x.file_path')}")
on_graph("path_tree", lambda g, s: reports.prefixes(traversal.entry_points(g, s.target, 3).select("path")),
         CD + levels("(SELECT id AS node, fn AS path FROM tgt)", "cd", 3, reverse=True, path="regexp_replace({node}, '^[A-Za-z]+:', '') || ' > ' || min(path)") + f", ep AS ({ENTRY}), s AS (SELECT string_split(path, ' > ') AS x FROM ep) SELECT DISTINCT list_aggregate(x[1:k], 'string_agg', ' > ') AS prefix, k::INTEGER AS depth FROM s, range(1, 9) t(k) WHERE k <= len(x)")


def _shown(g: PropertyGraph, s: Symbols) -> DataFrame:
    """The symbol's surroundings without the node itself: what is left has another link."""
    links = traversal.explore(g, s.cls, 2).select("source", "target")
    names = links.select(F.col("source").alias("full_name")).unionByName(links.select(F.col("target").alias("full_name"))).distinct()
    gone = names.where(F.col("full_name") == s.cls)
    return traversal.without_orphans(names, links, gone)[0]


L2 = """, o1 AS (SELECT src, dst, type FROM e JOIN cls ON src = id), o2 AS (SELECT e.src, e.dst, e.type FROM e WHERE src IN (SELECT dst FROM o1)),
         i1 AS (SELECT src, dst, type FROM e JOIN cls ON dst = id), i2 AS (SELECT e.src, e.dst, e.type FROM e WHERE dst IN (SELECT src FROM i1)),
         l2 AS (SELECT * FROM o1 UNION SELECT * FROM o2 UNION SELECT * FROM i1 UNION SELECT * FROM i2)"""
on_graph("shown_graph", _shown,
         L2 + """, k AS (SELECT DISTINCT a.full_name AS s, b.full_name AS t FROM l2 JOIN n a ON a.id = l2.src JOIN n b ON b.id = l2.dst WHERE a.full_name <> '' AND b.full_name <> '' AND a.full_name <> (SELECT fn FROM cls) AND b.full_name <> (SELECT fn FROM cls))
         SELECT s AS full_name FROM k UNION SELECT t FROM k""")  # fmt: skip
STATEMENTS = ("SELECT 1", "WITH x AS (SELECT 1) SELECT * FROM x", "DROP TABLE nodes", "INSERT INTO nodes SELECT * FROM nodes", "SELECT 'DROP TABLE x'", "CREATE TEMP VIEW v AS SELECT 1", "DELETE FROM nodes", "/* SELECT */ SET a = 1")


def _guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    def reads(text: str) -> bool:
        try:
            require_read_only(spark, text)
        except ValueError:
            return False
        return True

    return spark.createDataFrame([(k, reads(x)) for k, x in enumerate(STATEMENTS)], "k long, allowed boolean")


on_tables("guarded_statements", _guarded, "SELECT unnest(range(8)) AS k, unnest([true, true, false, false, true, false, false, false]) AS allowed")
