"""SQL (DuckDB) that builds the same graph as sources.star, for checks against an independent engine."""

from __future__ import annotations

import re

# Fixed values, written out here once more so that this side takes nothing from the code it checks.
TEST = (
    r"(?:.*[/\\][A-Za-z0-9.]*[Tt]ests?[/\\].*|.*[/\\]__tests__[/\\].*|.*[/\\]test-[A-Za-z0-9_-]+[/\\].*"
    r"|.*\.(?:test|spec)\.[jt]sx?$|.*_test\.[a-z]+$|.*[/\\]src[/\\]test[/\\].*)"
)
VENDORED = (
    r"(?:.*[/\\]node_modules[/\\].*|.*[/\\]vendor[/\\].*|.*[/\\]third_party[/\\].*|.*[/\\]\.gradle[/\\].*|.*[/\\]bower_components[/\\].*"
    r"|.*[/\\]static[/\\](?:js|lib|libs)[/\\].*|.*\.min\.[jt]sx?$|.*\.bundle\.[jt]sx?$|.*\.chunk\.[jt]sx?$"
    r"|.*[/\\](?:angular|vue|react|jquery|bootstrap|lodash|moment|axios)(?:-[\d.]+)?(?:\.min)?\.js$)"
)
#: Of the lists of names those that the star schema's methods and classes can have.
METHODS_OF_FRAMEWORKS = ("main", "service", "init", "destroy")
ATTRIBUTES_OF_FRAMEWORKS = ("HttpGet", "HttpPost", "HttpPut", "HttpDelete", "HttpPatch", "Fact", "override")
CLASSES_OF_FRAMEWORKS = ("service", "ApiController")
CLASSES_OF_ENTITIES = ("entity",)
REPOSITORY_METHODS = ("save", "saveAll", "saveAndFlush", "findById", "findAll", "findAllById", "existsById", "count", "delete", "deleteAll", "deleteById",
                      "deleteAllById", "deleteAllInBatch", "deleteInBatch", "flush", "getOne", "getReferenceById")


def test(c: str) -> str:
    return f"regexp_full_match({c}, '{TEST}')"


def vendored(c: str) -> str:
    return f"regexp_full_match({c}, '{VENDORED}')"


def attribute(c: str, names) -> str:
    return "(" + " OR ".join(f"contains(coalesce({c}, '[]'), '\"{n}\"')" for n in names) + ")"


def levels(start: str, edges: str, most: int, reverse: bool = False, path: str | None = None) -> str:
    """CTEs up to lv (node, depth and, with ``path``, path): nodes by the least number of hops from the rows of ``start`` (node, path), level by level."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    more = f", {path.format(node='z.' + b)} AS path" if path else ""
    out = [f"l0 AS MATERIALIZED (SELECT * FROM {start})"]
    for k in range(1, most + 1):
        known = "".join(f" AND z.{b} NOT IN (SELECT node FROM l{j})" for j in range(1, k))
        out.append(f"l{k} AS MATERIALIZED (SELECT z.{b} AS node{more} FROM l{k - 1} JOIN {edges} z ON z.{a} = node WHERE true{known} GROUP BY z.{b})")
    columns = "node, path" if path else "node"
    return ", " + ", ".join(out) + ", lv AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {columns}, {k} AS depth FROM l{k}" for k in range(1, most + 1)) + ") "


GRAPH = f"""
WITH RECURSIVE
f AS MATERIALIZED (SELECT s_suppkey, '/' || r_name AS repo, '/' || r_name || '/' || n_name AS dir,
    replace(s_name, '#', '_') || ['.py', '.java', '.cs', '.ts'][s_suppkey % 4 + 1] AS name,
    '/' || r_name || '/' || n_name || '/' || CASE WHEN s_suppkey % 5 = 0 THEN 'tests/' WHEN s_suppkey % 11 = 7 THEN 'vendor/' ELSE '' END
      || replace(s_name, '#', '_') || ['.py', '.java', '.cs', '.ts'][s_suppkey % 4 + 1] AS path,
    ['python', 'java', 'csharp', 'typescript'][s_suppkey % 4 + 1] AS language
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
p0 AS (SELECT p_partkey AS k, p_brand, p_type, p_size, p_brand || '.' || p_type AS class_name,
    CASE WHEN p_partkey % 50 = 7 THEN p_type WHEN p_partkey % 97 = 5 THEN 'main' WHEN p_partkey % 19 = 3 THEN 'get' || (p_partkey // 8)
      WHEN p_partkey % 59 = 11 THEN 'configure' ELSE 'm' || (p_partkey // 8) END AS method_name,
    p_partkey % (SELECT count(*) FROM supplier) AS s FROM part),
p AS MATERIALIZED (SELECT p0.*, class_name || '.' || method_name AS method, path, language FROM p0 JOIN f ON s = s_suppkey),
c AS MATERIALIZED (SELECT p_brand, p_type, class_name, min(k) AS k, arg_min(path, k) AS path, arg_min(language, k) AS language FROM p GROUP BY ALL),
m AS MATERIALIZED (SELECT class_name, method_name, method, min(k) AS k, arg_min(p_size, k) AS p_size, arg_min(path, k) AS path, arg_min(language, k) AS language FROM p GROUP BY class_name, method_name, method),
types AS (SELECT DISTINCT p_type FROM c),
shared AS (SELECT DISTINCT p_type, method_name FROM p WHERE method_name LIKE 'm%' AND method_name <> 'main' AND (k // 8) % 5 = 0),
routes AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([a-z]+)', 1) AS seg, p.method FROM pages JOIN p ON p.k = (page_id * 3) % (SELECT count(*) FROM part)
  WHERE regexp_extract(url, '^https?://[^/]+/([a-z]+)', 1) <> ''),
defs AS (SELECT CASE WHEN page_id % 3 = 0 THEN '/api' ELSE '' END || '/' || seg || '/{{id}}' AS route, ['GET', 'POST', 'PUT', 'DELETE'][(page_id // 2) % 4 + 1] AS http_method,
  method AS handler, page_id AS def_ord FROM routes WHERE page_id % 2 = 0),
ccalls AS (SELECT ['{{baseUrl}}/' || seg || '/{{x}}', '/' || seg || '/{{pid}}', '/' || seg || '/list', '/api/' || seg || '/{{q}}', '/v9/' || seg || '/{{q}}'][page_id % 5 + 1] AS route,
  ['GET', 'POST', 'PUT', 'DELETE'][(page_id // 2) % 4 + 1] AS http_method, method AS caller, page_id::INTEGER AS line, 0 AS col, page_id AS call_ord FROM routes WHERE page_id % 2 = 1),
dshape AS (SELECT http_method, regexp_replace(regexp_replace(route, '\\{{[^}}]+\\}}', '{{}}', 'g'), '^/', '') AS shape, arg_min(route, def_ord) AS ep_route, arg_min(handler, def_ord) AS handler, min(def_ord) AS def_ord
  FROM defs GROUP BY ALL),
tried AS (SELECT call_ord, http_method, t.pos, regexp_replace(regexp_replace(t.prefix || regexp_replace(route, '^\\{{[^}}]+\\}}/', '/'), '\\{{[^}}]+\\}}', '{{}}', 'g'), '^/', '') AS shape
  FROM ccalls, (VALUES (0, ''), (1, '/api'), (2, '/api/v1'), (3, '/api/v2')) t(pos, prefix)),
hits AS (SELECT call_ord, arg_min(ep_route, pos) AS ep_route, arg_min(handler, pos) AS handler, arg_min(def_ord, pos) AS def_ord FROM tried JOIN dshape USING (http_method, shape) GROUP BY call_ord),
matched AS MATERIALIZED (SELECT ccalls.*, coalesce(ep_route, route) AS ep_route, ep_route IS NOT NULL AS matched, handler, def_ord FROM ccalls LEFT JOIN hits USING (call_ord)),
eps AS (SELECT http_method, route FROM defs UNION SELECT http_method, ep_route FROM matched),
n AS MATERIALIZED (
  SELECT 'Repository:/' || r_name AS id, 'Repository' AS label, NULL::VARCHAR AS full_name, r_name AS name, '/' || r_name AS path, NULL::VARCHAR AS file_path, NULL::INTEGER AS line, NULL::INTEGER AS end_line,
    NULL::VARCHAR AS language, NULL::VARCHAR AS signature, NULL::VARCHAR AS type_name, NULL::VARCHAR AS attributes, NULL::VARCHAR AS external_bases, NULL::BOOLEAN AS is_abstract, NULL::BOOLEAN AS is_static,
    NULL::BOOLEAN AS stub, NULL::VARCHAR AS summary, NULL::VARCHAR AS route, NULL::VARCHAR AS http_method FROM region
  UNION ALL SELECT DISTINCT 'Directory:' || dir, 'Directory', NULL, split_part(dir, '/', 3), dir, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM f
  UNION ALL SELECT 'File:' || path, 'File', NULL, name, path, path, NULL, NULL, language, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM f
  UNION ALL SELECT DISTINCT 'Package:' || p_brand, 'Package', p_brand, p_brand, NULL, NULL, NULL::INTEGER, NULL::INTEGER, NULL, NULL, NULL, NULL, NULL, NULL::BOOLEAN, NULL::BOOLEAN, NULL::BOOLEAN, NULL, NULL, NULL FROM p
  UNION ALL SELECT 'Class:' || class_name, 'Class', class_name, p_type, NULL, path, 1, 500, language, NULL, NULL,
    CASE k % 10 WHEN 0 THEN '["service"]' WHEN 1 THEN '["ApiController"]' WHEN 2 THEN '["entity"]' ELSE '[]' END, CASE WHEN k % 13 = 5 THEN '["ext.Base"]' ELSE '[]' END, NULL, NULL, NULL, NULL, NULL, NULL FROM c
  UNION ALL SELECT 'Interface:api.' || p_type, 'Interface', 'api.' || p_type, 'I' || p_type, NULL, '/api/' || p_type || CASE WHEN length(p_type) % 2 = 0 THEN '.py' ELSE '.java' END, 1, 99,
    CASE WHEN length(p_type) % 2 = 0 THEN 'python' ELSE 'java' END, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM types
  UNION ALL SELECT 'Method:' || method, 'Method', method, method_name, NULL, CASE WHEN k % 41 = 0 THEN '' ELSE path END, p_size, p_size + 10, language, method_name || '()', NULL,
    CASE k % 16 WHEN 0 THEN '["HttpGet"]' WHEN 1 THEN '["test"]' WHEN 2 THEN '["override"]' WHEN 3 THEN '["Fact"]' WHEN 4 THEN '["virtual"]' WHEN 5 THEN '["HttpGetAsync"]' WHEN 6 THEN NULL ELSE '[]' END,
    NULL, k % 23 = 0, k % 3 = 0, k % 41 = 0, CASE WHEN k % 100 = 0 THEN 'about ' || method END, NULL, NULL FROM m
  UNION ALL SELECT 'Method:api.' || p_type || '.' || method_name, 'Method', 'api.' || p_type || '.' || method_name, method_name, NULL,
    '/api/' || p_type || CASE WHEN length(p_type) % 2 = 0 THEN '.py' ELSE '.java' END, 5, 6, CASE WHEN length(p_type) % 2 = 0 THEN 'python' ELSE 'java' END, method_name || '()', NULL, '[]', NULL, false, false, false, NULL, NULL, NULL FROM shared
  UNION ALL SELECT 'Field:' || class_name || '.f' || k, 'Field', class_name || '.f' || k, 'f' || k, NULL, path, p_size, p_size, language, NULL, CASE WHEN k % 10 = 0 THEN 'api.' || p_type ELSE '' END,
    CASE WHEN k % 20 = 0 THEN 'not json' WHEN k % 15 = 0 THEN '["autowired","lazy"]' END, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM p
  UNION ALL SELECT 'Endpoint:' || http_method || ' ' || route, 'Endpoint', NULL, http_method || ' ' || route, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, route, http_method FROM eps
),
l AS (SELECT l_orderkey, l_linenumber, l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS next FROM lineitem),
pair AS (SELECT l.*, a.method AS am, b.method AS bm, regexp_extract(a.p_brand, '(\\d+)$', 1)::INTEGER <= regexp_extract(b.p_brand, '(\\d+)$', 1)::INTEGER AS ahead FROM l JOIN p a ON a.k = l_partkey JOIN p b ON b.k = next),
calls AS MATERIALIZED (SELECT CASE WHEN ahead THEN am ELSE bm END AS caller, CASE WHEN ahead THEN bm ELSE am END AS callee, list_sort(list(DISTINCT (l_orderkey::INTEGER, l_linenumber::INTEGER))) AS sites FROM pair GROUP BY 1, 2),
refs AS (SELECT a.*, b.class_name AS other_class, b.p_brand AS other_brand FROM p a JOIN p b ON b.k = (a.k * 7 + 3) % (SELECT count(*) FROM part)),
inh AS (SELECT 'Class:' || a.class_name AS src, 'Class:' || b.class_name AS dst FROM c a JOIN c b ON b.p_type = a.p_type
    AND b.p_brand = 'Brand#' || (regexp_extract(a.p_brand, '(\\d+)$', 1)::INTEGER // 2) WHERE regexp_extract(a.p_brand, '(\\d+)$', 1)::INTEGER >= 2
  UNION ALL SELECT 'Interface:api.' || p_type, 'Interface:api.' || before FROM (SELECT p_type, lag(p_type) OVER (ORDER BY p_type) AS before FROM types) WHERE before IS NOT NULL),
inhc(a, b) AS (SELECT src, dst FROM inh UNION SELECT inhc.a, inh.dst FROM inhc JOIN inh ON inhc.b = inh.src),
impl0 AS (SELECT 'Class:' || class_name AS src, 'Interface:api.' || p_type AS dst FROM c),
impl AS MATERIALIZED (SELECT * FROM impl0 UNION SELECT i.src, x.b FROM impl0 i JOIN inhc x ON x.a = i.dst),
con AS MATERIALIZED (
  SELECT DISTINCT 'Repository:' || repo AS src, 'Directory:' || dir AS dst FROM f
  UNION ALL SELECT 'Directory:' || dir, 'File:' || path FROM f
  UNION ALL SELECT 'File:' || path, 'Class:' || class_name FROM c
  UNION ALL SELECT 'Package:' || p_brand, 'Class:' || class_name FROM c
  UNION ALL SELECT 'Class:' || class_name, 'Method:' || method FROM m
  UNION ALL SELECT 'Interface:api.' || p_type, 'Method:api.' || p_type || '.' || method_name FROM shared
  UNION ALL SELECT 'Class:' || class_name, 'Field:' || class_name || '.f' || k FROM p
  UNION ALL SELECT (SELECT min('Repository:/' || r_name) FROM region), 'Endpoint:' || http_method || ' ' || route FROM eps),
mem AS MATERIALIZED (SELECT con.src AS owner, o.label AS olabel, con.dst AS method, x.name, x.is_abstract FROM con JOIN n x ON x.id = con.dst AND x.label = 'Method' JOIN n o ON o.id = con.src),
mimpl AS MATERIALIZED (SELECT DISTINCT a.method AS src, b.method AS dst FROM impl JOIN mem a ON a.owner = impl.src JOIN mem b ON b.owner = impl.dst AND b.name = a.name),
need AS (SELECT owner, count(*) AS k FROM mem JOIN n ON n.id = owner AND n.language = 'python' WHERE olabel = 'Interface' GROUP BY owner),
struc AS (SELECT a.owner AS cls, b.owner AS ifc FROM mem a JOIN mem b ON a.name = b.name AND a.olabel = 'Class' JOIN need ON need.owner = b.owner
  WHERE NOT EXISTS (SELECT 1 FROM impl WHERE impl.src = a.owner AND impl.dst = b.owner) GROUP BY a.owner, b.owner, need.k HAVING count(*) = need.k),
disp AS MATERIALIZED (SELECT dst AS src, src AS dst FROM mimpl
  UNION SELECT pm.method, cm.method FROM inh JOIN mem pm ON pm.owner = inh.dst AND pm.olabel = 'Class' AND pm.is_abstract JOIN mem cm ON cm.owner = inh.src AND cm.olabel = 'Class' AND cm.name = pm.name
  UNION SELECT b.method, a.method FROM struc JOIN mem a ON a.owner = cls JOIN mem b ON b.owner = ifc AND a.name = b.name),
ovr AS MATERIALIZED (SELECT DISTINCT cm.method AS src, pm.method AS dst FROM inhc JOIN mem cm ON cm.owner = inhc.a AND cm.olabel = 'Class' JOIN mem pm ON pm.owner = inhc.b AND pm.olabel = 'Class' AND pm.name = cm.name WHERE cm.method <> pm.method),
tst AS MATERIALIZED (SELECT 'Method:' || caller AS src, 'Method:' || callee AS dst FROM calls JOIN n a ON a.id = 'Method:' || caller JOIN n b ON b.id = 'Method:' || callee
  WHERE {test('a.file_path')} AND NOT {test('b.file_path')} AND CASE a.language WHEN 'python' THEN starts_with(a.name, 'test_') WHEN 'typescript' THEN true
    WHEN 'csharp' THEN {attribute('a.attributes', ('Fact', 'Theory', 'TestMethod', 'DataTestMethod', 'Test', 'TestCase'))} WHEN 'java' THEN {attribute('a.attributes', ('test',))} ELSE false END),
typed AS MATERIALIZED (
  SELECT DISTINCT 'Method:' || method AS src, 'Class:' || other_class AS dst, 'REFERENCES' AS type, ['parameter', 'return_type', 'property_type', 'field_type'][p_size % 4 + 1] AS kind FROM refs
  UNION ALL SELECT 'Field:' || class_name || '.f' || k, 'Interface:api.' || p_type, 'REFERENCES', 'field_type' FROM p WHERE k % 10 = 0),
e AS MATERIALIZED (
  SELECT src, dst, 'CONTAINS' AS type, NULL::VARCHAR AS kind, 0 AS n_sites FROM con
  UNION ALL SELECT src, dst, 'INHERITS', NULL, 0 FROM inh
  UNION ALL SELECT src, dst, 'IMPLEMENTS', NULL, 0 FROM impl
  UNION ALL SELECT src, dst, 'IMPLEMENTS', NULL, 0 FROM mimpl
  UNION ALL SELECT src, dst, 'DISPATCHES_TO', NULL, 0 FROM disp
  UNION ALL SELECT src, dst, 'OVERRIDES', NULL, 0 FROM ovr
  UNION ALL SELECT src, dst, 'TESTS', NULL, 0 FROM tst
  UNION ALL SELECT 'Method:' || caller, 'Method:' || callee, 'CALLS', NULL, len(sites) FROM calls
  UNION ALL SELECT src, dst, type, kind, 0 FROM typed
  UNION ALL SELECT DISTINCT 'File:' || path, 'Package:' || other_brand, 'IMPORTS', NULL, 0 FROM refs
  UNION ALL SELECT 'Method:' || handler, 'Endpoint:' || http_method || ' ' || route, 'SERVES', NULL, 0 FROM (SELECT http_method, route, arg_min(handler, def_ord) AS handler FROM defs GROUP BY ALL)
  UNION ALL SELECT 'Method:' || caller, 'Endpoint:' || http_method || ' ' || ep_route, 'HTTP_CALLS', NULL, count(*) FROM matched GROUP BY ALL),
call AS MATERIALIZED (SELECT 'Method:' || caller AS src, 'Method:' || callee AS dst FROM calls),
tgt AS (SELECT dst AS id, substr(dst, 8) AS fn FROM call GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1),
sta AS (SELECT src AS id, substr(src, 8) AS fn FROM call GROUP BY src ORDER BY count(*) DESC, src LIMIT 1),
cls AS (SELECT 'Class:' || regexp_replace(fn, '\\.[^.]+$', '') AS id, regexp_replace(fn, '\\.[^.]+$', '') AS fn FROM tgt),
ifc AS (SELECT 'Interface:api.' || split_part(fn, '.', 2) AS id, 'api.' || split_part(fn, '.', 2) AS fn FROM cls),
goal AS (SELECT id FROM tgt UNION SELECT dst FROM e JOIN tgt ON e.src = tgt.id WHERE type = 'IMPLEMENTS')
"""


_HEADS = re.compile(r"^(\w+)(?:\([^)]*\))? AS (?:MATERIALIZED )?\(", re.MULTILINE)


def over_graph(sql: str) -> str:
    """``sql`` behind those tables of GRAPH that it uses, by itself or through others."""
    heads = list(_HEADS.finditer(GRAPH))
    ends = [m.start() for m in heads[1:]] + [len(GRAPH)]
    tables = {m[1]: GRAPH[m.start() : end].strip().removesuffix(",") for m, end in zip(heads, ends, strict=True)}
    words = lambda text: set(re.findall(r"\w+", re.sub(r"'(?:[^']|'')*'", "", text)))
    wanted, new = set(), words(sql) & set(tables)
    while new:
        wanted |= new
        new = {w for name in new for w in words(tables[name])} & set(tables) - wanted
    return "WITH RECURSIVE\n" + ",\n".join(x for name, x in tables.items() if name in wanted) + "\n" + sql
