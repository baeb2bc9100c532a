"""The questions of the code graph over the given tables: the graph is built once a session and read back pruned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.types import BUILT_IN_TYPES
from graphloom.operators import code_graph, domains, graph, graph_tools
from graphloom.plans import graph_queries as g
from graphloom.plans.corpus_core import json_nodes
from graphloom.plans.resolve_queries import CALLERS, CASCADE
from graphloom.session import scratch_dir, table
from graphloom.sources.store import GraphStore

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
_SOURCES = ("symbols", "classes", "calls", "parsed_properties", "class_bodies", "index_runs", "external_types")
_STORES: dict[tuple, GraphStore] = {}
CONFIGURED = [("Core", ["com.talus.*.*", "com.umbra.**"])]


def _stamp(spark: SparkSession, d: str) -> tuple:
    """Sizes and times of the tables' files, so that a changed table is read anew."""
    out = []
    for name in _SOURCES:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
        s = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
        out.append((name, s.getLen(), s.getModificationTime()))
    return tuple(out)


def graph_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the tables in a folder, from a store in the shared folder that the session's first question writes."""
    key = (spark.sparkContext.applicationId, d, _stamp(spark, d))
    if key not in _STORES:
        t = {n: table(spark, d, n) for n in _SOURCES}
        projects = t["index_runs"].select(F.col("project_path").alias("path")).distinct()
        nodes, edges = code_graph.build_graph(t["symbols"], t["classes"], t["calls"], t["parsed_properties"], t["class_bodies"], projects, t["external_types"], CONFIGURED)
        store = GraphStore(spark, f"{scratch_dir(spark)}/graphloom-graph-{len(_STORES)}-{spark.sparkContext.applicationId}")
        store.write(nodes, edges)
        _STORES[key] = store
    return _STORES[key].nodes().select(*code_graph.NODE_COLUMNS), _STORES[key].edges().select(*code_graph.EDGE_COLUMNS)


# ---- SQL of the whole graph ----

_BUILT_IN = ", ".join(f"'{t}'" for t in BUILT_IN_TYPES)
_TYPES_IN = lambda c: rf"list_distinct([x FOR x IN regexp_extract_all(replace({c}, '?', ''), '\b[A-Z][a-zA-Z0-9]*\b') IF x NOT IN ({_BUILT_IN})])"
_MODULE = r"nullif(regexp_replace(regexp_replace(substr(file_path, length(project) + 2), '(^|/)[^/]*$', ''), '^((src|lib|app|source|sources)(/|$))+', ''), '')"
_DOM = g.domain_sql("package")
_BODY = json_nodes("class_fqn").replace("FROM class_bodies", "FROM class_bodies WHERE class_fqn IS NOT NULL").replace("newest", "bnewest")
_BY_NAME = lambda name, refs: g.resolved_sql(name, refs, [("Class", "name"), ("Interface", "name")])
GRAPH = rf"""{CASCADE}, {CALLERS}, {g.NODES}, {g.EXTENDS}, {g.IMPLEMENTS}, {g.DECLARES},
 calls_r AS (SELECT from_fqn AS src, to_fqn AS dst, count(*) AS n FROM callers JOIN resolved USING (call_id) WHERE to_fqn IN (SELECT fqn FROM symbols WHERE kind = 'function') GROUP BY 1, 2),
 fo AS (SELECT fqn, arg_max(param_types, ins_seq) AS params, arg_max(receiver_type, ins_seq) AS receiver FROM symbols WHERE kind = 'function' AND fqn IS NOT NULL GROUP BY 1),
 ur AS (SELECT fqn AS src, ref, min(prio) AS prio FROM (SELECT fqn, unnest({_TYPES_IN('p')}) AS ref, 0 AS prio FROM (SELECT fqn, unnest(params) AS p FROM fo) UNION ALL SELECT fqn, unnest({_TYPES_IN('receiver')}), 1 FROM fo) GROUP BY 1, 2),
 {_BY_NAME('used', 'SELECT DISTINCT ref AS src, ref FROM ur')},
 uses_e AS (SELECT ur.src, used.dst, CASE WHEN min(prio) = 0 THEN 'parameter' ELSE 'receiver' END AS context FROM ur JOIN used ON used.src = ur.ref GROUP BY 1, 2),
 pj AS (SELECT DISTINCT project_path AS path FROM index_runs WHERE project_path IS NOT NULL),
 tops AS (SELECT fqn, arg_max(kind, ins_seq) AS kind, arg_max(package_name, ins_seq) AS package_name, arg_max(parent_fqn, ins_seq) AS parent_fqn, arg_max(declaring_type_fqn, ins_seq) AS dt, arg_max(file_path, ins_seq) AS file_path FROM symbols WHERE fqn IS NOT NULL GROUP BY 1),
 tp1 AS (SELECT tops.*, (SELECT max(path) FROM pj WHERE starts_with(file_path, path || '/')) AS project, {g.REF('parent_fqn')} IS NULL AND {g.REF('dt')} IS NULL AS top FROM tops WHERE kind IS NOT NULL),
 tp2 AS (SELECT *, CASE WHEN package_name IS NULL AND regexp_matches(lower(file_path), '\.(ts|tsx|js|jsx|mjs|cjs)$') THEN {_MODULE} END AS module FROM tp1),
 md AS (SELECT DISTINCT project, array_to_string(string_split(module, '/')[1:i], '/') AS path FROM (SELECT project, module, unnest(range(1, len(string_split(module, '/')) + 1)) AS i FROM tp2 WHERE module IS NOT NULL)),
 contains_e AS (SELECT DISTINCT 'project:' || project AS src, 'package:' || package_name AS dst FROM tp2 WHERE project IS NOT NULL AND package_name IS NOT NULL
  UNION SELECT 'package:' || package_name, fqn FROM tp2 WHERE top AND package_name IS NOT NULL
  UNION SELECT CASE WHEN contains(path, '/') THEN 'module:' || project || ':' || regexp_replace(path, '/[^/]*$', '') ELSE 'project:' || project END, 'module:' || project || ':' || path FROM md
  UNION SELECT 'module:' || project || ':' || module, fqn FROM tp2 WHERE top AND module IS NOT NULL),
 {_BODY},
 bo AS (SELECT concat_ws('.', record_id, names) AS fqn, concat_ws('.', record_id, owner) AS own, kind, j, coalesce(try_cast(regexp_extract(path, '\[(\d+)\]$', 1) AS INTEGER), 0) AS position FROM n WHERE kind <> 'body'),
 bp AS (SELECT own AS src, own || '#' || position || ':' || coalesce(j ->> '$.name', '') AS dst, position, j ->> '$.name' AS name FROM bo WHERE kind = 'parameter'),
 ba AS (SELECT DISTINCT fqn AS src, '@' || (a ->> '$.name') AS dst FROM (SELECT fqn, unnest(CASE json_type(v) WHEN 'ARRAY' THEN CAST(v AS JSON[]) WHEN 'OBJECT' THEN [v] END) AS a
  FROM (SELECT fqn, CASE json_type(x) WHEN 'VARCHAR' THEN TRY_CAST(x ->> '$' AS JSON) ELSE x END AS v FROM (SELECT fqn, json_extract(j, '$.annotations') AS x FROM bo WHERE kind = 'function'))) WHERE a ->> '$.name' IS NOT NULL),
 {_BY_NAME('returns_e', f"SELECT DISTINCT src, ref FROM (SELECT fqn AS src, unnest({_TYPES_IN('rt')}) AS ref FROM (SELECT fqn, j ->> '$.returnType' AS rt FROM bo WHERE kind = 'function'))")},
 pd AS (SELECT package, CASE WHEN regexp_matches(package, '^com\.talus\.[^.]*\.[^.]*$|^com\.umbra\..*$') THEN 'Core' ELSE upper({_DOM}[1]) || {_DOM}[2:] END AS domain FROM (SELECT DISTINCT package_name AS package FROM symbols WHERE package_name IS NOT NULL)),
 plan AS (SELECT * FROM pd WHERE domain <> '' AND (domain = 'Core' OR lower(domain) <> 'core')),
 weights AS (SELECT x.domain AS from_domain, y.domain AS to_domain, sum(n)::BIGINT AS weight FROM (SELECT {g.PKG.replace('fqn', 'src')} AS a, {g.PKG.replace('fqn', 'dst')} AS b, n FROM calls_r) JOIN plan x ON x.package = a JOIN plan y ON y.package = b WHERE x.domain <> y.domain GROUP BY 1, 2),
 ge AS (SELECT 'EXTENDS' AS rel_type, src, dst, NULL::BIGINT AS n, NULL AS context FROM extends_e UNION ALL SELECT 'IMPLEMENTS', src, dst, NULL, NULL FROM implements_e
  UNION ALL SELECT 'DECLARES', src, dst, NULL, NULL FROM (SELECT src, dst FROM declares_e UNION SELECT own, fqn FROM bo WHERE kind NOT IN ('class', 'parameter'))
  UNION ALL SELECT 'CALLS', src, dst, n, NULL FROM calls_r UNION ALL SELECT 'USES', src, dst, NULL, context FROM uses_e UNION ALL SELECT 'CONTAINS', src, dst, NULL, NULL FROM contains_e
  UNION ALL SELECT 'HAS_PARAMETER', src, dst, min(position), NULL FROM bp GROUP BY src, dst UNION ALL SELECT 'ANNOTATED_WITH', src, dst, NULL, NULL FROM ba UNION ALL SELECT 'RETURNS', src, dst, NULL, NULL FROM returns_e
  UNION ALL SELECT 'OWNS', 'domain:' || domain, 'package:' || package, NULL, NULL FROM plan UNION ALL SELECT 'DEPENDS_ON', 'domain:' || from_domain, 'domain:' || to_domain, weight, NULL FROM weights),
 bn AS (SELECT CASE kind WHEN 'companion' THEN 'Object' WHEN 'class' THEN CASE coalesce(j ->> '$.kind', 'class') WHEN 'enum' THEN 'Class' WHEN 'annotation' THEN 'Class' WHEN 'interface' THEN 'Interface' WHEN 'object' THEN 'Object' ELSE 'Class' END
   WHEN 'function' THEN 'Function' WHEN 'property' THEN 'Property' ELSE 'Constructor' END AS label, fqn AS key, CASE kind WHEN 'companion' THEN coalesce(j ->> '$.name', 'Companion') WHEN 'constructor' THEN NULL ELSE j ->> '$.name' END AS name,
   CASE WHEN kind <> 'class' THEN own END AS declaring_type, j ->> '$.visibility' AS visibility FROM bo WHERE kind <> 'parameter'
  UNION ALL SELECT 'Parameter', dst, name, NULL, NULL FROM bp UNION ALL SELECT DISTINCT 'Annotation', dst, dst, NULL, NULL FROM ba),
 gn AS (SELECT label, key, name, file_path, line_number, declaring_type, package_name, visibility FROM nodes
  UNION ALL SELECT label, key, min(name), NULL, NULL, min(declaring_type), NULL, min(visibility) FROM bn WHERE key NOT IN (SELECT key FROM nodes) GROUP BY label, key
  UNION ALL SELECT 'Project', 'project:' || path, regexp_extract(path, '[^/]*$'), NULL, NULL, NULL, NULL, NULL FROM pj UNION ALL SELECT DISTINCT 'Package', 'package:' || package_name, package_name, NULL, NULL, NULL, NULL, NULL FROM tp2 WHERE package_name IS NOT NULL
  UNION ALL SELECT 'Module', 'module:' || project || ':' || path, regexp_extract(path, '[^/]*$'), NULL, NULL, NULL, NULL, NULL FROM md UNION ALL SELECT DISTINCT 'Domain', 'domain:' || domain, domain, NULL, NULL, NULL, NULL, NULL FROM plan)"""
#: The name of the node that most edges of a type lead to (or come from), the first in order of equal ones.
_MOST = "(SELECT name FROM ge JOIN gn ON key = {end} WHERE rel_type = '{rel}' AND name IS NOT NULL GROUP BY name ORDER BY count(*) DESC, name LIMIT 1)"


def _most(nodes: DataFrame, edges: DataFrame, rel: str, end: str) -> str:
    n = edges.where(F.col("rel_type") == rel).join(nodes.where("name is not null").select(F.col("key").alias(end), "name"), end)
    first = n.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").first()
    return first.name if first else ""


def query(sql: str | None = None):
    """Registers a query under the function's name; its SQL goes on after the tables gn (nodes) and ge (edges)."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH RECURSIVE {GRAPH}{sql if sql.startswith(',') else ' ' + sql}"
        return f

    return add


@query("SELECT * FROM gn")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    """All nodes of the graph."""
    return graph_of(spark, d)[0]


@query("SELECT * FROM ge")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """All edges of the graph."""
    return graph_of(spark, d)[1]


_LABELS, _RELS = (", ".join(f"'{x}'" for x in v) for v in (code_graph.STATUS_LABELS, code_graph.STATUS_TYPES))


@query(f"SELECT 'node' AS kind, label AS name, count(*) AS n FROM gn WHERE label IN ({_LABELS}) GROUP BY 2 UNION ALL SELECT 'relationship', rel_type, count(*) FROM ge WHERE rel_type IN ({_RELS}) GROUP BY 2")
def graph_status(spark: SparkSession, d: str) -> DataFrame:
    """Nodes by label and edges by type, for the eight labels and nine types of the status."""
    return graph_tools.status(*graph_of(spark, d), code_graph.STATUS_LABELS, code_graph.STATUS_TYPES)


@query("SELECT src, dst, n AS calls FROM ge WHERE rel_type = 'CALLS'")
def edges_calls(spark: SparkSession, d: str) -> DataFrame:
    """Resolved calls between functions, with their number."""
    return graph_of(spark, d)[1].where("rel_type = 'CALLS'").select("src", "dst", F.col("n").alias("calls"))


@query("SELECT src, dst, context FROM ge WHERE rel_type = 'USES'")
def edges_uses(spark: SparkSession, d: str) -> DataFrame:
    """Functions and the types of their parameters and receivers."""
    return graph_of(spark, d)[1].where("rel_type = 'USES'").select("src", "dst", "context")


@query("SELECT from_domain, to_domain, weight FROM weights")
def domain_deps(spark: SparkSession, d: str) -> DataFrame:
    """Resolved calls between domains, configured and inferred ones, with their number."""
    e = graph_of(spark, d)[1].where("rel_type = 'DEPENDS_ON'")
    return e.select(F.expr("substr(src, 8)").alias("from_domain"), F.expr("substr(dst, 8)").alias("to_domain"), F.col("n").alias("weight"))


@query("SELECT package, domain FROM plan")
def domain_plan(spark: SparkSession, d: str) -> DataFrame:
    """Packages with their domain: configured first, the rest inferred."""
    packages = table(spark, d, "symbols").select(F.col("package_name").alias("package")).where("package is not null").distinct()
    return domains.analyze_domains(packages, CONFIGURED)


def _ways(a: str, b: str, end: str, depth: int) -> str:
    """Ends of trails of calls from (or to) the functions of the busiest name."""
    return rf""", st AS (SELECT key AS start FROM gn WHERE label = 'Function' AND name = {_MOST.format(rel='CALLS', end=end)}), ca AS (SELECT src, dst FROM ge WHERE rel_type = 'CALLS'),
 tr AS (SELECT start, {b} AS node, 1 AS depth, [src || ' ' || dst] AS used FROM st JOIN ca ON ca.{a} = start UNION ALL SELECT start, ca.{b}, depth + 1, used || [src || ' ' || dst] FROM tr JOIN ca ON ca.{a} = tr.node WHERE depth < {depth} AND NOT list_contains(used, src || ' ' || dst)),
 tn AS (SELECT DISTINCT node, depth FROM tr WHERE node <> start),
 ow AS (SELECT dst, name AS class_name FROM ge JOIN gn ON key = src AND label IN ('Class', 'Interface', 'Object') WHERE rel_type = 'DECLARES')
 SELECT depth, class_name, f.name AS function_name, f.file_path, coalesce(f.line_number, 0) AS line_number FROM tn JOIN gn f ON f.key = node AND f.label = 'Function' LEFT JOIN ow ON ow.dst = node"""


def _calls_query(name: str, backwards: bool, depth: int):
    def f(spark: SparkSession, d: str) -> DataFrame:
        nodes, edges = graph_of(spark, d)
        tool, end = (graph_tools.get_callers, "dst") if backwards else (graph_tools.get_callees, "src")
        return tool(nodes, edges, _most(nodes, edges, "CALLS", end), depth=depth)

    f.__name__, f.__doc__ = name, f"{'Callers of the most called' if backwards else 'Callees of the most calling'} function over up to {depth} calls."
    query(_ways("dst", "src", "dst", depth) if backwards else _ways("src", "dst", "src", depth))(f)


for _name, _backwards, _depth in (("get_callers_d1", True, 1), ("get_callers_d2", True, 2), ("get_callers_d4", True, 4), ("get_callees_d1", False, 1), ("get_callees_d2", False, 2)):
    _calls_query(_name, _backwards, _depth)

_THROUGH = """, nb AS (SELECT src, dst, 0 AS prio FROM ge WHERE rel_type IN ('EXTENDS', 'IMPLEMENTS') UNION ALL SELECT DISTINCT x.src, y.dst, 1 FROM ge x JOIN ge y ON x.rel_type = 'DECLARES' AND y.rel_type = 'USES' AND y.src = x.dst WHERE x.src <> y.dst),
 nr AS (SELECT s.name AS sname, s.label AS slabel, s.file_path AS sfile, s.key AS skey, t.name AS tname, t.label AS tlabel, t.file_path AS tfile, t.key AS tkey, prio FROM nb JOIN gn s ON s.key = src AND s.label IN ('Class', 'Interface', 'Object') JOIN gn t ON t.key = dst AND t.label IN ('Class', 'Interface'))
"""
_OUT = "SELECT sname AS node_name, 'outgoing' AS direction, tname AS name, first(tlabel ORDER BY prio, tfile NULLS FIRST, tkey) AS type, 1 AS depth, first(tfile ORDER BY prio, tfile NULLS FIRST, tkey) AS file_path FROM nr WHERE {0} GROUP BY sname, tname"
_IN = "SELECT tname AS node_name, 'incoming' AS direction, sname AS name, first(slabel ORDER BY prio, sfile NULLS FIRST, skey) AS type, 1 AS depth, first(sfile ORDER BY prio, sfile NULLS FIRST, skey) AS file_path FROM nr WHERE {0} GROUP BY tname, sname"


@query(_THROUGH + _OUT.format("tfile IS NOT NULL"))
def get_neighbors_out(spark: SparkSession, d: str) -> DataFrame:
    """What every type depends on."""
    return graph_tools.get_neighbors(*graph_of(spark, d), direction="outgoing")


@query(_THROUGH + _IN.format("sfile IS NOT NULL"))
def get_neighbors_in(spark: SparkSession, d: str) -> DataFrame:
    """What depends on every type."""
    return graph_tools.get_neighbors(*graph_of(spark, d), direction="incoming")


_HUB = _MOST.format(rel="IMPLEMENTS", end="dst")


@query(f"{_THROUGH} {_OUT.format(f'sname = {_HUB}')} UNION ALL {_IN.format(f'tname = {_HUB}')}")
def get_neighbors_of(spark: SparkSession, d: str) -> DataFrame:
    """Both directions for the interface that most classes implement, external neighbours included."""
    nodes, edges = graph_of(spark, d)
    return graph_tools.get_neighbors(nodes, edges, _most(nodes, edges, "IMPLEMENTS", "dst"), include_external=True)


_IMPL = f""", im AS (SELECT e.src, e.dst FROM ge e JOIN gn c ON c.key = e.src AND c.label = 'Class' JOIN gn i ON i.key = e.dst AND i.label = 'Interface' AND i.name = {_HUB} WHERE rel_type = 'IMPLEMENTS'),
 ex AS (SELECT e.src, e.dst FROM ge e JOIN gn a ON a.key = e.src AND a.label = 'Class' JOIN gn b ON b.key = e.dst AND b.label = 'Class' WHERE rel_type = 'EXTENDS'),
 dn AS (SELECT ex.src, im.dst FROM im JOIN ex ON ex.dst = im.src UNION SELECT ex.src, dn.dst FROM dn JOIN ex ON ex.dst = dn.src),
 al AS (SELECT src, dst, 'direct' AS kind FROM im UNION ALL SELECT src, dst, 'indirect' FROM (SELECT src, dst FROM dn EXCEPT SELECT src, dst FROM im))
 SELECT dst AS interface_fqn, kind, name, src AS class_fqn, file_path, coalesce(line_number, 0) AS line_number FROM al JOIN gn ON key = src AND label = 'Class'"""


@query(_IMPL)
def get_implementations_of(spark: SparkSession, d: str) -> DataFrame:
    """Direct and inherited implementations of the interface that most classes implement."""
    nodes, edges = graph_of(spark, d)
    return graph_tools.get_implementations(nodes, edges, _most(nodes, edges, "IMPLEMENTS", "dst"), include_indirect=True)


def _impact_sql(rel: str) -> str:
    return f""", tg AS (SELECT key, label FROM gn WHERE name = {_MOST.format(rel=rel, end='dst')}),
 cl AS (SELECT g0.key AS start, e.src AS node, 1 AS depth FROM tg g0 JOIN ge e ON e.dst = g0.key AND e.rel_type = 'CALLS' WHERE g0.label = 'Function' UNION SELECT cl.start, e.src, depth + 1 FROM cl JOIN ge e ON e.dst = node AND e.rel_type = 'CALLS' WHERE depth < 3),
 kd AS (SELECT g0.key AS start, e.src AS node, 1 AS depth FROM tg g0 JOIN ge e ON e.dst = g0.key AND e.rel_type = 'EXTENDS' JOIN gn c ON c.key = e.src AND c.label = 'Class' WHERE g0.label = 'Class'
  UNION SELECT kd.start, e.src, depth + 1 FROM kd JOIN ge e ON e.dst = node AND e.rel_type = 'EXTENDS' JOIN gn c ON c.key = e.src AND c.label = 'Class' WHERE depth < 3),
 br AS (SELECT 1 AS branch, node AS key, 'caller' AS impact_type, min(depth) AS depth FROM cl WHERE node <> start GROUP BY node
  UNION ALL SELECT DISTINCT 2, x.src, 'dependent', 1 FROM ge x JOIN ge y ON y.src = x.dst AND y.rel_type = 'USES' JOIN tg ON tg.key = y.dst AND tg.label IN ('Class', 'Interface') WHERE x.rel_type = 'DECLARES' AND x.src <> y.dst
  UNION ALL SELECT DISTINCT 3, e.src, 'implementor', 1 FROM ge e JOIN tg ON tg.key = e.dst AND tg.label = 'Interface' WHERE e.rel_type = 'IMPLEMENTS' UNION ALL SELECT 4, node, 'child', min(depth) FROM kd GROUP BY node)
 SELECT branch, name, CASE branch WHEN 1 THEN 'function' WHEN 2 THEN label ELSE 'class' END AS type, impact_type, depth, file_path, coalesce(line_number, 0) AS line_number FROM br JOIN gn USING (key)
  WHERE label IN ('Function', 'Class', 'Interface', 'Object') AND (branch <> 1 OR label = 'Function') AND (branch <> 2 OR label <> 'Function') AND (branch < 3 OR label = 'Class')"""


def _impact_query(name: str, rel: str):
    def f(spark: SparkSession, d: str) -> DataFrame:
        nodes, edges = graph_of(spark, d)
        return graph_tools.get_impact(nodes, edges, _most(nodes, edges, rel, "dst"))

    f.__name__, f.__doc__ = name, f"What a change of the node that most {rel} edges lead to reaches, all branches."
    query(_impact_sql(rel))(f)


for _name, _rel in (("get_impact_function", "CALLS"), ("get_impact_interface", "IMPLEMENTS"), ("get_impact_class", "EXTENDS"), ("get_impact_used", "USES")):
    _impact_query(_name, _rel)

_PATH_TYPES = ["EXTENDS", "IMPLEMENTS", "DECLARES", "USES"]
_FROM, _TO = _MOST.format(rel="EXTENDS", end="src"), _MOST.format(rel="IMPLEMENTS", end="dst")


@query(
    f""", pe AS (SELECT DISTINCT rel_type, src, dst FROM ge WHERE rel_type IN ('EXTENDS', 'IMPLEMENTS', 'DECLARES', 'USES')), un AS (SELECT src AS a, dst AS b FROM pe WHERE src <> dst UNION SELECT dst, src FROM pe WHERE src <> dst),
 aim AS (SELECT key FROM gn WHERE name = {_TO}),
 wk AS (SELECT key AS start, key AS node, 0 AS depth, [key] AS path FROM gn WHERE name = {_FROM} UNION ALL SELECT start, b, depth + 1, path || [b] FROM (SELECT start, b, depth, first(path ORDER BY path) AS path FROM wk JOIN un ON a = node WHERE depth < 5 AND NOT list_contains(path, b) GROUP BY start, b, depth)),
 hit AS (SELECT path FROM wk JOIN aim ON key = node WHERE start <> node ORDER BY depth, path LIMIT 1), stp AS (SELECT i - 1 AS step, path[i] AS node, path[i + 1] AS nxt FROM (SELECT path, unnest(range(1, len(path) + 1)) AS i FROM hit))
 SELECT step::INTEGER AS step, name, lower(CASE WHEN label IN ('Class', 'Interface', 'Function', 'Property', 'Object', 'Package') THEN label ELSE 'unknown' END) AS type, file_path,
  (SELECT string_agg(DISTINCT rel_type, '|' ORDER BY rel_type) FROM pe WHERE (src = node AND dst = nxt) OR (src = nxt AND dst = node)) AS relationship FROM stp JOIN gn ON key = node"""
)
def find_path_named(spark: SparkSession, d: str) -> DataFrame:
    """A shortest path from the type with most superclasses to the interface that most classes implement, over four edge types."""
    nodes, edges = graph_of(spark, d)
    return graph_tools.find_path(nodes, edges, _most(nodes, edges, "EXTENDS", "src"), _most(nodes, edges, "IMPLEMENTS", "dst"), 5, _PATH_TYPES)
