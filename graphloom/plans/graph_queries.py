"""Queries of the code graph over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.types import BUILT_IN_TYPES, package_of_fqn, type_names
from graphloom.operators import domains, graph, traversal
from graphloom.session import table
from graphloom.sources import files, modules

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

# ---- SQL pieces shared by the oracles ----

_BLANKS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))"
_NM = lambda c: rf"regexp_replace(regexp_replace(trim({c}, {_BLANKS}), '^`(.*)`$', '\1'), '\(\)$', '')"
REF = lambda c: rf"nullif(trim(regexp_replace(trim(split_part({c}, '<', 1), {_BLANKS}), '\?$', ''), {_BLANKS}), '')"
_LABEL = "CASE WHEN kind IN ('class','enum','annotation') THEN 'Class' ELSE upper(kind[1]) || kind[2:] END"
NODES = f"""sym AS (SELECT fqn, arg_max(name, ins_seq) AS name, arg_max(kind, ins_seq) AS kind, arg_max(file_path, ins_seq) AS file_path,
  arg_max(line_number, ins_seq) AS line_number, arg_max(declaring_type_fqn, ins_seq) AS dt, arg_max(package_name, ins_seq) AS package_name,
  arg_max(super_class, ins_seq) AS super_class, arg_max(interfaces, ins_seq) AS interfaces FROM symbols WHERE fqn IS NOT NULL GROUP BY fqn),
 cls AS (SELECT fqn, arg_max(visibility, write_seq) AS visibility FROM classes WHERE fqn IS NOT NULL GROUP BY fqn),
 nodes AS (SELECT {_LABEL} AS label, sym.fqn AS key, name, file_path, line_number, {REF('dt')} AS declaring_type, package_name, visibility
  FROM sym LEFT JOIN cls ON sym.fqn = cls.fqn WHERE kind IS NOT NULL)"""
_OWNERS = "label IN ('Class','Interface','Object')"
_TIERS = lambda tiers: " UNION ALL ".join(f"SELECT {c} AS ref, key AS dst, {i} AS rank FROM nodes WHERE label = '{lab}' AND {c} IS NOT NULL" for i, (lab, c) in enumerate(tiers))


def resolved_sql(name: str, refs: str, tiers: list[tuple[str, str]]) -> str:
    return f"""{name}_refs AS ({refs}), {name}_t AS ({_TIERS(tiers)}), {name}_b AS (SELECT ref, min(rank) AS rank FROM {name}_t GROUP BY ref),
 {name} AS (SELECT DISTINCT r.src, t.dst FROM {name}_refs r JOIN {name}_t t ON r.ref = t.ref JOIN {name}_b b ON t.ref = b.ref AND t.rank = b.rank)"""


EXTENDS = resolved_sql("extends_e", f"SELECT fqn AS src, {REF('super_class')} AS ref FROM sym JOIN nodes n ON n.key = fqn WHERE {_OWNERS.replace('label', 'n.label')} AND super_class IS NOT NULL", [("Class", "key"), ("Class", "name"), ("Interface", "key"), ("Interface", "name")])
IMPLEMENTS = resolved_sql("implements_e", f"SELECT src, ref FROM (SELECT fqn AS src, {REF('i')} AS ref FROM (SELECT fqn, unnest(interfaces) AS i FROM sym JOIN nodes n ON n.key = fqn WHERE {_OWNERS.replace('label', 'n.label')})) WHERE ref IS NOT NULL", [("Interface", "key"), ("Interface", "name")])
DECLARES = f"declares_e AS (SELECT m.declaring_type AS src, m.key AS dst FROM nodes m JOIN nodes o ON o.key = m.declaring_type AND o.{_OWNERS} WHERE m.label IN ('Function','Property'))"
_KEY = lambda side: f"CASE WHEN {_NM(side + '_function_name')} <> '' THEN CASE WHEN {_NM(side + '_class_name')} <> '' THEN {_NM(side + '_class_name')} || '.' || {_NM(side + '_function_name')} ELSE {_NM(side + '_function_name')} END END"
_CALLS = f"calls_e AS (SELECT src, dst, count(*) AS calls FROM (SELECT DISTINCT call_id, {_KEY('caller')} AS src, {_KEY('callee')} AS dst FROM calls) WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY src, dst)"


def query(sql: str | None = None):
    """Registers a query under the function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.symbol_nodes(table(spark, d, "symbols"), table(spark, d, "classes"))


def _projects(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "index_runs").select(F.col("project_path").alias("path")).where("path is not null").distinct()


# ---- nodes, counts, search ----


@query(f"WITH {NODES} SELECT label, key, name, file_path, line_number, declaring_type, package_name, visibility FROM nodes")
def nodes_merged(spark: SparkSession, d: str) -> DataFrame:
    """All nodes of the graph, merged by key with per-property overlay."""
    return _nodes(spark, d)


@query(f"WITH {NODES} SELECT label, count(*) AS n FROM nodes GROUP BY label")
def status_labels(spark: SparkSession, d: str) -> DataFrame:
    """Nodes by label."""
    return _nodes(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH {NODES}, {EXTENDS}, {IMPLEMENTS}, {DECLARES}, {_CALLS} SELECT 'EXTENDS' AS rel_type, count(*) AS n FROM extends_e UNION ALL SELECT 'IMPLEMENTS', count(*) FROM implements_e UNION ALL SELECT 'DECLARES', count(*) FROM declares_e UNION ALL SELECT 'CALLS', count(*) FROM calls_e"
)
def status_rels(spark: SparkSession, d: str) -> DataFrame:
    """Edges by type."""
    s, n = table(spark, d, "symbols"), _nodes(spark, d)
    parts = {"EXTENDS": graph.extends(s, n), "IMPLEMENTS": graph.implements(s, n), "DECLARES": graph.declares(n), "CALLS": graph.call_edges(table(spark, d, "calls"))}
    counts = [e.agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("rel_type"), "n") for t, e in parts.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3]).where("n > 0")


def search_nodes(nodes: DataFrame, text: str, labels: list[str] | None = None, exact: bool = False, limit: int = 20, project: str | None = None) -> DataFrame:
    """Nodes by name: part of it in any case, or exactly by a regular expression; the first `limit` by name."""
    wanted = labels or ["Class", "Interface", "Function", "Property", "Object"]
    match = F.col("name").rlike(rf"\A(?:{text})\z") if exact else F.contains(F.lower("name"), F.lit(text.lower()))
    found = nodes.where(F.col("label").isin(wanted) & match)
    if project:
        found = found.where(F.col("file_path").startswith(project))
    out = found.select("name", "label", "file_path", F.coalesce("line_number", F.lit(0)).alias("line_number"), F.coalesce("visibility", F.lit("public")).alias("visibility"), "key")
    return out.orderBy("name", "file_path", "line_number", "key").limit(limit)


@query(
    f"WITH {NODES} SELECT name, label, file_path, coalesce(line_number, 0) AS line_number, coalesce(visibility, 'public') AS visibility, key FROM nodes WHERE lower(name) LIKE '%handler%' AND label IN ('Class','Interface','Function','Property','Object') ORDER BY name, file_path, line_number, key LIMIT 20"
)
def search_nodes_partial(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 nodes with `handler` in their name (the limit is the feature)."""
    return search_nodes(_nodes(spark, d), "handler")


@query(
    f"WITH {NODES} SELECT name, label, file_path, coalesce(line_number, 0) AS line_number, coalesce(visibility, 'public') AS visibility, key FROM nodes WHERE regexp_full_match(name, '[A-Z]\\w*(Store|Registry)') AND label IN ('Class','Interface') ORDER BY name, file_path, line_number, key LIMIT 100"
)
def search_nodes_exact(spark: SparkSession, d: str) -> DataFrame:
    """Classes and interfaces whose whole name matches an expression, the first 100."""
    return search_nodes(_nodes(spark, d), r"[A-Z]\w*(Store|Registry)", ["Class", "Interface"], exact=True, limit=100)


def file_symbols(nodes: DataFrame, path: str, include_private: bool = True) -> DataFrame:
    """Nodes of the files whose path is, or ends with, `path`."""
    found = nodes.where((F.col("file_path") == path) | F.col("file_path").endswith(path))
    if not include_private:
        found = found.where(F.col("visibility").isNull() | F.col("visibility").isin("public", "protected", "internal"))
    return found.select("file_path", "line_number", "label", "name", F.coalesce("visibility", F.lit("public")).alias("visibility"), "key")


_FILE = "SELECT file_path, line_number, label, name, coalesce(visibility, 'public') AS visibility, key FROM nodes WHERE file_path LIKE '%Store.kt'"


@query(f"WITH {NODES} {_FILE}")
def file_symbols_all(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of all files that end with Store.kt."""
    return file_symbols(_nodes(spark, d), "Store.kt")


@query(f"WITH {NODES} {_FILE} AND (visibility IS NULL OR visibility IN ('public','protected','internal'))")
def file_symbols_public(spark: SparkSession, d: str) -> DataFrame:
    """The same without private ones."""
    return file_symbols(_nodes(spark, d), "Store.kt", include_private=False)


@query("SELECT path FROM (SELECT DISTINCT project_path AS path FROM index_runs) WHERE starts_with('/srv/code/violet-shard/src/Main.kt', path)")
def validate_project(spark: SparkSession, d: str) -> DataFrame:
    """The indexed projects that hold a path."""
    return _projects(spark, d).where(F.lit("/srv/code/violet-shard/src/Main.kt").startswith(F.col("path")))


# ---- edges ----


@query(f"WITH {_CALLS} SELECT src, dst, calls FROM calls_e")
def call_names(spark: SparkSession, d: str) -> DataFrame:
    """Who calls whom by the names in the calls alone, resolved or not, with the number of calls."""
    return graph.call_edges(table(spark, d, "calls"))


@query(f"WITH {NODES}, {DECLARES} SELECT src, dst FROM declares_e")
def edges_declares(spark: SparkSession, d: str) -> DataFrame:
    """Types and their members."""
    return graph.declares(_nodes(spark, d))


@query(f"WITH {NODES}, {EXTENDS} SELECT src, dst FROM extends_e")
def edges_extends(spark: SparkSession, d: str) -> DataFrame:
    """Types and their superclasses."""
    return graph.extends(table(spark, d, "symbols"), _nodes(spark, d))


@query(f"WITH {NODES}, {IMPLEMENTS} SELECT src, dst FROM implements_e")
def edges_implements(spark: SparkSession, d: str) -> DataFrame:
    """Types and the interfaces they implement."""
    return graph.implements(table(spark, d, "symbols"), _nodes(spark, d))


# ---- implementations, impact ----


def _classes_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return edges.join(nodes.where("label = 'Class'").select(F.col("key").alias("src")), "src", "left_semi")


@query(f"WITH {NODES}, {IMPLEMENTS} SELECT e.dst AS interface_fqn, e.src AS class_fqn FROM implements_e e JOIN nodes n ON n.key = e.src AND n.label = 'Class'")
def get_implementations_direct(spark: SparkSession, d: str) -> DataFrame:
    """Classes that implement an interface, for every interface."""
    n = _nodes(spark, d)
    return _classes_of(n, graph.implements(table(spark, d, "symbols"), n)).select(F.col("dst").alias("interface_fqn"), F.col("src").alias("class_fqn"))


@query(
    f"""WITH RECURSIVE {NODES}, {IMPLEMENTS}, {EXTENDS}, ec AS (SELECT e.src, e.dst FROM extends_e e JOIN nodes a ON a.key = e.src AND a.label = 'Class' JOIN nodes b ON b.key = e.dst AND b.label = 'Class'),
 ic AS (SELECT e.src, e.dst FROM implements_e e JOIN nodes a ON a.key = e.src AND a.label = 'Class'),
 up AS (SELECT src, dst FROM ec UNION SELECT up.src, ec.dst FROM up JOIN ec ON up.dst = ec.src)
 SELECT DISTINCT ic.dst AS interface_fqn, up.src AS class_fqn FROM up JOIN ic ON ic.src = up.dst ANTI JOIN ic x ON x.src = up.src AND x.dst = ic.dst"""
)
def get_implementations_indirect(spark: SparkSession, d: str) -> DataFrame:
    """Classes that implement an interface by way of a superclass only."""
    s, n = table(spark, d, "symbols"), _nodes(spark, d)
    classes = n.where("label = 'Class'").select("key")
    up = _classes_of(n, graph.extends(s, n)).join(classes.withColumnRenamed("key", "dst"), "dst", "left_semi")
    reach = traversal.closure(up).select(F.col("start").alias("class_fqn"), F.col("node").alias("src"))
    direct = _classes_of(n, graph.implements(s, n))
    found = reach.join(direct, "src").select(F.col("dst").alias("interface_fqn"), "class_fqn").distinct()
    return found.join(direct.select(F.col("dst").alias("interface_fqn"), F.col("src").alias("class_fqn")), ["interface_fqn", "class_fqn"], "left_anti")


@query(
    f"""WITH RECURSIVE {NODES}, {EXTENDS}, ec AS (SELECT e.src, e.dst FROM extends_e e JOIN nodes a ON a.key = e.src AND a.label = 'Class'),
 dn AS (SELECT dst AS start, src AS node, 1 AS depth FROM ec UNION SELECT dn.start, ec.src, dn.depth + 1 FROM dn JOIN ec ON ec.dst = dn.node WHERE dn.depth < 3)
 SELECT start AS class_fqn, node AS child_fqn, min(depth) AS depth FROM dn GROUP BY ALL"""
)
def impact_children(spark: SparkSession, d: str) -> DataFrame:
    """Subclasses of every type over up to three steps, with the least depth."""
    s, n = table(spark, d, "symbols"), _nodes(spark, d)
    down = _classes_of(n, graph.extends(s, n)).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = traversal.least_depths(down, down.select(F.col("src").alias("node")), 3)
    return found.select(F.col("start").alias("class_fqn"), F.col("node").alias("child_fqn"), "depth")


# ---- names, modules, domains, files ----


_TYPE_NAMES = rf"[x FOR x IN regexp_extract_all(replace(t, '?', ''), '\b[A-Z][a-zA-Z0-9]*\b') IF x NOT IN ({', '.join(repr(x) for x in BUILT_IN_TYPES)})]"


@query(f"SELECT type_name, count(*) AS n FROM (SELECT DISTINCT symbol_id, unnest({_TYPE_NAMES}) AS type_name FROM (SELECT symbol_id, unnest(param_types) AS t FROM symbols WHERE kind = 'function')) GROUP BY 1")
def type_names_in_parameters(spark: SparkSession, d: str) -> DataFrame:
    """Type names in the parameter types of all functions, with their number of functions."""
    f = table(spark, d, "symbols").where("kind = 'function'").select("symbol_id", F.explode("param_types").alias("t")).distinct()
    return f.select("symbol_id", F.explode(type_names(F.col("t"))).alias("type_name")).distinct().groupBy("type_name").agg(F.count(F.lit(1)).alias("n"))


PKG = r"regexp_replace(regexp_replace(fqn, '\.[^.]+$', ''), '(\.[A-Z][^.]*)+$', '')"


@query(f"SELECT {PKG} AS package, count(*) AS n FROM (SELECT DISTINCT fqn FROM symbols WHERE fqn IS NOT NULL) GROUP BY 1")
def package_from_fqn(spark: SparkSession, d: str) -> DataFrame:
    """Names by the package their fqn implies."""
    return table(spark, d, "symbols").where("fqn is not null").select("fqn").distinct().groupBy(package_of_fqn(F.col("fqn")).alias("package")).agg(F.count(F.lit(1)).alias("n"))


def _modules(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(files.language(F.col("file_path")).isin("typescript", "javascript"))
    return docs.select(files.module_path(F.col("file_path"), F.col("project_path")).alias("module")).where("module is not null").distinct()


_MODULES = r"""m AS (SELECT DISTINCT regexp_replace(regexp_replace(substr(file_path, length(project_path) + 2), '(^|/)[^/]*$', ''), '^((src|lib|app|source|sources)(/|$))+', '') AS module
  FROM documents WHERE regexp_matches(lower(file_path), '\.(ts|tsx|js|jsx|mjs|cjs)$') AND starts_with(file_path, project_path)), mm AS (SELECT module FROM m WHERE module <> '')"""


@query(f"WITH {_MODULES} SELECT DISTINCT array_to_string(string_split(module, '/')[1:i], '/') AS path FROM (SELECT module, unnest(range(1, len(string_split(module, '/')) + 1)) AS i FROM mm)")
def module_paths(spark: SparkSession, d: str) -> DataFrame:
    """Module paths of TypeScript and JavaScript files, with all above them."""
    return _modules(spark, d).select(F.explode(files.with_ancestors(F.col("module"))).alias("path")).distinct()


@query(
    f"WITH {_MODULES}, p AS (SELECT DISTINCT array_to_string(string_split(module, '/')[1:i], '/') AS path FROM (SELECT module, unnest(range(1, len(string_split(module, '/')) + 1)) AS i FROM mm)) SELECT path, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') END AS parent, regexp_extract(path, '[^/]*$') AS name FROM p"
)
def module_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Modules with their parent and name."""
    p = module_paths(spark, d)
    parent = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", ""))
    return p.select("path", parent.alias("parent"), F.substring_index("path", "/", -1).alias("name"))


def _file_filter(spark: SparkSession, d: str) -> DataFrame:
    opts = table(spark, d, "file_filter_options").select("project_path", "include_declaration_files", "additional_excluded_patterns")
    return table(spark, d, "documents").select("doc_id", "project_path", "file_path").join(opts, "project_path", "left")


_LANGUAGE = "CASE regexp_extract(lower(file_path), '\\.([a-z]+)$', 1) " + " ".join(f"WHEN '{e}' THEN '{lang}'" for e, lang in files.LANGUAGE_OF.items()) + " END"
_DIRECTORIES = "|".join(x.replace(".", r"\.") for x in files.EXCLUDED_DIRECTORIES)


@query(
    f"""SELECT doc_id, {_LANGUAGE} AS language, NOT regexp_matches(file_path, '(^|/)({_DIRECTORIES})/') AND NOT regexp_matches(base, '{files.GENERATED_PATTERN}')
  AND (coalesce(include_declaration_files, false) OR NOT regexp_matches(base, '{files.DECLARATION_PATTERN}')) AND base NOT IN ({', '.join(repr(x) for x in files.EXCLUDED_CONFIG_FILES)}) AND NOT regexp_matches(base, '{files.CONFIG_PATTERN}')
  AND NOT coalesce(list_bool_or([regexp_matches(file_path, x) FOR x IN additional_excluded_patterns]), false) AND ({_LANGUAGE}) IS NOT NULL AS parsed, regexp_matches(file_path, '{files.TEST_PATTERN}') AS is_test
 FROM (SELECT *, regexp_extract(file_path, '[^/]*$') AS base FROM documents) LEFT JOIN file_filter_options USING (project_path)"""
)
def file_filter(spark: SparkSession, d: str) -> DataFrame:
    """Every document's language, and whether the indexer would parse it under its project's options."""
    keep = files.should_parse(F.col("file_path"), F.col("include_declaration_files"), excluded=F.col("additional_excluded_patterns"))
    lang = files.language(F.col("file_path"))
    return _file_filter(spark, d).select("doc_id", lang.alias("language"), (keep & lang.isNotNull()).alias("parsed"), files.is_test_file(F.col("file_path")).alias("is_test"))


@query(r"""SELECT lang AS language, n FROM (SELECT CASE regexp_extract(lower(file_path), '\.([a-z]+)$', 1) WHEN 'kt' THEN 'kotlin' WHEN 'kts' THEN 'kotlin' WHEN 'java' THEN 'java' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript'
 WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'mjs' THEN 'javascript' WHEN 'cjs' THEN 'javascript' END AS lang, count(*) AS n FROM documents GROUP BY 1) WHERE lang IS NOT NULL""")
def languages(spark: SparkSession, d: str) -> DataFrame:
    """Files by language; the first is the primary one."""
    return table(spark, d, "documents").groupBy(files.language(F.col("file_path")).alias("language")).agg(F.count(F.lit(1)).alias("n")).where("language is not null")


_IMPORTS = r"""list_distinct(regexp_extract_all(text, '(?m)^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)(?:\s+as\s+\w+)?;?\s*$', 1) || regexp_extract_all(text, '(?:\bfrom|\bimport|\brequire)\s*\(?\s*["'']([^"'']+)["'']', 1))"""
_DECLARED = r"""regexp_extract_all(text, '(?m)^\s*(?:(?:export|default|declare|public|private|protected|internal|abstract|final|open|sealed|data|static|inner|annotation|value|enum)\s+)*(?:class|interface|object|enum|record)\s+([A-Z]\w*)', 1)"""


@query(
    rf"""SELECT doc_id, nullif(regexp_extract(text, '(?m)^\s*package\s+([\w.]+)', 1), '') AS package, len({_IMPORTS})::INTEGER AS n_imports,
 array_to_string([x FOR x, i IN {_DECLARED} IF list_position({_DECLARED}, x) = i], ',') AS types FROM documents WHERE ({_LANGUAGE}) IS NOT NULL"""
)
def source_declarations(spark: SparkSession, d: str) -> DataFrame:
    """Package, imports and declared types of every source file."""
    t = F.col("text")
    return table(spark, d, "documents").where(files.language(F.col("file_path")).isNotNull()).select("doc_id", files.declared_package(t).alias("package"), F.size(files.imports(t)).alias("n_imports"), F.array_join(files.declared_types(t), ",").alias("types"))


def _scripts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(files.language(F.col("file_path")).isin("typescript", "javascript")).select("file_path", "text")


_SCRIPTS = f"(SELECT file_path, text FROM documents WHERE ({_LANGUAGE}) IN ('typescript', 'javascript'))"
_QUOTE = "''"


def _sql(pattern: str) -> str:
    return pattern.replace("'", _QUOTE)


@query(f"SELECT DISTINCT file_path, unnest(regexp_extract_all(text, '{_sql(modules._DECLARED)}', 1)) AS name FROM {_SCRIPTS}")
def export_names(spark: SparkSession, d: str) -> DataFrame:
    """The names that every script declares and so offers to others; none of the given files re-exports any."""
    return modules.export_index(_scripts(spark, d)).where("source is null").select("file_path", "name")


_WHOLE_SQL = [f"regexp_extract_all(text, '{_sql(modules._WHOLE)}', {g})" for g in (1, 2, 3)]
_NAMED_SQL = [f"regexp_extract_all(text, '{_sql(modules._NAMED)}', {g})" for g in (1, 2)]
_IMPORTED = rf"""w AS (SELECT file_path, coalesce(a, '') || coalesce(b, '') AS name, module FROM (SELECT file_path, unnest({_WHOLE_SQL[0]}) AS a, unnest({_WHOLE_SQL[1]}) AS b, unnest({_WHOLE_SQL[2]}) AS module FROM {_SCRIPTS})),
 m AS (SELECT file_path, trim(split_part(x, ' as ', 1)) AS name, module FROM (SELECT file_path, module, unnest(string_split(listed, ',')) AS x FROM (SELECT file_path, unnest({_NAMED_SQL[0]}) AS listed, unnest({_NAMED_SQL[1]}) AS module FROM {_SCRIPTS})) WHERE trim(x) <> ''),
 i AS (SELECT DISTINCT * FROM (SELECT * FROM w UNION ALL SELECT * FROM m))"""
_ENDS = ", ".join(f"'{x}'" for x in ("", *modules.ENDINGS, *(f"/index{e}" for e in modules.ENDINGS)))


@query(
    rf"""WITH {_IMPORTED}, b AS (SELECT DISTINCT file_path, module, regexp_replace(file_path, '/[^/]*$', '') || '/' || regexp_replace(module, '^\./', '') AS base FROM i WHERE module LIKE './%'),
 c AS (SELECT b.*, [{_ENDS}][k] AS ending, k FROM b, range(1, 14) r(k)), t AS (SELECT c.file_path, module, arg_min(s.file_path, k) AS target FROM c JOIN {_SCRIPTS} s ON s.file_path = base || ending GROUP BY 1, 2)
 SELECT i.*, target FROM i LEFT JOIN t ON t.file_path = i.file_path AND t.module = i.module"""
)
def module_imports(spark: SparkSession, d: str) -> DataFrame:
    """The names every script imports, with their module and, where it is among the files, its file."""
    s = _scripts(spark, d)
    i = modules.imports_of(s).select("file_path", "name", "module")
    return i.join(modules.resolve_modules(i, s), ["file_path", "module"], "left").distinct()


def _packages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "symbols").select(F.col("package_name").alias("package")).where("package is not null").distinct()


domain_sql = lambda p: f"CASE WHEN lower(string_split({p}, '.')[3]) IN ('domain','application','infrastructure','presentation','api','impl','internal') THEN lower(string_split({p}, '.')[4]) ELSE lower(string_split({p}, '.')[3]) END"


@query(f"SELECT upper(dom[1]) || dom[2:] AS name, count(*) AS n_packages FROM (SELECT {domain_sql('package_name')} AS dom FROM (SELECT DISTINCT package_name FROM symbols WHERE package_name IS NOT NULL)) WHERE dom <> '' GROUP BY dom")
def domain_infer(spark: SparkSession, d: str) -> DataFrame:
    """Domains inferred from packages."""
    return domains.infer_domains(_packages(spark, d))


_CONFIGURED = [("Core", ["com.talus.*.*", "com.umbra.**"]), ("Edge", ["com.*.*.*"]), ("Rest", ["**"])]


@query(r"SELECT package_name AS package, CASE WHEN regexp_matches(package_name, '^com\.talus\.[^.]*\.[^.]*$|^com\.umbra\..*$') THEN 'Core' WHEN regexp_matches(package_name, '^com\.[^.]*\.[^.]*\.[^.]*$') THEN 'Edge' ELSE 'Rest' END AS domain FROM (SELECT DISTINCT package_name FROM symbols WHERE package_name IS NOT NULL)")
def domain_assign(spark: SparkSession, d: str) -> DataFrame:
    """Packages assigned to configured domains by pattern."""
    return domains.assign_packages(_packages(spark, d), _CONFIGURED)


# ---- runs ----


@query(r"SELECT project_path, run_id, started_at, parse_errors FROM (SELECT *, row_number() OVER (PARTITION BY project_path ORDER BY started_at DESC, run_id DESC) AS r FROM (SELECT DISTINCT project_path, run_id, started_at, parse_errors FROM index_runs WHERE success AND NOT dry_run)) WHERE r = 1")
def latest_runs(spark: SparkSession, d: str) -> DataFrame:
    """The latest successful run of every project."""
    w = Window.partitionBy("project_path").orderBy(F.desc("started_at"), F.desc("run_id"))
    runs = table(spark, d, "index_runs").where("success and not dry_run").select("project_path", "run_id", "started_at", "parse_errors").distinct()
    return runs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
