"""Queries of the general operators over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import function_name, reference_text
from graphloom.operators.heavy_keys import heavy_keys, key_states
from graphloom.operators.hierarchy import descendants, resolve_hierarchy
from graphloom.operators.nested_json import FlatTables, flatten_records
from graphloom.operators.orphans import orphan_references
from graphloom.session import table

TYPE_KINDS = ["class", "interface", "object", "enum", "annotation"]
BODY_FIELDS = {
    "nestedClasses": "class", "functions": "function", "properties": "property",
    "companionObject": "companion", "secondaryConstructors": "constructor", "parameters": "parameter",
}


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    symbols, classes = table(spark, d, "symbols"), table(spark, d, "classes")
    fields = F.explode(F.array(
        F.struct(F.lit("super_class").alias("f"), F.col("super_class").alias("r")),
        F.struct(F.lit("declaring_type_fqn").alias("f"), F.col("declaring_type_fqn").alias("r")),
    )).alias("x")
    of_symbols = symbols.select(F.lit("symbols").alias("src_table"), F.col("symbol_id").alias("row_id"), fields, F.col("indexed_at").alias("at")).select("src_table", "row_id", F.col("x.f").alias("ref_field"), F.col("x.r").alias("ref"), "at")
    of_classes = classes.select(F.lit("classes").alias("src_table"), F.col("class_id").alias("row_id"), F.lit("interfaces").alias("ref_field"), F.explode("interfaces").alias("ref"), F.col("indexed_at").alias("at"))
    refs = of_symbols.unionByName(of_classes).withColumn("key", reference_text(F.col("ref"))).where("key is not null").drop("ref")
    outside = table(spark, d, "external_types").select(F.col("fqn").alias("key"))
    refs = refs.join(outside, "key", "left_anti")
    parents = symbols.where(F.col("kind").isin(TYPE_KINDS)).select(F.col("fqn").alias("key"), F.col("indexed_at").alias("born"), F.col("removed_at").alias("died"))
    return orphan_references(refs, parents)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """References to types that are missing, removed or indexed only later."""
    return _orphans(spark, d).select("src_table", "row_id", "ref_field", F.col("key").alias("target_fqn")).distinct()


def p2_by_month(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references by table, field and month of indexed_at."""
    return (
        _orphans(spark, d).select("src_table", "row_id", "ref_field", "key", "at").distinct()
        .groupBy("src_table", "ref_field", F.date_format("at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n_orphans"), F.countDistinct("key").alias("n_targets"))
    )


def _calls(spark: SparkSession, d: str) -> tuple[DataFrame, dict, dict]:
    rows = table(spark, d, "calls").select(
        function_name(F.col("caller_function_name")).alias("caller"), function_name(F.col("callee_function_name")).alias("callee"), F.col("file_path").alias("file")
    )
    return rows, {"caller": "caller", "callee": "callee"}, {"caller": ["callee", "file"], "callee": ["caller", "file"]}


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Function names with at least 1 % of all rows on a side."""
    rows, sides, dims = _calls(spark, d)
    return heavy_keys(rows, sides, dims, 0.01).select("side", F.col("key").alias("function_name"))


def p3_key_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows, distinct counterparts and files of every caller and callee name."""
    s = key_states(*_calls(spark, d)).where("key is not null")
    is_file = F.col("dim") == "file"
    return s.groupBy("side", F.col("key").alias("function_name")).agg(
        F.max(F.when(is_file, F.col("n"))).alias("n_rows"),
        F.max(F.when(~is_file, F.col("n_distinct"))).alias("n_counterparts"),
        F.max(F.when(is_file, F.col("n_distinct"))).alias("n_files"),
    )


def _bodies(spark: SparkSession, d: str, attributes: dict | None = None) -> FlatTables:
    records = table(spark, d, "class_bodies").select("record_id", F.col("indexed_at").alias("version"), "body")
    return flatten_records(records, BODY_FIELDS, {"companionObject"}, "body", attributes)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every object nested in a class body, with its path and its parent's."""
    return _bodies(spark, d).table().select("record_id", "node_path", "parent_path", "kind")


def _kind_query(kind: str, attributes: dict):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return _bodies(spark, d, attributes).table(kind).drop("kind")

    query.__doc__ = f"The flat table of one kind: {kind}."
    return query


_NAME, _TYPE, _VISIBLE = {"name": ("name", "string")}, {"type": ("type", "string")}, {"visibility": ("visibility", "string")}
p4_classes = _kind_query("class", _NAME | {"class_kind": ("kind", "string"), "super_class": ("superClass", "string")} | _VISIBLE)
p4_functions = _kind_query("function", _NAME | {"return_type": ("returnType", "string")} | _VISIBLE)
p4_properties = _kind_query("property", _NAME | _TYPE | {"is_val": ("isVal", "boolean"), "initializer": ("initializer", "string")})
p4_parameters = _kind_query("parameter", _NAME | _TYPE | {"default_value": ("defaultValue", "string")})


def _links(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "symbols").where("fqn is not null")
    newest = s.groupBy("fqn").agg(F.max(F.struct("ins_seq", "kind", "parent_fqn", "super_class")).alias("s")).select("fqn", "s.*")
    nesting = newest.select(F.lit("nesting").alias("tree"), F.col("fqn").alias("node"), reference_text(F.col("parent_fqn")).alias("parent"))
    types = newest.where(F.col("kind").isin(TYPE_KINDS)).select(F.lit("inheritance").alias("tree"), F.col("fqn").alias("node"), reference_text(F.col("super_class")).alias("parent"))
    return nesting.unionByName(types)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Root and depth of every symbol in the trees of nesting and inheritance."""
    return resolve_hierarchy(_links(spark, d)).select("tree", F.col("node").alias("node_fqn"), F.col("root").alias("root_fqn"), "depth")


def p7_paths(spark: SparkSession, d: str) -> DataFrame:
    """Full path of every symbol from its root, joined by ` > `; depth -1: from the smallest symbol of the loop it is on or below."""
    r = resolve_hierarchy(_links(spark, d), with_path=True)
    return r.select("tree", F.col("node").alias("node_fqn"), "depth", F.array_join(F.coalesce("path", "loop_path"), " > ").alias("path"))


def p7_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of a symbol and a symbol below it, with the distance and whether they are on or below a loop."""
    r = resolve_hierarchy(_links(spark, d), with_path=True)
    return descendants(r).withColumnsRenamed({"ancestor": "ancestor_fqn", "node": "node_fqn"})


QUERIES = {
    n: q
    for n, q in {
        "p2_found": p2_found, "p2_by_month": p2_by_month, "p3_found": p3_found, "p3_key_counts": p3_key_counts,
        "p4_found": p4_found, "p4_classes": p4_classes, "p4_functions": p4_functions, "p4_properties": p4_properties,
        "p4_parameters": p4_parameters, "p7_found": p7_found, "p7_paths": p7_paths, "p7_descendants": p7_descendants,
    }.items()
}


# ---- SQL ----

_BLANKS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))"
_REF = lambda c: rf"nullif(trim(regexp_replace(trim(split_part({c}, '<', 1), {_BLANKS}), '\?$', ''), {_BLANKS}), '')"
_NM = lambda c: rf"regexp_replace(regexp_replace(trim({c}, {_BLANKS}), '^`(.*)`$', '\1'), '\(\)$', '')"
_KINDS = "('class','interface','object','enum','annotation')"
_ORPHANS = f"""WITH r AS (SELECT 'symbols' AS src_table, symbol_id AS row_id, 'super_class' AS ref_field, {_REF('super_class')} AS key, indexed_at AS seen FROM symbols
 UNION ALL SELECT 'symbols', symbol_id, 'declaring_type_fqn', {_REF('declaring_type_fqn')}, indexed_at FROM symbols
 UNION ALL SELECT 'classes', class_id, 'interfaces', {_REF('i')}, indexed_at FROM (SELECT class_id, indexed_at, unnest(interfaces) AS i FROM classes)),
 o AS (SELECT DISTINCT * FROM r WHERE key IS NOT NULL AND key NOT IN (SELECT fqn FROM external_types WHERE fqn IS NOT NULL)
  AND NOT EXISTS (SELECT 1 FROM symbols s WHERE s.kind IN {_KINDS} AND s.fqn = r.key AND s.indexed_at <= r.seen AND (s.removed_at IS NULL OR s.removed_at > r.seen)))"""
_SIDES = f"""c AS (SELECT {_NM('caller_function_name')} AS caller, {_NM('callee_function_name')} AS callee, file_path FROM calls),
 s AS (SELECT 'caller' AS side, caller AS function_name, callee AS other, file_path FROM c UNION ALL SELECT 'callee', callee, caller, file_path FROM c)"""


def _tree_sql(tree: str, where: str, parent: str) -> str:
    return f"""{tree}_n AS (SELECT fqn AS node, {_REF(parent)} AS parent FROM newest {where}),
 {tree}_l AS (SELECT n.node, p.node AS parent FROM {tree}_n n LEFT JOIN {tree}_n p ON n.parent = p.node),
 {tree}_w AS (SELECT node, node AS cur, 0 AS depth, [node] AS path FROM {tree}_l UNION ALL SELECT w.node, l.parent, w.depth + 1, list_append(w.path, l.parent)
  FROM {tree}_w w JOIN {tree}_l l ON l.node = w.cur WHERE l.parent IS NOT NULL AND NOT list_contains(w.path[:-2], w.cur)),
 {tree}_e AS (SELECT node, arg_max(cur, depth) AS cur, max(depth) AS depth, arg_max(path, depth) AS path FROM {tree}_w GROUP BY node),
 {tree}_r AS (SELECT '{tree}' AS tree, node AS node_fqn, CASE WHEN list_contains(path[:-2], cur) THEN list_min(path[list_position(path, cur):]) ELSE cur END AS root_fqn,
  CASE WHEN list_contains(path[:-2], cur) THEN -1 ELSE depth END AS depth FROM {tree}_e)"""


def _tree_ways(tree: str) -> str:
    """Ways from the end of every node's walk, turned around; a walk into a loop goes on to the loop's smallest node."""
    return f"""{tree}_z AS (SELECT r.tree, r.node_fqn, r.root_fqn, r.depth, r.node_fqn AS cur, [r.node_fqn] AS way FROM {tree}_r r
  UNION ALL SELECT z.tree, z.node_fqn, z.root_fqn, z.depth, l.parent, list_prepend(l.parent, z.way) FROM {tree}_z z JOIN {tree}_l l ON l.node = z.cur WHERE z.cur <> z.root_fqn),
 {tree}_y AS (SELECT tree, node_fqn, depth, way FROM {tree}_z WHERE cur = root_fqn)"""


_TREES = f"""WITH RECURSIVE newest AS (SELECT fqn, kind, parent_fqn, super_class FROM symbols WHERE fqn IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fqn ORDER BY ins_seq DESC) = 1),
 {_tree_sql('nesting', '', 'parent_fqn')}, {_tree_sql('inheritance', 'WHERE kind IN ' + _KINDS, 'super_class')}"""

#: The way from the root to a node; on and below loops from the smallest node of the loop.
_WAYS = f"""{_TREES}, {_tree_ways('nesting')}, {_tree_ways('inheritance')}, ways AS (SELECT * FROM nesting_y UNION ALL SELECT * FROM inheritance_y)"""

_HOLDS = lambda x: f"CASE json_type({x}) WHEN 'VARCHAR' THEN TRY_CAST({x} ->> '$' AS JSON) ELSE {x} END"
_FIELDS = ", ".join(f"('{f}', '{k}')" for f, k in BODY_FIELDS.items())


def json_nodes(key: str) -> str:
    """Tables of the objects nested in the newest body of every key."""
    return f"""fields AS (SELECT * FROM (VALUES {_FIELDS}) v(field, k)),
 newest AS (SELECT {key} AS record_id, body FROM class_bodies QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY indexed_at DESC NULLS LAST, body DESC NULLS LAST) = 1),
 n AS (SELECT record_id, '$' AS path, '' AS parent, 'body' AS kind, j, NULL::VARCHAR AS names, NULL::VARCHAR AS owner FROM (SELECT record_id, {_HOLDS('b')} AS j FROM (SELECT record_id, TRY_CAST(body AS JSON) AS b FROM newest)) WHERE json_type(j) = 'OBJECT'
  UNION ALL SELECT record_id, path || '.' || field || CASE WHEN field = 'companionObject' THEN '' ELSE '[' || (i - 1) || ']' END, path, k, e,
   concat_ws('.', names, CASE k WHEN 'companion' THEN coalesce(e ->> '$.name', 'Companion') WHEN 'constructor' THEN '<init>' || CASE WHEN i > 1 THEN (i - 1)::VARCHAR ELSE '' END ELSE e ->> '$.name' END), names
  FROM (SELECT *, {_HOLDS('l[i]')} AS e FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM (SELECT record_id, path, names, field, k, CASE json_type(v) WHEN 'ARRAY' THEN CAST(v AS JSON[]) WHEN 'OBJECT' THEN [v] END AS l
   FROM (SELECT n.*, field, k, {_HOLDS("json_extract(j, '$.' || field)")} AS v FROM n, fields)))) WHERE json_type(e) = 'OBJECT')"""


JSON_NODES = json_nodes("record_id")


def _flat(kind: str, **attributes: str) -> str:
    columns = ", ".join(f"j ->> '$.{f}' AS {a}" for a, f in attributes.items())
    return f"WITH RECURSIVE {JSON_NODES} SELECT record_id, path AS node_path, parent AS parent_path, {columns} FROM n WHERE kind = '{kind}'"


ORACLE_SQL = {
    "p2_found": f"{_ORPHANS} SELECT DISTINCT src_table, row_id, ref_field, key AS target_fqn FROM o",
    "p2_by_month": f"{_ORPHANS} SELECT src_table, ref_field, strftime(seen, '%Y-%m') AS month, count(*) AS n_orphans, count(DISTINCT key) AS n_targets FROM o GROUP BY ALL",
    "p3_found": f"WITH {_SIDES} SELECT side, function_name FROM s WHERE function_name IS NOT NULL GROUP BY ALL HAVING count(*) >= 0.01 * (SELECT count(*) FROM calls)",
    "p3_key_counts": f"WITH {_SIDES} SELECT side, function_name, count(*) AS n_rows, count(DISTINCT other) AS n_counterparts, count(DISTINCT file_path) AS n_files FROM s WHERE function_name IS NOT NULL GROUP BY ALL",
    "p4_found": f"WITH RECURSIVE {JSON_NODES} SELECT record_id, path AS node_path, parent AS parent_path, kind FROM n",
    "p4_classes": _flat("class", name="name", class_kind="kind", super_class="superClass", visibility="visibility"),
    "p4_functions": _flat("function", name="name", return_type="returnType", visibility="visibility"),
    "p4_properties": _flat("property", name="name", type="type", is_val="isVal", initializer="initializer").replace("j ->> '$.isVal'", "try_cast(j ->> '$.isVal' AS BOOLEAN)"),
    "p4_parameters": _flat("parameter", name="name", type="type", default_value="defaultValue"),
    "p7_found": f"{_TREES} SELECT * FROM nesting_r UNION ALL SELECT * FROM inheritance_r",
    "p7_paths": f"{_WAYS} SELECT tree, node_fqn, depth, array_to_string(way, ' > ') AS path FROM ways",
    "p7_descendants": f"{_WAYS} SELECT tree, way[i] AS ancestor_fqn, node_fqn, (len(way) - i)::INTEGER AS distance, depth = -1 AS loop FROM (SELECT *, unnest(range(1, len(way))) AS i FROM ways)",
}
