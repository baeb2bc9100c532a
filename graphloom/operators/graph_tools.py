"""The questions asked of a code graph. Every function takes nodes and edges (`code_graph`) and returns ordered rows.

project_path keeps what lies below a path, as a plain prefix of the file path. Names are compared exactly unless stated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators import traversal
from graphloom.operators.graph import OWNER_LABELS

SEARCHED = ["Class", "Interface", "Function", "Property", "Object"]
PATH_LABELS = [*SEARCHED, "Package"]


def _below(c: DataFrame, column: str, project_path: str | None) -> DataFrame:
    return c.where(F.col(column).startswith(project_path)) if project_path else c


def _of(edges: DataFrame, *types: str) -> DataFrame:
    return edges.where(F.col("rel_type").isin(*types)).select("src", "dst")


def _end(nodes: DataFrame, prefix: str, labels: list[str] | None = None) -> DataFrame:
    n = nodes.where(F.col("label").isin(labels)) if labels else nodes
    return n.select(*[F.col(c).alias(f"{prefix}_{c}") for c in ("key", "name", "label", "file_path", "line_number")])


def _line(column: str) -> Column:
    return F.coalesce(column, F.lit(0)).alias("line_number")


def validate_project(projects: DataFrame, path: str) -> DataFrame:
    """(path): the indexed projects whose path begins `path`; none: the path is not indexed."""
    return projects.where(F.lit(path).startswith(F.col("path"))).select("path").distinct()


def search_nodes(nodes: DataFrame, query: str, node_types: list[str] | None = None, exact_match: bool = False, limit: int = 20, project_path: str | None = None) -> DataFrame:
    """Nodes by name: part of it in any case, or the whole of it by a regular expression; the first `limit`, held to 1..100, by name."""
    match = F.col("name").rlike(rf"\A(?:{query})\z") if exact_match else F.contains(F.lower("name"), F.lit(query.lower()))
    found = _below(nodes.where(F.col("label").isin(node_types or SEARCHED) & match), "file_path", project_path)
    out = found.select("name", "label", "file_path", _line("line_number"), F.coalesce("visibility", F.lit("public")).alias("visibility"), "key")
    return out.orderBy(F.asc_nulls_last("name"), "file_path", "line_number", "key").limit(min(100, max(1, limit)))


def _functions(nodes: DataFrame, name: str, owner: str | None) -> DataFrame:
    f = nodes.where((F.col("label") == "Function") & (F.col("name") == name))
    return f.where(F.col("declaring_type").endswith(owner)) if owner else f


def _calls_of(nodes: DataFrame, edges: DataFrame, starts: DataFrame, depth: int, backwards: bool, project_path: str | None) -> DataFrame:
    e = _of(edges, "CALLS")
    e = e.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if backwards else e
    t = traversal.trails(e, starts.select(F.col("key").alias("node")), min(5, max(1, depth))).where("start <> node").select(F.col("node").alias("key"), "depth").distinct()
    f = _below(nodes.where("label = 'Function'").select("key", "name", "file_path", "line_number"), "file_path", project_path)
    owners = _of(edges, "DECLARES").join(_end(nodes, "o", OWNER_LABELS), F.col("src") == F.col("o_key")).select(F.col("dst").alias("key"), F.col("o_name").alias("class_name"))
    out = t.join(f, "key").join(owners, "key", "left").select("depth", "class_name", F.col("name").alias("function_name"), "file_path", _line("line_number"))
    return out.orderBy("depth", F.asc_nulls_last("class_name"), "function_name", "file_path", "line_number")


def get_callers(nodes: DataFrame, edges: DataFrame, function_name: str, class_name: str | None = None, depth: int = 2, project_path: str | None = None) -> DataFrame:
    """(depth, class_name, function_name, file_path, line_number): functions that call one of that name over 1..depth calls, once for every depth.

    class_name: the end of the declaring type's name. depth is held to 1..5. No call is used twice on a way.
    """
    return _calls_of(nodes, edges, _functions(nodes, function_name, class_name), depth, True, project_path)


def get_callees(nodes: DataFrame, edges: DataFrame, function_name: str, class_name: str | None = None, depth: int = 2, project_path: str | None = None) -> DataFrame:
    """The same for the functions it calls; project_path is of the calling function."""
    return _calls_of(nodes, edges, _below(_functions(nodes, function_name, class_name), "file_path", project_path), depth, False, None)


def get_neighbors(nodes: DataFrame, edges: DataFrame, node_name: str | None = None, direction: str = "both", include_external: bool = False, project_path: str | None = None) -> DataFrame:
    """(node_name, direction, name, type, depth, file_path): what a type depends on (outgoing), and what depends on it (incoming).

    By inheritance, or by a type that one of its functions uses. Of several neighbours of one name the
    first counts: inheritance first, then by file and key. Without include_external neighbours without a file are left out;
    project_path is of the depending type. node_name None: of all types.
    """
    direct = _of(edges, "EXTENDS", "IMPLEMENTS")
    uses = _of(edges, "USES").select(F.col("src").alias("f"), "dst")
    through = _of(edges, "DECLARES").select("src", F.col("dst").alias("f")).join(uses, "f").select("src", "dst").where("src <> dst").distinct()
    pairs = direct.select("src", "dst", F.lit(0).alias("prio")).unionByName(through.select("src", "dst", F.lit(1).alias("prio")))
    src, dst = _below(_end(nodes, "s", OWNER_LABELS), "s_file_path", project_path), _end(nodes, "t", ["Class", "Interface"])
    both = pairs.join(src, F.col("src") == F.col("s_key")).join(dst, F.col("dst") == F.col("t_key"))
    parts = []
    for way, me, other in (("outgoing", "s", "t"), ("incoming", "t", "s")):
        if direction in (way, "both"):
            rows = both if node_name is None else both.where(F.col(f"{me}_name") == node_name)
            rows = rows if include_external else rows.where(F.col(f"{other}_file_path").isNotNull())
            first = F.struct("prio", F.col(f"{other}_file_path").alias("file_path"), F.col(f"{other}_key").alias("key"), F.col(f"{other}_label").alias("type"))
            got = rows.groupBy(F.col(f"{me}_name").alias("node_name"), F.col(f"{other}_name").alias("name")).agg(F.min(first).alias("n"))
            parts.append(got.select("node_name", F.lit(way).alias("direction"), "name", "n.type", F.lit(1).alias("depth"), "n.file_path", "n.prio"))
    return reduce(DataFrame.unionByName, parts).orderBy("node_name", F.desc("direction"), "prio", "name").drop("prio")


def get_implementations(nodes: DataFrame, edges: DataFrame, interface_name: str | None = None, include_indirect: bool = False, project_path: str | None = None) -> DataFrame:
    """(interface_fqn, kind, name, class_fqn, file_path, line_number): classes that implement an interface, then those that inherit it only.

    interface_name None: of all interfaces. Being direct is told for each interface, not for each name.
    """
    classes = nodes.where("label = 'Class'")
    i = nodes.where("label = 'Interface'")
    i = (i if interface_name is None else i.where(F.col("name") == interface_name)).select(F.col("key").alias("dst"))
    direct = _of(edges, "IMPLEMENTS").join(i, "dst", "left_semi").join(classes.select(F.col("key").alias("src")), "src", "left_semi").select("src", "dst")
    found = direct.withColumn("kind", F.lit("direct"))
    if include_indirect:
        only = classes.select("key")
        up = _of(edges, "EXTENDS").join(only.withColumnRenamed("key", "src"), "src", "left_semi").join(only.withColumnRenamed("key", "dst"), "dst", "left_semi").select("src", "dst")
        if interface_name is None:
            reach = traversal.closure(up).select("start", "node")
        else:  # downwards from the classes that implement it
            down = up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
            reach = traversal.least_depths(down, direct.select(F.col("src").alias("node")).distinct()).select(F.col("node").alias("start"), F.col("start").alias("node"))
        far = reach.join(direct.select(F.col("src").alias("node"), "dst"), "node").select(F.col("start").alias("src"), "dst").distinct()
        far = far.join(direct, ["src", "dst"], "left_anti")
        found = found.unionByName(far.withColumn("kind", F.lit("indirect")))
    c = _below(classes.select(F.col("key").alias("src"), "name", "file_path", "line_number"), "file_path", project_path)
    out = found.join(c, "src").select(F.col("dst").alias("interface_fqn"), "kind", "name", F.col("src").alias("class_fqn"), "file_path", _line("line_number"))
    return out.orderBy("interface_fqn", "kind", "name", "class_fqn")


def get_impact(nodes: DataFrame, edges: DataFrame, node_name: str, node_type: str | None = None, depth: int = 3, project_path: str | None = None) -> DataFrame:
    """(branch, name, type, impact_type, depth, file_path, line_number): what a change of the nodes of that name reaches.

    Branches in their order: 1 callers of a function, 2 types with a function that uses the type, 3 classes that implement the
    interface, 4 subclasses; node_type (function, class, interface or another) keeps those that apply, none for others. depth is held to 1..10.
    """
    wanted, far = (lambda *t: node_type is None or node_type in t), min(10, max(1, depth))
    target = nodes.where(F.col("name") == node_name)
    keys = lambda *labels: target.where(F.col("label").isin(*labels)).select(F.col("key").alias("node"))
    reverse = lambda e: e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    parts = []

    def add(branch: int, found: DataFrame, labels: list[str], type_: Column, impact: str) -> None:
        n = _below(nodes.where(F.col("label").isin(labels)).select("key", "label", "name", "file_path", "line_number"), "file_path", project_path)
        parts.append(found.join(n, "key").select(F.lit(branch).alias("branch"), "name", type_.alias("type"), F.lit(impact).alias("impact_type"), "depth", "file_path", _line("line_number"), "key"))

    least = lambda t: t.groupBy(F.col("node").alias("key")).agg(F.min("depth").alias("depth"))
    if wanted("function"):
        t = traversal.least_depths(reverse(_of(edges, "CALLS")), keys("Function"), far).where("start <> node")
        add(1, least(t), ["Function"], F.lit("function"), "caller")
    if wanted("class", "interface"):
        labels = [node_type.capitalize()] if node_type else ["Class", "Interface"]
        users = _of(edges, "USES").join(keys(*labels), F.col("dst") == F.col("node")).select(F.col("src").alias("f"), "node")
        owners = _of(edges, "DECLARES").select(F.col("src").alias("key"), F.col("dst").alias("f")).join(users, "f").where("key <> node")
        add(2, owners.select("key", F.lit(1).alias("depth")).distinct(), OWNER_LABELS, F.col("label"), "dependent")
    if wanted("interface"):
        t = _of(edges, "IMPLEMENTS").join(keys("Interface"), F.col("dst") == F.col("node")).select(F.col("src").alias("key"), F.lit(1).alias("depth")).distinct()
        add(3, t, ["Class"], F.lit("class"), "implementor")
    if wanted("class"):
        only = nodes.where("label = 'Class'").select("key")
        up = _of(edges, "EXTENDS").join(only.withColumnRenamed("key", "src"), "src", "left_semi").select("src", "dst")
        add(4, least(traversal.least_depths(reverse(up), keys("Class"), far)), ["Class"], F.lit("class"), "child")
    if not parts:
        none = nodes.limit(0)
        return none.select(F.lit(0).alias("branch"), "name", F.col("label").alias("type"), F.lit("").alias("impact_type"), F.lit(1).alias("depth"), "file_path", _line("line_number"))
    return reduce(DataFrame.unionByName, parts).orderBy("branch", "depth", "name", "key").drop("key")


def find_path(nodes: DataFrame, edges: DataFrame, from_node: str, to_node: str, max_depth: int = 5, relationship_types: list[str] | None = None, project_path: str | None = None) -> DataFrame:
    """(step, name, type, file_path, relationship): a shortest path between nodes of two names over edges in either direction.

    Of several the first by node keys. relationship: the types of the edges to the next node; both ends, not the nodes between,
    lie in project_path; max_depth is held to 1..10. Labels beyond PATH_LABELS are `unknown`.
    """
    e = edges.where(F.col("rel_type").isin(relationship_types)) if relationship_types else edges
    ends = lambda name: _below(nodes.where(F.col("name") == name), "file_path", project_path).select(F.col("key").alias("node"))
    way = traversal.shortest_path(e, ends(from_node), ends(to_node), min(10, max(1, max_depth)))
    after = way.select((F.col("step") - 1).alias("step"), F.col("node").alias("next"))
    pairs = way.join(after, "step")
    both = e.select("rel_type", F.col("src").alias("node"), F.col("dst").alias("next")).unionByName(e.select("rel_type", F.col("dst").alias("node"), F.col("src").alias("next")))
    kinds = pairs.join(both, ["node", "next"]).groupBy("step").agg(F.array_join(F.array_sort(F.collect_set("rel_type")), "|").alias("relationship"))
    label = F.when(F.col("label").isin(PATH_LABELS), F.col("label")).otherwise("unknown")
    named = way.join(nodes.select(F.col("key").alias("node"), "name", "label", "file_path"), "node").select("step", "name", F.lower(label).alias("type"), "file_path")
    return named.join(kinds, "step", "left").orderBy("step")


def get_file_symbols(nodes: DataFrame, file_path: str, include_private: bool = True, project_path: str | None = None) -> DataFrame:
    """(line_number, type, name, visibility, file_path, key): nodes of the files whose path is, or ends with, file_path, by line, type and name."""
    found = _below(nodes.where(F.col("label").isin(SEARCHED) & F.col("file_path").endswith(file_path)), "file_path", project_path)
    shown = F.coalesce("visibility", F.lit("public"))
    if not include_private:
        found = found.where(shown.isin("public", "protected", "internal"))
    return found.select("file_path", _line("line_number"), F.col("label").alias("type"), "name", shown.alias("visibility"), "key").orderBy("line_number", "type", "name", "key")


def status(nodes: DataFrame, edges: DataFrame, labels: list[str], types: list[str]) -> DataFrame:
    """(kind, name, n): nodes by label and edges by type, as far as there are any."""
    n = nodes.where(F.col("label").isin(labels)).groupBy(F.lit("node").alias("kind"), F.col("label").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    e = edges.where(F.col("rel_type").isin(types)).groupBy(F.lit("relationship").alias("kind"), F.col("rel_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return n.unionByName(e)
