"""The whole code graph as two tables: nodes of all labels and edges of all types.

nodes: label, key, name, file_path, line_number, declaring_type, package_name, visibility; edges: rel_type, src, dst (node keys),
n (calls, weight or position), context. Types, functions and properties have their full name as key; packages, modules,
projects and domains theirs behind the label, parameters `function#position:name`, annotations `@name`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import reference_text
from graphloom.functions.types import build_fqn, package_of_fqn, type_names
from graphloom.operators import domains, graph, resolve
from graphloom.operators.nested_json import flatten_records
from graphloom.session import Scratch
from graphloom.sources import files

NODE_COLUMNS = ["label", "key", "name", "file_path", "line_number", "declaring_type", "package_name", "visibility"]
EDGE_COLUMNS = ["rel_type", "src", "dst", "n", "context"]
# Labels and edge types that the status counts.
STATUS_LABELS = ["Package", "Class", "Interface", "Object", "Function", "Property", "Parameter", "Annotation"]
STATUS_TYPES = ["CONTAINS", "DECLARES", "EXTENDS", "IMPLEMENTS", "CALLS", "USES", "HAS_PARAMETER", "ANNOTATED_WITH", "RETURNS"]
_BODY_FIELDS = {
    "nestedClasses": "class", "functions": "function", "properties": "property",
    "companionObject": "companion", "secondaryConstructors": "constructor", "parameters": "parameter",
}


def _nodes(df: DataFrame, label: Column, key: Column, name: Column, **more: Column) -> DataFrame:
    kinds = {"file_path": "string", "line_number": "int", "declaring_type": "string", "package_name": "string", "visibility": "string"}
    rest = [more.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]
    return df.select(label.alias("label"), key.alias("key"), name.alias("name"), *rest)


def _edges(df: DataFrame, rel_type: str, n: Column | None = None, context: Column | None = None) -> DataFrame:
    none = F.lit(None)
    return df.select(F.lit(rel_type).alias("rel_type"), "src", "dst", (none if n is None else n).cast("long").alias("n"), (none if context is None else context).cast("string").alias("context"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def file_projects(paths: DataFrame, projects: DataFrame) -> DataFrame:
    """(file_path, project): the innermost project that holds a file. paths: file_path; projects: path."""
    above = paths.where("file_path is not null").select("file_path").distinct().select("file_path", F.explode(files.with_ancestors(F.col("file_path"))).alias("path"))
    return above.join(projects.where("path is not null").select("path").distinct(), "path").groupBy("file_path").agg(F.max_by("path", F.length("path")).alias("project"))


def containment(symbols: DataFrame, projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Project, Package and Module nodes, and CONTAINS edges down to the top-level declarations.

    A project contains the packages its files declare; a package contains what stands in it without a parent. TypeScript and
    JavaScript files without a package belong to the module of their directory; modules contain their sub-modules.
    """
    tops = graph.merge_overlay(symbols, "fqn", "ins_seq", ["kind", "package_name", "parent_fqn", "declaring_type_fqn", "file_path"]).where("kind is not null")
    tops = tops.join(file_projects(tops, projects), "file_path", "left")
    top = reference_text(F.col("parent_fqn")).isNull() & reference_text(F.col("declaring_type_fqn")).isNull()
    package, project = F.concat(F.lit("package:"), "package_name"), F.concat(F.lit("project:"), "project")
    module = F.when(F.col("package_name").isNull() & files.language(F.col("file_path")).isin("typescript", "javascript"), files.module_path(F.col("file_path"), F.col("project")))
    tops = tops.withColumn("module", module)
    modules = tops.where("module is not null").select("project", F.explode(files.with_ancestors(F.col("module"))).alias("path")).distinct()
    key = lambda p: F.concat(F.lit("module:"), F.col("project"), F.lit(":"), p)
    parent = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", ""))
    nodes = [
        _nodes(projects.where("path is not null").select("path").distinct(), F.lit("Project"), F.concat(F.lit("project:"), "path"), files.base_name(F.col("path"))),
        _nodes(tops.where("package_name is not null").select("package_name").distinct(), F.lit("Package"), package, F.col("package_name")),
        _nodes(modules, F.lit("Module"), key(F.col("path")), files.base_name(F.col("path"))),
    ]
    edges = [
        tops.where("project is not null and package_name is not null").select(project.alias("src"), package.alias("dst")),
        tops.where(top & F.col("package_name").isNotNull()).select(package.alias("src"), F.col("fqn").alias("dst")),
        modules.select(F.coalesce(key(parent), project).alias("src"), key(F.col("path")).alias("dst")),
        tops.where(top & F.col("module").isNotNull()).select(key(F.col("module")).alias("src"), F.col("fqn").alias("dst")),
    ]
    return _union(nodes), _edges(_union(edges).distinct(), "CONTAINS")


def body_objects(bodies: DataFrame) -> DataFrame:
    """(class_fqn, kind, fqn, owner, position, name, class_kind, return_type, type, visibility, annotations): what the newest body of every class holds.

    fqn: the class and the names down to the object; a companion without name is Companion, constructors are `<init>`, `<init>1` and so on.
    owner: the fqn of the object that holds it; of a parameter its function or constructor.
    """

    def named(kind: Column, fields: Column, i: Column) -> Column:
        number = F.when(i > 0, i.cast("string")).otherwise("")
        return F.when(kind == "companion", F.coalesce(fields["name"], F.lit("Companion"))).when(kind == "constructor", F.concat(F.lit("<init>"), number)).otherwise(fields["name"])

    kept = {"name": "name", "class_kind": "kind", "return_type": "returnType", "type": "type", "visibility": "visibility", "annotations": "annotations"}
    rows = bodies.where("class_fqn is not null").select(F.col("class_fqn").alias("record_id"), F.col("indexed_at").alias("version"), "body")
    flat = flatten_records(rows, _BODY_FIELDS, {"companionObject"}, "body", {a: (f, "string") for a, f in kept.items()}, named).table().where("kind <> 'body'")
    position = F.regexp_extract("node_path", r"\[(\d+)\]$", 1).try_cast("int")
    return flat.select(F.col("record_id").alias("class_fqn"), "kind", build_fqn(F.col("record_id"), F.col("names")).alias("fqn"), build_fqn(F.col("record_id"), F.col("owner")).alias("owner"), position.alias("position"), *kept)


_ANNOTATIONS = "array<struct<name:string,arguments:string>>"


def body_graph(objects: DataFrame, types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of nested classes, companions, functions, properties, constructors, parameters and annotations, and their edges.

    objects: `body_objects`; types: nodes that RETURNS may lead to, found by name, a class before an interface. Nested types get no edge from their
    owner, as members do; parameters of one function are told apart by position and name; annotations of one name are one node.
    """
    o = objects
    label = F.when(F.col("kind") == "companion", "Object").when(F.col("kind") == "class", graph.label_of(F.coalesce("class_kind", F.lit("class")))).otherwise(F.initcap("kind"))
    declared = o.where("kind <> 'parameter'")
    owner = F.when(F.col("kind") != "class", F.col("owner"))
    names = F.when(F.col("kind") == "companion", F.coalesce("name", F.lit("Companion"))).when(F.col("kind") != "constructor", F.col("name"))
    nodes = _nodes(declared, label, F.col("fqn"), names, declaring_type=owner, visibility=F.col("visibility"))
    p = o.where("kind = 'parameter'").withColumn("key", F.concat("owner", F.lit("#"), F.coalesce("position", F.lit(0)), F.lit(":"), F.coalesce("name", F.lit(""))))
    functions = o.where("kind = 'function'")
    marks = functions.select("fqn", F.explode(F.from_json(F.when(F.ltrim("annotations").startswith("{"), F.concat(F.lit("["), "annotations", F.lit("]"))).otherwise(F.col("annotations")), _ANNOTATIONS)).alias("a")).where("a.name is not null").select("fqn", F.concat(F.lit("@"), "a.name").alias("key"))
    parts = [nodes, _nodes(p, F.lit("Parameter"), F.col("key"), F.col("name")), _nodes(marks.select("key").distinct(), F.lit("Annotation"), F.col("key"), F.col("key"))]
    returned = functions.select(F.col("fqn").alias("src"), F.explode(type_names(F.col("return_type"))).alias("ref")).distinct()
    edges = [
        _edges(declared.where("kind <> 'class'").select(F.col("owner").alias("src"), F.col("fqn").alias("dst")).distinct(), "DECLARES"),
        _edges(p.groupBy(F.col("owner").alias("src"), F.col("key").alias("dst")).agg(F.min(F.coalesce("position", F.lit(0))).alias("at")), "HAS_PARAMETER", F.col("at")),
        _edges(marks.select(F.col("fqn").alias("src"), F.col("key").alias("dst")).distinct(), "ANNOTATED_WITH"),
        _edges(graph._resolve(returned, types, [("Class", "name"), ("Interface", "name")]), "RETURNS"),
    ]
    merged = _union(parts).where("key is not null").groupBy("label", "key").agg(*[F.min(c).alias(c) for c in NODE_COLUMNS[2:]])
    return merged, _union(edges).where("src is not null and dst is not null")


def resolved_calls(calls: DataFrame, symbols: DataFrame, properties: DataFrame | None, libraries: DataFrame | None) -> DataFrame:
    """(src, dst, n): calls between functions that both are nodes, with their number."""
    f = symbols.where("kind = 'function' and fqn is not null").select(F.col("fqn").alias("to_fqn")).distinct()
    to = resolve.resolve_calls(calls, symbols, properties, libraries).join(f, "to_fqn", "left_semi")
    both = resolve.resolve_callers(calls, symbols).join(to, "call_id")
    return both.groupBy(F.col("from_fqn").alias("src"), F.col("to_fqn").alias("dst")).agg(F.count(F.lit(1)).alias("n"))


def build_graph(symbols: DataFrame, classes: DataFrame, calls: DataFrame, properties: DataFrame, bodies: DataFrame, projects: DataFrame, libraries: DataFrame, configured: list[tuple[str, list[str]]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all labels and types from the tables of declarations, calls and bodies.

    Symbols come first: a body adds what the symbols lack, under the same keys. Domains are the configured ones and those
    inferred from packages; they own packages and depend on each other by resolved calls.
    """
    scratch = Scratch(symbols.sparkSession)
    own = scratch.keep(graph.symbol_nodes(symbols, classes))
    objects = scratch.keep(body_objects(bodies))
    within, contains = containment(symbols, projects)
    added, body_edges = body_graph(objects, own)
    lacking = added.join(own.select("key"), "key", "left_anti")
    called = scratch.keep(resolved_calls(calls, symbols, properties, libraries))
    packages = symbols.select(F.col("package_name").alias("package")).where("package is not null").distinct()
    plan = domains.analyze_domains(packages, configured or [])
    domain = lambda c: F.concat(F.lit("domain:"), c)
    weights = domains.domain_weights(called.select(package_of_fqn(F.col("src")).alias("a"), package_of_fqn(F.col("dst")).alias("b"), "n"), plan)
    of_types = [
        _edges(graph.extends(symbols, own), "EXTENDS"), _edges(graph.implements(symbols, own), "IMPLEMENTS"), _edges(graph.declares(own), "DECLARES"),
        _edges(called, "CALLS", F.col("n")), _edges(graph.uses(symbols, own), "USES", context=F.col("context")), contains,
        _edges(plan.select(domain(F.col("domain")).alias("src"), F.concat(F.lit("package:"), "package").alias("dst")), "OWNS"),
        _edges(weights.select(domain(F.col("from_domain")).alias("src"), domain(F.col("to_domain")).alias("dst"), "weight"), "DEPENDS_ON", F.col("weight")),
    ]
    declared = _union([e for e in [of_types[2], body_edges]]).groupBy("rel_type", "src", "dst").agg(F.min("n").alias("n"), F.min("context").alias("context")).select(*EDGE_COLUMNS)
    edges = _union([*of_types[:2], *of_types[3:], declared])
    names = _nodes(plan.select("domain").distinct(), F.lit("Domain"), domain(F.col("domain")), F.col("domain"))
    return _union([own.select(*NODE_COLUMNS), lacking.select(*NODE_COLUMNS), within, names]), edges
