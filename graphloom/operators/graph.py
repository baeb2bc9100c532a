"""The code graph: merged nodes and typed edges as DataFrames.

Nodes have (label, key, name, file_path, line_number, declaring_type, package_name, visibility),
edges (src, dst) by node key, one row a pair. All joins are equality joins on keys or names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import function_name, reference_text
from graphloom.functions.types import type_names

CLASS_KINDS, OWNER_LABELS = ["class", "enum", "annotation"], ["Class", "Interface", "Object"]


def label_of(kind: Column) -> Column:
    """Node label of a symbol kind; enums and annotations are classes."""
    return F.when(kind.isin(CLASS_KINDS), "Class").otherwise(F.initcap(kind))


def merge_overlay(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row a key: of every column the last value that is not NULL, by `order` (merge with per-property overlay)."""
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(*last)


def symbol_nodes(symbols: DataFrame, classes: DataFrame) -> DataFrame:
    """Class, Interface, Object, Function and Property nodes by fqn; rows without fqn or kind are no nodes."""
    merged = merge_overlay(symbols, "fqn", "ins_seq", ["name", "kind", "file_path", "line_number", "declaring_type_fqn", "package_name"])
    seen = merge_overlay(classes, "fqn", "write_seq", ["visibility"])
    return (
        merged.where("kind is not null").join(seen, "fqn", "left")
        .select(label_of(F.col("kind")).alias("label"), F.col("fqn").alias("key"), "name", "file_path", "line_number",
                reference_text(F.col("declaring_type_fqn")).alias("declaring_type"), "package_name", "visibility")
    )


def declares(nodes: DataFrame) -> DataFrame:
    """Owner type -> function or property."""
    owners = nodes.where(F.col("label").isin(OWNER_LABELS)).select(F.col("key").alias("src"))
    members = nodes.where(F.col("label").isin("Function", "Property")).select(F.col("declaring_type").alias("src"), F.col("key").alias("dst"))
    return members.join(owners, "src", "left_semi").select("src", "dst")


def _resolve(refs: DataFrame, nodes: DataFrame, tiers: list[tuple[str, str]]) -> DataFrame:
    """(src, dst) of (src, ref): the first tier (label, column) in which ref is found, with all its matches."""
    targets = None
    for rank, (label, column) in enumerate(tiers):
        t = nodes.where(F.col("label") == label).select(F.col(column).alias("ref"), F.col("key").alias("dst"), F.lit(rank).alias("rank"))
        targets = t if targets is None else targets.unionByName(t)
    # The best tier of a text is a property of the text: it is settled once among the targets, before the references meet them.
    targets = targets.where("ref is not null")
    best = targets.groupBy("ref").agg(F.min("rank").alias("rank"))
    return refs.join(targets.join(best, ["ref", "rank"]), "ref").select("src", "dst").distinct()


def extends(symbols: DataFrame, nodes: DataFrame) -> DataFrame:
    """Type -> superclass: a class by fqn, else by name, else an interface by fqn, else by name."""
    refs = merge_overlay(symbols, "fqn", "ins_seq", ["super_class"]).select(F.col("fqn").alias("src"), reference_text(F.col("super_class")).alias("ref"))
    owners = nodes.where(F.col("label").isin(OWNER_LABELS)).select(F.col("key").alias("src"))
    return _resolve(refs.where("ref is not null").join(owners, "src", "left_semi"), nodes, [("Class", "key"), ("Class", "name"), ("Interface", "key"), ("Interface", "name")])


def implements(symbols: DataFrame, nodes: DataFrame) -> DataFrame:
    """Type -> interface, by fqn, else by name."""
    refs = merge_overlay(symbols, "fqn", "ins_seq", ["interfaces"]).select(F.col("fqn").alias("src"), F.explode("interfaces").alias("i")).select("src", reference_text(F.col("i")).alias("ref"))
    owners = nodes.where(F.col("label").isin(OWNER_LABELS)).select(F.col("key").alias("src"))
    return _resolve(refs.where("ref is not null").distinct().join(owners, "src", "left_semi"), nodes, [("Interface", "key"), ("Interface", "name")])


def uses(symbols: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, context): function -> type named in a parameter or receiver; a type named in both counts as parameter."""
    f = merge_overlay(symbols.where("kind = 'function'"), "fqn", "ins_seq", ["param_types", "receiver_type"])
    rows = f.select(F.col("fqn").alias("src"), F.explode(F.concat(
        F.transform(F.flatten(F.transform(F.coalesce("param_types", F.array().cast("array<string>")), type_names)), lambda t: F.struct(t.alias("ref"), F.lit(0).alias("prio"))),
        F.transform(F.coalesce(type_names(F.col("receiver_type")), F.array().cast("array<string>")), lambda t: F.struct(t.alias("ref"), F.lit(1).alias("prio"))),
    )).alias("x")).select("src", "x.*")
    first = rows.groupBy("src", "ref").agg(F.min("prio").alias("prio"))
    found = _resolve_with(first, nodes, [("Class", "name"), ("Interface", "name")])
    return found.groupBy("src", "dst").agg(F.min("prio").alias("prio")).select("src", "dst", F.when(F.col("prio") == 0, "parameter").otherwise("receiver").alias("context"))


def _resolve_with(refs: DataFrame, nodes: DataFrame, tiers: list[tuple[str, str]]) -> DataFrame:
    pairs = _resolve(refs.select(F.col("ref").alias("src"), "ref").distinct(), nodes, tiers).select(F.col("src").alias("ref"), "dst")
    return refs.join(pairs, "ref")


def call_edges(calls: DataFrame) -> DataFrame:
    """(src, dst, calls): function -> called function with the number of calls, from rows by name.

    A function is `class.function`, or `function` where the class is unknown; names without
    function are left out. Exact duplicates of a row are one delivery and count once.
    """
    def key(side: str) -> Column:
        owner, name = function_name(F.col(f"{side}_class_name")), function_name(F.col(f"{side}_function_name"))
        return F.when(name != "", F.when(owner != "", F.concat(owner, F.lit("."), name)).otherwise(name))

    once = calls.select("call_id", key("caller").alias("src"), key("callee").alias("dst")).where("src is not null and dst is not null").distinct()
    return once.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("calls"))
