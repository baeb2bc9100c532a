"""Deeply nested JSON records to flat tables that keep parent-child links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import Scratch, keyed

LEVELS = 4  # levels of one projection; deeper nodes go on in the next


def _fields_of(text: Column, schema: str) -> Column:
    """array<struct> of the fields, as text, of the objects that `text` lists; other elements are NULL.

    The plain case takes one parse. Elements that are neither object nor NULL spoil it, and then
    each element is read by itself.
    """
    slow = F.transform(
        F.from_json(text, "array<string>"),
        lambda e: F.when(F.ltrim(e).startswith("{"), F.element_at(F.from_json(F.concat(F.lit("["), e, F.lit("]")), f"array<struct<{schema}>>"), 1)),
    )
    return F.coalesce(F.from_json(text, f"array<struct<{schema}>>"), slow)


def _children(nodes: Column, fields: dict[str, str], single: set[str], schema: str, named: Callable | None) -> Column:
    """The objects one level below an array of nodes, with the path of their parent attached."""

    def below(n: Column) -> Column:
        held = F.array(*[
            F.struct(F.lit(f).alias("field"), F.lit(k).alias("kind"), F.lit(f in single).alias("single"), F.ltrim(n["j"][f]).alias("text"))
            for f, k in fields.items()
        ])

        def objects(h: Column) -> Column:
            listed = F.when(h["text"].startswith("{"), F.concat(F.lit("["), h["text"], F.lit("]"))).otherwise(h["text"])

            def child(j: Column, i: Column) -> Column:
                at = F.when(h["single"], F.lit("")).otherwise(F.concat(F.lit("["), i.cast("string"), F.lit("]")))
                path = F.concat(n["path"], F.lit("."), h["field"], at)
                own = [F.concat_ws(".", n["names"], named(h["kind"], j, i)).alias("names"), n["names"].alias("owner")] if named else []
                return F.struct(path.alias("path"), n["path"].alias("parent"), h["kind"].alias("kind"), *own, j.alias("j"))

            return F.transform(_fields_of(listed, schema), child)

        asked = F.filter(held, lambda h: (h["text"].startswith("[") | h["text"].startswith("{")) & (h["text"] != "[]"))
        return F.flatten(F.filter(F.transform(asked, objects), lambda a: a.isNotNull()))

    return F.filter(F.flatten(F.transform(nodes, below)), lambda c: c["j"].isNotNull())


class FlatTables:
    """The nodes of all records; `table` gives one flat table, or the links of all kinds."""

    def __init__(self, blocks: list[DataFrame]):
        self._blocks = blocks

    def table(self, kind: str | None = None) -> DataFrame:
        """(record_id, node_path, parent_path, kind, attributes...) of one kind, or of all."""
        parts = []
        for b in self._blocks:
            nodes = F.col("nodes") if kind is None else F.filter("nodes", lambda n: n["kind"] == kind)
            parts.append(b.select("record_id", F.inline(nodes)))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.withColumnsRenamed({"path": "node_path", "parent": "parent_path"})


def flatten_records(
    records: DataFrame,
    fields: dict[str, str],
    single: set[str] = frozenset(),
    root_kind: str = "body",
    attributes: dict[str, tuple[str, str]] | None = None,
    named: Callable[[Column, Column, Column], Column] | None = None,
) -> FlatTables:
    """Flat tables of the objects nested in JSON text at any depth.

    records: record_id, version, body (JSON text). Of a record delivered several times the row with
    the greatest version counts, of equal versions the greatest body; NULL versions are the oldest.
    Bodies that are not a JSON object (NULL, empty, cut off, arrays) give no row; a NULL record_id is
    a record of its own. fields: field -> kind of the objects in it; single: fields that hold one
    object, whose path has no index. Text that holds JSON stands for what it holds; NULL elements
    keep their index. attributes: column -> (field, Spark type) of every node; values that cannot
    be cast are NULL. named(kind, fields, index): a node's own name; with it every node has names, the names from the record's
    first level down to it joined by points, and owner, the names of its parent (NULL below the record itself).

    Method: nested transform calls parse the fields of a level as text, attach the ancestor's path
    and the index to every child, flatten joins the arrays of a level, and one inline per target
    table emits rows. One projection covers LEVELS levels; records that go deeper, few as a rule,
    carry their open nodes into the same projection again, so the depth is not bounded. No step
    but the choice among several deliveries of one record shuffles.
    """
    attributes = attributes or {}
    scratch = Scratch(records.sparkSession)
    # Only records that came more than once have to meet; the others stay where they were read.
    records = records.select("record_id", "version", "body")
    known = records.where("record_id is not null")
    repeated = scratch.keep(known.groupBy("record_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("record_id"))
    met = keyed(known, repeated, ["record_id"]).unionByName(records.where("record_id is null"))
    met = met.groupBy("record_id").agg(F.max(F.struct("version", "body")).alias("b")).select("record_id", F.col("b.body").alias("body"))
    newest = keyed(known, repeated, ["record_id"], "left_anti").select("record_id", "body").unionByName(met)
    schema = ",".join(f"`{n}`:string" for n in dict.fromkeys([*fields, *(f for f, _ in attributes.values())]))
    # As the only element of an array a body in quotes loses them, and one cut off or followed by more is no JSON.
    j = _fields_of(F.concat(F.lit("["), F.col("body"), F.lit("]")), schema)
    none = F.lit(None).cast("string")
    names = [none.alias("names"), none.alias("owner")] if named else []
    root = F.array(F.struct(F.lit("$").alias("path"), F.lit("").alias("parent"), F.lit(root_kind).alias("kind"), *names, "j"))
    frontier = newest.select("record_id", j.alias("a")).where("size(a) = 1").select("record_id", F.element_at("a", 1).alias("j")).where("j is not null").select("record_id", root.alias("open"))

    def bare(n: Column) -> Column:
        own = [n["j"][f].try_cast(kind).alias(a) for a, (f, kind) in attributes.items()]
        of = [n[c].alias(c) for c in ("names", "owner")] if named else []
        return F.struct(n["path"].alias("path"), n["parent"].alias("parent"), n["kind"].alias("kind"), *of, *own)

    blocks = []
    while True:
        df = frontier.withColumnRenamed("open", "p0")
        for k in range(LEVELS):
            df = df.withColumn(f"p{k + 1}", _children(F.col(f"p{k}"), fields, set(single), schema, named))
        nodes = F.flatten(F.array(*[F.transform(f"p{k}", bare) for k in range(LEVELS)]))
        rest = F.col(f"p{LEVELS}")
        block = scratch.keep(df.select("record_id", nodes.alias("nodes"), F.when(F.size(rest) > 0, rest).alias("open")))
        blocks.append(block.select("record_id", "nodes"))
        frontier = block.where("open is not null").select("record_id", "open")
        if not frontier.limit(1).count():
            return FlatTables(blocks)
