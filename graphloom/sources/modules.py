"""Modules of TypeScript and JavaScript: what files export, and which files their relative imports name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Endings that an import may leave out, in the order they are tried.
ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
_DECLARED = r"(?m)^(?:export\s+)?(?:default\s+)?(?:declare\s+|abstract\s+|async\s+)*(?:class|interface|enum|function\s*\*?|const|let|var|type)\s+([A-Za-z_$][\w$]*)"
_REEXPORTED = r"""export\s*\{([^}]*)\}\s*from\s*["']([^"']+)["']"""
_NAMED = r"""import\s+(?:type\s+)?(?:[\w$]+\s*,\s*)?\{([^}]*)\}\s*from\s*["']([^"']+)["']"""
_WHOLE = r"""(?:import\s+([A-Za-z_$][\w$]*)\s+from\s*|(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*require\(\s*)["']([^"']+)["']"""


def _pairs(text: Column, pattern: str, *groups: int) -> Column:
    """array<struct> of the groups of all matches, as g0, g1 and so on."""
    parts = [F.regexp_extract_all(text, F.lit(pattern), g) for g in groups]
    return F.arrays_zip(*[p.alias(f"g{i}") for i, p in enumerate(parts)])


def _items(listed: Column) -> Column:
    """array<struct<name, local>> of a list such as `a, b as c`."""
    every = F.transform(F.split(listed, ","), lambda x: F.split(F.regexp_replace(F.btrim(x, F.lit(" \t\r\n")), r"^type\s+", ""), r"\s+as\s+"))
    return F.transform(F.filter(every, lambda p: F.get(p, F.lit(0)) != ""), lambda p: F.struct(F.get(p, F.lit(0)).alias("name"), F.coalesce(F.get(p, F.lit(1)), F.get(p, F.lit(0))).alias("local")))


def export_index(files: DataFrame) -> DataFrame:
    """(file_path, name, original, source): names that a file offers, each once.

    files: file_path, text. Every declaration at the beginning of a line counts as offered; re-exported names have the module they come
    from in source and their name there in original. Of equal names a re-export counts, as it stands later. NULL texts offer nothing.
    """
    own = files.select("file_path", F.explode(F.regexp_extract_all("text", F.lit(_DECLARED), 1)).alias("name")).select("file_path", "name", F.col("name").alias("original"), F.lit(None).cast("string").alias("source"))
    again = files.select("file_path", F.inline(_pairs(F.col("text"), _REEXPORTED, 1, 2)).alias("listed", "source")).select("file_path", "source", F.inline(_items(F.col("listed"))).alias("original", "name"))
    both = own.unionByName(again.select("file_path", "name", "original", "source"))
    return both.groupBy("file_path", "name").agg(F.max(F.struct(F.col("source").isNotNull(), "source", "original")).alias("s")).select("file_path", "name", "s.original", "s.source")


def imports_of(files: DataFrame) -> DataFrame:
    """(file_path, name, local, module): names that a file imports; a whole module or its default has its own local name as name. Distinct."""
    named = files.select("file_path", F.inline(_pairs(F.col("text"), _NAMED, 1, 2)).alias("listed", "module")).select("file_path", "module", F.inline(_items(F.col("listed"))).alias("name", "local"))
    whole = files.select("file_path", F.inline(_pairs(F.col("text"), _WHOLE, 1, 2, 3)).alias("a", "b", "module")).withColumn("name", F.concat("a", "b"))
    return named.select("file_path", "name", "local", "module").unionByName(whole.select("file_path", "name", F.col("name").alias("local"), "module")).distinct()


def joined_path(folder: Column, module: Column) -> Column:
    """The path that a relative module names from a folder, with `.` and `..` resolved."""

    def step(done: Column, part: Column) -> Column:
        return F.when(part.isin("", "."), done).when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    parts = F.aggregate(F.split(F.concat(folder, F.lit("/"), module), "/"), F.array().cast("array<string>"), step)
    return F.concat(F.when(folder.startswith("/"), "/").otherwise(""), F.array_join(parts, "/"))


def resolve_modules(asked: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, module, target): the file a relative import names: as it is, with an ending, or an index file; the first that exists.

    asked: file_path, module; files: file_path. Modules of packages and those without a file have no row. Candidates are looked up by equality.
    """
    relative = asked.where(F.col("module").startswith("./") | F.col("module").startswith("../")).select("file_path", "module").distinct()
    base = relative.withColumn("base", joined_path(F.regexp_replace("file_path", "/[^/]*$", ""), F.col("module")))
    ends = F.array(*[F.lit(x) for x in ("", *ENDINGS, *(f"/index{e}" for e in ENDINGS))])
    tried = base.select("file_path", "module", "base", F.posexplode(ends).alias("at", "ending")).select("file_path", "module", "at", F.concat("base", "ending").alias("target"))
    found = tried.join(files.select(F.col("file_path").alias("target")).distinct(), "target")
    return found.groupBy("file_path", "module").agg(F.min_by("target", "at").alias("target"))


def resolve_imports(imports: DataFrame, index: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, local, name, module, target, origin, origin_name): where an imported name comes from; one re-export is followed.

    imports: `imports_of`; index: `export_index`. Names that the target does not offer have no row.
    """
    target = resolve_modules(imports, files)
    there = imports.join(target, ["file_path", "module"]).join(index.withColumnRenamed("file_path", "target"), ["target", "name"])
    onward = resolve_modules(there.where("source is not null").select(F.col("target").alias("file_path"), F.col("source").alias("module")), files)
    onward = onward.select(F.col("file_path").alias("target"), F.col("module").alias("source"), F.col("target").alias("next"))
    offered = index.where("source is null").select(F.col("file_path").alias("next"), F.col("name").alias("original"), F.lit(True).alias("known"))
    out = there.join(onward, ["target", "source"], "left").join(offered, ["next", "original"], "left")
    return out.select("file_path", "local", "name", "module", "target", F.when(F.col("known"), F.col("next")).otherwise(F.col("target")).alias("origin"), F.when(F.col("known"), F.col("original")).otherwise(F.col("name")).alias("origin_name"))
