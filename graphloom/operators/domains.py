"""Domains inferred from packages, and their dependencies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Layers that are no domains.
LAYERS = ["domain", "application", "infrastructure", "presentation", "api", "impl", "internal"]


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def domain_of_package(package: Column, index: int = 2) -> Column:
    """The segment at `index`, or the next one after a layer name, in lower case; NULL if there is none."""
    parts = F.split(package, F.when(F.contains(package, F.lit("/")), "/").otherwise(r"\."))
    two = F.transform(F.slice(parts, index + 1, 2), F.lower)
    return _let(two, lambda t: F.nullif(F.when(F.get(t, F.lit(0)).isin(LAYERS), F.get(t, F.lit(1))).otherwise(F.get(t, F.lit(0))), F.lit("")))


def infer_domains(packages: DataFrame, index: int = 2) -> DataFrame:
    """(name, n_packages) of the domains of distinct packages (column package), names capitalized."""
    d = packages.where("package is not null").distinct().select(domain_of_package(F.col("package"), index).alias("domain")).where("domain is not null")
    return d.groupBy("domain").agg(F.count(F.lit(1)).alias("n_packages")).select(F.concat(F.upper(F.substr("domain", F.lit(1), F.lit(1))), F.substr("domain", F.lit(2))).alias("name"), "n_packages")


def glob_pattern(glob: str) -> str:
    """Anchored regular expression of a package pattern: `*` is one segment, `**` any number."""
    separator = "/" if "/" in glob else "."
    text = glob.replace(".", r"\.").replace("**", "\0").replace("*", f"[^{separator}]*").replace("\0", ".*")
    return f"^{text}$"


def assign_packages(packages: DataFrame, domains: list[tuple[str, list[str]]]) -> DataFrame:
    """(package, domain): the first configured domain with a pattern that matches; packages without are left out."""
    if not domains:
        return packages.select("package", F.lit(None).cast("string").alias("domain")).limit(0)
    name = F.coalesce(*[F.when(F.col("package").rlike("|".join(glob_pattern(p) for p in patterns)), F.lit(n)) for n, patterns in domains])
    return packages.select("package").distinct().select("package", name.alias("domain")).where("domain is not null")


def capitalized(name: Column) -> Column:
    return _let(name, lambda n: F.concat(F.upper(F.substring(n, 1, 1)), F.substr(n, F.lit(2))))


def analyze_domains(packages: DataFrame, configured: list[tuple[str, list[str]]], index: int = 2) -> DataFrame:
    """(package, domain): configured domains first, the rest inferred from the package's segment at `index`.

    An inferred domain with the name of a configured one, in any case, is dropped together with its packages.
    """
    p = packages.where("package is not null").select("package").distinct()
    assigned = assign_packages(p, configured)
    rest = p.join(assigned.select("package"), "package", "left_anti")
    inferred = rest.select("package", capitalized(domain_of_package(F.col("package"), index)).alias("domain")).where("domain is not null")
    taken = [n.lower() for n, _ in configured]
    return assigned.unionByName(inferred.where(~F.lower("domain").isin(taken)) if taken else inferred)


def domain_weights(calls: DataFrame, plan: DataFrame) -> DataFrame:
    """(from_domain, to_domain, weight): calls between different domains. calls: a, b (packages of both ends), n; plan: `analyze_domains`."""
    d = calls.join(plan.select(F.col("package").alias("a"), F.col("domain").alias("from_domain")), "a").join(plan.select(F.col("package").alias("b"), F.col("domain").alias("to_domain")), "b")
    return d.where("from_domain <> to_domain").groupBy("from_domain", "to_domain").agg(F.sum("n").alias("weight"))


def load_domains(spark: SparkSession, folder: str, names: tuple[str, ...] = ("domains.json",)) -> list[tuple[str, list[str]]]:
    """Domains of the first readable configuration file in a folder: `{"domains": [{"name": ..., "patterns": [...]}]}`; files that are no such JSON are skipped."""
    schema = "struct<domains:array<struct<name:string,patterns:array<string>>>>"
    for name in names:
        try:
            text = spark.read.text(f"{folder.rstrip('/')}/{name}", wholetext=True)
            first = text.select(F.from_json("value", schema).alias("c")).select("c.domains").first()
        except AnalysisException:  # no such file
            continue
        if first and first.domains:
            return [(d.name, list(d.patterns or [])) for d in first.domains if d and d.name]
    return []


def primary_language(files: DataFrame) -> DataFrame:
    """(language): the language of most files; of equally frequent ones the one seen first. files: language, seq."""
    n = files.where("language is not null").groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    return n.orderBy(F.desc("n"), "first").limit(1).select("language")
