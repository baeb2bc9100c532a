import random

from conftest import rows
from pyspark.sql import functions as F

from graphloom.functions.output import compact
from graphloom.functions.text import function_name, reference_text
from graphloom.functions.types import is_type_compatible, overload_score, package_of_fqn, type_names
from graphloom.operators import domains, traversal
from graphloom.sources import files
from graphloom.sources.store import GraphStore

def _edges(spark, pairs):
    return spark.createDataFrame([(a, b, 1) for a, b in pairs], "src string, dst string, calls long")


def _one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(column(F.col("v"))).collect()]


def _trails(edges, start, depth):
    out, stack = set(), [(start, ())]
    while stack:
        x, used = stack.pop()
        for e in edges:
            if e[0] == x and e not in used and len(used) < depth:
                out.add((start, e[1], len(used) + 1))
                stack.append((e[1], (*used, e)))
    return sorted(out, key=repr)


def test_trails_and_depths_of_random_graphs(spark):
    r = random.Random(11)
    edges = sorted({(f"n{r.randrange(8)}", f"n{r.randrange(8)}") for _ in range(16)})
    e, s = _edges(spark, edges), spark.createDataFrame([("n0",), ("n1",)], "node string")
    assert rows(traversal.trails(e, s, 4), "start", "node", "depth") == sorted(_trails(edges, "n0", 4) + _trails(edges, "n1", 4), key=repr)
    best = {}
    for n in {x for p in edges for x in p}:
        seen, frontier, d = {}, {n}, 0
        while frontier and d < 20:
            d += 1
            frontier = {b for a, b in edges if a in frontier} - set(seen)
            seen |= {x: d for x in frontier}
        best |= {(n, x): d for x, d in seen.items()}
    assert {(a, b): d for a, b, d in rows(traversal.closure(e), "start", "node", "depth")} == best
    got = {(a, b): d for a, b, d in rows(traversal.least_depths(e, s), "start", "node", "depth")}
    assert got == {k: v for k, v in best.items() if k[0] in ("n0", "n1")}


def test_shortest_path(spark):
    e = _edges(spark, [("a", "b"), ("c", "b"), ("c", "d"), ("a", "x"), ("x", "d"), ("q", "q")])
    n = lambda *v: spark.createDataFrame([(x,) for x in v], "node string")
    path = lambda *a: [r.node for r in sorted(traversal.shortest_path(e, *a).collect())]
    assert path(n("a"), n("d")) == ["a", "x", "d"]
    assert path(n("a"), n("q")) == [] and path(n("q"), n("q")) == []
    assert path(n("a"), n("c"), 1) == []


def test_names(spark):
    assert _one(spark, reference_text, " a.B <C>? ", "a.B?", "<T>", "", None, " a.B ? ") == ["a.B", "a.B", None, None, None, "a.B"]
    assert _one(spark, function_name, " `f` ", "f()", "`f()`", "F", None, "`f") == ["f", "f", "f", "F", None, "`f"]
    assert _one(spark, type_names, "Map<UserId, List<User>?>", "String", None) == [["UserId", "User"], [], None]
    assert _one(spark, package_of_fqn, "com.a.Outer.Inner.f", "run", "com.a.f") == ["com.a", "run", "com.a"]


def test_overloads(spark):
    df = spark.createDataFrame([(["Int"], ["Int"]), (["Int"], ["Long"]), (["Int", "X"], ["Int"]), ([], ["Int"]), (["Unknown"], ["Int"]), (["A"], ["B"])], "a array<string>, p array<string>")
    assert [r[0] for r in df.select(overload_score(F.col("a"), F.col("p"))).collect()] == [150, 125, 49, 50, 100, 90]
    assert _one(spark, lambda c: is_type_compatible(c, F.lit("CharSequence")), "String", "Int", None) == [True, False, False]
    fits = lambda p, *v: _one(spark, lambda c: is_type_compatible(c, F.lit(p)), *v)
    assert fits("Long", "Int", "Double", "Long?", "Nothing", "never", "any", "Char") == [True, False, True, True, True, True, False]
    assert fits("ReadonlyArray", "Array", "Array<X>", "List") == [False, False, False]  # capitals: no assignment of TypeScript is asked
    assert fits("undefined", "void", "null", "number") == [True, False, False] and fits("Iterable", "Collection", "List") == [True, False]
    assert fits("Comparable", "String") == [False] and fits("Any", "X") == [True] and fits("Object", "X") == [False]


def test_files_and_modules(spark):
    keep = lambda *v: _one(spark, files.should_parse, *v)
    assert keep("/p/src/A.kt", "/p/build/A.kt", "/p/vite.config.ts", "/p/a.d.ts", "/p/a.min.js", "/p/tsconfig.json", None) == [True, False, False, False, False, False, None]
    assert _one(spark, files.is_test_file, "/p/src/test/A.kt", "/p/ATest.kt", "/p/a.spec.ts", "/p/latest.ts") == [True, True, True, False]
    assert _one(spark, lambda c: files.module_path(c, F.lit("/p")), "/p/src/components/User.ts", "/p/lib/src/a/b/C.ts", "/p/src/x.ts", "/q/a/b.ts") == ["components", "a/b", None, None]
    assert _one(spark, files.with_ancestors, "a/b/c") == [["a", "a/b", "a/b/c"]]
    assert _one(spark, files.imports, "import a.b.C\nimport static x.y.*;\nimport { Q } from './q'\nconst z = require('zz')\n") == [["a.b.C", "x.y.*", "./q", "zz"]]


def test_scanned_directories(spark):
    enter = lambda *v: _one(spark, files.should_scan, *v)
    assert enter("/p/src", "/p/node_modules", "/p/.angular", "/p/ios/App/public", "/p/.angular/x", "/p/building", None) == [True, False, False, False, False, True, None]
    reach = lambda *v: _one(spark, lambda c: files.scanned(c, F.lit("/build/p"), ("gen",)), *v)
    assert reach("/build/p/a/b.kt", "/build/p/b.kt", "/build/p/dist/b.kt", "/build/p/gen/b.kt", "/q/b.kt") == [True, True, False, False, False]


def test_domain_plan(spark):
    p = spark.createDataFrame([("com.x.order",), ("com.x.order.api",), ("com.x.payment",), ("com.x.user",), ("com.x.core",), ("a",), (None,)], "package string")
    plan = domains.analyze_domains(p, [("Core", ["com.x.user"])])
    assert rows(plan, "package", "domain") == sorted([("com.x.order", "Order"), ("com.x.order.api", "Order"), ("com.x.payment", "Payment"), ("com.x.user", "Core")])
    calls = spark.createDataFrame([("com.x.order", "com.x.payment", 1), ("com.x.order.api", "com.x.user", 1), ("com.x.order", "com.x.order.api", 5), ("com.x.order", "gone", 1)], "a string, b string, n long")
    assert rows(domains.domain_weights(calls, plan), "from_domain", "to_domain", "weight") == [("Order", "Core", 1), ("Order", "Payment", 1)]
    langs = spark.createDataFrame([("java", 3), ("kotlin", 1), ("kotlin", 4), ("java", 2), (None, 0)], "language string, seq long")
    assert [r.language for r in domains.primary_language(langs).collect()] == ["kotlin"]


def test_domain_configuration(spark, tmp_path):
    assert domains.load_domains(spark, str(tmp_path)) == []
    (tmp_path / "domains.json").write_text('{"domains": [{"name": "A", "patterns": ["com.a.**"]}, {"name": null}]}')
    assert domains.load_domains(spark, str(tmp_path)) == [("A", ["com.a.**"])]
    (tmp_path / "domains.json").write_text("no json")
    assert domains.load_domains(spark, str(tmp_path)) == []


def test_domains(spark):
    assert _one(spark, domains.domain_of_package, "com.example.payment.x", "com.example.domain.Order", "com.example", None) == ["payment", "order", None, None]
    p = spark.createDataFrame([("com.a.b",), ("com.a.b.c",), ("x",)], "package string")
    assert rows(domains.assign_packages(p, [("One", ["com.*.b"]), ("All", ["com.**"])])) == [("com.a.b", "One"), ("com.a.b.c", "All")]


def test_store_and_output(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"))
    nodes = spark.createDataFrame([("Class", "a", "A", "/p/A.kt"), ("Class", "b", "B", "/q/B.kt"), ("Package", "k", "k", None)], "label string, key string, name string, file_path string")
    edges = spark.createDataFrame([("EXTENDS", "a", "b"), ("CONTAINS", "k", "b")], "rel_type string, src string, dst string")
    store.write(nodes, edges)
    assert store.nodes().count() == 3 and store.edges().count() == 2
    store.clear("/p")
    assert rows(store.nodes(), "key") == [("b",), ("k",)] and rows(store.edges(), "rel_type") == [("CONTAINS",)]
    assert compact(store.nodes().orderBy("key"), "NODES", ["name", "file_path"]) == "NODES (2):\nB | /q/B.kt\nk | "
    assert compact(store.nodes().orderBy("key"), "NODES", ["name"], limit=1) == "NODES (2):\nB"
    store.clear()
    assert compact(store.nodes(), "NODES", ["name"]) == "NODES: No results found."


def test_store_splits_a_large_label(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"))
    nodes = spark.range(4000).select(F.lit("Function").alias("label"), F.col("id").cast("string").alias("key"), F.format_string("f%05d", "id").alias("name"), F.lit("/p/A.kt").alias("file_path"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together again
    try:
        name = store.write(nodes, spark.createDataFrame([("CALLS", "1", "2")], "rel_type string, src string, dst string"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "g" / name / "nodes" / "label=Function").glob("*.parquet"))) > 1
