"""The questions of the code graph on a small graph with computed answers."""

import pytest
from conftest import rows

from graphloom.operators import graph_tools as tools

NODES = [
    ("Interface", "com.a.Store", "Store", "/p/Store.kt", 1, None, "public"), ("Class", "com.a.Repo", "Repo", "/p/Repo.kt", 1, None, "public"),
    ("Class", "com.a.MemRepo", "MemRepo", "/p/MemRepo.kt", 1, None, "internal"), ("Class", "com.a.Ctl", "Ctl", "/p/Ctl.kt", 1, None, None),
    ("Function", "com.a.Repo.save", "save", "/p/Repo.kt", 10, "com.a.Repo", "public"), ("Function", "com.a.Ctl.handle", "handle", "/p/Ctl.kt", 5, "com.a.Ctl", "public"),
    ("Function", "com.b.run", "run", "/p/main.kt", 3, None, "public"), ("Function", "com.a.MemRepo.save", "save", "/p/MemRepo.kt", 8, "com.a.MemRepo", "private"),
]
EDGES = [
    ("DECLARES", "com.a.Repo", "com.a.Repo.save"), ("DECLARES", "com.a.MemRepo", "com.a.MemRepo.save"), ("DECLARES", "com.a.Ctl", "com.a.Ctl.handle"),
    ("IMPLEMENTS", "com.a.Repo", "com.a.Store"), ("EXTENDS", "com.a.MemRepo", "com.a.Repo"), ("USES", "com.a.Ctl.handle", "com.a.Repo"),
    ("CALLS", "com.a.Ctl.handle", "com.a.Repo.save"), ("CALLS", "com.b.run", "com.a.Ctl.handle"), ("CALLS", "com.a.Repo.save", "com.a.Repo.save"),
    ("CALLS", "com.a.Repo.save", "com.b.run"), ("CALLS", "com.b.run", "com.a.Repo.save"),
]


@pytest.fixture(scope="module")
def g(spark):
    n = spark.createDataFrame(NODES, "label string, key string, name string, file_path string, line_number int, declaring_type string, visibility string")
    e = spark.createDataFrame([(*x, None) for x in EDGES], "rel_type string, src string, dst string, n long")
    return n, e


def _list(df, *columns):
    """Rows in the order they come."""
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_callers(g):
    at = lambda d, **kw: _list(tools.get_callers(*g, "save", depth=d, **kw), "depth", "class_name", "function_name")
    assert at(1) == [(1, "Ctl", "handle"), (1, None, "run")]
    assert at(2) == [(1, "Ctl", "handle"), (1, None, "run"), (2, "Ctl", "handle"), (2, None, "run")]
    assert sorted(r[::2] for r in at(5)) == sorted([(d, "handle") for d in range(1, 5)] + [(d, "run") for d in range(1, 6)])
    assert at(1, class_name="MemRepo") == [] and len(at(1, class_name="Repo")) == 2
    assert at(1, project_path="/p/C") == [(1, "Ctl", "handle")] and at(1, project_path="/q") == []


def test_callees(g):
    assert _list(tools.get_callees(*g, "handle"), "depth", "class_name", "function_name", "file_path", "line_number") == [
        (1, "Repo", "save", "/p/Repo.kt", 10), (2, "Repo", "save", "/p/Repo.kt", 10), (2, None, "run", "/p/main.kt", 3),
    ]
    assert _list(tools.get_callees(*g, "handle", project_path="/q"), "depth") == []


def test_two_functions_calling_each_other(spark, g):
    n = spark.createDataFrame([("Function", k, k, "/f", 1, None, None) for k in "fg"], g[0].schema)
    e = spark.createDataFrame([("CALLS", "f", "g", 1), ("CALLS", "g", "f", 1)], g[1].schema)
    assert _list(tools.get_callers(n, e, "g", depth=3), "depth", "function_name") == [(1, "f")]


def test_impact(g):
    of = lambda *a: _list(tools.get_impact(*g, *a), "name", "type", "impact_type", "depth")
    assert of("save", "function", 3) == [("handle", "function", "caller", 1), ("run", "function", "caller", 1)]
    assert of("Repo") == [("Ctl", "Class", "dependent", 1), ("MemRepo", "class", "child", 1)]
    assert of("Store") == [("Repo", "class", "implementor", 1)] and of("Repo", "property") == [] and of("Repo", "interface") == []


def test_implementations(g):
    of = lambda **kw: _list(tools.get_implementations(*g, "Store", **kw), "kind", "name")
    assert of() == [("direct", "Repo")] and of(include_indirect=True) == [("direct", "Repo"), ("indirect", "MemRepo")]
    assert of(project_path="/q") == [] and rows(tools.get_implementations(*g, None, True), "kind", "name") == [("direct", "Repo"), ("indirect", "MemRepo")]


def test_neighbors(spark, g):
    of = lambda *a, **kw: _list(tools.get_neighbors(*g, *a, **kw), "direction", "name", "type")
    assert of("Repo") == [("outgoing", "Store", "Interface"), ("incoming", "MemRepo", "Class"), ("incoming", "Ctl", "Class")]
    assert of("Repo", "outgoing") == [("outgoing", "Store", "Interface")] and of("Repo", project_path="/p/Mem") == [("incoming", "MemRepo", "Class")]
    more = spark.createDataFrame([("Interface", "x.Out", "Out", None, None, None, None)], g[0].schema).unionByName(g[0])
    e = spark.createDataFrame([("IMPLEMENTS", "com.a.Ctl", "x.Out", None)], g[1].schema).unionByName(g[1])
    assert _list(tools.get_neighbors(more, e, "Ctl"), "name") == [("Repo",)]
    assert _list(tools.get_neighbors(more, e, "Ctl", include_external=True), "name") == [("Out",), ("Repo",)]


def test_find_path(g):
    of = lambda *a, **kw: _list(tools.find_path(*g, *a, **kw), "name", "type", "relationship")
    assert of("Ctl", "Store") == [("Ctl", "class", "DECLARES"), ("handle", "function", "USES"), ("Repo", "class", "IMPLEMENTS"), ("Store", "interface", None)]
    assert of("Ctl", "Store", relationship_types=["CALLS"]) == [] and of("Ctl", "Store", 2) == [] and of("Ctl", "Store", project_path="/q") == []


def test_search_and_file_symbols(g):
    n = g[0]
    assert len(_list(tools.search_nodes(n, "SAVE"), "key")) == 2 and _list(tools.search_nodes(n, "SAVE", exact_match=True), "key") == []
    assert len(_list(tools.search_nodes(n, "sav.", exact_match=True), "key")) == 2 and len(_list(tools.search_nodes(n, "", limit=0), "key")) == 1
    assert _list(tools.search_nodes(n, "save", project_path="/p/Mem"), "key") == [("com.a.MemRepo.save",)]
    assert _list(tools.get_file_symbols(n, "Repo.kt"), "line_number", "name") == [(1, "MemRepo"), (1, "Repo"), (8, "save"), (10, "save")]
    assert _list(tools.get_file_symbols(n, "/p/MemRepo.kt", include_private=False), "name") == [("MemRepo",)]


def test_status_and_projects(spark, g):
    assert rows(tools.status(*g, ["Class", "Package"], ["CALLS", "RETURNS"])) == [("node", "Class", 3), ("relationship", "CALLS", 5)]
    p = spark.createDataFrame([("/p",), ("/pq",)], "path string")
    assert rows(tools.validate_project(p, "/pq/a.kt")) == [("/p",), ("/pq",)] and rows(tools.validate_project(p, "/x")) == []
