import json

from conftest import rows

from graphloom.operators import code_graph, resolve

SYMBOL = "fqn string, name string, kind string, package_name string, parent_fqn string, declaring_type_fqn string, super_class string, interfaces array<string>, receiver_type string, param_types array<string>, is_extension boolean, file_path string, line_number int, ins_seq long"
CALL = "call_id long, callee_function_name string, callee_class_name string, receiver string, caller_class_name string, caller_function_name string, arg_types array<string>, file_path string"


def _type(fqn, up=None, over=None, kind="class", seq=50, package="p", file="/p/x.kt"):
    return (fqn, fqn.split(".")[-1], kind, package, None, None, up, over, None, None, None, file, 1, seq)


def _function(fqn, of=None, on=None, seq=9, params=(), package="p", file="/p/x.kt"):
    return (fqn, fqn.split(".")[-1], "function", package, of, of, None, None, on, list(params), on is not None, file, 2, seq)


SYMBOLS = [
    _type("p.A", "p.B<X>?"), _type("p.B", "C", ["p.I", None, ""]), _type("p.C", "p.A"), _type("p.I", kind="interface"), _type("p.Color", kind="enum"), _type("p.Obj", kind="object"),
    _function("z.run", "z", seq=1, package="z"), _function("p.C.run", "p.C"), _function("p.I.stop", "p.I"), _function("p.I.run", "p.I"), _function("z.stop", "z", seq=1, package="z"),
    _function("q.wrap", on="p.A", package="q"), _function("z.wrap", "z", seq=1, package="z"), _function("r.wrap", on="Int", seq=2, package="r"),
    _function("p.top"), _function("q.top", seq=1, package="q"), _function("p.A.Companion.make", "p.A.Companion"), _function("p.Obj.make", "p.Obj", seq=3),
    _function("q.add", seq=1, params=["String"], package="q"), _function("r.add", seq=2, params=["Long"], package="r"), _function("r.add2", seq=2, package="r"),
    _function("p.A.own", "p.A"),
]


def _calls(spark, *calls):
    every = [(i, *c, "/p/x.kt") for i, c in enumerate(calls)]
    return spark.createDataFrame([*every, every[0]], CALL)  # the first one is delivered twice


def test_cascade(spark):
    s = spark.createDataFrame(SYMBOLS, SYMBOL)
    props = spark.createDataFrame([("p.A", "store", "p.C<X>?"), ("p.A", "none", None)], "declaring_type_fqn string, name string, prop_type string")
    libs = spark.createDataFrame([("org.lib.Tool",)], "fqn string")
    call = lambda name, rtype=None, receiver=None, own=None, args=None: (name, rtype, receiver, own, "caller", args)
    calls = [
        (call("run", "A", "a"), ("1 receiver type", "p.C.run")),  # A extends B extends C before B's interfaces, depth first
        (call("stop", " A<T>? ", "a"), ("1 receiver type", "p.I.stop")), (call("make", None, "p.A"), ("0 qualified", "p.A.Companion.make")), (call("Color"), ("0.5 constructor", "p.Color.<init>")),
        (call("run", None, "store", "A"), ("2 property", "p.C.run")), (call("make", None, "A"), ("2 companion", "p.A.Companion.make")), (call("make", None, "Obj"), ("2 object", "p.Obj.make")),
        (call("values", None, "Color"), ("2 enum", "p.Color.values")), (call("own", None, "x", "A"), ("3 own class", "p.A.own")), (call("run", None, None, "B"), ("3 own class", "p.C.run")),
        (call("top"), ("5 package", "p.top")), (call("wrap", "A", "a"), ("7 extension", "q.wrap")), (call("wrap", "Int", "a"), ("7 extension", "r.wrap")), (call("wrap"), ("8 any", "z.wrap")),
        (call("add", None, None, None, ["Int"]), ("8 any", "r.add")), (call("add", None, None, None, ["String"]), ("8 any", "q.add")), (call("add"), ("8 any", "q.add")),
        (call("add2()"), ("8 any", "r.add2")), (call("hammer", "org.lib.Tool", "t"), ("10 library", "org.lib.Tool.hammer")),
        (call("nowhere"), None), (call(None), None), (call("  "), None),
    ]
    got = {r.call_id: (r.step, r.to_fqn) for r in resolve.resolve_calls(_calls(spark, *[c for c, _ in calls]), s, props, libs).collect()}
    assert got == {i: want for i, (_, want) in enumerate(calls) if want}
    assert resolve.resolve_calls(_calls(spark, calls[0][0]).limit(0), s.limit(0)).count() == 0


def test_edges_join_nodes_only(spark):
    s = spark.createDataFrame([*SYMBOLS, _function("p.caller"), _function("p.A.go", "p.A")], SYMBOL)
    calls = spark.createDataFrame(
        [(1, "run", "A", "a", None, "caller", None, "/p/x.kt"), (2, "run", "A", "a", None, "caller", None, "/p/x.kt"), (2, "run", "A", "a", None, "caller", None, "/p/x.kt"),
         (3, "Color", None, None, None, "caller", None, "/p/x.kt"), (4, "own", "A", "a", "A", "go", None, "/p/x.kt"), (5, "own", "A", "a", "A", "unknown", None, "/p/x.kt")], CALL)
    assert rows(code_graph.resolved_calls(calls, s, None, None)) == [("p.A.go", "p.A.own", 1), ("p.caller", "p.C.run", 2)]


def test_whole_graph(spark):
    ts = lambda fqn, name, kind, **kw: (fqn, name, kind, None, None, None, None, None, None, None, None, kw.get("file"), 1, 1)
    s = spark.createDataFrame([*SYMBOLS, _function("p.caller"), ts("Page", "Page", "class", file="/w/src/ui/pages/Page.ts")], SYMBOL)
    body = {
        "functions": [{"name": "load", "returnType": "List<B?>", "annotations": {"name": "Inject", "arguments": {"a": 1}}, "parameters": [None, {"name": "id", "type": "Int"}]}],
        "companionObject": {"properties": [{"name": "MAX", "isVal": True}]}, "secondaryConstructors": [{"parameters": []}, {"visibility": "private"}], "nestedClasses": [{"name": "In", "kind": "enum"}],
    }
    bodies = spark.createDataFrame([("p.A", 1, "{}"), ("p.A", 2, json.dumps(body)), (None, 3, "{}"), ("p.B", 1, "broken"), ("p.C", 1, None)], "class_fqn string, indexed_at long, body string")
    classes = spark.createDataFrame([], "fqn string, visibility string, write_seq long")
    calls = spark.createDataFrame([(1, "run", "A", "a", None, "caller", None, "/p/x.kt")], CALL)
    props = spark.createDataFrame([], "declaring_type_fqn string, name string, prop_type string")
    projects = spark.createDataFrame([("/p",), ("/w",)], "path string")
    nodes, edges = code_graph.build_graph(s, classes, calls, props, bodies, projects, spark.createDataFrame([], "fqn string"), [("Base", ["p"])])
    n = {(r.label, r.key): r for r in nodes.collect()}
    assert len(n) == nodes.count()
    for key in [("Constructor", "p.A.<init>"), ("Constructor", "p.A.<init>1"), ("Object", "p.A.Companion"), ("Property", "p.A.Companion.MAX"), ("Class", "p.A.In"), ("Function", "p.A.load"), ("Parameter", "p.A.load#1:id"), ("Annotation", "@Inject"), ("Project", "project:/p"), ("Package", "package:p"), ("Module", "module:/w:ui"), ("Module", "module:/w:ui/pages"), ("Domain", "domain:Base")]:
        assert key in n, key
    e = {(r.rel_type, r.src, r.dst) for r in edges.collect()}
    for edge in [
        ("RETURNS", "p.A.load", "p.B"), ("ANNOTATED_WITH", "p.A.load", "@Inject"), ("HAS_PARAMETER", "p.A.load", "p.A.load#1:id"), ("DECLARES", "p.A", "p.A.Companion"), ("DECLARES", "p.A.Companion", "p.A.Companion.MAX"),
        ("DECLARES", "p.A", "p.A.<init>1"), ("DECLARES", "p.A", "p.A.own"), ("EXTENDS", "p.A", "p.B"), ("IMPLEMENTS", "p.B", "p.I"), ("CALLS", "p.caller", "p.C.run"), ("CONTAINS", "project:/p", "package:p"), ("CONTAINS", "package:p", "p.A"),
        ("CONTAINS", "package:p", "p.top"), ("CONTAINS", "project:/w", "module:/w:ui"), ("CONTAINS", "module:/w:ui", "module:/w:ui/pages"), ("CONTAINS", "module:/w:ui/pages", "Page"), ("OWNS", "domain:Base", "package:p"),
    ]:
        assert edge in e, edge
    assert not [x for x in e if x[0] == "DECLARES" and x[2] == "p.A.In"] and ("CONTAINS", "package:p", "p.A.own") not in e
