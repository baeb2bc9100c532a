import json

from conftest import rows

from graphloom.operators.nested_json import flatten_records

FIELDS = {"classes": "class", "functions": "function", "parameters": "parameter", "companion": "companion"}


def _flat(spark, data, **kw):
    return flatten_records(spark.createDataFrame(data, "record_id long, version long, body string, path string"), FIELDS, {"companion"}, **kw)


def test_shapes(spark):
    body = {
        "classes": [{"name": "A", "functions": json.dumps([{"name": "f", "parameters": {"name": "p"}}])}, None, {"companion": {"functions": [None, {"x": 1}]}}],
        "functions": {"name": "g"}, "parameters": ["text", 5, {"name": "q"}, json.dumps({"name": "r"})], "companion": None,
    }
    out = _flat(spark, [(1, 1, json.dumps(json.dumps(body)), "")]).table()
    assert rows(out, "node_path", "parent_path", "kind") == sorted([
        ("$", "", "body"), ("$.classes[0]", "$", "class"), ("$.classes[0].functions[0]", "$.classes[0]", "function"),
        ("$.classes[0].functions[0].parameters[0]", "$.classes[0].functions[0]", "parameter"), ("$.classes[2]", "$", "class"),
        ("$.classes[2].companion", "$.classes[2]", "companion"), ("$.classes[2].companion.functions[1]", "$.classes[2].companion", "function"),
        ("$.functions[0]", "$", "function"), ("$.parameters[2]", "$", "parameter"), ("$.parameters[3]", "$", "parameter"),
    ], key=repr)


def test_newest_delivery_and_unreadable_bodies(spark):
    data = [(1, 1, '{"functions":[{}]}', ""), (1, 2, "{}", ""), (2, 1, '{"a":', ""), (3, 1, "[{}]", ""), (4, 1, None, ""), (5, 1, "", ""), (6, 1, "{} x", ""), (7, None, "{}", ""), (1, 2, "{}", "")]
    assert rows(_flat(spark, data).table(), "record_id", "node_path") == [(1, "$"), (7, "$")]
    assert _flat(spark, []).table().count() == 0


def test_depth_is_not_bounded(spark):
    body: dict = {}
    for _ in range(23):
        body = {"classes": [None, body]}
    paths = [r[0] for r in rows(_flat(spark, [(1, 1, json.dumps(body), "")]).table(), "node_path")]
    assert sorted(paths, key=len)[-1] == "$" + ".classes[1]" * 23 and len(paths) == 24


def test_one_table_a_kind_with_attributes(spark):
    t = _flat(spark, [(1, 1, '{"functions":[{"name":"f","n":"7"},{"name":null,"n":"x"}]}', "")], attributes={"name": ("name", "string"), "n": ("n", "int")})
    assert rows(t.table("function"), "node_path", "name", "n") == [("$.functions[0]", "f", 7), ("$.functions[1]", None, None)]
