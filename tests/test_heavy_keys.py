import random
from collections import Counter, defaultdict

from conftest import rows

from graphloom.operators.heavy_keys import heavy_keys, key_states

SCHEMA = "a string, b string, f string, key string, n string"


def test_counts_with_a_hot_key(spark):
    r = random.Random(1)
    data = [("hot" if i % 3 == 0 else f"a{r.randrange(200)}", f"b{r.randrange(50)}", r.choice([None, "x", "y", "z"]), "", "") for i in range(4000)] + [(None, "b1", "x", "", "")] * 50
    df = spark.createDataFrame(data, SCHEMA)
    got = {(s, k, d): (n, v) for s, k, d, n, v in rows(key_states(df, {"left": "a"}, {"left": ["b", "f"]}, 7), "side", "key", "dim", "n", "n_distinct")}
    count, seen = Counter(), defaultdict(set)
    for a, b, f, *_ in data:
        count[a] += 1
        for dim, v in (("b", b), ("f", f)):
            if v is not None:
                seen[a, dim].add(v)
    assert got == {("left", a, dim): (count[a], len(seen[a, dim])) for a in count for dim in ("b", "f")}


def test_share_counts_nulls_and_repeated_rows(spark):
    df = spark.createDataFrame([("x", "1", None, "", "")] * 2 + [(None, "1", None, "", "")] * 3 + [("y", "2", None, "", "")] * 95, SCHEMA)
    assert rows(heavy_keys(df, {"s": "a"}, {"s": ["b"]}, 0.02)) == [("s", "x", 2), ("s", "y", 95)]
    assert rows(heavy_keys(df, {"s": "a"}, {"s": ["b"]}, 0.03)) == [("s", "y", 95)]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert heavy_keys(df, {"s": "a"}, {"s": ["b"]}, 0.01).count() == 0
