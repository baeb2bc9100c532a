import random

from conftest import rows

from graphloom.operators.hierarchy import descendants, resolve_hierarchy


def _model(links):
    parent = dict(links)
    out = []
    for n in parent:
        chain, x = [], n
        while x not in chain:
            chain.append(x)
            if parent.get(x) not in parent:
                out.append((n, x, len(chain) - 1))
                break
            x = parent[x]
        else:
            out.append((n, min(chain[chain.index(x) :]), -1))
    return sorted(out, key=repr)


def _got(spark, links, **kw):
    df = spark.createDataFrame([("t", n, p, 1) for n, p in links], "tree string, node string, parent string, depth int").select("tree", "node", "parent")
    return resolve_hierarchy(df, **kw)


def test_chain_star_and_loops(spark):
    links = [("r", None)] + [(f"c{i:02}", f"c{i - 1:02}" if i else "r") for i in range(37)] + [(f"s{i}", "r") for i in range(60)]
    links += [("a", "b"), ("b", "c"), ("c", "a"), ("x", "c"), ("y", "x"), ("self", "self"), ("lost", "nowhere")]
    assert rows(_got(spark, links), "node", "root", "depth") == _model(links)


def test_random(spark):
    r = random.Random(5)
    links = [(f"n{i}", f"n{r.randrange(150)}" if r.random() < 0.9 else None) for i in range(140)]
    assert rows(_got(spark, links), "node", "root", "depth") == _model(links)


def test_paths_and_descendants(spark):
    links = [("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("l", "l")]
    out = _got(spark, links, with_path=True)
    assert rows(out, "node", "path") == [("a", ["a"]), ("b", ["a", "b"]), ("c", ["a", "b", "c"]), ("d", ["a", "b", "c", "d"]), ("l", None)]
    assert ("a", "d", 3) in rows(descendants(out), "ancestor", "node", "distance") and descendants(out).count() == 6


def test_descendants_on_and_below_loops(spark):
    links = [("a", "c"), ("b", "a"), ("c", "b"), ("x", "b"), ("y", "x"), ("r", None), ("s", "r")]
    out = _got(spark, links, with_path=True)
    assert rows(out.where("depth = -1"), "node", "root", "loop_path") == [("a", "a", ["a"]), ("b", "a", ["a", "b"]), ("c", "a", ["a", "b", "c"]), ("x", "a", ["a", "b", "x"]), ("y", "a", ["a", "b", "x", "y"])]
    below = [("a", "b", 1), ("a", "c", 2), ("a", "x", 2), ("a", "y", 3), ("b", "c", 1), ("b", "x", 1), ("b", "y", 2), ("x", "y", 1)]
    assert rows(descendants(out), "ancestor", "node", "distance", "loop") == sorted([(*b, True) for b in below] + [("r", "s", 1, False)], key=repr)


def test_empty(spark):
    assert _got(spark, []).count() == 0
