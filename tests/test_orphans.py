import datetime as dt
import random

from conftest import rows

from graphloom.operators.orphans import orphan_references

REFS, PARENTS = "row_id long, key string, at timestamp, born string", "key string, born timestamp, died timestamp, at string"
T = lambda d: dt.datetime(2025, 1, 1) + dt.timedelta(days=d)


def _orphans(spark, refs, parents):
    return orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS))


def test_missing_removed_and_late(spark):
    refs = [(1, "a", T(40), "x"), (2, "b", T(40), "x"), (3, "c", T(40), "x"), (4, "d", T(40), "x"), (5, "d", T(90), "x"), (6, None, T(1), "x"), (7, "a", None, "x"), (1, "a", T(40), "x")]
    parents = [("a", T(1), None, ""), ("b", T(1), T(40), ""), ("d", T(60), None, ""), (None, T(1), None, ""), ("c", None, None, "")]
    out = _orphans(spark, refs, parents)
    assert rows(out, "row_id") == [(2,), (3,), (4,), (7,)]
    assert out.columns == ["key", "row_id", "at", "born"]  # a clashing name of refs stays its own


def test_repeated_rows_stay(spark):
    out = _orphans(spark, [(1, "z", T(1), ""), (1, "z", T(1), "")], [])
    assert rows(out, "row_id") == [(1,), (1,)]


def test_empty(spark):
    assert _orphans(spark, [], [("a", T(1), None, "")]).count() == 0
    assert _orphans(spark, [(1, "a", T(1), "")], []).count() == 1


def test_random_against_brute_force(spark):
    r = random.Random(3)
    parents = [(f"k{r.randrange(300)}", T(r.randrange(400)), T(r.randrange(400, 800)) if r.random() < 0.3 else None, "") for _ in range(300)]
    refs = [(i, "hot" if i % 3 == 0 else f"k{r.randrange(400)}", T(r.randrange(900)), "") for i in range(1500)]
    want = sorted((i,) for i, k, t, _ in refs if not any(p[0] == k and p[1] <= t and (p[2] is None or p[2] > t) for p in parents))
    assert sorted(rows(_orphans(spark, refs, parents), "row_id")) == want
