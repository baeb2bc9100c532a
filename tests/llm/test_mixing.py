import random
from pathlib import Path

import pytest
from conftest import rows

from graphloom.llm.mixing import mix_sources, water_filling

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _filled(spark, sizes, targets, total=None):
    rows_ = [(s, float(w), r, sizes.get(s, 0)) for s, (w, r) in targets.items()]
    df = spark.createDataFrame(rows_, "source string, target_share double, max_repeats int, available_tokens long")
    return {r.source: r.planned_tokens for r in water_filling(df, total).collect()}


def test_water_filling(spark):
    fill = lambda *a: _filled(spark, *a)
    assert fill({"a": 100, "b": 100}, {"a": (0.5, 1), "b": (0.5, 1)}) == {"a": 100, "b": 100}
    got = fill({"a": 900, "b": 50, "c": 50}, {"a": (0.4, 1), "b": (0.4, 2), "c": (0.2, 4)})
    assert got["b"] == 100 and got["c"] == 200 and got["a"] == pytest.approx(700)
    assert fill({"a": 10}, {"a": (0.5, 1), "gone": (0.5, 3)}) == {"a": 10, "gone": 0}
    assert fill({}, {}) == {} and fill({"a": 5}, {"a": (0.0, 1)}) == {"a": 0}


def test_exact_total(spark):
    sizes, targets = {"a": 900, "b": 50}, {"a": (0.4, 1), "b": (0.4, 2), "gone": (0.2, 4)}
    assert _filled(spark, sizes, targets, "exact") == pytest.approx({"a": 100, "b": 100, "gone": 0})
    assert _filled(spark, {}, targets, "exact") == {"a": 0, "b": 0, "gone": 0} and _filled(spark, {}, {}, "exact") == {}


def test_random_plans_against_brute_force(spark):
    r = random.Random(3)
    for _ in range(4):
        n = r.randrange(3, 40)
        sizes = {f"s{i}": r.randrange(1, 5000) for i in range(n)}
        targets = {f"s{i}": (r.random(), r.randrange(4)) for i in range(n)}
        total = sum(sizes.values()) * r.choice([0.3, 1.0, 1.7])
        cap = {s: sizes[s] * k for s, (_, k) in targets.items()}
        take, open_, left = {}, dict(targets), total
        while open_:
            weight = sum(w for w, _ in open_.values())
            over = [s for s, (w, _) in open_.items() if left * w / weight > cap[s]]
            if not over:
                take |= {s: left * w / weight for s, (w, _) in open_.items()}
                break
            for s in over:
                take[s] = cap[s]
                left -= cap[s]
                del open_[s]
        assert _filled(spark, sizes, targets, total) == pytest.approx(take)


@pytest.mark.skipif(not Path(VOCABULARY).exists(), reason="no vocabulary")
def test_selection_meets_the_plan(spark):
    docs = [(i, " Big " if i % 4 else "small", "the quick brown fox " * (1 + i % 5), i) for i in range(2000)] + [(9001, None, "x", 0), (9002, "small", None, 0), (9003, "big", "", 0), (9004, "other", "y", 0)]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string, tokens long")
    t = spark.createDataFrame([("big", 0.5, 1), ("SMALL", 0.4, 2), ("gone", 0.1, 3)], "source string, target_share double, max_repeats int")
    selection, report = mix_sources(d, t, VOCABULARY)
    r = {x.source: x for x in report.collect()}
    assert r["gone"].selected_tokens == 0 and r["small"].epochs <= 2 and r["big"].epochs <= 1
    assert sum(x.actual_share for x in r.values()) == pytest.approx(1)
    assert all(abs(x.selected_tokens - x.planned_tokens) <= 11 for x in r.values())  # half of the longest document
    assert rows(selection) == rows(mix_sources(d.repartition(7), t, VOCABULARY)[0])
    assert selection.where("source = 'other' or source is null").count() == 0


@pytest.mark.skipif(not Path(VOCABULARY).exists(), reason="no vocabulary")
def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, source string, text string")
    t = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    selection, report = mix_sources(d, t, VOCABULARY)
    assert selection.count() == 0 and rows(report, "source", "actual_share") == [("a", 0.0)]
