import random

from conftest import rows

from graphloom.llm import shared_spans as spans
from graphloom.llm.leakage import leaked_passages
from graphloom.llm.textops import words_of

WORDS = [f"w{i}é" if i % 7 == 0 else f"word{i}" for i in range(400)]


def _text(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def _docs(spark, texts, name="doc_id"):
    return spark.createDataFrame([(i, t, "x") for i, t in texts], f"{name} long, text string, digest string")


def _pairs(texts, span):
    parts = {i: {t[k : k + span] for k in range(len(t) - span + 1)} for i, t in texts if t}
    ids = sorted(parts)
    return sorted(((a, b) for a in ids for b in ids if a < b and parts[a] & parts[b]), key=repr)


def test_pairs_against_brute_force(spark):
    r = random.Random(7)
    block = _text(r, 90)
    texts = [(i, _text(r, 120)) for i in range(25)]
    for n, (lo, hi) in enumerate([(0, 401), (0, 399), (37, 437), (3, 460), (10, 410)]):
        texts.append((100 + n, _text(r, 40)[: 50 + n] + block[lo:hi] + _text(r, 40)))
    texts += [(200, texts[0][1]), (201, texts[0][1]), (202, None), (203, ""), (204, "short"), (205, "ab" * 900), (206, "ab" * 700), (207, texts[3][1][5:405])]
    assert rows(spans.shared_spans(_docs(spark, texts)).document_pairs()) == _pairs(texts, 400)


def test_a_block_shared_by_very_many(spark, monkeypatch):
    monkeypatch.setattr(spans, "COARSE_GROUP", 6)
    r = random.Random(9)
    block = _text(r, 60)[:375]
    texts = [(i, _text(r, 30) + "|" + block + _text(r, 30)) for i in range(20)]
    texts += [(50 + i, _text(r, 10) + "|" + block + "0123456789abc" * 3 + _text(r, 20)) for i in range(3)]
    assert rows(spans.shared_spans(_docs(spark, texts)).document_pairs()) == [(50, 51), (50, 52), (51, 52)] == _pairs(texts, 400)


def test_shares_and_offsets(spark):
    r = random.Random(4)
    block, a, b = _text(r, 100)[:500], _text(r, 30), _text(r, 50)
    texts = [(1, a + block), (2, block + b), (3, block + b), (4, None), (5, "")]
    got = {i: (n, s) for i, n, s, _ in rows(spans.shared_parts(_docs(spark, texts)))}
    assert got == {1: (len(a) + 500, 500), 2: (500 + len(b), 500 + len(b)), 3: (500 + len(b), 500 + len(b)), 4: (0, 0), 5: (0, 0)}
    assert rows(spans.later_spans(_docs(spark, texts)), "doc_id", "start", "end") == [(2, 0, 500), (3, 0, 500 + len(b))]


def _covered(texts, span):
    """(doc, start, end) of what other texts hold too, and of what texts with a smaller id hold, window by window."""
    owners = {}
    for i, t in texts:
        for k in range(len(t or "") - span + 1):
            owners.setdefault(t[k : k + span], set()).add(i)
    out = ([], [])
    for i, t in texts:
        for part, held in zip(out, (lambda o: len(o) > 1, lambda o: min(o) < i), strict=True):  # noqa: B023
            end = None
            for k in range(len(t or "") - span + 1):
                if held(owners[t[k : k + span]]):
                    if end is None or k > end:
                        part.append([i, k, k + span])
                    part[-1][2] = end = k + span
    return tuple(sorted(tuple(x) for x in p) for p in out)


def test_covered_parts_against_brute_force(spark):
    r = random.Random(12)
    blocks = [_text(r, 60) for _ in range(3)]
    texts = []
    for i in range(40):
        b = r.choice(blocks)
        lo, n = r.randrange(60), r.choice([30, 59, 60, 61, 75, 140])
        texts.append((i, _text(r, r.randrange(12)) + b[lo : lo + n] + r.choice(["", "|", b[5:90]]) + _text(r, r.randrange(9))))
    texts += [(50, texts[3][1]), (51, blocks[0][:60] * 2), (52, None), (53, "x" * 200), (54, "x" * 90)]
    every, later = _covered(texts, 60)
    per = {}
    for i, a, b in every:
        per[i] = per.get(i, 0) + b - a
    got = {i: n for i, _, n, _ in rows(spans.shared_parts(_docs(spark, texts), 60))}
    assert got == {i: per.get(i, 0) for i, _ in texts} and len(per) > 20
    assert rows(spans.later_spans(_docs(spark, texts), 60), "doc_id", "start", "end") == sorted(later, key=repr)


def test_one_header_in_very_many_texts(spark):
    """Windows grow with the texts, not with their pairs."""
    r = random.Random(15)
    header = _text(r, 90)[:600]
    sizes = {}
    for n in (250, 2000):
        texts = [(i, header + chr(0x4E00 + i) + _text(r, 20)) for i in range(n)]
        members, windows = spans.shared_windows(_docs(spark, texts))
        sizes[n] = windows.count()
        assert members.count() == n and sizes[n] == 201 * n
    assert spans.later_spans(_docs(spark, texts)).where("start = 0 and end = 600").count() == 1999


def test_no_documents(spark):
    assert spans.shared_parts(_docs(spark, [])).count() == spans.later_spans(_docs(spark, [])).count() == 0
    assert spans.shared_spans(_docs(spark, [])).document_pairs().count() == 0
    assert leaked_passages(_docs(spark, []), _docs(spark, [], "item_id")).count() == 0


def test_leaks_against_brute_force(spark):
    r = random.Random(2)
    items = [(i, _text(r, r.randrange(10, 60))) for i in range(12)] + [(90, None), (91, ""), (92, "too short")]
    docs = [(i, _text(r, 200)) for i in range(20)] + [(500, None), (501, "")]
    for n, (i, t) in enumerate(items[:12]):
        w = words_of(t)
        take = w[1:16] if n % 3 else w[:14]
        docs.append((100 + n, _text(r, 30) + "; " + ", ".join(x.upper() for x in take) + "! " + _text(r, 30)))
    want = []
    for d, t in docs:
        w = words_of(t or "")
        held = {tuple(w[k : k + 15]) for k in range(len(w) - 14)}
        for i, p in items:
            q = words_of(p or "")
            if any(tuple(q[k : k + 15]) in held for k in range(len(q) - 14)):
                want.append((d, i))
    docs.append(docs[-1])
    assert want and rows(leaked_passages(_docs(spark, docs), _docs(spark, items, "item_id"))) == sorted(want)
