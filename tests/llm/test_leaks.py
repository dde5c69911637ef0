import random

import numpy as np
import pytest

from parchment.llm import leaks

D, I = "doc_id long, text string, doc string", "item_id long, text string, item string"


def words(r, n):
    return [r.choice(["door", "wall", "exit", "stair", "ramp", "beam", "slab", "duct", "pump", "valve"]) + str(r.randrange(40)) for _ in range(n)]


def brute(docs, items, size, most):
    win = lambda t, n: [w[i : i + n] for w in [leaks.words_of(t)] for i in range(len(w) - n + 1)]
    return {(d, i) for d, t in docs for i, u in items if any(leaks.edits(a, b, most) <= most for n in range(size - most, size + most + 1) for a in win(t, n) for b in win(u, size))}


def made(seed):
    r = random.Random(seed)
    items = [(i, " ".join(words(r, 20))) for i in range(6)] + [(6, "too short"), (7, None), (8, "")]
    docs = []
    for d in range(30):
        w = words(r, r.randrange(60))
        if d % 3 == 0:
            it = items[r.randrange(6)][1].split()
            at = r.randrange(6)
            part = it[at : at + r.choice([11, 12, 14])]
            if d % 2:
                part[5] = "changed"
            w[3:3] = part
        docs.append((d, " ".join(w).title() if d % 4 else "​, ".join(w)))
    return docs + [(30, None), (31, ""), docs[0]], items + [items[0]]


def run(spark, docs, items, **kw):
    got = leaks.leaks(spark.createDataFrame([(*d, "x") for d in docs], D), spark.createDataFrame([(*i, "x") for i in items], I), "doc_id", "item_id", **kw).collect()
    pairs = [(r.doc, r.item) for r in got]
    assert len(pairs) == len(set(pairs))
    return {(r.doc, r.item): r.edits for r in got}


@pytest.mark.parametrize("block", [200_000, 0])
@pytest.mark.parametrize("most", [0, 1, 2])
def test_against_brute_force(spark, monkeypatch, block, most):
    """By broadcast and by shuffle: unchanged passages are all found, changed ones to the target."""
    monkeypatch.setattr(leaks, "BLOCK", block)
    docs, items = made(1 + most)
    got = run(spark, docs, items, max_edits=most)
    exact, want = brute(docs, items, 12, 0), brute(docs, items, 12, most)
    assert {x for x, e in got.items() if e == 0} == exact and {*got} <= want and len(got) >= 0.95 * len(want)


def test_full_filter(spark, monkeypatch):
    """A filter at its bound lets more through and loses nothing."""
    monkeypatch.setattr(leaks, "FILTER_BITS", 64)
    docs, items = made(5)
    assert {x for x, e in run(spark, docs, items).items() if e == 0} == brute(docs, items, 12, 0)


def test_distances():
    r = random.Random(9)
    for n, m, most in ((12, 12, 1), (11, 12, 1), (13, 12, 1), (4, 4, 0), (10, 12, 2), (14, 12, 2), (12, 12, 3), (3, 9, 2)):
        a = [[r.randrange(3) for _ in range(n)] for _ in range(300)]
        b = [(leaks.edited(x, r.choice(["insert", "drop", "change"]), [r.randrange(n)], [7]) + [1] * 20)[:m] for x in a]
        got = leaks.distances(np.array(a, np.uint64), np.array(b, np.uint64), most)
        assert got.tolist() == [min(most + 1, leaks.edits(x, y, most)) for x, y in zip(a, b)]


def test_empty(spark):
    assert run(spark, [], [(1, "a b c")]) == {} == run(spark, [(1, "a")], []) == run(spark, [(1, None)], [(1, None)])


def test_walk_is_shared():
    w = leaks.Walk(12, 12, 3)
    x = np.arange(1, 31, dtype=np.uint64)
    a, b = w.keys(x, np.array([4])), w.keys(x[4:16], np.array([0]))
    assert a == b
