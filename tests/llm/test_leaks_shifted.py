"""Passages in which a word was inserted, dropped or changed."""

import random

from parchment.llm import leaks


def brute(docs, items, size, most):
    """Windows of an item against document windows of all lengths that ``most`` edits can make."""
    win = lambda t, n: [t[i : i + n] for i in range(len(t) - n + 1)]
    return {(d, i) for d, t in docs for i, u in items if any(leaks.edits(a, b, most) <= most for n in range(size - most, size + most + 1) for a in win(t.split(), n) for b in win(u.split(), size))}


def run(spark, docs, items, **kw):
    got = leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), "doc_id", "item_id", **kw).collect()
    return {(r.doc, r.item) for r in got}


def test_one_word_inserted_or_dropped(spark):
    r = random.Random(5)
    words = lambda n: [f"w{r.randrange(4000)}" for _ in range(n)]
    items = [(i, words(12)) for i in range(40)]
    docs = []
    for d in range(600):
        w, at = [*items[d % 40][1]], r.randrange(1, 11)
        if d % 3 == 0:
            w.insert(at, "added")
        elif d % 3 == 1:
            del w[at]
        else:
            w[at] = "changed"
        if d % 5 == 0:
            w.insert(12 - at, "second")
        docs.append((d, " ".join([*words(r.randrange(5)), *w, *words(r.randrange(5))])))
    items = [(i, " ".join(w)) for i, w in items]
    want, got = brute(docs, items, 12, 1), run(spark, docs, items, max_edits=1)
    assert got <= want
    for kind in range(3):
        of = {x for x in want if x[0] % 3 == kind}
        assert len(of) >= 150 and len(got & of) >= 0.95 * len(of)
    assert run(spark, docs, items, max_edits=0) == brute(docs, items, 12, 0)
