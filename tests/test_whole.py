"""Whole jobs: queries whose results are recomputed over all rows, without the SQL."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq

import __spark_entry__ as entry
from parchment.operators import relations as rel, stream_text, vectors

SF = "/root/testdata/sf0.001"


def rows(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def outcomes(expected, observed):
    out = {}
    for e, ts, k in expected:
        met = {(o, ok) for o, us, ok in observed if set(ts) & set(us)}
        same = len({o for o, ok in met if ok == k})
        out[e] = "expected_not_observed" if not met else "contradicted" if not same else "confirmed" if same == 1 else "ambiguous"
    wanted = {t for _, ts, _ in expected for t in ts}
    return out | {o: "unexpected_observed" for o, us, _ in observed if not wanted & set(us)}


def test_changes_of_several_targets(spark):
    """One observed change met at two targets is one, not several."""
    expected = [(1, [1, 2], "a"), (2, [1, 3], "a"), (3, [4], "a"), (4, [9], "a"), (5, [5], "b")]
    observed = [(11, [1, 2], "a"), (12, [3], "a"), (13, [4, 5], "b"), (14, [7], "a"), (15, [5], "b")]
    made = lambda x: spark.createDataFrame(x, "change_id long, targets array<long>, kind string")
    got = {r.change_id: r.outcome for r in rel.reconcile_changes(made(expected), made(observed)).collect()}
    assert got == outcomes(expected, observed) and {*got.values()} == {"confirmed", "ambiguous", "contradicted", "expected_not_observed", "unexpected_observed"}


def test_change_reconcile_reads_every_order(spark):
    o = [(r["o_orderkey"], [r["o_custkey"]], r["o_orderstatus"]) for r in rows("orders")]
    got = [(r.change_id, r.outcome) for r in entry.queries()["change_reconcile"](spark, SF).collect()]
    want = outcomes([x for x in o if x[0] % 2 == 0], [x for x in o if x[0] % 2])
    assert len(got) == len(want) and dict(got) == want


def fused(vs, k):
    """Best ``k`` by fused score over all rows, and the greatest score per label, of every query."""
    hybrid, best = {}, defaultdict(lambda: -np.inf)
    for q, v, label in vs:
        if q % 50 or v is None:
            continue
        near = [(n, round(float(np.dot(np.float64(v), np.float64(u))), 9), x) for n, u, x in vs if n != q and u is not None]
        s = [x[1] for x in near]
        c = [None if label is None or x[2] is None else float(x[2] == label) for x in near]
        known = [x for x in c if x is not None] or [0.0]
        score = [0.55 * (a - min(s)) / (max(s) - min(s) + 1e-9) + 0.45 * ((min(known) if b is None else b) - min(known)) / (max(known) - min(known) + 1e-9) for a, b in zip(s, c)]
        for f, n in sorted((-f, x[0]) for f, x in zip(score, near))[:k]:
            hybrid[q, n] = -f
        for _, a, x in near:
            best[q, x] = max(best[q, x], a)
    return hybrid, best


def close(got, want):
    return got.keys() == want.keys() and all(abs(got[x] - want[x]) < 2e-6 for x in want)


def test_vectors_over_all_rows(spark):
    vs = [(r["vec_id"], r["embedding"], r["label"]) for r in rows("embeddings")]
    hybrid, best = fused(vs, 10)
    assert close({(r.query_id, r.neighbour_id): r.fused for r in entry.queries()["visual_hybrid"](spark, SF).collect()}, hybrid)
    assert close({(r.query_id, r.label): r.score for r in entry.queries()["visual_best_per_label"](spark, SF).collect()}, best)


def test_vectors_in_blocks_without_labels(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 2)
    monkeypatch.setattr(vectors, "HELD", 16)
    r = np.random.default_rng(4)
    vs = [(i, None if i == 3 else r.random(4).astype("float32").tolist(), None if i % 7 == 0 else f"l{i % 3}") for i in range(251)]
    df = spark.createDataFrame(vs, "vec_id long, embedding array<float>, label string").repartition(3)
    hybrid, best = fused(vs, 5)
    q = df.where("vec_id % 50 = 0")
    assert close({(x.query_id, x.neighbour_id): x.fused for x in vectors.hybrid_top_k(q, df, "label", 5).collect()}, hybrid)
    assert close({(x.query_id, x.label): x.score for x in vectors.best_per_label(q, df, "label").collect()}, best)
    assert vectors.hybrid_top_k(q.limit(0), df, "label").count() == vectors.best_per_label(q.limit(0), df, "label").count() == 0


def mentions(docs, terms):
    split = lambda t: re.findall("[a-z0-9]+", t.lower())
    known = {" ".join(split(t)) for t in terms if t is not None} - {""}
    longest = max((len(t.split()) for t in known), default=0)
    return Counter((k, run) for k, t in docs if t is not None for w in [split(t)] for i in range(len(w)) for n in range(1, longest + 1) if i + n <= len(w) and (run := " ".join(w[i : i + n])) in known)


def test_terms_of_any_length(spark):
    docs = [(1, "Fire-retardant treated joist hanger type B, and a door. Door"), (2, "one two three four five six seven eight nine"), (3, None), (4, ""), (5, "six")]
    terms = ["fire retardant treated joist hanger", "door", "ONE two three four five six seven eight nine", "six", None, "..."]
    df = spark.createDataFrame(docs, "k int, t string")
    found = lambda x: {(r.k, r.term): r.mentions for r in stream_text.term_mentions(df, "k", "t", spark.createDataFrame([(t,) for t in x], "n string"), "n").collect()}
    assert found(terms) == mentions(docs, terms) and (2, "one two three four five six seven eight nine") in found(terms)
    assert found([None, "-"]) == {}


def test_term_mentions_of_the_documents(spark):
    want = mentions([(r["doc_id"], r["text"]) for r in rows("documents")], [r["label"] for r in rows("source_text_section")])
    assert {(r.doc_id, r.term): r.mentions for r in entry.queries()["term_mentions"](spark, SF).collect()} == want
