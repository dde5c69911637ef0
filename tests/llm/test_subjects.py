import random

import pytest

from parchment.llm import subjects

D = "doc_id long, text string, source string, subject string, term string"
TERMS = {"steel": ["gusset plate", "bolt group", "fillet weld"], "timber": ["rim board", "joist hanger", "lag screw"], "egress": ["exit door", "panic bar", "stair landing"]}
AREAS = [(k, k.title(), "Covers " + ", ".join(v[:1])) for k, v in TERMS.items()]


def corpus(seed):
    r = random.Random(seed)
    docs, labels, truth = [], [], set()
    for d in range(240):
        own = r.sample(sorted(TERMS), 2 if d % 4 == 0 else 1)
        text = []
        for n in range(6):
            s = own[n % len(own)]
            text.append(f"The {r.choice(TERMS[s])} shall be checked in year {n}.")
            text.append("A note is not part of the rule.")
        docs.append((d, " ".join(text), f"src{d % 7}", "x", "y"))
        truth |= {(d, s) for s in own}
        if d % 10 == 1:
            labels.append((d, " " + own[0].upper() if d % 20 == 1 else own[0]))
    labels += [(1, None), (1, "unknown"), (9999, "steel"), labels[0], (3, "timber")]
    return docs + [(500, None, "src1", "", ""), (501, "", "src2", "", ""), (502, "1 2 3", None, "", "")], labels, truth


@pytest.mark.parametrize("bound", [2_000_000, 0])
def test_held_out_documents(spark, monkeypatch, bound):
    """Terms and representatives' labels broadcast, or joined by shuffle."""
    monkeypatch.setattr(subjects, "TERM_ROWS", bound)
    monkeypatch.setattr(subjects, "HUB_ROWS", bound)
    docs, labels, truth = corpus(4)
    fit = subjects.Subjects(spark.createDataFrame(docs, D), spark.createDataFrame(labels, "doc_id long, subject_key string"), spark.createDataFrame(AREAS, "subject_key string, title string, description string"), rounds=2)
    got = {(r.doc, r.subject_key) for r in fit.documents().collect()}
    assert len(got & truth) >= 0.97 * len(truth) and len(got - truth) <= 0.03 * len(truth)
    makeup = {r.subject_key: r.documents for r in fit.makeup().collect()}
    assert sum(makeup.values()) == len(got)


def test_links_are_verified(spark):
    """Every link's weight is the Jaccard similarity of the two documents' terms; documents without common terms have none."""
    docs, labels, _ = corpus(6)
    fit = subjects.Subjects(spark.createDataFrame(docs, D), spark.createDataFrame(labels, "doc_id long, subject_key string"), spark.createDataFrame(AREAS, "subject_key string, title string, description string"), rounds=1)
    terms = {r.doc: set(r.terms) for r in fit.rows.select("doc", "terms").collect()}
    links = fit.links.collect()
    assert len(links) > 200 and all(abs(r.weight - len(terms[r.doc] & terms[r.rep]) / len(terms[r.doc] | terms[r.rep])) < 1e-9 and r.weight >= 0.05 for r in links)


def test_seeds_are_clamped(spark):
    docs, labels, _ = corpus(8)
    fit = subjects.Subjects(spark.createDataFrame(docs, D), spark.createDataFrame(labels, "doc_id long, subject_key string"), spark.createDataFrame(AREAS, "subject_key string, title string, description string"), rounds=2)
    got = {(r.doc, r.subject): r.share for r in fit.labels.collect()}
    seeds = fit.seeds.collect()
    assert len(seeds) > 15 and all(got[r.doc, r.subject] >= r.share / 2 - 1e-9 for r in seeds)


def test_empty(spark):
    none = spark.createDataFrame([], D)
    areas = spark.createDataFrame(AREAS, "subject_key string, title string, description string")
    fit = subjects.Subjects(none, spark.createDataFrame([], "doc_id long, subject_key string"), areas, rounds=1)
    assert fit.documents().count() == 0
