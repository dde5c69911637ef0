import datetime
import random
import re
from collections import defaultdict

import pytest

from parchment.llm import boilerplate, normal

S = "evidence_id string, source_id string, text string, loaded_at timestamp_ntz, doc string, source string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, "clash", "clash") for r in rows], S)


def key(line):
    t = normal.transducer()(re.sub("[\r\x85  ]", " ", line))
    return re.sub(r"[\d\s]+", "", t).lower() if re.search(r"[^\W\d_]", t) else None


def brute(rows, least, share):
    docs = {}
    for i, s, t in rows:
        docs.setdefault(i, (s, t))
    total, seen = defaultdict(int), defaultdict(set)
    for i, (s, t) in docs.items():
        total[s] += 1
        for line in (t or "").split("\n"):
            if key(line):
                seen[s, key(line)].add(i)
    return {(i, n) for i, (s, t) in docs.items() if t is not None for n, line in enumerate(t.split("\n"), 1) if key(line) and len(ids := seen[s, key(line)]) >= least and len(ids) >= share * total[s]}


@pytest.mark.parametrize("seed, bound", [(1, 200_000), (2, 0)])
def test_against_brute_force(spark, monkeypatch, seed, bound):
    monkeypatch.setattr(boilerplate, "BROADCAST_ROWS", bound)
    r = random.Random(seed)
    pool = ["Share this page", "SHARE  THIS page", "Ｓhare this page 7", "Downloaded 3/4", "12 34", "", "Dооr", "Door", "rare ​line"]
    rows = [(f"e{i}", r.choice(["s", "t", None, ""]), None if r.random() < 0.1 else "\n".join(r.choice(pool) if r.random() < 0.6 else f"own words {chr(97 + i % 26)}{chr(97 + i // 26)}" for _ in range(r.randrange(5)))) for i in range(90)]
    rows += rows[:15]
    got = boilerplate.repeated_lines(frame(spark, rows), "evidence_id", "source_id", "text", min_docs=4, min_share=0.1)
    assert {(x.doc, x.line_no) for x in got.collect()} == brute(rows, 4, 0.1)


def test_republished_copies_are_one_cluster(spark):
    rows = [(f"e{i}", "s", "a republished article\nof two lines") for i in range(20)]
    found = lambda by_cluster: boilerplate.repeated_lines(frame(spark, rows), "evidence_id", "source_id", "text", by_cluster=by_cluster).collect()
    assert len(found(False)) == 40 and found(True) == [] and {(r.docs, r.clusters, r.total) for r in found(False)} == {(20, 1, 20)}


@pytest.mark.parametrize("least", [2, 3])
def test_days(spark, least):
    """A line of many documents of few days is kept; a null day is none."""
    day = lambda n: None if n is None else datetime.datetime(2024, 1, n)
    rows = [(f"{k}{i}", "s", f"{k} notice\nbody {chr(97 + i)}", day(days[i % len(days)])) for k, days in (("one", [1]), ("two", [1, 2]), ("three", [1, 2, 3]), ("none", [None])) for i in range(6)]
    df = spark.createDataFrame(rows, "evidence_id string, source_id string, text string, at timestamp_ntz")
    got = boilerplate.repeated_lines(df, "evidence_id", "source_id", "text", date="at", by_cluster=True, min_dates=least).collect()
    assert {r.doc.rstrip("012345") for r in got} == {"two", "three"} - ({"two"} if least == 3 else set())


def test_removal_and_empty(spark):
    rows = [(f"e{i}", "s", f"notice\nbody {chr(97 + i)}\n") for i in range(6)] + [("n", "s", None), ("x", "s", "")]
    df = frame(spark, rows)
    found = boilerplate.repeated_lines(df, "evidence_id", "source_id", "text")
    out = {r.evidence_id: r.text for r in boilerplate.without_lines(df.drop("doc"), found, "evidence_id", "text").collect()}
    assert out["e0"] == "body a\n" and out["n"] is None and out["x"] == ""
    assert boilerplate.repeated_lines(frame(spark, []), "evidence_id", "source_id", "text").count() == 0
