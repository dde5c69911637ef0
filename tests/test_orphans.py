import random
from datetime import datetime

from parchment.operators import orphans

P = "owner string, key string, loaded_at timestamp_ntz, deleted boolean"
C = "table_name string, row_key string, owner string, key string, seen_at timestamp_ntz"
DAYS = [None, *[datetime(2020, m, 3) for m in (1, 2, 3)]]


def brute(parents, children):
    out = set()
    refs = {}
    for t, k, o, x, at in children:
        old = refs.get((t, k, o, x))
        refs[t, k, o, x] = at if old is None else old if at is None else min(old, at)
    for (t, k, o, x), at in refs.items():
        own = [p for p in parents if o is not None and x is not None and p[:2] == (o, x)]
        times = [p[2] for p in own if p[2]]
        if not own:
            reason = "missing"
        elif any(p[3] for p in own):
            reason = "deleted"
        elif times and at and min(times) > at:
            reason = "late"
        else:
            continue
        out.add((t, k, at and at.strftime("%Y-%m"), reason))
    return out


def run(spark, parents, children):
    rows = orphans.orphan_references(spark.createDataFrame(parents, P), spark.createDataFrame(children, C), salts=3).collect()
    assert len(rows) == len({tuple(r) for r in rows})
    return {tuple(r) for r in rows}


def test_against_brute_force(spark):
    r = random.Random(3)
    for _ in range(3):
        parents = [(r.choice([None, "o", "q"]), r.choice([None, "", *"abcd"]), r.choice(DAYS), r.random() < 0.2) for _ in range(12)]
        children = [(r.choice("xy"), f"k{i}", r.choice([None, "o", "q"]), r.choice([None, "", *"abcdef"]), r.choice(DAYS)) for i in range(80)]
        children += children[:20]
        assert run(spark, parents, children) == brute(parents, children)


def test_hot_missing_key_and_empty_tables(spark):
    children = [("x", f"k{i}", "o", "gone", DAYS[1]) for i in range(500)]
    assert len(run(spark, [], children)) == 500
    assert run(spark, [("o", "a", DAYS[1], False)], []) == set()
    assert run(spark, [], []) == set()


def test_counts(spark):
    found = orphans.orphan_references(spark.createDataFrame([], P), spark.createDataFrame([("x", "1", "o", "a", DAYS[1]), ("x", "2", "o", "b", DAYS[1])], C))
    assert [tuple(r) for r in orphans.orphans_by_period(found).collect()] == [("x", "2020-01", "missing", 2)]
