import random

import pytest

from parchment import session
from parchment.operators import forest

S = "owner string, key string, parent string"


def brute(links):
    up = {}
    for o, k, p in links:
        if k is None:
            continue
        if (o, k) in up:
            up[o, k] = p if up[o, k] is None else up[o, k] if p is None else min(p, up[o, k])
        else:
            up[o, k] = p
    out = {}
    for o, k in up:
        path, at = [k], up[o, k]
        while at is not None and (o, at) in up and at not in path:
            path.append(at)
            at = up[o, at]
        if at is None:
            out[o, k] = (path[-1], len(path) - 1, None, path[::-1])
        elif (o, at) not in up:
            out[o, k] = (at, len(path), "dangling", path[::-1])
        else:
            out[o, k] = (None, None, "cycle" if at == k else "below_cycle", None)
    return out


def got(df):
    return {(r.owner, r.key): (r.root, r.depth, r.finding, r.path) for r in df.collect()}


@pytest.mark.parametrize("parts, top, hot", [(1, 1_000_000, 100_000), (3, 1_000_000, 0), (40, 1_000_000, 100_000), (1, 0, 0), (20, 0, 100_000)])
def test_against_brute_force(spark, monkeypatch, parts, top, hot):
    """In one task at the top or by pointer doubling; hot keys salted or not."""
    monkeypatch.setattr(forest, "TOP_ROWS", top)
    monkeypatch.setattr(session, "HOT_ROWS", hot)
    r = random.Random(parts)
    links = [(r.choice([None, "", "a", "b"]), str(i), r.choice([None, *[str(r.randrange(60)) for _ in range(9)]])) for i in range(55)]
    links += [(None, None, "1"), ("a", "3", "4"), links[5], ("c", "self", "self")]
    assert got(forest.hierarchy(spark.createDataFrame(links, S), parts)) == brute(links)


def test_long_chain_over_many_partitions(spark):
    links = [("o", f"{i:04}", f"{i - 1:04}" if i else None) for i in range(400)]
    links += [("c", f"{i:04}", f"{(i + 1) % 300:04}") for i in range(300)]
    tree = got(forest.hierarchy(spark.createDataFrame(links, S), 20))
    assert tree["o", "0399"][:3] == ("0000", 399, None) and len(tree["o", "0399"][3]) == 400
    assert all(tree["c", f"{i:04}"][2] == "cycle" for i in range(300))


def test_other_parents_are_kept(spark):
    links = [("o", "a", None), ("o", "b", None), ("o", "c", "b"), ("o", "c", "a"), ("o", "c", None), ("o", "c", "x")]
    assert {r.key: r.others for r in forest.hierarchy(spark.createDataFrame(links, S), 2).collect()} == {"a": [], "b": [], "c": ["b", "x"]}


def test_descendants_and_empty(spark):
    links = [("o", "a", None), ("o", "b", "a"), ("o", "c", "b"), ("o", "d", "a")]
    pairs = {(r.ancestor, r.descendant, r.distance) for r in forest.descendants(forest.hierarchy(spark.createDataFrame(links, S), 2)).collect()}
    assert pairs == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("a", "d", 1)}
    assert forest.hierarchy(spark.createDataFrame([], S)).count() == 0
