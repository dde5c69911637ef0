"""Reference graphs: identified nodes and edges, components, cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from collections.abc import Iterator

import pyarrow as pa

from ..functions.ids import short_id
from ..session import checkpointed

#: Edges that one task may hold; a larger rest is worked off by joins.
LOCAL_EDGES = 200_000


def strong_components(edges: list[tuple[str, str]]) -> dict[str, str]:
    """Node to the greatest name of its strongly connected component, by one walk with its own stack."""
    out: dict[str, list[str]] = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    order: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    held: set[str] = set()
    result: dict[str, str] = {}
    for root in out:
        if root in order:
            continue
        work = [(root, iter(out[root]))]
        order[root] = low[root] = len(order)
        stack.append(root)
        held.add(root)
        while work:
            v, rest = work[-1]
            for w in rest:
                if w not in order:
                    order[w] = low[w] = len(order)
                    stack.append(w)
                    held.add(w)
                    work.append((w, iter(out[w])))
                    break
                if w in held:
                    low[v] = min(low[v], order[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == order[v]:
                    part = []
                    while True:
                        w = stack.pop()
                        held.discard(w)
                        part.append(w)
                        if w == v:
                            break
                    name = max(part)
                    result.update((w, name) for w in part)
    return result


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(node, component) of a small rest of edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = strong_components([p for b in batches for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())])
        yield pa.RecordBatch.from_arrays([pa.array([*found], pa.string()), pa.array([*found.values()], pa.string())], names=["node", "component"])

    return edges.select("source", "target").coalesce(1).mapInArrow(run, "node string, component string")


def provenance(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with deterministic ids: nodes by owner and key, edges by both ends and type; repeated edges are one, counted."""
    key = lambda o, k: F.concat_ws("|", o, k)
    ends = edges.select(F.col("source_owner").alias("owner"), F.col("source_key").alias("key")).unionByName(edges.select(F.col("target_owner").alias("owner"), F.col("target_key").alias("key")))
    nodes = ends.where("owner is not null and key is not null").distinct().withColumn("node_id", short_id("provnode", key("owner", "key")))
    e = edges.where("source_owner is not null and source_key is not null and target_owner is not null and target_key is not null").groupBy("source_owner", "source_key", "target_owner", "target_key", "type").agg(F.count("*").alias("occurrences"))
    a, b = key("source_owner", "source_key"), key("target_owner", "target_key")
    return nodes, e.select(short_id("provedge", F.concat_ws("|", a, b, "type")).alias("edge_id"), short_id("provnode", a).alias("source"), short_id("provnode", b).alias("target"), "type", "occurrences")


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component): connected components, named by their least node, by alternating large-star and small-star joins.

    Every round halves the distances at least, so the rounds grow with the logarithm of the
    longest path. Raises if ``rounds`` don't suffice.
    """
    e = edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"))
    isolated = e.where("a = b").select(F.col("a").alias("node"))
    e = checkpointed(e.where("a <> b").distinct())
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        flip = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = flip.groupBy("u").agg(F.min("v").alias("m"))
        small = flip.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).where("a <> b").distinct()
        new = checkpointed(small.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        same = new.count() == e.count() and new.join(e, ["a", "b"], "left_anti").isEmpty()
        e = new
        if same:
            break
    else:
        raise RuntimeError("components need more rounds")
    members = e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("component")))
    return members.unionByName(isolated.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))


def cycles(edges: DataFrame, rounds: int = 200, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, component): strongly connected components of more than one node, and nodes that point at themselves.

    Nodes without an incoming or outgoing edge are trimmed off again and again first. A rest of
    at most ``local_edges`` is walked in one task; on a larger one, the greatest name that reaches a node forwards is compared with the greatest
    that reaches it backwards. Nodes where both agree form the component of that name; they
    are taken out and the rest goes round again.
    """
    loops = edges.where("source = target").select(F.col("source").alias("node")).distinct()
    e = checkpointed(edges.select("source", "target").where("source <> target").distinct())
    found = None
    for _ in range(rounds):
        n = e.count()
        while n > local_edges:
            e = checkpointed(e.join(e.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(e.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target"))
            left, n = n, e.count()
            if left == n:
                break
        if n <= local_edges:
            done = checkpointed(_in_one_task(e))
            found = done if found is None else found.unionByName(done)
            break

        def reach(src: str, dst: str) -> DataFrame:
            c = checkpointed(e.select(F.col(src).alias("node")).unionByName(e.select(F.col(dst).alias("node"))).distinct().withColumn("c", F.col("node")))
            while True:
                up = e.join(c.select(F.col("node").alias(src), "c"), src).groupBy(F.col(dst).alias("node")).agg(F.max("c").alias("m"))
                new = checkpointed(c.join(up, "node", "left").select("node", F.greatest("c", "m").alias("c"), (F.col("m") > F.col("c")).alias("grew")))
                if new.where("grew").isEmpty():
                    return c
                c = new.select("node", "c")

        f, b = reach("source", "target"), reach("target", "source")
        done = checkpointed(f.join(b, ["node", "c"]).select("node", F.col("c").alias("component")))
        found = done if found is None else found.unionByName(done)
        gone = done.select("node")
        e = checkpointed(e.join(gone.select(F.col("node").alias("source")), "source", "left_anti").join(gone.select(F.col("node").alias("target")), "target", "left_anti"))
    else:
        raise RuntimeError("cycles need more rounds")
    single = loops.select("node", F.col("node").alias("component"))
    if found is None:
        return single
    big = found.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    found = found.join(big, "component").select("node", "component")
    return found.unionByName(single.join(found.select("node"), "node", "left_anti"))
