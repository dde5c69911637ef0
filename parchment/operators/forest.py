"""Parent-child links to full hierarchies, by weighted disjoint-set forests merged level by level."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import checkpointed, hot_join

#: Partitions of one level that are merged into one of the next.
FAN_IN = 16
#: Links that one task may merge; more at the top level are resolved by pointer doubling.
TOP_ROWS = 1_000_000
_TYPE = "owner string, key string, up string, steps long, kind string, path array<string>"
_ARROW = pa.schema([("owner", pa.string()), ("key", pa.string()), ("up", pa.string()), ("steps", pa.int64()), ("kind", pa.string()), ("path", pa.list_(pa.string()))])


class OffsetForest:
    """Disjoint sets whose members know their distance to the set's top.

    Member i has an own link (up[i], steps[i]): ``ext`` leads to a key, ``root`` and
    ``cycle`` end the chain. Uniting i with the member its link names adds the offsets;
    a link that leads back into i's own set closes a cycle and is cut there.
    """

    def __init__(self, owner: list, key: list, up: list, steps: list, kind: list, path: list) -> None:
        self.owner, self.key, self.up, self.steps, self.kind, self.path = owner, key, up, steps, kind, path
        n = len(key)
        self.top, self.off, self.par = list(range(n)), [0] * n, [-1] * n
        at = {k: i for i, k in enumerate(zip(owner, key))}
        for i in range(n):
            if kind[i] == "ext" and (j := at.get((owner[i], up[i]))) is not None:
                r, d = self.find(j)
                if r == i:
                    up[i], steps[i], kind[i], path[i] = key[i], 0, "cycle", [key[i]]
                else:
                    self.top[i], self.off[i], self.par[i] = r, steps[i] + d, j

    def find(self, i: int) -> tuple[int, int]:
        """The top of i's set and i's distance to it; the way there is compressed."""
        way = []
        while self.top[i] != i:
            way.append(i)
            i = self.top[i]
        d = 0
        for x in reversed(way):
            d += self.off[x]
            self.top[x], self.off[x] = i, d
        return i, d

    def paths(self) -> list[list]:
        """For each member the keys from its chain's end down to itself, by walking the parent index once."""
        done: list = [None] * len(self.key)
        for i in range(len(done)):
            stack = []
            while done[i] is None and self.par[i] >= 0:
                stack.append(i)
                i = self.par[i]
            if done[i] is None:
                done[i] = self.path[i]
            for x in reversed(stack):
                done[x] = done[self.par[x]] + self.path[x]
        return done

    def resolved(self) -> pa.RecordBatch:
        up, steps, kind = [], [], []
        for i in range(len(self.key)):
            r, d = self.find(i)
            up.append(self.up[r])
            steps.append(self.steps[r] + d)
            kind.append(self.kind[r])
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip((self.owner, self.key, up, steps, kind, self.paths()), _ARROW)], schema=_ARROW)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [b for b in batches if b.num_rows]
    if got:
        t = pa.Table.from_batches(got)
        out = OffsetForest(*[t.column(n).to_pylist() for n in _ARROW.names]).resolved()
        for at in range(0, out.num_rows, 20_000):
            yield out.slice(at, 20_000)


def _jump(links: DataFrame) -> DataFrame:
    """Every open link goes on by the link it leads to; ``low`` is the least key met on the way."""
    to = links.select("owner", F.col("key").alias("up"), F.struct("up", "steps", "kind", "path", "low").alias("a"))
    met = hot_join(links.where("kind = 'ext'"), to, ["owner", "up"], "key", "left")
    pick = lambda c, e: F.when(F.col("a").isNull(), F.col(c)).otherwise(e).alias(c)
    # where nothing is found the chain ends in a key that isn't here
    kind = F.when(F.col("a").isNull(), "gone").otherwise(F.col("a.kind")).alias("kind")
    gone = met.select("owner", "key", pick("up", F.col("a.up")), pick("steps", F.col("steps") + F.col("a.steps")), kind, pick("path", F.concat("a.path", "path")), pick("low", F.least("low", "a.low")))
    return checkpointed(links.where("kind <> 'ext'").unionByName(gone))


def _doubled(links: DataFrame) -> DataFrame:
    """Links resolved by joins alone, in about log2(depth) rounds each way: a cycle shows as a key that is the least on its own way, and is cut there."""
    first = checkpointed(links.withColumn("low", F.col("up")))
    n = first.count()
    at, seen = first.withColumn("path", F.array().cast("array<string>")), 1
    while seen <= n and not at.where("kind = 'ext'").isEmpty():
        at, seen = _jump(at), seen * 2
    cut = at.where("kind = 'ext' and low = key").select("owner", "key").withColumn("cut", F.lit(True))
    is_cut = F.coalesce("cut", F.lit(False))
    at = first.join(cut, ["owner", "key"], "left").select(
        "owner", "key", F.when(is_cut, F.col("key")).otherwise(F.col("up")).alias("up"), F.when(is_cut, 0).otherwise(F.col("steps")).alias("steps"), F.when(is_cut, "cycle").otherwise(F.col("kind")).alias("kind"), F.when(is_cut, F.array("key")).otherwise(F.col("path")).alias("path"), "low"
    )
    at = checkpointed(at)
    while not at.where("kind = 'ext'").isEmpty():
        at = _jump(at)
    return at.select("owner", "key", "up", "steps", F.when(F.col("kind") == "gone", "ext").otherwise(F.col("kind")).alias("kind"), "path")


def _level(links: DataFrame, parts: int) -> DataFrame:
    if parts == 1:
        links = checkpointed(links)
        if links.count() > TOP_ROWS:
            return checkpointed(_doubled(links))
        links = links.coalesce(1)
    else:
        links = links.repartitionByRange(parts, "owner", "key")
    return checkpointed(links.mapInArrow(_merge, _TYPE))


def hierarchy(links: DataFrame, parts: int | None = None) -> DataFrame:
    """Each node's place: owner, key, parent, others, root, depth, finding, path.

    ``links`` has owner, key, parent (null: no parent). finding is null in a proper tree,
    'dangling' where the chain ends in a parent that doesn't exist (root is that missing
    key, depth counts the steps to it), 'cycle' on a cycle and 'below_cycle' where the chain
    leads into one (root, depth and path are then null). Rows with a null key are skipped;
    repeated (owner, key) rows are one node, whose parent is the least non-null one named;
    ``others`` lists any other parents that its rows name, so that no link is lost. A null
    owner is an owner of its own, and comes out as null.

    Rows are range-partitioned by owner and key, so that locators stand near their parents
    and no owner is confined to one task. Each partition builds an offset forest of its
    links; only the keys that other partitions point at go up to the next, FAN_IN times
    narrower level, so cycles and roots appear at the level where their links meet. If over
    TOP_ROWS links reach the top, joins resolve them instead of one task. The answers then
    go down again by joins in which only hot keys are salted.
    """
    spark = links.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = F.when(F.col("owner").isNull(), "").otherwise(F.concat(F.lit("="), "owner"))
    one = checkpointed(links.where("key is not null").select(named.alias("owner"), "key", "parent").groupBy("owner", "key").agg(F.min("parent").alias("parent"), F.sort_array(F.collect_set("parent")).alias("all")))
    root = F.col("parent").isNull()
    start = one.select("owner", "key", F.coalesce("parent", "key").alias("up"), F.when(root, 0).otherwise(1).cast("long").alias("steps"), F.when(root, "root").otherwise("ext").alias("kind"), F.array("key").alias("path"))
    levels, width = [_level(start, parts)], parts
    while width > 1:
        width = -(-width // FAN_IN)
        below = levels[-1]
        asked = below.where("kind = 'ext'").select("owner", F.col("up").alias("key")).distinct()
        levels.append(_level(below.join(asked, ["owner", "key"], "left_semi"), width))
    found = levels.pop()
    while levels:
        above = found.select("owner", F.col("key").alias("up"), F.struct("up", "steps", "kind", "path").alias("a"))
        below = levels.pop()
        ext = hot_join(below.where("kind = 'ext'"), above, ["owner", "up"], "key", "left")
        pick = lambda c, e: F.when(F.col("a").isNull(), F.col(c)).otherwise(e).alias(c)
        found = below.where("kind <> 'ext'").unionByName(
            ext.select("owner", "key", pick("up", F.col("a.up")), pick("steps", F.col("steps") + F.col("a.steps")), pick("kind", F.col("a.kind")), pick("path", F.concat("a.path", "path")))
        )
    found = checkpointed(found.join(one, ["owner", "key"]))
    # the cut member of each cycle: its parent's path holds exactly the cycle
    cut = found.where("kind = 'cycle' and key = up").select("owner", F.col("parent").alias("key"))
    on = found.where("kind = 'cycle'").join(cut, ["owner", "key"], "left_semi").select("owner", F.explode("path").alias("key")).distinct().withColumn("on_cycle", F.lit(True))
    cyclic = F.col("kind") == "cycle"
    finding = F.when(F.col("on_cycle"), "cycle").when(cyclic, "below_cycle").when(F.col("kind") == "ext", "dangling")
    owner = F.when(F.col("owner") != "", F.substring("owner", F.lit(2), F.length("owner")))
    return found.join(on, ["owner", "key"], "left").select(
        owner.alias("owner"), "key", "parent", F.slice("all", F.lit(2), F.greatest(F.size("all") - 1, F.lit(0))).alias("others"), F.when(~cyclic, F.col("up")).alias("root"), F.when(~cyclic, F.col("steps")).alias("depth"), finding.alias("finding"), F.when(~cyclic, F.col("path")).alias("path")
    )


def descendants(tree: DataFrame) -> DataFrame:
    """(owner, ancestor, descendant, distance) of every node below every node, by exploding paths."""
    return tree.select("owner", F.col("key").alias("descendant"), F.size("path").alias("_n"), F.posexplode("path").alias("_i", "ancestor")).where(F.col("_i") < F.col("_n") - 1).select(
        "owner", "ancestor", "descendant", (F.col("_n") - 1 - F.col("_i")).alias("distance")
    )
