"""Vector search: exact top-k by dot product for a query set, in blocks; maxima per owner; fused scores over all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Queries whose vectors one broadcast holds.
BLOCK = 4_096
#: Scores that one slice of rows makes with a block of queries, and partial maxima that a task holds.
HELD = 4_000_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def top_k(queries: DataFrame, rows: DataFrame, k: int = 5, ident: str = "vec_id", vector: str = "embedding", exclude_self: bool = True) -> DataFrame:
    """(query_id, neighbour_id, score, rank): the ``k`` rows of the greatest dot product for each query, against all rows.

    Queries are broadcast in blocks; each Arrow batch of rows is multiplied by the block at
    once and yields its own best k a query, so the shuffle carries k rows a query and task.
    Ties go to the lower id. Rows without a vector or of another length are no candidates.
    """
    spark = rows.sparkSession
    out, block = None, []

    def probe(qs: list[tuple[int, list[float]]]) -> DataFrame:
        shared = spark.sparkContext.broadcast((np.array([q for q, _ in qs], np.int64), np.array([v for _, v in qs], np.float64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, m = shared.value
            best: list[list[tuple[float, int]]] = [[] for _ in ids]
            for b in batches:
                pairs = [(i, v) for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if v is not None and len(v) == m.shape[1]]
                if not pairs:
                    continue
                own = np.array([i for i, _ in pairs], np.int64)
                score = np.round(m @ np.array([v for _, v in pairs], np.float64).T, 9)
                for q in range(len(ids)):
                    s = np.where(own == ids[q], -np.inf, score[q]) if exclude_self else score[q]
                    top = np.lexsort((own, -s))[:k]
                    best[q] = sorted([*best[q], *((-float(s[t]), int(own[t])) for t in top if np.isfinite(s[t]))])[:k]
            flat = [(int(ids[q]), n, -s) for q, found in enumerate(best) for s, n in found]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat], pa.int64()), pa.array([x[2] for x in flat], pa.float64())], names=["query_id", "neighbour_id", "score"])

        return rows.select(F.col(ident).cast("long"), vector).mapInArrow(run, "query_id long, neighbour_id long, score double")

    for r in queries.select(F.col(ident).alias("i"), F.col(vector).alias("v")).where("v is not null").toLocalIterator():
        block.append((r.i, list(r.v)))
        if len(block) == BLOCK:
            part, block = probe(block), []
            out = part if out is None else out.unionByName(part)
    if block or out is None:
        part = probe(block) if block else spark.createDataFrame([], "query_id long, neighbour_id long, score double")
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "neighbour_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("score", F.round("score", 6))


def _blocks(queries: DataFrame, ident: str, vector: str, label: str) -> Iterator[tuple[np.ndarray, np.ndarray, list[object]]]:
    """Ids, vectors and labels of the queries, BLOCK at a time."""
    block: list[tuple[int, list[float], object]] = []
    rows = queries.select(F.col(ident).cast("long").alias("i"), F.col(vector).alias("v"), F.col(label).alias("l")).where("i is not null and v is not null").toLocalIterator()
    for r in rows:
        block.append((r.i, list(r.v), r.l))
        if len(block) == BLOCK:
            yield np.array([q[0] for q in block], np.int64), np.array([q[1] for q in block], np.float64), [q[2] for q in block]
            block = []
    if block:
        yield np.array([q[0] for q in block], np.int64), np.array([q[1] for q in block], np.float64), [q[2] for q in block]


def _scores(batches: Iterator[pa.RecordBatch], ids: np.ndarray, m: np.ndarray) -> Iterator[tuple[np.ndarray, list[object], np.ndarray]]:
    """Ids, labels and scores (query by row) of slices of the rows; a query's score with itself is -inf."""
    step = max(1, HELD // len(ids))
    for b in batches:
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            kept = [(i, v, x) for i, v, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()) if i is not None and v is not None and len(v) == m.shape[1]]
            if kept:
                own = np.array([i for i, _, _ in kept], np.int64)
                score = np.round(m @ np.array([v for _, v, _ in kept], np.float64).T, 9)
                score[ids[:, None] == own[None, :]] = -np.inf
                yield own, [x for _, _, x in kept], score


def best_per_label(queries: DataFrame, rows: DataFrame, label: str, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, label, score): for each query the greatest dot product with any other row of each label, over all rows.

    Tasks yield partial maxima, so the shuffle carries a row a query, label and task.
    """
    spark, kind = rows.sparkSession, rows.schema[label].dataType.simpleString()
    schema = f"query_id long, label {kind}, score double"

    def probe(ids: np.ndarray, m: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast((ids, m))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, m = shared.value
            best: dict[object, np.ndarray] = {}
            label_type = None

            def flat() -> pa.RecordBatch:
                made = [(int(ids[q]), x, float(s[q])) for x, s in best.items() for q in np.flatnonzero(np.isfinite(s))]
                return pa.RecordBatch.from_arrays([pa.array([x[0] for x in made], pa.int64()), pa.array([x[1] for x in made], label_type), pa.array([x[2] for x in made], pa.float64())], names=["query_id", "label", "score"])

            def typed() -> Iterator[pa.RecordBatch]:
                nonlocal label_type
                for b in batches:
                    label_type = b.schema.field(2).type
                    yield b

            for _, labels, score in _scores(typed(), ids, m):
                code: dict[object, int] = {}
                codes = np.array([code.setdefault(x, len(code)) for x in labels])
                order = np.argsort(codes, kind="stable")
                most = np.maximum.reduceat(score[:, order], np.searchsorted(codes[order], np.arange(len(code))), axis=1)
                for x, c in code.items():
                    best[x] = np.maximum(best[x], most[:, c]) if x in best else most[:, c].copy()
                if len(best) * len(ids) > HELD:
                    yield flat()
                    best.clear()
            if best:
                yield flat()

        return rows.select(F.col(ident).cast("long"), vector, label).mapInArrow(run, schema)

    out = None
    for ids, m, _ in _blocks(queries, ident, vector, label):
        part = probe(ids, m)
        out = part if out is None else out.unionByName(part)
    out = spark.createDataFrame([], schema) if out is None else out
    return out.groupBy("query_id", "label").agg(F.round(F.max("score"), 6).alias("score"))


def hybrid_top_k(queries: DataFrame, rows: DataFrame, label: str, k: int = 10, weights: tuple[float, float] = (0.55, 0.45), ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, neighbour_id, fused): the ``k`` best rows by fused score for each query, among all other rows.

    Dot product and context (1 for a row of the query's label, 0 for another, null if one has
    none) are min-max normalised over all rows as in ``fuse``, and weighted. Among rows of
    equal context the fused score grows with the dot product, so the best k of each context
    hold the best k of all; tasks yield these with the extremes of all that they read.
    """
    spark = rows.sparkSession
    schema = "query_id long, neighbour_id long, score double, context double, lo double, hi double, c_lo double, c_hi double"

    def probe(ids: np.ndarray, m: np.ndarray, asked: list[object]) -> DataFrame:
        shared = spark.sparkContext.broadcast((ids, m, asked))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, m, asked = shared.value
            code = {x: c for c, x in enumerate(dict.fromkeys(x for x in asked if x is not None))}
            query_code = np.array([-2 if x is None else code[x] for x in asked])
            lo, hi = np.full(len(ids), np.inf), np.full(len(ids), -np.inf)
            best: dict[tuple[int, float | None], list[tuple[float, int]]] = {}
            for own, labels, score in _scores(batches, ids, m):
                row_code = np.array([-2 if x is None else code.get(x, -1) for x in labels])
                real = np.isfinite(score)
                lo = np.minimum(lo, np.where(real, score, np.inf).min(axis=1))
                hi = np.maximum(hi, score.max(axis=1))
                for q, c in enumerate(query_code):
                    none = (row_code == -2) | (c == -2)
                    for context, of in ((1.0, ~none & (row_code == c)), (0.0, ~none & (row_code != c)), (None, none)):
                        held = best.get((q, context), [])
                        at = np.flatnonzero(of & real[q] & (score[q] >= -held[-1][0] if len(held) == k else True))
                        if len(at):
                            s = score[q][at]
                            top = np.lexsort((own[at], -s))[:k]
                            best[q, context] = sorted([*held, *((-float(s[t]), int(own[at[t]])) for t in top)])[:k]
            made = []
            for (q, context), found in best.items():
                seen = [c for c in (0.0, 1.0) if (q, c) in best] or [None]
                made += [(int(ids[q]), n, -s, context, float(lo[q]), float(hi[q]), seen[0], seen[-1]) for s, n in found]
            types = [pa.int64(), pa.int64(), *[pa.float64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in made], t) for i, t in enumerate(types)], names=["query_id", "neighbour_id", "score", "context", "lo", "hi", "c_lo", "c_hi"])

        return rows.select(F.col(ident).cast("long"), vector, label).mapInArrow(run, schema)

    out = None
    for ids, m, asked in _blocks(queries, ident, vector, label):
        part = probe(ids, m, asked)
        out = part if out is None else out.unionByName(part)
    out = spark.createDataFrame([], schema) if out is None else out
    w = Window.partitionBy("query_id")

    def normal(c: str, least: str, most: str) -> Column:
        lo, hi = F.min(least).over(w), F.max(most).over(w)
        return F.coalesce((F.coalesce(F.col(c), lo, F.lit(0.0)) - lo) / (hi - lo + F.lit(1e-9)), F.lit(0.0))

    d = out.withColumn("fused", F.lit(weights[0]) * normal("score", "lo", "hi") + F.lit(weights[1]) * normal("context", "c_lo", "c_hi"))
    rank = F.row_number().over(w.orderBy(F.desc("fused"), "neighbour_id"))
    return d.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "neighbour_id", F.round("fused", 6).alias("fused"))


def max_per_owner(scores: DataFrame, owner: str, score: str) -> DataFrame:
    return scores.groupBy(owner).agg(F.max(score).alias(score))


def fuse(scores: DataFrame, weights: dict[str, float], part: list[str]) -> DataFrame:
    """``scores`` with ``fused``: min-max normalised columns, weighted. A constant column counts 0; a null one is the least."""
    w = Window.partitionBy(*part)
    total: Column = F.lit(0.0)
    for c, k in weights.items():
        v = F.coalesce(F.col(c).cast("double"), F.min(F.col(c).cast("double")).over(w), F.lit(0.0))
        lo, hi = F.min(F.col(c).cast("double")).over(w), F.max(F.col(c).cast("double")).over(w)
        total = total + F.lit(k) * F.coalesce((v - lo) / (hi - lo + F.lit(1e-9)), F.lit(0.0))
    return scores.withColumn("fused", F.round(total, 6))
