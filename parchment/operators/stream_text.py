"""Lines as one addressed text, terms in running text, boxes in a writing frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import BROADCAST_ROWS
from .relations import _over_cells


def text_stream(df: DataFrame, owner: str, order: list[str], text: str, cell: Column) -> DataFrame:
    """``df`` with start and end: 0-based half-open code points of each line in its owner's text, lines parted by one line feed.

    Offsets run over cells of the order, so no owner is summed in one task. A null line is an empty one.
    """
    d = df.withColumn("_l", F.coalesce(F.length(text), F.lit(0)).cast("long") + 1)
    d = _over_cells(d, [owner], cell, F.sum("_l"), F.sum("_c"))
    w = Window.partitionBy(owner, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("_l").over(w) + F.coalesce("_before", F.lit(0)) - 1
    return d.withColumn("end", end).withColumn("start", F.col("end") - F.col("_l") + 1).drop("_l", "_cell", "_before")


def term_mentions(df: DataFrame, key: str, text: str, terms: DataFrame, term: str) -> DataFrame:
    """(key, term, mentions): whole-word mentions of each term, in lower case.

    Runs of words, of just the lengths that terms have, are joined to the terms by equality;
    no text is searched once per term. A run that repeats in one text is counted before the
    join. Longer terms hide none of the shorter ones in them.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    split = terms.select(F.regexp_extract_all(F.lower(term), F.lit("[a-z0-9]+"), F.lit(0)).alias("w")).where("size(w) > 0")
    seen = split.agg(F.collect_set(F.size("w")).alias("sizes"), F.count("*").alias("n")).first()
    t = split.select(F.array_join("w", " ").alias("term")).distinct()
    t = F.broadcast(t) if seen.n <= BROADCAST_ROWS else t
    d = df.where(F.col(text).isNotNull()).select(key, words.alias("w")).where("size(w) > 0")
    sizes = F.array(*[F.lit(n) for n in sorted(seen.sizes)]).cast("array<int>")
    runs = F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.when(i + n - 1 <= F.size("w"), F.array_join(F.slice("w", i, n), " ")))))
    return d.select(key, F.explode(runs).alias("term")).join(t, "term").groupBy(key, "term").agg(F.count("*").alias("mentions"))


def in_writing_frame(box: Column, dx: Column, dy: Column) -> Column:
    """A box (x0, y0, x1, y1) turned so that text of direction (dx, dy), a multiple of 90 degrees, runs to the right."""
    x0, y0, x1, y1 = (F.get(box, F.lit(i)) for i in range(4))
    right, down, left = (dx > 0.5), (dy > 0.5), (dx < -0.5)
    return F.when(right, box).when(down, F.array(y0, -x1, y1, -x0)).when(left, F.array(-x1, -y1, -x0, -y0)).otherwise(F.array(-y1, x0, -y0, x1))
