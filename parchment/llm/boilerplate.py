"""Lines repeated across one source's documents, found over collapsed documents and removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import BROADCAST_ROWS, checkpointed, salted_join, spread
from .normal import normalized


def line_form(line: Column) -> Column:
    """What two lines must share to be the same: no digits, no blanks, lower case, consistent characters (given)."""
    return F.lower(F.regexp_replace(line, r"[\p{Nd}\s]+", ""))


def _wide(form: Column) -> Column:
    return F.struct(F.xxhash64(form, F.lit(1)).alias("a"), F.xxhash64(F.lit(2), form).alias("b"))


def line_keys(text: Column) -> Column:
    """Wide hashes of the forms of a text's lines, by position; null for a line without a letter."""
    kept = F.regexp_replace(text, "[\r\u0085  ]", " ")  # a line is what a line feed ends
    return F.transform(F.split(normalized(kept), "\n"), lambda x: F.when(x.rlike(r"\p{L}"), _wide(line_form(x))))


def repeated_lines(df: DataFrame, doc: str, source: str, text: str, date: str | None = None, by_cluster: bool = False, min_docs: int = 5, min_share: float = 0.04, min_dates: int = 1) -> DataFrame:
    """(doc, line_no, docs, clusters, total): every line that stands excessively often in its source's documents.

    Rows with the same ``doc`` are one document (its least day counts). Documents of one
    source whose lines are the same form one cluster, which keeps the number of its documents
    and its first day; lines are then counted over clusters: ``clusters``, ``docs`` (each
    cluster with its documents) and days of ``date``. A line is repeated if it stands in at
    least ``min_docs`` documents and ``min_share`` of its source's ``total`` (those without
    text count in it), with ``by_cluster`` in as many clusters instead, so that a republished
    article isn't taken for boilerplate, and on ``min_dates`` distinct days. line_no counts
    from 1, empty lines included. A null source is a source of its own. Lines are keyed by
    128-bit hashes; only these are shuffled, pre-aggregated by source and line. The repeated
    lines are joined back by broadcast if they are few, otherwise salted, so that a source
    with a third of all rows spreads over many tasks.
    """
    day = F.to_date(F.col(f"`{date}`")) if date else F.lit(None).cast("date")
    own = spread(df.where(F.col(f"`{doc}`").isNotNull()).select(*[F.col(f"`{c}`").alias(c) for c in dict.fromkeys(x for x in (doc, source, text, date) if x)]))
    named = F.when(F.col(f"`{source}`").isNull(), "").otherwise(F.concat(F.lit("="), f"`{source}`"))
    rows = own.select(F.col(f"`{doc}`").alias("doc"), named.alias("source"), day.alias("day"), line_keys(F.col(f"`{text}`")).alias("keys"))
    rows = rows.select("doc", F.struct("day", "source", F.col("keys.a").alias("a"), F.col("keys.b").alias("b")).alias("r"))
    # read twice, and small beside the texts: two long integers a line
    docs = checkpointed(rows.groupBy("doc").agg(F.min("r").alias("r")).select("doc", "r.*"))
    # a hash passes over nulls, so a line without a letter gets a number; a null text keeps to itself
    a, b = (F.coalesce(F.transform(c, lambda x: F.coalesce(x, F.lit(0))), F.array(F.lit(1).cast("long"))) for c in ("a", "b"))
    same = docs.select("source", "day", F.xxhash64(a, b).alias("ka"), F.xxhash64(b, a).alias("kb"), F.array_distinct(F.filter(F.arrays_zip("a", "b"), lambda x: x["a"].isNotNull())).alias("lines"))
    clusters = same.groupBy("source", "ka", "kb").agg(F.count("*").alias("copies"), F.min("day").alias("day"), F.first("lines").alias("lines"))
    one = F.lit(1).cast("long") if by_cluster else F.col("copies")
    # a source's total and its lines' counts in one pass: the total is the row without a line
    parts = clusters.select("source", "day", "copies", one.alias("n"), F.explode(F.concat(F.array(F.lit(None).cast("struct<a:bigint,b:bigint>")), F.coalesce("lines", F.array().cast("array<struct<a:bigint,b:bigint>>")))).alias("key"))
    often = parts.groupBy("source", "key").agg(F.sum("n").alias("n"), F.sum("copies").alias("docs"), F.count("*").alias("clusters"), F.min("day").alias("lo"), F.max("day").alias("hi")).where((F.col("n") >= min_docs) | F.col("key").isNull())
    often = checkpointed(often)
    total = often.where("key is null").select("source", F.col("n").alias("total"))
    # at most 1 / min_share times the lines of a document per source
    often = often.where("key is not null").join(total, "source").where(F.col("n") >= F.col("total") * F.lit(min_share) - 1e-9)
    often = checkpointed((often.where("lo <> hi") if min_dates > 1 else often).select("source", "key", "docs", "clusters", "total"))
    few = often.count() <= BROADCAST_ROWS
    join = lambda big, by: big.join(F.broadcast(often), ["source", "key"]) if few else salted_join(big, often, ["source", "key"], by)
    if min_dates > 2:
        days = join(parts.where("key is not null"), "day").groupBy("source", "key", "docs", "clusters", "total").agg(F.countDistinct("day").alias("days"))
        often = checkpointed(days.where(F.col("days") >= min_dates).drop("days"))
    placed = docs.select("doc", "source", F.posexplode(F.arrays_zip("a", "b")).alias("pos", "key")).where("key.a is not null")
    return join(placed, "doc").select("doc", (F.col("pos") + 1).alias("line_no"), "docs", "clusters", "total")


def without_lines(df: DataFrame, found: DataFrame, doc: str, text: str) -> DataFrame:
    """``df`` with the found lines taken out of ``text``; null stays null, a text of such lines only becomes empty."""
    cut = found.groupBy("doc").agg(F.collect_set("line_no").alias("_cut"))
    j = df.join(cut, F.col(f"`{doc}`") == F.col("doc"), "left").drop("doc") if doc != "doc" else df.join(cut, "doc", "left")
    kept = F.array_join(F.filter(F.split(F.col(f"`{text}`"), "\n"), lambda x, i: F.coalesce(~F.array_contains("_cut", i + 1), F.lit(True))), "\n")
    return j.withColumn(text, kept).drop("_cut")
