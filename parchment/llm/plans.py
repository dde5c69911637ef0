"""Queries of the text problems over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import table
from . import boilerplate, leaks, normal, scans, sql, subjects, tokens


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [normal.variants(table(spark, d, t), k, "text").select(F.lit(t).alias("table_name"), "row_key") for t, k in (("evidence", "evidence_id"), ("searchable_text_entry", "entry_id"))]
    return parts[0].unionByName(parts[1]).distinct()


def p1_normal(spark: SparkSession, d: str) -> DataFrame:
    """Every evidence text in its consistent form."""
    return table(spark, d, "evidence").select("evidence_id", normal.normalized(F.col("text")).alias("text"))


def _repeated(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.repeated_lines(table(spark, d, "evidence"), "evidence_id", "source_id", "text", date="extracted_at")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Counted over clusters with their multiplicities, as each evidence_id counts in p2."""
    return _repeated(spark, d).select(F.col("doc").alias("evidence_id"), "line_no")


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    """Evidence texts without the repeated lines."""
    ev = table(spark, d, "evidence")
    return boilerplate.without_lines(ev.select("evidence_id", "text"), _repeated(spark, d), "evidence_id", "text")


def p2_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Repeated lines counted over clusters of equal text and on at least two days."""
    return boilerplate.repeated_lines(table(spark, d, "evidence"), "evidence_id", "source_id", "text", date="extracted_at", by_cluster=True, min_dates=2)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.Scans(table(spark, d, "evidence"), table(spark, d, "page_line")).noise()


def p7_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Continuous paragraphs of every page and block."""
    return scans.Scans(table(spark, d, "evidence"), table(spark, d, "page_line")).repaired()


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"), "doc_id", "text")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_item"), "doc_id", "item_id").withColumnsRenamed({"doc": "doc_id", "item": "item_id"})


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Of the passages within an edit, those without one."""
    return _leaks(spark, d).where("edits = 0").select("doc_id", "item_id")


def p9_near(spark: SparkSession, d: str) -> DataFrame:
    """Passages of 12 words within one edit."""
    return _leaks(spark, d)


def _subjects(spark: SparkSession, d: str) -> subjects.Subjects:
    return subjects.Subjects(table(spark, d, "documents"), table(spark, d, "document_label"), table(spark, d, "subject_area"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).documents().select(F.col("doc").alias("doc_id"), "subject_key")


def p10_makeup(spark: SparkSession, d: str) -> DataFrame:
    """The corpus by subject."""
    return _subjects(spark, d).makeup()


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_normal, p2_found, p2_clean, p2_clusters, p7_found, p7_paragraphs, p8_ids, p9_found, p9_near, p10_found, p10_makeup)}


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
