"""References to records that are missing, deleted or loaded later."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import locator, month
from ..session import salted_join

#: Columns of a parent key in long form, and of a reference.
PARENT = ["owner", "key", "loaded_at", "deleted"]
CHILD = ["table_name", "row_key", "owner", "key", "seen_at"]


def orphan_references(parents: DataFrame, children: DataFrame, salts: int = 16) -> DataFrame:
    """Each reference without a usable parent: (table_name, row_key, seen_month, reason).

    ``parents``: owner, key, loaded_at, deleted; ``children``: table_name, row_key, owner,
    key, seen_at. Both are reduced to one row a key, tagged, united in long form and grouped
    by key; the groups that lack the parent flag, are deleted, or whose parent came after
    the earliest reference are kept, and only their references are joined back, the hot keys
    salted. reason is the first that holds of missing, deleted, late. Repeated references
    (same table and row_key) are one, at their earliest time. A null owner or key names no
    section: missing. A parent without a time is never late; a reference without one is
    never late and has a null month.
    """
    # a reference delivered twice is one; its payload is small, so one shuffle on its own key
    refs = children.groupBy("table_name", "row_key", "owner", "key").agg(F.min("seen_at").alias("seen_at"))
    tagged = parents.select("owner", "key", F.col("loaded_at"), F.col("deleted"), F.lit(None).cast("timestamp_ntz").alias("seen_at"), F.lit(1).alias("is_parent"))
    asked = children.select("owner", "key", F.lit(None).cast("timestamp_ntz").alias("loaded_at"), F.lit(False).alias("deleted"), "seen_at", F.lit(0).alias("is_parent"))
    groups = tagged.unionByName(asked).groupBy("owner", "key").agg(
        F.max("is_parent").alias("is_parent"), F.min("loaded_at").alias("loaded_at"), F.max("deleted").alias("deleted"), F.min("seen_at").alias("first_seen"), F.min("is_parent").alias("_asked")
    )
    bad = groups.where((F.col("_asked") == 0) & F.col("owner").isNotNull() & F.col("key").isNotNull() & ((F.col("is_parent") == 0) | F.col("deleted") | (F.col("loaded_at") > F.col("first_seen")))).select(
        "owner", "key", "is_parent", "loaded_at", "deleted"
    )
    reason = F.when(F.col("is_parent") == 0, "missing").when(F.col("deleted"), "deleted").when(F.col("loaded_at") > F.col("seen_at"), "late")
    found = salted_join(refs, bad, ["owner", "key"], "row_key", salts=salts).withColumn("reason", reason).where("reason is not null")
    keyless = refs.where(F.col("owner").isNull() | F.col("key").isNull()).withColumn("reason", F.lit("missing"))
    cols = ["table_name", "row_key", month(F.col("seen_at")).alias("seen_month"), "reason"]
    return found.select(*cols).unionByName(keyless.select(*cols)).distinct()


def orphans_by_period(found: DataFrame) -> DataFrame:
    """Counts per table, month and reason."""
    return found.groupBy("table_name", "seen_month", "reason").agg(F.count("*").alias("orphans"))


def section_parents(sections: DataFrame) -> DataFrame:
    return sections.select(F.col("artifact_id").alias("owner"), locator(F.col("locator")).alias("key"), "loaded_at", F.col("deleted_at").isNotNull().alias("deleted"))


def section_children(sections: DataFrame) -> DataFrame:
    """The undeleted sections that name a parent; a node is deleted if any of its deliveries is."""
    one = sections.groupBy("node_id").agg(
        F.min("loaded_at").alias("seen_at"), F.max(F.col("deleted_at").isNotNull()).alias("deleted"), F.max(F.struct(locator(F.col("parent_locator")).alias("key"), F.col("artifact_id").alias("owner"))).alias("p")
    )
    return one.where(~F.col("deleted") & F.col("p.key").isNotNull()).select(F.lit("source_text_section").alias("table_name"), F.col("node_id").alias("row_key"), "p.owner", "p.key", "seen_at")


def relation_children(relations: DataFrame) -> DataFrame:
    key = locator(F.col("target_locator"))
    return relations.where(key.isNotNull() & ~key.startswith("external:")).select(
        F.lit("reference_relation").alias("table_name"), F.col("relation_id").alias("row_key"), F.col("target_artifact_id").alias("owner"), key.alias("key"), F.col("recorded_at").alias("seen_at")
    )
