"""Trees: nearest existing parents, marker stacks, invariants."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def nearest_parent(df: DataFrame, owner: str, key: str, separator: str = r"\.") -> DataFrame:
    """(owner, key, parent): the longest proper prefix of a dotted locator that exists under the same owner, else null.

    Prefixes are listed and joined by equality, so no pair of locators is compared.
    """
    d = df.select(owner, key).where(f"{key} is not null").distinct()
    parts = F.split(key, separator)
    pre = d.withColumn("_p", parts).where(F.size("_p") > 1).select(owner, key, F.explode(F.sequence(F.lit(1), F.size("_p") - 1)).alias("n"), "_p").select(owner, key, "n", F.array_join(F.slice("_p", F.lit(1), F.col("n")), ".").alias("prefix"))
    hit = pre.join(d.select(owner, F.col(key).alias("prefix")), [owner, "prefix"]).groupBy(owner, key).agg(F.max_by("prefix", "n").alias("parent"))
    return d.join(hit, [owner, key], "left").select(owner, key, "parent")


def marker_kind(marker: str) -> tuple[str, int | None]:
    """('number' | 'lower' | 'upper' | 'other', ordinal) of '(1)', '(a)', '(A)'; other markers, such as '(ii)', have no ordinal."""
    m = marker.strip().strip("()").strip()
    if m.isdecimal():
        return "number", int(m)
    if len(m) == 1 and m.isascii() and m.isalpha():
        return ("upper" if m.isupper() else "lower"), ord(m.lower()) - 96
    return "other", None


def marker_parents(rows: list[tuple[str, str]]) -> list[tuple[str, str | None, str]]:
    """(id, parent id, state) of a section's list items in order; null is the section itself.

    A capital letter stands under the section and closes all that is open. Any other marker
    that follows the last open one of its kind by exactly one is its sibling; otherwise it
    opens a level below the last open item. state is ambiguous where nothing is open for such
    a marker, else ok.
    """
    open_: list[tuple[str, int | None, str]] = []
    out = []
    for ident, marker in rows:
        kind, n = marker_kind(marker)
        same = next((i for i in reversed(range(len(open_))) if open_[i][0] == kind), None)
        state = "ok"
        if kind == "upper":
            open_ = []
        elif not open_:
            state = "ambiguous"
        elif same is not None and n is not None and open_[same][1] == n - 1:
            open_ = open_[:same]
        out.append((ident, open_[-1][2] if open_ else None, state))
        open_.append((kind, n, ident))
    return out


def marker_hierarchy(df: DataFrame, owner: str, order: str, ident: str, marker: str) -> DataFrame:
    """(owner, ident, parent, state) by one pass over each owner's list items; an owner is one list, bounded by its section."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(["o", "i"])
        got = marker_parents([*zip(p.i, p.m)])
        return pd.DataFrame([(pdf.w.iloc[0], *g) for g in got], columns=["owner", "ident", "parent", "state"])

    d = df.where(F.col(marker).isNotNull()).select(F.col(owner).alias("w"), F.col(order).alias("o"), F.col(ident).alias("i"), F.col(marker).alias("m"))
    return d.groupBy("w").applyInPandas(one, "owner string, ident string, parent string, state string")


def tree_findings(df: DataFrame, owner: str, key: str, parent: str, start: str, end: str) -> DataFrame:
    """(owner, key, code): duplicate-locator, missing-parent, bad-span, span-outside-parent.

    Each is found by one aggregate or equi-join; a row may bear several codes.
    """
    d = df.select(F.col(owner).alias("owner"), F.col(key).alias("key"), F.col(parent).alias("parent"), F.col(start).alias("s"), F.col(end).alias("e")).distinct()
    one = d.groupBy("owner", "key").agg(F.count("*").alias("n"), F.min("s").alias("ps"), F.max("e").alias("pe"))
    dup = one.where("n > 1").select("owner", "key", F.lit("duplicate-locator").alias("code"))
    bad = d.where("s is null or e is null or s >= e").select("owner", "key", F.lit("bad-span").alias("code"))
    j = d.where("parent is not null").join(one.select("owner", F.col("key").alias("parent"), "ps", "pe", F.lit(True).alias("there")), ["owner", "parent"], "left")
    miss = j.where("there is null").select("owner", "key", F.lit("missing-parent").alias("code"))
    out = j.where("there and (s < ps or e > pe)").select("owner", "key", F.lit("span-outside-parent").alias("code"))
    return dup.unionByName(bad).unionByName(miss).unionByName(out).distinct()
