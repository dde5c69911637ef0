"""Smaller inventory operators: ranges, agreement, lineages, families, fingerprints, view boxes, glyph lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ids import text_sha256


def sibling_ranges(refs: DataFrame, known: DataFrame, ref: str, raw: str, owner: str, key: str) -> DataFrame:
    """(ref, members, state): references such as '1.2(a)-(d)' expanded to all members, each of which must exist.

    A plain reference is a range of one. state: resolved, partial, nonexistent, or malformed
    where the ends aren't single letters in order.
    """
    pat = r"^(.*)\(([a-z])\)\s*(?:-|–|to)\s*\(([a-z])\)$"
    d = refs.select(ref, owner, F.col(raw).alias("raw")).where("raw is not null")
    a, b = F.ascii(F.regexp_extract("raw", pat, 2)), F.ascii(F.regexp_extract("raw", pat, 3))
    is_range = F.col("raw").rlike(pat)
    letters = F.when(is_range & (a <= b), F.transform(F.sequence(a, F.greatest(a, b)), lambda c: F.concat(F.regexp_extract("raw", pat, 1), F.lit("("), F.char(c), F.lit(")")))).when(~is_range, F.array("raw"))
    m = d.withColumn("members", letters)
    hit = m.select(ref, owner, F.explode("members").alias(key)).join(known.select(owner, key).distinct(), [owner, key]).groupBy(ref).agg(F.count("*").alias("hits"))
    state = F.when(F.col("members").isNull(), "malformed").when(F.col("hits") == F.size("members"), "resolved").when(F.col("hits") > 0, "partial").otherwise("nonexistent")
    return m.join(hit, ref, "left").select(ref, F.array_join("members", ",").alias("members"), state.alias("state"))


def page_ranges(starts: DataFrame, owner: str, name: str, page: str, last: DataFrame, last_page: str) -> DataFrame:
    """(owner, name, first_page, last_page): inclusive ranges of outline entries, each up to the page before the next start.

    An entry that starts on the page of the next one keeps that single page.
    """
    w = Window.partitionBy(owner).orderBy(page, name)
    d = starts.select(owner, name, page).withColumn("_n", F.lead(page).over(w)).join(last.select(owner, last_page), owner)
    return d.select(owner, name, F.col(page).alias("first_page"), F.greatest(F.col(page), F.coalesce(F.col("_n") - 1, F.col(last_page))).alias("last_page"))


def agreement(left: DataFrame, right: DataFrame, on: list[str], at: str) -> DataFrame:
    """(agreement, n): keys of two inventories by where they agree: exact, near (one off), far, left_only, right_only."""
    j = left.select(*on, F.col(at).alias("l")).join(right.select(*on, F.col(at).alias("r"), F.lit(1).alias("there")), on, "full")
    kind = F.when(F.col("there").isNull(), "left_only").when(F.col("l").isNull(), "right_only").when(F.col("l") == F.col("r"), "exact").when(F.abs(F.col("l") - F.col("r")) == 1, "near").otherwise("far")
    return j.groupBy(kind.alias("agreement")).agg(F.count("*").alias("n"))


def final_stage(df: DataFrame, chain: str, stage: Column, signature: Column) -> DataFrame:
    """(chain, stage, records, state): the records of the highest stage; agreed if they all say the same, else conflicting."""
    d = df.select(chain, stage.alias("stage"), signature.alias("s"))
    top = d.withColumn("_m", F.max("stage").over(Window.partitionBy(chain))).where("stage = _m")
    g = top.groupBy(chain, "stage").agg(F.count("*").alias("records"), F.min("s").alias("a"), F.max("s").alias("b"))
    return g.select(chain, "stage", "records", F.when(F.col("a") == F.col("b"), "agreed").otherwise("conflicting").alias("state"))


def lineage_findings(df: DataFrame, chain: str, sequence: str, kind: str, first: str, final: list[str]) -> DataFrame:
    """(chain, finding): duplicate-sequence, no-first, several-first, first-not-at-start, several-final."""
    g = df.groupBy(chain).agg(F.count("*").alias("n"), F.countDistinct(sequence).alias("d"), F.count_if(F.col(kind) == first).alias("f"), F.min_by(kind, sequence).alias("head"), F.count_if(F.col(kind).isin(*final)).alias("e"))
    tests = [("duplicate-sequence", F.col("d") < F.col("n")), ("no-first", F.col("f") == 0), ("several-first", F.col("f") > 1), ("first-not-at-start", (F.col("f") > 0) & (F.col("head") != first)), ("several-final", F.col("e") > 1)]
    return g.select(chain, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests]))).alias("finding"))


def shared_targets(df: DataFrame, target: str, owner: str) -> DataFrame:
    """(target, owners, state): unique where one owner claims a target, shared otherwise."""
    g = df.where(F.col(target).isNotNull() & F.col(owner).isNotNull()).groupBy(target).agg(F.countDistinct(owner).alias("owners"))
    return g.select(target, "owners", F.when(F.col("owners") == 1, "unique").otherwise("shared").alias("state"))


def families(df: DataFrame, family: str, *sets: str) -> DataFrame:
    """One row a family with the sorted distinct values of each column, comma-joined."""
    return df.groupBy(family).agg(*[F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ",").alias(c) for c in sets])


def operation(df: DataFrame, ident: str, owner: str, key: str, known: DataFrame) -> DataFrame:
    """(ident, operation): replace where the locator is known, add where one of its ancestors is, else unresolved."""
    parts = F.split(key, r"\.")
    d = df.select(ident, owner, key, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))).alias("up"))
    hit = d.join(known.select(owner, F.col(key).alias("up")).distinct(), [owner, "up"]).groupBy(ident).agg(F.max(F.col("up") == F.col(key)).alias("own"))
    return df.select(ident).join(hit, ident, "left").select(ident, F.when(F.col("own"), "replace").when(F.col("own").isNotNull(), "add").otherwise("unresolved").alias("operation"))


def fingerprints(df: DataFrame, part: list[str], corners: list[str]) -> DataFrame:
    """(part, members, fingerprint): digest of a group's boxes in sorted order, so their input order doesn't matter."""
    box = F.format_string(",".join(["%.3f"] * len(corners)), *[F.col(c) for c in corners])
    return df.groupBy(*part).agg(F.count("*").alias("members"), F.array_join(F.array_sort(F.collect_list(box)), ";").alias("b")).select(*part, "members", text_sha256(F.col("b")).alias("fingerprint"))


def far_from(regions: DataFrame, captions: DataFrame, ident: str, page: str, y: str, reach: float) -> DataFrame:
    """Regions with no caption on their page within ``reach``; heights are cut into cells of the reach, so the band join is an equi-join."""
    cell = lambda c: F.floor(c / F.lit(reach))
    r = regions.withColumn("_c", F.explode(F.array(*[cell(F.col(y)) + i for i in (-1, 0, 1)])))
    c = captions.select(F.col(page).alias("_p"), F.col(y).alias("_y"), cell(F.col(y)).alias("_k"))
    near = r.join(c, (F.col(page) == F.col("_p")) & (F.col("_c") == F.col("_k"))).where(F.abs(F.col(y) - F.col("_y")) <= reach).select(ident).distinct()
    return regions.join(near, ident, "left_anti")


def view_boxes(df: DataFrame, ident: str, width: str, height: str, fine: bool = False) -> DataFrame:
    """(ident, view, x0, y0, x1, y1): the whole, five views of 72 % of each side, and with ``fine`` five of 50 %; halves round to even."""
    views = [("global", 1.0, 0.0, 0.0)]
    for share, name in ((0.72, "medium"), *(((0.5, "fine"),) if fine else ())):
        views += [(f"{name}_{n}", share, ax, ay) for ax, ay, n in ((0.0, 0.0, "ul"), (1.0, 0.0, "ur"), (0.0, 1.0, "ll"), (1.0, 1.0, "lr"), (0.5, 0.5, "center"))]
    v = F.explode(F.array(*[F.struct(F.lit(n).alias("view"), F.lit(s).alias("s"), F.lit(x).alias("ax"), F.lit(y).alias("ay")) for n, s, x, y in views]))
    d = df.select(ident, F.col(width).alias("w"), F.col(height).alias("h"), v.alias("v")).select(ident, "w", "h", "v.*")
    d = d.withColumn("cw", F.greatest(F.lit(1), F.bround(F.col("w") * F.col("s")).cast("int"))).withColumn("ch", F.greatest(F.lit(1), F.bround(F.col("h") * F.col("s")).cast("int")))
    d = d.withColumn("x0", F.bround((F.col("w") - F.col("cw")) * F.col("ax")).cast("int")).withColumn("y0", F.bround((F.col("h") - F.col("ch")) * F.col("ay")).cast("int"))
    return d.select(ident, "view", "x0", "y0", (F.col("x0") + F.col("cw")).alias("x1"), (F.col("y0") + F.col("ch")).alias("y1"))


def glyph_line(glyphs: Column, gap: float = 1.5) -> Column:
    """Text of an array of (x0, x1, c) glyphs in x order, a blank where the next begins more than ``gap`` after the last."""
    ordered = F.array_sort(glyphs)
    state = F.aggregate(ordered, F.struct(F.lit("").alias("t"), F.lit(None).cast("double").alias("x")), lambda s, g: F.struct(F.concat(s.t, F.when(g.x0 - s.x > gap, " ").otherwise(""), g.c).alias("t"), g.x1.cast("double").alias("x")))
    return state.t


def context_text(label: Column, title: Column, context: Column, words: int = 60) -> Column:
    """Label, title and context as one text of at most ``words`` words."""
    return F.array_join(F.slice(F.split(F.trim(F.concat_ws(" ", label, title, context)), r"\s+"), 1, words), " ")
