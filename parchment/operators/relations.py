"""Inventories and their joins: references, captions, sessions, fills, coverage, intervals, changes, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.locators import natural_key


# references -----------------------------------------------------------------


def resolve(references: DataFrame, targets: DataFrame) -> DataFrame:
    """References (ref_id, owner, key, kind) with ``state``: resolved, nonexistent, ambiguous or unresolved.

    ``targets`` has owner and key, a row for each place that bears the key. No place is
    nonexistent, several are ambiguous; a reference without a key or owner is unresolved.
    """
    places = targets.groupBy("owner", "key").agg(F.count("*").alias("places"))
    state = F.when(F.col("key").isNull() | F.col("owner").isNull(), "unresolved").when(F.col("places").isNull(), "nonexistent").when(F.col("places") > 1, "ambiguous").otherwise("resolved")
    return references.join(places, ["owner", "key"], "left").withColumn("state", state).drop("places")


def reconcile(resolved: DataFrame, known: DataFrame) -> DataFrame:
    """``resolved`` with ``final_state`` and ``reason``.

    A nonexistent key may still be a heading over known ones: the keys below it begin with
    it and a dot. All headings of the known keys are listed once, so this is an equi-join and
    no prefix comparison.
    """
    parts = F.split("key", r"\.")
    heads = known.select("owner", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))).alias("key")).distinct().withColumn("is_head", F.lit(True))
    j = resolved.join(heads, ["owner", "key"], "left")
    heading = (F.col("state") == "nonexistent") & F.coalesce("is_head", F.lit(False))
    reason = F.when(heading, "section_heading_prefix").when(F.col("state") == "nonexistent", "target_not_in_inventory").when(F.col("state") == "ambiguous", "preserved_contextual_ambiguity").when(F.col("state") == "resolved", "preserved_resolved_target").otherwise("section_target_not_indexed")
    return j.withColumn("final_state", F.when(heading, "resolved").otherwise(F.col("state"))).withColumn("reason", reason).drop("is_head")


def in_degree(edges: DataFrame, k: int) -> DataFrame:
    """(target, references, rank): the ``k`` most referred-to targets; ties by target."""
    counts = edges.groupBy("target").agg(F.count("*").alias("references"))
    top = counts.orderBy(F.desc("references"), "target").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("references"), "target")))  # k rows


def two_cycles(edges: DataFrame) -> DataFrame:
    """(a, b) of nodes that refer to each other, each pair once."""
    e = edges.select("source", "target").where("source <> target").distinct()
    both = e.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"))
    return both.groupBy("a", "b").agg(F.count("*").alias("n")).where("n = 2").select("a", "b")


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys of one side only, both ways."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def alias_index(families: DataFrame) -> DataFrame:
    """(agency, alias, family, state): aliases exploded; one that names several families is ambiguous and names none."""
    x = families.select("agency", F.explode("aliases").alias("alias"), "family").distinct()
    g = x.groupBy("agency", "alias").agg(F.count("*").alias("n"), F.min("family").alias("family"))
    return g.select("agency", "alias", F.when(F.col("n") == 1, F.col("family")).alias("family"), F.when(F.col("n") == 1, "unique").otherwise("ambiguous").alias("state"))


def match_candidates(rows: DataFrame, key: str, candidates: list[Column], agency: Column, index: DataFrame) -> DataFrame:
    """(key, family, ordinal, reason): the first of the candidate spellings that the index knows uniquely."""
    c = rows.select(key, agency.alias("agency"), F.posexplode(F.array(*candidates)).alias("ordinal", "alias"))
    j = c.join(index, ["agency", "alias"], "left")
    best = j.groupBy(key).agg(F.min_by("family", F.when(F.col("state") == "unique", F.col("ordinal"))).alias("family"), F.min(F.when(F.col("state") == "unique", F.col("ordinal"))).alias("ordinal"), F.max(F.col("state") == "ambiguous").alias("amb"))
    reason = F.when(F.col("ordinal") == 0, "exact_alias").when(F.col("ordinal").isNotNull(), "derived_alias").when(F.col("amb"), "ambiguous_alias").otherwise("unknown_alias")
    return best.select(key, F.when(F.col("ordinal").isNotNull(), F.col("family")).alias("family"), "ordinal", reason.alias("reason"))


# windows --------------------------------------------------------------------


def _over_cells(df: DataFrame, part: list[str], cell: Column, carried: Column, merge: Column) -> DataFrame:
    """``df`` with ``_cell`` and ``_before``: what the cells before a row's own carry over.

    A cell is a stretch of the order, so a part that holds a third of all rows is sorted in
    many tasks; only one summary row a cell is sorted by part. ``carried`` aggregates a cell
    to ``_c``; ``merge`` is a window aggregate over ``_c``.
    """
    d = df.withColumn("_cell", cell)
    sums = d.groupBy(*part, "_cell").agg(carried.alias("_c"))
    before = sums.withColumn("_before", merge.over(Window.partitionBy(*part).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)))
    keys = [*part, "_cell"]
    on = None
    for k in keys:
        t = F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
        on = t if on is None else on & t
    return d.alias("l").join(before.alias("r"), on, "left").select("l.*", "r._before")


def carry_forward(df: DataFrame, part: list[str], order: list[str], value: Column, name: str, cell: Column) -> DataFrame:
    """``df`` with the latest non-null ``value`` up to each row. ``cell`` must not fall along ``order``."""
    d = df.withColumn("_v", value)
    last = F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order)))
    d = _over_cells(d, part, cell, last, F.last("_c", ignorenulls=True))
    w = Window.partitionBy(*part, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn(name, F.coalesce(F.last("_v", ignorenulls=True).over(w), "_before")).drop("_v", "_cell", "_before")


def running_count(df: DataFrame, part: list[str], order: list[str], flag: Column, name: str, cell: Column) -> DataFrame:
    """``df`` with how many rows up to each one bear ``flag``."""
    d = df.withColumn("_v", F.when(flag, 1).otherwise(0))
    d = _over_cells(d, part, cell, F.sum("_v"), F.sum("_c"))
    w = Window.partitionBy(*part, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn(name, F.sum("_v").over(w) + F.coalesce("_before", F.lit(0))).drop("_v", "_cell", "_before")


def gap_sessions(df: DataFrame, part: list[str], at: str, gap: Column, tie: str, cell: Column) -> DataFrame:
    """``df`` with ``session``: a new one where the step from the row before exceeds ``gap`` (a Column over ``_step``)."""
    d = _over_cells(df.withColumn("_t", F.col(at).cast("double")), part, cell, F.max("_t"), F.max("_c"))
    w = Window.partitionBy(*part, "_cell").orderBy(at, tie)
    d = d.withColumn("_step", F.col("_t") - F.coalesce(F.lag("_t").over(w), "_before")).withColumn("_new", F.col("_step").isNull() | gap).drop("_t", "_cell", "_before")
    return running_count(d, part, [at, tie], F.col("_new"), "session", cell).drop("_step", "_new")


def as_of(left: DataFrame, right: DataFrame, on: list[str], at: str, value: str, cell: Column) -> DataFrame:
    """``left`` with the ``value`` of the latest right row not after it, by union and a carried value instead of a range join."""
    cols = left.columns
    a = left.select(*cols, F.lit(None).cast(right.schema[value].dataType).alias(f"_{value}"), F.lit(1).alias("_side"))
    b = right.select(*[F.col(c) if c in [*on, at] else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols], F.col(value).alias(f"_{value}"), F.lit(0).alias("_side"))
    return carry_forward(a.unionByName(b), on, [at, "_side"], F.col(f"_{value}"), value, cell).where("_side = 1").select(*cols, value)


def bounded_children(df: DataFrame, part: list[str], at: str, is_parent: Column, is_child: Column, reach: float, tie: str) -> DataFrame:
    """(child, parent): each child of the nearest parent before it, within ``reach``, none past the next parent."""
    w = Window.partitionBy(*part).orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("_p", F.last(F.when(is_parent, F.struct(F.col(tie).alias("k"), F.col(at).cast("double").alias("at"))), ignorenulls=True).over(w))
    return d.where(is_child & (F.col(at).cast("double") - F.col("_p.at") <= reach)).select(F.col(tie).alias("child"), F.col("_p.k").alias("parent"))


def runs(df: DataFrame, part: str, at: str) -> DataFrame:
    """(part, first, last, length): maximal runs of consecutive whole numbers."""
    d = df.where(F.col(at).isNotNull()).select(part, at).distinct()
    d = d.withColumn("_g", F.col(at) - F.row_number().over(Window.partitionBy(part).orderBy(at)))
    return d.groupBy(part, "_g").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("length")).drop("_g")


def occurrence_patterns(df: DataFrame, part: str, key: str, at: str) -> DataFrame:
    """(part, key, occurrences, pages, pattern): single, same_page, adjacent or discontiguous."""
    g = df.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(part, key).agg(F.count("*").alias("occurrences"), F.countDistinct(at).alias("pages"), F.min(at).alias("a"), F.max(at).alias("b"))
    pattern = F.when(F.col("occurrences") == 1, "single").when(F.col("pages") == 1, "same_page").when(F.col("b") - F.col("a") + 1 == F.col("pages"), "adjacent").otherwise("discontiguous")
    return g.select(part, key, "occurrences", "pages", pattern.alias("pattern"))


def continuations(df: DataFrame, key: list[str], page: str, ident: str, explicit: Column) -> DataFrame:
    """(ident, previous, kind): primary, continuation of the one before, unresolved repetition, or orphan continuation."""
    w = Window.partitionBy(*key).orderBy(page, ident)
    d = df.withColumn("previous", F.lag(ident).over(w))
    kind = F.when(explicit & F.col("previous").isNotNull(), "continuation").when(explicit, "orphan").when(F.col("previous").isNotNull(), "unresolved").otherwise("primary")
    return d.select(ident, F.when(explicit, F.col("previous")).alias("previous"), kind.alias("kind"))


def top_per_group(df: DataFrame, part: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).where(F.col("rank") <= k)


def section_index(df: DataFrame, owner: str, key: str, ref: str) -> DataFrame:
    """(owner, key, sort_key, ref): each address's references, one a row, with the address's natural order.

    Rows instead of lists: an address that a third of all references name isn't gathered anywhere.
    """
    return df.select(owner, key, ref).distinct().withColumn("sort_key", natural_key(F.col(key)))


# bands and intervals --------------------------------------------------------


def overlap_join(sections: DataFrame, fragments: DataFrame, on: str, width: int) -> DataFrame:
    """Pairs of half-open ranges that overlap: sections (on, section_id, start, end) with fragments (on, fragment_id, start, end).

    Both sides are cut into cells of ``width``, joined by cell, and a pair counts in the first
    cell they share, so no pair is compared over the whole of an owner.
    """
    cell = lambda df: df.where("start < end").withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    s, f = cell(sections).alias("s"), cell(fragments).alias("f")
    j = s.join(f, (F.col(f"s.{on}") == F.col(f"f.{on}")) & (F.col("s.cell") == F.col("f.cell")))
    hit = (F.col("s.start") < F.col("f.end")) & (F.col("f.start") < F.col("s.end")) & (F.floor(F.greatest("s.start", "f.start") / width) == F.col("s.cell"))
    return j.where(hit).select(F.col(f"s.{on}").alias(on), "s.section_id", "f.fragment_id", F.greatest("s.start", "f.start").alias("start"), F.least("s.end", "f.end").alias("end"))


def overlaps_within(df: DataFrame, on: str, ident: str, start: str, end: str, width: int) -> DataFrame:
    """(on, a, b): overlapping half-open intervals (whole numbers) of one key, each pair once; a null end is open.

    Intervals are cut into cells of ``width`` and compared within a cell only; an open one
    ends after the key's last start. The pairs are the result.
    """
    last = df.groupBy(on).agg((F.max(start) + 1).alias("_last"))
    x = df.join(last, on).select(on, F.col(ident).alias("section_id"), F.col(start).alias("start"), F.coalesce(F.col(end), F.greatest("_last", F.col(start) + 1)).alias("end"))
    j = overlap_join(x, x.withColumnRenamed("section_id", "fragment_id"), on, width)
    return j.where("section_id < fragment_id").select(on, F.col("section_id").alias("a"), F.col("fragment_id").alias("b"))


def active_at(df: DataFrame, start: str, end: str, at: Column) -> DataFrame:
    """Rows whose half-open interval holds ``at``; a null end is open."""
    return df.where((F.col(start) <= at) & (F.col(end).isNull() | (at < F.col(end))))


def own_ranges(df: DataFrame, owner: str, key: str, parent: str, start: str, end: str) -> DataFrame:
    """(owner, key, own_start, own_end): what is left of each range once its children's are cut out.

    Children are ordered by start; the gaps before, between and after them are the parent's own.
    """
    kids = df.where(f"{start} < {end}").select(F.col(owner), F.col(parent).alias(key), F.col(start).alias("s"), F.col(end).alias("e"), F.lit(1).alias("kid"))
    base = df.where(f"{start} < {end}").select(owner, key, F.col(start).alias("ps"), F.col(end).alias("pe"))
    j = kids.join(base, [owner, key]).where("s < pe and e > ps").select(owner, key, "ps", "pe", F.greatest("s", "ps").alias("s"), F.least("e", "pe").alias("e"))
    # sentinels at both ends make every gap one between neighbours
    ends = base.select(owner, key, "ps", "pe", F.col("ps").alias("s"), F.col("ps").alias("e")).unionByName(base.select(owner, key, "ps", "pe", F.col("pe").alias("s"), F.col("pe").alias("e")))
    w = Window.partitionBy(owner, key).orderBy("s", "e")
    d = j.unionByName(ends).withColumn("own_start", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return d.where("own_start < s").select(owner, key, "own_start", F.col("s").alias("own_end"))


def structural_ranges(df: DataFrame, owner: str, key: str, depth: str, start: str, total: str) -> DataFrame:
    """(owner, key, range_start, range_end): a node ends where the next node that isn't below it begins, else at ``total``.

    In document order a node is closed by the next one of no greater depth: the nearest of the
    next ones of each depth up to its own. These are running minima over cells of the order,
    so an owner with a third of all rows is sorted in many tasks.
    """
    d = df.select(owner, key, depth, start, total).withColumn("_lvl", F.explode(F.sequence(F.lit(0), F.greatest(F.col(depth), F.lit(0)))))
    point = F.when(F.col(depth) == F.col("_lvl"), F.struct(F.col(start).alias("s"), F.col(key).alias("k")))
    part = [owner, "_lvl"]
    # cells run backwards, so those "before" a row's own follow it in the document
    d = _over_cells(d.withColumn("_p", point), part, -F.floor(F.col(start) / 20_000), F.min("_p"), F.min("_c"))
    w = Window.partitionBy(*part, "_cell").orderBy(start, key).rowsBetween(1, Window.unboundedFollowing)
    d = d.withColumn("_s", F.coalesce(F.min("_p").over(w), F.col("_before")).s)
    return d.groupBy(owner, key, depth, start, total).agg(F.min("_s").alias("_s")).select(owner, key, F.col(start).alias("range_start"), F.coalesce("_s", F.col(total)).alias("range_end"))


# changes and audits ---------------------------------------------------------


def controlling(df: DataFrame, part: str, priority: Column, sequence: str, value: str) -> DataFrame:
    """(part, value): the record of the highest priority, then sequence."""
    return df.groupBy(part).agg(F.max_by(value, F.struct(priority, F.col(sequence))).alias(value))


def reconcile_changes(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Expected (change_id, targets, kind) against observed (change_id, targets, kind) by shared targets.

    (change_id, outcome): confirmed, contradicted (only other kinds seen), ambiguous (several
    of its kind), expected_not_observed; observed changes that share no target come out as
    unexpected_observed. The least and the greatest observed change per target and kind tell
    none, one and several apart, so no pair is listed and one met at two targets counts once.
    """
    e = expected.select(F.col("change_id").alias("e"), F.col("kind").alias("k"), F.explode("targets").alias("t")).where("t is not null")
    o = observed.select(F.col("change_id").alias("o"), F.col("kind").alias("k"), F.explode("targets").alias("t")).where("t is not null")
    kinds = o.groupBy("t", "k").agg(F.min("o").alias("lo"), F.max("o").alias("hi"))
    same = e.join(kinds, ["t", "k"]).groupBy("e").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    met = e.join(o.select("t").distinct(), "t", "left_semi").select("e").distinct().withColumn("met", F.lit(True))
    out = expected.select(F.col("change_id").alias("e")).join(met, "e", "left").join(same, "e", "left")
    outcome = F.when(F.col("met").isNull(), "expected_not_observed").when(F.col("lo") == F.col("hi"), "confirmed").when(F.col("lo") < F.col("hi"), "ambiguous").otherwise("contradicted")
    extra = observed.select(F.col("change_id").alias("o")).join(o.join(e.select("t").distinct(), "t", "left_semi").select("o").distinct(), "o", "left_anti")
    return out.select(F.col("e").alias("change_id"), outcome.alias("outcome")).unionByName(extra.select(F.col("o").alias("change_id"), F.lit("unexpected_observed").alias("outcome")))


def ownership(captions: DataFrame, candidates: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """(candidate_id, caption_id, state): which caption a table region belongs to.

    captions: caption_id, page, x0, y0, y1; candidates: candidate_id, page, x0, y0, y1, ruled.
    Captions of the page whose left edge agrees within ``tolerance`` match. One match owns;
    of several, a ruled candidate goes to the only one that it overlaps (several: ambiguous);
    otherwise to the latest caption above (a tie: ambiguous). No match or none above:
    unresolved. Edges are cut into cells of the tolerance, so the band join is an equi-join.
    """
    cell = lambda c: F.floor(c / F.lit(tolerance))
    cap = captions.select("caption_id", F.col("page").alias("cp"), F.col("x0").alias("cx"), F.col("y0").alias("cy0"), F.col("y1").alias("cy1"), cell(F.col("x0")).alias("cell"))
    can = candidates.withColumn("cell", F.explode(F.array(*[cell(F.col("x0")) + i for i in (-1, 0, 1)])))
    m = can.join(cap, (F.col("page") == F.col("cp")) & (can["cell"] == cap["cell"])).where(F.abs(F.col("cx") - F.col("x0")) <= tolerance)
    over = (F.col("cy0") < F.col("y1") + tolerance) & (F.col("y0") < F.col("cy1") + tolerance)
    above = F.col("cy1") <= F.col("y0") + tolerance
    g = m.groupBy("candidate_id").agg(
        F.count("*").alias("n"), F.min("caption_id").alias("only"), F.max("ruled").alias("ruled"), F.count_if(over).alias("n_over"), F.min(F.when(over, F.col("caption_id"))).alias("over"), F.max(F.when(above, F.col("cy1"))).alias("top"), F.max_by("caption_id", F.when(above, F.col("cy1"))).alias("last"), F.collect_list(F.when(above, F.col("cy1"))).alias("ys")
    )
    tied = F.size(F.filter("ys", lambda y: y == F.col("top"))) > 1
    by_rule = F.col("ruled") & (F.col("n_over") > 0)
    state = F.when(F.col("n") == 1, "owned").when(by_rule & (F.col("n_over") == 1), "owned").when(by_rule, "ambiguous").when(F.col("top").isNull(), "unresolved").when(tied, "ambiguous").otherwise("owned")
    owner = F.when(F.col("n") == 1, F.col("only")).when(by_rule & (F.col("n_over") == 1), F.col("over")).when(by_rule, None).when(F.col("top").isNotNull() & ~tied, F.col("last"))
    return candidates.select("candidate_id").join(g.select("candidate_id", owner.alias("caption_id"), state.alias("state")), "candidate_id", "left").select("candidate_id", "caption_id", F.coalesce("state", F.lit("unresolved")).alias("state"))
