"""Document structure from positions and text: page order, visual lines, typed blocks, captions, spans of meaning, findings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .provisions import MODALS, any_of

#: Words that tell what a passage does.
MEANINGS = {
    "condition": ("where", "when", "if", "unless", "provided that", "exceeding", "greater than", "less than", "at least", "not less than"),
    "alternative": ("either", "one of", "any of", "in lieu of", "alternatively"),
    "applicability": ("apply to", "applies to", "applicable to", "for use with"),
    "calculation": ("calculate", "calculated", "calculates", "calculating", "calculation", "equation", "formula", "interpolation"),
    "exception": ("except", "exception"),
}
#: Modal words beyond those of the requirement grammar.
FURTHER_MODALS = {"should": "recommendation", "is required to": "requirement", "are required to": "requirement", "is permitted to": "permission", "are permitted to": "permission"}


def _found(text: Column, pattern: str, kind: Column | None = None) -> Column:
    """Every hit of ``pattern`` as (hit, start), 0-based code points, from the lengths of the pieces between hits."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    length = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda s, x: s + F.length(x))
    return F.transform(hits, lambda h, i: F.struct(h.alias("hit"), (length(gaps, i + 1) + length(hits, i)).alias("start")))


def meaning_spans(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, type, start, end): spans of words that state a requirement, permission, prohibition or recommendation, a condition, alternative, applicability, calculation or exception.

    Of exceptions the first in a text counts. The same span and type come once. Null and empty texts have none.
    """
    rows = df.where(F.col(text).isNotNull() & (F.col(text) != "")).select(key, F.col(text).alias("_t"))
    modal = MODALS | FURTHER_MODALS
    words = F.regexp_replace(F.lower(F.col("hit")), r"\s+", " ")
    parts = [rows.select(key, F.inline(_found(F.col("_t"), any_of(modal)))).withColumn("type", F.coalesce(*[F.when(words == w, t) for w, t in modal.items()]))]
    for kind, phrases in MEANINGS.items():
        found = _found(F.col("_t"), any_of(phrases))
        parts.append(rows.select(key, F.inline(F.slice(found, 1, 1) if kind == "exception" else found)).withColumn("type", F.lit(kind)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(key, "type", "start", (F.col("start") + F.length("hit")).alias("end")).distinct()


def inferred_order(lines: DataFrame, width: float = 612.0) -> DataFrame:
    """(source_id, pdf_page, mode, split_x, confidence, left_lines, right_lines): how each page is read.

    Only lines that don't cross the page's middle count. Two columns need two lines on each
    side that overlap in height, anchors left and right of the middle, and columns wide
    enough; the split lies between the columns' inner edges. Anything else reads top down.
    """
    mid = width / 2
    full = (F.col("x1") - F.col("x0") >= width * 0.65) | ((F.col("x0") <= mid - width * 0.1) & (F.col("x1") >= mid + width * 0.1))
    seen = lines.where("pdf_page is not null and trim(text) <> '' and x1 > x0").withColumn("_side", F.when(full, "full").when((F.col("x0") + F.col("x1")) / 2 < mid, "left").otherwise("right"))
    on = lambda side, c: F.when(F.col("_side") == side, c)
    span = F.col("x1") - F.col("x0")
    aggs = [F.percentile(F.when(F.col("_side") != "full", F.greatest(F.lit(0.1), F.col("y1") - F.col("y0"))), F.lit(0.5)).alias("height")]
    for s in ("left", "right"):
        aggs += [
            F.count(on(s, F.lit(1))).alias(f"{s}_lines"), F.min(on(s, F.col("y0"))).alias(f"{s}_top"), F.max(on(s, F.col("y1"))).alias(f"{s}_foot"), F.percentile(on(s, F.col("x0")), F.lit(0.5)).alias(f"{s}_at"),
            F.when(F.count(on(s, F.lit(1))) >= 4, F.percentile(on(s, span), F.lit(0.75))).otherwise(F.max(on(s, span))).alias(f"{s}_width"), F.sort_array(F.collect_list(on(s, F.col("x1" if s == "left" else "x0")))).alias(f"{s}_edges"),
        ]
    g = seen.groupBy("source_id", "pdf_page").agg(*aggs)
    n, m = F.col("left_lines"), F.col("right_lines")
    overlap = F.least("left_foot", "right_foot") - F.greatest("left_top", "right_top")
    two = (n >= 2) & (m >= 2) & (overlap >= F.col("height")) & (F.col("left_at") < width * 0.45) & (F.col("right_at") > width * 0.48) & (F.least("left_width", "right_width") >= width * 0.12)
    a = F.get("left_edges", F.least(n - 1, F.floor(n * F.lit(0.9))).cast("int"))
    b = F.get("right_edges", F.greatest(F.lit(0), F.floor(m * F.lit(0.1))).cast("int"))
    split = F.least(F.lit(width * 0.55), F.greatest(F.lit(width * 0.45), F.when(a < b, (a + b) / 2).otherwise(mid)))
    sure = F.least(F.lit(0.95), 0.62 + F.greatest(F.lit(0.0), F.col("right_at") - F.col("left_at")) / width * 0.35 + F.least(n, m) / F.greatest(n, m) * 0.12)
    two = F.coalesce(two, F.lit(False))
    return g.select("source_id", "pdf_page", F.when(two, "two_column").otherwise("top_to_bottom").alias("mode"), F.when(two, F.round(split, 3)).alias("split_x"), F.when(two, F.round(sure, 3)).otherwise(0.5).alias("confidence"), "left_lines", "right_lines")


def ordered_lines(lines: DataFrame, order: DataFrame, ident: str, width: float = 612.0) -> DataFrame:
    """(ident, source_id, pdf_page, reading_no): lines by their page's order; full-width lines part the page into bands, in a band the left column comes first. A page is one group."""
    mid = width / 2
    full = (F.col("x1") - F.col("x0") >= width * 0.65) | ((F.col("x0") <= mid - width * 0.1) & (F.col("x1") >= mid + width * 0.1))
    d = lines.where("pdf_page is not null and x0 is not null").join(order.select("source_id", "pdf_page", "split_x"), ["source_id", "pdf_page"], "left")
    column = F.when(F.col("split_x").isNull(), 0).when(full, 0).when((F.col("x0") + F.col("x1")) / 2 < F.col("split_x"), 1).otherwise(2)
    page = Window.partitionBy("source_id", "pdf_page")
    parts = F.when(full & F.col("split_x").isNotNull(), 1).otherwise(0)
    d = d.withColumn("_c", column).withColumn("_b", F.sum(2 * parts).over(page.orderBy("y0", "x0", ident).rowsBetween(Window.unboundedPreceding, 0)) - parts)
    return d.select(ident, "source_id", "pdf_page", F.row_number().over(page.orderBy("_b", "_c", "y0", "x0", ident)).alias("reading_no"))


def visual_lines(fragments: DataFrame, ident: str, tolerance: float = 2.5) -> DataFrame:
    """(source_id, pdf_page, line_no, fragments, text, x0, y0, x1, y1): fragments whose middles follow within ``tolerance`` of the one above, joined from left to right. A page is one group."""
    page = Window.partitionBy("source_id", "pdf_page")
    d = fragments.where("pdf_page is not null and x0 is not null").withColumn("_y", (F.col("y0") + F.col("y1")) / 2)
    down = page.orderBy("_y", ident)
    new = F.coalesce(F.col("_y") - F.lag("_y").over(down) > tolerance, F.lit(True)).cast("int")
    d = d.withColumn("_new", new).withColumn("line_no", F.sum("_new").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", F.col(ident).alias("i"), F.coalesce("text", F.lit("")).alias("t")))), lambda x: x.t), " ")
    return d.groupBy("source_id", "pdf_page", "line_no").agg(F.count("*").alias("fragments"), text.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def line_kind(text: Column) -> Column:
    """What a line opens: list_item, table, figure, note, exception, otherwise text."""
    t = F.trim(text)
    kinds = (("table", r"(?i)^table\s+[A-Za-z]?\d"), ("figure", r"(?i)^figure\s+[A-Za-z]?\d"), ("note", r"(?i)^note(\s+\d+)?\s*[:.]"), ("exception", r"(?i)^exception(\s+no\.\s*\d+|\s+\d+)?\s*[:.]"), ("list_item", r"^\([0-9a-zA-Z]{1,4}\)\s"))
    return F.coalesce(*[F.when(t.rlike(p), k) for k, p in kinds], F.lit("text"))


def direct_blocks(lines: DataFrame, ident: str, gap: float = 8.5) -> DataFrame:
    """(source_id, pdf_page, block_no, kind, lines, text, y0, y1): a page's lines as typed blocks.

    A line that opens something begins a block, and so does one further than ``gap`` below the
    line before, or text after a caption, note or exception; text close below a list item or
    a paragraph goes on in it. A page is one group.
    """
    page = Window.partitionBy("source_id", "pdf_page").orderBy("y0", ident)
    d = lines.where("pdf_page is not null and y0 is not null and trim(text) <> ''").withColumn("_k", line_kind(F.col("text")))
    before, above = F.lag("_k").over(page), F.lag("y1").over(page)
    new = before.isNull() | (F.col("_k") != "text") | ~before.isin("text", "list_item") | (F.col("y0") - above > gap)
    d = d.withColumn("_new", new.cast("int")).withColumn("block_no", F.sum("_new").over(page.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("y0", F.col(ident).alias("i"), F.trim("text").alias("t"), F.col("_k").alias("k"))))
    g = d.groupBy("source_id", "pdf_page", "block_no").agg(F.count("*").alias("lines"), parts.alias("p"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    kind = F.get("p.k", F.lit(0))
    return g.select("source_id", "pdf_page", "block_no", F.when(kind == "text", "paragraph").otherwise(kind).alias("kind"), "lines", F.array_join("p.t", " ").alias("text"), "y0", "y1")


def caption_clips(lines: DataFrame, ident: str, foot: float = 729.0) -> DataFrame:
    """(ident, source_id, pdf_page, locator, y0, y1): from each table caption down to the next line that opens something, else to ``foot``. A page is one group."""
    # thousandths of a point, as ranges of the order take whole numbers
    page = Window.partitionBy("source_id", "pdf_page").orderBy(F.round(F.col("y0") * 1000).cast("long")).rangeBetween(2001, Window.unboundedFollowing)
    d = lines.where("pdf_page is not null and y0 is not null and text is not null").withColumn("_k", line_kind(F.col("text")))
    d = d.withColumn("_next", F.min(F.when(~F.col("_k").isin("text", "list_item"), F.col("y0"))).over(page))
    cut = F.when(F.col("_next").isNull(), foot).otherwise(F.greatest(F.col("y1") + 12, F.col("_next") - 1))
    locator = F.concat(F.lit("table:"), F.regexp_extract(F.trim("text"), r"(?i)^table\s+([A-Za-z]?[0-9][0-9A-Za-z.-]*)", 1))
    return d.where("_k = 'table'").select(ident, "source_id", "pdf_page", F.regexp_replace(locator, r"[.-]+$", "").alias("locator"), F.greatest(F.lit(55.0), F.col("y0") - 1).alias("y0"), cut.cast("double").alias("y1"))


def detections(df: DataFrame, part: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``disposition``: the first of each ``part`` in ``order`` is accepted, the others merged into it. By an aggregate and a join, so a part of any size is split."""
    first = df.groupBy(*part).agg(F.min(F.struct(*order)).alias("_first"))
    same = F.struct(*[F.col(c) for c in order]) == F.col("_first")
    return df.join(first, part).withColumn("disposition", F.when(same, "accepted").otherwise("merged")).drop("_first")


def marker_roles(df: DataFrame, level: Column, titled: Column, listed: Column) -> DataFrame:
    """``df`` with ``role``, ``confidence`` and ``evidence`` of a parenthetical marker: a title makes it a subdivision, an introduced list a list item; both or neither leave it ambiguous."""
    lone = F.when(level <= 2, "title-expected-at-this-level").when(level == 3, "third-level-sibling-title-context-needed").when(level > 3, "beyond-named-subdivision-levels")
    role = F.when(titled & ~listed, "subdivision").when(listed & ~titled, "list_item").otherwise("ambiguous")
    evidence = F.when(titled & listed, "title,list-introduction,conflicting-evidence").when(titled, "title").when(listed, "list-introduction").otherwise(F.concat_ws(",", lone, F.lit("numbering-alone-is-insufficient")))
    return df.withColumn("role", role).withColumn("confidence", F.when(role == "ambiguous", "low").otherwise("high")).withColumn("evidence", evidence)


def note_identity(owner: Column, number: Column) -> Column:
    """A note's identity within its owner; null for an empty owner or a number below 1."""
    bare = F.regexp_replace(owner, r"\s+", "")
    return F.when((bare != "") & (number >= 1), F.concat(bare, F.lit("#informational-note:"), number.cast("string")))


def explains(df: DataFrame, known: DataFrame, owner: str, key: str, prefix: str) -> DataFrame:
    """(owner, source, target, resolved): an annex paragraph ``prefix`` + x explains x; resolved if the owner has x."""
    d = df.where(F.col(key).startswith(prefix)).select(owner, F.col(key).alias("source"), F.substring(F.col(key), F.lit(len(prefix) + 1), F.length(key)).alias("target")).distinct()
    have = known.select(owner, F.col(key).alias("target"), F.lit(True).alias("resolved")).distinct()
    return d.join(have, [owner, "target"], "left").select(owner, "source", "target", F.coalesce("resolved", F.lit(False)).alias("resolved"))


def section_findings(df: DataFrame) -> DataFrame:
    """(node_id, code): what is wrong with a bundle's sections, each row once however often delivered.

    empty-locator, empty-artifact, bad-text-hash, pages-reversed, bad-span,
    identity-in-several-artifacts.
    """
    one = df.select("node_id", "artifact_id", "locator", "parent_locator", "span_start", "span_end", "text_sha256", "first_page", "last_page").distinct()
    code = lambda c, n: F.when(c, F.lit(n))
    own = F.array_compact(F.array(
        code(F.coalesce(F.trim("locator"), F.lit("")) == "", "empty-locator"), code(F.coalesce(F.trim("artifact_id"), F.lit("")) == "", "empty-artifact"), code(~F.coalesce(F.col("text_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "bad-text-hash"),
        code(F.col("first_page") > F.col("last_page"), "pages-reversed"), code(F.coalesce((F.col("span_start") < 0) | (F.col("span_end") < F.col("span_start")), F.lit(True)), "bad-span"),
    ))
    found = one.select("node_id", F.explode(own).alias("code"))
    several = one.groupBy("node_id").agg(F.min("artifact_id").alias("a"), F.max("artifact_id").alias("b")).where("a <> b").select("node_id", F.lit("identity-in-several-artifacts").alias("code"))
    return found.unionByName(several).distinct()


def sibling_overlaps(df: DataFrame, part: list[str], ident: str, start: str, end: str) -> DataFrame:
    """(ident, code): rows that begin before an earlier one of their part ends (with siblings as a part, overlaps; with all of a bundle, nested rows too), by the running maximum of ends over cells of the order."""
    from .relations import _over_cells

    d = df.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    d = _over_cells(d, part, F.floor(F.col(start) / 20_000), F.max(end), F.max("_c"))
    w = Window.partitionBy(*part, "_cell").orderBy(start, ident).rowsBetween(Window.unboundedPreceding, -1)
    return d.withColumn("_most", F.greatest(F.max(end).over(w), F.col("_before"))).where(F.col(start) < F.col("_most")).select(ident, F.lit("begins-inside-another").alias("code")).distinct()


def page_findings(pages: DataFrame, profiles: DataFrame) -> DataFrame:
    """(source_id, pdf_page, code): pages without a profile, profiles without a page, several profiles of one page, and gaps in the page numbers from 1."""
    p = pages.where("pdf_page is not null").select("source_id", "pdf_page").distinct()
    f = profiles.groupBy("source_id", "pdf_page").agg(F.count("*").alias("n"))
    j = p.withColumn("there", F.lit(True)).join(f, ["source_id", "pdf_page"], "full")
    codes = F.array_compact(F.array(F.when(F.col("n").isNull(), "no-profile"), F.when(F.col("there").isNull(), "no-page"), F.when(F.col("n") > 1, "several-profiles")))
    found = j.select("source_id", "pdf_page", F.explode(codes).alias("code"))
    every = p.groupBy("source_id").agg(F.max("pdf_page").alias("m")).where("m >= 1").select("source_id", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("pdf_page"))
    return found.unionByName(every.join(p, ["source_id", "pdf_page"], "left_anti").withColumn("code", F.lit("page-left-out")))


def reference_diagnostics(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """(code, severity, locator, target, start, end): references with evidence that found no target, and nodes whose kind isn't interpreted.

    ``relations``: source_key, target_key, resolved, start, end; ``nodes``: kind, key, start, end.
    """
    open_ = relations.where("not coalesce(resolved, false) and start is not null").select(F.lit("unresolved-reference").alias("code"), F.lit("warning").alias("severity"), F.col("source_key").alias("locator"), F.col("target_key").alias("target"), "start", "end")
    plain = nodes.where("kind in ('figure', 'table_heading')").select(F.when(F.col("kind") == "figure", "unsupported-figure-interpretation").otherwise("unsupported-table-layout").alias("code"), F.lit("info").alias("severity"), F.col("key").alias("locator"), F.lit(None).cast("string").alias("target"), "start", "end")
    return open_.unionByName(plain).distinct()


def anchors(df: DataFrame, source: str, page: str, text: str = "text") -> DataFrame:
    """(source, page, kind, identifier): lines that name a chapter or an appendix, whatever their case and blanks, once a page."""
    line = F.upper(F.trim(F.regexp_replace(F.col("_l"), r"\s+", " ")))
    d = df.where(F.col(text).isNotNull() & F.col(page).isNotNull()).select(source, page, F.explode(F.split(F.col(text), r"\r\n|[\r\n]")).alias("_l")).select(source, page, line.alias("_l"))
    got = F.regexp_extract("_l", r"^(CHAPTER|APPENDIX) ?([0-9]{1,3}|[A-Z])(?: |$)", 1)
    return d.withColumn("kind", F.lower(got)).where("kind <> ''").select(source, page, "kind", F.regexp_extract("_l", r"^(CHAPTER|APPENDIX) ?([0-9]{1,3}|[A-Z])(?: |$)", 2).alias("identifier")).distinct()


def page_label(text: Column) -> Column:
    """A printed label's parts: style (decimal, chapter_page, letter_page, roman, other) and its last number, roman ones by their letters' values."""
    t = F.trim(text)
    style = F.when(t.rlike(r"^[0-9]+$"), "decimal").when(t.rlike(r"^[0-9]+-[0-9]+$"), "chapter_page").when(t.rlike(r"^[A-Za-z]-[0-9]+$"), "letter_page").when(t.rlike(r"(?i)^(?=.)m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"), "roman").otherwise("other")
    values = F.transform(F.split(F.lower(t), ""), lambda c: F.coalesce(*[F.when(c == k, v) for k, v in (("i", 1), ("v", 5), ("x", 10), ("l", 50), ("c", 100), ("d", 500), ("m", 1000))], F.lit(0)))
    roman = F.aggregate(F.transform(values, lambda v, i: F.when(v < F.coalesce(F.get(values, i + 1), F.lit(0)), -v).otherwise(v)), F.lit(0), lambda a, v: a + v)
    number = F.when(style == "roman", roman).when(style.isin("decimal", "chapter_page", "letter_page"), F.regexp_extract(t, "([0-9]{1,9})$", 1).try_cast("int"))
    return F.struct(style.alias("style"), number.alias("number"))


def unsafe_keys(df: DataFrame, ident: str, maps: Iterable[str], barred: Iterable[str]) -> DataFrame:
    """(ident, column, key): entries of map columns under a key that may bear source text."""
    out = None
    for m in maps:
        part = df.select(ident, F.lit(m).alias("column"), F.explode(F.map_keys(m)).alias("key")).where(F.lower("key").isin(*barred)).distinct()
        out = part if out is None else out.unionByName(part)
    return out


def definitions(nodes: DataFrame, relations: DataFrame, owner: str, key: str, term: str) -> tuple[DataFrame, DataFrame]:
    """(inventory, graph) of defined terms.

    inventory: owner, key, observed_term, normalized_term, uses, alternates: the nodes with a
    term that references name as their definition, and in how many other places of the owner
    the same term is defined. graph: source, owner, key, term: which node uses which
    definition, each once. ``relations``: source, owner, key. Terms agree in upper case with
    single blanks.
    """
    same = F.upper(F.trim(F.regexp_replace(F.col(term), r"\s+", " ")))
    n = nodes.where(F.col(term).isNotNull() & (F.trim(F.col(term)) != "")).groupBy(owner, key).agg(F.min(term).alias("observed_term"), F.min(same).alias("normalized_term"))
    links = relations.where("source is not null").select("source", owner, key).distinct()
    graph = links.join(n, [owner, key]).select("source", owner, key, F.col("normalized_term").alias("term"))
    found = n.join(graph.groupBy(owner, key).agg(F.count("*").alias("uses")), [owner, key])
    places = found.groupBy(owner, "normalized_term").agg((F.count("*") - 1).alias("alternates"))
    return found.join(places, [owner, "normalized_term"]).select(owner, key, "observed_term", "normalized_term", "uses", "alternates"), graph
