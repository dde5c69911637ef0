"""Observed lines and boxes to hierarchies, captions, drawings, gates and receipts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .relations import carry_forward

#: A rule: kind, level (0 for a leaf that hangs below the last heading), pattern with groups for number and title.
RULES = (
    ("chapter", 1, r"(?i)^chapter\s+([0-9]+)(?:\s+(.*))?$"),
    ("appendix", 1, r"(?i)^appendix\s+([A-Z])(?:\s+(.*))?$"),
    ("section", 2, r"^([0-9]+\.[0-9]+)\s+([A-Z].*)$"),
    ("subsection", 3, r"^([0-9]+(?:\.[0-9]+){2,})\s+([A-Z].*)$"),
    ("table", 0, r"(?i)^table\s+([A-Z]?[0-9]+(?:\.[0-9]+)*)(?:\s+(.*))?$"),
    ("figure", 0, r"(?i)^figure\s+([A-Z]?[0-9]+(?:\.[0-9]+)*)(?:\s+(.*))?$"),
    ("equation", 0, r"(?i)^equation\s+([0-9]+(?:\.[0-9]+)*)(?:\s+(.*))?$"),
)


def observed(lines: DataFrame, text: str = "text", rules: Sequence[tuple[str, int, str]] = RULES) -> DataFrame:
    """``lines`` that bear an observation, with ``kind``, ``level``, ``number`` and ``title``: the first rule that a line fits counts. A publication's grammar is the rules, not code."""
    t = F.trim(F.col(text))
    first = lambda value: F.coalesce(*[F.when(t.rlike(p), value(k, n, p)) for k, n, p in rules])
    d = lines.withColumn("kind", first(lambda k, n, p: F.lit(k))).where("kind is not null")
    title = first(lambda k, n, p: F.regexp_extract(t, p, 2))
    return d.withColumn("level", first(lambda k, n, p: F.lit(n))).withColumn("number", first(lambda k, n, p: F.regexp_extract(t, p, 1))).withColumn("title", F.when(title != "", title))


def observed_hierarchy(found: DataFrame, part: list[str], order: list[str], ident: str, cell: Column, levels: int = 3) -> DataFrame:
    """``found`` with ``parent``: the last heading before a row of a lower level, for a leaf the last heading of any. By carrying forward over cells of the order, once for each level."""
    d = found.withColumn("_lit", F.col(ident))
    last = [carry_forward(d, part, order, F.when(F.col("level") == n, F.struct(*[F.col(c) for c in order], F.col("_lit").alias("id"))), f"_l{n}", cell).select(ident, f"_l{n}") for n in range(1, levels + 1)]
    for x in last:
        d = d.join(x, ident)
    mine = lambda n: (F.col("level") == 0) | (F.col("level") > n)
    # the latest of the headings that may hold the row
    best = F.greatest(*[F.when(mine(n), F.col(f"_l{n}")) for n in range(1, levels + 1)])
    return d.withColumn("parent", best["id"]).drop("_lit", *[f"_l{n}" for n in range(1, levels + 1)])


def split_captions(boxes: DataFrame, ident: str, gap: float = 12.0, band: float = 20.0) -> DataFrame:
    """(ident, source_id, pdf_page, kind, number): a lone word Table or Figure and the one box to its right, near and level with it, that holds a number.

    None or several such boxes give nothing. Boxes meet by page and band of height, each
    keyword in its own and the neighbouring bands, so no page is compared whole.
    """
    d = boxes.where("pdf_page is not null and x0 is not null and text is not null").withColumn("_t", F.trim("text"))
    key = d.where(F.lower("_t").isin("table", "figure")).withColumn("_b", F.explode(F.array(*[F.floor(F.col("y0") / band) + i for i in (-1, 0, 1)])))
    other = d.where(F.col("_t").rlike(r"^[A-Za-z]?[0-9]+(\.[0-9]+)*$")).select("source_id", "pdf_page", F.floor(F.col("y0") / band).alias("_b"), F.col(ident).alias("_o"), F.col("_t").alias("number"), F.col("x0").alias("ox0"), F.col("y0").alias("oy0"), F.col("y1").alias("oy1"))
    near = (F.col("ox0") >= F.col("x1")) & (F.col("ox0") - F.col("x1") <= gap) & (F.least("y1", "oy1") > F.greatest("y0", "oy0"))
    met = key.join(other, ["source_id", "pdf_page", "_b"]).where(near)
    return met.groupBy(ident, "source_id", "pdf_page", F.lower("_t").alias("kind")).agg(F.count("*").alias("n"), F.min("number").alias("number")).where("n = 1").drop("n")


def drawings(paths: DataFrame, width: float, height: float) -> DataFrame:
    """``paths`` with ``shape`` (rule, upright, region, dot), ``disposition`` and ``reason``: what a drawn box is, and whether it is content. Corners may come in any order."""
    d = paths.withColumn("_w", F.abs(F.col("x1") - F.col("x0"))).withColumn("_h", F.abs(F.col("y1") - F.col("y0")))
    shape = F.when((F.col("_w") <= 2) & (F.col("_h") <= 2), "dot").when(F.col("_h") <= 2, "rule").when(F.col("_w") <= 2, "upright").otherwise("region")
    reason = F.when(F.col("_w") * F.col("_h") >= 0.85 * width * height, "page-frame").when(shape == "dot", "too-small").when((shape == "region") & (F.col("_w") * F.col("_h") < 0.0005 * width * height), "glyph-outline")
    return d.withColumn("shape", shape).withColumn("reason", reason).withColumn("disposition", F.when(reason.isNull(), "content").otherwise("left-out")).drop("_w", "_h")


def gate(records: DataFrame, registry: DataFrame, on: str, facts: Sequence[str]) -> DataFrame:
    """(on, admitted, reasons): records whose every fact is the registered one are admitted; others, and unregistered ones, are refused with what differs."""
    own = records.groupBy(on).agg(*[F.min(f).alias(f) for f in facts], *[F.max(f).alias(f"_{f}") for f in facts])
    known = registry.select(on, F.lit(True).alias("_known"), *[F.col(f).alias(f"{f}_registered") for f in facts])
    j = own.join(known, on, "left")
    wrong = F.array_compact(F.array(F.when(F.col("_known").isNull(), "unregistered"), *[F.when(F.col("_known") & ~(F.col(f).eqNullSafe(F.col(f"{f}_registered")) & F.col(f"_{f}").eqNullSafe(F.col(f"{f}_registered"))), f) for f in facts]))
    return j.select(on, (F.size(wrong) == 0).alias("admitted"), F.array_join(wrong, ",").alias("reasons"))


def cell_findings(cells: DataFrame, fragments: DataFrame, row: list[str], ident: str) -> DataFrame:
    """(row, ident, code): fragments of a row in no cell or in several, and cells' fragments that their row lacks."""
    held = cells.groupBy(*row, ident).agg(F.count("*").alias("n"))
    j = fragments.select(*row, ident, F.lit(True).alias("_own")).distinct().join(held, [*row, ident], "full")
    code = F.when(F.col("_own").isNull(), "outside-its-row").when(F.col("n").isNull(), "in-no-cell").when(F.col("n") > 1, "in-several-cells")
    return j.withColumn("code", code).where("code is not null").select(*row, ident, "code")


def phrases_at(df: DataFrame, key: str, text: str, phrases: dict[str, Sequence[str]]) -> DataFrame:
    """(key, marker, start): where each marker's first phrase stands first, 0-based; markers without one are left out."""
    low = F.lower(F.col(text))
    at = F.array_compact(F.array(*[F.when(F.coalesce(*[F.when(F.instr(low, p) > 0, F.lit(1)) for p in ps]).isNotNull(), F.struct(F.lit(m).alias("marker"), (F.least(*[F.nullif(F.instr(low, p), F.lit(0)) for p in ps], F.lit(2**31 - 1)) - 1).alias("start"))) for m, ps in phrases.items()]))
    return df.where(F.col(text).isNotNull()).select(key, F.inline(at))


def page_roles(blocks: DataFrame) -> DataFrame:
    """(source_id, pdf_page, role): text, image (blocks, none of them with text), or heading (only short lines)."""
    some = F.coalesce(F.trim("text"), F.lit("")) != ""
    g = blocks.where("pdf_page is not null").groupBy("source_id", "pdf_page").agg(F.count_if(some).alias("n"), F.max(F.length(F.trim("text"))).alias("longest"))
    return g.select("source_id", "pdf_page", F.when(F.col("n") == 0, "image").when(F.col("longest") < 60, "heading").otherwise("text").alias("role"))


def finalized_relations(relations: DataFrame, nodes: DataFrame, key: list[str], at: str, owner: str, target: str) -> DataFrame:
    """Relations once a key (the latest delivery), with the target's node: (key columns, ``at``, target_node, resolved)."""
    last = relations.groupBy(*key).agg(F.max(at).alias(at))
    known = nodes.groupBy("owner", "key").agg(F.min("node_id").alias("target_node")).select(F.col("owner").alias(owner), F.col("key").alias(target), "target_node")
    j = last.join(known, [owner, target], "left")
    return j.select(*key, at, "target_node", F.col("target_node").isNotNull().alias("resolved"))
