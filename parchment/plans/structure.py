"""Queries on document structure with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import locator
from ..operators import layout, structure as st
from ..operators.copies import HIERARCHY_VALUES, hierarchy_rows, latest
from ..operators.evidence import current
from ..operators.provisions import MODALS, any_of
from ..session import table


def _made(spark: SparkSession, d: str) -> DataFrame:
    """Pages of one and of two columns, laid out from customers: 24 lines a page, some across the whole width."""
    c = table(spark, d, "customer")
    i, page = F.col("c_custkey") % 24, F.floor(F.col("c_custkey") / 24).cast("int")
    two, wide = page % 3 == 0, i == 11
    x0 = F.when(wide, 40.0).when(two, (i % 2) * 290.0 + 40 + F.col("c_nationkey")).otherwise(60.0 + F.col("c_nationkey") * 2)
    x1 = F.when(wide, 560.0).when(two, x0 + 150 + F.col("c_nationkey") * 3).otherwise(x0 + 300)
    y0 = F.when(two, F.floor(i / 2) * 14.0).otherwise(i * 14.0)
    return c.select(F.lit("made").alias("source_id"), page.alias("pdf_page"), F.col("c_custkey").alias("line"), F.lit("line").alias("text"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), (y0 + 10).alias("y1"))


def page_order_inferred(spark, d):
    return st.inferred_order(_made(spark, d))


def page_lines_ordered(spark, d):
    lines = _made(spark, d)
    return st.ordered_lines(lines, st.inferred_order(lines), "line")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return layout.page_lines(table(spark, d, "page_line"))


def visual_lines(spark, d):
    return st.visual_lines(_lines(spark, d), "line_id")


def direct_blocks(spark, d):
    return st.direct_blocks(_lines(spark, d), "line_id")


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    at = lambda i: F.get("bbox", F.lit(i))
    return current(table(spark, d, "evidence")).select("evidence_id", "source_id", "pdf_page", "text", "block_index", at(1).alias("y0"), at(3).alias("y1"))


def table_clips(spark, d):
    return st.caption_clips(_blocks(spark, d), "evidence_id")


def caption_detections(spark, d):
    b = _blocks(spark, d).where("pdf_page is not null").withColumn("kind", st.line_kind(F.col("text"))).where("kind in ('table', 'figure')")
    b = b.select("source_id", "kind", F.regexp_extract(F.trim("text"), r"(?i)^(?:table|figure)\s+([A-Za-z]?[0-9]+(?:\.[0-9]+)*)", 1).alias("number"), "pdf_page", "evidence_id")
    return st.detections(b, ["source_id", "kind", "number"], ["pdf_page", "evidence_id"])


def _sections(spark: SparkSession, d: str) -> DataFrame:
    return current(table(spark, d, "source_text_section"), "node_id")


def marker_roles(spark, d):
    s = _sections(spark, d).where("locator is not null")
    r = st.marker_roles(s, F.size(F.split(F.col("locator"), r"\.")), F.col("label").isNotNull(), F.coalesce(F.col("node_type") == "list_item", F.lit(False)))
    return r.select("node_id", "role", "confidence", "evidence")


def note_identities(spark, d):
    return _sections(spark, d).select("node_id", st.note_identity(F.col("locator"), F.col("first_page")).alias("identity"))


def annex_relations(spark, d):
    """Annex paragraphs named after one copy's records, and which of the other copy's they explain."""
    own = lambda t: latest(hierarchy_rows(table(spark, d, t)), ["publication_key", "locator"], HIERARCHY_VALUES, "loaded_at").where("locator is not null")
    return st.explains(own("hierarchy_expected").select("publication_key", F.concat(F.lit("a."), "locator").alias("locator")), own("hierarchy_actual"), "publication_key", "locator", "a.")


def section_findings(spark, d):
    return st.section_findings(table(spark, d, "source_text_section"))


def section_overlaps(spark, d):
    """Customers' orders as spans of sixty days: those that begin before an earlier one ends. (The sections' own spans don't overlap.)"""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).alias("s"))
    return st.sibling_overlaps(o.withColumn("e", F.col("s") + 60), ["o_custkey"], "o_orderkey", "s", "e")


def page_findings(spark, d):
    """Evidence's pages against the scanned pages' lines, of the sources that have such."""
    lines = table(spark, d, "page_line").select("source_id", "pdf_page").where("source_id is not null and pdf_page is not null").distinct()
    return st.page_findings(table(spark, d, "evidence").join(lines.select("source_id").distinct(), "source_id", "left_semi"), lines)


def reference_diagnostics(spark, d):
    r = table(spark, d, "reference_relation").select(locator(F.col("source_locator")).alias("source_key"), locator(F.col("target_locator")).alias("target_key"), "resolved", F.col("evidence_start").alias("start"), F.col("evidence_end").alias("end"))
    b = _blocks(spark, d).withColumn("k", st.line_kind(F.col("text"))).select(F.when(F.col("k") == "table", "table_heading").otherwise(F.col("k")).alias("kind"), F.col("evidence_id").alias("key"), F.col("block_index").alias("start"), (F.col("block_index") + 1).alias("end"))
    return st.reference_diagnostics(r, b)


def chapter_anchors(spark, d):
    return st.anchors(table(spark, d, "page_line"), "source_id", "pdf_page")


def page_labels(spark, d):
    return current(table(spark, d, "evidence")).where("printed_page is not null").select("evidence_id", st.page_label(F.col("printed_page")).alias("p")).select("evidence_id", "p.style", "p.number")


def meaning_spans(spark, d):
    return st.meaning_spans(table(spark, d, "documents"), "doc_id")


def corpus_measures(spark, d):
    """What a publication holds: pages, blocks, captions, boxes and their middle height."""
    b = _blocks(spark, d).withColumn("k", st.line_kind(F.coalesce("text", F.lit(""))))
    p = current(table(spark, d, "evidence")).select("evidence_id", "publication_key")
    return b.join(p, "evidence_id").groupBy("publication_key").agg(
        F.countDistinct("source_id", "pdf_page").alias("pages"), F.count("*").alias("blocks"), F.count_if(F.col("k") == "table").alias("tables"), F.count_if(F.col("k") == "figure").alias("figures"), F.count_if(F.col("y0").isNull()).alias("without_box"),
        F.round(F.percentile(F.col("y1") - F.col("y0"), F.lit(0.5)), 3).alias("middle_height"),
    )


def source_manifest(spark, d):
    e = current(table(spark, d, "evidence"))
    return e.groupBy("source_id").agg(F.min("source_sha256").alias("sha256"), F.countDistinct("publication_key").alias("publications"), F.max("pdf_page").alias("last_page"), F.date_format(F.min("extracted_at"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("extracted_at"), "yyyy-MM-dd").alias("last_day"))


def _definitions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = _sections(spark, d).select(F.col("artifact_id").alias("owner"), locator(F.col("locator")).alias("key"), "label")
    r = table(spark, d, "reference_relation").where("relation_type = 'defined_in'").select(F.concat_ws("#", "source_artifact_id", locator(F.col("source_locator"))).alias("source"), F.col("target_artifact_id").alias("owner"), locator(F.col("target_locator")).alias("key"))
    return st.definitions(n, r, "owner", "key", "label")


def definition_inventory(spark, d):
    return _definitions(spark, d)[0]


def definition_graph(spark, d):
    return _definitions(spark, d)[1]


BARRED = ("text", "content", "source_text", "block_kind")


def unsafe_metadata(spark, d):
    return st.unsafe_keys(table(spark, d, "evidence"), "evidence_id", ["observed_metadata", "derived_metadata"], BARRED)


_ALL = (
    page_order_inferred, page_lines_ordered, visual_lines, direct_blocks, table_clips, caption_detections, marker_roles, note_identities, annex_relations, section_findings, section_overlaps, page_findings, reference_diagnostics,
    chapter_anchors, page_labels, meaning_spans, corpus_measures, source_manifest, unsafe_metadata, definition_inventory, definition_graph,
)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


_MADE = """base AS (SELECT c_custkey AS line, CAST(c_custkey // 24 AS INTEGER) AS pdf_page, c_custkey % 24 AS i, c_nationkey AS k FROM customer),
    boxed AS (SELECT *, CASE WHEN i = 11 THEN 40.0 WHEN pdf_page % 3 = 0 THEN (i % 2) * 290.0 + 40 + k ELSE 60.0 + k * 2 END::DOUBLE AS x0, CASE WHEN pdf_page % 3 = 0 THEN (i // 2) * 14.0 ELSE i * 14.0 END::DOUBLE AS y0 FROM base),
    made AS (SELECT *, CASE WHEN i = 11 THEN 560.0 WHEN pdf_page % 3 = 0 THEN x0 + 150 + k * 3 ELSE x0 + 300 END::DOUBLE AS x1, y0 + 10 AS y1 FROM boxed),
    sided AS (SELECT *, CASE WHEN x1 - x0 >= 612.0 * 0.65 OR (x0 <= 306 - 61.2 AND x1 >= 306 + 61.2) THEN 'full' WHEN (x0 + x1) / 2 < 306 THEN 'left' ELSE 'right' END AS side FROM made)"""


def _side(s: str, edge: str) -> str:
    return f"count(*) FILTER (side = '{s}') AS {s[0]}n, min(y0) FILTER (side = '{s}') AS {s[0]}top, max(y1) FILTER (side = '{s}') AS {s[0]}foot, quantile_cont(x0, 0.5) FILTER (side = '{s}') AS {s[0]}at, CASE WHEN count(*) FILTER (side = '{s}') >= 4 THEN quantile_cont(x1 - x0, 0.75) FILTER (side = '{s}') ELSE max(x1 - x0) FILTER (side = '{s}') END AS {s[0]}w, list_sort(list({edge}) FILTER (side = '{s}')) AS {s[0]}e"


_PROFILE = f"""page AS (SELECT pdf_page, quantile_cont(greatest(0.1, y1 - y0), 0.5) FILTER (side <> 'full') AS h, {_side('left', 'x1')}, {_side('right', 'x0')} FROM sided GROUP BY 1),
    told AS (SELECT *, coalesce(ln >= 2 AND rn >= 2 AND least(lfoot, rfoot) - greatest(ltop, rtop) >= h AND lat < 612 * 0.45 AND rat > 612 * 0.48 AND least(lw, rw) >= 612 * 0.12, false) AS two, le[CAST(least(ln - 1, floor(ln * 0.9)) AS INTEGER) + 1] AS a, re[CAST(greatest(0, floor(rn * 0.1)) AS INTEGER) + 1] AS b FROM page),
    profile AS (SELECT pdf_page, CASE WHEN two THEN 'two_column' ELSE 'top_to_bottom' END AS mode, CASE WHEN two THEN round(least(612 * 0.55, greatest(612 * 0.45, CASE WHEN a < b THEN (a + b) / 2 ELSE 306 END)), 3) END AS split_x,
      CASE WHEN two THEN round(least(0.95, 0.62 + greatest(0, rat - lat) / 612 * 0.35 + least(ln, rn) / greatest(ln, rn) * 0.12), 3) ELSE 0.5 END AS confidence, ln AS left_lines, rn AS right_lines FROM told)"""

_KIND = """CASE WHEN regexp_matches(trim({0}), '(?i)^table\\s+[A-Za-z]?\\d') THEN 'table' WHEN regexp_matches(trim({0}), '(?i)^figure\\s+[A-Za-z]?\\d') THEN 'figure' WHEN regexp_matches(trim({0}), '(?i)^note(\\s+\\d+)?\\s*[:.]') THEN 'note'
      WHEN regexp_matches(trim({0}), '(?i)^exception(\\s+no\\.\\s*\\d+|\\s+\\d+)?\\s*[:.]') THEN 'exception' WHEN regexp_matches(trim({0}), '^\\([0-9a-zA-Z]{{1,4}}\\)\\s') THEN 'list_item' ELSE 'text' END"""
_PL = "pl AS (SELECT line_id, source_id, pdf_page, text, bbox[1] AS x0, bbox[2] AS y0, bbox[3] AS x1, bbox[4] AS y1 FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY loaded_at) AS rn FROM page_line WHERE line_id IS NOT NULL) WHERE rn = 1)"
_EV = "ev AS (SELECT *, bbox[2] AS y0, bbox[4] AS y1 FROM (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY loaded_at) AS rn FROM evidence WHERE evidence_id IS NOT NULL) WHERE rn = 1)"
_SEC = "sec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY loaded_at) AS rn FROM source_text_section) WHERE rn = 1)"
_LOC = "lower(regexp_replace({0}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'))"


def _spans(name: str, phrases, kind: str, first: bool = False) -> str:
    pattern = any_of(phrases)
    return f"""{name} AS (SELECT doc_id, {kind} AS type, "start", "start" + length(hit) AS "end" FROM (SELECT doc_id, n, lower(regexp_replace(hit, '\\s+', ' ', 'g')) AS w, hit, sum(length(gap)) OVER o + coalesce(sum(length(hit)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "start"
      FROM (SELECT doc_id, unnest(range(1, len(hits) + 1)) AS n, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS hits, string_split_regex(text, '{pattern}') AS gaps FROM documents WHERE text <> '')) WINDOW o AS (PARTITION BY doc_id ORDER BY n)){' WHERE n = 1' if first else ''})"""


def oracle_sql() -> dict[str, str]:
    q = {}
    q["page_order_inferred"] = f"WITH {_MADE}, {_PROFILE} SELECT 'made' AS source_id, * FROM profile"
    q["page_lines_ordered"] = f"""WITH {_MADE}, {_PROFILE}, placed AS (SELECT s.*, split_x, CASE WHEN split_x IS NULL OR side = 'full' THEN 0 WHEN (x0 + x1) / 2 < split_x THEN 1 ELSE 2 END AS c, CASE WHEN side = 'full' AND split_x IS NOT NULL THEN 1 ELSE 0 END AS p FROM sided s JOIN profile USING (pdf_page)),
    band AS (SELECT *, sum(2 * p) OVER (PARTITION BY pdf_page ORDER BY y0, x0, line) - p AS b FROM placed) SELECT line, 'made' AS source_id, pdf_page, CAST(row_number() OVER (PARTITION BY pdf_page ORDER BY b, c, y0, x0, line) AS INTEGER) AS reading_no FROM band"""
    q["visual_lines"] = f"""WITH {_PL}, y AS (SELECT *, (y0 + y1) / 2 AS m FROM pl WHERE pdf_page IS NOT NULL AND x0 IS NOT NULL), n AS (SELECT *, CASE WHEN m - lag(m) OVER (PARTITION BY source_id, pdf_page ORDER BY m, line_id) <= 2.5 THEN 0 ELSE 1 END AS new FROM y),
    l AS (SELECT *, sum(new) OVER (PARTITION BY source_id, pdf_page ORDER BY m, line_id) AS line_no FROM n)
    SELECT source_id, pdf_page, CAST(line_no AS BIGINT) AS line_no, count(*) AS fragments, string_agg(coalesce(text, ''), ' ' ORDER BY x0, line_id) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM l GROUP BY source_id, pdf_page, line_no"""
    q["direct_blocks"] = f"""WITH {_PL}, k AS (SELECT *, {_KIND.format('text')} AS k FROM pl WHERE pdf_page IS NOT NULL AND y0 IS NOT NULL AND trim(text) <> ''),
    n AS (SELECT *, CASE WHEN lag(k) OVER w IS NULL OR k <> 'text' OR lag(k) OVER w NOT IN ('text', 'list_item') OR y0 - lag(y1) OVER w > 8.5 THEN 1 ELSE 0 END AS new FROM k WINDOW w AS (PARTITION BY source_id, pdf_page ORDER BY y0, line_id)),
    b AS (SELECT *, sum(new) OVER (PARTITION BY source_id, pdf_page ORDER BY y0, line_id) AS block_no FROM n)
    SELECT source_id, pdf_page, CAST(block_no AS BIGINT) AS block_no, CASE WHEN first(k ORDER BY y0, line_id) = 'text' THEN 'paragraph' ELSE first(k ORDER BY y0, line_id) END AS kind, count(*) AS lines, string_agg(trim(text), ' ' ORDER BY y0, line_id) AS text, min(y0) AS y0, max(y1) AS y1 FROM b GROUP BY source_id, pdf_page, block_no"""
    q["table_clips"] = f"""WITH {_EV}, k AS (SELECT evidence_id, source_id, pdf_page, text, y0, y1, {_KIND.format('text')} AS k FROM ev WHERE pdf_page IS NOT NULL AND y0 IS NOT NULL AND text IS NOT NULL)
    SELECT a.evidence_id, a.source_id, a.pdf_page, regexp_replace('table:' || regexp_extract(trim(a.text), '(?i)^table\\s+([A-Za-z]?[0-9][0-9A-Za-z.-]*)', 1), '[.-]+$', '') AS locator, greatest(55.0, a.y0 - 1) AS y0, CASE WHEN min(b.y0) IS NULL THEN 729.0 ELSE greatest(a.y1 + 12, min(b.y0) - 1) END AS y1
    FROM k a LEFT JOIN k b ON a.source_id IS NOT DISTINCT FROM b.source_id AND a.pdf_page = b.pdf_page AND round(b.y0 * 1000) >= round(a.y0 * 1000) + 2001 AND b.k NOT IN ('text', 'list_item') WHERE a.k = 'table' GROUP BY a.evidence_id, a.source_id, a.pdf_page, a.text, a.y0, a.y1"""
    q["caption_detections"] = f"""WITH {_EV}, c AS (SELECT source_id, {_KIND.format('text')} AS kind, regexp_extract(trim(text), '(?i)^(?:table|figure)\\s+([A-Za-z]?[0-9]+(?:\\.[0-9]+)*)', 1) AS number, pdf_page, evidence_id FROM ev WHERE pdf_page IS NOT NULL)
    SELECT source_id, kind, number, pdf_page, evidence_id, CASE WHEN row_number() OVER (PARTITION BY source_id, kind, number ORDER BY pdf_page, evidence_id) = 1 THEN 'accepted' ELSE 'merged' END AS disposition FROM c WHERE kind IN ('table', 'figure') AND source_id IS NOT NULL"""
    q["marker_roles"] = f"""WITH {_SEC}, m AS (SELECT node_id, len(string_split(locator, '.')) AS level, label IS NOT NULL AS titled, coalesce(node_type = 'list_item', false) AS listed FROM sec WHERE locator IS NOT NULL)
    SELECT node_id, CASE WHEN titled AND NOT listed THEN 'subdivision' WHEN listed AND NOT titled THEN 'list_item' ELSE 'ambiguous' END AS role, CASE WHEN titled <> listed THEN 'high' ELSE 'low' END AS confidence,
      CASE WHEN titled AND listed THEN 'title,list-introduction,conflicting-evidence' WHEN titled THEN 'title' WHEN listed THEN 'list-introduction' ELSE CASE WHEN level <= 2 THEN 'title-expected-at-this-level' WHEN level = 3 THEN 'third-level-sibling-title-context-needed' ELSE 'beyond-named-subdivision-levels' END || ',numbering-alone-is-insufficient' END AS evidence FROM m"""
    q["note_identities"] = f"WITH {_SEC} SELECT node_id, CASE WHEN regexp_replace(locator, '\\s+', '', 'g') <> '' AND first_page >= 1 THEN regexp_replace(locator, '\\s+', '', 'g') || '#informational-note:' || first_page END AS identity FROM sec"
    q["annex_relations"] = f"""WITH e AS (SELECT DISTINCT publication_key, {_LOC.format('locator')} AS k FROM hierarchy_expected WHERE locator IS NOT NULL), a AS (SELECT DISTINCT publication_key, {_LOC.format('locator')} AS k FROM hierarchy_actual)
    SELECT publication_key, 'a.' || e.k AS source, e.k AS target, a.k IS NOT NULL AS resolved FROM e LEFT JOIN a USING (publication_key, k)"""
    q["section_findings"] = """WITH s AS (SELECT DISTINCT node_id, artifact_id, locator, parent_locator, span_start, span_end, text_sha256, first_page, last_page FROM source_text_section)
    SELECT node_id, 'empty-locator' AS code FROM s WHERE coalesce(trim(locator), '') = '' UNION SELECT node_id, 'empty-artifact' FROM s WHERE coalesce(trim(artifact_id), '') = '' UNION SELECT node_id, 'bad-text-hash' FROM s WHERE NOT coalesce(regexp_full_match(text_sha256, '[0-9a-f]{64}'), false)
    UNION SELECT node_id, 'pages-reversed' FROM s WHERE first_page > last_page UNION SELECT node_id, 'bad-span' FROM s WHERE coalesce(span_start < 0 OR span_end < span_start, true) UNION SELECT node_id, 'identity-in-several-artifacts' FROM s GROUP BY node_id HAVING min(artifact_id) <> max(artifact_id)"""
    q["section_overlaps"] = """WITH o AS (SELECT o_orderkey, o_custkey, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS s FROM orders), w AS (SELECT *, max(s + 60) OVER (PARTITION BY o_custkey ORDER BY s, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM o)
    SELECT DISTINCT o_orderkey, 'begins-inside-another' AS code FROM w WHERE s < most"""
    q["page_findings"] = """WITH f AS (SELECT DISTINCT source_id, pdf_page FROM page_line WHERE source_id IS NOT NULL AND pdf_page IS NOT NULL), p AS (SELECT DISTINCT source_id, pdf_page FROM evidence WHERE pdf_page IS NOT NULL AND source_id IN (SELECT source_id FROM f))
    SELECT source_id, pdf_page, 'no-profile' AS code FROM p ANTI JOIN f USING (source_id, pdf_page) UNION ALL SELECT source_id, pdf_page, 'no-page' FROM f ANTI JOIN p USING (source_id, pdf_page)
    UNION ALL SELECT source_id, CAST(n AS INTEGER), 'page-left-out' FROM (SELECT source_id, unnest(range(1, max(pdf_page) + 1)) AS n FROM p GROUP BY 1) x WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.source_id = x.source_id AND p.pdf_page = x.n)"""
    q["reference_diagnostics"] = f"""WITH {_EV}, k AS (SELECT evidence_id, block_index, {_KIND.format('text')} AS k FROM ev)
    SELECT DISTINCT 'unresolved-reference' AS code, 'warning' AS severity, {_LOC.format('source_locator')} AS locator, {_LOC.format('target_locator')} AS target, evidence_start AS "start", evidence_end AS "end" FROM reference_relation WHERE NOT coalesce(resolved, false) AND evidence_start IS NOT NULL
    UNION SELECT CASE k WHEN 'figure' THEN 'unsupported-figure-interpretation' ELSE 'unsupported-table-layout' END, 'info', evidence_id, NULL, block_index, block_index + 1 FROM k WHERE k IN ('figure', 'table')"""
    q["chapter_anchors"] = """WITH l AS (SELECT source_id, pdf_page, upper(trim(regexp_replace(u.l, '\\s+', ' ', 'g'))) AS l FROM (SELECT source_id, pdf_page, string_split_regex(text, '\\r\\n|[\\r\\n]') AS ls FROM page_line WHERE text IS NOT NULL AND pdf_page IS NOT NULL), unnest(ls) AS u(l))
    SELECT DISTINCT source_id, pdf_page, lower(regexp_extract(l, '^(CHAPTER|APPENDIX) ?([0-9]{1,3}|[A-Z])(?: |$)', 1)) AS kind, regexp_extract(l, '^(CHAPTER|APPENDIX) ?([0-9]{1,3}|[A-Z])(?: |$)', 2) AS identifier FROM l WHERE regexp_matches(l, '^(CHAPTER|APPENDIX) ?([0-9]{1,3}|[A-Z])(?: |$)')"""
    roman = "(SELECT sum(CASE WHEN v < coalesce(nxt, 0) THEN -v ELSE v END) FROM (SELECT v, lead(v) OVER (ORDER BY i) AS nxt FROM (SELECT i, CASE lower(t)[i] WHEN 'i' THEN 1 WHEN 'v' THEN 5 WHEN 'x' THEN 10 WHEN 'l' THEN 50 WHEN 'c' THEN 100 WHEN 'd' THEN 500 WHEN 'm' THEN 1000 END AS v FROM unnest(range(1, length(t) + 1)) AS r(i))))"
    q["page_labels"] = f"""WITH {_EV}, p AS (SELECT evidence_id, trim(printed_page) AS t FROM ev WHERE printed_page IS NOT NULL),
    s AS (SELECT *, CASE WHEN regexp_full_match(t, '[0-9]+') THEN 'decimal' WHEN regexp_full_match(t, '[0-9]+-[0-9]+') THEN 'chapter_page' WHEN regexp_full_match(t, '[A-Za-z]-[0-9]+') THEN 'letter_page' WHEN t <> '' AND regexp_full_match(t, '(?i)m{{0,3}}(cm|cd|d?c{{0,3}})(xc|xl|l?x{{0,3}})(ix|iv|v?i{{0,3}})') THEN 'roman' ELSE 'other' END AS style FROM p),
    v AS (SELECT evidence_id, style, t, CASE WHEN style = 'roman' THEN {roman} END AS r FROM s)
    SELECT evidence_id, style, CAST(CASE WHEN style = 'roman' THEN r WHEN style <> 'other' THEN CAST(regexp_extract(t, '([0-9]{{1,9}})$', 1) AS INTEGER) END AS INTEGER) AS number FROM v"""
    modal = MODALS | st.FURTHER_MODALS
    parts = [_spans("modal", modal, "CASE w " + " ".join(f"WHEN '{w}' THEN '{t}'" for w, t in modal.items()) + " END"), *[_spans(f"{k}_", p, f"'{k}'", k == "exception") for k, p in st.MEANINGS.items()]]
    q["meaning_spans"] = f"WITH {', '.join(parts)} " + " UNION ".join(f'SELECT doc_id, type, CAST("start" AS INTEGER) AS "start", CAST("end" AS INTEGER) AS "end" FROM {n}' for n in ("modal", *[f"{k}_" for k in st.MEANINGS]))
    q["corpus_measures"] = f"""WITH {_EV} SELECT publication_key, count(DISTINCT CASE WHEN source_id IS NOT NULL AND pdf_page IS NOT NULL THEN source_id || '#' || pdf_page END) AS pages, count(*) AS blocks, count(*) FILTER ({_KIND.format("coalesce(text, '')")} = 'table') AS tables, count(*) FILTER ({_KIND.format("coalesce(text, '')")} = 'figure') AS figures, count(*) FILTER (y0 IS NULL) AS without_box, round(quantile_cont(y1 - y0, 0.5), 3) AS middle_height FROM ev GROUP BY 1"""
    q["source_manifest"] = f"WITH {_EV} SELECT source_id, min(source_sha256) AS sha256, count(DISTINCT publication_key) AS publications, max(pdf_page) AS last_page, strftime(min(extracted_at), '%Y-%m-%d') AS first_day, strftime(max(extracted_at), '%Y-%m-%d') AS last_day FROM ev GROUP BY 1"
    defs = f"""{_SEC}, n AS (SELECT artifact_id AS owner, {_LOC.format('locator')} AS key, min(label) AS observed_term, min(upper(trim(regexp_replace(label, '\\s+', ' ', 'g')))) AS normalized_term FROM sec WHERE trim(label) <> '' AND locator IS NOT NULL AND artifact_id IS NOT NULL GROUP BY 1, 2),
    l AS (SELECT DISTINCT concat_ws('#', source_artifact_id, {_LOC.format('source_locator')}) AS source, target_artifact_id AS owner, {_LOC.format('target_locator')} AS key FROM reference_relation WHERE relation_type = 'defined_in'),
    g AS (SELECT source, owner, key, normalized_term AS term FROM l JOIN n USING (owner, key)), f AS (SELECT owner, key, observed_term, normalized_term, count(*) AS uses FROM g JOIN n USING (owner, key) GROUP BY ALL)"""
    q["definition_graph"] = f"WITH {defs} SELECT * FROM g"
    q["definition_inventory"] = f"WITH {defs} SELECT *, count(*) OVER (PARTITION BY owner, normalized_term) - 1 AS alternates FROM f"
    barred = ", ".join(f"'{b}'" for b in BARRED)
    q["unsafe_metadata"] = " UNION ALL ".join(f"SELECT DISTINCT evidence_id, '{m}' AS \"column\", u.k AS key FROM (SELECT evidence_id, map_keys({m}) AS ks FROM evidence), unnest(ks) AS u(k) WHERE lower(u.k) IN ({barred})" for m in ("observed_metadata", "derived_metadata"))
    return q
