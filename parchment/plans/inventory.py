"""Inventory queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import locator
from ..operators import inventory as inv, layout, stream_text
from ..operators.copies import HIERARCHY_VALUES, hierarchy_rows, latest
from ..operators.evidence import current
from ..session import table


def _h(spark, d, name):
    return latest(hierarchy_rows(table(spark, d, name)), ["publication_key", "locator"], HIERARCHY_VALUES, "loaded_at")


def sibling_ranges(spark, d):
    """Ranges made from known locators that end in a letter, up to three letters on."""
    k = _h(spark, d, "hierarchy_expected").select("publication_key", "locator").where(F.col("locator").rlike(r"\([a-z]\)$"))
    last = F.char(F.least(F.ascii(F.regexp_extract("locator", r"\(([a-z])\)$", 1)) + F.length("locator") % 4, F.lit(122)))
    r = k.select(F.concat_ws("#", "publication_key", "locator").alias("ref"), "publication_key", F.concat("locator", F.lit("-("), last, F.lit(")")).alias("raw"))
    return inv.sibling_ranges(r, k, "ref", "raw", "publication_key", "locator")


def page_ranges(spark, d):
    s = table(spark, d, "source_text_section").where("node_type = 'chapter' and first_page is not null").select("artifact_id", locator(F.col("locator")).alias("chapter"), "first_page").distinct()
    last = table(spark, d, "source_text_section").groupBy("artifact_id").agg(F.max("last_page").alias("end_page"))
    return inv.page_ranges(s, "artifact_id", "chapter", "first_page", last, "end_page")


def locator_agreement(spark, d):
    return inv.agreement(_h(spark, d, "hierarchy_expected"), _h(spark, d, "hierarchy_actual"), ["publication_key", "locator"], "ordinal")


def expected_changes(spark, d):
    stage = F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "O", 2).otherwise(1)
    return inv.final_stage(table(spark, d, "orders"), "o_custkey", stage, F.col("o_orderpriority"))


def lineage_findings(spark, d):
    return inv.lineage_findings(table(spark, d, "events"), "user_id", "ts", "event_type", "signup", ["purchase"])


def applicability_scopes(spark, d):
    r = table(spark, d, "reference_relation").select(F.concat_ws("#", "target_artifact_id", locator(F.col("target_locator"))).alias("target"), "source_artifact_id", "target_artifact_id", "target_locator")
    return inv.shared_targets(r.where("target_artifact_id is not null and target_locator is not null"), "target", "source_artifact_id")


def family_sets(spark, d):
    return inv.families(table(spark, d, "part"), "p_brand", "p_type", "p_size")


def operation_resolve(spark, d):
    m = table(spark, d, "hierarchy_mismatch").select("mismatch_id", "publication_key", locator(F.col("locator")).alias("locator")).distinct()
    return inv.operation(m, "mismatch_id", "publication_key", "locator", _h(spark, d, "hierarchy_actual"))


def geometry_fingerprints(spark, d):
    lines = layout.page_lines(table(spark, d, "page_line")).where("x0 is not null and pdf_page is not null")
    return inv.fingerprints(lines, ["source_id", "pdf_page"], ["x0", "y0", "x1", "y1"])


def uncaptioned_regions(spark, d):
    e = current(table(spark, d, "evidence")).where("bbox is not null and pdf_page is not null").select("evidence_id", F.concat_ws("#", "source_id", "pdf_page").alias("page"), F.get("bbox", F.lit(1)).alias("y0"), F.coalesce(F.col("text").rlike("^(Table|Figure)"), F.lit(False)).alias("cap"))
    return inv.far_from(e.where("not cap"), e.where("cap"), "evidence_id", "page", "y0", 170.0).select("evidence_id")


def view_boxes(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 37 + 11).alias("w"), (F.col("p_partkey") % 900 + 5).cast("int").alias("h"))
    return inv.view_boxes(p, "p_partkey", "w", "h", fine=True)


def text_stream(spark, d):
    lines = layout.page_lines(table(spark, d, "page_line")).select("line_id", "source_id", "text")
    return stream_text.text_stream(lines, "source_id", ["line_id"], "text", F.substring("line_id", 1, 12)).select("line_id", "start", "end")


def term_mentions(spark, d):
    """Section labels mentioned in the documents."""
    terms = table(spark, d, "source_text_section").select("label").where("label is not null")
    return stream_text.term_mentions(table(spark, d, "documents"), "doc_id", "text", terms, "label")


_ALL = (sibling_ranges, page_ranges, locator_agreement, expected_changes, lineage_findings, applicability_scopes, family_sets, operation_resolve, geometry_fingerprints, uncaptioned_regions, view_boxes, text_stream, term_mentions)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


def _loc(c: str) -> str:
    return f"lower(regexp_replace({c}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'))"


def oracle_sql() -> dict[str, str]:
    q = {}
    h = lambda n, t: f"{n} AS (SELECT * EXCLUDE rn FROM (SELECT publication_key, {_loc('locator')} AS locator, ordinal, row_number() OVER (PARTITION BY publication_key, {_loc('locator')} ORDER BY loaded_at DESC NULLS LAST, title DESC NULLS LAST, parent DESC NULLS LAST, ordinal DESC NULLS LAST, depth DESC NULLS LAST) AS rn FROM {t}) WHERE rn = 1)"
    q["sibling_ranges"] = rf"""WITH {h('e', 'hierarchy_expected')}, k AS (SELECT publication_key, locator, regexp_replace(locator, '\([a-z]\)$', '') AS stem, ascii(regexp_extract(locator, '\(([a-z])\)$', 1)) AS a FROM e WHERE regexp_matches(locator, '\([a-z]\)$')),
      r AS (SELECT *, least(a + length(locator) % 4, 122) AS b FROM k), m AS (SELECT publication_key || '#' || r.locator AS ref, publication_key, list_transform(range(a, b + 1), lambda c: stem || '(' || chr(CAST(c AS INTEGER)) || ')') AS ms FROM r),
      x AS (SELECT ref, count(k.locator) AS hits FROM (SELECT ref, publication_key, unnest(ms) AS mm FROM m) u LEFT JOIN k ON k.publication_key = u.publication_key AND k.locator = u.mm GROUP BY 1)
      SELECT ref, array_to_string(ms, ',') AS members, CASE WHEN hits = len(ms) THEN 'resolved' WHEN hits > 0 THEN 'partial' ELSE 'nonexistent' END AS state FROM m JOIN x USING (ref)"""
    q["page_ranges"] = f"WITH s AS (SELECT DISTINCT artifact_id, {_loc('locator')} AS chapter, first_page FROM source_text_section WHERE node_type = 'chapter' AND first_page IS NOT NULL), l AS (SELECT artifact_id, max(last_page) AS m FROM source_text_section GROUP BY 1) SELECT s.artifact_id, chapter, first_page, greatest(first_page, coalesce(lead(first_page) OVER (PARTITION BY s.artifact_id ORDER BY first_page, chapter) - 1, m)) AS last_page FROM s JOIN l USING (artifact_id)"
    q["locator_agreement"] = f"WITH {h('e', 'hierarchy_expected')}, {h('a', 'hierarchy_actual')} SELECT CASE WHEN a.locator IS NULL THEN 'left_only' WHEN e.ordinal IS NULL THEN 'right_only' WHEN e.ordinal = a.ordinal THEN 'exact' WHEN abs(e.ordinal - a.ordinal) = 1 THEN 'near' ELSE 'far' END AS agreement, count(*) AS n FROM e FULL JOIN a ON e.publication_key = a.publication_key AND e.locator = a.locator GROUP BY 1"
    q["expected_changes"] = "WITH s AS (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END AS stage, o_orderpriority AS p FROM orders), t AS (SELECT * FROM s QUALIFY stage = max(stage) OVER (PARTITION BY o_custkey)) SELECT o_custkey, stage, count(*) AS records, CASE WHEN min(p) = max(p) THEN 'agreed' ELSE 'conflicting' END AS state FROM t GROUP BY 1, 2"
    q["lineage_findings"] = "WITH g AS (SELECT user_id, count(*) AS n, count(DISTINCT ts) AS d, count(*) FILTER (event_type = 'signup') AS f, arg_min(event_type, ts) AS head, count(*) FILTER (event_type = 'purchase') AS e FROM events GROUP BY 1) SELECT user_id, 'duplicate-sequence' AS finding FROM g WHERE d < n UNION ALL SELECT user_id, 'no-first' FROM g WHERE f = 0 UNION ALL SELECT user_id, 'several-first' FROM g WHERE f > 1 UNION ALL SELECT user_id, 'first-not-at-start' FROM g WHERE f > 0 AND head <> 'signup' UNION ALL SELECT user_id, 'several-final' FROM g WHERE e > 1"
    q["applicability_scopes"] = f"SELECT target_artifact_id || '#' || {_loc('target_locator')} AS target, count(DISTINCT source_artifact_id) AS owners, CASE WHEN count(DISTINCT source_artifact_id) = 1 THEN 'unique' ELSE 'shared' END AS state FROM reference_relation WHERE target_artifact_id IS NOT NULL AND target_locator IS NOT NULL AND source_artifact_id IS NOT NULL GROUP BY 1"
    q["family_sets"] = "SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS p_type, array_to_string(list_sort(list(DISTINCT CAST(p_size AS VARCHAR))), ',') AS p_size FROM part GROUP BY 1"
    q["operation_resolve"] = f"""WITH {h('a', 'hierarchy_actual')}, m AS (SELECT DISTINCT mismatch_id, publication_key, {_loc('locator')} AS locator FROM hierarchy_mismatch), u AS (SELECT mismatch_id, publication_key, locator, array_to_string(list_slice(string_split(locator, '.'), 1, i.i), '.') AS up FROM m, unnest(range(1, len(string_split(locator, '.')) + 1)) AS i(i)),
      t AS (SELECT mismatch_id, bool_or(u.up = u.locator) AS own FROM u JOIN a ON a.publication_key = u.publication_key AND a.locator = u.up GROUP BY 1) SELECT m.mismatch_id, CASE WHEN own THEN 'replace' WHEN own IS NOT NULL THEN 'add' ELSE 'unresolved' END AS operation FROM m LEFT JOIN t USING (mismatch_id)"""
    q["geometry_fingerprints"] = "WITH p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY loaded_at) AS rn FROM page_line) WHERE rn = 1 AND bbox IS NOT NULL AND pdf_page IS NOT NULL), b AS (SELECT source_id, pdf_page, array_to_string(list_transform(bbox, lambda x: printf('%.3f', x)), ',') AS b FROM p) SELECT source_id, pdf_page, count(*) AS members, sha256(array_to_string(list_sort(list(b)), ';')) AS fingerprint FROM b GROUP BY 1, 2"
    q["uncaptioned_regions"] = "WITH e AS (SELECT evidence_id, source_id || '#' || pdf_page AS page, bbox[2] AS y, coalesce(regexp_matches(text, '^(Table|Figure)'), false) AS cap FROM (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY loaded_at) AS rn FROM evidence) WHERE rn = 1 AND bbox IS NOT NULL AND pdf_page IS NOT NULL) SELECT evidence_id FROM e r WHERE NOT cap AND NOT EXISTS (SELECT 1 FROM e c WHERE c.cap AND c.page = r.page AND abs(c.y - r.y) <= 170.0)"
    views = "VALUES ('global', 1.0, 0.0, 0.0)" + "".join(f", ('{n}_{a}', {s}, {x}, {y})" for n, s in (("medium", 0.72), ("fine", 0.5)) for a, x, y in (("ul", 0.0, 0.0), ("ur", 1.0, 0.0), ("ll", 0.0, 1.0), ("lr", 1.0, 1.0), ("center", 0.5, 0.5)))
    q["view_boxes"] = f"WITH v(view, s, ax, ay) AS ({views}), p AS (SELECT p_partkey, p_size * 37 + 11 AS w, CAST(p_partkey % 900 + 5 AS INTEGER) AS h FROM part), c AS (SELECT *, greatest(1, CAST(round_even(CAST(w * s AS DOUBLE), 0) AS INTEGER)) AS cw, greatest(1, CAST(round_even(CAST(h * s AS DOUBLE), 0) AS INTEGER)) AS ch FROM p, v), x AS (SELECT *, CAST(round_even(CAST((w - cw) * ax AS DOUBLE), 0) AS INTEGER) AS x0, CAST(round_even(CAST((h - ch) * ay AS DOUBLE), 0) AS INTEGER) AS y0 FROM c) SELECT p_partkey, view, x0, y0, x0 + cw AS x1, y0 + ch AS y1 FROM x"
    q["text_stream"] = 'WITH p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY loaded_at) AS rn FROM page_line) WHERE rn = 1), e AS (SELECT line_id, coalesce(length(text), 0) AS l, CAST(sum(coalesce(length(text), 0) + 1) OVER (PARTITION BY source_id ORDER BY line_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS "end" FROM p) SELECT line_id, "end" - l AS start, "end" FROM e'
    q["term_mentions"] = "WITH t AS (SELECT DISTINCT array_to_string(regexp_extract_all(lower(label), '[a-z0-9]+'), ' ') AS term FROM source_text_section WHERE label IS NOT NULL), w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL), g AS (SELECT doc_id, array_to_string(list_slice(w, i.i, i.i + n.n - 1), ' ') AS term FROM w, unnest(range(1, len(w) + 1)) AS i(i), (SELECT unnest(range(1, (SELECT max(len(string_split(term, ' '))) FROM t) + 1)) AS n) n WHERE i.i + n.n - 1 <= len(w)) SELECT doc_id, term, count(*) AS mentions FROM g JOIN t USING (term) WHERE term <> '' GROUP BY ALL"
    return q
