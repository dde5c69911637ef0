"""Provision and layout queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import layout, provisions as pv
from ..operators.evidence import current
from ..session import table


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    return pv.sentences(table(spark, d, "documents").where("text is not null"), "doc_id")


def _made(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of the grammar's own shapes, made from parts."""
    p = table(spark, d, "part")
    unit = F.when(F.col("p_partkey") % 3 == 0, "feet").when(F.col("p_partkey") % 3 == 1, "sq ft").otherwise("inches")
    second = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit(" and at least "), "p_size", F.lit(" ft in width"))).when(F.col("p_partkey") % 5 == 1, F.concat(F.lit(" or more than "), "p_size", F.lit(".5 inches in depth"))).otherwise("")
    modal = F.when(F.col("p_partkey") % 4 == 0, " shall ").when(F.col("p_partkey") % 4 == 1, " must not ").when(F.col("p_partkey") % 4 == 2, " may ").otherwise(" will ")
    act = F.when(F.col("p_partkey") % 7 == 0, "provide ").when(F.col("p_partkey") % 7 == 1, "be equipped throughout with ").when(F.col("p_partkey") % 7 == 2, "be installed ").otherwise("have regard to ")
    exc = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(", except as permitted by Section "), (F.col("p_partkey") % 30).cast("string"), F.lit(".4."))).otherwise(".")
    return p.select("p_partkey", F.concat("p_name", F.lit(" exceeding "), "p_size", F.lit(" "), unit, F.lit(" in height"), second, modal, act, "p_brand", exc).alias("sentence"))


def provision_parse(spark, d):
    r = pv.parse(_made(spark, d))
    c = lambda i: F.get("comparisons", F.lit(i))
    return r.select("p_partkey", "modality", "modal_start", "modal_end", "subject", "condition_type", c(0)["property"].alias("property"), c(0)["operator"].alias("operator"), c(0)["value"].alias("value"), c(0)["unit"].alias("unit"), F.coalesce(F.size("comparisons"), F.lit(0)).alias("n_comparisons"), "action", "verb", "object", "exception_section", "diagnostics")


def provision_modality_counts(spark, d):
    return pv.parse(_sentences(spark, d)).groupBy("modality").agg(F.count("*").alias("sentences"))


def clause_tags(spark, d):
    return pv.clause_tags(_sentences(spark, d)).where("tags <> ''").groupBy("tags").agg(F.count("*").alias("sentences"))


def code_references(spark, d):
    return pv.references(table(spark, d, "documents"), ["doc_id"])


def code_reference_spans(spark, d):
    return pv.reference_spans(table(spark, d, "documents").where("text is not null"), "doc_id")


def definition_islands(spark, d):
    """Nodes in span order grouped from one heading to the next: the text of each artifact's runs."""
    s = current(table(spark, d, "source_text_section"), "node_id").where("label is not null or node_type is not null")
    i = pv.islands(s, ["artifact_id"], ["span_start", "node_id"], F.col("node_type").isin("chapter", "section"), F.floor(F.col("span_start") / 20_000))
    return i.groupBy("artifact_id", "island").agg(F.count("*").alias("nodes"), F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return layout.page_lines(table(spark, d, "page_line"))


def recurring_margins(spark, d):
    return layout.recurring_margins(_lines(spark, d), height=400.0, top=0.18, bottom=0.4, share=0.05)


def clean_margins(spark, d):
    lines = _lines(spark, d)
    return layout.clean_margins(lines, layout.recurring_margins(lines, height=400.0, top=0.18, bottom=0.4, share=0.05), height=400.0, top=0.18, bottom=0.4, fixed_top=0.17)


def body_font(spark, d):
    e = current(table(spark, d, "evidence"))
    size = F.expr("try_cast(observed_metadata['font_size'] as double)")
    return layout.weighted_median(e.where("length(trim(text)) >= 20"), "source_id", size, F.least(F.length("text"), F.lit(200)))


def page_order_profile(spark, d):
    return layout.page_order(_lines(spark, d))


def reading_order(spark, d):
    return layout.reading_order(_lines(spark, d))


def spacing_repair_candidates(spark, d):
    """Over the documents, and over part names, some of them with their words run together, as a scanner would."""
    p = table(spark, d, "part").select(F.when(F.col("p_size") == 7, F.translate("p_name", " ", "")).otherwise(F.col("p_name")).alias("text"))
    return layout.spacing_repairs(table(spark, d, "documents").select("text").unionByName(p))


def hyphenation_lexicon(spark, d):
    return layout.hyphenation_lexicon(current(table(spark, d, "evidence")))


_ALL = (provision_parse, provision_modality_counts, clause_tags, code_references, code_reference_spans, definition_islands, recurring_margins, clean_margins, body_font, page_order_profile, reading_order, spacing_repair_candidates, hyphenation_lexicon)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


_EV = "ev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY loaded_at) AS rn FROM evidence) WHERE rn = 1)"
_SENT = r"""sent AS (SELECT doc_id, trim(u.s) AS sentence FROM (SELECT doc_id, string_split(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(text, '\n\s*\n', ' ' || chr(1), 'g'), '[ \t\r\n]+', ' ', 'g')), '([.!?]) +([A-Z0-9(])', '\1' || chr(1) || '\2', 'g'), '([.!?]) +([A-Z0-9(])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS ss FROM documents WHERE text IS NOT NULL), unnest(ss) AS u(s) WHERE trim(u.s) <> '')"""
_PL = "pl AS (SELECT line_id, source_id, pdf_page, text, bbox[1] AS x0, bbox[2] AS y0, bbox[3] AS x1, bbox[4] AS y1 FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY loaded_at) AS rn FROM page_line) WHERE rn = 1)"
_KEY = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[0-9]+', '#', 'g'), '[^a-z#]+', ' ', 'g'), '(#\s*)+', '# ', 'g'), '\s+', ' ', 'g'))"
_WIDE = "(x1 - x0 >= 595.0 * 0.65 OR (x0 <= 595.0 * 0.4 AND x1 >= 595.0 * 0.6))"


def _margins() -> str:
    return f"""{_PL}, mk AS (SELECT *, {_KEY} AS key, CASE WHEN y0 <= 400.0 * 0.18 THEN 'header' WHEN y1 >= 400.0 * 0.6 THEN 'footer' END AS zone FROM pl),
    np AS (SELECT source_id, count(DISTINCT pdf_page) AS n FROM pl GROUP BY 1),
    rm AS (SELECT source_id, zone, key, count(DISTINCT pdf_page) AS pages FROM mk WHERE zone IS NOT NULL AND key <> '' GROUP BY ALL),
    rk AS (SELECT rm.* FROM rm JOIN np USING (source_id) WHERE pages >= greatest(2, ceil(n * 0.05)))"""


def oracle_sql() -> dict[str, str]:
    q = {}
    q["provision_parse"] = r"""WITH s AS (SELECT p_partkey, p_name, p_size, p_brand, p_partkey % 4 AS m, p_partkey % 7 AS a, p_partkey % 5 AS c, p_partkey % 3 AS u, p_partkey % 2 = 0 AS e,
        p_name || ' exceeding ' || p_size || ' ' || CASE p_partkey % 3 WHEN 0 THEN 'feet' WHEN 1 THEN 'sq ft' ELSE 'inches' END || ' in height' || CASE p_partkey % 5 WHEN 0 THEN ' and at least ' || p_size || ' ft in width' WHEN 1 THEN ' or more than ' || p_size || '.5 inches in depth' ELSE '' END AS head,
        CASE p_partkey % 4 WHEN 0 THEN 'shall' WHEN 1 THEN 'must not' WHEN 2 THEN 'may' END AS modal,
        CASE p_partkey % 7 WHEN 0 THEN 'provide ' WHEN 1 THEN 'be equipped throughout with ' WHEN 2 THEN 'be installed ' ELSE 'have regard to ' END AS act FROM part)
      SELECT p_partkey, CASE m WHEN 0 THEN 'requirement' WHEN 1 THEN 'prohibition' WHEN 2 THEN 'permission' ELSE 'unknown' END AS modality,
        CAST(CASE WHEN m < 3 THEN length(head) + 1 END AS INTEGER) AS modal_start, CAST(CASE WHEN m < 3 THEN length(head) + 1 + length(modal) END AS INTEGER) AS modal_end, CASE WHEN m < 3 THEN p_name END AS subject,
        CASE WHEN m < 3 THEN CASE c WHEN 0 THEN 'all_of' WHEN 1 THEN 'any_of' ELSE 'comparison' END END AS condition_type,
        CASE WHEN m < 3 THEN 'height' END AS property, CASE WHEN m < 3 THEN '>' END AS operator, CASE WHEN m < 3 THEN CAST(p_size AS DOUBLE) END AS value,
        CASE WHEN m < 3 THEN CASE u WHEN 0 THEN 'ft' WHEN 1 THEN 'ft2' ELSE 'in' END END AS unit, CASE WHEN m = 3 THEN 0 WHEN c < 2 THEN 2 ELSE 1 END AS n_comparisons,
        CASE WHEN m < 3 THEN act || p_brand || CASE WHEN e THEN '' ELSE '.' END END AS action, CASE WHEN m < 3 THEN CASE a WHEN 0 THEN 'provide' WHEN 1 THEN 'equip' WHEN 2 THEN 'install' ELSE 'have' END END AS verb,
        CASE WHEN m < 3 THEN CASE WHEN a > 2 THEN 'regard to ' ELSE '' END || p_brand END AS object, CASE WHEN m < 3 AND e THEN (p_partkey % 30) || '.4' END AS exception_section,
        CASE WHEN m = 3 THEN 'missing-modality' ELSE '' END AS diagnostics FROM s"""
    q["provision_modality_counts"] = rf"WITH {_SENT}, m AS (SELECT regexp_replace(lower(regexp_extract(sentence, '(?i)\b(shall\s+not|must\s+not|may\s+not|shall|must|may)\b', 1)), '\s+', ' ', 'g') AS w FROM sent) SELECT CASE WHEN w IN ('shall', 'must') THEN 'requirement' WHEN w = 'may' THEN 'permission' WHEN w = '' THEN 'unknown' ELSE 'prohibition' END AS modality, count(*) AS sentences FROM m GROUP BY 1"
    tags = ", ".join(f"CASE WHEN regexp_matches(sentence, '(?i)\\b{p}\\b') THEN '{n}' END" for n, p in pv.TAGS)
    q["clause_tags"] = f"WITH {_SENT} SELECT concat_ws(',', {tags}) AS tags, count(*) AS sentences FROM sent GROUP BY 1 HAVING tags <> ''"
    q["code_references"] = r"SELECT doc_id, lower(string_split(u.h, ' ')[1]) AS kind, string_split(u.h, ' ')[2] AS target, count(*) AS occurrences FROM (SELECT doc_id, regexp_extract_all(text, '(?:^|[^A-Za-z])((?:Table|Figure|Equation|Exception|Section|Article) [0-9]+(?:\.[0-9]+)*)', 1) AS hs FROM documents), unnest(hs) AS u(h) GROUP BY ALL"
    q["definition_islands"] = "WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY loaded_at) AS rn FROM source_text_section) WHERE rn = 1 AND (label IS NOT NULL OR node_type IS NOT NULL)), i AS (SELECT *, sum(CASE WHEN node_type IN ('chapter', 'section') THEN 1 ELSE 0 END) OVER (PARTITION BY artifact_id ORDER BY span_start NULLS FIRST, node_id ROWS UNBOUNDED PRECEDING) AS island FROM s) SELECT artifact_id, CAST(island AS BIGINT) AS island, count(*) AS nodes, min(span_start) AS span_start, max(span_end) AS span_end FROM i GROUP BY artifact_id, i.island"
    q["recurring_margins"] = f"WITH {_margins()} SELECT source_id, zone, key, pages FROM rk"
    q["clean_margins"] = f"WITH {_margins()} SELECT line_id, CASE WHEN y0 <= 400.0 * 0.18 AND EXISTS (SELECT 1 FROM rk WHERE rk.source_id = mk.source_id AND rk.key = mk.key AND rk.zone = 'header') THEN 'recurring_header' WHEN y1 >= 400.0 * 0.6 AND EXISTS (SELECT 1 FROM rk WHERE rk.source_id = mk.source_id AND rk.key = mk.key AND rk.zone = 'footer') THEN 'recurring_footer' WHEN y1 <= 400.0 * 0.17 THEN 'fixed_header' WHEN y0 >= 400.0 * 0.945 THEN 'fixed_footer' END AS reason FROM mk"
    q["body_font"] = f"WITH {_EV}, w AS (SELECT source_id, TRY_CAST(observed_metadata['font_size'] AS DOUBLE) AS v, least(length(text), 200) AS w FROM ev WHERE length(trim(text)) >= 20), r AS (SELECT source_id, unnest(list_resize([v], w, v)) AS v FROM w WHERE v IS NOT NULL) SELECT source_id, round(median(v), 3) AS body, round(round(median(v), 3) * 1.15, 3) AS threshold FROM r GROUP BY 1"
    q["page_order_profile"] = f"WITH {_PL} SELECT source_id, pdf_page, count(*) AS lines, count(*) FILTER ({_WIDE}) AS wide_lines, count(*) FILTER (NOT {_WIDE} AND x0 < 297.5) AS left_lines, count(*) FILTER (NOT {_WIDE} AND x0 >= 297.5) AS right_lines, quantile_cont(x0, 0.5) AS x_median, quantile_cont(x1 - x0, 0.75) AS width_p75, left_lines >= 4 AND right_lines >= 4 AND wide_lines * 2 <= lines AS two_columns FROM pl WHERE pdf_page IS NOT NULL AND x0 IS NOT NULL GROUP BY ALL"
    q["reading_order"] = f"WITH {_PL}, b AS (SELECT *, {_WIDE} AS wide, sum(CASE WHEN {_WIDE} THEN 2 ELSE 0 END) OVER (PARTITION BY source_id, pdf_page ORDER BY y0, x0, line_id ROWS UNBOUNDED PRECEDING) - CASE WHEN {_WIDE} THEN 1 ELSE 0 END AS band FROM pl WHERE pdf_page IS NOT NULL AND x0 IS NOT NULL) SELECT line_id, source_id, pdf_page, CAST(row_number() OVER (PARTITION BY source_id, pdf_page ORDER BY band, CASE WHEN wide THEN 0 WHEN x0 < 297.5 THEN 1 ELSE 2 END, y0, x0, line_id) AS INTEGER) AS reading_no FROM b"
    hit = r"(^|[^A-Za-z])(Table|Figure|Equation|Exception|Section|Article) [0-9]+(\.[0-9]+)*"
    q["code_reference_spans"] = f"""WITH h AS (SELECT doc_id, regexp_extract_all(text, '{hit}') AS hits, string_split_regex(text, '{hit}') AS gaps FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, unnest(range(1, len(hits) + 1)) AS n, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap FROM h),
    e AS (SELECT doc_id, n, hit, regexp_replace(hit, '^[^A-Za-z]', '') AS own, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY n) AS "end" FROM u)
    SELECT doc_id, lower(split_part(own, ' ', 1)) AS kind, split_part(own, ' ', 2) AS target, CAST("end" - length(own) AS INTEGER) AS "start", CAST("end" AS INTEGER) AS "end" FROM e"""
    pre = ", ".join(f"'{p}'" for p in layout.PREFIXES)
    q["spacing_repair_candidates"] = f"""WITH t AS (SELECT regexp_extract_all(lower(text), '[a-z]+') AS t FROM (SELECT text FROM documents UNION ALL SELECT CASE p_size WHEN 7 THEN replace(p_name, ' ', '') ELSE p_name END FROM part) WHERE text IS NOT NULL), w AS (SELECT u.x AS token, count(*) AS n FROM t, unnest(t.t) AS u(x) WHERE length(u.x) >= 5 GROUP BY 1),
    p AS (SELECT t.t[u.i] AS l, t.t[u.i + 1] AS r, count(*) AS pairs FROM t, unnest(range(1, len(t.t))) AS u(i) GROUP BY 1, 2 HAVING pairs >= 2),
    s AS (SELECT token, n, token[1:u.i] AS l, token[u.i + 1:] AS r FROM w, unnest(range(2, length(token) - 1)) AS u(i)),
    k AS (SELECT s.token, s.l, s.r, p.pairs, least(length(s.l), length(s.r)) AS bal FROM s JOIN p USING (l, r) WHERE p.pairs >= 2 * s.n AND s.l NOT IN ({pre}))
    SELECT token, l AS "left", r AS "right", pairs FROM k QUALIFY row_number() OVER (PARTITION BY token ORDER BY pairs DESC, bal DESC, l DESC, r DESC) = 1"""
    q["hyphenation_lexicon"] = rf"""WITH {_EV}, b AS (SELECT text FROM ev WHERE text IS NOT NULL), c AS (SELECT DISTINCT lower(string_split(u.c, '-' || chr(10))[1]) AS a, string_split(u.c, '-' || chr(10))[2] AS b FROM (SELECT regexp_extract_all(text, '[A-Za-z]+-\n[a-z]+') AS cs FROM b), unnest(cs) AS u(c)),
    f AS (SELECT lower(replace(text, '-' || chr(10), ' ')) AS f FROM b), p AS (SELECT u.x, count(*) AS n FROM (SELECT regexp_extract_all(f, '[a-z]+') AS xs FROM f), unnest(xs) AS u(x) GROUP BY 1), h AS (SELECT u.x, count(*) AS n FROM (SELECT regexp_extract_all(f, '[a-z]+-[a-z]+') AS xs FROM f), unnest(xs) AS u(x) GROUP BY 1)
    SELECT a || b AS joined, a || '-' || b AS hyphenated, coalesce(p.n, 0) AS plain_count, coalesce(h.n, 0) AS hyphen_count FROM c LEFT JOIN p ON p.x = a || b LEFT JOIN h ON h.x = a || '-' || b"""
    return q
