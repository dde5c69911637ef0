"""Evidence queries with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import ids, locators
from ..operators import evidence as ev
from ..session import shared_folder, table

PHRASE, TOKENS, SOURCE = "shall be", "exit handrail", "synthetic:standard:000000"


def _ev(spark: SparkSession, d: str) -> DataFrame:
    return ev.current(table(spark, d, "evidence"))


def evidence_lines(spark, d):
    return ev.lines(_ev(spark, d))


def evidence_ids(spark, d):
    e = _ev(spark, d)
    return e.select("evidence_id", ids.evidence_id(F.col("source_sha256"), F.col("pdf_page"), F.col("block_index"), F.col("bbox")).alias("stable_id"), ids.short_id("block", F.col("evidence_id")).alias("short_id"))


def search_exact(spark, d):
    return ev.search_exact(_ev(spark, d), "Exception")


def search_phrase(spark, d):
    return ev.search_phrase(_ev(spark, d), PHRASE)


def search_token(spark, d):
    return ev.search_tokens(_ev(spark, d), TOKENS)


def search_bm25(spark, d):
    return ev.search_ranked(table(spark, d, "documents"), "exit stairway exit", "doc_id")


def search_index(spark, d):
    """Over an index of postings that is written first and read by its terms' folders."""
    path = f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}"
    ev.write_postings(ev.postings(table(spark, d, "documents"), "doc_id"), path)
    return ev.search_postings(ev.read_postings(spark, path, "exit stairway door"), "exit stairway door", "doc_id")


def search_bm25_all(spark, d):
    return ev.search_all_tokens_ranked(_ev(spark, d), "exit door")


def context_expand(spark, d):
    return ev.with_context(_ev(spark, d).where("pdf_page is not null"), 1, 2, page_local=True)


def page_fetch(spark, d):
    return ev.page_rows(_ev(spark, d).select("evidence_id", "source_id", "pdf_page", "block_index", "text"), SOURCE, 4)


def structural_flags(spark, d):
    return ev.structural(_ev(spark, d))


def structural_search(spark, d):
    return ev.structural_search(_ev(spark, d), "the", first_page=2, last_page=30, min_font=9.5)


def grounding_packet(spark, d):
    return ev.grounding_packet(_ev(spark, d).where("pdf_page is not null"), "handrail", limit=20)


def citation_check(spark, d):
    e = _ev(spark, d).where("pdf_page is not null")
    return ev.check_citations(ev.grounding_packet(e, "handrail", limit=20), e.where(F.col("text").contains("landing")).select(F.col("evidence_id").alias("citation")))


def page_bounds(spark, d):
    """Union box of each page: the outermost coordinates of its blocks."""
    e = _ev(spark, d).where("bbox is not null and pdf_page is not null")
    at = lambda i: F.get("bbox", F.lit(i))
    return e.groupBy("source_id", "pdf_page").agg(F.min(at(0)).alias("x0"), F.min(at(1)).alias("y0"), F.max(at(2)).alias("x1"), F.max(at(3)).alias("y1"))


def page_coverage(spark, d):
    """Pages between a source's first and last one of evidence that lack scanned lines, for the sources that have such lines."""
    e = table(spark, d, "evidence").where("pdf_page is not null")
    lines = table(spark, d, "page_line").select("source_id", "pdf_page").distinct()
    span = e.groupBy("source_id").agg(F.min("pdf_page").alias("a"), F.max("pdf_page").alias("b")).join(lines.select("source_id").distinct(), "source_id", "left_semi")
    every = span.select("source_id", F.explode(F.sequence("a", "b")).alias("pdf_page"))
    return every.join(lines, ["source_id", "pdf_page"], "left_anti")


def block_text(spark, d):
    """Blocks as running text."""
    return _ev(spark, d).where("text is not null").select("evidence_id", locators.normalized_block(F.col("text")).alias("text"))


def publication_summary(spark, d):
    """Blocks, pages and methods of each publication, with totals (grouping sets)."""
    return _ev(spark, d).cube("publication_key", "extraction_method").agg(F.count("*").alias("blocks"), F.countDistinct("pdf_page").alias("pages")).select("publication_key", "extraction_method", "blocks", "pages")


_ALL = (evidence_lines, evidence_ids, search_exact, search_phrase, search_token, search_bm25, search_index, search_bm25_all, context_expand, page_fetch, structural_flags, structural_search, grounding_packet, citation_check, page_bounds, page_coverage, block_text, publication_summary)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


_EV = "ev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY loaded_at) AS rn FROM evidence) WHERE rn = 1)"
_O = "source_id, pdf_page, block_index, evidence_id"


def _count(text: str, needle: str) -> str:
    return f"CAST((length({text}) - length(replace({text}, '{needle}', ''))) // {len(needle)} AS INTEGER)"


def _bm25(docs: str, key: str, tokens: list[str], k1: float, b: float, plus1: bool, where: str = "true") -> str:
    distinct = list(dict.fromkeys(tokens))
    tf = lambda t: f"len(list_filter(t, lambda x: x = '{t}'))"
    dfs = ", ".join(f"count(*) FILTER (list_contains(t, '{t}')) AS df_{t}" for t in distinct)
    idf = (lambda t: f"ln(1.0 + (n - df_{t} + 0.5) / (df_{t} + 0.5))") if plus1 else (lambda t: f"greatest(ln((n - df_{t} + 0.5) / (df_{t} + 0.5)), 1e-6)")
    score = " + ".join(f"{idf(t)} * {tf(t)} * {k1 + 1} / ({tf(t)} + {k1} * ({1 - b} + {b} * len(t) / av))" for t in tokens)
    return f"""d AS (SELECT {key}, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM {docs}),
    s AS (SELECT count(*) AS n, sum(len(t)) / count(*) AS av, {dfs} FROM d),
    r AS (SELECT {key}, t, {score} AS bm FROM d, s WHERE {where})"""


def oracle_sql() -> dict[str, str]:
    q = {}
    q["evidence_lines"] = f"WITH {_EV}, l AS (SELECT evidence_id, string_split(text, chr(10)) AS ls FROM ev WHERE text IS NOT NULL) SELECT evidence_id, CAST(u.i AS INTEGER) AS line_no, ls[u.i] AS line, sha256(ls[u.i]) AS text_sha256 FROM l, unnest(range(1, len(ls) + 1)) AS u(i)"
    q["evidence_ids"] = f"""WITH {_EV} SELECT evidence_id, 'evidence:sha256:' || sha256('{{"bbox":' || CASE WHEN bbox IS NULL THEN 'null' ELSE '[' || array_to_string(list_transform(bbox, lambda x: printf('%.3f', x)), ',') || ']' END || ',"block_index":' || coalesce(CAST(block_index AS VARCHAR), 'null') || ',"pdf_page":' || coalesce(CAST(pdf_page AS VARCHAR), 'null') || ',"source_sha256":' || coalesce('"' || source_sha256 || '"', 'null') || '}}') AS stable_id, 'block:' || substr(sha256('block|' || evidence_id), 1, 24) AS short_id FROM ev"""
    q["search_exact"] = f"WITH {_EV} SELECT {_O}, CAST({_count('text', 'Exception')} AS DOUBLE) AS score, 'literal_occurrence_count' AS score_method FROM ev WHERE contains(text, 'Exception')"
    q["search_phrase"] = f"WITH {_EV} SELECT {_O}, CAST({_count('lower(text)', PHRASE)} AS DOUBLE) AS score, 'casefold_phrase_occurrence_count' AS score_method FROM ev WHERE contains(lower(text), '{PHRASE}')"
    q["search_token"] = f"WITH {_EV} SELECT {_O}, ({_count('lower(text)', 'exit')} + {_count('lower(text)', 'handrail')}) / 2.0::DOUBLE AS score, 'token_coverage_fallback' AS score_method FROM ev WHERE contains(lower(text), 'exit') AND contains(lower(text), 'handrail')"
    q["search_bm25"] = f"WITH {_bm25('documents', 'doc_id', ['exit', 'stairway', 'exit'], 1.4, 0.75, True)} SELECT doc_id, round(bm + CASE WHEN contains(' ' || array_to_string(t, ' ') || ' ', 'exit stairway exit') THEN 8.0 ELSE 0.0 END, 6) AS score FROM r WHERE round(bm, 6) > 0"
    q["search_index"] = f"WITH {_bm25('documents', 'doc_id', ['exit', 'stairway', 'door'], 1.4, 0.75, True)} SELECT doc_id, round(bm, 6) AS score FROM r WHERE round(bm, 6) > 0"
    q["search_bm25_all"] = f"WITH {_EV}, {_bm25('ev', _O, ['exit', 'door'], 1.2, 0.75, False)} SELECT {_O}, round(greatest(bm, 0.0), 6) AS score, 'bm25' AS score_method FROM r WHERE list_contains(t, 'exit') AND list_contains(t, 'door')"
    win = "OVER (PARTITION BY source_id, pdf_page ORDER BY pdf_page, block_index, evidence_id ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING)"
    q["context_expand"] = f"WITH {_EV} SELECT evidence_id, source_id, pdf_page, block_index, array_to_string(list(evidence_id) {win}, ',') AS context FROM ev WHERE pdf_page IS NOT NULL"
    q["page_fetch"] = f"WITH {_EV} SELECT evidence_id, source_id, pdf_page, block_index, text FROM ev WHERE source_id = '{SOURCE}' AND pdf_page = 4"
    head = "length(trim(text)) > 0 AND length(trim(text)) <= 120 AND length(trim(text)) - length(replace(trim(text), chr(10), '')) <= 1 AND length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > 0 AND length(regexp_replace(text, '[^A-Z]', '', 'g')) >= 0.8 * length(regexp_replace(text, '[^A-Za-z]', '', 'g'))"
    flags = ", ".join(f"coalesce(starts_with(lower(trim(text)), '{k}'), false) AS \"{k}\"" for k in ("table", "figure", "equation", "exception"))
    q["structural_flags"] = f"WITH {_EV} SELECT evidence_id, source_id, pdf_page, block_index, round(bbox[1] / 595.0, 6) AS x_fraction, round(bbox[2] / 842.0, 6) AS y_fraction, round((bbox[3] - bbox[1]) / 595.0, 6) AS width_fraction, round((bbox[4] - bbox[2]) / 842.0, 6) AS height_fraction, TRY_CAST(observed_metadata['font_size'] AS DOUBLE) AS font_size, coalesce({head}, false) AS heading, {flags} FROM ev"
    q["structural_search"] = f"WITH {_EV} SELECT {_O}, CAST({_count('lower(text)', 'the')} AS DOUBLE) AS score, 'casefold_phrase_occurrence_count' AS score_method FROM ev WHERE contains(lower(text), 'the') AND pdf_page BETWEEN 2 AND 30 AND TRY_CAST(observed_metadata['font_size'] AS DOUBLE) >= 9.5"
    hits = f"{_EV}, e2 AS (SELECT * FROM ev WHERE pdf_page IS NOT NULL), h AS (SELECT evidence_id, row_number() OVER (ORDER BY {_O}) AS rank FROM e2 WHERE contains(lower(text), 'handrail') QUALIFY rank <= 20), c AS (SELECT evidence_id, array_to_string(list(evidence_id) OVER (PARTITION BY source_id ORDER BY pdf_page, block_index, evidence_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), ',') AS context FROM e2)"
    q["grounding_packet"] = f"WITH {hits} SELECT h.evidence_id AS hit_id, CAST(rank AS INTEGER) AS rank, context FROM h JOIN c USING (evidence_id)"
    q["citation_check"] = f"WITH {hits} SELECT evidence_id AS citation, evidence_id IN (SELECT unnest(string_split(context, ',')) FROM c JOIN h USING (evidence_id)) AS supported FROM e2 WHERE contains(text, 'landing')"
    q["page_bounds"] = f"WITH {_EV} SELECT source_id, pdf_page, min(bbox[1]) AS x0, min(bbox[2]) AS y0, max(bbox[3]) AS x1, max(bbox[4]) AS y1 FROM ev WHERE bbox IS NOT NULL AND pdf_page IS NOT NULL GROUP BY ALL"
    q["page_coverage"] = "SELECT source_id, CAST(u.p AS INTEGER) AS pdf_page FROM (SELECT source_id, range(min(pdf_page), max(pdf_page) + 1) AS ps FROM evidence WHERE source_id IN (SELECT source_id FROM page_line) GROUP BY 1) s, unnest(ps) AS u(p) WHERE NOT EXISTS (SELECT 1 FROM page_line e WHERE e.source_id = s.source_id AND e.pdf_page = u.p)"
    q["block_text"] = f"WITH {_EV} SELECT evidence_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '([A-Za-z])-\\n([a-z])', '\\1\\2', 'g'), '[ \\t\\n]+', ' ', 'g')) AS text FROM ev WHERE text IS NOT NULL"
    q["publication_summary"] = f"WITH {_EV} SELECT publication_key, extraction_method, count(*) AS blocks, count(DISTINCT pdf_page) AS pages FROM ev GROUP BY CUBE (publication_key, extraction_method)"
    return q
