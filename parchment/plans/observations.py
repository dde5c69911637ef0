"""Queries on observed lines and boxes with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import locator
from ..operators import layout, observations as ob
from ..operators.evidence import current
from ..session import table


def _found(spark: SparkSession, d: str) -> DataFrame:
    """Evidence's first lines that bear an observation, in source order."""
    e = current(table(spark, d, "evidence")).where("text is not null and pdf_page is not null and block_index is not null and source_id is not null")
    return ob.observed(e.select("evidence_id", "source_id", "pdf_page", "block_index", F.split("text", "\n")[0].alias("text"))).drop("text")


def observed_lines(spark, d):
    return _found(spark, d)


def observed_hierarchy(spark, d):
    f = _found(spark, d)
    return ob.observed_hierarchy(f, ["source_id"], ["pdf_page", "block_index", "evidence_id"], "evidence_id", F.floor(F.col("pdf_page") / 64)).select("evidence_id", "kind", "number", "parent")


def chapter_lines(spark, d):
    """Scanned lines with the chapter or section last named before them in their source."""
    lines = layout.page_lines(table(spark, d, "page_line")).where("source_id is not null and pdf_page is not null")
    named = F.regexp_extract(F.upper(F.trim("text")), r"^CHAPTER +([0-9]+)", 1)
    r = ob.carry_forward(lines, ["source_id"], ["pdf_page", "y0", "line_id"], F.when(named != "", named), "chapter", F.floor(F.col("pdf_page") / 64))
    return r.select("line_id", "chapter")


def _scattered(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of orders' items in rows: a keyword, its number beside it, sometimes a second number or a far one."""
    li = table(spark, d, "lineitem")
    text = F.when(F.col("l_linenumber") == 1, F.when(F.col("l_orderkey") % 2 == 0, "Table").otherwise("figure")).when(F.col("l_linenumber") == 2, F.concat(F.col("l_suppkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"))).when((F.col("l_linenumber") == 3) & (F.col("l_orderkey") % 5 == 0), "7.3").otherwise("word")
    x0 = F.when(F.col("l_linenumber") == 1, 40.0).when(F.col("l_linenumber") == 2, F.when(F.col("l_orderkey") % 3 == 0, 120.0).otherwise(76.0)).when(F.col("l_linenumber") == 3, 78.0).otherwise(200.0)
    y0 = (F.col("l_orderkey") % 40) * 15.0
    return li.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.lit("made").alias("source_id"), F.floor(F.col("l_orderkey") / 40).cast("int").alias("pdf_page"), text.alias("text"), x0.alias("x0"), y0.alias("y0"), (x0 + 30).alias("x1"), (y0 + 9).alias("y1"))


def split_captions(spark, d):
    return ob.split_captions(_scattered(spark, d), "id")


def drawing_regions(spark, d):
    """Parts as drawn boxes of their size and price."""
    p = table(spark, d, "part")
    w, h = F.when(F.col("p_size") % 10 == 0, 1.0).otherwise(F.col("p_size") * 12.0), F.when(F.col("p_size") % 7 == 0, 1.5).otherwise(F.col("p_partkey") % 900 + 0.0)
    boxes = p.select("p_partkey", F.lit(10.0).alias("x0"), h.alias("y0"), (F.lit(10.0) + w).alias("x1"), F.lit(0.0).alias("y1"))
    return ob.drawings(boxes, 612.0, 792.0).groupBy("shape", "disposition", "reason").agg(F.count("*").alias("boxes"))


def adapter_gate(spark, d):
    """Sources of evidence held against what was registered with their first block."""
    e = table(spark, d, "evidence").where("source_id is not null").select("source_id", F.col("source_sha256").alias("sha256"), F.split_part("extraction_method", F.lit("/"), F.lit(1)).alias("method"))
    registered = table(spark, d, "evidence").where("source_id is not null and source_id not like '%1'").groupBy("source_id").agg(F.min("source_sha256").alias("sha256"), F.min(F.split_part("extraction_method", F.lit("/"), F.lit(1))).alias("method"))
    return ob.gate(e, registered, "source_id", ["sha256", "method"])


def recovery_entries(spark, d):
    """Evidence texts as searchable entries with the hash that a recovery is verified by."""
    e = current(table(spark, d, "evidence")).where("text is not null and text <> ''")
    return e.select("evidence_id", "source_id", F.col("pdf_page").alias("page_number"), F.sha2("text", 256).alias("text_sha256"), F.when(F.col("extraction_method").startswith("ocr"), "recovered").otherwise("embedded").alias("text_origin"))


def cell_findings(spark, d):
    """Orders as rows, their items as fragments; items of one supplier parity are left out of the cells, and some stand twice."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity").distinct()
    cells = li.where("l_suppkey % 7 <> 0").select("l_orderkey", "l_linenumber")
    cells = cells.unionByName(li.where("l_quantity = 5").select("l_orderkey", "l_linenumber")).unionByName(li.where("l_quantity = 11").select("l_orderkey", (F.col("l_linenumber") + 100).alias("l_linenumber")))
    return ob.cell_findings(cells, li.select("l_orderkey", "l_linenumber"), ["l_orderkey"], "l_linenumber")


MARKERS = {"mandatory": ("shall be", "shall not be"), "permissive": ("is permitted", "may still"), "explanatory": ("for guidance only", "values in the table"), "editorial": ("in the edition of", "was rewritten"), "reference": ("see section", "as shown in")}


def language_markers(spark, d):
    return ob.phrases_at(table(spark, d, "documents"), "doc_id", "text", MARKERS)


def page_roles(spark, d):
    return ob.page_roles(current(table(spark, d, "evidence")))


_REL = ["source_artifact_id", "source_key", "target_artifact_id", "target_key", "relation_type"]


def finalized_relations(spark, d):
    r = table(spark, d, "reference_relation").select("source_artifact_id", locator(F.col("source_locator")).alias("source_key"), "target_artifact_id", locator(F.col("target_locator")).alias("target_key"), "relation_type", "recorded_at")
    n = table(spark, d, "source_text_section").where("deleted_at is null").select(F.col("artifact_id").alias("owner"), locator(F.col("locator")).alias("key"), "node_id")
    f = ob.finalized_relations(r, n, _REL, "recorded_at", "target_artifact_id", "target_key")
    return f.withColumn("recorded_at", F.date_format("recorded_at", "yyyy-MM-dd"))


def case_receipt(spark, d):
    """For each publication, how many reviewed records the other copy confirms, lacks or tells otherwise."""
    from .general import p3_fields

    from ..operators.copies import HIERARCHY_VALUES, hierarchy_rows, latest

    e = latest(hierarchy_rows(table(spark, d, "hierarchy_expected")), ["publication_key", "locator"], HIERARCHY_VALUES, "loaded_at").select("publication_key", "locator")
    f = p3_fields(spark, d).where("code <> 'unexpected-locator'").groupBy("publication_key", "locator").agg(F.max(F.col("code") == "missing-locator").alias("gone"))
    g = e.join(f, ["publication_key", "locator"], "left").groupBy("publication_key")
    return g.agg(F.count("*").alias("records"), F.count_if(F.col("gone").isNull()).alias("confirmed"), F.count_if(F.coalesce("gone", F.lit(False))).alias("lacking"), F.count_if(~F.coalesce("gone", F.lit(True))).alias("otherwise"))


def document_receipts(spark, d):
    """Aggregates that tell a source's material without any of its text."""
    e = current(table(spark, d, "evidence"))
    return e.groupBy("source_id").agg(F.count("*").alias("blocks"), F.countDistinct("pdf_page").alias("pages"), F.sum(F.length("text")).alias("characters"), F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("empty"), F.count_if(F.col("text").contains("\n")).alias("of_several_lines"), F.countDistinct("extraction_method").alias("methods"))


_ALL = (observed_lines, observed_hierarchy, chapter_lines, split_captions, drawing_regions, adapter_gate, recovery_entries, cell_findings, language_markers, page_roles, finalized_relations, case_receipt, document_receipts)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


_EV = "ev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY loaded_at) AS rn FROM evidence WHERE evidence_id IS NOT NULL) WHERE rn = 1)"
_LOC = "lower(regexp_replace({0}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'))"


def _case(f) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN {f(k, n, p)}" for k, n, p in ob.RULES) + " END"


def oracle_sql() -> dict[str, str]:
    q = {}
    kind, level = _case(lambda k, n, p: f"'{k}'"), _case(lambda k, n, p: str(n))
    number, title = _case(lambda k, n, p: f"regexp_extract(t, '{p}', 1)"), _case(lambda k, n, p: f"nullif(regexp_extract(t, '{p}', 2), '')")
    found = f"""{_EV}, line AS (SELECT evidence_id, source_id, pdf_page, block_index, trim(string_split(text, chr(10))[1]) AS t FROM ev WHERE text IS NOT NULL AND pdf_page IS NOT NULL AND block_index IS NOT NULL AND source_id IS NOT NULL),
    found AS (SELECT * FROM (SELECT evidence_id, source_id, pdf_page, block_index, {kind} AS kind, {level} AS level, {number} AS number, {title} AS title FROM line) WHERE kind IS NOT NULL)"""
    q["observed_lines"] = f"WITH {found} SELECT * FROM found"
    last = ", ".join(f"last_value(CASE WHEN level = {n} THEN evidence_id END IGNORE NULLS) OVER w AS l{n}, last_value(CASE WHEN level = {n} THEN r END IGNORE NULLS) OVER w AS r{n}" for n in (1, 2, 3))
    may = lambda n: f"CASE WHEN level = 0 OR level > {n} THEN coalesce(r{n}, 0) ELSE 0 END"
    q["observed_hierarchy"] = f"""WITH {found}, n AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY pdf_page, block_index, evidence_id) AS r FROM found), c AS (SELECT *, {last} FROM n WINDOW w AS (PARTITION BY source_id ORDER BY r)),
    m AS (SELECT *, greatest({may(1)}, {may(2)}, {may(3)}) AS best FROM c) SELECT evidence_id, kind, number, CASE WHEN best = 0 THEN NULL WHEN best = r1 THEN l1 WHEN best = r2 THEN l2 WHEN best = r3 THEN l3 END AS parent FROM m"""
    q["chapter_lines"] = """WITH pl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY loaded_at) AS rn FROM page_line WHERE line_id IS NOT NULL) WHERE rn = 1 AND source_id IS NOT NULL AND pdf_page IS NOT NULL)
    SELECT line_id, last_value(nullif(regexp_extract(upper(trim(text)), '^CHAPTER +([0-9]+)', 1), '') IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY pdf_page, bbox[2] NULLS FIRST, line_id ROWS UNBOUNDED PRECEDING) AS chapter FROM pl"""
    q["split_captions"] = """WITH b AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, CAST(l_orderkey // 40 AS INTEGER) AS pdf_page, CASE WHEN l_linenumber = 1 THEN CASE WHEN l_orderkey % 2 = 0 THEN 'Table' ELSE 'figure' END WHEN l_linenumber = 2 THEN l_suppkey || '.' || l_linenumber WHEN l_linenumber = 3 AND l_orderkey % 5 = 0 THEN '7.3' ELSE 'word' END AS t,
      CASE WHEN l_linenumber = 1 THEN 40.0 WHEN l_linenumber = 2 THEN CASE WHEN l_orderkey % 3 = 0 THEN 120.0 ELSE 76.0 END WHEN l_linenumber = 3 THEN 78.0 ELSE 200.0 END AS x0, (l_orderkey % 40) * 15.0 AS y0 FROM lineitem)
    SELECT a.id, 'made' AS source_id, a.pdf_page, lower(a.t) AS kind, min(o.t) AS number FROM b a JOIN b o ON a.pdf_page = o.pdf_page AND o.x0 >= a.x0 + 30 AND o.x0 - (a.x0 + 30) <= 12 AND least(a.y0, o.y0) + 9 > greatest(a.y0, o.y0) WHERE lower(a.t) IN ('table', 'figure') AND regexp_matches(o.t, '^[A-Za-z]?[0-9]+(\\.[0-9]+)*$') GROUP BY a.id, a.pdf_page, a.t HAVING count(*) = 1"""
    q["drawing_regions"] = """WITH b AS (SELECT CASE WHEN p_size % 10 = 0 THEN 1.0 ELSE p_size * 12.0 END AS w, CASE WHEN p_size % 7 = 0 THEN 1.5 ELSE p_partkey % 900 END AS h FROM part),
    s AS (SELECT w, h, CASE WHEN w <= 2 AND h <= 2 THEN 'dot' WHEN h <= 2 THEN 'rule' WHEN w <= 2 THEN 'upright' ELSE 'region' END AS shape FROM b),
    r AS (SELECT shape, CASE WHEN w * h >= 0.85 * 612 * 792 THEN 'page-frame' WHEN shape = 'dot' THEN 'too-small' WHEN shape = 'region' AND w * h < 0.0005 * 612 * 792 THEN 'glyph-outline' END AS reason FROM s)
    SELECT shape, CASE WHEN reason IS NULL THEN 'content' ELSE 'left-out' END AS disposition, reason, count(*) AS boxes FROM r GROUP BY ALL"""
    q["adapter_gate"] = """WITH e AS (SELECT source_id, min(source_sha256) AS a, max(source_sha256) AS b, min(split_part(extraction_method, '/', 1)) AS m, max(split_part(extraction_method, '/', 1)) AS n FROM evidence WHERE source_id IS NOT NULL GROUP BY 1),
    w AS (SELECT source_id, CASE WHEN source_id LIKE '%1' THEN 'unregistered' ELSE concat_ws(',', CASE WHEN a IS DISTINCT FROM b THEN 'sha256' END, CASE WHEN m IS DISTINCT FROM n THEN 'method' END) END AS reasons FROM e) SELECT source_id, reasons = '' AS admitted, reasons FROM w"""
    q["recovery_entries"] = f"WITH {_EV} SELECT evidence_id, source_id, pdf_page AS page_number, sha256(text) AS text_sha256, CASE WHEN starts_with(extraction_method, 'ocr') THEN 'recovered' ELSE 'embedded' END AS text_origin FROM ev WHERE text <> ''"
    q["cell_findings"] = """WITH li AS (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey, l_quantity FROM lineitem), c AS (SELECT l_orderkey, l_linenumber FROM li WHERE l_suppkey % 7 <> 0 UNION ALL SELECT l_orderkey, l_linenumber FROM li WHERE l_quantity = 5 UNION ALL SELECT l_orderkey, l_linenumber + 100 FROM li WHERE l_quantity = 11),
    h AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM c GROUP BY 1, 2), f AS (SELECT DISTINCT l_orderkey, l_linenumber, true AS own FROM li), j AS (SELECT * FROM f FULL JOIN h USING (l_orderkey, l_linenumber))
    SELECT l_orderkey, l_linenumber, CASE WHEN own IS NULL THEN 'outside-its-row' WHEN n IS NULL THEN 'in-no-cell' ELSE 'in-several-cells' END AS code FROM j WHERE own IS NULL OR n IS NULL OR n > 1"""
    q["language_markers"] = " UNION ALL ".join("SELECT doc_id, '{0}' AS marker, CAST(least({1}) - 1 AS INTEGER) AS \"start\" FROM documents WHERE {2}".format(m, ", ".join(f"coalesce(nullif(instr(lower(text), '{p}'), 0), 2147483647)" for p in ps), " OR ".join(f"instr(lower(text), '{p}') > 0" for p in ps)) for m, ps in MARKERS.items())
    q["page_roles"] = f"WITH {_EV} SELECT source_id, pdf_page, CASE WHEN count(*) FILTER (coalesce(trim(text), '') <> '') = 0 THEN 'image' WHEN max(length(trim(text))) < 60 THEN 'heading' ELSE 'text' END AS role FROM ev WHERE pdf_page IS NOT NULL GROUP BY 1, 2"
    q["finalized_relations"] = f"""WITH r AS (SELECT source_artifact_id, {_LOC.format('source_locator')} AS source_key, target_artifact_id, {_LOC.format('target_locator')} AS target_key, relation_type, max(recorded_at) AS recorded_at FROM reference_relation GROUP BY ALL),
    n AS (SELECT artifact_id, {_LOC.format('locator')} AS k, min(node_id) AS target_node FROM source_text_section WHERE deleted_at IS NULL GROUP BY 1, 2)
    SELECT source_artifact_id, source_key, target_artifact_id, target_key, relation_type, strftime(recorded_at, '%Y-%m-%d') AS recorded_at, target_node, target_node IS NOT NULL AS resolved FROM r LEFT JOIN n ON r.target_artifact_id = n.artifact_id AND r.target_key = n.k"""
    from .general import _hier, _p3_fields

    q["case_receipt"] = f"""WITH {_hier('e0', 'hierarchy_expected')}, f AS (SELECT publication_key, locator, bool_or(code = 'missing-locator') AS gone FROM ({_p3_fields()}) WHERE code <> 'unexpected-locator' GROUP BY 1, 2)
    SELECT publication_key, count(*) AS records, count(*) FILTER (gone IS NULL) AS confirmed, count(*) FILTER (gone) AS lacking, count(*) FILTER (NOT gone) AS otherwise FROM e0 LEFT JOIN f USING (publication_key, locator) GROUP BY 1"""
    q["document_receipts"] = f"WITH {_EV} SELECT source_id, count(*) AS blocks, count(DISTINCT pdf_page) AS pages, CAST(sum(length(text)) AS BIGINT) AS characters, count(*) FILTER (text IS NULL OR text = '') AS empty, count(*) FILTER (contains(text, chr(10))) AS of_several_lines, count(DISTINCT extraction_method) AS methods FROM ev GROUP BY 1"
    return q
