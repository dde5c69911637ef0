"""Inventory, join, interval, graph, geometry and vector queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import locators
from ..functions.text import locator
from ..operators import geometry, graphs, layout, provisions as pv, relations as rel, vectors
from ..operators.evidence import current
from ..session import table


def _targets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_text_section").select("node_id", F.col("artifact_id").alias("owner"), locator(F.col("locator")).alias("key")).distinct().drop("node_id")


def _refs(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reference_relation").select("relation_id", "relation_type", "source_artifact_id", locator(F.col("source_locator")).alias("source_key"), F.col("target_artifact_id").alias("owner"), locator(F.col("target_locator")).alias("key")).distinct()
    return r.where("not coalesce(key, '') like 'external:%'")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return _refs(spark, d).where("key is not null and owner is not null").select(F.concat_ws("#", "source_artifact_id", "source_key").alias("source"), F.concat_ws("#", "owner", "key").alias("target"))


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    return rel.resolve(_refs(spark, d).select("relation_id", "owner", "key"), _targets(spark, d))


def crossref_resolve(spark, d):
    return _resolved(spark, d).select("relation_id", "state")


def crossref_reconcile(spark, d):
    return rel.reconcile(_resolved(spark, d), _targets(spark, d)).select("relation_id", "final_state", "reason")


def crossref_summary(spark, d):
    return rel.in_degree(_edges(spark, d), 50)


def crossref_two_cycles(spark, d):
    return rel.two_cycles(_edges(spark, d))


def crosschecks_anti(spark, d):
    ref = _refs(spark, d).where("key is not null and owner is not null").select(F.concat_ws("#", "owner", "key").alias("place"))
    return rel.unmatched(_targets(spark, d).select(F.concat_ws("#", "owner", "key").alias("place")), ref, "place")


def external_alias_match(spark, d):
    s, p = table(spark, d, "supplier"), table(spark, d, "part")
    fam = s.select(F.concat(F.lit("N"), "s_nationkey").alias("agency"), F.array("s_name", F.concat(F.lit("S"), F.col("s_suppkey") % 40)).alias("aliases"), F.col("s_suppkey").alias("family"))
    return rel.match_candidates(p, "p_partkey", [F.concat(F.lit("Supplier#"), F.lpad((F.col("p_partkey") % 150).cast("string"), 9, "0")), F.concat(F.lit("S"), F.col("p_partkey") % 60)], F.concat(F.lit("N"), F.col("p_partkey") % 25), rel.alias_index(fam))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("sec", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


def gap_sessions(spark, d):
    s = rel.gap_sessions(_events(spark, d), ["user_id"], "sec", F.col("_step") > 21600, "event_id", F.floor(F.col("sec") / 604_800))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("event_id").alias("first_event"), F.round(F.sum("value"), 4).alias("total"))


def locator_carry_forward(spark, d):
    lines = layout.page_lines(table(spark, d, "page_line"))
    head = F.nullif(F.regexp_extract("text", r"^(Section [0-9.]+)", 1), F.lit(""))
    return rel.carry_forward(lines, ["source_id"], ["line_id"], head, "locator", F.substring("line_id", 1, 12)).select("line_id", "locator")


def page_context_asof(spark, d):
    left = table(spark, d, "searchable_text_entry").select("entry_id", "source_id", F.col("page_number").alias("page")).distinct().where("page is not null")
    right = table(spark, d, "evidence").where("pdf_page is not null and printed_page is not null").groupBy("source_id", F.col("pdf_page").alias("page")).agg(F.min("printed_page").alias("printed"))
    return rel.as_of(left, right, ["source_id"], "page", "printed", F.floor(F.col("page") / 64))


def exception_children(spark, d):
    lines = layout.page_lines(table(spark, d, "page_line")).where("pdf_page is not null and y0 is not null")
    return rel.bounded_children(lines, ["source_id", "pdf_page"], "y0", F.col("text").contains("Exception"), F.col("text").contains("shall") & ~F.col("text").contains("Exception"), 60.0, "line_id")


def _captions(spark: SparkSession, d: str) -> DataFrame:
    e = current(table(spark, d, "evidence")).select("evidence_id", "source_id", "pdf_page", "text")
    return pv.references(e, ["evidence_id", "source_id", "pdf_page"]).where("kind = 'table'")


def caption_groups(spark, d):
    return _captions(spark, d).groupBy("source_id", "target").agg(F.min("pdf_page").alias("first_page"), F.max("pdf_page").alias("last_page"), F.count("*").alias("blocks"), F.min("evidence_id").alias("first_member"))


def occurrence_patterns(spark, d):
    return rel.occurrence_patterns(_captions(spark, d), "source_id", "target", "pdf_page")


def contiguous_runs(spark, d):
    return rel.runs(table(spark, d, "evidence").where("extraction_method like 'ocr%'"), "source_id", "pdf_page")


def continuation_links(spark, d):
    c = _captions(spark, d).where("pdf_page is not null").withColumn("id", F.concat_ws(":", "evidence_id", "target"))
    return rel.continuations(c, ["source_id", "target"], "pdf_page", "id", F.col("occurrences") > 1)


def top_per_group(spark, d):
    e = current(table(spark, d, "evidence")).where("pdf_page is not null")
    return rel.top_per_group(e, ["publication_key", "extraction_method"], [F.col("pdf_page"), F.col("block_index"), F.col("evidence_id")], 3).select("publication_key", "extraction_method", "evidence_id", "rank")


def section_index(spark, d):
    return rel.section_index(_refs(spark, d).where("key is not null and owner is not null"), "owner", "key", "relation_id")


def locator_parts(spark, d):
    """Parent, depth and kind told by the locators themselves."""
    k = F.col("key")
    return _targets(spark, d).distinct().select("owner", "key", locators.parent(k).alias("parent"), locators.depth(k).cast("int").alias("depth"), locators.address(k)[0].alias("kind"))


def _spans(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "source_text_section").where("span_start is not null and span_end is not null")
    return s.select(F.col("artifact_id").alias("owner"), locator(F.col("locator")).alias("key"), locator(F.col("parent_locator")).alias("parent"), "span_start", "span_end").distinct()


def section_references(spark, d):
    """Which sections hold each reference's text: interval overlap within an artifact."""
    s = _spans(spark, d).select("owner", F.col("key").alias("section_id"), F.col("span_start").alias("start"), F.col("span_end").alias("end"))
    f = table(spark, d, "reference_relation").where("evidence_start is not null and evidence_end is not null").select(F.col("source_artifact_id").alias("owner"), F.col("relation_id").alias("fragment_id"), F.col("evidence_start").alias("start"), F.col("evidence_end").alias("end")).distinct()
    return rel.overlap_join(s, f, "owner", 2_000)


def structural_ranges(spark, d):
    s = _spans(spark, d)
    total = s.groupBy("owner").agg(F.max("span_end").alias("total"))
    return rel.structural_ranges(s.join(total, "owner").withColumn("depth", locators.depth(F.col("key"))), "owner", "key", "depth", "span_start", "total")


def interval_subtract(spark, d):
    return rel.own_ranges(_spans(spark, d), "owner", "key", "parent", "span_start", "span_end")


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    day = F.datediff("o_orderdate", F.lit("1990-01-01"))
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", day.alias("start"), F.when(F.col("o_orderkey") % 50 != 0, day + 60 + (F.col("o_orderkey") % 90).cast("int")).alias("end"))


def amendment_overlaps(spark, d):
    return rel.overlaps_within(_intervals(spark, d), "o_custkey", "o_orderkey", "start", "end", 180)


def amendment_active(spark, d):
    return rel.active_at(_intervals(spark, d), "start", "end", F.lit(3_000)).select("o_custkey", "o_orderkey")


def lineage_controlling(spark, d):
    priority = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "click", 1).otherwise(0)
    return rel.controlling(table(spark, d, "events"), "user_id", priority, "event_id", "event_id")


def change_reconcile(spark, d):
    """Orders of even keys as expected changes of their customer, those of odd keys as observed ones."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("change_id"), F.array("o_custkey").alias("targets"), F.col("o_orderstatus").alias("kind"))
    return rel.reconcile_changes(o.where("change_id % 2 = 0"), o.where("change_id % 2 <> 0"))


def ownership_assign(spark, d):
    e = current(table(spark, d, "evidence")).where("bbox is not null and pdf_page is not null and text is not null")
    at = lambda i: F.get("bbox", F.lit(i))
    b = e.select("evidence_id", F.concat_ws("#", "source_id", "pdf_page").alias("page"), at(0).alias("x0"), at(1).alias("y0"), at(3).alias("y1"), F.col("text").rlike("^(Table|Figure)").alias("cap"), F.col("extraction_method").startswith("ocr").alias("ruled"))
    return rel.ownership(b.where("cap").select(F.col("evidence_id").alias("caption_id"), "page", "x0", "y0", "y1"), b.where("not cap").select(F.col("evidence_id").alias("candidate_id"), "page", "x0", "y0", "y1", "ruled"))


def source_audit(spark, d):
    """Readiness of each source with what stands against it."""
    e = current(table(spark, d, "evidence"))
    g = e.groupBy("source_id").agg(F.count("*").alias("blocks"), F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("no_text"), F.count_if(F.col("bbox").isNull()).alias("no_box"), F.count_if(F.col("pdf_page").isNull()).alias("no_page"), F.countDistinct("source_sha256").alias("hashes"))
    flag = lambda c, n: F.when(F.col(c) > (1 if c == "hashes" else 0), F.lit(n))
    blockers = F.array_join(F.array_compact(F.array(flag("no_text", "empty-text"), flag("no_box", "missing-box"), flag("no_page", "missing-page"), flag("hashes", "several-artifacts"))), ",")
    return g.select("source_id", "blocks", blockers.alias("blockers"))


def provenance_edges(spark, d):
    r = _refs(spark, d).select(F.col("source_artifact_id").alias("source_owner"), "source_key", F.col("owner").alias("target_owner"), F.col("key").alias("target_key"), F.col("relation_type").alias("type"))
    return graphs.provenance(r)[1]


def reference_components(spark, d):
    return graphs.components(_edges(spark, d))


def reference_cycles(spark, d):
    return graphs.cycles(_edges(spark, d))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes laid out from line items: an order's items stand side by side, orders below one another."""
    li = table(spark, d, "lineitem")
    x, y = F.col("l_linenumber") * 70.0, (F.col("l_orderkey") % 40) * 15.0 + F.col("l_quantity") % 2
    return li.select(F.col("l_returnflag").alias("source_id"), F.floor(F.col("l_orderkey") / 40).cast("int").alias("pdf_page"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"), x.alias("x0"), y.alias("y0"), (x + 20 + F.col("l_partkey") % 40).alias("x1"), (y + 9).alias("y1"))


def table_rows_detect(spark, d):
    return geometry.table_rows(_boxes(spark, d))


def ruled_tables(spark, d):
    """Tables ruled around the boxes: a level above each order, as long as its items, and uprights at its items' left edges."""
    b = _boxes(spark, d).withColumn("text", F.col("id"))
    row = F.split("id", "-")[0]
    across = b.groupBy("source_id", "pdf_page", row.alias("row")).agg(F.max("x0").alias("x1"), F.min("y0").alias("y0")).select("source_id", "pdf_page", F.lit(70.0).alias("x0"), "y0", (F.col("x1") + 60).alias("x1"), F.col("y0").alias("y1"))
    down = b.select("source_id", "pdf_page", "x0", "y0", F.col("x0").alias("x1"), (F.col("y0") + 15).alias("y1"))
    return geometry.ruled_tables(across.unionByName(down), b).select("source_id", "pdf_page", "table_no", "rows", "columns", "x0", "y0", "x1", "y1", F.size("cells").alias("filled"))


def box_clusters(spark, d):
    lines = layout.page_lines(table(spark, d, "page_line"))
    return geometry.box_clusters(lines.select("source_id", "pdf_page", F.col("line_id").alias("id"), "x0", "y0", "x1", "y1"), gap=3.0)


def visual_topk(spark, d):
    """Query set: the vectors whose id is divisible by 50, against all rows."""
    v = table(spark, d, "embeddings")
    return vectors.top_k(v.where("vec_id % 50 = 0"), v, 5)


def visual_hybrid(spark, d):
    v = table(spark, d, "embeddings")
    return vectors.hybrid_top_k(v.where("vec_id % 50 = 0"), v, "label", 10)


def visual_best_per_label(spark, d):
    v = table(spark, d, "embeddings")
    return vectors.best_per_label(v.where("vec_id % 50 = 0"), v, "label")


_ALL = (crossref_resolve, crossref_reconcile, crossref_summary, crossref_two_cycles, crosschecks_anti, external_alias_match, gap_sessions, locator_carry_forward, page_context_asof, exception_children, caption_groups, occurrence_patterns, contiguous_runs, continuation_links, top_per_group, section_index, locator_parts, section_references, structural_ranges, interval_subtract, amendment_overlaps, amendment_active, lineage_controlling, change_reconcile, ownership_assign, source_audit, provenance_edges, reference_components, reference_cycles, table_rows_detect, ruled_tables, box_clusters, visual_topk, visual_hybrid, visual_best_per_label)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


def _loc(c: str) -> str:
    return f"lower(regexp_replace({c}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'))"


_EV = "ev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY loaded_at) AS rn FROM evidence) WHERE rn = 1)"
_PL = "pl AS (SELECT line_id, source_id, pdf_page, text, bbox[1] AS x0, bbox[2] AS y0, bbox[3] AS x1, bbox[4] AS y1 FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY loaded_at) AS rn FROM page_line) WHERE rn = 1)"
_TG = f"tg AS (SELECT owner, key FROM (SELECT DISTINCT node_id, artifact_id AS owner, {_loc('locator')} AS key FROM source_text_section))"
_RF = f"rf AS (SELECT * FROM (SELECT DISTINCT relation_id, relation_type, source_artifact_id, {_loc('source_locator')} AS source_key, target_artifact_id AS owner, {_loc('target_locator')} AS key FROM reference_relation) WHERE coalesce(key, '') NOT LIKE 'external:%')"
_RS = f"{_TG}, {_RF}, pc AS (SELECT owner, key, count(*) AS places FROM tg GROUP BY ALL), rs AS (SELECT relation_id, rf.owner, rf.key, CASE WHEN rf.key IS NULL OR rf.owner IS NULL THEN 'unresolved' WHEN places IS NULL THEN 'nonexistent' WHEN places > 1 THEN 'ambiguous' ELSE 'resolved' END AS state FROM rf LEFT JOIN pc ON rf.owner = pc.owner AND rf.key = pc.key)"
_EG = f"{_RF}, eg AS (SELECT source_artifact_id || '#' || source_key AS source, owner || '#' || key AS target FROM rf WHERE key IS NOT NULL AND owner IS NOT NULL)"
_CP = rf"{_EV}, cp AS (SELECT evidence_id, source_id, pdf_page, string_split(u.h, ' ')[2] AS target, count(*) AS occurrences FROM (SELECT *, regexp_extract_all(text, '(?:^|[^A-Za-z])((?:Table|Figure|Equation|Exception|Section|Article) [0-9]+(?:\.[0-9]+)*)', 1) AS hs FROM ev), unnest(hs) AS u(h) WHERE u.h LIKE 'Table %' GROUP BY ALL)"
_SP = f"sp AS (SELECT DISTINCT artifact_id AS owner, {_loc('locator')} AS key, {_loc('parent_locator')} AS parent, span_start, span_end FROM source_text_section WHERE span_start IS NOT NULL AND span_end IS NOT NULL)"
_IV = "iv AS (SELECT o_custkey, o_orderkey, date_diff('day', DATE '1990-01-01', o_orderdate) AS s, CASE WHEN o_orderkey % 50 <> 0 THEN date_diff('day', DATE '1990-01-01', o_orderdate) + 60 + o_orderkey % 90 END AS e FROM orders)"
_TK = "tk AS (SELECT query_id, neighbour_id, score, rank FROM (SELECT q.vec_id AS query_id, r.vec_id AS neighbour_id, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])), 9) DESC, r.vec_id) AS rank FROM embeddings q JOIN embeddings r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id) WHERE rank <= {k})"
_DEPTH = "1 + length(regexp_replace({c}, '[^./(]', '', 'g'))"


def oracle_sql() -> dict[str, str]:
    q = {}
    q["crossref_resolve"] = f"WITH {_RS} SELECT relation_id, state FROM rs"
    q["crossref_reconcile"] = f"""WITH {_RS}, hd AS (SELECT DISTINCT owner, array_to_string(list_slice(p, 1, u.i), '.') AS key FROM (SELECT owner, string_split(key, '.') AS p FROM tg) t, unnest(range(1, greatest(len(p), 2))) AS u(i)),
      j AS (SELECT rs.*, hd.key IS NOT NULL AS h FROM rs LEFT JOIN hd ON rs.owner = hd.owner AND rs.key = hd.key)
      SELECT relation_id, CASE WHEN state = 'nonexistent' AND h THEN 'resolved' ELSE state END AS final_state, CASE WHEN state = 'nonexistent' AND h THEN 'section_heading_prefix' WHEN state = 'nonexistent' THEN 'target_not_in_inventory' WHEN state = 'ambiguous' THEN 'preserved_contextual_ambiguity' WHEN state = 'resolved' THEN 'preserved_resolved_target' ELSE 'section_target_not_indexed' END AS reason FROM j"""
    q["crossref_summary"] = f"WITH {_EG} SELECT target, count(*) AS \"references\", CAST(row_number() OVER (ORDER BY count(*) DESC, target) AS INTEGER) AS rank FROM eg GROUP BY target QUALIFY rank <= 50"
    q["crossref_two_cycles"] = f"WITH {_EG}, d AS (SELECT DISTINCT source, target FROM eg WHERE source <> target) SELECT x.source AS a, x.target AS b FROM d x JOIN d y ON x.source = y.target AND x.target = y.source WHERE x.source < x.target"
    q["crosschecks_anti"] = f"WITH {_TG}, {_RF}, l AS (SELECT DISTINCT owner || '#' || key AS place FROM tg), r AS (SELECT DISTINCT owner || '#' || key AS place FROM rf WHERE key IS NOT NULL AND owner IS NOT NULL) SELECT place, 'left' AS side FROM l ANTI JOIN r USING (place) UNION ALL SELECT place, 'right' FROM r ANTI JOIN l USING (place)"
    q["external_alias_match"] = """WITH x AS (SELECT DISTINCT 'N' || s_nationkey AS agency, unnest([s_name, 'S' || (s_suppkey % 40)]) AS alias, s_suppkey AS family FROM supplier), ix AS (SELECT agency, alias, count(*) AS n, min(family) AS family FROM x GROUP BY 1, 2),
      c AS (SELECT p_partkey, 'N' || (p_partkey % 25) AS agency, unnest([0, 1]) AS ordinal, unnest(['Supplier#' || lpad(CAST(p_partkey % 150 AS VARCHAR), 9, '0'), 'S' || (p_partkey % 60)]) AS alias FROM part),
      j AS (SELECT c.p_partkey, min(CASE WHEN n = 1 THEN ordinal END) AS o, arg_min(family, CASE WHEN n = 1 THEN ordinal END) AS f, bool_or(n > 1) AS amb FROM c LEFT JOIN ix USING (agency, alias) GROUP BY 1)
      SELECT p_partkey, CASE WHEN o IS NOT NULL THEN f END AS family, o AS ordinal, CASE WHEN o = 0 THEN 'exact_alias' WHEN o IS NOT NULL THEN 'derived_alias' WHEN amb THEN 'ambiguous_alias' ELSE 'unknown_alias' END AS reason FROM j"""
    q["gap_sessions"] = "WITH g AS (SELECT *, CASE WHEN coalesce(epoch(ts) - epoch(lag(ts) OVER w) > 21600, true) THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), n AS (SELECT *, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g) SELECT user_id, session, count(*) AS events, min(event_id) AS first_event, round(sum(value), 4) AS total FROM n GROUP BY ALL"
    q["locator_carry_forward"] = f"WITH {_PL} SELECT line_id, last_value(nullif(regexp_extract(text, '^(Section [0-9.]+)', 1), '') IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY line_id ROWS UNBOUNDED PRECEDING) AS locator FROM pl"
    q["page_context_asof"] = "WITH l AS (SELECT DISTINCT entry_id, source_id, page_number AS page FROM searchable_text_entry WHERE page_number IS NOT NULL), r AS (SELECT source_id, pdf_page AS page, min(printed_page) AS printed FROM evidence WHERE pdf_page IS NOT NULL AND printed_page IS NOT NULL GROUP BY ALL) SELECT l.entry_id, l.source_id, l.page, r.printed FROM l ASOF LEFT JOIN r ON l.source_id = r.source_id AND l.page >= r.page"
    q["exception_children"] = f"WITH {_PL}, f AS (SELECT *, last_value(CASE WHEN contains(text, 'Exception') THEN {{'k': line_id, 'y': y0}} END IGNORE NULLS) OVER (PARTITION BY source_id, pdf_page ORDER BY y0, line_id ROWS UNBOUNDED PRECEDING) AS p FROM pl WHERE pdf_page IS NOT NULL AND y0 IS NOT NULL) SELECT line_id AS child, p.k AS parent FROM f WHERE contains(text, 'shall') AND NOT contains(text, 'Exception') AND y0 - p.y <= 60.0"
    q["caption_groups"] = f"WITH {_CP} SELECT source_id, target, min(pdf_page) AS first_page, max(pdf_page) AS last_page, count(*) AS blocks, min(evidence_id) AS first_member FROM cp GROUP BY ALL"
    q["occurrence_patterns"] = f"WITH {_CP} SELECT source_id, target, count(*) AS occurrences, count(DISTINCT pdf_page) AS pages, CASE WHEN count(*) = 1 THEN 'single' WHEN count(DISTINCT pdf_page) = 1 THEN 'same_page' WHEN max(pdf_page) - min(pdf_page) + 1 = count(DISTINCT pdf_page) THEN 'adjacent' ELSE 'discontiguous' END AS pattern FROM cp WHERE pdf_page IS NOT NULL GROUP BY ALL"
    q["contiguous_runs"] = "WITH p AS (SELECT DISTINCT source_id, pdf_page FROM evidence WHERE extraction_method LIKE 'ocr%' AND pdf_page IS NOT NULL), g AS (SELECT *, pdf_page - row_number() OVER (PARTITION BY source_id ORDER BY pdf_page) AS g FROM p) SELECT source_id, min(pdf_page) AS first, max(pdf_page) AS last, count(*) AS length FROM g GROUP BY source_id, g"
    q["continuation_links"] = f"WITH {_CP}, w AS (SELECT *, evidence_id || ':' || target AS id, lag(evidence_id || ':' || target) OVER (PARTITION BY source_id, target ORDER BY pdf_page, evidence_id || ':' || target) AS prev FROM cp WHERE pdf_page IS NOT NULL) SELECT id, CASE WHEN occurrences > 1 THEN prev END AS previous, CASE WHEN occurrences > 1 AND prev IS NOT NULL THEN 'continuation' WHEN occurrences > 1 THEN 'orphan' WHEN prev IS NOT NULL THEN 'unresolved' ELSE 'primary' END AS kind FROM w"
    q["top_per_group"] = f"WITH {_EV} SELECT publication_key, extraction_method, evidence_id, CAST(row_number() OVER (PARTITION BY publication_key, extraction_method ORDER BY pdf_page, block_index NULLS FIRST, evidence_id) AS INTEGER) AS rank FROM ev WHERE pdf_page IS NOT NULL QUALIFY rank <= 3"
    q["section_index"] = f"WITH {_RF} SELECT DISTINCT owner, key, relation_id, array_to_string(list_transform(regexp_extract_all(key, '([0-9]+|[^0-9]+)', 1), lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') AND length(x) < 9 THEN lpad(x, 9, '0') ELSE x END), '') AS sort_key FROM rf WHERE key IS NOT NULL AND owner IS NOT NULL"
    q["locator_parts"] = f"WITH {_TG}, u AS (SELECT DISTINCT owner, key, regexp_replace(key, '(\\([^()]*\\)|/[^/]*|\\.[^./()]*)$', '') AS up FROM tg) SELECT owner, key, CASE WHEN up <> key AND up <> '' THEN up END AS parent, CAST({_DEPTH.format(c='key')} AS INTEGER) AS depth, string_split(key, ':')[1] AS kind FROM u"
    q["section_references"] = f"WITH {_SP}, f AS (SELECT DISTINCT source_artifact_id AS owner, relation_id, evidence_start AS s, evidence_end AS e FROM reference_relation WHERE evidence_start < evidence_end) SELECT sp.owner, sp.key AS section_id, f.relation_id AS fragment_id, greatest(span_start, s) AS start, least(span_end, e) AS \"end\" FROM sp JOIN f ON sp.owner = f.owner AND span_start < e AND s < span_end WHERE span_start < span_end"
    q["structural_ranges"] = f"WITH {_SP}, d AS (SELECT *, {_DEPTH.format(c='key')} AS dep FROM sp) SELECT a.owner, a.key, a.span_start AS range_start, coalesce(min(b.span_start), (SELECT max(span_end) FROM sp s WHERE s.owner = a.owner)) AS range_end FROM d a LEFT JOIN d b ON a.owner = b.owner AND b.dep <= a.dep AND (b.span_start > a.span_start OR (b.span_start = a.span_start AND b.key > a.key)) GROUP BY a.owner, a.key, a.span_start"
    q["interval_subtract"] = f"""WITH {_SP}, b AS (SELECT owner, key, span_start AS ps, span_end AS pe FROM sp WHERE span_start < span_end), j AS (SELECT b.owner, b.key, ps, pe, greatest(k.span_start, ps) AS s, least(k.span_end, pe) AS e FROM b JOIN sp k ON k.owner = b.owner AND k.parent = b.key WHERE k.span_start < k.span_end AND k.span_start < pe AND k.span_end > ps
      UNION ALL SELECT owner, key, ps, pe, ps, ps FROM b UNION ALL SELECT owner, key, ps, pe, pe, pe FROM b), w AS (SELECT *, max(e) OVER (PARTITION BY owner, key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o FROM j) SELECT owner, key, o AS own_start, s AS own_end FROM w WHERE o < s"""
    q["amendment_overlaps"] = f"WITH {_IV} SELECT a.o_custkey, least(a.o_orderkey, b.o_orderkey) AS a, greatest(a.o_orderkey, b.o_orderkey) AS b FROM iv a JOIN iv b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.s < coalesce(b.e, 1000000) AND b.s < coalesce(a.e, 1000000)"
    q["amendment_active"] = f"WITH {_IV} SELECT o_custkey, o_orderkey FROM iv WHERE s <= 3000 AND (e IS NULL OR 3000 < e)"
    q["lineage_controlling"] = "SELECT user_id, arg_max(event_id, {'p': CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'click' THEN 1 ELSE 0 END, 's': event_id}) AS event_id FROM events GROUP BY 1"
    q["change_reconcile"] = """WITH o AS (SELECT o_orderkey AS id, o_custkey AS t, o_orderstatus AS k, o_orderkey % 2 = 0 AS expected FROM orders), met AS (SELECT t, count(*) AS n FROM o WHERE NOT expected GROUP BY 1), same AS (SELECT t, k, count(*) AS n FROM o WHERE NOT expected GROUP BY 1, 2)
      SELECT o.id AS change_id, CASE WHEN met.n IS NULL THEN 'expected_not_observed' WHEN same.n IS NULL THEN 'contradicted' WHEN same.n = 1 THEN 'confirmed' ELSE 'ambiguous' END AS outcome FROM o LEFT JOIN met ON o.t = met.t LEFT JOIN same ON o.t = same.t AND o.k = same.k WHERE expected
      UNION ALL SELECT id, 'unexpected_observed' FROM o WHERE NOT expected AND t NOT IN (SELECT t FROM o WHERE expected)"""
    q["ownership_assign"] = f"""WITH {_EV}, b AS (SELECT evidence_id, source_id || '#' || pdf_page AS page, bbox[1] AS x0, bbox[2] AS y0, bbox[4] AS y1, regexp_matches(text, '^(Table|Figure)') AS cap, extraction_method LIKE 'ocr%' AS ruled FROM ev WHERE bbox IS NOT NULL AND pdf_page IS NOT NULL AND text IS NOT NULL),
      m AS (SELECT c.evidence_id AS cid, c.y0, c.y1, c.ruled, p.evidence_id AS pid, p.y0 AS py0, p.y1 AS py1, p.y0 < c.y1 + 3.0 AND c.y0 < p.y1 + 3.0 AS ov, p.y1 <= c.y0 + 3.0 AS ab FROM b c JOIN b p ON NOT c.cap AND p.cap AND c.page = p.page AND abs(c.x0 - p.x0) <= 3.0),
      g AS (SELECT cid, count(*) AS n, min(pid) AS only1, bool_or(ruled) AS ruled, count(*) FILTER (ov) AS nov, min(pid) FILTER (ov) AS ovp, max(py1) FILTER (ab) AS top, arg_max(pid, py1) FILTER (ab) AS last1, list(py1) FILTER (ab) AS ys FROM m GROUP BY 1),
      r AS (SELECT *, len(list_filter(ys, lambda y: y = top)) > 1 AS tied FROM g)
      SELECT b.evidence_id AS candidate_id, CASE WHEN n = 1 THEN only1 WHEN r.ruled AND nov = 1 THEN ovp WHEN r.ruled AND nov > 1 THEN NULL WHEN top IS NOT NULL AND NOT tied THEN last1 END AS caption_id,
        CASE WHEN n IS NULL THEN 'unresolved' WHEN n = 1 THEN 'owned' WHEN r.ruled AND nov = 1 THEN 'owned' WHEN r.ruled AND nov > 1 THEN 'ambiguous' WHEN top IS NULL THEN 'unresolved' WHEN tied THEN 'ambiguous' ELSE 'owned' END AS state FROM b LEFT JOIN r ON b.evidence_id = r.cid WHERE NOT b.cap"""
    q["source_audit"] = f"WITH {_EV} SELECT source_id, count(*) AS blocks, concat_ws(',', CASE WHEN count(*) FILTER (text IS NULL OR text = '') > 0 THEN 'empty-text' END, CASE WHEN count(*) FILTER (bbox IS NULL) > 0 THEN 'missing-box' END, CASE WHEN count(*) FILTER (pdf_page IS NULL) > 0 THEN 'missing-page' END, CASE WHEN count(DISTINCT source_sha256) > 1 THEN 'several-artifacts' END) AS blockers FROM ev GROUP BY 1"
    h = lambda kind, x: f"'{kind}:' || substr(sha256('{kind}|' || {x}), 1, 24)"
    a, b = "source_artifact_id || '|' || source_key", "owner || '|' || key"
    q["box_clusters"] = """WITH RECURSIVE pl AS (SELECT line_id, source_id, pdf_page, bbox[1] AS x0, bbox[2] AS y0, bbox[3] AS x1, bbox[4] AS y1 FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY loaded_at) AS rn FROM page_line WHERE line_id IS NOT NULL) WHERE rn = 1 AND pdf_page IS NOT NULL AND bbox[1] IS NOT NULL),
    near AS (SELECT a.line_id AS a, b.line_id AS b FROM pl a JOIN pl b ON a.source_id = b.source_id AND a.pdf_page = b.pdf_page AND a.x1 + 3 >= b.x0 AND b.x1 + 3 >= a.x0 AND a.y0 - 3 <= b.y1 AND b.y0 - 3 <= a.y1),
    reached AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reached r JOIN near n ON r.b = n.a), named AS (SELECT a AS line_id, min(b) AS c FROM reached GROUP BY 1),
    g AS (SELECT source_id, pdf_page, c, count(*) AS members, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM pl JOIN named USING (line_id) GROUP BY 1, 2, 3)
    SELECT source_id, pdf_page, CAST(row_number() OVER (PARTITION BY source_id, pdf_page ORDER BY y0, x0, y1, x1) AS INTEGER) AS cluster, members, x0, y0, x1, y1 FROM g"""
    q["reference_components"] = f"""WITH RECURSIVE {_EG}, both_ways AS (SELECT source AS a, target AS b FROM eg UNION SELECT target, source FROM eg), reached AS (SELECT a AS node, a AS other FROM both_ways UNION SELECT r.node, e.b FROM reached r JOIN both_ways e ON r.other = e.a)
    SELECT node, min(other) AS component FROM reached GROUP BY node"""
    q["reference_cycles"] = f"""WITH RECURSIVE {_EG}, d AS (SELECT DISTINCT source, target FROM eg), reached AS (SELECT source AS a, target AS b FROM d UNION SELECT r.a, d.target FROM reached r JOIN d ON r.b = d.source)
    SELECT x.a AS node, max(y.a) AS component FROM reached x JOIN reached y ON x.b = y.a AND y.b = x.a GROUP BY x.a"""
    q["provenance_edges"] = f"WITH {_RF} SELECT {h('provedge', f'{a} || chr(124) || {b} || chr(124) || relation_type')} AS edge_id, {h('provnode', a)} AS source, {h('provnode', b)} AS target, relation_type AS type, count(*) AS occurrences FROM rf WHERE source_artifact_id IS NOT NULL AND source_key IS NOT NULL AND owner IS NOT NULL AND key IS NOT NULL GROUP BY source_artifact_id, source_key, owner, key, relation_type"
    q["visual_topk"] = f"WITH {_TK.format(k=5)} SELECT query_id, neighbour_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM tk"
    pair = "s AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, b.label, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS s, CASE WHEN a.label IS NOT NULL AND b.label IS NOT NULL THEN CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END END AS c FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND a.embedding IS NOT NULL AND b.embedding IS NOT NULL)"
    q["visual_hybrid"] = f"""WITH {pair}, e AS (SELECT *, min(s) OVER w AS sl, max(s) OVER w AS sh, coalesce(min(c) OVER w, 0.0) AS cl, coalesce(max(c) OVER w, 0.0) AS ch FROM s WINDOW w AS (PARTITION BY query_id)),
    f AS (SELECT query_id, neighbour_id, 0.55 * (s - sl) / (sh - sl + 1e-9) + 0.45 * (coalesce(c, cl) - cl) / (ch - cl + 1e-9) AS f FROM e) SELECT query_id, neighbour_id, round(f, 6) AS fused FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY f DESC, neighbour_id) <= 10"""
    q["visual_best_per_label"] = f"WITH {pair} SELECT query_id, label, round(max(s), 6) AS score FROM s GROUP BY ALL"
    return q
