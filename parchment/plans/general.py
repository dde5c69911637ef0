"""Queries of the general problems (p3 to p6) over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import locator
from ..operators import copies, forest, nested, orphans
from ..session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.hierarchy_findings(*(table(spark, d, f"hierarchy_{t}") for t in ("expected", "actual", "mismatch")))


def p3_fields(spark: SparkSession, d: str) -> DataFrame:
    """Field by field, with both values."""
    return copies.hierarchy_differences(table(spark, d, "hierarchy_expected"), table(spark, d, "hierarchy_actual"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    sections, relations = table(spark, d, "source_text_section"), table(spark, d, "reference_relation")
    return orphans.orphan_references(orphans.section_parents(sections), orphans.relation_children(relations).unionByName(orphans.section_children(sections)))


def p4_by_month(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans_by_period(p4_found(spark, d))


def _links(spark: SparkSession, d: str) -> DataFrame:
    """All three trees in one form; the owner carries the table's name, so one forest serves all."""
    s = table(spark, d, "source_text_section").select(F.concat_ws("\x1f", F.lit("source_text_section"), "artifact_id").alias("owner"), locator(F.col("locator")).alias("key"), locator(F.col("parent_locator")).alias("parent"), F.lit(None).cast("int").alias("stored"))
    out = s
    for t in ("hierarchy_expected", "hierarchy_actual"):
        h = copies.latest(copies.hierarchy_rows(table(spark, d, t)), ["publication_key", "locator"], copies.HIERARCHY_VALUES, "loaded_at")
        out = out.unionByName(h.select(F.concat_ws("\x1f", F.lit(t), "publication_key").alias("owner"), F.col("locator").alias("key"), locator(F.col("parent")).alias("parent"), F.col("depth").alias("stored")))
    return out.withColumn("parent", F.nullif("parent", F.lit("")))


def p5_tree(spark: SparkSession, d: str) -> DataFrame:
    """Path, depth and root of every node of the three tables."""
    part = F.split("owner", "\x1f")
    return forest.hierarchy(_links(spark, d)).select(F.get(part, F.lit(0)).alias("table_name"), F.get(part, F.lit(1)).alias("owner_id"), F.col("key").alias("locator"), "root", "depth", "finding", F.array_join("path", " > ").alias("path"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """A row without a stored depth is no depth case."""
    links = _links(spark, d)
    tree = forest.hierarchy(links)
    stored = links.where("stored is not null").select("owner", "key", "stored")
    part = F.split("owner", "\x1f")
    cyc = tree.where("finding in ('cycle', 'below_cycle')").select("owner", "key", "finding")
    deep = tree.where("finding is null").join(stored, ["owner", "key"]).where("stored <> depth").select("owner", "key", F.lit("depth").alias("finding"))
    return cyc.unionByName(deep).select(F.get(part, F.lit(0)).alias("table_name"), F.get(part, F.lit(1)).alias("owner_id"), F.col("key").alias("locator"), "finding")


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "source_text_section")
    return forest.descendants(forest.hierarchy(s.select(F.col("artifact_id").alias("owner"), locator(F.col("locator")).alias("key"), locator(F.col("parent_locator")).alias("parent"))))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.emit_items(table(spark, d, "raw_record")).select("raw_id", "item_kind", "item_key", "parent_key").distinct()


def p6_conditions(spark: SparkSession, d: str) -> DataFrame:
    """The typed table of conditions."""
    return nested.item_tables(nested.emit_items(table(spark, d, "raw_record")))["condition"]


def queries() -> dict:
    return {f.__name__: f for f in (p3_found, p3_fields, p4_found, p4_by_month, p5_found, p5_tree, p5_descendants, p6_found, p6_conditions)}


_STRIP = "regexp_replace({0}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
_LOC = "lower(" + _STRIP + ")"
_TITLE = "regexp_replace(regexp_replace(regexp_replace(lower(nfc_normalize({0})), '[\\s\\p{{Z}}]+', ' ', 'g'), '^ | $', '', 'g'), '[. ]+$', '')"
_HIER = """{0} AS (SELECT * EXCLUDE rn FROM (SELECT publication_key, {loc} AS locator, title, parent, ordinal, depth, row_number() OVER (PARTITION BY publication_key, {loc} ORDER BY loaded_at DESC NULLS LAST, title DESC NULLS LAST, parent DESC NULLS LAST, ordinal DESC NULLS LAST, depth DESC NULLS LAST) AS rn FROM {1}) WHERE rn = 1)"""


def _hier(name: str, source: str) -> str:
    return _HIER.format(name, source, loc=_LOC.format("locator"))


def _report(column: str, copy: str) -> str:
    t, p = _TITLE.format, _LOC.format
    return f"""SELECT DISTINCT m.publication_key, m.locator, 'report-{column}' AS code
    FROM (SELECT publication_key, {p('locator')} AS locator, code, {column} AS said FROM hierarchy_mismatch) m
    LEFT JOIN {copy} h ON m.publication_key = h.publication_key AND m.locator = h.locator
    WHERE CASE m.code WHEN 'title-mismatch' THEN {t('m.said')} IS DISTINCT FROM {t('h.title')}
      WHEN 'parent-mismatch' THEN {p('m.said')} IS DISTINCT FROM {p('h.parent')}
      WHEN 'depth-mismatch' THEN trim(m.said) IS DISTINCT FROM CAST(h.depth AS VARCHAR)
      WHEN 'order-mismatch' THEN trim(m.said) IS DISTINCT FROM CAST(h.ordinal AS VARCHAR) ELSE false END"""


def _p3() -> str:
    t, p = _TITLE.format, _LOC.format
    both = [("title-mismatch", f"{t('e.title')} IS DISTINCT FROM {t('a.title')}"), ("parent-mismatch", f"{p('e.parent')} IS DISTINCT FROM {p('a.parent')}"), ("depth-mismatch", "e.depth IS DISTINCT FROM a.depth"), ("order-mismatch", "e.ordinal IS DISTINCT FROM a.ordinal")]
    parts = [f"SELECT e.publication_key, e.locator, '{c}' AS code FROM e JOIN a USING (publication_key, locator) WHERE {w}" for c, w in both]
    parts += ["SELECT publication_key, locator, 'missing-locator' FROM e ANTI JOIN a USING (publication_key, locator)", "SELECT publication_key, locator, 'unexpected-locator' FROM a ANTI JOIN e USING (publication_key, locator)"]
    return f"WITH {_hier('e', 'hierarchy_expected')}, {_hier('a', 'hierarchy_actual')} " + " UNION ALL ".join([*parts, _report("expected", "e"), _report("actual", "a")])


def _p4() -> str:
    p = _LOC.format
    return f"""WITH par AS (SELECT artifact_id AS owner, {p('locator')} AS key, min(loaded_at) AS loaded_at, bool_or(deleted_at IS NOT NULL) AS deleted FROM source_text_section GROUP BY 1, 2),
    kid AS (SELECT DISTINCT 'reference_relation' AS table_name, relation_id AS row_key, target_artifact_id AS owner, {p('target_locator')} AS key, recorded_at AS seen_at FROM reference_relation WHERE target_locator IS NOT NULL AND {p('target_locator')} NOT LIKE 'external:%'
      UNION ALL SELECT 'source_text_section', node_id, any_value(artifact_id), max({p('parent_locator')}), min(loaded_at) FROM source_text_section GROUP BY node_id HAVING count(deleted_at) = 0 AND max(parent_locator) IS NOT NULL)
    SELECT * FROM (SELECT DISTINCT table_name, row_key, strftime(seen_at, '%Y-%m') AS seen_month,
      CASE WHEN par.key IS NULL THEN 'missing' WHEN par.deleted THEN 'deleted' WHEN par.loaded_at > seen_at THEN 'late' END AS reason
      FROM kid LEFT JOIN par ON kid.owner = par.owner AND kid.key = par.key) WHERE reason IS NOT NULL"""


def _p5() -> str:
    p = _LOC.format
    return f"""WITH RECURSIVE {_hier('e', 'hierarchy_expected')}, {_hier('a', 'hierarchy_actual')},
    link AS (SELECT 'source_text_section' AS t, artifact_id AS o, {p('locator')} AS k, min(nullif({p('parent_locator')}, '')) AS up, NULL AS stored FROM source_text_section GROUP BY 1, 2, 3
      UNION ALL SELECT 'hierarchy_expected', publication_key, locator, nullif({p('parent')}, ''), depth FROM e
      UNION ALL SELECT 'hierarchy_actual', publication_key, locator, nullif({p('parent')}, ''), depth FROM a),
    way AS (SELECT t, o, k, k AS here, up AS nxt, 0 AS n, [k] AS seen, false AS back FROM link
      UNION ALL SELECT w.t, w.o, w.k, l.k, l.up, w.n + 1, list_append(w.seen, l.k), list_contains(w.seen, l.k) FROM way w JOIN link l ON w.t = l.t AND w.o = l.o AND w.nxt = l.k WHERE NOT w.back)
    SELECT t AS table_name, o AS owner_id, k AS locator, CASE WHEN here = k THEN 'cycle' ELSE 'below_cycle' END AS finding FROM way WHERE back
    UNION ALL SELECT w.t, w.o, w.k, 'depth' FROM way w JOIN link l ON w.t = l.t AND w.o = l.o AND w.k = l.k WHERE w.nxt IS NULL AND NOT w.back AND l.stored <> w.n"""


def _p3_fields() -> str:
    t, p = _TITLE.format, _LOC.format
    both = [("title", t("e.title"), t("a.title")), ("parent", p("e.parent"), p("a.parent")), ("depth", "e.depth", "a.depth"), ("order", "e.ordinal", "a.ordinal")]
    raw = {"order": "ordinal"}
    parts = [f"SELECT e.publication_key, e.locator, '{c}-mismatch' AS code, CAST(e.{raw.get(c, c)} AS VARCHAR) AS expected, CAST(a.{raw.get(c, c)} AS VARCHAR) AS actual FROM e JOIN a USING (publication_key, locator) WHERE {x} IS DISTINCT FROM {y}" for c, x, y in both]
    parts += ["SELECT publication_key, locator, 'missing-locator', NULL, NULL FROM e ANTI JOIN a USING (publication_key, locator)", "SELECT publication_key, locator, 'unexpected-locator', NULL, NULL FROM a ANTI JOIN e USING (publication_key, locator)"]
    return f"WITH {_hier('e', 'hierarchy_expected')}, {_hier('a', 'hierarchy_actual')} " + " UNION ALL ".join(parts)


_WAY = """way AS (SELECT t, o, k, k AS here, up AS nxt, 0 AS n, [k] AS seen, false AS back FROM link
      UNION ALL SELECT w.t, w.o, w.k, l.k, l.up, w.n + 1, list_append(w.seen, l.k), list_contains(w.seen, l.k) FROM way w JOIN link l ON w.t = l.t AND w.o IS NOT DISTINCT FROM l.o AND w.nxt = l.k WHERE NOT w.back),
    ends AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t, o, k ORDER BY n DESC) AS r FROM way) WHERE r = 1)"""


def _links_sql() -> str:
    p = _LOC.format
    return f"""{_hier('e', 'hierarchy_expected')}, {_hier('a', 'hierarchy_actual')},
    link AS (SELECT 'source_text_section' AS t, artifact_id AS o, {p('locator')} AS k, min(nullif({p('parent_locator')}, '')) AS up FROM source_text_section WHERE locator IS NOT NULL GROUP BY 1, 2, 3
      UNION ALL SELECT 'hierarchy_expected', publication_key, locator, nullif({p('parent')}, '') FROM e WHERE locator IS NOT NULL
      UNION ALL SELECT 'hierarchy_actual', publication_key, locator, nullif({p('parent')}, '') FROM a WHERE locator IS NOT NULL)"""


def _p5_tree() -> str:
    return f"""WITH RECURSIVE {_links_sql()}, {_WAY}
    SELECT t AS table_name, o AS owner_id, k AS locator, CASE WHEN NOT back THEN coalesce(nxt, here) END AS root, CAST(CASE WHEN NOT back THEN n + CASE WHEN nxt IS NULL THEN 0 ELSE 1 END END AS BIGINT) AS depth,
      CASE WHEN back AND here = k THEN 'cycle' WHEN back THEN 'below_cycle' WHEN nxt IS NOT NULL THEN 'dangling' END AS finding,
      CASE WHEN NOT back THEN array_to_string(list_reverse(seen), ' > ') END AS path FROM ends"""


def _p5_descendants() -> str:
    p = _LOC.format
    return f"""WITH RECURSIVE link AS (SELECT 's' AS t, artifact_id AS o, {p('locator')} AS k, min({p('parent_locator')}) AS up FROM source_text_section WHERE locator IS NOT NULL GROUP BY 1, 2, 3), {_WAY}
    SELECT o AS owner, seen[i] AS ancestor, k AS descendant, CAST(i - 1 AS INTEGER) AS distance FROM (SELECT o, k, seen, unnest(range(2, len(seen) + 1)) AS i FROM ends WHERE NOT back)"""


#: Payloads without byte order marks, JSON within JSON strings read in turn; then items from each level to the next.
_P6 = r"""raw AS (SELECT DISTINCT raw_id, payload FROM raw_record WHERE payload IS NOT NULL),
    text AS (SELECT raw_id, payload, 0 AS n, ltrim(payload, chr(65279) || ' ' || chr(9) || chr(10) || chr(13)) AS x FROM raw
      UNION ALL SELECT raw_id, payload, n + 1, ltrim(json_extract_string(CAST(x AS JSON), '$'), chr(65279) || ' ' || chr(9) || chr(10) || chr(13)) FROM text WHERE CASE WHEN json_valid(x) THEN json_type(CAST(x AS JSON)) = 'VARCHAR' ELSE false END),
    unreadable AS (SELECT raw_id FROM text WHERE n = 0 AND NOT json_valid(x)),
    doc AS (SELECT raw_id, payload, CASE WHEN json_valid(x) THEN CAST(x AS JSON) END AS j FROM text WHERE json_valid(x) AND json_type(CAST(CASE WHEN json_valid(x) THEN x END AS JSON)) <> 'VARCHAR'),
    body AS (SELECT raw_id, payload, CASE WHEN json_type(j) <> 'OBJECT' THEN j WHEN json_exists(j, '$.conditions') THEN json_extract(j, '$.conditions') WHEN json_exists(j, '$.name') OR json_exists(j, '$.expected') THEN j END AS b FROM doc WHERE coalesce(json_type(j, '$.root'), '') <> 'OBJECT'),
    node AS (SELECT raw_id, payload, json_extract(j, '$.root') AS x, '' AS parent FROM doc WHERE json_type(j, '$.root') = 'OBJECT'
      UNION ALL SELECT raw_id, payload, c.x, parent FROM (SELECT raw_id, payload, unnest({kids_children}) AS x, coalesce(json_extract_string(x, '$.node_id'), '') AS parent FROM node) c WHERE json_type(c.x) = 'OBJECT'),
    cases AS (SELECT raw_id, payload, x, coalesce(json_extract_string(x, '$.name'), '') AS name FROM (SELECT raw_id, payload, unnest({kids_b}) AS x FROM body) WHERE json_type(x) = 'OBJECT'),
    expected AS (SELECT raw_id, payload, name, json_extract(x, '$.expected') AS x FROM cases WHERE json_type(x, '$.expected') = 'OBJECT'),
    cond AS (SELECT raw_id, payload, name, x, name AS parent, 1 AS depth, CAST(i - 1 AS INTEGER) AS ordinal, {key} AS item_key FROM (SELECT raw_id, payload, name, unnest({kids_condition}) AS x, generate_subscripts({kids_condition}, 1) AS i FROM expected) WHERE json_type(x) = 'OBJECT'
      UNION ALL SELECT raw_id, payload, name, x, parent, depth, CAST(i - 1 AS INTEGER), {key} FROM (SELECT raw_id, payload, name, unnest({kids_operands}) AS x, generate_subscripts({kids_operands}, 1) AS i, item_key AS parent, depth + 1 AS depth FROM cond) WHERE json_type(x) = 'OBJECT')"""


def _p6_with() -> str:
    def kids(j: str) -> str:
        return f"CASE json_type({j}) WHEN 'ARRAY' THEN json_extract({j}, '$[*]') WHEN 'OBJECT' THEN [{j}] ELSE [] END"

    key = "name || '/' || coalesce(json_extract_string(x, '$.span.start'), '') || '-' || coalesce(json_extract_string(x, '$.span.end'), '')"
    out = _P6.replace("{kids_b}", kids("b")).replace("{key}", key)
    for f in ("children", "condition", "operands"):
        out = out.replace(f"{{kids_{f}}}", kids(f"json_extract(x, '$.{f}')"))
    return out


def _p6() -> str:
    def other(f: str) -> str:
        return f"""SELECT raw_id, '{f}', name || '/' || coalesce(json_extract_string(y, '$.span.start'), '') || '-' || coalesce(json_extract_string(y, '$.span.end'), ''), name
      FROM (SELECT raw_id, name, unnest(CASE json_type(x, '$.{f}s') WHEN 'ARRAY' THEN json_extract(x, '$.{f}s[*]') WHEN 'OBJECT' THEN [json_extract(x, '$.{f}s')] ELSE [] END) AS y FROM expected) WHERE json_type(y) = 'OBJECT'"""

    return f"""WITH RECURSIVE {_p6_with()}
    SELECT DISTINCT raw_id, 'node' AS item_kind, coalesce(json_extract_string(x, '$.node_id'), '') AS item_key, parent AS parent_key FROM node
    UNION SELECT raw_id, 'case', name, '' FROM cases UNION SELECT raw_id, 'condition', item_key, parent FROM cond
    UNION {other('exception')} UNION {other('diagnostic')} UNION SELECT raw_id, 'unreadable', '', '' FROM unreadable"""


def _p6_conditions() -> str:
    s = lambda f: f"json_extract_string(x, '$.{f}')"
    return f"""WITH RECURSIVE {_p6_with()}
    SELECT raw_id, item_key, parent AS parent_key, ordinal, CAST(depth AS INTEGER) AS depth, {s('type')} AS type, {s('subject_property')} AS subject_property, {s('operator')} AS operator, CAST({s('threshold.value')} AS DOUBLE) AS threshold, {s('threshold.unit')} AS unit FROM cond"""


def oracle_sql() -> dict[str, str]:
    p4 = _p4()
    return {
        "p3_found": _p3(), "p3_fields": _p3_fields(), "p4_found": p4, "p4_by_month": f"SELECT table_name, seen_month, reason, count(*) AS orphans FROM ({p4}) GROUP BY ALL", "p5_found": _p5(), "p5_tree": _p5_tree(), "p5_descendants": _p5_descendants(),
        "p6_found": _p6(), "p6_conditions": _p6_conditions(),
    }
