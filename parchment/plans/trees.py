"""Tree, reader, sink and streaming queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from ..functions.text import locator
from ..operators import trees
from ..operators.copies import HIERARCHY_VALUES, hierarchy_rows, latest
from ..sources import readers, sinks
from ..streaming import events
from ..session import table


def hierarchy_prefix_parent(spark, d):
    h = latest(hierarchy_rows(table(spark, d, "hierarchy_expected")), ["publication_key", "locator"], HIERARCHY_VALUES, "loaded_at")
    return trees.nearest_parent(h, "publication_key", "locator")


def hierarchy_marker_stack(spark, d):
    s = table(spark, d, "source_text_section").where("node_type = 'list_item'")
    one = s.groupBy("node_id").agg(F.min(F.struct("artifact_id", locator(F.col("parent_locator")).alias("parent"), "span_start", F.col("attributes")["marker"].alias("marker"))).alias("r")).select("node_id", "r.*")
    return trees.marker_hierarchy(one.withColumn("owner", F.concat_ws("#", "artifact_id", "parent")), "owner", "span_start", "node_id", "marker")


def tree_findings(spark, d):
    s = table(spark, d, "source_text_section").select("artifact_id", locator(F.col("locator")).alias("key"), locator(F.col("parent_locator")).alias("parent"), "span_start", "span_end")
    return trees.tree_findings(s, "artifact_id", "key", "parent", "span_start", "span_end")


def strict_reader(spark, d):
    """Event properties read with a closed schema, problems kept beside the records."""
    r = readers.strict_json(table(spark, d, "events"), "props", T.StructType([T.StructField("k", T.IntegerType())]))
    return r.select("event_id", F.col("record.k").alias("k"), F.coalesce("problem", F.lit("none")).alias("problem"))


def canonical_export(spark, d):
    return sinks.canonical_json(table(spark, d, "nation"))


def stream_windows(spark, d):
    """Events as a stream, counted per day and type."""
    src = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return events.run_available(spark, events.windowed(src.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", "event_type"), "windows").select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


_ALL = (hierarchy_prefix_parent, hierarchy_marker_stack, tree_findings, strict_reader, canonical_export, stream_windows)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


def _loc(c: str) -> str:
    return f"lower(regexp_replace({c}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'))"


def oracle_sql() -> dict[str, str]:
    q = {}
    q["hierarchy_prefix_parent"] = f"WITH h AS (SELECT DISTINCT publication_key, {_loc('locator')} AS locator FROM hierarchy_expected), p AS (SELECT publication_key, locator, u.i, array_to_string(list_slice(string_split(locator, '.'), 1, u.i), '.') AS pre FROM h, unnest(range(1, len(string_split(locator, '.')))) AS u(i)), b AS (SELECT p.publication_key, p.locator, arg_max(pre, i) AS parent FROM p JOIN h ON h.publication_key = p.publication_key AND h.locator = p.pre GROUP BY 1, 2) SELECT h.publication_key, h.locator, b.parent FROM h LEFT JOIN b USING (publication_key, locator)"
    q["tree_findings"] = f"""WITH d AS (SELECT DISTINCT artifact_id AS owner, {_loc('locator')} AS key, {_loc('parent_locator')} AS parent, span_start AS s, span_end AS e FROM source_text_section), o AS (SELECT owner, key, count(*) AS n, min(s) AS ps, max(e) AS pe FROM d GROUP BY 1, 2)
      SELECT owner, key, 'duplicate-locator' AS code FROM o WHERE n > 1 UNION SELECT owner, key, 'bad-span' FROM d WHERE s IS NULL OR e IS NULL OR s >= e
      UNION SELECT d.owner, d.key, 'missing-parent' FROM d LEFT JOIN o ON d.owner = o.owner AND d.parent = o.key WHERE d.parent IS NOT NULL AND o.key IS NULL
      UNION SELECT d.owner, d.key, 'span-outside-parent' FROM d JOIN o ON d.owner = o.owner AND d.parent = o.key WHERE s < ps OR e > pe"""
    q["strict_reader"] = "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, 'none' AS problem FROM events"
    q["canonical_export"] = """WITH j AS (SELECT '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS json FROM nation) SELECT json, sha256(json) AS sha256 FROM j"""
    q["stream_windows"] = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"
    return q
