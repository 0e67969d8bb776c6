"""The general training-data queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnwork.operators import references, shapes
from kilnwork.runtime import table


def _links(spark: SparkSession, d: str) -> tuple[list[references.Parent], list[references.Child]]:
    fixes, pulls = table(spark, d, "fix_suggestions"), table(spark, d, "pull_requests")
    return [
        references.Parent("findings", table(spark, d, "findings")),
        references.Parent("llm_calls", table(spark, d, "llm_calls"), deleted=None),
        references.Parent("fix_suggestions", fixes),
    ], [
        references.Child("fix_suggestions", "finding_id", fixes, "findings"),
        references.Child("fix_suggestions", "llm_call_id", fixes, "llm_calls"),
        references.Child("pull_requests", "included_suggestion_ids", pulls, "fix_suggestions", many=True),
    ]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return references.broken_references(*_links(spark, d)).select("ref_table", "ref_field", "ref_id", "target_id")


def p2_by_month(spark: SparkSession, d: str) -> DataFrame:
    counts = references.broken_reference_counts(*_links(spark, d))
    return counts.withColumn("month", F.date_format("month", "yyyy-MM"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    return shapes.tool_items(*(table(spark, d, t) for t in ("semgrep_output", "ruff_output", "raw_records")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("source_table", "record_id", "result_pos", "field_name", "item_pos")


def p3_runs(spark: SparkSession, d: str) -> DataFrame:
    runs = shapes.payload_runs(table(spark, d, "raw_records"))
    return runs.withColumn("received_at", F.date_format("received_at", "yyyy-MM-dd HH:mm:ss"))


def p3_results(spark: SparkSession, d: str) -> DataFrame:
    return shapes.payload_results(table(spark, d, "raw_records"))


def p3_text_items(spark: SparkSession, d: str) -> DataFrame:
    return shapes.variant_tables(_items(spark, d))["text"]


def p3_edit_items(spark: SparkSession, d: str) -> DataFrame:
    return shapes.variant_tables(_items(spark, d))["edit"]


def p3_semgrep_cwe(spark: SparkSession, d: str) -> DataFrame:
    """The items that are typed in Parquet, for the check against SQL."""
    semgrep = table(spark, d, "semgrep_output")
    items = shapes.struct_items(semgrep, "semgrep_output", "result_id", "cwe", F.col("extra.metadata.cwe"))
    return items.where("variant <> 'nothing'").select(
        "record_id", "item_pos", F.get_json_object("item", "$.v").alias("value")
    )


def p3_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Every value of the payloads, at any depth, with its parent."""
    return shapes.nodes(table(spark, d, "raw_records")).select("record_id", "node", "parent", "state")


def p3_variants(spark: SparkSession, d: str) -> DataFrame:
    v = shapes.variants(shapes.nodes(table(spark, d, "raw_records")))
    return v.select("at", F.array_join("fields", ",").alias("fields"), F.array_join("optional", ",").alias("optional"), "n")


def p3_metadata_objects(spark: SparkSession, d: str) -> DataFrame:
    """The objects at one place as their own table."""
    t = shapes.object_table(shapes.nodes(table(spark, d, "raw_records")), "$.results[*].extra.metadata")
    return t.select("record_id", "node", "parent", F.map_keys("leaves")[0].alias("first_field"), F.size("leaves").alias("leaves"))


QUERIES = {
    f.__name__: f
    for f in (
        p2_found,
        p2_by_month,
        p3_found,
        p3_runs,
        p3_results,
        p3_text_items,
        p3_edit_items,
        p3_semgrep_cwe,
        p3_nodes,
        p3_variants,
        p3_metadata_objects,
    )
}

_P2 = """
WITH p AS (
  SELECT 'findings' t, id, min(ingested_at) a, max(deleted_at IS NOT NULL) g FROM findings GROUP BY id
  UNION ALL SELECT 'llm_calls', id, min(ingested_at), false FROM llm_calls GROUP BY id
  UNION ALL SELECT 'fix_suggestions', id, min(ingested_at), max(deleted_at IS NOT NULL) FROM fix_suggestions GROUP BY id
), r AS (
  SELECT 'fix_suggestions' ref_table, 'finding_id' ref_field, id ref_id, finding_id target_id, 'findings' t, created_at
  FROM fix_suggestions
  UNION ALL SELECT 'fix_suggestions', 'llm_call_id', id, llm_call_id, 'llm_calls', created_at FROM fix_suggestions
  UNION ALL SELECT 'pull_requests', 'included_suggestion_ids', id, unnest(included_suggestion_ids), 'fix_suggestions',
    created_at FROM pull_requests
), x AS (
  SELECT DISTINCT ref_table, ref_field, ref_id, target_id, created_at,
    CASE WHEN p.id IS NULL THEN 'missing' WHEN g THEN 'deleted' WHEN a > created_at THEN 'late' END reason
  FROM r LEFT JOIN p ON p.t = r.t AND p.id = r.target_id WHERE target_id IS NOT NULL
)
"""

_RUNS = """
WITH r AS (SELECT DISTINCT ON (record_id) * FROM raw_records),
x AS (SELECT record_id, tool, CASE tool WHEN 'semgrep' THEN json_extract(payload, '$.results') ELSE payload::JSON END AS rs FROM r WHERE json_valid(payload)),
z AS (SELECT record_id, tool, pos, json_extract(rs, '$[' || pos || ']') AS res
  FROM (SELECT *, unnest(range(0, CAST(json_array_length(rs) AS BIGINT))) AS pos FROM x WHERE json_type(rs) = 'ARRAY')),
m AS (SELECT record_id, tool, pos, json_extract(res, CASE tool WHEN 'semgrep' THEN '$.extra.metadata' ELSE '$.fix' END) AS h FROM z),
h AS (SELECT record_id, tool, pos, CASE WHEN json_type(h) = 'VARCHAR' THEN TRY_CAST(h ->> '$' AS JSON) ELSE h END AS h FROM m),
f AS (SELECT record_id, pos, name, json_extract(h, '$.' || name) AS v
  FROM h, (VALUES ('semgrep', 'cwe'), ('semgrep', 'references'), ('ruff', 'edits')) k(t, name) WHERE t = tool),
i AS (SELECT record_id, pos, name, k FROM (SELECT *, unnest(range(0, CAST(json_array_length(v) AS BIGINT))) AS k FROM f WHERE json_type(v) = 'ARRAY')
    WHERE json_type(json_extract(v, '$[' || k || ']')) <> 'NULL'
  UNION ALL SELECT record_id, pos, name, 0 FROM f WHERE json_type(v) NOT IN ('ARRAY', 'NULL')),
s AS (SELECT DISTINCT ON (result_id) * FROM semgrep_output), u AS (SELECT DISTINCT ON (result_id) * FROM ruff_output),
a AS (SELECT result_id, 'cwe' AS name, unnest(extra.metadata.cwe) AS v, generate_subscripts(extra.metadata.cwe, 1) - 1 AS k FROM s
  UNION ALL SELECT result_id, 'references', unnest(extra.metadata."references"), generate_subscripts(extra.metadata."references", 1) - 1 FROM s),
b AS (SELECT result_id, unnest(fix.edits) AS v, generate_subscripts(fix.edits, 1) - 1 AS k FROM u)
"""

_TREE = """WITH r AS (SELECT DISTINCT ON (record_id) * FROM raw_records), t AS MATERIALIZED (SELECT record_id, t.fullkey AS node, t.type AS type, regexp_replace(t.fullkey, '\\[\\d+\\]', '[*]', 'g') AS loc, t.value AS value, t.atom AS atom
  FROM (SELECT record_id, payload FROM r WHERE json_valid(payload)) x, json_tree(x.payload::JSON) t),
p AS MATERIALIZED (SELECT *, CASE WHEN node <> '$' THEN regexp_replace(node, '(\\[\\d+\\]|\\.[^.\\[\\]]+)$', '') END AS parent FROM t)"""

ORACLE = {
    "p3_nodes": _TREE + " SELECT record_id, node, parent, CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'list' WHEN 'VARCHAR' THEN 'text' WHEN 'NULL' THEN 'nothing' WHEN 'BOOLEAN' THEN 'flag' ELSE 'number' END AS state FROM p",
    "p3_variants": _TREE
    + """, o AS (SELECT loc, list_sort(json_keys(value)) AS f FROM t WHERE type = 'OBJECT'), g AS (SELECT loc, f, count(*) AS n FROM o GROUP BY 1, 2), s AS (SELECT loc, sum(n) AS a FROM g GROUP BY 1),
      h AS (SELECT loc, k, sum(n) AS c FROM (SELECT loc, n, unnest(f) AS k FROM g) GROUP BY 1, 2), q AS (SELECT h.loc, list(k) AS rare FROM h JOIN s USING (loc) WHERE c < a GROUP BY 1)
      SELECT loc AS "at", array_to_string(f, ',') AS fields, array_to_string(list_sort(list_filter(f, lambda x: list_contains(coalesce(rare, []), x))), ',') AS optional, n FROM g LEFT JOIN q USING (loc)""",
    "p3_metadata_objects": _TREE
    + """, m AS (SELECT record_id, node, parent FROM p WHERE loc = '$.results[*].extra.metadata' AND type = 'OBJECT'), l AS (SELECT record_id, parent AS node, list_sort(list(substr(node, length(parent) + 2))) AS k FROM p WHERE type NOT IN ('OBJECT', 'ARRAY') AND NOT ends_with(node, ']') GROUP BY 1, 2)
      SELECT m.record_id, m.node, m.parent, k[1] AS first_field, CAST(len(k) AS INT) AS leaves FROM m LEFT JOIN l USING (record_id, node)""",
    "p3_runs": """SELECT record_id, tool, scan_id, strftime(received_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS received_at, json_valid(payload) AS complete,
      CAST(CASE WHEN NOT json_valid(payload) THEN 0 WHEN tool = 'semgrep' THEN coalesce(json_array_length(json_extract(payload, '$.results')), 0) ELSE coalesce(json_array_length(payload), 0) END AS INT) AS n_results
      FROM (SELECT DISTINCT ON (record_id) * FROM raw_records)""",
    "p3_found": _RUNS
    + """SELECT 'raw_records' AS source_table, record_id, CAST(pos AS INT) AS result_pos, name AS field_name, CAST(k AS INT) AS item_pos FROM i
      UNION ALL SELECT 'semgrep_output', result_id, 0, name, CAST(k AS INT) FROM a WHERE v IS NOT NULL
      UNION ALL SELECT 'ruff_output', result_id, 0, 'edits', CAST(k AS INT) FROM b WHERE v IS NOT NULL""",
    "p3_results": _RUNS
    + """SELECT record_id, CAST(pos AS INT) AS result_pos, tool, CASE WHEN json_type(r) = 'VARCHAR' THEN r ->> '$' END AS rule, CASE WHEN json_type(p) = 'VARCHAR' THEN p ->> '$' END AS path,
      CASE WHEN json_type(l) IN ('BIGINT', 'UBIGINT') THEN CAST(l AS INT) END AS line, CASE WHEN json_type(res) <> 'OBJECT' THEN 'other'
        WHEN json_exists(res, '$.check_id') AND json_exists(res, '$.path') OR json_exists(res, '$.filename') AND json_type(res, '$.location') IN ('OBJECT', 'NULL') THEN 'result' ELSE 'record' END AS variant
      FROM (SELECT *, CASE tool WHEN 'semgrep' THEN json_extract(res, '$.check_id') WHEN 'ruff' THEN coalesce(CASE WHEN (res ->> '$.code') <> '' THEN json_extract(res, '$.code') END, json_extract(res, '$.name')) END AS r,
        json_extract(res, CASE tool WHEN 'semgrep' THEN '$.path' ELSE '$.filename' END) AS p, json_extract(res, CASE tool WHEN 'semgrep' THEN '$.start.line' ELSE '$.location.row' END) AS l FROM z)""",
    "p3_text_items": _RUNS
    + """SELECT 'raw_records' AS source_table, record_id, CAST(pos AS INT) AS result_pos, name AS field_name, CAST(k AS INT) AS item_pos, x ->> '$' AS value
      FROM (SELECT record_id, pos, name, k, CASE WHEN json_type(v) = 'ARRAY' THEN json_extract(v, '$[' || k || ']') ELSE v END AS x FROM i JOIN f USING (record_id, pos, name)) WHERE json_type(x) = 'VARCHAR'
      UNION ALL SELECT 'semgrep_output', result_id, 0, name, CAST(k AS INT), v FROM a WHERE v IS NOT NULL""",
    "p3_edit_items": _RUNS
    + """SELECT 'raw_records' AS source_table, record_id, CAST(pos AS INT) AS result_pos, name AS field_name, CAST(k AS INT) AS item_pos, x ->> '$.content' AS content,
      TRY_CAST(x ->> '$.location.row' AS INT) AS start_row, TRY_CAST(x ->> '$.location.column' AS INT) AS start_column, TRY_CAST(x ->> '$.end_location.row' AS INT) AS end_row, TRY_CAST(x ->> '$.end_location.column' AS INT) AS end_column
      FROM (SELECT record_id, pos, name, k, CASE WHEN json_type(v) = 'ARRAY' THEN json_extract(v, '$[' || k || ']') ELSE v END AS x FROM i JOIN f USING (record_id, pos, name))
      WHERE json_type(x) = 'OBJECT' AND (json_type(x, '$.location') = 'OBJECT' OR json_exists(x, '$.content') AND json_type(x, '$.content') NOT IN ('OBJECT', 'ARRAY'))
      UNION ALL SELECT 'ruff_output', result_id, 0, 'edits', CAST(k AS INT), v.content, v.location.row, v.location.column, v.end_location.row, v.end_location.column FROM b WHERE v IS NOT NULL""",
    "p2_found": _P2 + "SELECT ref_table, ref_field, ref_id, target_id FROM x WHERE reason IS NOT NULL",
    "p2_by_month": _P2
    + """SELECT ref_table, ref_field, reason, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m') AS month,
      count(*) AS n_references, count(DISTINCT target_id) AS n_targets
      FROM x WHERE reason IS NOT NULL GROUP BY ALL""",
    "p3_semgrep_cwe": """
      WITH o AS (SELECT result_id, any_value(extra.metadata.cwe) c FROM semgrep_output GROUP BY result_id),
      u AS (SELECT result_id, unnest(c) AS value, generate_subscripts(c, 1) - 1 AS pos FROM o)
      SELECT result_id AS record_id, CAST(pos AS INTEGER) AS item_pos, value FROM u WHERE value IS NOT NULL""",
}
