"""Registered queries of the general data-quality problems, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.orphans import orphan_references, orphan_report
from ..sources.tables import table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    names = ("entities", "claims", "relations", "kb_references")
    return orphan_references({n: table(spark, d, n) for n in names})


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Each reference that is missing, deleted or late."""
    return _orphans(spark, d).select("table_name", "record_key", "ref_key", "reason")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Their number per table, month and reason."""
    return orphan_report(_orphans(spark, d))


_P3 = r"""
WITH rows AS (
  SELECT 'entities' AS table_name, 'reference' AS space, entity_path AS record_key, source_ids_json AS raw, loaded_at FROM entities
  UNION ALL SELECT 'claims', 'reference', claim_key, source_ids_json, loaded_at FROM claims
  UNION ALL SELECT 'relations', 'entity', CAST(relation_id AS VARCHAR), target, loaded_at FROM relations),
firsts AS (SELECT table_name, record_key, min(loaded_at) AS record_first FROM rows WHERE record_key IS NOT NULL GROUP BY ALL),
elements AS (
  SELECT table_name, space, record_key, raw AS ref_key FROM rows WHERE space = 'entity' AND raw LIKE '/%'
  UNION ALL
  SELECT table_name, space, record_key, regexp_replace(regexp_replace(e, '^[ \t\n\x0B\f\r]*((?i:ref:)[ \t\n\x0B\f\r]*)?', ''), '[ \t\n\x0B\f\r]+$', '')
  FROM (SELECT table_name, space, record_key, unnest(from_json(raw, '["VARCHAR"]')) AS e FROM rows WHERE space = 'reference')),
refs AS (SELECT DISTINCT table_name, space, record_key, ref_key FROM elements WHERE record_key IS NOT NULL AND ref_key IS NOT NULL AND ref_key <> ''),
parent_rows AS (
  SELECT 'reference' AS space, reference_id AS ref_key, loaded_at, deleted_at FROM kb_references
  UNION ALL SELECT 'entity', entity_path, loaded_at, deleted_at FROM entities),
parents AS (
  SELECT space, ref_key, min(loaded_at) AS parent_first, max(loaded_at) AS parent_last FROM parent_rows GROUP BY ALL),
dead AS (
  SELECT DISTINCT p.space, p.ref_key FROM parents p JOIN parent_rows r ON p.space = r.space AND p.ref_key = r.ref_key AND p.parent_last = r.loaded_at
  WHERE r.deleted_at IS NOT NULL),
found AS (
  SELECT r.table_name, r.record_key, r.ref_key, f.record_first,
         CASE WHEN p.ref_key IS NULL THEN 'missing' WHEN d.ref_key IS NOT NULL THEN 'deleted' WHEN p.parent_first > f.record_first THEN 'late' END AS reason
  FROM refs r JOIN firsts f ON r.table_name = f.table_name AND r.record_key = f.record_key
  LEFT JOIN parents p ON p.space = r.space AND p.ref_key = r.ref_key
  LEFT JOIN dead d ON d.space = r.space AND d.ref_key = r.ref_key)
"""


def queries() -> dict:
    return {"p3_found": p3_found, "p3_report": p3_report}


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _P3 + "SELECT table_name, record_key, ref_key, reason FROM found WHERE reason IS NOT NULL",
        "p3_report": _P3
        + "SELECT table_name, strftime(record_first, '%Y-%m') AS period, reason, count(*) AS n_references "
        + "FROM found WHERE reason IS NOT NULL GROUP BY ALL",
    }
