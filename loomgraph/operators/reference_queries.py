"""Problem 2 on the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomgraph.functions.text import key_form
from loomgraph.operators.references import orphan_references, parent_keys, references
from loomgraph.sources.tables import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record of the undo log and the dead letters whose run, entity or episode is missing, merged away or late."""
    undo, dead = table(spark, sf_dir, "dream_entity_undo_log"), table(spark, sf_dir, "dead_letter")
    refs = (
        references(undo, "dream_entity_undo_log", "id", "run_id", "dream_runs", "created_at")
        .unionByName(references(undo, "dream_entity_undo_log", "id", "target_node_uuid", "entity", "created_at"))
        .unionByName(references(dead, "dead_letter", "episode_id", "episode_id", "episodes", "failed_at"))
    )
    parents = None
    for name, key, time in (("dream_runs", "run_id", "started_at"), ("entity", "uuid", "created_at"), ("episodes", "id", "created_at")):
        own = parent_keys(table(spark, sf_dir, name), key, time).select(F.lit(name).alias("parent"), "key", "own_time")
        parents = own if parents is None else parents.unionByName(own)
    return orphan_references(refs, parents, undo.select(key_form(F.col("source_node_uuid")).alias("key")), "entity")


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of cases per table, field, month and kind."""
    return p2_found(spark, sf_dir).groupBy("table_name", "field_name", "period", "kind").agg(F.count(F.lit(1)).alias("cases"))


QUERIES = {"p2_found": p2_found, "p2_counts": p2_counts}

_TIME = r"""try_cast(CASE WHEN regexp_matches({0}, '([zZ]|[+-]\d{{2}}:?\d{{2}})$') THEN {0} ELSE {0} || '+00:00' END AS TIMESTAMPTZ)"""
_KEY = r"nullif(lower(regexp_replace({0}, '[^\p{{L}}\p{{Nd}}]', '', 'g')), '')"

_FOUND = f"""
WITH refs AS (
  SELECT 'dream_entity_undo_log' table_name, 'run_id' field_name, CAST(id AS VARCHAR) record_key, 'dream_runs' parent, {_KEY.format('run_id')} k, {_TIME.format('created_at')} t FROM dream_entity_undo_log
  UNION ALL SELECT 'dream_entity_undo_log', 'target_node_uuid', CAST(id AS VARCHAR), 'entity', {_KEY.format('target_node_uuid')}, {_TIME.format('created_at')} FROM dream_entity_undo_log
  UNION ALL SELECT 'dead_letter', 'episode_id', episode_id, 'episodes', {_KEY.format('episode_id')}, {_TIME.format('failed_at')} FROM dead_letter),
par AS (
  SELECT parent, k, min(t) t FROM (
    SELECT 'dream_runs' parent, {_KEY.format('run_id')} k, {_TIME.format('started_at')} t FROM dream_runs
    UNION ALL SELECT 'entity', {_KEY.format('uuid')}, {_TIME.format('created_at')} FROM entity
    UNION ALL SELECT 'episodes', {_KEY.format('id')}, {_TIME.format('created_at')} FROM episodes) GROUP BY 1, 2),
gone AS (SELECT DISTINCT 'entity' parent, {_KEY.format('source_node_uuid')} k FROM dream_entity_undo_log),
cases AS (
  SELECT DISTINCT table_name, field_name, record_key, strftime(r.t AT TIME ZONE 'UTC', '%Y-%m') period,
    CASE WHEN p.k IS NOT NULL THEN CASE WHEN p.t > r.t THEN 'late' END WHEN g.k IS NOT NULL THEN 'deleted' ELSE 'missing' END kind
  FROM refs r LEFT JOIN par p ON p.parent = r.parent AND p.k = r.k LEFT JOIN gone g ON g.parent = r.parent AND g.k = r.k
  WHERE r.k IS NOT NULL)
"""

ORACLES = {
    "p2_found": _FOUND + "SELECT * FROM cases WHERE kind IS NOT NULL",
    "p2_counts": _FOUND + "SELECT table_name, field_name, period, kind, count(*) cases FROM cases WHERE kind IS NOT NULL GROUP BY ALL",
}
