"""Problem 6 on the undo log: merges consolidated into one group per entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomgraph.functions.text import key_form
from loomgraph.llm.components import groups_of
from loomgraph.sources.tables import table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each group of tied entities, its lowest id and each other id of it."""
    undo = table(spark, sf_dir, "dream_entity_undo_log").select(key_form(F.col("source_node_uuid")).alias("s"), key_form(F.col("target_node_uuid")).alias("t"))
    return groups_of(undo, "s", "t").where("group_key != node_key")


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many groups there are of each size."""
    sizes = p6_found(spark, sf_dir).groupBy("group_key").agg((F.count(F.lit(1)) + 1).alias("members"))
    return sizes.groupBy("members").agg(F.count(F.lit(1)).alias("n_groups"))


QUERIES = {"p6_found": p6_found, "p6_groups": p6_groups}

_KEY = r"nullif(lower(regexp_replace({0}, '[^\p{{L}}\p{{Nd}}]', '', 'g')), '')"
_FOUND = f"""
WITH RECURSIVE e AS (
  SELECT DISTINCT {_KEY.format('source_node_uuid')} s, {_KEY.format('target_node_uuid')} t FROM dream_entity_undo_log),
d AS (SELECT s a, t b FROM e WHERE s <> t UNION SELECT t, s FROM e WHERE s <> t),
lab(v, l) USING KEY (v) AS (
  SELECT a, least(a, min(b)) FROM d GROUP BY a
  UNION
  SELECT d.a, min(n.l) FROM recurring.lab n JOIN d ON d.b = n.v JOIN recurring.lab o ON o.v = d.a GROUP BY d.a, o.l HAVING min(n.l) < o.l),
found AS (SELECT l group_key, v node_key FROM lab WHERE l <> v)
"""
ORACLES = {
    "p6_found": _FOUND + "SELECT * FROM found",
    "p6_groups": _FOUND + "SELECT members, count(*) n_groups FROM (SELECT group_key, count(*) + 1 members FROM found GROUP BY 1) GROUP BY 1",
}
