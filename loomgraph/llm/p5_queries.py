"""Problem 5 on the queue: payloads that differ only by the way they are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomgraph.llm.formatting import canonical_payload, copy_groups, fingerprints, formatting_copies
from loomgraph.sources.tables import table

#: Fields of a payload, in the order of the canonical text.
PAYLOAD_FIELDS = ["content", "group_id", "name", "source_description"]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each copy of a payload with the lowest id of its group."""
    return formatting_copies(table(spark, sf_dir, "episodes"), "id", canonical_payload(F.col("payload_json"), PAYLOAD_FIELDS))


def p5_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each payload once: the lowest id that holds it and the number of rows that do."""
    rows = table(spark, sf_dir, "episodes").select("id", "payload_json")
    return copy_groups(fingerprints(rows, "id", canonical_payload(F.col("payload_json"), PAYLOAD_FIELDS))).select("first_id", "copies")


QUERIES = {"p5_found": p5_found, "p5_payloads": p5_payloads}

_CANON = r"""
WITH p AS (
  SELECT id, CAST(payload_json AS JSON) j FROM episodes WHERE id IS NOT NULL AND json_valid(payload_json) AND json_type(CASE WHEN json_valid(payload_json) THEN payload_json END) = 'OBJECT'),
f AS (SELECT id, j, list_sort(json_keys(j)) ks FROM p),
c AS (SELECT id, list_transform(['content', 'group_id', 'name', 'source_description'], lambda n:
    lower(upper(regexp_replace(coalesce(json_extract_string(j, '$."' || list_filter(ks, lambda k: lower(k) = n)[1] || '"'), ''), '[^\p{L}\p{Nd}]', '', 'g')))) c FROM f)
"""
ORACLES = {
    "p5_found": _CANON + "SELECT DISTINCT first_id, id copy_id FROM (SELECT id, min(id) OVER (PARTITION BY c) first_id FROM c) WHERE id <> first_id",
    "p5_payloads": _CANON + "SELECT min(id) first_id, count(*) copies FROM c GROUP BY c",
}
