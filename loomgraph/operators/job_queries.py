"""Repairs, reports, windows and the nightly job as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomgraph.functions.repair import with_repairs
from loomgraph.operators import queue as Q
from loomgraph.operators.consolidation_queries import _W
from loomgraph.operators.dream import dream
from loomgraph.plans.staging import shared_dir, staged
from loomgraph.sources.graph import memory_graph
from loomgraph.sources.reports import read_reports, severity_at_least, shown, write_reports
from loomgraph.sources.tables import table
from loomgraph.streaming.ingest import windowed_counts

def _drifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entity (uuid, form, schema_name, payload_json) as a payload of one of five drifted forms, by its uuid's last character."""
    e = memory_graph(spark, sf_dir).entity.where("uuid is not null").withColumn("form", F.pmod(F.ascii(F.substring("uuid", -1, 1)), F.lit(5)))
    short = F.coalesce(F.length("name"), F.lit(0))
    forms = [
        ("SummarizedEntities", F.to_json(F.struct(F.array(F.struct("name", "summary")).alias("summary_list")))),
        ("ExtractedEntities", F.to_json(F.struct(F.struct(F.array(F.struct("name", short.cast("string").alias("entity_type_id"))).alias("node_list")).alias("properties")))),
        ("EdgeDuplicate", F.to_json(F.struct(F.concat(F.lit("["), short.cast("string"), F.lit("; 3, y]")).alias("duplicate_ids"), F.array(short, F.lit(8)).alias("contra_idx")))),
        ("ExtractedEdges", F.to_json(F.struct(F.array(F.struct(F.col("summary").alias("fact"))).alias("relations"), F.col("group_id").alias("group")))),
        ("NodeResolutions", F.to_json(F.struct(short.alias("id"), F.coalesce("name", F.lit("")).alias("name")))),
    ]
    pick = lambda k: F.element_at(F.array(*[F.lit(f[0]) if k == 0 else f[1] for f in forms]), F.col("form") + 1)
    return e.select("uuid", "form", pick(0).alias("schema_name"), pick(1).alias("payload_json"))


def f13_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drifted payloads of all entities repaired by their schema's rule: what is found at the places that the schema names."""
    out = with_repairs(_drifted(spark, sf_dir)).withColumn("v", F.try_parse_json("repaired_json"))
    at = lambda path, kind="string": F.try_variant_get("v", path, kind)
    return out.select(
        "uuid", "form", "state",
        F.coalesce(at("$.summaries[0].name"), at("$.extracted_entities[0].name"), at("$.entity_resolutions[0].name")).alias("name"),
        F.coalesce(at("$.summaries[0].summary"), at("$.edges[0].fact")).alias("text"),
        F.coalesce(at("$.extracted_entities[0].entity_type_id", "long"), at("$.duplicate_facts[0]", "long"), at("$.entity_resolutions[0].id", "long")).alias("number"),
        F.coalesce(at("$.extracted_entities[0].episode_indices[0]", "long"), at("$.contradicted_facts[1]", "long")).alias("second"), at("$.group").alias("kept"),
    )


def f8_payload_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episode payloads read as lists of extracted entities: how many rows repair to how many entities."""
    rows = table(spark, sf_dir, "episodes").select(F.lit("ExtractedEntities").alias("schema_name"), "payload_json")
    out = with_repairs(rows).select(F.size(F.try_variant_get(F.try_parse_json("repaired_json"), "$.extracted_entities", "array<variant>")).alias("entities"))
    return out.groupBy("entities").agg(F.count(F.lit(1)).alias("n"))


def t_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type and six hours."""
    return windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type", "6 hours")


def k5_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs written as report events and read again, errors and worse only."""
    runs = table(spark, sf_dir, "dream_runs")
    status = F.lower("status")
    events = runs.select(F.lit("dream").alias("kind"), F.when(status == "failed", "error").otherwise("info").alias("severity"), F.concat(F.lit("run "), F.col("run_id")).alias("summary"), F.col("error_message").alias("details"), F.col("started_at").alias("timestamp"))
    path = f"{shared_dir(spark)}/reports-{uuid.uuid4().hex}"
    write_reports(events, path)
    read = read_reports(spark, path).where(severity_at_least(F.col("severity"), "error"))
    return read.select(shown(F.struct("kind", "severity", "summary", "details", "timestamp"), "pretty").alias("line"))


def dr_dream_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit row of a nightly run that changes nothing."""
    graph = memory_graph(spark, sf_dir)
    dead = staged(Q.latest_rows(table(spark, sf_dir, "dead_letter"), "episode_id", "failed_at"), "dead")
    return dream(graph, dead, "run", "2026-10-20T00:00:00+00:00").audit


QUERIES = {f.__name__: f for f in (f13_repairs, f8_payload_entities, t_windows, k5_reports, dr_dream_audit)}

ORACLES = {
    # what each form must become, said on the entities themselves
    "f13_repairs": _W + """, x AS (SELECT *, CAST(ascii(right(uuid, 1)) % 5 AS INTEGER) form, CAST(coalesce(length(name), 0) AS BIGINT) n FROM en WHERE uuid IS NOT NULL)
SELECT uuid, form, 'repaired' state,
  CASE WHEN form IN (0, 1) THEN CASE WHEN coalesce(name, '') = '' THEN '<unnamed>' ELSE name END WHEN form = 4 THEN coalesce(name, '') END AS name,
  CASE form WHEN 0 THEN coalesce(summary, '') WHEN 3 THEN summary END AS text,
  CASE WHEN form IN (1, 2, 4) THEN n END number, CASE form WHEN 1 THEN CAST(0 AS BIGINT) WHEN 2 THEN 8 END AS second, CASE form WHEN 3 THEN group_id END kept FROM x""",
    "f8_payload_entities": "SELECT CAST(CASE WHEN json_valid(payload_json) AND (json_exists(payload_json, '$.name') OR json_exists(payload_json, '$.summary')) THEN 1 ELSE 0 END AS INTEGER) entities, count(*) n FROM episodes GROUP BY 1",
    "t_windows": "SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') start, event_type, count(*) n FROM events GROUP BY 1, 2",
    "k5_reports": "SELECT '[ERROR] dream: run ' || run_id line FROM dream_runs WHERE lower(status) = 'failed'",
}
