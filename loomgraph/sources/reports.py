"""Report events as JSON lines, and the order of severities."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Severities and their weights.
SEVERITY = {"debug": 10, "info": 20, "warning": 30, "error": 40, "critical": 50}
FIELDS = ["kind", "severity", "summary", "details", "timestamp"]


def severity_at_least(severity: Column, threshold: str) -> Column:
    """The severity reaches the threshold; an unknown threshold lets everything pass, an unknown severity nothing."""
    if threshold not in SEVERITY:
        return F.lit(True)
    weights = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    return F.coalesce(F.try_element_at(weights, F.lower(severity)) >= SEVERITY[threshold], F.lit(False))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Events of JSON-lines files with ``seq``, the order of lines within their file; lines that are no JSON objects are skipped."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("seq"))
    payload = F.try_parse_json("value")
    rows = lines.withColumn("p", payload).where(F.col("p").try_cast("map<string,variant>").isNotNull())
    return rows.select("seq", *[F.try_variant_get("p", f"$.{f}", "string").alias(f) for f in FIELDS])


def last_reports(reports: DataFrame, count: int, kind: str | None = None) -> DataFrame:
    """The last ``count`` events, of one kind if it is given."""
    rows = reports if kind is None else reports.where(F.col("kind") == kind)
    return rows.orderBy(F.col("seq").desc()).limit(count)


def write_reports(events: DataFrame, path: str) -> None:
    """Appends events as JSON lines."""
    events.select(*FIELDS).write.mode("append").json(path)


def shown(event: Column, form: str) -> Column:
    """An event (struct) as text: json, raw, summary or pretty."""
    head = F.concat(F.lit("["), F.upper(event["severity"]), F.lit("] "), event["kind"], F.lit(": "), event["summary"])
    return {"json": F.to_json(event), "raw": F.coalesce(event["details"], event["summary"]), "summary": event["summary"], "pretty": head}[form]


def dispatched(events: DataFrame, sinks: dict[str, Callable[[DataFrame], None]]) -> dict[str, str]:
    """Hands events to all sinks at once; one that fails doesn't keep them from the others. Gives 'ok' or the error by sink.

    As a foreachBatch function it serves a stream: ``lambda batch, _: dispatched(batch, sinks)``.
    """

    def run(sink: Callable[[DataFrame], None]) -> str:
        try:
            sink(events)
            return "ok"
        except Exception as e:  # told to the caller, by sink
            return f"{type(e).__name__}: {e}"

    with ThreadPoolExecutor(max(1, len(sinks))) as pool:
        return dict(zip(sinks, pool.map(run, sinks.values())))
