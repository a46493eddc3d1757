"""Ingest as Structured Streaming: gated enqueue and the sweep of the queue, one writer a table.

The set of active payloads is the state: it is held in the versioned episodes table, looked up by each micro-batch
and left at a terminal status, which a watermark can't express. Each batch is published once, under its id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.operators import queue as Q
from loomgraph.plans.staging import staged
from loomgraph.plans.versions import VersionedTable

#: Columns of the episodes table.
EPISODES = "id string, status string, payload_json string, enqueued_at string, started_at string, finished_at string, attempt_count long, consecutive_failures long, last_error string, checkpoint string, created_at string, updated_at string, last_replay_at string, payload_hash string, claimed_by string, canonical_hash string, dedup_gate string"
#: Columns of the dead letters.
LETTERS = "episode_id string, payload_json string, last_error string, attempt_count long, failed_at string, recovered_at string, recovered_attempts long"
#: Columns of the ledger.
LEDGER = "detected_at string, mode string, action string, payload_hash string, existing_episode_id string, duplicate_episode_id string, writer string"


def current(table: VersionedTable, schema: str) -> DataFrame:
    """The latest rows, or none of the schema."""
    rows = table.read()
    return rows if rows is not None else table.spark.createDataFrame([], schema)


def shaped(rows: DataFrame, schema: str) -> DataFrame:
    """Rows with the schema's columns, null where they lack one."""
    fields = rows.sparkSession.createDataFrame([], schema).schema.fields
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def enqueue_batch(spark: SparkSession, root: str, batch: DataFrame, number: int, mode: str, now: str, stream: str = "enqueue") -> None:
    """Gates a stream's batch (id, payload_json, claimed_by, seq) and publishes episodes and ledger; a batch seen before changes nothing."""
    episodes, ledger = VersionedTable(spark, f"{root}/episodes"), VersionedTable(spark, f"{root}/ledger")
    before = current(episodes, EPISODES)
    known = batch.join(before.select("id"), "id", "left_anti")  # a replayed batch's rows are there already
    rows, events = (staged(d, "gated") for d in Q.gate_enqueue(before, staged(known, "batch"), mode, now))
    ledger.publish(current(ledger, LEDGER).unionByName(shaped(events, LEDGER)), stream, number)
    episodes.publish(before.unionByName(shaped(rows, EPISODES)), stream, number)


def ingest(stream: DataFrame, root: str, checkpoint: str, mode: str, clock: Callable[[], str]) -> StreamingQuery:
    """Starts the gated enqueue of a stream of arrivals; it stops when what is there has been read."""
    run = lambda batch, number: enqueue_batch(batch.sparkSession, root, batch, number, mode, clock())
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sweep(spark: SparkSession, root: str, work: Callable[[DataFrame], DataFrame], now: str, limit: int = 20, timeout_sec: int = 900, max_attempts: int = 3) -> dict[str, int]:
    """One sweep: reap stuck rows, claim the next, work on them, set their states, publish.

    work gives (id, error_class, message) of the claimed rows, error_class null for success. A failure is retried or goes
    to the dead letters as retry_decision says. Gives counts. Both tables get the sweep's number: letters of a sweep that
    died before its episodes were published are taken back first.
    """
    table, dead = VersionedTable(spark, f"{root}/episodes"), VersionedTable(spark, f"{root}/dead_letter")
    number = (table.last("sweep") or 0) + 1
    if (dead.last("sweep") or 0) >= number:
        before = [v for v in dead.manifests() if (dead.manifest(v)["streams"].get("sweep") or [0])[0] < number]
        dead.roll_back(before[-1]) if before else dead.publish(dead.read().limit(0))
    episodes, letters = current(table, EPISODES), current(dead, LETTERS)
    reaped = staged(Q.reap_stuck(episodes, now, timeout_sec, max_attempts), "reaped")
    episodes = Q.replaced(episodes, reaped, "id")
    late = reaped.where("status = 'aborted'").select(F.col("id").alias("episode_id"), "payload_json", "last_error", "attempt_count", F.lit(now).alias("failed_at"))
    letters = Q.replaced(letters, shaped(late, LETTERS), "episode_id")
    claimed = staged(Q.claim_batch(episodes, limit).withColumns({"status": F.lit("processing"), "started_at": F.lit(now), "updated_at": F.lit(now)}), "claimed")
    judged = staged(claimed.join(work(claimed).select("id", "error_class", "message"), "id", "left"), "judged")
    failed = judged.where("error_class is not null")
    fate = Q.retry_decision(F.col("attempt_count"), F.col("error_class"), F.col("message"), max_attempts)
    text = Q.error_text(F.col("error_class"), F.col("message"))
    done, closed = Q.mark_done(judged.where("error_class is null").select(*episodes.columns), letters, now)
    again = Q.mark_failed(failed.where(fate == "retry"), text, now).select(*episodes.columns)
    ended, opened = Q.mark_aborted(failed.where(fate == "dead"), text, now)
    new = staged(done.unionByName(again).unionByName(ended.select(*episodes.columns)), "new")
    letters = Q.replaced(Q.replaced(letters, shaped(closed, LETTERS), "episode_id"), shaped(opened, LETTERS), "episode_id")
    dead.publish(letters, "sweep", number)
    table.publish(Q.replaced(episodes, new, "id"), "sweep", number)
    counts = {r["status"]: r["n"] for r in new.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {"reaped": reaped.count(), "processed": sum(counts.values()), "succeeded": counts.get("done", 0), "failed": counts.get("failed", 0), "dead": counts.get("aborted", 0)}


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by kind and window; on a stream, rows later than ``late`` are not counted. An addition to the reference's scope."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def over_rate(events: DataFrame, who: str, time: str, seconds: int, most: int) -> DataFrame:
    """Events with ``over``: whether ``who`` had more than ``most`` in the ``seconds`` up to and including the event's second."""
    recent = Window.partitionBy(who).orderBy(F.unix_seconds(F.col(time).cast("timestamp"))).rangeBetween(1 - seconds, 0)
    return events.withColumn("over", F.count(F.lit(1)).over(recent) > most)
