"""The queue's statistics, picks and transitions on episodes and dead letters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomgraph.functions.text import utc_time
from loomgraph.operators import queue as Q
from loomgraph.sources.tables import table

#: The time of the transitions.
NOW = "2026-10-20T00:00:00+00:00"
#: Classes of errors that are counted.
CLASSES = ["timeout", "Error code: 5", "connection", "Error_code", "validation"]


def _episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.latest_rows(table(spark, sf_dir, "episodes"), "id", "updated_at")


def _dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.latest_rows(table(spark, sf_dir, "dead_letter"), "episode_id", "failed_at")


def _on(f, *tables):
    """A query of the function's name on its tables."""
    readers = {"e": _episodes, "d": _dead}
    run = lambda spark, sf_dir: f(*[readers[t](spark, sf_dir) for t in tables])
    run.__doc__ = f.__doc__
    return run


def a2_total_rows(e: DataFrame) -> DataFrame:
    """All episodes."""
    return e.agg(F.count(F.lit(1)).alias("n"))


def a4_reap_fairness(e: DataFrame) -> DataFrame:
    """Fairness of the reaping."""
    return Q.reap_fairness(e)


def a8_adapter_stats(e: DataFrame) -> DataFrame:
    """Claimed active rows by writer."""
    return e.where(F.col("status").isin(Q.ACTIVE) & F.col("claimed_by").isNotNull()).groupBy("status", "claimed_by").agg(F.count(F.lit(1)).alias("n"))


def s6_lookup(e: DataFrame) -> DataFrame:
    """The row of the first id with its payload's name."""
    first = e.agg(F.min("id")).first()[0]
    return Q.looked_up(e, first).select("id", "status", F.try_element_at("payload", F.lit("name")).alias("name"))


def pred5_recovered(d: DataFrame) -> DataFrame:
    """Recovered letters of two classes."""
    return Q.letters_where(d, False, ["timeout", "Error_code"]).select("episode_id")


def m15_replay_one(e: DataFrame, d: DataFrame) -> DataFrame:
    """The first letter whose episode is there, replayed by hand."""
    both = d.select(F.col("episode_id").alias("id"), "last_error").where(Q.retryable(F.col("last_error"))).join(e.select("id"), "id").agg(F.min("id")).first()[0]
    queued, closed = Q.replay_one(e, d, both or "", NOW)
    return queued.select("id", "status", "attempt_count", "enqueued_at").join(closed.select(F.col("episode_id").alias("id"), "recovered_attempts"), "id", "left")


def m11_checkpoints(e: DataFrame) -> DataFrame:
    """Processing rows with a checkpoint that names their attempt."""
    rows = e.where("status = 'processing'")
    return Q.checkpointed(rows, F.concat(F.lit("attempt "), F.col("attempt_count").cast("string")), NOW).select("id", "checkpoint", "updated_at")


def pred1_retryable(e: DataFrame) -> DataFrame:
    """Failed and aborted rows by whether their error may run again."""
    return e.where(F.col("status").isin("failed", "aborted")).groupBy("last_error", Q.retryable(F.col("last_error")).alias("may")).agg(F.count(F.lit(1)).alias("n"))


def pred2_allowlist(e: DataFrame) -> DataFrame:
    """Rows that an allowlist of two codes lets through: all of them, or any."""
    policy = Q.RetryPolicy(allowed_codes=("Error code: 500", "InternalServerError"))
    either = Q.RetryPolicy(allowed_codes=("Error code: 500", "timeout"))
    return e.agg(F.count_if(Q.retryable(F.col("last_error"), policy)).alias("both"), F.count_if(Q.retryable(F.col("last_error"), either)).alias("two"), F.count_if(Q.retryable(F.col("last_error"), either, True)).alias("any_of_two"))


def pred4_like_classes(d: DataFrame) -> DataFrame:
    """Open letters of a class as a text and as a pattern."""
    d = Q.open_letters(d)
    return d.agg(F.count_if(Q.in_classes(F.col("last_error"), ["error_code"])).alias("as_text"), F.count_if(Q.like_classes(F.col("last_error"), ["error_code"])).alias("as_pattern"))


def pred6_old_letters(d: DataFrame) -> DataFrame:
    """Letters that may be replayed after 30 days."""
    return Q.replay_candidates(d, NOW, None, 30 * 86400).select("episode_id")


def pred15_cut_errors(d: DataFrame) -> DataFrame:
    """Errors cut to 20 characters."""
    return d.select("episode_id", Q.cut_text(F.col("last_error"), 20).alias("error"))


def o1_claim(e: DataFrame) -> DataFrame:
    """The next queued rows."""
    return Q.claim_batch(e).select("id")


def o2_reap_pick(e: DataFrame, d: DataFrame) -> DataFrame:
    """The failed rows that are reaped next."""
    return Q.first_by_time(Q.reap_candidates(e, d), "updated_at", "id", 25).select("id", "status")


def o3_replay_pick(d: DataFrame) -> DataFrame:
    """The letters that are replayed next."""
    return Q.first_by_time(Q.replay_candidates(d, NOW, ["timeout", "error_code"]), "failed_at", "episode_id", 10).select("episode_id")


def o4_dead_letters(d: DataFrame) -> DataFrame:
    """The latest open letters."""
    return Q.first_by_time(Q.open_letters(d), "failed_at", "episode_id", 15, True).select("episode_id", "attempt_count")


def o7_holders(e: DataFrame) -> DataFrame:
    """The newest active row of each hash."""
    return Q.active_holders(e)


def m5_canonical_hash(e: DataFrame) -> DataFrame:
    """Rows whose stored canonical hash is, or isn't, the computed one."""
    own = Q.canonical_hash(F.col("payload_json"))
    return e.select(F.when(F.col("canonical_hash").isNull(), "absent").when(own.isNull(), "no hash").when(own == F.col("canonical_hash"), "same").otherwise("other").alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def m6_backfill(e: DataFrame) -> DataFrame:
    """The canonical hash of each row after the backfill."""
    return Q.backfilled(e).select("id", "canonical_hash")


def m12_reap_stuck(e: DataFrame) -> DataFrame:
    """New states of stuck rows."""
    return Q.reap_stuck(e, NOW).select("id", "status", "attempt_count", "last_error", "enqueued_at")


def m13_reap_failed(e: DataFrame, d: DataFrame) -> DataFrame:
    """Rows that the reaper queues again."""
    return Q.reap_failed(e, d, NOW, Q.RetryPolicy(reap_limit=60)).select("id", "status", "attempt_count", "consecutive_failures", "enqueued_at")


def m16_replay(e: DataFrame, d: DataFrame) -> DataFrame:
    """Episodes that a replay queues again."""
    return Q.replay_batch(e, d, NOW, 50)[0].select("id", "status", "attempt_count", "last_error")


def m16_closed(e: DataFrame, d: DataFrame) -> DataFrame:
    """Letters that a replay closes."""
    return Q.replay_batch(e, d, NOW, 50)[1].select("episode_id", "recovered_at", "recovered_attempts")


def m17_refusals(d: DataFrame) -> DataFrame:
    """Open letters by the code that refuses their replay."""
    return Q.open_letters(d).groupBy(Q.refusal(F.col("last_error")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


def m18_backstop(e: DataFrame) -> DataFrame:
    """Queued rows whose payload is already done."""
    return Q.backstop(e.where("status = 'queued'"), e).select("id")


def _error_parts(error):
    return F.substring_index(error, ":", 1), F.trim(F.regexp_replace(error, "^[^:]*:", ""))


def m20_retry_decision(e: DataFrame) -> DataFrame:
    """Whether failed rows run again, by error."""
    cls, msg = _error_parts(F.col("last_error"))
    return e.where("status = 'failed' and last_error is not null").groupBy("last_error", "attempt_count", Q.retry_decision(F.col("attempt_count"), cls, msg).alias("decision"), Q.backoff_seconds(F.col("attempt_count")).alias("backoff"), Q.error_text(cls, F.when(F.col("attempt_count") > 1, msg)).alias("shown")).agg(F.count(F.lit(1)).alias("n"))


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead letters' payloads arriving again, and each of every third twice."""
    again = F.when(F.pmod(F.ascii(F.substring("episode_id", -1, 1)), F.lit(3)) == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = _dead(spark, sf_dir).where(F.col("episode_id").isNotNull()).select("episode_id", "payload_json", F.explode(again).alias("turn"))
    return rows.select(F.concat_ws("#", "episode_id", F.col("turn").cast("string")).alias("id"), "payload_json", F.lit("mcp").alias("claimed_by"), F.concat_ws("#", F.col("turn").cast("string"), "episode_id").alias("seq"))


def _gate(mode: str, part: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = Q.gate_enqueue(_episodes(spark, sf_dir), _arrivals(spark, sf_dir), mode, NOW)[part]
        return out.select("id", "status", "canonical_hash", "dedup_gate") if part == 0 else out.select("action", "payload_hash", "existing_episode_id", "duplicate_episode_id")

    run.__doc__ = f"{'Rows appended' if part == 0 else 'Ledger rows'} with the gate on {mode}."
    return run


def m1_off_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows appended with an unknown mode, which is off."""
    return Q.gate_enqueue(_episodes(spark, sf_dir), _arrivals(spark, sf_dir), "sometimes", NOW)[0].select("id", "payload_hash", "dedup_gate")


def m7_daemon_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the daemon appends under enforcement."""
    return Q.daemon_enqueue(_episodes(spark, sf_dir), _arrivals(spark, sf_dir), "Enforce", NOW, "shared")[0].groupBy("claimed_by").agg(F.count(F.lit(1)).alias("n"))


def o5_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest ledger rows of an enforced batch."""
    ledger = Q.gate_enqueue(_episodes(spark, sf_dir), _arrivals(spark, sf_dir), "enforce", NOW)[1]
    return Q.ledger_recent(ledger, 15).select("action", "existing_episode_id", "duplicate_episode_id")


def k3_dream_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs folded from their start and final rows: the first start, the last of every other field that is there."""
    rows = table(spark, sf_dir, "dream_runs").where(F.col("run_id").isNotNull())
    done = utc_time(F.col("completed_at"))
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(F.coalesce(done, F.lit("1970-01-01").cast("timestamp")), F.col(c)))).alias(c)
    folded = rows.withColumn("status", F.lower("status")).groupBy("run_id").agg(F.min(utc_time(F.col("started_at"))).alias("started"), F.max(done).alias("completed"), last("status"), F.max("episodes_evaluated").alias("episodes_evaluated"), last("phase_1_status"), last("error_message"))
    return folded


def o6_recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest runs."""
    return k3_dream_runs(spark, sf_dir).orderBy(F.col("started").desc_nulls_last(), "run_id").limit(20).select("run_id", "status")


QUERIES = {
    "a1_status_counts": _on(Q.status_counts, "e", "d"), "a2_total_rows": _on(a2_total_rows, "e"), "a3_dedup_stats": _on(Q.dedup_stats, "e"), "a4_reap_fairness": _on(a4_reap_fairness, "e"), "a5_class_counts": _on(lambda d: Q.class_counts(d, CLASSES), "d"), "a7_breakdown": _on(lambda d: Q.breakdown(d, CLASSES), "d"), "a8_adapter_stats": _on(Q.adapter_stats, "e", "d"), "a8_claimed": _on(a8_adapter_stats, "e"), "s6_lookup": _on(s6_lookup, "e"), "pred5_recovered": _on(pred5_recovered, "d"), "m15_replay_one": _on(m15_replay_one, "e", "d"), "m11_checkpoints": _on(m11_checkpoints, "e"), "m1_off_rows": m1_off_rows, "m7_daemon_rows": m7_daemon_rows, "o5_ledger": o5_ledger,
    "pred1_retryable": _on(pred1_retryable, "e"), "pred2_allowlist": _on(pred2_allowlist, "e"), "pred4_like_classes": _on(pred4_like_classes, "d"), "pred6_old_letters": _on(pred6_old_letters, "d"), "pred15_cut_errors": _on(pred15_cut_errors, "d"),
    "o1_claim": _on(o1_claim, "e"), "o2_reap_pick": _on(o2_reap_pick, "e", "d"), "o3_replay_pick": _on(o3_replay_pick, "d"), "o4_dead_letters": _on(o4_dead_letters, "d"), "o6_recent_runs": o6_recent_runs, "o7_holders": _on(o7_holders, "e"),
    "m2_observe_rows": _gate("observe", 0), "m2_observe_ledger": _gate("observe", 1), "m3_enforce_rows": _gate("enforce", 0), "m3_enforce_ledger": _gate("enforce", 1),
    "m5_canonical_hash": _on(m5_canonical_hash, "e"), "m6_backfill": _on(m6_backfill, "e"), "m12_reap_stuck": _on(m12_reap_stuck, "e"), "m13_reap_failed": _on(m13_reap_failed, "e", "d"), "m16_replay": _on(m16_replay, "e", "d"), "m16_closed": _on(m16_closed, "e", "d"), "m17_refusals": _on(m17_refusals, "d"), "m18_backstop": _on(m18_backstop, "e"), "m20_retry_decision": _on(m20_retry_decision, "e"),
    "k3_dream_runs": k3_dream_runs,
}

_T = lambda c: rf"(try_cast(CASE WHEN regexp_matches({c}, '([zZ]|[+-]\d{{2}}:?\d{{2}})$') THEN {c} ELSE {c} || '+00:00' END AS TIMESTAMPTZ) AT TIME ZONE 'UTC')"
_E_COLS = ["id", "status", "payload_json", "enqueued_at", "started_at", "finished_at", "attempt_count", "consecutive_failures", "last_error", "checkpoint", "created_at", "updated_at", "last_replay_at", "payload_hash", "claimed_by", "canonical_hash", "dedup_gate"]
_D_COLS = ["episode_id", "payload_json", "last_error", "attempt_count", "failed_at", "recovered_at", "recovered_attempts"]
_latest = lambda t, k, u, cols: f"SELECT * FROM {t} QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY {', '.join(f'{c} DESC NULLS LAST' for c in [_T(u), *cols])}) = 1"
_NOW = f"TIMESTAMP '{NOW[:19]}'"
_JP = lambda n: f"CASE WHEN json_valid(payload_json) THEN json_extract_string(payload_json, '$.{n}') END"
_HASH = f"CASE WHEN {_JP('content')} IS NOT NULL AND {_JP('group_id')} IS NOT NULL AND {_JP('source_description')} IS NOT NULL THEN sha256({_JP('content')} || '|' || {_JP('group_id')} || '|' || {_JP('source_description')}) END"
_MAY = "(last_error IS NULL OR (instr(lower(last_error), 'error code: 404') = 0 AND instr(lower(last_error), 'error code: 402') = 0))"
_WITH = f"WITH e AS ({_latest('episodes', 'id', 'updated_at', _E_COLS)}), d AS ({_latest('dead_letter', 'episode_id', 'failed_at', _D_COLS)}), o AS (SELECT * FROM d WHERE recovered_at IS NULL) "
_IN = lambda c: f"instr(lower(last_error), lower('{c}')) > 0"
_ANY = "coalesce(" + " OR ".join(_IN(c) for c in CLASSES) + ", false)"
_LIMITED = f"cand AS (SELECT * FROM e WHERE status IN ('failed', 'aborted') AND {_MAY} AND attempt_count < 3 AND NOT (status = 'failed' AND EXISTS (SELECT 1 FROM o WHERE o.episode_id = e.id)))"
_HELD = "held AS (SELECT canonical_hash h, id hid FROM e WHERE dedup_gate = 'enforce' AND canonical_hash IS NOT NULL AND status IN ('queued', 'processing'))"
_FREE = lambda src, order: f"free AS (SELECT * FROM {src} w WHERE NOT coalesce(dedup_gate = 'enforce' AND canonical_hash IS NOT NULL, false) UNION ALL SELECT * FROM (SELECT * FROM {src} w WHERE dedup_gate = 'enforce' AND canonical_hash IS NOT NULL AND NOT EXISTS (SELECT 1 FROM held WHERE h = w.canonical_hash AND hid <> w.id)) QUALIFY row_number() OVER (PARTITION BY canonical_hash ORDER BY {order}) = 1)"
_ARR = f"arr AS (SELECT episode_id || '#' || t id, payload_json, t || '#' || episode_id seq FROM (SELECT *, unnest(CASE WHEN ascii(right(episode_id, 1)) % 3 = 0 THEN [1, 2] ELSE [1] END) t FROM d WHERE episode_id IS NOT NULL)), act AS (SELECT coalesce(canonical_hash, payload_hash) h, arg_max(id, ({_T('created_at')}, id)) eid FROM e WHERE status IN ('queued', 'processing') GROUP BY 1), j AS (SELECT a.id, a.h, coalesce(act.eid, CASE WHEN a.h IS NOT NULL AND a.f <> a.id THEN a.f END) ex FROM (SELECT *, first_value(id) OVER (PARTITION BY h ORDER BY seq, id) f FROM (SELECT *, {_HASH} h FROM arr)) a LEFT JOIN act ON act.h = a.h)"
_REPLAY = f"pick AS (SELECT * FROM o WHERE {_MAY} ORDER BY {_T('failed_at')} NULLS FIRST, episode_id LIMIT 50), {_HELD}, want AS (SELECT e.*, {_T('pick.failed_at')} ft FROM e JOIN pick ON pick.episode_id = e.id WHERE coalesce(e.status <> 'done', true)), {_FREE('want', 'ft NULLS FIRST, id')}"
_STUCK = f"stuck AS (SELECT * FROM e WHERE status = 'processing' AND started_at <> '' AND coalesce(epoch_us({_NOW}) - epoch_us({_T('started_at')}) >= 900000000, true)), again AS (SELECT * FROM stuck WHERE NOT coalesce(attempt_count + 1 >= 3, false)), {_HELD}, {_FREE('again', 'id')}"
_CLS, _MSG = "split_part(last_error, ':', 1)", "trim(regexp_replace(last_error, '^[^:]*:', ''))"
_RUNS = f"SELECT run_id, min({_T('started_at')}) started, max({_T('completed_at')}) completed, arg_max(s, (ct, s)) FILTER (s IS NOT NULL) status, max(episodes_evaluated) episodes_evaluated, arg_max(phase_1_status, (ct, phase_1_status)) FILTER (phase_1_status IS NOT NULL) phase_1_status, arg_max(error_message, (ct, error_message)) FILTER (error_message IS NOT NULL) error_message FROM (SELECT *, lower(status) s, coalesce({_T('completed_at')}, TIMESTAMP '1970-01-01 00:00:00') ct FROM dream_runs WHERE run_id IS NOT NULL) GROUP BY run_id"
ORACLES = {
    "a1_status_counts": _WITH + "SELECT status, count(*) n FROM e GROUP BY 1 UNION ALL SELECT 'dlq', count(*) FROM o",
    "a2_total_rows": _WITH + "SELECT count(*) n FROM e",
    "a3_dedup_stats": _WITH + "SELECT count(payload_hash) hashed_rows, count(canonical_hash) canonical_rows, count(*) FILTER (status = 'skipped_duplicate') backstop_skips, (SELECT count(*) FROM (SELECT 1 FROM e WHERE payload_hash IS NOT NULL AND status IN ('queued', 'processing') GROUP BY payload_hash HAVING count(*) > 1)) active_duplicates, CAST(0 AS BIGINT) observed_hits FROM e",
    "a4_reap_fairness": _WITH + f"SELECT count(*) eligible, count(*) FILTER (attempt_count >= 3) exhausted, count(last_replay_at) repeated_turns, round_even(count(last_replay_at) / count(*), 4) repeat_rate, min({_T('enqueued_at')}) oldest, max({_T('enqueued_at')}) newest FROM e WHERE status IN ('failed', 'aborted')",
    "a5_class_counts": _WITH + " UNION ALL ".join(f"SELECT '{c}' AS class, count(*) FILTER ({_IN(c)}) n FROM o" for c in CLASSES),
    "a7_breakdown": _WITH + f"SELECT count(*) open, count(*) FILTER ({_ANY}) classified, count(*) - count(*) FILTER ({_ANY}) unclassified FROM o",
    "a8_adapter_stats": _WITH + "SELECT 'by_status' part, status AS name, count(*) n FROM e GROUP BY status UNION ALL SELECT 'dlq_open', NULL, count(*) FROM o UNION ALL SELECT 'claimed_active', NULL, count(*) FROM e WHERE claimed_by IS NOT NULL AND status IN ('queued', 'processing')",
    "s6_lookup": _WITH + f"SELECT id, status, {_JP('name')} AS name FROM e WHERE id = (SELECT min(id) FROM e)",
    "pred5_recovered": _WITH + f"SELECT episode_id FROM d WHERE recovered_at IS NOT NULL AND ({_IN('timeout')} OR {_IN('Error_code')})",
    "m15_replay_one": _WITH + f", pk AS (SELECT min(id) i FROM e JOIN d ON d.episode_id = e.id WHERE d.last_error IS NULL OR (instr(lower(d.last_error), 'error code: 404') = 0 AND instr(lower(d.last_error), 'error code: 402') = 0)), {_HELD} SELECT id, 'queued' status, CAST(0 AS BIGINT) attempt_count, '{NOW}' enqueued_at, (SELECT attempt_count FROM d WHERE episode_id = e.id) recovered_attempts FROM e WHERE id = (SELECT i FROM pk) AND NOT coalesce(dedup_gate = 'enforce' AND EXISTS (SELECT 1 FROM held WHERE h = e.canonical_hash AND hid <> e.id), false)",
    "m11_checkpoints": _WITH + f"SELECT id, 'attempt ' || attempt_count checkpoint, '{NOW}' updated_at FROM e WHERE status = 'processing'",
    "m1_off_rows": _WITH + f", {_ARR} SELECT id, CAST(NULL AS VARCHAR) payload_hash, 'off' dedup_gate FROM j",
    "m7_daemon_rows": _WITH + f", {_ARR} SELECT 'daemon' claimed_by, count(*) n FROM j WHERE ex IS NULL",
    "o5_ledger": _WITH + f", {_ARR} SELECT 'rejected' action, ex existing_episode_id, id duplicate_episode_id FROM j WHERE ex IS NOT NULL ORDER BY id LIMIT 15",
    "a8_claimed": _WITH + "SELECT status, claimed_by, count(*) n FROM e WHERE status IN ('queued', 'processing') AND claimed_by IS NOT NULL GROUP BY 1, 2",
    "pred1_retryable": _WITH + f"SELECT last_error, {_MAY} may, count(*) n FROM e WHERE status IN ('failed', 'aborted') GROUP BY 1, 2",
    "pred2_allowlist": _WITH + f"SELECT count(*) FILTER (last_error IS NULL OR ({_IN('Error code: 500')} AND {_IN('InternalServerError')})) AS both, count(*) FILTER (last_error IS NULL OR ({_IN('Error code: 500')} AND {_IN('timeout')})) two, count(*) FILTER (last_error IS NULL OR {_IN('Error code: 500')} OR {_IN('timeout')}) any_of_two FROM e",
    "pred4_like_classes": _WITH + f"SELECT count(*) FILTER ({_IN('error_code')}) as_text, count(*) FILTER (lower(last_error) LIKE '%error_code%') as_pattern FROM o",
    "pred6_old_letters": _WITH + f"SELECT episode_id FROM o WHERE {_MAY} AND epoch({_T('failed_at')})::BIGINT <= epoch({_NOW})::BIGINT - 2592000",
    "pred15_cut_errors": _WITH + "SELECT episode_id, CASE WHEN length(last_error) > 20 THEN left(last_error, 20) || '…' ELSE last_error END error FROM d",
    "o1_claim": _WITH + f"SELECT id FROM e WHERE status = 'queued' ORDER BY {_T('enqueued_at')} NULLS FIRST, id LIMIT 20",
    "o2_reap_pick": _WITH + f", {_LIMITED} SELECT id, status FROM cand ORDER BY {_T('updated_at')} NULLS FIRST, id LIMIT 25",
    "o3_replay_pick": _WITH + f"SELECT episode_id FROM o WHERE {_MAY} AND (lower(last_error) LIKE '%timeout%' OR lower(last_error) LIKE '%error_code%') ORDER BY {_T('failed_at')} NULLS FIRST, episode_id LIMIT 10",
    "o4_dead_letters": _WITH + f"SELECT episode_id, attempt_count FROM o ORDER BY {_T('failed_at')} DESC NULLS LAST, episode_id LIMIT 15",
    "o6_recent_runs": f"SELECT run_id, status FROM ({_RUNS}) ORDER BY started DESC NULLS LAST, run_id LIMIT 20",
    "o7_holders": _WITH + f"SELECT coalesce(canonical_hash, payload_hash) hash, arg_max(id, ({_T('created_at')}, id)) existing_id FROM e WHERE status IN ('queued', 'processing') AND coalesce(canonical_hash, payload_hash) IS NOT NULL GROUP BY 1",
    "m2_observe_rows": _WITH + f", {_ARR} SELECT id, 'queued' status, h canonical_hash, 'observe' dedup_gate FROM j",
    "m2_observe_ledger": _WITH + f", {_ARR} SELECT 'detected' action, h payload_hash, ex existing_episode_id, id duplicate_episode_id FROM j WHERE ex IS NOT NULL",
    "m3_enforce_rows": _WITH + f", {_ARR} SELECT id, 'queued' status, h canonical_hash, 'enforce' dedup_gate FROM j WHERE ex IS NULL",
    "m3_enforce_ledger": _WITH + f", {_ARR} SELECT 'rejected' action, h payload_hash, ex existing_episode_id, id duplicate_episode_id FROM j WHERE ex IS NOT NULL",
    "m5_canonical_hash": _WITH + f"SELECT CASE WHEN canonical_hash IS NULL THEN 'absent' WHEN h IS NULL THEN 'no hash' WHEN h = canonical_hash THEN 'same' ELSE 'other' END state, count(*) n FROM (SELECT *, {_HASH} h FROM e) GROUP BY 1",
    "m6_backfill": _WITH + f"SELECT id, coalesce(canonical_hash, {_HASH}) canonical_hash FROM e",
    "m12_reap_stuck": _WITH + f", {_STUCK} SELECT id, 'aborted' status, attempt_count + 1 attempt_count, '{Q.STUCK_ERROR}' last_error, enqueued_at FROM stuck WHERE attempt_count + 1 >= 3 UNION ALL SELECT id, 'queued', attempt_count + 1, last_error, '{NOW}' FROM free UNION ALL SELECT id, 'skipped_duplicate', attempt_count, '{Q.HELD_ERROR}', enqueued_at FROM again WHERE id NOT IN (SELECT id FROM free)",
    "m13_reap_failed": _WITH + f", {_LIMITED}, pick AS (SELECT * FROM cand ORDER BY {_T('updated_at')} NULLS FIRST, id LIMIT 60), {_HELD}, {_FREE('pick', _T('updated_at') + ' NULLS FIRST, id')} SELECT id, 'queued' status, attempt_count, CAST(0 AS BIGINT) consecutive_failures, '{NOW}' enqueued_at FROM free",
    "m16_replay": _WITH + f", {_REPLAY} SELECT id, 'queued' status, CAST(0 AS BIGINT) attempt_count, CAST(NULL AS VARCHAR) last_error FROM free",
    "m16_closed": _WITH + f", {_REPLAY} SELECT episode_id, '{NOW}' recovered_at, attempt_count recovered_attempts FROM pick WHERE episode_id NOT IN (SELECT id FROM want WHERE id NOT IN (SELECT id FROM free))",
    "m17_refusals": _WITH + f"SELECT CASE WHEN {_IN('Error code: 404')} THEN 'Error code: 404' WHEN {_IN('Error code: 402')} THEN 'Error code: 402' END code, count(*) n FROM o GROUP BY 1",
    "m18_backstop": _WITH + "SELECT id FROM e WHERE status = 'queued' AND EXISTS (SELECT 1 FROM e x WHERE x.status = 'done' AND x.id <> e.id AND coalesce(x.canonical_hash, x.payload_hash) = coalesce(e.canonical_hash, e.payload_hash))",
    "m20_retry_decision": _WITH + f"SELECT last_error, attempt_count, CASE WHEN attempt_count + 1 >= 3 OR {_CLS} IN ('TypeError', 'ValueError', 'KeyError', 'ValidationError') THEN 'dead' ELSE 'retry' END decision, least(2.0 * pow(2.0, greatest(attempt_count - 1, 0)), 300.0)::DOUBLE backoff, {_CLS} || ': ' || CASE WHEN attempt_count > 1 THEN {_MSG} ELSE '<no message>' END shown, count(*) n FROM e WHERE status = 'failed' AND last_error IS NOT NULL GROUP BY ALL",
    "k3_dream_runs": _RUNS,
}
