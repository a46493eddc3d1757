import pytest
from pyspark.sql import functions as F

from loomgraph.operators import queue as Q
from loomgraph.streaming.ingest import EPISODES, LETTERS, shaped
from tests.conftest import rows_of

NOW = "2026-10-20T00:00:00+00:00"


def episodes(spark, *rows):
    """Episodes from dicts; what isn't given is null, attempts are 0."""
    names = sorted({k for r in rows for k in r} | {"id", "attempt_count"})
    kinds = {"attempt_count": "long", "consecutive_failures": "long"}
    df = spark.createDataFrame([tuple(r.get(n, 0 if n == "attempt_count" else None) for n in names) for r in rows], ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names))
    return shaped(df, EPISODES)


def letters(spark, *rows):
    names = ["episode_id", "last_error", "attempt_count", "failed_at", "recovered_at"]
    return shaped(spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], "episode_id string, last_error string, attempt_count long, failed_at string, recovered_at string"), LETTERS)


ERRORS = [None, "NotFoundError: Error code: 404 - x", "ERROR CODE: 402", "Error code: 500", "ConnectionError: y", "Errorxcode: 404"]


def test_retry_policy_and_classes(spark):
    d = spark.createDataFrame([(e,) for e in ERRORS], "e string")
    assert [r[0] for r in d.select(Q.retryable(F.col("e"))).collect()] == [True, False, False, True, True, True]
    allow = Q.RetryPolicy(allowed_codes=("Error code: 500", "connection"))
    assert [r[0] for r in d.select(Q.retryable(F.col("e"), allow)).collect()] == [True, False, False, False, False, False]
    assert [r[0] for r in d.select(Q.retryable(F.col("e"), allow, True)).collect()] == [True, False, False, True, True, False]
    assert d.where(Q.in_classes(F.col("e"), ["error_code"])).count() == 0
    assert d.where(Q.like_classes(F.col("e"), ["error_code"])).count() == 4
    assert [r[0] for r in d.select(Q.refusal(F.col("e"))).collect()] == [None, "Error code: 404", "Error code: 402", None, None, None]


def test_reap_failed_leaves_owned_permanent_and_exhausted(spark):
    e = episodes(
        spark, {"id": "ok", "status": "failed", "updated_at": "2026-01-02"}, {"id": "owned", "status": "failed"}, {"id": "dead", "status": "aborted", "updated_at": "2026-01-01"}, {"id": "perm", "status": "failed", "last_error": "Error code: 404"},
        {"id": "spent", "status": "failed", "attempt_count": 3}, {"id": "done", "status": "done"},
    )
    d = letters(spark, {"episode_id": "owned", "failed_at": NOW}, {"episode_id": "dead", "failed_at": NOW})
    assert [r["id"] for r in Q.first_by_time(Q.reap_candidates(e, d), "updated_at", "id", 9).collect()] == ["dead", "ok"]
    got = Q.reap_failed(e, d, NOW, Q.RetryPolicy(reap_limit=1)).collect()
    assert [(r["id"], r["status"], r["enqueued_at"], r["consecutive_failures"]) for r in got] == [("dead", "queued", NOW, 0)]


def test_requeue_keeps_payloads_unique(spark):
    row = lambda i, s, h, t, gate="enforce": {"id": i, "status": s, "canonical_hash": h, "updated_at": t, "dedup_gate": gate}
    e = episodes(spark, row("a", "failed", "h1", "2026-01-01"), row("b", "queued", "h1", "2026-01-01"), row("c", "failed", "h2", "2026-01-03"), row("d", "failed", "h2", "2026-01-02"), row("f", "failed", "h1", "2026-01-01", "observe"), row("g", "failed", None, "2026-01-01"))
    assert rows_of(Q.reap_failed(e, letters(spark), NOW).select("id")) == [("d",), ("f",), ("g",)]


def test_reap_stuck(spark):
    row = lambda i, t, n=0, h=None: {"id": i, "status": "processing", "started_at": t, "attempt_count": n, "canonical_hash": h, "dedup_gate": "enforce"}
    e = episodes(spark, row("old", "2026-10-19T23:00:00Z"), row("new", "2026-10-19T23:59:00+00:00"), row("edge", "2026-10-19 23:45:00"), row("last", "2026-10-19T00:00:00", 2), row("none", None), row("blank", ""), row("odd", "yesterday"), row("held", "2026-10-01", 0, "h"), {"id": "q", "status": "queued", "canonical_hash": "h", "dedup_gate": "enforce"})
    got = {r["id"]: (r["status"], r["attempt_count"]) for r in Q.reap_stuck(e, NOW).collect()}
    assert got == {"old": ("queued", 1), "edge": ("queued", 1), "last": ("aborted", 3), "odd": ("queued", 1), "held": ("skipped_duplicate", 0)}


def test_gate(spark):
    payload = '{"content":"c","group_id":"g","source_description":"s","name":"%s"}'
    e = shaped(episodes(spark, {"id": "old", "status": "queued", "payload_json": payload % 1, "created_at": "2026-01-01"}).withColumn("canonical_hash", Q.canonical_hash(F.col("payload_json"))), EPISODES)
    other = payload.replace('"c"', '"d"')
    new = spark.createDataFrame([("n1", payload % 2, "w", "1"), ("n2", other % 3, "w", "2"), ("n3", other % 4, "w", "3"), ("n4", "cut off {", "w", "4"), ("n5", "cut off {", "w", "5")], "id string, payload_json string, claimed_by string, seq string")
    for mode, kept, said in (("off", 5, []), ("observe", 5, [("n1", "old"), ("n3", "n2")]), ("enforce", 3, [("n1", "old"), ("n3", "n2")])):
        rows, ledger = Q.gate_enqueue(e, new, mode, NOW)
        assert rows.count() == kept and rows_of(ledger.select("duplicate_episode_id", "existing_episode_id")) == said
    rows, ledger = Q.gate_enqueue(e, new, "maybe", NOW)
    assert rows.count() == 5 and ledger.count() == 0 and rows.first()["dedup_gate"] == "off"
    assert [Q.mode_of(x) for x in (True, False, " ENFORCE ", None, 3)] == ["observe", "off", "enforce", "off", "off"]
    with pytest.raises(PermissionError):
        Q.daemon_enqueue(e, new, "off", NOW, "mcp_only")
    assert {r["claimed_by"] for r in Q.daemon_enqueue(e, new, "off", NOW, None, "d1")[0].collect()} == {"d1"}


def test_replay_one_and_lookup(spark):
    held = {"canonical_hash": "h", "dedup_gate": "enforce"}
    e = episodes(spark, {"id": "a", "status": "done", "attempt_count": 5, "payload_json": '{"name":"x","n":1}'}, {"id": "p", "status": "aborted", "payload_json": "{"}, {"id": "w", "status": "aborted", **held}, {"id": "q", "status": "queued", **held})
    d = letters(spark, {"episode_id": "a", "attempt_count": 5, "recovered_at": NOW}, {"episode_id": "p", "last_error": "Error code: 402"}, {"episode_id": "w"}, {"episode_id": "gone"})
    got = {i: tuple(x.count() for x in Q.replay_one(e, d, i, NOW)) for i in ("a", "p", "w", "gone", "none")}
    assert got == {"a": (1, 1), "p": (0, 0), "w": (0, 0), "gone": (0, 0), "none": (0, 0)}
    assert [Q.looked_up(e, i).first()["payload"] for i in ("a", "p")] == [{"name": "x", "n": "1"}, {}]
    assert [Q.letters_where(d, x).count() for x in (None, True, False)] == [4, 3, 1]


def test_rows_without_a_hash_are_no_group(spark):
    e = episodes(spark, *[{"id": f"i{n}", "status": "failed", "dedup_gate": "enforce"} for n in range(5)], *[{"id": f"h{n}", "status": "failed", "dedup_gate": "enforce", "canonical_hash": "h"} for n in range(3)])
    assert {r["id"] for r in Q.free_to_activate(e, e, [F.col("id")]).collect()} == {"i0", "i1", "i2", "i3", "i4", "h0"}


def test_replay(spark):
    e = episodes(spark, {"id": "a", "status": "aborted", "attempt_count": 5, "last_error": "x"}, {"id": "b", "status": "done"})
    d = letters(spark, {"episode_id": "a", "attempt_count": 5, "failed_at": "2026-01-01"}, {"episode_id": "b", "attempt_count": 1, "failed_at": "2026-01-02"}, {"episode_id": "gone", "attempt_count": 1, "failed_at": "2026-01-03"}, {"episode_id": "p", "last_error": "Error code: 402", "failed_at": "2026-01-01"}, {"episode_id": "r", "failed_at": "2026-01-01", "recovered_at": NOW})
    queued, closed = Q.replay_batch(e, d, NOW)
    assert rows_of(queued.select("id", "status", "attempt_count", "last_error")) == [("a", "queued", 0, None)]
    assert rows_of(closed.select("episode_id", "recovered_attempts")) == [("a", 5), ("b", 1), ("gone", 1)]
    assert Q.replay_candidates(d, "2026-01-03T00:00:00Z", None, 86400).count() == 2


def test_marks_and_small_expressions(spark):
    e = episodes(spark, {"id": "a", "status": "processing", "attempt_count": 1})
    d = letters(spark, {"episode_id": "a", "attempt_count": 1, "failed_at": NOW})
    done, closed = Q.mark_done(e, d, NOW)
    assert done.first()["status"] == "done" and closed.count() == 1
    aborted, opened = Q.mark_aborted(e, F.lit("boom"), NOW)
    assert aborted.first()["attempt_count"] == 2 and opened.first()["recovered_at"] is None
    assert Q.replaced(e, aborted, "id").first()["status"] == "aborted"
    s = spark.createDataFrame([(1, "TimeoutError", ""), (2, "X", "y"), (1, "KeyError", "k"), (1, "X", "bad duplicate_facts")], "n long, c string, m string")
    got = s.select(Q.retry_decision(F.col("n"), F.col("c"), F.col("m")), Q.error_text(F.col("c"), F.col("m")), Q.backoff_seconds(F.col("n")), Q.cut_text(F.col("c"), 3)).collect()
    assert [tuple(r) for r in got] == [("retry", "TimeoutError: <no message>", 2.0, "Tim…"), ("dead", "X: y", 4.0, "X"), ("dead", "KeyError: k", 2.0, "Key…"), ("dead", "X: bad duplicate_facts", 2.0, "X")]


def test_statistics_of_nothing(spark):
    e, d = episodes(spark).limit(0), letters(spark).limit(0)
    assert rows_of(Q.status_counts(e, d)) == [("dlq", 0)]
    assert Q.reap_fairness(e).first()["repeat_rate"] == 0.0
    assert rows_of(Q.class_counts(d, ["a", "b"])) == [("a", 0), ("b", 0)]
    assert Q.dedup_stats(e).first()["hashed_rows"] == 0
