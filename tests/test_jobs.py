import json

import pytest
from pyspark.sql import functions as F

from loomgraph.functions.repair import append_quirks, repair_json, rule_for, with_repairs
from loomgraph.operators.dream import dream
from loomgraph.plans.skew import spread_join
from loomgraph.plans.versions import VersionedTable
from loomgraph.sources.graph import MemoryGraph
from loomgraph.sources.reports import dispatched, last_reports, read_reports, severity_at_least, write_reports
from loomgraph.streaming.ingest import EPISODES, LEDGER, LETTERS, current, enqueue_batch, ingest, sweep, windowed_counts
from tests.conftest import rows_of

NOW = "2026-10-20T00:00:00+00:00"

# drifted payloads and what they repair to
PAYLOADS = [
    ("SummarizedEntities", '{"summary_list":[{"name":"Harbour"}]}', '{"summaries":[{"name":"Harbour","summary":""}]}'),
    ("SummarizedEntities", '{"properties":{"summaries":[{"summary":"tides"}]},"lang":"en"}', '{"summaries":[{"summary":"tides","name":"<unnamed>"}]}'),
    ("SummarizedEntities", '{"SummarizedEntities":{"name":"Quay","summary":"long"}}', '{"summaries":[{"name":"Quay","summary":"long"}]}'),
    ("SummarizedEntities", '"[{\\"name\\":\\"Pier\\"}]"', '{"summaries":[{"name":"Pier","summary":""}]}'),
    ("SummarizedEntities", '{"unrelated":1}', '{"summaries":[]}'),
    ("ExtractedEntities", '[{"name":"Crane","entity_type_id":"12","episode_indices":"5"},"Dock",{"entity_type_id":false}]', '{"extracted_entities":[{"name":"Crane","entity_type_id":12,"episode_indices":[5]},{"name":"Dock","entity_type_id":0,"episode_indices":[0]},{"entity_type_id":0,"episode_indices":[0],"name":"<unnamed>"}]}'),
    ("ExtractedEntities", "{cut off", '{"extracted_entities":[]}'),
    ("EdgeDuplicate", '{"dup_idx":"(9; 8, seven)","contradictions":[null,"6",5.5]}', '{"duplicate_facts":[9,8],"contradicted_facts":[6,5]}'),
    ("EdgeDuplicate", '{"properties":{"duplicates":true},"contra_idx":" EMPTY "}', '{"duplicate_facts":[1],"contradicted_facts":[]}'),
    ("ExtractedEdges", '{"relations":[{"fact":"tug pulls barge"}],"run":3}', '{"edges":[{"fact":"tug pulls barge"}],"run":3}'),
    ("ExtractedEdges", None, '{"edges":[]}'),
    ("NodeResolutions", '{"name":"Buoy","id":4}', '{"entity_resolutions":[{"name":"Buoy","id":4}]}'),
    ("NodeResolutions", '{"nodes":"none"}', '{"entity_resolutions":[]}'),
    ("Weather", "{}", None),
]


@pytest.mark.parametrize(("schema", "payload", "want"), PAYLOADS)
def test_repairs(schema, payload, want):
    assert repair_json(schema, payload) == want


def test_more_repairs():
    assert json.loads(repair_json("ExtractedEntities", json.dumps('[{"name": ""}]'))) == {"extracted_entities": [{"name": "<unnamed>", "entity_type_id": 0, "episode_indices": [0]}]}
    assert json.loads(repair_json("SummarizedEntities", "[null, 5]")) == {"summaries": [{"name": "<unnamed>", "summary": ""}, {"name": "<unnamed>", "summary": "5"}]}
    assert json.loads(repair_json("EdgeDuplicate", '{"duplicate_facts": 2.7, "contradictions": "None"}')) == {"duplicate_facts": [2], "contradicted_facts": []}
    assert rule_for("EntityResolutions").name == "node_resolutions" and rule_for("x") is None


def test_versions(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    assert t.read() is None and t.manifests() == []
    assert t.publish(spark.range(2), "b", 1) == 1 and t.publish(spark.range(9), "b", 1) == 1 and t.publish(spark.range(3), "b", 2) == 2
    assert t.publish(spark.range(9), "b", 0) == 2  # however old a batch is, it isn't published again
    assert t.read().count() == 3 and t.read(1).count() == 2
    assert t.roll_back(1) == 3 and t.read().count() == 2 and t.last("b") == 1
    assert t.summary("id") == t.summary("id", 1) != t.summary("id", 2) and t.summary("id")["counts"] == {0: 1, 1: 1}
    with pytest.raises(ValueError):
        t.roll_back(9)


def test_ingest_and_sweep(spark, tmp_path):
    root, source = f"file://{tmp_path}/state", f"{tmp_path}/in"
    payload = '{"content":"%s","group_id":"g","source_description":"s","name":"n"}'
    rows = [("e1", payload % "a", "w", "1"), ("e2", payload % "a", "w", "2"), ("e3", payload % "b", "w", "3"), ("e4", payload % "c", "w", "4")]
    schema = "id string, payload_json string, claimed_by string, seq string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
    run = lambda: ingest(spark.readStream.schema(schema).parquet(source), root, f"{tmp_path}/cp", "enforce", lambda: NOW).awaitTermination(120)
    assert run()
    assert rows_of(current(VersionedTable(spark, f"{root}/episodes"), EPISODES).select("id", "status")) == [("e1", "queued"), ("e3", "queued"), ("e4", "queued")]
    assert current(VersionedTable(spark, f"{root}/ledger"), LEDGER).count() == 1
    enqueue_batch(spark, root, spark.createDataFrame(rows, schema), 0, "enforce", NOW)  # a replayed batch
    assert current(VersionedTable(spark, f"{root}/episodes"), EPISODES).count() == 3

    def work(claimed):
        return claimed.select("id", F.when(F.col("id") == "e3", "TimeoutError").when(F.col("id") == "e4", "KeyError").alias("error_class"), F.lit("").alias("message"))

    assert sweep(spark, root, work, NOW) == {"reaped": 0, "processed": 3, "succeeded": 1, "failed": 1, "dead": 1}
    assert rows_of(current(VersionedTable(spark, f"{root}/episodes"), EPISODES).select("id", "status", "attempt_count", "last_error")) == [("e1", "done", 0, None), ("e3", "failed", 1, "TimeoutError: <no message>"), ("e4", "aborted", 1, "KeyError: <no message>")]
    dead = VersionedTable(spark, f"{root}/dead_letter")
    assert rows_of(current(dead, LETTERS).select("episode_id", "recovered_at")) == [("e4", None)]
    dead.publish(dead.read().limit(0), "sweep", 2)  # a sweep that died before it published its episodes
    sweep(spark, root, work, NOW)
    assert rows_of(current(dead, LETTERS).select("episode_id", "recovered_at")) == [("e4", None)]


def test_windows_on_a_stream(spark, small, tmp_path):
    schema = spark.read.parquet(f"{small}/events.parquet").schema
    spark.read.parquet(f"{small}/events.parquet").write.parquet(f"{tmp_path}/events")
    q = windowed_counts(spark.readStream.schema(schema).parquet(f"{tmp_path}/events"), "ts", "event_type").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert spark.table("windows").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{small}/events.parquet").count()


def test_reports(spark, tmp_path):
    at = f"{tmp_path}/r"
    write_reports(spark.createDataFrame([("dream", s, f"s{i}", None, NOW) for i, s in enumerate(("info", "error", "odd"))], "kind string, severity string, summary string, details string, timestamp string").coalesce(1), at)
    (tmp_path / "r" / "part-zz.json").write_text("not json\n[1]\n\n")
    read = read_reports(spark, at)
    assert read.count() == 3 and [r["summary"] for r in last_reports(read, 1).collect()] == ["s2"] and last_reports(read, 5, "other").count() == 0
    assert read.where(severity_at_least(F.col("severity"), "warning")).count() == 1 and read.where(severity_at_least(F.col("severity"), "loud")).count() == 3


def test_dream(spark):
    e = spark.createDataFrame([("u1", "n", "one two three", "1", "g"), ("u2", "n", "one two three", "2", "g"), ("u3", "lone", " ", "1", "g"), ("u4", "kept", "text", "1", "g")], "uuid string, name string, summary string, created_at string, group_id string")
    ep = spark.createDataFrame([("e1", "n", "c", "1", "s", "g")], "uuid string, name string, content string, created_at string, source_description string, group_id string")
    m = spark.createDataFrame([("m1", "e1", "u1", "1", "g"), ("m2", "e1", "u2", "1", "g")], "uuid string, src_uuid string, dst_uuid string, created_at string, group_id string")
    dead = spark.createDataFrame([], LETTERS)
    dry = dream(MemoryGraph(e, ep, m), dead, "r", NOW)
    assert dry.graph.entity.count() == 4 and dry.undo is None and dry.audit.first()["phase_2_status"] == "COMPLETED: 1 merges planned"
    wet = dream(MemoryGraph(e, ep, m), dead, "r", NOW, force=True)
    row = wet.audit.first()
    assert rows_of(wet.graph.entity.select("uuid")) == [("u1",), ("u4",)] and wet.undo.count() == 1 and (row["status"], row["nodes_before"], row["nodes_after"]) == ("completed", 4, 3)
    broken = dream(MemoryGraph(e, ep, m.drop("dst_uuid")), dead, "r", NOW).audit.first()
    assert broken["status"] == "failed" and broken["phase_4_status"].startswith("COMPLETED")


def test_dream_clusters_until_the_end(spark):
    n = 26  # on a path the lowest label needs about a round a node, then the two sides swap labels for good
    e = spark.createDataFrame([(f"n{i:02}", None, None, "1", "g") for i in range(0, n, 2)], "uuid string, name string, summary string, created_at string, group_id string")
    ep = spark.createDataFrame([(f"n{i:02}", "n", "c", "1", "s", "g") for i in range(1, n, 2)], "uuid string, name string, content string, created_at string, source_description string, group_id string")
    m = spark.createDataFrame([(f"m{i}", f"n{i + 1 - i % 2:02}", f"n{i + i % 2:02}", "1", "g") for i in range(n - 1)], "uuid string, src_uuid string, dst_uuid string, created_at string, group_id string")
    labels, seen, rounds = list(range(n)), set(), 0
    while tuple(labels) not in seen:
        seen.add(tuple(labels))
        labels, rounds = [min(labels[j] for j in (i - 1, i + 1) if 0 <= j < n) for i in range(n)], rounds + 1
    assert rounds > 20
    row = dream(MemoryGraph(e, ep, m), spark.createDataFrame([], LETTERS), "r", NOW, min_degree=1).audit.first()
    assert row["phase_1_status"] == f"COMPLETED: 1 communities in {rounds} rounds, cycle of {n} oscillating nodes resolved"


def test_spread_join_keeps_hot_keys_whole(spark):
    many = spark.range(1000).select(F.when(F.col("id") < 700, 1).when(F.col("id") < 990, F.col("id")).alias("k"), "id")
    once = spark.createDataFrame([(1, "hot"), (800, "cold"), (None, "null")], "k long, v string")
    for how in ("inner", "left"):
        assert rows_of(spread_join(many, once, "k", how, hot_rows=50).select("id", "v")) == rows_of(many.join(once, "k", how).select("id", "v"))


def test_sinks_are_isolated(spark, tmp_path):
    events = spark.createDataFrame([("k", "info", "s", None, NOW)], "kind string, severity string, summary string, details string, timestamp string")

    def broken(_):
        raise ConnectionError("away")

    said = dispatched(events, {"file": lambda e: write_reports(e, f"file://{tmp_path}/r"), "hook": broken})
    assert said == {"file": "ok", "hook": "ConnectionError: away"} and read_reports(spark, f"file://{tmp_path}/r").count() == 1


def test_quirks_are_appended(spark, tmp_path):
    rows = with_repairs(spark.createDataFrame([("ExtractedEdges", '{"relations":[]}'), ("ExtractedEdges", '{"edges":[]}'), ("x", "{}")], "schema_name string, payload_json string"))
    for _ in range(2):
        append_quirks(rows, f"file://{tmp_path}/q", NOW)
    assert rows_of(spark.read.json(f"file://{tmp_path}/q").select("rule", "before", "after")) == [("extracted_edges", '{"relations":[]}', '{"edges":[]}')] * 2
