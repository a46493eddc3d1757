import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import references as R
from tests.conftest import rows_of


def key(n):
    return f"{n:032x}"


def brute(refs, parents, moved):
    out = set()
    for record, parent, k, t in refs:
        if k is None:
            continue
        if (parent, k) in parents:
            p = parents[parent, k]
            if p is not None and t is not None and p > t:
                out.add((record, "late"))
        else:
            out.add((record, "deleted" if parent == "entity" and k in moved else "missing"))
    return out


@pytest.mark.parametrize("run_keys", [4, 1024])
def test_random_runs_match_brute_force(spark, monkeypatch, run_keys):
    rng = random.Random(run_keys)
    monkeypatch.setattr(R, "RUN_KEYS", run_keys)
    monkeypatch.setattr(R, "PIECE_KEYS", run_keys)
    numbers = set()
    for start in [0, 5, (1 << 64) - 3, (1 << 127) - 2, (1 << 128) - 6, *[rng.getrandbits(128) for _ in range(20)]]:
        numbers |= {(start + i) % (1 << 128) for i in range(rng.randrange(1, 12))}
    parents = {(p, key(n)): rng.choice([None, 10, 20, 30]) for n in numbers for p in ("entity", "run") if rng.random() < 0.8}
    parents |= {("entity", key(5) + "z"): 10, ("entity", "letters"): 10, ("entity", "g0"): 30}
    asked = [key((n + d) % (1 << 128)) for n in numbers for d in (-1, 0, 1)] + [key(5) + "z", key(6) + "z", "letters", "letter", "g0", None]
    refs = [(str(i), rng.choice(["entity", "run"]), k, rng.choice([None, 5, 15, 25, 35])) for i, k in enumerate(asked * 2)]
    moved = {k for k in asked if k and rng.random() < 0.3}
    t = lambda c: F.timestamp_seconds(F.col(c))
    rdf = spark.createDataFrame(refs, "record_key string, parent string, key string, t long").where("key is not null").select(F.lit("t").alias("table_name"), F.lit("f").alias("field_name"), "record_key", "parent", "key", t("t").alias("ref_time"))
    pdf = spark.createDataFrame([(p, k, v) for (p, k), v in parents.items()], "parent string, key string, t long").select("parent", "key", t("t").alias("own_time"))
    mdf = spark.createDataFrame([(k,) for k in moved], "key string")
    got = {(r["record_key"], r["kind"]) for r in R.orphan_references(rdf, pdf, mdf, "entity").collect()}
    assert got == brute(refs, parents, moved)


def test_successive_keys_make_one_run(spark):
    keys = spark.range(5000).select(F.lit("p").alias("parent"), F.lpad(F.lower(F.hex("id")), 32, "0").alias("key"), F.lit(None).cast("timestamp").alias("own_time"), F.lit(0.0).alias("_piece"))
    assert R.key_runs(keys, 1024).count() == 5
    assert R.key_runs(keys, 10_000).count() == 1


def test_keys_under_one_half_fall_into_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(R, "PIECE_KEYS", 100)
    keys = spark.range(2000).select(F.lpad(F.lower(F.hex(F.col("id") * 10**9)), 32, "0").alias("key"))
    sizes = [r["count"] for r in R._with_piece(keys, R.key_bounds(keys, 2000)).groupBy("_piece").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 250


def test_forms_of_ids_and_times(spark):
    rows = spark.createDataFrame([(1, " {AB-cd}\t", "2026-01-31T23:30:00-01:00"), (2, " ", "2026-01-01"), (3, None, None), (4, "x", "not a time")], "id long, k string, t string")
    got = rows_of(R.references(rows, "t", "id", "k", "p", "t").select("record_key", "key", "ref_time"))
    assert [(r[0], r[1], str(r[2])) for r in got] == [("1", "abcd", "2026-02-01 00:30:00"), ("4", "x", "None")]


@pytest.mark.parametrize("tables", ["empty_dir", "null_dir"])
def test_nothing_from_nothing(spark, request, tables):
    from loomgraph.operators.reference_queries import QUERIES

    for f in QUERIES.values():
        assert f(spark, request.getfixturevalue(tables)).count() == 0


def test_repeats_and_clashing_columns_change_nothing(spark, small, wide_dir):
    from loomgraph.operators.reference_queries import p2_found

    assert rows_of(p2_found(spark, small)) == rows_of(p2_found(spark, wide_dir))
