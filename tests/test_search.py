import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from loomgraph.functions.vector import cosine, jaccard
from loomgraph.operators import retrieve as R
from loomgraph.operators.catalog import blocked_keyword, read_only_sql
from loomgraph.operators.retrieve import error_code, query_text
from loomgraph.operators.traverse import first_line, rerank, search_request, trail_facts, trails
from loomgraph.sources.graph import Graph

FACTS = [("a", 0.9, 2), ("b", 0.5, 1), ("c", 0.7, 3)]


def scored(spark, rows):
    return spark.createDataFrame([(f, c, h, f, 0) for f, c, h in rows], "fact string, cosine double, hop int, trail string, place int")


@pytest.mark.parametrize(("lam", "order"), [(1.0, "acb"), (0.0, "bac"), (2.0, "acb")])
def test_order_at_the_ends(spark, lam, order):
    assert "".join(r["fact"] for r in rerank(scored(spark, FACTS), lam, 10).collect()) == order


def test_mixed_order_follows_the_formula(spark):
    rows = [("p", 0.9, 2), ("q", 0.85, 1), ("r", 0.5, 1)]
    got = rerank(scored(spark, rows), 0.5, 10).collect()
    assert [(r["fact"], round(r["score"], 2)) for r in got] == [("q", 0.6), ("p", 0.5), ("r", -0.1)]


def test_floor_is_inclusive_and_drops_unscored(spark):
    rows = scored(spark, [*FACTS, ("d", None, 1)])
    assert {r["fact"] for r in rerank(rows, 1.0, 10, 0.7).collect()} == {"a", "c"}


def test_trails_of_a_small_graph(spark):
    nodes = spark.createDataFrame([(x, x.upper(), f"about {x}") for x in "abcd"], "uuid string, name string, summary string")
    edges = spark.createDataFrame([("1", "a", "b", "K", "f1"), ("2", "b", "c", None, "\n  f2 \nx"), ("3", "c", "a", "K", ""), ("4", "d", "d", "L", None)], "eid string, src string, dst string, edge_type string, fact string").withColumn("invalid_at", F.lit(None).cast("timestamp"))
    found = trails(Graph(nodes, edges), ["A", "A", "none"], 3)
    assert sorted(r["t"] for r in found.select(F.array_join(F.transform("steps", lambda s: s["eid"]), "").alias("t")).collect()) == ["1", "12", "123", "3", "32", "321"]
    facts = {(r["trail"], r["place"]): r for r in trail_facts(found).collect()}
    assert facts["1|2", 1]["fact"] == "f2" and facts["1|2", 1]["edge_type"] == "RELATES_TO" and facts["1|2", 1]["path"] == ["A", "B"] and facts["1|2", 1]["source"] == "A" and facts["1|2", 1]["target"] == "C" and facts["1|2", 0]["hop"] == 2
    assert facts["3", 0]["fact"] == "about c"


@pytest.mark.parametrize("bad", [{"seeds": []}, {"seeds": [" "]}, {"seeds": list("abcdef")}, {"max_hops": 4}, {"max_hops": True}, {"min_cosine": 1.5}, {"min_cosine": True}, {"limit": 0}, {"limit": True}])
def test_requests_are_checked(bad):
    with pytest.raises(ValueError):
        search_request(**{"seeds": ["a"], **bad})


def test_request_defaults():
    r = search_request([" a "], rerank_lambda="x", limit=500)
    assert (r.seeds, r.rerank_lambda, r.limit) == (["a"], 0.7, 50)


def test_measures(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0, 0.0], [-1.0, 0.0], -1.0), ([0.0, 0.0], [1.0, 0.0], 0.0), ([], [], 0.0), ([1.0], [1.0, 2.0], 0.0), (None, [1.0], 0.0)]
    got = spark.createDataFrame(rows, "a array<float>, b array<float>, want double").select("want", cosine(F.col("a"), F.col("b")).alias("got")).collect()
    assert all(r["got"] == pytest.approx(r["want"]) for r in got)
    sets = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], [])], "a array<string>, b array<string>").select(jaccard(F.col("a"), F.col("b")).alias("j")).collect()
    assert [r["j"] for r in sets] == [pytest.approx(1 / 3), 1.0]


def test_first_line(spark):
    rows = spark.createDataFrame([("  \n\t a b \nc",), ("\x1c\x1d",), ("",), (None,), ("x y",)], "t string").select(first_line(F.col("t")).alias("f"))
    assert [r["f"] for r in rows.collect()] == ["a b", None, None, None, "x"]


def test_fusion_and_variety(spark):
    arm = lambda *ids: spark.createDataFrame([(i, 10.0 - k) for k, i in enumerate(ids)], "eid long, score double")
    got = {r["eid"]: r["score"] for r in R.rrf([arm(1, 2, 3), arm(2, 4, 5, 6, 7, 8, 1)], 10).collect()}
    assert got[1] == pytest.approx(1 + 1 / 7, abs=1e-6) and got[2] == pytest.approx(1.5)
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "eid long, fact_embedding array<double>")
    assert [r["eid"] for r in R.mmr(vectors, [1.0, 0.2], 0.3, 3).collect()] == [3, 1, 2]
    assert R.cosine_gate(arm(1, 3, 9), vectors, [1.0, 0.0], 0.5, 5).count() == 1
    assert R.cosine_gate(arm(1, 3, 9), vectors, None, 0.5, 5).count() == 3


def test_lexical_edges(spark):
    facts = spark.createDataFrame([(1, "the cat sat"), (2, "the dog"), (3, None), (4, "")], "eid long, fact string")
    assert [r["eid"] for r in R.lexical_arm(facts, "CAT?", 5).collect()] == [1]
    assert R.lexical_arm(facts, "???", 5).count() == 0
    assert R.lexical_arm(facts.limit(0), "cat", 5).count() == 0


@pytest.mark.parametrize(("query", "limit"), [("abc", 5), ("x" * 513, 5), (None, 5), ("abcd", 0), ("abcd", 51), ("abcd", True)])
def test_search_bounds(query, limit):
    with pytest.raises(ValueError):
        R.search_bounds(query, limit)


def test_read_only(spark):
    assert blocked_keyword("MATCH (n) DETACH DELETE n") == "DELETE" and blocked_keyword("select created_at") is None
    assert read_only_sql(spark, "SELECT :x + 1 AS y", {"x": 1}).first()["y"] == 2
    for bad in ("DROP TABLE t", "INSERT INTO t VALUES (1)", "show tables"):
        with pytest.raises(PermissionError):
            read_only_sql(spark, bad)


def test_read_only_looks_at_the_plan(spark):
    spark.range(3).createOrReplaceTempView("three")
    assert read_only_sql(spark, "WITH t AS (SELECT id FROM three) SELECT max(id) m FROM t WHERE id < :n", {"n": 2}).first()["m"] == 1
    for statement in ("FROM three INSERT INTO t SELECT *", "SHOW TABLES", "DROP TABLE three", "WITH t AS (SELECT 1) INSERT INTO three SELECT * FROM t"):
        with pytest.raises(PermissionError):
            read_only_sql(spark, statement)


def test_errors_and_missing_queries():
    assert [error_code(e) for e in (TimeoutError(), ConnectionError(), KeyError(), AnalysisException("x"))] == ["BACKEND_TIMEOUT", "BACKEND_DISCONNECTED", "INTERNAL_ERROR", "INVALID_QUERY"]
    assert [query_text(*a) for a in (("q", ["s"]), (" ", ["s"]), (None, [], ["f"]), (None,))] == ["q", "s", "f", ""]
