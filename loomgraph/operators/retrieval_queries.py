"""Hybrid retrieval over the embedded texts of the project."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomgraph.operators import retrieve as R
from loomgraph.sources.tables import table

#: What is searched for, and the stored vector that stands for it.
QUERY, QUERY_ID = "rollback of the parser took snapshots", 3


def _facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[float]]:
    rows = table(spark, sf_dir, "embedding_result").groupBy("result_id").agg(F.max("text").alias("fact"), F.max("embedding").alias("e"), F.max("error").alias("error"))
    facts = rows.where(F.col("fact").isNotNull()).select(F.col("result_id").alias("eid"), "fact", F.when(F.col("error").isNotNull(), F.lit("2026-01-01")).alias("invalid_at"))
    usable = F.when(F.forall("e", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("e") == 64), F.col("e"))
    vectors = rows.select(F.col("result_id").alias("eid"), usable.alias("fact_embedding")).where(F.col("fact_embedding").isNotNull())
    asked = vectors.orderBy(F.abs(F.col("eid") - QUERY_ID), "eid").first()
    return facts, vectors, [float(x) for x in asked["fact_embedding"]]


def v8_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical arm."""
    facts = _facts(spark, sf_dir)[0]
    return R.lexical_arm(facts.where(F.col("invalid_at").isNull()), QUERY, 20).select("eid", F.round("score", 6).alias("score"))


def v7_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector arm."""
    _, vectors, asked = _facts(spark, sf_dir)
    return R.vector_arm(vectors, asked, 20).select("eid", F.round("score", 6).alias("score"))


def v10_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both arms fused by ranks."""
    facts, vectors, asked = _facts(spark, sf_dir)
    return R.rrf([R.lexical_arm(facts, QUERY, 20), R.vector_arm(vectors, asked, 20)], 10).select("eid", F.round("score", 6).alias("score"))


def v9_mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector arm reranked for variety."""
    _, vectors, asked = _facts(spark, sf_dir)
    near = vectors.join(R.vector_arm(vectors, asked, 30).select("eid"), "eid")
    return R.mmr(near, asked, 0.5, 10).select("eid", F.round("score", 6).alias("score"))


def v12_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search with the gate on."""
    facts, vectors, asked = _facts(spark, sf_dir)
    return R.hybrid_search(facts, vectors, QUERY, asked, 10, "rrf", gate=0.5).select("eid", F.round("score", 6).alias("score"))


def v14_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the arms and rows that a gate drops."""
    facts, vectors, asked = _facts(spark, sf_dir)
    rows = R.rrf([R.lexical_arm(facts, QUERY, 40), R.vector_arm(vectors, asked, 40)], 40)
    kept = R.cosine_gate(rows, vectors, asked, 0.5, 40)
    counts = rows.agg(F.count(F.lit(1)).alias("candidates"))
    return counts.join(F.broadcast(kept.agg(F.count(F.lit(1)).alias("returned")))).withColumn("dropped", F.col("candidates") - F.col("returned"))  # one row each


def v1_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each stored vector, usable or not, to one of them."""
    asked = [float(x) for x in table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]]
    from loomgraph.functions.vector import cosine

    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(cosine(F.col("embedding"), F.array(*[F.lit(x) for x in asked])), 6).alias("cosine"))


def v16_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose vector isn't stored yet, by digest: what an embedder would have to do, and the hit rate."""
    rows = table(spark, sf_dir, "embedding_result").where(F.col("text").isNotNull()).select(F.sha2("text", 256).alias("digest"), "embedding")
    have = rows.where("embedding is not null").select("digest").distinct()
    asked = rows.select("digest")
    missing = asked.join(have, "digest", "left_anti")
    return asked.agg(F.count(F.lit(1)).alias("asked")).join(F.broadcast(missing.agg(F.count(F.lit(1)).alias("misses"), F.countDistinct("digest").alias("to_embed")))).withColumn("hit_rate", F.round((F.col("asked") - F.col("misses")) / F.col("asked"), 6))  # one row each


QUERIES = {f.__name__: f for f in (v1_cosine, v7_vector, v8_lexical, v9_mmr, v10_rrf, v12_gate, v14_diagnostics, v16_cache)}

_BASE = f"""WITH r AS (SELECT result_id eid, max(text) fact, max(embedding) e, max(error) err FROM embedding_result GROUP BY 1),
f AS (SELECT eid, fact, err IS NOT NULL dead FROM r WHERE fact IS NOT NULL),
v AS (SELECT eid, CAST(e AS DOUBLE[]) e FROM r WHERE len(e) = 64 AND len(list_filter(e, lambda x: isnan(x) OR isinf(x) OR x IS NULL)) = 0),
q AS (SELECT e FROM v ORDER BY abs(eid - {QUERY_ID}), eid LIMIT 1),
cs AS (SELECT eid, e, round(coalesce(CASE WHEN list_inner_product(e, e) > 0 AND (SELECT list_inner_product(e, e) FROM q) > 0 THEN list_inner_product(e, (SELECT e FROM q)) / (sqrt(list_inner_product(e, e)) * sqrt((SELECT list_inner_product(e, e) FROM q))) END, 0), 9) score FROM v),
va AS (SELECT eid, score FROM cs WHERE (1 + score) / 2 >= 0.6)
"""
_TERMS = sorted(set(QUERY.lower().split()))
_TF = "len(list_filter(w, lambda x: x = '{0}'))"


def _bm25(source: str) -> str:
    weight = lambda i: f"ln(1 + (docs - d{i} + 0.5) / (d{i} + 0.5)) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * n / mean))"
    return f"""w AS (SELECT eid, regexp_extract_all(lower(fact), '[a-z0-9_]+') w FROM f WHERE {source}),
tf AS (SELECT eid, len(w) n, {', '.join(f'{_TF.format(t)} t{i}' for i, t in enumerate(_TERMS))} FROM w),
st AS (SELECT count(*) docs, avg(n) mean, {', '.join(f'count(*) FILTER (t{i} > 0) d{i}' for i in range(len(_TERMS)))} FROM tf),
la AS (SELECT eid, round({' + '.join(weight(i) for i in range(len(_TERMS)))}, 9) score FROM tf, st WHERE {' + '.join(f't{i}' for i in range(len(_TERMS)))} > 0)"""


def _fused(limit: int, arm: str = "va") -> str:
    return f"rk AS (SELECT eid, row_number() OVER (ORDER BY score DESC, eid) - 1 k FROM (SELECT * FROM la ORDER BY score DESC, eid LIMIT {limit}) UNION ALL SELECT eid, row_number() OVER (ORDER BY score DESC, eid) - 1 FROM (SELECT * FROM {arm} ORDER BY score DESC, eid LIMIT {limit})), rf AS (SELECT eid, round(sum(1 / (k + 1)), 9) score FROM rk GROUP BY 1)"


ORACLES = {
    "v1_cosine": "SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) cosine FROM embeddings",
    "v7_vector": _BASE + "SELECT eid, round(score, 6) score FROM va ORDER BY va.score DESC, eid LIMIT 20",
    "v8_lexical": _BASE + f", {_bm25('NOT dead')} SELECT eid, round(score, 6) score FROM (SELECT * FROM la ORDER BY score DESC, eid LIMIT 20)",
    "v9_mmr": _BASE + ", c AS (SELECT * FROM cs WHERE eid IN (SELECT eid FROM va ORDER BY score DESC, eid LIMIT 30)), m AS (SELECT a.eid, any_value(a.score) s, max(list_cosine_similarity(a.e, b.e)) x FROM c a JOIN c b ON a.eid <> b.eid GROUP BY 1) SELECT eid, round(score, 6) score FROM (SELECT eid, round(0.5 * s - 0.5 * x, 9) score FROM m ORDER BY score DESC, eid LIMIT 10)",
    "v10_rrf": _BASE + f", {_bm25('true')}, {_fused(20)} SELECT eid, round(score, 6) score FROM (SELECT * FROM rf ORDER BY score DESC, eid LIMIT 10)",
    "v12_gate": _BASE + f", {_bm25('NOT dead')}, live AS (SELECT * FROM va WHERE eid IN (SELECT eid FROM f WHERE NOT dead)), {_fused(40, 'live')}, top AS (SELECT * FROM rf ORDER BY score DESC, eid LIMIT 20) SELECT eid, round(top.score, 6) score FROM top JOIN cs USING (eid) WHERE cs.score >= 0.5 ORDER BY top.score DESC, eid LIMIT 10",
    "v16_cache": "SELECT count(*) asked, count(*) FILTER (NOT h) misses, count(DISTINCT d) FILTER (NOT h) to_embed, round((count(*) - count(*) FILTER (NOT h)) / count(*), 6) hit_rate FROM (SELECT sha256(text) d, bool_or(embedding IS NOT NULL) OVER (PARTITION BY text) h FROM embedding_result WHERE text IS NOT NULL)",
    "v14_diagnostics": _BASE + f", {_bm25('true')}, {_fused(40)}, top AS (SELECT * FROM rf ORDER BY score DESC, eid LIMIT 40) SELECT count(*) candidates, count(*) FILTER (coalesce(cs.score >= 0.5, false)) returned, count(*) FILTER (NOT coalesce(cs.score >= 0.5, false)) dropped FROM top LEFT JOIN cs USING (eid)",
}
