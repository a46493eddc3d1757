"""Hybrid retrieval of facts: a lexical and a vector arm, fused by reciprocal ranks or reranked by MMR, and a cosine gate.

Corpus statistics (document frequencies, mean length) cover all facts; the arms keep their best rows for fusion, which
is what a top-k search returns. Equals go by id.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, Window, functions as F

from loomgraph.functions.text import WORD
from loomgraph.functions.vector import cosine

#: BM25's saturation and length weight (our choice).
K1, B = 1.2, 0.75
#: Least (1 + cosine) / 2 of the vector arm, least MMR score, rows of an arm beyond the limit.
MIN_SCORE, MMR_FLOOR, ARM_FACTOR = 0.6, -2.0, 2
# Names of the rerankers.
RERANKERS = {"rrf": "rrf", "reciprocal_rank_fusion": "rrf", "mmr": "mmr", "maximal_marginal_relevance": "mmr"}


def reranker_of(name: object, default: str = "mmr") -> str:
    """'rrf' or 'mmr'; anything unknown is the default."""
    return RERANKERS.get(str(name).strip().lower(), default)


def search_bounds(query: str, limit: object = 5) -> tuple[str, int]:
    """The stripped query (4 to 512 characters) and the limit (1 to 50); anything else is refused."""
    text = query.strip() if isinstance(query, str) else ""
    if not 4 <= len(text) <= 512:
        raise ValueError("query of 4 to 512 characters")
    if not isinstance(limit, int) or isinstance(limit, bool) or not 1 <= limit <= 50:
        raise ValueError("limit of 1 to 50")
    return text, limit


# Codes of failed searches (our names).
NO_BACKEND, TIMED_OUT, BAD_QUERY, INTERNAL = "BACKEND_DISCONNECTED", "BACKEND_TIMEOUT", "INVALID_QUERY", "INTERNAL_ERROR"


def error_code(error: BaseException) -> str:
    """The code of a failed search: the query's own fault, a backend that is away or too slow, or anything else."""
    if isinstance(error, (AnalysisException, ParseException)):
        return BAD_QUERY
    if isinstance(error, TimeoutError):
        return TIMED_OUT
    return NO_BACKEND if isinstance(error, (ConnectionError, OSError)) else INTERNAL


def query_text(query: str | None, seeds: Sequence[str] = (), facts: Sequence[str] = ()) -> str:
    """The query, or what stands for a missing one: the first seed of a request, else the first fact found, else nothing."""
    return query if query and query.strip() else next(iter([*seeds, *facts]), "")


def lexical_arm(facts: DataFrame, query: str, limit: int) -> DataFrame:
    """(eid, score) of the best facts (eid, fact) by BM25 over words; no least score."""
    asked = sorted(set(_terms(query)))
    words = F.regexp_extract_all(F.lower("fact"), F.lit(WORD), F.lit(0))
    counts = facts.select("eid", F.size(words).alias("n"), words.alias("w"))
    times = lambda t: F.size(F.filter("w", lambda x: x == F.lit(t)))
    tf = counts.select("eid", "n", *[times(t).alias(f"t{i}") for i, t in enumerate(asked)])
    corpus = tf.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"), *[F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in range(len(asked))])
    rows = tf.join(F.broadcast(corpus))  # one row
    if not asked:
        return rows.where(F.lit(False)).select("eid", F.lit(0.0).alias("score"))

    def weight(i: int):
        t, d = F.col(f"t{i}"), F.col(f"d{i}")
        return F.log(1 + (F.col("docs") - d + 0.5) / (d + 0.5)) * t * (K1 + 1) / (t + K1 * (1 - B + B * F.col("n") / F.col("mean")))

    score = sum((weight(i) for i in range(1, len(asked))), weight(0))
    return rows.where(sum((F.col(f"t{i}") for i in range(1, len(asked))), F.col("t0")) > 0).select("eid", F.round(score, 9).alias("score")).orderBy(F.col("score").desc(), "eid").limit(limit)


def _terms(query: str) -> list[str]:
    return re.findall(WORD, query.lower())


def vector_arm(vectors: DataFrame, query: Sequence[float], limit: int, min_score: float = MIN_SCORE) -> DataFrame:
    """(eid, score) of the best facts (eid, fact_embedding) by cosine, at (1 + cosine) / 2 of ``min_score`` or more."""
    asked = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors.where(F.col("fact_embedding").isNotNull()).select("eid", F.round(cosine(F.col("fact_embedding"), asked), 9).alias("score"))
    return rows.where((1 + F.col("score")) / 2 >= min_score).orderBy(F.col("score").desc(), "eid").limit(limit)


def ranked(arm: DataFrame) -> DataFrame:
    """(eid, rank) of an arm, from 0."""
    return arm.select("eid", (F.row_number().over(Window.orderBy(F.col("score").desc(), "eid")) - 1).alias("rank"))  # an arm's rows are limited


def rrf(arms: list[DataFrame], limit: int) -> DataFrame:
    """(eid, score): the sum over arms of 1 / (rank + 1)."""
    every = ranked(arms[0])
    for arm in arms[1:]:
        every = every.unionByName(ranked(arm))
    return every.groupBy("eid").agg(F.sum(1 / (F.col("rank") + 1)).alias("score")).select("eid", F.round("score", 9).alias("score")).orderBy(F.col("score").desc(), "eid").limit(limit)


def mmr(candidates: DataFrame, query: Sequence[float], lam: float, limit: int, floor: float = MMR_FLOOR) -> DataFrame:
    """(eid, score) of candidates (eid, fact_embedding): lam * cosine to the query less (1 - lam) * the highest cosine to another candidate.

    The candidates are the arms' rows, some hundreds at most; a candidate alone has no other.
    """
    asked = F.array(*[F.lit(float(x)) for x in query])
    others = candidates.select(F.col("eid").alias("other"), F.col("fact_embedding").alias("other_embedding"))
    pairs = candidates.join(others, F.col("eid") != F.col("other"), "left").select("eid", F.when(F.col("other").isNotNull(), cosine(F.col("fact_embedding"), F.col("other_embedding"))).alias("sim"))
    near = pairs.groupBy("eid").agg(F.coalesce(F.max("sim"), F.lit(0.0)).alias("sim"))
    score = lam * cosine(F.col("fact_embedding"), asked) + (lam - 1) * F.col("sim")
    return candidates.join(near, "eid").select("eid", F.round(score, 9).alias("score")).where(F.col("score") >= floor).orderBy(F.col("score").desc(), "eid").limit(limit)


def cosine_gate(rows: DataFrame, vectors: DataFrame, query: Sequence[float] | None, floor: float, limit: int) -> DataFrame:
    """The first ``limit`` rows (eid, score) whose true cosine reaches ``floor``; rows without a vector fail; without a query vector all pass."""
    if not query:
        return rows.orderBy(F.col("score").desc(), "eid").limit(limit)
    asked = F.array(*[F.lit(float(x)) for x in query])
    true = rows.join(vectors, "eid").where(F.col("fact_embedding").isNotNull()).withColumn("true_cosine", F.round(cosine(F.col("fact_embedding"), asked), 9))
    return true.where(F.col("true_cosine") >= floor).drop("fact_embedding").orderBy(F.col("score").desc(), "eid").limit(limit)


def hybrid_search(facts: DataFrame, vectors: DataFrame, query: str, vector: Sequence[float], limit: int = 5, reranker: str = "rrf", lam: float = 0.5, gate: float | None = None, overfetch: int = 2) -> DataFrame:
    """(eid, score, fact) of the best live facts (eid, fact, invalid_at); the gate overfetches and cuts to the limit."""
    query, limit = search_bounds(query, limit)
    live = facts.where(F.col("invalid_at").isNull())
    own = vectors.join(live.select("eid"), "eid", "left_semi")
    wide = limit * (overfetch if gate is not None else 1)
    arms = [lexical_arm(live.select("eid", "fact"), query, wide * ARM_FACTOR), vector_arm(own, vector, wide * ARM_FACTOR)]
    if reranker_of(reranker) == "rrf":
        rows = rrf(arms, wide)
    else:
        named = arms[0].select("eid").union(arms[1].select("eid")).distinct()
        rows = mmr(own.join(named, "eid"), vector, lam, wide)
    if gate is not None:
        rows = cosine_gate(rows, own, vector, gate, limit)
    return rows.join(live.select("eid", "fact"), "eid").orderBy(F.col("score").desc(), "eid").limit(limit)
