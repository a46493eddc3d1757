"""Problem 8: documents mixed to the shares of mix_target."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.mixing import mixed, shares_reached
from loomgraph.llm.tokens import encoded
from loomgraph.plans.staging import staged
from loomgraph.sources.tables import table


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix, a row per use of a document."""
    docs = table(spark, sf_dir, "documents")
    sizes = encoded(docs, "doc_id", "text", count_only=True)
    return mixed(docs.select("doc_id", "source").join(sizes, "doc_id"), table(spark, sf_dir, "mix_target"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares really reached."""
    return shares_reached(staged(p8_mix(spark, sf_dir), "mix"), table(spark, sf_dir, "mix_target"))


QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares}
ORACLES: dict[str, str] = {}
