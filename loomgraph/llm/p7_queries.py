"""Problem 7: token ids of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomgraph.llm.tokens import decoded, encoded
from loomgraph.plans.staging import staged
from loomgraph.sources.tables import table


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of each document's text."""
    return encoded(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that each document's ids decode to."""
    return decoded(staged(p7_ids(spark, sf_dir), "ids")).select("doc_id", F.col("text").alias("decoded"))


QUERIES = {"p7_ids": p7_ids, "p7_decoded": p7_decoded}
ORACLES = {"p7_decoded": "SELECT doc_id, coalesce(text, '') decoded FROM documents"}
