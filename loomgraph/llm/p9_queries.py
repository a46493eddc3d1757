"""Problem 9: subject areas of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomgraph.llm.subjects import classified
from loomgraph.sources.tables import table


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's subject areas."""
    return classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_label"), table(spark, sf_dir, "subject_area"))


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and characters by subject, and their part of all documents; a document of several subjects counts in each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    total = docs.agg(F.count(F.lit(1)).alias("all_documents"))
    by = p9_found(spark, sf_dir).join(docs, "doc_id").groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"))
    return by.join(F.broadcast(total), how="inner").select("subject", "documents", "chars", (F.col("documents") / F.col("all_documents")).alias("part"))  # total: one row


QUERIES = {"p9_found": p9_found, "p9_composition": p9_composition}
ORACLES: dict[str, str] = {}
