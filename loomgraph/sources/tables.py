"""Readers of the parquet tables, each one file or folder named ``<table>.parquet``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomgraph.functions.text import utc_time


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table ``name``; columns are pruned by whoever selects from it."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def latest(rows: DataFrame, key: str, time: str) -> DataFrame:
    """One row a key: the one of the latest ``time``, then the greatest in the order of the columns. Rows without a key all stay."""
    columns = rows.columns
    best = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(utc_time(F.col(time)).alias("_t"), *columns)).alias("_r"))
    return best.select(*[F.col("_r")[c].alias(c) for c in columns]).unionByName(rows.where(F.col(key).isNull()))
