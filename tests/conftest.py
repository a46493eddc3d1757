"""One local session for all tests, and folders of small tables."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__  # noqa: E402, F401  it makes the package travel with the tasks

#: Test tables of the smallest scale.
SMALL = os.environ.get("SMALL_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["episodes", "dead_letter", "dream_runs", "dream_entity_undo_log", "entity", "orphan", "mentions", "embedding_result", "documents", "subject_area", "subject_label", "mix_target", "source_trust"]


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    return s


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables here")
    return SMALL


def _variant(spark, small, at, change):
    from pyspark.sql import functions as F

    for t in TABLES:
        change(spark.read.parquet(f"{small}/{t}.parquet"), F).write.parquet(f"{at}/{t}.parquet")
    return str(at)


@pytest.fixture(scope="session")
def empty_dir(spark, small, tmp_path_factory):
    """All tables without a row."""
    return _variant(spark, small, tmp_path_factory.mktemp("empty"), lambda d, F: d.limit(0))


@pytest.fixture(scope="session")
def null_dir(spark, small, tmp_path_factory):
    """All tables of three rows of nulls."""
    nulls = lambda d, F: d.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in d.schema.fields]).withColumn("_x", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).drop("_x")
    return _variant(spark, small, tmp_path_factory.mktemp("nulls"), nulls)


@pytest.fixture(scope="session")
def wide_dir(spark, small, tmp_path_factory):
    """All tables twice over, with columns whose names the operators use inside, and rows of nulls."""
    names = ["key", "h", "cid", "n", "words", "batch", "kind", "block", "region", "s", "a", "b", "v", "u", "rank", "first", "second", "parent", "_t", "_salt", "copies", "n_tokens", "ids", "position", "shard"]

    def change(d, F):
        nulls = d.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in d.schema.fields])
        return d.unionByName(d).unionByName(nulls).withColumns({c: F.lit(f"clash {c}") for c in names if c not in d.columns})

    return _variant(spark, small, tmp_path_factory.mktemp("wide"), change)


def rows_of(df):
    """Sorted rows as tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
