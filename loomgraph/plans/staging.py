"""Tables written to the shared checkpoint folder, so that lineage is cut and lost executors cost no work."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a temporary one in local mode and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", named)
        _written[named] = spark
    return named.rstrip("/")


def staged(df: DataFrame, name: str, instead: DataFrame | None = None) -> DataFrame:
    """``df`` written once as parquet to the shared folder and read back from there.

    ``instead`` is the staged table of the round before, which nothing needs once this one is written: it is deleted.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomgraph-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    if instead is not None and (old := getattr(instead, "_staged_at", None)) in _written:
        _delete(_written.pop(old), old)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


@atexit.register
def _remove_all() -> None:
    for path, spark in _written.items():
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended before; its folder goes with the cluster
            return
