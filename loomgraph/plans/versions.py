"""Tables as versions: a folder a version and a manifest that names the current one, for one writer at a time.

A new version is written whole and then published by renaming a small manifest into place, so a reader sees the old
or the new version and a writer that dies leaves the old one. Batches of a stream are numbered upwards; the manifest
keeps the highest number of each stream, and a batch up to it is not published again.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, functions as F


class VersionedTable:
    """A table under ``root`` on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def manifests(self) -> list[int]:
        """Numbers of the published versions, in order."""
        if not self._fs.exists(self._path("_manifest")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("_manifest"))]
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, version: int | None = None) -> dict | None:
        """What the manifest of a version (the latest) says; None if there is none."""
        known = self.manifests()
        if not known or (version is not None and version not in known):
            return None
        text = self.spark.read.text(f"{self.root}/_manifest/{known[-1] if version is None else version}", wholetext=True).first()
        return json.loads(text["value"])

    def read(self, version: int | None = None) -> DataFrame | None:
        """A version's rows (the latest's); None if there is none."""
        said = self.manifest(version)
        return None if said is None else self.spark.read.parquet(f"{self.root}/{said['folder']}")

    def last(self, stream: str) -> int | None:
        """The highest batch number of a stream that is in the latest version; None if there is none."""
        said = self.manifest()
        return None if said is None or stream not in said["streams"] else said["streams"][stream][0]

    def publish(self, rows: DataFrame, stream: str | None = None, number: int = 0) -> int:
        """Writes rows as the next version and gives its number; a stream's batch up to the last known isn't written again."""
        return self._publish(rows, (self.manifest() or {"streams": {}})["streams"], stream, number)

    def _publish(self, rows: DataFrame, streams: dict, stream: str | None = None, number: int = 0) -> int:
        if stream in streams and number <= streams[stream][0]:
            return streams[stream][1]
        known = self.manifests()
        version = known[-1] + 1 if known else 1
        folder = f"v{version}"
        rows.write.mode("overwrite").parquet(f"{self.root}/{folder}")
        streams = streams | ({stream: [number, version]} if stream is not None else {})
        out = self._fs.create(self._path(f"_manifest/.{version}"), True)
        out.write(json.dumps({"version": version, "folder": folder, "streams": streams}).encode())
        out.close()
        if not self._fs.rename(self._path(f"_manifest/.{version}"), self._path(f"_manifest/{version}")):
            raise RuntimeError(f"version {version} was published by another writer")
        return version

    def roll_back(self, version: int) -> int:
        """Publishes an older version's rows again as the latest, with the batches that it knew; gives the new number."""
        rows = self.read(version)
        if rows is None:
            raise ValueError(f"no version {version}")
        return self._publish(rows, self.manifest(version)["streams"])

    def summary(self, by: str, version: int | None = None) -> dict:
        """Rows by the values of a column, and a digest that is the same for the same rows in any order; {} without a version."""
        rows = self.read(version)
        if rows is None:
            return {}
        mark = F.xxhash64(*[F.col(c).cast("string") for c in rows.columns])
        parts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(mark).alias("x"), F.sum(mark.cast("decimal(38,0)")).alias("s")).collect()  # a row a value
        whole = 0
        for r in parts:
            whole ^= r["x"]
        text = f"{sum(r['n'] for r in parts)} {whole} {sum(r['s'] for r in parts)}"
        return {"counts": {r[by]: r["n"] for r in parts}, "digest": hashlib.sha256(text.encode()).hexdigest()}
