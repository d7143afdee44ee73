"""Several tables that change together.

A commit writes each table's new files to a folder of their own and then one
manifest file that names the folders of all tables; Spark's committer makes that
file visible in one step. Readers take the newest manifest, so they see all of a
commit or nothing of it, and a writer that fails leaves only files that no
manifest names. Commits come from one writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import upserted


class Snapshots:
    """The tables below ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _manifests(self) -> DataFrame:
        empty = self.spark.createDataFrame([], "version long, name string, folder string")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(empty.schema).parquet(f"{self.path}/manifests") if there else empty

    def version(self) -> int:
        """Of the newest commit; 0 before the first."""
        return self._manifests().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def folders(self, version: int | None = None) -> dict[str, str]:
        rows = self._manifests()
        return {r["name"]: r["folder"] for r in rows.where(F.col("version") == (self.version() if version is None else version)).collect()}  # a row a table

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.folders(version)[name])

    def commit(self, tables: dict[str, DataFrame]) -> int:
        """Put ``tables`` in place of those of their names, all at once; other tables stay. Returns the new version."""
        number = self.version()
        folders = self.folders(number)
        for name, rows in tables.items():
            folders[name] = f"{self.path}/data/{name}-{uuid.uuid4().hex}"
            rows.write.parquet(folders[name])
        manifest = self.spark.createDataFrame([(number + 1, n, f) for n, f in sorted(folders.items())], "version long, name string, folder string")
        manifest.coalesce(1).write.mode("append").parquet(f"{self.path}/manifests")
        return number + 1

    def replace(self, key: str, value: str, tables: dict[str, DataFrame]) -> int:
        """Put new rows of one key into several tables at once, in place of all rows of that key."""
        now = self.folders()
        kept = lambda name: self.spark.read.parquet(now[name]).where(~F.col(key).eqNullSafe(F.lit(value)))
        return self.commit({name: kept(name).unionByName(rows) if name in now else rows for name, rows in tables.items()})

    def update(self, name: str, changes: DataFrame, key: str) -> int:
        """Change rows by their key, as ``upserted`` does."""
        return self.commit({name: upserted(self.read(name), changes, key)})
