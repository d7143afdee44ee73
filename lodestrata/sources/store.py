"""Tables that are replaced by key, and append-only logs.

A chunk table is a folder of Parquet files partitioned by its key, so that a
key is replaced, or revoked, by rewriting its partition alone.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """The shared folder of the session, that of its checkpoints. Where none is set, a temporary one on a local master, and an error on a cluster, whose machines would each write to their own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="lodestrata-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a table that several branches of a plan need to the shared folder, and read it from there."""
    path = f"{scratch(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replace_by_key(rows: DataFrame, path: str, key: str) -> None:
    """Write ``rows`` in place of all earlier rows of the keys they have; other keys stay. Running it twice changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def revoke(spark: SparkSession, path: str, key: str, value: str) -> tuple[int, int]:
    """Remove a key; (rows removed, rows left).

    The key's partition is overwritten with no rows, as a partition of a table
    over the folder, so that Spark itself spells the partition's name.
    """
    rows = spark.read.parquet(path)
    removed = rows.where(F.col(key).cast("string") == value).count()
    left = rows.count() - removed
    if removed:
        name = f"revoked_{uuid.uuid4().hex}"
        quoted = lambda x: "`" + x.replace("`", "``") + "`"
        others = [f for f in rows.schema.fields if f.name != key]
        columns = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in [*others, rows.schema[key]])
        nothing = ", ".join(f"CAST(NULL AS {f.dataType.simpleString()})" for f in others)
        literal = value.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY ({quoted(key)}) LOCATION '{path}'")  # an external table: dropping it leaves the files
        spark.sql(f"INSERT OVERWRITE TABLE {name} PARTITION ({quoted(key)} = '{literal}') SELECT {nothing} WHERE false")
        spark.sql(f"DROP TABLE {name}")
    return removed, left


def backfilled(rows: DataFrame, column: str, derived) -> DataFrame:
    """``column`` filled where it is null or empty; filled rows are kept as they are."""
    return rows.withColumn(column, F.when(F.col(column).isNull() | (F.col(column) == ""), derived).otherwise(F.col(column)))


def upserted(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``table`` with the rows of ``changes`` added, or put over those of the same key; nulls in a change keep what was there."""
    others = [c for c in table.columns if c != key]
    joined = table.alias("t").join(changes.alias("c"), F.col(f"t.{key}") == F.col(f"c.{key}"), "full")
    return joined.select(F.coalesce(f"c.{key}", f"t.{key}").alias(key), *(F.coalesce(f"c.{c}", f"t.{c}").alias(c) for c in others))


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def backup(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def listing(chunks: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """Rows per key in both tables, keys of either."""
    a = chunks.groupBy(key).agg(F.count("*").alias("chunks"))
    b = entities.groupBy(key).agg(F.count("*").alias("entities"))
    return a.join(b, key, "full").select(key, F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("entities", F.lit(0)).alias("entities"))
