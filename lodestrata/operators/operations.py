"""Running a service: limits, failures, caches, freshness, audits."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The limits of requests, in the order in which they are tried.
LIMITS = (("user_second", "user_id", "second", 2), ("user_day", "user_id", "day", 200), ("source_second", "source", "second", 10))


def fixed_windows(requests: DataFrame, limits: tuple[tuple[str, str, str, int], ...] = LIMITS) -> DataFrame:
    """``rejected_by``: the first limit that a request exceeds, or null; ``requests(request_id, ts, ...)``.

    A limit counts the requests of a key in a fixed window that the limits
    before it let through; those it rejects count for it.
    """
    rows = requests.withColumn("rejected_by", F.lit(None).cast("string"))
    for name, key, unit, most in limits:
        open_ = F.col("rejected_by").isNull()
        w = Window.partitionBy(key, F.date_trunc(unit, "ts")).orderBy("ts", "request_id").rowsBetween(Window.unboundedPreceding, 0)
        n = F.sum(open_.cast("int")).over(w)
        rows = rows.withColumn("__n", n).withColumn("rejected_by", F.when(open_ & (F.col("__n") > most), name).otherwise(F.col("rejected_by"))).drop("__n")
    return rows


def sliding_load(requests: DataFrame, key: str, seconds: int) -> DataFrame:
    """``in_window``: requests of the same key in the ``seconds`` up to each one, itself included."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return requests.withColumn("in_window", F.count("*").over(w))


def failure_runs(calls: DataFrame, key: str, order: list, least: int = 5, bucket: str = "hour") -> DataFrame:
    """Runs of ``least`` or more failures in a row: ``key, run, failures, first_id, last_id``; ``calls(call_id, ts, ok)``, ordered by ``ts`` first.

    ``run`` is the number of successes before. Successes are counted by time
    bucket, then within each, so no task sorts all the history of a key.
    """
    timed = calls.withColumn("bucket", F.date_trunc(bucket, "ts"))
    sums = timed.groupBy(key, "bucket").agg(F.sum(F.col("ok").cast("int")).alias("oks"))
    earlier = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(key, "bucket", F.coalesce(F.sum("oks").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy(key, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = timed.withColumn("inside", F.sum(F.col("ok").cast("int")).over(inside)).where(~F.col("ok"))
    runs = marked.join(before, (marked[key].eqNullSafe(before[key])) & (marked["bucket"].eqNullSafe(before["bucket"]))).select(marked[key], (F.col("before") + F.col("inside")).alias("run"), "call_id")
    return runs.groupBy(key, "run").agg(F.count("*").alias("failures"), F.min("call_id").alias("first_id"), F.max("call_id").alias("last_id")).where(F.col("failures") >= least)


def freshness(data: DataFrame, registry: DataFrame, now: Column) -> DataFrame:
    """``fresh``: younger than its source's ``expiry_seconds``; sources without one, or unknown, are always fresh."""
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp"))
    return data.join(registry, "source", "left").withColumn("fresh", F.coalesce(age <= F.col("expiry_seconds"), F.lit(True)))


def latest_status(changes: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    return changes.groupBy(key).agg(F.max(F.struct(*order, value)).alias("m"), F.count("*").alias("changes")).select(key, F.col(f"m.{value}").alias(value), "changes")


def cache_rates(calls: DataFrame, by: str) -> DataFrame:
    """``calls(key, ...)``: a call hits if its key was seen before in its group; hit rate in percent."""
    seen = F.row_number().over(Window.partitionBy(by, "key").orderBy("ts", "call_id")) > 1
    return calls.withColumn("hit", seen).groupBy(by).agg(F.count("*").alias("calls"), F.count_if("hit").alias("hits")).withColumn("rate", F.round(F.col("hits") / F.col("calls") * 100, 1))


def last_items(rows: DataFrame, key: str, order: str, value: str, n: int = 20) -> DataFrame:
    """The last ``n`` values of each key, oldest first."""
    kept = rows.withColumn("back", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("back") <= n)
    return kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("items"))


def interests(rows: DataFrame, key: str, kind: str, value: str, order: list[str]) -> DataFrame:
    """``key, kind, interests``: the distinct values of each key and kind, in the order in which they came; empty ones go."""
    first = rows.where(F.coalesce(F.col(value), F.lit("")) != "").groupBy(key, kind, value).agg(F.min(F.struct(*order)).alias("first"))
    return first.groupBy(key, kind).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", value))), lambda x: x[value]).alias("interests"))


def cached(calls: DataFrame, seconds: int) -> DataFrame:
    """``hit`` for each call ``(namespace, key, ts, call_id)``: whether a call of the same key was stored in the last ``seconds``; every miss stores anew.

    A stored value lives ``seconds`` from the miss that stored it. Calls of a
    key run through a task in order, and only the time of its last miss is kept.
    """
    micros = seconds * 1_000_000

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, stored = None, 0
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            us = np.asarray(batch.column(2))
            hit = np.ones(len(us), bool)
            at = 0
            while at < len(us):
                if keys[at] != last or us[at] - stored > micros:
                    hit[at], last, stored = False, keys[at], us[at]
                at += 1
                # what follows within the life of the value hits, without a look at each
                ahead = at + int(np.searchsorted(us[at : at + 256], stored + micros, "right")) if at < len(us) and keys[min(at + 255, len(us) - 1)] == last else at
                at = max(at, ahead)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(hit)], ["namespace", "key", "call_id", "hit"])

    rows = calls.select("namespace", F.col("key").cast("string").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("call_id").cast("long").alias("call_id")).where("us is not null")
    kind = rows.schema["namespace"].dataType.simpleString()
    ordered = rows.repartition("namespace", "key").sortWithinPartitions("namespace", "key", "us", "call_id")
    return ordered.mapInArrow(run, f"namespace {kind}, key string, call_id long, hit boolean")
