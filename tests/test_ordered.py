"""As-of joins and look-backs against plain versions, and busy days that are split."""

import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import itinerary, ordered


@pytest.mark.parametrize("seed", range(2))
def test_asof_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    time = lambda: rng.choice([None, 50, 50, 50, *range(0, 200, 7)])
    left = [(i, rng.choice(["a", "b", None]), time()) for i in range(300)]
    right = [(rng.choice(["a", "b", "c", None]), time(), rng.choice([None, rng.randrange(100)])) for _ in range(60)]
    have, points = spark.createDataFrame(left, "id long, k string, t long").repartition(4), spark.createDataFrame(right, "k string, t long, v long")

    def want(t, k, by, greatest):
        seen = [(x, v) for key, x, v in right if x is not None and v is not None and t is not None and x <= t and (not by or key == k)]
        return max((v if greatest else (x, v) for x, v in seen), default=None) if greatest else max(seen, default=(0, None))[1]

    for by in ((), ("k",)):
        for greatest in (True, False):
            got = {r["id"]: r["v"] for r in ordered.asof(have, points.drop("k") if not by else points, "t", "v", by, greatest).collect()}
            assert got == {i: want(t, k, by, greatest) for i, k, t in left}, (by, greatest)


def test_previous_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.randrange(1000) * 1000 + i) for i in range(500)]
    got = {r["id"]: r["before"] and r["before"]["id"] for r in ordered.previous(spark.createDataFrame(rows, "id long, k string, t long").repartition(5), ["k"], ["t"], ["id"]).collect()}
    want = {}
    for key in ("a", "b", None):
        own = sorted((t, i) for i, k, t in rows if k == key)
        want |= {i: own[n - 1][1] if n else None for n, (_, i) in enumerate(own)}
    assert got == want


def test_a_busy_day_and_a_busy_client_are_split(spark):
    """Nine rows in ten are of one day, half of them of one instant, all of one client."""
    checks = spark.range(4000).select(F.lit("one").alias("client"), F.when(F.col("id") % 10 == 0, F.col("id") * 100_000).when(F.col("id") % 2 == 0, 86_400).otherwise(86_400 + F.col("id")).alias("s"))
    checks = checks.select("client", F.timestamp_seconds("s").alias("ts"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows become one range
    try:
        rows = ordered.ranges(checks.withColumn("h", F.xxhash64(F.monotonically_increasing_id())), "client", "ts", "h")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in rows.groupBy("_range").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 1200
    versions = spark.range(50).select(F.col("id").alias("version"), F.timestamp_seconds(F.col("id") * 2000).alias("ts"))
    got = itinerary.refreshed(checks, versions)
    assert got.count() == 4000 and got.where("ts = timestamp_seconds(86400) AND seen <> 43").count() == 0


def test_nothing_to_see(spark):
    left, right = spark.createDataFrame([(1, 5)], "id long, t long"), spark.createDataFrame([(3, 7)], "t long, v long")
    assert ordered.asof(left, right.limit(0), "t", "v").first()["v"] is None
    assert ordered.asof(left.limit(0), right, "t", "v").count() == 0 and ordered.previous(left.limit(0), ["id"], ["t"], ["t"]).count() == 0
