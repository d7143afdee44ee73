"""Vector search by blocks against brute force, and blocks that never meet."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import retrieval, vectors


def clustered(seed, n, dim=6, centres=5, spread=0.05):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    x = middle[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim))
    return np.round(x / np.linalg.norm(x, axis=1, keepdims=True), 3)  # rounded: some scores are equal


def frame(spark, x, key, first=0, groups=3):
    rows = [(first + i, f"g{i % groups}", [float(a) for a in v]) for i, v in enumerate(x)]
    return spark.createDataFrame([*rows, (-1, "g0", None)], f"{key} long, grp string, embedding array<double>").repartition(3)


def brute(v, q, top, group=lambda i, k: True, at_least=-9.0, allowed=None):
    out = set()
    for i, a in enumerate(q):
        scored = sorted((-round(float(a @ b), 12), k) for k, b in enumerate(v) if group(i, k) and (allowed is None or k in allowed) and round(float(a @ b), 12) >= at_least)
        out |= {(1000 + i, k, r + 1) for r, (_, k) in enumerate(scored[:top])}
    return out


def rows(df):
    return {(r["query_id"], r["vec_id"], r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("size,top", [(8, 3), (64, 5), (4096, 1)])
def test_nearest_equals_brute_force(spark, size, top):
    v, q = clustered(1, 400), clustered(2, 37)
    have, asked = frame(spark, v, "vec_id"), frame(spark, q, "query_id", 1000)
    assert rows(vectors.nearest(have, asked, top, size=size)) == brute(v, q, top)
    assert rows(vectors.nearest(have, asked, top, at_least=0.9, same=True, size=size)) == brute(v, q, top, lambda i, k: i % 3 == k % 3, 0.9)
    few = set(range(0, 400, 90))
    allowed = spark.createDataFrame([(k,) for k in [*few, *few, 9999]], "vec_id long")
    assert rows(vectors.nearest(have, asked, top, allowed=allowed, size=size)) == brute(v, q, top, allowed=few)
    got = vectors.nearest(have, asked, 1, at_least=0.5, per_group=True, size=size)
    assert rows(got) == set().union(*(brute(v, q, 1, lambda i, k, g=g: k % 3 == g, 0.5) for g in range(3)))


def test_own_ids_are_left_out_with_same(spark):
    v = clustered(3, 60)
    have = frame(spark, v, "vec_id", groups=1)
    got = retrieval.near(have, have.withColumnRenamed("vec_id", "query_id"), 0.2, True).collect()
    assert len(got) == 60 and all(r["query_id"] != r["vec_id"] for r in got)


def test_far_blocks_do_not_meet(spark):
    """Queries of one cluster: most pairs of blocks are below their floor, and the rows are the same."""
    v, q = clustered(4, 2000, centres=20, spread=0.01), clustered(4, 40, centres=20, spread=0.01)
    near = vectors.pivots(frame(spark, v, "vec_id"), 20)
    have = vectors.blocks(frame(spark, v, "vec_id").select(F.col("vec_id").alias("id"), F.lit(None).cast("string").alias("grp"), "embedding"), near, 50)
    asked = vectors.blocks(frame(spark, q, "query_id").select(F.col("query_id").alias("id"), F.lit(None).cast("string").alias("grp"), "embedding"), near, 50)
    every = vectors.pairs(asked.withColumns({"floor": F.lit(-9.0), "met": F.lit(None).cast("int")}), have, 16, False)
    some = vectors.pairs(asked.withColumns({"floor": F.lit(0.9), "met": F.lit(None).cast("int")}), have, 16, False)
    assert every.count() == asked.count() * have.count()
    assert some.count() < 0.3 * every.count()
    assert rows(vectors.nearest(frame(spark, v, "vec_id"), frame(spark, q, "query_id", 1000), 4, size=50)) == brute(v, q, 4)


def test_nothing_to_search(spark):
    have, asked = frame(spark, clustered(1, 5), "vec_id"), frame(spark, clustered(2, 2), "query_id")
    assert vectors.nearest(have.limit(0), asked, 3).count() == 0 and vectors.nearest(have, asked.limit(0), 3).count() == 0
    assert vectors.nearest(have, asked, 9).count() == 10


def test_what_a_task_holds_is_bounded():
    """Vectors that wait to fill blocks, of 64 doubles each, take at most 40 MB of a worker."""
    from lodestrata.operators import vectors

    assert vectors.OPEN * vectors.BLOCK * 64 * 8 <= 40e6


def test_blocks_do_not_grow_with_the_parts_read(spark, monkeypatch):
    """A table of many parts makes few blocks, and groups do not cut those of the queries, where any group's vectors are looked for."""
    v, q, met = clustered(5, 900), clustered(6, 90), []
    pairs = vectors.pairs
    monkeypatch.setattr(vectors, "pairs", lambda asked, have, *a: met.append((asked.count(), have.count())) or pairs(asked, have, *a))
    have, asked = frame(spark, v, "vec_id").repartition(60), frame(spark, q, "query_id", 1000).repartition(60)
    got = vectors.nearest(have, asked, 1, at_least=0.5, per_group=True)
    assert rows(got) == set().union(*(brute(v, q, 1, lambda i, k, g=g: k % 3 == g, 0.5) for g in range(3)))
    (n_asked, n_have), cores = met[0], spark.sparkContext.defaultParallelism
    assert n_asked <= vectors.PIVOTS and n_have <= 3 * vectors.PIVOTS * cores
