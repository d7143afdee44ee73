"""Exact search over vectors by a join of blocks.

Both tables are cut into blocks, rows of some thousand vectors each that lie
near one pivot, with their centre and radius. A block of queries meets a block
of vectors as two rows, and a task multiplies them. By Cauchy and Schwarz no
product of a query and a vector exceeds

    <centre, centre'> + |centre| radius' + |centre'| radius + radius radius'

so pairs of blocks below what the queries have already, or below the least
score asked for, are left out by the join's condition. Queries get what they
have from a first join, of blocks with the same pivot. Nothing but the pivots,
a fixed number of them, passes the driver, and the vectors are read once,
whatever the number of queries.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import staged

#: Pivots, vectors in a block, and blocks that a task fills at once.
PIVOTS, BLOCK, OPEN = 32, 4096, 16
_BLOCK = "block long, grp string, cell int, n int, ids array<long>, data binary, centre array<double>, length double, radius double"


def pivots(vectors: DataFrame, count: int = PIVOTS) -> np.ndarray:
    """Vectors of ``vectors(vec_id, embedding)`` that a hash of their ids picks, at most ``count``."""
    rows = vectors.where("embedding IS NOT NULL").orderBy(F.xxhash64("vec_id"), "vec_id").limit(count).select("embedding").collect()
    return np.array([r["embedding"] for r in rows], np.float64)


def blocks(rows: DataFrame, near: np.ndarray, size: int = BLOCK) -> DataFrame:
    """``rows(id, grp, embedding)`` as blocks, each of one ``grp`` and nearest pivot; rows without an embedding are left out."""
    shared = rows.sparkSession.sparkContext.broadcast(near)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = shared.value
        held: dict[tuple[str | None, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        count: dict[tuple[str | None, int], int] = {}

        def out(key: tuple[str | None, int]) -> pa.RecordBatch:
            parts = held.pop(key)
            count.pop(key)
            ids, data = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            centre = data.mean(axis=0)
            radius = float(np.sqrt(((data - centre) ** 2).sum(axis=1).max()))
            name = int.from_bytes(np.random.default_rng([len(ids), *(int(i) & 0xFFFFFFFF for i in ids[:4])]).bytes(7), "little")
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([data.tobytes()], pa.binary()),
                 pa.array([centre], pa.list_(pa.float64())), pa.array([float(np.sqrt((centre**2).sum()))]), pa.array([radius])],
                names=["block", "grp", "cell", "n", "ids", "data", "centre", "length", "radius"],
            )

        for b in batches:
            data = np.asarray(b.column(2).flatten(), np.float64).reshape(b.num_rows, -1)
            cell = np.argmin((near**2).sum(axis=1) - 2 * (data @ near.T), axis=1) if len(near) else np.zeros(len(data), np.int64)
            ids, groups = np.asarray(b.column(0)), b.column(1).to_pylist()
            own: dict[tuple[str | None, int], list[int]] = {}
            for i, key in enumerate(zip(groups, cell.tolist())):
                own.setdefault(key, []).append(i)
            for key, at in own.items():
                for k in range(0, len(at), size):
                    part = at[k : k + size]
                    held.setdefault(key, []).append((ids[part], data[part]))
                    count[key] = count.get(key, 0) + len(part)
                    if count[key] >= size:
                        yield out(key)
            while sum(count.values()) > OPEN * size:
                yield out(max(count, key=count.get))
        while held:
            yield out(next(iter(held)))

    kept = rows.select(F.col("id").cast("long"), F.col("grp").cast("string"), "embedding").where("embedding IS NOT NULL")
    return staged(kept.mapInArrow(run, _BLOCK), "vector-blocks")


def few_tasks(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """``rows`` read by no more tasks than there are cores, or than each may hold ``OPEN`` blocks of: a task leaves a block of each group and pivot that is not full, and their pairs grow with the square of the tasks."""
    return rows.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // (OPEN * size))))


def met_tasks(rows: DataFrame, size: int) -> DataFrame:
    """``rows``, fewer and spread over all that is read, brought together so that each task holds about ``OPEN`` blocks."""
    return rows.repartition(max(1, -(-rows.count() // (OPEN * size))))


def bound(a: str, b: str) -> Column:
    """The largest product that a vector of block ``a`` and one of block ``b`` may have."""
    at = lambda t, c: F.col(f"{t}.{c}")
    inner = F.aggregate(F.zip_with(at(a, "centre"), at(b, "centre"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return inner + at(a, "length") * at(b, "radius") + at(b, "length") * at(a, "radius") + at(a, "radius") * at(b, "radius") + 1e-9


def pairs(asked: DataFrame, vectors: DataFrame, cells: int, same: bool) -> DataFrame:
    """Blocks of ``asked`` beside blocks of ``vectors``, unless their bound is below ``floor`` or they have the same ``met`` cell.

    Dealt over a grid of about ``cells``: each side goes to one row or column
    of it by its hash, as often as the other side's share asks for.
    """
    n_asked, n_vectors = max(1, asked.count()), max(1, vectors.count())
    wide = max(1, min(n_vectors, cells, round((cells * n_vectors / n_asked) ** 0.5)))
    high = max(1, min(n_asked, -(-cells // wide)))
    left = asked.withColumn("y", F.pmod("block", F.lit(high)).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(wide - 1)))).alias("q")
    right = vectors.withColumn("x", F.pmod("block", F.lit(wide)).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(high - 1)))).alias("v")
    on = (F.col("q.x") == F.col("v.x")) & (F.col("q.y") == F.col("v.y")) & (F.col("q.met").isNull() | (F.col("q.met") != F.col("v.cell"))) & (bound("q", "v") >= F.col("q.floor"))
    return left.join(right, on & F.col("q.grp").eqNullSafe(F.col("v.grp")) if same else on)


def _products(met: DataFrame, top: int, at_least: float | None, same: bool) -> DataFrame:
    """``query_id, vec_id, grp, score``: the best ``top`` of each query and group that a task meets in ``met`` pairs of blocks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[bytes, str | None], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for b in batches:
            for i in range(b.num_rows):
                q_ids, v_ids = np.asarray(b.column(0)[i].values), np.asarray(b.column(2)[i].values)
                q = np.frombuffer(b.column(1)[i].as_buffer(), np.float64).reshape(len(q_ids), -1)
                v = np.frombuffer(b.column(3)[i].as_buffer(), np.float64).reshape(len(v_ids), -1)
                score = np.round(q @ v.T, 12)
                if same:
                    score[q_ids[:, None] == v_ids[None, :]] = -np.inf
                key = (q_ids.tobytes(), b.column(4)[i].as_py())
                ident = np.broadcast_to(v_ids, score.shape)
                if key in best:
                    score, ident = np.hstack([best[key][1], score]), np.hstack([best[key][2], ident])
                if score.shape[1] > top:
                    edge = np.partition(score, score.shape[1] - top, axis=1)[:, score.shape[1] - top]
                    keep = np.flatnonzero((score >= edge[:, None]).any(axis=0))  # ties at the edge are settled by id
                    score, ident = score[:, keep], ident[:, keep]
                order = np.lexsort((ident, -score), axis=1)[:, :top]
                best[key] = (q_ids, np.take_along_axis(score, order, 1), np.take_along_axis(ident, order, 1))
            if len(best) > 4 * OPEN:  # as many blocks of queries as a task holds
                yield from out(best)
                best = {}
        yield from out(best)

    def out(best: dict) -> Iterator[pa.RecordBatch]:
        for (_, grp), (ids, score, ident) in best.items():
            keep = (score >= (-np.inf if at_least is None else at_least)) & (score > -np.inf)
            row, place = np.nonzero(keep)
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(ident[row, place]), pa.array([grp] * len(row), pa.string()), pa.array(score[row, place])], names=["query_id", "vec_id", "grp", "score"])

    return met.select("q.ids", "q.data", "v.ids", "v.data", "v.grp").toDF("q_ids", "q_data", "v_ids", "v_data", "grp").mapInArrow(run, "query_id long, vec_id long, grp string, score double")


def nearest(vectors: DataFrame, queries: DataFrame, top: int, at_least: float | None = None, per_group: bool = False, same: bool = False, allowed: DataFrame | None = None, size: int = BLOCK) -> DataFrame:
    """``query_id, vec_id, grp, score, rank``: the ``top`` largest inner products of each query, ties by ``vec_id``.

    ``vectors(vec_id, grp, embedding)``, ``queries(query_id, grp, embedding)``;
    ids are distinct, rows without an embedding are left out. ``at_least``: only
    scores from there on; ``per_group``: the best of each group of vectors;
    ``same``: only vectors of the query's group, not of its own id; ``allowed
    (vec_id)``: only those vectors, chosen before anything is ranked.
    """
    if allowed is not None:
        vectors = vectors.join(allowed.select("vec_id").distinct(), "vec_id", "left_semi")
    spark = vectors.sparkSession
    near = pivots(vectors)
    own = F.col("grp") if same else F.lit(None).cast("string")  # a query's group matters only where it must be the vector's
    have = blocks(few_tasks(vectors.select(F.col("vec_id").alias("id"), "grp", "embedding"), size), near, size)
    asked = blocks(met_tasks(queries.select(F.col("query_id").alias("id"), own.alias("grp"), "embedding"), max(1, size // 4)), near, max(1, size // 4))
    cells = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = float("-inf") if at_least is None else at_least
    if per_group or same or at_least is not None:
        asked = asked.withColumns({"floor": F.lit(least), "met": F.lit(None).cast("int")})
        found = _products(pairs(asked, have, cells, same), top, at_least, same)
    else:
        first = _products(asked.alias("q").join(have.alias("v"), F.col("q.cell") == F.col("v.cell")), top, at_least, same)
        first = staged(first, "first-scores")
        worst = best(first, ["query_id"], top).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("worst")).where(F.col("n") >= top).select("query_id", "worst")
        each = asked.select("block", F.explode("ids").alias("query_id")).join(worst, "query_id", "left")
        floors = each.groupBy("block").agg(F.min(F.coalesce("worst", F.lit(least))).alias("floor"))
        asked = asked.join(floors, "block").withColumn("met", F.col("cell"))
        found = first.unionByName(_products(pairs(staged(asked, "asked"), have, cells, same), top, at_least, same))
    return best(found, ["query_id", "grp"] if per_group else ["query_id"], top)


def best(rows: DataFrame, by: list[str], top: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("vec_id")))).where(F.col("rank") <= top)
