"""Vector best-fit packing of token sequences.

A text becomes ids and an end id; one longer than a sequence is cut into full
pieces and a rest. Full pieces fill a sequence each. For the others, only the
number of pieces of each length matters: lengths are bounded by the sequence
length, so the plan is made from a small table whatever the corpus. Lengths
are placed from the longest down. Every bin has what is left of three
capacities (tokens, documents, attention cost, which is the sum of squared
lengths); among the bins in which all three still hold, a piece goes to the
one with the best score, either the smallest weighted norm of what would be
left or the largest weighted dot product of the piece and what is left. Bins
alike are one group with a count, and a group takes a piece in each of its
bins at once. The plan gives each length runs of ranks; Spark numbers the
pieces of each length and joins them with the runs.

Rows: a null or empty text is the end id alone; repeated rows are packed each;
an empty table gives an empty result; other columns are ignored; no text is
cut short.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_slices, map_arrow, stage
from .word_ids import encoder, with_end

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long"
RUNS = "length long, rank_from long, rank_to long, sequence_base long, offset long"


@dataclass(frozen=True)
class Limits:
    """What one sequence holds; the weights are of tokens, documents and attention cost."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.0, 0.05)
    score: str = "norm"


@dataclass
class Group:
    """``bins`` bins numbered from ``base`` that hold the same lengths."""

    base: int
    bins: int
    left: np.ndarray
    used: int


def plan(counts: dict[int, int], limits: Limits) -> list[tuple[int, int, int, int, int]]:
    """(length, rank_from, rank_to, sequence_base, offset): the pieces of these ranks go to bins from the base on, one each."""
    room = np.array([limits.tokens, limits.documents, limits.attention], float)
    weight = np.array(limits.weights)
    groups: list[Group] = []
    left = np.zeros((0, 3))
    runs: list[tuple[int, int, int, int, int]] = []
    opened = 0
    for length in sorted((k for k in counts if counts[k]), reverse=True):
        size, rank, n = np.array([length, 1, length * length], float), 0, counts[length]
        if (size > room).any():
            raise ValueError(f"a piece of {length} tokens does not fit an empty sequence")
        while n > rank:
            fits = np.flatnonzero((left >= size).all(axis=1))
            if len(fits):
                if limits.score == "norm":
                    best = fits[np.argmin(((((left[fits] - size) / room) ** 2) * weight).sum(axis=1))]
                else:
                    best = fits[np.argmax((left[fits] * size / room**2 * weight).sum(axis=1))]
                g = groups[best]
            else:  # as many new bins as take this length when each is filled with it
                each = int((room // size).min())
                g = Group(opened, -(-(n - rank) // each), room.copy(), 0)
                opened += g.bins
                best = len(groups)
                groups.append(g)
                left = np.vstack([left, room])
            taken = min(g.bins, n - rank)
            if taken < g.bins:
                groups.append(Group(g.base + taken, g.bins - taken, g.left.copy(), g.used))
                left = np.vstack([left, g.left])
                g.bins = taken
            runs.append((length, rank, rank + taken, g.base, g.used))
            g.left = g.left - size
            g.used += length
            left[best] = g.left
            rank += taken
        keep = left[:, 0] > 0
        if keep.sum() < len(keep) // 2:  # full bins are done with
            groups = [g for g, k in zip(groups, keep) if k]
            left = left[keep]
    return runs


def pieces(docs: DataFrame, vocabulary: str, end_id: int, length: int) -> DataFrame:
    """``docs(doc_id, text)`` to one row per piece; ``place`` counts the pieces of one length in a task."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), np.zeros(length + 1, np.int64)
        for batch in batches:
            for at, n in byte_slices(batch.column(1)):
                ids, sizes = with_end(*encoder(vocabulary).encode(batch.column(1).slice(at, n)), end_id)
                ids = ids.astype("<u4")
                number = -(-sizes // length)
                doc = np.repeat(np.arange(n), number)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
                start = piece * length
                size = np.minimum(length, sizes[doc] - start)
                base = (np.cumsum(sizes) - sizes)[doc] + start
                order = np.argsort(size, kind="stable")
                _, first, many = np.unique(size[order], return_index=True, return_counts=True)
                place = np.empty(len(size), np.int64)
                place[order] = np.arange(len(size)) - np.repeat(first, many)
                place += seen[size]
                seen += np.bincount(size, minlength=length + 1)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(at, n).take(pa.array(doc)), "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start), "length": pa.array(size),
                    "ids_crc32": pa.array([zlib.crc32(ids[b : b + k]) for b, k in zip(base, size)], pa.int64()), "task": pa.array(np.full(len(doc), task, np.int32)), "place": pa.array(place),
                })

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), cut, PIECES)


def pack(docs: DataFrame, vocabulary: str, end_id: int, limits: Limits = Limits()) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    cut = stage(pieces(docs, vocabulary, end_id, limits.tokens), "pieces")
    per_task = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    per_task = stage(per_task.select("length", "task", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "places")
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row per length
    runs = spark.createDataFrame([tuple(map(int, r)) for r in plan(counts, limits)], RUNS)
    ranked = cut.join(per_task.select("length", "task", "before"), ["length", "task"]).withColumn("rank", F.col("place") + F.col("before"))
    placed = assign(ranked, runs)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def assign(ranked: DataFrame, runs: DataFrame) -> DataFrame:
    """Join pieces with the run that holds their rank.

    The plan has a few thousand runs for any corpus. They travel as one sorted
    array per length, at most ``tokens`` rows, which is broadcast.
    """
    run = F.struct("rank_from", "sequence_base", "offset")
    by_length = runs.groupBy("length").agg(F.array_sort(F.collect_list(run)).alias("runs"))
    joined = ranked.join(F.broadcast(by_length), "length")
    mine = F.element_at(F.filter("runs", lambda r: r["rank_from"] <= F.col("rank")), -1)
    return joined.withColumn("run", mine).withColumns({
        "sequence_id": F.col("run.sequence_base") + F.col("rank") - F.col("run.rank_from"),
        "offset": F.col("run.offset"),
    })
