"""Search over a query table: keyword, dense, sparse and fused."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import terms
from ..sources.store import scratch
from .keyword_index import KeywordIndex, build, search
from .vectors import nearest

#: Fixed value of reciprocal-rank fusion.
RRF_K = 60


def bm25(docs: DataFrame | KeywordIndex, queries: DataFrame, top: int = 5, allowed: DataFrame | None = None) -> DataFrame:
    """``query_id, doc_id, score, rank`` of the best ``top`` documents of each query, by an index or by one made for this call from ``docs(doc_id, text)``."""
    if not isinstance(docs, KeywordIndex):
        docs = build(docs, f"{scratch(docs.sparkSession)}/keywords-{uuid.uuid4().hex}")
    return search(docs, queries, top, allowed)


def best(rows: DataFrame, by: list[str], order: list, top: int) -> DataFrame:
    """The first ``top`` rows of each group, with their rank from 1."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)


def dense(vectors: DataFrame, queries: DataFrame, top: int = 10, allowed: DataFrame | None = None) -> DataFrame:
    """``query_id, vec_id, score, rank``: exact inner products of ``queries(query_id, embedding)`` with ``vectors(vec_id, embedding)``, or of those whose ids are in ``allowed(vec_id)``."""
    ungrouped = lambda df, key: df.select(key, F.lit(None).cast("string").alias("grp"), "embedding")
    return nearest(ungrouped(vectors, "vec_id"), ungrouped(queries, "query_id"), top, allowed=allowed).drop("grp")


def sparse(vectors: DataFrame, queries: DataFrame, top: int = 10) -> DataFrame:
    """Inner products of sparse vectors, ``map<term, weight>``, through a join on the term."""
    left = vectors.select("doc_id", F.explode("weights").alias("term", "w"))
    right = queries.select("query_id", F.explode("weights").alias("term", "q"))
    scored = left.join(right, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("q")).alias("score"))
    return best(scored, ["query_id"], [F.desc(F.round("score", 9)), F.asc("doc_id")], top)


def term_weights(text: str) -> Column:
    """Sparse vector of a text: the share of each word."""
    words = terms(text)
    return F.map_from_entries(F.transform(F.array_distinct(words), lambda t: F.struct(t, F.size(F.filter(words, lambda w: w == t)) / F.size(words))))


def hybrid(first: DataFrame, second: DataFrame, weights: tuple[float, float] = (0.9, 0.1), top: int = 10) -> DataFrame:
    """Two ranked lists ``query_id, doc_id, score`` as one, by a weighted sum of scores brought to 0..1 by 0.5 + atan(x) / pi; a missing side counts 0."""
    unit = lambda c: F.coalesce(0.5 + F.atan(F.col(c)) / F.lit(np.pi), F.lit(0.0))
    both = first.select("query_id", "doc_id", F.col("score").alias("a")).join(second.select("query_id", "doc_id", F.col("score").alias("b")), ["query_id", "doc_id"], "full")
    return best(both.select("query_id", "doc_id", (weights[0] * unit("a") + weights[1] * unit("b")).alias("score")), ["query_id"], [F.desc(F.round("score", 9)), F.asc("doc_id")], top)


def rrf(paths: list[DataFrame], weights: list[float] | None = None, top: int = 5) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists ``query_id, doc_id, rank``; ties keep the order of first sight."""
    weights = weights or [1.0] * len(paths)
    rows = None
    for i, (p, w) in enumerate(zip(paths, weights)):
        part = p.select("query_id", "doc_id", (F.lit(w) / (RRF_K + F.col("rank"))).alias("gain"), (F.lit(i).cast("long") * 1_000_000_000 + F.col("rank")).alias("seen"))
        rows = part if rows is None else rows.unionByName(part)
    fused = rows.groupBy("query_id", "doc_id").agg(F.sum("gain").alias("score"), F.min("seen").alias("seen"))
    return best(fused, ["query_id"], [F.desc(F.round("score", 12)), F.asc("seen")], top).drop("seen")


def first_seen(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row per key, the first by ``order``."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def near(vectors: DataFrame, queries: DataFrame, at_least: float, same: bool) -> DataFrame:
    """``query_id, vec_id, grp, score``: the nearest of ``vectors(vec_id, grp, embedding)`` to each of ``queries(query_id, grp, embedding)``, if it scores ``at_least``.

    The nearest of each group of vectors, or with ``same`` of the query's own
    group, where vectors of the query's own id are left out.
    """
    return nearest(vectors, queries, 1, at_least, per_group=not same, same=same).drop("rank")


def similar_cached(cache: DataFrame, queries: DataFrame, at_least: float = 0.92, now: Column | None = None) -> DataFrame:
    """``query_id, namespace, key, similarity``: the cached value nearest each query in its namespace, other than the query itself.

    ``cache(namespace, key, embedding)``, with ``expires`` where ``now`` is
    given: values that have expired are not found; and ``queries(query_id,
    namespace, embedding)``.
    """
    if now is not None:
        cache = cache.where(F.col("expires").isNull() | (F.col("expires") > now))
    found = near(cache.select(F.col("key").alias("vec_id"), F.col("namespace").alias("grp"), "embedding"), queries.select("query_id", F.col("namespace").alias("grp"), "embedding"), at_least, True)
    kind = queries.schema["namespace"].dataType
    return found.select("query_id", F.col("grp").cast(kind).alias("namespace"), F.col("vec_id").alias("key"), F.round("score", 9).alias("similarity"))


def query_list(rewritten: Column, rewrites: Column, answer: Column, several: bool = True) -> Column:
    """The queries to search with beside the original: rewrites and "original,assumed answer"; distinct in order, without empty ones and the original."""
    none = F.array().cast("array<string>")
    joined = F.when(F.coalesce(answer, F.lit("")) != "", F.array(F.concat(rewritten, F.lit(","), answer))).otherwise(none)
    every = F.concat(F.coalesce(rewrites, none), joined) if several else joined
    return F.array_distinct(F.filter(every, lambda q: q.isNotNull() & (q != "") & (q != rewritten)))


def multi_query(docs: DataFrame | KeywordIndex, asked: DataFrame, top: int = 5) -> DataFrame:
    """``query_id, doc_id, path, rank``: each document once for a question, by the first of its queries that finds it.

    ``asked(query_id, queries)`` holds a list of queries; all lists are searched in one join.
    """
    paths = asked.select("query_id", F.posexplode("queries").alias("path", "text"))
    keyed = paths.select(F.struct("query_id", "path").alias("query_id"), "text")
    hits = bm25(docs, keyed, top).select("query_id.query_id", "doc_id", "query_id.path", "rank")
    return first_seen(hits, ["query_id", "doc_id"], ["path", "rank"])
