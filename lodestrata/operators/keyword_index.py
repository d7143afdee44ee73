"""A stored keyword index with blocks that carry their greatest impact.

The documents of a segment are dealt into spans by hash, about ``SPAN`` each; a
term's postings in a span are one row, with the most occurrences and the
shortest document among them, which bound the score of any of its documents
under any average length. A search sums the bounds of its terms by span, scores
the spans of the greatest sums first, and then only those whose sum reaches the
last of the best scores so found: the others' postings are never read. A span
is scored for all questions at once, as a product of two small matrices, and a
task keeps no more than the best of each question, so that what is shuffled
grows with the postings of the terms asked for, not with questions times documents.

New documents become a segment of their own; the statistics of all segments are
merged into new weights. A row in ``stats`` is written last and makes a segment
valid, so that a writer that fails leaves the index as it was.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import terms
from ..sources.store import staged

#: Fixed values of BM25.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Documents of a span, about, and spans of each search that are scored first.
SPAN, FIRST = 256, 4
#: Questions whose scores in a span are taken at once.
ASKED = 512


def postings(docs: DataFrame, spans: int) -> DataFrame:
    """``docs(doc_id, text)`` to ``term, span, n, most, shortest, total, docs``: a row for each term of a span, counted where the span's documents meet."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    words = docs.select("doc_id", spanned(spans).alias("span"), terms("text").alias("w")).where("size(w) > 0")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for span, rows in _runs(batches, ["span"]):
            ids, lists = rows.column("doc_id"), rows.column("w")
            dl = np.diff(np.asarray(lists.offsets)).astype(np.int64)
            coded, told = ids.dictionary_encode(), lists.flatten().dictionary_encode()
            pairs, first, own = np.unique(np.asarray(coded.indices).astype(np.int64) << 32 | dl, return_index=True, return_inverse=True)  # rows of one id and length are one document
            key, tf = np.unique(np.asarray(told.indices).astype(np.int64) * len(pairs) + np.repeat(own, dl), return_counts=True)
            term, doc = key // len(pairs), first[key % len(pairs)]
            at = np.flatnonzero(np.diff(term, prepend=-1))
            edge = np.append(at, len(term))
            docs = pa.StructArray.from_arrays([ids.take(pa.array(doc)), pa.array(tf.astype(np.int64)), pa.array(dl[doc].astype(np.int32))], ["doc_id", "tf", "dl"])
            made = [told.dictionary.take(pa.array(term[at])), pa.array(np.full(len(at), span[0], np.int32)), pa.array(np.diff(edge)), pa.array(np.maximum.reduceat(tf, at)), pa.array(np.minimum.reduceat(dl[doc], at).astype(np.int32)), pa.array(np.add.reduceat(tf, at)), pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), docs)]
            yield pa.RecordBatch.from_arrays(made, ["term", "span", "n", "most", "shortest", "total", "docs"])

    together = words.repartition("span").sortWithinPartitions("span")
    return together.mapInArrow(run, f"term string, span int, n long, most long, shortest int, total long, docs array<struct<doc_id:{kind},tf:bigint,dl:int>>")


def spanned(spans: int) -> Column:
    """The span of a document."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(spans)).cast("int")


def _runs(batches: Iterable[pa.RecordBatch], by: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(key, rows) of each run of rows that are equal in the integers ``by``, whatever the batches."""
    key, parts = None, []
    whole = lambda: pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([np.asarray(batch.column(c)) for c in by])
        starts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for at, stop in zip(starts, starts[1:]):
            new = tuple(keys[:, at].tolist())
            if new != key and parts:
                yield key, whole()
                parts = []
            key = new
            parts.append(batch.slice(at, stop - at))
    if parts:
        yield key, whole()


@dataclass
class KeywordIndex:
    """An index in the folder ``path``; ``segments`` are those valid when it was opened."""

    spark: SparkSession
    path: str
    segments: list[int]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}").where(F.col("segment").isin(*self.segments))

    @property
    def blocks(self) -> DataFrame:
        """``term, span, n, most, shortest, docs, segment``: the postings of a term in a span."""
        return self.table("blocks")

    def dealt(self) -> list[tuple[int, int]]:
        """(segment, spans) of each segment."""
        found = self.spark.read.parquet(f"{self.path}/stats").where(F.col("segment").isin(*self.segments)).select("segment", "spans").collect()  # a row a segment
        return [(r["segment"], r["spans"]) for r in found]

    @property
    def weights(self) -> DataFrame:
        """``term, idf, avgdl`` over all segments; negative weights of very common terms are a share of the mean."""
        return self.spark.read.parquet(f"{self.path}/weights-{max(self.segments)}")

    def append(self, docs: DataFrame) -> KeywordIndex:
        """The index with ``docs(doc_id, text)``, new documents of distinct ids, as one more segment."""
        number = max(self.segments, default=-1) + 1
        n = docs.count()
        spans = max(1, -(-n // SPAN))
        at = lambda name: f"{self.path}/{name}/segment={number}"
        postings(docs.select("doc_id", "text"), spans).write.mode("overwrite").parquet(at("blocks"))
        written = self.spark.read.parquet(at("blocks"))
        written.groupBy("term").agg(F.sum("n").alias("df"), F.sum("total").alias("total")).write.mode("overwrite").parquet(at("terms"))
        segments = [*self.segments, number]
        after = KeywordIndex(self.spark, self.path, segments)
        n_docs = n + sum(r["n"] for r in self.spark.read.parquet(f"{self.path}/stats").select("n").collect()) if self.segments else n  # a row a segment
        every = after.table("terms").groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
        raw = F.log(F.lit(n_docs) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        known = every.select("term", "total", raw.alias("raw"))
        mean, total = known.agg(F.avg("raw"), F.sum("total")).first()
        known.select("term", F.when(F.col("raw") < 0, EPSILON * F.lit(mean or 0.0)).otherwise(F.col("raw")).alias("idf"), F.lit((total or 0) / max(1, n_docs)).alias("avgdl")).write.mode("overwrite").parquet(f"{self.path}/weights-{number}")
        self.spark.range(1).select(F.lit(number).alias("segment"), F.lit(n).cast("long").alias("n"), F.lit(spans).alias("spans")).coalesce(1).write.mode("append").parquet(f"{self.path}/stats")
        return after


def build(docs: DataFrame, path: str) -> KeywordIndex:
    """A new index of ``docs(doc_id, text)`` in the folder ``path``, which all executors share."""
    return KeywordIndex(docs.sparkSession, path, []).append(docs)


def opened(spark: SparkSession, path: str) -> KeywordIndex:
    """The index in ``path`` with the segments that are valid now."""
    rows = spark.read.parquet(f"{path}/stats").select("segment").distinct().collect()
    return KeywordIndex(spark, path, sorted(r["segment"] for r in rows))


def asked_terms(queries: DataFrame, weights: DataFrame) -> DataFrame:
    """``query_id, term, times, idf, avgdl`` of the terms that the index has."""
    words = queries.select("query_id", F.explode(terms("text")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    return words.join(weights, "term")


def impact(tf: Column, dl: Column) -> Column:
    return F.col("times") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))


def bounds(index: KeywordIndex, asked: DataFrame) -> DataFrame:
    """``query_id, segment, span, most``: what a document of the span may score at most."""
    heads = index.blocks.select("term", "segment", "span", F.col("most").alias("tf"), F.col("shortest").alias("dl"))
    return heads.join(asked, "term").groupBy("query_id", "segment", "span").agg(F.sum(F.greatest(F.lit(0.0), impact(F.col("tf"), F.col("dl")))).alias("most"))


def scores(index: KeywordIndex, asked: DataFrame, spans: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """``query_id, doc_id, score`` of all documents of ``spans(query_id, segment, span)`` that score above 0."""
    wanted = spans.select("query_id", "segment", "span").join(asked, "query_id")
    hits = index.blocks.select("term", "segment", "span", "docs").join(wanted, ["term", "segment", "span"]).select("query_id", "times", "idf", "avgdl", F.explode("docs").alias("d"))
    found = hits.groupBy("query_id", F.col("d.doc_id").alias("doc_id")).agg(F.sum(impact(F.col("d.tf"), F.col("d.dl"))).alias("score")).where("score > 0")
    return found if allowed is None else found.join(allowed, "doc_id", "left_semi")


def products(index: KeywordIndex, weighted: DataFrame, top: int, spans: DataFrame | None = None, allowed: DataFrame | None = None, share: bool = False) -> DataFrame:
    """``query_id, doc_id, score, place`` of the best ``top`` documents, and some more, for each query of ``weighted(query_id, term, y, avgdl)``.

    A document scores the sum of y times its impact, or with ``share`` its share
    of the term; ``place`` is the score as it is ranked, rounded. ``spans(segment,
    span)`` are those to score, each for all queries; without it all are.
    """
    weighted = staged(weighted, "weighted")
    numbers = staged(weighted.select("query_id").distinct().withColumn("q", F.monotonically_increasing_id()), "numbers")
    by_term = staged(weighted.join(numbers, "query_id").groupBy("term").agg(F.max("avgdl").alias("avgdl"), F.collect_list(F.struct("q", "y")).alias("asked")), "by-term")
    blocks = index.blocks.select("segment", "span", "term", "docs")
    if spans is not None:
        blocks = blocks.join(spans, ["segment", "span"], "left_semi")
    rows = blocks.join(by_term, "term").select(F.col("segment").cast("long").alias("segment"), F.col("span").cast("long").alias("span"), "avgdl", "asked", F.col("docs.doc_id").alias("doc"), F.col("docs.tf").alias("tf"), F.col("docs.dl").alias("dl"), F.lit(False).alias("only"))
    if allowed is not None:
        for segment, dealt in index.dealt():
            own = allowed.groupBy(spanned(dealt).cast("long").alias("span")).agg(F.collect_list("doc_id").alias("doc"))
            rows = rows.unionByName(own.select(F.lit(segment).cast("long").alias("segment"), "span", "doc", F.lit(True).alias("only")), allowMissingColumns=True)
    filtered = allowed is not None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place_of: dict[int, int] = {}
        ids = place = score = None  # the best of each query so far, a row for each; those without a document have a place of -1

        for _, part in _runs(batches, ["segment", "span"]):
            only = np.asarray(part.column("only").to_numpy(zero_copy_only=False), bool)
            kept = np.asarray(part.filter(pa.array(only)).column("doc").flatten()).astype(np.int64) if filtered else None
            part = part.filter(pa.array(~only))
            if not part.num_rows:
                continue
            lists, asked = part.column("doc"), part.column("asked")
            doc, tf, dl = (np.asarray(part.column(c).flatten()).astype(t) for c, t in (("doc", np.int64), ("tf", float), ("dl", float)))
            row = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(lists.offsets)))
            average = np.asarray(part.column("avgdl")).astype(float)[row]
            value = tf / dl if share else tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))
            if kept is not None:
                there = np.isin(doc, kept)
                doc, row, value = doc[there], row[there], value[there]
            names, column = np.unique(doc, return_inverse=True)
            if not len(names):
                continue
            flat, entry = asked.flatten(), np.repeat(np.arange(part.num_rows), np.diff(np.asarray(asked.offsets)))
            q, local = np.unique(np.asarray(flat.field("q")), return_inverse=True)
            y, right = np.asarray(flat.field("y")), np.zeros((part.num_rows, len(names)))
            np.add.at(right, (row, column), value)
            slots = np.array([place_of.setdefault(x, len(place_of)) for x in q.tolist()])
            if ids is None or len(place_of) > len(ids):
                more = len(place_of) if ids is None else len(place_of) - len(ids)
                new = (np.zeros((more, top), np.int64), np.full((more, top), -1.0), np.zeros((more, top)))
                ids, place, score = new if ids is None else (np.vstack(x) for x in zip((ids, place, score), new))
            for low in range(0, len(q), ASKED):
                own = (local >= low) & (local < low + ASKED)
                left = np.zeros((min(ASKED, len(q) - low), part.num_rows))
                np.add.at(left, (local[own] - low, entry[own]), y[own])
                got, at = np.round(left @ right, 12), slots[low : low + ASKED]  # what sums leave beyond would decide halves
                rounded = np.where(got > 0, np.floor(got * 1e9 + 0.500001) / 1e9, -1.0)
                hit = np.flatnonzero(rounded.max(axis=1) >= np.maximum(place[at, -1], 0))
                at = at[hit]
                every = np.hstack([ids[at], np.broadcast_to(names, (len(hit), len(names)))])
                places = np.hstack([place[at], rounded[hit]])
                order = np.argsort(every, axis=1, kind="stable")
                order = np.take_along_axis(order, np.argsort(-np.take_along_axis(places, order, 1), axis=1, kind="stable"), 1)[:, :top]
                ids[at], place[at], score[at] = (np.take_along_axis(x, order, 1) for x in (every, places, np.hstack([score[at], got[hit]])))
        if ids is not None:
            q = np.array(list(place_of))
            for low in range(0, len(q), max(1, (1 << 16) // top)):
                part = slice(low, low + max(1, (1 << 16) // top))
                r, c = np.nonzero(place[part] >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(q[part][r]), pa.array(ids[part][r, c]), pa.array(score[part][r, c]), pa.array(place[part][r, c])], ["q", "doc_id", "score", "place"])

    together = rows.repartition("segment", "span").sortWithinPartitions("segment", "span")
    return together.mapInArrow(run, "q long, doc_id long, score double, place double").join(numbers, "q").select("query_id", "doc_id", "score", "place")


def search(index: KeywordIndex, queries: DataFrame, top: int = 5, allowed: DataFrame | None = None) -> DataFrame:
    """``query_id, doc_id, score, rank`` of the best ``top`` documents of each of ``queries(query_id, text)``, ties by ``doc_id``, an integer.

    Equal to scoring every document. A query's repeated words count each time;
    ``allowed(doc_id)`` filters after scoring, so statistics cover all documents.
    """
    asked = staged(asked_terms(queries, index.weights), "asked")
    weighted = asked.select("query_id", "term", (F.col("times") * F.col("idf")).alias("y"), "avgdl")
    kept, rest = first_spans(bounds(index, asked))
    early = staged(kept.select("segment", "span").distinct(), "early-spans")
    first = staged(products(index, weighted, top, early, allowed), "first-scores")
    late = staged(within_reach(rest, first, top).select("segment", "span").distinct().join(early, ["segment", "span"], "left_anti"), "late-spans")
    return best(first.unionByName(products(index, weighted, top, late, allowed)), top)


def first_spans(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The spans of each query with the greatest bounds, and all others."""
    spans = staged(spans, "spans")
    order = Window.partitionBy("query_id").orderBy(F.desc("most"), F.asc("segment"), F.asc("span"))
    kept = staged(spans.withColumn("place", F.row_number().over(order)).where(F.col("place") <= FIRST).drop("place"), "first-spans")
    return kept, spans.join(kept, ["query_id", "segment", "span"], "left_anti")


def within_reach(spans: DataFrame, first: DataFrame, top: int) -> DataFrame:
    """Of ``spans`` those that may hold a document as good as the last of the best ``top`` in ``first``."""
    last = best(first, top).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("last")).where(F.col("n") >= top).select("query_id", "last")
    return spans.join(last, "query_id", "left").where(F.col("last").isNull() | (F.col("most") >= F.col("last") - 1e-6))


def best(rows: DataFrame, top: int) -> DataFrame:
    place = F.col("place") if "place" in rows.columns else F.round("score", 9)
    order = Window.partitionBy("query_id").orderBy(place.desc(), F.asc("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).drop("place")


def shares(index: KeywordIndex, queries: DataFrame, top: int = 10) -> DataFrame:
    """``query_id, doc_id, score, rank``: inner products of the shares that terms have of their texts, through the same postings."""
    words = queries.select("query_id", terms("text").alias("w")).select("query_id", F.size("w").alias("n"), F.explode("w").alias("term")).groupBy("query_id", "n", "term").agg(F.count("*").alias("c"))
    weighted = words.select("query_id", "term", (F.col("c") / F.col("n")).alias("y"), F.lit(1.0).alias("avgdl"))
    return best(products(index, weighted, top, share=True), top)
