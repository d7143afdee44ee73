"""Benchmark decontamination by winnowing.

Words are hashed; each run of ``GRAM`` words makes a hash, and in each run of
``SPAN - GRAM + 1`` such hashes the smallest is a fingerprint. Two texts that
share ``SPAN`` words in a row share a fingerprint, so texts without a benchmark
fingerprint are done with. In the others, every run of ``SPAN`` words is looked
up among the runs of the items; hits extend over all words of the runs found,
overlapping ones merged. Items of fewer words are looked up as a whole, by runs
of their length. Everything is DataFrame functions; runs are compared by 128
bits of hashes.

Rows: a null or empty text has no words and is never contaminated; items
without words never occur; rows of one id count as one text each for hits and
words are of the largest; an empty table on either side gives the documents
with no hits; other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

SPAN, GRAM = 10, 5
#: Rows of a side that may be broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def words(text: str) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, A-Z lower-cased; no words for null."""
    parts = F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1)
    return F.filter(parts, lambda w: w != "")


def _runs(h: Column, k: int) -> Column:
    """(at, one, two) of every run of ``k`` words, from the two hashes of each word."""
    run = lambda i: F.struct(i.alias("at"), *(F.xxhash64(F.lit(seed), *(h[i + j][part] for j in range(k))).alias(part) for seed, part in ((k, "one"), (-k, "two"))))
    return F.when(F.size(h) >= k, F.transform(F.sequence(F.lit(0), F.size(h) - k), run))


def _runs_of(k: int):
    return lambda h: _runs(h, k)


def _hashes(text: str) -> Column:
    return F.transform(words(text), lambda w: F.struct(F.xxhash64(w).alias("one"), F.xxhash64(F.lit(7), w).alias("two")))


def fingerprints(text: str) -> Column:
    """The distinct minima of ``SPAN - GRAM + 1`` neighbouring hashes; null for texts shorter than ``SPAN`` words."""
    width = SPAN - GRAM + 1
    single = F.transform(words(text), lambda w: F.xxhash64(w))
    grams = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - GRAM), lambda i: F.xxhash64(*(h[i + j] for j in range(GRAM))))
    minima = lambda g: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(g) - width), lambda i: F.least(*(g[i + j] for j in range(width)))))
    return _let(single, lambda h: F.when(F.size(h) >= SPAN, _let(grams(h), minima)))


def _sized(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if its rows are few enough."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def item_runs(items: DataFrame) -> DataFrame:
    """``items(item_id, text)`` to ``item_id, k, one, two``: runs of ``SPAN`` words, or the whole of a shorter item."""
    hashed = items.select("item_id", _hashes("text").alias("h")).where(F.size("h") > 0)
    whole = reduce(lambda rest, k: F.when(F.size("h") == k, _runs(F.col("h"), k)).otherwise(rest), range(1, SPAN), _runs(F.col("h"), SPAN))
    return hashed.select("item_id", F.least(F.size("h"), F.lit(SPAN)).alias("k"), F.explode(whole).alias("r")).select("item_id", "k", "r.one", "r.two").distinct()


def occurrences(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """Where runs of the items occur: ``doc_id, at, k, one, two``."""
    keys = stage(runs.select("k", "one", "two").distinct(), "item-runs")
    lengths = sorted(r["k"] for r in keys.select("k").distinct().collect())  # at most SPAN values
    found = None
    for k in lengths:
        own = _sized(keys.where(F.col("k") == k).select("one", "two"))
        rows = docs.select("doc_id", F.explode(_let(_hashes("text"), _runs_of(k))).alias("r")).select("doc_id", "r.at", F.lit(k).alias("k"), "r.one", "r.two")
        hit = rows.join(own, ["one", "two"]).select("doc_id", "at", "k", "one", "two")
        found = hit if found is None else found.union(hit)
    return found


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, items`` (sorted item ids, as strings) of ``docs(doc_id, text)``, and ``starts``: (first word, words) of each run found."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null")
    runs = stage(item_runs(items), "runs")
    long_items = items.where(F.size(words("text")) >= SPAN)
    prints = stage(long_items.select(F.explode(fingerprints("text")).alias("print")).distinct(), "prints")
    marked = docs.select("doc_id", F.explode(fingerprints("text")).alias("print")).join(_sized(prints), "print").select("doc_id").distinct()
    suspects = docs.join(stage(marked, "suspects"), "doc_id", "left_semi")
    counts = docs.groupBy("doc_id").agg(F.max(F.size(words("text"))).cast("long").alias("n_words"))

    long_hits = occurrences(suspects, runs.where(F.col("k") == SPAN))
    short_hits = occurrences(docs, runs.where(F.col("k") < SPAN))
    parts = [h for h in (long_hits, short_hits) if h is not None]
    if not parts:
        return counts.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"), F.array().cast("array<struct<at:int,k:int>>").alias("starts"))
    hits = stage(reduce(DataFrame.union, parts), "hits")
    covered = hits.groupBy("doc_id").agg(F.collect_set(F.struct("at", "k")).alias("starts"))
    n_hit = F.size(F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s["at"], s["at"] + s["k"] - 1)))))
    pairs = hits.select("doc_id", "k", "one", "two").distinct().join(_sized(runs), ["k", "one", "two"]).select("doc_id", "item_id").distinct()
    named = pairs.groupBy("doc_id").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    out = counts.join(covered.select("doc_id", "starts", n_hit.cast("long").alias("n_hit")).join(named, "doc_id"), "doc_id", "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"), "starts")
