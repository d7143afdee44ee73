"""Exact dedup by content sort.

Texts are normalised (each run of ASCII white space becomes one space) and
range-partitioned by their first characters and a hash, with splitters that
Spark samples: 40 bytes a sampled row, whatever the texts' length. Each range is
sorted by the whole normalised bytes, spilling where it must, so equal texts
stand next to each other; neighbours are compared in full, and the row of the
smallest ``doc_id`` of each run of equals stays.

A hash that more than one row in ``SHARES`` has belongs to a hot group. There
are fewer than ``SHARES`` of them whatever the input, so the list is broadcast;
their rows are dealt over as many ranges as they are shares of the input, each
range finds its own smallest row, and the few leaders of a group, with their
texts, are compared in full again. Everything is DataFrame functions.

Rows: a null text counts as empty; equal texts of one id keep one row, the
others are dropped rows of the same group; rows without an id come after all
others, and a group of them alone has no ``keep_id``; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: A group is hot from this share of all rows on; also the bound of the broadcast list.
SHARES = 10_000

#: Characters of a normalised text that order the ranges, before its hash.
HEAD = 16


def normalised(text: Column) -> Column:
    """Each run of ``[\\x20\\x09-\\x0D]`` as one space; a null text is empty."""
    filled = F.coalesce(text, F.lit(""))
    return F.when(filled.rlike("[\t-\r]|  "), F.regexp_replace(filled, "[\t-\r ]+", " ")).otherwise(filled)


def _hot(rows: DataFrame, total: int, shares: int) -> DataFrame:
    """``hash, parts`` of hashes that more than one of ``total`` rows in ``shares`` has: fewer than ``shares`` rows."""
    share = F.col("n") * shares / F.lit(max(total, 1))
    counts = rows.groupBy("hash").agg(F.count("*").alias("n"))
    return counts.where((F.col("n") > 1) & (share > 1)).select("hash", F.ceil(share).cast("int").alias("parts"))


def _sorted_groups(rows: DataFrame) -> DataFrame:
    """``rows(doc_id, body, head, hash, part)`` range-partitioned and sorted; each row with the smallest id, the place and the size of its run of equals."""
    equals = Window.partitionBy("head", "hash", "part", "body")  # the ranges' own columns and the bytes: no second exchange
    in_order = equals.orderBy(F.col("doc_id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranged = rows.repartitionByRange("head", "hash", "part")
    return ranged.select("*", F.row_number().over(equals.orderBy(F.col("doc_id").asc_nulls_last())).alias("place"), F.first("doc_id").over(in_order).alias("leader")).withColumn("n", F.count("*").over(equals))


def exact_duplicates(docs: DataFrame, shares: int = SHARES) -> DataFrame:
    """``docs(doc_id, text)`` to ``doc_id, keep_id, group_size, kept, text_sha256``, a row for each row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("body"))
    rows = rows.withColumn("hash", F.xxhash64("body"))
    hot = stage(_hot(rows, docs.count(), shares), "hot-texts")
    dealt = rows.join(F.broadcast(hot), "hash", "left").select(
        "doc_id", "body", F.substring("body", 1, HEAD).alias("head"), "hash", F.when(F.col("parts").isNull(), -1).otherwise(F.pmod(F.xxhash64("doc_id"), "parts")).cast("int").alias("part")
    )
    is_hot = F.col("part") >= 0
    found = _sorted_groups(dealt).select(
        "doc_id", "leader", "n", "place", "part", F.sha2("body", 256).alias("text_sha256"), F.when(is_hot & (F.col("place") == 1), F.col("body")).alias("body")
    )
    found = stage(found, "sorted-texts")
    best = F.min(F.struct(F.col("leader").isNull().alias("nameless"), F.col("leader").alias("id"), "part"))
    merged = found.where("body IS NOT NULL").groupBy("body", "text_sha256").agg(best.alias("best"), F.sum("n").alias("total"))
    merged = stage(merged.select("text_sha256", "best", "total"), "hot-groups")  # fewer than ``shares`` rows
    joined = found.drop("body").join(F.broadcast(merged), (found["text_sha256"] == merged["text_sha256"]) & is_hot, "left").drop(merged["text_sha256"])
    return joined.select(
        "doc_id", F.when(is_hot, F.col("best.id")).otherwise(F.col("leader")).alias("keep_id"), F.when(is_hot, F.col("total")).otherwise(F.col("n")).cast("long").alias("group_size"),
        ((F.col("place") == 1) & (~is_hot | (F.col("part") == F.col("best.part")))).alias("kept"), "text_sha256",
    )
