"""Line dedup by overlapping three-line windows.

The lines of a text that are not blank, trimmed, are hashed; each run of three
makes a window, and a text with fewer lines is one window. A window that occurs
more than once anywhere keeps its first occurrence, by ``doc_id`` and place;
the lines that later occurrences cover are removed, overlapping ones merged.
Everything is DataFrame functions; a window is compared by 128 bits of hashes.

Rows: a null text stays null and has no lines; a text without repeats stays as
it is, to the byte; in others the kept lines, blank ones included, are joined
by newlines; what is left of a text that repeats as a whole is "" or its blank
lines; rows equal in id and text count as one row; of several texts of one id
that repeat a window at one place, one keeps it; rows without an id are
never cut; an empty table gives an empty result; other columns of the input are
carried along, except columns named ``n_lines`` and ``n_removed``; names that
begin with ``_lodestrata_`` are the operator's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

WINDOW = 3


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^[\t-\r ]+|[\t-\r ]+$", "")


def windows(docs: DataFrame) -> DataFrame:
    """``docs(row, doc_id, text)`` to ``row, doc_id, at, one, two``: where each window starts among the lines that are not blank, and its hashes."""
    lines = F.filter(F.transform(F.split("text", "\n", -1), _trimmed), lambda x: x != "")
    hashes = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("one"), F.xxhash64(F.lit(1), x, F.length(x)).alias("two")))

    def of(h: Column) -> Column:
        full = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.struct(i.alias("at"), *(F.xxhash64(F.lit(k), *(h[i + j][part] for j in range(WINDOW))).alias(part) for k, part in enumerate(("one", "two")))))
        short = F.array(F.struct(F.lit(0).alias("at"), *(F.xxhash64(F.lit(k), *(F.coalesce(F.get(h, F.lit(j))[part], F.lit(0)) for j in range(WINDOW))).alias(part) for k, part in enumerate(("one", "two")))))
        return F.when(F.size(h) >= WINDOW, full).when(F.size(h) > 0, short)

    return docs.select("row", "doc_id", F.explode(_let(hashes, of)).alias("w")).select("row", "doc_id", "w.at", "w.one", "w.two")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` without repeated lines, and ``n_lines, n_removed`` (lines that are not blank).

    ``docs`` has ``doc_id, text`` and any other columns.
    """
    key = F.xxhash64("doc_id", "text")
    found = stage(windows(docs.select(key.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")), "windows")
    first = found.groupBy("one", "two").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "at", "row")).alias("first")).where("n > 1").drop("n")
    first = stage(first, "firsts")  # so that Spark can split the rows of a hot window
    later = found.join(first, ["one", "two"]).where("row <> first.row or at <> first.at").select("row", "doc_id", "at").distinct()
    covered = later.groupBy("row", "doc_id").agg(F.sort_array(F.collect_set("at")).alias("starts"))
    return _without(docs, key, covered)


def _without(docs: DataFrame, key: Column, covered: DataFrame) -> DataFrame:
    places = covered.select(F.col("row").alias("_lodestrata_row"), F.col("doc_id").alias("_lodestrata_doc"), F.col("starts").alias("_lodestrata_starts"))
    rows = docs.withColumns({"_lodestrata_row": key, "_lodestrata_doc": F.col("doc_id").cast("long")})
    joined = rows.join(places, ["_lodestrata_row", "_lodestrata_doc"], "left")
    lines = F.split("text", "\n", -1)
    full = lambda xs: F.filter(F.transform(F.sequence(F.lit(0), F.size(xs) - 1), lambda i: F.struct(i.alias("i"), (_trimmed(xs[i]) != "").alias("full"))), lambda s: s["full"])

    def removed(xs: Column) -> Column:
        """Positions, among all lines, of those that the windows cover."""
        own = F.transform(full(xs), lambda s: s["i"])
        numbers = F.array_distinct(F.flatten(F.transform("_lodestrata_starts", lambda s: F.sequence(s, s + WINDOW - 1))))
        return _let(own, lambda o: F.filter(F.transform(numbers, lambda k: F.get(o, k)), lambda x: x.isNotNull()))

    def rebuilt(xs: Column) -> Column:
        def keep(gone: Column) -> Column:
            left = F.array_except(F.sequence(F.lit(0), F.size(xs) - 1), gone)
            return F.struct(F.array_join(F.transform(left, lambda i: xs[i]), "\n").alias("text"), F.size(gone).alias("n"))

        return _let(removed(xs), keep)

    n_lines = F.coalesce(F.size(F.filter(lines, lambda x: _trimmed(x) != "")), F.lit(0))
    out = joined.withColumn("_lodestrata_new", F.when(F.col("_lodestrata_starts").isNotNull(), _let(lines, rebuilt)))
    columns = [F.coalesce("_lodestrata_new.text", "text").alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*columns, F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"), F.coalesce("_lodestrata_new.n", F.lit(0)).cast("long").alias("n_removed"))
