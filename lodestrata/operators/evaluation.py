"""Retrieval and answer evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import staged


def ratio(a: Column, b: Column, digits: int = 4) -> Column:
    """a / b rounded, 0 where b is 0."""
    return F.round(F.when(b == 0, 0.0).otherwise(a / b), digits)


def retrieval_metrics(rows: DataFrame) -> DataFrame:
    """``rows(id, found, gold)``, arrays, to precision, recall, F1 and hit."""
    hits = F.size(F.array_intersect("found", "gold"))
    p, r = ratio(hits, F.size("found")), ratio(hits, F.size("gold"))
    return rows.select("id", p.alias("precision"), r.alias("recall"), ratio(2 * hits, F.size("found") + F.size("gold")).alias("f1"), (hits > 0).alias("hit"))


def confusion(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``rows(expected boolean, accept boolean or null)`` to counts and rates; unresolved rows are outside every rate."""
    e, a = F.col("expected"), F.col("accept")
    counts = (rows.groupBy(*by) if by else rows.groupBy()).agg(
        F.count_if(F.coalesce(e & a, F.lit(False))).alias("tp"), F.count_if(F.coalesce(~e & a, F.lit(False))).alias("fp"), F.count_if(F.coalesce(e & ~a, F.lit(False))).alias("fn"),
        F.count_if(F.coalesce(~e & ~a, F.lit(False))).alias("tn"), F.count_if(a.isNull()).alias("unresolved"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return counts.withColumns({"accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": p, "recall": r, "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def flips(base: DataFrame, new: DataFrame) -> DataFrame:
    """``id, change`` of two runs ``(id, accept)``: improved, regressed, unresolved, same, only_base or only_new."""
    b, n = F.col("b.accept"), F.col("n.accept")
    change = F.when(F.col("n.id").isNull(), "only_base").when(F.col("b.id").isNull(), "only_new").when(b.eqNullSafe(n), "same").when(b.isNull() | n.isNull(), "unresolved").when(n, "improved").otherwise("regressed")
    return base.alias("b").join(new.alias("n"), F.col("b.id") == F.col("n.id"), "full").select(F.coalesce("b.id", "n.id").alias("id"), change.alias("change"))


def latency(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Count, mean, 50th and 95th percentile and maximum; percentiles are the value at index round(q (n - 1)), halves to even.

    Equal values are counted first, then bins of neighbouring magnitude, about
    256 to a doubling; only the bins that hold an index are sorted.
    """
    x = F.col(value).cast("double")
    size = F.floor(F.log2(F.abs(x)) * 256) + 1_000_000
    bin_ = F.when(x == 0, 0).when(x > 0, size).otherwise(-size)
    counted = staged(rows.where(x.isNotNull()).groupBy(by, bin_.cast("long").alias("bin"), value).agg(F.count("*").alias("c")), "latencies")
    whole = Window.partitionBy(by)
    bins = counted.groupBy(by, "bin").agg(F.sum("c").alias("c"))
    bins = bins.select(by, "bin", "c", (F.sum("c").over(whole.orderBy("bin")) - F.col("c")).alias("before"), F.sum("c").over(whole).alias("n"))
    index = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.bround(q * (F.col("n") - 1), 0).cast("long").alias("i")) for name, q in (("p50", 0.5), ("p95", 0.95))))).alias("q")
    wanted = bins.select(by, "bin", "c", "before", index).where("q.i >= before and q.i < before + c").select(F.col(by).alias("_group"), F.col("bin").alias("own"), "before", "q.name", "q.i")
    inside = counted.join(wanted, F.col(by).eqNullSafe(F.col("_group")) & (F.col("bin") == F.col("own")))
    up_to = F.col("before") + F.sum("c").over(Window.partitionBy(by, "bin", "name").orderBy(value))
    picked = inside.withColumn("up_to", up_to).where("up_to > i").groupBy(by).agg(*(F.min(F.when(F.col("name") == name, F.col(value))).alias(name) for name in ("p50", "p95")))
    sums = rows.where(x.isNotNull()).groupBy(F.col(by).alias("_group")).agg(F.count("*").alias("n"), F.round(F.avg(value), 4).alias("mean"), F.max(value).alias("most"))
    return sums.join(picked, F.col("_group").eqNullSafe(F.col(by))).select(by, "n", "mean", "p50", "p95", "most")


def review_sample(rows: DataFrame, share: float, seed: int) -> DataFrame:
    """All failures and, in an order fixed by the seed, passes up to ``share`` of all rows; ``rows(id, passed)``.

    The order is that of a digest, so its first digits deal the passes evenly;
    places are counted within each of 4096 parts and the parts before it.
    """
    total = rows.agg(F.ceil(F.count("*") * share).alias("want"), F.count_if(~F.col("passed")).alias("failed"))
    keyed = rows.where("passed").withColumn("key", F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}")))).withColumn("part", F.substring("key", 1, 3))
    before = keyed.groupBy("part").agg(F.count("*").alias("c")).select("part", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("key", "id")) + F.col("before")
    passes = keyed.join(F.broadcast(before), "part").withColumn("n", place).crossJoin(F.broadcast(total)).where(F.col("n") <= F.col("want") - F.col("failed"))
    return rows.where(~F.col("passed")).select("id", "passed").union(passes.select("id", "passed"))


def unresolved(rows: DataFrame, most_share: float = 0.1) -> DataFrame:
    """``id`` of the rows without a verdict, and ``warn``: whether they are more than ``most_share`` of all."""
    total = rows.agg((F.count_if(F.col("accept").isNull()) > most_share * F.count("*")).alias("warn"))
    return rows.where("accept is null").select("id").crossJoin(F.broadcast(total))


def picked(cases: DataFrame, ids: DataFrame) -> DataFrame:
    """The cases of a list of ids, with ``found`` false for ids that no case has."""
    return ids.select("id").distinct().join(cases.withColumn("found", F.lit(True)), "id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def overridden(judged: DataFrame, human: DataFrame) -> DataFrame:
    """Human verdicts in place of the judge's where there are any."""
    return judged.join(human.select("id", F.col("accept").alias("h")), "id", "left").select("id", F.coalesce("h", "accept").alias("accept"), F.col("h").isNotNull().alias("reviewed"))


def macro(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means of ``metrics(precision, recall, f1, hit)`` over its rows, and ``acc_micro``, the share of rows with a hit; 0 for no rows."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4)
    hit = F.col("hit").cast("double")
    grouped = metrics.groupBy(*by) if by else metrics.groupBy()
    return grouped.agg(F.count("*").alias("cases"), *(mean(F.col(c)).alias(c) for c in ("precision", "recall", "f1")), mean(hit).alias("hit"), mean(hit).alias("acc_micro"))


def report(metrics: DataFrame, title: str = "report") -> DataFrame:
    """One row per line of a Markdown table of ``metrics``: ``line, text``, to be written as text; numbers as they print in SQL."""
    names = metrics.columns
    head = metrics.sparkSession.createDataFrame([(0, f"# {title}"), (1, ""), (2, "| " + " | ".join(names) + " |"), (3, "|" + "---|" * len(names))], "line long, text string")
    cells = F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names))
    order = F.row_number().over(Window.orderBy(*names))  # a report has a row per group
    return head.union(metrics.select((order + 3).cast("long"), F.concat(F.lit("| "), cells, F.lit(" |"))))


def regression_cases(cases: DataFrame, tags: list[str], impact: str | None = None, core: bool = False, impacts: dict[str, list[str]] | None = None) -> DataFrame:
    """Cases ``(id, tags)`` that have one of ``tags``, of those of an impact, or ``core``; all of them for the impact "all"."""
    if impact == "all":
        return cases
    wanted = [*tags, *((impacts or {})[impact] if impact else []), *(["core"] if core else [])]
    if not wanted:
        raise ValueError("neither tags nor an impact")
    return cases.where(F.arrays_overlap("tags", F.array(*map(F.lit, wanted))))
