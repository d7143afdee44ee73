"""What happens to a ranked list before it is shown: condensing, cutting, seats for sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sentences, term_set


def condense(rows: DataFrame, limit: int) -> DataFrame:
    """``rows(id, question, text)`` to ``id, condensed``: texts over ``limit`` characters cut to the sentences nearest the question.

    A sentence scores 2 x (share of the question's terms it has) + share of its
    own terms the question has, 0.15 more among the first three. Sentences are
    taken by score while what is taken is below the limit, the last cut to fit,
    and put back in order.
    """
    q, s = F.col("q"), F.col("s")
    long = rows.where(F.length("text") > limit).select("id", "text", term_set("question").alias("q"), F.posexplode_outer(sentences("text")).alias("i", "sentence"))
    scored = long.withColumn("s", term_set("sentence")).where(F.size("s") > 0)
    overlap = F.size(F.array_intersect(q, s))
    score = overlap / F.greatest(F.size(q), F.lit(1)) * 2 + overlap / F.size(s) + F.when(F.col("i") < 3, 0.15).otherwise(0.0)
    taken = Window.partitionBy("id").orderBy(F.desc("score"), "i").rowsBetween(Window.unboundedPreceding, -1)
    picked = scored.withColumn("score", F.round(score, 9)).withColumn("before", F.coalesce(F.sum(F.length("sentence")).over(taken), F.lit(0))).where(F.col("before") < limit)
    cut = F.substr(F.col("sentence"), F.lit(1), (F.lit(limit) - F.col("before")).cast("int"))
    made = picked.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", cut.alias("c")))), lambda x: x["c"]), "").alias("condensed"))
    return rows.select("id", "text").join(made, "id", "left").select("id", F.coalesce("condensed", F.substring("text", 1, limit)).alias("condensed"))


def cliff_cut(ranked: DataFrame, most: int = 10, least: int = 1, gap: float = 2.0, ratio: float = 2.0) -> DataFrame:
    """Rows of ``ranked(query_id, rank, score)`` before the first score cliff, at most ``most``."""
    w = Window.partitionBy("query_id").orderBy("rank")
    head = ranked.where(F.col("rank") <= most)
    drop = F.col("score") - F.lead("score").over(w)
    cliff = F.when((F.col("rank") >= least) & ((drop > gap) | (drop / (F.col("score") + 1e-7) > ratio)), F.col("rank"))
    return head.withColumn("cliff", cliff).withColumn("cut", F.min("cliff").over(Window.partitionBy("query_id"))).where(F.col("cut").isNull() | (F.col("rank") <= F.col("cut"))).drop("cliff", "cut")


def quota(top: DataFrame, full: DataFrame, window: int = 5, seats: int = 3) -> DataFrame:
    """Seats for local documents among the first ``window``.

    ``top`` and ``full`` are ranked lists ``query_id, doc_id, rank, kind``;
    where fewer than ``seats`` of the window are local, the lowest web rows
    give way to the best local rows outside it. Nothing is sorted anew.
    """
    head = top.where(F.col("rank") <= window)
    missing = head.groupBy("query_id").agg((F.lit(seats) - F.count_if(F.col("kind") != "web")).alias("missing")).where("missing > 0")
    slot = Window.partitionBy("query_id").orderBy(F.desc("rank"))
    web = head.where("kind = 'web'").join(missing, "query_id").withColumn("n", F.row_number().over(slot)).where("n <= missing").select("query_id", "rank", "n")
    outside = full.where("kind <> 'web'").join(head.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    swap = web.join(outside.select("query_id", "n", F.col("doc_id").alias("new_id"), F.col("kind").alias("new_kind")), ["query_id", "n"]).drop("n")
    return top.join(swap, ["query_id", "rank"], "left").select("query_id", "rank", F.coalesce("new_id", "doc_id").alias("doc_id"), F.coalesce("new_kind", "kind").alias("kind"))


def with_web(local: DataFrame, web: DataFrame) -> DataFrame:
    """Local and web candidates as one table; web rows have score 0 and no local columns."""
    return local.withColumn("kind", F.lit("local")).unionByName(web.withColumns({"kind": F.lit("web"), "score": F.lit(0.0)}), allowMissingColumns=True)


def source_list(docs: DataFrame, most: int = 5) -> DataFrame:
    """``query_id, sources``: of the first ``most`` documents, local titles and then web links, each once, in order."""
    head = docs.where(F.col("rank") <= most).withColumns({"web": (F.col("kind") == "web").cast("int"), "name": F.when(F.col("kind") == "web", F.col("url")).otherwise(F.col("title"))}).where("name is not null")
    once = head.groupBy("query_id", "web", "name").agg(F.min("rank").alias("place"))
    ordered = F.array_sort(F.collect_list(F.struct("web", "place", "name")))
    return once.groupBy("query_id").agg(F.transform(ordered, lambda x: x["name"]).alias("sources"))


def sentence_budget(query_terms: Column, tokens: int = 512, per_char: float = 1.3, least: int = 50) -> Column:
    """Characters of a candidate that fit beside a question in a pair of ``tokens``."""
    return F.greatest(F.lit(least), ((tokens - query_terms - 4) / per_char).cast("int"))


def candidates(local: DataFrame, web: DataFrame, plan: Column, policy: str = "both") -> DataFrame:
    """Local and web candidates ``(query_id, ...)`` of each question: with the policy "kb" no web ones, and none for a plan that has local ones.

    ``plan`` is a condition on ``query_id``.
    """
    if policy == "kb":
        return local
    has_local = local.select("query_id").distinct()
    kept = web.where(~plan).unionByName(web.where(plan).join(has_local, "query_id", "left_anti"))
    return local.unionByName(kept)
