"""Conversations: recent messages, sessions, compression, follow-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHORTENED = "…(已截断)"


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    """The last ``n`` messages of each conversation ``(conv_id, turn, role, text)``; ``place`` counts from the oldest of them."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    kept = messages.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= n)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).drop("back")


def sessions(messages: DataFrame) -> DataFrame:
    """``conv_id, message_count, last_turn, title, preview``: the title is the first user text, else the last text."""
    user = F.when(F.col("role") == "user", F.col("turn"))
    grouped = messages.groupBy("conv_id").agg(
        F.count("*").alias("message_count"), F.max("turn").alias("last_turn"), F.min_by(F.when(F.col("role") == "user", F.col("text")), user).alias("first_user"), F.max_by("text", "turn").alias("last_text")
    )
    return grouped.select("conv_id", "message_count", "last_turn", F.substring(F.coalesce("first_user", "last_text"), 1, 60).alias("title"), F.substring("last_text", 1, 80).alias("preview"))


def history_text(messages: DataFrame, most: int = 160) -> DataFrame:
    """``conv_id, history``: one ``role: text`` line a message, long texts shortened and marked.

    A user's message is told by its ``rewritten_query``, where the table has one.
    """
    if "rewritten_query" in messages.columns:
        told = F.when(F.col("role") == "user", F.coalesce(F.nullif("rewritten_query", F.lit("")), F.col("text"))).otherwise(F.col("text"))
        messages = messages.withColumn("text", told)
    short = F.when(F.length("text") > most, F.concat(F.substring("text", 1, most), F.lit(SHORTENED))).otherwise(F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), short).alias("line"))))
    return messages.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("history"))


def compress(messages: DataFrame, head: int = 4, tail: int = 6, most: int = 1500) -> DataFrame:
    """``conv_id, head, middle, tail``: ends kept, what lies between as one text of at most ``most`` characters."""
    w = Window.partitionBy("conv_id")
    placed = messages.withColumn("i", F.row_number().over(w.orderBy("turn"))).withColumn("n", F.count("*").over(w))
    zone = F.when(F.col("i") <= head, "head").when(F.col("i") > F.greatest(F.lit(head), F.col("n") - tail), "tail").otherwise("middle")
    texts = lambda z: F.transform(F.array_sort(F.collect_list(F.when(F.col("zone") == z, F.struct("i", "text")))), lambda x: x["text"])
    grouped = placed.withColumn("zone", zone).groupBy("conv_id").agg(texts("head").alias("head"), texts("middle").alias("middle"), texts("tail").alias("tail"))
    return grouped.select("conv_id", F.array_join("head", "\n").alias("head"), F.substring(F.array_join("middle", "\n"), 1, most).alias("middle"), F.array_join("tail", "\n").alias("tail"))


def inherited(messages: DataFrame, domain: str, back: int = 3) -> DataFrame:
    """``inherited_turn``: the latest of the ``back`` messages before each one that is in ``domain``."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-back, -1)
    return messages.withColumn("inherited_turn", F.last(F.when(F.col("domain") == domain, F.col("turn")), ignorenulls=True).over(w))


def prompt_history(messages: DataFrame, most: int = 160, answers: int | None = None) -> DataFrame:
    """``conv_id, history``: a line of role, content and subjects for each of ``messages(conv_id, turn, role, text, rewritten_query, item_names)``, by turn.

    A user's content is the rewritten question, others' their text; contents
    are trimmed, cut after ``most`` characters and marked. ``answers`` is the
    limit of those that are not the user's, larger where a question points
    back at them (400).
    """
    user = F.coalesce(F.col("role") == "user", F.lit(False))
    content = F.regexp_replace(F.coalesce(F.when(user, F.col("rewritten_query")).otherwise(F.col("text")), F.lit("")), r"(?U)^\s+|\s+$", "")
    limit = F.when(user, F.lit(most)).otherwise(F.lit(answers or most))
    short = F.when(F.length(content) > limit, F.concat(F.substr(content, F.lit(1), limit), F.lit(SHORTENED))).otherwise(content)
    names = F.array_join(F.coalesce("item_names", F.array().cast("array<string>")), "、")
    line = F.concat(F.lit("角色:"), F.coalesce("role", F.lit("")), F.lit(",内容:"), short, F.lit(",关联主体: "), names)
    return messages.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("history"))
