"""Itinerary texts and plans: days, codes, map points, structure checks, releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chinese_number, col
from .ordered import asof, previous

#: Words of a day that was planned as a relaxed one, and the states of a proposal with those that each may follow.
RELAXED = ("慢节奏", "赶景点", "景点资源较少", "以品尝本地小吃", "以当地美食与街巷", "以寻味探店", "美食与休闲", "街角漫步")
FOLLOWS = {"proposed": (), "regression_passed": ("proposed",), "rejected": ("proposed",), "approved": ("regression_passed",), "gray_released": ("approved",), "rolled_back": ("approved", "gray_released")}

_DATE = r"20\d{2}-\d{2}-\d{2}"
_DAY = r"第([一二三四五六七八九十两\d]{1,3})天|[Dd][Aa][Yy]\s*(\d{1,2})"


def day_parts(texts: DataFrame) -> DataFrame:
    """``texts(id, text)`` to ``id, part, label, body``: cut at "day N" titles, else at dates, else one part.

    A date with less than 40 characters to the next one is part of a range and cuts nothing.
    """
    marks = F.split(F.regexp_replace("text", f"(?={_DAY})", "\x01"), "\x01")
    has_title = F.coalesce(F.col("text").rlike(_DAY), F.lit(False))
    parts = texts.where(has_title).select("id", F.posexplode(marks).alias("i", "body"))
    cn, digits = F.regexp_extract("body", f"^(?:{_DAY})", 1), F.regexp_extract("body", f"^(?:{_DAY})", 2)
    rows = parts.where((cn != "") | (digits != ""))
    number = F.coalesce(F.when(cn != "", chinese_number(cn)), digits.try_cast("int"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("i"))
    titled = rows.select("id", place.alias("part"), F.concat(F.lit("第"), F.coalesce(number, place).cast("string"), F.lit("天")).alias("label"), "body")

    dates = F.split(F.regexp_replace("text", f"(?={_DATE})", "\x01"), "\x01")
    cut = texts.where(~has_title).select("id", F.coalesce("text", F.lit("")).alias("text"), F.posexplode(F.coalesce(dates, F.array(F.lit("")))).alias("i", "body"))
    w = Window.partitionBy("id").orderBy("i")
    dated = F.col("body").rlike(f"^{_DATE}")
    starts = cut.withColumn("starts", dated & ((F.length("body") - 10 >= 40) | F.lead("i").over(w).isNull()))
    group = F.sum(F.col("starts").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    grouped = starts.withColumn("part", group).withColumn("parts", F.max("part").over(Window.partitionBy("id")))
    # a date that cuts nothing stays with the part before it; what comes before the first cut goes, if there is one
    kept = grouped.where((F.col("parts") == 0) | (F.col("part") > 0)).groupBy("id", "part", "parts").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "body"))), lambda x: x["body"]), "").alias("body"))
    label = F.when(F.col("parts") == 0, "行程").otherwise(F.substring("body", 1, 10))
    return titled.unionByName(kept.select("id", F.greatest("part", F.lit(1)).cast("int").alias("part"), label.alias("label"), "body"))


def keep_codes(text: Column | str, known: Column | str) -> Column:
    """Flight and train codes that are not known taken out of a text, with the words left bare by it."""
    x = col(text)
    codes = F.regexp_extract_all(x, F.lit(r"\b([A-Z]{1,2}\d{2,4})\b"), F.lit(1))
    gone = F.array_except(F.array_distinct(codes), col(known))
    bare = F.aggregate(gone, x, lambda t, c: F.regexp_replace(t, F.concat(F.lit(r"\b"), c, F.lit(r"\b")), F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "[（(]\\s*[)）]", ""), "[ \t]{2,}", " "))


def compact(text: Column | str) -> Column:
    """Blank lines taken out, except before headings; lines right-trimmed."""
    x = F.regexp_replace(col(text), r"(?m)[ \t]+$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"\n{2,}(?!#|\*\*|第[^\n]{1,3}天)", "\n"), r"\n{3,}", "\n\n"))


def map_points(points: DataFrame, most: int = 20) -> DataFrame:
    """``points(plan_id, day, place, name, lng, lat)`` to ``plan_id, day, points``: those with coordinates, the first ``most`` of a plan, days without any left out."""
    good = points.where("lng is not null and lat is not null and name <> ''")
    kept = good.withColumn("n", F.row_number().over(Window.partitionBy("plan_id").orderBy("day", "place"))).where(F.col("n") <= most)
    return kept.groupBy("plan_id", "day").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name", "lng", "lat"))), lambda x: F.struct(x["name"].alias("name"), x["lng"].alias("lng"), x["lat"].alias("lat"))).alias("points"))


def verified(attractions: DataFrame, found: DataFrame) -> DataFrame:
    """``plan_id, day, total, verified, missing``: attractions ``(plan_id, day, name, lng)`` of which a found name ``(name, poi_name)`` contains the name, or is contained."""
    good = (F.trim("poi_name") != "") & (F.col("poi_name").contains(F.col("name")) | F.col("name").contains(F.trim("poi_name")))
    known = found.where(good).select("name").distinct().withColumn("known", F.lit(True))
    return attractions.join(known, "name", "left").groupBy("plan_id", "day").agg(F.count("*").alias("total"), F.count_if(F.col("known")).alias("verified"), F.count_if(F.col("lng").isNull()).alias("missing"))


def structure(plans: DataFrame, days: DataFrame) -> DataFrame:
    """``plan_id, ok, shortage, relaxed``: ``plans(plan_id, travel_days, least)`` against ``days(plan_id, day, attractions, description)``; a short day passes if it was planned as a relaxed one."""
    relaxed = F.exists(F.array(*map(F.lit, RELAXED)), lambda w: F.coalesce(F.col("description"), F.lit("")).contains(w))
    short = F.col("attractions") < F.col("least")
    joined = plans.join(days, "plan_id", "left")
    counts = joined.groupBy("plan_id", "travel_days").agg(F.count("day").alias("n"), F.count_if(short & ~relaxed).alias("shortage"), F.count_if(short & relaxed).alias("relaxed"), F.min("attractions").alias("fewest"))
    return counts.select("plan_id", ((F.col("n") == F.col("travel_days")) & (F.col("shortage") == 0)).alias("ok"), "shortage", "relaxed", "fewest")


def releases(steps: DataFrame) -> DataFrame:
    """``valid`` for each step ``(proposal_id, n, state)``: whether its state may follow the last valid one."""
    rules = F.create_map(*(x for s, before in FOLLOWS.items() for x in (F.lit(s), F.array(*map(F.lit, before)).cast("array<string>"))))
    ordered = F.array_sort(F.collect_list(F.struct("n", "state")))
    start = F.struct(F.lit("").alias("at"), F.array().cast("array<struct<n:int,state:string,valid:boolean>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        ok = F.when(acc["at"] == "", x["state"] == "proposed").otherwise(F.array_contains(F.coalesce(F.try_element_at(rules, x["state"]), F.array().cast("array<string>")), acc["at"]))
        return F.struct(F.when(ok, x["state"]).otherwise(acc["at"]).alias("at"), F.concat(acc["out"], F.array(F.struct(x["n"].alias("n"), x["state"].alias("state"), ok.alias("valid")))).alias("out"))

    grouped = steps.select("proposal_id", F.col("n").cast("int").alias("n"), "state").groupBy("proposal_id").agg(F.aggregate(ordered, start, step)["out"].alias("out"))
    return grouped.select("proposal_id", F.inline("out"))


def gate(proposals: DataFrame) -> DataFrame:
    """``state`` after a regression run: passed if the accuracy is known and not below the baseline."""
    return proposals.withColumn("state", F.when(F.col("accuracy") >= F.col("baseline"), "regression_passed").otherwise("rejected"))


def missing_slots(flags: Column | str, wanted: list[str]) -> Column:
    """Names of wanted slots that are not set in ``map<string, boolean>``."""
    return F.filter(F.array(*map(F.lit, wanted)), lambda k: ~F.coalesce(F.try_element_at(col(flags), k), F.lit(False)))


def refreshed(checks: DataFrame, versions: DataFrame) -> DataFrame:
    """``refresh`` for each check ``(client, ts)``: whether a newer version ``(version, ts)`` came since the client's last check; the first check records only.

    The version that a check sees is the greatest up to its time.
    """
    seen = asof(checks.select("client", "ts"), versions.select("ts", F.col("version").alias("seen")), "ts", "seen", greatest=True)
    both = previous(seen, ["client"], ["ts"], ["seen"])
    newer = F.col("before").isNotNull() & (F.coalesce("seen", F.lit(-1)) > F.coalesce("before.seen", F.lit(-1)))
    return both.select("client", "ts", "seen", newer.alias("refresh"))


def plan_markdown(days: DataFrame) -> DataFrame:
    """``plan_id, markdown``: a heading a day and a line an item, from ``days(plan_id, day, date, place, item)``."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "item"))), lambda x: F.concat(F.lit("- "), x["item"])), "\n")
    each = days.groupBy("plan_id", "day", "date").agg(lines.alias("body"))
    text = F.concat(F.lit("## 第"), (F.col("day") + 1).cast("string"), F.lit("天 "), F.col("date").cast("string"), F.lit("\n\n"), F.col("body"))
    return each.groupBy("plan_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("day", text.alias("t")))), lambda x: x["t"]), "\n\n").alias("markdown"))
