"""Itineraries: points of interest, days, fares, budgets, fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.places import haversine
from ..functions.routing import generic_place, in_box
from .mentions import mentions


def split_days(pois: DataFrame, key: str, order: list, days: int) -> DataFrame:
    """Contiguous groups of each key's rows, the first ones one larger where they do not divide evenly."""
    return pois.withColumn("day", F.ntile(days).over(Window.partitionBy(key).orderBy(*order)))


def once_across_days(rows: DataFrame, plan: str, name: str, order: list) -> DataFrame:
    """Rows of a plan without names seen before; rows without a name stay."""
    n = F.row_number().over(Window.partitionBy(plan, name).orderBy(*order))
    return rows.withColumn("__n", n).where((F.col("__n") == 1) | F.col(name).isNull() | (F.col(name).cast("string") == "")).drop("__n")


def median_cost(rows: DataFrame, key: str, cost: str) -> DataFrame:
    """The median of the costs that are numbers above 0."""
    x = F.col(cost).try_cast("double")
    return rows.groupBy(key).agg(F.percentile(F.when(x > 0, x), 0.5).alias("median_cost"))


def cheapest(fares: DataFrame, key: str) -> DataFrame:
    """The lowest price over ``seats``, a map of seat to price text; the first seat and train on ties."""
    each = fares.select(key, "train", F.explode("seats").alias("seat", "price")).withColumn("p", F.col("price").try_cast("double")).where("p > 0")
    return each.groupBy(key).agg(F.min(F.struct("p", "train", "seat")).alias("m")).select(key, F.col("m.train").alias("train"), F.col("m.seat").alias("seat"), F.col("m.p").alias("price"))


def fastest(trains: DataFrame, key: str) -> DataFrame:
    """The train of the shortest ``minutes`` (null ones are passed over), the first by name on ties."""
    return trains.where("minutes is not null").groupBy(key).agg(F.min(F.struct("minutes", "train")).alias("m")).select(key, F.col("m.train").alias("train"), F.col("m.minutes").alias("minutes"))


def budget(hotel: Column, meal: Column, days: Column, default_hotel: float = 300.0, default_meal: float = 50.0, meals: int = 3) -> Column:
    """Stay and meals of a trip: unit prices or defaults, one night less than days but one at least, 1 to 30 days."""
    d = F.greatest(F.lit(1), F.least(F.lit(30), days))
    stay = F.coalesce(hotel, F.lit(default_hotel)) * F.greatest(F.lit(1), d - 1)
    food = F.coalesce(meal, F.lit(default_meal)) * meals * d
    return F.struct(d.alias("days"), stay.alias("stay"), food.alias("meals"), (stay + food).alias("total"))


def over_budget(total: Column, limit: Column) -> Column:
    """(over, percent): what exceeds the limit, and its share in whole percent, halves to even; nulls within it."""
    over = total - limit
    return F.when((limit > 0) & (over > 0), F.struct(over.alias("over"), F.bround(over / limit * 100, 0).cast("int").alias("percent")))


def nearest_match(attractions: DataFrame, pois: DataFrame, most_m: float = 3000.0, cell: float = 0.05) -> DataFrame:
    """The first POI (by ``poi_rank``) for each attraction whose name contains the other's or that lies within ``most_m``.

    Both sides are dealt by a grid of ``cell`` degrees, an attraction to its
    cell and those around it, so that distances are taken within neighbouring
    cells; names pass an automaton of the other side's names, and meet within
    ``city``.
    """
    grid = lambda c: F.floor(F.col(c) / cell)
    near = F.sequence(F.lit(-1), F.lit(1))
    a = attractions.withColumn("gx", F.explode(F.transform(near, lambda d: grid("lng") + d))).withColumn("gy", F.explode(F.transform(near, lambda d: grid("lat") + d)))
    p = pois.select("poi_id", "poi_rank", F.col("name").alias("poi_name"), F.col("lat").alias("plat"), F.col("lng").alias("plng"), F.col("city").alias("pcity"), grid("lng").alias("gx"), grid("lat").alias("gy"))
    distance = haversine(F.col("lat"), F.col("lng"), F.col("plat"), F.col("plng"))
    by_place = a.join(p, ["gx", "gy"]).where(distance <= most_m).select("attraction_id", "poi_id", "poi_rank")
    texts = lambda df: df.where("name <> ''").select(F.col("name").alias("doc_id"), F.col("name").alias("text")).distinct()
    terms = lambda df: df.where("name <> ''").select(F.col("name").alias("term"))
    inside = mentions(texts(attractions), terms(pois), maximal=False).select(F.col("doc_id").alias("name"), F.explode("terms").alias("poi_name"))
    around = mentions(texts(pois), terms(attractions), maximal=False).select(F.explode("terms").alias("name"), F.col("doc_id").alias("poi_name"))
    first = pois.where("name <> ''").groupBy(F.col("name").alias("poi_name"), "city").agg(F.min(F.struct("poi_rank", "poi_id")).alias("p"))
    named = attractions.select("attraction_id", "name", "city").join(inside.union(around).distinct(), "name").join(first, ["poi_name", "city"])
    by_name = named.select("attraction_id", "p.poi_id", "p.poi_rank")
    both = by_place.union(by_name)
    return both.groupBy("attraction_id").agg(F.min(F.struct("poi_rank", "poi_id")).alias("m")).select("attraction_id", F.col("m.poi_id").alias("poi_id"))


def in_window_or_all(rows: DataFrame, key: str, inside: Column) -> DataFrame:
    """Rows inside a window, or all rows of a key that has none inside."""
    return rows.withColumn("__in", inside).withColumn("__any", F.max(F.col("__in").cast("int")).over(Window.partitionBy(key))).where(F.col("__in") | (F.col("__any") == 0)).drop("__in", "__any")


def primary_or_backup(requests: DataFrame, primary: DataFrame, backup: DataFrame, key: str, most_backup: int) -> DataFrame:
    """Rows of the primary source, or up to ``most_backup`` of the backup for requests of which it has none; ``degraded`` marks those."""
    missing = requests.join(primary.select(key).distinct(), key, "left_anti")
    spare = backup.join(missing.select(key), key, "left_semi").withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("place"))).where(F.col("n") <= most_backup).drop("n")
    return primary.join(requests.select(key), key, "left_semi").withColumn("degraded", F.lit(False)).unionByName(spare.withColumn("degraded", F.lit(True)))


def itinerary_dates(plans: DataFrame) -> DataFrame:
    """Days of ``plans(plan_id, start, days, items)`` numbered from 0 with their dates, those beyond ``days`` left out."""
    return plans.select("plan_id", "start", "days", F.posexplode("items").alias("day_index", "item")).where(F.col("day_index") < F.col("days")).select("plan_id", "day_index", F.date_add("start", F.col("day_index")).alias("date"), "item")


def trip_budget(entries: DataFrame, key: str = "plan_id") -> DataFrame:
    """Sums of ``entries(key, kind, cost)`` by kind and in all; costs that are no numbers count 0."""
    cost = F.coalesce(F.col("cost").cast("string").try_cast("double"), F.lit(0.0))
    part = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, cost)), F.lit(0.0)).alias(kind)
    kinds = ("attractions", "hotels", "meals", "transport")
    sums = entries.groupBy(key).agg(*map(part, kinds))
    return sums.withColumn("total", F.col("attractions") + F.col("hotels") + F.col("meals") + F.col("transport"))


def with_distances(pois: DataFrame, distances: DataFrame, keep: bool = False) -> DataFrame:
    """POIs with the distance row of their location, the last by ``place`` where there are several; without one they go, unless ``keep``."""
    rows = distances.where("origin is not null and origin <> ''").groupBy("origin").agg(F.max_by(F.struct("distance_m", "duration_s"), "place").alias("d"))
    joined = pois.join(rows, pois["location"] == rows["origin"], "left" if keep else "inner")
    return joined.select(*(pois[c] for c in pois.columns), F.col("d.distance_m").alias("distance_m"), F.col("d.duration_s").alias("duration_s"))


def located(asked: DataFrame, primary: DataFrame, backup: DataFrame) -> DataFrame:
    """``id, name, latitude, longitude, loc_source`` of ``asked(id, destination, city, latitude, longitude)``, without those that nothing locates.

    The destination, unless it is generic, then the city: each by ``primary``,
    else by ``backup`` ``(place, latitude, longitude)``; at last the given
    coordinates, if they are in the country.
    """
    place = F.when(~generic_place("destination") & (F.coalesce("destination", F.lit("")) != ""), F.col("destination"))
    rows = asked.withColumn("first", place)
    found = []
    for side, column in (("p1", "first"), ("b1", "first"), ("p2", "city"), ("b2", "city")):
        source = (primary if side[0] == "p" else backup).select(F.col("place").alias(f"{side}_place"), F.struct("latitude", "longitude", F.lit("primary" if side[0] == "p" else "backup").alias("source")).alias(side))
        rows = rows.join(source.dropDuplicates([f"{side}_place"]), rows[column] == F.col(f"{side}_place"), "left")
        found.append(side)
    given = F.when(in_box("latitude", "longitude"), F.struct("latitude", "longitude", F.lit("fallback").alias("source")))
    name = F.coalesce(F.nullif("destination", F.lit("")), "city")
    out = rows.withColumn("at", F.coalesce(*found, given)).where("at is not null")
    return out.select("id", name.alias("name"), F.col("at.latitude").alias("latitude"), F.col("at.longitude").alias("longitude"), F.col("at.source").alias("loc_source"))


def usable(pois: DataFrame) -> DataFrame:
    """POIs with a name and a location or an address."""
    filled = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    return pois.where(filled("name") & (filled("location") | filled("address")))


def capped_union(hits: DataFrame, fallback: DataFrame, key: str, order: list[str], least: int = 5, most: int = 12) -> DataFrame:
    """The first ``most`` hits of each key; keys with fewer than ``least`` get those of ``fallback`` behind them. The cap is the feature."""
    few = hits.groupBy(key).agg(F.count("*").alias("__n"))
    rest = fallback.join(few.where(F.col("__n") >= least), key, "left_anti")
    both = hits.withColumn("__side", F.lit(0)).unionByName(rest.withColumn("__side", F.lit(1)))
    place = F.row_number().over(Window.partitionBy(key).orderBy("__side", *order))
    return both.withColumn("__n", place).where(F.col("__n") <= most).drop("__n", "__side")
