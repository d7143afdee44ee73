"""Queries on itineraries. Parts stand for points of interest, suppliers for hotels, orders for trips, line items for fares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import places
from ..operators import budgets, planning
from .registry import query, table


@query("""SELECT p_partkey, p_brand, ntile(3) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS day FROM part""")
def candidates_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.split_days(table(spark, sf_dir, "part"), "p_brand", ["p_partkey"], 3).select("p_partkey", "p_brand", "day")


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_extendedprice) AS n FROM lineitem) WHERE n = 1""")
def once_per_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.once_across_days(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", ["l_linenumber", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT p_brand, round(quantile_cont(p_retailprice, 0.5), 6) AS median_cost FROM part WHERE p_retailprice > 0 GROUP BY p_brand""")
def median_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.median_cost(table(spark, sf_dir, "part"), "p_brand", "p_retailprice").withColumn("median_cost", F.round("median_cost", 6))


@query("""WITH e AS (SELECT l_orderkey AS trip, l_partkey AS train, unnest(['a', 'b']) AS seat, unnest([l_extendedprice, l_extendedprice * 1.5]) AS p FROM lineitem),
m AS (SELECT trip, arg_min(train, (p, train, seat)) AS train, arg_min(seat, (p, train, seat)) AS seat, min(p) AS price FROM e WHERE p > 0 GROUP BY trip) SELECT trip, train, seat, round(price, 6) AS price FROM m""")
def cheapest_fares(spark: SparkSession, sf_dir: str) -> DataFrame:
    seats = F.create_map(F.lit("a"), F.col("l_extendedprice").cast("string"), F.lit("b"), (F.col("l_extendedprice") * 1.5).cast("string"))
    fares = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trip"), F.col("l_partkey").alias("train"), seats.alias("seats"))
    return planning.cheapest(fares, "trip").withColumn("price", F.round("price", 6))


@query("""WITH t AS (SELECT l_orderkey AS trip, l_partkey AS train, CAST(l_quantity AS BIGINT) * 61 + l_linenumber AS m FROM lineitem)
SELECT trip, arg_min(train, (m, train)) AS train, CAST(min(m) AS INT) AS minutes FROM t WHERE m % 13 <> 0 GROUP BY trip""")
def fastest_trains(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("l_quantity").cast("long") * 61 + F.col("l_linenumber")
    text = F.when(m % 13 != 0, F.concat(F.floor(m / 60).cast("string"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"))).otherwise("--")
    trains = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trip"), F.col("l_partkey").alias("train"), places.minutes(text).alias("minutes"))
    return planning.fastest(trains, "trip")


@query("""WITH u AS (SELECT o_orderkey, greatest(1, least(30, CAST(count(l_linenumber) AS INT))) AS days, CASE WHEN o_orderkey % 3 <> 0 THEN floor(max(l_extendedprice) / 100) END AS hotel FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)
SELECT o_orderkey, days, round(coalesce(hotel, 300) * greatest(1, days - 1), 2) AS stay, 50.0 * 3 * days AS meals, round(coalesce(hotel, 300) * greatest(1, days - 1) + 150 * days, 2) AS total FROM u""")
def budget_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    trips = orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").groupBy("o_orderkey").agg(F.count("l_linenumber").cast("int").alias("n"), F.floor(F.max("l_extendedprice") / 100).alias("unit"))
    hotel = F.when(F.col("o_orderkey") % 3 != 0, F.col("unit"))
    made = trips.select("o_orderkey", planning.budget(hotel, F.lit(None).cast("double"), F.col("n")).alias("b"))
    return made.select("o_orderkey", "b.days", F.round("b.stay", 2).alias("stay"), F.col("b.meals").alias("meals"), F.round("b.total", 2).alias("total"))


@query("""SELECT coalesce(o_orderpriority, 'all') AS priority, coalesce(o_orderstatus, 'all') AS status, count(*) AS trips, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)""")
def budget_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("trips"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return sums.select(F.coalesce("o_orderpriority", F.lit("all")).alias("priority"), F.coalesce("o_orderstatus", F.lit("all")).alias("status"), "trips", "total")


@query("""SELECT o_orderkey, round(o_totalprice - 100000, 2) AS over, CAST(round_even((o_totalprice - 100000) / 100000 * 100, 0) AS INT) AS percent FROM orders WHERE o_totalprice > 100000""")
def over_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "orders").select("o_orderkey", planning.over_budget(F.col("o_totalprice"), F.lit(100000.0)).alias("b")).where("b is not null")
    return found.select("o_orderkey", F.round("b.over", 2).alias("over"), "b.percent")


_GEO = "(CAST({k} AS DOUBLE) * 7919 % 1000) / 200.0"


@query(f"""WITH a AS (SELECT c_custkey AS id, {_GEO.format(k="c_custkey")} AS lng, 20 + {_GEO.format(k="c_custkey * 31")} AS lat FROM customer),
p AS (SELECT s_suppkey AS pid, {_GEO.format(k="s_suppkey * 3")} AS plng, 20 + {_GEO.format(k="s_suppkey * 17")} AS plat FROM supplier),
d AS (SELECT id, pid, 2 * 6371000 * asin(sqrt(least(1.0, pow(sin((radians(plat) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(plat)) * pow(sin(radians(plng - lng) / 2), 2)))) AS m FROM a, p)
SELECT id AS attraction_id, min(pid) AS poi_id FROM d WHERE m <= 3000 GROUP BY id""")
def places_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first POI within 3 km of each attraction."""
    spot = lambda k: (k.cast("double") * 7919 % 1000) / 200.0
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("attraction_id"), F.lit("").alias("name"), F.lit("").alias("city"), spot(F.col("c_custkey")).alias("lng"), (20 + spot(F.col("c_custkey") * 31)).alias("lat"))
    p = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("poi_id"), F.col("s_suppkey").alias("poi_rank"), F.lit("").alias("name"), F.lit("").alias("city"), spot(F.col("s_suppkey") * 3).alias("lng"), (20 + spot(F.col("s_suppkey") * 17)).alias("lat"))
    return planning.nearest_match(a, p)


@query("""WITH x AS (SELECT o_orderkey, o_custkey, o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' AS inside FROM orders)
SELECT o_orderkey, o_custkey FROM (SELECT *, max(CAST(inside AS INT)) OVER (PARTITION BY o_custkey) AS n_in FROM x) WHERE inside OR n_in = 0""")
def window_or_everything(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    inside = (F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp")) & (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp"))
    return planning.in_window_or_all(orders, "o_custkey", inside).select("o_orderkey", "o_custkey")


@query("""WITH p AS (SELECT o_custkey AS k, o_orderkey AS place FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey AS k, o_orderkey AS place FROM orders WHERE o_orderstatus <> 'F'),
s AS (SELECT k, place, row_number() OVER (PARTITION BY k ORDER BY place) AS n FROM b WHERE k NOT IN (SELECT k FROM p) AND k IN (SELECT c_custkey FROM customer))
SELECT k, place, false AS degraded FROM p WHERE k IN (SELECT c_custkey FROM customer) UNION ALL SELECT k, place, true FROM s WHERE n <= 4""")
def primary_or_backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("place"), "o_orderstatus")
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return planning.primary_or_backup(asked, orders.where("o_orderstatus = 'F'").drop("o_orderstatus"), orders.where("o_orderstatus <> 'F'").drop("o_orderstatus"), "k", 4)


@query("""WITH n AS (SELECT l_orderkey AS plan_id, list(l_partkey ORDER BY l_linenumber, l_partkey) AS items FROM lineitem GROUP BY l_orderkey),
u AS (SELECT plan_id, CAST(o_orderdate AS DATE) AS start, unnest(items) AS item, generate_subscripts(items, 1) - 1 AS day_index FROM n JOIN orders ON o_orderkey = plan_id)
SELECT plan_id, CAST(day_index AS INT) AS day_index, CAST(start + CAST(day_index AS INT) AS VARCHAR) AS date, item FROM u WHERE day_index < 3""")
def itinerary_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    items = lines.groupBy(F.col("l_orderkey").alias("plan_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("items"))
    plans = items.join(orders, items.plan_id == orders.o_orderkey).select("plan_id", F.to_date("o_orderdate").alias("start"), F.lit(3).alias("days"), "items")
    return planning.itinerary_dates(plans).withColumn("date", F.col("date").cast("string"))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 50 AS km, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity / 4 END AS rail, CASE WHEN l_orderkey % 10 = 0 THEN 'rail' ELSE '' END AS asked FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN asked <> '' THEN asked WHEN km <= 300 THEN 'drive' WHEN rail >= 8 OR km >= 1000 THEN 'fly' WHEN rail IS NOT NULL THEN 'rail' ELSE 'drive' END AS way,
  round(km / 750 + 0.5, 4) AS flight_hours, round_even(km / 100 * 8 * 7.8, 0) AS fuel FROM t""")
def transport_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 50).alias("km"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity") / 4).alias("rail"), F.when(F.col("l_orderkey") % 10 == 0, "rail").otherwise("").alias("asked"))
    return t.select("l_orderkey", "l_linenumber", places.transport(F.col("asked"), F.col("km"), F.col("rail")).alias("way"), F.round(places.flight_hours(F.col("km")), 4).alias("flight_hours"), places.fuel_cost(F.col("km")).alias("fuel"))


@query("""SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE WHEN s_acctbal > 0 THEN 0 ELSE 1 END, s_suppkey) AS place FROM supplier""")
def urban_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preferred rows first, the order of the source within each kind."""
    from pyspark.sql import Window

    w = Window.partitionBy("s_nationkey").orderBy(F.when(F.col("s_acctbal") > 0, 0).otherwise(1), "s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.row_number().over(w).alias("place"))


@query("""WITH u AS (SELECT o_custkey, o_orderkey, o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS path FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY path, o_orderkey) AS n FROM u) SELECT o_custkey, o_orderkey, path FROM r WHERE n <= 12""")
def keyword_union_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of several keywords in order, the first twelve of each city: the cap is the feature."""
    from ..operators.retrieval import best

    path = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return best(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", path.alias("path")), ["o_custkey"], ["path", "o_orderkey"], 12).drop("rank")


@query("""WITH h AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F'), n AS (SELECT o_custkey, count(*) AS c FROM h GROUP BY o_custkey),
u AS (SELECT *, 0 AS side FROM h UNION ALL SELECT o_custkey, o_orderkey, 1 FROM orders LEFT JOIN n USING (o_custkey) WHERE o_orderstatus <> 'F' AND coalesce(c, 0) < 5)
SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY side, o_orderkey) AS n FROM u) WHERE n <= 12""")
def places_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword hits of a city, and generic ones where there are fewer than five."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    hits, others = rows.where("o_orderstatus = 'F'").drop("o_orderstatus"), rows.where("o_orderstatus <> 'F'").drop("o_orderstatus")
    return planning.capped_union(hits, others, "o_custkey", ["o_orderkey"])


_MONEY = lambda x: f"CASE WHEN abs({x} - round({x})) < 0.05 THEN printf('%.0f', {x}) ELSE printf('%.1f', {x}) END"


@query(f"""WITH l AS (SELECT l_orderkey AS k, count(*) AS n, CASE WHEN l_orderkey % 3 <> 0 THEN floor(max(l_extendedprice) / 100) END AS hotel, CASE WHEN l_orderkey % 5 <> 0 THEN floor(min(l_extendedprice) / 100) + 0.5 END AS meal,
  CASE l_orderkey % 4 WHEN 0 THEN 'fly' WHEN 1 THEN 'rail' WHEN 2 THEN 'drive' END AS way, CASE WHEN l_orderkey % 7 <> 0 THEN floor(sum(l_quantity)) END AS fare, CASE WHEN l_orderkey % 11 <> 0 THEN floor(sum(l_quantity) * 2) END AS fuel, l_orderkey % 8 = 3 AS rail FROM lineitem GROUP BY l_orderkey),
t AS (SELECT o_orderkey, greatest(1, least(30, coalesce(n * (o_orderkey % 9), 0))) AS d0, coalesce(n * (o_orderkey % 9), 0) AS raw, hotel, meal, way, fare, fuel, coalesce(rail, false) AS rail FROM orders LEFT JOIN l ON k = o_orderkey),
u AS (SELECT *, CAST(CASE WHEN raw = 0 THEN 2 ELSE d0 END AS INT) AS days, coalesce(hotel > 0, false) AS hh, coalesce(meal > 0, false) AS hm FROM t),
v AS (SELECT *, greatest(1, days - 1) AS nights, CAST(CASE WHEN hh THEN hotel ELSE 400 END AS DOUBLE) AS night, CAST(CASE WHEN hm THEN meal ELSE 60 END AS DOUBLE) AS bite FROM u),
w AS (SELECT *, night * nights AS stay, bite * 3 * days AS food FROM v)
SELECT o_orderkey, days, nights, stay + food AS total, '花销估算（人均，按 ' || days || ' 天 ' || nights || ' 晚计，来源逐项标注）：' || chr(10) || '- 交通：' ||
  CASE WHEN way = 'fly' THEN '机票价格随航司与购票时间浮动，请以航空公司/购票平台实际报价为准' WHEN (way = 'rail' OR way IS NULL AND rail) AND fare > 0 THEN '二等座约 ' || {_MONEY("fare")} || ' 元（单程人均）' WHEN way = 'rail' OR way IS NULL AND rail THEN '班次与票价请以 12306 官方为准'
    WHEN way = 'drive' AND fuel <> 0 THEN '油费约 ' || {_MONEY("fuel")} || ' 元（按高德全程距离与百公里油耗/油价估算，过路费与停车费另计）' WHEN way = 'drive' THEN '自驾费用请以地图导航与加油站实际为准' WHEN fare > 0 THEN '二等座约 ' || {_MONEY("fare")} || ' 元（单程人均）'
    WHEN fuel <> 0 THEN '油费约 ' || {_MONEY("fuel")} || ' 元（估算，过路费另计）' ELSE '交通费用请以 12306 / 航司 / 购票平台为准' END ||
  chr(10) || '- 住宿：人均约 ' || {_MONEY("night")} || ' 元/晚 × ' || nights || ' 晚 ≈ ' || {_MONEY("stay")} || ' 元' || CASE WHEN hh THEN '' ELSE '（预估：按默认单价×住宿晚数，实际以预订为准）' END ||
  chr(10) || '- 餐饮：人均约 ' || {_MONEY("bite")} || ' 元/餐 × 3 餐 × ' || days || ' 天 ≈ ' || {_MONEY("food")} || ' 元' || CASE WHEN hm THEN '（预估：当地人均单餐来自高德 POI）' ELSE '（预估：按默认单餐单价，实际以消费为准）' END ||
  chr(10) || '- 门票：各景区票价差异较大，请以景区实际收费为准' || chr(10) || '- 其他：购物、娱乐等按个人实际消费计算' || chr(10) || '合计（人均，不含门票与购物）：约 ' || {_MONEY("(stay + food)")} || ' 元' AS text FROM w""")
def budget_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates with transport, stay and meals, as users read them."""
    lines, orders, k = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), F.col("l_orderkey")
    units = lines.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_extendedprice").alias("most"), F.min("l_extendedprice").alias("least"), F.sum("l_quantity").alias("q"))
    trips = orders.join(units, orders.o_orderkey == units.l_orderkey, "left")
    days = F.coalesce((F.col("n") * (F.col("o_orderkey") % 9)).cast("int"), F.lit(0))
    hotel, meal = F.when(k % 3 != 0, F.floor(F.col("most") / 100).cast("double")), F.when(k % 5 != 0, F.floor(F.col("least") / 100) + 0.5)
    way = F.when(k % 4 == 0, "fly").when(k % 4 == 1, "rail").when(k % 4 == 2, "drive")
    fare, fuel = F.when(k % 7 != 0, F.floor("q").cast("double")), F.when(k % 11 != 0, F.floor(F.col("q") * 2).cast("double"))
    made = trips.select("o_orderkey", budgets.estimate(days, hotel, meal, way, F.lit("二等座"), fare, fuel, k % 8 == 3).alias("b"))
    return made.select("o_orderkey", "b.days", "b.nights", "b.total", "b.text")
