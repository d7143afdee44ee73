"""Queries on plans as documents: orders as plans, line items as their entries, events as checks and steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import places
from ..operators import itinerary
from .registry import query, table


@query("""WITH e AS (SELECT l_orderkey AS plan_id, l_linenumber - 1 AS day, l_extendedprice AS place, 'part ' || l_partkey AS item, CAST(o_orderdate AS DATE) + CAST(l_linenumber - 1 AS INT) AS date FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
d AS (SELECT plan_id, day, '## 第' || (day + 1) || '天 ' || date || chr(10) || chr(10) || string_agg('- ' || item, chr(10) ORDER BY place, item) AS t FROM e GROUP BY plan_id, day, date)
SELECT plan_id, string_agg(t, chr(10) || chr(10) ORDER BY day, t) AS markdown FROM d GROUP BY plan_id""")
def plan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("l_orderkey").alias("plan_id"), (F.col("l_linenumber") - 1).cast("int").alias("day"), F.date_add(F.to_date("o_orderdate"), (F.col("l_linenumber") - 1).cast("int")).alias("date"), F.col("l_extendedprice").alias("place"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("item"),
    )
    return itinerary.plan_markdown(rows)


@query("""WITH d AS (SELECT l_orderkey AS plan_id, l_linenumber AS day, count(*) AS attractions, CASE WHEN min(l_partkey) % 3 = 0 THEN '慢节奏的一天' ELSE '' END AS description FROM lineitem GROUP BY 1, 2),
p AS (SELECT o_orderkey AS plan_id, CAST(o_orderkey % 5 + 1 AS INT) AS travel_days FROM orders),
j AS (SELECT p.plan_id, travel_days, day, attractions, attractions < 2 AS short, contains(description, '慢节奏') AS relaxed FROM p LEFT JOIN d ON d.plan_id = p.plan_id),
c AS (SELECT plan_id, travel_days, count(day) AS n, count(*) FILTER (short AND NOT relaxed) AS shortage, count(*) FILTER (short AND relaxed) AS relaxed, coalesce(min(attractions), -1) AS fewest FROM j GROUP BY plan_id, travel_days)
SELECT plan_id, n = travel_days AND shortage = 0 AS ok, shortage, relaxed, fewest FROM c""")
def plan_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("day")).agg(F.count("*").alias("attractions"), F.when(F.min("l_partkey") % 3 == 0, "慢节奏的一天").otherwise("").alias("description"))
    plans = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("plan_id"), (F.col("o_orderkey") % 5 + 1).cast("int").alias("travel_days"), F.lit(2).alias("least"))
    return itinerary.structure(plans, days).withColumn("fewest", F.coalesce("fewest", F.lit(-1)))


@query("""WITH a AS (SELECT l_orderkey AS plan_id, l_linenumber AS day, p_name AS name, CASE WHEN l_partkey % 4 <> 0 THEN 1.0 END AS lng FROM lineitem JOIN part ON p_partkey = l_partkey),
k AS (SELECT DISTINCT p_name AS name FROM part WHERE p_size % 2 = 0)
SELECT plan_id, day, count(*) AS total, count(k.name) AS verified, count(*) FILTER (lng IS NULL) AS missing FROM a LEFT JOIN k ON a.name = k.name GROUP BY plan_id, day""")
def places_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    rows = lines.join(part, lines.l_partkey == part.p_partkey).select(F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("day"), F.col("p_name").alias("name"), F.when(F.col("l_partkey") % 4 != 0, 1.0).alias("lng"))
    found = part.where("p_size % 2 = 0").select(F.col("p_name").alias("name"), F.concat(F.lit("the "), F.col("p_name")).alias("poi_name"))
    return itinerary.verified(rows, found)


@query("""WITH g AS (SELECT l_orderkey AS plan_id, l_linenumber AS day, l_extendedprice AS place, l_partkey AS k FROM lineitem WHERE l_partkey % 4 <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY day, place) AS n FROM g)
SELECT plan_id, day, string_agg(k, ',' ORDER BY place) AS points FROM n WHERE n <= 5 GROUP BY plan_id, day""")
def plan_map_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of one price follow in the order of the table; the SQL leaves their order open."""
    place = F.struct("l_extendedprice", "_metadata.file_path", "_metadata.row_index")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("day"), place.alias("place"), F.col("l_partkey").cast("string").alias("name"), F.when(F.col("l_partkey") % 4 != 0, 1.0).alias("lng"), F.lit(1.0).alias("lat"))
    return itinerary.map_points(rows, 5).withColumn("points", F.array_join(F.transform("points", lambda p: p["name"]), ","))


@query(None)
def proposal_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state machine folded over each user's events; checked on a small fixture."""
    states = F.create_map(*(x for i, s in enumerate(itinerary.FOLLOWS) for x in (F.lit(i), F.lit(s))))
    steps = table(spark, sf_dir, "events").select(F.col("user_id").alias("proposal_id"), F.col("event_id").alias("n"), F.try_element_at(states, (F.col("event_id") % 6).cast("int")).alias("state"))
    return itinerary.releases(steps)


@query("""WITH v AS (SELECT event_id AS version, ts FROM events WHERE event_type = 'purchase'), c AS (SELECT CAST(user_id AS VARCHAR) AS client, ts FROM events WHERE event_type = 'click'),
s AS (SELECT client, ts, (SELECT max(version) FROM v WHERE v.ts <= c.ts) AS seen FROM c),
l AS (SELECT client, ts, coalesce(seen, -1) AS seen, coalesce(lag(seen) OVER w, -1) AS before, row_number() OVER w AS n FROM s WINDOW w AS (PARTITION BY client ORDER BY ts))
SELECT client, epoch_us(ts) AS at_us, seen, n > 1 AND seen > before AS refresh FROM l""")
def version_refreshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    versions = events.where("event_type = 'purchase'").select(F.col("event_id").alias("version"), "ts")
    checks = events.where("event_type = 'click'").select(F.col("user_id").cast("string").alias("client"), "ts")
    return itinerary.refreshed(checks, versions).select("client", F.unix_micros("ts").alias("at_us"), F.coalesce("seen", F.lit(-1)).alias("seen"), "refresh")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS city, CASE WHEN c_custkey % 40 BETWEEN 1 AND 30 THEN CAST(c_custkey % 40 AS INT) ELSE 3 END AS days, CAST(DATE '2024-05-11' + CASE WHEN c_custkey % 40 BETWEEN 1 AND 30 THEN CAST(c_custkey % 40 AS INT) - 1 ELSE 2 END AS VARCHAR) AS last_day FROM customer WHERE c_custkey % 7 <> 0""")
def trip_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    none, today = F.lit(None).cast("string"), F.lit("2024-05-10").cast("date")
    city = F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment"))
    days = F.concat((F.col("c_custkey") % 40).cast("string"), F.lit(" days"))
    made = table(spark, sf_dir, "customer").select("c_custkey", places.trip_request(city, days, none, none, none, today).alias("r")).where("r is not null")
    return made.select("c_custkey", "r.city", "r.days", F.col("r.end").cast("string").alias("last_day"))


@query("""SELECT n_nationkey, r_name, n_name, contains(r_name || n_name, 'ASIA') OR contains(r_name || n_name, 'CHINA') OR contains(r_name || n_name, 'FRANCE') OR contains(r_name || n_name, 'EUROPE') AS kept FROM nation JOIN region ON n_regionkey = r_regionkey""")
def region_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cities and their provinces as a filter on a region text."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
    kept = places.in_regions(F.concat("r_name", "n_name"), ["CHINA", "FRANCE"], {"CHINA": "ASIA", "FRANCE": "EUROPE"})
    return rows.select("n_nationkey", "r_name", "n_name", kept.alias("kept"))
