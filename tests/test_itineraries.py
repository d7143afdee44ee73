from pyspark.sql import functions as F

from lodestrata.functions import places
from lodestrata.operators import itinerary


def value(spark, column, t=None):
    return spark.createDataFrame([(t,)], "t string").select(column.alias("x")).first()["x"]


def test_travel_date(spark):
    today = F.lit("2024-05-10").cast("date")  # a Friday
    day = lambda t: tuple(map(str, value(spark, places.travel_date("t", today), t)))
    assert day("出发 2024-6-1") == ("2024-06-01", "False")
    assert day("2024年6月2日走") == ("2024-06-02", "False")
    assert day("3月2日走") == ("2024-03-02", "False")
    assert day("大后天") == ("2024-05-13", "False")
    assert day("下周三去") == ("2024-05-15", "False")
    assert day("下周末去") == ("2024-05-18", "False")
    assert day("下周去") == ("2024-05-13", "False")
    assert day("周五去") == ("2024-05-17", "False")
    assert day("星期天去") == ("2024-05-12", "False")
    assert day("随便") == ("2024-05-11", "True")


def test_requests(spark):
    today = F.lit("2024-05-10").cast("date")
    assert [str(value(spark, places.any_date("t", today), t)) for t in ("2024/6/1", "2024年6月1日", "6-1", "6月1日", "x", None)] == ["2024-06-01"] * 2 + ["2024-06-01"] * 2 + ["None"] * 2
    assert [value(spark, places.days_wanted("t"), t) for t in ("5天", "三天", "两日", "31", "x", None)] == [5, 3, 2, 0, 0, 0]
    none = F.lit(None).cast("string")
    r = value(spark, places.trip_request(F.lit("西安"), F.lit("2"), none, F.lit("美食、历史"), F.lit("3000元"), today))
    assert (r["city"], r["days"], str(r["start"]), str(r["end"]), r["preferences"], r["budget"]) == ("西安", 2, "2024-05-11", "2024-05-12", ["美食", "历史"], 3000)
    assert value(spark, places.trip_request(none, none, none, none, none, today)) is None


def test_words_for_figures(spark):
    assert [value(spark, places.wind_text(F.lit(d), F.lit(p))) for d, p in (("北", "1-3"), ("北风", "4"), ("", "5"), ("东", ""), (None, None))] == ["北风1-3级", "北风4级", "5级", "东风", ""]
    assert [value(spark, places.duration_text("t"), t) for t in ("07:58", "25:54", "x", None)] == ["7小时58分", "25小时54分", "", ""]
    assert [value(spark, places.hours_text(F.lit(h).cast("double"))) for h in (19.13, 2.0, 0.5, None)] == ["19小时8分钟", "2小时", "30分钟", ""]
    assert [value(spark, places.distance_text(F.lit(m).cast("double"))) for m in (1540.0, 999.0, None)] == ["约 1.5 公里", "约 999 米", "约 0 米"]
    assert value(spark, places.fares_text(F.create_map(F.lit("二等座"), F.lit("813.5"), F.lit("一等座"), F.lit("1281.5")))) == "二等座 813.5 元 / 一等座 1281.5 元"


def test_cities(spark):
    assert [value(spark, places.city_of_address("t"), t) for t in ("四川省成都市武侯区", "北京市海淀区", "某路南宁市", "无", None)] == ["成都", "北京", "某路南宁", "", ""]
    assert value(spark, places.cities_in("t", ["西安", "成都", "潮州"], {"潮汕": ["潮州", "汕头"]}), "成都到西安再到潮汕") == ["西安", "成都", "潮州", "汕头"]
    assert value(spark, places.in_regions("t", ["三亚"], {"三亚": "海南"}), "海南省") and not value(spark, places.in_regions("t", ["三亚"], {}), "海南省")
    assert value(spark, places.in_regions("t", [], {}), None)


def test_day_parts(spark):
    rows = spark.createDataFrame([(1, "概览\n第一天 西湖\n第十二天 灵隐"), (2, "Day 1 a Day 2 b"), (3, "no days")], "id long, text string")
    got = [(r["id"], r["label"], r["body"].strip()) for r in itinerary.day_parts(rows).orderBy("id", "part").collect()]
    assert got == [(1, "第1天", "第一天 西湖"), (1, "第12天", "第十二天 灵隐"), (2, "第1天", "Day 1 a"), (2, "第2天", "Day 2 b"), (3, "行程", "no days")]


def test_codes_and_spacing(spark):
    assert value(spark, itinerary.keep_codes("t", F.array(F.lit("G123"))), "乘 G123 或 CA1234 (MU55) 到达") == "乘 G123 或 到达"
    assert value(spark, itinerary.compact("t"), "a  \n\nb\n\n## c\n\n\nd") == "a\nb\n\n## c\nd"


def test_structure(spark):
    plans = spark.createDataFrame([(1, 2, 2), (2, 2, 2), (3, 1, 2)], "plan_id long, travel_days int, least int")
    days = spark.createDataFrame([(1, 0, 3, ""), (1, 1, 1, "慢节奏"), (2, 0, 1, ""), (2, 1, 2, "")], "plan_id long, day int, attractions int, description string")
    assert sorted(tuple(r)[:4] for r in itinerary.structure(plans, days).collect()) == [(1, True, 0, 1), (2, False, 1, 0), (3, False, 0, 0)]


def test_releases(spark):
    states = ["proposed", "approved", "regression_passed", "approved", "gray_released", "rolled_back", "approved"]
    steps = spark.createDataFrame([(1, i, s) for i, s in enumerate(states)], "proposal_id long, n int, state string")
    assert [r["valid"] for r in itinerary.releases(steps).orderBy("n").collect()] == [True, False, True, True, True, True, False]
    gated = spark.createDataFrame([(0.9, 0.8), (0.7, 0.8), (None, 0.8)], "accuracy double, baseline double")
    assert [r["state"] for r in itinerary.gate(gated).collect()] == ["regression_passed", "rejected", "rejected"]


def test_slots_and_refreshes(spark):
    flags = F.create_map(F.lit("city"), F.lit(True), F.lit("days"), F.lit(False))
    assert value(spark, itinerary.missing_slots(flags, ["city", "days", "origin"])) == ["days", "origin"]
    at = lambda rows, schema: spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp"))
    versions = at([(1, "2024-01-01 00:00:00"), (2, "2024-01-02 12:00:00")], "version long, ts string")
    checks = at([("a", "2024-01-01 01:00:00"), ("a", "2024-01-02 01:00:00"), ("a", "2024-01-03 01:00:00"), ("b", "2024-01-03 01:00:00")], "client string, ts string")
    got = itinerary.refreshed(checks, versions).orderBy("client", "ts").collect()
    assert [(r["seen"], r["refresh"]) for r in got] == [(1, False), (1, False), (2, True), (2, False)]


def test_map_points_and_markdown(spark):
    points = spark.createDataFrame([(1, 0, 1, "a", 1.0, 2.0), (1, 0, 0, "b", None, 2.0), (1, 1, 0, "", 1.0, 1.0)], "plan_id long, day int, place int, name string, lng double, lat double")
    assert [(r["plan_id"], r["day"], [p["name"] for p in r["points"]]) for r in itinerary.map_points(points).collect()] == [(1, 0, ["a"])]
    days = spark.createDataFrame([(1, 0, "2024-01-01", 1, "y"), (1, 0, "2024-01-01", 0, "x"), (1, 1, "2024-01-02", 0, "z")], "plan_id long, day int, date string, place int, item string")
    assert itinerary.plan_markdown(days).first()["markdown"] == "## 第1天 2024-01-01\n\n- x\n- y\n\n## 第2天 2024-01-02\n\n- z"


def test_days_are_cut_at_dates_where_there_are_no_titles(spark):
    from lodestrata.operators import itinerary

    day = lambda d: f"2026-09-{d} " + "go here and there, " * 3
    rows = [(1, "trip 2026-09-11→2026-09-13\n" + day(11) + day(12) + day(13)), (2, "no date at all"), (3, None), (4, "intro 第一天 a 2026-09-11 第2天 b"), (5, "2026-09-11→2026-09-12")]
    got = {}
    for r in itinerary.day_parts(spark.createDataFrame(rows, "id int, text string")).orderBy("id", "part").collect():
        got.setdefault(r["id"], []).append((r["part"], r["label"], r["body"]))
    assert got[1] == [(1, "2026-09-11", day(11)), (2, "2026-09-12", day(12)), (3, "2026-09-13", day(13))]
    assert got[2] == [(1, "行程", "no date at all")] and got[3] == [(1, "行程", "")]
    assert got[4] == [(1, "第1天", "第一天 a 2026-09-11 "), (2, "第2天", "第2天 b")]
    assert got[5] == [(1, "2026-09-12", "2026-09-12")]


def test_points_of_one_price_keep_the_order_of_the_table(spark, tmp_path):
    from lodestrata.plans import itineraries

    lines = [(1, 1, 5.0, part) for part in (31, 9, 22, 17, 3, 1)] + [(1, 2, 1.0, 2)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_extendedprice double, l_partkey long").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert [tuple(r) for r in itineraries.plan_map_points(spark, str(tmp_path)).select("plan_id", "day", "points").collect()] == [(1, 1, "31,9,22,17,3")]
