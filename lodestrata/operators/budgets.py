"""The budget estimate of a trip, item by item."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days without any, meals a day, prices without any.
DAYS, MEALS, MEAL, HOTEL = 2, 3, 60.0, 400.0


def money(amount: Column) -> Column:
    """An amount without decimals if it is nearly whole, else with one."""
    return F.when(F.abs(amount - F.round(amount)) < 0.05, F.format_string("%.0f", amount)).otherwise(F.format_string("%.1f", amount))


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _item(name: str, text: Column, source: Column | str, estimated: Column | bool, amount: Column | None = None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(name).alias("name"), text.alias("text"), (F.lit(None).cast("double") if amount is None else amount).alias("amount"), lit(source).alias("source"), lit(estimated).alias("estimated"))


def _transport(way: Column, seat: Column, fare: Column, fuel: Column, rail: Column) -> Column:
    """What the way there costs: a real fare by rail, an estimate of fuel by car, nothing by air; without a way, what there is."""
    by_rail = _text(seat, "约 ", money(fare), " 元（单程人均）")
    drive = _text("油费约 ", money(fuel), " 元（按高德全程距离与百公里油耗/油价估算，过路费与停车费另计）")
    rule = lambda text, source, estimated: F.struct(text.alias("text"), F.lit(source).alias("source"), F.lit(estimated).alias("estimated"))
    lit = F.lit
    has_fare, has_fuel = F.coalesce(fare > 0, lit(False)), F.coalesce(fuel != 0, lit(False))
    train = way.isin("rail", "train") | (way.isNull() & F.coalesce(rail, lit(False)))
    return (
        F.when(way == "fly", rule(lit("机票价格随航司与购票时间浮动，请以航空公司/购票平台实际报价为准"), "需自行查询", False))
        .when(train & has_fare, rule(by_rail, "12306 真实票价", False)).when(train, rule(lit("班次与票价请以 12306 官方为准"), "无数据", False))
        .when((way == "drive") & has_fuel, rule(drive, "高德距离 + 代码估算油费", True)).when(way == "drive", rule(lit("自驾费用请以地图导航与加油站实际为准"), "无数据", False))
        .when(has_fare, rule(by_rail, "12306 真实票价", False)).when(has_fuel, rule(_text("油费约 ", money(fuel), " 元（估算，过路费另计）"), "高德距离 + 代码估算油费", True))
        .otherwise(rule(lit("交通费用请以 12306 / 航司 / 购票平台为准"), "无数据", False))
    )


def estimate(days: Column, hotel: Column, meal: Column, way: Column, seat: Column, fare: Column, fuel: Column, rail: Column) -> Column:
    """``days, nights, items, total, text`` of a trip; ``items`` have ``name, text, amount, source, estimated``.

    ``hotel`` and ``meal`` are median prices or null, ``way`` the recommended
    one or null, ``seat`` and ``fare`` the cheapest by rail, ``rail`` whether
    rail answered. Days run from 1 to 30, nights are one less but one at least;
    the total counts stay and meals.
    """
    n = F.greatest(F.lit(1), F.least(F.lit(30), F.coalesce(F.nullif(days, F.lit(0)), F.lit(DAYS))))
    nights = F.greatest(F.lit(1), n - 1)
    has_hotel, has_meal = F.coalesce(hotel > 0, F.lit(False)), F.coalesce(meal > 0, F.lit(False))
    night, bite = F.when(has_hotel, hotel).otherwise(F.lit(HOTEL)), F.when(has_meal, meal).otherwise(F.lit(MEAL))
    stay, food = night * nights, bite * MEALS * n
    stay_text = _text("人均约 ", money(night), " 元/晚 × ", nights.cast("string"), " 晚 ≈ ", money(stay), " 元", F.when(has_hotel, "").otherwise("（预估：按默认单价×住宿晚数，实际以预订为准）"))
    food_text = _text("人均约 ", money(bite), f" 元/餐 × {MEALS} 餐 × ", n.cast("string"), " 天 ≈ ", money(food), " 元", F.when(has_meal, "（预估：当地人均单餐来自高德 POI）").otherwise("（预估：按默认单餐单价，实际以消费为准）"))
    travel = _transport(way, seat, fare, fuel, rail)
    items = F.array(
        _item("交通", travel["text"], travel["source"], travel["estimated"]),
        _item("住宿", stay_text, F.when(has_hotel, "高德酒店人均价").otherwise("预估（无高德房价数据）"), ~has_hotel, stay),
        _item("餐饮", food_text, F.when(has_meal, "高德餐饮人均 × 预估公式").otherwise("预估（无高德餐饮人均）"), True, food),
        _item("门票", F.lit("各景区票价差异较大，请以景区实际收费为准"), "无数据", False),
        _item("其他", F.lit("购物、娱乐等按个人实际消费计算"), "无数据", False),
    )
    head = _text("花销估算（人均，按 ", n.cast("string"), " 天 ", nights.cast("string"), " 晚计，来源逐项标注）：")
    lines = F.array_join(F.transform(items, lambda i: _text("- ", i["name"], "：", i["text"])), "\n")
    text = _text(head, "\n", lines, "\n合计（人均，不含门票与购物）：约 ", money(stay + food), " 元")
    return F.struct(n.alias("days"), nights.alias("nights"), items.alias("items"), (stay + food).alias("total"), text.alias("text"))
