"""Column functions on coordinates, fares, dates and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

EARTH_M = 6_371_000


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres along the great circle."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def location(text: Column | str) -> Column:
    """``lng,lat`` as a struct; null parts where it is not two numbers."""
    parts = F.split(col(text), ",")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    good = (F.size(parts) == 2) & number(0).isNotNull() & number(1).isNotNull()
    return F.when(good, F.struct(number(0).alias("lng"), number(1).alias("lat")))


def minutes(duration: Column | str) -> Column:
    """``HH:MM``, hours beyond 24 included, as minutes; null where it does not parse."""
    d = col(duration)
    return F.when(d.rlike(r"^\d+:[0-5]\d$"), F.split(d, ":")[0].cast("int") * 60 + F.split(d, ":")[1].cast("int"))


def amount(text: Column | str) -> Column:
    """A number, null where it is none or not above 0."""
    x = col(text).try_cast("double")
    return F.when(x > 0, x)


def flight_hours(km: Column, speed: float = 750.0, extra: float = 0.5) -> Column:
    return km / speed + extra


def fuel_cost(km: Column, litres: float = 8.0, price: float = 7.8) -> Column:
    return F.bround(km / 100 * litres * price, 0)


def transport(specified: Column, km: Column, rail_hours: Column, drive_km: float = 300, fly_km: float = 1000, fly_hours: float = 8) -> Column:
    """The recommended way: as asked, else by distance and rail time; null without any figures."""
    asked = F.when(specified.isNotNull() & (specified != ""), specified)
    rule = F.when(km <= drive_km, "drive").when((rail_hours >= fly_hours) | (km >= fly_km), "fly").when(rail_hours.isNotNull(), "rail").when(km.isNotNull(), "drive")
    return F.coalesce(asked, rule)


def alternatives(way: Column, specified: Column, avoid: Column, km: Column, rail_hours: Column) -> Column:
    """Other ways for a recommendation that was not asked for, without the one to avoid."""
    none = F.array().cast("array<string>")
    rail = F.array(F.lit("rail"), F.lit("train"))
    near = F.when(rail_hours.isNotNull(), rail).otherwise(none)
    far = F.when(rail_hours.isNotNull(), rail).otherwise(F.array(F.lit("drive")))
    by_rail = F.when(km.isNotNull(), F.array(F.lit("train"), F.lit("drive"))).otherwise(F.array(F.lit("train")))
    base = F.when(specified.isNotNull() & (specified != ""), none).when((way == "drive") & (km <= 300), near).when(way == "fly", far).when(way == "rail", by_rail).otherwise(none)
    return F.filter(base, lambda x: (x != F.coalesce(avoid, F.lit(""))) & (x != way))


def travel_date(text: Column | str, today: Column) -> Column:
    """(date, assumed): the first that a question gives of a full date, a day of this year, a relative word, a day of next week, a weekday; else tomorrow, assumed."""
    t = col(text)
    year = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, m, d), "yyyy-M-d")
    part = lambda pattern, i: F.nullif(F.regexp_extract(t, pattern, i), F.lit(""))
    full, short = r"(\d{4})[-/年.](\d{1,2})[-/月.](\d{1,2})", r"(\d{1,2})月(\d{1,2})[日号]"
    explicit = year(part(full, 1), part(full, 2), part(full, 3))
    monthly = F.when(part(short, 1).isNotNull(), year(F.year(today).cast("string"), part(short, 1), part(short, 2)))
    word = F.when(t.contains("大后天"), 3).when(t.contains("后天"), 2).when(t.contains("明天"), 1).when(t.contains("今天"), 0)
    number = lambda c: F.instr(F.lit("一二三四五六日"), F.translate(c, "天", "日")) - 1
    monday = F.date_add(F.date_trunc("week", today).cast("date"), 7)
    of_next = r"下(?:周|星期|礼拜)([一二三四五六日天])"
    next_week = F.when(part(of_next, 1).isNotNull(), F.date_add(monday, number(part(of_next, 1)))).when(t.rlike("下(?:周|星期|礼拜)末"), F.date_add(monday, 5)).when(t.rlike("下(?:周|星期|礼拜)"), monday)
    plain = part(r"(?:周|星期|礼拜)([一二三四五六日天])", 1)
    ahead = F.pmod(number(plain) - F.weekday(today), F.lit(7))
    weekday = F.when(plain.isNotNull(), F.date_add(today, F.when(ahead == 0, 7).otherwise(ahead)))
    found = F.coalesce(explicit, monthly, F.date_add(today, word), next_week, weekday)
    return F.struct(F.coalesce(found, F.date_add(today, 1)).alias("date"), found.isNull().alias("assumed"))


def any_date(text: Column | str, today: Column) -> Column:
    """A date in one of the usual spellings, the year of ``today`` where it has none; null otherwise."""
    t = F.trim(col(text))
    tries = [F.try_to_date(t, p) for p in ("yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "yyyy年M月d日")]
    tries += [F.try_to_date(F.concat(F.year(today).cast("string"), F.lit("-"), t), f"yyyy-{p}") for p in ("M-d", "M/d", "M月d日")]
    return F.coalesce(*tries)


def days_wanted(text: Column | str, most: int = 30) -> Column:
    """A number of days from 1 to ``most`` in a text, in digits or one Chinese numeral; 0 otherwise."""
    t = F.trim(col(text))
    digits = F.regexp_extract(t, r"(\d+)", 1).try_cast("int")
    numeral = F.instr(F.lit("一二三四五六七八九十"), F.translate(F.regexp_extract(t, "([一二三四五六七八九十两])", 1), "两", "二"))
    n = F.coalesce(digits, F.when(F.regexp_extract(t, "([一二三四五六七八九十两])", 1) != "", numeral), F.lit(0))
    return F.when(n.between(1, most), n).otherwise(0)


def trip_request(city: Column, days: Column, start: Column, preferences: Column, budget: Column, today: Column) -> Column:
    """A request with defaults: three days from tomorrow; null without a city."""
    n = days_wanted(days)
    n = F.when(n == 0, 3).otherwise(n)
    first = F.coalesce(any_date(start, today), F.date_add(today, 1))
    likes = F.filter(F.split(F.trim(F.coalesce(preferences, F.lit(""))), r"[、,，/;；\s]+"), lambda p: p != "")
    made = F.struct(F.trim(city).alias("city"), n.alias("days"), first.alias("start"), F.date_add(first, n - 1).alias("end"), likes.alias("preferences"), F.regexp_extract(budget, r"(\d+)", 1).try_cast("int").alias("budget"))
    return F.when(F.trim(F.coalesce(city, F.lit(""))) != "", made)


def wind_text(direction: Column | str, power: Column | str) -> Column:
    """Direction and force as one text; the word for wind is not doubled."""
    d, p = (F.trim(F.coalesce(col(x), F.lit(""))) for x in (direction, power))
    named = F.when((d == "") | d.endswith("风"), d).otherwise(F.concat(d, F.lit("风")))
    return F.concat(named, F.when(p != "", F.concat(p, F.lit("级"))).otherwise(""))


def duration_text(duration: Column | str) -> Column:
    m = minutes(duration)
    return F.coalesce(F.concat(F.floor(m / 60).cast("string"), F.lit("小时"), (m % 60).cast("string"), F.lit("分")), F.lit(""))


def hours_text(hours: Column) -> Column:
    """Hours as hours and minutes, rounded to the minute; empty for null."""
    m = F.bround(hours * 60, 0).cast("int")
    h, rest = F.floor(m / 60), m % 60
    return F.when(hours.isNull(), "").when((h > 0) & (rest > 0), F.concat(h.cast("string"), F.lit("小时"), rest.cast("string"), F.lit("分钟"))).when(h > 0, F.concat(h.cast("string"), F.lit("小时"))).otherwise(F.concat(rest.cast("string"), F.lit("分钟")))


def distance_text(metres: Column) -> Column:
    m = F.coalesce(metres, F.lit(0.0))
    return F.when(m >= 1000, F.format_string("约 %.1f 公里", m / 1000)).otherwise(F.format_string("约 %d 米", m.cast("int")))


def fares_text(prices: Column | str) -> Column:
    """``map<seat, price>`` as text, in the order of the map; empty without prices."""
    lines = F.transform(F.map_entries(col(prices)), lambda e: F.concat(e["key"], F.lit(" "), e["value"], F.lit(" 元")))
    return F.coalesce(F.array_join(lines, " / "), F.lit(""))


def city_of_address(address: Column | str) -> Column:
    """The city in an address, without its suffix: after a province, at the start, or anywhere."""
    a = F.coalesce(col(address), F.lit(""))
    name = lambda p: F.nullif(F.regexp_extract(a, p, 1), F.lit(""))
    return F.coalesce(name("(?:省|自治区)([^省市区县]{1,8})市"), name("^([^省市区县]{1,8})市"), name("([^省市区县]{1,8})市"), F.lit(""))


def cities_in(text: Column | str, cities: list[str], alias: dict[str, list[str]] | None = None) -> Column:
    """Known cities that a text names, in the order of the list; an alias stands for its cities."""
    t = F.coalesce(col(text), F.lit(""))
    found = [F.when(t.contains(c), F.array(F.lit(c))) for c in cities] + [F.when(t.contains(a), F.array(*map(F.lit, own))) for a, own in (alias or {}).items()]
    return F.array_distinct(F.flatten(F.array_compact(F.array(*found))))


def in_regions(region: Column | str, cities: list[str], province: dict[str, str]) -> Column:
    """Whether a region text holds one of the cities or its province; true without cities."""
    words = list(dict.fromkeys(w for c in cities for w in (c, province.get(c)) if w))
    rule = F.lit(not words)
    for w in words:
        rule = rule | F.coalesce(col(region), F.lit("")).contains(w)
    return rule
