"""Queries on what questions ask for: flags, classes, causes, date answers; and on what a plan needs around it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions import lexicon_values as V
from ..functions import routing as R
from ..operators import chunking, evaluation, mentions, planning, ranking
from ..sources.store import staged
from .registry import query, table
from .serving import _JUDGED, _judged

#: Questions in Chinese, which the given conversations lack; each comes after the one before it.
SENTENCES = (
    "你好", "谢谢啦", "杭州有哪些景点", "那门票多少钱", "华为手机拍照怎么样", "什么是猫娘", "帮我规划一下三天行程", "第一次去杭州，景点应该怎么安排？", "第一次从深圳去杭州，景点应该怎么安排？", "开车太累了，换成高铁",
    "三亚会下雨吗", "今天是几月几号", "现在几点", "几点出发去机场", "中秋节是几月几号", "清明节是几号", "国庆节是几号星期几", "大后天星期几，几点了", "昨天是几号", "那边天气怎么样", "再安排一天", "第三天改成灵隐寺",
    "我要去杭州，不是成都", "？", "什么意思？", "可以吗", "从机场到市区怎么走", "我在杭州东站，到市区怎么走", "我在杭州东站，到市区玩3天怎么安排", "算了", "没找到相关文档", "格式不对，JSON 坏了", "页面按钮没反应", "", "元宵节是哪天", "日期",
)
_SAID = f"SELECT * FROM (VALUES {', '.join(f'({i}, {i} - 1, ' + chr(39) + s + chr(39) + ')' for i, s in enumerate(SENTENCES))}) v(turn, before, text)"
_ALL = f"SELECT conv_id, turn, text FROM conversations UNION ALL SELECT -1, turn, text FROM ({_SAID})"


def _said(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(SENTENCES)), "turn long, text string")


def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _said(spark).select(F.lit(-1).cast("long").alias("conv_id"), "turn", "text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").union(said)


def _hit(name: str) -> str:
    return f"coalesce(regexp_matches(text, '{R.PATTERNS[name]}'), false)"


def _contains(words: tuple[str, ...], text: str = "lower(coalesce(text, ''))") -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


_FLAGS = ("follow_up", "knowledge", "off_domain", "plan", "weather", "transport_change", "tweak", "correction", "confusion", "deixis", "consult")
_DATE = f"({_hit('date_word')} AND NOT {_hit('activity')} AND ({_hit('date_anchor')} OR {_hit('clock')} OR {_hit('festival')}))"


@query(f"""SELECT conv_id, turn, {", ".join(f"{_hit(n)} AS is_{n}" for n in _FLAGS)}, {_hit("plan_word")} OR ({_hit("arrange")} AND {_hit("cross_city")}) AS plan_signal, {_DATE} AS date_question,
  {_hit("hub")} AND {_hit("downtown")} AND NOT {_hit("several_days")} AS transfer_question FROM ({_ALL})""")
def intent_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = [R.flag(n, "text").alias(f"is_{n}") for n in _FLAGS]
    return _all(spark, sf_dir).select("conv_id", "turn", *flags, R.plan_signal("text").alias("plan_signal"), R.date_question("text").alias("date_question"), R.transfer_question("text").alias("transfer_question"))


@query(f"""SELECT conv_id, turn, CASE WHEN {_contains(R.CHITCHAT)} THEN 'chitchat' WHEN {_contains(R.TOURISM)} THEN 'tourism' WHEN {_hit("off_domain")} THEN 'chitchat'
  WHEN {_hit("knowledge")} THEN 'tourism' WHEN {_hit("plan")} THEN 'tourism' ELSE '' END AS domain FROM ({_ALL})""")
def rule_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir).select("conv_id", "turn", R.rule_class("text").alias("domain"))


_CAUSES = " ".join(f"WHEN {_contains(words)} THEN '{name}'" for name, words in R.CAUSES.items())


@query(f"SELECT conv_id, turn, CASE {_CAUSES} ELSE 'data' END AS cause FROM ({_ALL})")
def failure_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir).select("conv_id", "turn", R.cause("text").alias("cause"))


@query(f"""WITH q AS (SELECT conv_id, turn, trim(coalesce(text, ''), ' ') AS q, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM ({_ALL}))
SELECT conv_id, turn, CASE WHEN q = '' THEN NULL WHEN {_contains(R.REWRITES, "q")} THEN 'rewrite' WHEN coalesce(p, '') <> '' AND {_contains(R.ABANDONS, "q")} THEN 'abandon'
  WHEN coalesce(p, '') <> '' AND length(q) <= {R.SHORT} AND substr(q, 1, 1) IN ({", ".join(f"'{w}'" for w in R.CONNECTORS)}) THEN 'follow_up' END AS feedback FROM q""")
def implicit_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return _all(spark, sf_dir).withColumn("before", before).select("conv_id", "turn", R.feedback("text", "before").alias("feedback"))


_NOW = "2026-09-11 08:05:00"
_WEEK = "[" + ", ".join(f"'{d}'" for d in R.WEEKDAYS) + "]"
_weekday = lambda d: f"{_WEEK}[isodow({d})]"
_offset = lambda i: "CASE " + " ".join(f"WHEN contains(q, '{w[0]}') THEN " + (str(w[1]) if i == 1 else f"'{w[2]}'") for w in R.OTHER_DAYS) + (" ELSE 0 END" if i == 1 else " ELSE '今天' END")
_monthday = lambda d: f"month({d}) || '月' || day({d}) || '日'"
_ask = lambda name: f"regexp_matches(q, '{R.ASKS[name]}')"


@query(f"""WITH s AS (SELECT conv_id, turn, text AS q, DATE '{_NOW[:10]}' AS d FROM ({_ALL})), t AS (SELECT *, d + CAST({_offset(1)} AS INT) AS g, {_offset(2)} AS a FROM s)
SELECT conv_id, turn, CASE WHEN contains(q, '清明') THEN '清明节是二十四节气之一，一般落在公历4月4日至6日之间（' || year(d) || '年具体日期以日历为准）。'
  {" ".join(f"WHEN contains(q, '{n}') THEN year(d) || '年{n}是{m}月{k}日，' || {_weekday(f'make_date(year(d), {m}, {k})')} || '。'" for n, m, k in sorted(R.FESTIVALS, key=lambda f: -len(f[0])))}
  {" ".join(f"WHEN contains(q, '{n}') THEN '{n}是农历{x}，' || year(d) || '年对应的公历日期请以日历为准。'" for n, x in sorted(R.LUNAR, key=lambda f: -len(f[0])))}
  ELSE coalesce(nullif(CASE WHEN {_ask("date")} THEN a || '是' || year(g) || '年' || {_monthday("g")} || CASE WHEN {_ask("weekday")} THEN '，' || {_weekday("g")} ELSE '' END || '。' WHEN {_ask("weekday")} THEN a || '是' || {_weekday("g")} || '。' ELSE '' END
    || CASE WHEN {_ask("clock")} THEN '现在是{_NOW[11:16]}。' ELSE '' END, ''), '今天是' || year(d) || '年' || {_monthday("d")} || '，' || {_weekday("d")} || '。') END AS answer FROM t""")
def date_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir).select("conv_id", "turn", R.date_answer("text", F.lit(_NOW).cast("timestamp")).alias("answer"))


@query(f"""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT CAST(d AS VARCHAR) AS day, strftime(d, '%Y-%m-%d') || ' ' || {_weekday("d")} || '；未来14天：' || array_to_string(list_transform(range(1, 15), lambda k:
  CASE WHEN k = 1 THEN '明天' WHEN k = 2 THEN '后天' WHEN k < 8 - isodow(d) THEN {_weekday("d + CAST(k AS INT)")} WHEN k < 15 - isodow(d) THEN '下' || {_weekday("d + CAST(k AS INT)")} ELSE '下下' || {_weekday("d + CAST(k AS INT)")} END
  || '=' || strftime(d + CAST(k AS INT), '%m-%d')), '，') AS days FROM d""")
def relative_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return days.select(F.col("d").cast("string").alias("day"), R.date_table(F.col("d")).alias("days"))


@query("""WITH e AS (SELECT l_orderkey AS plan_id, CASE l_linenumber % 4 WHEN 0 THEN 'transport' WHEN 1 THEN 'attractions' WHEN 2 THEN 'hotels' ELSE 'meals' END AS kind, CASE WHEN l_partkey % 9 = 0 THEN 0.0 ELSE l_extendedprice END AS cost FROM lineitem),
s AS (SELECT plan_id, coalesce(sum(cost) FILTER (kind = 'attractions'), 0) AS attractions, coalesce(sum(cost) FILTER (kind = 'hotels'), 0) AS hotels, coalesce(sum(cost) FILTER (kind = 'meals'), 0) AS meals, coalesce(sum(cost) FILTER (kind = 'transport'), 0) AS transport FROM e GROUP BY plan_id)
SELECT plan_id, round(attractions, 2) AS attractions, round(hotels, 2) AS hotels, round(meals, 2) AS meals, round(transport, 2) AS transport, round(attractions + hotels + meals + transport, 2) AS total FROM s""")
def trip_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the entries of a plan, some with a price that is no number."""
    n = F.col("l_linenumber") % 4
    kind = F.when(n == 0, "transport").when(n == 1, "attractions").when(n == 2, "hotels").otherwise("meals")
    cost = F.when(F.col("l_partkey") % 9 == 0, "free").otherwise(F.col("l_extendedprice").cast("string"))
    made = planning.trip_budget(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("plan_id"), kind.alias("kind"), cost.alias("cost")))
    return made.select("plan_id", *(F.round(c, 2).alias(c) for c in made.columns[1:]))


@query("""WITH p AS (SELECT c_custkey AS id, c_nationkey || ',' || c_custkey % 50 AS location FROM customer), d AS (SELECT s_nationkey || ',' || s_suppkey % 50 AS origin, arg_max(s_acctbal, s_suppkey) AS distance_m, arg_max(s_suppkey, s_suppkey) AS duration_s FROM supplier GROUP BY 1)
SELECT id, location, round(distance_m, 2) AS distance_m, coalesce(duration_s, -1) AS duration_s FROM p LEFT JOIN d ON location = origin""")
def place_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance rows found by their origin; places without one stay."""
    at = lambda a, b: F.concat_ws(",", F.col(a).cast("string"), (F.col(b) % 50).cast("string"))
    pois = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), at("c_nationkey", "c_custkey").alias("location"))
    rows = table(spark, sf_dir, "supplier").select(at("s_nationkey", "s_suppkey").alias("origin"), F.col("s_acctbal").alias("distance_m"), F.col("s_suppkey").alias("duration_s"), F.col("s_suppkey").alias("place"))
    return planning.with_distances(pois, rows, keep=True).withColumns({"distance_m": F.round("distance_m", 2), "duration_s": F.coalesce("duration_s", F.lit(-1))})


@query("""WITH a AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN '市区' WHEN 1 THEN '' WHEN 2 THEN c_mktsegment ELSE n_name END AS destination, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE r_name END AS city, 10.0 + c_custkey % 60 AS lat, 60.0 + c_custkey % 90 AS lng FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
p AS (SELECT n_name AS place, CAST(n_nationkey AS DOUBLE) AS lat, CAST(n_regionkey AS DOUBLE) AS lng FROM nation WHERE n_nationkey % 2 = 0), b AS (SELECT n_name AS place, -1.0 AS lat, -1.0 AS lng FROM nation UNION ALL SELECT r_name, CAST(r_regionkey AS DOUBLE), 0.0 FROM region),
j AS (SELECT a.*, CASE WHEN p.place IS NOT NULL THEN 1 WHEN b.place IS NOT NULL THEN 2 WHEN c.place IS NOT NULL THEN 3 WHEN lat_ok THEN 4 END AS way, p.lat AS plat, p.lng AS plng, b.lat AS blat, b.lng AS blng, c.lat AS clat, c.lng AS clng
  FROM (SELECT *, lat BETWEEN 15 AND 55 AND lng BETWEEN 70 AND 140 AS lat_ok FROM a) a LEFT JOIN p ON destination = p.place LEFT JOIN b ON destination = b.place LEFT JOIN b c ON city = c.place)
SELECT id, coalesce(nullif(destination, ''), city) AS name, CASE way WHEN 1 THEN plat WHEN 2 THEN blat WHEN 3 THEN clat ELSE lat END AS latitude, CASE way WHEN 1 THEN plng WHEN 2 THEN blng WHEN 3 THEN clng ELSE lng END AS longitude, CASE way WHEN 1 THEN 'primary' WHEN 4 THEN 'fallback' ELSE 'backup' END AS loc_source FROM j WHERE way IS NOT NULL""")
def location_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    k = F.col("c_custkey")
    asked = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        k.alias("id"), F.when(k % 5 == 0, "市区").when(k % 5 == 1, "").when(k % 5 == 2, F.col("c_mktsegment")).otherwise(F.col("n_name")).alias("destination"), F.when(k % 3 == 0, "").otherwise(F.col("r_name")).alias("city"),
        (F.lit(10.0) + k % 60).alias("latitude"), (F.lit(60.0) + k % 90).alias("longitude"),
    )
    primary = nation.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("place"), F.col("n_nationkey").cast("double").alias("latitude"), F.col("n_regionkey").cast("double").alias("longitude"))
    backup = nation.select(F.col("n_name").alias("place"), F.lit(-1.0).alias("latitude"), F.lit(-1.0).alias("longitude")).union(region.select("r_name", F.col("r_regionkey").cast("double"), F.lit(0.0)))
    return planning.located(asked, primary, backup)


@query("""SELECT p_partkey FROM part WHERE trim(p_name) <> '' AND (p_size % 3 = 0 OR p_size % 5 = 0)""")
def usable_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.when(F.col("p_size") % 3 == 0, "1,2").otherwise(" ").alias("location"), F.when(F.col("p_size") % 5 == 0, "street").alias("address"))
    return planning.usable(rows).select("p_partkey")


@query("""WITH l AS (SELECT o_custkey AS query_id, o_orderkey AS id FROM orders WHERE o_orderstatus = 'F'), w AS (SELECT o_custkey AS query_id, o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F')
SELECT query_id, id, 'local' AS kind FROM l UNION ALL SELECT query_id, id, 'web' FROM w WHERE query_id % 2 <> 0 OR query_id NOT IN (SELECT query_id FROM l)""")
def plan_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans, here the even questions, take web candidates only where they have no local ones."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "local").otherwise("web").alias("kind"))
    return ranking.candidates(rows.where("kind = 'local'"), rows.where("kind = 'web'"), F.col("query_id") % 2 == 0)


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'nearby' WHEN 'purchase' THEN 'related' END AS relation FROM events""")
def relation_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", mentions.relation_key("event_type", {"click": "nearby", "purchase": "related"}).alias("relation"))


@query("""SELECT doc_id FROM documents WHERE lang = 'fr' OR source IN ('src1', 'src2')""")
def regression_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "documents").select("doc_id", F.array("lang", "source").alias("tags"))
    return evaluation.regression_cases(cases, ["fr"], impact="sources", impacts={"sources": ["src1", "src2"]}).select("doc_id")


@query("""WITH w AS (SELECT doc_id, lang, list_distinct(regexp_extract_all(lower(text), '[a-z]{6,}')) AS found FROM documents), g AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{6,}')) AS gold FROM benchmark),
h AS (SELECT lang, found, gold, len(list_intersect(found, gold)) AS hits FROM w JOIN g ON doc_id = item_id),
m AS (SELECT lang, CAST(hits > 0 AS INT) AS hit, round(CASE WHEN len(found) + len(gold) = 0 THEN 0 ELSE 2 * hits / (len(found) + len(gold)) END, 4) AS f1, round(CASE WHEN len(found) = 0 THEN 0 ELSE hits / len(found) END, 4) AS precision, round(CASE WHEN len(gold) = 0 THEN 0 ELSE hits / len(gold) END, 4) AS recall FROM h)
SELECT lang, count(*) AS cases, round(avg(precision), 3) AS precision, round(avg(recall), 3) AS recall, round(avg(f1), 3) AS f1, round(avg(hit), 3) AS hit, round(avg(hit), 3) AS acc_micro FROM m GROUP BY lang""")
def macro_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    long_words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z]{6,})"), F.lit(1)))
    found = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", long_words("text").alias("found"))
    gold = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), long_words("text").alias("gold"))
    both = staged(found.join(gold, "id"), "judged")
    means = evaluation.macro(evaluation.retrieval_metrics(both).join(both.select("id", "lang"), "id"), ["lang"])
    return means.select("lang", "cases", *(F.round(c, 3).alias(c) for c in means.columns[2:]))


@query(f"""WITH {_JUDGED}, c AS (SELECT lang, count(*) FILTER (expected AND accept) AS tp, count(*) FILTER (NOT expected AND accept) AS fp, count(*) FILTER (accept IS NULL) AS open FROM j GROUP BY lang),
r AS (SELECT 3 + row_number() OVER (ORDER BY lang) AS line, '| ' || lang || ' | ' || tp || ' | ' || fp || ' | ' || open || ' |' AS text FROM c)
SELECT * FROM r UNION ALL SELECT * FROM (VALUES (0, '# verdicts'), (1, ''), (2, '| lang | tp | fp | open |'), (3, '|---|---|---|---|')) v(line, text)""")
def metrics_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = evaluation.confusion(_judged(spark, sf_dir), ["lang"]).select("lang", "tp", "fp", F.col("unresolved").alias("open"))
    return evaluation.report(counts, "verdicts")


@query("""WITH a AS (SELECT n_nationkey AS attraction_id, n_name AS name, r_name AS city, 10.0 + n_nationkey AS lng FROM nation JOIN region ON r_regionkey = n_regionkey),
p AS (SELECT s_suppkey AS poi_id, CASE s_suppkey % 3 WHEN 0 THEN n_name || ' ' || s_name WHEN 1 THEN substr(n_name, 1, 4) ELSE s_name END AS name, r_name AS city FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)
SELECT attraction_id, min(poi_id) AS poi_id FROM a JOIN p ON a.city = p.city AND (contains(a.name, p.name) OR contains(p.name, a.name)) GROUP BY attraction_id""")
def places_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first POI of an attraction's city whose name contains the other's; none lies near."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    homes = nation.join(region, F.col("r_regionkey") == F.col("n_regionkey"))
    a = homes.select(F.col("n_nationkey").alias("attraction_id"), F.col("n_name").alias("name"), F.col("r_name").alias("city"), (F.lit(10.0) + F.col("n_nationkey")).alias("lng"), F.lit(20.0).alias("lat"))
    k = F.col("s_suppkey")
    name = F.when(k % 3 == 0, F.concat_ws(" ", "n_name", "s_name")).when(k % 3 == 1, F.substring("n_name", 1, 4)).otherwise(F.col("s_name"))
    p = table(spark, sf_dir, "supplier").join(homes, F.col("s_nationkey") == F.col("n_nationkey")).select(k.alias("poi_id"), k.alias("poi_rank"), name.alias("name"), F.col("r_name").alias("city"), F.lit(-120.0).alias("lng"), F.lit(-50.0).alias("lat"))
    return planning.nearest_match(a, p)


@query("""WITH h AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
SELECT conv_id AS doc_id, substr(string_agg('[' || role || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY n), 1, 400) AS context FROM h WHERE n <= 5 GROUP BY conv_id""")
def chunk_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents of many chunks: the first five, cut at 400 characters."""
    chunks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("part"), F.col("role").alias("title"), F.col("text").alias("content"))
    return chunking.context(chunks, first=5, most=400)


#: Sentences of plans, which the given conversations lack.
_PLANS = ("上午：前往鼓浪屿需乘轮渡", "游览西湖，参观灵隐寺附近", "前往周边的轮渡码头", "打卡环岛路骑行或散步，登上雷峰塔等", "漫步 Old Town 2, 抵达", "游玩交通与市内行程", "帮我订一间酒店", "能代订门票吗", "我想订票", "")
_EVERY = f"SELECT conv_id, turn, text FROM conversations UNION ALL SELECT -2, turn, text FROM (VALUES {', '.join(f'({i}, {chr(39)}{s}{chr(39)})' for i, s in enumerate(_PLANS))}) v(turn, text)"
_CUT = "".join("\\" + c if c in "[]()?/~" else c for c in V.CLAUSE_ENDS)


@query(rf"""WITH s AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM ({_EVERY})), r AS (SELECT conv_id, turn, t, regexp_extract_all(t, '{V.PLACE_AFTER}', 1) AS raw FROM s),
b AS (SELECT conv_id, turn, t, list_distinct(list_filter(list_transform(raw, lambda x: trim(regexp_replace(regexp_replace(trim(x), '^(..[^{_CUT}]*)[{_CUT}].*$', '\1'), '{V.PLACE_TAIL}', ''))), lambda n: length(n) BETWEEN 2 AND 10 AND regexp_matches(n, '[\x{{4e00}}-\x{{9fa5}}]') AND NOT regexp_matches(n, '{V.NOT_A_PLACE}'))) AS places FROM r)
SELECT conv_id, turn, array_to_string(list_sort(places), ',') AS places, regexp_matches(t, '{V.BOOKING}') AS booking FROM b""".replace("\\\\", "\\"))
def places_and_bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places that sentences say one goes to, and whether they ask to book something."""
    said = spark.createDataFrame(list(enumerate(_PLANS)), "turn long, text string").select(F.lit(-2).cast("long").alias("conv_id"), "turn", "text")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").union(said)
    return rows.select("conv_id", "turn", F.array_join(F.array_sort(lexicon.places_in("text")), ",").alias("places"), lexicon.booking("text").alias("booking"))
