"""Queries on the smaller rules: texts of answers and questions, names of places, pictures in texts, dates, units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import places as P
from ..functions import text as T
from ..operators import itinerary
from ..sources import store
from .registry import query, table


@query(r"""SELECT doc_id, md5(replace(replace(replace(replace(text, ', ', chr(13) || chr(10)), '. ', chr(13)), chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS text_md5 FROM documents""")
def normalised_newlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = F.replace(F.replace("text", F.lit(", "), F.lit("\r\n")), F.lit(". "), F.lit("\r"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.newlines(mixed)).alias("text_md5"))


@query(r"""WITH x AS (SELECT conv_id, turn, replace(replace(text, ', ', ' 【第' || turn || '块】【3】, '), '. ', '.  ' || chr(10) || ' 【图片】 ' || chr(10) || chr(10) || chr(10) || chr(10)) || ' 【2】' AS x FROM conversations),
a AS (SELECT conv_id, turn, regexp_replace(regexp_replace(x, '(?:\s*【(?:第[0-9]+块|[0-9]+)】)+', '', 'g'), '(?m)^\s*【?图片】?\s*$', '', 'g') AS x FROM x)
SELECT conv_id, turn, trim(regexp_replace(regexp_replace(x, '(?m)[ \t\r]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(10) || ' ' || chr(9) || chr(13)) AS answer FROM a""")
def clean_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = F.replace("text", F.lit(", "), F.concat(F.lit(" 【第"), F.col("turn").cast("string"), F.lit("块】【3】, ")))
    x = F.concat(F.replace(cited, F.lit(". "), F.lit(".  \n 【图片】 \n\n\n\n")), F.lit(" 【2】"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.clean_answer(x).alias("answer"))


@query("""SELECT conv_id, turn, substr(trim(replace(text, chr(10), ' '), ' "'), 1, 100) AS question FROM conversations WHERE text IS NOT NULL""")
def clean_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    n = F.col("turn") % 3
    noisy = F.concat(F.when(n == 0, F.concat(F.lit(" "), F.col("turn").cast("string"), F.lit(". “"))).when(n == 1, " - 《").otherwise("\t\""), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("》” "))
    return rows.select("conv_id", "turn", T.clean_rewrite(noisy).alias("question"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice >= 1000 THEN printf('约 %.1f 公里', floor(o_totalprice / 100) / 10) ELSE '约 ' || CAST(floor(o_totalprice / 100) * 100 AS INT) || ' 米' END AS distance,
  CASE WHEN o_orderkey % 240 >= 60 AND o_orderkey % 60 > 0 THEN o_orderkey % 240 // 60 || '小时' || o_orderkey % 60 || '分钟' WHEN o_orderkey % 240 >= 60 THEN o_orderkey % 240 // 60 || '小时' ELSE o_orderkey % 60 || '分钟' END AS hours,
  o_orderkey % 30 || '小时' || o_orderkey % 60 || '分' AS duration, CASE o_orderkey % 4 WHEN 0 THEN '北风3级' WHEN 1 THEN '北风3级' WHEN 2 THEN '3级' ELSE '北风' END AS wind FROM orders""")
def unit_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances, hours, durations and winds as users read them."""
    k, n = F.col("o_orderkey"), F.col("o_orderkey") % 4
    metres = F.floor(F.col("o_totalprice") / 100).cast("double") * 100
    clock = F.concat((k % 30).cast("string"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"))
    wind = P.wind_text(F.when(n == 0, "北").when(n == 1, " 北风").when(n == 2, "").otherwise("北"), F.when(n < 3, "3 "))
    return table(spark, sf_dir, "orders").select("o_orderkey", P.distance_text(metres).alias("distance"), P.hours_text((k % 240) / 60).alias("hours"), P.duration_text(clock).alias("duration"), wind.alias("wind"))


@query("""WITH x AS (SELECT n_nationkey AS k, replace(n_name, 'NATION_', '国') AS n, replace(r_name, ' ', '') AS r FROM nation JOIN region ON r_regionkey = n_regionkey)
SELECT k AS n_nationkey, list_filter(CASE k % 4 WHEN 0 THEN [n || '市', n, r] WHEN 1 THEN [n || '自治区', n, r] WHEN 2 THEN [n || '县', n, '某盟旗', '某', r] ELSE ['市区', r] END, lambda t: length(t) >= 2) AS tokens, CASE WHEN k % 3 < 2 THEN n ELSE '' END AS city FROM x""")
def place_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of names, and cities in addresses."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    rows = rows.withColumns({"n_name": F.replace("n_name", F.lit("NATION_"), F.lit("国")), "r_name": F.replace("r_name", F.lit(" "), F.lit(""))})
    k, name = F.col("n_nationkey"), F.col("n_name")
    raw = F.when(k % 4 == 0, F.concat(name, F.lit("市"))).when(k % 4 == 1, F.concat(name, F.lit("自治区"))).when(k % 4 == 2, F.concat(name, F.lit("县，某盟旗 x"))).otherwise("市区")
    address = F.when(k % 3 == 0, F.concat(F.lit("某省"), name, F.lit("市武侯区1号"))).when(k % 3 == 1, F.concat(name, F.lit("市朝阳区"))).otherwise("")
    return rows.select("n_nationkey", T.place_tokens(raw, "r_name").alias("tokens"), P.city_of_address(address).alias("city"))


@query("""SELECT l_orderkey, l_linenumber, 1 + (l_orderkey * 7 + l_linenumber) % 99 AS n FROM lineitem""")
def chinese_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers up to 99 written in characters, and read."""
    n = 1 + (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 99
    digit = lambda d: F.substr(F.lit("一二三四五六七八九"), d.cast("int"), F.lit(1))
    tens, ones = F.floor(n / 10), n % 10
    written = F.concat(F.when(tens > 1, digit(tens)).otherwise(""), F.when(tens > 0, "十").otherwise(""), F.when(ones > 0, digit(ones)).otherwise(""))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.chinese_number(written).cast("long").alias("n"))


@query("""SELECT doc_id, 'img_' || doc_id || '.png' AS target, right(text, 100) AS before, left(text, 100) AS after, text || '![' || source || '](http://h/' || doc_id || '.png)' || text AS replaced FROM documents WHERE NOT contains(text, '![') AND text <> ''""")
def picture_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A picture between two copies of each text: what stands around it, and the text with its summary and link."""
    docs = table(spark, sf_dir, "documents").where("NOT contains(text, '![') AND text <> ''")
    target = F.concat(F.lit("img_"), F.col("doc_id").cast("string"), F.lit(".png"))
    rows = docs.withColumn("target", target).withColumn("md", F.concat("text", F.lit("![x](images/"), "target", F.lit(")"), "text"))
    seen = F.get(T.image_contexts("md"), F.lit(0))
    links = F.create_map(F.concat(F.lit("images/"), F.col("target")), F.struct(F.concat(F.lit("http://h/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("url"), F.col("source").alias("summary")))
    return rows.select("doc_id", F.replace(seen["target"], F.lit("images/"), F.lit("")).alias("target"), seen["before"].alias("before"), seen["after"].alias("after"), T.replaced_images("md", links).alias("replaced"))


@query("""SELECT doc_id, contains(source, '1') OR (length(text) - length(replace(text, 'tion', ''))) / 4 >= 2 AS about FROM documents""")
def material_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents about a thing: in the title, or twice in the text."""
    docs = table(spark, sf_dir, "documents")
    one = T.has_material(F.lit(""), "text", F.array(F.lit("tion")))
    return docs.select("doc_id", (T.has_material("source", F.lit(""), F.array(F.lit("1"))) | one).alias("about"))


@query("""WITH e AS (SELECT event_id, CAST(ts AS DATE) AS d FROM events), w AS (SELECT *, isodow(d) AS wd FROM e)
SELECT event_id, CAST(CASE event_id % 7 WHEN 0 THEN d + 1 WHEN 1 THEN d + 2 WHEN 2 THEN d WHEN 3 THEN d - (wd - 1)::INT + 7 + 2 WHEN 4 THEN d + (CASE WHEN (5 - wd + 7) % 7 = 0 THEN 7 ELSE (5 - wd + 7) % 7 END)::INT WHEN 5 THEN make_date(2024, 3, 5) ELSE d + 1 END AS VARCHAR) AS day, event_id % 7 = 6 AS assumed FROM w""")
def travel_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that questions name, seen from the day of an event."""
    asked = F.array(*map(F.lit, ("明天去", "后天出发", "今天", "下周三走", "周五吧", "2024年3月5日", "去玩")))
    rows = table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("d"), F.get(asked, (F.col("event_id") % 7).cast("int")).alias("q"))
    found = rows.select("event_id", P.travel_date("q", F.col("d")).alias("t"))
    return found.select("event_id", F.col("t.date").cast("string").alias("day"), F.col("t.assumed").alias("assumed"))


@query("""SELECT o_orderkey, part, CASE WHEN o_orderkey % 2 = 0 THEN '第' || part || '天' ELSE '行程' END AS label FROM (SELECT o_orderkey, unnest(CASE WHEN o_orderkey % 2 = 0 THEN range(1, 2 + o_orderkey % 5) ELSE [1] END) AS part FROM orders)""")
def itinerary_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans cut at their days, or whole without any."""
    k = F.col("o_orderkey")
    days = F.array_join(F.transform(F.sequence(F.lit(1), (1 + k % 5).cast("int")), lambda d: F.concat(F.when(d % 2 == 0, F.concat(F.lit("Day "), d.cast("string"))).otherwise(F.concat(F.lit("第"), d.cast("string"), F.lit("天"))), F.lit("：去湖边\n"))), "")
    texts = table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 2 == 0, F.concat(F.lit("计划\n"), days)).otherwise("随便走走").alias("text"))
    return itinerary.day_parts(texts).select(F.col("id").alias("o_orderkey"), F.col("part").cast("long").alias("part"), "label")


@query("""WITH a AS (SELECT source AS file, count(*) AS chunks FROM documents GROUP BY 1), b AS (SELECT 'src' || turn AS file, count(*) AS entities FROM conversations GROUP BY 1)
SELECT coalesce(a.file, b.file) AS file, coalesce(chunks, 0) AS chunks, coalesce(entities, 0) AS entities FROM a FULL JOIN b ON a.file = b.file""")
def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each file in both tables."""
    chunks = table(spark, sf_dir, "documents").select(F.col("source").alias("file"))
    entities = table(spark, sf_dir, "conversations").select(F.concat(F.lit("src"), F.col("turn").cast("string")).alias("file"))
    return store.listing(chunks, entities, "file")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN n_name WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE n_name END AS region FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def regions_backfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty regions filled from the nation; others stay."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    rows = rows.withColumn("region", F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 1, F.col("c_mktsegment")))
    return store.backfilled(rows, "region", F.col("n_name")).select("c_custkey", "region")
