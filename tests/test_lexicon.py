"""Rules of the place lexicon, mentions through an automaton, and what they fill."""

import random

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import lexicon
from lodestrata.operators import mentions


def each(spark, f, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", f("t").alias("x")).orderBy("i").collect()
    return [r["x"] for r in rows]


def test_valid_terms(spark):
    no = ["", None, "西", "abcdefg", "2024年", "3号线", "abc", "杭州", "四川", "北京", "四川成都", "甘肃敦煌", "东线", "商圈", "市区", "怎么去", "怎么玩", "值得吗", "适合谁", "元数据", "攻略", "住宿", "打卡", "古城", "海边", "周边", "九寨沟"]
    no += ["千塔之城", "永恒之城", "音乐之都", "光之城", "北方威尼斯", "沙溪古镇"]
    yes = ["西湖", "灵隐", "鼓浪屿", "曾厝垵", "武陵源", "蜈支洲岛", "宽窄巷子", "张掖丹霞地貌", "乌镇", "宏村"]
    assert each(spark, lexicon.valid_term, no) == [False] * len(no) and each(spark, lexicon.valid_term, yes) == [True] * len(yes)
    assert each(spark, lexicon.admin_name, ["九寨沟", "四川阿坝", "四川成都", "四川", "中国", "西湖", None]) == [True, False, True, True, True, False, False]


def test_normalised_terms(spark):
    given = ["龙井方向", "灵隐周边", "  西湖  ", "｜鼓浪屿｜", "龙井片区", "灵隐一带", "鼓浪屿所在", "“西湖”", "周边", "大周边", "西湖沿线", "西湖周边附近", "- 西湖", ""]
    assert each(spark, lexicon.normalised, given) == ["龙井", "灵隐", "西湖", "鼓浪屿", "龙井", "灵隐", "鼓浪屿", "西湖", "周边", "大周边", "西湖沿线", "西湖周边", "西湖", ""]


def test_topics_and_headings(spark):
    text = "- 主题：西湖、灵隐\n## 灵隐\n## 注意事项\n"
    assert each(spark, lexicon.topic_terms, [text, None]) == [["西湖", "灵隐"], []]
    assert each(spark, lexicon.heading_terms, [text, "# 西湖\n##西湖 和 断桥\n####### 宏村"]) == [["灵隐"], ["西湖", "断桥", "宏村"]]


def test_lexicon_of_sources(spark):
    doc = "- 主题：西湖、灵隐\n西湖很大，灵隐寺香火旺盛，梵净山也值得去。\n## 西湖\n## 梵净山\n## 永恒之城\n西湖与灵隐相隔不远。\n"
    made = lambda texts, extra=None: {r["term"] for r in mentions.place_lexicon(spark.createDataFrame([(t,) for t in texts], "text string"), extra and spark.createDataFrame([(t,) for t in extra], "term string")).collect()}
    assert made([doc]) == {"西湖", "灵隐", "梵净山"}
    assert made(["## 只出现一次\n正文没有提到它。\n", None, ""]) == set()
    assert made(["- 主题：西湖\n西湖很好，西湖很美。\n"], ["九寨沟", "沙溪古镇", "四川阿坝", "3号", "abc", None]) == {"九寨沟", "四川阿坝", "西湖"}


def test_places_of_chunks(spark):
    rows = [("景点信息", None, "九寨沟", "九寨沟"), ("景点信息", None, "沙溪古镇", "沙溪古镇景点介绍"), ("景点信息", "峨眉山", "x", "x"), ("酒店信息", None, "西湖", "杭州住宿推荐"), (None, "y", "z", None)]
    chunks = spark.createDataFrame(rows, "content_type string, attraction_name string, item_name string, file_title string")
    assert {r["term"] for r in mentions.harvested_places(chunks).collect()} == {"沙溪古镇", "峨眉山"}


def test_clauses_and_places(spark):
    given = ["鼓浪屿需乘轮渡", "环岛路骑行或散步", "鼓浪屿的轮渡信息", "周边的轮渡码头", "可可托海", "，西湖", "西湖", ""]
    assert each(spark, lexicon.truncated_at_clause, given) == ["鼓浪屿", "环岛路", "鼓浪屿", "周边", "可可托海", "，西湖", "西湖", ""]
    names = ["周边的轮渡码头", "鼓浪屿的轮渡信息", "环岛路骑行或散步", "交通与市内行程", "这是一个非常长的描述性片段文字", "湖", None, "西溪湿地", "曾厝垵", "鼓浪屿风景名胜区", "中山路步行街"]
    assert each(spark, lexicon.place_like, names) == [False] * 7 + [True] * 4
    assert each(spark, lexicon.places_in, ["上午：前往鼓浪屿需乘轮渡", "游览西湖，参观西湖，打卡断桥附近", "前往周边的轮渡码头", None]) == [["鼓浪屿"], ["西湖", "断桥"], [], []]


def test_bookings(spark):
    assert each(spark, lexicon.booking, ["帮我订一间酒店", "替我买下门票", "帮我看看酒店", "能代订吗", "我想订票", None]) == [True, True, False, True, False, False]


def test_backfill_plan_and_coverage(spark):
    rows = [
        ("c1", "酒店信息", "湖滨住宿 住在湖滨，步行可到西湖和灵隐。", {}), ("c2", " 酒店信息 ", "西湖边 西湖边上的酒店。", {"nearby_attractions": ["西湖"]}), ("c3", "景点信息", "西湖十景 西湖十景。", {}), ("c4", "美食推荐", "西湖醋鱼", None),
        ("c5", "游记攻略", "没有景点名。", None), ("c6", "游记攻略", "西湖", {"attractions": []}),
    ]
    chunks = spark.createDataFrame(rows, "doc_id string, content_type string, text string, relations map<string,array<string>>")
    plan = mentions.backfill_plan(chunks, spark.createDataFrame([("西湖",), ("灵隐",)], "term string"))
    assert sorted(map(tuple, plan.collect())) == [("c1", "酒店信息", "nearby_attractions", ["西湖", "灵隐"]), ("c6", "游记攻略", "attractions", ["西湖"])]
    filled = chunks.join(plan.select("doc_id", "key", "terms"), "doc_id", "left").withColumn("relations", F.when(F.col("key").isNotNull(), F.create_map("key", "terms")).otherwise(F.col("relations")))
    assert mentions.backfill_plan(filled.select(chunks.columns), spark.createDataFrame([("西湖",), ("灵隐",)], "term string")).count() == 0
    got = {r["content_type"].strip() + str(len(r["content_type"])): tuple(r)[1:] for r in mentions.backfill_coverage(chunks, plan).collect()}
    assert got == {"酒店信息4": (1, 0, 1, 1.0), "酒店信息6": (1, 1, 0, 0.0), "景点信息4": (1, 0, 0, 0.0), "美食推荐4": (1, 0, 0, 0.0), "游记攻略4": (2, 0, 1, 0.5)}


@pytest.mark.parametrize("shard", [1 << 20, 40])
def test_mentions_equal_brute_force(spark, shard):
    """One automaton, and a lexicon in shards."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abé西😀") for _ in range(rng.choice([1, 2, 2, 3, 4])))
    terms = {word() for _ in range(60)}
    texts = {i: "".join(rng.choice("abé西😀 \n") for _ in range(rng.choice([0, 3, 20, 200]))) for i in range(80)}
    for maximal in (True, False):
        expected = {}
        for i, t in texts.items():
            hits = {x for x in terms if x in t}
            kept = [x for x in hits if not (maximal and any(x != y and x in y for y in hits))]
            if kept:
                expected[i] = sorted(kept, key=lambda x: (t.find(x), x))
        docs = spark.createDataFrame([*texts.items(), (99, None)], "doc_id long, text string").repartition(3)
        lex = spark.createDataFrame([(t,) for t in [*terms, "", *terms]] + [(None,)], "term string")
        assert {r["doc_id"]: r["terms"] for r in mentions.mentions(docs, lex, maximal, shard).collect()} == expected
    assert mentions.mentions(docs, lex.limit(0)).count() == 0 and mentions.mentions(docs.limit(0), lex).count() == 0
