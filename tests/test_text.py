import random
import re

from pyspark.sql import functions as F

from lodestrata.functions import places, text


def value(spark, column, **inputs):
    df = spark.createDataFrame([tuple(inputs.values())], ", ".join(f"{k} string" for k in inputs)) if inputs else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_terms(spark):
    assert value(spark, text.terms("t"), t="The Cat sat on a MAT, x 42") == ["cat", "sat", "mat", "42"]
    assert value(spark, text.terms("t"), t="") == []
    assert value(spark, text.term_set("t"), t="西湖") == ["西湖"]
    assert value(spark, text.term_set("t"), t="! ?") == ["!?"]


def test_masks_follow_in_order(spark):
    t = "call 13812345678, card 6222020200112233445, id 11010519491231002X, a.b@c.example.org, 12.50 元"
    out, hits = text.masked("t", ("secret",))
    assert value(spark, out, t=t) == "call 〔手机号〕, card 〔银行卡号〕, id 〔身份证号〕, 〔邮箱〕, 〔金额〕"
    assert value(spark, hits["phone"], t=t) == 1
    assert value(spark, hits["dict_word"], t="secret secret") == 2
    assert value(spark, hits["phone"], t="2024-113812345678") == 0


def test_cleaning(spark):
    assert value(spark, text.newlines("t"), t="a\r\nb\rc") == "a\nb\nc"
    assert value(spark, text.clean_rewrite("t"), t='1. "where to go"') == "where to go"
    assert [value(spark, text.clean_rewrite("t"), t=t) for t in ("  - 《西湖》 ", "12、“怎么走” ", "3)x", "2024年", None, "a" * 120)] == ["西湖", "怎么走", "x", "2024年", "", "a" * 100]
    assert value(spark, text.clean_answer("t"), t="a 【1】 【第2块】  \n 【图片】 \n\n\n\nb [1]\u3000\n") == "a\n\nb [1]"
    assert value(spark, text.compact_blank_lines("t"), t="a\n\n\n\nb") == "a\n\nb"
    assert value(spark, text.sentences("t"), t="One. Two! 三。four\nfive") == ["One.", "Two!", "三。", "four", "five"]


def test_files_and_hosts(spark):
    assert [value(spark, text.route("p"), p=p) for p in ("a.md", "a.MD", "b.pdf", "c.XLSX", "d.Json", "e", "f.exe")] == ["markdown", "error", "pdf", "table", "text", "error", "error"]
    assert value(spark, text.host("u"), u="https://A.example.org/x?y=1") == "a.example.org"
    assert value(spark, text.host("u"), u="no url") == ""
    assert value(spark, text.host_allowed("h", ["*.example.org"]), h="example.org")
    assert not value(spark, text.host_allowed("h", ["*.example.org"]), h="badexample.org")


def test_keys(spark):
    import hashlib

    df = spark.createDataFrame([("a", None, "b")], "x string, y string, z string")
    assert df.select(text.cache_key("x", "y", "z")).first()[0] == hashlib.md5(b"a||b").hexdigest()
    assert value(spark, text.fingerprint("t"), t="abc") == hashlib.sha256(b"abc").hexdigest()[:8]
    long = "x" * 300_000
    assert value(spark, text.fingerprint("t"), t=long) == hashlib.sha256((long[:131072] + long[-131072:]).encode()).hexdigest()[:8]


def test_pictures(spark):
    t = "![a](x.png) ![b](y.jpg \"t\") ![a](x.png) https://e.org/p.JPG"
    assert value(spark, text.image_references("t"), t=t) == ["x.png", "y.jpg"]
    assert value(spark, text.image_urls("t"), t=t) == ["https://e.org/p.JPG"]


def test_numbers_and_places(spark):
    assert [value(spark, text.chinese_number("t"), t=t) for t in ("三", "十", "十二", "二十", "二十三", "两", "7", "x")] == [3, 10, 12, 20, 23, 2, 7, None]
    assert value(spark, text.place_tokens("t"), t="西安市") == ["西安市", "西安"]
    assert value(spark, text.place_tokens("t"), t="市") == []
    assert value(spark, text.place_tokens("t"), t="内蒙古自治区 呼和浩特市、市区，云龙镇") == ["内蒙古自治区", "内蒙古", "呼和浩特市", "呼和浩特", "市区", "云龙镇"]
    assert value(spark, places.location("t"), t="120.1,30.2") == (120.1, 30.2)
    assert value(spark, places.location("t"), t="120.1") is None
    assert [value(spark, places.minutes("t"), t=t) for t in ("01:30", "26:05", "--", "3:70")] == [90, 1565, None, None]


def test_distance(spark):
    d = value(spark, places.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    assert abs(d - 111194.93) < 1


def test_transport(spark):
    none = F.lit(None).cast("double")
    way = lambda asked, km, rail: value(spark, places.transport(F.lit(asked), km, rail))
    assert way("bus", F.lit(100.0), none) == "bus"
    assert way("", F.lit(300.0), F.lit(2.0)) == "drive"
    assert way("", F.lit(500.0), F.lit(8.0)) == "fly"
    assert way("", F.lit(500.0), F.lit(3.0)) == "rail"
    assert way("", none, none) is None
    out = places.alternatives(F.lit("fly"), F.lit(""), F.lit("train"), F.lit(1200.0), F.lit(9.0))
    assert value(spark, out) == ["rail"]


def test_model_json(spark):
    parsed = F.try_variant_get(text.json_object("t"), "$.a", "int")
    assert value(spark, parsed, t='```json\n{"a": 3}\n```') == 3
    assert value(spark, parsed, t="sorry") is None


def test_more_text_rules(spark):
    links = F.create_map(F.lit("a.png"), F.struct(F.lit("http://h/a.png").alias("url"), F.lit("a cat").alias("summary")))
    assert value(spark, text.replaced_images("t", links), t="x ![](a.png) ![b](b.png)") == "x ![a cat](http://h/a.png) ![b](b.png)"
    gate = lambda title, body: value(spark, text.has_material(F.lit(title), F.lit(body), F.array(F.lit("西湖"))))
    assert gate("西湖", "") and gate("", "西湖与西湖") and not gate("", "西湖") and not gate(None, None)
    ways = {"rail": "高铁|火车", "fly": "飞机"}
    assert [value(spark, text.preference("t", ways, "想坐|乘坐"), t=t) for t in ("我想坐飞机去", "飞机好吗，想坐高铁", "高铁", None)] == ["fly", "rail", None, None]


def test_parts_of_messages_are_masked_and_pictures_left(spark):
    rows = [([("text", "mail a@b.cn now"), ("image_url", "a@b.cn"), ("text", None)],), ([],), (None,)]
    df = spark.createDataFrame(rows, "parts array<struct<type:string,text:string>>")
    got = [r["m"] and [tuple(p) for p in r["m"]] for r in df.select(text.masked_parts("parts").alias("m")).collect()]
    assert got == [[("text", "mail 〔邮箱〕 now"), ("image_url", "a@b.cn"), ("text", None)], [], None]


def test_pictures_with_their_surroundings(spark):
    df = spark.createDataFrame([("abc ![x](p.png) def ![](q.jpg \"t\")",), ("none",), (None,)], "t string")
    got = df.select(text.image_contexts("t", 3).alias("i")).collect()
    assert [r["i"] and [tuple(x) for x in r["i"]] for r in got] == [[("p.png", "bc ", " de"), ("q.jpg", "ef ", "")], [], None]


def test_runs_that_come_again(spark):
    """As counting each in the whole text does, without going through the text for each."""
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choice("ab") for _ in range(rng.choice([2, 3, 4, 7]))) + rng.choice(["", "X", "9", "é"]) for _ in range(40)) for _ in range(60)] + ["abc xabcx", "abcabc abc", "abc ab", "aaa aaaaaa", ""]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    want = [sorted(w for w in set(re.findall("[a-z]{3,}", t)) if t.count(w) >= 2) for t in texts] + [None]
    assert [r["x"] for r in df.select(text.again("t", "[a-z]{3,}").alias("x")).collect()] == want
