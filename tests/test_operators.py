import pytest
from pyspark.sql import functions as F

from lodestrata.operators import chunking, evaluation, history, mentions, operations, planning, ranking, retrieval


def test_sections(spark):
    docs = spark.createDataFrame([(1, "intro\n# A\nx\n```\n# no\n```\n## B\n# C"), (2, "plain\ntext"), (3, "")], "doc_id long, text string")
    got = [tuple(r) for r in chunking.sections(docs).orderBy("doc_id", "part").collect()]
    assert got == [(1, 1, "# A", "# A\nx\n```\n# no\n```"), (1, 3, "# C", "# C"), (2, 0, "default", "plain\ntext"), (3, 0, "default", "")]


def test_long_sections_are_split_and_short_ones_merged(spark):
    body = "A" * 700 + "\n" + "B" * 500
    chunks = [(1, 1, "## F", "## F\n\n" + body), (1, 2, "## G", "## G\nshort"), (2, 1, "## H", "## H\n\n" + "A" * 1200), (3, 1, "t" * 1000, "t" * 1000 + "x"), (4, 1, None, "A" * 700 + " " + "B" * 700), (5, 1, "e", None)]
    split = chunking.split_long(spark.createDataFrame(chunks, "doc_id long, part int, title string, content string"), 1000)
    rows = split.orderBy("doc_id", "part", "sub").collect()
    first = [r for r in rows if r["doc_id"] == 1]
    assert [len(r["content"]) <= 1000 for r in first] == [True] * 3
    assert "\n".join(r["content"].removeprefix("## F\n\n") for r in first[:2]) == body
    assert first[0]["title"] == "## F-1" and first[0]["parent_title"] == "## F"
    assert [(r["title"], r["content"]) for r in rows if r["doc_id"] in (2, 3)] == [("## H-1", "## H\n\n" + "A" * 1200), ("t" * 1000, "t" * 1000 + "x")]
    assert [(r["title"], len(r["content"])) for r in rows if r["doc_id"] == 4] == [("chunk-1", 700), ("chunk-2", 700)]
    assert [r["content"] for r in rows if r["doc_id"] == 5] == [None]
    merged = chunking.merge_short(split.where("doc_id = 1"), 600, 1000).orderBy("part").collect()
    assert [r["parent_title"] for r in merged] == ["## F", "## F", "## G"]
    close = spark.createDataFrame([(1, 1, 0, "a", "p", "one"), (1, 1, 1, "b", "p", "p two"), (1, 2, 0, "c", "q", "three")], "doc_id long, part int, sub int, title string, parent_title string, content string")
    assert [r["content"] for r in chunking.merge_short(close).orderBy("part").collect()] == ["one\n\ntwo", "three"]


def test_split_text_prefers_earlier_separators():
    assert chunking.split_text("aa bb. cc dd", 7) == ["aa bb", ". cc dd"]
    assert chunking.split_text("x" * 25, 10) == ["x" * 25]  # a run without a separator stays whole
    assert chunking.split_text("a" * 1200 + "\n\nbb", 1000) == ["a" * 1200, "bb"]
    assert chunking.split_text("aa. bb. " + "c" * 9 + ". dd", 7) == ["aa. bb", ".", "c" * 9, ". dd"]
    assert chunking.split_text("  ", 10) == []


def test_table_chunks(spark):
    rows = spark.createDataFrame([(1, "兵马俑", "5A"), (2, "", None), (3, "西湖", "")], "i int, name string, level string")
    assert [tuple(r) for r in chunking.table_chunks(rows, ["name", "level"], ["i"]).collect()] == [(1, "name: 兵马俑\nlevel: 5A", "sheet1-1"), (3, "name: 西湖", "sheet1-3")]


def test_json_sections(spark):
    df = spark.createDataFrame([('{"b": 1, "a": "x"}',), ("not json",)], "t string")
    assert [r[0] for r in df.select(chunking.json_sections(F.col("t"), F.lit("T"))).collect()] == ["# T\n\n## b\n\n1\n\n## a\n\nx", ""]


def test_fusion_keeps_first_seen_on_ties(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, doc_id long, rank int")
    b = spark.createDataFrame([(1, 12, 1), (1, 11, 2)], "query_id long, doc_id long, rank int")
    assert [r["doc_id"] for r in retrieval.rrf([a, b]).orderBy("rank").collect()] == [11, 10, 12]


def test_bm25_of_nothing(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "beta"), (2, "the of"), (3, None)], "query_id long, text string")
    got = retrieval.bm25(docs, queries).collect()
    assert [(r["query_id"], r["doc_id"]) for r in got] == [(1, 1)]
    assert retrieval.bm25(docs.limit(0), queries).count() == 0


def test_dense(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(7)] + [(99, None)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(i, [1.0, float(-i)]) for i in range(5)], "query_id long, embedding array<float>")
    got = retrieval.dense(v, q, 2).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(i, r, 7 - r) for i in range(5) for r in (1, 2)]
    assert retrieval.dense(v, q.limit(0), 2).count() == 0


def test_cliff(spark):
    rows = spark.createDataFrame([(1, i + 1, s) for i, s in enumerate([9.0, 8.5, 3.0, 2.9])], "query_id long, rank int, score double")
    assert ranking.cliff_cut(rows).count() == 2
    assert ranking.cliff_cut(rows.where("rank > 2")).count() == 2


def test_quota(spark):
    kinds = ["web", "local", "web", "web", "web", "local", "local"]
    full = spark.createDataFrame([(1, i + 1, i + 1, k) for i, k in enumerate(kinds)], "query_id long, doc_id long, rank int, kind string")
    assert [r["doc_id"] for r in ranking.quota(full.where("rank <= 5"), full).orderBy("rank").collect()] == [1, 2, 3, 7, 6]


def test_condense(spark):
    rows = spark.createDataFrame([(1, "alpha", "Nothing here. The alpha sentence. More words follow. The end of it."), (2, "x", "short")], "id long, question string, text string")
    got = {r["id"]: r["condensed"] for r in ranking.condense(rows, 25).collect()}
    assert got == {1: "Nothing The alpha sentence.", 2: "short"} or got[1].find("The alpha sentence.") >= 0 and len(got[1]) <= 25
    assert len(got[1]) <= 25


def messages(spark, n):
    return spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(n)], "conv_id long, turn int, role string, text string")


@pytest.mark.parametrize("n,middle,tail", [(12, "m4\nm5", "\n".join(f"m{i}" for i in range(6, 12))), (10, "", "\n".join(f"m{i}" for i in range(4, 10))), (8, "", "\n".join(f"m{i}" for i in range(4, 8)))])
def test_history_compression(spark, n, middle, tail):
    r = history.compress(messages(spark, n)).first()
    assert (r["head"], r["middle"], r["tail"]) == ("m0\nm1\nm2\nm3", middle, tail)


def test_sessions_without_user(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "hello"), (1, 1, "assistant", "bye")], "conv_id long, turn int, role string, text string")
    assert history.sessions(df).first().asDict() == {"conv_id": 1, "message_count": 2, "last_turn": 1, "title": "bye", "preview": "bye"}


def test_mentions(spark):
    lex = spark.createDataFrame([("West Lake",), ("Lake",), ("Temple",)], "term string")
    docs = spark.createDataFrame([(1, "Temple, then West Lake and West Lake"), (2, "nothing"), (3, None)], "doc_id long, text string")
    assert [tuple(r) for r in mentions.mentions(docs, lex).collect()] == [(1, ["Temple", "West Lake"])]
    assert sorted(mentions.mentions(docs, lex, maximal=False).first()["terms"]) == ["Lake", "Temple", "West Lake"]


def test_mentions_inside_longer_runs(spark):
    lex = spark.createDataFrame([("西湖",), ("灵隐",), ("塔",), ("(new)",), ("😀x",), ("lake",)], "term string")
    docs = spark.createDataFrame([(1, "灵隐之后去西湖"), (2, "西湖 西湖 西湖"), (3, "雷峰塔 (new)\na😀x"), (4, "northlakes"), (5, ""), (6, "湖西")], "doc_id long, text string")
    got = {r["doc_id"]: r["terms"] for r in mentions.mentions(docs, lex).collect()}
    assert got == {1: ["灵隐", "西湖"], 2: ["西湖"], 3: ["塔", "(new)", "😀x"], 4: ["lake"]}


def test_backfill_is_idempotent(spark):
    chunks = spark.createDataFrame([(1, []), (2, ["kept"]), (3, None)], "doc_id long, near array<string>")
    found = spark.createDataFrame([(1, ["a"]), (2, ["b"])], "doc_id long, terms array<string>")
    once = mentions.backfill(chunks, found, "near")
    twice = mentions.backfill(once, found, "near")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, ["a"]), (2, ["kept"]), (3, [])]


def test_confusion_and_flips(spark):
    rows = spark.createDataFrame([(True, True), (False, True), (True, False), (False, False), (True, None)], "expected boolean, accept boolean")
    r = evaluation.confusion(rows).first()
    assert (r["accuracy"], r["precision"], r["recall"], r["f1"], r["unresolved"]) == (0.5, 0.5, 0.5, 0.5, 1)
    base = spark.createDataFrame([(1, True), (2, False), (3, None), (4, True)], "id int, accept boolean")
    new = spark.createDataFrame([(1, False), (2, True), (3, None), (5, True)], "id int, accept boolean")
    assert sorted(map(tuple, evaluation.flips(base, new).collect())) == [(1, "regressed"), (2, "improved"), (3, "same"), (4, "only_base"), (5, "only_new")]


def test_limits_skip_what_was_rejected(spark):
    rows = spark.createDataFrame([(i, "u", "s", f"2024-01-01 00:00:0{i // 4}") for i in range(8)], "request_id long, user_id string, source string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = operations.fixed_windows(rows, (("second", "user_id", "second", 2), ("day", "user_id", "day", 3)))
    assert [r["rejected_by"] for r in got.orderBy("request_id").collect()] == [None, None, "second", "second", None, "day", "second", "second"]


def test_budget(spark):
    df = spark.createDataFrame([(200.0, None, 3), (None, None, 1), (100.0, 20.0, 90)], "h double, m double, d int")
    got = [tuple(r["b"]) for r in df.select(planning.budget(F.col("h"), F.col("m"), F.col("d")).alias("b")).collect()]
    assert got == [(3, 400.0, 450.0, 850.0), (1, 300.0, 150.0, 450.0), (30, 2900.0, 1800.0, 4700.0)]


def test_nearest_match_by_name_or_place(spark):
    a = spark.createDataFrame([(1, "Lake", "x", 120.0, 30.0), (2, "Far", "x", 10.0, 10.0), (3, "Spot", "y", 120.001, 30.001)], "attraction_id long, name string, city string, lng double, lat double")
    p = spark.createDataFrame([(7, 1, "West Lake", "x", 50.0, 50.0), (8, 2, "Any", "z", 120.002, 30.002)], "poi_id long, poi_rank int, name string, city string, lng double, lat double")
    assert sorted(map(tuple, planning.nearest_match(a, p).collect())) == [(1, 7), (3, 8)]


def test_once_across_days_keeps_nameless(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 2, None), (1, 3, None), (1, 3, "")], "plan int, day int, name string")
    assert planning.once_across_days(df, "plan", "name", ["day"]).count() == 4


def test_cache_with_expiry(spark):
    times = ["00:00:00", "00:00:30", "00:01:01", "00:01:30", "00:03:00"]
    calls = spark.createDataFrame([("n", "k", f"2024-01-01 {t}", i) for i, t in enumerate(times)], "namespace string, key string, ts string, call_id long").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [r["hit"] for r in operations.cached(calls, 60).orderBy("call_id").collect()] == [False, True, False, True, False]


def test_unresolved_and_picked(spark):
    rows = spark.createDataFrame([(1, None), (2, True), (3, False)], "id int, accept boolean")
    assert [tuple(r) for r in evaluation.unresolved(rows).collect()] == [(1, True)]
    ids = spark.createDataFrame([(2,), (9,)], "id int")
    assert sorted((r["id"], r["found"]) for r in evaluation.picked(rows, ids).collect()) == [(2, True), (9, False)]


def test_cached_values_live_across_midnight_and_batches(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(1)
    calls = [("n", rng.choice("ab"), rng.randrange(80_000, 95_000), i) for i in range(3000)] + [("n", "c", 86_390, 9000), ("n", "c", 86_430, 9001), ("n", "c", 86_451, 9002)]
    want, stored = {}, {}
    for name, key, at, ident in sorted(calls, key=lambda c: (c[1], c[2], c[3])):
        hit = key in stored and at - stored[key] <= 60
        want[ident] = hit
        if not hit:
            stored[key] = at
    df = spark.createDataFrame(calls, "namespace string, key string, at long, call_id long").withColumn("ts", F.timestamp_seconds("at"))
    assert {r["call_id"]: r["hit"] for r in operations.cached(df, 60).collect()} == want
    assert [want[i] for i in (9000, 9001, 9002)] == [False, True, False]


def test_similar_cached_values_above_the_threshold(spark):
    from pyspark.sql import functions as F

    unit = lambda *x: [v / sum(a * a for a in x) ** 0.5 for v in x]
    cache = spark.createDataFrame([("a", 1, unit(1.0, 0.0), None), ("a", 2, unit(1.0, 0.4), None), ("b", 3, unit(1.0, 0.01), None), ("a", 4, unit(0.0, 1.0), 5), ("a", 100, unit(0.99, 0.1), None)], "namespace string, key long, embedding array<double>, expires int")
    asked = spark.createDataFrame([(100, "a", unit(1.0, 0.01)), (200, "a", unit(0.0, 1.0)), (300, "b", unit(0.5, 1.0))], "query_id long, namespace string, embedding array<double>")
    got = {r["query_id"]: r["key"] for r in retrieval.similar_cached(cache, asked, now=F.lit(4)).collect()}
    assert got == {100: 1, 200: 4}
    assert {r["query_id"] for r in retrieval.similar_cached(cache, asked, now=F.lit(6)).collect()} == {100}


def test_query_lists_are_distinct_and_leave_the_original_out(spark):
    rows = [("q", ["a", "q", "a", "", None], "h"), ("q", None, ""), ("q", ["q"], None)]
    df = spark.createDataFrame(rows, "q string, r array<string>, h string")
    made = lambda several: [r[0] for r in df.select(retrieval.query_list(df.q, df.r, df.h, several)).collect()]
    assert made(True) == [["a", "q,h"], [], []] and made(False) == [["q,h"], [], []]


def test_latency_of_ties_negatives_and_zeros(spark):
    import random

    from lodestrata.operators import evaluation

    rng = random.Random(4)
    rows = [(g, v) for g, n in (("a", 1), ("b", 2), ("c", 501), (None, 7)) for v in [rng.choice([0.0, -1.5, 2.0, rng.uniform(-5, 900), rng.expovariate(0.01)]) for _ in range(n)]] + [("d", None)]
    got = {r["g"]: (r["n"], r["p50"], r["p95"], r["most"]) for r in evaluation.latency(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    for g in ("a", "b", "c", None):
        v = sorted(x for k, x in rows if k == g)
        assert got[g] == (len(v), v[round(0.5 * (len(v) - 1))], v[round(0.95 * (len(v) - 1))], v[-1])
    assert "d" not in got


def test_regression_cases_and_report(spark):
    from lodestrata.operators import evaluation

    cases = spark.createDataFrame([(1, ["core"]), (2, ["a", "b"]), (3, ["c"]), (4, None)], "id int, tags array<string>")
    ids = lambda **k: sorted(r["id"] for r in evaluation.regression_cases(cases, **k).collect())
    assert ids(tags=["b"]) == [2] and ids(tags=[], impact="x", core=True, impacts={"x": ["c"]}) == [1, 3] and ids(tags=[], impact="all") == [1, 2, 3, 4]
    lines = [r["text"] for r in evaluation.report(spark.createDataFrame([("b", 0.5), ("a", None)], "name string, share double")).orderBy("line").collect()]
    assert lines == ["# report", "", "| name | share |", "|---|---|", "| a |  |", "| b | 0.5 |"]


def test_json_of_every_kind(spark):
    from pyspark.sql import functions as F

    rows = ['[{"景点名称": "兵马俑", "票价": 120}, "free", 7, {"b": {"c": [1]}, "a": null}]', '{"主题": "x", "a": [1, 2]}', "12", '"word"', "no json", "", None, "[]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = [r["m"] for r in df.withColumn("m", chunking.json_sections(F.col("t"), F.lit("T"))).orderBy("i").collect()]
    assert got[0] == '# T\n\n## 记录 1\n- 景点名称: 兵马俑\n- 票价: 120\n\n## 记录 2\nfree\n\n## 记录 3\n7\n\n## 记录 4\n- b: {"c":[1]}\n- a: '
    assert got[1] == "# T\n\n## 主题\n\nx\n\n## a\n\n[1,2]"
    assert got[2:] == ["# T\n\n12", "# T\n\nword", "", "", "", "# T\n\n"]
