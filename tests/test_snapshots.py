"""Tables that change together: a reader sees all of a commit or nothing of it."""

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import routing
from lodestrata.operators import history, operations
from lodestrata.sources.snapshots import Snapshots


def test_two_tables_are_replaced_together(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s"))
    rows = lambda xs: spark.createDataFrame(xs, "file string, n int")
    seen = lambda name, **at: sorted(map(tuple, store.read(name, **at).collect()), key=str)
    assert store.version() == 0
    assert store.commit({"chunks": rows([("a", 1), ("a", 2), ("b", 3), (None, 4)]), "items": rows([("a", 1), ("b", 1)])}) == 1
    old = store.read("chunks")
    assert store.replace("file", "a", {"chunks": rows([("a", 9)]), "items": rows([("a", 7), ("a", 8)])}) == 2
    assert seen("chunks") == [("a", 9), ("b", 3), (None, 4)]
    assert seen("items") == [("a", 7), ("a", 8), ("b", 1)] and old.count() == 4 and seen("items", version=1) == [("a", 1), ("b", 1)]

    broken = rows([("a", 5)]).withColumn("n", F.raise_error(F.lit("the writer is killed")).cast("int"))
    with pytest.raises(Exception, match="killed"):
        store.replace("file", "a", {"chunks": rows([("a", 10)]), "items": broken})  # after the first table, before the second
    assert store.version() == 2 and sorted(r["n"] for r in store.read("chunks").collect()) == [3, 4, 9] and seen("items") == [("a", 7), ("a", 8), ("b", 1)]
    assert Snapshots(spark, str(tmp_path / "s")).commit({"other": rows([])}) == 3 and seen("items") == [("a", 7), ("a", 8), ("b", 1)]


def test_messages_get_their_subjects_by_id(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "m"))
    store.commit({"messages": spark.createDataFrame([(1, "x", []), (2, "y", ["old"]), (3, "z", None)], "id long, text string, item_names array<string>")})
    store.update("messages", spark.createDataFrame([(1, None, ["a", "b"]), (3, None, ["c"]), (4, "new", None)], "id long, text string, item_names array<string>"), "id")
    assert sorted((r["id"], r["text"], r["item_names"]) for r in store.read("messages").collect()) == [(1, "x", ["a", "b"]), (2, "y", ["old"]), (3, "z", ["c"]), (4, "new", None)]


def test_history_for_prompts(spark):
    rows = [(1, 0, "user", "raw", " asked ", ["西湖", "灵隐"]), (1, 1, "assistant", "a" * 200, None, None), (1, 2, "user", "raw", None, []), (2, 0, "assistant", None, "x", ["z"])]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, rewritten_query string, item_names array<string>")
    short = {r["conv_id"]: r["history"] for r in history.prompt_history(df).collect()}
    assert short == {1: f"角色:user,内容:asked,关联主体: 西湖、灵隐\n角色:assistant,内容:{'a' * 160}…(已截断),关联主体: \n角色:user,内容:,关联主体: ", 2: "角色:assistant,内容:,关联主体: z"}
    assert "a" * 200 + ",关联" in history.prompt_history(df, answers=400).where("conv_id = 1").first()["history"]


def test_interests_and_expansion(spark):
    df = spark.createDataFrame([("u", "food", "b", 1), ("u", "food", "a", 2), ("u", "food", "b", 3), ("u", "city", "", 1), ("u", "city", None, 2), ("v", "city", "x", 5)], "user string, kind string, value string, ts int")
    assert sorted((r["user"], r["kind"], r["interests"]) for r in operations.interests(df, "user", "kind", "value", ["ts"]).collect()) == [("u", "food", ["b", "a"]), ("v", "city", ["x"])]
    asked = spark.createDataFrame([("x" * 14, None), ("x" * 15, None), ("x" * 15, []), ("x" * 15, ["a"]), (None, None)], "q string, s array<string>")
    assert [r[0] for r in asked.select(routing.expands("q", "s")).collect()] == [False, True, True, False, False]


@pytest.mark.parametrize("text,plan,transfer,date", [
    ("第一次去杭州，景点应该怎么安排？", False, False, False), ("从深圳去杭州，景点应该怎么安排？", True, False, False), ("从昆明到大理再到丽江，城市之间怎么转场最方便？", False, False, False),
    ("今天是几号", False, False, True), ("现在几点", False, False, None),
])
def test_expected_signals(spark, text, plan, transfer, date):
    """Labels that were written down, not derived from the patterns."""
    r = spark.createDataFrame([(text,)], "t string").select(routing.plan_signal("t").alias("p"), routing.transfer_question("t").alias("t"), routing.date_question("t").alias("d")).first()
    assert (r["p"], r["t"]) == (plan, transfer) and date in (None, r["d"])


def test_expected_plans_and_places(spark):
    plans = [("我想去云南玩 5 天，昆明、大理、丽江怎么安排比较顺？", True), ("想去厦门玩两三天，鼓浪屿和市区怎么安排？", True), ("帮我安排一下从成都去九寨沟的行程", True), ("我到张家界市区了，接下来天门山和森林公园怎么安排着玩？", True), ("成都有什么好吃的？", False), ("云南什么季节去合适？", False)]
    places = [("市区", True), ("市中心", True), ("城区", True), ("成都市区", False), ("杭州市", False), ("景区", False), ("", False), ("市区。", True)]
    for cases, f in ((plans, routing.plan_signal), (places, routing.generic_place)):
        got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").select("i", f("t").alias("x")).orderBy("i").collect()
        assert [r["x"] for r in got] == [want for _, want in cases]
