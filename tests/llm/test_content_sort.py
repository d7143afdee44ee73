import hashlib
import random
import re

from pyspark.sql import functions as F

from helpers import SF, rows_of
from lodestrata.llm import content_sort, queries


def brute(rows):
    """``rows`` of (doc_id, text) to the rows of the result, as a sorted list."""
    groups = {}
    for i, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(i)
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i))
        out += [(i, ids[0], len(ids), k == 0, hashlib.sha256(text.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(out, key=str)


def found(docs, **options):
    return sorted(map(tuple, content_sort.exact_duplicates(docs, **options).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_equals_sql(spark, duck):
    assert rows_of(queries.op13_content_sort(spark, SF).toPandas()) == rows_of(duck.execute(queries.OP13_SQL).df())


def test_equals_brute_force_with_and_without_hot_groups(spark):
    rng = random.Random(1)
    texts = ["a b", "a\tb", "a  b", " a b", "a b\n", "a\x0b\x0c\rb", "a\x1cb", "a\xa0b", "", " ", None, "é", "é", "A b", "a b c" * 900, "a b c" * 900 + " "]
    rows = [(rng.randrange(100), rng.choice(texts)) for _ in range(400)] + [(None, "a b"), (None, "alone"), (None, "alone"), (7, "alone again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for shares in (1, 3, 50, content_sort.SHARES):
        assert found(docs, shares=shares) == brute(rows), shares


def test_a_third_of_all_rows_is_one_text(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 1, "the same\ntext").otherwise(F.concat(F.lit("own "), F.col("id").cast("string"))).alias("text"))
    got = content_sort.exact_duplicates(docs, shares=100)
    assert got.where("group_size = 2000 AND keep_id = 1").count() == 2000 and got.where("kept").count() == 4001


def test_one_exchange_and_a_split_group(spark):
    texts = spark.createDataFrame([(i, "same", "same", 1, i % 50) for i in range(3000)], "doc_id long, body string, head string, hash long, part int")
    sorted_rows = content_sort._sorted_groups(texts)
    plan = sorted_rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "hashpartitioning" not in plan
    assert sorted_rows.where("place = 1 AND n = 60").count() == 50


def test_odd_rows(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert found(odd_docs) == brute(rows)
    clash = odd_docs.withColumnsRenamed({"label": "part", "n": "hash", "score": "body"})
    assert found(clash) == brute(rows)
    assert content_sort.exact_duplicates(no_docs).count() == 0
