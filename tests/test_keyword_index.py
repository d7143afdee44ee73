"""The stored index against scoring every document, blocks that are never read, and appended segments."""

import math
import random
from collections import Counter

from lodestrata.operators import keyword_index as K
from lodestrata.operators import retrieval


def brute(docs, asked, top):
    words = {i: (t or "").split() for i, t in docs}
    n, avgdl = len(docs), sum(map(len, words.values())) / max(1, len(docs))
    df = Counter(w for own in words.values() for w in set(own))
    raw = {w: math.log(n - k + 0.5) - math.log(k + 0.5) for w, k in df.items()}
    mean = sum(raw.values()) / max(1, len(raw))
    idf = {w: x if x >= 0 else 0.25 * mean for w, x in raw.items()}
    out = []
    for q, text in asked:
        scored = []
        for i, own in words.items():
            tf = Counter(own)
            s = sum(idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(own) / avgdl)) for w in text.split() if w in tf)
            if s > 0:
                scored.append((-round(s, 9), i))
        out += [(q, i, r + 1, round(-s, 6)) for r, (s, i) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def rows(df):
    return sorted((r["query_id"], r["doc_id"], r["rank"], round(r["score"], 6)) for r in df.collect())


def made(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    text = lambda: " ".join(vocabulary[min(299, int(rng.expovariate(0.03)))] for _ in range(rng.choice([0, 3, 20, 60])))
    docs = [(i, text()) for i in range(n)] + [(n, None), (n + 1, "")]
    docs += [(n + 2 + k, f"rare{k % 3} " * 4 + "w1 w2") for k in range(9)]
    asked = [(q, text() or "w1") for q in range(12)] + [(50, "rare0 rare1 w1"), (51, "nothing here"), (52, "w1 w1 w2")]
    return docs, asked


def test_search_equals_scoring_every_document(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "SPAN", 16)
    docs, asked = made(3, 700)
    have, queries = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(asked, "query_id long, text string")
    index = K.build(have, str(tmp_path / "one"))
    assert rows(K.search(index, queries, 5)) == brute(docs, asked, 5)
    assert rows(K.search(K.opened(spark, str(tmp_path / "one")), queries, 40)) == brute(docs, asked, 40)
    # blocks out of reach are never read
    terms = K.asked_terms(queries.where("query_id = 50"), index.weights)
    first, rest = K.first_spans(K.bounds(index, terms))
    reach = K.within_reach(rest, K.scores(index, terms, first, None), 5)
    assert rest.count() > 20 and reach.count() < 0.3 * rest.count()
    # a filter after scoring
    few = spark.createDataFrame([(i,) for i, _ in docs if i % 7 == 0], "doc_id long")
    every = brute(docs, asked, 10_000)
    kept = {}
    for q, i, _, s in sorted(every, key=lambda r: (r[0], r[2])):
        if i % 7 == 0:
            kept.setdefault(q, []).append((q, i, len(kept.get(q, [])) + 1, s))
    assert rows(K.search(index, queries, 5, few)) == sorted(r for own in kept.values() for r in own[:5])


def test_appended_documents_change_the_statistics(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "SPAN", 16)
    docs, asked = made(4, 300)
    have, queries = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, text string")
    index = K.build(have.where("doc_id < 200"), str(tmp_path / "two"))
    later = index.append(have.where("doc_id >= 200"))
    assert rows(K.search(index, queries, 5)) == brute(docs[:200], asked, 5)  # as it was opened
    assert rows(K.search(later, queries, 5)) == rows(K.search(K.opened(spark, str(tmp_path / "two")), queries, 5)) == brute(docs, asked, 5)


def test_a_writer_that_fails_leaves_the_index(spark, tmp_path):
    docs, asked = made(5, 50)
    have, queries = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, text string")
    path = str(tmp_path / "three")
    K.build(have, path)
    (tmp_path / "three/blocks/segment=1").mkdir()
    index = K.build(have, str(tmp_path / "four"))
    index.blocks.drop("segment").write.mode("overwrite").parquet(f"{path}/blocks/segment=1")  # all but the row that makes it valid
    assert rows(K.search(K.opened(spark, path), queries, 5)) == brute(docs, asked, 5)


def test_no_documents_and_no_questions(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b ccc")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "ccc")], "query_id long, text string")
    assert retrieval.bm25(docs.limit(0), asked).count() == 0 and retrieval.bm25(docs, asked.limit(0)).count() == 0


def test_tasks_keep_the_best_of_each_question_alone(spark, tmp_path, monkeypatch):
    """So what leaves them does not grow with questions times documents; more questions than are scored at once, and ids that come twice."""
    monkeypatch.setattr(K, "SPAN", 16)
    monkeypatch.setattr(K, "ASKED", 4)
    docs, asked = made(6, 600)
    have, queries = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(asked, "query_id long, text string")
    index = K.build(have, str(tmp_path / "five"))
    terms = K.asked_terms(queries, index.weights)
    weighted = terms.selectExpr("query_id", "term", "times * idf AS y", "avgdl")
    got = K.products(index, weighted, 3)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert max(r["count"] for r in got.groupBy("query_id").count().collect()) <= 3 * parts < len(docs)
    assert rows(K.best(got, 3)) == brute(docs, asked, 3)
