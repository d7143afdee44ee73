import random

import pytest
from pyspark.sql import functions as F

from helpers import SF
from lodestrata.llm import queries, toxicity

BAD = ["grumbork", "snarlings", "snarled", "vexpot"]


def labelled(n, seed):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randrange(4, 15))) + "." for _ in range(rng.randrange(1, 12))]
        toxic = rng.random() < 0.25
        if toxic:
            k = rng.randrange(len(parts))
            parts[k] = f"{rng.choice(words)} {rng.choice(BAD)} {rng.choice(words)} {rng.choice(BAD)}."
        rows.append((i, " ".join(parts), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.fit(spark.createDataFrame(labelled(1500, 1), "doc_id long, text string, label int"))


def test_held_out_accuracy(model):
    rows = labelled(800, 2)
    right = sum((model.score(t)[0] >= 0.7) == bool(y) for _, t, y in rows)
    assert right >= 0.98 * len(rows)


def test_worst_sentence_is_the_toxic_one(model):
    text = "Word1 word2 word3. You grumbork and snarlings. Word4 word5."
    score, start, end, worst = model.score(text)
    assert score > 0.7 and text[start:end].strip() == "You grumbork and snarlings." and worst <= score
    assert model.score("Word1 word2.")[0] < 0.1


def test_unseen_forms_count_by_their_beginning(model):
    assert model.score("snarlishly snarlous")[0] > 0.5


def test_noisy_or(model):
    one, two = model.score("grumbork vexpot.")[0], model.score("grumbork vexpot. \ngrumbork vexpot.")[0]
    assert abs(two - (1 - (1 - one) ** 2)) < 1e-9


def test_query(spark):
    got = queries.op5_toxicity(spark, SF).collect()
    assert len(got) == 200 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)


def test_odd_rows(spark, odd_docs, no_docs, model):
    got = {r["doc_id"]: r["score"] for r in toxicity.score(odd_docs, model).collect()}
    assert got[0] == got[1] == got[2] == 0.0 and set(got) == set(range(12))
    assert toxicity.score(no_docs, model).count() == 0
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, None), (5, 0), (99, 1), (None, 1)], "doc_id long, toxic int")
    drawn = toxicity.labelled_rows(odd_docs, labels)
    assert {r["doc_id"] for r in drawn.collect()} <= {3, 4, 5}
    untrained = toxicity.fit(drawn)
    assert toxicity.score(odd_docs, untrained).count() == odd_docs.count()
    nothing = toxicity.fit(toxicity.labelled_rows(no_docs, labels))
    assert {r["score"] for r in toxicity.score(odd_docs, nothing).collect()} == {0.0}
    kept = toxicity.keep_clean(odd_docs, model, 0.7)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()


def test_the_sample_of_labels_is_bounded(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    labels = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    n = toxicity.labelled_rows(docs, labels, most=1000).count()
    assert 800 < n <= 1000
    held = toxicity.labelled_rows(docs, labels).where(toxicity.remainder("doc_id", 3) == 1)
    assert held.count() == 0
