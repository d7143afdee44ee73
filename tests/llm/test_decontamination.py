import hashlib
import random
import re

import pytest

from helpers import SF, rows_of
from lodestrata.llm import decontamination, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = {}
    for i, t in docs.items():
        w = words(t)
        hit, found = set(), set()
        for j, x in items.items():
            y = words(x)
            k = min(10, len(y))
            runs = {tuple(y[a : a + k]) for a in range(len(y) - k + 1)} if y else set()
            for a in range(len(w) - k + 1) if y else ():
                if tuple(w[a : a + k]) in runs:
                    hit |= set(range(a, a + k))
                    found.add(str(j))
        out[i] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "日本", "x1"]
    items = {i: " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 9, 10, 14, 30]))) for i in range(25)}
    items[25], items[26] = None, items[3]
    docs = {}
    for i in range(60):
        parts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 30)))]
        for _ in range(rng.randrange(0, 3)):
            own = (items[rng.randrange(25)] or "").upper().split()
            a = rng.randrange(0, max(1, len(own) - 9))
            parts += [", ".join(own[a : a + rng.choice([8, 9, 10, 11, 40])]), rng.choice(vocabulary)]
        docs[i] = " ".join(parts)
    docs[60], docs[61] = None, ""
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontamination.contamination(d, b).collect()}
    assert got == brute(docs, items)


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    a = decontamination.contamination(docs, items).drop("starts").toPandas()
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 1)
    b = decontamination.contamination(docs, items).drop("starts").toPandas()
    assert rows_of(a) == rows_of(b) and (a["n_hit"] > 0).any()


def test_equals_sql(spark, duck):
    got = queries.op4_decontamination(spark, SF).toPandas()
    assert rows_of(got) == rows_of(duck.execute(queries.OP4_SQL).df())
    assert hashlib.sha256(b"").hexdigest() in set(got["items_sha256"])


def test_odd_rows(odd_docs, no_docs, spark):
    items = spark.createDataFrame([(1, "one two three"), (2, None), (None, "one"), (4, "")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontamination.contamination(odd_docs, items).collect()}
    assert got[4] == (3, 3, ["1"]) and got[3] == (1, 0, []) and got[0] == (0, 0, []) and got[9][0] == 5000
    assert decontamination.contamination(no_docs, items).count() == 0
    assert decontamination.contamination(odd_docs, items.limit(0)).where("n_hit > 0").count() == 0
