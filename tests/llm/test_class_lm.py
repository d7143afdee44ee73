import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from helpers import SF
from lodestrata.llm import class_lm, queries


def test_counts_and_base_score_equal_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r for r in queries.op2_class_lm(spark, SF).collect()}
    words = {i: (t or "").encode().lower().split() for i, t in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    c = Counter(w for i in docs if not held[i] for w in [*words[i], None])
    n, v = sum(c.values()), len(c)
    better = 0
    for i in docs:
        tokens = [*words[i], None]
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(tokens), sum(c[w] > 0 for w in tokens), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens), rel_tol=1e-9)
        better += r["score"] > r["base_score"]
    assert better > 0.9 * len(docs)


def test_classes_find_an_alternation():
    """Words in alternation: classes find the pattern."""
    rng = np.random.default_rng(0)
    counts = np.zeros((9, 9))
    text = [w for _ in range(2000) for w in (rng.integers(0, 4), 4 + rng.integers(0, 4))]
    for a, b in zip(text, text[1:]):
        counts[a, b] += 1
    own = class_lm.cluster(counts, 8, classes=2)
    assert len(set(own[:4])) == 1 and len(set(own[4:8])) == 1 and own[0] != own[4] and own[8] == 2


def plain(docs, held, spark):
    """(words' classes, log10 P(token | token before) of a pair) from the operator's classes alone, counted anew."""
    train = [t for i, t in docs.items() if not held(i)]
    df = spark.createDataFrame([(t,) for t in train], "text string").repartition(3)
    top = class_lm.common_words(class_lm.word_counts(df), class_lm.COMMON).toPandas().sort_values(["c", "word"], ascending=[False, True])
    own, _ = class_lm.fit(df, top, 4)
    texts = [(t or "").encode().lower().split() for t in docs.values()]
    every = sorted({w for t in texts for w in t})
    found = class_lm.Words(pa.array([b" ".join(every).decode()]))
    at = class_lm.Table(top["word"].to_numpy(np.int64).view(np.uint64)).find(found.hash)
    shape = class_lm.CLASSES + class_lm._shape(found)
    cls = {w: int(own[a]) if a >= 0 else int(s) for w, a, s in zip(every, at, shape)} | {None: int(own[-1])}
    runs = [[None, *(t or "").encode().lower().split(), None] for t in train]
    joint, c = Counter((cls[a], cls[b]) for r in runs for a, b in zip(r, r[1:])), Counter(w for r in runs for w in r[1:])
    n_in, n_out, total = Counter(), Counter(), sum(joint.values())
    for (a, b), n in joint.items():
        n_out[a] += n
        n_in[b] += n
    members = Counter(cls[w] for w in c)
    k = class_lm.CLASSES + class_lm.SHAPES

    def cost(a, b):
        x, y = cls[a], cls[b]
        share = (n_in[y] + 1) / (total + k)
        follow = (1 - class_lm.BACKOFF) * joint[x, y] / n_out[x] + class_lm.BACKOFF * share if n_out[x] else share
        return math.log10(follow) + math.log10((c[b] + class_lm.EMIT_ADD) / (n_in[y] + class_lm.EMIT_ADD * (members[y] + (y >= class_lm.CLASSES))))

    return cls, cost, c, members


def test_score_equals_a_plain_version_and_probabilities_sum_to_one(spark):
    rng = np.random.default_rng(3)
    docs = {i: " ".join(f"{'ab'[k % 2]}{rng.zipf(1.5) % 3000}" for k in range(int(rng.integers(0, 60)))) for i in range(300)}
    held = lambda i: i % 7 == 0
    cls, cost, c, members = plain(docs, held, spark)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    for r in class_lm.score(df, F.col("doc_id") % 7 != 0).collect():
        tokens = [None, *docs[r["doc_id"]].encode().lower().split(), None]
        assert math.isclose(r["score"], sum(cost(a, b) for a, b in zip(tokens, tokens[1:])), rel_tol=1e-9), r
    # after any word, seen words and one unknown word of each shape have probability one together
    unknown = [(y, next((w for w in cls if cls[w] == y and not c[w]), None)) for y in range(class_lm.CLASSES, class_lm.CLASSES + class_lm.SHAPES)]
    for before in (None, *list(c)[:3]):
        seen = sum(10 ** cost(before, w) for w in c)
        assert seen < 1 and sum(10 ** cost(before, w) for _, w in unknown if w is not None) <= 1 - seen + 1e-9


def test_words_find_the_class_of_their_place(spark):
    """Words beyond the first exchange are put beside the words that they stand for."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"{'xy'[k % 2]}{rng.integers(0, 900)}" for k in range(40)) for _ in range(700)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    top = class_lm.common_words(class_lm.word_counts(df), class_lm.COMMON).toPandas().sort_values(["c", "word"], ascending=[False, True])
    own, joint = class_lm.fit(df, top, 4)
    words = class_lm.Words(pa.array([" ".join([f"{a}{i}" for a in "xy" for i in range(900)])]))
    number = class_lm.Table(top["word"].to_numpy(np.int64).view(np.uint64)).find(words.hash)
    assert len(top) > class_lm.CLUSTERED and (number >= 0).all() and (own[:-1] < class_lm.CLASSES).mean() > 0.99
    x, y = set(own[number[:900]]), set(own[number[900:]])
    assert sum(np.isin(own[number[:900]], list(x & y))) < 20
    assert joint.sum() == len(texts) * 41


def test_odd_rows(odd_docs, no_docs):
    got = class_lm.score(odd_docs, F.col("doc_id") % 2 == 1).collect()
    assert len(got) == odd_docs.count()
    by = {}
    for r in got:
        assert by.setdefault(r["doc_id"], r) == r
        assert r["score"] < 0
    assert by[0]["n_tokens"] == by[1]["n_tokens"] == 1 and by[9]["n_tokens"] == 5001
    assert by[0]["score"] == by[1]["score"]
    assert class_lm.score(no_docs, F.lit(True)).count() == 0
    untrained = class_lm.score(odd_docs, F.lit(False)).collect()
    assert {r["train_tokens"] for r in untrained} == {0} and {r["n_known"] for r in untrained} == {0}


def test_gains_equal_recounting_the_likelihood():
    """The class chosen for a word is one where the likelihood, counted anew with the word moved there, is greatest."""
    rng = np.random.default_rng(2)
    k = class_lm.CLASSES + class_lm.SHAPES
    own = np.concatenate([rng.integers(0, 6, 40), rng.integers(class_lm.CLASSES, k, 20)])
    text = rng.choice(60, 900, p=rng.dirichlet(np.full(60, 0.5)))

    def joint_of(classes):
        return np.bincount(classes[text[:-1]] * k + classes[text[1:]], minlength=k * k).reshape(k, k).astype(float)

    entries = []
    for w in range(60):
        after, before = text[1:][text[:-1] == w], text[:-1][text[1:] == w]
        for side, other in ((0, after), (1, before)):
            entries += [(w, side, c, n) for c, n in zip(*np.unique(own[other], return_counts=True))]
        if (after == w).sum():
            entries.append((w, 2, 0, (after == w).sum()))
    row, side, cls, c = (np.array(x) for x in zip(*entries))
    best = class_lm._Gains(joint_of(own)).best(row, side, cls, c.astype(float), own)
    for w in range(60):
        found = []
        for to in range(class_lm.CLASSES):
            moved = own.copy()
            moved[w] = to
            found.append(class_lm.likelihood(joint_of(moved)))
        assert math.isclose(found[best[w]], max(found), rel_tol=1e-9)


def test_sweeps_end_by_what_they_gain(spark, monkeypatch):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(" ".join(f"{'xy'[k % 2]}{rng.integers(0, 700)}" for k in range(40)),) for _ in range(300)], "text string").repartition(3)
    top = class_lm.common_words(class_lm.word_counts(df), class_lm.COMMON).toPandas().sort_values(["c", "word"], ascending=[False, True])
    seen = []
    monkeypatch.setattr(class_lm, "likelihood", lambda joint, f=class_lm.likelihood: seen.append((f(joint), joint)) or f(joint))
    own, joint = class_lm.fit(df, top, 4)
    assert 2 <= len(seen) < class_lm.ROUNDS
    per_token = [x / j.sum() for x, j in seen]
    gains = [b - a for a, b in zip(per_token, per_token[1:])]
    assert all(g >= class_lm.SMALL_GAIN for g in gains[1:-1]) and joint.sum() == 300 * 41
    assert per_token[0] < class_lm.likelihood(joint) / joint.sum() + 1e-9


def test_contexts_are_counted_by_groups_of_words(spark):
    """A row for each group of words at most, and the counts are those of a plain pass, more than a task holds at once included."""
    rng = np.random.default_rng(8)
    k, known = class_lm.CLASSES + class_lm.SHAPES, 3000
    own = np.concatenate([rng.integers(0, k, known), [3]])
    texts = [rng.integers(0, known + class_lm.SHAPES, n).tolist() + [known + class_lm.SHAPES] for n in (3_000_000, 0, 1, 500)]
    texts[3][10:13] = [2999, 2999, 2999]
    texts[3][20:22] = [5, 5]
    df = spark.createDataFrame([(np.array(t, np.int32).tobytes(),) for t in texts], "tokens binary").coalesce(1)
    wanted = np.arange(known) % 3 == 2
    rows, joint = class_lm.contexts(df, own, wanted)
    rows = rows.collect()
    assert len(rows) == len({r["grp"] for r in rows}) <= class_lm.GROUPS
    got = np.zeros((known, class_lm.WIDTH), np.int64)
    for r in rows:
        word, slot, c = class_lm._entries(r["grp"], pa.scalar(bytes(r["cells"]), pa.binary()), pa.scalar(bytes(r["counts"]), pa.binary()))
        got[word, slot] += c
    every, plain, pairs = np.concatenate([own[:-1], class_lm.CLASSES + np.arange(class_lm.SHAPES), own[-1:]]), np.zeros_like(got), np.zeros((k, k))
    for t in texts:
        b = np.array(t)
        a = np.concatenate([[known + class_lm.SHAPES], b[:-1]])
        np.add.at(pairs, (every[a], every[b]), 1)
        left, right = [(x < known) & (x % 3 == 2) for x in (a, b)]
        np.add.at(plain, (a[left], every[b[left]]), 1)
        np.add.at(plain, (b[right], k + every[a[right]]), 1)
        np.add.at(plain, (b[right & (a == b)], 2 * k), 1)
    assert (got == plain).all() and (joint == pairs).all() and got[2999, 2 * k] and got[5, 2 * k]
