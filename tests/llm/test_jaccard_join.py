import random
from collections import defaultdict
from fractions import Fraction
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from lodestrata.llm import jaccard_join
from lodestrata.llm.common import Words


def shingles(text, size):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def brute_rows(rows, size, percent):
    """(doc_id, n_shingles, component_id) of each row, in order; each row is a text of its own."""
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if sets[a] and sets[b] and Fraction(len(sets[a] & sets[b]), len(sets[a] | sets[b])) * 100 >= percent:
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(i, least.get(root(k), i))
    return [(i, len(sets[k]), least[root(k)]) for k, (i, _) in enumerate(rows)]


def brute(texts, size, percent):
    return {i: (n, c) for i, n, c in brute_rows(sorted(texts.items()), size, percent)}


def found_rows(spark, rows, size, percent):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return sorted(tuple(r) for r in jaccard_join.near_duplicates(docs, size, percent).select("doc_id", "n_shingles", "component_id").collect())


def edited(rng, words, vocabulary, n):
    out = list(words)
    for _ in range(n):
        k = rng.randrange(len(out))
        act = rng.random()
        if act < 0.4:
            out[k] = rng.choice(vocabulary)
        elif act < 0.7:
            out.insert(k, rng.choice(vocabulary))
        elif len(out) > 1:
            del out[k]
    return out


def corpus(seed):
    """Groups of near and exact copies, a passage that many share, short texts and odd ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    texts = []
    for _ in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 12, 40, 120]))]
        texts += [" ".join(edited(rng, base, vocabulary, rng.randrange(0, 5))) for _ in range(25)]
        texts += [" ".join(base).upper()] * 3
    for _ in range(40):
        own = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 12))]
        k = rng.randrange(len(own) + 1)
        texts.append(" ".join(own[:k] + passage + own[k:]))
    texts += ["", " ", None, "one", "One", "two words", "three little words", "four words make one"]
    rng.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize("seed,size,percent", [(1, 4, 85), (2, 5, 80), (3, 2, 90)])
def test_components_equal_brute_force(spark, seed, size, percent):
    texts = corpus(seed)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(docs, size, percent).collect()}
    assert got == brute(texts, size, percent)


@pytest.mark.parametrize("seed", [4])
def test_repeated_rows_and_shared_ids(spark, seed):
    """Rows given twice, ids with several texts, and texts that are half alike beside them."""
    rng = random.Random(seed)
    texts = corpus(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(i, t) for i, t in texts.items() if i % 2]
    rows += [rng.choice(rows) for _ in range(60)]
    rows += [(i, texts[rng.randrange(len(texts))]) for i in range(0, 40, 3)]
    for k in range(6):
        base = [rng.choice(vocabulary) for _ in range(60)]
        half = base[:45] + [rng.choice(vocabulary) for _ in range(12)]
        rows += [(1000 + 2 * k, " ".join(base))] * 3 + [(1001 + 2 * k, " ".join(half))] * 2
    assert found_rows(spark, rows, 4, 85) == sorted(brute_rows(rows, 4, 85))


def test_repeated_row_beside_a_text_that_is_half_alike(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (1, " ".join(words)), (2, " ".join(words[:46] + [f"x{i}" for i in range(14)]))]
    assert found_rows(spark, rows, 4, 85) == [(1, 57, 1), (1, 57, 1), (2, 57, 2)]


def staged_rows(spark, label):
    """Rows of each table that was staged as ``label``."""
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    return {p.name: spark.read.parquet(str(p)).count() for p in folder.glob(f"{label}-*")}


@pytest.mark.parametrize("percent", [85])
def test_variants_beside_a_truncated_copy_are_not_paired_up(spark, percent):
    """The truncated copy is shorter, leads every bucket, and is at middle distance from all variants."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base[:122]))]
    for i in range(1, 2001):
        text = list(base)
        text[rng.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(text)))
    before = {label: set(staged_rows(spark, label)) for label in ("alike", "parted", "candidates")}
    got = found_rows(spark, rows, 4, percent)
    for label, most in (("alike", 4 * 2000), ("parted", 20 * 2000), ("candidates", 2000)):
        assert sum(n for name, n in staged_rows(spark, label).items() if name not in before[label]) <= most, label
    sets = [shingles(t, 4) for _, t in rows]
    near_cut = [len(sets[0] & s) * 100 >= percent * len(sets[0] | s) for s in sets[1:]]
    assert len({c for i, _, c in got if i}) == 1  # variants are linked with each other, for the most part through one
    assert (got[0][2] == got[1][2]) == any(near_cut)


def test_far_sets_that_share_a_shingle_are_not_paired_up(spark):
    rows = [(i, f"many share these words {' '.join(f'v{i}n{k}' for k in range(i % 40 + 1))}") for i in range(2000)]
    before = set(staged_rows(spark, "alike"))
    got = found_rows(spark, rows, 4, 85)
    assert sum(n for name, n in staged_rows(spark, "alike").items() if name not in before) <= 2000
    assert [c for _, _, c in got] == list(range(2000))


def test_levels_tell_common_shingles_apart_in_a_full_table():
    rng = np.random.default_rng(2)
    counts = rng.poisson(2_400_000, 1 << 16).astype(np.float64)
    counts[:4] += [20_000, 200_000, 2_000_000, 5_000_000_000]
    found = jaccard_join.levels(counts)
    assert 0 < found[0] < found[1] < found[2] < found[3]
    assert not found[4:].any()
    assert jaccard_join.levels(np.array([0.0, 0, 1, 3, 40, 100, 10_000])).tolist() == [0, 0, 0, 0, 0, 1, 8]


def test_texts_are_joined_first_where_ids_are_many(spark, monkeypatch):
    rows = list(corpus(7).items())
    monkeypatch.setattr(jaccard_join, "FLAGS", 8)
    assert found_rows(spark, rows, 4, 85) == sorted(brute_rows(rows, 4, 85))


@pytest.mark.parametrize("rounds", [1])
def test_rounds_do_not_change_what_is_found(spark, monkeypatch, rounds):
    monkeypatch.setattr(jaccard_join, "FEW", 2)
    rows = list(corpus(8).items())
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    classes, edges = jaccard_join.links(docs, 3, 70, rounds)
    found = {r["id"]: r["component"] for r in jaccard_join.components(edges).collect()}
    groups = defaultdict(set)
    for r in classes.collect():
        groups[found.get(r["set_id"], r["set_id"]) if r["set_id"] is not None else ("none", r["doc_id"])].add(r["doc_id"])
    want = defaultdict(set)
    for i, _, c in brute_rows(rows, 3, 70):
        want[c].add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_a_large_group_of_near_copies_is_not_paired_up(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    texts = {i: " ".join(edited(rng, base, vocabulary, rng.randrange(0, 6))) for i in range(300)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    classes, edges = jaccard_join.links(docs, 4, 85)
    assert edges.count() < 10 * 300
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(docs, 4, 85).collect()}
    assert got == brute(texts, 4, 85)


def test_odd_rows(odd_docs, no_docs):
    got = jaccard_join.near_duplicates(odd_docs, 4, 85).collect()
    assert len(got) == odd_docs.count()
    by = defaultdict(set)
    for r in got:
        by[r["component_id"]].add(r["doc_id"])
    assert by[5] == {5, 6}
    assert {r["doc_id"] for r in got if r["n_shingles"] == 0} == {0, 1, 2, 10}
    assert jaccard_join.near_duplicates(no_docs, 4, 85).count() == 0


def test_long_chains_are_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["id"]: r["component"] for r in jaccard_join.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_words_of_a_column():
    words = Words(pa.array(["ab  AB\ncd", "", "x", None, " ", "ba ab"]))
    assert words.first.tolist() == [0, 3, 3, 4, 4, 4, 6]
    assert words.hash[0] == words.hash[1] == words.hash[5] != words.hash[4]
    sliced = Words(pa.array(["zz", "ab", "cd"]).slice(1))
    assert sliced.hash[0] == words.hash[0] and sliced.hash[1] == words.hash[2]


def test_parities_bound_the_difference():
    rng = np.random.default_rng(1)
    for n in (3, 70, 900):
        a = np.unique(rng.integers(0, 2**63, n, np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 2**63, n, np.uint64)]))
        assert jaccard_join._least_difference(jaccard_join._parities(a), jaccard_join._parities(b)) <= len(np.setxor1d(a, b))
