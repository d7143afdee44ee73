import hashlib
import random
import zlib

import numpy as np
import pytest

from helpers import SF
from lodestrata.llm import periodic_runs, queries


def brute(words, least=12):
    """All runs by looking at each distance: stretches that are equal a distance on, of the smallest distance."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                best.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, m, q) for (s, m), q in best.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def found(docs, **options):
    return [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs.periodic_runs(docs, **options).orderBy("doc_id").collect()]


def made_up(rng):
    """Words with periodic parts, some of them within others."""
    out = []
    while len(out) < rng.choice([0, 5, 40, 150, 600]):
        kind = rng.random()
        if kind < 0.4:
            base = [rng.choice("abcdefghij") for _ in range(rng.choice([1, 2, 3, 5, 6, 7, 8, 13, 15, 16, 31, 40, 70]))]
            times = rng.choice([2, 2.3, 3, 4.5, 9])
            out += (base * 10)[: int(len(base) * times)]
        elif kind < 0.6 and out:
            out += out[-rng.randrange(1, len(out) + 1) :]
        else:
            out += [rng.choice(["x", "y", "own%d" % rng.randrange(50)]) for _ in range(rng.randrange(8))]
    return out


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([" ", "\n", " \t "]).join(made_up(rng))) for i in range(250)]
    rows += [(250 + i, " ".join(rng.choice("ab") for _ in range(n))) for i, n in enumerate((11, 12, 13, 30, 100, 400))]
    rows += [(300, "a " * 700), (301, "A a " * 9), (302, "a b c d e f " * 2), (303, "a b c d e " * 2 + "a b"), (304, "\x1c \xa0x " * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    import re

    expected = []
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        expected.append((i, len(words), brute(words), collapsed(words, brute(words))))
    assert found(docs) == expected
    assert any(len(r[2]) > 3 for r in expected) and any(r[2] and r[2][0][2] > 31 for r in expected)


def test_other_least_lengths():
    rng = random.Random(5)
    for least in (2, 4, 7, 12, 20):
        for _ in range(60):
            words = [rng.choice("ab") if rng.random() < 0.9 else "c" for _ in range(rng.randrange(60))]
            ids = np.array([ord(w) for w in words], np.int64)
            blocks = periodic_runs._worth_searching(ids, np.array([0, len(ids)]), least).get(0, {}) if len(ids) else {}
            assert periodic_runs.runs_of(ids, blocks, least) == brute(words, least), (least, words)


def test_long_texts_of_one_word_and_of_long_periods():
    ids = np.zeros(60_000, np.int64)
    first = np.array([0, len(ids)])
    assert periodic_runs.runs_of(ids, periodic_runs._worth_searching(ids, first, 12)[0]) == [(0, 60_000, 1)]
    ids = np.tile(np.random.default_rng(1).permutation(9001), 5)
    first = np.array([0, len(ids)])
    assert periodic_runs.runs_of(ids, periodic_runs._worth_searching(ids, first, 12)[0]) == [(0, 45_005, 9001)]


def test_query_equals_brute_force(spark):
    """Over the whole smallest table; documents of over 1,500 words only if their ends were made periodic."""
    import re

    got = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for i, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        elif n > 1500:
            continue
        if n > 4000:
            continue
        runs = brute(words)
        r = got[i]
        assert r["n_runs"] == len(runs)
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r["start"], r["length"], r["period"]) == top
        assert r["exponent_milli"] == (1000 * top[1] // top[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert sum(r["n_runs"] > 0 for r in got.values()) > 5


def test_odd_rows(odd_docs, no_docs, spark):
    got = found(odd_docs)
    assert len(got) == odd_docs.count() and got[0] == (0, 0, [], "") and got[2][3] == ""
    assert next(r for r in got if r[1] == 5000)[2:] == ([(0, 5000, 1)], "a")
    assert periodic_runs.periodic_runs(no_docs).count() == 0
    nameless = spark.createDataFrame([(None, "a " * 20), (None, None)], "doc_id long, text string")
    assert sorted(len(r[2]) for r in found(nameless, tail=queries.periodic_tail)) == [0, 1]
