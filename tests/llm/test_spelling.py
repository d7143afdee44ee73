import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from helpers import SF
from lodestrata.llm import queries, spelling


def counts(rows, shortest=7, least=2, misspelt=0):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if misspelt and h % misspelt == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= shortest:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= least}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def brute(n, ratio=10):
    """Near words by what is left when any one letter goes; every pair that meets is held against the definition."""
    meet = defaultdict(set)
    for w in n:
        meet[w].add(w)
        for i in range(len(w)):
            meet[w[:i] + w[i + 1 :]].add(w)
            meet[w[:i] + "*" + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for group in meet.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def found(docs, **options):
    rows = spelling.spelling_variants(docs, **options).collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def edited(rng, w):
    k = rng.randrange(len(w) + 1)
    return rng.choice([w[:k] + rng.choice("abé") + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice("abñ") + w[k + 1 :]])


@pytest.mark.parametrize("letters", ["ab", "abcdefg", "aé"])
def test_equals_brute_force(spark, letters):
    rng = random.Random(letters)
    words = ["".join(rng.choice(letters) for _ in range(rng.choice([5, 6, 7, 7, 8, 9, 12]))) for _ in range(60)]
    words += [edited(rng, w) for w in words for _ in range(3)]
    words += [edited(rng, w) for w in words[60:160]]
    long = "".join(rng.choice(letters) for _ in range(400))
    words += [long, edited(rng, long), edited(rng, long), edited(rng, edited(rng, long))]
    texts = [rng.choice([" ", "1", "\n", "-"]).join(str(rng.choice([w, w.upper(), w])) for w in rng.choices(words, [100 if k < 60 else 10 if k < 240 else 1 for k in range(len(words))], k=400)) for _ in range(60)]
    texts += [" ".join(words) + " " + words[0] * 2] * 2
    rows = list(enumerate(texts)) + [(None, " ".join(words[:9])), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for misspelt in (0, 5):
        expected = brute(counts(rows, misspelt=misspelt))
        assert found(docs, misspelt=misspelt) == expected
        assert sum(r[0] is not None for r in expected.values()) > 10 and max(r[3] for r in expected.values()) > 2


def test_query_equals_brute_force(spark):
    """Over the whole table."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in queries.op12_spelling_variants(spark, SF).collect()}
    assert got == brute(counts(rows, misspelt=31)) and len(got) > 500


def test_chains_of_forms(spark):
    words = {"abcdefgh": 2, "abcdefghi": 20, "abcdefghij": 250, "abcdefghijk": 2600, "abcdxfgh": 2}
    docs = spark.createDataFrame([(i, " ".join([w] * n)) for i, (w, n) in enumerate(words.items())], "doc_id long, text string")
    got = found(docs)
    assert got["abcdefgh"] == ("abcdefghi", "abcdefghijk", 2, 2, 20) and got["abcdxfgh"][:2] == (None, "abcdxfgh") and got["abcdefghijk"][:2] == (None, "abcdefghijk")


def test_pairs_that_meet_are_few(spark):
    """Words of one stem share bigrams, place and length; they meet only if they are equal but for a window."""
    rng = random.Random(3)
    stems = ["quizzical" + "".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(1500)]
    letters = spelling._Letters(pa.array(sorted(set(stems))))
    rank = np.zeros(1 << 16, np.uint16)
    rank[:] = 65535
    for k, gram in enumerate(("qu", "ui", "iz")):
        rank[ord(gram[0]) * 256 + ord(gram[1])] = k
    word, place = letters.rarest(rank)
    assert sorted(set(place.tolist())) == [0, 1, 2]
    with np.errstate(over="ignore"):
        letters.hashes()
        _, keys = letters.keys(word, place, 0)
    times = np.unique(keys, return_counts=True)[1]
    assert (times * (times - 1) // 2).sum() < 3 * len(stems)


def test_odd_rows(odd_docs, no_docs, spark):
    assert found(odd_docs) == brute(counts([(r["doc_id"], r["text"]) for r in odd_docs.collect()]))
    assert spelling.spelling_variants(no_docs).count() == 0
    letters = spark.createDataFrame([(1, "a" * 60_000 + " " + "a" * 60_000), (2, "a" * 59_999 + " " + "a" * 59_999)], "doc_id long, text string")
    assert sorted((r[2], r[3]) for r in found(letters).values()) == [(2, 1), (2, 1)]
    with pytest.raises(ValueError):
        spelling.spelling_variants(no_docs, ratio=1)
