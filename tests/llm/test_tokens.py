import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from conftest import ODD
from helpers import SF
from lodestrata.llm import common, packing, queries, token_counts, token_files, word_ids

ALPHABET = ["a", "B", "é", "1", "٣", " ", "  ", "\n", "\t", "\x85", "\xa0", "\x1c", "​", "'s", "'", "<|endoftext|>", "<|ENDOFTEXT|>", "日本", "!", "😀", "́", "ß", "İ", "²", "\x00"]


def strange(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randrange(0, 25))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts(spark):
    return [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").select("text").collect()]


def test_counts_equal_the_library(texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    counter, library = token_counts.Counter(path), Tokenizer.from_file(path)
    for part in (texts, strange(3000, 1), [t or "" for t in ODD], ["x" * 4000, "ab" * 3000, ""]):
        assert [counter.count(t) for t in part] == [len(e.ids) for e in library.encode_batch(part, add_special_tokens=False)]


def test_memory_of_the_counter_is_bounded(monkeypatch, texts):
    monkeypatch.setattr(token_counts, "REMEMBERED", 50)
    path = public_tokenizers.path("byte_bpe_50k.json")
    counter, library = token_counts.Counter(path), Tokenizer.from_file(path)
    assert [counter.count(t) for t in texts[:30]] == [len(e.ids) for e in library.encode_batch(texts[:30], add_special_tokens=False)]


def test_count_rows(spark, odd_docs, no_docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = token_counts.count_tokens(odd_docs, path).collect()
    assert len(got) == odd_docs.count() and {(r["n_bytes"], r["n_tokens"]) for r in got if r["doc_id"] < 2} == {(0, 0)}
    assert token_counts.count_tokens(no_docs, path).count() == 0


def test_word_ids_equal_the_library(texts, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for remembered in (word_ids.REMEMBERED, 40):
        monkeypatch.setattr(word_ids, "REMEMBERED", remembered)
        encoder = word_ids.Encoder(path)
        for part in (texts, strange(2000, 2), strange(200, 3) + texts[:40], [t or "" for t in ODD]):
            ids, lengths = encoder.encode(pa.array(part))
            want = [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
            assert lengths.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


def test_repair_is_exact_and_smaller():
    rng = np.random.default_rng(1)
    common = [rng.integers(0, 500, 5) for _ in range(20)]
    ids = np.concatenate([common[i] for i in rng.integers(0, 20, 4000)]).astype(np.uint32)
    seq, left, right = token_files.repair(ids, 500)
    assert np.array_equal(token_files.expand(seq, 500, left, right), ids) and len(seq) < 0.6 * len(ids)
    size = token_files.expansions(500, left, right)
    assert size.tolist() == [len(token_files.expand(np.array([500 + i]), 500, left, right)) for i in range(len(left))]
    for odd in (np.zeros(0, np.uint32), np.array([7], np.uint32), np.full(999, 3, np.uint32)):
        assert np.array_equal(token_files.expand(*(lambda s, a, b: (s, 500, a, b))(*token_files.repair(odd, 500))), odd)


def test_repair_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(2)
    passage = rng.integers(0, 400, 300)
    parts = [x for _ in range(60) for x in (passage, rng.integers(400, 60000, 50))]
    ids = np.concatenate([*parts, rng.integers(0, 90, 200_000)]).astype(np.uint32)
    seq, left, right = token_files.repair(ids, 60000)
    assert np.array_equal(token_files.expand(seq, 60000, left, right), ids)
    assert np.unique((seq[:-1] << 32) | seq[1:], return_counts=True)[1].max() < token_files.LEAST_COUNT
    assert len(set(zip(left.tolist(), right.tolist()))) == len(left)
    assert token_files.expansions(60000, left, right).max() > 100


def test_token_files_round_trip(spark, odd_docs, no_docs, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 1)
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    token_files.write(odd_docs.union(spark.createDataFrame([(None, "no id", "", 0.0, 0)], odd_docs.schema)), f"{tmp_path}/t", path, 2, 49408, 3)
    rows = token_files.read(spark, f"{tmp_path}/t").join(token_files.starts(spark, f"{tmp_path}/t"), ["shard", "block"]).collect()
    got = sorted(((r["before"] + r["in_block"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows), key=lambda r: r[0])
    want, at = [], 0
    for i in [None, *range(6), *range(5, 12)]:
        ids = library.encode("no id" if i is None else ODD[i] or "", add_special_tokens=False).ids + [2]
        want.append((at, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    token_files.write(no_docs, f"{tmp_path}/e", path, 2, 49408, 3)
    assert token_files.read(spark, f"{tmp_path}/e").count() == 0
    for row in spark.read.parquet(f"{tmp_path}/t").collect():
        row = row.asDict()
        whole, at = token_files.decode(row), 0
        for i, n in enumerate(row["n_tokens"]):
            assert np.array_equal(token_files.fetch(row, i), whole[at : at + n])
            at += n


def test_token_file_query(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [e.ids + [2] for e in library.encode_batch(texts, add_special_tokens=False)]
    starts = np.cumsum([0, *map(len, want)]).tolist()
    got = sorted(map(tuple, queries.op6_token_files(spark, SF).select("start", "n_tokens", "ids_crc32").collect()))
    assert got == [(s, len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for s, w in zip(starts, want)]


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(documents=5), packing.Limits(attention=2_000_000), packing.Limits(score="dot", weights=(1.0, 0.2, 0.2))])
def test_plan_keeps_every_limit(limits):
    if limits.attention < limits.tokens**2:
        counts = {n: 30 for n in range(1, 1300, 7)}
    else:
        counts = {n: 1 + 3000 // n for n in range(1, 2049, 3)}
    bins = {}
    runs = packing.plan(counts, limits)
    taken = dict.fromkeys(counts, 0)
    for length, a, b, base, offset in sorted(runs):
        assert a == taken[length]
        taken[length] = b
    for length, a, b, base, offset in runs:
        for k in range(b - a):
            used = bins.setdefault(base + k, [])
            assert sum(used) == offset
            used.append(length)
    assert taken == counts
    for used in bins.values():
        assert sum(used) <= limits.tokens and len(used) <= limits.documents and sum(x * x for x in used) <= limits.attention
    if limits == packing.Limits():
        total = sum(k * n for k, n in counts.items())
        assert len(bins) <= -(-total // 2048) + 3


def test_packing_rows(spark, odd_docs, no_docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = packing.pack(odd_docs, path, 0).collect()
    want = []
    for i in [*range(12), 5]:
        ids = library.encode(ODD[i] or "", add_special_tokens=False).ids + [0]
        want += [(i, p, p * 2048, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for p in range(-(-len(ids) // 2048)) for x in [ids[p * 2048 : (p + 1) * 2048]]]
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in by.values():
        at = 0
        for offset, n in sorted(placed):
            assert offset == at
            at += n
        assert at <= 2048
    assert packing.pack(no_docs, path, 0).count() == 0


def test_a_worker_remembers_words_within_bounds():
    """Of ever new words, tables stay within 40 MB."""
    encoder = word_ids.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    for i in range(12):
        texts = pa.array([" ".join(f"w{n:x}" for n in range(i * 60_000, (i + 1) * 60_000))])
        encoder.encode(texts)
    assert sum(x.nbytes for x in vars(encoder).values() if isinstance(x, np.ndarray)) < 40e6


def test_tasks_give_back_what_arrow_has_freed(monkeypatch):
    released = []

    class Pool:
        def release_unused(self):
            released.append(1)

    class Rows:
        def mapInArrow(self, run, schema):
            return run

    monkeypatch.setattr(common.pa, "default_memory_pool", Pool)
    batches = [pa.RecordBatch.from_pydict({"n": [i]}) for i in range(3)]
    assert list(common.map_arrow(Rows(), lambda rows: (b for b in rows), "n long")(iter(batches))) == batches and len(released) == 4
