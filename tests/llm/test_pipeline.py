import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from helpers import SF
from lodestrata.llm import toxicity
from test_decontamination import brute as contaminated
from test_jaccard_join import brute as components
from test_line_dedup import brute as lines


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """A folder of tables with planted cases."""
    rng = random.Random(3)
    words = [f"word{i}" for i in range(900)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = {i: say(20) for i in range(10)}
    docs, labels = {}, []
    for i in range(400):
        docs[i] = "\n".join(say(rng.randrange(5, 40)) for _ in range(rng.randrange(1, 6)))
        toxic = i % 4 == 0
        if toxic:
            docs[i] += f"\nyou {rng.choice(['grumbork', 'vexpot'])} and {rng.choice(['grumbork', 'vexpot'])}."
        labels.append((i, 1, int(toxic)))
    docs[400] = docs[1]
    docs[401] = docs[2] + " extra"
    docs[402] = say(5) + " " + items[3] + " " + say(5)
    docs[403] = say(30) + "\nsame one\nsame two\nsame three\n" + say(30)
    docs[404] = say(30) + "\nsame one\nsame two\nsame three\n" + say(30)
    docs[405], docs[406] = None, ""
    folder = str(tmp_path_factory.mktemp("world"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, items


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_each_stage_equals_a_plain_version(spark, world, tmp_path):
    folder, items = world
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = texts(docs)
        out = stage(spark, docs, folder)
        path = f"{tmp_path}/{k}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if name == "packing":
            break
        after = texts(docs)
        assert docs.columns == columns
        if name == "toxicity":
            model = toxicity.fit(toxicity.labelled_rows(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")))
            want = {i: t for i, t in before.items() if model.score(t)[0] < 0.7}
            assert len(before) - len(want) >= 95 and {1, 2, 402, 403, 405, 406} <= set(want)
        elif name == "line_dedup":
            cut = lines(before)
            want = {i: t for i, (t, n, gone) in cut.items() if gone == 0 or gone < n}
            assert 400 not in want and "same two" not in want[404] and "same two" in want[403]
            assert docs.where("n_chars <> length(text)").count() == 0
        elif name == "near_duplicates":
            want = {i: t for i, t in before.items() if components(before, 5, 80)[i][1] == i} if len(before) < 60 else {i: before[i] for i, (_, c) in components(before, 5, 80).items() if c == i}
            assert 401 not in want and 2 in want
        else:
            found = contaminated(before, items)
            want = {i: t for i, t in before.items() if not found[i][1]}
            assert 402 not in want
        assert after == want, name
        kept = after
    rows = docs.collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {r["doc_id"] for r in rows} == set(kept)
    assert sum(r["length"] for r in rows) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for t in kept.values())
    assert max(np.bincount([r["sequence_id"] for r in rows], [r["length"] for r in rows])) <= 2048


def test_stages_take_repeated_rows_shared_ids_and_clashing_names(spark, world):
    folder, items = world
    rng = random.Random(9)
    say = lambda n: " ".join(f"word{rng.randrange(900)}" for _ in range(n))
    base, other, half = say(60), say(60), say(20)
    rows = [(1, base), (1, base), (2, base + " more"), (3, other), (3, half), (4, other), (5, items[2]), (5, say(30)), (6, None), (6, None), (None, say(12)), (7, ""), (8, " ".join(base.split()[:30]) + " " + half)]
    columns = ["n_lines", "n_removed", "row", "component_id", "set_id", "h1", "group", "first", "n_hit", "__row"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *range(len(columns))) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in columns))
    want = {
        "line_dedup": [(1, base), (1, base), (2, base + " more"), (3, other), (3, half), (5, items[2]), (5, rows[7][1]), (6, None), (6, None), (None, rows[10][1]), (7, ""), (8, rows[12][1])],
        "near_duplicates": [(1, base), (3, other), (3, half), (5, items[2]), (5, rows[7][1]), (6, None), (6, None), (None, rows[10][1]), (7, ""), (8, rows[12][1])],
        "decontamination": [(1, base), (1, base), (2, base + " more"), (3, other), (3, half), (4, other), (5, rows[7][1]), (6, None), (6, None), (None, rows[10][1]), (7, ""), (8, rows[12][1])],
    }
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        got = out.collect()
        assert sorted([(r["doc_id"] or 0, r["text"] or "") for r in got]) == sorted([(i or 0, t or "") for i, t in want[name]]), name
        assert all([r[c] for c in columns] == list(range(len(columns))) for r in got), name


def test_run_and_empty_tables(spark, world, tmp_path):
    folder, _ = world
    assert corpus_pipeline.run(spark, folder).count() > 200
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, SF).count() > 0
