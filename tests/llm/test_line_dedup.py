import random

import pytest

from helpers import SF, rows_of
from lodestrata.llm import line_dedup, queries


def brute(texts):
    """Rows in the order of their ids."""
    strip = "\t\n\x0b\x0c\r "
    own = {i: [k for k, x in enumerate((t or "").split("\n")) if t is not None and x.strip(strip)] for i, t in texts.items()}
    line = {i: (t or "").split("\n") for i, t in texts.items()}
    seen, gone = set(), {i: set() for i in texts}
    for i in sorted(texts):
        full = [line[i][k].strip(strip) for k in own[i]]
        for at in range(max(1, len(full) - 2)) if full else ():
            w = tuple(full[at : at + 3])
            if w in seen:
                gone[i] |= {own[i][k] for k in range(at, min(at + 3, len(full)))}
            seen.add(w)
    return {i: (texts[i] if not gone[i] else "\n".join(x for k, x in enumerate(line[i]) if k not in gone[i]), len(own[i]), len(gone[i])) for i in texts}


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    lines = ["a", "b", " a ", "", "c d", "e\t", "f"]
    texts = {i: "\n".join(rng.choice(lines) for _ in range(rng.choice([0, 1, 2, 3, 5, 9]))) for i in range(60)}
    texts[60], texts[61] = None, "x\r\ny\r\nz"
    texts[62] = "x\ny\nz\nnew"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == brute(texts)


def test_equals_sql(spark, duck):
    assert rows_of(queries.op3_line_dedup(spark, SF).toPandas()) == rows_of(duck.execute(queries.OP3_SQL).df())


def test_odd_rows(odd_docs, no_docs, spark):
    out = line_dedup.dedup_lines(odd_docs)
    assert out.columns == [*odd_docs.columns, "n_lines", "n_removed"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == odd_docs.count()
    assert got[0]["text"] is None and got[1]["text"] == "" and got[11]["text"] == "line\r\nline\r\nline"
    assert got[5]["n_removed"] == 0 and got[6]["n_removed"] == 0
    assert line_dedup.dedup_lines(no_docs).count() == 0
    clash = odd_docs.withColumnsRenamed({"n": "n_lines", "label": "row"})
    assert line_dedup.dedup_lines(clash).where("n_lines = 3").count() == 1
    nameless = spark.createDataFrame([(None, "a\nb\nc"), (1, "a\nb\nc")], "doc_id long, text string")
    assert line_dedup.dedup_lines(nameless).count() == 2


def test_a_window_that_most_texts_share(spark):
    docs = spark.range(500).selectExpr("id AS doc_id", "concat('same\nlines\nhere\nown ', id) AS text")
    got = line_dedup.dedup_lines(docs)
    assert got.where("n_removed = 3").count() == 499 and got.where("n_removed = 0").first()["doc_id"] == 0


def test_one_of_several_texts_of_an_id_keeps_a_window(spark):
    rows = [(1, "a b\nc d\ne f"), (1, "a b\nc d\ne f\ng h"), (2, "x\na b\nc d\ne f")]
    got = sorted((r["doc_id"], r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert sorted(n for i, _, n in got if i == 1) == [0, 3]
    assert got[-1] == (2, "x", 3)
