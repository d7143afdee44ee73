import pytest

#: Texts that every operator must take: nulls, empties, repeats, odd characters, a long one.
ODD = [None, "", " \n\t ", "one", "one two three", "Same text here now", "same TEXT here now", "é ü 日本 😀 \x1c x", "<|endoftext|> a<|endoftext|>b", "a " * 5000, "\n\n\n", "line\r\nline\r\nline"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts under ids of their own, with columns whose names clash with those that operators make, and one row twice."""
    rows = [(i, t, "x", float(i), i) for i, t in enumerate(ODD)]
    rows.append(rows[5])
    return spark.createDataFrame(rows, "doc_id long, text string, label string, score double, n long").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
