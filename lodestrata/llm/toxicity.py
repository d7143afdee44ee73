"""Toxicity by multiple-instance learning.

A document is a bag of sentences and its label says whether any of them is
toxic. A sentence scores p = sigmoid(bias + sum of the weights of its distinct
features, which are words and the beginnings of words, so that inflected forms
not seen before count too); the document scores 1 - product of (1 - p), the
noisy-or. Features with evidence are chosen and weights are learned, from
document labels by gradient descent, on a bounded sample of labelled rows; then
every sentence of every text is scored and the most offending one is located.

Bounds, all parameters: ``most`` labelled documents to learn from (those of
least hash; their whole texts) and ``words`` features.

Rows: a null or empty text has no sentence and gets the score 0; documents
without a label, and labels that are null or without a document, are not
learned from; of several labels the largest counts; repeated rows are scored
each; without both labels in the training rows, every score is the share of
toxic rows; an empty table gives an empty result; other columns are ignored.
Sentences end at ``. ! ?`` with white space after them, and at line ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, map_arrow, stage

SENTENCE = re.compile(r"[^\n]*?(?:[.!?]+(?=\s)|\n|\Z)", re.S)
WORD = re.compile(r"\w+")
BEGINNINGS = (4, 6)
SCORES = "doc_id long, score double, worst_start int, worst_end int, worst_score double"


def sentences(text: str) -> Iterator[tuple[int, int]]:
    for m in SENTENCE.finditer(text):
        if m.end() > m.start():
            yield m.start(), m.end()


def features(word: str) -> list[str]:
    """The word and, marked by a star, its beginnings."""
    return [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k)]


class Model:
    def __init__(self, weights: dict[str, float], bias: float, prior: float):
        self.weights, self.bias, self.prior = weights, bias, prior
        self.heads = {w[: BEGINNINGS[0]] for w in weights}

    def bag(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, logit) of the sentences that hold a known feature."""
        low = text.lower()
        if len(low) != len(text):  # a few letters change length; positions follow the text
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        known, heads, k, out = self.weights, self.heads, BEGINNINGS[0], []
        hits = [(m.start(), f) for m in WORD.finditer(low) if m[0][:k] in heads for f in features(m[0]) if f in known]
        if not hits:
            return out
        i = 0
        for start, end in sentences(low):
            own = set()
            while i < len(hits) and hits[i][0] < end:
                own.add(hits[i][1])
                i += 1
            if own:
                out.append((start, end, self.bias + sum(sorted(known[w] for w in own))))
            if i == len(hits):
                break
        return out

    def score(self, text: str | None) -> tuple[float, int | None, int | None, float]:
        """(document score, start and end of the worst sentence, its score); sentences without known words count as clean."""
        if not self.weights:
            return self.prior, None, None, self.prior
        bag = self.bag(text or "")
        if not bag:
            return 0.0, None, None, 0.0
        logits = np.array([x for _, _, x in bag])
        clean = -np.logaddexp(0, logits)  # log(1 - p)
        worst = int(np.argmax(logits))
        return float(-np.expm1(clean.sum())), bag[worst][0], bag[worst][1], float(1 / (1 + np.exp(-logits[worst])))


def evidence(labelled: DataFrame, words: int, least: float) -> list[str]:
    """The ``words`` words whose presence says most about the label, by a log likelihood ratio of ``least`` or more."""
    spark = labelled.sparkSession
    totals = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return []

    def distinct(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}

        def flush() -> pa.RecordBatch:
            keys, pairs = list(counts), list(counts.values())
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["word", "clean", "toxic"])

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for f in {f for w in set(WORD.findall((text or "").lower())) for f in features(w)}:
                    counts.setdefault(f, [0, 0])[label] += 1
                if len(counts) > 200_000:
                    yield flush()
        if counts:
            yield flush()

    found = map_arrow(labelled.select("text", "label"), distinct, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    term = lambda k, n, p: F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    p = (a + b) / (n1 + n0)
    ratio = term(a, n1, p) + term(b, n0, p) + term(n1 - a, n1, 1 - p) + term(n0 - b, n0, 1 - p)
    top = found.select("word", ratio.alias("ratio")).where(F.col("ratio") >= least).orderBy(F.desc("ratio"), "word").limit(words)
    return [r["word"] for r in top.collect()]


def fit(labelled: DataFrame, words: int = 2048, least: float = 8.0, steps: int = 300, rate: float = 0.3, ridge: float = 0.05) -> Model:
    """Learn from ``labelled(doc_id, text, label)``, a bounded sample as ``labelled_rows`` draws it."""
    labelled = stage(labelled.select("doc_id", "text", "label"), "labelled")
    vocabulary = evidence(labelled, words, least)
    if not vocabulary:
        share = labelled.agg(F.avg("label")).first()[0]
        return Model({}, 0.0, float(share or 0.0))
    index = {w: i for i, w in enumerate(vocabulary)}

    def bags(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Model({w: 0.0 for w in index}, 0.0, 0.0)
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                low = (text or "").lower()
                rows = [sorted({index[f] for w in WORD.findall(low[s:e]) for f in features(w) if f in index}) for s, e, _ in finder.bag(low)]
                out.append([r for r in rows if r])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.list_(pa.int32()))), batch.column(1)], ["bag", "label"])

    rows = map_arrow(labelled.select("text", "label"), bags, "bag array<array<int>>, label int").collect()
    label = np.array([r["label"] for r in rows], float)
    prior = float(label.mean())
    doc = np.array([i for i, r in enumerate(rows) for _ in r["bag"]], np.int64)
    width = np.array([len(s) for r in rows for s in r["bag"]], np.int64)
    word = np.array([w for r in rows for s in r["bag"] for w in s], np.int64)
    sentence = np.repeat(np.arange(len(width)), width)
    if not len(word) or prior in (0.0, 1.0):
        return Model({}, 0.0, prior)
    w, bias = np.zeros(len(index)), -4.0
    m, v, mb, vb = np.zeros(len(index)), np.zeros(len(index)), 0.0, 0.0
    for step in range(1, steps + 1):
        logit = bias + np.bincount(sentence, w[word], len(width))
        log_clean = np.bincount(doc, -np.logaddexp(0, logit), len(rows))
        toxic = np.clip(-np.expm1(log_clean), 1e-9, 1.0)
        # d loss / d log_clean: clean documents pull it up, toxic ones push it down by (1 - P) / P
        pull = np.where(label == 1, np.exp(log_clean) / toxic, -1.0)
        grad_logit = -pull[doc] / (1 + np.exp(-logit)) / len(rows)
        grad = np.bincount(word, grad_logit[sentence], len(index)) + ridge * w / len(rows)
        grad_bias = grad_logit.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        mb, vb = 0.9 * mb + 0.1 * grad_bias, 0.999 * vb + 0.001 * grad_bias**2
        scale = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        w = w - rate * scale * m / (np.sqrt(v) + 1e-8)
        bias = bias - rate * scale * mb / (np.sqrt(vb) + 1e-8)
    return Model({x: float(w[i]) for x, i in index.items()}, float(bias), prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(doc_id, text)`` to ``doc_id, score`` and the place and score of the worst sentence."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.prior))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            for at, n in byte_slices(batch.column(1)):
                found = [own.score(t) for t in batch.column(1).slice(at, n).to_pylist()]
                columns = list(zip(*found))
                kinds = [pa.float64(), pa.int32(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "score", "worst_start", "worst_end", "worst_score"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCORES)


def keep_clean(docs: DataFrame, model: Model, limit: float) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``limit``, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.prior))
    place = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            for at, n in byte_slices(batch.column(place)):
                part = batch.slice(at, n)
                yield part.filter(pa.array([own.score(t)[0] < limit for t in part.column(place).to_pylist()], pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def remainder(column: str, by: int):
    """crc32 of an id as text, modulo ``by``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


def labelled_rows(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> DataFrame:
    """``doc_id, text, label`` of labelled documents without the held-out third: all of them, or about ``most`` of least hash.

    The sample is drawn from the labels; its rows are bounded, so they are
    broadcast and no text is moved.
    """
    known = labels.where("toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("label")).where(remainder("doc_id", 3) != 1)
    n = known.count()
    if n > most:
        share = 0.95 * most / n  # so many standard deviations below ``most`` that the limit never cuts
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known.limit(most)), "doc_id")
