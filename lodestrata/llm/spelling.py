"""Spelling variants by a rare-first q-gram prefix filter.

Words are counted over all texts. Positional bigrams are ordered by how many
words have them, rarest first; one edit destroys two bigrams at most, so two
words that are one edit apart share one of the three rarest of both, at most one
place off, the edit on one side of it. Words are joined on those three, with
place and length, and every pair that meets is verified.

A bigram that many words share would pair them all, so the join key holds what
the edit must leave alone, too: all letters but a window on one side of the
bigram. The windows of a bigram, three letters each (an eighth of the word, if
that is more), cover both sides; so words meet that are equal but for one window.

Each word's form is its commonest near word, if that is ``ratio`` times as
common; roots are found by joins of forms with forms, which halve what is left
of the chains (a chain has fewer links than a count has digits).

Rows: a null text has no words; rows without an id count like others; repeated
rows and equal ids count each; ties of forms go to the smallest word in
code-point order; a word of any length is compared whole; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _power_tables, byte_slices, map_arrow, mix64, ragged, stage

#: Bigrams of a word that are joined: one edit destroys two.
RAREST = 3
#: Letters of a window, and windows of a long word.
WINDOW, WINDOWS = 3, 8
#: Distinct words that a task holds before it hands its counts on.
HELD = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), 0xC3]] = True  # 0xC3 begins U+00C0 to U+00FF
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def _checksums(data: np.ndarray, start: np.ndarray, size: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each run of bytes, continued from the checksum ``before`` it."""
    out = np.empty(len(start), np.uint32)
    order = np.argsort(-size, kind="stable")
    long = int(np.searchsorted(-size[order], -64, "left"))  # those are few
    for i in order[:long].tolist():
        out[i] = zlib.crc32(data[start[i] : start[i] + size[i]].tobytes(), int(before[i]))
    order = order[long:]
    state, at, left = before[order] ^ np.uint32(0xFFFFFFFF), start[order], size[order]
    live = len(order)
    for k in range(int(left[0]) if live else 0):
        live = int(np.searchsorted(-left, -k, "left"))
        state[:live] = _CRC[(state[:live] ^ data[at[:live] + k]) & 0xFF] ^ (state[:live] >> np.uint32(8))
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def _words_of(doc_ids: pa.Array, texts: pa.Array, shortest: int, misspelt: int) -> pa.Array:
    """The runs of letters of ``shortest`` code points or more, A-Z lower-cased."""
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = _LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    letter = _LETTER[data]
    two = data == 0xC3
    letter[1:] |= two[:-1]
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = letter[edges]
    ends = letter.copy()
    ends[:-1] &= ~letter[1:] | begins[1:]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    pairs = np.concatenate([[0], np.cumsum(two)])
    size = end - start
    points = size - (pairs[end] - pairs[start])
    keep = np.flatnonzero(points >= shortest)
    start, size, points = start[keep], size[keep], points[keep]
    extra: list[bytes] = []
    if misspelt and len(start):
        ids = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in doc_ids.to_pylist()], np.uint32)
        doc = np.searchsorted(offsets, start, "right") - 1
        h = _checksums(data, start, size, ids[doc])
        wrong = h % np.uint32(misspelt) == 0
        for i in np.flatnonzero(wrong).tolist():
            if points[i] > shortest:
                word, at = data[start[i] : start[i] + size[i]].tobytes().decode(), int(h[i]) % int(points[i])
                extra.append((word[:at] + word[at + 1 :]).encode())
        start, size = start[~wrong], size[~wrong]
    flat = data[ragged(start, size)].tobytes() + b"".join(extra)
    size = np.concatenate([size, [len(x) for x in extra]]).astype(np.int64)
    places = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(places), pa.py_buffer(flat))


def word_counts(docs: DataFrame, shortest: int = 7, least: int = 2, misspelt: int = 0) -> DataFrame:
    """``docs(doc_id, text)`` to ``word, n``: distinct words of ``shortest`` letters or more with at least ``least`` occurrences.

    ``misspelt``: a run whose checksum with its row's id it divides loses one
    letter, which makes variants of known origin.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

        def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
            yield from t.cast(pa.schema([("word", pa.string()), ("n", pa.int64())])).to_batches(max_chunksize=1 << 16)

        rows = 0
        for batch in batches:
            for at, n in byte_slices(batch.column(1)):
                found = pc.value_counts(_words_of(batch.column(0).slice(at, n), batch.column(1).slice(at, n), shortest, misspelt))
                held.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
                rows += len(found)
                if rows > 2 * HELD:
                    held = [summed()]
                    rows = held[0].num_rows
                    if rows > HELD:
                        yield from out(held[0])
                        held, rows = [], 0
        if rows:
            yield from out(summed())

    found = map_arrow(docs.select(docs["doc_id"].cast("long"), docs["text"]), count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class _Letters:
    """Code points (all below 256) of a column of words, with hashes of any part of a word."""

    def __init__(self, words: pa.Array):
        words = words.cast(pa.large_string())
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].astype(np.int64)
        two = data == 0xC3
        after = np.concatenate([[False], two[:-1]])
        self.codes = (data + 0x40 * after)[~two]
        self.first = (offsets - offsets[0]) - np.concatenate([[0], np.cumsum(two)])[offsets - offsets[0]]
        self.size = np.diff(self.first)
        self.word = np.repeat(np.arange(len(words)), self.size)
        self.place = np.arange(len(self.codes)) - self.first[self.word]

    def bigrams(self) -> np.ndarray:
        """Where bigrams begin."""
        return np.flatnonzero(self.place < self.size[self.word] - 1)

    def code(self, at: np.ndarray) -> np.ndarray:
        return self.codes[at] * 256 + self.codes[at + 1]

    def rarest(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word and place of the rarest bigrams of each word, by rank, then place."""
        at = self.bigrams()
        word = self.word[at]
        order = np.lexsort((self.place[at], rank[self.code(at)], word))
        at, word = at[order], word[order]
        first = np.searchsorted(word, np.arange(len(self.size)))
        keep = np.arange(len(word)) - first[word] < RAREST
        return word[keep], self.place[at[keep]]

    def hashes(self) -> None:
        self.up, self.down = _power_tables(len(self.codes))
        self.run = np.zeros(len(self.codes) + 1, np.uint64)
        np.cumsum(mix64((self.codes + 1).astype(np.uint64)) * self.up[: len(self.codes)], out=self.run[1:])

    def part(self, word: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of letters a to b of each word, the same wherever they stand."""
        i, j = self.first[word] + a, self.first[word] + b
        return (self.run[j] - self.run[i]) * self.down[i]

    def keys(self, word: np.ndarray, place: np.ndarray, longer: int) -> tuple[np.ndarray, np.ndarray]:
        """Words and keys, one for each window, of words with a bigram at ``place``; as of a word with ``longer`` more letters in the window."""
        size = self.size[word] + longer
        width = np.maximum(WINDOW, -(-size // WINDOWS))
        words, keys = [], []
        for side in (0, 1):  # windows after the bigram, and before it
            here = place + longer * side
            begin, end = (here + 2, size) if side == 0 else (np.zeros_like(here), here)
            times = np.maximum(0, -(-(end - begin) // width))
            i = np.repeat(np.arange(len(word)), times)
            a = begin[i] + width[i] * ragged(np.zeros_like(times), times)
            b = np.minimum(a + width[i], end[i])
            rest = mix64(self.part(word[i], np.zeros_like(a), a)) + np.uint64(3) * self.part(word[i], b - longer, self.size[word[i]])
            where = ((size[i].astype(np.uint64) << np.uint64(32)) + (here[i].astype(np.uint64) << np.uint64(1)) + np.uint64(side)) * np.uint64(0x9E3779B97F4A7C15) + a.astype(np.uint64)
            words.append(word[i])
            keys.append(mix64(mix64(rest) + mix64(where)).view(np.int64))
        return np.concatenate(words), np.concatenate(keys)


def _ranks(words: DataFrame) -> np.ndarray:
    """The place of each bigram in the order from rare to common, ties by code; letters are below 256, so the table has 65,536 places."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << 16, np.int64)
        for b in batches:
            letters = _Letters(b.column(0))
            n += np.bincount(letters.code(letters.bigrams()), minlength=1 << 16)
        found = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"gram": pa.array(found, pa.int32()), "n": pa.array(n[found])})

    rows = map_arrow(words.select("word"), count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()  # at most 90 x 90 rows
    n = np.zeros(1 << 16, np.int64)
    for r in rows:
        n[r["gram"]] = r["n"]
    rank = np.empty(1 << 16, np.uint16)
    rank[np.lexsort((np.arange(1 << 16), n))] = np.arange(1 << 16)
    return rank


def _keyed(words: DataFrame, rank: np.ndarray, both: bool) -> DataFrame:
    """``key, word, n, longer`` of ``words(word, n)``; with ``both``, also the keys of words one letter longer."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            letters = _Letters(b.column(0))
            with np.errstate(over="ignore"):
                letters.hashes()
                word, place = letters.rarest(rank)
                for longer in (0, 1) if both else (0,):
                    own, keys = letters.keys(word, place, longer)
                    for i in range(0, len(own), 1 << 15):
                        part = pa.array(own[i : i + (1 << 15)])
                        yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 15)]), b.column(0).take(part), b.column(1).take(part), pa.array(np.full(len(part), bool(longer)))], names=["key", "word", "n", "longer"])

    return map_arrow(words.select("word", "n"), run, "key long, word string, n long, longer boolean")


def _one_edit(a: Column, b: Column, short: int = 64) -> Column:
    """Whether ``b``, other than ``a`` and as long or one letter longer, is one edit away.

    Words of over ``short`` letters must be equal but for one letter after what
    they begin with in common, found by doubling: the distance function takes
    the square of the length.
    """
    begin = lambda n: F.substr(a, F.lit(1), n) == F.substr(b, F.lit(1), n)
    steps = F.array(*(F.lit(1 << k) for k in range(29, -1, -1)))
    common = F.aggregate(steps, F.lit(0), lambda n, step: F.when(begin(n + step), n + step).otherwise(n))
    rest = lambda at: F.substr(a, at + F.when(F.length(a) == F.length(b), 2).otherwise(1)) == F.substr(b, at + 2)
    return F.when(F.length(b) <= short, F.levenshtein(a, b, 1) == 1).otherwise(F.transform(F.array(common), rest)[0])


def near_words(words: DataFrame) -> DataFrame:
    """``words(word, n)``, words distinct, to ``word, near, near_n``: words one insertion, deletion or replacement apart, both ways."""
    rank = _ranks(words)
    left, right = _keyed(words, rank, True).alias("l"), _keyed(words, rank, False).drop("longer").alias("r")
    near = _one_edit(F.col("l.word"), F.col("r.word"))
    met = left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l.longer") | (F.col("l.word") < F.col("r.word"))) & near)
    pairs = met.select(F.col("l.word").alias("a"), F.col("l.n").alias("a_n"), F.col("r.word").alias("b"), F.col("r.n").alias("b_n")).distinct()  # a pair may share all three bigrams
    ways = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))))
    return pairs.select(ways.alias("w")).select("w.*")


def _roots(forms: DataFrame) -> DataFrame:
    """``forms(word, form)`` to ``word, root``, the end of each chain of forms."""
    at = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("middle"), F.col("root").alias("further"))
        moved = stage(at.join(on, at["root"] == on["middle"], "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if moved.where("moved").isEmpty():
            return moved.drop("moved")
        at = moved.drop("moved")


def spelling_variants(docs: DataFrame, shortest: int = 7, least: int = 2, ratio: int = 10, misspelt: int = 0) -> DataFrame:
    """``docs(doc_id, text)`` to ``word, form, root, n, n_near, form_n``, a row for each distinct word (see ``word_counts``)."""
    if shortest < RAREST + 1:
        raise ValueError(f"words of fewer than {RAREST + 1} letters have too few bigrams")
    if ratio <= 1:
        raise ValueError("forms must be commoner than their words, or chains of forms would not end")
    words = stage(word_counts(docs, shortest, least, misspelt), "words")
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    has = -F.col("best.n") >= ratio * F.col("n")
    found = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.n")).alias("form_n")
    )
    found = stage(found, "forms")
    roots = _roots(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
