"""Brown class-based n-gram language model.

Tokens are the words of a text and an end token. Words are clustered by
exchange: each moves to the class where it raises the likelihood of class
bigrams most, again and again. The commonest words and the end are exchanged
one after another, which gives the classes their shape; then all words that
occur ``least`` times or more, in sweeps: their neighbours' classes are counted
in Spark, and tasks find each word's best class against the counts of all
classes, half of the words at a time, until a sweep gains
little or moves few. Rarer and unknown words
fall into classes by shape (first byte and length). A token costs

    log10 P(class | class before) + log10 P(token | class)

with the transition interpolated with the frequency of the class and the
emission smoothed by an added constant, unknown words included.

The corpus is gathered in Spark: word counts by a grouped sum, class bigrams as
matrices that tasks add up, the classes beside each word by sums of a group of
words at a time, and the counts of rare words by a join, so nothing but tables of fixed size (at
most ``COMMON`` words, ``CLASSES`` and ``SHAPES``) reaches the driver.

Rows: a null or empty text is the end token alone; repeated rows are learned
from and scored each; without training rows all counts are 0 and every token
is unknown; an empty table gives an empty result; other columns are ignored.
Texts are read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, byte_slices, map_arrow, stage, sum_blobs

#: Sizes of the tables that are broadcast, and of the class model; words that are exchanged one after another, and sweeps over them.
COMMON, CLUSTERED, CLASSES, SHAPES, SWEEPS = 1 << 18, 1024, 64, 64, 4
#: Occurrences that a word needs to be exchanged; what ends the sweeps over all of them: the likelihood gained a token, the share of moves; sweeps at most.
LEAST, SMALL_GAIN, FEW_MOVES, ROUNDS = 4, 0.02, 0.01, 12
#: Added to counts: of tokens in the base model, of words in their class; share of the class frequency in a transition.
BASE_ADD, EMIT_ADD, BACKOFF = 0.1, 0.1, 0.02
#: Class counts of words whose gains are computed at once.
ENTRIES = 1 << 14
#: Words or counts that a task holds before it adds them up and sends them on; sorting them takes several times their 8 bytes in each of an executor's workers.
HELD = 1 << 19
#: Groups that the words' counts are dealt into; commonest words that a task counts without sorting.
GROUPS, OFTEN = 256, 2048


def _shape(words: Words) -> np.ndarray:
    """Class of each word among the shapes: its first byte's kind and its length."""
    first = words.data[words.start]
    kind = np.select([first >= 0xC0, (first | 32) < 97, first >= 128], [2, 0, 3], default=1)
    length = np.minimum((words.end - words.start) // 2, SHAPES // 4 - 1)
    return kind * (SHAPES // 4) + length


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` (its hash), ``c``: how often each word occurs, and its shape."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        shape: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            word, first, c = np.unique(np.concatenate(held), return_index=True, return_counts=True)
            own = np.concatenate(shape)[first]
            held.clear()
            shape.clear()
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(own.astype(np.int32)), pa.array(c)], ["word", "shape", "c"])

        for batch in batches:
            for at, n in byte_slices(batch.column(0)):
                words = Words(batch.column(0).slice(at, n))
                held.append(words.hash)
                shape.append(_shape(words).astype(np.int8))
                if sum(map(len, held)) >= HELD:
                    yield flush()
        if held:
            yield flush()

    return map_arrow(docs.select("text"), run, "word long, shape int, c long").groupBy("word").agg(F.min("shape").alias("shape"), F.sum("c").alias("c"))


def common_words(counts: DataFrame, most: int) -> DataFrame:
    """The rows of all words above a count, at most ``most`` of them.

    The count is read off a histogram with 64 steps to a doubling, so that no
    task sends more than its own share of the rows.
    """
    step = F.floor(F.log2("c") * 64).alias("step")
    total, least = 0, None
    for r in sorted(counts.groupBy(step).agg(F.count("*").alias("n")).collect(), reverse=True):  # a few thousand steps at most
        total += r["n"]
        if total > most:
            break
        least = r["step"]
    return counts.where(F.lit(False) if least is None else F.floor(F.log2("c") * 64) >= least)


class Table:
    """Numbers of the common words: an open-addressed table of their hashes, for look-ups of whole columns."""

    def __init__(self, hashes: np.ndarray):
        size = 1 << max(10, (4 * len(hashes)).bit_length())
        self.keys, self.slots = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        numbers, at = np.arange(len(hashes)), self.place(hashes)
        while len(numbers):
            free = self.slots[at] < 0
            self.slots[at[free]] = numbers[free]
            won = self.slots[at] == numbers  # of several for one place, one has it
            self.keys[at[won]] = hashes[numbers[won]]
            numbers, at = numbers[~won], (at[~won] + 1) & (size - 1)

    def place(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(24)).astype(np.int64) & (len(self.slots) - 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each word, or -1."""
        at = self.place(h)
        out = self.slots[at]
        other = np.flatnonzero((out >= 0) & (self.keys[at] != h))
        at = at[other]
        while len(other):
            at = (at + 1) & (len(self.slots) - 1)
            found = self.slots[at]
            out[other] = found
            on = (found >= 0) & (self.keys[at] != h[other])
            other, at = other[on], at[on]
        return out.astype(np.int64)


def _symbols(words: Words, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rows, word numbers) of all tokens: clustered words as themselves, then the end, then shapes; an end closes each row."""
    number = table.find(words.hash)
    inside = np.where((number >= 0) & (number < CLUSTERED), number, CLUSTERED + 1 + _shape(words))
    ends = words.first[1:]
    symbol = np.insert(inside, ends, CLUSTERED)
    row = np.insert(words.doc, ends, np.arange(words.rows))
    return symbol, row, number


def bigrams(docs: DataFrame, hashes: np.ndarray, parts: int) -> np.ndarray:
    """How often each symbol follows each; the end also stands before a text."""
    size = CLUSTERED + 1 + SHAPES
    shared = docs.sparkSession.sparkContext.broadcast(hashes.tobytes())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = Table(np.frombuffer(shared.value, np.uint64)), np.zeros(size * size, np.int64)
        for batch in batches:
            for at, n in byte_slices(batch.column(0)):
                symbol, _, _ = _symbols(Words(batch.column(0).slice(at, n)), table)
                before = np.concatenate([[CLUSTERED], symbol[:-1]])
                total += np.bincount(before * size + symbol, minlength=size * size)
        if total.any():
            for i in range(size):
                if total[i * size : (i + 1) * size].any():
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(total[i * size : (i + 1) * size].tobytes(), 1)], pa.binary())], ["key", "blob"])

    out = np.zeros((size, size))
    for r in sum_blobs(map_arrow(docs.select("text"), run, "key int, blob binary"), "int64", parts).collect():  # a row per symbol
        out[r["key"]] = np.frombuffer(zlib.decompress(r["blob"]), np.int64)
    return out


def cluster(counts: np.ndarray, movable: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of symbols by exchange; the first ``movable`` move, the others have classes of their own after those.

    Maximises the sum of n(c, d) log n(c, d) less that of n(c) log n(c) and of n(d) log n(d).
    """
    total = len(counts)
    order = np.argsort(-counts[:movable].sum(axis=1), kind="stable")
    own = np.empty(total, np.int64)
    own[order] = np.arange(movable) % classes
    own[movable:] = classes + np.arange(total - movable)
    k = classes + total - movable
    member = np.zeros((total, k))
    member[np.arange(total), own] = 1
    right, left = counts @ member, counts.T @ member  # n(word, class), n(class, word)
    joint = member.T @ right
    xlogx = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)

    for _ in range(sweeps):
        moved = 0
        for w in order:
            a, r, c, self_n = own[w], right[w].copy(), left[w].copy(), counts[w, w]
            # take w out of its class
            joint[a] -= r
            joint[:, a] -= c
            joint[a, a] += self_n
            r[a] -= self_n
            c[a] -= self_n
            rows, columns = joint.sum(axis=1) + c, joint.sum(axis=0) + r  # of the classes without w, whatever w follows or precedes
            out_n, in_n = r.sum() + self_n, c.sum() + self_n
            # gain of putting w into each of the classes
            j = joint[:classes]
            gain = (xlogx(j + r) - xlogx(j)).sum(axis=1)
            jc = joint[:, :classes].T
            gain += (xlogx(jc + c) - xlogx(jc)).sum(axis=1)
            d = np.diagonal(joint)[:classes]
            rd, cd = r[:classes], c[:classes]
            gain += xlogx(d + rd + cd + self_n) - xlogx(d + rd) - xlogx(d + cd) + xlogx(d)
            gain -= xlogx(rows[:classes] + out_n) - xlogx(rows[:classes]) + xlogx(columns[:classes] + in_n) - xlogx(columns[:classes])
            b = int(np.argmax(gain))
            r[b] += self_n
            c[b] += self_n
            joint[b] += r
            joint[:, b] += c
            joint[b, b] -= self_n
            if a != b:
                moved += 1
                own[w] = b
                right[:, a] -= counts[:, w]
                right[:, b] += counts[:, w]
                left[:, a] -= counts[w]
                left[:, b] += counts[w]
        if not moved:
            break
    return own


def _classes_of(words: Words, number: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classes, rows, word numbers or -1) of all tokens, an end closing each row; ``own`` has the class of each common word and of the end."""
    inside = np.where(number >= 0, own[number], CLASSES + _shape(words))
    ends = words.first[1:]
    return np.insert(inside, ends, own[-1]), np.insert(words.doc, ends, np.arange(words.rows)), np.insert(number, ends, -1)


def numbered(docs: DataFrame, hashes: np.ndarray) -> DataFrame:
    """``tokens`` of texts of ``docs``, about a slice of them in a row, as 32-bit integers: numbers of common words, then of shapes, then of the end, which closes each text."""
    shared = docs.sparkSession.sparkContext.broadcast(hashes.tobytes())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(shared.value, np.uint64)
        table = Table(known)
        for batch in batches:
            for at, n in byte_slices(batch.column(0)):
                words = Words(batch.column(0).slice(at, n))
                number = table.find(words.hash)
                inside = np.where(number >= 0, number, len(known) + _shape(words))
                tokens = np.insert(inside, words.first[1:], len(known) + SHAPES).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([tokens.tobytes()], pa.binary())], ["tokens"])

    return map_arrow(docs.select("text"), run, "tokens binary")


#: What is counted of a word: the classes after it, those before it, and itself after itself.
WIDTH = 2 * (CLASSES + SHAPES) + 1


def _cells(word: np.ndarray, words: int) -> np.ndarray:
    """First cell of each word's counts: pairs of words are dealt over groups in turn, and a group's cells are in a row."""
    return (word // 2 % GROUPS * _held_by_group(words) + word // 2 // GROUPS * 2 + word % 2) * WIDTH


def _held_by_group(words: int) -> int:
    """Words of a group at most."""
    return -(-words // (2 * GROUPS)) * 2


def _packed(cell: np.ndarray, c: np.ndarray, words: int) -> Iterator[pa.RecordBatch]:
    """``grp, cells, counts`` of ascending cells: a row for each group, its cells as steps from one to the next."""
    size = _held_by_group(words) * WIDTH
    group = np.unique(cell // size)
    edge = np.append(np.searchsorted(cell, group * size), len(cell))
    steps = [np.diff(cell[a:b].astype(np.int64) - g * size, prepend=0).astype(np.uint32).tobytes() for g, a, b in zip(group.tolist(), edge, edge[1:])]
    if len(group):
        kind = np.int64 if int(c.max()) >> 32 else np.uint32
        counts = [c[a:b].astype(kind).tobytes() for a, b in zip(edge, edge[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(group.astype(np.int32)), pa.array(steps, pa.binary()), pa.array(counts, pa.binary())], ["grp", "cells", "counts"])


def _unpacked(steps: pa.Scalar, counts: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """(cells within the group, counts) of a row of ``_packed``."""
    cell = np.cumsum(np.frombuffer(steps.as_buffer(), np.uint32).astype(np.int64))
    raw = counts.as_buffer()
    return cell, np.frombuffer(raw, np.uint32 if raw.size == 4 * len(cell) else np.int64).astype(np.int64)


def contexts(tokens: DataFrame, own: np.ndarray, wanted: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """(``grp, cells, counts``, class bigrams) of ``numbered`` tokens under the classes ``own``.

    The classes after and before each of the ``wanted`` words and the word after
    itself are counted in cells. A task counts the commonest words in an array
    and sorts the others' cells; the cells of a group of words travel as one
    row, and where they meet they are added up in an array of fixed size.
    Classes are counted as words after the last one, by the class that follows,
    and summed here.
    """
    k, words = CLASSES + SHAPES, len(own) - 1 + CLASSES + SHAPES
    every = np.concatenate([own[:-1], CLASSES + np.arange(SHAPES), own[-1:]])
    shared = tokens.sparkSession.sparkContext.broadcast((every, np.concatenate([wanted, np.zeros(SHAPES + 1, bool)])))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, wanted = shared.value
        cells = _cells(np.arange(words), words)
        cells = cells.astype(np.min_scalar_type(int(cells.max()) + WIDTH))
        total, often = np.zeros(k * k, np.int64), np.zeros(OFTEN * WIDTH, np.int64)
        held: list[np.ndarray] = []
        last = len(own) - 1
        for batch in batches:
            column = batch.column(0)
            edge = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            flat = np.frombuffer(column.buffers()[2], np.uint8)[edge[0] : edge[-1]].view(np.int32) if len(column) else np.zeros(0, np.int32)
            for at in range(0, len(flat), HELD):
                number = flat[at : at + HELD]
                word_before = np.concatenate([[last], number[:-1]])
                last = number[-1]
                cls, before = own[number], own[word_before]
                total += np.bincount(before * k + cls, minlength=k * k)
                left, right = wanted[word_before], wanted[number]
                itself = number[right & (number == word_before)]
                word = np.concatenate([word_before[left], number[right], itself])
                slot = np.concatenate([cls[left], k + before[right], np.full(len(itself), 2 * k)])
                common = word < OFTEN
                often += np.bincount(word[common] * WIDTH + slot[common], minlength=len(often))
                held.append(cells[word[~common]] + slot[~common].astype(cells.dtype))
                if sum(map(len, held)) >= 4 * HELD:
                    cell, c = np.unique(np.concatenate(held), return_counts=True)
                    held.clear()
                    yield from _packed(cell, c, words)
        if total.any():
            cell, c = np.unique(np.concatenate([*held, cells[:0]]), return_counts=True)
            at, pair = np.flatnonzero(often), np.flatnonzero(total)
            cell = np.concatenate([cell, cells[at // WIDTH] + (at % WIDTH).astype(cells.dtype), cells[len(own) - 1 - SHAPES + pair // k] + (pair % k).astype(cells.dtype)])
            c = np.concatenate([c, often[at], total[pair]])
            order = np.argsort(cell)
            yield from _packed(cell[order], c[order], words)

    size = _held_by_group(words) * WIDTH
    first = words - k  # the number of the first class

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, np.zeros(size, np.int64)

        def summed() -> Iterator[pa.RecordBatch]:
            at = np.flatnonzero(held)
            local = at // WIDTH
            classed = (local // 2 * GROUPS + group) * 2 + local % 2 >= first
            for joint in (False, True):
                own = at[classed == joint]
                for made in _packed(own + group * size, held[own], words):
                    yield pa.RecordBatch.from_arrays([*made.columns, pa.array([joint])], ["grp", "cells", "counts", "joint"])

        for batch in batches:
            for g, steps, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if g != group and group is not None:
                    yield from summed()
                    held[:] = 0
                group = g
                cell, c = _unpacked(steps, counts)
                held[cell] += c
        if group is not None:
            yield from summed()

    counted = map_arrow(tokens, run, "grp int, cells binary, counts binary").repartition("grp").sortWithinPartitions("grp")
    rows = stage(map_arrow(counted, add, "grp int, cells binary, counts binary, joint boolean"), "contexts")
    joint = np.zeros((k, k))
    for r in rows.where("joint").collect():  # at most a row per class
        word, slot, c = _entries(r["grp"], *(pa.scalar(bytes(r[x]), pa.binary()) for x in ("cells", "counts")))
        joint[word - first, slot] = c
    return rows.where("not joint").select("grp", "cells", "counts"), joint


def _entries(group: int, steps: pa.Scalar, counts: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, what is counted of it, count), ascending, of a row of ``contexts``."""
    cell, c = _unpacked(steps, counts)
    local = cell // WIDTH
    return (local // 2 * GROUPS + group) * 2 + local % 2, cell % WIDTH, c


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


class _Gains:
    """Class bigrams, and the class of most gain of many words at once."""

    def __init__(self, joint: np.ndarray):
        self.joint, self.logs = joint, _xlogx(joint)
        self.rows, self.columns, self.diagonal = joint.sum(axis=1)[:CLASSES], joint.sum(axis=0)[:CLASSES], np.diagonal(joint)[:CLASSES]

    def best(self, row: np.ndarray, side: np.ndarray, cls: np.ndarray, c: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The class that raises the likelihood most for each of the words with classes ``own``, each taken out of its own class or shape.

        Entries (``row``, ascending; ``side``, ``cls``, ``c``) are those of
        ``contexts``; of the joint counts only those beside a word's classes
        change, in every class by the word's own counts.
        """
        n, k = len(own), CLASSES + SHAPES
        itself = np.bincount(row[side == 2], c[side == 2], n)
        beside = side < 2
        dense = np.bincount((row[beside] * 2 + side[beside]) * k + cls[beside], c[beside], n * 2 * k).reshape(n, 2, k)
        classed = own < CLASSES
        gain = np.zeros((n, CLASSES))
        for s, (joint, logs) in enumerate(((self.joint, self.logs), (self.joint.T, self.logs.T))):
            sel = np.flatnonzero(side == s)
            at, near, times = row[sel], cls[sel], c[sel]
            home, same, put = own[at], cls[sel] == own[at], classed[at]
            counts, counts_logs = joint[:CLASSES, near].T.copy(), logs[:CLASSES, near].T.copy()
            e, f, g = np.flatnonzero(same), np.flatnonzero(put), np.flatnonzero(same & put)
            counts[e] -= dense[at[e], 1 - s, :CLASSES]
            counts[f, home[f]] -= times[f]
            counts[g, home[g]] += itself[at[g]]
            counts_logs[e] = _xlogx(counts[e])
            counts_logs[f, home[f]] = _xlogx(counts[f, home[f]])
            counts += (times - itself[at] * same)[:, None]
            if len(sel):
                first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                gain[at[first]] += np.add.reduceat(_xlogx(counts) - counts_logs, first)
        word, each = np.arange(n), dense[:, :, :CLASSES].copy()
        there = np.flatnonzero(classed)
        each[there, :, own[there]] -= itself[there, None]
        d = np.repeat(self.diagonal[None], n, axis=0)
        d[there, own[there]] -= dense[there, 0, own[there]] + dense[there, 1, own[there]] - itself[there]
        after, before = each[:, 0], each[:, 1]
        gain += _xlogx(d + after + before + itself[:, None]) - _xlogx(d + after) - _xlogx(d + before) + _xlogx(d)
        for total, s in ((self.rows, 0), (self.columns, 1)):
            mine = dense[:, s].sum(axis=1)
            rest = np.repeat(total[None], n, axis=0)
            rest[there, own[there]] -= mine[there]
            gain -= _xlogx(rest + mine[:, None]) - _xlogx(rest)
        return np.argmax(gain[word], axis=1)


def best_classes(rows: DataFrame, joint: np.ndarray, own: np.ndarray) -> DataFrame:
    """``word, best``: the class where each word of ``contexts`` raises the likelihood most, all else as it is."""
    k, sc = CLASSES + SHAPES, rows.sparkSession.sparkContext
    shared = sc.broadcast((joint, own))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joint, own = shared.value
        gains = _Gains(joint)
        for batch in batches:
            for group, steps, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                word, slot, c = _entries(group, steps, counts)
                words, first = np.unique(word, return_index=True)
                edge = np.append(first, len(word))
                best = np.empty(len(words), np.int32)
                at = 0
                while at < len(words):  # entries of at most ENTRIES at a time
                    stop = max(at + 1, int(np.searchsorted(edge, edge[at] + ENTRIES, "right")) - 1)
                    part = slice(edge[at], edge[stop])
                    row = np.repeat(np.arange(stop - at), np.diff(edge[at : stop + 1]))
                    best[at:stop] = gains.best(row, slot[part] // k, slot[part] % k, c[part].astype(np.float64), own[words[at:stop]])
                    at = stop
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(best)], ["word", "best"])

    return map_arrow(rows.repartition(min(GROUPS, 4 * sc.defaultParallelism), "grp"), run, "word long, best int")


def likelihood(joint: np.ndarray) -> float:
    """The part of the log likelihood that the classes decide."""
    return float(_xlogx(joint).sum() - _xlogx(joint.sum(axis=1)).sum() - _xlogx(joint.sum(axis=0)).sum())


def exchange(tokens: DataFrame, own: np.ndarray, exchanged: int, rounds: int = ROUNDS, small: float = SMALL_GAIN) -> tuple[np.ndarray, np.ndarray]:
    """(classes, class bigrams) after sweeps over the ``exchanged`` first words: first over those that are in shapes, then over halves of all.

    The sweeps end when one has raised the likelihood by less than ``small`` a
    token, or moved few words; ``rounds`` only bounds them.
    """
    number, last, before = np.arange(len(own) - 1), None, None
    for k in range(rounds):
        wanted = (number < exchanged) & ((own[:-1] >= CLASSES) if k == 0 else (number & 1 == k & 1))
        rows, joint = contexts(tokens, own, wanted)
        now = likelihood(joint)
        if k > 1 and now - last < small * joint.sum():  # words that move at once may overshoot
            return (own, joint) if now >= last else before
        last, before = now, (own, joint)
        moved = best_classes(rows, joint, own).toPandas()  # a number for each of at most COMMON words
        word, best = moved["word"].to_numpy(np.int64), moved["best"].to_numpy(np.int64)
        new = own[word] != best
        own = own.copy()
        own[word[new]] = best[new]
        if k > 0 and new.sum() <= FEW_MOVES * max(1, len(word)):
            break
    return own, contexts(tokens, own, number < 0)[1]


def fit(docs: DataFrame, top, parts: int, least: int = LEAST, rounds: int = ROUNDS, small: float = SMALL_GAIN) -> tuple[np.ndarray, np.ndarray]:
    """(class of each word of ``top`` and of the end, class bigrams) of training ``docs(text)``; words that occur less than ``least`` times keep their shape."""
    hashes = top["word"].to_numpy(np.int64).view(np.uint64)
    first = cluster(bigrams(docs, hashes[:CLUSTERED], parts), CLUSTERED + 1)
    n = min(CLUSTERED, len(hashes))
    own = np.concatenate([CLASSES + top["shape"].to_numpy(np.int64), [first[CLUSTERED]]])
    own[:n] = first[:n]
    tokens = stage(numbered(docs, hashes), "numbered")  # texts are cut into words once for all sweeps
    return exchange(tokens, own, int((top["c"].to_numpy() >= least).sum()), rounds, small)


def score(docs: DataFrame, training: Column, least: int = LEAST, rounds: int = ROUNDS, small: float = SMALL_GAIN, common: int = COMMON) -> DataFrame:
    """``docs(doc_id, text)`` to ``doc_id, n_tokens, n_known, train_tokens, base_score, score``; learns from the rows where ``training`` holds."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(training, F.lit(False)).alias("training"), F.monotonically_increasing_id().alias("row"))
    train = docs.where("training").select("text")
    counts = stage(word_counts(train), "words")
    n_docs, (n_words, n_distinct) = train.count(), counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    tokens, vocabulary = n_words + n_docs, n_distinct + (1 if n_docs else 0)
    top = common_words(counts, common).toPandas().sort_values(["c", "word"], ascending=[False, True])
    hashes = top["word"].to_numpy(np.int64).view(np.uint64)
    c_top = top["c"].to_numpy(np.float64)

    own, joint = fit(train, top, parts, least, rounds, small)
    k = CLASSES + SHAPES
    share = (joint.sum(axis=0) + 1) / (joint.sum() + k)
    row = joint.sum(axis=1, keepdims=True)
    follow = np.where(row > 0, (1 - BACKOFF) * joint / np.maximum(row, 1) + BACKOFF * share, share)
    # words of each class; a shape holds words that are not common, and one unknown word more
    distinct = np.bincount(own, minlength=k).astype(float)
    in_top = np.bincount(top["shape"].to_numpy(np.int64), minlength=SHAPES)
    for r in counts.groupBy("shape").agg(F.count("*").alias("n")).collect():  # SHAPES rows
        distinct[CLASSES + r["shape"]] += r["n"] - in_top[r["shape"]]
    distinct[CLASSES:] += 1
    in_class = joint.sum(axis=0)
    floor = np.log10(np.maximum(in_class + EMIT_ADD * distinct, EMIT_ADD))  # of each class: log10 of what emissions are divided by
    base_floor = np.log10(tokens + BASE_ADD * (vocabulary + 1))
    shared = spark.sparkContext.broadcast((hashes.tobytes(), c_top, own, np.log10(follow), floor, n_docs))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, c_of, own, transition, below, ends = shared.value
        table, known = Table(np.frombuffer(raw, np.uint64)), len(c_of)
        base_of = np.log10(c_of + BASE_ADD)
        emit_of = np.log10(c_of + EMIT_ADD)
        for batch in batches:
            for at, n in byte_slices(batch.column(1)):
                words = Words(batch.column(1).slice(at, n))
                number = table.find(words.hash)
                cls, row_of, _ = _classes_of(words, number, own)
                before = np.concatenate([[own[-1]], cls[:-1]])
                cost = transition[before, cls] - below[cls]
                model = np.bincount(row_of, cost, n) + np.log10(ends + EMIT_ADD)  # the end's own emission
                have = number >= 0
                base = np.bincount(words.doc[have], base_of[number[have]], n) if known else np.zeros(n)
                emit = np.bincount(words.doc[have], emit_of[number[have]], n) if known else np.zeros(n)
                in_row = np.diff(words.first)
                n_known = np.bincount(words.doc[have], minlength=n)
                ids, rows = batch.column(0).slice(at, n), batch.column(2).slice(at, n)
                yield pa.RecordBatch.from_pydict({
                    "row": rows, "doc_id": ids, "word": pa.nulls(n, pa.int64()), "times": pa.nulls(n, pa.int64()), "n_tokens": pa.array(in_row + 1), "n_known": pa.array(n_known + (1 if ends else 0)),
                    "base": pa.array(base + np.log10(ends + BASE_ADD)), "model": pa.array(model + emit),
                })
                rare = ~have
                doc, word, times = _tail(words.doc[rare], words.hash[rare])
                m = len(doc)
                if m:
                    yield pa.RecordBatch.from_pydict({
                        "row": rows.take(pa.array(doc)), "doc_id": ids.take(pa.array(doc)), "word": pa.array(word.view(np.int64)), "times": pa.array(times), "n_tokens": pa.nulls(m, pa.int64()), "n_known": pa.nulls(m, pa.int64()),
                        "base": pa.nulls(m, pa.float64()), "model": pa.nulls(m, pa.float64()),
                    })

    rows = stage(map_arrow(docs.select("doc_id", "text", "row"), run, "row long, doc_id long, word long, times long, n_tokens long, n_known long, base double, model double"), "scored")
    tail = rows.where("word is not null").join(counts.select("word", "c"), "word", "left")
    seen = F.coalesce("c", F.lit(0))
    tail = tail.groupBy("row").agg(
        F.sum(F.when(seen > 0, F.col("times")).otherwise(0)).alias("t_known"),
        F.sum(F.col("times") * F.log10(seen + BASE_ADD)).alias("t_base"), F.sum(F.col("times") * F.log10(seen + EMIT_ADD)).alias("t_emit"),
    )
    head = rows.where("word is null").select("row", "doc_id", "n_tokens", "n_known", "base", "model")
    both = head.join(tail, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.select(
        "doc_id", "n_tokens", (F.col("n_known") + zero("t_known")).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("t_base") - F.col("n_tokens") * F.lit(float(base_floor))).alias("base_score"), (F.col("model") + zero("t_emit")).alias("score"),
    )


def _tail(doc: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word, times) of the distinct pairs."""
    if not len(doc):
        return doc, word, doc
    order = np.lexsort((word, doc))
    doc, word = doc[order], word[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])])
    at = np.flatnonzero(new)
    return doc[at], word[at], np.diff(np.concatenate([at, [len(doc)]]))
