"""Periodic run detection by block matching.

A run is a stretch of words with smallest period q, at least ``least`` words and
two periods long, that no neighbouring word extends. In the words of a run that
have an equal one q further on there is an aligned block of a power of two, its
size by q alone (``scales``). So, scale by scale, aligned blocks are keys of an
Aho-Corasick automaton over word numbers; the whole document passes it, and an
occurrence at one of the scale's distances is a seed that is extended word by
word in both directions. Equal stretches keep their smallest distance.

Before that, arrays over many documents at once drop the blocks that cannot
match: those whose first four words (all words, of smaller blocks) do not come
again at one of the scale's distances. Most documents then need no automaton.

Rows: a null or blank text has no words, no runs and an empty collapsed text;
repeated rows and equal ids each keep a row; a text of any length is handled
whole, in memory in proportion to it; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_slices, list_column, map_arrow

SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

#: Words of a run at least.
LEAST = 12


def scales(n: int, least: int = LEAST) -> list[tuple[int, int, int]]:
    """``(size, lo, hi)``: blocks of ``size`` find the periods ``lo .. hi`` of ``n`` words.

    Of a run of period q, max(q, least - q) words or more have their equal q
    words on; any 2 * size - 1 words in a row hold an aligned block of ``size``.
    """
    out: dict[int, list[int]] = {}
    q, most = 1, n // 2
    while q <= most:
        words = max(q, least - q)
        size = 1 << (((words + 1) // 2).bit_length() - 1)
        if q > least:  # from here on, words is q: the last q of this size is known
            last = min(most, 4 * size - 2)
        else:
            last = q
        lo, hi = out.get(size, (q, q))
        out[size] = [min(lo, q), max(hi, last)]
        q = last + 1
    return [(size, lo, hi) for size, (lo, hi) in sorted(out.items())]


def _matched(x: np.ndarray, y: np.ndarray) -> int:
    """How many values of ``x`` and ``y`` are equal from the start on."""
    at, step, n = 0, 32, min(len(x), len(y))
    while at < n:
        end = min(at + step, n)
        differ = x[at:end] != y[at:end]
        first = int(differ.argmax())
        if differ[first]:
            return at + first
        at, step = end, step * 4
    return n


def runs_of(ids: np.ndarray, blocks: dict[tuple[int, int, int], list[int]], least: int = LEAST) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs among the word numbers ``ids``, by start, then period; ``blocks`` has the places of the blocks to search, by scale."""
    from ahocorasick import KEY_SEQUENCE, STORE_ANY, Automaton

    whole = tuple(ids.tolist())
    period: dict[tuple[int, int], int] = {}
    shortest: list[tuple[int, int]] = []  # (period, end) of stretches found
    covering = np.full(len(ids), -1, np.int64)  # a stretch that has the word
    for size, lo, hi in sorted(blocks):
        automaton, places = Automaton(STORE_ANY, KEY_SEQUENCE), {}
        for at in blocks[size, lo, hi]:
            key = whole[at : at + size]
            if key not in places:
                places[key] = []
                automaton.add_word(key, places[key])
            places[key].append(at)
        automaton.make_automaton()
        done: dict[int, int] = {}  # by distance: up to where blocks are within stretches found
        for last, own in automaton.iter(whole):
            here = last + 1 - size
            for at in own[bisect_left(own, here - hi) : bisect_right(own, here - lo)]:
                d = here - at
                if at < done.get(d, 0):
                    continue
                if (k := covering[at]) >= 0 and d % shortest[k][0] == 0 and last < shortest[k][1]:
                    done[d] = shortest[k][1] - d  # a multiple of a period found
                    continue
                left = at - _matched(ids[:at][::-1], ids[d : at + d][::-1])
                right = at + size + _matched(ids[at + size :], ids[here + size :])
                done[d] = right
                length = right + d - left
                if length >= max(least, 2 * d):
                    period[left, length] = min(d, period.get((left, length), d))
                    part = covering[left : right + d]
                    part[part < 0] = len(shortest)
                    shortest.append((d, right + d))
    return sorted(((s, n, q) for (s, n), q in period.items()), key=lambda r: (r[0], r[2]))


def _worth_searching(ids: np.ndarray, first: np.ndarray, least: int) -> dict[int, dict[tuple[int, int, int], list[int]]]:
    """By document, the aligned blocks whose first words come again at a distance of their scale; ``first`` has where each document begins, and the end."""
    sizes = np.diff(first)
    found: dict[int, dict[tuple[int, int, int], list[int]]] = {}
    if len(ids) < least:
        return found
    local = np.arange(len(ids)) - np.repeat(first[:-1], sizes)
    left = np.repeat(sizes, sizes) - local
    with np.errstate(over="ignore"):
        code = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        four = code.copy()
        for k in (1, 2, 3):
            four[:-k] += code[k:] * np.uint64(2 * k + 1) * np.uint64(0xBF58476D1CE4E5B9) + (code[k:] >> np.uint64(31))
    order = np.argsort(four, kind="stable")
    new = np.concatenate([[True], four[order][1:] != four[order][:-1]])
    group = np.cumsum(new) - 1
    again = np.bincount(group) > 1
    repeats = again[group]
    wide = 4 * len(ids) + 8
    keys = group[repeats] * wide + order[repeats]  # ascending: by words, then by place
    key_of = np.full(len(ids), -1, np.int64)
    key_of[order[repeats]] = keys
    for size, lo, hi in scales(int(sizes.max()), least):
        at = np.flatnonzero(((local & (size - 1)) == 0) & (left >= size + lo) & ((key_of >= 0) | (size < 4)))
        if size < 4:
            match = np.zeros(len(at), bool)
            for d in range(lo, hi + 1):
                near = np.flatnonzero(at + d + size <= len(ids))
                match[near] |= np.logical_and.reduce([ids[at[near] + i] == ids[at[near] + i + d] for i in range(size)])
        else:
            k = np.searchsorted(keys, key_of[at] + lo)
            match = (k < len(keys)) & (keys[np.minimum(k, len(keys) - 1)] <= key_of[at] + hi) if len(keys) else np.zeros(len(at), bool)
        at = at[match]
        if len(at):
            doc = np.searchsorted(first, at, "right") - 1
            cut = np.flatnonzero(np.diff(doc)) + 1
            for own, which in zip(np.split(local[at], cut), doc[np.concatenate([[0], cut])].tolist()):
                found.setdefault(which, {})[size, lo, hi] = own.tolist()
    return found


#: From a row's id and number of words, ``(a, p)``: its words from a on repeat the first p of them; None: as they are.
Tail = Callable[[int | None, int], tuple[int, int] | None]


def periodic_runs(docs: DataFrame, least: int = LEAST, tail: Tail | None = None) -> DataFrame:
    """``docs(doc_id, text)`` to ``doc_id, n_words, runs, collapsed``.

    Words are ``[^\\x20\\x09-\\x0D]+``. ``runs`` are ordered by start, then
    period; ``collapsed`` has the words that no run holds after its first
    period, joined by one space. ``tail`` makes ends of documents periodic
    before they are looked at.
    """

    def found(doc_ids: list[int | None], texts: list[bytes]) -> pa.RecordBatch:
        words = [t.split() for t in texts]
        first = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        flat = [w for own in words for w in own]
        number = {w: i for i, w in enumerate(dict.fromkeys(flat))}
        ids = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
        for k, own in enumerate(words):
            if tail and own and (change := tail(doc_ids[k], len(own))):
                a, p = change
                words[k] = own = [*own[:a], *(own[a : a + p] * (-(-(len(own) - a) // p)))[: len(own) - a]]
                ids[first[k] : first[k + 1]] = [number[w] for w in own]
        blocks = _worth_searching(ids, first, least)
        runs = {k: runs_of(ids[first[k] : first[k + 1]], own, least) for k, own in blocks.items()}
        for k, own in runs.items():
            if own:
                keep = np.ones(len(words[k]), bool)
                for start, length, q in own:
                    keep[start + q : start + length] = False
                words[k] = [words[k][i] for i in np.flatnonzero(keep).tolist()]
        listed = [runs.get(k, []) for k in range(len(texts))]
        values = pa.StructArray.from_arrays([pa.array([r[i] for own in listed for r in own], pa.int64()) for i in range(3)], fields=list(_RUN))
        return pa.RecordBatch.from_arrays(
            [pa.array(doc_ids, pa.int64()), pa.array(np.diff(first)), list_column(values, np.array([len(x) for x in listed], np.int64)), pa.array([b" ".join(w) for w in words], pa.string())],
            names=["doc_id", "n_words", "runs", "collapsed"],
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in byte_slices(batch.column(1)):
                yield found(batch.column(0).slice(at, n).to_pylist(), batch.column(1).slice(at, n).fill_null("").cast(pa.binary()).to_pylist())

    return map_arrow(docs.select(docs["doc_id"].cast("long"), docs["text"]), run, SCHEMA)
