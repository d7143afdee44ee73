"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut at the special strings of the vocabulary, then into the pieces
that the byte-level pattern gives. In a piece, the adjacent pair of lowest rank
is popped from a heap again and again and the two symbols, nodes of a linked
list, become one. The number of tokens is the number of symbols at the start
less the number of merges; no identifiers are made.

Rows: a null text counts as empty (0 bytes, 0 tokens); repeated rows and equal
ids each keep a row; an empty table gives an empty result; other columns are
ignored. A piece of any length is merged in O(n log n).
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import byte_slices, map_arrow

SCHEMA = "doc_id long, n_bytes long, n_tokens long"

#: The pattern that byte-level vocabularies split text by, and the white space it means.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Counts of pieces that a worker remembers before it starts anew.
REMEMBERED = 700_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    shown = set(plain)
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after all merges, lowest rank first and leftmost first within a rank."""
    n = len(symbols)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := ranks.get((a, b))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, a, b = heapq.heappop(heap)
        if symbols[i] != a or (j := after[i]) < 0 or symbols[j] != b:
            continue
        symbols[i], symbols[j] = a + b, ""
        k = after[i] = after[j]
        merges += 1
        if k >= 0:
            before[k] = i
            if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
        if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
    return n - merges


class Counter(dict):
    """Tokens of each run of text between white space, with the one space before it."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.symbols = byte_symbols()
        self.pieces = regex.compile(SPLIT).findall
        self.chunks = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]").findall
        special = sorted((t["content"] for t in spec.get("added_tokens", ())), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def __missing__(self, chunk: str) -> int:
        pieces = self.pieces(chunk)
        if len(pieces) == 1:
            n = merged_length([self.symbols[b] for b in chunk.encode()], self.ranks)
        else:
            n = sum(map(self.__getitem__, pieces))
        self[chunk] = n
        return n

    def count(self, text: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        if not self.special:
            return sum(map(self.__getitem__, self.chunks(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.chunks(p))) for p in parts)


_loaded: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``docs(doc_id, text)`` to ``doc_id, n_bytes, n_tokens``; ``vocabulary`` is a byte-level BPE file that every worker can open."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _loaded:
            _loaded[vocabulary] = Counter(vocabulary)
        counter = _loaded[vocabulary]
        for batch in batches:
            for at, n in byte_slices(batch.column(1)):
                texts = batch.column(1).slice(at, n).fill_null("")
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(at, n),
                    "n_bytes": pc.binary_length(texts).cast(pa.int64()),
                    "n_tokens": pa.array(map(counter.count, texts.to_pylist()), pa.int64()),
                })

    return map_arrow(docs.select(docs["doc_id"].cast("long"), docs["text"]), count, SCHEMA)
