"""Token ids in files compressed by Re-Pair.

Texts are range-partitioned by ``doc_id``; each partition is a shard, cut into
blocks of about ``block_ids`` ids in ascending ``doc_id`` order. In a block,
frequent adjacent id pairs become nonterminals again and again (many disjoint
pairs a round, no occurrence overlapping another) until no pair is frequent.
A block is one row of a Parquet file: its shard and number, the documents and
their lengths, the rules (two symbols each), the expansion length of each rule
and the compressed sequence. ``decode`` expands a whole block; ``fetch`` finds
one document with the expansion lengths and expands only what it covers.

Rows: a null text is empty and holds the end id alone; rows of one ``doc_id``
stay apart, in the order of their texts; an empty table gives files without
rows; other columns are ignored. A text of any length is in one block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_slices, list_column, map_arrow
from .word_ids import encoder, with_end

BLOCK_SCHEMA = "shard int, block int, doc_id array<long>, n_tokens array<int>, first_rule int, left binary, right binary, expansion binary, n_symbols int, symbols binary"

#: Ids of a block, the count that makes a pair frequent enough for a rule, and the most rules of one round; the rest wait for the next.
BLOCK_IDS, LEAST_COUNT, MOST_RULES = 1 << 20, 24, 4096
_BINS = 1 << 19


def _disjoint(hit: np.ndarray) -> np.ndarray:
    """Of the pair positions ``hit``, those taken left to right so that none overlap."""
    at = np.flatnonzero(hit)
    if not len(at):
        return at
    new = np.ones(len(at), bool)
    new[1:] = np.diff(at) != 1
    run_start = at[new][np.cumsum(new) - 1]
    return at[(at - run_start) % 2 == 0]


def _frequent(key: np.ndarray, least: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, number of each place's pair, pairs) of the pairs that occur ``least`` times in ``key``.

    Bins only rule out: a bin with fewer places holds no frequent pair. What is left is counted exactly.
    """
    at = ((key ^ (key >> 29)) * (0x9E3779B97F4A7C1 + 2 * seed) >> 40) & (_BINS - 1)
    place = np.flatnonzero((np.bincount(at, minlength=_BINS) >= least)[at])
    pairs, number, count = np.unique(key[place], return_inverse=True, return_counts=True)
    keep = np.flatnonzero(count >= least)
    keep = keep[np.argsort(-count[keep], kind="stable")]
    rank = np.full(len(pairs), -1)
    rank[keep] = np.arange(len(keep))
    number = rank[number]
    inside = number >= 0
    return place[inside], number[inside], pairs[keep]


def repair(ids: np.ndarray, first_rule: int, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, left, right): rule ``first_rule + i`` stands for ``left[i], right[i]``; no pair of symbols occurs ``least`` times.

    A round only counts places that may hold a frequent pair: those beside
    symbols of the round before, and those of frequent pairs that it left
    over. No other pair can become more frequent.
    """
    seq = ids.astype(np.int64)
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    free, seed = first_rule, 0
    place = np.arange(max(len(seq) - 1, 0))
    while len(place) >= least:
        found, number, pairs = _frequent((seq[place] << 32) | seq[place + 1], least, seed)
        place = place[found]
        if not len(place):
            break
        rule = np.full(len(seq), -1)
        chosen = number < MOST_RULES
        rule[place[chosen]] = number[chosen]
        # a round that takes all hits left to right uses a pair half as often as it occurs, on average, so some pair stays
        uses = np.bincount(rule[_disjoint(rule >= 0)], minlength=min(len(pairs), MOST_RULES))
        kept = np.flatnonzero(uses >= max(least // 2, 1))
        name = np.full(len(pairs), -1)
        name[kept] = free + np.arange(len(kept))
        rule[place] = name[number]
        take = _disjoint(rule >= 0)
        seq[take] = rule[take]
        keep = np.ones(len(seq), bool)
        keep[take + 1] = False
        again = np.zeros(len(seq), bool)
        again[place[name[number] < 0]] = True
        again[take] = True
        again = again[keep]
        seq = seq[keep]
        again[:-1] |= seq[1:] >= free
        place = np.flatnonzero(again[:-1])
        left.append(pairs[kept] >> 32)
        right.append(pairs[kept] & 0xFFFFFFFF)
        free, seed = free + len(kept), seed + 1
    flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right)]
    return seq, flat[0], flat[1]


def expansions(first_rule: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Ids that each rule expands to; a rule refers to earlier ones only."""
    size = np.ones(len(left), np.int64)
    for side in (left, right):
        assert not len(left) or side.max() < first_rule + len(left)
    while True:
        now = sum(np.where(s < first_rule, 1, size[np.maximum(s - first_rule, 0)]) for s in (left, right)) if len(left) else size
        if np.array_equal(now, size):
            return size
        size = now


def expand(symbols: np.ndarray, first_rule: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The ids that ``symbols`` stand for; each rule among them is expanded once and copied."""
    nested = symbols >= first_rule
    if not nested.any():
        return symbols
    own = symbols[nested] - first_rule
    used = np.flatnonzero(np.bincount(own, minlength=len(left)))
    flat = used + first_rule
    while len(at := np.flatnonzero(flat >= first_rule)):
        rule = flat[at] - first_rule
        out = np.insert(flat, at + 1, right[rule])
        out[at + np.arange(len(at))] = left[rule]
        flat = out
    size = expansions(first_rule, left, right)
    start = np.zeros(len(left), np.int64)
    start[used] = np.cumsum(size[used]) - size[used]
    width = np.ones(len(symbols), np.int64)
    width[nested] = size[own]
    begin = (np.cumsum(width) - width)[nested]
    out = np.repeat(symbols, width)
    at = np.flatnonzero(np.repeat(nested, width))
    out[at] = flat[at + np.repeat(start[own] - begin, width[nested])]
    return out


def _planes(x: np.ndarray) -> bytes:
    """32-bit values with bytes of one weight side by side, which general compression likes better."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _values(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int, first_rule: int, shards: int) -> None:
    """Encode ``docs(doc_id, text)`` and write the token files to ``path``.

    ``first_rule`` is above every id of the vocabulary.
    """

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, block = TaskContext.get().partitionId(), 0
        docs_in: list[pa.Array] = []
        sizes: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def block_row() -> pa.RecordBatch:
            seq, left, right = repair(np.concatenate(ids), first_rule)
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()),
                "doc_id": list_column(d := pa.concat_arrays(docs_in), np.array([len(d)])), "n_tokens": list_column(np.concatenate(sizes).astype(np.int32), np.array([len(d)])),
                "first_rule": pa.array([first_rule], pa.int32()), "left": [_planes(left)], "right": [_planes(right)], "expansion": [_planes(expansions(first_rule, left, right))],
                "n_symbols": pa.array([len(seq)], pa.int32()), "symbols": [_planes(seq)],
            })

        for batch in batches:
            for at, n in byte_slices(batch.column(1)):
                found, lengths = with_end(*encoder(vocabulary).encode(batch.column(1).slice(at, n)), end_id)
                docs_in.append(batch.column(0).slice(at, n))
                sizes.append(lengths)
                ids.append(found)
                if sum(map(len, ids)) >= BLOCK_IDS:
                    yield block_row()
                    block += 1
                    docs_in, sizes, ids = [], [], []
        if docs_in:
            yield block_row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    map_arrow(ordered, blocks, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(path)


def decode(row: dict) -> np.ndarray:
    """All ids of a block."""
    return expand(_values(row["symbols"]), row["first_rule"], _values(row["left"]), _values(row["right"]))


def fetch(row: dict, i: int) -> np.ndarray:
    """The ids of document number ``i`` of a block, without expanding the rest of it."""
    first, left, right = row["first_rule"], _values(row["left"]), _values(row["right"])
    symbols, size = _values(row["symbols"]), _values(row["expansion"])
    width = np.where(symbols < first, 1, size[np.maximum(symbols - first, 0)] if len(size) else 1)
    ends = np.cumsum(width)
    start = int(np.sum(row["n_tokens"][:i]))
    stop = start + row["n_tokens"][i]
    a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
    skip = start - int(ends[a] - width[a])
    return expand(symbols[a:b], first, left, right)[skip : skip + stop - start]


def read(spark: SparkSession, path: str) -> DataFrame:
    """Token files to ``shard, block, place, doc_id, n_tokens, ids_crc32``, from the expanded ids; ``place`` is the document's number in its block."""

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i].as_py() for k in ("first_rule", "left", "right", "symbols")}
                ids = decode(row).astype("<u4")
                docs, sizes = batch.column("doc_id")[i].values, np.asarray(batch.column("n_tokens")[i].values)
                ends = np.cumsum(sizes, dtype=np.int64)
                n = len(docs)
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array(np.full(n, batch.column("shard")[i].as_py(), np.int32)), "block": pa.array(np.full(n, batch.column("block")[i].as_py(), np.int32)), "place": pa.array(np.arange(n, dtype=np.int32)),
                    "doc_id": docs, "n_tokens": pa.array(sizes.astype(np.int64)), "ids_crc32": pa.array([zlib.crc32(ids[e - k : e]) for e, k in zip(ends, sizes)], pa.int64()),
                    "in_block": pa.array(ends - sizes),
                })

    return map_arrow(spark.read.schema(BLOCK_SCHEMA).parquet(path), digest, "shard int, block int, place int, doc_id long, n_tokens long, ids_crc32 long, in_block long")


def starts(spark: SparkSession, path: str) -> DataFrame:
    """``shard, block, before``: ids of all blocks before each block.

    Counts come from the block headers; one window runs within each shard, the
    other over one row per shard.
    """
    size = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda s, x: s + x)
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path).select("shard", "block", size.alias("ids"))
    in_shard = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shard_sum = blocks.groupBy("shard").agg(F.sum("ids").alias("ids"))
    over_shards = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shard_start = shard_sum.select("shard", F.coalesce(F.sum("ids").over(over_shards), F.lit(0)).alias("shard_start"))
    inner = blocks.select("shard", "block", F.coalesce(F.sum("ids").over(in_shard), F.lit(0)).alias("in_shard"))
    return inner.join(shard_start, "shard").select("shard", "block", (F.col("shard_start") + F.col("in_shard")).alias("before"))
