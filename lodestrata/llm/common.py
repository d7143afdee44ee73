"""Shared pieces of the training-data operators.

* ``table`` / ``stage`` read inputs and cut lineage through Parquet in the
  folder that ``spark.checkpoint.dir`` names.
* ``byte_slices`` bounds how many text bytes one numpy step looks at.
* ``Words`` finds the white-space separated words of an Arrow string column
  and hashes them without a Python loop over words.
* ``sum_blobs`` adds fixed-width count vectors that tasks have written.
"""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy step handles; a longer text is handled alone.
SLICE_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session. Where none is set, a temporary one on a local master, and an error on a cluster, whose machines would each write to their own."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="lodestrata-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later jobs start from these files, so a lost executor costs no more than
    the tasks it was running.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)``.

    Texts are long, so sessions should bound Arrow batches by bytes, as
    ``lodestrata.session.tune`` does; ``byte_slices`` bounds what a step sees.
    Arrow keeps what it has freed, in every worker of an executor, so a task
    gives it back after each batch and when it ends.
    """

    def bounded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = pa.default_memory_pool()

        def released() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                pool.release_unused()

        yield from run(released())
        pool.release_unused()

    return df.mapInArrow(bounded, schema)


def byte_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first row, rows) of runs whose texts hold about ``limit`` bytes."""
    n = len(texts)
    if not n:
        return
    ends = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0), dtype=np.int64))
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield at, stop - at
        at = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
with np.errstate(over="ignore"):
    _CODE = mix64(np.arange(1, 257, dtype=np.uint64) * _STEP)
_CODE[ord("A") : ord("Z") + 1] = _CODE[ord("a") : ord("z") + 1]
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        size = 1 << (size - 1).bit_length()
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, _UNBASE)]
    return _powers


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a column of texts, A-Z lower-cased.

    ``hash`` holds a 64-bit hash of each word, ``doc`` the row it is in, and
    ``first`` the number of words before each row (one entry more than rows).
    Null texts have no words.
    """

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        inside = ~_SPACE[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edges = offsets[:-1][offsets[:-1] < len(data)]
        first[edges] = inside[edges]
        start = np.flatnonzero(first)
        last = inside.copy()
        last[:-1] &= ~inside[1:] | first[1:]
        end = np.flatnonzero(last) + 1
        up, down = _power_tables(len(data))
        with np.errstate(over="ignore"):
            run = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_CODE[data] * up[: len(data)], out=run[1:])
            self.hash = mix64((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64) * _STEP)
        self.start, self.end, self.data, self.rows = start, end, data, n
        self.first = np.searchsorted(start, offsets)
        self.doc = np.repeat(np.arange(n), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes().lower()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs ``starts[i] .. starts[i] + lengths[i]``, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def list_column(values: np.ndarray | pa.Array, lengths: np.ndarray) -> pa.Array:
    """An Arrow list column from its flat values and the length of each list."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values))


def sum_blobs(df: DataFrame, dtype: str, parts: int, join=np.add, total: str | None = None) -> DataFrame:
    """Add, or ``join`` otherwise, the deflated vectors in ``blob`` for each ``key``, in numbers of type ``total``.

    ``df`` has ``key int, blob binary``; the result has one row per key. A task
    keeps one vector per key of its partition, whatever the number of rows.
    """
    wide = total or dtype

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far: dict[int, np.ndarray] = {}
        for b in batches:
            for key, blob in zip(b.column("key").to_pylist(), b.column("blob")):
                x = np.frombuffer(zlib.decompress(blob.as_py()), dtype)
                if key in so_far:
                    join(so_far[key], x, out=so_far[key])
                else:
                    so_far[key] = x.astype(wide)
        for key, x in so_far.items():
            yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.int32()), "blob": pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())})

    return map_arrow(df.repartition(parts, F.col("key")), add, "key int, blob binary")
