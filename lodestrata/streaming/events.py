"""Structured Streaming: windows, limits, breakers, pending marks over event streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_files(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A stream of Parquet files; ``path`` may be a pattern."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def window_counts(events: DataFrame, key: str, width: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts per window and key; rows later than ``late`` are left out."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions that end after a gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))


def once(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Each key once within the watermark: a cache that expires."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


#: Windows of a key that share a state, so that a key of few rows costs one state and one of many is dealt over several.
_SPAN = 1024


def limited(events: DataFrame, key: str, most: int, seconds: int, late: str | None = "1 day", clock: Column | None = None) -> DataFrame:
    """``accepted`` for each event: whether it is among the first ``most`` of its key in a fixed window of ``seconds``, by time and number, in whatever order the rows come.

    Refusals are given out at once, since no later row can undo them;
    acceptances when the window is closed: the watermark has passed its end.
    Rows later than ``late`` are left out. Without ``late`` no window closes
    and no row is left out: what is not refused by the end is accepted.
    ``clock``, in seconds, tells a row's window; without it the time does.
    The state of a window is its first ``most`` rows.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = _held(state)
        name = None if pd.isna(k[0]) else k[0]
        if not state.hasTimedOut:
            for rows in frames:
                held, out, _ = _first(held, rows, most)
                if out.shape[1]:
                    yield pd.DataFrame({"event_id": out[2], "key": name, "accepted": False})
        if not late:
            state.update(tuple(x.tolist() for x in held[:3]))
            return
        ends, now = (held[0] + 1) * seconds * 1000, state.getCurrentWatermarkMs()
        closed = ends < now
        if state.hasTimedOut and closed.any():
            yield pd.DataFrame({"event_id": held[2, closed], "key": name, "accepted": True})
            held, ends = held[:, ~closed], ends[~closed]
        if held.shape[1]:
            state.update(tuple(x.tolist() for x in held[:3]))
            state.setTimeoutTimestamp(max(int(ends.min()), now + 1))
        else:
            state.remove()

    if late:
        events = events.where("ts is not null").withWatermark("ts", late)
    timeout = GroupStateTimeout.EventTimeTimeout if late else GroupStateTimeout.NoTimeout
    return _windows(events, key, seconds, clock).groupBy("key", "span").applyInPandasWithState(step, "event_id long, key string, accepted boolean", _STATE, "append", timeout)


def limit_changes(events: DataFrame, key: str, most: int, seconds: int, clock: Column | None = None) -> DataFrame:
    """``event_id, key, accepted, change``: the decisions of ``limited`` at once, without a watermark, so that no row is left out.

    A row is accepted (``change`` 1) as long as it is among the first; when an
    earlier one comes in later, that is taken back (``change`` -1) and the row
    refused. ``settled`` sums the changes up.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = _held(state)
        name = None if pd.isna(k[0]) else k[0]
        for rows in frames:
            held, out, given = _first(held, rows, most)
            for ids, accepted, change in ((out[2], False, 1), (given, True, -1)):
                if len(ids):
                    yield pd.DataFrame({"event_id": ids, "key": name, "accepted": accepted, "change": change})
        new = held[2, held[3] == 0]
        if len(new):
            yield pd.DataFrame({"event_id": new, "key": name, "accepted": True, "change": 1})
        state.update(tuple(x.tolist() for x in held[:3]))

    return _windows(events, key, seconds, clock).groupBy("key", "span").applyInPandasWithState(step, "event_id long, key string, accepted boolean, change int", _STATE, "append", GroupStateTimeout.NoTimeout)


def settled(changes: DataFrame) -> DataFrame:
    """``event_id, key, accepted`` of the changes that a stream of ``limit_changes`` has written so far, a row for each row it has read."""
    one = lambda part: changes.where(part).select("event_id", "key", "accepted")
    return one("not accepted").unionByName(one("accepted and change > 0").exceptAll(one("change < 0")))


_STATE = "w array<long>, us array<long>, id array<long>"


def _windows(events: DataFrame, key: str, seconds: int, clock: Column | None) -> DataFrame:
    at = F.unix_micros("ts") / F.lit(1_000_000) if clock is None else clock
    w = F.coalesce(F.floor(at / F.lit(seconds)), F.lit(-(1 << 62)))  # rows without a time share a window
    rows = events.select("event_id", "ts", F.coalesce(F.unix_micros("ts"), F.lit(0)).alias("us"), F.col(key).cast("string").alias("key"), w.alias("w"))
    return rows.withColumn("span", F.floor(F.col("w") / F.lit(_SPAN)))


def _held(state: GroupState) -> np.ndarray:
    """Window, time, number of the rows in a state, and 1 for each: it was there before."""
    rows = np.array(state.get, np.int64).reshape(3, -1) if state.exists else np.zeros((3, 0), np.int64)
    return np.vstack([rows, np.ones(rows.shape[1], np.int64)])


def _first(held: np.ndarray, rows: pd.DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the first ``most`` rows of each window, the others, the numbers of those among them that were there before)."""
    new = np.vstack([rows[c].to_numpy(np.int64) for c in ("w", "us", "event_id")] + [np.zeros(len(rows), np.int64)])
    both = np.hstack([held, new])
    both = both[:, np.lexsort((both[2], both[1], both[0]))]
    start = np.flatnonzero(np.diff(both[0], prepend=both[0, :1] - 1))
    place = np.arange(both.shape[1]) - np.repeat(start, np.diff(np.append(start, both.shape[1])))
    out = both[:, place >= most]
    return both[:, place < most], out, out[2, out[3] == 1]


def breaker(calls: DataFrame, key: str, failures: int = 5, pause: int = 60) -> DataFrame:
    """``state`` at each call of a circuit breaker: closed, open (refused) or half_open (let through as a trial).

    ``failures`` failures in a row open it for ``pause`` seconds; then one
    trial closes it, or opens it again.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, opened = state.get if state.exists else (0, -1)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for ident, ts, ok in zip(rows["event_id"], rows["ts"], rows["ok"]):
            now = int(ts.timestamp())
            if opened >= 0 and now - opened < pause:
                out.append((int(ident), k[0], "open"))
                continue
            out.append((int(ident), k[0], "half_open" if opened >= 0 else "closed"))
            if ok:
                run, opened = 0, -1
            else:
                run += 1
                if opened >= 0 or run >= failures:
                    opened = now
        state.update((run, opened))
        yield pd.DataFrame(out, columns=["event_id", "key", "state"])

    rows = calls.select("event_id", "ts", "ok", F.col(key).cast("string").alias("key"))
    return rows.groupBy("key").applyInPandasWithState(step, "event_id long, key string, state string", "run int, opened long", "append", GroupStateTimeout.NoTimeout)


#: Groups of keys, by hash, that share a state of marks: a state costs far more than the rows of most keys.
_GROUPS = 4096


def _due(held: pd.DataFrame, marks: pd.DataFrame, life: int, passed: int) -> tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame]:
    """(rows that go out, rows that wait, marks left) when the watermark has passed ``passed`` milliseconds.

    ``held(key, us, id, sets)`` and ``marks(key, us)``. A row meets the mark
    that the row of its key before it has set, or one that is left from before.
    """
    ends = (held["us"] // life + 1) * life // 1000
    due, later = held[ends < passed], held[ends >= passed]
    rows = pd.concat([marks.assign(id=0, sets=True, old=True), due.assign(old=False)], ignore_index=True)
    rows["code"] = pd.factorize(rows["key"], use_na_sentinel=False)[0]
    rows = rows.sort_values(["code", "old", "us", "id"], ascending=[True, False, True, True], ignore_index=True)
    same = rows["code"].eq(rows["code"].shift())
    rows["pending"] = same & rows["sets"].astype(bool).shift(fill_value=False) & (rows["us"] - rows["us"].shift(fill_value=0) <= life)
    last = rows[~rows["code"].duplicated(keep="last") & rows["sets"].astype(bool)]
    kept = last[((last["us"] + life) // life + 1) * life // 1000 >= passed]  # the others no row in time can meet any more
    return rows[~rows["old"]], later, kept[["key", "us"]]


def pending_marks(messages: DataFrame, key: str, sets: Column, seconds: int = 1800, late: str = "1 hour") -> DataFrame:
    """``event_id, key, pending``: whether a message comes upon its key's mark, set by a message before it that ``sets`` holds for, at most ``seconds`` old.

    The mark is used once: the next message takes it, in time or not, and may
    set a new one. Messages wait in the state until the watermark has passed
    the period of ``seconds`` that they are in, and then go through in their
    order, so files may come in any order; later rows than ``late`` are left
    out. The state of a key is its rows since then and one mark. Keys share
    states by hash; a state wakes once for all that is due, and clears marks
    that nothing takes.
    """
    life = seconds * 1_000_000

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name, us, ident, flag, mark_name, mark_us = state.get if state.exists else ((),) * 6
        held = pd.DataFrame({"key": pd.Series(name, dtype=object), "us": pd.Series(us, dtype="int64"), "id": pd.Series(ident, dtype="int64"), "sets": pd.Series(flag, dtype=bool)})
        marks = pd.DataFrame({"key": pd.Series(mark_name, dtype=object), "us": pd.Series(mark_us, dtype="int64")})
        if state.hasTimedOut:
            out, held, marks = _due(held, marks, life, state.getCurrentWatermarkMs())
            if len(out):
                yield out.rename(columns={"id": "event_id"})[["event_id", "key", "pending"]]
        else:
            held = pd.concat([held, *(f.rename(columns={"event_id": "id"})[["key", "us", "id", "sets"]] for f in frames)], ignore_index=True)
        first = [int((us.min() // life + 1) * life // 1000) for us in (held["us"], marks["us"] + life) if len(us)]
        if not first:
            state.remove()
            return
        text = lambda names: [None if pd.isna(x) else x for x in names]
        state.update((text(held["key"]), held["us"].tolist(), held["id"].tolist(), held["sets"].tolist(), text(marks["key"]), marks["us"].tolist()))
        state.setTimeoutTimestamp(max(min(first), state.getCurrentWatermarkMs() + 1))

    rows = messages.where("ts IS NOT NULL").withWatermark("ts", late).select("event_id", "ts", F.unix_micros("ts").alias("us"), F.col(key).cast("string").alias("key"), F.coalesce(sets, F.lit(False)).alias("sets"))
    kind = "key array<string>, us array<long>, id array<long>, sets array<boolean>, mark_key array<string>, mark_us array<long>"
    grouped = rows.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(_GROUPS)))
    return grouped.groupBy("group").applyInPandasWithState(step, "event_id long, key string, pending boolean", kind, "append", GroupStateTimeout.EventTimeTimeout)


#: The store that timers and lists need.
_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def drain(stream: DataFrame, path: str, mode: str = "append", timers: bool = False) -> DataFrame:
    """Run a stream over what there is, into Parquet files below ``path``, and read them; ``timers``: its state needs the store that has them."""
    if not timers:
        return _drained(stream, path, mode)
    conf, (name, provider) = stream.sparkSession.conf, _PROVIDER
    before = conf.get(name)
    conf.set(name, provider)
    try:
        return _drained(stream, path, mode)
    finally:
        conf.set(name, before)


def _drained(stream: DataFrame, path: str, mode: str) -> DataFrame:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{path}/rows").start()
    else:  # the last state of each batch's groups takes the place of earlier ones
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{path}/rows")).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
