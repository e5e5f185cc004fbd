"""A limit of attempts for each key, as keyed state of a stream.

The first attempt of a key opens a window of fixed length; in it so many attempts are
allowed, and each further one is told how many seconds are left. The first attempt
after the window's end opens the next. A key's state is one row, its window's end and
its count, and a timer at the window's end clears it once the watermark is past, so
state holds the keys of open windows only.

Attempts of one key count in the order of their times within a micro-batch; later
batches follow it. An attempt behind the watermark is dropped, as its window is gone.
One without a time comes last: it counts in the window that is open then, opens none and
isn't told a time. Streams can't be sorted before keyed state, so a task sorts a key's
attempts: up to `HELD` in memory, more in a temporary file of its own."""

from __future__ import annotations

import os
import tempfile
from bisect import bisect_left
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The window's length in seconds, and the attempts allowed in it.
WINDOW_S, MOST = 60, 10
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Attempts of a key that a task holds at once, and of those that it gives on at once. The result doesn't hang on them.
HELD, GIVEN = 500_000, 50_000
#: An attempt, in the order of its fields; bare ones have no time or no id, with 0 in its place.
ROW = np.dtype([("bare", "i1"), ("at", "i8"), ("bare_id", "i1"), ("id", "i8")])


def _sorted(parts: list[np.ndarray]) -> np.ndarray:
    rows = np.concatenate([np.zeros(0, ROW), *parts])
    return rows[np.lexsort((rows["id"], rows["bare_id"], rows["at"], rows["bare"]))]


def ordered(batches: Iterator[np.ndarray], held: int) -> Iterator[np.ndarray]:
    """The batches' rows in their order, in blocks of about `held` at most. Sorted runs
    go to a temporary file; cuts through all runs, from every step-th row of each, part
    them into blocks."""
    with tempfile.TemporaryFile() as file:
        parts, n, ends = [], 0, [0]
        for rows in batches:
            parts.append(rows)
            n += len(rows)
            if n >= held:
                file.write(_sorted(parts))
                parts, n, ends = [], 0, [*ends, ends[-1] + n]
        if len(ends) == 1:
            yield _sorted(parts)
            return
        file.write(_sorted(parts))
        file.flush()
        runs = list(pairwise([*ends, ends[-1] + n]))
        read = lambda i, j: np.frombuffer(os.pread(file.fileno(), (j - i) * ROW.itemsize, i * ROW.itemsize), ROW)
        row = lambda i: read(i, i + 1)[0].item()
        starts, step = [i for i, _ in runs], max(1, held // (2 * len(runs)))
        cuts = sorted(row(k) for i, j in runs for k in range(i, j, step))[len(runs) :: len(runs)]
        for cut in [*cuts, None]:
            stops = [j if cut is None else bisect_left(range(j), cut, lo=s, key=row) for s, (_, j) in zip(starts, runs, strict=True)]
            yield _sorted([read(i, j) for i, j in zip(starts, stops, strict=True)])
            starts = stops


class Limiter(StatefulProcessor):
    def __init__(self, window_s: int, most: int) -> None:
        self.window, self.most, self.held = window_s * 1_000_000, most, HELD

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "ends long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        held = self.open.get() if self.open.exists() else None
        ends, n = held if held else (None, 0)
        first = ends
        packed = (np.rec.fromarrays([b[c] for c in ROW.names], dtype=ROW).view(np.ndarray) for b in rows)
        for block in ordered(packed, self.held):
            for k in range(0, len(block), GIVEN):
                part = block[k : k + GIVEN]
                at, timed = part["at"], int((part["bare"] == 0).sum())
                # each row's place in its window, and the window's end
                rank, until, i = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), 0
                while i < timed:
                    if ends is None or at[i] > ends:
                        ends, n = int(at[i]) + self.window, 0
                    j = int(np.searchsorted(at[:timed], ends, side="right"))
                    rank[i:j], until[i:j] = np.arange(n + 1, n + 1 + j - i), ends
                    n, i = n + j - i, j
                rank[i:] = np.arange(n + 1, n + 1 + len(at) - i)
                n += len(at) - i
                allowed, untimed = rank <= self.most, part["bare"] == 1
                left = pd.array(np.where(allowed, 0, -((at - until) // 1_000_000)), "Int64")
                left[untimed & ~allowed] = pd.NA
                ids, times = pd.array(part["id"], "Int64"), pd.array(at, "Int64")
                ids[part["bare_id"] == 1], times[untimed] = pd.NA, pd.NA
                yield pd.DataFrame({"key": np.full(len(at), key[0], object), "id": ids, "at_us": times, "allowed": allowed, "retry_after": left})
        if ends is None:
            return
        self.open.update((ends, n))
        if ends != first:
            if first is not None:
                self.handle.deleteTimer(first // 1000 + 1)
            self.handle.registerTimer(ends // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        self.open.clear()
        return iter([])

    def close(self) -> None:
        pass


def limited(attempts: DataFrame, window_s: int = WINDOW_S, most: int = MOST, lateness: str = "0 seconds") -> DataFrame:
    """key, id, at_us, allowed, retry_after (seconds) for a stream of attempts (key, id,
    at_us: microseconds). Its session needs the state store PROVIDER."""
    rows = attempts.select("key", "id", "at_us", F.timestamp_micros("at_us").alias("time")).withWatermark("time", lateness)
    bare = lambda c: F.col(c).isNull().cast("byte")
    zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    rows = rows.select("key", bare("at_us").alias("bare"), zero("at_us").alias("at"), bare("id").alias("bare_id"), zero("id").alias("id"), "time")
    schema = "key string, id long, at_us long, allowed boolean, retry_after long"
    return rows.groupBy("key").transformWithStateInPandas(Limiter(window_s, most), schema, "append", "eventTime")
