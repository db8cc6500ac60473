"""Sessions and runs that end by themselves: keyed state with event-time timers.

Each key holds one timestamp and one timer. What ends is told by event times alone
(a gap that is long enough, or a watermark that has passed the end), so the result
does not depend on how the stream is cut into batches. Events of one key inside a
batch are taken in order of time; later than the watermark, Spark drops them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

MINUTE = 60_000


class _Timed(StatefulProcessor):
    """State ``at``: milliseconds of the key's one open session or run."""

    def __init__(self, minutes: int):
        self.span = minutes * MINUTE

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "ms long")

    def _get(self) -> int | None:
        return self.at.get()[0] if self.at.exists() else None

    def _set(self, was: int | None, now: int | None) -> None:
        if was == now:
            return
        if was is not None:
            self.handle.deleteTimer(was + self.span)
        if now is None:
            self.at.clear()
        else:
            self.at.update((now,))
            self.handle.registerTimer(now + self.span)

    def close(self) -> None:
        pass


def _sorted_rows(rows: Iterator[pd.DataFrame], *columns: str) -> list[tuple]:
    """A key's rows of one batch in order of time (bounded by the batch)."""
    return sorted(r for pdf in rows for r in pdf[list(columns)].itertuples(index=False, name=None))


class Expiry(_Timed):
    """A session lives on with each use and ends ``minutes`` after its last one."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        was = last = self._get()
        ended = []
        for (ms,) in _sorted_rows(rows, "ms"):
            if last is not None and ms - last > self.span:
                ended.append(last + self.span)
            last = ms if last is None else max(last, ms)
        self._set(was, last)
        yield pd.DataFrame({"key": [key[0]] * len(ended), "ended": ended})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.at.clear()
        yield pd.DataFrame({"key": [key[0]], "ended": [expiredTimerInfo.getExpiryTimeInMs()]})


class Runs(_Timed):
    """A run goes on from its start to its finish, or is abandoned after ``minutes``.

    ``mark`` is 0 for a start, 1 for a finish. A start while a run goes on is part
    of it, and a finish without a run is none."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        was = open_ = self._get()
        out = []
        for ms, mark in _sorted_rows(rows, "ms", "mark"):
            if open_ is not None and ms - open_ > self.span:
                out.append((open_, "abandoned"))
                open_ = None
            if mark and open_ is not None:
                out.append((open_, "finished"))
                open_ = None
            elif not mark and open_ is None:
                open_ = ms
        self._set(was, open_)
        yield pd.DataFrame({"key": [key[0]] * len(out), "started": [s for s, _ in out], "status": [x for _, x in out]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.at.clear()
        yield pd.DataFrame({"key": [key[0]], "started": [expiredTimerInfo.getExpiryTimeInMs() - self.span], "status": ["abandoned"]})


def _timed(events: DataFrame, key: str, ts: str, late: str, *more) -> DataFrame:
    return events.withWatermark(ts, late).select(F.col(key).cast("string").alias("key"), ts, F.unix_millis(ts).alias("ms"), *more)


def expiries(events: DataFrame, key: str, ts: str, minutes: int, late: str) -> DataFrame:
    """(key, ended): when each session ended, in milliseconds; sessions that the
    watermark has not passed are still open and have no row."""
    timed = _timed(events.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()), key, ts, late)
    return timed.groupBy("key").transformWithStateInPandas(Expiry(minutes), outputStructType="key string, ended long", outputMode="append", timeMode="EventTime")


def run_ends(events: DataFrame, key: str, ts: str, finish, minutes: int, late: str) -> DataFrame:
    """(key, started, status): runs that have finished or were abandoned. ``finish``
    is true of the events that end a run; all others start one."""
    timed = _timed(events.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()), key, ts, late, F.coalesce(finish, F.lit(False)).cast("int").alias("mark"))
    return timed.groupBy("key").transformWithStateInPandas(Runs(minutes), outputStructType="key string, started long, status string", outputMode="append", timeMode="EventTime")
