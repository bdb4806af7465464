"""Stops on a stream: a track's rows wait until the watermark has passed them, and go through the batch operator's walk."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from wakeline.operators.sequence import STOP_M, STOP_MIN, StopWalk

#: State with lists and timers needs this store: set it as spark.sql.streaming.stateStore.providerClass before the job starts.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NAMES = ["start_s", "end_s", "minutes", "lat", "lon", "n"]
#: A track's state in one value, so that a call reads and writes once: rows that the watermark has not passed and rows of the
#: undecided run, three numbers each; the walk's place; the last time walked, and when the one timer of the track is due.
STATE = "waiting array<double>, held array<double>, at int, sums array<double>, last_ms long, timer_ms long"


def _flat(rows: list[tuple]) -> list[float]:
    return [float(v) for r in rows for v in r]


def _threes(flat) -> list[tuple]:
    return [*zip(flat[::3], flat[1::3], flat[2::3], strict=True)]


class _Stops(StatefulProcessor):
    def __init__(self, key: str, radius_m: float, min_minutes: float, idle_ms: int) -> None:
        self.key, self.radius_m, self.min_minutes, self.idle_ms = key, radius_m, min_minutes, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("walk", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        new = [(r["t"], r["lat"], r["lon"]) for r in rows]
        new = [r for r in new if all(v is not None and v == v for v in r)]
        if new:
            waiting, held, at, sums, last_ms, timer = self.state.get() or ([], [], 1, None, 0, None)
            due = int(min(r[0] for r in new) * 1000)
            if timer is None or due < timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(due)
                timer = due
            self.state.update(([*waiting, *_flat(new)], held, at, sums, last_ms, timer))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        waiting, held, at, sums, last_ms, _ = self.state.get()
        waiting = sorted(_threes(waiting))
        ready = [r for r in waiting if r[0] * 1000 <= passed]
        walk = StopWalk(self.radius_m, self.min_minutes, _threes(held), at, list(sums) if sums else None)
        found = []
        for r in ready:
            found += walk.push(*r)
            last_ms = int(r[0] * 1000)
        left = waiting[len(ready) :]
        if not left and (walk.held or walk.sums) and last_ms + self.idle_ms <= passed:
            found += walk.end()  # silent for long enough
        if left or walk.held or walk.sums:
            timer = int(left[0][0] * 1000) if left else last_ms + self.idle_ms
            self.state.update((_flat(left), _flat(walk.held), walk.at, [float(v) for v in walk.sums] if walk.sums else None, last_ms, timer))
            self.handle.registerTimer(timer)
        else:
            self.state.clear()
        return (Row(**dict(zip([self.key, *NAMES], [*key, *map(float, s[:5]), int(s[5])], strict=True))) for s in found)

    def close(self) -> None:
        pass


def stops(fixes: DataFrame, key: str = "track", time: str = "ts", late: str = "10 minutes", idle: str = "12 hours", radius_m: float = STOP_M, min_minutes: float = STOP_MIN) -> DataFrame:
    """key, start_s, end_s, minutes, lat, lon, n of a stream's stops, as the batch operator finds them whatever the micro-batches.

    ``time`` is a timestamp. Rows may come ``late`` behind the newest and are taken in order of time; later ones are left
    out, as are rows without a time or a position. A track that has been silent for ``idle`` of event time is closed by a timer,
    and forgotten. State is a track's undecided run and the rows of the last ``late``.
    """
    kind = fixes.select(key).schema[0].dataType.simpleString()
    schema = f"{key} {kind}, start_s double, end_s double, minutes double, lat double, lon double, n long"
    rows = fixes.withWatermark(time, late).select(key, time, (F.unix_micros(time) / 1e6).alias("t"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    made = _Stops(key, radius_m, min_minutes, int(pd.Timedelta(idle).total_seconds() * 1000))
    return rows.groupBy(key).transformWithState(statefulProcessor=made, outputStructType=schema, outputMode="Append", timeMode="EventTime")
