"""The spike filter and thinning on a stream: per track, the last accepted and last kept position."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wakeline.functions.geo import KN_PER_MS, NM_M, haversine_m
from wakeline.operators.report import MOVING_KN
from wakeline.operators.sequence import JUMP_M, MAX_KN, THIN_M

STATE = "t double, lat double, lon double, keep_lat double, keep_lon double, metres double"
OUT = "track {kind}, t double, lat double, lon double, step_m double, kept boolean, nm double"


def accepted(fixes: DataFrame, key: str = "track", time: str = "t_s", watermark: tuple[str, str] | None = None, idle: str = "12 hours") -> DataFrame:
    """Accepted rows of a stream of fixes with step_m, kept and the track's gated distance so far.

    State is six numbers a track. Within a micro-batch rows are taken in order of time; a row that comes in a later
    batch than a newer one does not advance and is rejected, as in the batch operator; so is one without a time or a position. With a ``watermark``
    (a timestamp column and its delay) a track that has been silent for ``idle`` of event time is forgotten, so state
    stays in proportion to the tracks under way, and its next row starts it anew; without one every track is kept.
    """
    silence = int(pd.Timedelta(idle).total_seconds() * 1000)
    kind = dict(fixes.dtypes)[key]

    def step(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = list(state.get) if state.exists else None
        rows = []
        for t, la, lo, kn in pd.concat(pdfs).sort_values("t")[["t", "lat", "lon", "sog_kn"]].itertuples(index=False):
            if t != t or la != la or lo != lo:
                continue  # without a time or a position: rejected, as in the batch operator
            if now is None:
                now = [t, la, lo, la, lo, 0.0]
                rows.append((*k, t, la, lo, None, True, 0.0))
                continue
            dt, d = t - now[0], haversine_m(now[1], now[2], la, lo)
            if dt <= 0 or (d / dt * KN_PER_MS > MAX_KN and d > JUMP_M):
                continue
            now[5] += d if kn > MOVING_KN else 0.0
            kept = haversine_m(now[3], now[4], la, lo) >= THIN_M
            now[:3] = t, la, lo
            if kept:
                now[3:5] = la, lo
            rows.append((*k, t, la, lo, d, kept, now[5] / NM_M))
        if now is not None:
            state.update(tuple(float(x) for x in now))
            if watermark:
                state.setTimeoutTimestamp(max(int(now[0] * 1000), state.getCurrentWatermarkMs()) + silence)
        yield pd.DataFrame(rows, columns=["track", "t", "lat", "lon", "step_m", "kept", "nm"])

    if watermark:
        fixes = fixes.withWatermark(*watermark)
    event = [F.col(watermark[0]).alias("_ts")] if watermark else []
    rows = fixes.select(F.col(key).alias("track"), F.col(time).cast("double").alias("t"), "lat", "lon", "sog_kn", *event)
    timeout = GroupStateTimeout.EventTimeTimeout if watermark else GroupStateTimeout.NoTimeout
    return rows.groupBy("track").applyInPandasWithState(step, OUT.format(kind=kind), STATE, "append", timeout)


def hourly(fixes: DataFrame, ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """Fixes and mean speed per event-time hour of a stream; hours close ``late`` after their last fix."""
    return fixes.withWatermark(ts, late).groupBy(F.window(ts, "1 hour").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.avg("sog_kn").alias("mean_kn")).select("hour.start", "n", "mean_kn")
