"""Filters whose test looks at the last accepted row, which no window frame can express.

Rows are dealt by track and sorted inside their task; a kernel walks them batch by batch with a few
numbers of state, so a track of any length streams through in bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wakeline.functions.geo import KN_PER_MS, haversine_m

# Spike filter, thinning, stops.
MAX_KN, JUMP_M, THIN_M = 30.0, 60.0, 22.0
STOP_M, STOP_MIN = 90.0, 25.0


def _dealt(fixes: DataFrame, keys: list[str], time: str, order: list[str]) -> DataFrame:
    """Rows by track, in order, behind them ``_k`` (the keys as text, nulls told apart), seconds, latitude and longitude."""
    at = F.unix_micros(F.col(time).cast("timestamp")) / 1e6 if dict(fixes.dtypes)[time].startswith("timestamp") else F.col(time).cast("double")
    rows = fixes.repartition(*keys).sortWithinPartitions(*keys, *order)
    return rows.select("*", F.to_json(F.struct(*keys)).alias("_k"), at.alias("_t"), F.col("lat").cast("double").alias("_la"), F.col("lon").cast("double").alias("_lo"))


def _walked(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(_k, t, lat, lon) of every row."""
    return zip(*(c.to_pylist() for c in batch.columns[-4:]), strict=True)


def accept(fixes: DataFrame, keys: list[str], time: str, order: list[str] | None = None, need_advance: bool = True, max_kn: float = MAX_KN, jump_m: float = JUMP_M, thin_m: float = THIN_M) -> DataFrame:
    """Adds accepted, step_m (from the last accepted row) and kept (thinned to ``thin_m``).

    The first row of a track is accepted and kept. A later one is rejected if it implies more than
    ``max_kn`` and lies more than ``jump_m`` from the last accepted row, or, with ``need_advance``, if
    its time does not advance; rejected rows have a null step. Thinning compares with the last kept row.
    Null keys are a track like any other; rows without a time or a position are rejected.
    """
    schema = fixes.withColumns({"accepted": F.lit(True), "step_m": F.lit(None).cast("double"), "kept": F.lit(True)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        track = last = keep = None
        for batch in batches:
            ok, step, kept = [], [], []
            for key, t, la, lo in _walked(batch):
                if key != track:
                    track, last = key, None
                if t is None or la is None or lo is None:
                    ok.append(False), step.append(None), kept.append(False)
                    continue
                if last is None:
                    last, keep = (t, la, lo), (la, lo)
                    ok.append(True), step.append(None), kept.append(True)
                    continue
                dt, d = t - last[0], haversine_m(last[1], last[2], la, lo)
                if (need_advance and dt <= 0) or (dt > 0 and d / dt * KN_PER_MS > max_kn and d > jump_m):
                    ok.append(False), step.append(None), kept.append(False)
                    continue
                last = (t, la, lo)
                far = haversine_m(*keep, la, lo) >= thin_m
                keep = (la, lo) if far else keep
                ok.append(True), step.append(d), kept.append(far)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-4], pa.array(ok, pa.bool_()), pa.array(step, pa.float64()), pa.array(kept, pa.bool_())], names=schema.names)

    return _dealt(fixes, keys, time, order or [time]).mapInArrow(run, schema)


def strided(rows: DataFrame, keys: list[str], order: list[str], step: int = 3) -> DataFrame:
    """Every ``step``-th row of each group from its first, and its last."""
    w = Window.partitionBy(*keys)
    x = rows.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_m": F.count(F.lit(1)).over(w)})
    return x.filter((F.col("_i") % step == 0) | (F.col("_i") == F.col("_m") - 1)).drop("_i", "_m")


class StopWalk:
    """One track's search for stops: rows go in by time, stops (start, end, minutes, lat, lon, n) come out.

    From an anchor the run goes on while rows lie within the radius of it; a run of the least time is a stop and the
    next anchor is the row after it, else the next row is. ``held`` are the rows of the undecided run, the first its
    anchor, of which the first ``at`` are known to lie within; a run that is long enough already is down to ``sums``: the
    anchor's time and place, the last time, the number of rows and the sums of their places.
    """

    def __init__(self, radius_m: float = STOP_M, min_minutes: float = STOP_MIN, held: list | None = None, at: int = 1, sums: list[float] | None = None) -> None:
        self.radius_m, self.min_minutes = radius_m, min_minutes
        self.held, self.at, self.sums = held or [], at, sums

    def push(self, t: float, la: float, lo: float) -> list[tuple]:
        found = []
        if (s := self.sums) is not None:
            if haversine_m(s[1], s[2], la, lo) < self.radius_m:
                s[3:] = [t, s[4] + 1, s[5] + la, s[6] + lo]
                return found
            found.append(self._leave())
        self.held.append((t, la, lo))
        return found + self._settle(False)

    def end(self) -> list[tuple]:
        found = [self._leave()] if self.sums is not None else []
        return found + self._settle(True)

    def _leave(self) -> tuple:
        s, self.sums = self.sums, None
        return s[0], s[3], (s[3] - s[0]) / 60, s[5] / s[4], s[6] / s[4], int(s[4])

    def _settle(self, done: bool) -> list[tuple]:
        found = []
        while self.held:
            held, a = self.held, self.held[0]
            while self.at < len(held) and haversine_m(a[1], a[2], held[self.at][1], held[self.at][2]) < self.radius_m:
                self.at += 1
            at = self.at
            long = (held[at - 1][0] - a[0]) / 60 >= self.min_minutes
            if at == len(held) and not done and not long:
                break
            self.at = 1
            if not long:
                self.held = held[1:]
                continue
            self.sums = [*a, held[at - 1][0], at, sum(p[1] for p in held[:at]), sum(p[2] for p in held[:at])]
            self.held = held[at:]
            if not self.held and not done:
                break
            found.append(self._leave())
        return found


def stops(fixes: DataFrame, key: str, time: str, order: list[str] | None = None, radius_m: float = STOP_M, min_minutes: float = STOP_MIN) -> DataFrame:
    """key, start_s, end_s, minutes, lat, lon, n of stationary runs: greedy, anchored, not overlapping (see StopWalk).

    Only rows of the undecided run are held. Null keys are a track like any other; rows without a time or a position take no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, found, track, kind, seen = StopWalk(radius_m, min_minutes), [], None, None, None

        def rows() -> pa.RecordBatch:
            nonlocal found
            columns = [*zip(*found, strict=True)] or [()] * len(names)
            found = []
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *[pa.array(c, pa.float64()) for c in columns[1:6]], pa.array(columns[6], pa.int64())], names=names)

        for batch in batches:
            kind = batch.schema.field(key).type
            for own, (key_, t, la, lo) in zip(batch.column(batch.schema.get_field_index(key)).to_pylist(), _walked(batch), strict=True):
                if t is None or la is None or lo is None:
                    continue
                if key_ != seen:
                    found += [(track, *s) for s in walk.end()]
                    seen, track, walk = key_, own, StopWalk(radius_m, min_minutes)
                found += [(track, *s) for s in walk.push(t, la, lo)]
            yield rows()
        found += [(track, *s) for s in walk.end()]
        if found:
            yield rows()

    names = [key, "start_s", "end_s", "minutes", "lat", "lon", "n"]
    schema = fixes.select(key, *[F.lit(0.0).alias(c) for c in names[1:6]], F.lit(0).cast("long").alias("n")).schema
    return _dealt(fixes, [key], time, order or [time]).mapInArrow(run, schema)


def split_legs(fixes: DataFrame, days: DataFrame, key: str = "track", time: str = "ts") -> DataFrame:
    """Adds ``leg``: walk up to and including walk_split, road after road_split, afloat between; no split, no such leg."""
    x = fixes.join(days.select(F.col(key).alias("_day"), "walk_split", "road_split"), F.col(key) == F.col("_day"), "left").drop("_day")
    leg = F.when(F.col(time) <= F.col("walk_split"), "walk").when(F.col(time) > F.col("road_split"), "road").otherwise("afloat")
    return x.withColumn("leg", leg).drop("walk_split", "road_split")


