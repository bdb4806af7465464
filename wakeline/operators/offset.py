"""Shifting a track sideways inside a corridor, with the shift tapered at bends and folds cut out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wakeline.functions.geo import K0, corridor_gate

# Width of the two smoothing windows, look-ahead for folds, least scale that counts as moved.
WIDTH, AHEAD, ACTIVE = 15, 80, 1e-3


def headings(points: DataFrame, key: str, order: str) -> DataFrame:
    """x, y (plane of degrees), unit headings in and out, seg lengths and turn radius (null: straight or an end)."""
    w = Window.partitionBy(key).orderBy(order)
    p = points.select(key, order, (F.col("lon") * K0).alias("x"), F.col("lat").alias("y"))
    p = p.withColumns({"nx": F.lead("x").over(w), "ny": F.lead("y").over(w)})
    p = p.filter("nx is null or nx != x or ny != y")  # a segment without length goes, the last point stays
    p = p.withColumns({"sx": F.lead("x").over(w) - F.col("x"), "sy": F.lead("y").over(w) - F.col("y")})
    # Not hypot: arc cosines near 1 show its last bit in the radius.
    p = p.withColumn("len", F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy"))).withColumns({"ux": F.col("sx") / F.col("len"), "uy": F.col("sy") / F.col("len")})
    p = p.withColumns({"vx": F.lag("ux").over(w), "vy": F.lag("uy").over(w), "before": F.lag("len").over(w)})
    turn = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("ux") * F.col("vx") + F.col("uy") * F.col("vy"))))
    p = p.withColumn("turn", turn)
    return p.withColumn("radius", F.when(F.col("turn") > 1e-9, (F.col("before") + F.col("len")) / 2 / F.col("turn")))


def edge_mean(value: Column, key: str, order: str, width: int = WIDTH) -> Column:
    """Rolling mean whose window repeats the first and last value beyond the ends."""
    half = width // 2
    w = Window.partitionBy(key).orderBy(order)
    near = w.rowsBetween(-half, half)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n, all_ = F.row_number().over(w), F.count(F.lit(1)).over(whole)
    before = F.greatest(F.lit(0), half + 1 - n)
    after = F.greatest(F.lit(0), half - (all_ - n))
    return (F.sum(value).over(near) + before * F.first(value).over(whole) + after * F.last(value).over(whole)) / width


def shifted(points: DataFrame, key: str, order: str, distance: Column, width: int = WIDTH) -> DataFrame:
    """key, order, x, y, qx, qy, scale: where each vertex goes. ``distance`` is in degrees of latitude, left positive.

    A track of fewer than three points, or of fewer than two segments that have a length, stays where it is.
    """
    w = Window.partitionBy(key).orderBy(order)
    h = headings(points, key, order)
    # Points without a length after them are gone, the last one stays: three rows are two segments.
    h = h.withColumn("d", F.when(F.count(F.lit(1)).over(Window.partitionBy(key)) >= 3, distance).otherwise(0.0))
    tight = F.min("radius").over(w.rowsBetween(-(width // 2), width // 2))
    h = h.withColumn("tight", tight)
    h = h.withColumn("taper", F.when(F.col("tight").isNull() | (F.col("d") == 0), 1.0).otherwise(F.least(F.lit(1.0), F.col("tight") / (2 * F.abs("d")))))
    h = h.withColumn("smooth", edge_mean(F.col("taper"), key, order, width)).withColumn("scale", F.col("smooth") * corridor_gate("y"))
    tx, ty = F.coalesce("vx", F.lit(0.0)) + F.coalesce("ux", F.lit(0.0)), F.coalesce("vy", F.lit(0.0)) + F.coalesce("uy", F.lit(0.0))
    h = h.withColumns({"tx": tx, "ty": ty}).withColumn("tl", F.hypot("tx", "ty"))
    unit = lambda c: F.when(F.col("tl") < 1e-12, 0.0).otherwise(c / F.col("tl"))
    move = F.col("d") * F.col("scale")
    return h.select(key, order, "x", "y", (F.col("x") + unit(-F.col("ty")) * move).alias("qx"), (F.col("y") + unit(F.col("tx")) * move).alias("qy"), "scale", "d")


def trim_folds(rows: DataFrame, key: str, order: str, ahead: int = AHEAD) -> DataFrame:
    """(key, n, x, y): the shifted line without the small loops that shifting made.

    At each vertex the farthest crossing within ``ahead`` segments is taken, if all of its loop lies within
    twice the shift of the crossing and was moved; the line jumps there. Sequential per track, holding the look-ahead only.
    """

    def fold(a: np.ndarray, i: int) -> tuple[int, float, float] | None:
        """(next vertex, crossing) of the farthest fold that starts on the segment at i; a has x, y, tolerance, moved."""
        ends = a[i + 2 : min(i + ahead, len(a) - 1) + 1, :2]
        if len(ends) < 2 or not a[i, 3]:
            return None
        own, others, gap = a[i + 1, :2] - a[i, :2], np.diff(ends, axis=0), ends[:-1] - a[i, :2]
        area = own[0] * others[:, 1] - own[1] * others[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            here = (gap[:, 0] * others[:, 1] - gap[:, 1] * others[:, 0]) / area
            there = (gap[:, 0] * own[1] - gap[:, 1] * own[0]) / area
        for k in np.flatnonzero((area != 0) & (here > 0) & (here < 1) & (there > 0) & (there < 1))[::-1]:
            at, loop = a[i, :2] + here[k] * own, a[i : i + k + 3]
            if loop[:, 3].all() and (np.abs(loop[:, :2] - at).max(axis=1) <= loop[:, 2]).all():
                return i + int(k) + 3, float(at[0]), float(at[1])
        return None

    def walk(pts: list, done: bool, out: list) -> int:
        """Emit while the look-ahead is complete; the vertex reached."""
        a, i = np.array(pts, dtype=np.float64), 0
        stop = len(pts) - 1 if done else len(pts) - ahead
        while i < stop:
            if (found := fold(a, i)) is not None:
                i, *at = found
                out.append(tuple(at))
            else:
                i += 1
                out.append(pts[i][:2])
        return i

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, track, pts, n, out, rows_, kind = None, None, [], 0, [], [], None

        def flush(done: bool) -> None:
            nonlocal pts, n, out
            if pts and not (n or out):
                out.append(pts[0][:2])
            if not done or len(pts) > 1:
                at = walk(pts, done, out)
                pts = [] if done else pts[at:]
            rows_.extend((track, n + k, x, y) for k, (x, y) in enumerate(out))
            n, out = n + len(out), []

        def batch_of() -> pa.RecordBatch:
            nonlocal rows_
            columns = [*zip(*rows_, strict=True)] or [()] * 4
            rows_ = []
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.float64())], names=[key, "n", "x", "y"])

        for batch in batches:
            kind = batch.column(0).type
            for own, key_, x, y, d, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key_ != seen:
                    flush(True)
                    seen, track, pts, n = key_, own, [], 0
                pts.append((x, y, 2 * abs(d), s > ACTIVE))
                if len(pts) >= 8 * ahead:
                    flush(False)
            yield batch_of()
        flush(True)
        if rows_:
            yield batch_of()

    # The key as text tells null from every other value.
    dealt = rows.repartition(key).sortWithinPartitions(key, order).select(key, F.to_json(F.struct(key)).alias("_k"), "qx", "qy", "d", "scale")
    schema = rows.select(key, F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")).schema
    return dealt.mapInArrow(run, schema)
