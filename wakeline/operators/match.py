"""Matching independent recordings: nearest in time, nearest on a path, inside intervals."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wakeline.functions.geo import to_segment
from wakeline.session import checkpoint


def asof_nearest(probes: DataFrame, fixes: DataFrame, time: str, tolerance_s: float, by: str, values: list[str], seq: str, keep_all: bool = False) -> DataFrame:
    """Probes within ``tolerance_s`` of a fix of the same ``by``, with that fix as struct ``fix`` and ``dt`` in seconds.

    ``time`` is in seconds on both sides. The nearest fix wins, the earlier on ties, the lowest ``seq`` among equal
    times. Probes without one are left out, or have a null ``fix`` and ``dt`` if ``keep_all``. Both sides are dealt by (by, time bucket); a fix stands
    in its own bucket and its neighbours, so a window over one bucket sees all that can match, and neither
    pairs nor whole tracks are formed.
    """
    width = float(max(tolerance_s, 1))
    bucket = F.floor(F.col(time) / width).cast("long")
    f = F.struct(F.col(time).alias("t"), *[F.col(v) for v in values])
    right = fixes.groupBy(by, time).agg(F.min_by(f, seq).alias("_fix")).withColumn("_b", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    row = F.struct(*[F.col(c) for c in probes.columns])
    left = probes.select(F.col(by), F.col(time), bucket.alias("_b"), row.alias("_row"))
    both = right.select(by, time, "_b", "_fix", F.lit(0).alias("_side")).unionByName(left.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(by, "_b").orderBy(time, "_side")
    before = F.last("_fix", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_fix", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    x = both.withColumns({"_p": before, "_n": after}).filter("_side = 1")
    gap = lambda c: F.abs(F.col(f"{c}.t") - F.col(time))
    take = F.when(F.col("_n").isNull() | (gap("_p") <= gap("_n")), F.col("_p")).otherwise(F.col("_n"))
    x = x.withColumn("fix", F.when(F.col("_p").isNull(), F.col("_n")).otherwise(take))
    x = x.withColumn("dt", F.abs(F.col("fix.t") - F.col(time)))
    near = F.col("dt") <= tolerance_s
    if keep_all:
        return x.select("_row.*", F.when(near, F.col("fix")).alias("fix"), F.when(near, F.col("dt")).alias("dt"))
    return x.filter(near).select("_row.*", "fix", "dt")


def placed_by_time(photos: DataFrame, fixes: DataFrame, time: str, tolerance_s: float, by: str, seq: str, plat: str = "plat", plon: str = "plon") -> DataFrame:
    """All columns of ``photos``, ``placed``, lat, lon: ``own`` where a photo has a position, ``track`` where a fix is near enough in time, else null.

    ``fixes`` have ``by``, ``time``, ``seq``, lat and lon. Half a position counts as none. Every photo comes back once,
    those with a null key or time included; only photos without a position are matched.
    """
    has = F.col(plat).isNotNull() & F.col(plon).isNotNull()
    own = photos.filter(has).select(*photos.columns, F.lit("own").alias("placed"), F.col(plat).alias("lat"), F.col(plon).alias("lon"))
    found = asof_nearest(photos.filter(~has), fixes, time, tolerance_s, by, ["lat", "lon"], seq, keep_all=True)
    return own.unionByName(found.select(*photos.columns, F.when(F.col("fix").isNotNull(), "track").alias("placed"), F.col("fix.lat").alias("lat"), F.col("fix.lon").alias("lon")))


def segments(points: DataFrame, key: str, order: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """(key, seg, ax, ay, bx, by) between neighbouring points of each path; gaps are bridged."""
    w = Window.partitionBy(key).orderBy(*order)
    s = points.select(key, F.row_number().over(w).cast("long").alias("seg"), F.col(x).alias("ax"), F.col(y).alias("ay"), F.lead(x).over(w).alias("bx"), F.lead(y).over(w).alias("by"))
    return s.filter("bx is not null")


def nearest_segment(points: DataFrame, segs: DataFrame, key: str, point_id: str, cell: float, x: str = "x", y: str = "y", growth: int = 8, with_seg: bool = True) -> DataFrame:
    """point_id, seg, dist: the nearest segment of the point's path, the lowest ``seg`` on ties; point_id and dist alone unless ``with_seg``.

    Segments are sampled into square cells, at half a cell's distance, and met by the points of the two by two cells whose common
    corner is nearest: what is found within 0.24 of a cell is exact. Points without such a find go on to cells ``growth`` times as wide, until
    the cells are as wide as everything; so the answer is exact at any distance, and no point meets all
    segments unless it is far from all of them. ``cell`` is half of the first width: a find within 0.48 ``cell`` ends the search.
    A segment's cells are made distinct in its own row, so the samples are shuffled once. Pairs are reduced to the least distance
    of a point as a hash aggregate of plain numbers, so they are neither sorted nor spilled; the segments that have it are looked up afterwards.
    """
    cell = 2 * cell
    pts = checkpoint(points.select(F.col(key), F.col(point_id), F.col(x).alias("_x"), F.col(y).alias("_y")))
    segs = checkpoint(segs)
    edge = segs.agg(F.min(F.least("ax", "bx")), F.max(F.greatest("ax", "bx")), F.min(F.least("ay", "by")), F.max(F.greatest("ay", "by"))).first()
    own = pts.agg(F.min("_x"), F.max("_x"), F.min("_y"), F.max("_y")).first()
    if edge[0] is None or own[0] is None:
        return pts.limit(0).select(point_id, *([F.lit(1).cast("long").alias("seg")] if with_seg else []), F.lit(0.0).alias("dist"))
    span = 2 * max(max(edge[1], own[1]) - min(edge[0], own[0]), max(edge[3], own[3]) - min(edge[2], own[2]), cell)
    found, left, last = None, pts, False
    while not last:
        last = cell >= 2 * span
        grid = lambda c: F.floor(c / cell).cast("long")  # noqa: B023, E731
        n = F.ceil(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) / (cell / 2)).cast("int")
        along = lambda i, a, b: F.col(a) + F.when(n > 0, i / n).otherwise(0.0) * (F.col(b) - F.col(a))  # noqa: B023, E731
        sampled = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(grid(along(i, "ax", "bx")).alias("_cx"), grid(along(i, "ay", "by")).alias("_cy")))  # noqa: B023
        s = segs.select(key, "seg", "ax", "ay", "bx", "by", F.inline(F.array_distinct(sampled)))
        corner = lambda c: F.round(F.col(c) / cell).cast("long")  # noqa: B023, E731
        near = F.array(*[F.struct((corner("_x") + i).alias("_cx"), (corner("_y") + j).alias("_cy")) for i in (-1, 0) for j in (-1, 0)])
        p = left.select(key, point_id, "_x", "_y", F.inline(near))
        far = F.sqrt(to_segment("_x", "_y", "ax", "ay", "bx", "by")[0])
        best = p.join(s, [key, "_cx", "_cy"]).groupBy(point_id).agg(F.min(far).alias("dist"))
        if not last:
            best = best.filter(F.col("dist") <= 0.24 * cell)
        best = checkpoint(best)
        if with_seg:
            best = checkpoint(p.join(best, point_id).join(s, [key, "_cx", "_cy"]).filter(far == F.col("dist")).groupBy(point_id).agg(F.min("seg").alias("seg"), F.min("dist").alias("dist")))
        found = best if found is None else found.unionByName(best)
        left = checkpoint(left.join(best.select(point_id), point_id, "left_anti"))
        last = last or left.isEmpty()
        cell *= growth
    return found


def nearest_rank(values: DataFrame, value: Column, by: list[str]) -> DataFrame:
    """n, median, p90 and max per group, each the sorted value at index floor(n * q): no interpolation.

    One sort within groups by (group, value), with the rank taken by a window; no group is collected into an array.
    Without groups see ``overall_rank``.
    """
    if not by:
        return overall_rank(values, value)
    x = values.select(*by, value.alias("_v")).filter("_v is not null")
    w = Window.partitionBy(*by)
    x = x.withColumns({"_r": F.row_number().over(w.orderBy("_v")) - 1, "_n": F.count(F.lit(1)).over(w)})
    at = lambda q: F.max(F.when(F.col("_r") == q, F.col("_v")))
    return x.groupBy(*by).agg(F.max("_n").alias("n"), at(F.floor(F.col("_n") / 2)).alias("median"), at(F.floor(F.col("_n") * F.lit(0.9))).alias("p90"), F.max("_v").alias("max"))


def overall_rank(values: DataFrame, value: Column) -> DataFrame:
    """n, median, p90 and max over all rows by exact selection: nowhere do all values meet in a task.

    Equal values are counted before any shuffle and the distinct ones dealt by range; the ranges' counts, one number
    each, tell which ranges hold the wanted indexes, and only those are ranked. Nulls take no part; without values all is null and n is 0.
    """
    spark = values.sparkSession
    x = values.select(value.alias("_v")).filter("_v is not null").groupBy("_v").agg(F.count(F.lit(1)).alias("_n"))
    x = x.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "_v")
    x = checkpoint(x.withColumn("_p", F.spark_partition_id()))
    counts = sorted((r["_p"], r["n"]) for r in x.groupBy("_p").agg(F.sum("_n").alias("n")).collect())  # one row a range
    n = sum(c for _, c in counts)
    at = {"median": n // 2, "p90": int(n * 0.9), "max": n - 1}
    start, starts = 0, {}
    for p, c in counts:
        starts[p] = start
        start += c
    holds = {name: max((p for p, s in starts.items() if s <= i), default=-1) for name, i in at.items()}
    upto = F.sum("_n").over(Window.partitionBy("_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = x.filter(F.col("_p").isin(*holds.values())).withColumn("_upto", upto)
    picked = [F.min(F.when((F.col("_p") == p) & (F.col("_upto") + starts.get(p, 0) > at[name]), F.col("_v"))).alias(name) for name, p in holds.items()]
    return ranked.agg(F.lit(n).cast("long").alias("n"), *picked)


def in_interval(windows: DataFrame, points: DataFrame, start: str, end: str, time: str, by: str, closed: bool, width_s: float) -> DataFrame:
    """Windows left-joined to the points of the same ``by`` inside them, ends included if ``closed``.

    Times are seconds. Windows are worked out once, listed under the time buckets they touch, and meet points by equality. A window
    with a null key or end holds no point and comes back once, as any other without points does.
    """
    windows = checkpoint(windows)
    first, last = F.floor(F.col(start) / width_s).cast("long"), F.floor(F.col(end) / width_s).cast("long")
    w = windows.withColumn("_b", F.explode(F.sequence(first, F.greatest(first, last))))
    p = points.select(F.col(by).alias("_by"), F.floor(F.col(time) / width_s).cast("long").alias("_pb"), F.struct(*[F.col(c) for c in points.columns]).alias("point"))
    t = F.col(f"point.{time}")
    inside = (t >= F.col(start)) & (t <= F.col(end)) if closed else (t > F.col(start)) & (t < F.col(end))
    hit = w.join(p, (F.col(by) == F.col("_by")) & (F.col("_b") == F.col("_pb")) & inside).select(*windows.columns, "point")
    met = hit.select(*[F.col(c).alias(f"_m{i}") for i, c in enumerate(windows.columns)]).distinct()
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_m{i}")) for i, c in enumerate(windows.columns)])
    missed = windows.join(met, same, "left_anti")
    return hit.unionByName(missed.withColumn("point", F.lit(None).cast(hit.schema["point"].dataType)))
