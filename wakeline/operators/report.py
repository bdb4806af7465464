"""Sums over tracks: distance, speeds, spans, excursions, label positions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wakeline.functions.geo import NM_M, dm_label, haversine
from wakeline.session import checkpoint

# Gates of distance and of moving speed, in knots.
MOVING_KN, AVERAGE_KN = 0.5, 0.8


def steps(fixes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds step_m, from the row before in the track; null for the first."""
    w = Window.partitionBy(key).orderBy(*order)
    return fixes.withColumn("step_m", haversine(F.lag("lat").over(w), F.lag("lon").over(w), "lat", "lon"))


def gated_nm(step: str = "step_m") -> Column:
    return F.coalesce(F.sum(F.when(F.col("sog_kn") > MOVING_KN, F.col(step))), F.lit(0.0)) / NM_M


def average_kn() -> Column:
    return F.coalesce(F.avg(F.when(F.col("sog_kn") > AVERAGE_KN, F.col("sog_kn"))), F.lit(0.0))


def max_kn() -> Column:
    return F.coalesce(F.max(F.when(F.col("sog_kn") > AVERAGE_KN, F.col("sog_kn"))), F.lit(0.0))


def extent(fixes: DataFrame, key: str, margin: float = 1.35, least: float = 0.012) -> DataFrame:
    """Centre and padded size of each track's box, for tracks of two points or more."""
    box = fixes.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("lon", "lat")]).filter("n >= 2")
    size = lambda c: F.greatest(F.col(f"max_{c}") - F.col(f"min_{c}"), F.lit(least)) * margin
    mid = lambda c: (F.col(f"min_{c}") + F.col(f"max_{c}")) / 2
    return box.select(key, mid("lon").alias("cx"), mid("lat").alias("cy"), size("lon").alias("width"), size("lat").alias("height"))


def fitted(boxes: DataFrame, ratio: float, aspect: float) -> DataFrame:
    """``boxes`` (cx, cy, width, height) widened or heightened to a page's ``ratio`` (height by width, in inches), plus west, east, south, north.

    A degree of longitude is drawn 1 / ``aspect`` as wide as one of latitude is high. A box is never made smaller.
    """
    low = F.col("height") / (F.col("width") / aspect) < ratio
    x = boxes.withColumns({"height": F.when(low, F.col("width") / aspect * ratio).otherwise(F.col("height")), "width": F.when(low, F.col("width")).otherwise(F.col("height") / ratio * aspect)})
    half = lambda c, s, sign: F.col(c) + sign * F.col(s) / 2
    return x.withColumns({"west": half("cx", "width", -1), "east": half("cx", "width", 1), "south": half("cy", "height", -1), "north": half("cy", "height", 1)})


def _axes(boxes: DataFrame, key: str) -> DataFrame:
    side = lambda name, lo, hi: F.struct(F.lit(name).alias("axis"), F.col(lo).alias("lo"), F.col(hi).alias("hi"))
    return boxes.select(key, F.explode(F.array(side("lon", "west", "east"), side("lat", "south", "north"))).alias("s")).select(key, "s.*").filter("hi > lo")


def neatline_bands(boxes: DataFrame, key: str) -> DataFrame:
    """key, axis, minute, start, end: the inked stretches of a chart's frame, every even minute, cut at the frame's corners."""
    x = _axes(boxes, key).withColumn("minute", F.explode(F.sequence(F.floor(F.col("lo") * 60), F.ceil(F.col("hi") * 60) - 1))).filter(F.pmod("minute", F.lit(2)) == 0)
    x = x.select(key, "axis", "minute", F.greatest(F.col("minute") / 60, "lo").alias("start"), F.least((F.col("minute") + 1) / 60, "hi").alias("end"))
    return x.filter("end > start")


def neatline_labels(boxes: DataFrame, key: str, every: int = 5, corner: float = 0.012) -> DataFrame:
    """key, axis, minute, at, label: every ``every`` th minute of a chart's frame, none nearer than ``corner`` degrees to a corner."""
    x = _axes(boxes, key).withColumns({"first": F.ceil(F.col("lo") * 60), "last": F.floor(F.col("hi") * 60)}).filter("first <= last")
    x = x.withColumn("minute", F.explode(F.sequence("first", "last"))).withColumn("at", F.col("minute") / 60)
    x = x.filter((F.pmod("minute", F.lit(every)) == 0) & (F.col("at") - F.col("lo") >= corner) & (F.col("hi") - F.col("at") >= corner))
    return x.select(key, "axis", "minute", "at", F.when(F.col("axis") == "lon", dm_label("at", "E", "W")).otherwise(dm_label("at", "N", "S")).alias("label"))


def camera_table(photos: DataFrame, camera: str = "camera") -> DataFrame:
    """camera, images, located, placed_by: photos with a position of their own, and how a camera's photos are placed, by it or by time. Null is a camera too."""
    located = F.count_if(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    x = photos.groupBy(camera).agg(F.count(F.lit(1)).alias("images"), located.alias("located"))
    return x.withColumn("placed_by", F.when(F.col("located") > 0, "position").otherwise("time"))


def slow_share(fixes: DataFrame, key: str, below: float = MOVING_KN) -> DataFrame:
    """key, n, slow, share: fixes of each key that have a speed, and those of them slower than ``below`` knots."""
    x = fixes.filter(F.col("sog_kn").isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("sog_kn") < below).alias("slow"))
    return x.withColumn("share", F.col("slow") / F.col("n"))


def farthest_point(points: DataFrame, key: str, order: str, chart: str, mine: int = 3, others: int = 2, candidates: int = 400, avoid=(), manual: DataFrame | None = None) -> DataFrame:
    """Per track the point farthest from the other tracks of its ``chart``, the first on ties: key, order, lat, lon, dist (degrees).

    At most ``candidates`` evenly spaced points of a track are held against every second point of the chart's
    other tracks, and against the places ``avoid`` ((lon, lat), a short fixed list). A track named in ``manual``
    (key, lat, lon) takes that position, with neither order nor distance. A track alone on its chart has none.
    Candidates go down a grid of the chart with bounds (see ``nearest_other``) instead of meeting all its points.
    """
    w = Window.partitionBy(key).orderBy(order)
    p = points.select(chart, key, order, "lat", "lon", (F.row_number().over(w) - 1).alias("i"), (F.col("lon") * F.cos(F.radians("lat"))).alias("x"), F.col("lat").alias("y"))
    own = p.filter(F.col("i") % mine == 0).withColumn("k", (F.col("i") / mine).cast("int"))
    own = own.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy(key)))
    own = own.filter(F.col("k") % F.greatest(F.lit(1), F.floor(F.col("m") / candidates)) == 0)
    if manual is not None:
        own = own.join(manual.select(key), key, "left_anti")
    kept_off = [F.hypot(F.col("x") - lon * math.cos(math.radians(lat)), F.col("y") - lat) for lon, lat in avoid]
    own = own.withColumn("most", F.least(*kept_off, F.lit(float("inf"))) if kept_off else F.lit(float("inf")))
    rest = p.filter(F.col("i") % others == 0).select(chart, key, "x", "y")
    d = nearest_other(own.select(chart, key, order, "lat", "lon", "k", "x", "y", "most"), rest, key, chart).groupBy(key, order, "lat", "lon", "k").agg(F.min("dist").alias("dist"))
    best = d.groupBy(key).agg(F.max_by(F.struct(order, "lat", "lon", "dist"), F.struct(F.round("dist", 9), -F.col("k"))).alias("b")).select(key, "b.*")
    if manual is not None:
        none = {c: F.lit(None).cast(t) for c, t in best.dtypes if c not in (key, "lat", "lon")}
        best = best.unionByName(manual.select(key, "lat", "lon").withColumns(none))
    return best


#: A grid's cells are parted SPLIT by SPLIT from one level to the next, down to about LEAF places a cell; DEEPEST levels at most.
SPLIT, LEAF, DEEPEST = 4, 8, 8
#: Distances that differ by less are told apart by the exact ones alone.
CLOSE = 1e-8


def nearest_other(own: DataFrame, rest: DataFrame, key: str, chart: str) -> DataFrame:
    """``own`` with ``dist``, the distance to a point of ``rest`` of another track of the chart, or ``most`` if less; the least one a row counts.

    ``own`` has chart, key, k, x, y and ``most``. Only rows that can be their track's farthest are answered, each with
    the points that can be its nearest. A cell of the chart's grid bounds the distance to what it holds from below by
    its square, and from above by one point in it of each of two tracks. Level by level cells beyond the least upper bound go,
    then rows whose own upper bound lies below another row's lower bound of the same track. Points at one place are one.
    """
    at = rest.groupBy(chart, F.col("x").alias("ox"), F.col("y").alias("oy")).agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    box = at.groupBy(chart).agg(F.min("ox").alias("x0"), F.min("oy").alias("y0"), F.greatest(F.max("ox") - F.min("ox"), F.max("oy") - F.min("oy"), F.lit(1e-9)).alias("size"), F.count(F.lit(1)).alias("_n"))
    at, box = checkpoint(at), checkpoint(box)
    most = box.agg(F.max("_n")).first()[0] or 1
    levels = min(DEEPEST, max(1, math.ceil(math.log(max(1.0, most / LEAF), SPLIT**2))))
    at = at.join(box.drop("_n"), chart)
    place = lambda c, c0, level: F.least(F.floor((F.col(c) - F.col(c0)) / F.col("size") * SPLIT**level), F.lit(SPLIT**level - 1)).cast("long")
    one = Window.partitionBy(key, "k")
    pairs = own.withColumn("upper", F.col("most"))
    cols = [*own.columns, "upper", "cx", "cy"]
    for level in range(1, levels + 1):
        own_key = [chart] if level == 1 else [chart, "px", "py"]
        cells = at.groupBy(chart, place("ox", "x0", level).alias("cx"), place("oy", "y0", level).alias("cy")).agg(F.first("x0").alias("x0"), F.first("y0").alias("y0"), F.first("size").alias("size"), F.min_by(F.struct("lo", "ox", "oy"), "lo").alias("a"), F.max_by(F.struct("hi", "ox", "oy"), "hi").alias("b"))
        cells = cells.withColumns({"px": F.floor(F.col("cx") / SPLIT), "py": F.floor(F.col("cy") / SPLIT)})
        met = (pairs if level == 1 else pairs.withColumnsRenamed({"cx": "px", "cy": "py"})).join(cells, own_key).filter((F.col("a.lo") != F.col(key)) | (F.col("b.hi") != F.col(key)))
        side = F.col("size") / SPLIT**level
        off = lambda v, c0, c: F.greatest(F.lit(0.0), F.col(c0) + F.col(c) * side - F.col(v), F.col(v) - F.col(c0) - (F.col(c) + 1) * side)  # noqa: E731, B023
        reach = lambda rep, name: F.when(F.col(f"{rep}.{name}") != F.col(key), F.hypot(F.col(f"{rep}.ox") - F.col("x"), F.col(f"{rep}.oy") - F.col("y")))
        met = met.withColumns({"lower": F.hypot(off("x", "x0", "cx"), off("y", "y0", "cy")), "upper": F.least("upper", reach("a", "lo"), reach("b", "hi"))})
        met = met.withColumns({"upper": F.min("upper").over(one), "nearest": F.min("lower").over(one)}).withColumn("least", F.least("most", "nearest"))
        met = met.filter((F.col("lower") <= F.col("upper") + CLOSE) | (F.col("lower") == F.col("nearest")))  # one cell stays where ``most`` decides
        met = met.withColumn("beaten", F.max(F.least("least", "upper")).over(Window.partitionBy(key))).filter(F.col("upper") >= F.col("beaten") - CLOSE)
        pairs = checkpoint(met.select(*cols))
    points = at.select(chart, place("ox", "x0", levels).alias("cx"), place("oy", "y0", levels).alias("cy"), "ox", "oy", "lo", "hi")
    found = pairs.join(points, [chart, "cx", "cy"]).filter((F.col("lo") != F.col(key)) | (F.col("hi") != F.col(key)))
    return found.withColumn("dist", F.least("most", F.hypot(F.col("ox") - F.col("x"), F.col("oy") - F.col("y")))).select(*own.columns, "dist")
