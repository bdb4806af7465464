"""Land polygons from directed coastlines: faces of lines and frame, the left-hand rule, holes, dissolving.

Land lies to the left of a coastline's direction. A face is land if a point inside it lies to the left of
the nearest way. Rings inside a face are found by looking left from their leftmost corner to the next edge,
through bands of latitude; land faces dissolve by dropping the edges between them and tracing what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wakeline.functions.geo import clip
from wakeline.operators import match, polygons
from wakeline.session import checkpoint, written

#: The line number of the frame's edges.
FRAME = (1 << 63) - 1
#: How far along its way the nearest place's direction is taken, to both sides.
REACH = 1e-5


def _frame(spark, west: float, south: float, east: float, north: float) -> DataFrame:
    c = [(west, south), (east, south), (east, north), (west, north)]
    rows = [(FRAME, -1 - i, *c[i], *c[(i + 1) % 4]) for i in range(4)]
    return spark.createDataFrame(rows, "line long, seg long, ax double, ay double, bx double, by double")


def ring_parents(half: DataFrame, band: float) -> DataFrame:
    """(face, area, parent): the signed area of every ring, and for rings of negative area the face around them.

    A ring of positive area is its own parent; a ring around which there is nothing has none. Edges are listed under the
    bands of height ``band`` they pass, and one corner of each ring meets the edges of its band.
    """
    w = F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")
    rings = written(half.groupBy("face").agg((F.sum(w) / 2).alias("area"), F.min(F.struct("ax", "ay")).alias("p")))
    inner = rings.filter("area <= 1e-12").select(F.col("face").alias("ring"), F.col("p.ax").alias("px"), F.col("p.ay").alias("py"), F.floor(F.col("p.ay") / band).cast("long").alias("_b"))
    # An edge going down has what is right of it to its left: its ring is the one seen from there.
    down = half.filter("by < ay").withColumn("_b", F.explode(F.sequence(F.floor(F.col("by") / band).cast("long"), F.floor(F.col("ay") / band).cast("long"))))
    slope = (F.col("ax") - F.col("bx")) / (F.col("ay") - F.col("by"))
    at = F.col("bx") + (F.col("py") - F.col("by")) * slope
    seen = inner.join(down, "_b").filter((F.col("by") <= F.col("py")) & (F.col("py") < F.col("ay"))).withColumns({"_x": at, "_s": slope}).filter("_x < px")
    hit = seen.groupBy("ring").agg(F.max(F.struct("_x", "_s", "face")).alias("h")).select("ring", F.col("h.face").alias("to"))
    own = rings.filter("area > 1e-12").select(F.col("face").alias("ring"), F.col("face").alias("to"))
    now = written(inner.select("ring").join(hit, "ring", "left").unionByName(own))
    while True:  # rings seen beside a ring: on to what that one sees, twice as far each time
        on = now.select(F.col("ring").alias("to"), F.col("to").alias("to2"))
        new = written(now.join(on, "to", "left").select("ring", F.col("to2").alias("to"), (~F.col("to").eqNullSafe(F.col("to2"))).alias("moved")))
        moved = new.filter("moved").limit(1).count()
        now = new.select("ring", "to")
        if not moved:
            break
    return rings.join(now.select(F.col("ring").alias("face"), F.col("to").alias("parent")), "face").select("face", "area", "parent")


def inner_points(half: DataFrame) -> DataFrame:
    """(face, x, y): a point inside each face, the middle of its widest stretch near half its height. ``half`` has its holes' edges too."""
    ys = half.select("face", F.col("ay").alias("v"))
    mid = ys.groupBy("face").agg(((F.min("v") + F.max("v")) / 2).alias("m"))
    level = ys.join(mid, "face").groupBy("face").agg(((F.max(F.when(F.col("v") <= F.col("m"), F.col("v"))) + F.min(F.when(F.col("v") > F.col("m"), F.col("v")))) / 2).alias("y"))
    cut = half.join(level, "face").filter((F.least("ay", "by") < F.col("y")) & (F.greatest("ay", "by") > F.col("y")))
    cut = cut.select("face", "y", (F.col("ax") + (F.col("y") - F.col("ay")) / (F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax"))).alias("x"))
    w = Window.partitionBy("face").orderBy("x")
    span = cut.withColumns({"k": F.row_number().over(w), "x2": F.lead("x").over(w)}).filter("k % 2 = 1 and x2 is not null")
    return span.groupBy("face").agg(F.max(F.struct((F.col("x2") - F.col("x")).alias("wide"), ((F.col("x") + F.col("x2")) / 2).alias("x"), "y")).alias("s")).select("face", "s.x", "s.y")


def left_of_nearest(points: DataFrame, coast: DataFrame, cell: float) -> DataFrame:
    """face and ``land`` of points (face, x, y): whether each lies left of the way nearest to it, the lowest ``seg`` on ties.

    The direction is taken from REACH before to REACH behind the nearest place along its way, so a corner has
    the direction of its chord.
    """
    w = Window.partitionBy("line").orderBy("seg")
    size = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    s = coast.filter("ax != bx or ay != by").select("line", "seg", "ax", "ay", "bx", "by", size.alias("len"), ((F.col("bx") - F.col("ax")) / size).alias("ux"), ((F.col("by") - F.col("ay")) / size).alias("uy"))
    joined = lambda f, a, b, c, d: (f(a).over(w) == F.col(b)) & (f(c).over(w) == F.col(d))
    s = s.withColumns({"pre": joined(F.lag, "bx", "ax", "by", "ay"), "post": joined(F.lead, "ax", "bx", "ay", "by"), "pux": F.lag("ux").over(w), "puy": F.lag("uy").over(w), "nux": F.lead("ux").over(w), "nuy": F.lead("uy").over(w)})
    s = checkpoint(s)
    near = match.nearest_segment(points.select(F.lit(1).alias("all"), F.struct("face").alias("id"), "x", "y"), s.select(F.lit(1).alias("all"), "seg", "ax", "ay", "bx", "by"), "all", "id", cell)
    x = points.join(near.select("id.face", "seg"), "face").join(s, "seg")
    along = F.greatest(F.lit(0.0), F.least(F.col("len"), (F.col("x") - F.col("ax")) * F.col("ux") + (F.col("y") - F.col("ay")) * F.col("uy")))
    x = x.withColumn("d", along)

    def back(a: str, u: str, p: str):
        inside = F.col(a) + (F.col("d") - REACH) * F.col(u)
        return F.when(F.col("d") >= REACH, inside).when(F.col("pre"), F.col(a) + (F.col("d") - REACH) * F.col(p)).otherwise(F.col(a))

    def ahead(a: str, b: str, u: str, n: str):
        left = F.col("len") - F.col("d")
        return F.when(left >= REACH, F.col(a) + (F.col("d") + REACH) * F.col(u)).when(F.col("post"), F.col(b) + (REACH - left) * F.col(n)).otherwise(F.col(b))

    x = x.withColumns({"fx": back("ax", "ux", "pux"), "fy": back("ay", "uy", "puy"), "gx": ahead("ax", "bx", "ux", "nux"), "gy": ahead("ay", "by", "uy", "nuy")})
    cross = (F.col("gx") - F.col("fx")) * (F.col("y") - F.col("fy")) - (F.col("gy") - F.col("fy")) * (F.col("x") - F.col("fx"))
    return x.select("face", (cross > 0).alias("land"))


def _clipped(coast: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    whole = coast.filter("ax is not null and ay is not null and bx is not null and by is not null")
    return whole.withColumn("c", clip("ax", "ay", "bx", "by", west, south, east, north)).filter("c is not null").select("line", "seg", "c.*")


def faces_of(coast: DataFrame, west: float, south: float, east: float, north: float, cell: float) -> tuple[DataFrame, DataFrame]:
    """Half-edges of coastlines and frame, with ``own`` the face that they bound, and (face, area, land) of the faces.

    ``coast`` has line, seg (unique, in order along a line) and ends; it is cut to the box. A face's area is without
    its holes. Raises if no coastline lies in the box.
    """
    near = checkpoint(_clipped(coast, west, south, east, north))
    if near.isEmpty():
        raise ValueError("no coastline in the box")
    pieces = polygons.split_at_crossings(near.unionByName(_frame(coast.sparkSession, west, south, east, north)), cell)
    half = written(polygons.faces(pieces))
    parents = checkpoint(ring_parents(half, cell))
    half = written(half.join(parents.select("face", F.col("parent").alias("own")), "face"))
    inside = half.filter("own is not null").select(F.col("own").alias("face"), "ax", "ay", "bx", "by")
    land = left_of_nearest(checkpoint(inner_points(inside)), near, cell)
    areas = parents.filter("parent is not null").groupBy(F.col("parent").alias("face")).agg(F.sum("area").alias("area"))
    return half, written(areas.join(land, "face", "left").withColumn("land", F.coalesce("land", F.lit(False))))


def traced(edges: DataFrame, cell: float) -> DataFrame:
    """polygon, ring, hole, place, ax, ay, bx, by of boundary edges (ax, ay, bx, by) that have the inside on their left."""
    rings = written(polygons.faces(edges.withColumn("line", F.lit(1).cast("long")), order=True).filter("along"))
    every = ring_parents(rings, cell).select("face", F.col("parent").alias("polygon"), (F.col("area") < 0).alias("hole"))
    return written(rings.join(every, "face").select("polygon", F.col("face").alias("ring"), "hole", "place", "ax", "ay", "bx", "by"))


def land_polygons(coast: DataFrame, west: float, south: float, east: float, north: float, cell: float) -> DataFrame:
    """Ring edges of the land in a box: polygon, ring, hole, place, ax, ay, bx, by.

    ``polygon`` is the ring around the land, ``ring`` that one or one of its ``hole`` s; edges run with the land on
    their left, ``place`` counts them from 0 along their ring. Faces of land that share an edge are one polygon. No land gives no
    rows; no coastline in the box raises.
    """
    half, found = faces_of(coast, west, south, east, north, cell)
    x = half.join(found.select(F.col("face").alias("own"), "land"), "own", "left").withColumn("land", F.coalesce("land", F.lit(False)))
    x = written(x.select("ax", "ay", "bx", "by", "land"))
    other = x.filter("land").select(F.col("bx").alias("ax"), F.col("by").alias("ay"), F.col("ax").alias("bx"), F.col("ay").alias("by"))
    edge = x.filter("land").join(other, ["ax", "ay", "bx", "by"], "left_anti").select("ax", "ay", "bx", "by")
    return traced(edge, cell)


def land_table(rings: DataFrame) -> DataFrame:
    """polygon, area (without holes), n_holes and n_edges of every polygon of ``land_polygons``."""
    w = F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")
    return rings.groupBy("polygon").agg((F.sum(w) / 2).alias("area"), F.count_distinct(F.when(F.col("hole"), F.col("ring"))).alias("n_holes"), F.count(F.lit(1)).alias("n_edges"))
