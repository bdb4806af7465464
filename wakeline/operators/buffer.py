"""Polygons widened and narrowed: offset curves with round joins, cut where they meet, kept by winding number.

Every edge moves outward along its normal; at an outward corner an arc joins two neighbours, at an inward corner the
curve goes by way of the corner itself. The points that the curves wind around are the widened polygon, so polygons
that grow together become one. Winding numbers are running sums along rows of grid cells, then a short way inside
a cell: no edge meets all others. Narrowing widens what is outside.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wakeline.operators import land
from wakeline.session import written

#: Steps of a quarter of a round join.
QUARTER = 8
#: Coordinates are whole millionths inside; a corner closer than REACH to an edge cuts it.
SCALE, REACH = 1e6, 0.75
#: Where in a cell its reference place lies: aside from the middle, so that no round coordinate meets it.
ASIDE_X, ASIDE_Y = 0.5123456789, 0.4876543211


def _corners(rings: DataFrame, back: bool) -> DataFrame:
    """(ring, ax, ay, bx, by, cx, cy): every edge with the end of the one after it, in millionths; reversed if ``back``."""
    whole = lambda c: F.round(F.col(c) * SCALE)
    v = rings.select("ring", (-F.col("place") if back else F.col("place")).alias("place"), whole("ax").alias("ax"), whole("ay").alias("ay"))
    v = v.filter("ax is not null and ay is not null and not isnan(ax) and not isnan(ay) and abs(ax) < 1e15 and abs(ay) < 1e15")
    w = Window.partitionBy("ring").orderBy("place")
    v = v.withColumns({"px": F.lag("ax").over(w), "py": F.lag("ay").over(w)}).filter("px is null or px != ax or py != ay")
    after = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(w))
    e = v.withColumns({"bx": after("ax"), "by": after("ay")}).filter("ax != bx or ay != by")
    return e.withColumns({"cx": after("bx"), "cy": after("by")}).select("ring", "ax", "ay", "bx", "by", "cx", "cy")


def offset_curve(rings: DataFrame, dist: float, quarter: int = QUARTER) -> DataFrame:
    """(ax, ay, bx, by): directed steps, in millionths, of the curves ``dist`` beside rings that have their inside on the left.

    Outside them if ``dist`` is positive; if negative the curve of the reversed rings, so inside them.
    """
    d = abs(dist) * SCALE
    e = _corners(rings, dist < 0)
    ab, bc = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")), F.hypot(F.col("cx") - F.col("bx"), F.col("cy") - F.col("by"))
    e = e.withColumns({"ux": (F.col("bx") - F.col("ax")) / ab, "uy": (F.col("by") - F.col("ay")) / ab, "vx": (F.col("cx") - F.col("bx")) / bc, "vy": (F.col("cy") - F.col("by")) / bc})
    cross, dot = F.expr("ux * vy - uy * vx"), F.expr("ux * vx + uy * vy")
    turn = F.when((cross == 0) & (dot < 0), math.pi).otherwise(F.atan2(cross, dot))
    e = e.withColumns({"turn": turn, "steps": F.greatest(F.lit(1), F.ceil(turn / (math.pi / 2) * quarter - 1e-9).cast("int")), "from": F.atan2(-F.col("ux"), F.col("uy"))})
    at = lambda x, y: F.struct(F.round(x).alias("x"), F.round(y).alias("y"))
    beside = lambda x, y, u, v: at(F.col(x) + d * F.col(v), F.col(y) - d * F.col(u))
    out, on = beside("bx", "by", "ux", "uy"), beside("bx", "by", "vx", "vy")
    arc = lambda i: at(F.col("bx") + d * F.cos(F.col("from") + F.col("turn") * i / F.col("steps")), F.col("by") + d * F.sin(F.col("from") + F.col("turn") * i / F.col("steps")))
    inner = F.when(F.col("steps") > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("steps") - 1)), arc)).otherwise(F.array().cast("array<struct<x:double,y:double>>"))
    join = F.when(F.col("turn") > 0, inner).otherwise(F.when(F.col("turn") < 0, F.array(at(F.col("bx"), F.col("by")))).otherwise(F.array().cast("array<struct<x:double,y:double>>")))
    path = e.select(F.concat(F.array(beside("ax", "ay", "ux", "uy"), out), join, F.array(on)).alias("p"))
    step = path.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.struct(F.col("p")[i - 1].alias("a"), F.col("p")[i].alias("b")))).alias("s"))
    return step.select("s.a.x", "s.a.y", "s.b.x", "s.b.y").toDF("ax", "ay", "bx", "by").filter("ax != bx or ay != by")


def _listed(edges: DataFrame, cell: float) -> DataFrame:
    """``edges`` under every grid cell (gx, gy) that they pass or come within one millionth of."""
    floor = lambda c: F.floor(c / cell).cast("long")
    x = edges.withColumn("gx", F.explode(F.sequence(floor(F.least("ax", "bx") - 1), floor(F.greatest("ax", "bx") + 1))))
    slope = (F.col("by") - F.col("ay")) / F.when(F.col("bx") != F.col("ax"), F.col("bx") - F.col("ax"))
    held = lambda c: F.greatest(F.least("ax", "bx"), F.least(F.greatest("ax", "bx"), c))
    at = lambda c: F.col("ay") + (held(c) - F.col("ax")) * slope
    left, right = F.coalesce(at(F.col("gx") * cell - 1), F.col("ay")), F.coalesce(at((F.col("gx") + 1) * cell + 1), F.col("by"))
    return x.withColumn("gy", F.explode(F.sequence(floor(F.least(left, right) - 1), floor(F.greatest(left, right) + 1))))


def _noded_once(edges: DataFrame, cell: float) -> DataFrame:
    """Undirected edges (ax, ay, bx, by, m) cut where they cross, and where a corner of another lies on them; ``m`` steps run upward more than down."""
    x = edges.withColumn("id", F.xxhash64("ax", "ay", "bx", "by"))
    g = written(_listed(x, cell))
    o = g.select("gx", "gy", *[F.col(c).alias(f"o_{c}") for c in ("id", "ax", "ay", "bx", "by")])
    near = (F.least("ax", "bx") <= F.greatest("o_ax", "o_bx") + 1) & (F.least("o_ax", "o_bx") <= F.greatest("ax", "bx") + 1) & (F.col("ay") <= F.col("o_by") + 1) & (F.col("o_ay") <= F.col("by") + 1)
    met = g.join(o, ["gx", "gy"]).filter(near & (F.col("id") != F.col("o_id")))
    # Both edges of a crossing take its place from the one of the lower id, so they agree on it to the last bit.
    low = F.col("id") < F.col("o_id")
    p = {c: F.when(low, F.col(c)).otherwise(F.col(f"o_{c}")) for c in ("ax", "ay", "bx", "by")}
    q = {c: F.when(low, F.col(f"o_{c}")).otherwise(F.col(c)) for c in ("ax", "ay", "bx", "by")}
    met = met.withColumns({**{f"p_{c}": v for c, v in p.items()}, **{f"q_{c}": v for c, v in q.items()}})
    den = F.expr("(p_bx - p_ax) * (q_by - q_ay) - (p_by - p_ay) * (q_bx - q_ax)")
    den = F.when(den != 0, den)
    t = F.expr("(q_ax - p_ax) * (q_by - q_ay) - (q_ay - p_ay) * (q_bx - q_ax)") / den
    u = F.expr("(q_ax - p_ax) * (p_by - p_ay) - (q_ay - p_ay) * (p_bx - p_ax)") / den
    cross = F.when(t.between(0, 1) & u.between(0, 1), F.struct(F.round(F.expr("p_ax") + t * F.expr("p_bx - p_ax")).alias("x"), F.round(F.expr("p_ay") + t * F.expr("p_by - p_ay")).alias("y")))
    length2 = F.expr("(bx - ax) * (bx - ax) + (by - ay) * (by - ay)")

    def touch(cx: str, cy: str):
        off = F.abs(F.expr(f"({cx} - ax) * (by - ay) - ({cy} - ay) * (bx - ax)")) / F.sqrt(length2)
        along = F.expr(f"({cx} - ax) * (bx - ax) + ({cy} - ay) * (by - ay)")
        return F.when((off <= REACH) & (along > 0) & (along < length2), F.struct(F.col(cx).alias("x"), F.col(cy).alias("y")))

    cuts = met.select("id", "ax", "ay", "bx", "by", F.explode(F.array(cross, touch("o_ax", "o_ay"), touch("o_bx", "o_by"))).alias("c")).filter("c is not null").select("id", "c").distinct()
    ends = x.select("id", F.explode(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))).alias("c"))
    at = cuts.unionByName(ends).distinct().join(x.select("id", "m", "ax", "ay", F.expr("bx - ax").alias("dx"), F.expr("by - ay").alias("dy")), "id")
    at = at.withColumn("t", F.expr("(c.x - ax) * dx + (c.y - ay) * dy"))
    w = Window.partitionBy("id").orderBy("t", "c")
    piece = at.withColumn("d", F.lead("c").over(w)).filter("d is not null")
    return merged(piece.select(F.col("c.x").alias("ax"), F.col("c.y").alias("ay"), F.col("d.x").alias("bx"), F.col("d.y").alias("by"), "m"))


def merged(steps: DataFrame) -> DataFrame:
    """(ax, ay, bx, by, m): steps of one place to another as one edge, lower end first; those that cancel out are gone."""
    up = F.expr("ay < by or (ay = by and ax < bx)")
    pick = lambda a, b: F.when(up, F.col(a)).otherwise(F.col(b))
    x = steps.filter("ax != bx or ay != by").select(pick("ax", "bx").alias("ax"), pick("ay", "by").alias("ay"), pick("bx", "ax").alias("bx"), pick("by", "ay").alias("by"), F.when(up, F.col("m")).otherwise(-F.col("m")).alias("m"))
    return x.groupBy("ax", "ay", "bx", "by").agg(F.sum("m").alias("m")).filter("m != 0")


def noded(steps: DataFrame, cell: float) -> DataFrame:
    """(ax, ay, bx, by, m) of directed steps, cut until no cut makes more edges (whole millionths can move an edge onto another)."""
    now = written(merged(steps.withColumn("m", F.lit(1).cast("long"))))
    seen = -1
    while (n := now.count()) != seen:
        seen, now = n, written(_noded_once(now, cell))
    return now


def winding(points: DataFrame, edges: DataFrame, cell: float) -> DataFrame:
    """``points`` (id, x, y) with ``w``, how often the edges (ax, ay, bx, by, m; lower end first) wind around each.

    A point on an edge counts as just left of it, or above it if the edge is level; ``own``, where points have it, names the edge (xxhash64 of its
    ends) a point lies on. A cell's edges and points meet in one place, so ``cell`` should hold few edges.
    """
    if "own" not in points.columns:
        points = points.withColumn("own", F.lit(None).cast("long"))
    e = edges.withColumn("eid", F.xxhash64("ax", "ay", "bx", "by"))
    rows = e.withColumn("gy", F.explode(F.sequence(F.floor(F.col("ay") / cell).cast("long"), F.floor(F.col("by") / cell).cast("long"))))
    line = (F.col("gy") + ASIDE_Y) * cell
    rows = rows.filter((F.col("ay") <= line) & (F.col("by") > line)).withColumn("xc", F.expr("ax") + (line - F.col("ay")) / F.expr("by - ay") * F.expr("bx - ax"))
    jumps = rows.groupBy("gy", (F.floor(F.col("xc") / cell - ASIDE_X) + 1).cast("long").alias("gx")).agg(F.sum(-F.col("m")).alias("w0"))
    p = points.withColumns({"gx": F.floor(F.col("x") / cell).cast("long"), "gy": F.floor(F.col("y") / cell).cast("long")})
    asked = p.select("gy", "gx", F.lit(0).cast("long").alias("w0"))
    run = Window.partitionBy("gy").orderBy("gx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = jumps.unionByName(asked).groupBy("gy", "gx").agg(F.sum("w0").alias("w0")).withColumn("w0", F.sum("w0").over(run))
    rx, ry = (F.col("gx") + ASIDE_X) * cell, (F.col("gy") + ASIDE_Y) * cell
    m = p.select("id", "x", "y", "own", "gx", "gy").join(_listed(e, cell), ["gx", "gy"])
    yc = F.expr("ay") + (rx - F.col("ax")) / F.when(F.expr("bx != ax"), F.expr("bx - ax")) * F.expr("by - ay")
    side = F.when((F.col("ax") <= rx) & (F.col("bx") > rx), F.col("m")).when((F.col("bx") <= rx) & (F.col("ax") > rx), -F.col("m"))
    rise = F.when((ry < yc) & (yc <= F.col("y")), side).when((F.col("y") < yc) & (yc <= ry), -side)
    xc = F.when(F.col("own") == F.col("eid"), F.col("x")).otherwise(F.expr("ax + (y - ay) / nullif(by - ay, 0) * (bx - ax)"))
    over = F.expr("ay <= y and by > y")
    run_x = F.when(over & (rx <= xc) & (xc < F.col("x")), -F.col("m")).when(over & (F.col("x") <= xc) & (xc < rx), F.col("m"))
    zero = F.lit(0).cast("long")
    moved = m.select("id", (F.coalesce(rise, zero) + F.coalesce(run_x, zero)).alias("d")).groupBy("id").agg(F.sum("d").alias("d"))
    out = p.join(start, ["gy", "gx"]).join(moved, "id", "left")
    return out.select(*points.columns, (F.col("w0") + F.coalesce("d", zero)).alias("w"))


def buffered(rings: DataFrame, dist: float, cell: float, quarter: int = QUARTER) -> DataFrame:
    """Ring edges (polygon, ring, hole, place, ax, ay, bx, by) of polygons widened by ``dist``, or narrowed if negative.

    ``rings`` has ring, place (the order along it) and the edges' starts ax, ay, inside on the left, so holes run the other way: what
    this and ``land.land_polygons`` return. Widened polygons that meet are one, holes that fill are gone; for narrowing the
    rings must not overlap. Round joins are arcs of ``quarter`` steps a right angle, inside the true circle. Places without
    finite coordinates are left out of their ring, repeated places count once; a ring of two places widens like a line,
    one of a single place, and an empty table, give nothing. ``cell``, in the units of the coordinates, is the grid on which edges meet: about the length
    of an edge or ``dist``, whichever is more. Coordinates come out as whole millionths.
    """
    unit = cell * SCALE
    e = noded(offset_curve(rings, dist, quarter), unit).withColumn("own", F.xxhash64("ax", "ay", "bx", "by"))
    mid = e.select(F.col("own").alias("id"), F.expr("(ax + bx) / 2").alias("x"), F.expr("(ay + by) / 2").alias("y"), "own")
    left = e.join(winding(mid, e.drop("own"), unit).select(F.col("id").alias("own"), "w"), "own").withColumn("r", F.col("w") - F.col("m"))
    within = "{0} >= 1" if dist >= 0 else "{0} > -1"
    left = left.withColumns({"_l": F.expr(within.format("w")), "_r": F.expr(within.format("r"))}).filter("_l != _r")
    if dist < 0:  # the curve winds around the outside that stays; what it leaves is narrowed
        left = left.withColumn("_l", ~F.col("_l"))
    end = lambda a, b: (F.when(F.col("_l"), F.col(a)).otherwise(F.col(b)) / SCALE).alias(a)
    return land.traced(left.select(end("ax", "bx"), end("ay", "by"), end("bx", "ax"), end("by", "ay")), cell)


def covered(points: DataFrame, rings: DataFrame, cell: float) -> DataFrame:
    """``points`` (id, x, y) with ``inside``: whether the rings wind around them. Points without finite coordinates are outside."""
    unit = cell * SCALE
    e = merged(rings.select(*[F.round(F.col(c) * SCALE).alias(c) for c in ("ax", "ay", "bx", "by")], F.lit(1).cast("long").alias("m")))
    fine = F.coalesce(F.abs(F.col("x")) + F.abs(F.col("y")) < 1e9, F.lit(False)) & ~F.isnan("x") & ~F.isnan("y")
    found = winding(points.filter(fine).select("id", (F.col("x") * SCALE).alias("x"), (F.col("y") * SCALE).alias("y")), written(e), unit)
    return points.join(found.select("id", "w"), "id", "left").select(*points.columns, (F.coalesce("w", F.lit(0)) > 0).alias("inside"))
