"""Faces of a planar line network, built from joins and windows.

Lines are split where they cross, every piece becomes two half-edges, and the next half-edge around
a face is the neighbouring one by angle at the node. Faces are the rings of that mapping, found by pointer
doubling; areas and centroids are sums over a ring's half-edges and need no order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wakeline.functions.geo import clip, crossing, micro
from wakeline.session import written


def clip_lines(segs: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Segments (line, ax, ay, bx, by) cut to the box, direction kept."""
    x = segs.withColumn("c", clip("ax", "ay", "bx", "by", west, south, east, north)).filter("c is not null")
    return x.select("line", "c.*")


def clip_ways(segs: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """(line, part, pos, x, y): the vertices, in direction, of the parts of each way inside the box, parts counted from 1.

    ``segs`` has line, seg (counts a way's segments without gaps) and ends. A way that leaves the box and comes back is
    as many parts; one that only touches it has none. A segment goes on with the part before it if it is the next one
    and starts inside, so at a vertex that is in the box.
    """
    x = segs.withColumn("c", clip("ax", "ay", "bx", "by", west, south, east, north)).filter("c is not null")
    way = Window.partitionBy("line").orderBy("seg")
    on = (F.lag("seg").over(way) == F.col("seg") - 1) & (F.col("c.ax") == F.col("ax")) & (F.col("c.ay") == F.col("ay"))
    x = x.withColumn("first", ~F.coalesce(on, F.lit(False)))
    x = x.withColumn("part", F.sum(F.col("first").cast("long")).over(way))
    start = F.when(F.col("first"), F.struct(F.col("c.ax").alias("x"), F.col("c.ay").alias("y")))
    end = F.struct(F.col("c.bx").alias("x"), F.col("c.by").alias("y"))
    x = x.withColumn("_at", F.row_number().over(Window.partitionBy("line", "part").orderBy("seg")))
    v = x.select("line", "part", "_at", F.posexplode(F.array(start, end)).alias("_i", "v")).filter("v is not null")
    return v.select("line", "part", (F.col("_at") - 1 + F.col("_i")).cast("long").alias("pos"), "v.x", "v.y")


def split_at_crossings(segs: DataFrame, cell: float) -> DataFrame:
    """(line, seg, ax, ay, bx, by): pieces between crossings and touching ends. ``segs`` has line, seg and ends.

    Segments meet through the grid cells they pass, and one step around them, so only neighbours are compared: a
    segment is listed in proportion to its length, and one side of each meeting is listed in its own cells alone.
    """
    steps = F.ceil(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) / (cell / 2)).cast("int")
    at = lambda a, b: F.floor((F.col(a) + F.col("_i") / F.greatest("_m", F.lit(1)) * (F.col(b) - F.col(a))) / cell).cast("long")
    own = segs.withColumn("_m", steps).withColumn("_i", F.explode(F.sequence(F.lit(0), "_m")))
    own = own.select("line", "seg", "ax", "ay", "bx", "by", at("ax", "bx").alias("cx"), at("ay", "by").alias("cy")).distinct()
    around = F.sequence(F.lit(-1).cast("long"), F.lit(1).cast("long"))
    g = own.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around))
    g = g.select("line", "seg", "ax", "ay", "bx", "by", (F.col("cx") + F.col("_dx")).alias("cx"), (F.col("cy") + F.col("_dy")).alias("cy")).distinct()
    o = own.select("cx", "cy", *[F.col(c).alias(f"o_{c}") for c in ("seg", "ax", "ay", "bx", "by")])
    t, u = crossing(("ax", "ay"), ("bx", "by"), ("o_ax", "o_ay"), ("o_bx", "o_by"))
    tiny = 1e-9
    cuts = g.join(o, ["cx", "cy"]).filter("seg != o_seg").withColumns({"t": t, "u": u})
    cuts = cuts.filter(F.col("t").between(-tiny, 1 + tiny) & F.col("u").between(-tiny, 1 + tiny)).select("seg", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("t"))).alias("t"))
    ends = segs.select("seg", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t"))
    at = cuts.unionByName(ends).distinct()
    w = Window.partitionBy("seg").orderBy("t")
    parts = at.withColumn("t2", F.lead("t").over(w)).filter("t2 is not null").join(segs, "seg")
    place = lambda t, a, b: F.col(a) + F.col(t) * (F.col(b) - F.col(a))
    return parts.select("line", "seg", place("t", "ax", "bx").alias("ax"), place("t", "ay", "by").alias("ay"), place("t2", "ax", "bx").alias("bx"), place("t2", "ay", "by").alias("by"))


def faces(pieces: DataFrame, scale: float = 1e6, order: bool = False) -> DataFrame:
    """(face, a, b, ax, ay, bx, by, along): half-edges with their face on the left.

    Node keys are coordinates in millionths; ``along`` is true for a half-edge that runs as its line does.
    Dangling pieces lie in one face on both sides; the unbounded face has negative area. With ``order``, ``place`` counts
    the half-edges of a ring from 0, the one with the least ends, in the order in which they follow each other.
    """
    node = lambda x, y: F.struct(micro(x).alias("x"), micro(y).alias("y"))
    one = pieces.select(node("ax", "ay").alias("a"), node("bx", "by").alias("b"), "line").filter("a != b").groupBy("a", "b").agg(F.min("line").alias("line"))
    both = one.withColumn("along", F.lit(True)).unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "line").withColumn("along", F.lit(False)))
    both = both.groupBy("a", "b").agg(F.max("along").alias("along"), F.min("line").alias("line"))
    angle = F.atan2((F.col("b.y") - F.col("a.y")).cast("double"), (F.col("b.x") - F.col("a.x")).cast("double"))
    half = written(both.withColumn("angle", angle).withColumn("id", F.struct("a", "b")))
    # Around node b, after arriving from a: the half-edge just clockwise of the way back keeps the face on the left.
    w = Window.partitionBy("a").orderBy("angle")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = half.select("a", "b", F.coalesce(F.lag("id").over(w), F.last("id").over(whole)).alias("next"))
    follow = half.join(turn.select(F.col("a").alias("b"), F.col("b").alias("a"), "next"), ["a", "b"])
    follow = written(follow.select("id", "next"))
    ring = follow.withColumn("least", F.least("id", "next"))
    while True:
        far = ring.select(F.col("id").alias("next"), F.col("next").alias("next2"), F.col("least").alias("least2"))
        new = written(ring.join(far, "next").select("id", F.col("next2").alias("next"), F.least("least", "least2").alias("now"), "least"))
        moved = new.filter("now != least").limit(1).count()
        ring = new.select("id", "next", F.col("now").alias("least"))
        if not moved:
            break
    out = half.join(ring.select("id", F.col("least").alias("face")), "id")
    if order:
        out = out.join(_places(follow.join(ring.select("id", F.col("least").alias("face")), "id")), "id")
    deg = lambda c: (F.col(c) / scale)
    return out.select("face", "line", "along", deg("a.x").alias("ax"), deg("a.y").alias("ay"), deg("b.x").alias("bx"), deg("b.y").alias("by"), *(["place"] if order else []))


def _places(ring: DataFrame) -> DataFrame:
    """(id, place) of half-edges (id, next, face): steps to the ring's end, by doubling from the edge before its first."""
    now = written(ring.select("id", F.when(F.col("next") != F.col("face"), F.col("next")).alias("next"), F.when(F.col("next") != F.col("face"), 1).otherwise(0).cast("long").alias("left"), "face"))
    while not now.filter("next is not null").isEmpty():
        far = now.select(F.col("id").alias("next"), F.col("next").alias("next2"), F.col("left").alias("left2"))
        now = written(now.join(far, "next", "left").select("id", F.col("next2").alias("next"), (F.col("left") + F.coalesce("left2", F.lit(0))).alias("left"), "face"))
    size = now.groupBy("face").agg(F.max("left").alias("most"))
    return now.join(size, "face").select("id", (F.col("most") - F.col("left")).alias("place"))


def face_table(half: DataFrame, coast: Column) -> DataFrame:
    """face, area, cx, cy, land of the bounded faces: land lies to the left of a coastline's direction."""
    w = F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")
    t = half.groupBy("face").agg((F.sum(w) / 2).alias("area"), F.sum((F.col("ax") + F.col("bx")) * w).alias("mx"), F.sum((F.col("ay") + F.col("by")) * w).alias("my"), F.max(coast & F.col("along")).alias("land"))
    t = t.filter("area > 1e-12")
    return t.select("face", "area", (F.col("mx") / (6 * F.col("area"))).alias("cx"), (F.col("my") / (6 * F.col("area"))).alias("cy"), "land")


def ring_areas(points: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys and the signed ``area`` of each ring of points (x, y): a sum over rows, so a ring of any length needs bounded memory."""
    w = Window.partitionBy(*keys).orderBy(*order)
    after = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(w))
    e = points.withColumns({"u": after("x"), "v": after("y")})
    return e.groupBy(*keys).agg((F.sum(F.col("x") * F.col("v") - F.col("u") * F.col("y")) / 2).alias("area"))
