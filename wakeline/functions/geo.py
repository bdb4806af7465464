"""Geodesy and planar geometry as Column expressions.

Three metrics are kept apart: the haversine on a sphere (metres), a local plane scaled at one
latitude (kilometres or metres per degree), and plain degrees of latitude.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Results depend on them to the last digit.
EARTH_M = 6_371_000.0
NM_M = 1852.0
KN_PER_MS = 1.94384
LAT0 = 26.5
KM_PER_DEG = 111.0
M_PER_DEG = 111_000.0
CORRIDOR_S, CORRIDOR_N, CORRIDOR_FADE = 26.470, 26.520, 0.010
BARRIER = (
    (-77.190, 26.720), (-77.145, 26.690), (-77.090, 26.652), (-77.045, 26.628), (-77.003, 26.596), (-76.972, 26.560), (-76.955, 26.535),
    (-76.968, 26.500), (-76.975, 26.455), (-76.978, 26.410), (-76.982, 26.365), (-76.995, 26.322), (-77.010, 26.280),
)
OFFSHORE_KM = 0.5

K0 = math.cos(math.radians(LAT0))


def col(c: Column | str | float) -> Column:
    return c if isinstance(c, Column) else F.col(c) if isinstance(c, str) else F.lit(float(c))


def haversine(a_lat, a_lon, b_lat, b_lon) -> Column:
    """Metres between two points in degrees."""
    p, q = F.radians(col(a_lat)), F.radians(col(b_lat))
    dl = F.radians(col(b_lon) - col(a_lon))
    s, t = F.sin((q - p) / 2), F.sin(dl / 2)
    return 2 * EARTH_M * F.asin(F.sqrt(s * s + F.cos(p) * F.cos(q) * t * t))


def haversine_m(a_lat: float, a_lon: float, b_lat: float, b_lon: float) -> float:
    """The same for plain numbers, for the sequential kernels."""
    p, q = math.radians(a_lat), math.radians(b_lat)
    s, t = math.sin((q - p) / 2), math.sin(math.radians(b_lon - a_lon) / 2)
    return 2 * EARTH_M * math.asin(math.sqrt(s * s + math.cos(p) * math.cos(q) * t * t))


def to_segment(px, py, ax, ay, bx, by) -> tuple[Column, Column]:
    """(squared distance to the segment, cross product): the cross product is positive left of a->b."""
    px, py, ax, ay, bx, by = map(col, (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    len2 = dx * dx + dy * dy
    t = F.when(len2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / len2))).otherwise(0.0)
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return ex * ex + ey * ey, dx * (py - ay) - dy * (px - ax)


def offshore_km(lon, lat, barrier=BARRIER) -> Column:
    """Signed kilometres to the nearest barrier segment, the first on ties; positive to the left of its direction."""
    x, y = col(lon) * K0, col(lat)
    d2, side = [], []
    for (a_lon, ay), (b_lon, by) in zip(barrier, barrier[1:]):
        ax, dx, dy = a_lon * K0, (b_lon - a_lon) * K0, by - ay
        len2 = dx * dx + dy * dy
        # Off the line squared, plus what lies before or beyond the segment along it; every part is named once to keep the code small.
        off = dx * (y - ay) - dy * (x - ax)
        beyond = F.greatest(F.abs(((x - ax) * dx + (y - ay) * dy) * (1 / len2) - 0.5) - 0.5, F.lit(0.0))
        d2.append(F.pow(off, F.lit(2.0)) * (1 / len2) + F.pow(beyond, F.lit(2.0)) * len2)
        side.append(F.when(off > 0, 1.0).otherwise(-1.0))
    # Unrolled over constants, all in generated code; the array is one subexpression, so it is made once.
    each = F.array(*d2)
    return F.get(F.array(*side), F.array_position(each, F.array_min(each)).cast("int") - 1) * F.sqrt(F.array_min(each)) * KM_PER_DEG


def with_offshore_km(rows: DataFrame, lon="lon", lat="lat", name: str = "km") -> DataFrame:
    """``rows`` plus their offshore distance, for use in filters and sums.

    Generated rows keep what is above them from being merged into what is below: the position's own expressions and the
    distance are evaluated once a row, however often either is mentioned, and the generated code stays small.
    """
    at = rows.select("*", F.inline(F.array(F.struct(col(lon).alias("_lon"), col(lat).alias("_lat")))))
    return at.select(*rows.columns, F.inline(F.array(F.struct(offshore_km("_lon", "_lat").alias(name)))))


def corridor_gate(lat) -> Column:
    """1 inside the corridor, 0 outside, linear across its margins."""
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return F.least(unit((col(lat) - (CORRIDOR_S - CORRIDOR_FADE)) / CORRIDOR_FADE), unit(((CORRIDOR_N + CORRIDOR_FADE) - col(lat)) / CORRIDOR_FADE))


def micro(deg) -> Column:
    """Degrees as whole millionths: an exact key for equality joins."""
    return F.round(col(deg) * 1e6).cast("long")


def crossing(p, q, r, s) -> tuple[Column, Column]:
    """(t, u) where p->q and r->s meet; both null if parallel. Each point is a pair (x, y)."""
    (px, py), (qx, qy), (rx, ry), (sx, sy) = [tuple(map(col, v)) for v in (p, q, r, s)]
    ax, ay, bx, by = qx - px, qy - py, sx - rx, sy - ry
    den = ax * by - ay * bx
    dx, dy = rx - px, ry - py
    den = F.when(den != 0, den)
    return (dx * by - dy * bx) / den, (dx * ay - dy * ax) / den


def clip(ax, ay, bx, by, west: float, south: float, east: float, north: float) -> Column:
    """The part of a->b inside the box as struct(ax, ay, bx, by), direction kept; null if none (Liang-Barsky)."""
    ax, ay, bx, by = map(col, (ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    lo, hi, out = F.lit(0.0), F.lit(1.0), F.lit(False)
    for p, q in ((-dx, ax - west), (dx, east - ax), (-dy, ay - south), (dy, north - ay)):
        t = q / F.when(p != 0, p)
        lo = F.when(p < 0, F.greatest(lo, t)).otherwise(lo)
        hi = F.when(p > 0, F.least(hi, t)).otherwise(hi)
        out = out | ((p == 0) & (q < 0))
    part = F.struct((ax + lo * dx).alias("ax"), (ay + lo * dy).alias("ay"), (ax + hi * dx).alias("bx"), (ay + hi * dy).alias("by"))
    return F.when(~out & (lo < hi), part)


def ring_moments(xs: Column, ys: Column) -> tuple[Column, Column, Column]:
    """(signed area, centroid x, centroid y) of a ring given as two arrays, first point not repeated."""
    n = F.size(xs)
    nxt = lambda a: F.concat(F.slice(a, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(a, 1, 1))
    e = F.arrays_zip(xs.alias("x"), ys.alias("y"), nxt(xs).alias("u"), nxt(ys).alias("v"))
    total = lambda f: F.aggregate(F.transform(e, f), F.lit(0.0), lambda a, b: a + b)
    w = lambda p: p["x"] * p["v"] - p["u"] * p["y"]
    area = total(w) / 2
    safe = F.when(area != 0, area)
    return area, total(lambda p: (p["x"] + p["u"]) * w(p)) / (6 * safe), total(lambda p: (p["y"] + p["v"]) * w(p)) / (6 * safe)


def dm_label(value, pos: str, neg: str) -> Column:
    """Degrees and whole minutes, such as 26°33′N, with a prime: degrees cut, minutes rounded half to even, 60 carried."""
    v = F.abs(col(value))
    deg = F.floor(v)
    minutes = F.bround((v - deg) * 60, 0)
    carried = F.when(minutes >= 60, deg + 1).otherwise(deg)
    return F.concat(carried.cast("int").cast("string"), F.lit("°"), F.lpad(F.when(minutes >= 60, 0).otherwise(minutes).cast("int").cast("string"), 2, "0"), F.lit("\u2032"), F.when(col(value) >= 0, pos).otherwise(neg))
