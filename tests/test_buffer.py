"""Widened and narrowed polygons: areas, and inside or outside against plain distances."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from wakeline.operators import buffer, land, polygons

EDGES = "ring long, place long, ax double, ay double, bx double, by double"
NGON = 0.5 * 32 * math.sin(2 * math.pi / 32)  # area of a round join's whole circle, of radius 1


def edges(spark, rings):
    rows = [(i, k, *ring[k], *ring[(k + 1) % len(ring)]) for i, ring in enumerate(rings) for k in range(len(ring))]
    return spark.createDataFrame([tuple(None if v is None else (float(v) if j > 1 else v) for j, v in enumerate(r)) for r in rows], EDGES)


def square(x, y, size):
    return [(x, y), (x + size, y), (x + size, y + size), (x, y + size)]


def table(rings):
    return sorted((round(r["area"], 4), r["n_holes"]) for r in land.land_table(rings).collect())


def test_square_wider_and_back(spark):
    wide = buffer.buffered(edges(spark, [square(0, 0, 1)]), 0.5, 0.5)
    assert table(wide) == [(round(1 + 4 * 0.5 + NGON * 0.25, 4), 0)]
    back = table(buffer.buffered(wide, -0.5, 0.5))
    assert len(back) == 1 and back[0] == pytest.approx((1, 0), abs=1e-2)
    assert buffer.buffered(edges(spark, [square(0, 0, 1)]), -0.6, 0.5).isEmpty()


def test_islands_merge_and_holes_close(spark):
    hole = list(reversed(square(1, 1, 1)))
    rings = [square(0, 0, 3), hole, square(3.5, 0, 1), square(9, 9, 1)]
    got = table(buffer.buffered(edges(spark, rings), 0.3, 0.5))
    assert [h for _, h in got] == [0, 1]
    assert got[0][0] == pytest.approx(1 + 1.2 + NGON * 0.09, abs=1e-4)
    assert [h for _, h in table(buffer.buffered(edges(spark, rings), 0.6, 0.5))] == [0, 0]
    assert table(buffer.buffered(edges(spark, rings[:2]), -0.2, 0.5)) == [(round(2.6**2 - (1 + 0.8 + NGON * 0.04), 4), 1)]


def outside(p, ring):
    """Distance of p to a ring, 0 inside it."""
    best, within = math.inf, False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        t = max(0.0, min(1.0, ((p[0] - ax) * (bx - ax) + (p[1] - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
        best = min(best, math.hypot(p[0] - ax - t * (bx - ax), p[1] - ay - t * (by - ay)))
        if (ay <= p[1]) != (by <= p[1]) and ax + (p[1] - ay) / (by - ay) * (bx - ax) > p[0]:
            within = not within
    return 0.0 if within else best


def test_stars_against_plain_distances(spark):
    rng = random.Random(5)
    stars = []
    for _ in range(12):
        x, y, n = rng.uniform(0, 8), rng.uniform(0, 8), rng.randint(5, 12)
        stars.append([(x + r * math.cos(2 * math.pi * i / n), y + r * math.sin(2 * math.pi * i / n)) for i in range(n) for r in [rng.uniform(0.2, 1.2)]])
    places = [(i, rng.uniform(-2, 10), rng.uniform(-2, 10)) for i in range(1500)]
    wide = buffer.buffered(edges(spark, stars), 0.4, 0.5)
    got = {r["id"]: r["inside"] for r in buffer.covered(spark.createDataFrame(places, "id long, x double, y double"), wide, 0.5).collect()}
    for i, x, y in places:
        d = min(outside((x, y), s) for s in stars)
        if not 0.4 * math.cos(math.pi / 32) - 1e-5 < d < 0.4 + 1e-5:
            assert got[i] == (d < 0.4), (i, x, y, d)
    shut = buffer.buffered(wide, -0.06, 0.5)
    held = {r["id"] for r in buffer.covered(spark.createDataFrame(places, "id long, x double, y double"), shut, 0.5).filter("inside").collect()}
    assert all(got[i] for i in held)
    assert all(i in held for i, x, y in places if min(outside((x, y), s) for s in stars) < 0.33)


def test_odd_rings(spark):
    got = buffer.buffered(edges(spark, [[(0, 0), (2, 0)], [(5, 5)], [(9, 0), (9, 0), (10, 0), (None, 3), (10, 1), (9, 1)]]), 0.5, 0.5)
    assert table(got) == sorted([(round(2 + NGON / 4, 4), 0), (round(3 + NGON / 4, 4), 0)])
    assert buffer.buffered(edges(spark, [[(5, 5)]]), 0.5, 0.5).isEmpty()
    twice = buffer.buffered(edges(spark, [square(0, 0, 1), square(0, 0, 1), square(1, 0, 1)]), 0.25, 0.5)
    assert table(twice) == [(round(2 + 6 * 0.25 + NGON / 16, 4), 0)]
    nowhere = spark.createDataFrame([(1, None, 0.5), (2, float("nan"), 0.5), (3, 0.5, 0.5)], "id long, x double, y double")
    assert {r["id"]: r["inside"] for r in buffer.covered(nowhere, twice, 0.5).collect()} == {1: False, 2: False, 3: True}
    assert twice.select(F.min("place")).first()[0] == 0


def test_long_ring_in_few_seconds(spark):
    """A ring of thousands of edges takes a dozen rounds, each planned as fast as the first."""
    n = 6000
    at = [(round(math.cos(2 * math.pi * i / n), 6), round(math.sin(2 * math.pi * i / n), 6)) for i in range(n)]
    rows = [(1, *at[i], *at[(i + 1) % n]) for i in range(n)]
    began = time.monotonic()
    half = polygons.faces(spark.createDataFrame(rows, "line long, ax double, ay double, bx double, by double"), order=True)
    ring = half.filter("along").orderBy("place").collect()
    assert time.monotonic() - began < 90
    assert [r.place for r in ring] == list(range(n)) and all((a.bx, a.by) == (b.ax, b.ay) for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
