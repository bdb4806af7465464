"""Label positions by bounds against brute force over all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wakeline.operators import report


def brute(rows, mine, others, candidates, avoid):
    """{track: (rn, dist)} by every candidate against every point of the other tracks of its chart."""
    tracks = {}
    for chart, track, rn, la, lo in sorted(rows, key=lambda r: r[2]):
        tracks.setdefault((chart, track), []).append((rn, lo * math.cos(math.radians(la)), la))
    kept_off = [(lo * math.cos(math.radians(la)), la) for lo, la in avoid]
    out = {}
    for (chart, track), p in tracks.items():
        rest = [q[1:] for (c, t), o in tracks.items() if c == chart and t != track for q in o[::others]]
        own = p[::mine]
        if not rest:
            continue
        best = None
        for k in range(0, len(own), max(1, len(own) // candidates)):
            rn, x, y = own[k]
            d = min(math.hypot(a - x, b - y) for a, b in rest + kept_off)
            if best is None or round(d, 9) > round(best[1], 9):
                best = rn, d
        out[track] = best
    return out


SCHEMA = "chart int, track int, rn int, lat double, lon double"


@pytest.mark.parametrize("kind", ["spread", "anchored", "apart", "alone"])
def test_farthest_point(spark, kind):
    rng, rows = random.Random(kind), []
    for track in range(1 if kind == "alone" else 7):
        la, lo = 26.5 + (track if kind == "apart" else 0), -77.0
        for rn in range(150):
            if kind != "anchored" or rng.random() < 0.2:
                la, lo = la + rng.gauss(0, 0.01), lo + rng.gauss(0, 0.01)
            rows.append((track // 4, track, rn, la, lo))
    rows.append((9, 99, 1, 26.0, -77.0))  # alone on its chart
    rng.shuffle(rows)
    for avoid in ((), ((-77.0, 26.5), (-76.99, 26.51))):
        got = {r.track: (r.rn, r.dist) for r in report.farthest_point(spark.createDataFrame(rows, SCHEMA), "track", "rn", "chart", candidates=40, avoid=avoid).collect()}
        want = brute(rows, 3, 2, 40, avoid)
        assert {t: (rn, pytest.approx(d, abs=1e-12)) for t, (rn, d) in want.items()} == got


def test_candidates_meet_few_points(spark):
    """On a chart of 6,000 points a candidate meets a few dozen on average, not half of the chart."""
    rng = random.Random(3)
    p = spark.createDataFrame([(0, i % 3, i, rng.random(), rng.random()) for i in range(6000)], "chart int, track int, k int, x double, y double")
    own = p.filter("k % 30 < 3").withColumn("most", F.lit(float("inf")))
    met = report.nearest_other(own, p.select("chart", "track", "x", "y"), "track", "chart")
    assert 0 < met.groupBy("track", "k").count().agg(F.avg("count")).first()[0] < 60
    # Most candidates are out by their bounds before they meet a point.
    assert met.select("track", "k").distinct().count() < own.count() / 2


def test_empty(spark):
    assert report.farthest_point(spark.createDataFrame([], SCHEMA), "track", "rn", "chart").count() == 0


def test_page_fit_and_neatline(spark):
    box = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 1.0), (2, 0.0, 0.0, 1.0, 2.0)], "k long, cx double, cy double, width double, height double")
    fit = {r["k"]: r for r in report.fitted(box, 1.5, 2.0).collect()}
    assert (fit[1]["width"], fit[1]["height"]) == (2.0, 1.5) and (fit[1]["west"], fit[1]["north"]) == (-1.0, 0.75)
    assert fit[2]["height"] == 2.0 and fit[2]["width"] == pytest.approx(8 / 3)
    frame = spark.createDataFrame([(1, -77.1, -77.0, 26.41, 26.52), (2, 1.0, 1.0, None, 2.0)], "k long, west double, east double, south double, north double")
    labels = {(r["axis"], r["minute"]): r["label"] for r in report.neatline_labels(frame, "k").collect()}
    assert labels == {("lon", -4625): "77°05′W", ("lat", 1590): "26°30′N"}  # 26°25' lies within 0.012 degrees of its corner
    bands = sorted((r["axis"], r["minute"], round(r["start"], 4), round(r["end"], 4)) for r in report.neatline_bands(frame, "k").collect())
    assert bands[0] == ("lat", 1584, 26.41, 26.4167) and [b[1] for b in bands if b[0] == "lon"] == [-4626, -4624, -4622]
    assert bands[[b[0] for b in bands].index("lon")][2:] == (-77.1, -77.0833)


def test_cameras_and_slow_share(spark):
    photos = spark.createDataFrame([("a", 1.0, 2.0), ("a", None, 2.0), ("b", None, None), (None, 1.0, 1.0)], "camera string, lat double, lon double")
    assert sorted(map(str, ((r["camera"], r["images"], r["located"], r["placed_by"]) for r in report.camera_table(photos).collect()))) == sorted(map(str, [("a", 2, 1, "position"), ("b", 1, 0, "time"), (None, 1, 1, "position")]))
    fixes = spark.createDataFrame([(1, 0.4), (1, 0.5), (1, None), (2, 0.0)], "k long, sog_kn double")
    assert {(r["k"], r["n"], r["slow"], r["share"]) for r in report.slow_share(fixes, "k").collect()} == {(1, 2, 1, 0.5), (2, 1, 1, 1.0)}
