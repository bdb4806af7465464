"""The track engine: every query against its SQL, and hand-made cases for what SQL cannot show."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

import __spark_entry__ as entry
from tests.compare import difference
from wakeline.functions import clock, geo, nmea
from wakeline.operators import days, graph, land, match, offset, parse, polygons, quality, report, sequence
from wakeline.plans import queries
from wakeline.plans.registry import ORACLE, QUERIES
from wakeline.sources import tracks
from wakeline.streaming import tracks as live


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_sql(spark, sf_dir, name):
    if name in ORACLE:
        assert difference(QUERIES[name](spark, sf_dir), ORACLE[name], sf_dir) == ""
    else:
        assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(ORACLE) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())


GOOD = [
    "$GPRMC,144533.000,A,2632.7133,N,07702.9344,W,2.10,184.5,230324,,*21",
    "$GPGGA,144533.000,2632.7133,N,07702.9344,W,1,08,1.05,3.0,M,,M,,*60",
    "$GPRMC,144543.000,A,2632.7140,N,07702.9350,W,,,230324,,*1C",
    "$GPGGA,144543.000,2632.7140,N,07702.9350,W,1,04,4.05,3.0,M,,M,,*6F",
]
BAD = [
    "$GPRMC,144538.000,V,2632.7133,N,07702.9344,W,2.10,184.5,230324,,*3D",
    "$GPRMC,144560.000,A,2632.7140,N,07702.9350,W,1.0,2.0,230324,,*1E",
    "$GPRMC,144548.000,A,,N,,W,1.0,2.0,230324,,*2E",
    "$GNRMC,144553.000,A,2632.7140,N,07702.9350,W,1.0,2.0,230324,,*00",
    "$GPRMC,144558.000,A,2632.7140,N,07702.9350,W,abc,2.0,230324,,*5A",
    GOOD[0].replace("2632", "2633"),
    GOOD[0].replace("*21", ""),
    GOOD[0].replace("*21", "*ZZ"),
    "$GPRMC,é*00",
    "",
]


def lines(spark, rows):
    return spark.createDataFrame([("a", i, x) for i, x in enumerate(rows)], "file string, pos int, line string")


def test_nmea_cases(spark):
    rows = {str(x.ts): x for x in parse.fixes(lines(spark, BAD + GOOD + GOOD[:1])).collect()}
    assert list(sorted(rows)) == ["2024-03-23 14:45:33", "2024-03-23 14:45:43"]
    a, b = rows["2024-03-23 14:45:33"], rows["2024-03-23 14:45:43"]
    assert (round(a.lat, 6), round(a.lon, 6), a.sog_kn, a.cog_deg, a.quality, a.sats, a.hdop) == (26.545222, -77.048907, 2.1, 184.5, 1, 8, 1.05)
    assert (b.sog_kn, b.cog_deg, b.hdop) == (0.0, None, 4.05)
    kept = quality.keep_good(parse.as_written(parse.fixes(lines(spark, GOOD)))).collect()
    assert sorted(x.hdop for x in kept) == [1.0, 4.0] or sorted(x.hdop for x in kept) == [1.1, 4.0]
    late = GOOD[:2] + ["$GPGGA,144533.000,2632.7133,N,07702.9344,W,6,00,50.0,3.0,M,,M,,*6E"]
    assert [x.quality for x in parse.fixes(lines(spark, late)).collect()] == [6]
    assert [(x.quality, x.sats, x.hdop) for x in parse.fixes(lines(spark, GOOD[:1])).collect()] == [(0, 0, 99.0)]
    assert parse.fixes(lines(spark, BAD)).count() == 0


def test_fixed_decimals(spark):
    values = [4.05, 0.25, 2.675, -1.005, 1e-9, 123456.789] + [random.Random(1).uniform(-100, 100) for _ in range(300)]
    got = [x[0] for x in spark.createDataFrame([(v,) for v in values], "v double").select(nmea.fixed(F.col("v"), 1)).collect()]
    assert [float(x) for x in got] == [float(f"{v:.1f}") for v in values]


def points(spark, rows):
    return spark.createDataFrame([("a", float(t), la, lo, 1.0) for t, la, lo in rows], "track string, t_s double, lat double, lon double, sog_kn double")


SPIKES = [(0, 26.5, -77.0), (5, 26.5001, -77.0), (10, 26.6, -77.0), (15, 26.6001, -77.0), (20, 26.5002, -77.0), (25, 26.5002, -77.0005)]


def test_spikes_in_a_row(spark):
    got = sequence.accept(points(spark, SPIKES), ["track"], "t_s").collect()
    assert sorted(x.t_s for x in got if not x.accepted) == [10, 15]
    assert all(x.kept <= x.accepted for x in got)
    assert sequence.accept(points(spark, []), ["track"], "t_s").count() == 0


def plain_stops(rows):
    """By first exits: where the run anchored at each row ends, then the chain of anchors from the first row."""
    far = lambda a, b: geo.haversine_m(a[1], a[2], b[1], b[2]) >= 90
    exits = [next((k for k in range(i, len(rows)) if far(rows[i], rows[k])), len(rows)) for i in range(len(rows))]
    is_stop = [rows[e - 1][0] - rows[i][0] >= 25 * 60 for i, e in enumerate(exits)]
    chain, at = [], 0
    while at < len(rows):
        chain.append(at)
        at = exits[at] if is_stop[at] else at + 1
    return [(rows[i][0], rows[exits[i] - 1][0], exits[i] - i) for i in chain if is_stop[i]]


def test_stops_random(spark):
    rng = random.Random(4)
    for _ in range(6):
        la, rows = 26.5, []
        for t in range(0, 60_000, 300):
            la += rng.choice([0, 0, 0, 0.0001, 0.0004, 0.002])
            rows.append((float(t), la, -77.0))
        got = sorted((x.start_s, x.end_s, x.n) for x in sequence.stops(points(spark, rows), "track", "t_s").collect())
        assert got == plain_stops(rows)


def test_percentiles(spark):
    df = spark.createDataFrame([("x", float(i)) for i in range(1, 11)], "g string, v double")
    assert [(r["n"], r["median"], r["p90"], r["max"]) for r in match.nearest_rank(df, F.col("v"), ["g"]).collect()] == [(10, 6.0, 10.0, 10.0)]


def test_asof_ties_and_tolerance(spark):
    fixes = spark.createDataFrame([("a", 90, 1), ("a", 110, 2), ("a", 300, 3)], "track string, t_s long, seq int")
    probes = spark.createDataFrame([("a", 100, 1), ("a", 360, 2), ("a", 361, 3), ("b", 100, 4)], "track string, t_s long, id int")
    got = {r.id: (r.fix.t, r.dt) for r in match.asof_nearest(probes, fixes, "t_s", 60, "track", ["seq"], "seq").collect()}
    assert got == {1: (90, 10), 2: (300, 60)}


def test_split_instant_belongs_to_the_leg_before(spark):
    days = spark.createDataFrame([("a", 5.0, 15.0)], "track string, walk_split double, road_split double")
    got = {x.t_s: x.leg for x in sequence.split_legs(points(spark, SPIKES), days, time="t_s").collect()}
    assert got == {0: "walk", 5: "walk", 10: "afloat", 15: "afloat", 20: "road", 25: "road"}


def meet(p, q, r, s):
    """Where the open segments p-q and r-s cross, by solving the two equations."""
    m = np.array([[q[0] - p[0], r[0] - s[0]], [q[1] - p[1], r[1] - s[1]]])
    if abs(np.linalg.det(m)) < 1e-30:
        return None
    t, u = np.linalg.solve(m, np.array(r) - np.array(p))
    return tuple(np.array(p) + t * (np.array(q) - np.array(p))) if 0 < t < 1 and 0 < u < 1 else None


def plain_trim(pts, tol, active, window=80):
    crossings = {}
    for i in range(len(pts) - 1):
        for j in range(i + 2, min(i + window, len(pts) - 1)):
            c = meet(pts[i], pts[i + 1], pts[j], pts[j + 1])
            if c and all(active[i : j + 1]) and np.abs(np.array(pts[i : j + 1]) - c).max() <= tol:
                crossings[i] = (j + 1, c)  # later ones are farther
    line, at = [pts[0]], 0
    while at < len(pts) - 1:
        at, point = crossings.get(at, (at + 1, pts[at + 1]))
        line.append(point)
    return line


def test_trim_folds(spark):
    rng = np.random.default_rng(1)
    walk = np.cumsum(rng.normal(size=(1500, 2)) * 0.0004 + [0.0003, 0.0001], axis=0)
    active = (rng.random(1500) > 0.03).tolist()
    df = spark.createDataFrame([("a", i, float(x), float(y), 0.001, 0.5 if a else 0.0) for i, ((x, y), a) in enumerate(zip(walk, active))], "track string, n int, qx double, qy double, d double, scale double")
    got = [(x.x, x.y) for x in sorted(offset.trim_folds(df, "track", "n").collect(), key=lambda x: x.n)]
    want = plain_trim([tuple(map(float, p)) for p in walk], 0.002, active)
    assert len(want) < 1500 and len(got) == len(want) and np.allclose(got, want, rtol=0, atol=1e-12)


def test_shift_is_identity_outside_the_corridor(spark):
    rows = [("a", i, 26.3 + i * 0.0005, -77.0 + 0.0003 * math.sin(i)) for i in range(200)]
    got = offset.shifted(spark.createDataFrame(rows, "track string, n int, lat double, lon double"), "track", "n", F.lit(0.0015))
    assert got.filter("scale = 0 and (qx != x or qy != y)").count() == 0 and got.filter("scale > 0").count() == 0


def test_shortest_path(spark):
    edges = [(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (3, 4, 1.0), (8, 9, 1.0)]
    g = spark.createDataFrame(edges + [(b, a, w) for a, b, w in edges], "src long, dst long, w double")
    reached = graph.distances(g, spark.createDataFrame([(1,)], "node long"))
    assert {x.node: x.dist for x in reached.collect()} == {1: 0.0, 2: 1.0, 3: 2.0, 4: 3.0}
    way = graph.routes(reached, spark.createDataFrame([(4,), (1,), (9,)], "node long")).collect()
    assert sorted((x.target, x.back, x.node) for x in way) == [(1, 0, 1), (4, 0, 4), (4, 1, 3), (4, 2, 2), (4, 3, 1)]


def test_faces_of_a_cut_square(spark):
    rows = [(0, 0.0, 0.0, 4.0, 0.0), (1, 4.0, 0.0, 4.0, 4.0), (2, 4.0, 4.0, 0.0, 4.0), (3, 0.0, 4.0, 0.0, 0.0), (9, 1.0, 0.0, 1.0, 4.0)]
    segs = spark.createDataFrame(rows, "line long, ax double, ay double, bx double, by double").withColumn("seg", F.col("line"))
    t = polygons.face_table(polygons.faces(polygons.split_at_crossings(segs, 1.0)), F.col("line") == 9).collect()
    assert sorted((round(x.area, 6), round(x.cx, 6), x.land) for x in t) == [(4.0, 0.5, True), (12.0, 2.5, False)]


def _coast(spark, lines):
    rows = [(k, 1000 * k + i, *map(float, a), *map(float, b)) for k, line in enumerate(lines) for i, (a, b) in enumerate(zip(line, line[1:]))]
    return spark.createDataFrame(rows, "line long, seg long, ax double, ay double, bx double, by double")


def _square(x, y, side, left=True):
    c = [(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]
    return c if left else c[::-1]


def test_land_polygons(spark):
    """A shore across the box, an island, a lake with an islet in it, and two land faces that a line of land on both sides parts."""
    shore = [(-1, 3), (11, 3)][::-1]  # land to the left of going west: below
    lines = [shore, _square(2, 5, 4), _square(3, 6, 2, left=False), _square(3.5, 6.5, 1), _square(8, 8, 1), [(4, -1), (4, 3)]]
    made = land.land_polygons(_coast(spark, lines), 0.0, 0.0, 10.0, 10.0, 1.0)
    rings = made.collect()
    areas: dict = {}
    for r in rings:
        areas.setdefault((tuple(map(tuple, r.polygon)), tuple(map(tuple, r.ring)), r.hole), []).append(r)
    found = sorted((k[2], round(sum(r.ax * r.by - r.bx * r.ay for r in v) / 2, 6)) for k, v in areas.items())
    # The shore is nearer to the middle of both faces than the line between them, so both are land, and one.
    assert found == [(False, 1.0), (False, 1.0), (False, 16.0), (False, 30.0), (True, -4.0)]
    for v in areas.values():
        v.sort(key=lambda r: r.place)
        assert [r.place for r in v] == list(range(len(v)))
        assert all((a.bx, a.by) == (b.ax, b.ay) for a, b in zip(v, v[1:] + v[:1]))
    table = sorted((round(r.area, 6), r.n_holes) for r in land.land_table(made).collect())
    assert table == [(1.0, 0), (1.0, 0), (12.0, 1), (30.0, 0)]


def test_land_ties_and_box_without_shore(spark):
    """The middle of the right square is as near to the left one's edge, whose seg is lower and which it lies right of: water. A box without a line raises."""
    both = _coast(spark, [_square(2, 2, 3), _square(5, 2, 3)])
    got = land.land_table(land.land_polygons(both, 0.0, 0.0, 10.0, 10.0, 1.0)).collect()
    assert [(round(r.area, 6), r.n_holes) for r in got] == [(9.0, 0)]
    with pytest.raises(ValueError):
        land.land_polygons(both, 20.0, 20.0, 30.0, 30.0, 1.0)


def test_nearest_segment_far_away(spark):
    rng = random.Random(9)
    line = [("p", i, rng.uniform(0, 1), rng.uniform(0, 1)) for i in range(30)]
    segs = match.segments(spark.createDataFrame(line, "k string, n int, x double, y double"), "k", ["n"])
    pts = [("p", i, rng.uniform(-3, 3), rng.uniform(-3, 3)) for i in range(40)]
    got = {x.id: x.dist for x in match.nearest_segment(spark.createDataFrame(pts, "k string, id int, x double, y double"), segs, "k", "id", 0.05).collect()}

    def dist(p, a, b):
        dx, dy = b[2] - a[2], b[3] - a[3]
        t = max(0, min(1, ((p[2] - a[2]) * dx + (p[3] - a[3]) * dy) / (dx * dx + dy * dy)))
        return math.hypot(p[2] - a[2] - t * dx, p[3] - a[3] - t * dy)

    for p in pts:
        assert math.isclose(got[p[1]], min(dist(p, a, b) for a, b in zip(line, line[1:])), rel_tol=1e-9)


GPX = """<?xml version="1.0"?><gpx xmlns="http://www.topografix.com/GPX/1/1"><trk><name>one</name><trkseg>
<trkpt lat="26.5" lon="-77.0"><ele>2</ele><time>2024-03-23T14:39:34Z</time></trkpt><trkpt lat="26.6" lon="-77.1"><ele>3</ele></trkpt>
<trkpt lat="26.7" lon="-77.2"><time>2024-03-23T14:49:34Z</time></trkpt></trkseg></trk></gpx>"""


def test_sources(spark, tmp_path):
    (tmp_path / "a.gpx").write_text(GPX)
    got = tracks.read_gpx(spark, str(tmp_path / "a.gpx")).orderBy("ts").collect()
    assert [(x.session, str(x.ts), x.lat, x.ele) for x in got] == [("one", "2024-03-23 14:39:34", 26.5, 2.0), ("one", "2024-03-23 14:49:34", 26.7, None)]
    (tmp_path / "w.json").write_text('{"elements": [{"id": 1, "geometry": [{"lat": 1, "lon": 2}, {"lat": 1, "lon": 3}], "tags": {"highway": "service"}}, {"id": 2}, {"id": 3, "geometry": [{"lat": 1, "lon": 2}]}]}')
    (tmp_path / "e.json").write_text('{"elements": []}')
    assert [x.way_id for x in tracks.read_ways(spark, str(tmp_path / "w.json")).collect()] == [1]
    assert tracks.read_ways(spark, str(tmp_path / "e.json")).count() == 0
    (tmp_path / "p.csv").write_text("name,when,lat,lon\na,2024:03:22 14:43:00,26.5,-77\nb,,26.5,-77\nc,2024:03:22 14:43:00,,\nd,2024:03:22 14:43:00,31,-77\n")
    assert [(x.name, str(x.ts)) for x in tracks.read_photos(spark, str(tmp_path / "p.csv")).collect()] == [("a", "2024-03-22 18:43:00")]
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "GPS_1.log").write_bytes(("\r\n".join(GOOD) + "\r\nnoise \xff\r\n").encode("latin-1"))
    (tmp_path / "logs" / "other.txt").write_text("x")
    fixes = parse.fixes(tracks.read_logs(spark, str(tmp_path / "logs")))
    assert fixes.count() == 2
    tracks.write_tracks(fixes, str(tmp_path / "csv"))
    back = tracks.read_tracks(spark, str(tmp_path / "csv")).orderBy("ts").collect()
    assert [(x.track, x.lat, x.cog_deg, x.hdop) for x in back] == [("GPS_1", 26.545222, 184.5, 1.1 if f"{1.05:.1f}" == "1.1" else 1.0), ("GPS_1", 26.545233, None, 4.0)]


def test_clock(spark):
    x = spark.range(1).select(clock.iso(F.lit("2024-03-23T02:00:00Z")).alias("t")).select(F.date_format(clock.local(F.col("t")), "yyyy-MM-dd HH").alias("d"), clock.seconds(F.col("t"), F.col("t") + F.expr("interval 90 seconds")).alias("s")).first()
    assert (x.d, x.s) == ("2024-03-22 22", 90.0)


def test_stream_accepts_what_the_batch_does(spark, sf_dir, tmp_path):
    from wakeline.plans.fixtures import dense

    good = quality.keep_good(dense(spark, sf_dir)).filter("track < 4").select("track", F.col("t_s").cast("double").alias("t_s"), "lat", "lon", "sog_kn")
    for part in range(3):
        lo, hi = 1711195200 + 300 * 25 * part, 1711195200 + 300 * 25 * (part + 1)
        good.filter((F.col("t_s") > lo) & (F.col("t_s") <= (hi if part < 2 else 9e12))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(good.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.accepted(stream).writeStream.format("memory").queryName("live_tracks").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(x.track, x.t): (x.kept, None if x.step_m is None else round(x.step_m, 6)) for x in spark.table("live_tracks").collect()}
    want = {(x.track, x.t_s): (x.kept, None if x.step_m is None else round(x.step_m, 6)) for x in sequence.accept(good, ["track"], "t_s").filter("accepted").collect()}
    assert got == want and len(got) > 100


def test_every_offshore_photo(spark):
    """More than fifty photos: none is cut, and they come in order of time and id."""
    d = "/root/testdata/sf0.01"
    got = [(x.taken, x.photo) for x in QUERIES["photo_offshore_all"](spark, d).collect()]
    assert len(got) > 50 and got == sorted(got)
    assert len(got) == QUERIES["offshore_km"](spark, d).filter("km > 0.5").count()
    assert difference(QUERIES["photo_offshore_all"](spark, d), ORACLE["photo_offshore_all"], d) == ""


def test_long_groups_stay_rows(spark, sf_dir, tmp_path):
    """A ring is summed over rows, not collected; a long track is written in several pieces and read back whole."""
    assert "collect_list" not in QUERIES["ring_area"](spark, sf_dir)._jdf.queryExecution().toString()
    ring = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 2, 2.0, 3.0), (1, 1, 2.0, 0.0), (1, 3, 0.0, 3.0), (2, 0, 5.0, 5.0)], "k int, n int, x double, y double")
    assert {(x.k, x.area) for x in polygons.ring_areas(ring, ["k"], ["n"]).collect()} == {(1, 6.0), (2, 0.0)}
    p = spark.range(25).select(F.lit(7).alias("track"), F.col("id").alias("t_s"), F.timestamp_seconds("id").alias("ts"), (26 + F.col("id") / 1000).alias("lat"), F.lit(-77.0).alias("lon"))
    tracks.write_gpx(p, f"{tmp_path}/gpx", piece=10, per_file=6)
    lines = [x.value for x in spark.read.text(f"{tmp_path}/gpx").collect()]
    assert sum(x.startswith("<trk>") for x in lines) == 3 and sum(x == "<gpx>" for x in lines) == 5
    got = tracks.read_gpx(spark, f"{tmp_path}/gpx").orderBy("ts").collect()
    assert [(x.session, round(x.lat, 6)) for x in got] == [("7", round(26 + i / 1000, 6)) for i in range(25)]


def test_photos_by_time(spark):
    """Photos keep their own position, take the nearest fix's, or stay without one; none is lost."""
    p = spark.createDataFrame([("a", 1, 10.0, 26.1, -77.1), ("a", 2, 12.0, None, None), ("a", 3, 500.0, None, -77.0), ("a", 4, None, None, None), (None, 5, 10.0, None, None), ("b", 6, 10.0, None, None)], "k string, photo int, t double, plat double, plon double")
    f = spark.createDataFrame([("a", 9.0, 1, 26.5, -77.5), ("a", 15.0, 2, 26.6, -77.6)], "k string, t double, n int, lat double, lon double")
    got = {x.photo: (x.placed, x.lat, x.lon) for x in match.placed_by_time(p, f, "t", 90, "k", "n").collect()}
    assert got == {1: ("own", 26.1, -77.1), 2: ("track", 26.5, -77.5), **{i: (None, None, None) for i in (3, 4, 5, 6)}}
    assert match.placed_by_time(p.limit(0), f, "t", 90, "k", "n").count() == 0 and match.placed_by_time(p, f.limit(0), "t", 90, "k", "n").count() == 6


# nulls, short tracks, and what no table shows


def test_null_keys_are_one_track(spark):
    """Null keys, in a nullable whole-number column too wide for a float, and null times and positions."""
    big = 9007199254740993
    rows = [(k, float(t), la, lo, 1.0) for k in (None, big, big + 1) for t, la, lo in SPIKES] + [(None, None, 26.5, -77.0, 1.0), (big, 11.0, None, -77.0, 1.0)]
    df = spark.createDataFrame(rows, "track long, t_s double, lat double, lon double, sog_kn double")
    got = sequence.accept(df, ["track"], "t_s").collect()
    assert len(got) == len(rows) and {r.track for r in got} == {None, big, big + 1}
    for k in (None, big, big + 1):
        assert sorted(r.t_s for r in got if r.track == k and not r.accepted and r.t_s not in (None, 11.0)) == [10, 15]
    assert not any(r.accepted for r in got if r.t_s in (None, 11.0))
    still = spark.createDataFrame([(k, t * 600.0, 26.5, -77.0) for k in (None, big) for t in range(5)], "track long, t_s double, lat double, lon double")
    assert {(r.track, r.n, r.minutes) for r in sequence.stops(still, "track", "t_s").collect()} == {(None, 5, 40.0), (big, 5, 40.0)}
    line = spark.createDataFrame([(k, n, 26.48 + n / 1000, -77.0) for k in (None, big) for n in range(6)], "track long, n long, lat double, lon double")
    out = offset.trim_folds(offset.shifted(line, "track", "n", F.lit(0.001)), "track", "n").collect()
    assert sorted(((r.track or 0), r.n) for r in out) == sorted((k, n) for k in (0, big) for n in range(6))


def test_windows_with_nulls(spark):
    """A window comes back once, whatever is null in it."""
    windows = spark.createDataFrame([("a", 0, 10, None), (None, 0, 10, "x"), ("a", 20, None, "y"), ("a", 0, 10, "z")], "k string, s int, e int, note string")
    points = spark.createDataFrame([("a", 5), (None, 5), ("a", None)], "k string, t int")
    got = match.in_interval(windows, points, "s", "e", "t", "k", True, 4.0).collect()
    assert {((r.k, r.s, r.e, r.note), r.point.t) for r in got if r.point} == {(("a", 0, 10, None), 5), (("a", 0, 10, "z"), 5)} and len(got) == 4
    assert sorted(str((r.k, r.s, r.e, r.note)) for r in got if not r.point) == sorted(str(x) for x in [(None, 0, 10, "x"), ("a", 20, None, "y")])
    assert match.in_interval(windows.limit(0), points, "s", "e", "t", "k", True, 4.0).count() == 0 and match.in_interval(windows, points.limit(0), "s", "e", "t", "k", True, 4.0).count() == 4


def test_short_tracks_are_not_shifted(spark):
    """Two points, or three of which two coincide, stay; three points move."""
    rows = [("two", 1, 26.49, -77.0), ("two", 2, 26.50, -77.0), ("dup", 1, 26.49, -77.0), ("dup", 2, 26.49, -77.0), ("dup", 3, 26.50, -77.0)] + [("three", n, 26.48 + n / 100, -77.0) for n in (1, 2, 3)]
    got = offset.shifted(spark.createDataFrame(rows, "track string, n long, lat double, lon double"), "track", "n", F.lit(0.001)).collect()
    assert all((r.x, r.y) == (r.qx, r.qy) for r in got if r.track != "three")
    assert any(abs(r.x - r.qx) > 5e-4 for r in got if r.track == "three")


def test_radius_of_nearly_straight_bends(spark):
    """Lengths are plain square roots: their last bit decides the angle, and with it the radius, of a nearly straight bend."""
    rng = random.Random(7)
    rows = []
    for k in range(400):
        u, v, far, bend = rng.uniform(-1, 1), rng.uniform(-1, 1), rng.uniform(0.5, 2), rng.choice((0, 1e-8, 1e-6))
        rows += [(k, n, 26.5 + y * 1e-2, -77.0 + x * 1e-2) for n, (x, y) in enumerate([(0.0, 0.0), (u, v), (u + far * u - bend * v, v + far * v + bend * u)])]
    got = {r.track: r.radius for r in offset.headings(spark.createDataFrame(rows, "track long, n long, lat double, lon double"), "track", "n").filter("n = 1").collect()}
    for k in range(400):
        (ax, ay), (bx, by), (cx, cy) = [(lon * geo.K0, lat) for _, _, lat, lon in rows[3 * k : 3 * k + 3]]
        (px, py), (qx, qy) = (bx - ax, by - ay), (cx - bx, cy - by)
        p, q = math.sqrt(px * px + py * py), math.sqrt(qx * qx + qy * qy)
        turn = math.acos(max(-1.0, min(1.0, qx / q * (px / p) + qy / q * (py / p))))
        assert got[k] == (pytest.approx((p + q) / 2 / turn, rel=1e-12) if turn > 1e-9 else None), k


def test_day_of_one_fix(spark):
    """A day of fewer than two good fixes has no points and zero totals, but keeps its rejects."""
    rows = [("a", 0.0, 26.5, -77.0, 3.0, 1, 9, 1.0), ("a", 5.0, 26.5, -77.0, 3.0, 6, 9, 1.0), ("a", 9.0, 45.0, -77.0, 3.0, 6, 9, 1.0)] + [("b", 300.0 * i, 26.5 + i / 1000, -77.0, 3.0, 1, 9, 1.0) for i in range(7)]
    fixes = spark.createDataFrame(rows, "track string, t_s double, lat double, lon double, sog_kn double, quality int, sats int, hdop double")
    split = spark.createDataFrame([("b", 600.0, None)], "track string, walk_split double, road_split double")
    points, totals = days.load(fixes, split)
    got = {r.track: (r.fixes, r.dropped, r.nm > 0, r.max_kn) for r in totals.collect()}
    assert got == {"a": (0, 1, False, 0.0), "b": (7, 0, True, 3.0)}
    assert sorted((r.track, r.leg, r.t_s) for r in points.collect()) == [("b", "afloat", 300.0 * i) for i in (3, 4, 5, 6)] + [("b", "walk", 0.0), ("b", "walk", 600.0)]
    assert {r.track for r in days.track_report(fixes).collect()} == {"b"}


def test_route_without_a_way(spark):
    way = lambda i, *p: (i, {"highway": "service"}, [{"lat": a, "lon": b} for a, b in p])
    ways = spark.createDataFrame([way(1, (26.0, -77.0), (26.01, -77.0), (26.02, -77.0)), way(2, (27.0, -77.0), (27.01, -77.0))], "way_id int, tags map<string,string>, points array<struct<lat:double,lon:double>>")
    g = graph.edges(ways)
    got = graph.route(g, (25.999, -77.0), (26.021, -77.001)).orderBy("place").collect()
    assert [(r.place, r.lat) for r in got] == [(0, 25.999), (1, 26.0), (2, 26.01), (3, 26.02), (4, 26.021)]
    assert all(abs(r.metres - geo.haversine_m(26.0, -77.0, 26.02, -77.0)) < 1e-6 for r in got)
    assert graph.route(g, (26.0, -77.0), (27.0, -77.0)).count() == 0 and graph.route(g.limit(0), (26.0, -77.0), (27.0, -77.0)).count() == 0
    same = graph.route(g, (26.0, -77.0), (26.0, -77.0)).orderBy("place").collect()
    assert [r.place for r in same] == [0, 1, 2] and same[0].metres == 0


#: A tracker file whose figures are known; it is not part of this repository.
TRACKER = os.environ.get("WAKELINE_TRACKER_GPX", "")
#: When the receiver was off, local time at four hours behind UTC, and what the tracker shows: fixes, path and net metres, longest hours unwatched.
NIGHTS = [
    ("2024-03-23 20:06", "2024-03-24 06:56", 2, 17, 17, 4.0),
    ("2024-03-24 18:46", "2024-03-25 07:17", 3, 27, 27, 4.0),
    ("2024-03-25 20:05", "2024-03-26 07:49", 4, 24, 5, 4.0),
    ("2024-03-26 19:28", "2024-03-27 08:20", 4, 18, 13, 4.0),
    ("2024-03-27 18:20", "2024-03-28 07:17", 4, 20, 4, 9.0),
]


@pytest.mark.skipif(not TRACKER, reason="WAKELINE_TRACKER_GPX names no file")
def test_tracker_file(spark):
    """The tracker's file: points, gaps, length, and the five nights."""
    p = tracks.read_gpx(spark, TRACKER).withColumn("t_s", F.unix_timestamp("ts")).withColumn("all", F.lit(1))
    w = Window.partitionBy("all").orderBy("t_s")
    x = report.steps(p, "all", ["t_s"]).withColumn("gap", F.col("t_s") - F.lag("t_s").over(w))
    r = x.agg(F.count("*").alias("n"), F.count("gap").alias("gaps"), F.count_if((F.col("gap") > 570) & (F.col("gap") < 630)).alias("ten"), F.count_if(F.col("gap") == 600).alias("exact"), F.sum("step_m").alias("m")).first()
    assert (r.n, r.gaps, r.ten, r.exact, round(r.m / geo.NM_M, 1)) == (150, 149, 116, 84, 81.7)
    second = lambda t: F.unix_timestamp(F.to_utc_timestamp(F.to_timestamp(t), "-04:00"))
    off = spark.createDataFrame([(1, i, a, b) for i, (a, b, *_) in enumerate(NIGHTS)], "all int, night int, a string, b string").select("all", "night", second("a").alias("end_s"), second("b").alias("next_s"))
    seen = match.in_interval(off, p.select("all", "t_s", "lat", "lon"), "end_s", "next_s", "t_s", "all", False, 3600.0)
    got = queries._night_table(seen.select("night", "end_s", "next_s", "point.t_s", "point.lat", "point.lon"), ["night"]).orderBy("night").collect()
    assert [(r.fixes, round(r.path_m), round(r.net_m), round(r.blind_h, 1), r.moved) for r in got] == [(*x[2:], False) for x in NIGHTS]


def test_hourly(spark, tmp_path):
    """Event-time hours of a stream, closed once the watermark has passed them; late rows of closed hours are left out."""
    rows = [("2024-03-23 10:05:00", 2.0), ("2024-03-23 10:55:00", 4.0), ("2024-03-23 11:30:00", 6.0), ("2024-03-23 15:00:00", 1.0), ("2024-03-23 16:10:00", 5.0), ("2024-03-23 10:10:00", 9.0), ("2024-03-23 20:00:00", 1.0)]
    for i, part in enumerate((rows[:3], rows[3:4], rows[4:5], rows[5:])):
        spark.createDataFrame(part, "ts string, sog_kn double").select(F.to_timestamp("ts").alias("ts"), "sog_kn").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("ts timestamp, sog_kn double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = live.hourly(stream).writeStream.format("memory").queryName("live_hours").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((str(r.start), r.n, r.mean_kn) for r in spark.table("live_hours").collect()) == [("2024-03-23 10:00:00", 2, 3.0), ("2024-03-23 11:00:00", 1, 6.0), ("2024-03-23 15:00:00", 1, 1.0), ("2024-03-23 16:00:00", 1, 5.0)]


def test_idle_tracks_leave_no_state(spark, tmp_path):
    """With a watermark a track's state goes once it has been silent for long enough, and a later row starts anew."""
    steps = [[("a", 0, 26.5)], [("a", 60, 26.5005)], [("b", 40_000, 26.5)], [("c", 80_000, 26.5)], [("a", 80_060, 26.9)], [("c", 80_120, 26.5)]]
    for i, part in enumerate(steps):
        spark.createDataFrame([(k, 1.7e9 + t, la, -77.0, 3.0) for k, t, la in part], "track string, t_s double, lat double, lon double, sog_kn double").withColumn("ts", F.timestamp_seconds("t_s")).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    schema = spark.read.parquet(f"{tmp_path}/in/0").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = live.accepted(stream, watermark=("ts", "10 minutes"), idle="2 hours").writeStream.format("memory").queryName("live_idle").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").start()
    q.processAllAvailable()
    kept = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    q.stop()
    got = {(r.track, r.t - 1.7e9): r.step_m for r in spark.table("live_idle").collect()}
    assert got["a", 60.0] is not None and ("a", 80_060.0) in got and got["a", 80_060.0] is None and kept <= 3
