"""GPX of any names and sizes, sentences cut once, order statistics over all rows, clipped ways as lines."""

import random

from pyspark.sql import functions as F

from tests.compare import difference  # noqa: F401
from wakeline.operators import match, parse, polygons
from wakeline.sources import tracks


def test_gpx_names(spark, tmp_path):
    """Names with XML's own characters, control characters and nulls come back, and lose no file."""
    names = ["plain", "a & b", "<x>", 'say "hi"', "it's", "&amp;", "]]>", "ünï", None, "tab\x01"]
    rows = [(n, 1711200000.0 + 60 * i, 26.5 + i * 1e-3, -77.1) for i, n in enumerate(names) for _ in range(1)]
    p = spark.createDataFrame(rows, "track string, t_s double, lat double, lon double").withColumn("ts", F.timestamp_seconds("t_s"))
    tracks.write_gpx(p, f"{tmp_path}/g", per_file=3)
    got = {r.session: r.lat for r in tracks.read_gpx(spark, f"{tmp_path}/g").collect()}
    want = {n.replace("\x01", "�") if n else n: round(26.5 + i * 1e-3, 6) for i, n in enumerate(names)}
    assert got == want
    # The files are XML to another reader too.
    seen = spark.read.format("xml").option("rowTag", "trk").schema("name string").load(f"{tmp_path}/g").collect()
    assert {r.name for r in seen} == set(want)


ODD = """<?xml version="1.0"?>
<gpx xmlns="http://www.topografix.com/GPX/1/1"><metadata><name>the file</name></metadata>
<wpt lat="1" lon="2"><name>a mark</name><time>2024-03-23T10:00:00Z</time></wpt>
<trk><name>first</name><trkseg>
<trkpt lat="26.5" lon="-77.1"><ele>1.5</ele><time>2024-03-23T14:39:34Z</time></trkpt>
<trkpt
   lon='-77.2' lat='26.6'><time> 2024-03-23T14:49:34Z </time></trkpt>
<trkpt lat="26.7" lon="-77.2"></trkpt></trkseg><trkseg><trkpt lat="26.8" lon="-77.3"><time>2024-03-23T14:59:34Z</time></trkpt></trkseg></trk>
<trk><number>2</number><trkseg><trkpt lat="26.9" lon="-77.4"><time>2024-03-23T15:09:34Z</time></trkpt></trkseg></trk>
<trk><name><![CDATA[R&D]]></name><trkpt lat="27.0" lon="-77.5"><time>2024-03-23T15:19:34Z</time></trkpt></trk></gpx>"""


def test_gpx_of_others(spark, tmp_path):
    """Points outside a segment, without a time, in several segments; tracks without a name; names of other elements."""
    (tmp_path / "a.gpx").write_text(ODD)
    (tmp_path / "empty.gpx").write_text("<gpx></gpx>")
    got = [(r.session, r.lat, r.lon, r.ele, r.ts.minute) for r in tracks.read_gpx(spark, str(tmp_path)).orderBy("ts").collect()]
    assert got == [("first", 26.5, -77.1, 1.5, 39), ("first", 26.6, -77.2, None, 49), ("first", 26.8, -77.3, None, 59), (None, 26.9, -77.4, None, 9), ("R&D", 27.0, -77.5, None, 19)]


def test_one_large_track_is_read_in_parts(spark, tmp_path):
    """A file of one trk and one more, read in many splits: every point once, every name right."""
    n = 40_000
    point = '<trkpt lat="{}" lon="-77"><time>2024-03-23T14:39:34Z</time></trkpt>'
    body = "".join(point.format(i) for i in range(n))
    (tmp_path / "big.gpx").write_text(f"<gpx><trk><name>one</name><trkseg>{body}</trkseg></trk><trk><name>two</name><trkseg>{point.format(n)}</trkseg></trk></gpx>")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        got = tracks.read_gpx(spark, str(tmp_path / "big.gpx"))
        assert spark.read.option("lineSep", "<trkpt").text(str(tmp_path / "big.gpx")).rdd.getNumPartitions() > 8
        per = {r.session: (r["n"], r["d"]) for r in got.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lat").alias("d")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert per == {"one": (n, n), "two": (1, 1)}


def test_fields_are_cut_once(spark):
    lines = spark.createDataFrame([("f", 1, "$GPRMC,1*00")], "file string, pos long, line string")
    plan = parse.fixes(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_overall_rank(spark):
    rng = random.Random(6)
    for values in ([], [None], [3.0], [2.0, 1.0], [rng.choice([5.0, rng.random()]) for _ in range(1001)], [7.0] * 500 + [rng.random() for _ in range(11)]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        got = match.nearest_rank(df.repartition(3), F.col("v"), []).first()
        a = sorted(v for v in values if v is not None)
        want = (len(a), a[len(a) // 2], a[int(len(a) * 0.9)], a[-1]) if a else (0, None, None, None)
        assert (got["n"], got["median"], got["p90"], got["max"]) == want
    plan = match.nearest_rank(df, F.col("v"), [])._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan or "_p" in plan.split("Window", 1)[1]


def test_clipped_ways(spark):
    """A way that leaves the box, comes back, touches a corner, and one that stays outside."""
    ways = {1: [(1, 1), (5, 1), (5, 3), (1, 3), (1, 2)], 2: [(-1, 4), (0, 5), (1, 6)], 3: [(9, 9), (8, 8)], 4: [(2, 2), (2, 2), (3, 3)], 5: [(-1, 2), (6, 2)], 6: [(1, 1), (4, 1), (4, 2), (6, 2), (4, 3), (1, 3)]}
    rows = [(w, i, *map(float, (*a, *b))) for w, p in ways.items() for i, (a, b) in enumerate(zip(p, p[1:]))]
    segs = spark.createDataFrame(rows, "line int, seg int, ax double, ay double, bx double, by double")
    got = {}
    for r in polygons.clip_ways(segs, 0.0, 0.0, 4.0, 4.0).orderBy("line", "part", "pos").collect():
        assert r.pos == len(got.setdefault((r.line, r.part), []))
        got[r.line, r.part].append((r.x, r.y))
    assert got == {
        (1, 1): [(1, 1), (4, 1)],
        (1, 2): [(4, 3), (1, 3), (1, 2)],
        (4, 1): [(2, 2), (2, 2), (3, 3)],
        (5, 1): [(0, 2), (4, 2)],
        (6, 1): [(1, 1), (4, 1), (4, 2)],
        (6, 2): [(4, 3), (1, 3)],
    }


def test_many_tracks_share_files(spark, tmp_path):
    """The number of track files follows from the points, not from the tracks; names of any characters, from either layout; an empty one is null, as before."""
    names = ["plain", " a b ", "x,y", 'say "hi"', "two\nlines", "ünï/é", "a+b%20c", "", None] + [f"t{i}" for i in range(200)]
    rows = [(n, 1711200000 + i, 26.5 + i * 1e-3, None if i % 2 else 184.5) for i, n in enumerate(names)]
    p = spark.createDataFrame(rows, "track string, s long, lat double, cog_deg double").select("track", F.timestamp_seconds("s").alias("ts"), "lat", F.lit(-77.1).alias("lon"), F.lit(5.0).alias("sog_kn"), "cog_deg", *[F.lit(n).alias(c) for c, n in (("quality", 1), ("sats", 7), ("hdop", 1.0))])
    read = lambda path: sorted(((r.track or "", r.track is None, round(r.lat, 6), r.cog_deg) for r in tracks.read_tracks(spark, path).collect()), key=lambda v: v[:3])
    key = lambda v: (v[0], v[1], v[2], v[3] or 0)
    want = sorted(((n or "", not n, round(26.5 + i * 1e-3, 6), None if i % 2 else 184.5) for i, n in enumerate(names)), key=key)
    tracks.write_tracks(p, f"{tmp_path}/shared")
    assert len(list((tmp_path / "shared").rglob("part-*.csv"))) <= 8 and sorted(read(f"{tmp_path}/shared"), key=key) == want
    named = p.filter("track != ''")
    tracks.write_tracks(named.filter("length(track) > 3"), f"{tmp_path}/own", folders=True)
    assert len(list((tmp_path / "own").glob("track=*"))) == len({n for n in names if n and len(n) > 3})
    assert [v[0] for v in read(f"{tmp_path}/own")] == sorted(n for n in names if n and len(n) > 3)
