"""Work that grows with the input is dealt over more tasks, not over larger ones; results stay those of the plain forms."""

import math
import random
from functools import reduce
from operator import xor

import pytest
from pyspark.sql import functions as F

from wakeline.functions import nmea
from wakeline.operators import match, raster, sequence
from wakeline.plans import queries
from wakeline.streaming import stops as live_stops


@pytest.mark.parametrize("tile", [1, 6, 64, 100])
def test_drawings_compared_by_words(spark, monkeypatch, tile):
    """Cells as bits of words, dealt over many tasks: the same tiles as by listed cells, null keys, gaps and steep lines included."""
    rng = random.Random(tile)
    rows = [(k, n, rng.uniform(-9, 9), rng.uniform(-300, 300), rng.uniform(-9, 9), rng.uniform(-300, 300) if n % 9 else None) for k in ("a", "b", None) for n in range(30)]
    rows += [("same", n, float(n), 0.5, float(n), 0.5) for n in range(5)] + [("up", n, 0.5, 80.0 * n, 0.5, -80.0 * n) for n in range(3)]
    p = spark.createDataFrame(rows, "k string, n int, x double, y double, u double, v double")
    plain = raster.difference(*[raster.cells(raster.segments(p, ["k"], "n", *c), ["k"], 1.0) for c in (("x", "y"), ("u", "v"))], ["k"], tile)
    want = {tuple(r) for r in plain.collect()}
    monkeypatch.setattr(raster, "STRIPS", 100)
    got = raster.drawn_difference(p, ["k"], "n", ("x", "y"), ("u", "v"), 1.0, tile)
    assert got.columns == plain.columns and {tuple(r) for r in got.collect()} == want and len(want) > 20
    assert got.rdd.getNumPartitions() > 8  # about 1,600 columns at 100 a task


def test_replay_in_many_files(spark):
    """A replayed part is many files and still one micro-batch: no row comes late, also where a part is short of files, and stops are those of the batch."""
    t = lambda k: F.timestamp_seconds(F.lit(1711200000) + 300 * k)
    place = F.col("id") % 40
    rows = spark.range(400, numPartitions=5).select((F.col("id") % 3).alias("track"), t(F.floor(F.col("id") / 3)).alias("ts"), F.when(place < 25, 26.5).otherwise(26.5 + place * 0.01).alias("lat"), F.lit(-77.0).alias("lon"))
    rows = rows.unionByName(spark.range(1).select(F.lit(7).cast("long").alias("track"), t(F.lit(1000)).alias("ts"), F.lit(1.0).alias("lat"), F.lit(1.0).alias("lon")))
    last = lambda after: spark.range(1).select(F.lit(-1).cast("long").alias("track"), after.alias("ts"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"))
    stream, folder = queries._replayed(spark, rows, "ts", last, file_rows=40)
    files = [len(spark.read.parquet(f"{folder}/in/part-{k}").inputFiles()) for k in range(5)]
    assert files == [4] * 5 and spark.read.parquet(f"{folder}/in/part-1").count() == 0
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live_stops.STORE)
    try:
        got = queries._run(spark, live_stops.stops(stream), folder).collect()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    want = sequence.stops(rows, "track", "ts").collect()
    assert len(want) > 6 and {tuple(x) for x in got} == {tuple(x) for x in want} and len(got) == len(want)


def test_nearest_segment_shuffles_samples_once(spark, monkeypatch):
    """Against every pair, points on corners of cells included; samples are dealt by their cell alone, not by all that a row holds."""
    rng, plans, write = random.Random(5), [], match.checkpoint
    grid = lambda: rng.choice([rng.uniform(0, 3), rng.randrange(30) / 10])
    segs = [(k, n, grid(), grid(), grid(), grid()) for k in "ab" for n in range(25)]
    pts = [("ab"[i % 2], i, grid(), grid()) for i in range(300)]

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(match, "checkpoint", noted)
    got = match.nearest_segment(spark.createDataFrame(pts, "k string, id int, x double, y double"), spark.createDataFrame(segs, "k string, seg long, ax double, ay double, bx double, by double"), "k", "id", 0.05, growth=2).collect()

    def far(px, py, ax, ay, bx, by):
        m = (bx - ax) ** 2 + (by - ay) ** 2
        t = max(0, min(1, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / m)) if m else 0
        return math.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay))

    want = {i: min(far(x, y, *s[2:]) for s in segs if s[0] == k) for k, i, x, y in pts}
    assert len(got) == len(want) and all(abs(r.dist - want[r.id]) < 1e-12 for r in got)
    dealt = [line for p in plans for line in p.splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and not any("ax#" in line for line in dealt)


def test_windows_are_worked_out_once(spark):
    """Windows that are costly to make are read in three places of the plan and made once; one without points still comes back."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    windows = spark.createDataFrame([("a", 0.0, 9.0), ("a", 20.0, 25.0), ("b", 0.0, 5.0)], "k string, s double, e double").mapInArrow(count, "k string, s double, e double")
    points = spark.createDataFrame([("a", float(t)) for t in range(12)], "k string, t double")
    got = match.in_interval(windows, points, "s", "e", "t", "k", True, 4.0).groupBy("k", "s").agg(F.count("point.t").alias("n")).collect()
    assert {(r.k, r.s): r.n for r in got} == {("a", 0.0): 10, ("a", 20.0): 0, ("b", 0.0): 0} and made.value == 3


def test_nearest_segment_keeps_no_pairs(spark, monkeypatch):
    """Pairs go into hash aggregates of plain numbers: none is sorted to be reduced. The lowest of equal segments is named, or none if not asked for."""
    plans, write = [], match.checkpoint

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(match, "checkpoint", noted)
    segs = spark.createDataFrame([("a", n, 0.0, float(n % 3), 1.0, float(n % 3)) for n in range(9, 0, -1)], "k string, seg long, ax double, ay double, bx double, by double")
    pts = spark.createDataFrame([("a", i, 0.5, y) for i, y in enumerate((0.0, 0.99, 2.5, 9.0))] + [("b", 9, 0.0, 0.0)], "k string, id int, x double, y double")
    got = match.nearest_segment(pts, segs, "k", "id", 0.05)
    assert {r.id: (r.seg, round(r.dist, 9)) for r in got.collect()} == {0: (3, 0.0), 1: (1, 0.01), 2: (2, 0.5), 3: (2, 7.0)}
    plain = match.nearest_segment(pts, segs, "k", "id", 0.05, with_seg=False)
    assert plain.columns == ["id", "dist"] and {(r.id, r.dist) for r in plain.collect()} == {(r.id, r.dist) for r in got.collect()}
    assert any("HashAggregate" in p for p in plans) and not any("SortAggregate" in p for p in plans)


def test_checksums_without_python(spark):
    """The XOR of any bytes, whatever their number, as an expression: sentences are written and checked without a Python worker."""
    rng = random.Random(4)
    bodies = ["".join(chr(rng.choice([rng.randrange(1, 128), rng.randrange(128, 3000)])) for _ in range(n % 40)) for n in range(120)] + ["", None, "\x7f" * 7, "GPRMC" * 900]
    got = {r.i: r.c for r in spark.createDataFrame(list(enumerate(bodies)), "i int, b string").select("i", nmea.checksum(F.col("b")).alias("c")).collect()}
    assert got == {i: None if b is None else reduce(xor, b.encode(), 0) for i, b in enumerate(bodies)}
    for name in ("nmea_checksum", "nmea_parse_rmc", "nmea_parse_gga", "nmea_join_quality"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Arrow" not in plan and "Python" not in plan and plan.count("regexp_extract_all") == 2, name
