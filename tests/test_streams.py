"""Streams against the batch operators: sentence join, stops, null positions; late rows, timers and bounded state."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from wakeline.operators import parse, sequence
from wakeline.streaming import sentences
from wakeline.streaming import stops as live_stops
from wakeline.streaming import tracks as live

T0 = 1711200000


def at(t):
    return datetime.datetime.fromtimestamp(t, datetime.UTC)


def run(spark, make, schema, batches, folder, **conf):
    """(rows, last progress) of the stream that ``make`` builds over the batches, one file each."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{k:03d}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    out = make(stream)
    name = "t" + str(abs(hash(str(folder))))
    q = out.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.sql(f"select * from {name}").collect(), q.recentProgress


def sentence(body):
    x = 0
    for c in body:
        x ^= ord(c)
    return f"${body}*{x:02X}"


def clock(t, form):
    return at(t).strftime(form)


def rmc(t, lat="2630.0000"):
    return sentence(f"GPRMC,{clock(t, '%H%M%S')}.000,A,{lat},N,07700.0000,W,5.00,,{clock(t, '%d%m%y')},,")


def gga(t, q, sats=8):
    return sentence(f"GPGGA,{clock(t, '%H%M%S')}.000,2630.0000,N,07700.0000,W,{q},{sats:02d},1.00,3.0,M,,M,,")


LINES = "file string, pos long, received timestamp, line string"


def test_sentence_join(spark, tmp_path):
    """Across batches and midnight: last quality, first position, none at all, and one that comes after its second has closed."""
    night = T0 - T0 % 86400 + 86400
    row = lambda f, pos, t, line: (f, pos, t, line)
    one = [row("a", 1, T0, rmc(T0)), row("a", 2, T0, gga(T0, 1)), row("a", 4, T0, rmc(T0, "2631.0000")), row(None, 1, T0, rmc(T0)), row(None, 2, T0, gga(T0, 2)), row("b", 1, T0, rmc(T0)), row("c", 1, T0, "$GPRMC,nonsense*00")]
    two = [row("a", 3, T0 + 60, gga(T0, 5)), row("a", 5, night - 1, rmc(night - 1)), row("a", 6, night + 3, gga(night - 1, 4))]
    more = [row("a", 7, night + 4, "$GPZDA,*00")]  # rows are late by the watermark of the batch before
    three = [row("b", 2, T0 + 7200, gga(T0, 1))]  # two hours late: its second has closed
    after = night + 86400
    end = [row("end", 1, after, rmc(after)), row("end", 2, after, gga(after, 1))]
    batches = [[(f, p, at(t), x) for f, p, t, x in b] for b in (one, two, more, three, end, end)]
    got, progress = run(spark, lambda s: sentences.join_quality(sentences.positions(s), sentences.qualities(s)), LINES, batches, tmp_path)
    seen = {(r.track, int(r.ts.replace(tzinfo=datetime.UTC).timestamp())): (round(r.lat, 6), r.quality, r.sats, r.hdop) for r in got}
    assert seen == {("a", T0): (26.5, 5, 8, 1.0), (None, T0): (26.5, 2, 8, 1.0), ("b", T0): (26.5, 0, 0, 99.0), ("a", night - 1): (26.5, 4, 8, 1.0)}
    assert len(got) == 4
    # What is held at the end belongs to the last rows alone.
    assert sum(o["numRowsTotal"] for o in progress[-1]["stateOperators"]) <= 4
    lines = spark.createDataFrame([x for b in batches[:2] for x in b], LINES)
    batch = {(r.track, round(r.lat, 6), r.quality) for r in parse.fixes(lines).collect()}
    assert batch == {(t, v[0], v[1]) for (t, _), v in seen.items()}


FIX = "track string, ts timestamp, lat double, lon double"


@pytest.fixture
def rocks(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live_stops.STORE)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def walk_rows():
    """Three tracks that anchor and move, a null track among them; some rows lack a position."""
    rng, rows = random.Random(9), []
    for track in ("a", "b", None):
        t, la = T0, 26.5
        for _ in range(80):
            t += rng.choice([60, 300, 600])
            la += 0.01 if rng.random() < 0.15 else 1e-5
            rows.append((track, t, la if rng.random() > 0.05 else None, -77.0))
    return rows


@pytest.mark.parametrize("cuts", [1, 4])
def test_stops_in_any_batches(spark, tmp_path, rocks, cuts):
    rows = [(k, at(t), la, lo) for k, t, la, lo in walk_rows()]
    want = {(r.track, r.start_s, r.end_s, round(r.lat, 9), r.n) for r in sequence.stops(spark.createDataFrame(rows, FIX), "track", "ts").collect()}
    assert len(want) > 6
    rows.sort(key=lambda x: (x[1], str(x[0])))
    size = -(-len(rows) // cuts)
    batches = [rows[i : i + size] for i in range(0, len(rows), size)]
    for b in batches:
        random.Random(1).shuffle(b)  # in any order within a batch
    batches[0].append(rows[size] if size < len(rows) else ("late", at(T0), 1.0, 1.0))
    if size < len(rows):
        batches[1].remove(rows[size])  # and a row that comes early
    later = [[("end", at(T0 + 90 * 86400), 0.0, 0.0)]] * 2
    got, progress = run(spark, lambda s: live_stops.stops(s, late="2 days"), FIX, batches + later, tmp_path)
    assert {(r.track, r.start_s, r.end_s, round(r.lat, 9), r.n) for r in got} == want and len(got) == len(want)


def test_silent_tracks_are_closed(spark, tmp_path, rocks):
    """A stop of a track that says no more comes out once others have moved the watermark past its idle time."""
    still = [("still", at(T0 + 300 * i), 26.5, -77.0) for i in range(10)]
    other = [[("other", at(T0 + 3600 * h), 26.5 + h, -77.0)] for h in (2, 4, 5)]
    got, progress = run(spark, lambda s: live_stops.stops(s, late="1 minute", idle="1 hour"), FIX, [still, *other], tmp_path)
    assert [(r.track, r.start_s, r.end_s, r.n) for r in got] == [("still", T0, T0 + 2700, 10)]


def test_null_positions_on_a_stream(spark, tmp_path):
    rows = [("a", float(T0 + 60 * i), None if i % 5 == 2 else 26.5 + 1e-3 * i, -77.0 if i % 7 else None, 5.0) for i in range(40)] + [("a", None, 26.5, -77.0, 5.0)]
    schema = "track string, t_s double, lat double, lon double, sog_kn double"
    want = {r.t_s for r in sequence.accept(spark.createDataFrame(rows, schema), ["track"], "t_s").filter("accepted").collect()}
    got, _ = run(spark, live.accepted, schema, [rows[:13], rows[13:14], rows[14:]], tmp_path)
    assert {r.t for r in got} == want and all(r.nm == r.nm for r in got)


def test_nearest_time(spark):
    cases = [("235959", "2024-03-24 00:00:10", "2024-03-23 23:59:59"), ("000001", "2024-03-23 23:59:58", "2024-03-24 00:00:01"), ("120000", "2024-03-23 12:00:00", "2024-03-23 12:00:00"), ("1200", "2024-03-23 12:00:00", None), ("256000", "2024-03-23 12:00:00", None)]
    df = spark.createDataFrame([c[:2] for c in cases], "h string, r string").withColumn("r", F.to_timestamp("r"))
    got = [x[0] for x in df.select(F.date_format(sentences.nearest_time(F.col("h"), F.col("r")), "yyyy-MM-dd HH:mm:ss")).collect()]
    assert got == [c[2] for c in cases]
