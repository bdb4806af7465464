"""Receiver sentences on a stream: positions left-joined to the quality sentences of the same second."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.operators import parse

LATE = "10 minutes"


def nearest_time(hhmmss: Column, received: Column) -> Column:
    """The time of day on the date that brings it nearest to ``received``; null where it is none."""
    part = lambda i, below: F.when(F.substr(hhmmss, F.lit(i), F.lit(2)).rlike("^[0-9]{2}$"), F.substr(hhmmss, F.lit(i), F.lit(2)).try_cast("int"))
    hour, minute, second = (F.when(part(i, n) < n, part(i, n)) for i, n in ((1, 24), (3, 60), (5, 60)))
    at = F.unix_timestamp(received)
    return F.timestamp_seconds(at + F.pmod(hour * 3600 + minute * 60 + second - at % 86400 + 43200, F.lit(86400)) - 43200)


def positions(lines: DataFrame) -> DataFrame:
    """file, pos, ts and p (lat, lon, sog_kn, cog_deg) of a stream's valid position sentences."""
    return parse.positions(lines).select("file", "pos", "ts", F.struct("lat", "lon", "sog_kn", "cog_deg").alias("p"))


def qualities(lines: DataFrame) -> DataFrame:
    """file, pos, at and q (quality, sats, hdop) of a stream's valid quality sentences.

    They carry no date; ``received``, the time at which a line came in, tells it within half a day.
    """
    x = parse.quality_rows(lines.withColumn("pos", F.struct("pos", "received")))
    return x.select("file", "pos.pos", nearest_time(F.col("hhmmss"), F.col("pos.received")).alias("at"), "q").filter("at is not null")


def join_quality(positions: DataFrame, qualities: DataFrame, late: str = LATE) -> DataFrame:
    """track, ts, lat, lon, sog_kn, cog_deg, quality, sats, hdop: one row per file and second, the first position in file order with the last quality.

    Both streams may be ``late`` behind the newest row; a second closes when both watermarks have passed it, so state
    is the seconds under way, whatever the length of the streams. A quality that comes after its second has closed
    is left out, and a position without one has quality 0, no satellites and HDOP 99, as in the batch join. Unlike
    there, seconds are those of one date: a date-less key would have to be kept for ever.
    """
    second = lambda c: F.window(c, "1 second").alias("w")
    p = positions.withWatermark("ts", late).groupBy("file", second("ts")).agg(F.min_by("p", "pos").alias("p"))
    q = qualities.withWatermark("at", late).groupBy("file", second("at")).agg(F.max_by("q", "pos").alias("q"))
    p = p.select("file", "p", F.col("w.start").alias("ts"), F.window_time("w").alias("closed"))
    q = q.select(F.col("file").alias("of"), "q", F.window_time("w").alias("q_closed"))
    near = (F.col("q_closed") >= F.col("closed")) & (F.col("q_closed") <= F.col("closed"))
    met = p.join(q, F.col("file").eqNullSafe(F.col("of")) & near, "left")
    return met.select(F.col("file").alias("track"), "ts", "p.*", F.coalesce("q.quality", F.lit(0)).alias("quality"), F.coalesce("q.sats", F.lit(0)).alias("sats"), F.coalesce("q.hdop", F.lit(99.0)).alias("hdop"))
