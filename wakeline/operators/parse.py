"""Receiver sentences to fixes: positions left-joined to the quality sentences of the same second."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wakeline.functions import nmea


def _number(x, kind: str, default):
    """(value with a default for empty, whether a non-empty text is no number)."""
    value = x.try_cast(kind)
    return F.when(x == "", F.lit(default).cast(kind)).otherwise(value), (x != "") & value.isNull()


def _sentences(lines: DataFrame, *kinds: str) -> DataFrame:
    """file, pos, kind, hhmmss and the parsed fields of the valid sentences of the named kinds; the name is looked at before the checksum is.

    Fields are cut once and numbers read once: each step is a row of a generator, into which later expressions are not inlined.
    """
    kind = F.substr(F.col("line"), F.lit(2), F.lit(5))
    x = lines.filter(F.col("line").startswith("$") & kind.isin(*kinds)).filter(nmea.checksum_ok(F.col("line")))
    x = x.select("file", "pos", kind.alias("kind"), F.inline(F.array(F.struct(nmea.fields(F.col("line")).alias("f")))))
    f = lambda i: F.get("f", F.lit(i))
    rmc = F.col("kind") == "GPRMC"
    ts, lat, lon = nmea.timestamp(f(1), f(9)), nmea.degrees(f(3), f(4)), nmea.degrees(f(5), f(6))
    sog, bad_sog = _number(f(7), "double", 0.0)
    cog, bad_cog = _number(f(8), "double", None)
    sats, bad_sats = _number(f(7), "int", 0)
    hdop, bad_hdop = _number(f(8), "double", 99.0)
    shape = (F.size("f") >= 10) & (f(2) == "A") & (F.length(f(1)) >= 6) & (F.length(f(9)) == 6) & ~(bad_sog | bad_cog)
    quality_shape = (F.size("f") >= 9) & (f(1) != "") & (f(6) != "") & ~(bad_sats | bad_hdop)
    parsed = F.struct(
        F.substr(f(1), F.lit(1), F.lit(6)).alias("hhmmss"), F.when(rmc, shape).otherwise(quality_shape).alias("shape"),
        *[F.when(rmc, c).alias(n) for n, c in {"ts": ts, "lat": lat, "lon": lon, "sog_kn": sog, "cog_deg": cog}.items()],
        *[F.when(~rmc, c).alias(n) for n, c in {"quality": f(6).try_cast("int"), "sats": sats, "hdop": hdop}.items()],
    )
    return x.select("file", "pos", "kind", F.inline(F.array(parsed))).filter("shape")


def _position():
    """The position of a parsed row as a struct, null where it is none."""
    usable = (F.col("kind") == "GPRMC") & F.col("ts").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return F.when(usable, F.struct("ts", "lat", "lon", "sog_kn", "cog_deg"))


def _quality():
    """The quality of a parsed row as a struct, null where it is none."""
    return F.when((F.col("kind") == "GPGGA") & F.col("quality").isNotNull(), F.struct("quality", "sats", "hdop"))


def positions(lines: DataFrame) -> DataFrame:
    """Valid ``$GPRMC`` rows: file, pos, hhmmss, ts, lat, lon, sog_kn, cog_deg."""
    return _sentences(lines, "GPRMC").select("file", "pos", "hhmmss", _position().alias("p")).filter("p is not null").select("file", "pos", "hhmmss", "p.*")


def qualities(lines: DataFrame) -> DataFrame:
    """The last valid ``$GPGGA`` of each file and second of day: file, hhmmss, quality, sats, hdop."""
    return quality_rows(lines).groupBy("file", "hhmmss").agg(F.max_by("q", "pos").alias("q")).select("file", "hhmmss", "q.*")


def quality_rows(lines: DataFrame) -> DataFrame:
    """Every valid ``$GPGGA``: file, pos, hhmmss, q (quality, sats, hdop)."""
    return _sentences(lines, "GPGGA").select("file", "pos", "hhmmss", _quality().alias("q")).filter("q is not null")


def fixes(lines: DataFrame) -> DataFrame:
    """track, ts, lat, lon, sog_kn, cog_deg, quality, sats, hdop; one row per time, the first in file order.

    A position without a quality sentence has quality 0, no satellites and HDOP 99, which the quality
    filter rejects later. ``lines`` has file, pos (orders a file's lines) and line. Lines are read once: both
    kinds are dealt by file and second, where the last quality meets the positions.
    """
    x = _sentences(lines, "GPRMC", "GPGGA").select("file", "pos", "hhmmss", _position().alias("p"), _quality().alias("q")).filter("p is not null or q is not null")
    same = Window.partitionBy("file", "hhmmss")
    x = x.withColumn("q", F.max_by("q", F.when(F.col("q").isNotNull(), F.col("pos"))).over(same)).filter("p is not null")
    # Equal times are equal seconds of day, so this needs no other dealing.
    return first_of(x.withColumn("ts", F.col("p.ts")), ["file", "hhmmss", "ts"], "pos").select(F.col("file").alias("track"), "p.*", F.coalesce("q.quality", F.lit(0)).alias("quality"), F.coalesce("q.sats", F.lit(0)).alias("sats"), F.coalesce("q.hdop", F.lit(99.0)).alias("hdop"))


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row, by ``order``, of each group."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_n = 1").drop("_n")


def as_written(rows: DataFrame) -> DataFrame:
    """Fixes with the decimals the track file keeps: later filters see these, not the parsed values."""
    digits = {"lat": 6, "lon": 6, "sog_kn": 2, "cog_deg": 1, "hdop": 1}
    return rows.withColumns({c: nmea.rounded(F.col(c), n) for c, n in digits.items() if c in rows.columns})
