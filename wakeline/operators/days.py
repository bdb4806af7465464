"""A day's log as the charts and the checks use it: legs, thinned points, and totals of the part afloat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wakeline.operators import quality, report, sequence


def _usable(fixes: DataFrame, key: str, below: float) -> tuple[DataFrame, DataFrame]:
    """(good fixes of the days that have two or more, counts per day): what lies outside the region is no reject."""
    inside = fixes.filter(quality.in_region(below)).withColumn("_ok", quality.good())
    n = F.count_if("_ok").over(Window.partitionBy(key))
    good = inside.withColumn("_n", n).filter("_ok and _n >= 2").drop("_ok", "_n")
    counts = inside.groupBy(key).agg(F.count_if("_ok").alias("fixes"), F.count_if(~F.col("_ok")).alias("dropped"))
    return good, counts


def load(fixes: DataFrame, days: DataFrame, key: str = "track", time: str = "t_s", below: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """(points, totals) of every day of ``fixes`` (key, time, lat, lon, sog_kn, quality, sats, hdop).

    ``days`` has key, walk_split and road_split, each possibly null. Points are all columns plus ``leg``: the part
    afloat passes the spike filter and is thinned by distance, walk and road keep every third row and the last.
    Totals are fixes and dropped of the whole day, and nm and max_kn of the part afloat alone; a day of fewer
    than two good fixes has no points, no fixes and zero totals, and keeps its count of rejects.
    """
    good, counts = _usable(fixes, key, below)
    legs = sequence.split_legs(good, days, key, time)
    sailed = sequence.accept(legs.filter("leg = 'afloat'"), [key], time, need_advance=False)
    ashore = sequence.strided(legs.filter("leg != 'afloat'"), [key, "leg"], [time])
    points = sailed.filter("kept").select(*legs.columns).unionByName(ashore)
    sums = sailed.groupBy(F.col(key).alias("_day")).agg(report.gated_nm().alias("nm"), report.max_kn().alias("max_kn"))
    enough = F.when(F.col("fixes") >= 2, F.col("fixes")).otherwise(0)
    totals = counts.join(sums, F.col(key).eqNullSafe(F.col("_day")), "left")
    return points, totals.select(key, enough.alias("fixes"), "dropped", F.coalesce("nm", F.lit(0.0)).alias("nm"), F.coalesce("max_kn", F.lit(0.0)).alias("max_kn"))


def cleaned(fixes: DataFrame, key: str = "track", time: str = "t_s") -> DataFrame:
    """Good fixes that the spike filter accepts, with step_m, of the tracks that have two or more of them."""
    x = sequence.accept(quality.keep_good(fixes), [key], time).filter("accepted").drop("accepted", "kept")
    return x.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key))).filter("_n >= 2").drop("_n")


def track_report(fixes: DataFrame, key: str = "track", time: str = "t_s", below: float = 30.0, home: str = "-04:00", away: str = "-07:00") -> DataFrame:
    """One row a track: in_region (by its first cleaned fix), local first and last time, hours, nm, max_kn, avg_kn, dropped, stops, stop_minutes.

    ``time`` is in seconds. Times are shown at ``home``'s offset inside the region and at ``away``'s outside;
    stops are looked for inside only. Tracks with fewer than two cleaned fixes are left out.
    """
    x = cleaned(fixes, key, time)
    first, last = F.min(time), F.max(time)
    rows = x.groupBy(key).agg(
        (F.min_by("lat", time) < below).alias("in_region"), first.alias("_a"), last.alias("_b"), ((last - first) / 3600).alias("hours"),
        report.gated_nm().alias("nm"), F.max("sog_kn").alias("max_kn"), report.average_kn().alias("avg_kn"),
    )
    dropped = fixes.groupBy(F.col(key).alias("_d")).agg(F.count_if(~quality.good()).alias("dropped"))
    stays = sequence.stops(x, key, time).groupBy(F.col(key).alias("_s")).agg(F.count(F.lit(1)).alias("stops"), F.sum("minutes").alias("stop_minutes"))
    same = lambda c: F.col(key).eqNullSafe(F.col(c))
    rows = rows.join(dropped, same("_d"), "left").join(stays, same("_s"), "left")
    zone = F.when(F.col("in_region"), home).otherwise(away)
    local = lambda c: F.date_format(F.from_utc_timestamp(F.timestamp_seconds(F.col(c)), zone), "yyyy-MM-dd HH:mm")
    inside = lambda c: F.when(F.col("in_region"), F.coalesce(c, F.lit(0)))
    return rows.select(key, "in_region", local("_a").alias("first_local"), local("_b").alias("last_local"), "hours", "nm", "max_kn", "avg_kn", "dropped", inside("stops").alias("stops"), inside("stop_minutes").alias("stop_minutes"))


def region_totals(reports: DataFrame) -> DataFrame:
    """in_region, tracks, nm and max_kn over the rows of a track report."""
    return reports.groupBy("in_region").agg(F.count(F.lit(1)).alias("tracks"), F.sum("nm").alias("nm"), F.max("max_kn").alias("max_kn"))


def headline(totals: DataFrame, sailing: Column) -> DataFrame:
    """One row: sailing days, their distance and best speed, and the rejects of all days."""
    of = lambda c: F.when(sailing, F.col(c))
    return totals.agg(F.count_if(sailing).alias("days"), F.coalesce(F.sum(of("nm")), F.lit(0.0)).alias("nm"), F.max(of("max_kn")).alias("max_kn"), F.coalesce(F.sum("dropped"), F.lit(0)).alias("dropped"))


def windows(points: DataFrame, keys: list[str], time: str = "t_s") -> DataFrame:
    """keys, start_s and end_s of each day's points: the span that one charge of the receiver recorded."""
    return points.groupBy(*keys).agg(F.min(time).alias("start_s"), F.max(time).alias("end_s"))


def nights(spans: DataFrame, voyage: str) -> DataFrame:
    """voyage, night (from 1), end_s and next_s of the gaps between neighbouring spans of a voyage."""
    w = Window.partitionBy(voyage).orderBy("start_s", "end_s")
    x = spans.select(voyage, F.row_number().over(w).cast("long").alias("night"), "end_s", F.lead("start_s").over(w).alias("next_s"))
    return x.filter("next_s is not null")
