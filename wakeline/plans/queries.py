"""One query per operator of the track engine, each with the SQL that computes the same rows another way."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wakeline.functions import clock, geo, nmea
from wakeline.operators import buffer, days, graph, match, offset, parse, polygons, quality, raster, report, sequence
from wakeline.plans.fixtures import DENSE_SQL, GOOD_SQL, PLAIN_SQL, dense, hav_sql, plain, with_time
from wakeline.session import ensure_checkpoint_dir, table, written
from wakeline.sources import tracks
from wakeline.store import stored
from wakeline.streaming import sentences, stops as live_stops
from wakeline.streaming import tracks as live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
P, D = f"with f as ({PLAIN_SQL})", f"with recursive f as ({DENSE_SQL}), g as (select *, row_number() over (partition by track order by rn) as n from f where {GOOD_SQL})"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def r(c, digits: int = 6, name: str | None = None):
    x = F.col(c) if isinstance(c, str) else c
    out = F.round(x, digits)
    return out.alias(name or c) if name or isinstance(c, str) else out


# sources and row filters


@query(f"{P} select track, seq, round(lat, 6) as lat, round(lon, 6) as lon, round(sog_kn, 3) as sog_kn, quality, sats, round(hdop, 3) as hdop from f")
def scan_fixes(spark, d):
    return plain(spark, d).select("track", "seq", r("lat"), r("lon"), r("sog_kn", 3), "quality", "sats", r("hdop", 3))


@query(f"{P} select track, seq, round(lat, 6) as lat from f where {GOOD_SQL}")
def quality_filter(spark, d):
    return quality.keep_good(plain(spark, d)).select("track", "seq", r("lat"))


@query(f"{P} select track, seq from f where lat < 26.5")
def region_filter(spark, d):
    return plain(spark, d).filter(quality.in_region(26.5)).select("track", "seq")


@query(f"{P} select track, count(*) as n, count(*) filter (where not ({GOOD_SQL})) as dropped from f where lat < 26.5 group by track")
def dropped_by_track(spark, d):
    return quality.dropped(plain(spark, d), 26.5)


@query(f"{P}, h as (select track, seq, hdop * 1.0125 as h from f) select track, seq, cast(printf('%.1f', h) as double) as hdop from h where cast(printf('%.1f', h) as double) <= 4.0")
def rounded_csv_filter(spark, d):
    x = plain(spark, d).select("track", "seq", (F.col("hdop") * 1.0125).alias("hdop"))
    return parse.as_written(x).filter(F.col("hdop") <= quality.MAX_HDOP)


# NMEA

_DM = "cast({deg} as bigint)"


def _sentences(spark, d, *more):
    """Two sentences per fix: position, then quality; every tenth quality sentence is followed by a later one that overrides it."""
    x = plain(spark, d).withColumn("when", F.timestamp_seconds(F.floor("t_s")))
    dm = lambda v, w: F.concat(F.lpad(F.floor(F.abs(v)).cast("int").cast("string"), w, "0"), F.lpad(nmea.fixed((F.abs(v) - F.floor(F.abs(v))) * 60, 4), 7, "0"))
    at = F.concat(dm(F.col("lat"), 2), F.lit(",N,"), dm(F.col("lon"), 3), F.lit(",W"))
    # Behind a generator, so that the texts are made once a fix and not once a sentence and mention.
    x = x.select("*", F.inline(F.array(F.struct(at.alias("_place"), F.date_format("when", "HHmmss").alias("_time"), nmea.fixed(F.col("hdop"), 2).alias("_hdop")))))
    at, time = F.col("_place"), F.col("_time")
    rmc = F.concat(F.lit("GPRMC,"), time, F.lit(".000,A,"), at, F.lit(","), nmea.fixed(F.col("sog_kn"), 2), F.lit(",,"), F.date_format("when", "ddMMyy"), F.lit(",,"))
    gga = lambda q: F.concat(F.lit("GPGGA,"), time, F.lit(".000,"), at, F.lit(","), q.cast("string"), F.lit(","), F.lpad(F.col("sats").cast("string"), 2, "0"), F.lit(","), F.col("_hdop"), F.lit(",3.0,M,,M,,"))
    lines = F.array(F.struct(F.lit(0).alias("i"), rmc.alias("b")), F.struct(F.lit(1).alias("i"), gga(F.col("quality")).alias("b")), F.when(F.col("seq") % 10 == 0, F.struct(F.lit(2).alias("i"), gga(F.lit(6)).alias("b"))))
    x = x.select(*more, F.col("track").cast("string").alias("file"), (F.col("seq") * 4).alias("at"), F.explode(F.array_compact(lines)).alias("s"))
    sum_ = F.lpad(F.hex(nmea.checksum(F.col("s.b")).cast("long")), 2, "0")
    line = F.concat(F.lit("$"), F.col("s.b"), F.lit("*"), sum_)
    return x.select(*more, "file", (F.col("at") + F.col("s.i")).alias("pos"), F.inline(F.array(F.struct(line.alias("line")))))


def _dm_sql(v: str, w: int) -> str:
    return f"lpad(cast(floor(abs({v})) as int)::varchar, {w}, '0') || lpad(printf('%.4f', (abs({v}) - floor(abs({v}))) * 60), 7, '0')"


_AT = f"{_dm_sql('lat', 2)} || ',N,' || {_dm_sql('lon', 3)} || ',W'"
_LINES = f"""{P}, w as (select *, make_timestamp((floor(t_s)*1000000)::bigint) as wt from f), b as (
  select track, seq*4 as pos, 'GPRMC,' || strftime(wt, '%H%M%S') || '.000,A,' || {_AT} || ',' || printf('%.2f', sog_kn) || ',,' || strftime(wt, '%d%m%y') || ',,' as b from w
  union all select track, seq*4+1, 'GPGGA,' || strftime(wt, '%H%M%S') || '.000,' || {_AT} || ',' || quality || ',' || lpad(sats::varchar, 2, '0') || ',' || printf('%.2f', hdop) || ',3.0,M,,M,,' from w
  union all select track, seq*4+2, 'GPGGA,' || strftime(wt, '%H%M%S') || '.000,' || {_AT} || ',6,' || lpad(sats::varchar, 2, '0') || ',' || printf('%.2f', hdop) || ',3.0,M,,M,,' from w where seq % 10 = 0)"""


@query(_LINES + " select track::varchar as file, pos, '$' || b || '*' || printf('%02X', list_reduce(list_transform(string_split(b, ''), lambda c: ascii(c)), lambda x, y: xor(x, y))) as line from b")
def nmea_checksum(spark, d):
    return _sentences(spark, d).filter(nmea.checksum_ok(F.col("line")))


_POS = """round((case when {v} < 0 then -1 else 1 end) * (floor(abs({v})) + printf('%.4f', (abs({v}) - floor(abs({v}))) * 60)::double / 60), 6)"""


@query(f"{P} select track::varchar as file, seq*4 as pos, floor(t_s)::bigint as t, {_POS.format(v='lat')} as lat, {_POS.format(v='lon')} as lon, round(printf('%.2f', sog_kn)::double, 2) as sog_kn from f")
def nmea_parse_rmc(spark, d):
    return parse.positions(_sentences(spark, d)).select("file", "pos", F.unix_timestamp("ts").alias("t"), r("lat"), r("lon"), r("sog_kn", 2))


@query(f"""{P} select track::varchar as file, strftime(make_timestamp((floor(t_s)*1000000)::bigint), '%H%M%S') as hhmmss,
 arg_max(case when seq % 10 = 0 then 6 else quality end, seq) as quality, arg_max(sats, seq) as sats, round(arg_max(printf('%.2f', hdop)::double, seq), 2) as hdop from f group by all""")
def nmea_parse_gga(spark, d):
    return parse.qualities(_sentences(spark, d)).select("file", "hhmmss", "quality", "sats", r("hdop", 2))


@query(f"""{P}, x as (select track::varchar as file, seq, floor(t_s)::bigint as t, strftime(make_timestamp((floor(t_s)*1000000)::bigint), '%H%M%S') as hh, case when seq % 10 = 0 then 6 else quality end as q, sats, hdop from f),
 k as (select file, hh, arg_max(q, seq) as quality, arg_max(sats, seq) as sats, arg_max(printf('%.2f', hdop)::double, seq) as hdop from x group by all),
 p as (select file, t, any_value(hh) as hh from x group by all)
 select file as track, t, quality, sats, round(hdop, 2) as hdop from p join k using (file, hh)""")
def nmea_join_quality(spark, d):
    return parse.fixes(_sentences(spark, d)).select("track", F.unix_timestamp("ts").alias("t"), "quality", "sats", r("hdop", 2))


@query(f"{P}, x as (select track, floor(t_s / 86400)::bigint as day, seq from f) select track, day, min(seq) as seq from x group by all")
def dedupe_ts(spark, d):
    x = plain(spark, d).select("track", F.floor(F.col("t_s") / 86400).alias("day"), "seq")
    return parse.first_of(x, ["track", "day"], "seq")


# distances, speeds, sums

_STEP = f"select *, {hav_sql('lag(lat) over w', 'lag(lon) over w', 'lat', 'lon')} as step_m from f where {GOOD_SQL} window w as (partition by track order by t_s, seq)"


def _good_steps(spark, d):
    return report.steps(quality.keep_good(plain(spark, d)), "track", ["t_s", "seq"])


@query(f"{P} select track, seq, round(step_m, 3) as step_m from ({_STEP})")
def haversine_steps(spark, d):
    return _good_steps(spark, d).select("track", "seq", r("step_m", 3))


@query(f"""{P}, s as ({_STEP}), b as (select track, count(*) filter (where not ({GOOD_SQL})) as dropped from f group by track)
 select track, count(*) as fixes, any_value(dropped) as dropped, round(coalesce(sum(case when sog_kn > 0.5 then step_m end), 0) / 1852, 6) as nm, round(max(sog_kn), 3) as max_kn,
 round(coalesce(avg(case when sog_kn > 0.8 then sog_kn end), 0), 6) as avg_kn from s join b using (track) group by track""")
def gated_distance(spark, d):
    """Distance under way, speeds, and rejects per track."""
    x = plain(spark, d)
    x = x.withColumn("ok", quality.good())
    # The good row before, within one window by track: the sums below then need no second shuffle.
    w = Window.partitionBy("track").orderBy("t_s", "seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("ok"), F.struct("lat", "lon")), True).over(w)
    x = x.withColumn("p", before).withColumn("step_m", geo.haversine("p.lat", "p.lon", "lat", "lon"))
    ok = lambda c: F.when(F.col("ok"), c)
    out = x.groupBy("track").agg(
        F.count_if("ok").alias("fixes"), F.count_if(~F.col("ok")).alias("dropped"),
        r(F.coalesce(F.sum(F.when(F.col("ok") & (F.col("sog_kn") > report.MOVING_KN), F.col("step_m"))), F.lit(0.0)) / geo.NM_M, 6, "nm"),
        r(F.max(ok(F.col("sog_kn"))), 3, "max_kn"), r(F.coalesce(F.avg(F.when(F.col("ok") & (F.col("sog_kn") > report.AVERAGE_KN), F.col("sog_kn"))), F.lit(0.0)), 6, "avg_kn"),
    )
    return out.filter("fixes > 0")


@query(f"{P} select track, round(coalesce(max(case when sog_kn > 0.8 then sog_kn end), 0), 3) as max_kn, round(coalesce(avg(case when sog_kn > 0.8 then sog_kn end), 0), 6) as avg_kn from f group by track")
def speed_stats(spark, d):
    return plain(spark, d).groupBy("track").agg(r(report.max_kn(), 3, "max_kn"), r(report.average_kn(), 6, "avg_kn"))


@query(f"{P} select track, count(*) as n, round(min(t_s), 3) as first_s, round(max(t_s), 3) as last_s, round(min(lat), 6) as min_lat, round(max(lat), 6) as max_lat, round(min(lon), 6) as min_lon, round(max(lon), 6) as max_lon from f group by rollup (track)")
def file_summary(spark, d):
    edge = [r(f(c), n, f"{name}") for f, c, n, name in ((F.min, "t_s", 3, "first_s"), (F.max, "t_s", 3, "last_s"), (F.min, "lat", 6, "min_lat"), (F.max, "lat", 6, "max_lat"), (F.min, "lon", 6, "min_lon"), (F.max, "lon", 6, "max_lon"))]
    return plain(spark, d).rollup("track").agg(F.count(F.lit(1)).alias("n"), *edge)


@query(f"{P} select strftime(make_timestamp((t_s*1000000)::bigint) - interval 4 hour, '%Y-%m-%d') as day, count(*) as n, count(distinct track) as tracks from f group by 1")
def local_day(spark, d):
    return with_time(plain(spark, d)).groupBy(F.date_format(clock.local(F.col("ts")), "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("track").alias("tracks"))


@query(f"{P} select track, round((max(t_s) - min(t_s)) / 60, 6) as minutes from f group by track")
def durations(spark, d):
    return with_time(plain(spark, d)).groupBy("track").agg(r(clock.seconds(F.min("ts"), F.max("ts")) / 60, 6, "minutes"))


# order-dependent filters

_H = hav_sql("s.la", "s.lo", "g.lat", "g.lon")
_HK = hav_sql("s.kla", "s.klo", "g.lat", "g.lon")
_BAD = f"({_H} / (g.t_s - s.t) * 1.94384 > 30 and {_H} > 60)"
CLEAN = f"""{D}, s as (
  select track, n, rn, t_s as t, lat as la, lon as lo, lat as kla, lon as klo, true as accepted, null::double as step_m, true as kept, sog_kn from g where n = 1
  union all
  select g.track, g.n, g.rn, case when {_BAD} then s.t else g.t_s end, case when {_BAD} then s.la else g.lat end, case when {_BAD} then s.lo else g.lon end,
    case when {_BAD} or {_HK} < 22 then s.kla else g.lat end, case when {_BAD} or {_HK} < 22 then s.klo else g.lon end,
    not {_BAD}, case when {_BAD} then null else {_H} end, not {_BAD} and {_HK} >= 22, g.sog_kn
  from s join g on g.track = s.track and g.n = s.n + 1)"""


def _clean(spark, d):
    return sequence.accept(quality.keep_good(dense(spark, d)), ["track"], "t_s")


@query(f"{CLEAN} select track, rn, accepted, round(step_m, 3) as step_m from s")
def spike_clean(spark, d):
    return _clean(spark, d).select("track", "rn", "accepted", r("step_m", 3))


@query(f"{CLEAN} select track, rn from s where kept")
def distance_thin(spark, d):
    return _clean(spark, d).filter("kept").select("track", "rn")


@query(f"{CLEAN} select track, count(*) filter (where accepted) as accepted, count(*) filter (where kept) as kept, round(coalesce(sum(case when sog_kn > 0.5 then step_m end), 0) / 1852, 6) as nm from s group by track")
def clean_distance(spark, d):
    return _clean(spark, d).groupBy("track").agg(F.count_if("accepted").alias("accepted"), F.count_if("kept").alias("kept"), r(report.gated_nm(), 6, "nm"))


def _days(spark, d):
    """A walk until the tenth fix on even tracks, a road leg after the fortieth on every third."""
    x = dense(spark, d).groupBy("track").agg(F.lit(1).alias("one"))
    split = lambda cond, n: F.when(cond, F.lit(1711195200 + 300 * n))
    return x.select("track", split(F.col("track") % 2 == 0, 10).alias("walk_split"), split(F.col("track") % 3 == 0, 40).alias("road_split"))


_LEG = "case when track % 2 = 0 and t_s <= 1711195200 + 3000 then 'walk' when track % 3 = 0 and t_s > 1711195200 + 12000 then 'road' else 'afloat' end"


@query(f"with recursive f as ({DENSE_SQL}) select track, {_LEG} as leg, count(*) as n, min(rn) as first_rn, max(rn) as last_rn from f where {GOOD_SQL} group by all")
def day_legs(spark, d):
    x = sequence.split_legs(quality.keep_good(dense(spark, d)), _days(spark, d), time="t_s")
    return x.groupBy("track", "leg").agg(F.count(F.lit(1)).alias("n"), F.min("rn").alias("first_rn"), F.max("rn").alias("last_rn"))


_REGION = 26.65
_GOOD_DAY = "g as (select *, row_number() over (partition by track order by rn) as n from f where"
# The part afloat alone goes through the recursion; what follows it are every good fix of a usable day and the counts of all days.
_LOADED = CLEAN.replace(_GOOD_DAY, f"""r as (select *, {_LEG} as leg from f where lat < {_REGION}), c as (select track, count(*) filter (where {GOOD_SQL}) as n_good, count(*) filter (where not ({GOOD_SQL})) as dropped from r group by track),
 u as (select r.* from r join c using (track) where {GOOD_SQL} and n_good >= 2), g as (select *, row_number() over (partition by track order by rn) as n from u where leg = 'afloat' and""") + """,
 pts as (select track, 'afloat' as leg, t as t_s, la as lat, lo as lon from s where kept union all
   select track, leg, t_s, lat, lon from (select *, row_number() over (partition by track, leg order by rn) - 1 as i, count(*) over (partition by track, leg) as m from u where leg <> 'afloat') where i % 3 = 0 or i = m - 1),
 tot as (select track, case when n_good >= 2 then n_good else 0 end as fixes, dropped, coalesce(nm, 0) as nm, coalesce(max_kn, 0) as max_kn from c left join
   (select track, sum(case when sog_kn > 0.5 then step_m end) / 1852 as nm from s group by track) using (track) left join (select track, max(case when sog_kn > 0.8 then sog_kn end) as max_kn from g group by track) using (track))"""


def _loaded(spark, d):
    return days.load(dense(spark, d), _days(spark, d), below=_REGION)


@query(f"{_LOADED} select track, leg, t_s, round(lat, 6) as lat, round(lon, 6) as lon from pts")
def day_points(spark, d):
    """The points of every day: thinned by distance afloat, every third ashore."""
    return _loaded(spark, d)[0].select("track", "leg", "t_s", r("lat"), r("lon"))


@query(f"{_LOADED} select track, fixes, dropped, round(nm, 6) as nm, round(max_kn, 3) as max_kn from tot")
def day_loader(spark, d):
    """Fixes and rejects of every day, distance and best speed of its part afloat."""
    return _loaded(spark, d)[1].select("track", "fixes", "dropped", r("nm"), r("max_kn", 3))


@query(f"{_LOADED} select count(*) filter (where track % 3 <> 0) as days, round(sum(case when track % 3 <> 0 then nm end), 4) as nm, round(max(case when track % 3 <> 0 then max_kn end), 3) as max_kn, sum(dropped)::bigint as dropped from tot")
def headline(spark, d):
    """Distance and best speed of the sailing days, rejects of all."""
    return days.headline(_loaded(spark, d)[1], F.col("track") % 3 != 0).select("days", r("nm", 4), r("max_kn", 3), "dropped")


@query(f"{D} select track, rn from (select track, rn, n, max(n) over (partition by track) as m from g) where (n - 1) % 3 = 0 or n = m")
def stride_thin(spark, d):
    w = Window.partitionBy("track")
    x = quality.keep_good(dense(spark, d)).withColumns({"n": F.row_number().over(w.orderBy("rn")) - 1, "m": F.count(F.lit(1)).over(w)})
    return x.filter("n % 3 = 0 or n = m - 1").select("track", "rn")


def _stops_sql(g: str) -> str:
    """CTEs e, q and w: where the run anchored at each row of ``g`` ends, and the chain of anchors from the first."""
    return f"""e as (select a.track, a.n, a.t_s, coalesce(min(b.n), any_value(m.m) + 1) as x from {g} a join (select track, max(n) as m from {g} group by track) m using (track)
   left join {g} b on b.track = a.track and b.n > a.n and {hav_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} >= 90 group by a.track, a.n, a.t_s),
 q as (select e.track, e.n, e.x, (g.t_s - e.t_s) / 60 as minutes, e.t_s as start_s, g.t_s as end_s from e join {g} g on g.track = e.track and g.n = e.x - 1),
 w as (select track, n, x, minutes, start_s, end_s, case when minutes >= 25 then x else n + 1 end as nxt, minutes >= 25 as stop from q where n = 1
   union all select q.track, q.n, q.x, q.minutes, q.start_s, q.end_s, case when q.minutes >= 25 then q.x else q.n + 1 end, q.minutes >= 25 from w join q on q.track = w.track and q.n = w.nxt)"""


@query(f"""{D}, {_stops_sql('g')}
 select w.track, round(start_s::double, 3) as start_s, round(end_s::double, 3) as end_s, round(minutes, 6) as minutes, count(*) as n, round(avg(g.lat), 8) as lat, round(avg(g.lon), 8) as lon
 from w join g on g.track = w.track and g.n >= w.n and g.n < w.x where stop group by all""")
def stops(spark, d):
    x = sequence.stops(quality.keep_good(dense(spark, d)), "track", "t_s")
    return x.select("track", r("start_s", 3), r("end_s", 3), r("minutes"), "n", r("lat", 8), r("lon", 8))


# reports by track: a region whose border the anchorages cross, so that both sides and both zones are met

_SPLIT = 26.5
_REPORT = f"""{CLEAN}, k as (select *, row_number() over (partition by track order by t) as m, count(*) over (partition by track) as all_ from s where accepted),
 h as (select track, m as n, t as t_s, la as lat, lo as lon, sog_kn, step_m from k where all_ >= 2), {_stops_sql('h')},
 st as (select track, count(*) as stops, sum(minutes) as stop_minutes from w where stop group by track), dr as (select track, count(*) filter (where not ({GOOD_SQL})) as dropped from f group by track),
 rep as (select track, arg_min(lat, t_s) < {_SPLIT} as in_region, min(t_s) as a, max(t_s) as b, coalesce(sum(case when sog_kn > 0.5 then step_m end), 0) / 1852 as nm, max(sog_kn) as max_kn, coalesce(avg(case when sog_kn > 0.8 then sog_kn end), 0) as avg_kn from h group by track),
 full_ as (select rep.*, dropped, case when in_region then coalesce(stops, 0) end as stops, case when in_region then coalesce(stop_minutes, 0) end as stop_minutes from rep join dr using (track) left join st using (track))"""


def _report(spark, d):
    return days.track_report(dense(spark, d), below=_SPLIT)


@query(f"""{_REPORT} select track, in_region, strftime(make_timestamp(a * 1000000) - to_hours(case when in_region then 4 else 7 end), '%Y-%m-%d %H:%M') as first_local, strftime(make_timestamp(b * 1000000) - to_hours(case when in_region then 4 else 7 end), '%Y-%m-%d %H:%M') as last_local,
 round((b - a) / 3600, 6) as hours, round(nm, 6) as nm, round(max_kn, 3) as max_kn, round(avg_kn, 6) as avg_kn, dropped, stops, round(stop_minutes, 3)::double as stop_minutes from full_""")
def track_report(spark, d):
    """Every track after cleaning: its region, local times, distance under way, speeds, rejects and stops."""
    x = _report(spark, d)
    return x.select("track", "in_region", "first_local", "last_local", r("hours"), r("nm"), r("max_kn", 3), r("avg_kn"), "dropped", "stops", r("stop_minutes", 3))


@query(f"{_REPORT} select in_region, count(*) as tracks, round(sum(nm), 4) as nm, round(max(max_kn), 3) as max_kn from full_ group by in_region")
def grand_total(spark, d):
    """Distance of the tracks that start inside the region, and of the others, over cleaned steps."""
    return days.region_totals(_report(spark, d)).select("in_region", "tracks", r("nm", 4), r("max_kn", 3))


# gaps and windows


@query(f"{P}, w as (select track, t_s - lag(t_s) over (partition by track order by t_s, seq) as gap from f) select track, count(gap) as gaps, count(*) filter (where gap / 3600 > 9.5 and gap / 3600 < 10.5) as near_ten, round(max(gap), 3) as longest_s from w group by track")
def gap_cadence(spark, d):
    w = Window.partitionBy("track").orderBy("t_s", "seq")
    x = plain(spark, d).withColumn("gap", F.col("t_s") - F.lag("t_s").over(w))
    h = F.col("gap") / 3600
    return x.groupBy("track").agg(F.count("gap").alias("gaps"), F.count_if((h > 9.5) & (h < 10.5)).alias("near_ten"), r(F.max("gap"), 3, "longest_s"))


@query(f"{P}, w as (select track, seq, t_s - lag(t_s) over (partition by track order by t_s, seq) as gap from f) select track, seq, round(gap, 3) as gap_s from w where gap > 86400")
def long_gaps(spark, d):
    w = Window.partitionBy("track").orderBy("t_s", "seq")
    return plain(spark, d).withColumn("gap_s", F.col("t_s") - F.lag("t_s").over(w)).filter("gap_s > 86400").select("track", "seq", r("gap_s", 3))


_WIN = "w as (select track, (n - 1) // 10 as day, min(t_s) as start_s, max(t_s) as end_s from (select track, t_s, rn as n from f where rn % 10 < 7) group by all), x as (select *, lead(start_s) over (partition by track order by start_s) as next_s from w)"


def _windows(spark, d):
    """The spans of rows 0-6 of every ten: what lies between is a night."""
    x = dense(spark, d).filter("rn % 10 < 7").groupBy("track", F.expr("(rn - 1) div 10").alias("day")).agg(F.min("t_s").alias("start_s"), F.max("t_s").alias("end_s"))
    return x.withColumn("next_s", F.lead("start_s").over(Window.partitionBy("track").orderBy("start_s")))


@query(f"with f as ({DENSE_SQL}), {_WIN} select track, day, start_s, end_s, round((end_s - start_s) / 3600, 6) as hours from w")
def windows_runtime(spark, d):
    return _windows(spark, d).select("track", "day", "start_s", "end_s", r((F.col("end_s") - F.col("start_s")) / 3600, 6, "hours"))


@query(f"""with f as ({DENSE_SQL}), {_WIN}, n as (select * from x where next_s > end_s),
 j as (select n.track, n.day, n.end_s, n.next_s, f.t_s, f.lat, f.lon from n left join f on f.track = n.track and f.t_s > n.end_s and f.t_s < n.next_s),
 k as (select *, {hav_sql('lag(lat) over q', 'lag(lon) over q', 'lat', 'lon')} as step, coalesce(lead(t_s) over q, next_s) - t_s as ahead from j window q as (partition by track, day order by t_s))
 select track, day, count(t_s) as fixes, round(coalesce(sum(step), 0), 3) as path_m,
  round(coalesce({hav_sql('arg_min(lat, t_s)', 'arg_min(lon, t_s)', 'arg_max(lat, t_s)', 'arg_max(lon, t_s)')}, 0), 3) as net_m,
  greatest(coalesce(max(ahead), 0), coalesce(min(t_s), any_value(next_s)) - any_value(end_s)) / 3600e0 as blind_h,
  coalesce({hav_sql('arg_min(lat, t_s)', 'arg_min(lon, t_s)', 'arg_max(lat, t_s)', 'arg_max(lon, t_s)')}, 0) > 300 as moved
 from k group by track, day""")
def overnight_watch(spark, d):
    nights = _windows(spark, d).filter("next_s > end_s").select("track", "day", "end_s", "next_s")
    pts = dense(spark, d).select("track", "t_s", "lat", "lon")
    x = match.in_interval(nights, pts, "end_s", "next_s", "t_s", "track", False, 3600.0)
    return _night_table(x.select("track", "day", "end_s", "next_s", "point.t_s", "point.lat", "point.lon"), ["track", "day"])


# matching


def _tracker(spark, d):
    """A second recording of every dense row, some seconds later and a little away."""
    x = dense(spark, d)
    return x.select("track", F.col("rn").alias("probe"), (F.col("t_s") + (F.col("rn") * 7 + F.col("track")) % 121).alias("t_s"), (F.col("lat") + 1e-4).alias("plat"), F.col("lon").alias("plon"))


_ASOF = f"""with f as ({DENSE_SQL}), p as (select track, rn as probe, t_s + (rn * 7 + track) % 121 as t_s, lat + 1e-4 as plat, lon as plon from f),
 c as (select p.track, p.probe, abs(f.t_s - p.t_s) as dt, f.rn, f.lat, f.lon, plat, plon, row_number() over (partition by p.track, p.probe order by abs(f.t_s - p.t_s), f.t_s, f.rn) as k from p join f using (track)),
 m as (select *, {hav_sql('plat', 'plon', 'lat', 'lon')} as dist from c where k = 1)"""


def _asof(spark, d, tolerance):
    fixes = dense(spark, d).select("track", "t_s", "rn", "lat", "lon")
    x = match.asof_nearest(_tracker(spark, d), fixes, "t_s", tolerance, "track", ["rn", "lat", "lon"], "rn")
    return x.select("track", "probe", "dt", F.col("fix.rn").alias("rn"), geo.haversine("plat", "plon", "fix.lat", "fix.lon").alias("dist"))


@query(f"{_ASOF} select track, probe, rn, dt, round(dist, 3) as dist from m where dt <= 60")
def asof_nearest_60(spark, d):
    return _asof(spark, d, 60).select("track", "probe", "rn", "dt", r("dist", 3))


@query(f"{_ASOF} select track, probe, rn, dt, round(dist, 3) as dist from m where dt <= 90")
def asof_nearest_90(spark, d):
    return _asof(spark, d, 90).select("track", "probe", "rn", "dt", r("dist", 3))


@query(f"""{_ASOF}, z as (select track, list_sort(list(round(dist, 6))) as a from m where dt <= 90 group by track)
 select track, len(a) as n, a[len(a) // 2 + 1] as median, a[cast(floor(len(a) * 0.9) as int) + 1] as p90, a[-1] as max from z""")
def asof_percentiles(spark, d):
    return match.nearest_rank(_asof(spark, d, 90), F.round("dist", 6), ["track"])


@query(f"""{_ASOF}, z as (select list_sort(list(round(dist, 6))) as a from m where dt <= 90)
 select len(a) as n, a[len(a) // 2 + 1] as median, a[cast(floor(len(a) * 0.9) as int) + 1] as p90, a[-1] as max from z""")
def asof_overall(spark, d):
    """Median, p90 and maximum over all matches of all tracks."""
    return match.nearest_rank(_asof(spark, d, 90), F.round("dist", 6), [])


_PATH = f"""{D}, t as (select track, n, lat as ay, lon * {geo.K0} as ax, lead(lat) over w as b_y, lead(lon) over w * {geo.K0} as bx from g window w as (partition by track order by n)),
 p as (select track, rn as probe, (lat + ((rn * 31) % 17) * 1e-3) as py, lon * {geo.K0} as px from f),
 c as (select p.track, probe, n, px, py, ax, ay, bx, b_y, case when bx = ax and b_y = ay then 0 else greatest(0, least(1, ((px - ax) * (bx - ax) + (py - ay) * (b_y - ay)) / ((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)))) end as u from p join t using (track) where bx is not null),
 m as (select track, probe, min(sqrt(power(px - ax - u * (bx - ax), 2) + power(py - ay - u * (b_y - ay), 2))) * 111000 as dist from c group by all)"""


def _path(spark, d):
    pts = quality.keep_good(dense(spark, d)).select("track", "rn", (F.col("lon") * geo.K0).alias("x"), F.col("lat").alias("y"))
    segs = match.segments(pts, "track", ["rn"])
    probes = dense(spark, d).select("track", F.col("rn").alias("probe"), (F.col("lon") * geo.K0).alias("x"), (F.col("lat") + ((F.col("rn") * 31) % 17) * 1e-3).alias("y"), F.struct("track", "rn").alias("id"))
    return match.nearest_segment(probes, segs, "track", "id", 0.005, with_seg=False).select("id.track", F.col("id.rn").alias("probe"), (F.col("dist") * geo.M_PER_DEG).alias("dist"))


@query(f"{_PATH} select track, probe, round(dist, 3) as dist from m")
def path_distance(spark, d):
    return _path(spark, d).select("track", "probe", r("dist", 3))


@query(f"{_PATH} select track, count(*) as n, count(*) filter (where dist < 50) as within from m group by track")
def within_50m(spark, d):
    return _path(spark, d).groupBy("track").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("dist") < 50).alias("within"))


# offshore

_SEGS = ", ".join(f"({i}, {a[0]}e0, {a[1]}e0, {b[0]}e0, {b[1]}e0)" for i, (a, b) in enumerate(zip(geo.BARRIER, geo.BARRIER[1:])))
_OFF = f"""{P}, b as (select i, ax * {geo.K0} as ax, ay, bx * {geo.K0} as bx, b_y from (values {_SEGS}) v(i, ax, ay, bx, b_y)),
 c as (select track, seq, t_s, lon * {geo.K0} as px, lat as py, b.*, greatest(0, least(1, ((lon * {geo.K0} - ax) * (bx - ax) + (lat - ay) * (b_y - ay)) / ((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)))) as u from f, b),
 e as (select track, seq, t_s, i, power(px - (ax + u * (bx - ax)), 2) + power(py - (ay + u * (b_y - ay)), 2) as d2, (bx - ax) * (py - ay) - (b_y - ay) * (px - ax) as cr from c),
 o as (select track, seq, t_s, case when cr > 0 then 1 else -1 end * sqrt(d2) * 111.0 as km from (select *, row_number() over (partition by seq order by d2, i) as k from e) where k = 1)"""


def _offshore(spark, d):
    return geo.with_offshore_km(plain(spark, d)).select("track", "seq", "t_s", "km")


@query(f"{_OFF} select track, seq, round(km, 6) as km from o")
def offshore_km(spark, d):
    return _offshore(spark, d).select("track", "seq", r("km"))


_EXC = "x as (select track, min(t_s) as a, max(t_s) as b, max(km) as km from o where km > 0.5 group by track)"


def _excursions(spark, d):
    return _offshore(spark, d).filter(F.col("km") > geo.OFFSHORE_KM).groupBy("track").agg(F.min("t_s").alias("a"), F.max("t_s").alias("b"), F.max("km").alias("km"))


@query(f"{_OFF}, {_EXC} select track, round(a, 3) as first_s, round(b, 3) as last_s, round((b - a) / 60, 3) as minutes, round(km, 6) as max_km from x")
def offshore_excursion(spark, d):
    return _excursions(spark, d).select("track", r("a", 3, "first_s"), r("b", 3, "last_s"), r((F.col("b") - F.col("a")) / 60, 3, "minutes"), r("km", 6, "max_km"))


@query(f"{_OFF}, {_EXC} select x.track, count(f.seq) as seen from x left join f on f.track = x.track and f.t_s >= a and f.t_s <= b group by x.track")
def excursion_seen(spark, d):
    pts = plain(spark, d).select("track", "t_s", "seq")
    x = match.in_interval(_excursions(spark, d).select("track", "a", "b"), pts, "a", "b", "t_s", "track", True, 86400.0)
    return x.groupBy("track").agg(F.count("point.seq").alias("seen"))


# corridor offset

_GATE = f"least(greatest(0, least(1, (lat - {geo.CORRIDOR_S - geo.CORRIDOR_FADE}) / {geo.CORRIDOR_FADE})), greatest(0, least(1, ({geo.CORRIDOR_N + geo.CORRIDOR_FADE} - lat) / {geo.CORRIDOR_FADE})))"


@query(f"{P} select track, seq, round({_GATE}, 9) as gate from f")
def corridor_gate(spark, d):
    return plain(spark, d).select("track", "seq", r(geo.corridor_gate("lat"), 9, "gate"))


_BEND = f"""{D}, a as (select track, n, lon * {geo.K0} as x, lat as y from g), b as (select *, lead(x) over w as nx, lead(y) over w as ny from a window w as (partition by track order by n)),
 c as (select track, n, x, y from b where nx is null or nx <> x or ny <> y), e as (select *, lead(x) over w - x as sx, lead(y) over w - y as sy from c window w as (partition by track order by n)),
 h as (select *, sqrt(sx*sx+sy*sy) as len, sx / sqrt(sx*sx+sy*sy) as ux, sy / sqrt(sx*sx+sy*sy) as uy from e),
 i as (select *, lag(ux) over w as vx, lag(uy) over w as vy, lag(len) over w as pl from h window w as (partition by track order by n)),
 j as (select *, acos(greatest(-1, least(1, ux * vx + uy * vy))) as turn from i), k as (select *, case when turn > 1e-9 then (pl + len) / 2 / turn end as radius from j)"""


def _good_dense(spark, d):
    w = Window.partitionBy("track").orderBy("rn")
    return quality.keep_good(dense(spark, d)).withColumn("n", F.row_number().over(w).cast("long"))


@query(f"{_BEND} select track, n, round(radius, 7) as radius from k")
def turn_radius(spark, d):
    return offset.headings(_good_dense(spark, d), "track", "n").select("track", "n", r("radius", 7))


_TAPER = f"""{_BEND}, l as (select *, min(radius) over (partition by track order by n rows between 7 preceding and 7 following) as tight, count(*) over (partition by track) as rows_, -0.0015 as d from k),
 m as (select *, case when tight is null then 1 else least(1, tight / 0.003) end as taper from l)"""


@query(f"{_TAPER} select track, n, round(tight, 7) as tight from m")
def rolling_min_taper(spark, d):
    w = Window.partitionBy("track").orderBy("n").rowsBetween(-7, 7)
    return offset.headings(_good_dense(spark, d), "track", "n").select("track", "n", F.round(F.min("radius").over(w), 7).alias("tight"))


_SMOOTH = f"""{_TAPER}, q as (select *, row_number() over w as rk, count(*) over (partition by track) as m_, first_value(taper) over w as t0, last_value(taper) over (partition by track order by n rows between unbounded preceding and unbounded following) as t1,
   sum(taper) over (partition by track order by n rows between 7 preceding and 7 following) as sm from m window w as (partition by track order by n)),
 s as (select *, (sm + greatest(0, 8 - rk) * t0 + greatest(0, 7 - (m_ - rk)) * t1) / 15 as smooth from q)"""


@query(f"{_SMOOTH} select track, n, round(smooth, 7) as smooth from s")
def rolling_mean_taper(spark, d):
    w = Window.partitionBy("track").orderBy("n")
    h = offset.headings(_good_dense(spark, d), "track", "n").withColumn("tight", F.min("radius").over(w.rowsBetween(-7, 7)))
    h = h.withColumn("taper", F.when(F.col("tight").isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.col("tight") / 0.003)))
    return h.withColumn("smooth", offset.edge_mean(F.col("taper"), "track", "n")).select("track", "n", r("smooth", 7))


def _shifted(spark, d):
    return offset.shifted(_good_dense(spark, d), "track", "n", F.lit(-0.0015))


_SHIFT = f"""{_SMOOTH}, z as (select *, smooth * {_GATE.replace("lat", "y")} as scale, coalesce(ux, 0) + coalesce(vx, 0) as tx, coalesce(uy, 0) + coalesce(vy, 0) as ty from s),
 y as (select track, n, x, y, case when rows_ < 3 or sqrt(tx*tx+ty*ty) < 1e-12 then 0 else -ty / sqrt(tx*tx+ty*ty) end as nx_, case when rows_ < 3 or sqrt(tx*tx+ty*ty) < 1e-12 then 0 else tx / sqrt(tx*tx+ty*ty) end as ny_, scale from z)"""


@query(f"{_SHIFT} select track, n, round(x + nx_ * -0.0015 * scale, 8) as qx, round(y + ny_ * -0.0015 * scale, 8) as qy from y")
def offset_points(spark, d):
    return _shifted(spark, d).select("track", "n", r("qx", 8), r("qy", 8))


_AFLOAT_POINTS = f"with ld as ({_LOADED} select track, t_s, lat, lon from pts where leg = 'afloat'), g as (select *, row_number() over (partition by track order by t_s) as n from ld)"


@query(f"{_SHIFT.replace(D, _AFLOAT_POINTS)} select track, n, round(x + nx_ * -0.0015 * scale, 8) as qx, round(y + ny_ * -0.0015 * scale, 8) as qy from y")
def offset_day_points(spark, d):
    """The shifted line over what the day loader keeps of each day afloat."""
    w = Window.partitionBy("track").orderBy("t_s")
    x = _loaded(spark, d)[0].filter("leg = 'afloat'").withColumn("n", F.row_number().over(w).cast("long"))
    return offset.shifted(x, "track", "n", F.lit(-0.0015)).select("track", "n", r("qx", 8), r("qy", 8))


@query()
def trim_loops(spark, d):
    return offset.trim_folds(_shifted(spark, d), "track", "n").select("track", "n", r(F.col("x") / geo.K0, 8, "lon"), r("y", 8, "lat"))


_CELL = 0.0037


def _drawn_sql(name: str, x: str, y: str) -> str:
    """CTE of the cells that the lines through (x, y) of ``drawn`` pass."""
    return f"""{name}s as (select * from (select track, {x} as ax, {y} as ay, lead({x}) over w as bx, lead({y}) over w as b_y from drawn window w as (partition by track order by n)) where bx is not null),
 {name}c as (select *, unnest(range(floor(least(ax, bx) / {_CELL})::bigint, floor(greatest(ax, bx) / {_CELL})::bigint + 1)) as cx from {name}s),
 {name}y as (select track, cx, case when bx = ax then ay else ay + (greatest(least(ax, bx), cx * {_CELL}) - ax) / (bx - ax) * (b_y - ay) end as lo, case when bx = ax then b_y else ay + (least(greatest(ax, bx), (cx + 1) * {_CELL}) - ax) / (bx - ax) * (b_y - ay) end as hi from {name}c),
 {name} as (select distinct track, cx, unnest(range(floor(least(lo, hi) / {_CELL})::bigint, floor(greatest(lo, hi) / {_CELL})::bigint + 1)) as cy from {name}y)"""


@query(f"""{_SHIFT}, drawn as (select track, n, x, y, x + nx_ * (-0.0015 * scale) as qx, y + ny_ * (-0.0015 * scale) as qy from y), {_drawn_sql('before', 'x', 'y')}, {_drawn_sql('after', 'qx', 'qy')},
 d as (select track, cx, cy, 1 as s from (select * from before except select * from after) union all select track, cx, cy, 2 from (select * from after except select * from before))
 select track, floor(cx / 64)::bigint as tx, floor(cy / 64)::bigint as ty, count(*) filter (where s = 1) as removed, count(*) filter (where s = 2) as added from d group by all""")
def render_difference(spark, d):
    """Tracks drawn with and without the corridor's offset: the cells of each tile that change."""
    return raster.drawn_difference(_shifted(spark, d), ["track"], "n", ("x", "y"), ("qx", "qy"), _CELL)


_CROSS = f"""{D}, t as (select track, n, lon as ax, lat as ay, lead(lon) over w as bx, lead(lat) over w as b_y from g window w as (partition by track order by n)),
 c as (select a.track, a.n as i, b.n as j, a.ax, a.ay, a.bx - a.ax as rx, a.b_y - a.ay as ry, b.ax as qx, b.ay as qy, b.bx - b.ax as sx, b.b_y - b.ay as sy from t a join t b on a.track = b.track and b.n >= a.n + 2 and b.n < a.n + 80 where a.bx is not null and b.bx is not null),
 e as (select *, rx * sy - ry * sx as den from c), x as (select track, i, j, ((qx - ax) * sy - (qy - ay) * sx) / den as t, ((qx - ax) * ry - (qy - ay) * rx) / den as u from e where den <> 0)"""


@query(f"{_CROSS} select track, i, max(j) as j from x where t > 1e-7 and t < 1 - 1e-7 and u > 1e-7 and u < 1 - 1e-7 group by all")
def loop_crossings(spark, d):
    """The farthest crossing ahead of every segment, by a band join within the track on blocks of the look-ahead."""
    x = _good_dense(spark, d).select("track", "n", F.col("lon").alias("x"), F.col("lat").alias("y"))
    s = match.segments(x, "track", ["n"])
    a = s.withColumn("blk", F.explode(F.array(F.expr("seg div 80"), F.expr("seg div 80 + 1"))))
    b = s.select("track", F.expr("seg div 80").alias("blk"), *[F.col(c).alias(f"o_{c}") for c in ("seg", "ax", "ay", "bx", "by")])
    t, u = geo.crossing(("ax", "ay"), ("bx", "by"), ("o_ax", "o_ay"), ("o_bx", "o_by"))
    hit = a.join(b, ["track", "blk"]).filter("o_seg >= seg + 2 and o_seg < seg + 80").withColumns({"t": t, "u": u})
    inside = (F.col("t") > 1e-7) & (F.col("t") < 1 - 1e-7) & (F.col("u") > 1e-7) & (F.col("u") < 1 - 1e-7)
    return hit.filter(inside).groupBy("track", F.col("seg").alias("i")).agg(F.max("o_seg").alias("j"))


# labels and extents


@query(f"""with f as ({DENSE_SQL}), p as (select track, track // 5 as chart, rn, lat, lon, lon * cos(radians(lat)) as x, lat as y, row_number() over (partition by track order by rn) - 1 as i from f),
 c as (select a.track, a.rn, a.lat, a.lon, a.i, min(sqrt(power(b.x - a.x, 2) + power(b.y - a.y, 2))) as dist from p a join p b on a.chart = b.chart and a.track <> b.track and b.i % 2 = 0 where a.i % 3 = 0 group by all),
 k as (select *, row_number() over (partition by track order by round(dist, 9) desc, i) as k from c) select track, rn, round(lat, 6) as lat, round(lon, 6) as lon, round(dist, 8) as dist from k where k = 1""")
def badge_farthest(spark, d):
    """On charts of five tracks, the point of each track farthest from the others."""
    x = dense(spark, d).select("track", "rn", "lat", "lon", F.expr("track div 5").alias("chart"))
    return report.farthest_point(x, "track", "rn", "chart").select("track", "rn", r("lat"), r("lon"), r("dist", 8))


# Labelled places that badges keep clear of, (lon, lat): anchorages, the airport, towns and isles.
AVOID = (
    (-76.9907, 26.4488), (-76.9849, 26.3568), (-77.0782, 26.5135), (-77.0640, 26.5310), (-76.9594, 26.5407), (-77.0002, 26.3242),
    (-77.1310, 26.6790), (-77.0030, 26.5930), (-76.9700, 26.4950), (-77.0270, 26.4700), (-76.9830, 26.4400), (-77.1550, 26.4300),
)
_AVOID = ", ".join(f"({lon}e0, {lat}e0)" for lon, lat in AVOID)


@query(f"""with f as ({DENSE_SQL}), v as (select * from f where track % 3 <> 0), p as (select track, track // 5 as chart, rn, lat, lon, lon * cos(radians(lat)) as x, lat as y, row_number() over (partition by track order by rn) - 1 as i from v),
 a as (select lo * cos(radians(la)) as x, la as y from (values {_AVOID}) t(lo, la)), own as (select *, i // 3 as k, count(*) over (partition by track) as m from p where i % 3 = 0 and track % 10 <> 1),
 c as (select own.track, own.rn, own.lat, own.lon, own.k, least(min(sqrt(power(b.x - own.x, 2) + power(b.y - own.y, 2))), (select min(sqrt(power(a.x - own.x, 2) + power(a.y - own.y, 2))) from a)) as dist
   from own join p b on own.chart = b.chart and own.track <> b.track and b.i % 2 = 0 where own.k % greatest(1, own.m // 400) = 0 group by own.track, own.rn, own.lat, own.lon, own.k, own.x, own.y),
 z as (select *, row_number() over (partition by track order by round(dist, 9) desc, k) as place from c)
 select track, rn, round(lat, 6) as lat, round(lon, 6) as lon, round(dist, 8) as dist from z where place = 1 union all select distinct track, null, 26.5585, -77.0836, null from v where track % 10 = 1""")
def badge_positions(spark, d):
    """Badges of the sailing days, clear of the other days and of labelled places; one day in ten is placed by hand."""
    x = dense(spark, d).filter("track % 3 != 0").select("track", "rn", "lat", "lon", F.expr("track div 5").alias("chart"))
    by_hand = x.filter("track % 10 = 1").select("track", F.lit(26.5585).alias("lat"), F.lit(-77.0836).alias("lon")).distinct()
    return report.farthest_point(x, "track", "rn", "chart", avoid=AVOID, manual=by_hand).select("track", "rn", r("lat"), r("lon"), r("dist", 8))


@query(f"{P} select track, round((min(lon) + max(lon)) / 2, 6) as cx, round((min(lat) + max(lat)) / 2, 6) as cy, round(greatest(max(lon) - min(lon), 0.012) * 1.35, 6) as width, round(greatest(max(lat) - min(lat), 0.012) * 1.35, 6) as height from f group by track having count(*) >= 2")
def bbox_extent(spark, d):
    return report.extent(plain(spark, d), "track").select("track", r("cx"), r("cy"), r("width"), r("height"))


@query(f"""{P}, a as (select distinct round(lat, 3) as v from f), b as (select v, floor(v) as g, round_even((v - floor(v)) * 60, 0) as m from a)
 select v, case when m >= 60 then g + 1 else g end::int || '°' || lpad((case when m >= 60 then 0 else m end)::int::varchar, 2, '0') || '\u2032N' as label from b""")
def dm_label(spark, d):
    x = plain(spark, d).select(F.round("lat", 3).alias("v")).distinct()
    return x.select("v", geo.dm_label("v", "N", "S").alias("label"))


@query(f"{P}, e as (select track, floor(min(lat) * 60)::int as a, ceil(max(lat) * 60)::int as b from f group by track), m as (select track, unnest(range(a, b + 1)) as minute from e) select track, minute::int as minute, minute % 2 = 0 as inked, minute % 5 = 0 as labelled from m")
def tick_table(spark, d):
    e = plain(spark, d).groupBy("track").agg(F.floor(F.min("lat") * 60).cast("int").alias("a"), F.ceil(F.max("lat") * 60).cast("int").alias("b"))
    m = e.select("track", F.explode(F.sequence("a", "b")).alias("minute"))
    return m.select("track", "minute", (F.pmod("minute", F.lit(2)) == 0).alias("inked"), (F.pmod("minute", F.lit(5)) == 0).alias("labelled"))


# The same badges over the days' loaded points afloat; the candidates' table has another name, since the loader's SQL has one like it.
_AFLOAT = _LOADED + ", v as (select track, t_s as rn, lat, lon from pts where leg = 'afloat' and track % 3 <> 0), p as (" + ORACLE["badge_positions"].split(", p as (", 1)[1].replace("c as (select own", "badge as (select own").replace("from c)", "from badge)")


@query(_AFLOAT)
def badge_day_points(spark, d):
    """Badges of the sailing days over what the day loader keeps of them afloat; ``rn`` is the second."""
    x = _loaded(spark, d)[0].filter("leg = 'afloat' and track % 3 != 0").select("track", F.col("t_s").alias("rn"), "lat", "lon", F.expr("track div 5").alias("chart"))
    by_hand = x.filter("track % 10 = 1").select("track", F.lit(26.5585).alias("lat"), F.lit(-77.0836).alias("lon")).distinct()
    return report.farthest_point(x, "track", "rn", "chart", avoid=AVOID, manual=by_hand).select("track", "rn", r("lat"), r("lon"), r("dist", 8))


# The frame of days ashore (centre, size), the page's aspect there, and seven charts side by side on it.
_ASHORE, _ASPECT = (-77.0618, 26.5305, 0.047), 1 / geo.K0
_RATIO = 0.134 * 24 / ((0.87 - 0.06) / 7 * 18)
_PAGE = _LOADED + f""", bx as (select track, count(*) as n, min(lon) as a, max(lon) as b, min(lat) as c, max(lat) as e from pts group by track having count(*) >= 2),
 q as (select track, case when track % 3 = 0 then {_ASHORE[0]}e0 else (a + b) / 2 end as cx, case when track % 3 = 0 then {_ASHORE[1]}e0 else (c + e) / 2 end as cy,
  case when track % 3 = 0 then {_ASHORE[2]}e0 else greatest(b - a, 0.012e0) * 1.35e0 end as w, case when track % 3 = 0 then {_ASHORE[2]}e0 else greatest(e - c, 0.012e0) * 1.35e0 end as h from bx),
 pg as (select track, cx, cy, case when h / (w / {_ASPECT}e0) < {_RATIO}e0 then w else h / {_RATIO}e0 * {_ASPECT}e0 end as width, case when h / (w / {_ASPECT}e0) < {_RATIO}e0 then w / {_ASPECT}e0 * {_RATIO}e0 else h end as height from q),
 ax as (select track, 'lon' as axis, cx - width / 2 as lo, cx + width / 2 as hi from pg union all select track, 'lat', cy - height / 2, cy + height / 2 from pg)"""


def _pages(spark, d):
    """The frame of every loaded day's chart: around its points, or the fixed one for days ashore (one track in three), fitted to the page."""
    box = report.extent(_loaded(spark, d)[0], "track")
    ashore = F.col("track") % 3 == 0
    fixed = dict(zip(("cx", "cy", "width", "height"), (*_ASHORE, _ASHORE[2])))
    return report.fitted(box.withColumns({c: F.when(ashore, F.lit(v)).otherwise(F.col(c)) for c, v in fixed.items()}), _RATIO, _ASPECT)


@query(f"{_PAGE} select track, round(cx, 6) as cx, round(cy, 6) as cy, round(width, 6) as width, round(height, 6) as height from pg")
def page_extent(spark, d):
    return _pages(spark, d).select("track", r("cx"), r("cy"), r("width"), r("height"))


@query(f"{_PAGE}, m as (select *, unnest(range(floor(lo * 60)::bigint, ceil(hi * 60)::bigint)) as minute from ax) select track, axis, minute, round(greatest(minute / 60, lo), 6) as start, round(least((minute + 1) / 60, hi), 6) as stop from m where minute % 2 = 0 and least((minute + 1) / 60, hi) > greatest(minute / 60, lo)")
def neatline_bands(spark, d):
    return report.neatline_bands(_pages(spark, d), "track").select("track", "axis", "minute", r("start"), r("end", 6, "stop"))


@query(f"""{_PAGE}, m as (select *, unnest(range(ceil(lo * 60)::bigint, floor(hi * 60)::bigint + 1)) as minute from ax)
 select track, axis, minute, (abs(minute) // 60) || '°' || lpad((abs(minute) % 60)::varchar, 2, '0') || '\u2032' || case when axis = 'lon' then 'W' else 'N' end as label from m
 where minute % 5 = 0 and minute / 60 - lo >= 0.012 and hi - minute / 60 >= 0.012""")
def neatline_labels(spark, d):
    return report.neatline_labels(_pages(spark, d), "track").select("track", "axis", "minute", "label")


_CAMERA = "case when sats % 4 = 0 then 'action' when sats % 4 = 1 then 'drone' when quality = 6 then 'compact' else 'phone' end"


@query(f"{P} select {_CAMERA} as camera, count(*) as images, count(*) filter (where sats % 4 in (1, 2) and hdop <= 4) as located, case when count(*) filter (where sats % 4 in (1, 2) and hdop <= 4) > 0 then 'position' else 'time' end as placed_by from f group by 1")
def photo_cameras(spark, d):
    own = F.expr("sats % 4 in (1, 2) and hdop <= 4")
    x = plain(spark, d).select(F.expr(_CAMERA).alias("camera"), F.when(own, F.col("lat")).alias("lat"), F.when(own, F.col("lon")).alias("lon"))
    return report.camera_table(x)


@query(f"{_OFF} select o.track, count(*) as n, count(*) filter (where sog_kn < 0.5) as slow, round(count(*) filter (where sog_kn < 0.5) / count(*), 6) as share from o join f using (seq) where km > 0.5 group by o.track")
def offshore_slow_share(spark, d):
    x = geo.with_offshore_km(plain(spark, d)).filter(F.col("km") > geo.OFFSHORE_KM)
    return report.slow_share(x, "track").select("track", "n", "slow", r("share"))


# roads: a ring of nations with chords, whole-number weights


def _ways(spark, d):
    """One way a nation, to the next nation and on to a farther one: footways, service and residential roads."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("k"))
    at = lambda k: F.struct((26.4 + (k % 5) * 0.01).alias("lat"), (-77.1 + F.floor(k / 5) * 0.01).alias("lon"))
    tags = F.create_map(F.lit("highway"), F.when(F.col("k") % 7 == 0, "footway").when(F.col("k") % 3 == 1, "service").otherwise("residential"))
    return n.select(F.col("k").alias("way_id"), tags.alias("tags"), F.array(at(F.col("k")), at((F.col("k") + 1) % 25), at((F.col("k") * 3 + 2) % 25)).alias("points"))


_NODE = lambda k: f"round((26.4 + ({k} % 5) * 0.01) * 1e6)::bigint", lambda k: f"round((-77.1 + floor({k} / 5) * 0.01) * 1e6)::bigint"


def _edges_sql(where: str) -> str:
    pick = lambda a, b: f"select {_NODE[0](a)} as a_lat, {_NODE[1](a)} as a_lon, {_NODE[0](b)} as b_lat, {_NODE[1](b)} as b_lon from k where {where}"
    return f"""with recursive k as (select n_nationkey::int as k from nation), e0 as ({pick('k', '((k + 1) % 25)')} union all {pick('((k + 1) % 25)', '((k * 3 + 2) % 25)')}),
 e1 as (select * from e0 where a_lat <> b_lat or a_lon <> b_lon), e as (select * from e1 union all select b_lat, b_lon, a_lat, a_lon from e1), w as (select *, {hav_sql('a_lat/1e6', 'a_lon/1e6', 'b_lat/1e6', 'b_lon/1e6')} as w from e)"""


@query(_edges_sql("k % 7 <> 0") + " select a_lat, a_lon, b_lat, b_lon, round(w, 3) as w from w")
def graph_edges(spark, d):
    return graph.edges(_ways(spark, d)).select(F.col("src.lat").alias("a_lat"), F.col("src.lon").alias("a_lon"), F.col("dst.lat").alias("b_lat"), F.col("dst.lon").alias("b_lon"), r("w", 3))


@query(_edges_sql("true") + f", n as (select distinct a_lat, a_lon from w) select a_lat as lat, a_lon as lon from n order by {hav_sql('26.4171', '-77.0729', 'a_lat/1e6', 'a_lon/1e6')}, a_lat, a_lon limit 1")
def graph_nearest(spark, d):
    return graph.nearest_node(graph.edges(_ways(spark, d), graph.WALKABLE), 26.4171, -77.0729).select("node.lat", "node.lon")


def _reached(spark, d, allowed):
    g = graph.edges(_ways(spark, d), allowed)
    return graph.distances(g, graph.nearest_node(g, 26.4, -77.1))


_REACH = """, u as (select a_lat*1000000000 + a_lon as a, b_lat*1000000000 + b_lon as b, min(w) as w from w group by all), s0 as (select arg_min(a_lat*1000000000 + a_lon, (power(a_lat - 26400000, 2) + power(a_lon + 77100000, 2))) as a from w),
 r0 as (select a as n, 0.0::double as dist, 0 as hops from s0), {rounds} """


def _bellman(rounds: int) -> str:
    steps = [f"r{i + 1} as materialized (select n, min(dist) as dist from (select n, dist from r{i} union all select b, dist + w from r{i} join u on a = n) group by n)" for i in range(rounds)]
    return ", ".join(steps)


@query(_edges_sql("true") + _REACH.format(rounds=_bellman(24)) + "select n as node, round(dist, 3) as dist from r24")
def shortest_path(spark, d):
    x = _reached(spark, d, graph.WALKABLE)
    return x.select((F.col("node.lat") * 1000000000 + F.col("node.lon")).alias("node"), r("dist", 3))


# a street grid whose side grows with the events: an event is a crossing, with streets east and, mostly, north

_GRID = f"""with recursive s as (select greatest(2, floor(sqrt(count(*)))::bigint) as side from events), c as (select event_id as k, event_type, event_id % side as i, event_id // side as j, side from events, s where event_id // side < side),
 pl as (select *, 26000000 + 900 * i + (k * 7919) % 300 as la, -77000000 + 900 * j + (k * 104729) % 300 as lo from c),
 g as (select a.k as ka, b.k as kb, a.la, a.lo, b.la as lb, b.lo as ob from pl a join pl b on (b.k = a.k + 1 and b.j = a.j) or (b.k = a.k + a.side and (a.event_type <> 'purchase' or a.i = 0))),
 e as (select *, {hav_sql('la / 1e6', 'lo / 1e6', 'lb / 1e6', 'ob / 1e6')} as w from g), u as (select la * 1000000000 + lo as a, lb * 1000000000 + ob as b, w from e union all select lb * 1000000000 + ob, la * 1000000000 + lo, w from e)"""


def _grid(spark, d):
    """(src, dst, w) of the street grid, through ways of two points."""
    e = table(spark, d, "events").select("event_id", "event_type")
    # One row on the right: the side of the grid.
    side = e.agg(F.greatest(F.lit(2), F.floor(F.sqrt(F.count(F.lit(1))))).cast("long").alias("side"))
    c = e.crossJoin(F.broadcast(side)).select("event_id", "event_type", F.expr("event_id % side").alias("i"), F.expr("event_id div side").alias("j"), "side").filter("j < side")
    at = F.struct(((26_000_000 + 900 * F.col("i") + F.col("event_id") * 7919 % 300) / 1e6).alias("lat"), ((-77_000_000 + 900 * F.col("j") + F.col("event_id") * 104729 % 300) / 1e6).alias("lon"))
    c = c.select("event_id", "event_type", "i", "j", "side", at.alias("at"))
    ends = c.select(F.col("event_id").alias("to"), F.col("at").alias("far"))
    north = F.when((F.col("event_type") != "purchase") | (F.col("i") == 0), F.col("event_id") + F.col("side"))
    east = F.when(F.col("i") + 1 < F.col("side"), F.col("event_id") + 1)
    met = c.select("event_id", "at", F.explode(F.array_compact(F.array(east, north))).alias("to")).join(ends, "to")
    return graph.edges(met.select(F.create_map(F.lit("highway"), F.lit("residential")).alias("tags"), F.array("at", "far").alias("points")))


@query(_GRID + """, s0 as (select la * 1000000000 + lo as a from pl where k = 0),
 t(n, dist) using key (n) as (select a, 0.0::double from s0 union select b, min(t.dist + u.w) from t join u on t.n = u.a left join recurring.t r on r.n = u.b where r.dist is null or t.dist + u.w < r.dist group by b)
 select n as node, round(dist, 2) as dist from t""")
def road_distances(spark, d):
    """Distances from the first crossing of a street grid to every other, region by region."""
    first = spark.createDataFrame([((26_000_000, -77_000_000),)], "node struct<lat:bigint,lon:bigint>")
    x = graph.regional_distances(_grid(spark, d), first)
    return x.select((F.col("node.lat") * 1000000000 + F.col("node.lon")).alias("node"), r("dist", 2))


@query(_edges_sql("k % 3 = 1 and k % 7 <> 0") + _REACH.format(rounds=_bellman(24)) + "select distinct a as node from u where a not in (select n from r24)")
def unreachable(spark, d):
    """Nodes of the service roads that no chain of service roads leads to."""
    g = graph.edges(_ways(spark, d), ("service",))
    x = graph.distances(g, graph.nearest_node(g, 26.4, -77.1))
    return g.select(F.col("src").alias("node")).distinct().join(x, "node", "left_anti").select((F.col("node.lat") * 1000000000 + F.col("node.lon")).alias("node"))


@query(_edges_sql("true") + _REACH.format(rounds=_bellman(24)) + """, t as (select n from r24),
 back as (select n as target, n as node, 0::bigint as back from t union all
  select target, (select min(u.a) from u join r24 p on p.n = u.a join r24 q on q.n = u.b where u.b = node and abs(p.dist + u.w - q.dist) < 1e-6), back + 1 from back where node <> (select a from s0))
 select target, node, back from back""")
def route_points(spark, d):
    """The nodes on the way to every node."""
    x = _reached(spark, d, graph.WALKABLE)
    flat = F.col("node.lat") * 1000000000 + F.col("node.lon")
    way = graph.routes(x, x.select("node"))
    return way.select((F.col("target.lat") * 1000000000 + F.col("target.lon")).alias("target"), flat.alias("node"), "back")


@query(_edges_sql("true") + _REACH.format(rounds=_bellman(24)).replace("(power(a_lat - 26400000, 2) + power(a_lon + 77100000, 2))", hav_sql("a_lat/1e6", "a_lon/1e6", "26.4012", "-77.0991")) + f""", e0_ as (select arg_min(a_lat*1000000000 + a_lon, {hav_sql("a_lat/1e6", "a_lon/1e6", "26.4377", "-77.0613")}) as n from w),
 back as (select n as node, 0::bigint as back from e0_ where n in (select n from r24) union all
  select (select min(u.a) from u join r24 p on p.n = u.a join r24 q on q.n = u.b where u.b = node and abs(p.dist + u.w - q.dist) < 1e-6), back + 1 from back where node <> (select a from s0)),
 way as (select max(back) over () - back + 1 as place, (select any_value(a_lat) from w where a_lat*1000000000 + a_lon = node) / 1e6 as lat, (select any_value(a_lon) from w where a_lat*1000000000 + a_lon = node) / 1e6 as lon from back),
 all_ as (select * from way union all select 0, 26.4012, -77.0991 from way where place = 1 union all select max(place) + 1, 26.4377, -77.0613 from way having count(*) > 0)
 select place, round(lat, 6) as lat, round(lon, 6) as lon, (select round(dist, 3) from r24 where n = (select n from e0_)) as metres from all_""")
def road_route(spark, d):
    """The way between two positions: both ends, the nodes between them, and the length along the roads."""
    x = graph.route(graph.edges(_ways(spark, d), graph.WALKABLE), (26.4012, -77.0991), (26.4377, -77.0613))
    return x.select("place", r("lat"), r("lon"), r("metres", 3))


@query(ORACLE["road_route"])
def road_route_stored(spark, d):
    """The same way from the result store: made once for its ends and the version of the table, then read."""
    ends = (26.4012, -77.0991), (26.4377, -77.0613)
    make = lambda: graph.route(graph.edges(_ways(spark, d), graph.WALKABLE), *ends)
    x = stored(spark, f"{ensure_checkpoint_dir(spark)}/results", "route", {"ends": ends, "profile": "walk"}, [f"{d}/nation.parquet"], make)
    return x.select("place", r("lat"), r("lon"), r("metres", 3))


# planar geometry

_BOX = (-77.15, 26.35, -77.0, 26.6)


def _segments(spark, d):
    w = Window.partitionBy("track").orderBy("t_s", "seq")
    x = plain(spark, d).select(F.col("track").alias("line"), "seq", F.col("lon").alias("ax"), F.col("lat").alias("ay"), F.lead("lon").over(w).alias("bx"), F.lead("lat").over(w).alias("by"))
    return x.filter("bx is not null")


_CLIP = f"""{P}, s as (select track as line, lon as ax, lat as ay, lead(lon) over w as bx, lead(lat) over w as b_y from f window w as (partition by track order by t_s, seq)),
 c as (select line, ax, ay, bx - ax as dx, b_y - ay as dy from s where bx is not null),
 l as (select *, greatest(0, case when dx <> 0 then least(({_BOX[0]} - ax) / dx, ({_BOX[2]} - ax) / dx) else 0 end, case when dy <> 0 then least(({_BOX[1]} - ay) / dy, ({_BOX[3]} - ay) / dy) else 0 end) as lo,
  least(1, case when dx <> 0 then greatest(({_BOX[0]} - ax) / dx, ({_BOX[2]} - ax) / dx) else 1 end, case when dy <> 0 then greatest(({_BOX[1]} - ay) / dy, ({_BOX[3]} - ay) / dy) else 1 end) as hi,
  (dx = 0 and (ax < {_BOX[0]} or ax > {_BOX[2]})) or (dy = 0 and (ay < {_BOX[1]} or ay > {_BOX[3]})) as outside from c)"""


@query(f"{_CLIP} select line, count(*) as parts, round(sum((hi - lo) * sqrt(dx * dx + dy * dy)), 6) as length from l where lo < hi and not outside group by line")
def clip_bbox(spark, d):
    c = polygons.clip_lines(_segments(spark, d), *_BOX)
    return c.groupBy("line").agg(F.count(F.lit(1)).alias("parts"), r(F.sum(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))), 6, "length"))


@query(f"""{_CLIP.replace("lead(lon) over w as bx,", "row_number() over w as n, lead(lon) over w as bx,").replace("select line, ax, ay, bx - ax", "select line, n, ax, ay, bx - ax")},
 i as (select *, lag(n) over w is distinct from n - 1 or lo > 0 as first from l where lo < hi and not outside window w as (partition by line order by n)),
 g as (select *, sum(case when first then 1 else 0 end) over (partition by line order by n) as part from i)
 select line, part::bigint as part, count(*) + 1 as points, round(arg_min(ax + lo * dx, n), 9) as x0, round(arg_min(ay + lo * dy, n), 9) as y0, round(arg_max(ax + hi * dx, n), 9) as x1, round(arg_max(ay + hi * dy, n), 9) as y1 from g group by line, part""")
def clip_parts(spark, d):
    """Ways cut to a box as lines: every part's number of vertices and its ends, in the way's direction."""
    w = Window.partitionBy("track").orderBy("t_s", "seq")
    x = plain(spark, d).select(F.col("track").alias("line"), F.row_number().over(w).alias("seg"), F.col("lon").alias("ax"), F.col("lat").alias("ay"), F.lead("lon").over(w).alias("bx"), F.lead("lat").over(w).alias("by"))
    v = polygons.clip_ways(x.filter("bx is not null"), *_BOX)
    end = lambda f, c, name: r(f(c, "pos"), 9, name)
    return v.groupBy("line", "part").agg(F.count(F.lit(1)).alias("points"), end(F.min_by, "x", "x0"), end(F.min_by, "y", "y0"), end(F.max_by, "x", "x1"), end(F.max_by, "y", "y1"))


@query(f"{P}, s as (select track, seq, lat, lon, lead(lon) over w as bx, lead(lat) over w as b_y, lag(lon) over w as ax, lag(lat) over w as ay from f window w as (partition by track order by t_s, seq)) select track, seq, (bx - ax) * (lat - ay) - (b_y - ay) * (lon - ax) > 1e-9 as land from s where ax is not null and bx is not null")
def land_side(spark, d):
    w = Window.partitionBy("track").orderBy("t_s", "seq")
    x = plain(spark, d).withColumns({"ax": F.lag("lon").over(w), "ay": F.lag("lat").over(w), "bx": F.lead("lon").over(w), "by": F.lead("lat").over(w)})
    _, cross = geo.to_segment("lon", "lat", "ax", "ay", "bx", "by")
    return x.filter("ax is not null and bx is not null").select("track", "seq", (cross > 1e-9).alias("land"))


_RING = f"""{P}, p as (select track, seq % 7 as ring, lon + 77 as x, lat - 26 as y, t_s, seq from f), q as (select *, lead(x) over w as u, lead(y) over w as v, first_value(x) over w as x0, first_value(y) over w as y0 from p window w as (partition by track, ring order by t_s, seq)),
 e as (select track, ring, x, y, coalesce(u, x0) as u, coalesce(v, y0) as v from q)"""


@query(f"{_RING} select track, ring, round(sum(x * v - u * y) / 2, 9) as area from e group by all")
def ring_area(spark, d):
    p = plain(spark, d).select("track", (F.col("seq") % 7).alias("ring"), "t_s", "seq", (F.col("lon") + 77).alias("x"), (F.col("lat") - 26).alias("y"))
    return polygons.ring_areas(p, ["track", "ring"], ["t_s", "seq"]).select("track", "ring", r("area", 9))


@query(f"{_RING} select track, ring, round(abs(sum(x * v - u * y) / 2), 9) as area from e group by all order by 3 desc, 1, 2 limit 5")
def top5_area(spark, d):
    return ring_area(spark, d).withColumn("area", F.abs("area")).orderBy(F.desc("area"), "track", "ring").limit(5)


@query()
def polygonize_faces(spark, d):
    """Faces of the lines between regions, on a frame."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    chord = n.select(F.col("k").alias("line"), F.lit(0.0).alias("ax"), (F.col("k") * 0.38 + 0.3).alias("ay"), F.lit(10.0).alias("bx"), ((F.col("k") * 7 % 25) * 0.38 + 0.5).alias("by"))
    frame = spark.createDataFrame([(100, 0.0, 0.0, 10.0, 0.0), (101, 10.0, 0.0, 10.0, 10.0), (102, 10.0, 10.0, 0.0, 10.0), (103, 0.0, 10.0, 0.0, 0.0)], "line long, ax double, ay double, bx double, by double")
    segs = chord.unionByName(frame).withColumn("seg", F.col("line"))
    half = polygons.faces(polygons.split_at_crossings(segs, 2.0))
    return polygons.face_table(half, F.col("line") < 100).select(r("area", 6), r("cx", 5), r("cy", 5), "land")


# An island a track on a lattice, boxes of whole units; with 2.4 units around it, neighbours merge or not. No lattice
# distance lies between the radius of a round join's inner circle and 2.4, so plain distances tell the same points.
_SHOAL = 2.4
_ISLES = """with i as (select distinct user_id as track from events), b as (select track, track % 50 * 7 + track * 3 % 5 as x0, track // 50 * 7 + track * 11 % 4 as y0, 1 + track % 4 as w, 1 + track * 7 % 3 as h from i),
 g as (select track, track % 50 * 7 + dx as px, track // 50 * 7 + dy as py from i, unnest(range(7)) a(dx), unnest(range(7)) c(dy))"""


def _isles(spark, d):
    t = table(spark, d, "events").select(F.col("user_id").alias("track")).distinct()
    x0, y0 = F.expr("track % 50 * 7 + track * 3 % 5"), F.expr("track div 50 * 7 + track * 11 % 4")
    x1, y1 = x0 + F.expr("1 + track % 4"), y0 + F.expr("1 + track * 7 % 3")
    corners = F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])
    v = t.select("track", F.posexplode(corners).alias("place", "v"))
    return t, v.select(F.col("track").alias("ring"), "place", F.col("v.x").alias("ax"), F.col("v.y").alias("ay"))


@query(f"""{_ISLES}, near as (select g.track, px, py, min(power(greatest(x0 - px, 0, px - x0 - w), 2) + power(greatest(y0 - py, 0, py - y0 - h), 2)) as d2 from g join i on true join b on b.track = i.track
  where i.track // 50 between g.track // 50 - 2 and g.track // 50 + 2 and i.track % 50 between g.track % 50 - 2 and g.track % 50 + 2 group by all)
 select track, px, py, d2 < {_SHOAL * _SHOAL} as inside from near""")
def shoal_cover(spark, d):
    """Which lattice points the shallows around the islands cover: islands widened, merged, and asked point by point."""
    t, isles = _isles(spark, d)
    shoal = buffer.buffered(isles, _SHOAL, 7.0)
    side = F.sequence(F.lit(0), F.lit(6))
    g = t.select("track", F.expr("track % 50 * 7").alias("x"), F.expr("track div 50 * 7").alias("y")).withColumn("dx", F.explode(side)).withColumn("dy", F.explode(side))
    p = g.select(F.struct("track", "dx", "dy").alias("id"), (F.col("x") + F.col("dx")).cast("double").alias("x"), (F.col("y") + F.col("dy")).cast("double").alias("y"))
    return buffer.covered(p, shoal, 7.0).select("id.track", F.col("x").cast("long").alias("px"), F.col("y").cast("long").alias("py"), "inside")


# sets, orders


@query(f"{P} select track, seq, 'north' as leg from f where lat > 26.45 union all select track, seq, 'east' from f where lon > -77.08")
def union_legs(spark, d):
    """Two legs that share the fixes north-east of a point."""
    x = plain(spark, d)
    return x.filter("lat > 26.45").select("track", "seq", F.lit("north").alias("leg")).unionByName(x.filter("lon > -77.08").select("track", "seq", F.lit("east").alias("leg")))


@query(f"{P} select distinct track from f where track not in (select track from f where lat > 26.69)")
def anti_unseen(spark, d):
    x = plain(spark, d)
    return x.select("track").distinct().join(x.filter("lat > 26.69").select("track").distinct(), "track", "left_anti")


@query(f"{P} select track, seq from f where track in (select user_id from events where event_type = 'error')")
def semi_allowed(spark, d):
    e = table(spark, d, "events").filter("event_type = 'error'").select(F.col("user_id").alias("track")).distinct()
    return plain(spark, d).join(e, "track", "left_semi").select("track", "seq")


@query(f"{P} select track, seq, row_number() over (partition by track order by round(lat, 2), round(lon, 2), seq) as place from f")
def sort_tiebreak(spark, d):
    w = Window.partitionBy("track").orderBy(F.round("lat", 2), F.round("lon", 2), "seq")
    return plain(spark, d).select("track", "seq", F.row_number().over(w).cast("long").alias("place"))


@query(f"with f as ({DENSE_SQL}), b as (select floor(lat / 0.005)::bigint as band, track, avg(lon) as lon from f group by all) select a.band, a.track as one, b.track as other from b a join b on a.band = b.band and a.track < b.track and abs(a.lon - b.lon) * {geo.K0} * 111000 < 250")
def shared_bands(spark, d):
    """Pairs of tracks within 250 m of each other in a band of latitude, met through cells of longitude."""
    width = 250 / (geo.K0 * geo.M_PER_DEG)
    b = dense(spark, d).groupBy(F.floor(F.col("lat") / 0.005).alias("band"), "track").agg(F.avg("lon").alias("lon"))
    cell = F.floor(F.col("lon") / width)
    o = b.select("band", F.col("track").alias("other"), F.col("lon").alias("olon"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    near = b.withColumn("cell", cell).join(o, ["band", "cell"]).filter((F.col("track") < F.col("other")) & (F.abs(F.col("lon") - F.col("olon")) * geo.K0 * geo.M_PER_DEG < 250))
    return near.select("band", F.col("track").alias("one"), "other")


# photos: positions with a local time as text


def _photos(spark, d):
    x = with_time(plain(spark, d))
    taken = F.date_format(clock.local(F.timestamp_seconds(F.floor("t_s"))), "yyyy:MM:dd HH:mm:ss")
    return x.select("track", F.col("seq").alias("photo"), taken.alias("taken"), (F.col("lat") + 5e-5).alias("plat"), F.col("lon").alias("plon"))


_PHOTOS = "p as (select track, seq as photo, strftime(make_timestamp((floor(t_s)*1000000)::bigint) - interval 4 hour, '%Y:%m:%d %H:%M:%S') as taken, floor(t_s)::bigint as t_s, lat + 5e-5 as plat, lon as plon from f)"


@query(f"{P}, {_PHOTOS} select photo, taken, t_s from p")
def exif_time(spark, d):
    return _photos(spark, d).select("photo", "taken", F.unix_timestamp(clock.from_exif(F.col("taken"))).alias("t_s"))


@query(f"""{P}, {_PHOTOS}, c as (select p.track, photo, abs(f.t_s - p.t_s) as dt, {hav_sql('plat', 'plon', 'lat', 'lon')} as dist, row_number() over (partition by photo order by abs(f.t_s - p.t_s), f.t_s, seq) as k from p join f using (track)),
 m as (select track, round(dist, 6) as dist from c where k = 1 and dt <= 90), z as (select track, list_sort(list(dist)) as a from m group by track), n as (select track, count(*) as located from p group by track)
 select track, located, coalesce(len(a), 0)::bigint as matched, a[len(a) // 2 + 1] as median, a[cast(floor(len(a) * 0.9) as int) + 1] as p90 from n left join z using (track)""")
def photo_match(spark, d):
    """Photos matched to fixes within 90 s: located and matched counts, and how far apart they are."""
    p = _photos(spark, d).withColumn("t_s", F.unix_timestamp(clock.from_exif(F.col("taken"))).cast("double"))
    m = match.asof_nearest(p, plain(spark, d), "t_s", 90, "track", ["seq", "lat", "lon"], "seq")
    q = match.nearest_rank(m, F.round(geo.haversine("plat", "plon", "fix.lat", "fix.lon"), 6), ["track"])
    n = p.groupBy("track").agg(F.count(F.lit(1)).alias("located"))
    return n.join(q, "track", "left").select("track", "located", F.coalesce("n", F.lit(0)).cast("long").alias("matched"), "median", "p90")


def _photos_offshore(spark, d):
    return geo.with_offshore_km(_photos(spark, d), "plon", F.col("plat") - 5e-5).filter(F.col("km") > geo.OFFSHORE_KM)


@query(f"{_OFF}, {_PHOTOS} select p.track, row_number() over (partition by p.track order by taken, photo) as place, photo, taken, round(km, 6) as km from p join o on o.seq = p.photo where km > 0.5")
def photo_offshore(spark, d):
    """Every photo taken offshore, with its place among its track's."""
    w = Window.partitionBy("track").orderBy("taken", "photo")
    return _photos_offshore(spark, d).select("track", F.row_number().over(w).cast("long").alias("place"), "photo", "taken", r("km"))


@query(f"{_OFF}, {_PHOTOS} select photo, taken, round(km, 6) as km from p join o on o.seq = p.photo where km > 0.5 order by taken, photo")
def photo_offshore_all(spark, d):
    """Every photo taken offshore, in order of time and id; the sort is by ranges, so no task holds them all."""
    return _photos_offshore(spark, d).select("photo", "taken", r("km")).orderBy("taken", "photo")


@query(f"""{P}, p as (select track, seq as photo, floor(t_s)::bigint + seq % 181 as t_s, case when quality <> 2 then lat + 5e-5 end as plat, case when quality <> 2 then lon end as plon from f),
 c as (select photo, plat, plon, f.lat, f.lon, abs(f.t_s - p.t_s) as dt, row_number() over (partition by photo order by abs(f.t_s - p.t_s), f.t_s, seq) as k from p join f using (track))
 select photo, case when plat is not null then 'own' when dt <= 90 then 'track' end as placed, round(case when plat is not null then plat when dt <= 90 then lat end, 6) as lat, round(case when plat is not null then plon when dt <= 90 then lon end, 6) as lon from c where k = 1""")
def photo_placed(spark, d):
    """Photos of cameras with and without a receiver: the latter are placed by their time on the track."""
    x = with_time(plain(spark, d))
    own = lambda c: F.when(F.col("quality") != 2, c)
    p = x.select("track", F.col("seq").alias("photo"), (F.floor("t_s") + F.col("seq") % 181).cast("double").alias("t_s"), own(F.col("lat") + 5e-5).alias("plat"), own(F.col("lon")).alias("plon"))
    return match.placed_by_time(p, plain(spark, d), "t_s", 90, "track", "seq", "plat", "plon").select("photo", "placed", r("lat"), r("lon"))


# the same on a stream


@query(f"{CLEAN} select track, round(t, 3)::double as t, round(step_m, 3) as step_m, kept from s where accepted")
def stream_clean(spark, d):
    """The spike filter and thinning as a streaming job over files of fixes, run until it has caught up."""
    folder = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    good = quality.keep_good(dense(spark, d)).select("track", F.col("t_s").cast("double").alias("t_s"), "lat", "lon", "sog_kn")
    good.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(good.schema).parquet(f"{folder}/in")
    job = live.accepted(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("track", r("t", 3), r("step_m", 3), "kept")


#: Rows of a file that a replayed stream reads.
_FILE_ROWS = 500_000


def _replayed(spark, rows, time: str, last, parts: int = 3, file_rows: int = _FILE_ROWS):
    """``rows`` as a stream of files in order of ``time``, a part a micro-batch; ``last`` is a later row that lets watermarks pass the others.

    Rows are made once, by all tasks. Every part has as many files, so that this number of files is a micro-batch: a part that is
    written as fewer has empty ones added.
    """
    folder = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = written(rows)
    cuts = rows.select(F.unix_micros(time).alias("t")).agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count(F.lit(1)).alias("n")).first()
    part = F.least(F.floor((F.unix_micros(time) - F.lit(cuts["a"])) / F.lit(max(1, (cuts["b"] or 0) - (cuts["a"] or 0))) * parts), F.lit(parts - 1))
    files = cuts["n"] // (parts * file_rows) + 1
    for k in range(parts):
        at = f"{folder}/in/part-{k}"
        rows.filter(part == k).coalesce(files).write.parquet(at)
        for _ in range(files - len(spark.read.parquet(at).inputFiles())):
            spark.createDataFrame([], rows.schema).coalesce(1).write.mode("append").parquet(at)
    after = F.timestamp_micros(F.lit((cuts["b"] or 0) + 3 * 86_400_000_000))
    for k in range(2):
        last(after).crossJoin(spark.range(files)).repartitionById(files, F.col("id").cast("int")).drop("id").write.parquet(f"{folder}/in/part-{parts + k}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).parquet(f"{folder}/in"), folder


def _run(spark, stream, folder: str):
    """Runs a stream until it has caught up and reads what it wrote."""
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query(f"""{P}, x as (select track::varchar as file, seq, floor(t_s)::bigint as t, case when seq % 10 = 0 then 6 else quality end as q, sats, hdop from f)
 select file as track, t, arg_max(q, seq) as quality, arg_max(sats, seq) as sats, round(arg_max(printf('%.2f', hdop)::double, seq), 2) as hdop from x group by all""")
def stream_nmea_join(spark, d):
    """Position and quality sentences as two streams, joined by file and second; files replayed in order of time."""
    lines = _sentences(spark, d, "when").withColumnRenamed("when", "received")
    marks = ["GPRMC,{}.000,A,2600.0000,N,07700.0000,W,1.00,,{},,", "GPGGA,{}.000,2600.0000,N,07700.0000,W,1,08,1.00,3.0,M,,M,,"]

    def last(after):
        body = F.array(*[F.format_string(m.replace("{}", "%s"), F.date_format(after, "HHmmss"), F.date_format(after, "ddMMyy")) for m in marks])
        x = spark.range(1).select(after.alias("received"), F.explode(body).alias("b"))
        return x.select("received", F.lit("end").alias("file"), F.lit(0).cast("long").alias("pos"), F.concat(F.lit("$"), "b", F.lit("*"), F.lpad(F.hex(nmea.checksum(F.col("b")).cast("long")), 2, "0")).alias("line")).coalesce(1)

    stream, folder = _replayed(spark, lines, "received", last)
    out = _run(spark, sentences.join_quality(sentences.positions(stream), sentences.qualities(stream)), folder)
    return out.filter("track != 'end'").select("track", F.unix_timestamp("ts").alias("t"), "quality", "sats", r("hdop", 2))


@query(ORACLE["stops"])
def stream_stops(spark, d):
    """Stops of a stream of fixes, replayed in order of time; a timer closes what is silent."""
    good = with_time(quality.keep_good(dense(spark, d))).select("track", "ts", "lat", "lon")
    last = lambda after: spark.range(1).select(F.lit(-1).cast("long").alias("track"), after.alias("ts"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon")).coalesce(1)
    stream, folder = _replayed(spark, good, "ts", last)
    store = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live_stops.STORE)
    try:
        x = _run(spark, live_stops.stops(stream), folder)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", store)
    return x.select("track", r("start_s", 3), r("end_s", 3), r("minutes"), "n", r("lat", 8), r("lon", 8))


# corroboration: a voyage is five tracks, each a day of it, against a tracker that reports day and night; all over the loaded points

_DAY_S = 86400
_VOYAGE = f"""{_LOADED}, pv as (select track // 5 as voyage, track, leg, t_s + {_DAY_S} * (track % 5) as t_s, lat, lon from pts),
 tk as (select track // 5 as voyage, track * 1000 + rn as probe, 1711195200 + {_DAY_S} * (track % 5) + 900 * rn + track % 61 as t_s, lat + 1e-4 as plat, lon as plon from f),
 wi as (select voyage, track, min(t_s) as start_s, max(t_s) as end_s from pv group by all),
 ni as (select * from (select voyage, row_number() over w as night, end_s, lead(start_s) over w as next_s from wi window w as (partition by voyage order by start_s, end_s)) where next_s is not null)"""


def _voyage(spark, d):
    """Loaded points of every day at its place in the voyage."""
    t = F.col("t_s") + _DAY_S * (F.col("track") % 5)
    return _loaded(spark, d)[0].select(F.expr("track div 5").alias("voyage"), "track", "leg", t.alias("t_s"), "lat", "lon")


def _reports(spark, d):
    """A tracker's positions, every quarter of an hour and over all of the night."""
    t = F.lit(1711195200) + _DAY_S * (F.col("track") % 5) + 900 * F.col("rn") + F.col("track") % 61
    return dense(spark, d).select(F.expr("track div 5").alias("voyage"), (F.col("track") * 1000 + F.col("rn")).alias("probe"), t.alias("t_s"), (F.col("lat") + 1e-4).alias("plat"), F.col("lon").alias("plon"))


@query(f"{_VOYAGE} select voyage, track, start_s, end_s, round((end_s - start_s) / 3600, 6) as hours from wi")
def corroborate_windows(spark, d):
    """How long each day's recording ran."""
    x = days.windows(_voyage(spark, d), ["voyage", "track"])
    return x.select("voyage", "track", "start_s", "end_s", r((F.col("end_s") - F.col("start_s")) / 3600, 6, "hours"))


def _night_table(x, keys, lat="lat", lon="lon"):
    """fixes, path_m, net_m, blind_h and moved of windows (end_s, next_s) joined to their points."""
    w = Window.partitionBy(*keys).orderBy("t_s")
    x = x.withColumns({"step": geo.haversine(F.lag(lat).over(w), F.lag(lon).over(w), lat, lon), "ahead": F.coalesce(F.lead("t_s").over(w), F.col("next_s")) - F.col("t_s")})
    first, last = lambda c: F.min_by(c, "t_s"), lambda c: F.max_by(c, "t_s")
    g = x.groupBy(*keys).agg(
        F.count("t_s").alias("fixes"), r(F.coalesce(F.sum("step"), F.lit(0.0)), 3, "path_m"), F.coalesce(geo.haversine(first(lat), first(lon), last(lat), last(lon)), F.lit(0.0)).alias("net"),
        (F.greatest(F.coalesce(F.max("ahead"), F.lit(0)), F.coalesce(F.min("t_s"), F.first("next_s")) - F.first("end_s")) / F.lit(3600.0)).alias("blind_h"),
    )
    return g.select(*keys, "fixes", "path_m", r("net", 3, "net_m"), "blind_h", (F.col("net") > 300).alias("moved"))


_NET = hav_sql("arg_min(plat, t_s)", "arg_min(plon, t_s)", "arg_max(plat, t_s)", "arg_max(plon, t_s)")


@query(f"""{_VOYAGE}, j as (select ni.*, tk.t_s, plat, plon from ni left join tk on tk.voyage = ni.voyage and tk.t_s > end_s and tk.t_s < next_s),
 k2 as (select *, {hav_sql('lag(plat) over q', 'lag(plon) over q', 'plat', 'plon')} as step, coalesce(lead(t_s) over q, next_s) - t_s as ahead from j window q as (partition by voyage, night order by t_s))
 select voyage, night, count(t_s) as fixes, round(coalesce(sum(step), 0), 3) as path_m, round(coalesce({_NET}, 0), 3) as net_m, greatest(coalesce(max(ahead), 0), coalesce(min(t_s), any_value(next_s)) - any_value(end_s)) / 3600e0 as blind_h,
  coalesce({_NET}, 0) > 300 as moved from k2 group by voyage, night""")
def corroborate_nights(spark, d):
    """What the tracker saw between one day's recording and the next."""
    spans = days.nights(days.windows(_voyage(spark, d), ["voyage", "track"]), "voyage")
    seen = _reports(spark, d).select("voyage", "t_s", F.col("plat").alias("lat"), F.col("plon").alias("lon"))
    x = match.in_interval(spans, seen, "end_s", "next_s", "t_s", "voyage", False, 3600.0)
    return _night_table(x.select("voyage", "night", "end_s", "next_s", "point.t_s", "point.lat", "point.lon"), ["voyage", "night"])


_RANKED = "select voyage, len(a) as n, a[len(a) // 2 + 1] as median, a[cast(floor(len(a) * 0.9) as int) + 1] as p90, a[-1] as max from z"


@query(f"""{_VOYAGE}, c2 as (select tk.voyage, probe, abs(pv.t_s - tk.t_s) as dt, {hav_sql('plat', 'plon', 'lat', 'lon')} as dist, row_number() over (partition by tk.voyage, probe order by abs(pv.t_s - tk.t_s), pv.t_s) as k2 from tk join pv using (voyage)),
 z as (select voyage, list_sort(list(round(dist, 6))) as a from c2 where k2 = 1 and dt <= 60 group by voyage) {_RANKED}""")
def corroborate_moment(spark, d):
    """How far the two recordings are apart at the same moment, within a minute."""
    m = match.asof_nearest(_reports(spark, d), _voyage(spark, d), "t_s", 60, "voyage", ["lat", "lon"], "t_s")
    return match.nearest_rank(m.withColumn("dist", geo.haversine("plat", "plon", "fix.lat", "fix.lon")), F.round("dist", 6), ["voyage"])


@query(f"""{_VOYAGE}, t2 as (select voyage, lat as ay, lon * {geo.K0} as ax, lead(lat) over w2 as b_y, lead(lon) over w2 * {geo.K0} as bx from pv window w2 as (partition by voyage order by t_s)),
 c2 as (select tk.voyage, probe, plon * {geo.K0} as px, plat as py, t2.* exclude (voyage), case when bx = ax and b_y = ay then 0 else greatest(0, least(1, ((plon * {geo.K0} - ax) * (bx - ax) + (plat - ay) * (b_y - ay)) / ((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)))) end as u2 from tk join t2 using (voyage) where bx is not null),
 m2 as (select voyage, probe, min(sqrt(power(px - ax - u2 * (bx - ax), 2) + power(py - ay - u2 * (b_y - ay), 2))) * 111000 as dist from c2 group by all),
 z as (select voyage, list_sort(list(round(dist, 4))) as a, count(*) filter (where dist < 50) as within from m2 group by voyage) {_RANKED.replace('select voyage,', 'select voyage, within,')}""")
def corroborate_path(spark, d):
    """How far the tracker's positions are from the one line through all days' points, whatever their times."""
    pts = _voyage(spark, d).select("voyage", "t_s", (F.col("lon") * geo.K0).alias("x"), F.col("lat").alias("y"))
    probes = _reports(spark, d).select("voyage", F.struct("voyage", "probe").alias("id"), (F.col("plon") * geo.K0).alias("x"), F.col("plat").alias("y"))
    x = match.nearest_segment(probes, match.segments(pts, "voyage", ["t_s"]), "voyage", "id", 0.005, with_seg=False).select("id.voyage", (F.col("dist") * geo.M_PER_DEG).alias("dist"))
    near = x.groupBy("voyage").agg(F.count_if(F.col("dist") < 50).alias("within"))
    return match.nearest_rank(x, F.round("dist", 4), ["voyage"]).join(near, "voyage").select("voyage", "within", "n", "median", "p90", "max")


_BEYOND = f"""bs as (select i, ax * {geo.K0} as ax, ay, bx * {geo.K0} as bx, b_y from (values {_SEGS}) v(i, ax, ay, bx, b_y)),
 cs as (select voyage, track, t_s, lon * {geo.K0} as px, lat as py, bs.*, greatest(0, least(1, ((lon * {geo.K0} - ax) * (bx - ax) + (lat - ay) * (b_y - ay)) / ((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)))) as u2 from pv, bs where leg = 'afloat'),
 es as (select voyage, track, t_s, i, power(px - (ax + u2 * (bx - ax)), 2) + power(py - (ay + u2 * (b_y - ay)), 2) as d2, (bx - ax) * (py - ay) - (b_y - ay) * (px - ax) as cr from cs),
 os as (select voyage, track, t_s, case when cr > 0 then 1 else -1 end * sqrt(d2) * 111.0 as km from (select *, row_number() over (partition by track, t_s order by d2, i) as k2 from es) where k2 = 1),
 xs as (select voyage, track, min(t_s) as a, max(t_s) as b, max(km) as km from os where km > 0.5 group by all)"""


@query(f"{_VOYAGE}, {_BEYOND} select xs.voyage, track, a as first_s, b as last_s, round(km, 6) as max_km, count(tk.probe) as seen from xs left join tk on tk.voyage = xs.voyage and tk.t_s >= a and tk.t_s <= b group by all")
def corroborate_offshore(spark, d):
    """Days that went beyond the barrier: from when to when, how far, and how many of the tracker's positions fall into that span."""
    out = geo.with_offshore_km(_voyage(spark, d).filter("leg = 'afloat'")).filter(F.col("km") > geo.OFFSHORE_KM)
    spans = out.groupBy("voyage", "track").agg(F.min("t_s").alias("first_s"), F.max("t_s").alias("last_s"), r(F.max("km"), 6, "max_km"))
    x = match.in_interval(spans, _reports(spark, d).select("voyage", "t_s", "probe"), "first_s", "last_s", "t_s", "voyage", True, 86400.0)
    return x.groupBy("voyage", "track", "first_s", "last_s", "max_km").agg(F.count("point.probe").alias("seen"))


@query(f"""{_VOYAGE}, ph as (select voyage, track, t_s + track % 97 as t_s, lat + 5e-5 as plat, lon as plon from pv where leg <> 'road'),
 c2 as (select ph.voyage, ph.track, ph.t_s as at, abs(pv.t_s - ph.t_s) as dt, {hav_sql('plat', 'plon', 'pv.lat', 'pv.lon')} as dist, row_number() over (partition by ph.voyage, ph.track, ph.t_s order by abs(pv.t_s - ph.t_s), pv.t_s) as k2 from ph join pv using (voyage)),
 z as (select voyage, list_sort(list(round(dist, 6))) as a from c2 where k2 = 1 and dt <= 90 group by voyage), lo as (select voyage, count(*) as located from ph group by voyage)
 select voyage, located, coalesce(len(a), 0)::bigint as matched, a[len(a) // 2 + 1] as median, a[cast(floor(len(a) * 0.9) as int) + 1] as p90 from lo left join z using (voyage)""")
def corroborate_photos(spark, d):
    """Photos of every voyage against its loaded points, within ninety seconds."""
    v = _voyage(spark, d)
    p = v.filter("leg != 'road'").select("voyage", "track", (F.col("t_s") + F.col("track") % 97).alias("t_s"), (F.col("lat") + 5e-5).alias("plat"), F.col("lon").alias("plon"))
    m = match.asof_nearest(p, v, "t_s", 90, "voyage", ["lat", "lon"], "t_s")
    q = match.nearest_rank(m, F.round(geo.haversine("plat", "plon", "fix.lat", "fix.lon"), 6), ["voyage"])
    n = p.groupBy("voyage").agg(F.count(F.lit(1)).alias("located"))
    return n.join(q, "voyage", "left").select("voyage", "located", F.coalesce("n", F.lit(0)).cast("long").alias("matched"), "median", "p90")


# files: written to the shared folder and read back


@query(f"""with f as ({DENSE_SQL}), s as (select track, t_s + 300 * (rn // 4) as t_s, lat, lon from f), p as (select track, t_s, round(lat, 6) as lat, round(lon, 6) as lon, t_s - lag(t_s) over (partition by track order by t_s) as gap from s)
 select track::varchar as session, count(*) as points, count(gap) as gaps, count(*) filter (where gap / 60e0 > 9.5 and gap / 60e0 < 10.5) as ten_minutes, round(max(gap) / 60e0, 6) as longest_min, round(min(lat), 6) as south, round(max(lat), 6) as north from p group by track""")
def gpx_cadence(spark, d):
    """Tracker files, long tracks in pieces of bounded size: points, gaps, gaps of about ten minutes (every fourth is one)."""
    folder = f"{ensure_checkpoint_dir(spark)}/gpx-{uuid.uuid4().hex}"
    p = with_time(dense(spark, d).withColumn("t_s", F.expr("t_s + 300 * (rn div 4)")))
    tracks.write_gpx(p, folder)
    g = tracks.read_gpx(spark, folder).withColumn("t", F.unix_timestamp("ts"))
    g = g.withColumn("gap", (F.col("t") - F.lag("t").over(Window.partitionBy("session").orderBy("t", "lat", "lon"))) / F.lit(60.0))
    return g.groupBy("session").agg(
        F.count(F.lit(1)).alias("points"), F.count("gap").alias("gaps"), F.count_if((F.col("gap") > 9.5) & (F.col("gap") < 10.5)).alias("ten_minutes"), r(F.max("gap"), 6, "longest_min"), r(F.min("lat"), 6, "south"), r(F.max("lat"), 6, "north")
    )


@query(f"""{P} select 't' || track as track, floor(t_s)::bigint as t, printf('%.6f', lat)::double as lat, printf('%.6f', lon)::double as lon, printf('%.2f', sog_kn)::double as sog_kn, quality::int as quality, sats::int as sats, printf('%.1f', hdop)::double as hdop
 from f where printf('%.1f', hdop)::double <= 4.0""")
def track_csv(spark, d):
    """Track files in their fixed decimals, filtered on what was written."""
    folder = f"{ensure_checkpoint_dir(spark)}/tracks-{uuid.uuid4().hex}"
    x = with_time(plain(spark, d)).withColumns({"track": F.concat(F.lit("t"), F.col("track").cast("string")), "cog_deg": F.lit(None).cast("double")})
    tracks.write_tracks(x, folder)
    y = tracks.read_tracks(spark, folder).filter(F.col("hdop") <= quality.MAX_HDOP)
    return y.select("track", F.unix_timestamp("ts").alias("t"), "lat", "lon", "sog_kn", "quality", "sats", "hdop")


@query(_edges_sql("k % 7 <> 0").replace("w as (select *,", "w0 as (select *,") + " select count(*) as edges, round(sum(w), 3) as metres from w0")
def osm_json(spark, d):
    """Map ways written as one JSON document a way and read back with an explicit schema."""
    folder = f"{ensure_checkpoint_dir(spark)}/ways-{uuid.uuid4().hex}"
    w = _ways(spark, d)
    e = F.struct(F.col("way_id").alias("id"), F.lit("way").alias("type"), F.col("points").alias("geometry"), "tags")
    w.select(F.to_json(F.struct(F.array(e).alias("elements")))).repartition(4).write.text(folder)
    return graph.edges(tracks.read_ways(spark, folder, multi_line=False)).agg(F.count(F.lit(1)).alias("edges"), r(F.sum("w"), 3, "metres"))
