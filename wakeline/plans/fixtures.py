"""Tracks derived from the ``events`` table, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.session import table

_K = "cast(regexp_extract(props,'([0-9]+)',1) as int) as k"
_COLS = """value/10e0 as sog_kn, case when k%25=0 then 6 when k%7=0 then 2 else 1 end as quality, 3+k%10 as sats, (7+k%40)/10e0 as hdop"""
_PLAIN = f"""select track, seq, t_s, lat, lon, sog_kn, quality, sats, hdop from (
  select user_id as track, event_id as seq, {{epoch}} as t_s,
    case when event_type in ('click','view') then 26.30e0+(user_id%40)*1e-2+(event_id%5)*1e-4 else 26.30e0+((event_id*7919)%1000)*4e-4 end as lat,
    case when event_type in ('click','view') then -77.18e0+(user_id%27)*1e-2+(k%3)*1e-4 else -77.18e0+((event_id*104729)%1000)*2.7e-4 end as lon, {_COLS}
  from (select *, {_K} from {{events}}) e) f"""
_DENSE = f"""select track, rn, t_s, lat, lon, sog_kn, quality, sats, hdop, event_type from (
  select track, rn, 1711195200 + 300*rn as t_s, event_type,
    case when event_type='purchase' and rn%3<>0 then 26.30e0+((event_id*7919)%1000)*4e-4 else 26.30e0+((track+(rn {{div}} 12))%40)*1e-2+(event_id%5)*1e-4 end as lat,
    case when event_type='purchase' and rn%3<>0 then -77.18e0+((event_id*104729)%1000)*2.7e-4 else -77.18e0+((track+(rn {{div}} 12))%27)*1e-2+(k%3)*1e-4 end as lon, {_COLS}
  from (select *, user_id as track, cast(row_number() over (partition by user_id order by ts,event_id) as bigint) as rn, {_K} from {{events}}) e) f"""

PLAIN_SQL = _PLAIN.format(events="events", epoch="epoch_us(ts)/1e6")
DENSE_SQL = _DENSE.format(events="events", div="//")
GOOD_SQL = "quality in (1,2,4,5) and sats >= 4 and hdop <= 4.0"


def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes with real times, hours apart."""
    return spark.sql(_PLAIN.format(events="{events}", epoch="unix_micros(cast(ts as timestamp))/1e6"), events=table(spark, sf_dir, "events"))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fix every five minutes, an anchorage an hour, with jumps: for every order-dependent operator."""
    return spark.sql(_DENSE.format(events="{events}", div="div"), events=table(spark, sf_dir, "events"))


def with_time(df: DataFrame) -> DataFrame:
    """Adds ``ts`` from ``t_s``."""
    return df.withColumn("ts", F.timestamp_micros(F.round(F.col("t_s") * 1_000_000).cast("long")))


def hav_sql(a: str, b: str, c: str, d: str) -> str:
    """Haversine metres in DuckDB SQL."""
    s, t = f"sin((radians({c})-radians({a}))/2)", f"sin(radians(({d})-({b}))/2)"
    return f"(2*6371000.0*asin(sqrt({s}*{s}+cos(radians({a}))*cos(radians({c}))*{t}*{t})))"
