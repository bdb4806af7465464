"""Times at fixed offsets from UTC, and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local(ts: Column, offset: str = "-04:00") -> Column:
    """Wall time at a fixed offset: never a zone with daylight saving."""
    return F.from_utc_timestamp(ts, offset)


def from_exif(text: Column, offset: str = "-04:00") -> Column:
    """``YYYY:MM:DD HH:MM:SS`` at a fixed offset to UTC; null where it is not that."""
    return F.to_utc_timestamp(F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss")), offset)


def iso(text: Column) -> Column:
    return F.to_timestamp(text, "yyyy-MM-dd'T'HH:mm:ssX")


def seconds(a: Column, b: Column) -> Column:
    """b - a in seconds, fractions kept."""
    return (F.unix_micros(b) - F.unix_micros(a)) / 1e6
