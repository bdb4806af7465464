"""Row filters of fixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the quality filter.
QUALITIES, MIN_SATS, MAX_HDOP = (1, 2, 4, 5), 4, 4.0


def good() -> Column:
    return F.coalesce(F.col("quality").isin(*QUALITIES) & (F.col("sats") >= MIN_SATS) & (F.col("hdop") <= MAX_HDOP), F.lit(False))


def in_region(below: float = 30.0) -> Column:
    return F.col("lat") < below


def keep_good(fixes: DataFrame) -> DataFrame:
    return fixes.filter(good())


def dropped(fixes: DataFrame, below: float = 30.0, key: str = "track") -> DataFrame:
    """Fixes and rejects per track among those in the region; what lies outside is not a reject."""
    return fixes.filter(in_region(below)).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(~good()).alias("dropped"))
