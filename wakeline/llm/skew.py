"""Joins whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.session import checkpoint

#: A key with more than one in SHARE of the rows is dealt over pieces of that size; so at most SHARE keys are,
#: over twice as many pieces together, which bounds what is broadcast and copied.
SHARE = 1000
#: Rows that one piece may always hold.
PIECE = 512


def hot_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ``_pieces`` of the keys with more than one in SHARE of ``rows``: at most SHARE of them, written.

    Counts are summed before the shuffle.
    """
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    n = checkpoint(n.filter(F.col("_rows") > PIECE))
    limit = max(PIECE, (n.agg(F.sum("_rows")).first()[0] or 0) / SHARE)
    return n.filter(F.col("_rows") > limit).select(*keys, F.ceil(F.col("_rows") / limit).alias("_pieces"))


def join_one(rows: DataFrame, other: DataFrame, keys: list[str], how: str = "inner", total: int | None = None) -> DataFrame:
    """``rows`` joined (inner or left) to ``other``, which holds each key at most once; null keys meet nothing.

    A hot key of ``rows`` is dealt over pieces by a hash of its other columns, so that a retry deals alike, and
    its one row of ``other`` is copied to each piece. ``other`` may bring the number of ``rows`` of each key
    as ``_rows``, and the caller their ``total``, where both are known; else they are counted first.
    """
    if total is None:
        hot = hot_keys(rows, keys)
        right = other.join(F.broadcast(hot), keys, "left")
    else:
        limit = max(PIECE, total / SHARE)
        right = other.withColumn("_pieces", F.when(F.col("_rows") > limit, F.ceil(F.col("_rows") / limit))).drop("_rows")
        hot = right.filter("_pieces is not null").select(*keys, "_pieces")
    many = F.coalesce("_pieces", F.lit(1))
    salt = F.xxhash64(*[F.col(c) for c in rows.columns if c not in keys], F.lit(7))
    left = rows.join(F.broadcast(hot), keys, "left").withColumn("_piece", F.pmod(salt, many)).drop("_pieces")
    right = right.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), many - 1))).drop("_pieces")
    return left.join(right, [*keys, "_piece"], how).drop("_piece")
