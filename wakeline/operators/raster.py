"""Lines on a grid of cells, and what changes between two drawings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wakeline.session import checkpoint

#: Columns of segments that one task lists when two drawings are compared.
STRIPS = 1 << 20


def segments(points: DataFrame, keys: list[str], order: str, x: str, y: str) -> DataFrame:
    """keys, ax, ay, bx, by: each point of a line with the next."""
    w = Window.partitionBy(*keys).orderBy(order)
    return points.select(*keys, F.col(x).alias("ax"), F.col(y).alias("ay"), F.lead(x).over(w).alias("bx"), F.lead(y).over(w).alias("by")).filter("bx is not null and by is not null and ax is not null and ay is not null")


def _column(v, cell: float):
    return F.floor(v / cell).cast("long")


def _rows(x: DataFrame, cell: float) -> DataFrame:
    """Adds _lo, _hi: the rows that the part of a segment inside column ``cx`` passes."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    left, right = F.greatest(F.least("ax", "bx"), F.col("cx") * cell), F.least(F.greatest("ax", "bx"), (F.col("cx") + 1) * cell)
    at = lambda v, end: F.when(dx == 0, F.col(end)).otherwise(F.col("ay") + (v - F.col("ax")) / dx * dy)
    x = x.withColumns({"_a": at(left, "ay"), "_b": at(right, "by")})
    return x.withColumns({"_lo": _column(F.least("_a", "_b"), cell), "_hi": _column(F.greatest("_a", "_b"), cell)})


def cells(segs: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """keys, cx, cy: every cell that a line passes, once. A segment is listed in proportion to its length.

    Column by column: the part of the segment inside a column of cells passes the rows between its two ends.
    """
    x = segs.withColumn("cx", F.explode(F.sequence(_column(F.least("ax", "bx"), cell), _column(F.greatest("ax", "bx"), cell))))
    return _rows(x, cell).withColumn("cy", F.explode(F.sequence("_lo", "_hi"))).select(*keys, "cx", "cy").distinct()


def difference(before: DataFrame, after: DataFrame, keys: list[str], tile: int = 64) -> DataFrame:
    """keys, tx, ty, removed, added: per tile of ``tile`` by ``tile`` cells, those of one drawing that the other lacks; tiles without a change are absent."""
    both = before.withColumn("_s", F.lit(1)).unionByName(after.withColumn("_s", F.lit(2))).groupBy(*keys, "cx", "cy").agg(F.sum("_s").alias("_s")).filter("_s != 3")
    return both.groupBy(*keys, F.floor(F.col("cx") / tile).alias("tx"), F.floor(F.col("cy") / tile).alias("ty")).agg(F.count_if(F.col("_s") == 1).alias("removed"), F.count_if(F.col("_s") == 2).alias("added"))


def drawn_difference(points: DataFrame, keys: list[str], order: str, before: tuple[str, str], after: tuple[str, str], cell: float, tile: int = 64) -> DataFrame:
    """``difference`` of the lines through two positions of the same points, without listing their cells.

    The cells of a column are bits of a word, so a segment gives one row a column and drawing. Segments are dealt by key and
    tile column, over as many tasks as their columns ask for (about ``STRIPS`` each), so a task's memory does not grow with the input.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    ends = [F.struct(F.col(x).alias("ax"), F.col(y).alias("ay"), F.lead(x).over(w).alias("bx"), F.lead(y).over(w).alias("by")) for x, y in (before, after)]
    segs = points.select(*keys, *[e.alias(n) for e, n in zip(ends, ("_1", "_2"), strict=True)])
    sides = F.array(*[F.struct(F.lit(s).alias("_s"), *[F.col(f"_{s}")[c].alias(c) for c in ("ax", "ay", "bx", "by")]) for s in (1, 2)])
    segs = checkpoint(segs.select(*keys, F.inline(sides)).filter("bx is not null and by is not null and ax is not null and ay is not null"))
    first, last = _column(F.least("ax", "bx"), cell), _column(F.greatest("ax", "bx"), cell)
    word = max(k for k in range(1, 65) if tile % k == 0)  # rows of a tile that one word holds
    listed = segs.agg(F.sum(last - first + 1 + F.ceil(F.abs(F.col("by") - F.col("ay")) / (cell * word)))).first()[0] or 0
    x = segs.withColumn("tx", F.explode(F.sequence(F.floor(first / tile), F.floor(last / tile))))
    x = x.repartition(int(listed // STRIPS) + 1, *keys, "tx")
    x = _rows(x.withColumn("cx", F.explode(F.sequence(F.greatest(first, F.col("tx") * tile), F.least(last, F.col("tx") * tile + (tile - 1))))), cell)
    x = x.withColumn("_w", F.explode(F.sequence(F.floor(F.col("_lo") / word), F.floor(F.col("_hi") / word))))
    low, high = F.greatest(F.col("_lo") - F.col("_w") * word, F.lit(0)).cast("int"), F.least(F.col("_hi") - F.col("_w") * word, F.lit(word - 1)).cast("int")
    x = x.withColumn("_bits", F.call_function("shiftleft", F.expr("-1L"), low).bitwiseAND(F.call_function("shiftrightunsigned", F.expr("-1L"), 63 - high)))
    drawn = lambda s: F.coalesce(F.bit_or(F.when(F.col("_s") == s, F.col("_bits"))), F.expr("0L"))
    x = x.groupBy(*keys, "tx", "cx", "_w").agg(drawn(1).alias("_1"), drawn(2).alias("_2")).filter("_1 != _2")
    only = lambda a, b: F.sum(F.bit_count(F.col(a).bitwiseAND(F.bitwise_not(b)))).alias
    return x.groupBy(*keys, "tx", F.floor(F.col("_w") / (tile // word)).alias("ty")).agg(only("_1", "_2")("removed"), only("_2", "_1")("added"))
