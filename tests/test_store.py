"""The result store, and drawings on a grid."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wakeline.operators import offset, raster
from wakeline.store import stored


def test_made_once_and_again_when_inputs_change(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/in")
    made = []

    def make():
        made.append(1)
        return spark.read.parquet(f"{tmp_path}/in")

    run = lambda **a: sorted(r.id for r in stored(spark, f"{tmp_path}/out", "copy", a, [f"{tmp_path}/in"], make).collect())
    assert run(box=1) == [0, 1, 2] and run(box=1) == [0, 1, 2] and len(made) == 1
    assert run(box=2) == [0, 1, 2] and len(made) == 2
    spark.range(5).write.mode("overwrite").parquet(f"{tmp_path}/in")
    assert run(box=1) == [0, 1, 2, 3, 4] and len(made) == 3 and run(box=1) == [0, 1, 2, 3, 4] and len(made) == 3
    kept = [p for p in (tmp_path / "out" / "copy").iterdir() for _ in p.iterdir() if not _.name.startswith(".")]
    assert len(kept) == 2  # one version for each of the two sets of arguments


def test_a_failed_run_is_made_again(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/in")

    def fail():
        return spark.sql("select raise_error('no') as id")

    with pytest.raises(Exception, match="no"):
        stored(spark, f"{tmp_path}/out", "copy", {}, [f"{tmp_path}/in"], fail)
    assert stored(spark, f"{tmp_path}/out", "copy", {}, [f"{tmp_path}/in"], lambda: spark.range(2)).count() == 2


def test_cells_of_lines(spark):
    """Every cell that holds a point of a line, against many points along it."""
    rng = random.Random(2)
    lines = {k: [(rng.uniform(-3, 3), rng.uniform(-3, 3)) for _ in range(4)] for k in range(20)}
    lines[20] = [(0.5, 0.5), (0.5, 3.5), (2.5, 3.5), (2.5, 3.5)]
    rows = [(k, i, float(x), float(y)) for k, p in lines.items() for i, (x, y) in enumerate(p)]
    p = spark.createDataFrame(rows, "k int, i int, x double, y double")
    got = {(r.k, r.cx, r.cy) for r in raster.cells(raster.segments(p, ["k"], "i", "x", "y"), ["k"], 1.0).collect()}
    seen = set()
    for k, p in lines.items():
        for a, b in zip(p, p[1:]):
            for t in range(4001):
                seen.add((k, math.floor(a[0] + (b[0] - a[0]) * t / 4000), math.floor(a[1] + (b[1] - a[1]) * t / 4000)))
    assert seen <= got and len(got - seen) <= 2  # steps may miss a cell that a line just cuts


def test_changes_stay_in_the_corridor(spark):
    """A track through the corridor in short steps: the drawing changes inside it and nowhere else."""
    rows = [(1, n, 26.40 + n * 1e-3, -77.05 + 0.004 * math.sin(n / 9)) for n in range(200)]
    p = spark.createDataFrame(rows, "track int, n int, lat double, lon double")
    q = offset.shifted(p, "track", "n", F.lit(-0.0015))
    drawn = [raster.cells(raster.segments(q, ["track"], "n", x, y), ["track"], 2e-4) for x, y in (("x", "y"), ("qx", "qy"))]
    changed = raster.difference(*drawn, ["track"], tile=1).collect()
    rows_ = [r.ty * 2e-4 for r in changed]
    assert changed and min(rows_) > 26.455 and max(rows_) < 26.535
    assert sum(r.added for r in changed) > 50 and raster.difference(drawn[0], drawn[0], ["track"]).count() == 0
