"""Embedding whitening by compensated covariance.

Vectors become whole numbers, so counts and sums are exact. Every task centres its rows in double-double
(a pair high + low), cuts them into slices of few bits by an error-free transformation, and multiplies slices
block by block: with so few bits a product summed over a block is exact in a double. These exact matrices
are added into double-double accumulators by two-sums, and the tasks' high and low parts are merged the same
way. The covariance's eigenvectors come from LAPACK's tridiagonal divide and conquer and are then refined
with products of the same kind, so that small eigenvalues beside large ones are right as well.

Distinct vectors are found by a grouped aggregate that combines before its shuffle, so a vector that a third
of all rows hold is one row of the fit list. The driver holds sums and matrices of the dimension only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.session import checkpoint

#: Components of a whitened vector, at most.
COMPONENTS = 4
#: An entry c stands for floor(SCALE * c).
SCALE = 256
#: Rows of a block, bits of a slice, slices of a number: products of slices summed over a block stay below 2^53.
BLOCK, BITS, SLICES = 1024, 21, 5
#: A component whose eigenvalue is below this share of the largest has no variance.
FLAT = 1e-24
#: Eigenvalues closer than this share of the largest are a cluster.
CLOSE = 2.0**-30


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b rounded, and what the rounding left out."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(high: np.ndarray, low: np.ndarray, more: np.ndarray, rest: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """The double-double (high, low) plus (more, rest)."""
    s, e = two_sum(high, more)
    return two_sum(s, e + (low + rest))


def slices(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """Matrices whose sum is high + low up to 2^-(BITS * SLICES) of a column's largest entry, each of BITS bits a column.

    Rounding to a multiple of a power of two and subtracting leave no error.
    """
    largest = np.abs(high).max(0, initial=0.0)
    unit = np.ldexp(1.0, np.where(largest > 0, np.frexp(largest)[1], 0) - (BITS - 1))
    out, rest, lower = [], high, low
    for _ in range(SLICES):
        part = np.rint(rest / unit) * unit
        out.append(part)
        rest, lower = two_sum(rest - part, lower)
        unit = unit * 2.0 ** -(BITS - 1)
    return out


def product(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """a^T b of double-doubles, as one; rows in blocks."""
    shape = a[0].shape[1], b[0].shape[1]
    high, low = np.zeros(shape), np.zeros(shape)
    for at in range(0, len(a[0]), BLOCK):
        left = slices(a[0][at : at + BLOCK], a[1][at : at + BLOCK])
        right = left if a is b else slices(b[0][at : at + BLOCK], b[1][at : at + BLOCK])
        for i in range(SLICES):
            for j in range(SLICES - i):
                high, low = add(high, low, left[i].T @ right[j])  # exact
    return high, low


def centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """x - sums / n as a double-double; the mean is rounded once, from the exact quotient, to twice a double's bits."""
    mean, rest = _quotients(sums, n)
    s, e = two_sum(x.astype(np.float64), -mean)
    return two_sum(s, e - rest)


def _quotients(sums: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    high = [s / n for s in sums]
    low = []
    for s, h in zip(sums, high, strict=True):
        a, b = h.as_integer_ratio()
        low.append((s * b - a * n) / (n * b))
    return np.array(high), np.array(low)


@dataclass
class Fit:
    """What the fit list says: its length, the exact sums, and unit eigenvectors by falling eigenvalue."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Rows of whitened components; none for a component without variance."""
        high, low = centred(x, self.n, self.sums)
        flat = self.values == 0.0
        out = (high @ self.vectors + low @ self.vectors) / np.sqrt(np.where(flat, 1.0, self.values))
        out[:, flat] = np.nan
        return out

    def deviation(self, x: np.ndarray) -> list[int]:
        """The exact sum over dimensions of (n x - S)^2, per row."""
        bound = self.n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max(map(abs, self.sums), default=0)
        if bound * bound * max(1, x.shape[1]) < 1 << 63:
            d = self.n * x - np.array(self.sums, np.int64)
            return (d * d).sum(1).tolist()
        return [sum((self.n * v - s) ** 2 for v, s in zip(r, self.sums, strict=True)) for r in x.tolist()]


def eigen(high: np.ndarray, low: np.ndarray, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the symmetric double-double matrix, by falling value.

    numpy's eigh reduces to tridiagonal form and divides and conquers. Every round then corrects the vectors from
    the residuals of orthogonality and of the diagonal form, taken in double-double; values that lie closer
    together than CLOSE of the largest are told apart by eigh of their own block, from which their mean is taken first.
    """
    own, one = (high, low), np.eye(len(high))
    none = np.zeros_like(one)
    x = np.linalg.eigh(high)[1][:, ::-1].copy(), none
    form = lambda: product(x, product(own, x))  # noqa: E731  the matrix is its own transpose
    for _ in range(rounds):
        gram = product(x, x)
        r, s = sum(add(one, none, -gram[0], -gram[1])), sum(form())
        values = np.diag(s) / (1.0 - np.diag(r))
        gap = values[None, :] - values[:, None]
        order = np.argsort(-values, kind="stable")
        label = np.empty(len(values), np.int64)
        label[order] = np.cumsum(np.concatenate([[0], -np.diff(values[order]) > CLOSE * np.abs(values).max(initial=0.0)]))[: len(values)]
        same = label[None, :] == label[:, None]
        e = np.where(same, r / 2, (s + values[None, :] * r) / np.where(same, 1.0, gap))
        x = add(*x, *product((x[0].T.copy(), x[1].T.copy()), (e, none)))
        if len(set(label.tolist())) < len(label):
            s, turn = form(), np.eye(len(values))
            for k in set(label.tolist()):
                at = np.flatnonzero(label == k)
                block = s[0][np.ix_(at, at)] - np.eye(len(at)) * s[0][at, at].mean() + s[1][np.ix_(at, at)]
                turn[np.ix_(at, at)] = np.linalg.eigh((block + block.T) / 2)[1][:, ::-1]
            x = product((x[0].T.copy(), x[1].T.copy()), (turn, none))
    values = np.diag(sum(form()))
    order = np.argsort(-values, kind="stable")
    return values[order], sum(x)[:, order]


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """_id and x (array<bigint>) of the rows that take part."""
    v = F.col("_v")
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v"))
    fine = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform(v, lambda c: F.floor(c.cast("double") * SCALE))
    return rows.filter(fine).select("_id", whole.alias("x"))


def _numbers(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(fit_list: DataFrame) -> list[int]:
    """Exact sums of each dimension: of the upper and the lower half of every number, so that no sum overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = lower = None
        for batch in filter(len, batches):
            x = _numbers(batch.column(0))
            a, b = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
            upper, lower = (a, b) if upper is None else (upper + a, lower + b)
        if upper is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper))), pa.array(upper), pa.array(lower)], names=["i", "a", "b"])

    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found = fit_list.select("x").mapInArrow(run, "i long, a long, b long").groupBy("i").agg(wide("a"), wide("b")).collect()  # one row a dimension
    return [(int(r["a"]) << 32) + int(r["b"]) for r in sorted(found, key=lambda r: r["i"])]


def _gram(rows: DataFrame, make, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sum over all rows of the outer products of ``make(x)``, a double-double, as one.

    Each task adds up its own blocks; their parts meet a line of the matrix at a time, one row a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros((width, width)), np.zeros((width, width))
        any_rows = False
        for batch in filter(len, batches):
            made = make(_numbers(batch.column(0)))
            high, low = add(high, low, *product(made, made))
            any_rows = True
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(list(high)), pa.array(list(low))], names=["i", "high", "low"])

    def merge(key: tuple, parts: pa.Table) -> pa.Table:
        high, low = np.zeros(width), np.zeros(width)
        for h, lo in zip(parts["high"].to_pylist(), parts["low"].to_pylist(), strict=True):
            high, low = add(high, low, np.array(h), np.array(lo))
        return pa.table({"i": pa.array([key[0].as_py()]), "high": pa.array([high]), "low": pa.array([low])})

    schema = "i long, high array<double>, low array<double>"
    lines = rows.select("x").mapInArrow(run, schema).groupBy("i").applyInArrow(merge, schema).collect()  # one row a dimension
    lines.sort(key=lambda r: r["i"])
    return np.array([r["high"] for r in lines]), np.array([r["low"] for r in lines])


def fit(fit_list: DataFrame, n: int, components: int = COMPONENTS) -> Fit:
    sums = _sums(fit_list)
    high, low = _gram(fit_list, lambda x: centred(x, n, sums), len(sums))
    # Scaled by a power of two, which leaves no error, and divided by n in double-double.
    scale = 2.0 ** -int(np.frexp(max(np.abs(high).max(initial=0.0), 1e-300))[1])
    values, vectors = eigen(high * scale, low * scale)
    k = min(components, len(sums))
    values = np.where(values > FLAT * values.max(initial=0.0), values, 0.0)
    trace = math.fsum([*np.diag(high) * scale, *np.diag(low) * scale])
    explained = values[:k] / trace if trace > 0 else np.zeros(k)
    return Fit(n, sums, vectors[:, :k], values[:k] / scale / n, explained)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """id, component (from 1), n, deviation (decimal), whitened, explained, identity_error of every row that takes part.

    Rows whose vector is null or holds null or non-finite entries take no part, nor do vectors of another than
    the commonest length, or of none. Entries beyond what a long holds are cut to it. Repeated rows are answered
    each for itself; null ids like any other. A component without variance (a flat or linearly dependent fit
    list) has whitened null and explains 0; identity_error leaves it out, and is null if no other is there. A
    deviation beyond 38 digits is null. Empty tables give no rows. Other columns take no part.
    """
    spark: SparkSession = vectors.sparkSession
    rows = valid(vectors, id_col, vector_col).filter(F.size("x") > 0)
    kinds = {"component": "int", "n": "long", "deviation": "decimal(38,0)", "whitened": "double", "explained": "double", "identity_error": "double"}
    schema = rows.select(F.col("_id").alias(id_col), *[F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()]).schema
    distinct = checkpoint(rows.select("x").distinct())
    sizes = distinct.groupBy(F.size("x").alias("d")).count()
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    dim = common["d"]
    fit_list, rows = distinct.filter(F.size("x") == dim), rows.filter(F.size("x") == dim)
    n = sizes.filter(F.col("d") == dim).first()["count"]
    found = fit(fit_list, n, components)
    k = found.vectors.shape[1]

    def whitened(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = np.nan_to_num(found.whiten(x))
        return w, np.zeros_like(w)

    # The whitened rows are centred by construction: the sums are exact and every vector is centred before it is projected.
    high, low = _gram(fit_list, whitened, k)
    live = ~np.isnan(found.whiten(np.zeros((1, dim), np.int64))[0])
    off = np.abs((high + low) / n - np.eye(k))[np.ix_(live, live)]
    error = float(off.max()) if off.size else None
    shared = spark.sparkContext.broadcast((found, error))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, error = shared.value
        for batch in filter(len, batches):
            x = _numbers(batch.column(1))
            m = len(x)
            far = [Decimal(d) if d < 10**38 else None for d in found.deviation(x)]
            w = found.whiten(x).ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, found.n)),
                    pa.array(far, pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(w, mask=np.isnan(w)),
                    pa.array(np.tile(found.explained, m)),
                    pa.array([error] * (m * k), pa.float64()),
                ],
                names=schema.names,
            )

    return rows.mapInArrow(run, schema)
