"""Approximate nearest neighbours by balanced posting lists.

Inner products become angles by one more coordinate that lifts all vectors to one length. Balanced
bisection of a bounded sample, moved twice to the means, gives centroids; every distinct vector is
posted to its nearest list and, near a boundary, to the next ones too. For a query the centroids are
walked as an in-memory neighbour graph, and the lists within a ratio of the nearest centroids' angle
are read, however many they are. Both ratios are fitted on the sample: the closure so that the copies
of boundary vectors stay within a budget, the pruning so that the sample's own neighbours are found.

Equal vectors collapse first: a class keeps its smallest ids, as many as an answer can use, so a
vector that a third of all rows share is one posting. Neighbouring lists make a bundle of bounded
size, a list beyond it is cut into parts, and the queries of a bundle into blocks; a query travels
once to each part it reads, and a part returns its best few as arrays, which are merged in one
sorted pass. The driver holds the sample, the centroids and one count per list and bundle, all
bounded by parameters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wakeline.llm.skew import join_one
from wakeline.session import checkpoint

K = 20
#: Numbers in the sample that lists are fitted on, at most: 131,072 vectors of 64. Those with the smallest hashes are taken.
SAMPLE_NUMBERS = 1 << 23
#: Distinct vectors for each list, and vectors of the sample for each list at least.
PER_LIST, LEAST_SAMPLE = 24, 8
#: Lists that hold one vector at most, and postings per vector that the closure ratio is fitted to.
COPIES, MEAN_COPIES = 3, 1.4
#: Share of the sample's own neighbours that the pruning ratio is fitted to reach, on this many of its vectors.
TARGET, PROBES = 0.95, 512
#: The angle that the pruning ratio multiplies is the mean of this many nearest centroids'.
NEAREST = 16
#: Graph neighbours of a centroid; postings in one part of a bundle, and queries in one block of it.
DEGREE = 24
PART, QUERY_PART = 8192, 8192


@dataclass
class Lists:
    """Unit centroids (lifted), their neighbour graph, the length all vectors are lifted to, and the two ratios.

    ``scale``, a power of two, brings the largest component near one first, so that no square overflows or vanishes.
    """

    centroids: np.ndarray
    length: float
    graph: np.ndarray = field(default_factory=lambda: np.empty((0, 0), np.int64))
    closure: float = 1.0
    prune: float = 1.5
    scale: float = 1.0

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Vectors as directions: one more coordinate brings all to the same length."""
        x = x * self.scale
        rest = np.sqrt(np.maximum(0.0, self.length**2 - (x * x).sum(1)))
        return np.column_stack([x, rest]) / self.length

    def aim(self, q: np.ndarray) -> np.ndarray:
        """Queries as directions: the direction alone decides which products are largest."""
        q = np.ldexp(q, -_exponents(q)[:, None])
        return np.column_stack([q / np.sqrt((q * q).sum(1))[:, None], np.zeros(len(q))])

    def post(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lists, angles) of the COPIES nearest of all centroids, nearest first, by matrix products."""
        width = min(COPIES, len(self.centroids))
        ids, angles = np.empty((len(x), width), np.int64), np.empty((len(x), width))
        for at in range(0, len(x), step := max(1, (1 << 22) // len(self.centroids))):
            cos = x[at : at + step] @ self.centroids.T
            near = np.argpartition(-cos, width - 1, axis=1)[:, :width]
            angle = _angle(np.take_along_axis(cos, near, 1))
            order = np.lexsort((near, angle), axis=1)
            ids[at : at + step], angles[at : at + step] = np.take_along_axis(near, order, 1), np.take_along_axis(angle, order, 1)
        return ids, angles

    def search(self, x: np.ndarray, prune: float | None = None) -> np.ndarray:
        """Angles (rows, lists) of the centroids that a walk of the graph reached within the ratio; infinite for the others.

        From entries spread over all centroids every row expands, in steps, each centroid it has met
        within the ratio of its nearest ones so far, until no such centroid is left.
        """
        ratio = self.prune if prune is None else prune
        n, c = len(x), len(self.centroids)
        entries = np.unique(np.linspace(0, c - 1, min(c, max(64, 4 * int(c**0.5)))).astype(np.int64))
        angle = np.full((n, c), np.inf)
        angle[:, entries] = _angle(x @ self.centroids[entries].T)
        fresh = np.isfinite(angle)
        while True:
            row, node = np.nonzero(fresh & (angle <= ratio * self.reference(angle)[:, None]))
            if not len(row):
                break
            fresh = np.zeros(n * c, dtype=bool)
            for at in range(0, len(row), 1 << 18):
                fresh[(row[at : at + (1 << 18), None] * c + self.graph[node[at : at + (1 << 18)]]).ravel()] = True
            fresh = fresh.reshape(n, c) & np.isinf(angle)
            row, node = np.nonzero(fresh)
            for at in range(0, len(row), 1 << 16):
                r, m = row[at : at + (1 << 16)], node[at : at + (1 << 16)]
                angle[r, m] = _angle(np.einsum("nd,nd->n", x[r], self.centroids[m]))
        angle[angle > ratio * self.reference(angle)[:, None]] = np.inf
        return angle

    def reference(self, angle: np.ndarray) -> np.ndarray:
        """The mean angle of the nearest few centroids, per row."""
        few = min(NEAREST, angle.shape[1])
        near = np.partition(angle, few - 1, axis=1)[:, :few]
        return np.maximum(near.mean(1), 1e-9)


def _angle(cos: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cos, -1.0, 1.0))


def _exponents(x: np.ndarray) -> np.ndarray:
    """The power of two just above each row's largest component."""
    return np.frexp(np.abs(x).max(1, initial=0.0))[1]


def ordinary(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether no product of rows with these exponents leaves a double's range."""
    return bool(a.max(initial=0) + b.max(initial=0) < 1000 and a.min(initial=0) + b.min(initial=0) > -900)


def scaled_products(q: np.ndarray, v: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows with exponents a and b; those beyond a double's range come out infinite or zero, never as the difference of two such."""
    near_one = np.ldexp(q, -a[:, None]) @ np.ldexp(v, -b[:, None]).T
    with np.errstate(over="ignore", under="ignore"):
        return np.ldexp(near_one, a[:, None] + b[None, :])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1)), 1e-300)[:, None]


def bisect(x: np.ndarray, lists: int) -> np.ndarray:
    """Means of ``lists`` equal parts: split at the median along the line between two means, again and again.

    Neighbouring parts stand next to each other, as the leaves of the tree of splits do.
    """
    parts, out = [(x, lists)], []
    while parts:
        now, k = parts.pop()
        if k <= 1 or len(now) < 2:
            out.append(now.mean(0))
            continue
        a, b = now[0], now[((now - now[0]) ** 2).sum(1).argmax()]
        for _ in range(4):
            side = ((now - a) ** 2).sum(1) <= ((now - b) ** 2).sum(1)
            if side.all() or not side.any():
                break
            a, b = now[side].mean(0), now[~side].mean(0)
        order = np.argsort(now @ (b - a), kind="stable")
        left = k // 2
        cut = max(1, min(len(now) - 1, len(now) * left // k))
        parts += [(now[order[:cut]], left), (now[order[cut:]], k - left)]
    return np.array(out)


def neighbour_graph(c: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """The nearest centroids of each, itself included, plus a ring through all, so that every centroid can be reached."""
    n = len(c)
    ring = np.column_stack([(np.arange(n) + 1) % n, (np.arange(n) - 1) % n])
    degree, near = min(n, degree + 1), []
    for i in range(0, n, 512):
        near.append(np.argpartition(-(c[i : i + 512] @ c.T), degree - 1, axis=1)[:, :degree])
    return np.hstack([np.vstack(near), ring])


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """_id, _x and its 128-bit hash (h1, h2): not null, not zero, of finite components only, of the commonest dimension."""
    x = F.col("_x")
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).alias("_x")).filter("_id is not null and _x is not null and size(_x) > 0")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(x, lambda v: v != 0)
    rows = rows.filter(fine)
    common = rows.groupBy(F.size("_x").alias("_d")).count().orderBy(F.desc("count"), F.desc("_d")).limit(1)
    dim = (common.first() or [0])[0]
    # -0.0 and 0.0 are one value to the products but not to a hash.
    same = F.transform(x, lambda v: F.when(v == 0, F.lit(0.0)).otherwise(v.cast("double")))
    return rows.filter(F.size("_x") == dim).select("_id", "_x", F.xxhash64(same).alias("h1"), F.xxhash64(F.lit(1), same).alias("h2"))


def classes(rows: DataFrame, k: int) -> DataFrame:
    """(h1, h2, x, ids): every distinct vector with its k + 1 smallest ids."""
    place = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("_id"))
    few = rows.dropDuplicates(["_id", "h1", "h2"]).withColumn("_n", place).filter(F.col("_n") <= k + 1)
    return few.groupBy("h1", "h2").agg(F.min_by("_x", "_n").alias("x"), F.sort_array(F.collect_list("_id")).alias("ids"))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def fit(known: DataFrame, per_list: int = PER_LIST, numbers: int = SAMPLE_NUMBERS) -> Lists | None:
    """Lists for the distinct vectors ``x``; None if there are none. The driver sees ``numbers`` components at most.

    Lists and sample grow with the vectors up to that bound; beyond it lists grow in length instead.
    """
    largest = F.aggregate("x", F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v.cast("double"))))
    n, top, dim = known.agg(F.count(F.lit(1)), F.max(largest), F.max(F.size("x"))).first()
    if not n:
        return None
    scale = 2.0 ** -int(np.clip(np.frexp(top)[1], -1000, 1023))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + (v.cast("double") * scale) * (v.cast("double") * scale)))
    length = known.agg(F.max(norm)).first()[0]
    size = max(1, numbers // dim)
    # Hashes are uniform: those below a limit are a sample of about the wanted size, without sorting all vectors.
    share = min(1.0, 1.05 * size / n)
    some = known.filter(F.shiftrightunsigned("h1", 11) < int(share * (1 << 53))).select("h1", "h2", "x").toArrow()
    order = np.lexsort((some["h2"].to_numpy(), some["h1"].to_numpy()))[:size]
    if not len(order):
        order, some = np.arange(1), known.select("h1", "h2", "x").limit(1).toArrow()
    lists = Lists(np.empty((0, 0)), float(length) * (1 + 1e-12), scale=scale)
    plain = _matrix(some["x"])[order]
    x = lists.lift(plain)
    wanted = int(max(1, min(-(-n // per_list), len(x) // LEAST_SAMPLE)))
    c = _unit(bisect(x, wanted))
    for _ in range(2):
        own = np.concatenate([(x[at : at + 4096] @ c.T).argmax(1) for at in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where((np.bincount(own, minlength=len(c)) > 0)[:, None], _unit(sums), c)
    lists.centroids, lists.graph = c, neighbour_graph(c)
    _fit_ratios(lists, plain, x)
    return lists


def _fit_ratios(lists: Lists, plain: np.ndarray, x: np.ndarray) -> None:
    """The closure ratio that makes MEAN_COPIES postings a vector, and the pruning ratio that finds TARGET of the sample's neighbours."""
    few = np.linspace(0, len(x) - 1, min(len(x), 4096)).astype(np.int64)
    _, angle = lists.post(x[few])
    more = np.sort((angle[:, 1:] / np.maximum(angle[:, :1], 1e-9)).ravel())
    extra = int((MEAN_COPIES - 1) * len(few))
    lists.closure = float(more[extra - 1]) if 0 < extra <= len(more) else 1.0
    probes = np.linspace(0, len(x) - 1, min(len(x), PROBES)).astype(np.int64)
    k = min(K, len(x) - 1)
    if k < 1:
        return
    needed = []
    for at in range(0, len(probes), 64):
        own = probes[at : at + 64]
        score = lists.aim(plain[own])[:, :-1] @ (plain * lists.scale).T
        score[np.arange(len(own)), own] = -np.inf
        near = np.argpartition(-score, k - 1, axis=1)[:, :k]
        posted, apart = lists.post(x[near.ravel()])
        held = apart <= lists.closure * np.maximum(apart[:, :1], 1e-9)
        held[:, 0] = True
        to = _angle(lists.aim(plain[own]) @ lists.centroids.T)
        of = np.take_along_axis(np.repeat(to, k, 0), posted, 1)
        needed.append((np.where(held, of, np.inf).min(1).reshape(len(own), k) / lists.reference(to)[:, None]).ravel())
    lists.prune = max(1.0, float(np.quantile(np.concatenate(needed), TARGET)))


def _postings(known: DataFrame, shared) -> DataFrame:
    """(list, h1, h2, x, ids): every distinct vector under its nearest list and those within the closure ratio."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: Lists = shared.value
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 1024):
                batch = whole_batch.slice(at, 1024)
                found, angle = lists.post(lists.lift(_matrix(batch.column(2))))
                near = angle <= lists.closure * np.maximum(angle[:, :1], 1e-9)
                near[:, 0] = True
                row, col = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([pa.array(found[row, col]), *batch.take(pa.array(row)).columns], names=["list", *batch.schema.names])

    rows = known.select("h1", "h2", "x", "ids")
    return rows.mapInArrow(run, rows.withColumn("list", F.lit(0).cast("long")).select("list", *rows.columns).schema)


def _reads(wanted: DataFrame, shared, bundle_of: np.ndarray, exact: bool) -> DataFrame:
    """(bundle, lists, h1, h2, x): every query once for each bundle that it reads lists of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: Lists = shared.value
        step = max(1, min(1024, (1 << 22) // len(lists.centroids)))
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, step):
                batch = whole_batch.slice(at, step)
                x = lists.aim(_matrix(batch.column(2)))
                # Lists stand in the order of their bundles, so a row's lists of one bundle are neighbours.
                row, each = np.nonzero(np.ones((len(x), len(lists.centroids)), bool) if exact else np.isfinite(lists.search(x)))
                bundle = bundle_of[each]
                starts = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (bundle[1:] != bundle[:-1])])[: len(row)])
                of = pa.ListArray.from_arrays(pa.array([*starts, len(row)], pa.int32()), pa.array(each, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(bundle[starts]), of, *batch.take(pa.array(row[starts])).columns], names=["bundle", "lists", *batch.schema.names])

    extra = {"bundle": F.lit(0).cast("long"), "lists": F.array(F.lit(0))}
    rows = wanted.select("h1", "h2", "x")
    return rows.mapInArrow(run, rows.withColumns(extra).select("bundle", "lists", *rows.columns).schema)


def bundles(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bundle of each list, parts of each bundle): neighbouring lists up to ``size`` postings together, longer ones alone."""
    of, total = np.zeros(len(counts), np.int64), []
    for i, n in enumerate(counts.tolist()):
        if not total or total[-1] + n > size:
            total.append(0)
        total[-1] += n
        of[i] = len(total) - 1
    return of, np.maximum(1, -(-np.array(total, np.int64) // size))


def _table(spark: SparkSession, names: str, columns: list[np.ndarray]) -> DataFrame:
    """A small table of longs, one row a list or bundle, to broadcast."""
    return F.broadcast(spark.createDataFrame(pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names.split(), columns, strict=True)})))


def _best(run: np.ndarray, ids: np.ndarray, scores: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``keep`` best (run, id, score) of every run, best first, ties to the smaller id; an id counts once a run, at its best."""
    order = np.lexsort((-scores, ids, run))
    run, ids, scores = run[order], ids[order], scores[order]
    first = np.concatenate([[True], (run[1:] != run[:-1]) | (ids[1:] != ids[:-1])])[: len(run)]
    run, ids, scores = run[first], ids[first], scores[first]
    order = np.lexsort((ids, -scores, run))
    run, ids, scores = run[order], ids[order], scores[order]
    starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])[: len(run)])
    place = np.arange(len(run)) - np.repeat(starts, np.diff([*starts, len(run)]))
    near = place < keep
    return run[near], ids[near], scores[near]


FOUND = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])


def _answers(h1: np.ndarray, h2: np.ndarray, run: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    """One row for each run number met in ``run`` (sorted), with h1 and h2 of that number."""
    starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])[: len(run)])
    ends = pa.array([*starts, len(run)], pa.int32())
    own = run[starts]
    return pa.RecordBatch.from_arrays([pa.array(h1[own]), pa.array(h2[own]), pa.ListArray.from_arrays(ends, pa.array(ids, pa.int64())), pa.ListArray.from_arrays(ends, pa.array(scores, pa.float64()))], schema=FOUND)


def _read_part(k: int):
    """Queries and postings of one part of a bundle -> the part's k + 1 best of each query, over the lists that it reads."""

    def run(queries: pa.Table, postings: pa.Table) -> pa.Table:
        if not queries.num_rows or not postings.num_rows:
            return FOUND.empty_table()
        postings = postings.sort_by("list")
        v, of_list = _matrix(postings["x"]), postings["list"].to_numpy()
        ev = _exponents(v)
        names, starts = np.unique(of_list, return_index=True)
        ends = [*starts[1:], len(of_list)]
        held = postings["ids"].combine_chunks()
        flat, at_id, n_ids = held.flatten().to_numpy(), held.offsets.to_numpy().astype(np.int64), held.value_lengths().to_numpy().astype(np.int64)
        at_id = at_id - at_id[0]
        out, step = [], max(1, (1 << 22) // len(v))
        for at in range(0, queries.num_rows, step):
            block = queries.slice(at, step)
            q = _matrix(block["x"])
            eq = _exponents(q)
            plain = ordinary(eq, ev)
            reads = block["lists"].combine_chunks()
            wanted = reads.flatten().to_numpy()
            row = np.repeat(np.arange(len(q)), reads.value_lengths().to_numpy())
            order = np.argsort(wanted, kind="stable")
            wanted, row = wanted[order], row[order]
            lo, hi = np.searchsorted(wanted, names), np.searchsorted(wanted, names, "right")
            score = np.full((len(q), len(v)), -np.inf)
            read = None if plain else np.zeros(score.shape, bool)
            for a, b, i, j in zip(lo, hi, starts, ends):
                if a < b:
                    if plain:
                        score[row[a:b], i:j] = q[row[a:b]] @ v[i:j].T
                    else:
                        score[row[a:b], i:j] = scaled_products(q[row[a:b]], v[i:j], eq[row[a:b]], ev[i:j])
                        read[row[a:b], i:j] = True
            m = min(COPIES * (k + 1), len(v))  # a vector may stand in that many lists of a bundle
            least = np.partition(score, len(v) - m, axis=1)[:, len(v) - m]
            near, col = np.nonzero((score >= least[:, None]) & (np.isfinite(score) if plain else read))
            n = n_ids[col]
            each = np.repeat(at_id[col], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found = _best(np.repeat(near, n), flat[each], np.repeat(score[near, col], n), k + 1)
            out.append(_answers(block["h1"].to_numpy(), block["h2"].to_numpy(), *found))
        return pa.Table.from_batches(out, FOUND)

    return run


def _merge(k: int):
    """Rows (h1, h2, ids, scores) sorted by query -> one row a query; a query may go on in the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = FOUND.empty_table()
        for batch in batches:
            held = _merged(pa.concat_tables([held, pa.Table.from_batches([batch]).cast(FOUND)]))
            if held.num_rows > 1:
                yield from held.slice(0, held.num_rows - 1).to_batches()
                held = held.slice(held.num_rows - 1)
        yield from held.to_batches()

    def _merged(t: pa.Table) -> pa.Table:
        if not t.num_rows:
            return t
        h1, h2 = t["h1"].to_numpy(), t["h2"].to_numpy()
        number = np.cumsum(np.concatenate([[0], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]))
        ids, scores = t["ids"].combine_chunks(), t["scores"].combine_chunks()
        starts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
        found = _best(np.repeat(number, ids.value_lengths().to_numpy()), ids.flatten().to_numpy(), scores.flatten().to_numpy(), k + 1)
        return pa.Table.from_batches([_answers(h1[starts], h2[starts], *found)], FOUND)

    return run


def neighbours(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, exact: bool = False) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products found for each query row.

    Ids are whole numbers; ``is_query`` is a condition on ``_id``. Vectors that are null, zero, of null or
    non-finite components, without an id or of another than the commonest dimension take no part. Ties go to
    the smaller id; a query never finds its own id. Components of any finite size take part: a product beyond a
    double's range counts as infinite (or zero), and such products tie. Repeated rows count once, and so does an id with several
    vectors, at its best score; as a query, such an id is answered for each. ``exact`` reads all
    lists, for measuring recall. Empty tables give no rows. Other columns take no part.
    """
    spark: SparkSession = vectors.sparkSession
    rows = checkpoint(valid(vectors, id_col, vector_col))
    known = checkpoint(classes(rows, k))
    lists = fit(known)
    if lists is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(lists)
    asked = rows.filter(is_query)
    # Dealt out anew, by another key than the one they are grouped by: few rows of wide walks would otherwise be coalesced into one task.
    wanted = asked.groupBy("h1", "h2").agg(F.first("_x").alias("x")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "h2")
    postings = checkpoint(_postings(known, shared))
    counts = np.zeros(len(lists.centroids), np.int64)
    for r in postings.groupBy("list").count().collect():  # one count a list
        counts[r["list"]] = r["count"]
    bundle_of, parts = bundles(counts, PART)
    reads = checkpoint(_reads(wanted, shared, bundle_of, exact))
    blocks = np.ones(len(parts), np.int64)
    for r in reads.groupBy("bundle").count().collect():  # one count a bundle, of which there are no more than lists
        blocks[r["bundle"]] = -(-r["count"] // QUERY_PART)
    cut = _table(spark, "bundle parts blocks", [np.arange(len(parts)), parts, blocks])
    of_hash = lambda n: F.pmod(F.col("h2"), F.col(n))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = reads.join(cut, "bundle").withColumn("block", of_hash("blocks")).withColumn("part", numbers("parts")).drop("parts", "blocks")
    right = postings.join(_table(spark, "list bundle", [np.arange(len(bundle_of)), bundle_of]), "list").join(cut, "bundle")
    right = right.withColumn("part", of_hash("parts")).withColumn("block", numbers("blocks")).select("bundle", "part", "block", "list", "x", "ids")
    key = ["bundle", "part", "block"]
    schema = "h1 long, h2 long, ids array<long>, scores array<double>"
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_read_part(k), schema)
    best = found.repartition("h1", "h2").sortWithinPartitions("h1", "h2").mapInArrow(_merge(k), schema)
    answered = join_one(asked.select("_id", "h1", "h2").distinct(), checkpoint(best), ["h1", "h2"])
    pairs = F.arrays_zip(F.col("ids").alias("id"), F.col("scores").alias("s"))
    others = answered.select("_id", F.filter(pairs, lambda p: p["id"] != F.col("_id")).alias("_others"))
    out = others.select(F.col("_id").alias("query_id"), F.posexplode(F.slice("_others", 1, k)).alias("_n", "_p"))
    return out.select("query_id", (F.col("_n") + 1).alias("rank"), F.col("_p.id").alias("vec_id"), F.col("_p.s").alias("score"))
