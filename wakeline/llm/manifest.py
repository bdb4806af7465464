"""A Merkle manifest of a table: one tree of digests per group, and one over the groups.

Rows are dealt by range of (group, order), so that a partition holds consecutive leaves. Each partition
folds what it can: runs of ARITY siblings whose digests are all there become their parent, and what is
left are the open nodes at its two ends, keyed by group, level and index. Fragments of open nodes form a
monoid: the union of two neighbouring ones, in which every run that is now complete becomes its parent,
whatever the order of merging. A tree of such merges, FAN partitions at a time, closes all runs. How many
siblings a run has follows from the number of the group's leaves, which a partition has to be told only of
its first and last group: one row a partition goes through the driver.

A fragment holds fewer than 2 * ARITY open nodes a level, whatever the rows. The paths from the root come
down by joins of a run with its parent, each parent meeting at most ARITY runs, so no key is hot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm.text import ascii_lower
from wakeline.session import checkpoint

ARITY = 16
#: Partitions whose fragments one merge takes.
FAN = 16
#: Documents whose number's CRC-32 this divides are tampered with.
TAMPER = 5

NODES = pa.schema([("p", pa.int64()), ("grp", pa.string()), ("total", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.binary()), ("children", pa.binary()), ("root", pa.bool_())])
STEPS = "array<struct<left:binary,right:binary>>"


def hashed(*parts: bytes) -> bytes:
    """SHA-256 of the concatenation of digests as hex text."""
    return hashlib.sha256(b"".join(p.hex().encode() for p in parts)).digest()


def width(total: int, level: int) -> int:
    """Nodes of a level over so many leaves."""
    return -(-total // ARITY**level)


class Fragment:
    """Open nodes of one group by (level, index), and how many of them each run has.

    ``add`` closes every run that becomes complete and hands (level, idx, digest, children) of its parent to
    ``closed``. Before ``total`` is known only runs of ARITY nodes are complete; ``settle`` brings it.
    """

    def __init__(self, total: int | None, closed) -> None:
        self.total, self.closed, self.open, self.have = total, closed, {}, {}

    def add(self, level: int, idx: int, digest: bytes) -> None:
        while True:
            self.open[level, idx] = digest
            run = idx // ARITY
            self.have[level, run] = self.have.get((level, run), 0) + 1
            if (parent := self.close(level, run)) is None:
                return
            level, idx, digest = level + 1, run, parent

    def close(self, level: int, run: int) -> bytes | None:
        """The parent's digest if the run is complete."""
        size = ARITY
        if self.total is not None:
            n = width(self.total, level)
            if n <= 1:
                return None  # the root
            size = min(ARITY, n - run * ARITY)
        if self.have[level, run] < size:
            return None
        del self.have[level, run]
        parts = [self.open.pop((level, i)) for i in range(run * ARITY, run * ARITY + size)]
        digest = hashed(*parts)
        self.closed(level + 1, run, digest, b"".join(parts))
        return digest

    def settle(self, total: int) -> None:
        """All leaves are here and are so many: the last runs close, the lowest first."""
        self.total = total
        for level in range(64):
            n = width(total, level)
            if n <= 1:
                return
            run = (n - 1) // ARITY
            if (level, run) in self.have and (digest := self.close(level, run)) is not None:
                self.add(level + 1, run, digest)


class _Rows:
    """Rows of NODES, handed out in batches."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def batches(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            columns = zip(*self.rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, NODES.types, strict=True)], schema=NODES)
            self.rows = []

    def rest(self, p: int, grp: str, fragment: Fragment) -> None:
        """The nodes that stay open; one that is alone in its level is the root."""
        for (level, idx), digest in fragment.open.items():
            self.rows.append((p, grp, fragment.total, level, idx, digest, None, width(fragment.total, level) == 1))


def _merged(nodes: Iterator[tuple], known) -> Iterator[pa.RecordBatch]:
    """(p, grp, level, idx, digest) of nodes, a group's together -> the runs they close, and the nodes that stay open.

    ``known`` gives a group's total in partition p, or None where all its leaves are among the nodes.
    """
    out, own, fragment, last = _Rows(), None, None, 0

    def finish() -> None:
        if fragment is not None:
            if fragment.total is None:
                fragment.settle(last + 1)
            out.rest(*own, fragment)

    for p, grp, level, idx, digest in nodes:
        if own != (p, grp):
            finish()
            own = p, grp
            fragment = Fragment(known(p, grp), lambda lv, i, d, c, p=p, g=grp: out.rows.append((p, g, None, lv, i, d, c, False)))
        last = idx
        fragment.add(level, idx, digest)
        yield from out.batches(4096)
    finish()
    yield from out.batches()


def numbered(leaves: DataFrame, keys: list[str]):
    """``leaves`` (grp, digest, keys and others) with their partition ``p`` and place ``idx`` (from 0) in their group by ``keys``.

    Rows equal in all keys stand in any order. Written once, dealt by range. With them a broadcast: by partition
    (first group, its rows in earlier partitions, its total, last group, its total), one row a partition.
    """
    spark: SparkSession = leaves.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["grp", *[F.col(k).asc_nulls_first() for k in keys], "_tie"]
    rows = leaves.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = checkpoint(rows.drop("_tie").withColumn("p", F.spark_partition_id().cast("long")))
    counts = rows.groupBy("p", "grp").agg(F.count(F.lit(1)).alias("n"))
    ends = counts.groupBy("p").agg(F.min(F.struct("grp", "n")).alias("first"), F.max(F.struct("grp", "n")).alias("last")).collect()  # one row a partition
    totals: dict[str, int] = {}
    before: dict[int, int] = {}
    for r in sorted(ends, key=lambda r: r["p"]):
        before[r["p"]] = totals.get(r["first"]["grp"], 0)
        for grp, n in {tuple(r["first"]), tuple(r["last"])}:
            totals[grp] = totals.get(grp, 0) + n
    edges = {r["p"]: (r["first"]["grp"], before[r["p"]], totals[r["first"]["grp"]], r["last"]["grp"], totals[r["last"]["grp"]]) for r in ends}
    shared = spark.sparkContext.broadcast(edges)
    schema = rows.withColumn("idx", F.lit(0).cast("long")).schema
    at_grp, at_p = rows.columns.index("grp"), rows.columns.index("p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = None, 0
        for batch in filter(len, batches):
            groups = batch.column(at_grp)
            if own is None:
                own, seen, *_ = shared.value[batch.column(at_p)[0].as_py()]
            n = len(groups)
            starts = np.flatnonzero(np.concatenate([[groups[0].as_py() != own], pa.compute.not_equal(groups[1:], groups[:-1]).to_numpy(zero_copy_only=False)]))
            first = np.zeros(n, np.int64)
            first[starts] = starts
            idx = np.arange(n) - np.maximum.accumulate(first)
            idx[: starts[0] if len(starts) else n] += seen
            own, seen = groups[n - 1].as_py(), int(idx[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(idx)], names=schema.names)

    return rows.mapInArrow(run, schema), shared


def forest(leaves: DataFrame, edges) -> tuple[DataFrame, DataFrame]:
    """(runs, roots) of the numbered leaves and the broadcast that came with them.

    runs: grp, level and idx of the parent, and its children's digests, concatenated. roots: grp, the level
    and the digest of a group's root, which a lone leaf is itself.
    """
    cols = ["p", "grp", "level", "idx", "digest"]
    schema = "p long, grp string, total long, level int, idx long, digest binary, children binary, root boolean"

    def total(p: int, grp: str) -> int | None:
        first, _, n, last, m = edges.value[p]
        return n if grp == first else m if grp == last else None

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _merged((r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True)), total)

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("grp", "ascending"), ("level", "ascending"), ("idx", "ascending")])
        totals = dict(zip(t["grp"].to_pylist(), t["total"].to_pylist(), strict=True))
        b = key[0].as_py()
        rows = zip([b] * t.num_rows, *[t[c].to_pylist() for c in cols[1:]], strict=True)
        return pa.Table.from_batches(_merged(rows, lambda p, grp: totals[grp]), NODES)

    nodes = checkpoint(leaves.withColumn("level", F.lit(0)).select(*cols).mapInArrow(fold, schema))
    closed, roots, left = [], [], int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        closed.append(nodes.filter("children is not null").select("grp", "level", "idx", "children"))
        roots.append(nodes.filter("root").select("grp", "level", "digest"))
        if left <= 1:
            return reduce(DataFrame.unionByName, closed), reduce(DataFrame.unionByName, roots)
        left = -(-left // FAN)
        # A group meets at most FAN fragments, each of fewer than 2 * ARITY nodes a level.
        nodes = checkpoint(nodes.filter("children is null and not root").groupBy(F.floor(F.col("p") / FAN).alias("b")).applyInArrow(merge, schema))


def _step(children: Column, place: Column) -> Column:
    """The digests left and right of one child of a run."""
    at = (place * 32).cast("int")
    return F.struct(F.substring(children, F.lit(1), at).alias("left"), F.substring(children, at + 33, F.lit(32 * ARITY)).alias("right"))


def proofs(leaves: DataFrame, runs: DataFrame, top: DataFrame, height: int) -> DataFrame:
    """``leaves`` (grp, idx and others) with ``steps``, the siblings on the way up, the lowest first, and ``subroot``.

    ``top`` holds grp, the level of its root, the root as ``subroot`` and the ``steps`` above it; ``height`` is the
    highest of those levels. Levels come down one by one, and a node meets one row: its parent's run, or,
    where it is the root, its row of ``top``.
    """
    runs = runs.select("grp", "level", "idx", "children")
    own, above = None, None
    for level in range(height, -1, -1):
        parents = top.filter(F.col("level") == level).select("grp", F.lit(0).cast("long").alias("_up"), F.lit(None).cast("binary").alias("_siblings"), F.col("steps").alias("_above"), "subroot")
        if above is not None:
            parents = parents.unionByName(above.select("grp", F.col("idx").alias("_up"), F.col("children").alias("_siblings"), F.col("steps").alias("_above"), "subroot"))
        own = runs.filter(F.col("level") == level).drop("level") if level else leaves
        met = own.withColumn("_up", F.floor(F.col("idx") / ARITY)).join(parents, ["grp", "_up"])
        lower = F.concat(F.array(_step(F.col("_siblings"), F.pmod("idx", F.lit(ARITY)))), "_above")
        own = met.withColumn("steps", F.when(F.col("_siblings").isNull(), F.col("_above")).otherwise(lower)).drop("_up", "_siblings", "_above")
        above = checkpoint(own) if level else None
    return own


def _field(c: Column) -> Column:
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(fields: list[Column]) -> Column:
    """The digest of one row, as bytes: of every field ``-`` if null, else its UTF-8 length, a colon and its value."""
    return F.unhex(F.sha2(F.concat(*map(_field, fields)), 256))


def _text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "source", text_col: str = "text") -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root and verified of every row; digests are lowercase hex.

    A row's proof are its siblings from its leaf up to the root; folding it recomputes the root from the
    tampered leaf, where the row is tampered with, else from the leaf. Null groups are a group, the first of
    all; null ids stand first in theirs and are not tampered with. Rows of one id are ordered by their leaves;
    repeated rows are leaves each for itself. Empty tables give no rows. Further columns take no part.
    """
    named = {"text": F.col(text_col), "id": F.col(id_col)}
    changed = leaf([ascii_lower(F.col(f).cast("string")) if f == text_col else F.col(f) for f in fields])
    hit = F.crc32(named["id"].cast("string").cast("binary")) % TAMPER == 0
    grp = F.when(F.col(group_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group_col).cast("string")))
    rows = docs.select(named["id"].alias("id"), grp.alias("grp"), leaf([F.col(f) for f in fields]).alias("digest"), F.when(hit, changed).alias("tampered"))
    # Written before they are dealt by range, whose sampling would hash all texts once more.
    leaves, edges = numbered(checkpoint(rows), ["id", "digest"])
    runs, roots = forest(leaves, edges)
    roots = checkpoint(roots)
    # The tree over the groups, by the same means: their roots are its leaves.
    over, edges = numbered(roots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "level", "digest"), ["name"])
    over_runs, over_root = forest(over, edges)
    root = checkpoint(over_root.select("grp", "level", F.col("digest").alias("subroot"), F.array().cast(STEPS).alias("steps")))
    height, over_height = roots.agg(F.max("level")).first()[0] or 0, root.agg(F.max("level")).first()[0] or 0
    up = proofs(over.select("grp", "idx", "name", F.col("level").alias("_level"), "digest"), over_runs, root, over_height)
    top = checkpoint(up.select(F.col("name").alias("grp"), F.col("_level").alias("level"), F.col("digest").alias("subroot"), "steps"))
    met = proofs(leaves.select("grp", "idx", "id", "digest", "tampered"), runs, top, height)
    found = root.first()
    sides = F.transform("steps", lambda s: F.concat(_text(s["left"]), _text(s["right"])))
    folded = F.aggregate("steps", _text(F.coalesce("tampered", "digest")), lambda d, s: F.sha2(F.concat(_text(s["left"]), d, _text(s["right"])), 256))
    out = met.select(
        F.col("id").alias(id_col),
        _text(F.col("digest")).alias("leaf"),
        _text(F.col("subroot")).alias("subroot"),
        F.lit(bytes(found["subroot"]).hex() if found else None).cast("string").alias("root"),
        F.sha2(F.array_join(sides, ""), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
