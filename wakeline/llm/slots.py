"""Training-order materialisation: a keyed permutation puts every sequence in a global slot.

Documents are cut into sequences of fixed length. A sequence's index in corpus order goes through a
four-round Feistel network over the smallest even number of bits that holds all indices, walked
again while it falls outside; that is a permutation of 0..n-1 which needs no sort and no state:
the slot of any index, and the index of any slot, follow from the key and n alone. Sequences are
dealt to shards by slot range and written in slot order at a fixed stride, so byte offsets follow
from slots, and a reader resumes anywhere by seeking.

Ids are any whole numbers below ``vocabulary``: a column of them (such as the encoder's), or the bytes
of the text. The next number ends a document, the one after it pads, and all are stored in the fewest
of 1, 2 or 4 bytes that hold them. Sequences are packed: a partition's documents, in order of id and
hash, form one stream of ids with an end mark after each document, cut every LENGTH ids; only its
last sequence is padded. A first pass counts ids per partition; running sums over those counts, one
row a partition, give each partition its first index. Ids move once, to their shard.

Every call writes a run folder of its own. Shard files are written under a temporary name and renamed,
and their content follows from the input, so a task that runs twice leaves the same file.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
from collections.abc import Iterator
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wakeline.llm.text import whole
from wakeline.session import checkpoint

KEY = 0x5EED
ROUNDS = 4
#: Ids in one sequence.
LENGTH = 2048
#: Ids of the bytes of a text: no UTF-8 text holds a byte above 0xF4, so 254 can end and 255 can pad.
BYTES = 254
#: Sequences in one shard.
SHARD = 4096
#: Ids that are marked at once, and stored sequences that are written at once: so memory follows neither batches nor the length of most documents.
PIECE, ROWS = 1 << 18, 256


def _half_bits(n: int) -> int:
    return max(1, (max(2, n) - 1).bit_length() + 1 >> 1)


def _round(x: np.ndarray, key: int, r: int) -> np.ndarray:
    """A 64-bit mix of a half, the key and the round."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _network(x: np.ndarray, bits: int, key: int, rounds: range) -> np.ndarray:
    half, low = np.uint64(bits), np.uint64((1 << bits) - 1)
    left, right = x >> half, x & low
    for r in rounds:
        left, right = right, left ^ (_round(right, key, r) & low)
    return left << half | right


def slot_of(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The slots of indices in 0..n-1: a permutation of 0..n-1."""
    bits, x = _half_bits(n), np.asarray(index).astype(np.uint64)
    x = _network(x, bits, key, range(ROUNDS))
    while (out := x >= np.uint64(n)).any():  # cycle-walking: under four tries on average
        x[out] = _network(x[out], bits, key, range(ROUNDS))
    return x.astype(np.int64)


def index_of(slot: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The inverse of ``slot_of``: the same network with swapped halves and rounds in reverse."""
    bits = _half_bits(n)
    half, low = np.uint64(bits), np.uint64((1 << bits) - 1)
    swap = lambda x: (x & low) << half | x >> half
    back = lambda x: swap(_network(swap(x), bits, key, range(ROUNDS - 1, -1, -1)))
    x = back(np.asarray(slot).astype(np.uint64))
    while (out := x >= np.uint64(n)).any():
        x[out] = back(x[out])
    return x.astype(np.int64)


def width(vocabulary: int) -> np.dtype:
    """How an id is stored: the ids below ``vocabulary``, the end mark and the padding."""
    return np.dtype("<u1" if vocabulary + 2 <= 1 << 8 else "<u2" if vocabulary + 2 <= 1 << 16 else "<u4")


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, ids of each row) of a batch of byte strings or lists."""
    if pa.types.is_list(column.type):
        if column.flatten().null_count:
            raise ValueError("a null among the ids of a document")
        return column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], np.diff(at)


def _pieces(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ids of a batch, and those of each row, in pieces of about PIECE ids; a longer document is one piece."""
    ids, sizes = _ids(column)
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + PIECE, "right")) - 1)
        yield ids[ends[at] : ends[to]], sizes[at:to]
        at = to


def _stream(batches: Iterator[pa.RecordBatch], length: int, vocabulary: int) -> Iterator[np.ndarray]:
    """Rows of ``length`` ids from batches of documents, the last one padded."""
    kind = width(vocabulary)
    rest = np.empty(0, kind)
    for ids, sizes in chain.from_iterable(_pieces(b.column(b.num_columns - 1)) for b in batches):
        if len(ids) and (ids.min() < 0 or ids.max() >= vocabulary):
            raise ValueError(f"an id is not in 0..{vocabulary - 1}")
        marked = np.full(len(rest) + len(ids) + len(sizes), vocabulary, kind)
        marked[: len(rest)] = rest
        marked[len(rest) + np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = ids
        cut = len(marked) // length * length
        if cut:
            yield marked[:cut].reshape(-1, length)
        rest = marked[cut:]
    if len(rest):
        yield np.concatenate([rest, np.full(length - len(rest), vocabulary + 1, kind)]).reshape(1, length)


def _uri(folder: str) -> str:
    return folder.replace("s3a://", "s3://", 1)


def materialise(
    docs: DataFrame,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    ids_col: str | None = None,
    vocabulary: int = BYTES,
    length: int = LENGTH,
    per_shard: int = SHARD,
    key: int = KEY,
) -> DataFrame:
    """Write all sequences of ``docs`` as shard files in a new folder under ``folder`` and return their manifest.

    ``shard-%08d.bin`` holds slots shard * per_shard onward, ``stride`` bytes each, ids in the width that
    ``vocabulary`` asks for, low byte first. The manifest has shard, first_slot, n_sequences, n_docs (end marks),
    n_ids (neither end marks nor padding), stride, sha256 and file.

    ``ids_col`` names a column of array<int>; without it the ids are the bytes of ``text_col``. ``docs`` is a
    table, or anything else that has the same rows in the same partitions when read again; where it has not, the
    manifest would not add up, and this raises, as it does for a null among the ids or an id outside the
    vocabulary. Every row is written, repeated rows each; a null or empty text or list is an end mark alone; null
    ids come first. Other columns take no part. ``folder`` is a URI that executors can write to; what it
    holds already is left alone. An empty table writes no shard.
    """
    spark: SparkSession = docs.sparkSession
    run = f"{folder}/run-{uuid.uuid4().hex}"
    ids = whole(F.col(text_col)).cast("binary") if ids_col is None else F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>"))
    size = (F.octet_length(ids) if ids_col is None else F.size(ids)).cast("long") + 1
    sums = docs.select(F.spark_partition_id().alias("p"), size.alias("n")).groupBy("p").agg(F.ceil(F.sum("n") / length).alias("s"))
    firsts = checkpoint(sums.select("p", "s", F.sum("s").over(Window.orderBy("p")).alias("upto")))
    total = firsts.agg(F.max("upto")).first()[0] or 0
    stride = length * width(vocabulary).itemsize
    rows = docs.select(F.spark_partition_id().alias("p"), F.col(id_col).alias("_id"), F.xxhash64(ids).alias("_h"), ids.alias("_t"))
    # One row of two numbers a partition of the input: a fixed, small size however much the partitions hold.
    rows = rows.join(F.broadcast(firsts.select("p", (F.col("upto") - F.col("s")).alias("_first"))), "p")
    rows = rows.sortWithinPartitions("_id", "_h").select("_first", "_t")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        if (one := next(batches, None)) is None:
            return
        index = one.column(0)[0].as_py()
        for cut in _stream(chain([one], batches), length, vocabulary):
            slot = slot_of(np.arange(index, index + len(cut)), total, key)
            index += len(cut)
            held = pa.FixedSizeBinaryArray.from_buffers(pa.binary(stride), len(cut), [None, pa.py_buffer(np.ascontiguousarray(cut))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(slot // per_shard), pa.array(slot), held], names=["shard", "slot", "ids"])

    placed = rows.mapInArrow(place, "shard long, slot long, ids binary")
    shards = max(1, -(-total // per_shard))
    # The session's parallelism, and no more than 16 shards (128 MB as set here) to a task however much there is.
    tasks = max(-(-shards // 16), min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # Tasks take neighbouring shards, as many as the others to within one: ranges of slots known beforehand, so
    # nothing is sampled and no task is hashed more than its share. One shuffle, then a sort inside the task.
    dealt = placed.repartitionById(tasks, F.expr(f"cast(shard * {tasks} div {shards} as int)")).sortWithinPartitions("slot")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        for shard, pieces in groupby(_shard_pieces(batches), key=itemgetter(0)):
            store, root = fs.FileSystem.from_uri(_uri(run))
            store.create_dir(root, recursive=True)
            name = posixpath.join(root, f"_{shard:08d}-{uuid.uuid4().hex}.tmp")
            digest, n, n_docs, n_ids = hashlib.sha256(), 0, 0, 0
            with store.open_output_stream(name) as out:
                for _, raw in pieces:
                    out.write(raw)
                    digest.update(raw)
                    ids = np.frombuffer(raw, width(vocabulary))
                    n += len(raw) // stride
                    n_docs += int(np.count_nonzero(ids == vocabulary))
                    n_ids += int(np.count_nonzero(ids < vocabulary))
            file = f"shard-{shard:08d}.bin"
            to = posixpath.join(root, file)
            # Another attempt of this task may have been first: its file is the same.
            store.move(name, to) if store.get_file_info(to).type == fs.FileType.NotFound else store.delete_file(name)
            done.append({"shard": shard, "first_slot": shard * per_shard, "n_sequences": n, "n_docs": n_docs, "n_ids": n_ids, "stride": stride, "sha256": digest.hexdigest(), "file": f"{run}/{file}"})
        if done:
            yield pa.RecordBatch.from_pylist(done)

    manifest = checkpoint(dealt.mapInArrow(write, "shard long, first_slot long, n_sequences long, n_docs long, n_ids long, stride long, sha256 string, file string"))
    wrong = manifest.filter(F.col("n_sequences") != F.least(F.lit(per_shard), F.lit(total) - F.col("first_slot"))).count()
    if wrong or manifest.count() != -(-total // per_shard):
        raise RuntimeError(f"{wrong} shards do not hold what their slots ask for: docs changed between two reads")
    return manifest


def _shard_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    """(shard, bytes of neighbouring slots) from rows sorted by slot."""
    for batch in batches:
        shard = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], 1 + np.flatnonzero(np.diff(shard)), [len(shard)]])
        for a, b in zip(cuts, cuts[1:]):
            for at in range(a, b, ROWS):
                yield int(shard[a]), b"".join(batch.column(2).slice(at, min(ROWS, b - at)).to_pylist())


def read_slots(run: str, first: int, count: int, length: int = LENGTH, per_shard: int = SHARD, vocabulary: int = BYTES) -> Iterator[np.ndarray]:
    """Sequences from slot ``first`` on, by seeking in the files of a run: what a trainer does after a restart."""
    store, root = fs.FileSystem.from_uri(_uri(run))
    kind, slot = width(vocabulary), first
    stride = length * kind.itemsize
    while slot < first + count:
        path = posixpath.join(root, f"shard-{slot // per_shard:08d}.bin")
        if store.get_file_info(path).type == fs.FileType.NotFound:
            return  # beyond the last slot
        with store.open_input_file(path) as f:
            f.seek((slot % per_shard) * stride)
            for _ in range(min(first + count - slot, per_shard - slot % per_shard)):
                raw = f.read(stride)
                if not raw:
                    return
                yield np.frombuffer(raw, kind)
                slot += 1
