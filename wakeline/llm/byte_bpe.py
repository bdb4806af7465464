"""Byte-level BPE encoding and decoding by the ranks of a public vocabulary file.

A pattern cuts the text into pieces; a piece's bytes are merged pair by pair, the lowest rank first
and the leftmost of equals. A segment tree over the byte positions holds, at every node, the least
(rank, position) below it, so the root names the next merge; a merge changes the pairs of the merged
symbol and of its live neighbours, which are three point updates of logarithmic cost. Decoding
concatenates the bytes of the ids.

Rows never move: every partition encodes its own documents. A worker remembers the ids of short
pieces and of the text between two lone spaces in two bounded generations, as operator 10 does; that
changes no result. The vocabulary (under a MB, a fixed file) is read on the driver and broadcast.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm import bpe
from wakeline.llm.bpe import ROWS, Memo
from wakeline.llm.text import whole

#: A key from here on belongs to no pair: the pair at this position is gone or not in the vocabulary.
NONE = 1 << 61
#: Positions beyond which a tree is packed into eight bytes a node.
PACKED = 4096


class PairTree:
    """A segment tree over the positions of pairs: every node holds the least rank << 32 | position below it."""

    def __init__(self, keys: list[int]) -> None:
        self.size = size = 1 << (len(keys) - 1).bit_length()
        nodes = [NONE] * size + keys + [NONE] * (size - len(keys))
        for node in range(size - 1, 0, -1):
            a, b = nodes[2 * node], nodes[2 * node + 1]
            nodes[node] = a if a < b else b
        self.nodes = array("q", nodes) if len(keys) > PACKED else nodes

    def update(self, changed: tuple[tuple[int, int], ...]) -> int:
        """Point updates: the key at each position, and the nodes above it up to the first that stays as it is; then the least key of all."""
        nodes, size = self.nodes, self.size
        for at, least in changed:
            node = size + at
            nodes[node] = least
            while node > 1:
                other = nodes[node ^ 1]
                node >>= 1
                if other < least:
                    least = other
                if nodes[node] == least:
                    break
                nodes[node] = least
        return nodes[1]


class Known(Memo):
    """Operator 10's memo with room for pieces and chunks together."""

    def __missing__(self, key: str) -> tuple[int, ...]:
        if (known := self.old.get(key)) is None:
            known = self.make(key)
        if len(key) <= 64:
            if len(self) >= 2 * bpe.CACHE:
                self.old = dict(self)
                self.clear()
            self[key] = known
        return known


class ByteBpe:
    """Encoder and decoder of one file of base64 byte strings and ranks, with the pattern that cuts pieces."""

    def __init__(self, lines: bytes, pattern: str) -> None:
        self.ranks: dict[bytes, int] = {}
        for line in lines.splitlines():
            if line.strip():
                token, rank = line.split()
                self.ranks[base64.b64decode(token)] = int(rank)
        self.bytes = [b""] * (1 + max(self.ranks.values()))
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.pairs = [NONE if (r := self.ranks.get(bytes([a, b]))) is None else r << 32 for a in range(256) for b in range(256)]
        self.pieces = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}"), regex.V1)
        # A space between two other characters than white space opens a piece whatever stands around it.
        self.lone = regex.compile(r"(?<!\p{White_Space}) (?=\P{White_Space})", regex.V1)
        self.known = Known(self.chunk)  # pieces and chunks alike: a chunk of one piece is that piece

    def merge(self, piece: str) -> tuple[int, ...]:
        """The ids of one piece."""
        raw = piece.encode()
        rank_of = self.ranks.get
        if (known := rank_of(raw)) is not None:
            return (known,)  # a piece that is a token is that token, as in the library
        n = len(raw)
        ids, ends, before = [*map(self.single.__getitem__, raw)], [*range(1, n + 1)], [*range(-1, n)]  # of the symbol that starts at a position
        pairs = self.pairs
        tree = PairTree([*[pairs[a << 8 | b] | at for at, (a, b) in enumerate(zip(raw, raw[1:]))], NONE])
        top = tree.nodes[1]
        while top < NONE:
            i = top & 0xFFFFFFFF
            ids[i] = top >> 32  # a merged symbol's id is its rank
            j = ends[i]
            ids[j] = -1
            ends[i] = k = ends[j]
            before[k] = i
            own = rank_of(raw[i : ends[k]]) if k < n else None
            changed = (i, NONE if own is None else own << 32 | i), (j, NONE)
            if (h := before[i]) >= 0:
                own = rank_of(raw[h:k])
                changed = (h, NONE if own is None else own << 32 | h), *changed
            top = tree.update(changed)
        return tuple([x for x in ids if x >= 0])

    def chunk(self, text: str) -> tuple[int, ...]:
        """The ids of what stands between two lone spaces, with the space before it."""
        pieces = self.pieces.findall(text)
        return self.merge(text) if len(pieces) == 1 else tuple(chain.from_iterable(map(self.known.__getitem__, pieces)))

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text; strings of special tokens are ordinary text."""
        parts = self.lone.split(text) if CROWDED.search(text) else text.split(" ")
        chunks = [" " + p for p in parts]
        chunks[0] = parts[0]
        return np.fromiter(chain.from_iterable(map(self.known.__getitem__, chunks)), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


#: A space beside white space, where cutting at every space would cut a piece.
CROWDED = re.compile(r" \s|\s ")
_LOADED: dict[int, ByteBpe] = {}


def _loaded(shared) -> ByteBpe:
    lines, pattern = shared.value
    key = hash((lines, pattern))
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBpe(lines, pattern)
    return _LOADED[key]


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, keys: dict[str, Column], text: Column, decoded: bool = True) -> DataFrame:
    """The key columns, ``ids`` (array<int>) and, if asked for, ``decoded`` (binary) of every row.

    ``vocabulary`` is the path of a rank file that the driver can read, ``pattern`` what cuts pieces and
    covers every character. Null text is empty and gives no ids and no bytes; repeated rows are encoded
    each for itself; texts and pieces of any length are encoded whole. Other columns of ``docs``, whatever
    their names, take no part. Empty tables give no rows. Letters and digits are those of the ``regex``
    package's Unicode version, which may know code points that the library's does not yet.
    """
    spark: SparkSession = docs.sparkSession
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast((f.read(), pattern))
    rows = docs.select(*[c.alias(k) for k, c in keys.items()], whole(text).alias("_text"))
    more = {"ids": F.array(F.lit(0))} | ({"decoded": F.lit(b"")} if decoded else {})
    schema = rows.drop("_text").withColumns(more).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _loaded(shared)
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, ROWS):
                batch = whole_batch.slice(at, ROWS)
                each = [coder.encode(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
                ends = np.zeros(len(each) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in each], out=ends[1:])
                out = [*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(each)))]
                if decoded:
                    out.append(pa.array([coder.decode(x) for x in each], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return rows.mapInArrow(run, schema)
