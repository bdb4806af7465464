"""BPE encoding and decoding over a public vocabulary file.

A pre-token's symbols form a doubly linked list; a priority queue holds the merge rank of every
neighbouring pair and hands out the lowest, leftmost first. Entries whose pair has changed
meanwhile are stale and skipped. Decoding concatenates vocabulary strings.

Rows never move: every partition encodes its own documents. Each worker remembers the ids of the
pieces and pre-tokens it has met lately, in two generations of at most CACHE entries; that bounds
memory and changes no result. The vocabulary (a few MB, a fixed file) is read on the driver and broadcast.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm.text import whole

CACHE = 1 << 18
#: Documents in one Arrow batch that a worker returns.
ROWS = 256


def _byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable bytes
    stand for themselves, the others take the characters from 256 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b if b in printable else next(other)) for b in range(256)]


class Memo(dict):
    """Results of ``make`` by string: a young generation, and the one before it."""

    def __init__(self, make) -> None:
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> tuple[int, ...]:
        if (known := self.old.get(key)) is None:
            known = self.make(key)
        if len(key) <= 64:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[key] = known
        return known

    def forget(self) -> None:
        self.old = {}
        self.clear()


class Bpe:
    """Encoder and decoder of one vocabulary file: BPE with byte-level symbols and a word-end suffix."""

    def __init__(self, spec: str) -> None:
        made = json.loads(spec)
        model = made["model"]
        if model["type"] != "BPE" or made.get("decoder") is not None:
            raise ValueError("only BPE files without a decoder of their own are supported")
        self.suffix: str = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.strings = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for s, i in [*vocab.items(), *self.special.items()]:
            self.strings[i] = s
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        self.ranks = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.merged = [vocab[a + b] for a, b in pairs]
        alphabet = _byte_alphabet()
        self.inner = [vocab[c] for c in alphabet]
        self.last = [vocab[c + self.suffix] for c in alphabet]
        pattern = made["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"), regex.V1)
        self.spaces = regex.compile(r"\p{White_Space}+", regex.V1)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words, self.chunks = Memo(self.merge), Memo(self.piece)

    def merge(self, word: str) -> tuple[int, ...]:
        """The ids of one pre-token."""
        raw = word.encode()
        n = len(raw)
        ids = [*map(self.inner.__getitem__, raw)]
        ids[-1] = self.last[raw[-1]]
        rank_of, merged = self.ranks.get, self.merged
        # An entry is rank * 2^32 + place, so the lowest rank comes first and equal ranks go left to right.
        queue = [r << 32 | i for i, r in enumerate(map(rank_of, zip(ids, ids[1:]))) if r is not None]
        if not queue:
            return tuple(ids)
        heapq.heapify(queue)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            top = pop(queue)
            i, rank = top & 0xFFFFFFFF, top >> 32
            j = after[i]
            if j < 0 or rank_of((ids[i], ids[j])) != rank:
                continue  # stale: one of the two symbols has been merged meanwhile
            ids[i] = new = merged[rank]
            ids[j] = -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank_of((new, ids[k]))) is not None:
                    push(queue, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := rank_of((ids[h], new))) is not None:
                push(queue, r << 32 | h)
        return tuple([x for x in ids if x >= 0])

    def piece(self, chunk: str) -> tuple[int, ...]:
        """The ids of a piece without white space."""
        # Each character is lower-cased for itself: no final-sigma rule.
        text = (chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk).replace("Σ", "σ")).lower()
        if text.isalpha():
            return self.words[text]  # letters only: one pre-token
        return tuple(chain.from_iterable(map(self.words.__getitem__, self.pieces.findall(text))))

    def _plain(self, text: str) -> Iterator[tuple[int, ...]]:
        # str.split() also splits at the four separators below, which are not white space here.
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
        return map(self.chunks.__getitem__, filter(None, self.spaces.split(text)) if odd else text.split())

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text; special tokens' strings in it give their ids."""
        if self.specials is None or not any(s in text for s in self.special):
            found = self._plain(text)
        else:
            found = chain.from_iterable([(self.special[part],)] if part in self.special else self._plain(part) for part in self.specials.split(text))
        return np.fromiter(chain.from_iterable(found), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The vocabulary strings of the ids; a file without a decoder puts one space between them."""
        return " ".join(map(self.strings.__getitem__, ids.tolist()))


_LOADED: dict[int, Bpe] = {}


def _loaded(shared) -> Bpe:
    spec = shared.value
    key = hash(spec)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Bpe(spec)
    return _LOADED[key]


def vocabulary_size(vocabulary: str) -> int:
    """Ids of the file at ``vocabulary``: all lie below this."""
    with open(vocabulary, encoding="utf-8") as f:
        return len(Bpe(f.read()).strings)


def encode_decode(docs: DataFrame, vocabulary: str, keys: dict[str, Column], text: Column, decoded: bool = True, keep: bool = True) -> DataFrame:
    """The key columns, ``ids`` (array<int>) and, if asked for, ``decoded`` (string) of every row.

    ``vocabulary`` is the path of a tokenizer file that the driver can read. Null text is empty and
    gives no ids and an empty string; repeated rows are encoded each for itself; texts of any length
    are encoded whole. Other columns of ``docs``, whatever their names, take no part. Unless ``keep``, a worker forgets at the
    end of a task what it remembers, so that later steps of a job do not run in workers that still hold it.
    """
    spark: SparkSession = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    rows = docs.select(*[c.alias(k) for k, c in keys.items()], whole(text).alias("_text"))
    more = {"ids": F.array(F.lit(0))} | ({"decoded": F.lit("")} if decoded else {})
    schema = rows.drop("_text").withColumns(more).schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(shared)
        try:
            for whole_batch in batches:
                for at in range(0, whole_batch.num_rows, ROWS):
                    batch = whole_batch.slice(at, ROWS)
                    each = [bpe.encode(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
                    ends = np.zeros(len(each) + 1, dtype=np.int32)
                    np.cumsum([len(x) for x in each], out=ends[1:])
                    out = [*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(each)))]
                    if decoded:
                        out.append(pa.array([bpe.decode(x) for x in each], pa.string()))
                    yield pa.RecordBatch.from_arrays(out, names=names)
        finally:
            if not keep:
                bpe.words.forget()
                bpe.chunks.forget()

    return rows.mapInArrow(run, schema)
