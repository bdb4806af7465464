"""Operator 11 against the public library, brute-force merging and exact round trips."""

import hashlib
import random

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from tests.llm.test_llm import docs, empty, odd  # noqa: F401
from wakeline.llm import bpe, byte_bpe
from wakeline.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def own():
    with open(PATH, "rb") as f:
        return byte_bpe.ByteBpe(f.read(), public_tokenizers.PATTERN)


def library(coder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def test_like_the_library():
    coder = own()
    lib, rng = library(coder), random.Random(11)
    pool = "aAbBsStTéÉÑßẞΣσςİıǅ̈  \t\n\r\x1c\x85 ​'’019٣½日本가🙂👨.,!?-_<|>กำ"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["", " ", "  ", " a", "a ", "a  b", "a \n b", "\n\na", "I'll we've DON'T", "a<|endoftext|>b", "x" * 5000, "ab" * 6000, "aaab" * 2000, "\x00\x01", "word " * 50]
    for t in texts:
        ids = coder.encode(t)
        assert ids.tolist() == lib.encode_ordinary(t), t
        assert coder.decode(ids) == t.encode()


def test_pair_tree():
    """The least key after any updates, beyond the packed size too, is the least of a plain list."""
    rng = random.Random(3)
    for n in (1, 2, 3, 7, 8, 9, 100, byte_bpe.PACKED + 5):
        keys = [rng.choice([byte_bpe.NONE, rng.randrange(9)]) << 1 for _ in range(n)]
        tree = byte_bpe.PairTree(list(keys))
        assert tree.nodes[1] == min(keys)
        for _ in range(60):
            changed = tuple((rng.randrange(n), rng.randrange(20)) for _ in range(rng.randint(1, 3)))
            for at, key in changed:
                keys[at] = key
            assert tree.update(changed) == min(keys)


def plain_merge(raw, ranks):
    """The leftmost pair of the least rank, again and again, over a list of byte strings."""
    parts = [raw[i : i + 1] for i in range(len(raw))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return tuple(ranks[p] for p in parts)
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merges_by_brute_force():
    coder, rng = own(), random.Random(8)
    for _ in range(300):
        piece = "".join(rng.choice("etaoin shrdlé🙂") for _ in range(rng.randint(1, 40)))
        raw = piece.encode()
        assert coder.merge(piece) == ((coder.ranks[raw],) if raw in coder.ranks else plain_merge(raw, coder.ranks))


def test_memo_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 2)
    coder = own()
    lib = library(coder)
    text = "the quick brown fox, the lazy dog;\nthe end. " * 5
    assert coder.encode(text).tolist() == lib.encode_ordinary(text)
    assert len(coder.known) <= 4 and len(coder.known.old) <= 4


def test_query(spark, sf_dir):
    lib = library(own())
    got = {r.doc_id: r for r in QUERIES["op11_byte_bpe"](spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = lib.encode_ordinary(r.text or "")
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == want


def test_odd_rows(spark, odd, empty):  # noqa: F811
    def run(d):
        return byte_bpe.encode_decode(d, PATH, public_tokenizers.PATTERN, {"doc_id": F.col("doc_id")}, F.col("text"))

    got = run(odd).collect()
    assert len(got) == odd.count()
    assert sorted(bytes(r.decoded) for r in got) == sorted((r.text or "").encode() for r in odd.collect())
    assert all(r.ids == [] for r in got if r.doc_id in (1, 2))
    assert run(empty).count() == 0
    assert run(odd).columns == ["doc_id", "ids", "decoded"]
