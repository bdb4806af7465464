"""Operator 13 against a plain tree, the monoid in any order of merging, and odd tables."""

import hashlib
import random
import zlib

import pytest

from wakeline.llm import manifest


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def low(t):
    return None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def plain_leaf(r):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))


def plain_tree(nodes):
    """The root, and every leaf's siblings (left, right) on the way up."""
    proofs, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for proof, at in zip(proofs, own):
            run = runs[at // 16]
            proof.append(("".join(run[: at % 16]), "".join(run[at % 16 + 1 :])))
        nodes, own = [digest("".join(r)) for r in runs], [a // 16 for a in own]
    return nodes[0], proofs


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    groups = [sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r))) for s in sorted(by, key=lambda s: (s is not None, (s or "").encode()))]
    trees = [plain_tree([plain_leaf(r) for r in g]) for g in groups]
    root, above = plain_tree([t[0] for t in trees]) if trees else (None, [])
    out = []
    for g, (sub, below), up in zip(groups, trees, above):
        for r, proof in zip(g, below):
            d = plain_leaf((*r[:4], low(r[4])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r)
            for a, b in proof + up:
                d = digest(a + d + b)
            out.append((r[0], plain_leaf(r), sub, root, digest("".join(a + b for a, b in proof + up)), d, d == root))
    return out


def table(spark, rows):
    names = "doc_id long, source string, lang string, n_chars long, text string, grp string, digest string, steps int, level string, p int, idx int"
    return spark.createDataFrame([(*r, "a", "b", 1, "z", 0, 0) for r in rows], names)


def same(spark, rows, parts=5):
    order = lambda r: tuple(map(str, r))
    got = [tuple(r) for r in manifest.manifest(table(spark, rows).repartition(parts)).collect()]
    return sorted(got, key=order) == sorted(plain(rows), key=order)


def odd_rows():
    """One hot source, many small ones, null and empty ones; null ids and texts; repeated rows and ids."""
    rng = random.Random(2)
    rows = [(i if i % 50 else None, rng.choice(["hot"] * 6 + [None, "", "é", "Z"] + [f"s{rng.randrange(300)}"]), None if i % 11 == 0 else "en", i, f"Text {i}" if i % 7 else None) for i in range(3000)]
    return [*rows, *[(5, "hot", "en", 5, "same")] * 100, (5, "hot", "en", 5, ""), (6, "long", "en", 1, "Word " * 100_000)]


def test_like_a_plain_tree(spark):
    assert same(spark, odd_rows())


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 257])
def test_sizes(spark, n):
    assert same(spark, [(i, "x", "en", 1, "T") for i in range(n)], 3)


def test_merges_in_any_order():
    """Fragments of pieces of one group, merged in any order, close the same runs."""
    rng = random.Random(4)
    for total in (1, 2, 15, 16, 17, 31, 255, 256, 257, 300):
        leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(total)]
        want = None
        for _ in range(6):
            closed = {}
            fragment = manifest.Fragment(total, lambda lv, i, d, c: closed.__setitem__((lv, i), (d, c)))
            for i in rng.sample(range(total), total):
                fragment.add(0, i, leaves[i])
            assert len(fragment.open) == 1
            result = closed, fragment.open
            assert want is None or result == want
            want = result
        unknown = {}
        fragment = manifest.Fragment(None, lambda lv, i, d, c: unknown.__setitem__((lv, i), (d, c)))
        for i in range(total):
            fragment.add(0, i, leaves[i])
        fragment.settle(total)
        assert (unknown, fragment.open) == want


def test_open_nodes_are_bounded():
    """A part of a long run of leaves keeps fewer than 2 * ARITY open nodes a level."""
    fragment = manifest.Fragment(10**9, lambda *a: None)
    for i in range(1_000_003, 1_020_005):
        fragment.add(0, i, b"x" * 32)
    levels = [lv for lv, _ in fragment.open]
    assert max(levels.count(lv) for lv in set(levels)) < 2 * manifest.ARITY and len(fragment.have) <= 2 * (max(levels) + 1)


def test_tampering_is_found(spark):
    rows = [(i, "x", "en", 1, "TEXT") for i in range(100)]
    got = {r.doc_id: r.verified for r in manifest.manifest(table(spark, rows)).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 != 0 for i in range(100)}
    assert all(r.verified for r in manifest.manifest(table(spark, [(i, "x", "en", 1, "text") for i in range(100)])).collect())
