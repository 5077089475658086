import itertools
import random
import string

import numpy as np
import pytest

from quern.llm import near_dup as N
from quern.operators.graph import connected_components

SCHEMA = "doc_id long, text string, key string, h1 long, n long, kept boolean, component_id long, _gone long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, 2, True, 3, i) for i, t in rows], SCHEMA)


def sets_of(rows, size):
    out = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out.append((i, frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()))
    return out


def brute(rows, size, percent=80):
    own = [(i, s) for i, s in sets_of(rows, size) if i is not None]
    up = {i: i for i, _ in own}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, s), (b, t) in itertools.combinations(own, 2):
        if s and t and 100 * len(s & t) >= percent * len(s | t):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {i: find(i) for i, _ in own}


def mutate(rng, words, n):
    out = words.copy()
    for _ in range(n):
        out[rng.randrange(len(out))] = "".join(rng.choices(string.ascii_lowercase, k=5))
    return out


def corpus(seed=5):
    """Groups of near copies of every closeness, chains, shared passages, short texts and copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(string.ascii_lowercase, k=4))
    rows, k = [], itertools.count(1)
    passage = [word() for _ in range(60)]
    for _ in range(25):
        base = [word() for _ in range(rng.randrange(8, 200))]
        for n in (0, 0, 1, 2, 3, 5, 8, 12):
            rows.append((next(k), " ".join(mutate(rng, base, n))))
    chain = [word() for _ in range(100)]
    for _ in range(15):
        chain = mutate(rng, chain, 4)
        rows.append((next(k), " ".join(chain)))
    for _ in range(60):
        rows.append((next(k), " ".join(passage + [word() for _ in range(rng.randrange(5, 120))])))
    rows += [(next(k), t) for t in ("one", "one", "One", "one two", "two", "", None, "  ", "a b", "a b a b", "a b a b a b")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size", [2, 5])
def test_against_brute_force(spark, size):
    rows = corpus()
    got = {r.doc_id: r for r in N.near_duplicates(frame(spark, rows), shingle=size).collect()}
    want = brute(rows, size)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (i == want[i]) for i, r in got.items())
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets_of(rows, size)}


def test_pairs_that_only_a_third_document_hides(spark):
    """a-b and b-c are links; a, the smallest of every group, is no link of c."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choices(string.ascii_lowercase, k=6))
    a = [word() for _ in range(200)]
    b = a[:178] + [word() for _ in range(20)]
    c = [word() for _ in range(18)] + b[18:]
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c)), (4, " ".join(c + ["end"]))]
    got = {r.doc_id: r.component_id for r in N.near_duplicates(frame(spark, rows), shingle=2).collect()}
    assert got == brute(rows, 2)


def test_on_data(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r.component_id for r in N.near_duplicates(docs, shingle=2, broadcast_rows=0).collect()}
    assert got == brute(rows, 2)


def test_oddities(spark, odd_docs, no_docs):
    rows = N.near_duplicates(odd_docs, shingle=2).collect()
    assert len(rows) == odd_docs.count()
    got = {r.doc_id: r for r in rows}
    assert got[1].component_id == got[2].component_id == got[8].component_id == 1
    assert got[None].component_id is None and got[None].kept
    for i in (3, 4, 5):
        assert got[i].n_shingles == 0 and got[i].component_id == i and got[i].kept
    assert got[7].n_shingles == 1
    kept = N.keep_one(odd_docs, shingle=2)
    assert kept.schema == odd_docs.schema and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "5", "6", "7", "9", "None"]
    assert N.near_duplicates(no_docs).count() == 0 and N.keep_one(no_docs).count() == 0


def test_rows_that_share_an_id_are_linked(spark):
    t = ["alpha beta gamma delta epsilon zeta", "one two three four five six"]
    rows = [(1, t[0]), (2, t[0]), (2, t[1]), (5, t[1]), (9, "else")]
    got = {r.doc_id: r.component_id for r in N.near_duplicates(frame(spark, rows), shingle=2).collect()}
    assert got == {1: 1, 2: 1, 5: 1, 9: 9}


def test_pigeonhole_guarantee():
    """Signatures that differ in up to 27 of 112 values share a key."""
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = rng.integers(0, 2**32, N.VALUES, dtype=np.uint64)
        b = a.copy()
        at = rng.choice(N.VALUES, 27, replace=False)
        b[at] ^= np.uint64(1)
        assert np.intersect1d(*N.index_keys(np.stack([a, b]))).size
    # The hardest case: two in every chunk but one.
    b = a.copy().reshape(N.CHUNKS, N.WIDTH)
    b[:, :2] ^= np.uint64(1)
    b[0, 1] ^= np.uint64(1)
    assert np.intersect1d(*N.index_keys(np.stack([a, b.ravel()]))).size


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 400)] + [(1, k) for k in range(2, 60)] + [(70, 70)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(100, 401), 100), **dict.fromkeys(range(1, 60), 1), 70: 70}


@pytest.mark.parametrize(("size", "block"), [(2, 4), (5, 1024)])
def test_a_crowd_about_the_threshold(spark, size, block):
    """Copies of one text, about half of them just too far from it, with few kinds of changes, some in common."""
    rng = random.Random(11)
    base = ["".join(rng.choices(string.ascii_lowercase, k=4)) for _ in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 240):
        words = base.copy()
        if i % 3 == 0:
            words[: 6 + i % 5] = ["x"] * (6 + i % 5)
        for _ in range(rng.randrange(2, 14) * 2 // size):
            words[rng.randrange(len(words))] = rng.choice(["the", "of", "and"])
        rows.append((i, " ".join(words)))
    docs = frame(spark, rows)
    docs = docs.union(docs) if block == 4 else docs  # as when a table is read twice
    got = {r.doc_id: r.component_id for r in N.near_duplicates(docs, shingle=size, block=block, broadcast_rows=0 if block == 4 else 1_000_000).collect()}
    want = brute(rows, size)
    assert got == want
    assert len(set(want.values())) > 20
