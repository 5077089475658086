import random
import string

import numpy as np
import pytest

from quern.llm import decontaminate as D
from quern.llm import tokens

SCHEMA = "item_id long, text string, doc_id string, shared int"


def items(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def brute(docs, bench, size=5, threshold=0.8):
    table = str.maketrans(string.punctuation, " " * len(string.punctuation))
    sh = lambda t: set(D.word_shingles((t or "").lower().translate(table).encode().split(), size))
    out = set()
    own = [(i, sh(t)) for i, t in bench]
    for d, t in docs:
        has = sh(t)
        for i, s in own:
            if s and len(s & has) >= threshold * len(s) - 1e-9:
                out.add((d, i, len(s), len(s & has)))
    return out


def test_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert want
    found = {(r.doc_id, r.item_id, r.item_shingles, r.shared) for r in D.find_leaks(docs, bench).collect()}
    assert found == want
    small_blocks = {(r.doc_id, r.item_id, r.item_shingles, r.shared) for r in D.find_leaks(docs, bench, block_bytes=2000).collect()}
    assert small_blocks == want
    clean = {r.doc_id for r in D.drop_leaks(docs, bench).collect()}
    assert clean == {r.doc_id for r in docs.collect()} - {d for d, *_ in want}


def test_short_item_in_a_long_document(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices(string.ascii_lowercase, k=6))
    item = [word() for _ in range(25)]
    noise = [word() for _ in range(40_000)]
    hurt = item.copy()
    hurt[12] = "changed"  # 5 of 21 shingles go, so 16 are left: under 0.8
    edge = item.copy()
    edge[0] = "changed"  # 1 goes
    text = lambda w: " ".join(noise[:20_000] + w + noise[20_000:])
    docs = spark.createDataFrame([(1, text(item)), (2, text(hurt)), (3, text(edge)), (4, text(item).upper().replace(" ", ", "))], "doc_id long, text string")
    found = {(r.doc_id, r.shared) for r in D.find_leaks(docs, items(spark, [(7, " ".join(item))])).collect()}
    assert found == {(1, 21), (3, 20), (4, 21)}


def test_oddities(spark, odd_docs, no_docs):
    bench = items(spark, [(1, "quick brown fox jumps over the lazy"), (2, None), (3, ""), (4, "word"), (5, "word word word word word"), (None, "fox jumps over the lazy"), (1, "nothing like it at all here")])
    rows = D.find_leaks(odd_docs, bench).collect()
    hits = {(r.doc_id, r.item_id) for r in rows}
    assert hits == {(d, i) for d in (1, 2, 8, None) for i in (1, None)} | {(6, 4), (7, 5)}
    assert sum(r.doc_id == 2 for r in rows) == 4  # a repeated row has rows of its own
    kept = D.drop_leaks(odd_docs, bench)
    assert kept.schema == odd_docs.schema and {r.doc_id for r in kept.collect()} == {3, 4, 5, 9}
    assert D.find_leaks(no_docs, bench).count() == 0
    assert D.find_leaks(odd_docs, items(spark, [])).count() == 0
    assert D.drop_leaks(odd_docs, items(spark, [])).count() == odd_docs.count()


@pytest.mark.parametrize("size", range(1, 120))
def test_sketch_cannot_miss(size):
    """More sketch hashes than an item may lack."""
    words = [f"w{k}".encode() for k in range(size + 4)]
    index = D.Index([(1, b" ".join(words))], 5, 0.8)
    lacking = size - int(np.ceil(0.8 * size - 1e-9))
    assert len(index.keys) > lacking or len(index.keys) == size


def test_shingles_do_not_depend_on_the_batch():
    a = tokens.split([b"a b c d e f", b"", b"x", b"p q"])
    h, made = tokens.shingles(tokens.hashes(a[0]), a[1], 5)
    assert made.tolist() == [2, 0, 1, 1]
    one, _ = tokens.shingles(tokens.hashes([b"x"]), np.array([1]), 5)
    assert h[2] == one[0]
