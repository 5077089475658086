import math
import zlib
from collections import Counter

import numpy as np
import pytest

from quern.llm import ngram_lm as L
from quern.llm import queries


def words(t):
    return (t or "").encode().lower().split() + [L.END]


def test_levels():
    assert L.levels(np.array([1, 2, 3, 4, 7, 8, 1000])).tolist() == [1, 2, 2, 3, 3, 4, 10]


def small(docs, **k):
    return L.train(docs, filter_bits=1 << 22, **k)


@pytest.mark.parametrize("head", [0, 50, 1 << 18])
def test_base_score_is_exact(spark, docs_small, head):
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    docs = {r.doc_id: r.text for r in docs_small.collect()}
    seen = Counter(w for i, t in docs.items() if not held(i) for w in words(t))
    n, v = sum(seen.values()), len(seen)
    model, table = small(docs_small.filter(~L.is_held_out(docs_small.doc_id)), head_words=head)
    rows = L.score(docs_small, model, table).collect()
    assert len(rows) == len(docs)
    for r in rows:
        own = words(docs[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(w in seen for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((seen[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), rel_tol=1e-9)


def test_filter_holds_every_count_at_its_level(spark, docs_small):
    model, _ = small(docs_small)
    seen, pairs = Counter(), Counter()
    for r in docs_small.collect():
        own = words(r.text)
        seen.update(own)
        pairs.update(zip([L.END, *own], own, strict=False))
    h = L.tokens.hashes(list(seen))
    want = L.level_count(L.levels(np.array(list(seen.values()))))
    got = model.counts(h)
    assert (got >= want).all() and (got == want).mean() > 0.97
    a, b = (L.tokens.hashes([p[k] for p in pairs]) for k in (0, 1))
    got = model.counts(L.tokens.mix(a * L._PAIR + b + np.uint64(1)))
    want = L.level_count(L.levels(np.array(list(pairs.values()))))
    assert (got >= want).all() and (got == want).mean() > 0.97
    assert L.false_positive_rate(model) < 0.05


def test_score_against_exact_counts(spark, docs_small):
    """With a filter large enough the score is that of the quantised counts."""
    model, table = L.train(docs_small, filter_bits=1 << 27)
    seen, pairs = Counter(), Counter()
    docs = {r.doc_id: r.text for r in docs_small.collect()}
    for t in docs.values():
        own = words(t)
        seen.update(own)
        pairs.update(zip([L.END, *own], own, strict=False))
    q = lambda c: float(L.level_count(L.levels(np.array([c])))[0]) if c else 0.0
    n, v = sum(seen.values()), len(seen)
    for r in L.score(docs_small, model, table).collect():
        own, want = words(docs[r.doc_id]), 0.0
        for a, b in zip([L.END, *own], own, strict=False):
            alone = (q(seen[b]) + 0.5) / (n + 0.5 * (v + 1))
            want += math.log10(0.7 * min(q(pairs[a, b]), q(seen[a])) / q(seen[a]) + 0.3 * alone)
        assert math.isclose(r.score, want, rel_tol=0.01)


def test_pairs_help(spark):
    rows = [r for r in queries.op5_lm_score(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_oddities(spark, odd_docs, no_docs):
    model, table = small(odd_docs)
    rows = L.score(odd_docs, model, table).collect()
    assert len(rows) == odd_docs.count()
    found = {r.doc_id: r for r in rows}
    assert found[3].n_tokens == found[4].n_tokens == found[5].n_tokens == 1 and found[7].n_tokens == 50_001
    assert found[3].base_score == found[4].base_score and all(r.n_known == r.n_tokens for r in rows)
    empty, table = small(no_docs)
    assert L.score(no_docs, empty, table).count() == 0
    rows = L.score(odd_docs, empty, table).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in rows)


def test_filter_grows_with_the_entries(spark, docs_small):
    """Sized by what was counted, with one rate of false positives; explicit sizes stay possible."""
    model, _ = L.train(docs_small)
    large = docs_small.selectExpr("doc_id", "concat_ws(' ', transform(split(text, ' '), w -> concat(w, doc_id % 50))) as text")
    more, _ = L.train(large.unionByName(docs_small.select("doc_id", "text")))
    assert len(more.bits) > 1.2 * len(model.bits)
    for m in (model, more):
        assert 0.001 < L.false_positive_rate(m) < 0.02


def test_a_full_filter_is_probed_to_its_highest_level_only(spark, odd_docs):
    model, table = L.train(odd_docs, filter_bits=1)  # one word a segment
    model.bits[:] = np.uint64(2**64 - 1)
    assert (model.counts(np.arange(5, dtype=np.uint64)) == L.level_count(np.array([model.highest]))[0]).all()
    assert all(math.isfinite(r.score) for r in L.score(odd_docs, model, table).collect())


@pytest.mark.parametrize("name", ["docs_small", "odd_docs", "no_docs"])
def test_segments_score_like_the_broadcast_filter(spark, request, name):
    docs = request.getfixturevalue(name)
    seen = docs.filter(~L.is_held_out(docs.doc_id))
    one, two = (sorted(map(tuple, L.score(docs, *L.train(seen, **k)).collect()), key=str) for k in ({}, {"broadcast_bits": 0}))
    assert L.train(seen, broadcast_bits=-1)[0].bits is None
    assert len(one) == len(two) == docs.count()
    for a, b in zip(one, two, strict=True):
        assert a[:4] == b[:4] and np.allclose(a[4:], b[4:], rtol=1e-9)


@pytest.mark.parametrize("name", ["docs_small", "odd_docs", "no_docs"])
def test_one_exchange_scores_like_train_and_score(spark, request, name):
    docs = request.getfixturevalue(name)
    learn = ~L.is_held_out(docs.doc_id)
    want, got = (sorted(map(tuple, x.collect()), key=str) for x in (L.score(docs, *L.train(docs.filter(learn))), L.train_and_score(docs, learn)))
    assert len(want) == len(got) == docs.count()
    for a, b in zip(want, got, strict=True):
        assert a[:4] == b[:4] and np.allclose(a[4:], b[4:], rtol=1e-9)


def test_one_exchange_with_more_segments(spark, docs_small, monkeypatch):
    """Beyond the least number of segments, which all tokens sent decide, not those learnt alone."""
    learn = ~L.is_held_out(docs_small.doc_id)
    monkeypatch.setattr(L, "SEGMENT_TOKENS", 170)
    model, table = L.train(docs_small.filter(learn))
    assert len(model.words) == 2 * L.SEGMENTS
    want, got = (sorted(map(tuple, x.collect())) for x in (L.score(docs_small, model, table), L.train_and_score(docs_small, learn)))
    assert [a[:4] for a in want] == [a[:4] for a in got] and np.allclose([a[4:] for a in want], [a[4:] for a in got], rtol=1e-9)
    sent, own = [], spark.sparkContext.broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value) or own(value))
    L.train_and_score(docs_small, L.F.lit(False))
    assert [len(x.words) for x in sent if isinstance(x, L.Filter)] == [2 * L.SEGMENTS]


def test_nothing_learnt_in_one_exchange(spark, odd_docs):
    rows = L.train_and_score(odd_docs, L.F.lit(False)).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in rows)


def test_the_query_neither_collects_nor_broadcasts_its_filter(spark, monkeypatch):
    """The filter's segments are filled and read in one exchange at every size, so the cost a GB does not jump where a broadcast ends."""
    monkeypatch.setattr(L, "train", None)
    monkeypatch.setattr(L, "_by_segment", None)
    sent, own = [], spark.sparkContext.broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value) or own(value))
    assert queries.op5_lm_score(spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert all(model.bits is None and model.stored is None for model in sent if isinstance(model, L.Filter))
