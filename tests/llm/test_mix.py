from fractions import Fraction

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from quern.llm import mix


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0.01, 100), min_size=1, max_size=12))
def test_deviation_stays_under_one_block(weights):
    parts, q = mix.shares({str(k): w for k, w in enumerate(weights)}, 200)
    assert sum(parts.values()) == q and min(parts.values()) >= 1
    slots = mix.period(parts, q)
    assert sorted(s for own in slots.values() for s in own) == list(range(q))
    for k, own in slots.items():
        assert len(own) == parts[k]
        done = set(own)
        n = 0
        for t in range(q):
            n += t in done
            assert abs(n - Fraction(parts[k] * (t + 1), q)) < 1


def brute(blocks, weights, resolution):
    """The whole schedule, slot by slot, with exhausted sources left out."""
    out, done = [], dict.fromkeys(blocks, 0)
    while True:
        left = {k for k in blocks if done[k] < blocks[k]}
        if not left:
            return out
        parts, q = mix.shares({k: weights[k] for k in left}, resolution)
        order = {s: k for k, own in mix.period(parts, q).items() for s in own}
        t = 0
        while all(done[k] < blocks[k] for k in left):
            k = order[t % q]
            out.append((k, done[k]))
            done[k] += 1
            t += 1


def expand(plan):
    out = {}
    for k, first, n, slot0, p, q, slots in plan:
        for j in range(n):
            out[slot0 + j // p * q + slots[j % p]] = (k, first + j)
    return [out[t] for t in sorted(out)], sorted(out) == list(range(len(out)))


@settings(max_examples=40, deadline=None)
@example({"a": (1, 0.25), "b": (1, 0.25), "c": (28, 6.0)})
@given(st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.integers(1, 60), st.floats(0.1, 9)), min_size=1))
def test_phases_against_brute_force(sources):
    blocks, weights = {k: v[0] for k, v in sources.items()}, {k: v[1] for k, v in sources.items()}
    got, dense = expand(mix.phases(blocks, weights, 20))
    assert dense and got == brute(blocks, weights, 20)


def test_rows_follow_the_schedule(spark, docs_small):
    rows = mix.interleave(docs_small, block_rows=4, resolution=100).collect()
    assert len(rows) == docs_small.count() == len({r.mix_position for r in rows})
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + 1
    blocks = {f"={k}": -(-n // 4) for k, n in sizes.items()}
    want = brute(blocks, {f"={k}": n**0.5 for k, n in sizes.items()}, 100)
    got = {}
    for r in rows:
        got.setdefault(r.mix_slot, set()).add(f"={r.source}")
    assert [got[t] for t in sorted(got)] == [{k} for k, _ in want]


def test_oddities(spark, odd_docs, no_docs):
    out = mix.interleave(odd_docs.withColumnRenamed("key", "mix_slot"), weights={"s": 3.0, None: 1.0}, block_rows=2)
    rows = out.collect()
    assert len(rows) == odd_docs.count() and len({r.mix_position for r in rows}) == len(rows)
    assert out.columns == [c for c in odd_docs.columns if c != "key"] + ["mix_slot", "mix_position"]
    assert mix.interleave(no_docs).count() == 0
    with pytest.raises(ValueError):
        mix.interleave(odd_docs, max_sources=1)


def test_a_given_weight_is_met(spark):
    docs = spark.range(9000).selectExpr("id as doc_id", "if(id % 3 = 0, 'a', 'b') as source", "'x' as text")
    rows = mix.interleave(docs, weights={"a": 0.25, "b": 0.75}, block_rows=10).orderBy("mix_position").limit(4000).collect()
    assert abs(sum(r.source == "a" for r in rows) - 1000) <= 10


def deviation(blocks, weights, order):
    """The furthest that any source is from its exact share, at any slot."""
    w = [Fraction(x) for x in weights]
    done, fluid, worst = [0] * len(w), [Fraction(0)] * len(w), Fraction(0)
    for k in order:
        left = Fraction(1)
        while left > 0 and (active := [i for i in range(len(w)) if fluid[i] < blocks[i]]):
            total = sum(w[i] for i in active)
            step = min(left / total, min((blocks[i] - fluid[i]) / w[i] for i in active))
            for i in active:
                fluid[i] += w[i] * step
            left -= step * total
        done[k] += 1
        worst = max(worst, max(abs(a - b) for a, b in zip(done, fluid, strict=True)))
    return worst


def ordered(blocks, weights):
    source, nth, slot = mix.schedule(np.array(blocks), np.array(weights))
    assert sorted(slot.tolist()) == list(range(sum(blocks)))
    order = source[np.argsort(slot)].tolist()
    for k in range(len(blocks)):
        assert nth[np.argsort(slot)][np.array(order) == k].tolist() == list(range(blocks[k]))
    return order


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.floats(0.001, 100)), min_size=1, max_size=8))
def test_schedule_follows_the_unrounded_weights(sources):
    blocks, weights = [n for n, _ in sources], [w for _, w in sources]
    assert deviation(blocks, weights, ordered(blocks, weights)) < 1 + 1e-5


def test_no_drift_over_a_long_schedule():
    """A third of the rows and 19 equal others: weights that parts of 1000 do not meet, and none that is small gets more."""
    blocks = [20_000] + [2_105] * 19
    order = np.array(ordered(blocks, [n**0.5 for n in blocks]))
    share = np.array([n**0.5 for n in blocks]) / sum(n**0.5 for n in blocks)
    done = np.cumsum(order[:40_000, None] == np.arange(20), axis=0)
    assert (np.abs(done - share * np.arange(1, 40_001)[:, None]) < 1 + 1e-5).all()
    order = np.array(ordered([5_000, 5], [0.9998, 0.0002]))
    assert abs((order[:4_000] == 1).sum() - 0.8) < 1


def test_any_number_of_sources(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "concat('s', id % 700) as source", "'x' as text")
    rows = mix.interleave(docs, block_rows=2).collect()
    assert len(rows) == 4000 == len({r.mix_position for r in rows}) and len({r.source for r in rows}) == 700
    assert {r.mix_slot for r in rows} == set(range(700 * 3))
    assert len({(r.mix_slot, r.source) for r in rows}) == 700 * 3
