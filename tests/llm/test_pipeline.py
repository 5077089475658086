import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline as P
from quern.llm import langid
from tests_brute import leaks, near_groups


def brute(rows, bench, model):
    """The documents that the first four stages keep, each by its definition."""
    found = model.predict([r.text.encode() if r.text is not None else None for r in rows])
    rows = [r for r, (lang, _, bits) in zip(rows, found, strict=True) if lang != "und" and bits < 8]
    first = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        first.setdefault(r.text, r)
    rows = list(first.values())
    group = near_groups([(r.doc_id, r.text) for r in rows], 5)
    rows = [r for r in rows if group[r.doc_id] == r.doc_id]
    dirty = leaks([(r.doc_id, r.text) for r in rows], bench)
    return {r.doc_id for r in rows if r.doc_id not in dirty}


def test_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = brute(docs.collect(), bench, langid.train(docs))
    out = P.run(spark, sf)
    rows = out.collect()
    assert {r.doc_id for r in rows} == want and len(rows) == len(want) < docs.count()
    assert out.columns == [*docs.columns, "mix_slot", "mix_position"]
    assert len({r.mix_position for r in rows}) == len(rows)
    text = {r.doc_id: r for r in docs.collect()}
    assert all((r.text, r.lang, r.source, r.n_chars) == (text[r.doc_id].text, text[r.doc_id].lang, text[r.doc_id].source, text[r.doc_id].n_chars) for r in rows)


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_the_columns(spark, odd_docs, no_docs, k):
    for docs in (odd_docs, no_docs):
        out = P.STAGES[k][1](spark, docs, "/root/testdata/sf0.001")
        assert out.schema == docs.schema
        assert out.count() <= docs.count()


def test_last_stage_drops_nothing(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        assert P.STAGES[4][1](spark, docs, "/root/testdata/sf0.001").count() == docs.count()


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 11))
