import hashlib

from pyspark.sql import functions as F

from quern.llm import exact_dedup


def by_id(rows):
    return {r.doc_id: r for r in rows}


def test_groups_of_equal_texts(odd_docs):
    rows = exact_dedup.mark_duplicates(odd_docs, keep="max").collect()
    assert len(rows) == odd_docs.count()
    prose = [r for r in rows if r.doc_id in (1, 2, None)]
    assert {r.keep_id for r in prose} == {2} and {r.group_size for r in prose} == {4}
    assert sorted(r.kept for r in prose) == [False, False, True, True]
    found = by_id(rows)
    assert found[3].keep_id == found[4].keep_id == 4 and found[3].group_size == 2  # null is empty
    assert found[3].text_sha256 == hashlib.sha256(b"").hexdigest()
    assert found[5].kept and found[9].kept


def test_smallest_id_stays_by_default(odd_docs):
    assert by_id(exact_dedup.mark_duplicates(odd_docs).collect())[2].keep_id == 1


def test_collisions_stay_apart(odd_docs):
    want = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.mark_duplicates(odd_docs).collect()}
    poor = exact_dedup.mark_duplicates(odd_docs, hash_of=lambda t: F.lit(b"x"))
    assert {(r.doc_id, r.keep_id, r.group_size) for r in poor.collect()} == want


def test_empty_table(no_docs):
    assert exact_dedup.mark_duplicates(no_docs).count() == 0
    assert exact_dedup.drop_duplicates(no_docs).count() == 0


def test_stage_keeps_rows_and_columns(odd_docs):
    kept = exact_dedup.drop_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and kept.schema.simpleString() == odd_docs.schema.simpleString()
    rows = kept.collect()
    assert sorted((r.doc_id for r in rows if r.doc_id is not None)) == [1, 3, 5, 6, 7, 8, 9]
    assert by_id(rows)[3].text is None  # as it came in
    assert by_id(rows)[7].text == "word " * 50_000 and by_id(rows)[1].hash == "h"


def test_against_brute_force(docs_small):
    docs = docs_small.select("doc_id", "text").collect()
    best = {}
    for r in docs:
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    rows = exact_dedup.mark_duplicates(docs_small, keep="max").collect()
    assert {r.doc_id: r.keep_id for r in rows} == {r.doc_id: best[r.text] for r in docs}
