import math
import zlib

import numpy as np

from quern.llm import langid, queries


def brute_bits(samples, text, order):
    """PPM, method C, without exclusion, one byte at a time."""
    counts = {}
    for s in samples:
        data = bytes(order) + s
        for i in range(order, len(data)):
            for k in range(order + 1):
                at = counts.setdefault(data[i - k : i], {})
                at[data[i]] = at.get(data[i], 0) + 1
    data, bits = bytes(order) + text, 0.0
    for i in range(order, len(data)):
        for k in range(order, -2, -1):
            if k < 0:
                bits += 8
                break
            at = counts.get(data[i - k : i])
            if at is None:
                continue
            total = sum(at.values()) + len(at)
            if data[i] in at:
                bits -= math.log2(at[data[i]] / total)
                break
            bits -= math.log2(len(at) / total)
    return bits


SAMPLES = {"aa": [b"the cat sat on the mat", b"", b"that hat"], "bb": ["un été à la plage".encode(), b"le chat"], "cc": [b"x"]}


def test_code_lengths_against_brute_force():
    texts = [b"the chat", b"", b"zzzz", "été".encode(), b"x", b"the cat sat on the mat" * 20, bytes(range(256))]
    for order in (1, 2, 3, 5):
        got = langid.Model(SAMPLES, order).code_lengths(texts, block=16)
        want = [[brute_bits(SAMPLES[k], t, order) for k in sorted(SAMPLES)] for t in texts]
        assert np.allclose(got, want, rtol=1e-5, atol=1e-3)


def test_blocks_do_not_matter():
    model = langid.Model(SAMPLES)
    texts = [b"the cat " * 50, b"le chat", b""]
    assert np.allclose(model.code_lengths(texts, block=7), model.code_lengths(texts))


def test_table_finds_all_and_only_its_keys():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 2**40, 5000, dtype=np.uint64))
    t = langid.Table(keys, np.arange(len(keys)))
    assert (t.find(keys) == np.arange(len(keys))).all()
    other = np.setdiff1d(rng.integers(0, 2**40, 5000, dtype=np.uint64), keys)
    assert (t.find(other) == -1).all()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in queries.op3_language_id(spark, sf).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in rows) / len(rows) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_oddities(spark, odd_docs, no_docs):
    model = langid.train(odd_docs)
    assert model.langs == ["en"]
    rows = langid.identify(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    found = {r.doc_id: r.lang_pred for r in rows}
    assert found[3] == found[4] == found[5] == "und" and found[1] == found[9] == "en"
    kept = langid.keep_identified(odd_docs, model)
    assert kept.schema == odd_docs.schema and {r.doc_id for r in kept.collect()} >= {1, 2, 6, 7, 8, None}
    nothing = langid.train(no_docs)
    assert nothing.langs == [] and langid.identify(no_docs, nothing).count() == 0
    assert {r.lang_pred for r in langid.identify(odd_docs, nothing).collect()} == {"und"}
    assert langid.keep_identified(odd_docs, nothing).count() == odd_docs.count()


GERMAN = "der hund und die katze laufen über die straße zum haus"
ENGLISH = "the dog and the cat run over the street to the house"


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_rows_that_share_an_id_are_learnt_from(spark):
    for i in (1, 7, 8, 9, 10, 11, 12, 13):
        rows = [(i, f"{GERMAN} {k}", "de") for k in range(600)]
        model = langid.train(labelled(spark, rows), sample_docs=16)
        assert model.langs == ([] if zlib.crc32(str(i).encode()) % 3 == 1 else ["de"]), i


def test_the_sample_is_the_same_in_any_order_and_bounded(spark):
    rows = [(k, f"{(GERMAN, ENGLISH)[k % 2]} {k % 90}" * (1 + k % 5), ("de", "en")[k % 2]) for k in range(800)]
    rows += [(5000 + k, ENGLISH * 4000, "en") for k in range(300)]  # copies of one very long text
    a = langid.train(labelled(spark, rows).repartition(7), sample_docs=20)
    b = langid.train(labelled(spark, rows[::-1]).coalesce(1), sample_docs=20)
    assert a.langs == b.langs == ["de", "en"]
    assert all((x.keys == y.keys).all() and np.array_equal(x.values, y.values) for x, y in zip(a.costs, b.costs, strict=True))
    seen = []
    old, langid.Model = langid.Model, lambda samples, order: seen.append(samples)
    try:
        langid.train(labelled(spark, rows), sample_docs=20)
        langid.train(labelled(spark, rows), sample_bytes=2000)
    finally:
        langid.Model = old
    assert all(len(v) == len(set(v)) == 20 for v in seen[0].values())
    for v in seen[1].values():
        assert sum(map(len, v)) - max(map(len, v)) < 2000 <= sum(map(len, v))


def test_letters_are_letters(spark):
    model = langid.Model({"en": [b"the cat"]})
    texts = ["²", "½", "Ⅷ", "12 _ 34", "x", "é", "文", "ª", "\u0301"]
    got = model.predict([t.encode() for t in texts])
    assert [x[0] for x in got] == ["und"] * 4 + ["en"] * 4 + ["und"]
