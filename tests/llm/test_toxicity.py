import random

import numpy as np

from quern.llm import queries, toxicity

SCHEMA = "doc_id long, text string, d long, i long, y0 int, words string"


def made(spark, n=600, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    bad, poor = ["grubby", "vile", "rotten", "nasty"], ["###", "buy", "click"]
    rows, labels = [], []
    for k in range(n):
        words = rng.choices(vocabulary, k=rng.randrange(5, 120))
        toxic, low = rng.random() < 0.2, rng.random() < 0.3
        for pool, use in ((bad, toxic), (poor, low)):
            if use:
                for _ in range(rng.randrange(1, 4)):
                    words.insert(rng.randrange(len(words)), rng.choice(pool).title() + rng.choice(["", ",", "!"]))
        rows.append((k, " ".join(words), k, k, 1, "x"))
        labels.append((k, int(not low), int(toxic)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_unseen_documents(spark):
    docs, labels, truth = made(spark)
    learnt = labels.filter("doc_id < 400")
    rows = {r.doc_id: r for r in toxicity.predict(docs, toxicity.train(docs, learnt)).collect()}
    unseen = [t for t in truth if t[0] >= 400]
    hits = [rows[i].is_toxic == bool(y) for i, _, y in unseen]
    assert np.mean(hits) > 0.97
    assert np.mean([rows[i].is_toxic for i, _, y in unseen if not y]) < 0.02


def test_later_models_see_earlier_categories(spark):
    docs, labels, _ = made(spark)
    chain = toxicity.train(docs, labels)
    assert chain.categories == ["quality", "toxic"]
    (first, w1), (second, w2) = chain.models
    assert len(w1) == 1 + len(first) and len(w2) == 2 + len(second)


def test_fit_against_newton():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    y = (x @ [1.0, -2.0, 0.5, 0.0] + rng.normal(size=300) > 0.3).astype(float)
    w = toxicity.fit(x, y, ridge=1.0, steps=3000)
    full, v = np.hstack([np.ones((300, 1)), x]), np.zeros(5)
    for _ in range(30):
        p = 1 / (1 + np.exp(-full @ v))
        r = np.diag([0, 1, 1, 1, 1])
        v -= np.linalg.solve(full.T @ (full * (p * (1 - p))[:, None]) + r, full.T @ (p - y) + r @ v)
    assert np.allclose(w, v, atol=1e-3)


def test_on_data(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r.is_toxic for r in queries.op6_toxicity(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert len(rows) == 1000
    clean = [rows[r.doc_id] for r in labels if not r.toxic]
    assert np.mean(clean) < 0.02


def test_oddities(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    chain = toxicity.train(odd_docs, none)
    rows = toxicity.predict(odd_docs, chain).collect()
    assert len(rows) == odd_docs.count() and all(r.p_toxic == 0.5 and not r.is_toxic for r in rows)
    some = spark.createDataFrame([(1, 1, 0), (2, 1, None), (None, 0, 1), (4, 0, 1), (7, 1, 0), (7, 1, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(odd_docs, some)
    assert toxicity.predict(odd_docs, chain).count() == odd_docs.count()
    assert toxicity.predict(no_docs, chain).count() == 0
    assert toxicity.predict(no_docs, toxicity.train(no_docs, some)).count() == 0


def held_out_figures(spark, sf):
    """Recall and precision on labels that were not learnt from."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    learnt = labels.filter("doc_id % 2 = 0")
    rows = {r.doc_id: r.is_toxic for r in toxicity.predict(docs, toxicity.train(docs, learnt)).collect()}
    unseen = [(rows[r.doc_id], bool(r.toxic)) for r in labels.filter("doc_id % 2 = 1").collect()]
    hit = sum(a and b for a, b in unseen)
    return hit / sum(b for _, b in unseen), hit / max(1, sum(a for a, _ in unseen))


def test_recall_and_precision_on_held_out_labels(spark):
    recall, precision = held_out_figures(spark, "/root/testdata/sf0.1")
    assert recall > 0.75 and precision > 0.95


def brute_chain(docs, ys, folds, most, least_z):
    """The chain over sets of words, one category after the other, with Newton's method."""

    def newton(x, y):
        x = np.hstack([np.ones((len(x), 1)), x])
        w, ridge = np.zeros(x.shape[1]), 0.3 * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
        for _ in range(40):
            p = 1 / (1 + np.exp(-x @ w))
            w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge + 1e-12 * np.eye(len(w)), x.T @ (p - y) + ridge @ w)
        return w

    def learn(rows, y, earlier):
        score = {}
        for word in {w for i in rows for w in docs[i]}:
            a, b = (sum(word in docs[i] for i in rows if y[i] == v) for v in (1, 0))
            na, nb = (sum(y[i] == v for i in rows) for v in (1, 0))
            score[word] = abs(np.log((a + 0.5) / (na - a + 0.5)) - np.log((b + 0.5) / (nb - b + 0.5))) / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        words = sorted(w for w in sorted(score, key=lambda w: -score[w])[:most] if score[w] >= least_z)
        return words, newton(np.array([[w in docs[i] for w in words] + list(earlier[i]) for i in rows], dtype=float), y[rows])

    def ask(model, i, earlier):
        words, w = model
        return 1 / (1 + np.exp(-(w[0] + np.array([x in docs[i] for x in words] + list(earlier[i]), dtype=float) @ w[1:])))

    fold = [int(np.bitwise_xor.reduce(np.array(sorted(d), dtype=np.uint64)) % np.uint64(folds)) for d in docs]
    train, real = [[] for _ in docs], [[] for _ in docs]
    for y in ys:
        everything = np.arange(len(docs))
        model = learn(everything, y, train)
        unseen = {}
        for k in set(fold):
            part = learn(np.array([i for i in everything if fold[i] != k]), y, train)
            unseen |= {i: ask(part, i, train) for i in everything if fold[i] == k}
        for i, p in [(i, ask(model, i, real)) for i in everything]:
            real[i].append(p)
        for i in everything:
            train[i].append(unseen[i])
    return np.array(real)


def test_the_chain_against_brute_force(spark):
    docs, labels, truth = made(spark, n=160)
    rows = toxicity.predict(docs, toxicity.train(docs, labels)).orderBy("doc_id").collect()
    sets = [{int(h) for h in toxicity.tokens.hashes(r.text.lower().replace(",", " ").replace("!", " ").replace("#", " ").encode().split())} for r in docs.orderBy("doc_id").collect()]
    want = brute_chain(sets, [np.array([t[k] for t in truth]) for k in (1, 2)], toxicity.FOLDS, toxicity.MOST_WORDS, toxicity.LEAST_Z)
    assert np.allclose([[r.p_quality, r.p_toxic] for r in rows], want, atol=0.02)


def test_the_sample_is_bounded_and_repeats_add_nothing(spark):
    docs, labels, _ = made(spark, n=300)
    once = toxicity.train(docs, labels, sample_rows=200)
    again = toxicity.train(docs.union(docs).union(docs), labels.union(labels), sample_rows=400)
    assert [len(w) for w, _ in once.models] == [len(w) for w, _ in again.models]
    p, q = ([r.p_toxic for r in toxicity.predict(docs, c).orderBy("doc_id").collect()] for c in (once, again))
    assert np.allclose(p, q, atol=1e-6)
