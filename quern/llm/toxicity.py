"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other. A later model sees the words and
the probabilities of the categories before it; for training these are predicted
out of fold, by models whose words, too, were chosen without the fold, so that it
learns from what it will meet, not from a fit. The model is fitted on a bounded
sample of labelled documents, of which only the words that some model uses reach
the driver; every document is scored over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern import scratch
from quern.llm import tokens
from quern.llm.columns import long_id
from quern.llm.decontaminate import normalise

#: Parts for out-of-fold predictions, words of a model at most, and standard errors that a word's log odds are from none at least.
FOLDS, MOST_WORDS, LEAST_Z = 5, 512, 3.0


def _words(values: list[bytes]) -> list[np.ndarray]:
    """The distinct word hashes of each text."""
    words, counts = tokens.split(values, lower=False)
    ends = np.cumsum(counts)
    h = tokens.hashes(words)
    return [np.unique(h[a:b]) for a, b in zip(ends - counts, ends, strict=True)]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, steps: int = 300) -> np.ndarray:
    """Logistic regression with an intercept in front, by accelerated gradient steps in the precision of ``x``."""
    x = np.hstack([np.ones((len(x), 1), dtype=x.dtype), x])
    y = y.astype(x.dtype)
    norm = np.ones(x.shape[1], dtype=x.dtype)
    for _ in range(12):
        norm = x.T @ (x @ norm)
        norm /= np.linalg.norm(norm)
    rate = 1 / (0.25 * float(np.linalg.norm(x @ norm)) ** 2 + ridge)
    rate, ridge = x.dtype.type(rate), x.dtype.type(ridge)
    w = ahead = np.zeros(x.shape[1], dtype=x.dtype)
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        shrink = ridge * ahead
        shrink[0] = 0
        new = ahead - rate * (x.T @ (p - y) + shrink)
        w, ahead = new, new + x.dtype.type(k / (k + 3)) * (new - w)
    return w


def probability(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))


def fold_of(words: np.ndarray, folds: int) -> int:
    """The fold of a document, by its distinct words: copies share it."""
    return int(np.bitwise_xor.reduce(words) % np.uint64(folds)) if len(words) else 0


def informative(docs: list[np.ndarray], y: np.ndarray, most: int, least_z: float) -> np.ndarray:
    """Words whose log odds between the two classes is many standard errors from none."""
    flat = np.concatenate(docs) if docs else np.zeros(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    words, index = np.unique(flat, return_inverse=True)
    a, b = (np.bincount(index, y[owner] == k, minlength=len(words)) for k in (1, 0))
    na, nb = (y == 1).sum(), (y == 0).sum()
    z = (np.log((a + 0.5) / (na - a + 0.5)) - np.log((b + 0.5) / (nb - b + 0.5))) / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    order = np.argsort(-np.abs(z), kind="stable")[:most]
    return np.sort(words[order[np.abs(z[order]) >= least_z]])


class Chain:
    """Categories in order, each with its words and its linear model.

    ``fold`` gives the folds of documents whose words are not all in ``docs``.
    """

    def __init__(self, docs: list[np.ndarray], labels: dict[str, np.ndarray], folds: int = FOLDS, most_words: int = MOST_WORDS, least_z: float = LEAST_Z, fold: np.ndarray | None = None) -> None:
        self.categories = list(labels)
        self.models: list[tuple[np.ndarray, np.ndarray]] = []
        fold = np.array([fold_of(d, folds) for d in docs], dtype=np.int64) if fold is None else fold
        earlier = np.zeros((len(docs), 0))

        def learn(rows: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            own = [docs[k] for k in rows]
            words = informative(own, y[rows], most_words, least_z) if own else np.zeros(0, dtype=np.uint64)
            x = np.hstack([self.presence(own, words), earlier[rows]]).astype(np.float32)
            return words, fit(x, y[rows]) if own else np.zeros(1 + x.shape[1])

        for y in labels.values():
            self.models.append(learn(np.arange(len(docs)), y))
            unseen = np.zeros(len(docs))
            for k in np.unique(fold):
                out, rest = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
                if len(rest):
                    words, w = learn(rest, y)
                    unseen[out] = probability(w, np.hstack([self.presence([docs[i] for i in out], words), earlier[out]]).astype(np.float32))
                else:
                    unseen[out] = 0.5
            earlier = np.hstack([earlier, unseen[:, None]])
        self.all_words = np.unique(np.concatenate([w for w, _ in self.models] or [np.zeros(0, dtype=np.uint64)]))

    @staticmethod
    def presence(docs: list[np.ndarray], words: np.ndarray) -> np.ndarray:
        out = np.zeros((len(docs), len(words)), dtype=np.float32)
        if len(words):
            for k, d in enumerate(docs):
                at = np.minimum(np.searchsorted(words, d), len(words) - 1)
                out[k, at[words[at] == d]] = 1
        return out

    def predict(self, values: list[bytes]) -> np.ndarray:
        """Probability of each category for each text."""
        words, counts = tokens.split(values, lower=False)
        h = tokens.hashes(words)
        if len(self.all_words):
            at = np.minimum(np.searchsorted(self.all_words, h), len(self.all_words) - 1)
            told = self.all_words[at] == h
        else:
            told = np.zeros(len(h), dtype=bool)
        owner = np.repeat(np.arange(len(values)), counts)[told]
        ends = np.searchsorted(owner, np.arange(len(values)), side="right")
        starts = np.concatenate([[0], ends[:-1]]) if len(values) else ends
        kept = h[told]
        docs = [np.unique(kept[a:b]) for a, b in zip(starts, ends, strict=True)]
        out = np.zeros((len(values), 0))
        for own, w in self.models:
            out = np.hstack([out, probability(w, np.hstack([self.presence(docs, own), out]))[:, None]])
        return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tokens.pieces(batch):
            sets = _words(tokens.texts(part))
            names = [n for n in part.schema.names if n != "text"]
            made = [pa.array([fold_of(s, FOLDS) for s in sets], pa.int64()), pa.array([xxhash.xxh64_intdigest(s.tobytes()) >> 1 for s in sets], pa.int64()), pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], *made], names=[*names, "fold", "same", "words"])


def _candidates(rows: DataFrame, categories: int) -> DataFrame:
    """``word``: those that any model of the chain may choose, counted over all rows.

    For each category, all rows and all but each fold, twice as many as are chosen
    there, so that the order of equally telling words is left to the one who chooses.
    """
    one = lambda test: F.sum(F.when(test, 1).otherwise(0))
    cells = [(c, f, v, (F.col(f"y{c}") == v) & (F.col("fold") == f)) for c in range(categories) for f in range(FOLDS) for v in (0, 1)]
    total = rows.agg(*[one(t).alias(f"n{c}_{f}_{v}") for c, f, v, t in cells]).first()
    counts = rows.select(*[f"y{c}" for c in range(categories)], "fold", F.explode("words").alias("word")).groupBy("word").agg(*[one(t).alias(f"n{c}_{f}_{v}") for c, f, v, t in cells])

    def odds(c: int, v: int, out: int) -> tuple[Column, Column]:
        use = [f for f in range(FOLDS) if f != out]
        have, of = sum((F.col(f"n{c}_{f}_{v}") for f in use), F.lit(0)), sum(total[f"n{c}_{f}_{v}"] or 0 for f in use)
        return F.log((have + 0.5) / (of - have + 0.5)), have + 0.5

    told = []
    for c in range(categories):
        for out in range(-1, FOLDS):
            (yes, a), (no, b) = odds(c, 1, out), odds(c, 0, out)
            told.append(F.struct(F.lit(c * (FOLDS + 1) + out).alias("model"), F.abs((yes - no) / F.sqrt(1 / a + 1 / b)).alias("z")))
    ranked = counts.select("word", F.explode(F.array(*told)).alias("t")).select("word", "t.*").filter(F.col("z") >= LEAST_Z - 1e-6)
    first = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("z"), "word"))
    return ranked.withColumn("k", first).filter(F.col("k") <= 2 * MOST_WORDS).select("word").distinct()


def train(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = ("quality", "toxic"), id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 8000) -> Chain:
    """Fit on at most ``sample_rows`` labelled documents, those with the smallest hash of their id.

    * Labels with a null are not used; of labels that share an id the smallest are.
    * Documents with the same distinct words are learnt from once, that with the
      smallest id and labels; so rows that repeat an id add nothing beyond the
      sample but other texts. Whole texts are read, whatever their length.
    * Other columns, whatever their names, are not read. Without labelled documents
      the chain knows nothing.
    """
    ys = [f"y{k}" for k in range(len(categories))]
    whole = labels.select(long_id(labels, id_col).alias("i"), *[F.col(c).cast("int").alias(y) for c, y in zip(categories, ys, strict=True)]).dropna()
    first = {}
    for r in whole.orderBy(F.xxhash64("i"), "i", *ys).limit(sample_rows).collect():  # sample_rows rows
        first.setdefault(r.i, r)
    sample = docs.sparkSession.createDataFrame(list(first.values()), whole.schema)

    own = docs.select(long_id(docs, id_col).alias("d"), F.col(text_col).alias("t"))
    joined = own.join(F.broadcast(sample), F.col("d") == F.col("i")).select("d", *ys, normalise(F.col("t")).alias("text"))  # sample_rows rows
    seen = joined.mapInArrow(_features, ", ".join(["d long", *[f"{y} int" for y in ys], "fold long, same long, words array<long>"]))
    # One of the rows with the same words, and as many of them as the sample has ids.
    each = seen.groupBy("same").agg(F.min_by(F.struct("d", *ys, "fold", "words"), F.struct("d", *ys)).alias("r")).select("same", "r.*")
    rows = scratch.table(each.orderBy(F.xxhash64("d"), "d", "same").limit(sample_rows), "labelled")
    chosen = np.array([r.word for r in _candidates(rows, len(ys)).collect()], dtype=np.int64)  # 2 * MOST_WORDS for each model
    used = F.array_intersect("words", F.lit(chosen)) if len(chosen) else F.array().cast("array<long>")
    found = sorted(rows.select("d", "same", *ys, "fold", used.alias("words")).collect(), key=lambda r: r.same)
    scratch.drop_table(rows)
    y = np.array([[r[k] for k in ys] for r in found], dtype=np.float64).reshape(-1, len(categories))
    sets = [np.sort(np.array(r.words, dtype=np.int64).view(np.uint64)) for r in found]
    return Chain(sets, {c: y[:, k] for k, c in enumerate(categories)}, fold=np.array([r.fold for r in found], dtype=np.int64))


def predict(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``p_<category>`` for each, and ``is_<last category>``.

    Words are lower-case, ASCII punctuation separates them; null text is empty and
    gets the intercepts' probabilities. Without labelled documents every
    probability is a half and nothing is flagged. Repeated rows and ids give rows of
    their own; other columns are not read; an empty table gives none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.pieces(batch):
                p = sent.value.predict(tokens.texts(part))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(p[:, k]) for k in range(p.shape[1])]], names=["doc_id", *names])

    rows = docs.select(long_id(docs, id_col).alias("doc_id"), normalise(F.col(text_col)).alias("text"))
    scored = rows.mapInArrow(run, ", ".join(["doc_id long", *[f"{n} double" for n in names]]))
    return scored.withColumn(f"is_{chain.categories[-1]}", F.col(names[-1]) > 0.5)
