"""Language identification by prediction by partial matching.

Each language has a byte context tree of bounded depth with frozen counts. A
byte costs minus log2 of its share in the longest context in which the
language has seen it, and each longer context that is known but lacks it costs
an escape first (method C: as many escapes as distinct successors). The
language with the shortest exact code for the whole text wins.

All trees are resolved into one table per depth when the model is made: a row
for each context and byte that any language has seen, with the full cost in
every language. Scoring is then one vectorised table look-up per byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quern.llm import tokens
from quern.llm.columns import long_id

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Table:
    """Rows of float costs by uint64 key, with open addressing, all vectorised."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, dtype=np.uint64)
        self.rows = np.full(1 << bits, -1, dtype=np.int32)
        self.values = values
        rest, slot = np.arange(len(keys)), self._slot(keys)
        while len(rest):
            free = self.rows[slot] < 0
            self.rows[slot[free]] = rest[free]
            won = self.rows[slot] == rest
            self.keys[slot[won]] = keys[rest[won]]
            rest, slot = rest[~won], (slot[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _ODD) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where it is absent."""
        slot = self._slot(keys)
        found = self.rows[slot]
        wrong = np.flatnonzero((found >= 0) & (self.keys[slot] != keys))
        at = slot[wrong]
        while len(wrong):
            at = (at + 1) & self.mask
            found[wrong] = self.rows[at]
            again = (self.rows[at] >= 0) & (self.keys[at] != keys[wrong])
            wrong, at = wrong[again], at[again]
        return found


def padded(values: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, each value after ``order`` zeros, and the values' lengths."""
    gap = bytes(order)
    return np.frombuffer(gap + gap.join(values) if values else gap, dtype=np.uint8), np.array([len(v) for v in values], dtype=np.int64)


def grams(data: np.ndarray, order: int) -> np.ndarray:
    """At each position from ``order`` on, the byte there with the ``order`` bytes before it."""
    out = np.zeros(max(0, len(data) - order), dtype=np.uint64)
    for k in range(order + 1):
        out = (out << np.uint64(8)) | data[k : len(data) - order + k]
    return out


class Model:
    """Frozen context trees of several languages."""

    def __init__(self, samples: dict[str, list[bytes]], order: int = 3) -> None:
        self.langs, self.order = sorted(samples), order
        self.costs: list[Table] = []
        self.escapes: list[Table] = []
        self.low = [np.uint64((1 << (8 * k)) - 1) for k in range(order + 2)]
        seen = [self._count(samples[x], order) for x in self.langs]
        for k in range(order + 1):
            self._resolve(k, [s[k] for s in seen])

    @staticmethod
    def _count(values: list[bytes], order: int) -> list[tuple[np.ndarray, np.ndarray]]:
        data, lengths = padded(values, order)
        whole = grams(data, order)
        first = np.cumsum(lengths + order) - lengths - order
        inside = np.concatenate([np.arange(a, a + n) for a, n in zip(first, lengths, strict=True)] or [np.zeros(0, dtype=np.int64)])
        whole = whole[inside.astype(np.int64)]
        return [np.unique(whole & np.uint64((1 << (8 * (k + 1))) - 1), return_counts=True) for k in range(order + 1)]

    def _resolve(self, k: int, seen: list[tuple[np.ndarray, np.ndarray]]) -> None:
        keys = np.unique(np.concatenate([x for x, _ in seen] or [np.zeros(0, dtype=np.uint64)]))
        contexts = np.unique(keys >> np.uint64(8))
        escape = np.zeros((len(contexts), len(self.langs)))
        share = np.full((len(keys), len(self.langs)), np.nan)
        for at, (own, n) in enumerate(seen):
            if not len(own):
                continue
            context, index, kinds = np.unique(own >> np.uint64(8), return_inverse=True, return_counts=True)
            total = np.bincount(index, n) + kinds
            escape[np.searchsorted(contexts, context), at] = -np.log2(kinds / total)
            share[np.searchsorted(keys, own), at] = -np.log2(n / total[index])
        below = self._cost(keys & self.low[k], k - 1) + escape[np.searchsorted(contexts, keys >> np.uint64(8))]
        self.costs.append(Table(keys, np.where(np.isnan(share), below, share).astype(np.float32)))
        self.escapes.append(Table(contexts, escape.astype(np.float32)))

    def _cost(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Bits of each gram of ``k + 1`` bytes in every language."""
        if k < 0 or not len(keys):
            return np.full((len(keys), len(self.langs)), 8.0, dtype=np.float32)
        table = self.costs[k]
        row = table.find(keys)
        if not len(table.values):
            return self._cost(keys & self.low[k], k - 1)
        out = table.values[np.maximum(row, 0)]
        if len(lost := np.flatnonzero(row < 0)):
            gram = keys[lost]
            known = self.escapes[k].find(gram >> np.uint64(8))
            out[lost] = self._cost(gram & self.low[k], k - 1) + np.where((known >= 0)[:, None], self.escapes[k].values[np.maximum(known, 0)], 0)
        return out

    def code_lengths(self, values: list[bytes], block: int = 1 << 19) -> np.ndarray:
        """Bits of each value in every language; memory is bounded by ``block`` positions."""
        data, lengths = padded(values, self.order)
        out = np.zeros((len(values), len(self.langs)))
        ends = np.cumsum(lengths + self.order)
        for a in range(0, len(data) - self.order, block):
            cost = self._cost(grams(data[a : a + block + self.order], self.order), self.order)
            # Position p codes byte p + order; the owner's own bytes end at ends - order.
            first = np.searchsorted(ends, a, side="right")
            last = np.searchsorted(ends, a + len(cost) - 1, side="right")
            for d in range(first, min(last, len(values) - 1) + 1):
                lo, hi = max(ends[d] - lengths[d] - self.order, a) - a, min(ends[d] - self.order, a + len(cost)) - a
                if hi > lo:
                    out[d] += cost[lo:hi].sum(axis=0, dtype=np.float64)
        return out

    def predict(self, values: list[bytes | None]) -> list[tuple[str, float, float]]:
        """Language, its share of the posterior under equal priors, and bits a byte."""
        if not self.langs:
            return [(UNKNOWN, 0.0, 0.0)] * len(values)
        bits = self.code_lengths([v or b"" for v in values])
        best = bits.argmin(axis=1) if len(bits) else np.zeros(0, dtype=int)
        low = bits.min(axis=1, keepdims=True) if len(bits) else bits
        score = 1 / np.exp2(np.maximum(low - bits, -1000)).sum(axis=1)
        lettered = [v is not None and _LETTER.search(v.decode("utf-8", "replace")) is not None for v in values]
        return [
            (self.langs[best[k]], float(score[k]), float(low[k, 0] / max(1, len(v or b"")))) if lettered[k] else (UNKNOWN, 0.0, 0.0)
            for k, v in enumerate(values)
        ]


def is_held_out(id_col: Column) -> Column:
    """Rows that the contract keeps out of training; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def _first_hashes(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Of each language the ``most`` smallest hashes that a task sees, once each."""
    least: dict[str, np.ndarray] = {}
    size: dict[int, int] = {}
    for batch in batches:
        lang, h, n = (batch.column(k).to_pylist() for k in range(3))
        size.update(zip(h, n, strict=True))
        new: dict[str, list[int]] = {}
        for x, y in zip(lang, h, strict=True):
            new.setdefault(x, []).append(y)
        for x, own in new.items():
            least[x] = np.unique(np.concatenate([least.get(x, np.zeros(0, dtype=np.int64)), own]))[:most]
        held = set(np.concatenate(list(least.values())).tolist()) if least else set()
        size = {k: v for k, v in size.items() if k in held}
    for x, own in least.items():
        yield pa.RecordBatch.from_arrays([pa.array([x] * len(own)), pa.array(own), pa.array([size[k] for k in own.tolist()], pa.int64())], names=["l", "h", "n"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = 3, sample_docs: int = 256, sample_bytes: int = 4 << 20) -> Model:
    """Fit on at most ``sample_docs`` texts per language, and no more after the one that reaches ``sample_bytes`` in all.

    These bounds are the only ones, and concern training alone. The sample is the
    distinct texts with the smallest hashes among the rows that are not held out and
    have a text and a language, whatever their ids, lengths or order. Texts that
    repeat count once. Without such rows the model knows no language.
    """
    text, lang = F.col(text_col).cast("string"), F.col(lang_col).cast("string")
    rows = docs.filter(lang.isNotNull() & text.isNotNull() & ~is_held_out(F.col(id_col))).select(lang.alias("l"), F.xxhash64(text).alias("h"), text.alias("t"))
    narrow = rows.select("l", "h", F.octet_length("t").cast("long").alias("n")).mapInArrow(lambda b: _first_hashes(b, sample_docs), "l string, h long, n long")
    first = Window.partitionBy("l").orderBy("h")
    few = narrow.groupBy("l", "h").agg(F.min("n").alias("n")).withColumn("k", F.row_number().over(first)).filter(F.col("k") <= sample_docs)
    few = few.withColumn("before", F.sum("n").over(first) - F.col("n")).filter(F.col("before") < sample_bytes)
    picked = few.select("l", "h").collect()  # sample_docs rows a language
    if not picked:
        return Model({}, order)
    chosen = docs.sparkSession.createDataFrame(picked, "l string, h long")
    taken = rows.join(F.broadcast(chosen), ["l", "h"], "left_semi").groupBy("l", "h").agg(F.min("t").alias("t"))
    samples: dict[str, list[bytes]] = {}
    for r in taken.collect():  # sample_docs rows a language, and but one beyond sample_bytes
        samples.setdefault(r.l, []).append(r.t.encode())
    return Model({k: sorted(v) for k, v in samples.items()}, order)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, lang_pred, score, bits_per_byte``.

    * A null text, or one without a letter, is ``und`` with score 0; so is any
      text if the model knows no language. Ties go to the first name.
    * Whole texts are coded, in pieces of bounded memory; only id and text are
      read, so other columns may have any names. Nothing is shuffled.
    * Repeated rows and ids give rows of their own; an empty table gives none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.pieces(batch, max_bytes=2 << 20):
                found = sent.value.predict(part.column("text").cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.float64())],
                    names=["doc_id", "lang_pred", "score", "bits_per_byte"],
                )

    rows = docs.select(long_id(docs, id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, lang_pred string, score double, bits_per_byte double")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", max_bits_per_byte: float = 8.0) -> DataFrame:
    """The rows in a language that the model knows, with all their columns.

    Rejected are ``und`` and texts that the best language codes no better than
    one raw byte per byte. A model without languages rejects nothing.

    * Null texts and those without a letter go; repeated rows stay or go together.
    * Columns keep their names and values; an empty table stays empty.
    """
    if not model.langs:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.pieces(batch, text_col, max_bytes=2 << 20):
                found = sent.value.predict(part.column(text_col).cast(pa.binary()).to_pylist())
                yield part.filter(pa.array([x[0] != UNKNOWN and x[2] < max_bits_per_byte for x in found], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
