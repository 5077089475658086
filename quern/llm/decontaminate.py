"""Benchmark decontamination by size-partitioned MinHash containment search.

A short item inside a long document has almost no Jaccard similarity to it, so
two sketches of equal length never meet. Here only the item is sketched: the
``k`` smallest hashes of its word shingles are probed with every shingle of
every document. Items are partitioned by size, in powers of two, and a
partition's ``k`` is one more than the shingles that an item of its largest
size may lack at the wanted containment. By pigeonhole a document that
contains an item meets at least one of the ``k``: nothing is missed. What is
met is verified by exact containment of the shingles' words.

Items are taken in blocks of bounded bytes and a block is sent to all tasks;
documents are scanned once for each block and never shuffled.
"""

from __future__ import annotations

import string
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import tokens
from quern.llm.columns import long_id

#: The characters that count as spaces.
PUNCTUATION = string.punctuation


def normalise(text: Column) -> Column:
    """Lower case, ASCII punctuation as spaces, null as empty."""
    return F.translate(F.lower(F.coalesce(text.cast("string"), F.lit(""))), PUNCTUATION, " " * len(PUNCTUATION))


def word_shingles(words: list[bytes], size: int) -> list[bytes]:
    """Every run of ``size`` words, or all words if there are fewer."""
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


class Index:
    """The sketches and the shingles of a block of items."""

    def __init__(self, items: list[tuple[int | None, bytes]], size: int, threshold: float) -> None:
        self.size, self.threshold = size, threshold
        self.items: list[tuple[int | None, frozenset[bytes]]] = []
        self.posting: dict[int, list[int]] = defaultdict(list)
        for item_id, text in items:
            words = text.split()
            if not (own := frozenset(word_shingles(words, size))):
                continue
            h, _ = tokens.shingles(tokens.hashes(words), np.array([len(words)]), size)
            largest = 2 ** len(own).bit_length() - 1
            for x in np.unique(h)[: int((1 - threshold) * largest + 1e-9) + 1]:
                self.posting[int(x)].append(len(self.items))
            self.items.append((item_id, own))
        self.keys = np.array(sorted(self.posting), dtype=np.uint64)
        self.low = np.zeros(1 << 20, dtype=bool)
        self.low[(self.keys & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def find(self, values: list[bytes]) -> Iterator[tuple[int, list[tuple[int | None, int, int]]]]:
        """Position of each value that contains items, with (item, its shingles, those shared)."""
        words, counts = tokens.split(values, lower=False)
        h, made = tokens.shingles(tokens.hashes(words), counts, self.size)
        near = np.flatnonzero(self.low[(h & np.uint64(0xFFFFF)).astype(np.int64)])
        if not len(near) or not len(self.keys):
            return
        slot = np.minimum(np.searchsorted(self.keys, h[near]), len(self.keys) - 1)
        near = near[self.keys[slot] == h[near]]
        owner = np.searchsorted(np.cumsum(made), near, side="right")
        met: dict[int, set[int]] = defaultdict(set)
        for d, x in zip(owner.tolist(), h[near].tolist(), strict=True):
            met[d].update(self.posting[x])
        for d, candidates in met.items():
            has = set(word_shingles(values[d].split(), self.size))
            found: dict[int | None, tuple[int, int]] = {}
            for k in candidates:
                item_id, own = self.items[k]
                shared = len(own & has)
                if shared >= self.threshold * len(own) - 1e-9 and shared * found.get(item_id, (1, 0))[0] > found.get(item_id, (1, 0))[1] * len(own):
                    found[item_id] = (len(own), shared)
            if found:
                yield d, [(i, *found[i]) for i in sorted(found, key=lambda i: (i is not None, i or 0))]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int, size: int, threshold: float) -> Iterator[Index]:
    items = benchmark.select(F.col(id_col).alias("i"), normalise(F.col(text_col)).cast("binary").alias("t")).distinct()
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    for k in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).collect()  # bounded by block_bytes, on average
        yield Index([(r.i, bytes(r.t)) for r in own], size, threshold)


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    shingle: int = 5,
    threshold: float = 0.8,
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """Pairs of a document and an item of which it has ``threshold`` of the distinct shingles, or more.

    Returns ``doc_id, item_id, item_shingles, shared, containment``.

    * Words are lower-case; ASCII punctuation separates words.
    * A text of fewer than ``shingle`` words has its whole sequence as its only
      shingle; one without words, null or empty has none and pairs with nothing.
    * Rows that repeat a document give rows of their own; items that share an id
      give one row, that of the highest containment.
    * Other columns are not read; empty tables give an empty result.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, item_shingles long, shared long, containment double"
    rows = docs.select(long_id(docs, id_col).alias("doc_id"), normalise(F.col(text_col)).alias("text"))
    found = None
    for index in _blocks(benchmark, item_id_col, item_text_col, block_bytes, shingle, threshold):
        sent = spark.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in tokens.pieces(batch):
                    ids = part.column("doc_id")
                    out = [(ids[d].as_py(), i, n, s, s / n) for d, hits in sent.value.find(tokens.texts(part)) for i, n, s in hits]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [*[pa.int64()] * 4, pa.float64()], strict=True)], names=["doc_id", "item_id", "item_shingles", "shared", "containment"])

        one = rows.mapInArrow(search, schema)
        found = one if found is None else found.unionByName(one)
    return spark.createDataFrame([], schema) if found is None else found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", shingle: int = 5, threshold: float = 0.8, block_bytes: int = 8 << 20) -> DataFrame:
    """The documents that contain no item, rows and columns as they are.

    * What contains an item is as in :func:`find_leaks`; so null and empty texts, and
      those without words, stay, and a text of exactly the threshold goes.
    * Repeated rows stay or go together; ids are not read. Columns keep their names
      and values, whatever they are called. An empty table stays empty, and without
      items every document stays.
    * Whole texts are searched, in pieces of bounded memory.
    """
    spark, names = docs.sparkSession, docs.columns
    key = "_normal"
    while key in names:
        key += "_"
    for index in _blocks(benchmark, item_id_col, item_text_col, block_bytes, shingle, threshold):
        sent = spark.sparkContext.broadcast(index)

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in tokens.pieces(batch, key):
                    clean = np.ones(part.num_rows, dtype=bool)
                    for d, _ in sent.value.find(tokens.texts(part, key)):
                        clean[d] = False
                    yield part.filter(pa.array(clean)).drop_columns([key])

        docs = docs.withColumn(key, normalise(F.col(text_col))).mapInArrow(keep, docs.schema)
    return docs
