"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs are quantised to 1 + floor(log2 count) levels. An
n-gram of level q is in the filter q times, once with each of 1..q, so its level
is read back by probing 1, 2, ... until a probe fails. A filter can only err
upwards, and errs by a level with the probability of one false positive.

The filter grows with the corpus: 64-bit words, four bits of one word for an
entry, in segments by the first bits of the n-gram's hash. Each segment is built
where its n-grams are aggregated, with ``ENTRY_BITS`` for every entry counted, so
false positives stay at the same rate. A filter of up to ``broadcast_bits`` goes to
all tasks by way of the driver. Beyond that it stays in its segments: the n-grams
of every piece of text are sent to them, and the levels found are sent back.
Where the texts to score hold those to learn from, :func:`train_and_score` sends
their n-grams once, both to fill the segments and to be looked up in them.

The unigram base score needs exact counts of all words, which no broadcast may
hold. The most frequent words, a fixed number of them, are sent to the tasks;
the rest are joined by word.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern import scratch
from quern.llm import tokens
from quern.llm.columns import long_id

#: The end of a text, and what stands before its first word: no word is empty.
END = b""
#: Segments of the filter, at least; more of them beyond so many tokens in each.
SEGMENTS, SEGMENT_TOKENS = 256, 1 << 22
#: Bits of the filter for an entry; about one n-gram in a hundred that was never added is found.
ENTRY_BITS = 12
_ODD, _PAIR = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)


#: N-grams that are placed in a segment at once.
AT_ONCE = 1 << 18
#: Bits of an n-gram's hash beyond those that name its segment.
KEY_BITS, KEY_BYTES = 40, 5


def keyed(h: np.ndarray, segments: int) -> np.ndarray:
    """Hashes cut to the bits that tell n-grams apart: those of the segment and ``KEY_BITS`` more."""
    low = np.uint64(max(0, 65 - segments.bit_length() - KEY_BITS))
    return h >> low << low


def packed(h: np.ndarray, segments: int) -> bytes:
    """Cut hashes of one segment in ``KEY_BYTES`` each."""
    low = np.uint64(max(0, 65 - segments.bit_length() - KEY_BITS))
    own = (h >> low) & np.uint64(2**KEY_BITS - 1)
    return own.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def unpacked(data: bytes, segment: int, segments: int) -> np.ndarray:
    """The cut hashes of a segment that :func:`packed` wrote."""
    low = np.uint64(max(0, 65 - segments.bit_length() - KEY_BITS))
    own = np.zeros((len(data) // KEY_BYTES, 8), dtype=np.uint8)
    own[:, :KEY_BYTES] = np.frombuffer(data, dtype=np.uint8).reshape(-1, KEY_BYTES)
    h = own.view("<u8").ravel() << low
    first = np.uint64(65 - segments.bit_length())
    return h | (np.uint64(segment) << first) if segments > 1 else h


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes in order, and the place among them of each."""
    order = np.argsort(h)
    own = h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = own[1:] != own[:-1]
    rank = np.cumsum(new)
    rank -= 1
    at = np.empty(len(h), dtype=np.int64)
    at[order] = rank
    return own[new], at


def levels(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 count)."""
    return np.frexp(counts.astype(np.float64))[1]


def level_count(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for: 1, then the geometric middle of its range."""
    return np.where(level <= 1, level, np.exp2(level - 0.5)).astype(np.float64)


def place(h: np.ndarray, level: int, words: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Word and bit mask of n-grams at a level, in segments of ``words``."""
    x = tokens.mix(h + np.uint64(level * int(_ODD) % 2**64))
    at = (x & np.uint64(0xFFFFFFFF)) * np.asarray(words, dtype=np.uint64) >> np.uint64(32)
    mask = np.zeros(len(h), dtype=np.uint64)
    for k in range(4):
        mask |= np.uint64(1) << ((x >> np.uint64(36 + 6 * k)) & np.uint64(63))
    return at.astype(np.int64), mask


def segment_of(h: np.ndarray, segments: int) -> np.ndarray:
    """The segments, a power of two, by the first bits of the hash."""
    return (h >> np.uint64(65 - segments.bit_length())).astype(np.int64)


def probe(h: np.ndarray, bits: np.ndarray, words: np.ndarray, starts: np.ndarray, highest: int) -> np.ndarray:
    """Levels of n-grams, by repeated probes up to the highest level stored."""
    level = np.zeros(len(h), dtype=np.int8)
    rest = np.arange(len(h))
    for k in range(1, highest + 1):
        at, mask = place(h[rest], k, words[rest])
        rest = rest[(bits[starts[rest] + at] & mask) == mask]
        if not len(rest):
            break
        level[rest] = k
    return level


class Filter:
    """The finished filter with the corpus totals; ``bits`` is None where it stays in the table ``stored``."""

    def __init__(self, bits: np.ndarray | None, words: np.ndarray, highest: int, stored: DataFrame, tokens_seen: int, distinct: int, head: dict[bytes, int], pair_weight: float) -> None:
        self.bits, self.words, self.highest, self.stored = bits, words, highest, stored
        self.starts = np.cumsum(words) - words
        self.total, self.distinct, self.head, self.pair_weight = tokens_seen, distinct, head, pair_weight
        self.mass = tokens_seen + 0.5 * (distinct + 1)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"stored": None}

    def counts(self, h: np.ndarray) -> np.ndarray:
        """The counts that the filter holds for n-grams."""
        h = keyed(h, len(self.words))
        s = segment_of(h, len(self.words))
        return level_count(probe(h, self.bits, self.words[s], self.starts[s], self.highest))


def _sequence(values: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Words of all texts, an end after each, and the tokens of each."""
    out: list[bytes] = []
    counts = np.zeros(len(values), dtype=np.int64)
    for k, v in enumerate(values):
        own = v.lower().split()
        out += own
        out.append(END)
        counts[k] = len(own) + 1
    return out, counts


def _pairs(h: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it; the first of a text follows an end."""
    before = np.concatenate([[np.uint64(xxhash.xxh64_intdigest(END))], h[:-1]]) if len(h) else h
    return tokens.mix(before * _PAIR + h + np.uint64(1))


def _count_words(batches: Iterator[pa.RecordBatch], most: int = 400_000) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["token", "c"])

    for batch in batches:
        for part in tokens.pieces(batch):
            held.update(_sequence(tokens.texts(part))[0])
            if len(held) > most:
                yield flush()
                held.clear()
    yield flush()


#: N-grams of a segment: their packed hashes, in order, and their counts.
COUNTED = "segment int, keys binary, counts binary"


def _by_segment(h: np.ndarray, c: np.ndarray, segments: int) -> pa.RecordBatch:
    """Distinct cut hashes in order, with their counts, a row a segment."""
    of, at = np.unique(segment_of(h, segments), return_index=True)
    keys = [packed(x, segments) for x in np.split(h, at[1:])] if len(h) else []
    counts = [x.astype("<i8").tobytes() for x in np.split(c, at[1:])] if len(h) else []
    return pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], names=["segment", "keys", "counts"])


def _count_pairs(batches: Iterator[pa.RecordBatch], segments: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return _by_segment(h, c, segments)

    for batch in batches:
        for part in tokens.pieces(batch):
            held.append(keyed(_pairs(tokens.hashes(_sequence(tokens.texts(part))[0])), segments))
            if sum(map(len, held)) > most:
                yield flush()
    if held:
        yield flush()


def _hash_words(batches: Iterator[pa.RecordBatch], segments: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = keyed(np.array([xxhash.xxh64_intdigest(w) for w in batch.column("token").to_pylist()], dtype=np.uint64), segments)
        order = np.argsort(h)
        yield _by_segment(h[order], batch.column("c").to_numpy(zero_copy_only=False)[order], segments)


def _filled(h: np.ndarray, counts: np.ndarray, words: int | None = None) -> tuple[np.ndarray, int]:
    """A segment of the filter, of ``words`` or as its entries need, and the highest level in it."""
    q = levels(counts).astype(np.int8)
    size = words or -(-int(q.sum(dtype=np.int64)) * ENTRY_BITS // 64)
    own = np.zeros(size, dtype=np.uint64)
    highest = int(q.max(initial=0))
    for a in range(0, len(h), AT_ONCE):
        some, level = h[a : a + AT_ONCE], q[a : a + AT_ONCE]
        for k in range(1, int(level.max()) + 1):
            where, mask = place(some[level >= k], k, size)
            np.bitwise_or.at(own, where, mask)
    return own, highest


STORED = "segment int, words long, highest int, bits binary"


def _build(batches: Iterator[pa.RecordBatch], segments: int, words: int | None) -> Iterator[pa.RecordBatch]:
    """Segments of the filter from their n-grams, segment after segment, each of ``words`` or as its entries need."""

    def made(s: int, keys: list[bytes], counts: list[bytes]) -> pa.RecordBatch:
        h, at = distinct(np.concatenate([unpacked(k, s, segments) for k in keys]))
        own, highest = _filled(h, np.bincount(at, weights=np.frombuffer(b"".join(counts), dtype="<i8")), words)
        return pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([len(own)], pa.int64()), pa.array([highest], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["segment", "words", "highest", "bits"])

    now, keys, counts = None, [], []
    for batch in batches:
        for s, k, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if s != now and keys:
                yield made(now, keys, counts)
                keys, counts = [], []
            now = s
            keys.append(k)
            counts.append(c)
    if keys:
        yield made(now, keys, counts)


def is_held_out(id_col: Column) -> Column:
    """Rows that the contract keeps out of training; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1


def _learn_words(rows: DataFrame, head_words: int) -> tuple[DataFrame, int, int, int, dict[bytes, int]]:
    """Table of exact word counts, tokens, distinct tokens, the highest count, and the frequent words."""
    words = scratch.table(rows.mapInArrow(_count_words, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c")), "words")
    total, kinds, most = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.max("c"), F.lit(0))).first()
    frequent = words.orderBy(F.desc("c"), "token").limit(head_words).toArrow()  # head_words rows
    head = dict(zip(frequent.column("token").to_pylist(), frequent.column("c").to_pylist(), strict=True))
    return words, total, kinds, most, head


def segments_for(total: int) -> int:
    """Segments of the filter, a power of two, for so many tokens sent to them."""
    return max(SEGMENTS, 1 << (total // SEGMENT_TOKENS).bit_length())


def train(texts: DataFrame, text_col: str = "text", filter_bits: int | None = None, head_words: int = 1 << 18, pair_weight: float = 0.7, broadcast_bits: int = 1 << 29) -> tuple[Filter, DataFrame]:
    """The filter over all words and word pairs of ``texts``, and the table of exact word counts ``token, c``.

    The filter has ``ENTRY_BITS`` for every entry counted, unless ``filter_bits``
    sets its size. One of more than ``broadcast_bits`` stays in its segments.
    """
    rows = texts.select(F.col(text_col).cast("string").alias("text"))
    words, total, kinds, _, head = _learn_words(rows, head_words)
    segments = segments_for(total)
    ngrams = rows.mapInArrow(lambda b: _count_pairs(b, segments), COUNTED).unionByName(words.mapInArrow(lambda b: _hash_words(b, segments), COUNTED))
    ngrams = ngrams.repartition("segment") if segments == SEGMENTS else ngrams.repartition(segments, "segment")
    fixed = filter_bits and max(1, filter_bits // 64 // segments)
    stored = scratch.table(ngrams.sortWithinPartitions("segment").mapInArrow(lambda b: _build(b, segments, fixed), STORED), "segments")
    size, highest = stored.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.max("highest"), F.lit(0))).first()
    sizes, bits = np.ones(segments, dtype=np.int64), None
    if size * 64 <= broadcast_bits:
        for r in stored.select("segment", "words").collect():  # one row a segment, of a filter that is broadcast
            sizes[r.segment] = r.words
        starts = np.cumsum(sizes) - sizes
        bits = np.zeros(sizes.sum(), dtype=np.uint64)
        for r in stored.select("segment", "bits").toLocalIterator():  # broadcast_bits in all
            bits[starts[r.segment] : starts[r.segment] + sizes[r.segment]] = np.frombuffer(r.bits, dtype=np.uint64)
    return Filter(bits, sizes, highest, stored, total, kinds, head, pair_weight), words


SCORES = "row long, doc_id long, n_tokens long, known long, base double, score double, token binary, tf long"


def _coded(part: pa.RecordBatch) -> tuple[np.ndarray, pa.BinaryArray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each text, the words, and the hashes; for each token the number of its word and the hash of its pair."""
    seq, counts = _sequence(tokens.texts(part))
    coded = pa.array(seq, pa.binary()).dictionary_encode()
    kinds, ids = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, kinds.to_pylist()), dtype=np.uint64, count=len(kinds))
    return counts, kinds, h, ids, _pairs(h[ids])


def _score_piece(part: pa.RecordBatch, model: Filter, level: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """For each text its score and the base score of its frequent words; then its other words, counted.

    ``level`` has the levels of the piece's distinct n-grams in order, where they were looked up before.
    """
    names = [x.split()[0] for x in SCORES.split(", ")]
    counts, kinds, h, ids, pairs = _coded(part)
    starts = np.cumsum(counts) - counts
    exact = np.fromiter((model.head.get(w, -1) for w in kinds.to_pylist()), dtype=np.float64, count=len(kinds))
    both = np.concatenate([h, pairs])
    held = model.counts(both) if level is None else level_count(np.arange(128))[level[distinct(keyed(both, len(model.words)))[1]]]
    held, of_pairs = held[: len(h)], held[len(h) :]

    alone = (held + 0.5) / model.mass
    before = np.concatenate([ids[-1:], ids[:-1]])  # the last token is an end
    context = held[before]
    share = np.minimum(of_pairs, context) / np.maximum(context, 1)
    p = np.where(context > 0, model.pair_weight * share + (1 - model.pair_weight) * alone[ids], alone[ids])
    score = np.add.reduceat(np.log10(p), starts)

    base = np.where(exact >= 0, np.log10((np.maximum(exact, 0) + 0.5) / model.mass), 0.0)
    own = np.add.reduceat(base[ids], starts)
    known = np.add.reduceat((exact >= 0)[ids].astype(np.int64), starts)
    row, doc = part.column("row"), part.column("doc_id")
    n = len(counts)
    yield pa.RecordBatch.from_arrays([row, doc, pa.array(counts), pa.array(known), pa.array(own), pa.array(score), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], names=names)

    rare = np.flatnonzero(exact[ids] < 0)
    pair, tf = np.unique(np.repeat(np.arange(n), counts)[rare] * len(kinds) + ids[rare], return_counts=True)
    m = len(pair)
    spelt = kinds.take(pa.array(pair % len(kinds)))
    yield pa.RecordBatch.from_arrays([row.take(pa.array(pair // len(kinds))), pa.nulls(m, pa.int64()), *[pa.nulls(m, pa.int64())] * 2, *[pa.nulls(m, pa.float64())] * 2, spelt, pa.array(tf.astype(np.int64))], names=names)


def _score(batches: Iterator[pa.RecordBatch], model: Filter) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tokens.pieces(batch, max_bytes=4 << 20):
            yield from _score_piece(part, model)


#: Rows of the exchange with the segments: the filter's bits (row null), n-grams of a run of rows by its first row, their levels, or a row itself.
SENT = "piece long, row long, segment int, data binary, doc_id long, text string"
_LAST = 2**31 - 1


def _sent(piece: list[int], row: list[int], segment: list[int], data: list[bytes]) -> pa.RecordBatch:
    n = len(piece)
    return pa.RecordBatch.from_arrays([pa.array(piece, pa.int64()), pa.array(row, pa.int64()), pa.array(segment, pa.int32()), pa.array(data, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())], names=[x.split()[0] for x in SENT.split(", ")])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the pieces that they are in, named by their first rows."""
    for batch in batches:
        for part in tokens.pieces(batch, max_bytes=2 << 20):
            piece = pa.array(np.full(part.num_rows, part.column("row")[0].as_py(), dtype=np.int64))
            yield pa.RecordBatch.from_arrays([piece, part.column("row"), part.column("doc_id"), part.column("text")], names=["piece", "row", "doc_id", "text"])


def _probes(part: pa.RecordBatch, segments: int) -> np.ndarray:
    _, _, h, _, pairs = _coded(part)
    return distinct(keyed(np.concatenate([h, pairs]), segments))[0]


def _ask(batches: Iterator[pa.RecordBatch], segments: int) -> Iterator[pa.RecordBatch]:
    """The distinct n-grams of each run of rows of one piece, in order, cut by segment."""

    def flush() -> pa.RecordBatch:
        part = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        h = _probes(part, segments)
        of, at = np.unique(segment_of(h, segments), return_index=True)
        n = len(of)
        return _sent([part.column("piece")[0].as_py()] * n, [part.column("row")[0].as_py()] * n, of.tolist(), [packed(x, segments) for x in np.split(h, at[1:])])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        piece = batch.column("piece").to_numpy()
        at = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(piece)]
        for a, b in zip(at, at[1:], strict=False):
            if held and a < b and held[-1].column("piece")[0].as_py() != piece[a]:
                yield flush()
                held.clear()
            if a < b:
                held.append(batch.slice(a, b - a))
    if held:
        yield flush()


def _answer(batches: Iterator[pa.RecordBatch], segments: int, highest: int) -> Iterator[pa.RecordBatch]:
    """Levels of the n-grams sent to each segment, whose bits come first; a segment without bits has none."""
    at, bits = -1, None
    for batch in batches:
        piece, row, segment, data = (batch.column(c).to_pylist() for c in ("piece", "row", "segment", "data"))
        out: list[bytes] = []
        for p, s, d in zip(row, segment, data, strict=True):
            if s != at:
                at, bits = s, None
            if p is None:
                bits = np.frombuffer(d, dtype=np.uint64)
                continue
            h = unpacked(d, s, segments)
            n = np.full(len(h), 0 if bits is None else len(bits), dtype=np.int64)
            out.append((np.zeros(len(h), dtype=np.int8) if bits is None else probe(h, bits, n, np.zeros(len(h), dtype=np.int64), highest)).tobytes())
        asked = [k for k, p in enumerate(row) if p is not None]
        yield _sent([piece[k] for k in asked], [row[k] for k in asked], [segment[k] for k in asked], out)


def _score_runs(batches: Iterator[pa.RecordBatch], model: Filter) -> Iterator[pa.RecordBatch]:
    """Scores of runs of rows, each after the levels of its n-grams in the order of the segments."""

    def flush() -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        yield from _score_piece(part, model, np.frombuffer(b"".join(answers), dtype=np.int8))

    answers: list[bytes] = []
    rows: list[pa.RecordBatch] = []
    for batch in batches:
        own = batch.column("segment").to_numpy() == _LAST
        at = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
        for a, b in zip(at, at[1:], strict=False):
            if a < b and own[a]:
                rows.append(batch.select(["row", "doc_id", "text"]).slice(a, b - a))
            elif a < b:
                if rows:
                    yield from flush()
                    rows.clear()
                    answers.clear()
                answers += batch.column("data").slice(a, b - a).to_pylist()
    if rows:
        yield from flush()


def _score_by_segments(rows: DataFrame, model: Filter, sent: Broadcast[Filter]) -> DataFrame:
    """What :func:`_score` makes, with a filter that no task can hold."""
    segments, highest = len(model.words), model.highest
    cut = scratch.table(rows.mapInArrow(_cut, "piece long, row long, doc_id long, text string"), "pieces", codec="zstd")
    null = [F.lit(None).cast(t).alias(n) for n, t in (("doc_id", "long"), ("text", "string"))]
    bits = model.stored.select(F.lit(None).cast("long").alias("piece"), F.lit(None).cast("long").alias("row"), "segment", F.col("bits").alias("data"), *null)
    asked = cut.mapInArrow(lambda b: _ask(b, segments), SENT).unionByName(bits).repartition("segment").sortWithinPartitions("segment", F.asc_nulls_first("row"))
    found = asked.mapInArrow(lambda b: _answer(b, segments, highest), SENT)
    own = cut.select("piece", "row", F.lit(_LAST).alias("segment"), F.lit(None).cast("binary").alias("data"), "doc_id", "text")
    together = found.unionByName(own).repartition("piece").sortWithinPartitions("piece", "row", "segment")
    return together.mapInArrow(lambda b: _score_runs(b, sent.value), SCORES)


def _with_rare_words(scored: DataFrame, model: Filter, words: DataFrame) -> DataFrame:
    """The columns of :func:`score`, with the exact counts of the words that are not in the head."""
    made = scratch.table(scored, "scores")
    whole = made.filter("token IS NULL").select("row", "doc_id", "n_tokens", "known", "base", "score")
    rare = made.filter("token IS NOT NULL").select("row", "token", "tf").join(words, "token", "left")
    chance = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(float(model.mass)))
    rare = rare.groupBy("row").agg(F.sum(F.col("tf") * chance).alias("rare_base"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("rare_known"))
    return whole.join(rare, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        "score",
    )


def score(docs: DataFrame, model: Filter, words: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, n_known, train_tokens, base_score, score``.

    * Null text is empty: one token, the end. Words are runs of characters other
      than ASCII white space, A-Z lower-cased.
    * ``base_score`` is exact: sums of log10 of add-half unigram probabilities.
    * ``score`` is the model's log10 probability: ``pair_weight`` of the pair's
      share of its first word, the rest of the word's own probability.
    * Repeated and null ids are rows like any other. With nothing learnt, every
      word is unknown and both scores are those of the empty corpus.
    """
    scratch.settle(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), long_id(docs, id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = _score_by_segments(rows, model, sent) if model.bits is None else rows.mapInArrow(lambda b: _score(b, sent.value), SCORES)
    return _with_rare_words(scored, model, words)


#: Rows of the joint pass: the texts of a piece (segment ``_LAST``), its n-grams of a segment with how often the learnt texts have them, or their levels.
JOINT = "piece long, segment int, n int, data binary, counts binary"


def _joint(piece: list[int], segment: list[int], n: list[int], data: list[bytes], counts: list[bytes | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(piece, pa.int64()), pa.array(segment, pa.int32()), pa.array(n, pa.int32()), pa.array(data, pa.binary()), pa.array(counts, pa.binary())], names=[x.split()[0] for x in JOINT.split(", ")])


def _squeezed(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def _opened(data: bytes, n: int, dtype: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(dtype).itemsize, codec="zstd"), dtype=dtype)


def _pack_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in pieces named by their first rows, each as one compressed Arrow stream, with its number of tokens."""
    for batch in batches:
        for part in tokens.pieces(batch, max_bytes=4 << 20):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(part)
            n = sum(len(v.split()) + 1 for v in tokens.texts(part))
            yield _joint([part.column("row")[0].as_py()], [_LAST], [n], [sink.getvalue().to_pybytes()], [None])


def _unpack_piece(data: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(data.as_buffer()).read_next_batch()


def _offer(batches: Iterator[pa.RecordBatch], segments: int) -> Iterator[pa.RecordBatch]:
    """The distinct n-grams of each piece, in order, cut by segment."""
    for batch in batches:
        for piece, data in zip(batch.column("piece").to_pylist(), batch.column("data"), strict=True):
            part = _unpack_piece(data)
            counts, kinds, h, ids, pairs = _coded(part)
            learnt = np.repeat(part.column("learn").to_numpy(zero_copy_only=False), counts).astype(np.float64)
            keys, at = distinct(keyed(np.concatenate([h, pairs]), segments))
            n = np.bincount(at, weights=np.concatenate([np.bincount(ids, weights=learnt, minlength=len(kinds)), learnt])).astype("<u4")
            of, cut = np.unique(segment_of(keys, segments), return_index=True)
            own = np.split(keys, cut[1:])
            yield _joint([piece] * len(of), of.tolist(), list(map(len, own)), [packed(x, segments) for x in own], list(map(_squeezed, np.split(n, cut[1:]))))


def _learn_and_answer(batches: Iterator[pa.RecordBatch], segments: int, highest: int) -> Iterator[pa.RecordBatch]:
    """Levels of the n-grams of each piece, segment after segment, by the filter's segment that all of them fill."""

    def made(s: int, piece: list[int], n: list[int], data: list[bytes], counts: list[bytes]) -> pa.RecordBatch:
        h, at = distinct(np.concatenate([unpacked(x, s, segments) for x in data]))
        c = np.bincount(at, weights=np.concatenate([_opened(x, k, "<u4") for x, k in zip(counts, n, strict=True)]))
        learnt = c > 0
        bits, _ = _filled(h[learnt], c[learnt])
        del c, learnt
        level = np.zeros(len(h), dtype=np.int8)
        for a in range(0, len(h) if len(bits) else 0, AT_ONCE):
            some = h[a : a + AT_ONCE]
            level[a : a + AT_ONCE] = probe(some, bits, np.full(len(some), len(bits)), np.zeros(len(some), dtype=np.int64), highest)
        return _joint(piece, [s] * len(piece), n, list(map(_squeezed, np.split(level[at], np.cumsum(n)[:-1]))), [None] * len(piece))

    now, held = None, []
    for batch in batches:
        for s, *row in zip(*(batch.column(c).to_pylist() for c in ("segment", "piece", "n", "data", "counts")), strict=True):
            if s != now and held:
                yield made(now, *map(list, zip(*held, strict=True)))
                held.clear()
            now = s
            held.append(row)
    if held:
        yield made(now, *map(list, zip(*held, strict=True)))


def _score_pieces(batches: Iterator[pa.RecordBatch], model: Filter) -> Iterator[pa.RecordBatch]:
    """Scores of pieces, each after the levels of its n-grams in the order of the segments."""
    answers: list[np.ndarray] = []
    for batch in batches:
        for segment, n, data in zip(batch.column("segment").to_pylist(), batch.column("n").to_pylist(), batch.column("data"), strict=True):
            if segment != _LAST:
                answers.append(_opened(data.as_buffer(), n, "i1"))
                continue
            yield from _score_piece(_unpack_piece(data), model, np.concatenate(answers))
            answers.clear()


def train_and_score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", head_words: int = 1 << 18, pair_weight: float = 0.7) -> DataFrame:
    """What :func:`score` returns for ``docs`` by the model that :func:`train` makes of those where ``learn`` holds.

    The n-grams of every piece of text are sent to the filter's segments once: there
    they fill the segment, and are then looked up in it. No part of the filter is
    stored, sent or broadcast, whatever its size.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), long_id(docs, id_col).alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text_col).cast("string").alias("text"))
    words, total, kinds, most, head = _learn_words(rows.filter("learn").select("text"), head_words)
    highest = int(levels(np.array([most]))[0])  # no pair is more frequent than its words
    scratch.settle(spark)
    texts = scratch.table(rows.mapInArrow(_pack_pieces, JOINT), "pieces")
    segments = segments_for(texts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    sent = spark.sparkContext.broadcast(model := Filter(None, np.ones(segments, dtype=np.int64), highest, None, total, kinds, head, pair_weight))
    offered = texts.mapInArrow(lambda b: _offer(b, segments), JOINT)
    offered = offered.repartition("segment") if segments == SEGMENTS else offered.repartition(segments, "segment")
    found = offered.sortWithinPartitions("segment").mapInArrow(lambda b: _learn_and_answer(b, segments, highest), JOINT)
    together = found.unionByName(texts).repartition("piece").sortWithinPartitions("piece", "segment")
    scored = _with_rare_words(together.mapInArrow(lambda b: _score_pieces(b, sent.value), SCORES), model, words)
    scratch.drop_table(texts)
    scratch.settle(spark)
    return scored


def false_positive_rate(model: Filter, probes: int = 100_000) -> float:
    """Measured share of n-grams that were never added and yet found."""
    h = np.random.default_rng(1).integers(0, 2**64, probes, dtype=np.uint64)
    return float((model.counts(h) > 0).mean())


def perplexity(score10: float, n_tokens: int) -> float:
    """Perplexity per token of a log10 probability."""
    return math.pow(10, -score10 / max(1, n_tokens))
