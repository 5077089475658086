"""Sequence composition: k-mer statistics, correlation of profiles, and clustering by them."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern import scratch
from quern.functions import sequence as S

TETRAMERS = ["".join(p) for p in itertools.product("ACGT", repeat=4)]


#: Most windows that a task holds at a time, and the longest ones whose codes fit a number with that of their sequence.
WINDOWS, LONGEST = 1 << 20, 24


def kmer_counts(seqs: DataFrame, k: int = 4, both_strands: bool = True) -> DataFrame:
    """``id, kmer, n``: windows of ``k`` bases without N, on both strands.

    Windows are counted within each sequence, piece by piece; only the counts are
    dealt out, by ``id`` and by their number, to add up sequences of one id. The
    other strand's counts are those of the reverse complements.
    """
    kind = seqs.schema["id"].dataType.simpleString()
    if k <= LONGEST:
        found = seqs.select("id", "seq").filter("seq IS NOT NULL").mapInArrow(lambda batches: _counted(batches, k, both_strands), f"id {kind}, kmer string, n long")
    else:
        found = seqs.select("id", F.explode(S.kmers(F.col("seq"), k)).alias("kmer"), F.lit(1).cast("long").alias("n")).filter(~F.rlike("kmer", F.lit("[^ACGT]")))
        found = found.unionByName(found.select("id", S.reverse_complement(F.col("kmer")).alias("kmer"), "n")) if both_strands else found
    found = scratch.table(found, "windows")
    return scratch.dealt(found, found.count(), "id").groupBy("id", "kmer").agg(F.sum("n").alias("n"))


def _counted(batches: Iterator[pa.RecordBatch], k: int, both_strands: bool) -> Iterator[pa.RecordBatch]:
    """Each sequence's windows and their numbers."""
    letter = np.full(256, 4, dtype=np.uint8)
    letter[np.frombuffer(b"ACGT", dtype=np.uint8)] = np.arange(4)
    for batch in batches:
        for part in S.pieces(batch, "seq", WINDOWS):
            own = [x.encode() for x in part.column("seq").to_pylist()]
            codes, ends = letter[np.frombuffer(b"".join(own), dtype=np.uint8)], np.cumsum([len(x) for x in own])
            for first in range(0, len(codes) - k + 1, WINDOWS):
                some = codes[first : first + WINDOWS + k - 1]
                owner = np.searchsorted(ends, np.arange(first, first + len(some)), side="right")
                windows = len(some) - k + 1
                key, good = owner[:windows].copy(), owner[:windows] == owner[k - 1 :]
                for j in range(k):
                    code = some[j : j + windows]
                    good &= code < 4
                    key = key << 2 | (code & 3)
                yield from _summed(part.column("id"), key[good], k, both_strands)


def _summed(ids: pa.Array, key: np.ndarray, k: int, both_strands: bool) -> Iterator[pa.RecordBatch]:
    """Windows as numbers, that of their sequence before their bases, with how often they occur."""
    key, n = np.unique(key, return_counts=True)
    if both_strands:
        turned = key >> 2 * k
        for j in range(k):
            turned = turned << 2 | 3 - (key >> 2 * j & 3)
        key, at = np.unique(np.concatenate([key, turned]), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([n, n]), minlength=len(key)).astype(np.int64)
    bases = np.frombuffer(b"ACGT", dtype=np.uint8)
    for at in range(0, len(key), 100_000):
        some = key[at : at + 100_000]
        text = np.stack([bases[some >> 2 * (k - 1 - j) & 3] for j in range(k)], axis=1)
        kmer = pa.StringArray.from_buffers(len(some), pa.py_buffer(np.arange(0, len(some) * k + 1, k, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(text)))
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(some >> 2 * k)), kmer, pa.array(n[at : at + 100_000])], names=["id", "kmer", "n"])


def _gathered(counts: DataFrame) -> DataFrame:
    """A sequence's counts, 256 at most, in one row."""
    return counts.groupBy("id").agg(F.collect_list(F.struct("kmer", "n")).alias("c")).select("id", "c.kmer", "c.n")


def z_scores(counts: DataFrame) -> DataFrame:
    """``id, kmer, z``: how far each tetranucleotide's count is from what its parts predict; 256 rows a sequence.

    Expected is front * back / centre, of the front and back trinucleotides and the
    centre dinucleotide; the variance is expected * (centre - front) * (centre -
    back) / centre squared. Without a variance the score is nothing. A sequence's
    counts, 256 at most, are gathered once.
    """
    kind = counts.schema["id"].dataType.simpleString()
    return _gathered(counts).mapInArrow(_scored, f"id {kind}, kmer string, z double")


def _dense(part: pa.RecordBatch) -> np.ndarray:
    """A row of 256 counts for each list of tetranucleotides and counts."""
    names = part.column("kmer")
    where = pc.index_in(names.flatten(), pa.array(TETRAMERS)).to_numpy(zero_copy_only=False)
    dense = np.zeros((part.num_rows, len(TETRAMERS)))
    dense[pc.list_parent_indices(names).to_numpy(zero_copy_only=False), where] = part.column("n").flatten().to_numpy(zero_copy_only=False)
    return dense


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Profiles of sequences that come as lists of their tetranucleotides and counts."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            ids = part.column("id").take(pa.array(np.repeat(np.arange(part.num_rows), len(TETRAMERS))))
            yield pa.RecordBatch.from_arrays([ids, pa.array(TETRAMERS * part.num_rows), pa.array(_z_matrix(_dense(part)).ravel())], names=["id", "kmer", "z"])


def _laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same, one row a sequence."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            yield pa.RecordBatch.from_arrays([part.column("id"), *[pa.array(z) for z in _z_matrix(_dense(part)).T]], names=["id", *TETRAMERS])


def z_table(counts: DataFrame) -> DataFrame:
    """The scores of :func:`z_scores`, one row per sequence, a column per tetranucleotide."""
    kind = counts.schema["id"].dataType.simpleString()
    return _gathered(counts).mapInArrow(_laid_out, f"id {kind}, " + ", ".join(f"{k} double" for k in TETRAMERS))


#: The largest block of profiles; two of them and their product's stripes are what a task holds.
BLOCK = 2048


def profile_pairs(z: DataFrame, block: int | None = None, least: float | None = None) -> DataFrame:
    """``a, b, r``: Pearson correlation of all pairs of profiles, in blocks.

    All pairs are the operator. Profiles are gathered into blocks of about ``block``,
    and each pair of blocks is one matrix product; a task holds two blocks, whatever
    their number. Blocks are as large as leaves every core some pairs of them, since
    each profile is sent once for every block. With ``least`` only pairs whose
    correlation has at least that size leave a task.
    """
    kind = dict(z.dtypes)["id"]
    rows = z.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("kmer", "z"))), lambda x: x["z"]).alias("v"))
    rows = scratch.table(rows, "profiles")
    cores, many = z.sparkSession.sparkContext.defaultParallelism, rows.count()
    if block is None:
        block = min(BLOCK, max(64, -(-many // (2 * math.isqrt(2 * cores) + 1))))
    n = max(1, -(-many // block))
    blocks = rows.withColumn("blk", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    left = blocks.select(F.col("blk").alias("i"), F.explode(F.sequence(F.col("blk"), F.lit(n - 1))).alias("j"), "id", "v", F.lit(0).alias("side"))
    right = blocks.filter("blk > 0").select(F.explode(F.sequence(F.lit(0), F.col("blk") - 1)).alias("i"), F.col("blk").alias("j"), "id", "v", F.lit(1).alias("side"))

    def correlate(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        sides = [rows.filter(pc.equal(rows["side"], k)).combine_chunks() for k in (0, 1)]

        def part(own: pa.Table) -> tuple[pa.Array, np.ndarray]:
            values = own["v"].combine_chunks()
            x = values.flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1) if len(own) else np.zeros((0, 1))
            x = x - x.mean(axis=1, keepdims=True)
            size = np.sqrt((x * x).sum(axis=1, keepdims=True))
            return own["id"].combine_chunks(), np.divide(x, size, out=np.zeros_like(x), where=size > 0)

        one = rows["i"][0] == rows["j"][0]
        a, x = part(sides[0])
        b, y = (a, x) if one else part(sides[1])
        out = []
        for at in range(0, len(x) if len(y) else 0, 256):
            r = x[at : at + 256] @ y.T
            wanted = np.arange(at, at + len(r))[:, None] < np.arange(len(y)) if one else np.ones(r.shape, dtype=bool)
            if least is not None:
                wanted &= np.abs(r) >= least
            p, q = np.nonzero(wanted)
            u, v = a.take(pa.array(p + at)), b.take(pa.array(q))
            low = pc.less(u, v)
            out.append(pa.table([pc.if_else(low, u, v), pc.if_else(low, v, u), pa.array(r[p, q])], names=["a", "b", "r"]))
        return pa.concat_tables(out) if out else pa.table([a.slice(0, 0), a.slice(0, 0), pa.array([], pa.float64())], names=["a", "b", "r"])

    pairs = n * (n + 1) // 2
    both = left.unionByName(right).repartition(max(cores, pairs // 2), "i", "j")
    return both.groupBy("i", "j").applyInArrow(lambda rows: correlate(rows), f"a {kind}, b {kind}, r double")


def chunk_sequences(seqs: DataFrame, size: int) -> DataFrame:
    """Windows of ``size`` bases one after the other, the rest dropped, named ``id.start.stop``."""
    pieces = F.regexp_extract_all("seq", F.lit(f"(.{{{size}}})"), F.lit(1))
    rows = seqs.select("id", F.posexplode(pieces).alias("k", "seq"))
    return rows.select(F.concat_ws(".", F.col("id").cast("string"), (F.col("k") * size).cast("string"), ((F.col("k") + 1) * size - 1).cast("string")).alias("id"), "seq")


def _z_matrix(counts):  # noqa: ANN001, ANN202
    """Z profiles of rows of 256 counts."""

    t = np.asarray(counts, dtype=float).reshape(-1, 4, 4, 4, 4)
    front, back, centre = t.sum(axis=4, keepdims=True), t.sum(axis=1, keepdims=True), t.sum(axis=(1, 4), keepdims=True)
    with np.errstate(all="ignore"):
        expected = front * back / centre
        z = (t - expected) / np.sqrt(expected * (centre - front) * (centre - back) / centre**2)
    return np.where(np.isfinite(z), z, 0.0).reshape(-1, 256)


def _tri_z(counts):  # noqa: ANN001, ANN202
    """The same for trinucleotides out of their dinucleotides and centre bases."""

    t = np.asarray(counts, dtype=float).reshape(-1, 4, 4, 4, 4).sum(axis=4)
    front, back, centre = t.sum(axis=3, keepdims=True), t.sum(axis=1, keepdims=True), t.sum(axis=(1, 3), keepdims=True)
    with np.errstate(all="ignore"):
        expected = front * back / centre
        z = (t - expected) / np.sqrt(expected * (centre - front) * (centre - back) / centre**2)
    return np.where(np.isfinite(z), z, 0.0).reshape(-1, 64)


def merge_profiles(ids: list, counts, lengths: list[int], thresholds: Callable[[int], tuple[float, float, float]], min_len: int = 5000) -> list[list]:  # noqa: ANN001
    """Nearest-pair clustering: merges the best passing pair and recomputes it, until none passes.

    ``thresholds`` gives, for the shorter of two lengths, the primary, secondary
    and trinucleotide correlations to reach. A pair passes first class with the
    primary and trinucleotide ones, second class with the secondary one if the
    shorter is under ``min_len``; first class goes before second. Clusters of two
    or more come out, the longest first.
    """

    if not len(ids):
        return []
    return _Merger(ids, counts, lengths, thresholds, min_len).run()


class _Merger:
    """The state of :func:`merge_profiles`: each cluster's best pair with one after it, or a bound on it.

    ``key`` is a pair's class and score as one whole number, ``mate`` the other
    cluster, and ``rest`` bounds the keys of all its other pairs. A merge changes
    one row of pairs. A cluster that loses its best pair keeps ``rest`` as a bound and
    is looked through again only when that bound is the largest key of all.
    """

    NONE = -(10**15)
    #: Rows of pairs looked through together, and scores in one of them at most.
    ROWS, CELLS = 16, 1 << 21

    def __init__(self, ids: list, counts, lengths: list[int], thresholds: Callable[[int], tuple[float, float, float]], min_len: int) -> None:  # noqa: ANN001
        self.counts = np.array(counts, dtype=float).reshape(len(ids), 256)
        self.members, self.size, self.min_len, self.thresholds = [[x] for x in ids], np.array(lengths, dtype=float), min_len, thresholds
        self.limits = np.array([thresholds(int(x)) for x in lengths], dtype=float)
        self.z, self.t = (np.concatenate([self._unit(f(self.counts[at : at + 4096])) for at in range(0, len(ids), 4096)]) for f in (_z_matrix, _tri_z))
        self.alive = np.ones(len(ids), dtype=bool)
        self.key, self.rest = (np.full(len(ids), self.NONE, dtype=np.int64) for _ in range(2))
        self.mate = np.full(len(ids), -1)

    @staticmethod
    def _unit(x):  # noqa: ANN001, ANN205
        x = x - x.mean(axis=1, keepdims=True)
        n = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return np.divide(x, n, out=np.zeros_like(x), where=n > 0)

    def _keys(self, rows: np.ndarray, at: int) -> np.ndarray:
        """Keys of the pairs of some clusters with all from ``at`` on."""
        a, b = self.z[rows] @ self.z[at:].T, self.t[rows] @ self.t[at:].T
        own, other = self.size[rows][:, None], self.size[at:][None, :]
        primary, secondary, tri = (np.where(other < own, self.limits[at:, k][None, :], self.limits[rows, k][:, None]) for k in range(3))
        whole = lambda r: np.rint(r * 1e12).astype(np.int64)
        first = (a >= primary) & (b >= tri)
        keys = np.where(first, whole(a) + 10**13, self.NONE)
        if (self.size < self.min_len).any():
            second = ~first & (a >= secondary) & (np.minimum(own, other) < self.min_len)
            keys[second] = whole(b[second])
        keys[:, ~self.alive[at:]] = self.NONE
        return keys

    def _look(self, rows: np.ndarray) -> None:
        """The best pair of each of some clusters with one after it, and the bound on its other pairs."""
        at = int(rows.min())
        keys = self._keys(rows, at)
        keys[np.arange(at, at + keys.shape[1])[None, :] <= rows[:, None]] = self.NONE
        every = np.arange(len(rows))
        best = keys.argmax(axis=1)
        self.key[rows] = keys[every, best]
        keys[every, best] = self.NONE
        self.mate[rows], self.rest[rows] = best + at, keys.max(axis=1)

    def _merge(self, i: int, j: int) -> None:
        """Cluster ``j`` goes into ``i``, which comes before it."""
        self.counts[i] += self.counts[j]
        self.size[i] += self.size[j]
        self.members[i] += self.members[j]
        self.alive[j], self.key[j], self.rest[j] = False, self.NONE, self.NONE
        self.limits[i] = self.thresholds(int(self.size[i]))
        self.z[i], self.t[i] = self._unit(_z_matrix(self.counts[i : i + 1]))[0], self._unit(_tri_z(self.counts[i : i + 1]))[0]
        new = self._keys(np.array([i]), 0)[0]
        lost = self.alive & (self.key > self.NONE) & (self.mate == j)
        lost[:i] |= self.mate[:i] == i
        lost &= self.alive
        self.key[lost], self.mate[lost] = self.rest[lost], -1
        # Of the clusters before i each has a new pair with i; a bound gives way to a pair above it.
        k, pair = slice(0, i), new[:i]
        better = (pair > self.key[k]) | (pair == self.key[k]) & (self.mate[k] > i)
        better &= pair > self.NONE
        self.rest[k] = np.where(better, self.key[k], np.maximum(self.rest[k], pair))
        self.key[k][better], self.mate[k][better] = pair[better], i
        after = new[i + 1 :]
        if len(after):
            best = int(after.argmax())
            self.key[i], self.mate[i] = after[best], best + i + 1
            after[best] = self.NONE
            self.rest[i] = after.max()
        else:
            self.key[i], self.rest[i] = self.NONE, self.NONE

    def _pack(self) -> None:
        """Leaves out what is merged away; the order stays."""
        kept = np.flatnonzero(self.alive)
        place = np.full(len(self.alive), -1)
        place[kept] = np.arange(len(kept))
        self.mate = np.where(self.mate[kept] >= 0, place[self.mate[kept]], -1)
        self.members = [self.members[k] for k in kept]
        for name in ("counts", "size", "limits", "z", "t", "key", "rest", "alive"):
            setattr(self, name, getattr(self, name)[kept])

    def run(self) -> list[list]:
        n = len(self.alive)
        step = max(1, min(self.CELLS // n, 512))
        for at in range(0, n, step):
            self._look(np.arange(at, min(at + step, n)))
        gone = 0
        while (top := self.key.max()) > self.NONE:
            rows = np.flatnonzero(self.key == top)
            stale = rows[self.mate[rows] < 0]
            if len(stale):
                # Those that come next are looked through with them.
                others = np.flatnonzero((self.mate < 0) & (self.key > self.NONE) & (self.key < top))
                room = max(0, self.ROWS - len(stale))
                if len(others) > room:
                    others = others[np.argpartition(-self.key[others], room)[:room]] if room else others[:0]
                both = np.sort(np.concatenate([stale, others]))
                for at in range(0, len(both), self.ROWS):
                    self._look(both[at : at + self.ROWS])
                continue
            i = int(rows[0])
            self._merge(i, int(self.mate[i]))
            gone += 1
            if gone * 8 > len(self.alive) + 64:
                self._pack()
                gone = 0
        found = sorted((i for i in np.flatnonzero(self.alive) if len(self.members[i]) > 1), key=lambda i: (-self.size[i], str(self.members[i][0])))
        return [self.members[i] for i in found]


def cluster(seqs: DataFrame, threshold: float = 0.9, secondary: float | None = None, tri: float | None = None, min_len: int = 5000, merge_len: int | None = None, most: int | None = None, thresholds: Callable[[int], tuple[float, float, float]] | None = None) -> DataFrame:
    """``cluster_id, id``: sequences of at least ``min_len`` bases clustered by composition.

    Counting is distributed; the merge loop, sequential by nature, runs in one task
    over one row of 256 counts a sequence. More than ``most`` sequences are an error,
    where it is given. ``thresholds``, as in :func:`merge_profiles`, goes before the
    three fixed ones.
    """
    kind = dict(seqs.dtypes)["id"]
    long_enough = seqs.filter(F.char_length("seq") >= min_len)
    counts = kmer_counts(long_enough).filter(F.col("kmer").isin(TETRAMERS))
    rows = _gathered(counts).join(long_enough.select("id", F.char_length("seq").alias("seq_len")), "id")
    if most is not None and (n := rows.count()) > most:
        raise ValueError(f"{n} sequences to cluster; at most {most}")
    limits = (threshold, threshold if secondary is None else secondary, threshold if tri is None else tri)
    shorter = min_len if merge_len is None else merge_len

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Counts are dense as they come, so that a sequence takes 2 KB here.
        held = [(b.column("id"), b.column("seq_len").to_numpy(zero_copy_only=False), _dense(b)) for b in batches if b.num_rows]
        if not held:
            return
        ids = pa.chunked_array([x[0] for x in held]).combine_chunks()
        order = pc.sort_indices(ids)
        at = order.to_numpy()
        lengths, profiles = np.concatenate([x[1] for x in held])[at], np.concatenate([x[2] for x in held])[at]
        held.clear()
        found = merge_profiles(ids.take(order).to_pylist(), profiles, lengths.tolist(), thresholds or (lambda _: limits), shorter)
        for k, own in enumerate(found):
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(own), pa.int32()), pa.array(own, ids.type)], names=["cluster_id", "id"])

    return rows.repartition(1).mapInArrow(lambda batches: run(batches), f"cluster_id int, id {kind}")


def threshold_table(rows: list[tuple[float, float, float]]) -> Callable[[float, float], float]:
    """A threshold by (target, log2 of length), interpolated in a table of ``target, log2_length, value`` that the caller brings."""
    import bisect

    targets = sorted({r[0] for r in rows})
    grid = {t: sorted((x, v) for a, x, v in rows if a == t) for t in targets}

    def along(points: list[tuple[float, float]], x: float) -> float:
        xs = [p[0] for p in points]
        k = bisect.bisect_right(xs, x)
        if k == 0 or k == len(xs):
            return points[min(k, len(xs) - 1)][1]
        (x0, v0), (x1, v1) = points[k - 1], points[k]
        return v0 + (v1 - v0) * (x - x0) / (x1 - x0)

    return lambda target, log_len: along([(t, along(grid[t], log_len)) for t in targets], target)


def shared_kmer_fraction(query: DataFrame, reference: DataFrame, k: int = 14) -> DataFrame:
    """``id, fraction``: distinct k-mers of each query that the reference sequences have, on their forward strand."""
    q = query.select("id", F.explode(F.array_distinct(S.kmers(F.col("seq"), k))).alias("kmer"))
    r = reference.select(F.explode(F.array_distinct(S.kmers(F.col("seq"), k))).alias("kmer")).distinct().withColumn("hit", F.lit(1))
    return q.join(r, "kmer", "left").groupBy("id").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))).alias("fraction"))
