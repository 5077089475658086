"""Words, word hashes and shingles over Arrow batches, vectorised.

Words are runs of bytes other than ASCII white space, lower-cased in A-Z
unless the caller has normalised before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_S = np.uint64(29)


def pieces(batch: pa.RecordBatch, column: str = "text", max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold at most ``max_bytes``, or one row.

    The words of a piece take some twenty times its bytes, and a task holds one piece
    at a time. What Arrow keeps of a batch is given back after its last piece.
    """
    lengths = np.asarray([0 if x is None else x for x in pc.binary_length(batch.column(column)).to_pylist()], dtype=np.int64)
    group = (np.cumsum(lengths) - lengths) // max_bytes if len(lengths) else lengths
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    for a, b in zip(starts, np.append(starts[1:], len(lengths)), strict=True):
        yield batch.slice(int(a), int(b - a))
    pa.default_memory_pool().release_unused()


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's values as bytes; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def split(values: list[bytes], lower: bool = True) -> tuple[list[bytes], np.ndarray]:
    """All words, one after the other, and the number in each value."""
    words: list[bytes] = []
    counts = np.zeros(len(values), dtype=np.int64)
    for k, v in enumerate(values):
        own = (v.lower() if lower else v).split()
        counts[k] = len(own)
        words += own
    return words, counts


def hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, computed once for each distinct one."""
    known = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _M2
    return x ^ (x >> _S)


def shingles(h: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``size`` words, document after document, and how many each has.

    A document with fewer words, but not none, has its whole sequence as one.
    """
    ends = np.cumsum(counts)
    starts = ends - counts
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    total = int(made.sum())
    if not total:
        return np.zeros(0, dtype=np.uint64), made
    own = np.repeat(np.arange(len(counts)), made)
    at = np.arange(total) - np.repeat(np.cumsum(made) - made, made) + starts[own]
    width = np.minimum(counts, size)[own]
    out = np.zeros(total, dtype=np.uint64)
    for j in range(size):
        if (full := width > j).all():
            out = mix(out * _M1 + h[at + j])
        else:
            out[full] = mix(out[full] * _M1 + h[at[full] + j])
    return out, made
