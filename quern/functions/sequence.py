"""Column functions on sequences and qualities; all are built-in expressions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: IUPAC codes and their complements, both cases.
IUPAC = "ACGTMRWSYKVHDBNacgtmrwsykvhdbn"
COMPLEMENT = "TGCAKYWSRMBDHVNtgcakywsrmbdhvn"
#: Colour digits and the letters that stand for them.
COLORS, COLOR_LETTERS = "0123.", "ACGTN"
#: Bits of the IUPAC codes, A 1, C 2, G 4, T 8.
IUPAC_BITS = {"A": 1, "C": 2, "M": 3, "G": 4, "R": 5, "S": 6, "V": 7, "T": 8, "W": 9, "Y": 10, "H": 11, "K": 12, "D": 13, "B": 14, "N": 15}

#: Trimming adds costs of -ln(1 - error) in these units, so that sums are exact.
COST_UNIT = 1_000_000_000


def chars(text: Column) -> Column:
    """The characters of a string."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def pieces(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose values of a column hold at most about ``most`` bytes, or one row."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(lengths) - lengths) // most
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    for a, b in zip(starts, np.append(starts[1:], len(lengths)), strict=True):
        yield batch.slice(int(a), int(b - a))


def phred_error(quality: Column) -> Column:
    """Error probability of a quality character."""
    return F.pow(F.lit(10.0), -(F.ascii(quality) - 33) / 10.0)


def quality_sum(qual: Column) -> Column:
    """Sum of the qualities of a read."""
    return F.aggregate(chars(qual), F.lit(0).cast("long"), lambda s, c: s + F.ascii(c) - 33)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, IUPAC, COMPLEMENT))


def clean_bases(seq: Column) -> Column:
    """Upper case, whatever is no base as N."""
    return F.regexp_replace(F.translate(seq, "acgtn", "ACGTN"), "[^ACGT]", "N")


def to_letters(colors: Column) -> Column:
    return F.translate(colors, COLORS, COLOR_LETTERS)


def to_colors(letters: Column) -> Column:
    return F.translate(letters, COLOR_LETTERS, COLORS)


def decode_colors(colors: Column, start: Column) -> Column:
    """Bases of a colour-space read that follows base ``start``; unknown from the first unknown colour on.

    A colour is the exclusive or of two neighbouring bases, counted A, C, G, T from 0.
    """
    base = F.lit("ACGT")
    digits = chars(colors)
    state = F.struct((F.instr(base, start) - 1).cast("int").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        at = F.when((acc["at"] >= 0) & c.isin("0", "1", "2", "3"), acc["at"].bitwiseXOR(c.cast("int"))).otherwise(-1).cast("int")
        return F.struct(at.alias("at"), F.concat(acc["out"], F.array(F.when(at >= 0, F.substring(base, at + 1, F.lit(1))).otherwise("N"))).alias("out"))

    return F.array_join(F.aggregate(digits, state, step)["out"], "")


def pack_prefix(seq: Column, length: int) -> Column:
    """The first bases in two bits each, the first lowest; N counts as A."""
    codes = F.translate(F.rpad(F.substring(seq, 1, length), length, "A"), "ACGTN", "01230")
    return F.aggregate(
        F.reverse(chars(codes)), F.lit(0).cast("long"), lambda s, c: s * 4 + c.cast("long")
    )


def packed_distance(a: Column, b: Column) -> Column:
    """Positions in which two packed prefixes differ."""
    x = a.bitwiseXOR(b)
    return F.bit_count(F.shiftright(x, 1).bitwiseOR(x).bitwiseAND(F.lit(0x5555555555555555).cast("long")))


def gc_fraction(seq: Column) -> Column:
    """G and C among unambiguous bases; null if there are none."""
    known = F.char_length(F.regexp_replace(seq, "[^ACGT]", ""))
    return F.when(known > 0, F.char_length(F.regexp_replace(seq, "[^GC]", "")) / known)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def dinucleotide_entropy(seq: Column) -> Column:
    """Bits per dinucleotide of a read: counts of pairs without N, out of its length less the pairs with N.

    The sum is divided by the read's length, so N lowers it. Two unlike bases
    cannot overlap themselves, so their pairs are what replacing them removes; a
    base's pairs with itself are its occurrences that no other character precedes.
    """
    lost = lambda s, what: (F.char_length(s) - F.char_length(F.replace(s, F.lit(what), F.lit("")))).cast("long")
    unlike = [(a, b) for b in "ACGT" for a in "ACGTN" if a != b]

    def seen(s: Column) -> Column:
        return F.array(*[lost(s, a + b) / 2 for a, b in unlike], *[lost(s, b) - F.when(F.startswith(s, F.lit(b)), 1).otherwise(0) for b in "ACGT"])

    def pairs(n: Column) -> Column:
        at = {p: F.element_at(n, k + 1) for k, p in enumerate(unlike)}
        same = [F.element_at(n, len(unlike) + 1 + k) - sum(at[a, b] for a in "ACGTN" if a != b) for k, b in enumerate("ACGT")]
        return F.array(*same, *[c for (a, _), c in at.items() if a != "N"])

    def bits(counts: Column, n: Column) -> Column:
        clean = F.aggregate(counts, F.lit(0.0), lambda t, c: t + c)
        left = n - (F.greatest(n - 1, F.lit(0)) - clean)
        return let(left, lambda w: F.aggregate(counts, F.lit(0.0), lambda t, c: t + F.when(c > 0, c * F.log2(w / c)).otherwise(0.0))) / n

    whole = F.regexp_replace(seq, "[^ACGT]", "N")
    found = let(let(whole, seen), pairs)
    return F.when(F.char_length(seq) > 0, let(found, lambda c: bits(c, F.char_length(seq))))


def error_costs(budget: int) -> np.ndarray:
    """-ln(1 - error) of each quality code in whole units, and of each that follows another, by both their errors.

    Row 0 is a code alone, row 1 + k one that follows code k. What costs more than the
    budget, as a quality of nothing does, costs one more than it.
    """
    error = np.array([10.0 ** (-(c - 33) / 10.0) for c in range(256)])
    wrong = np.vstack([error, error[:, None] * error[None, :]])
    cost = np.full(wrong.shape, float(budget + 1))
    some = wrong < 1
    cost[some] = np.minimum(np.rint(-np.log(1 - wrong[some]) * COST_UNIT), budget + 1)
    return cost.astype(np.int64)


#: Codes whose sums are held at a time, or those of one read.
CODES = 1 << 18


def prefix_within(quals: list[str | None], budget: int, color: bool) -> list[int | None]:
    """How many codes of each string cost no more than the budget together; None for None.

    A code takes some forty bytes on the way, so strings are taken a few at a time.
    """
    costs = error_costs(budget)
    out: list[int | None] = []
    some: list[str | None] = []
    held = 0
    for q in quals:
        if some and held + len(q or "") > CODES:
            out += _prefix_within(some, costs, budget, color)
            some, held = [], 0
        some.append(q)
        held += len(q or "")
    return out + _prefix_within(some, costs, budget, color) if some else out


def _prefix_within(quals: list[str | None], costs: np.ndarray, budget: int, color: bool) -> list[int | None]:
    given = [q or "" for q in quals]
    codes = np.minimum(np.frombuffer("".join(given).encode("utf-32-le"), dtype=np.uint32), 255)
    n = np.array([len(q) for q in given], dtype=np.int64)
    ends = np.cumsum(n)
    starts = ends - n
    row = np.zeros(len(codes), dtype=np.int64)
    if color and len(codes):
        row[1:] = codes[:-1] + 1
        row[starts[n > 0]] = 0
    total = np.concatenate([[0], np.cumsum(costs[row, codes])])
    kept = np.searchsorted(total, total[starts] + budget, side="right") - 1 - starts
    return [None if q is None else int(k) for q, k in zip(quals, np.minimum(kept, n), strict=True)]


def trim_length(qual: Column, correct_prob: float, color: bool = False) -> Column:
    """The longest prefix that is free of error with at least ``correct_prob``; 0 disables.

    In colour space a base is wrong only if its colour and the one before are. The
    sums run over a batch of reads at once; a fold over every quality of a read as
    SQL expressions took ten times as long.
    """
    if correct_prob <= 0:
        return F.char_length(qual)
    budget = round(-math.log(correct_prob) * COST_UNIT)

    @F.pandas_udf("int")
    def within(quals: pd.Series) -> pd.Series:
        return pd.Series(prefix_within(quals.tolist(), budget, color), dtype="Int32")

    return within(qual)


def kmers(seq: Column, k: int) -> Column:
    """All windows of ``k`` bases."""
    return F.regexp_extract_all(seq, F.lit(f"(?=(.{{{k}}}))"), F.lit(1))


def edge_heuristic(bits: Column, gc_a: Column, gc_b: Column, cov_a: Column, cov_b: Column) -> Column:
    """A link's bits, lowered by how much its ends differ in GC and in log coverage."""
    return bits - bits * (0.08 * F.abs(gc_a - gc_b) + 0.125 * F.abs(F.log(cov_a) - F.log(cov_b)))
