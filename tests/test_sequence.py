"""Column functions against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quern.functions import sequence as S

RNG = random.Random(4)
SEQS = ["", "A", "AC", "AAAAAA", "ACGTNACGT", "NNNN", "ACNNNGT", "".join(RNG.choices("ACGTN", k=500)), "".join(RNG.choices("ACGT", k=300))]


@pytest.fixture(scope="module")
def seqs(spark):
    return spark.createDataFrame(list(enumerate(SEQS)), "id long, seq string")


def values(df, column):
    return {r.id: r.v for r in df.select("id", column.alias("v")).collect()}


def entropy(s):
    if not s:
        return None
    left, counts = len(s), {}
    for a, b in zip(s, s[1:], strict=False):
        if "N" in a + b:
            left -= 1
        else:
            counts[a + b] = counts.get(a + b, 0) + 1
    return sum(c * math.log2(left / c) for c in counts.values()) / len(s)


def test_entropy(seqs):
    got = values(seqs, S.dinucleotide_entropy(F.col("seq")))
    for i, s in enumerate(SEQS):
        assert got[i] == pytest.approx(entropy(s)) if s else got[i] is None


def test_reverse_complement(spark):
    df = spark.createDataFrame([(1, "ACGTN"), (2, "acRYkmSWbdhvN"), (3, "A"), (4, "")], "id long, seq string")
    assert values(df, S.reverse_complement(F.col("seq"))) == {1: "NACGT", 2: "NbdhvWSkmRYgt", 3: "T", 4: ""}
    assert values(df, S.reverse_complement(S.reverse_complement(F.col("seq")))) == {1: "ACGTN", 2: "acRYkmSWbdhvN", 3: "A", 4: ""}


@pytest.mark.parametrize("color", [False, True])
@pytest.mark.parametrize("p", [0.0, 0.5, 0.9, 0.999])
def test_trim_length(spark, p, color):
    quals = ["", "IIII5555", "I!II", "!!!!", "+" * 30, "".join(chr(33 + RNG.randrange(2, 41)) for _ in range(200)), "I" * 100]
    df = spark.createDataFrame(list(enumerate(quals)), "id long, qual string")
    got = values(df, S.trim_length(F.col("qual"), p, color))
    for i, q in enumerate(quals):
        e = [10 ** (-(ord(c) - 33) / 10) for c in q]
        n, prob = 0, 1.0
        for k in range(len(q)):
            prob *= 1 - (e[k] * e[k - 1] if color and k else e[k])
            if prob < p:
                break
            n = k + 1
        assert got[i] == (len(q) if p == 0 else n), q


def test_packing_and_distance(spark):
    rows = [("".join(RNG.choices("ACGTN", k=14)), "".join(RNG.choices("ACGTN", k=14))) for _ in range(50)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id long, a string, b string")
    got = values(df, S.packed_distance(S.pack_prefix(F.col("a"), 14), S.pack_prefix(F.col("b"), 14)))
    assert got == {k: sum(x.replace("N", "A") != y.replace("N", "A") for x, y in zip(a, b, strict=True)) for k, (a, b) in enumerate(rows)}


def test_color_decoding(spark):
    step = {("A", "0"): "A", ("A", "1"): "C", ("A", "2"): "G", ("A", "3"): "T", ("C", "0"): "C", ("C", "1"): "A", ("C", "2"): "T", ("C", "3"): "G", ("G", "0"): "G", ("G", "1"): "T", ("G", "2"): "A", ("G", "3"): "C", ("T", "0"): "T", ("T", "1"): "G", ("T", "2"): "C", ("T", "3"): "A"}
    reads = ["".join(RNG.choices("0123", k=30)) for _ in range(10)] + ["01.23", ""]
    df = spark.createDataFrame(list(enumerate(reads)), "id long, c string")
    for start in "ACGT":
        got = values(df, S.decode_colors(F.col("c"), F.lit(start)))
        for i, r in enumerate(reads):
            base, out = start, ""
            for c in r:
                base = step.get((base, c), "N")
                out += base
            assert got[i] == out


def test_kmers_quality_and_gc(seqs):
    got = values(seqs, S.kmers(F.col("seq"), 4))
    assert all(got[i] == [s[k : k + 4] for k in range(len(s) - 3)] for i, s in enumerate(SEQS))
    gc = values(seqs, S.gc_fraction(F.col("seq")))
    for i, s in enumerate(SEQS):
        known = [c for c in s if c != "N"]
        assert gc[i] == (pytest.approx(sum(c in "GC" for c in known) / len(known)) if known else None)
    assert all(v == sum(ord(c) - 33 for c in SEQS[i]) for i, v in values(seqs, S.quality_sum(F.col("seq"))).items())
