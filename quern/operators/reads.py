"""Read processing: trimming, filtering, pairing, sampling, duplicate removal.

Reads are rows of ``pair_id, mate, seq, qual``; the mates of a pair share
``pair_id`` and have ``mate`` 1 and 2. Extra columns pass through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern import scratch
from quern.functions import sequence as S


def trim(reads: DataFrame, correct_prob: float = 0.5, fixed_len: int | None = None, color: bool = False) -> DataFrame:
    """Cut sequence and quality to the longest prefix that is likely right; adds ``trim_len``.

    With ``fixed_len`` what is longer is cut to that length, and reads that trimming
    leaves shorter are dropped.
    """
    cut = reads.withColumn("trim_len", S.trim_length(F.col("qual"), correct_prob, color).cast("int"))
    if fixed_len is not None:
        cut = cut.filter(F.col("trim_len") >= fixed_len).withColumn("trim_len", F.lit(fixed_len))
    return cut.withColumn("seq", F.substring("seq", F.lit(1), F.col("trim_len"))).withColumn("qual", F.substring("qual", F.lit(1), F.col("trim_len")))


def keep_reads(reads: DataFrame, min_len: int = 24, entropy: float | None = None, whole: str | None = None) -> DataFrame:
    """Reads of at least ``min_len`` bases and ``entropy`` bits; ``whole`` names the column to measure entropy on."""
    kept = reads.filter(F.char_length("seq") >= min_len)
    return kept if entropy is None else kept.filter(S.dinucleotide_entropy(F.col(whole or "seq")) >= entropy)


def split_pairs(reads: DataFrame) -> DataFrame:
    """Marks reads ``part``: ``read1`` and ``read2`` while both mates are there, else ``single``."""
    both = F.count(F.lit(1)).over(Window.partitionBy("pair_id"))
    return reads.withColumn("part", F.when(both >= 2, F.concat(F.lit("read"), F.col("mate").cast("string"))).otherwise("single"))


def sample(reads: DataFrame, fraction: float, seed: int = 12345, key: str = "pair_id") -> DataFrame:
    """A reproducible share of the pairs; mates stay together. Above 1, ``fraction`` is a number of reads.

    A pair stays if the first 32 bits of the MD5 of ``seed:key`` are among that share of all.
    """
    if fraction > 1:
        fraction = min(1.0, fraction / max(1, reads.count()))
    drawn = F.conv(F.left(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.lit(8)), 16, 10).cast("long")
    return reads.filter(drawn < round(fraction * 2**32))


def interleave_mates(reads: DataFrame, color: bool = False, reverse: bool | None = None) -> DataFrame:
    """Rows of whole pairs in the order read1, read2; the second reversed if asked, in colour space by default.

    Nucleotides are complemented too. ``ord`` is the place within the pair's rows.
    """
    turn = F.lit(color if reverse is None else reverse) & (F.col("mate") == 2)
    seq = F.reverse("seq") if color else S.reverse_complement(F.col("seq"))
    paired = split_pairs(reads).filter("part <> 'single'").drop("part")
    return paired.withColumn("seq", F.when(turn, seq).otherwise(F.col("seq"))).withColumn("qual", F.when(turn, F.reverse("qual")).otherwise(F.col("qual")))


def synchronise(first: DataFrame, second: DataFrame, key: str = "read_id") -> DataFrame:
    """Full outer pairing of two read sets on their id: pairs, and singlets of either side."""
    a = first.select(F.col(key), F.col("seq").alias("seq1"), F.col("qual").alias("qual1"), F.lit(True).alias("has1"))
    b = second.select(F.col(key), F.col("seq").alias("seq2"), F.col("qual").alias("qual2"), F.lit(True).alias("has2"))
    part = F.when(F.col("has1") & F.col("has2"), "pair").when(F.col("has1"), "single1").otherwise("single2")
    return a.join(b, key, "full_outer").withColumn("part", part).drop("has1", "has2")


def _blocks(prefix: Column, length: int, errors: int) -> Column:
    """The blocks of which one must be equal in prefixes that differ in at most ``errors`` bases."""
    n = errors + 1
    cuts = [length * k // n for k in range(n + 1)]
    return F.array(*[F.struct(F.lit(k).alias("block"), F.substring(prefix, cuts[k] + 1, cuts[k + 1] - cuts[k]).alias("part")) for k in range(n)])


def _two_blocks(p: Column, q: Column, length: int, p_errors: int, q_errors: int) -> Column:
    """Every block of one prefix with every block of the other."""
    return F.flatten(
        F.transform(_blocks(p, length, p_errors), lambda u: F.transform(_blocks(q, length, q_errors), lambda v: F.struct(u["block"].alias("block"), u["part"].alias("part"), v["block"].alias("block2"), v["part"].alias("part2"))))
    )


def duplicate_pairs(pairs: DataFrame, index_len: int = 14, index_err: int = 1, match_err: int = 3) -> DataFrame:
    """``a, b``: pairs that are duplicates by their prefixes, in either role of the mates.

    Pairs (``pair_id, seq1, seq2``) are duplicates if one mate's prefixes differ in
    at most ``index_err`` bases and the other's in at most ``match_err``. One of the
    ``index_err + 1`` blocks of the first and one of the ``match_err + 1`` blocks of the
    other must then be equal: an equi-join on two blocks, so that only pairs alike in
    both mates meet. Equal pairs of prefixes are one node, joined by their first pair.
    """
    cut = lambda c: F.translate(F.rpad(F.substring(c, 1, index_len), index_len, "A"), "N", "A")
    keyed = scratch.table(pairs.select("pair_id", cut(F.col("seq1")).alias("p1"), cut(F.col("seq2")).alias("p2")), "prefixes")
    node = keyed.groupBy("p1", "p2").agg(F.min("pair_id").alias("id"))
    copies = keyed.join(node, ["p1", "p2"]).filter("pair_id <> id").select(F.col("id").alias("a"), F.col("pair_id").alias("b"))
    node = scratch.table(node.withColumn("x1", S.pack_prefix(F.col("p1"), index_len)).withColumn("x2", S.pack_prefix(F.col("p2"), index_len)), "nodes")
    found = [copies]
    for x, y in (("x1", "x2"), ("x2", "x1")):
        p, q = (F.col(c.replace("x", "p")) for c in (x, y))
        rows = node.select("id", F.col(x).alias("x"), F.col(y).alias("y"), F.inline(_two_blocks(p, q, index_len, index_err, match_err)))
        keys = ["block", "part", "block2", "part2"]
        left = rows.select(F.col("id").alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya"), *keys)
        right = rows.select(F.col("id").alias("b"), F.col("x").alias("xb"), F.col("y").alias("yb"), *keys)
        near = (S.packed_distance(F.col("xa"), F.col("xb")) <= index_err) & (S.packed_distance(F.col("ya"), F.col("yb")) <= match_err)
        found.append(left.join(right, keys).filter((F.col("a") < F.col("b")) & near).select("a", "b"))
    return reduce(DataFrame.unionByName, found).distinct()


def drop_duplicate_pairs(pairs: DataFrame, index_len: int = 14, index_err: int = 1, match_err: int = 3) -> DataFrame:
    """Of each group of duplicate pairs the one of the highest total quality, the earliest if tied.

    Groups are connected components of :func:`duplicate_pairs`, so the result does
    not depend on the order of the input.
    """
    from quern.operators.graph import connected_components

    label = connected_components(duplicate_pairs(pairs, index_len, index_err, match_err), "a", "b")
    quality = S.quality_sum(F.col("qual1")) + S.quality_sum(F.col("qual2"))
    best = Window.partitionBy("component").orderBy(F.desc("_quality"), "pair_id")
    marked = pairs.join(label, F.col("pair_id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "pair_id")).withColumn("_quality", quality)
    return marked.withColumn("_rank", F.row_number().over(best)).filter("_rank = 1").drop("_rank", "_quality", "node", "component")


def reject_rate(all_reads: DataFrame, rejected: DataFrame, prefix: str = "prefix") -> DataFrame:
    """For each prefix the share of its pairs that were rejected: the chance that a singlet with it goes."""
    total = all_reads.groupBy(prefix).agg(F.count(F.lit(1)).alias("total"))
    gone = rejected.groupBy(prefix).agg(F.count(F.lit(1)).alias("rejected"))
    return total.join(gone, prefix, "left").select(prefix, "total", F.coalesce("rejected", F.lit(0)).alias("rejected"), (F.coalesce("rejected", F.lit(0)) / (F.col("total"))).alias("rate"))


def summary(reads: DataFrame) -> DataFrame:
    """Reads and bases by part."""
    return reads.groupBy("part").agg(F.count(F.lit(1)).alias("reads"), F.sum(F.char_length("seq").cast("long")).alias("bases"))


def diff_reads(before: DataFrame, after: DataFrame, key: str = "read_id") -> DataFrame:
    """Reads whose sequence changed, with a marker under each changed base."""
    a, b = before.select(key, F.col("seq").alias("before")), after.select(key, F.col("seq").alias("after"))
    both = a.join(b, key).filter("before <> after")
    marks = F.zip_with(S.chars(F.col("before")), S.chars(F.col("after")), lambda x, y: F.when(x.eqNullSafe(y), " ").otherwise("*"))
    marked = both.withColumn("marks", F.array_join(marks, ""))
    return marked.withColumn("changed", F.char_length(F.regexp_replace("marks", "[^*]", "")).cast("long"))
