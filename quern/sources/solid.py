"""Colour-space run folders: which files belong together, and their records as reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import sequence as S
from quern.operators.reads import synchronise
from quern.sources import fasta, fastq

#: File tags of the first and of the second read of a pair, the first found counts.
TAGS = {"read1": ("R3", "F5-BC", "F5-P2", "F5-DNA", "F5-RNA"), "read2": ("F3",)}


@dataclass(frozen=True)
class Files:
    """The files of one end: nucleotide FASTQ, or colours with their qualities."""

    reads: str
    quals: str | None = None


def candidates(prefix: str, part: str, barcode: str | None = None) -> list[Files]:
    """The names that one end of a library may have, most wanted first.

    With a barcode, a nucleotide file may carry it; colour files carry it before
    the tag, or after it. Without one the quality file is marked ``_QV`` or ``.QV``.
    """
    out = []
    for tag in TAGS[part]:
        if barcode:
            out += [Files(f"{prefix}_{barcode}_{tag}.fastq")] if tag in ("R3", "F3") else []
            out += [Files(f"{prefix}_{tag}_{barcode}.csfasta", f"{prefix}_{tag}_QV_{barcode}.qual"), Files(f"{prefix}_{barcode}_{tag}.csfasta", f"{prefix}_{barcode}_{tag}.QV.qual")]
        else:
            out += [Files(f"{prefix}_{tag}.csfasta", f"{prefix}_{tag}{mark}.qual") for mark in ("_QV", ".QV")]
    return sorted(out, key=lambda f: f.quals is not None)


def resolve(spark: SparkSession, prefix: str, part: str, barcode: str | None = None) -> Files | None:
    """The first candidate of which all files exist, each plain or ``.gz``; without a barcode the default one is tried last."""
    base = spark._jvm.org.apache.hadoop.fs.Path(prefix)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())

    def there(name: str | None) -> str | None:
        return next((n for n in (name, f"{name}.gz") if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(n))), None)

    wanted = candidates(prefix, part, barcode)
    if not barcode:
        wanted += [f for b in ("default", "Default") for f in candidates(prefix, part, b)]
    for f in wanted:
        reads = there(f.reads)
        quals = there(f.quals) if f.quals else None
        if reads and (quals or not f.quals):
            return Files(reads, quals)
    return None


def read_end(spark: SparkSession, files: Files, prefix: str | None, mate: int | None) -> DataFrame:
    """One end's reads: ``read_id, primer, prefix, mate, seq, qual``; ids end before the third ``_``."""
    if files.quals:
        rows = fasta.read_csfasta(spark, files.reads, files.quals)
    else:
        raw = fastq.read_fastq(spark, files.reads)
        rows = raw.select(F.substring_index(F.substring("header", F.lit(2), F.char_length("header")), "_", 3).alias("name"), F.lit(None).cast("string").alias("primer"), "seq", "qual")
    return rows.select(F.col("name").alias("read_id"), "primer", F.lit(None).cast("int").alias("trim_len"), F.lit(prefix).cast("string").alias("prefix"), F.lit(mate).cast("int").alias("mate"), "seq", "qual")


def convert(spark: SparkSession, in_prefix: str, prefix: str | None, barcode: str | None = None, suffix: bool = True) -> DataFrame:
    """Both ends of a library as one read set with ``part``: mates together, the rest single.

    A library with one kind of file is all single. ``suffix`` numbers the mates.
    """
    found = {p: resolve(spark, in_prefix, p, barcode) for p in TAGS}
    if not any(found.values()):
        raise FileNotFoundError(f"no read files of {in_prefix}")
    ends = {p: read_end(spark, f, prefix, k if suffix else None) for k, (p, f) in enumerate(found.items(), 1) if f}
    if len(ends) == 1:
        return next(iter(ends.values())).withColumn("part", F.lit("single"))
    both = synchronise(ends["read1"], ends["read2"]).select("read_id", F.col("part").alias("how"))
    part = lambda p: F.when(F.col("how") == "pair", p).otherwise("single")
    return ends["read1"].join(both, "read_id").withColumn("part", part("read1")).unionByName(ends["read2"].join(both, "read_id").withColumn("part", part("read2"))).drop("how")


def simulated_illumina(reads: DataFrame) -> DataFrame:
    """Records of an Illumina simulator (``header, seq, qual``): length and mate in the header, its first ``-`` as ``:``."""
    name = F.regexp_replace(F.substring("header", F.lit(2), F.char_length("header")), "^([^-]*)-", "$1:")
    return reads.select(F.concat(F.lit("@"), F.char_length("seq").cast("string"), F.lit("|"), name, F.lit("/1")).alias("header"), "seq", F.lit("+").alias("plus"), "qual")


def simulated_colors(reads: DataFrame, prefix: str, primer: Column | None = None) -> DataFrame:
    """Records of a colour simulator: those with a NUL in them are dropped, digits become letters, the primer goes into the header."""
    clean = reads.filter(~F.contains("seq", F.lit("\0")) & ~F.contains("qual", F.lit("\0")))
    first = primer if primer is not None else F.concat(F.substring("seq", 1, 1), S.to_letters(F.substring("seq", 2, 1)))
    name = F.regexp_replace(F.substring("header", F.lit(2), F.char_length("header")), r"[:|+/\s].*$", "")
    seq = S.to_letters(F.substring("seq", F.lit(3), F.char_length("seq")))
    return clean.select(F.concat(F.lit("@"), first, F.lit("+"), F.char_length(seq).cast("string"), F.lit(f"|{fastq.check_prefix(prefix)}:"), name).alias("header"), seq.alias("seq"), F.lit("+").alias("plus"), F.substring("qual", F.lit(2), F.char_length("qual")).alias("qual"))
