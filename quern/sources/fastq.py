"""FASTQ in and out.

A record is four lines, and a quality line may look like any other, so a split
cannot tell where its first record starts. Lines are therefore counted per split
first; then every split knows the number of its first line, and with it where
records start and which number they have. Only records that a split's end cuts
are put together from pieces. A gzip file is one split; spread its rows with
``repartition``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern import scratch

PARTS = ("read1", "read2", "single1", "single2", "single")
SCHEMA = "file string, ord long, header string, seq string, plus string, qual string"
_PIECES = SCHEMA + ", line int, value string"


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records of each split, and the lines of cut ones."""
    names = [x.split()[0] for x in _PIECES.split(", ")]
    types = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int32(), pa.string()]
    out: list[tuple] = []
    key, at, held = None, 0, []

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    def cut() -> None:
        out.extend((key[0], n // 4, None, None, None, None, n % 4, v) for n, v in held)
        held.clear()

    for batch in batches:
        for file, split, base, value in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if key != (file, split):
                if key:
                    cut()
                key, at = (file, split), base
            held.append((at, value))
            at += 1
            if at % 4 == 0:
                if len(held) == 4:
                    out.append((file, held[0][0] // 4, *[v for _, v in held], None, None))
                    held.clear()
                else:
                    cut()
        if len(out) > 20_000:
            yield flush()
            out = []
    if key:
        cut()
    if out:
        yield flush()


def read_fastq(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, ord, header, seq, plus, qual``, a row per record, numbered from 0 in each file.

    A record without its ``@`` or ``+``, or with a quality of another length, is an error.
    """
    lines = _lines(spark, paths)
    counts = lines.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    base = scratch.table(counts.select(F.col("file").alias("f"), F.col("split").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "lines")
    table = F.broadcast(base) if base.count() <= 200_000 else base
    placed = lines.withColumn("_n", F.monotonically_increasing_id()).join(table, (F.col("file") == F.col("f")) & (F.col("split") == F.col("s")))
    if table is base:
        placed = placed.repartition("file", "split").sortWithinPartitions("file", "split", "_n")
    found = scratch.table(placed.select("file", "split", "base", "value").mapInArrow(_records, _PIECES), "records")
    whole = found.filter("line IS NULL").drop("line", "value")
    at = lambda k: F.max(F.when(F.col("line") == k, F.col("value")))
    cut = found.filter("line IS NOT NULL").groupBy("file", "ord").agg(at(0).alias("header"), at(1).alias("seq"), at(2).alias("plus"), at(3).alias("qual"))
    cut = cut.filter("NOT (header = '' AND seq IS NULL)")
    rows = whole.unionByName(cut)
    bad = ~F.coalesce(F.startswith("header", F.lit("@")) & F.startswith("plus", F.lit("+")), F.lit(False))
    return rows.withColumn("header", F.when(bad, F.raise_error(F.concat(F.lit("no FASTQ record: "), "file", F.lit(" "), F.col("ord").cast("string"))).cast("string")).otherwise(F.col("header")))


#: A header: two characters of primer, the length before trimming, prefix and id, mate.
HEADER = r"^@(?:([ACGT][0-3.ACGTN])\+)?(?:(\d+)\|)?(?:([^:|+/]*):)?([^/]*)(?:/([12]))?$"


def parse_header(header: Column) -> dict[str, Column]:
    """Primer, trimmed length, prefix, read id and mate of a header; absent parts are null."""
    part = lambda k: F.nullif(F.regexp_extract(header, HEADER, k), F.lit(""))
    return {"primer": part(1), "trim_len": part(2).cast("int"), "prefix": part(3), "read_id": part(4), "mate": part(5).cast("int")}


def read_set(spark: SparkSession, prefix: str) -> DataFrame:
    """All files of a read set, ``<prefix>.<part>.fastq`` with or without ``.gz``, with ``part`` and the header's parts."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{prefix}.*.fastq*")
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    paths = [s.getPath().toString() for s in (fs.globStatus(fs_path) or [])]
    own = [p for p in paths if any(p.endswith((f".{x}.fastq", f".{x}.fastq.gz")) for x in PARTS)]
    if not own:
        raise FileNotFoundError(f"no read files of {prefix}")
    part = F.regexp_extract("file", r"\.(read1|read2|single1|single2|single)\.fastq(?:\.gz)?$", 1)
    rows = read_fastq(spark, own).withColumn("part", part)
    return rows.select("part", "ord", *[c.alias(n) for n, c in parse_header(F.col("header")).items()], "seq", "qual")


def read_order_tag(file: Column) -> Column:
    """``1~`` or ``2~`` for files of first or second mates, else ``S~``."""
    return F.when(F.contains(file, F.lit("read1")), "1~").when(F.contains(file, F.lit("read2")), "2~").otherwise("S~")


def check_prefix(prefix: str) -> str:
    """The prefix, if a header can hold it."""
    if not prefix or any(c in prefix for c in ":|+/"):
        raise ValueError(f"a read prefix may not be empty or have any of : | + / in it: {prefix!r}")
    return prefix


def header_of(prefix: str | None = None, add_len: bool = False) -> Column:
    """The header line of rows with the parts of :func:`parse_header`; a prefix of '' leaves it out."""
    name = F.col("prefix") if prefix is None else F.lit(check_prefix(prefix) if prefix else None).cast("string")
    some = lambda c, after: F.coalesce(F.concat(c, F.lit(after)), F.lit(""))
    length = F.char_length("seq").cast("string") if add_len else F.col("trim_len").cast("string")
    return F.concat(F.lit("@"), some(F.col("primer"), "+"), some(length, "|"), some(name, ":"), "read_id", F.coalesce(F.concat(F.lit("/"), F.col("mate").cast("string")), F.lit("")))


def write_fastq(reads: DataFrame, path: str, header: Column | None = None, gzip: bool = False) -> None:
    """One record per row of ``seq, qual`` and a header."""
    record = F.concat_ws("\n", header if header is not None else F.col("header"), "seq", F.lit("+"), "qual")
    reads.select(record.alias("value")).write.text(path, compression="gzip" if gzip else "none")


def is_color(seq: Column, header: Column) -> Column:
    """Whether a read is in colour space: its header has a primer."""
    return F.rlike(header, F.lit(r"^@[ACGT][0-3.ACGTN]\+"))


def one_kind(reads: DataFrame) -> DataFrame:
    """The reads, if all are of one space; mixed files are an error."""
    kinds = reads.select(is_color(F.col("seq"), F.col("header")).alias("c")).distinct().count()
    if kinds > 1:
        raise ValueError("colour and nucleotide reads are mixed")
    return reads


def move_header(reads: DataFrame) -> DataFrame:
    """Old style records, which have the header's rest on the ``+`` line, in the new style."""
    return reads.withColumn("header", F.concat(F.lit("@"), F.substring("plus", F.lit(2), F.char_length("plus")))).withColumn("plus", F.lit("+"))


def simulated_header(header: Column, prefix: str) -> Column:
    """Headers of a read simulator, ``@name-number/mate``, as ``@prefix:name-number/mate``."""
    return F.concat(F.lit(f"@{check_prefix(prefix)}:"), F.regexp_replace(F.substring(header, F.lit(2), F.char_length(header)), ":", "_"))
