"""SAM files: hits and the catalog in their headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.fastq import read_order_tag


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"))


def read_hits(spark: SparkSession, paths: str | list[str], reverse: bool = False, all_equal: bool = False) -> DataFrame:
    """``read_key, mate, seq_id, pos, ed, read_len``: a row for each place of each mapped read.

    The position's sign is the strand, turned if ``reverse``. The edit distance is
    that of the ``XM`` tag, else of ``NM``; a mapped read without either is an error.
    ``XA`` gives further places. ``/1`` and ``/2`` come off the read's name, and the
    file's name says which mate it holds. ``all_equal`` sets all distances to 0.
    """
    rows = _lines(spark, paths).filter(~F.startswith("value", F.lit("@"))).withColumn("f", F.split("value", "\t"))
    flag = F.element_at("f", 2).cast("int")
    rows = rows.filter((F.size("f") >= 11) & (flag.bitwiseAND(4) == 0))
    tag = lambda name: F.nullif(F.regexp_extract("value", rf"\t{name}:i:(\d+)", 1), F.lit(""))
    missing = F.raise_error(F.concat(F.lit("no edit distance: "), F.element_at("f", 1))).cast("string")
    ed = F.coalesce(tag("XM"), tag("NM"), missing).cast("int")
    sign = -1 if reverse else 1
    first = F.struct(F.element_at("f", 3).alias("seq_id"), (F.when(flag.bitwiseAND(16) != 0, -1).otherwise(1) * sign * F.element_at("f", 4).cast("int")).alias("pos"), ed.alias("ed"))
    others = F.filter(F.split(F.regexp_extract("value", r"\tXA:Z:([^\t]*)", 1), ";"), lambda x: x != "")

    def place(x):  # noqa: ANN001, ANN202
        p = F.split(x, ",")
        return F.struct(p[0].alias("seq_id"), (p[1].cast("int") * sign).alias("pos"), p[3].cast("int").alias("ed"))

    mate = F.when(read_order_tag(F.col("file")) == "2~", 2).otherwise(1)
    found = rows.select(
        F.regexp_replace(F.element_at("f", 1), "/[12]$", "").alias("read_key"), mate.alias("mate"), F.length(F.element_at("f", 10)).alias("read_len"), F.explode(F.concat(F.array(first), F.transform(others, place))).alias("h")
    ).select("read_key", "mate", "h.*", "read_len")
    return found.withColumn("ed", F.lit(0)) if all_equal else found


def read_legacy_hits(spark: SparkSession, paths: str | list[str], default_len: int | None = None, reverse: bool = False, all_equal: bool = False) -> DataFrame:
    """Hits of the older alignment listing, with the columns of :func:`read_hits`; the catalog comes from elsewhere.

    A read is a line ``>name hits``, where the name may start with its primer and
    ``+``, then its length and ``|``; without one the length is ``default_len``. A line
    ``reference, position, distance`` (tab-separated, the position signed by strand)
    follows for each hit.
    """
    rows = spark.read.option("lineSep", "\n>").text(paths).select(F.regexp_replace("value", "^>", "").alias("text"), F.col("_metadata.file_path").alias("file"))
    head = F.substring_index("text", "\n", 1)
    name = F.regexp_replace(F.substring_index(head, " ", 1), r"^..\+", "")
    size = F.substring_index(name, "|", 1).cast("int")
    bad = F.raise_error(F.concat(F.lit("no length in the name of a read: "), name)).cast("int")
    length = F.when(F.contains(name, F.lit("|")), F.when(F.coalesce(size > 0, F.lit(False)), size).otherwise(bad)).otherwise(F.lit(default_len).cast("int"))
    mate = F.when(read_order_tag(F.col("file")) == "2~", 2).otherwise(1)
    line = F.explode(F.filter(F.slice(F.split("text", "\n"), F.lit(2), F.size(F.split("text", "\n"))), lambda x: x != ""))
    found = rows.filter(F.trim("text") != "").select(F.regexp_replace(F.regexp_replace(name, r"^[^|]*\|", ""), "/[12]$", "").alias("read_key"), mate.alias("mate"), length.alias("read_len"), line.alias("line")).withColumn("f", F.split("line", "\t"))
    distance = F.lit(0) if all_equal else F.element_at("f", 3).cast("int")
    return found.select("read_key", "mate", F.element_at("f", 1).alias("seq_id"), (F.element_at("f", 2).cast("int") * (-1 if reverse else 1)).alias("pos"), distance.alias("ed"), "read_len")


def read_header(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The catalog that ``@SQ`` lines make; a reference with two lengths is an error."""
    rows = _lines(spark, paths).filter(F.startswith("value", F.lit("@SQ")))
    field = lambda name: F.regexp_extract("value", rf"\t{name}:([^\t]*)", 1)
    by = rows.select(field("SN").alias("seq_id"), field("LN").cast("long").alias("seq_len"), F.nullif(field("SP"), F.lit("")).alias("descr")).groupBy("seq_id").agg(F.min("seq_len").alias("seq_len"), F.max("seq_len").alias("hi"), F.max("descr").alias("descr"))
    bad = F.raise_error(F.concat(F.lit("two lengths of "), "seq_id")).cast("long")
    return by.select("seq_id", F.when(F.col("seq_len") != F.col("hi"), bad).otherwise(F.col("seq_len")).alias("seq_len"), F.col("seq_id").alias("parent_id"), F.coalesce("descr", F.lit("NA")).alias("descr"))
