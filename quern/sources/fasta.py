"""FASTA, CSFASTA and QUAL files, reference catalogs, and tables of selected sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import sequence as S

CATALOG = "seq_id string, seq_len long, parent_id string, descr string"


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``name, descr, seq``, a row per record; comment lines (``#``) are skipped.

    Records are split at a line that starts with ``>``, which no sequence line does.
    """
    rows = spark.read.option("lineSep", "\n>").text(paths)
    text = F.regexp_replace(F.regexp_replace(F.concat(F.lit("\n"), "value"), r"\n#[^\n]*", ""), r"^\n>?", "")
    head = F.regexp_replace(F.substring_index(text, "\n", 1), "\r", "")
    body = F.when(F.contains(text, F.lit("\n")), F.substring(text, F.char_length(F.substring_index(text, "\n", 1)) + 2, F.char_length(text))).otherwise("")
    return rows.filter(F.trim(text) != "").select(
        F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.nullif(F.trim(F.regexp_replace(head, r"^\S*", "")), F.lit("")).alias("descr"), F.regexp_replace(body, r"\s", "").alias("seq"), body.alias("body")
    )


def wrap(seq: Column, width: int) -> Column:
    """A sequence in lines of ``width``."""
    return F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), r"\n$", "")


def write_fasta(seqs: DataFrame, path: str, name: Column | None = None, width: int = 0) -> None:
    body = wrap(F.col("seq"), width) if width else F.col("seq")
    seqs.select(F.concat(F.lit(">"), name if name is not None else F.col("name"), F.lit("\n"), body).alias("value")).write.text(path)


def abundance_name(name: Column, rel_ab: Column) -> Column:
    """A name with the abundance in percent after it."""
    return F.concat(name, F.lit("_"), F.format_string("%.6f", rel_ab * 100))


#: Four homopolymers of five with at most two bases between them.
LOW_COMPLEXITY = r"(?i)((ttttt|aaaaa|ccccc|ggggg)[acgtn]{0,2}){4}"


def filter_fasta(seqs: DataFrame, minlen: int = 0, maxlen: int | None = None, low_complexity: bool = True) -> DataFrame:
    """Sequences of a length in the range, without repeated homopolymers if those are filtered."""
    kept = seqs.filter(F.char_length("seq") >= minlen)
    if maxlen is not None:
        kept = kept.filter(F.char_length("seq") <= maxlen)
    return kept.filter(~F.rlike("seq", F.lit(LOW_COMPLEXITY))) if low_complexity else kept


def catalog_of(seqs: DataFrame) -> DataFrame:
    """A reference catalog: id, length, id, description or ``NA``."""
    return seqs.select(F.col("name").alias("seq_id"), F.char_length("seq").cast("long").alias("seq_len"), F.col("name").alias("parent_id"), F.coalesce("descr", F.lit("NA")).alias("descr"))


def read_catalog(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A catalog of four tab-separated fields; blank lines are skipped, a length that is not positive is an error."""
    rows = spark.read.csv(paths, sep="\t", schema=CATALOG, quote="").filter("seq_id IS NOT NULL")
    bad = F.raise_error(F.concat(F.lit("no length in the catalog: "), "seq_id")).cast("long")
    return rows.withColumn("seq_len", F.when(F.coalesce(F.col("seq_len") > 0, F.lit(False)), F.col("seq_len")).otherwise(bad))


def attach(refs: DataFrame, fasta: DataFrame) -> DataFrame:
    """References with their sequence and GC; one longer than the catalog says is an error."""
    joined = refs.join(fasta.select(F.col("name").alias("seq_id"), F.upper("seq").alias("seq")), "seq_id", "left")
    bad = F.raise_error(F.concat(F.lit("longer than in the catalog: "), F.col("seq_id").cast("string")))
    return joined.withColumn("seq", F.when(F.char_length("seq") > F.col("seq_len"), bad.cast("string")).otherwise(F.col("seq"))).withColumn("pct_gc", S.gc_fraction(F.col("seq")))


def select_by_table(seqs: DataFrame, table: DataFrame, with_abundance: bool = False) -> DataFrame:
    """Sequences with coverage in the table (``name, cov, rel_ab``), named with their abundance if asked."""
    own = seqs.join(table.filter("cov > 0").select("name", "rel_ab"), "name")
    return own.withColumn("name", abundance_name(F.col("name"), F.col("rel_ab"))).drop("rel_ab") if with_abundance else own.drop("rel_ab")


def read_csfasta(spark: SparkSession, colors: str, quals: str) -> DataFrame:
    """Colour reads with their qualities: ``name, primer, seq, qual``.

    Names are cut at the third ``_``. The primer is the first base and the colour
    after it; sequence and quality go on from there. Digits become letters, and a
    quality ``q`` the character ``q + 33``, at least that of 0. Files are joined on
    the name; one that only one file has is an error.
    """
    key = lambda c: F.substring_index(c, "_", 3)
    c = read_fasta(spark, colors).select(key(F.col("name")).alias("name"), F.col("seq").alias("raw"))
    q = read_fasta(spark, quals).select(key(F.col("name")).alias("name"), F.split(F.trim(F.regexp_replace("body", r"\s+", " ")), " ").alias("phred"))
    both = c.join(q, "name", "full_outer")
    missing = F.raise_error(F.concat(F.lit("only in one of the two files: "), "name")).cast("string")
    chars = F.transform(F.slice("phred", F.lit(2), F.greatest(F.size("phred") - 1, F.lit(0))), lambda x: F.char(F.greatest(x.cast("int"), F.lit(0)) + 33))
    return both.select(
        "name",
        F.when(F.col("raw").isNull() | F.col("phred").isNull(), missing).otherwise(F.concat(F.substring("raw", 1, 1), S.to_letters(F.substring("raw", 2, 1)))).alias("primer"),
        S.to_letters(F.substring("raw", F.lit(3), F.char_length("raw"))).alias("seq"),
        F.array_join(chars, "").alias("qual"),
    )


def to_csfasta(reads: DataFrame) -> DataFrame:
    """``name, seq`` in colour digits, the primer in front."""
    return reads.select("name", F.concat(F.substring("primer", 1, 1), S.to_colors(F.concat(F.substring("primer", 2, 1), "seq"))).alias("seq"))


def pseudo_fasta(first: DataFrame, second: DataFrame | None = None, reverse_second: bool = True) -> DataFrame:
    """Colour reads as letters without primer and first colour; pairs alternate, the second reversed. Sort by ``name, mate``."""
    letters = S.to_letters(F.substring("seq", F.lit(3), F.char_length("seq")))
    a = first.select("name", F.lit(1).alias("mate"), letters.alias("seq"))
    if second is None:
        return a
    return a.unionByName(second.select("name", F.lit(2).alias("mate"), (F.reverse(letters) if reverse_second else letters).alias("seq")))


def to_nucleotides(reads: DataFrame, starts: str = "T") -> DataFrame:
    """Colour reads decoded from each of the start bases: ``name, start, seq``."""
    rows = reads.withColumn("start", F.explode(F.array(*[F.lit(s) for s in starts])))
    return rows.select("name", "start", S.decode_colors(F.col("seq"), F.col("start")).alias("seq"))


def replace_sequences(reads: DataFrame, corrected: DataFrame, key: str = "name") -> DataFrame:
    """Reads with the corrected sequence of the same name; a read without one is an error."""
    joined = reads.join(corrected.select(key, F.col("seq").alias("_new")), key, "left")
    missing = F.raise_error(F.concat(F.lit("no corrected read: "), F.col(key).cast("string"))).cast("string")
    return joined.withColumn("seq", F.coalesce("_new", missing)).drop("_new")


def n_statistics(seqs: DataFrame) -> DataFrame:
    """Records, bases and N50 of a file."""
    rows = seqs.select(F.char_length("seq").alias("n"))
    run = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    by = rows.groupBy("n").agg(F.sum("n").alias("s"), F.count(F.lit(1)).alias("k"))
    return by.withColumn("run", F.sum("s").over(run)).withColumn("all", F.sum("s").over(Window.partitionBy())).agg(F.sum("k").alias("records"), F.sum("s").alias("bases"), F.max(F.when(F.col("run") * 2 >= F.col("all"), F.col("n"))).alias("n50"))
