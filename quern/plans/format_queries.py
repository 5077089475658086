"""Queries that write a format and read it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import scratch
from quern.functions import sequence as S
from quern.plans import adapters as A
from quern.sources import fasta, fastq, sam, solid


def fastq_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = A.reads(spark, sf_dir).select(F.col("read_id").cast("string").alias("read_id"), F.lit("lib").alias("prefix"), F.col("mate").cast("int").alias("mate"), F.lit(None).cast("string").alias("primer"), F.lit(None).cast("int").alias("trim_len"), "seq", "qual")
    path = scratch.folder(spark, "fastq")
    fastq.write_fastq(own, path, fastq.header_of(add_len=True))
    back = fastq.read_fastq(spark, path)
    return back.select(*[c.alias(n) for n, c in fastq.parse_header(F.col("header")).items() if n in ("trim_len", "prefix", "read_id", "mate")], F.md5("seq").alias("seq_md5"), F.md5("qual").alias("qual_md5"))


def fasta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = A.seqs(spark, sf_dir).filter("seq <> ''").select(F.concat(F.lit("c"), F.col("id").cast("string"), F.lit(" contig")).alias("name"), "seq")
    path = scratch.folder(spark, "fasta")
    fasta.write_fasta(own, path, width=60)
    return fasta.read_fasta(spark, path).select("name", "descr", F.md5("seq").alias("seq_md5"))


def fasta_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = A.seqs(spark, sf_dir).select(F.col("id").alias("name"), "seq")
    return fasta.filter_fasta(own, 300, 5000).select("name")


def fasta_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.seqs(spark, sf_dir).select("id", F.md5(fasta.wrap(F.col("seq"), 70)).alias("text_md5"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = A.seqs(spark, sf_dir).select(F.col("id").cast("string").alias("name"), F.lit(None).cast("string").alias("descr"), "seq")
    return fasta.catalog_of(own)


def catalog_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.folder(spark, "catalog")
    A.catalog(spark, sf_dir).write.csv(path, sep="\t")
    return fasta.read_catalog(spark, path)


def select_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = A.seqs(spark, sf_dir).select(F.col("id").cast("string").alias("name"), "seq")
    parts = A.read(spark, sf_dir, "part")
    table = parts.select(F.col("p_partkey").cast("string").alias("name"), (F.col("p_size") - 25).alias("cov"), (F.col("p_size") / 1000.0).alias("rel_ab"))
    return fasta.select_by_table(own, table, with_abundance=True).select("name", F.md5("seq").alias("seq_md5"))


def attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = A.seqs(spark, sf_dir).select("id", (F.char_length("seq") + 1).alias("n"))
    cat = refs.select(F.col("id").alias("seq_id"), F.col("n").alias("seq_len"))
    own = A.seqs(spark, sf_dir).select(F.col("id").alias("name"), "seq")
    return fasta.attach(cat, own).select("seq_id", F.round("pct_gc", 9).alias("pct_gc"))


def csfasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour reads of orders, written as CSFASTA and QUAL, read as FASTQ records and written back."""
    o = A.read(spark, sf_dir, "orders").select(F.concat_ws("_", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.lit("7"), F.lit("F3")).alias("name"), F.translate(F.col("o_orderkey").cast("string"), "456789", "0123..").alias("c"))
    colors, quals = scratch.folder(spark, "colors"), scratch.folder(spark, "quals")
    fasta.write_fasta(o.select("name", F.concat(F.lit("T1"), "c").alias("seq")), colors)
    phred = F.array_join(F.transform(S.chars(F.concat(F.lit("0"), "c")), lambda x: F.when(x == ".", "-1").otherwise(x)), " ")
    fasta.write_fasta(o.select("name", phred.alias("seq")), quals)
    back = fasta.read_csfasta(spark, colors, quals)
    return back.join(fasta.to_csfasta(back).withColumnRenamed("seq", "csfasta"), "name")


def sam_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = A.hits(spark, sf_dir).groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("seq_id", "pos", "strand", "ed", "mate"))).alias("h"))
    first = F.element_at("h", 1)
    others = F.transform(F.slice("h", F.lit(2), F.size("h")), lambda x: F.concat(x["seq_id"].cast("string"), F.when(x["strand"] < 0, ",-").otherwise(",+"), x["pos"].cast("string"), F.lit(",50M,"), x["ed"].cast("string"), F.lit(";")))
    line = F.concat_ws("\t", F.concat(F.col("read_id").cast("string"), F.lit("/1")), F.when(first["strand"] < 0, "16").otherwise("0"), first["seq_id"].cast("string"), first["pos"].cast("string"), F.lit("37"), F.lit("50M"), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("A" * 50), F.lit("*"), F.concat(F.lit("NM:i:"), first["ed"].cast("string")), F.concat(F.lit("XA:Z:"), F.array_join(others, "")))
    path = scratch.folder(spark, "sam")
    hits.select(line.alias("value")).write.text(path)
    back = sam.read_hits(spark, path)
    return back.select(F.col("read_key").cast("long").alias("read_id"), F.col("seq_id").cast("long").alias("seq_id"), F.col("pos").cast("long").alias("pos"), F.col("ed").cast("long").alias("ed"))


def legacy_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = A.hits(spark, sf_dir)
    line = F.concat_ws("\t", F.col("seq_id").cast("string"), (F.col("pos") * F.col("strand")).cast("string"), F.col("ed").cast("string"))
    own = hits.groupBy("read_id").agg(F.sort_array(F.collect_list(line)).alias("h"))
    head = F.concat(F.lit(">TA+50|lib:"), F.col("read_id").cast("string"), F.lit("/1 "), F.size("h").cast("string"))
    path = scratch.folder(spark, "legacy")
    own.select(F.concat_ws("\n", head, F.array_join("h", "\n")).alias("value")).write.text(path)
    return sam.read_legacy_hits(spark, path).select("read_key", "seq_id", "pos", "ed", "read_len")


def sam_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = A.catalog(spark, sf_dir)
    path = scratch.folder(spark, "header")
    cat.select(F.concat(F.lit("@SQ\tSN:"), F.col("seq_id").cast("string"), F.lit("\tLN:"), F.col("seq_len").cast("string"), F.lit("\tSP:"), "descr").alias("value")).write.text(path)
    return sam.read_header(spark, path).select(F.col("seq_id").cast("long").alias("seq_id"), "seq_len", "descr")


def _colored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of orders: ``name, c``, and whether the order is finished."""
    o = A.read(spark, sf_dir, "orders")
    name = F.concat_ws("_", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.lit("7"))
    return o.select(name.alias("name"), F.translate(F.col("o_orderkey").cast("string"), "456789", "0123..").alias("c"), (F.col("o_orderstatus") == "F").alias("done"))


def solid_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A library of colour files, the first end of finished orders only, found by its prefix and converted."""
    prefix = f"{scratch.folder(spark, 'solid')}/lib"
    for tag, rows in (("F3", _colored(spark, sf_dir)), ("R3", _colored(spark, sf_dir).filter("done"))):
        name = F.concat("name", F.lit(f"_{tag}"))
        fasta.write_fasta(rows.select(name.alias("name"), F.concat(F.lit("T1"), "c").alias("seq")), f"{prefix}_{tag}.csfasta")
        phred = F.array_join(F.transform(S.chars(F.concat(F.lit("0"), "c")), lambda x: F.when(x == ".", "-1").otherwise(x)), " ")
        fasta.write_fasta(rows.select(name.alias("name"), phred.alias("seq")), f"{prefix}_{tag}.QV.qual")
    return solid.convert(spark, prefix, "lib").select("read_id", "primer", "prefix", "mate", "seq", "qual", "part")


def pseudo_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _colored(spark, sf_dir).select("name", F.concat(F.lit("T1"), "c").alias("seq"), "done")
    return fasta.pseudo_fasta(own, own.filter("done"))


def replace_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = A.reads(spark, sf_dir).select(F.col("read_id").alias("name"), "seq", "qual")
    done = fasta.replace_sequences(own, own.select("name", F.translate("seq", "N", "A").alias("seq")))
    return done.select("name", F.md5("seq").alias("seq_md5"), F.md5("qual").alias("qual_md5"))


def simulated_illumina(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = A.reads(spark, sf_dir).select(F.concat(F.lit("@sim-"), F.col("read_id").cast("string"), F.lit("-x")).alias("header"), "seq", "qual")
    return solid.simulated_illumina(own).select("header", "plus", F.md5("seq").alias("seq_md5"), F.md5("qual").alias("qual_md5"))


def simulated_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _colored(spark, sf_dir).select(F.concat(F.lit("@"), "name", F.lit(":rest")).alias("header"), F.concat(F.lit("T1"), "c").alias("seq"), F.concat(F.lit("5"), F.translate("c", ".", "!")).alias("qual"))
    return solid.simulated_colors(own, "lib")


QUERIES = {
    "format_solid": solid_convert,
    "format_pseudo_fasta": pseudo_fasta,
    "format_replace_sequences": replace_sequences,
    "format_simulated_illumina": simulated_illumina,
    "format_simulated_colors": simulated_colors,
    "format_fastq": fastq_round_trip,
    "format_fasta": fasta_round_trip,
    "format_fasta_filter": fasta_filter,
    "format_fasta_wrap": fasta_wrap,
    "format_catalog": catalog,
    "format_catalog_file": catalog_file,
    "format_select_by_table": select_by_table,
    "format_attach_reference": attach,
    "format_csfasta": csfasta,
    "format_sam": sam_round_trip,
    "format_legacy_hits": legacy_round_trip,
    "format_sam_header": sam_header,
}

_COLORED = """o AS (SELECT o_orderkey || '_' || o_custkey || '_7' AS name, translate(CAST(o_orderkey AS VARCHAR), '456789', '0123..') AS c, o_orderstatus = 'F' AS done FROM orders)"""

ORACLES = {
    "format_solid": f"""WITH {_COLORED}, k AS (SELECT name AS read_id, 'TC' AS primer, 'lib' AS prefix, translate(c, '0123.', 'ACGTN') AS seq, translate(c, '0123.', '!"#$!') AS qual, done FROM o)
SELECT * EXCLUDE done, CAST(2 AS INTEGER) AS mate, CASE WHEN done THEN 'read2' ELSE 'single' END AS part FROM k
UNION ALL SELECT * EXCLUDE done, 1, 'read1' FROM k WHERE done""",
    "format_pseudo_fasta": f"""WITH {_COLORED} SELECT name, CAST(1 AS INTEGER) AS mate, translate(c, '0123.', 'ACGTN') AS seq FROM o
UNION ALL SELECT name, 2, reverse(translate(c, '0123.', 'ACGTN')) FROM o WHERE done""",
    "format_replace_sequences": f"WITH {A.READS} SELECT read_id AS name, md5(replace(seq, 'N', 'A')) AS seq_md5, md5(qual) AS qual_md5 FROM reads",
    "format_simulated_illumina": f"WITH {A.READS} SELECT '@' || length(seq) || '|sim:' || read_id || '-x/1' AS header, '+' AS plus, md5(seq) AS seq_md5, md5(qual) AS qual_md5 FROM reads",
    "format_simulated_colors": f"""WITH {_COLORED} SELECT '@TC+' || length(c) || '|lib:' || name AS header, translate(c, '0123.', 'ACGTN') AS seq, '+' AS plus, replace(c, '.', '!') AS qual FROM o""",
    "format_fastq": f"WITH {A.READS} SELECT CAST(length(seq) AS INTEGER) AS trim_len, 'lib' AS prefix, CAST(read_id AS VARCHAR) AS read_id, CAST(mate AS INTEGER) AS mate, md5(seq) AS seq_md5, md5(qual) AS qual_md5 FROM reads",
    "format_fasta": f"WITH {A.SEQS} SELECT 'c' || id AS name, 'contig' AS descr, md5(seq) AS seq_md5 FROM seqs WHERE seq <> ''",
    "format_fasta_filter": f"WITH {A.SEQS} SELECT id AS name FROM seqs WHERE length(seq) BETWEEN 300 AND 5000 AND NOT regexp_matches(seq, '(?i)((ttttt|aaaaa|ccccc|ggggg)[acgtn]{{0,2}}){{4}}')",
    "format_fasta_wrap": f"WITH {A.SEQS} SELECT id, md5(regexp_replace(regexp_replace(seq, '(.{{70}})', '\\1' || chr(10), 'g'), chr(10) || '$', '')) AS text_md5 FROM seqs",
    "format_catalog": f"WITH {A.SEQS} SELECT CAST(id AS VARCHAR) AS seq_id, length(seq) AS seq_len, CAST(id AS VARCHAR) AS parent_id, 'NA' AS descr FROM seqs",
    "format_catalog_file": f"WITH {A.CATALOG} SELECT CAST(seq_id AS VARCHAR) AS seq_id, seq_len, parent_id, descr FROM catalog",
    "format_select_by_table": f"WITH {A.SEQS} SELECT printf('%d_%.6f', id, p_size / 1000.0 * 100) AS name, md5(seq) AS seq_md5 FROM seqs JOIN part ON id = p_partkey WHERE p_size > 25",
    "format_attach_reference": f"WITH {A.SEQS} SELECT id AS seq_id, round(CASE WHEN length(seq) > 0 THEN CAST(length(regexp_replace(seq, '[^GC]', '', 'g')) AS DOUBLE) / length(seq) END, 9) AS pct_gc FROM seqs",
    "format_csfasta": """WITH o AS (SELECT o_orderkey || '_' || o_custkey || '_7' AS name, translate(CAST(o_orderkey AS VARCHAR), '456789', '0123..') AS c FROM orders)
SELECT name, 'TC' AS primer, translate(c, '0123.', 'ACGTN') AS seq, translate(c, '0123.', '!"#$!') AS qual, 'T1' || c AS csfasta FROM o""",
    "format_sam": f"WITH {A.HITS} SELECT read_id, seq_id, pos * strand AS pos, ed FROM hits",
    "format_legacy_hits": f"WITH {A.HITS} SELECT 'lib:' || read_id AS read_key, CAST(seq_id AS VARCHAR) AS seq_id, CAST(pos * strand AS INTEGER) AS pos, CAST(ed AS INTEGER) AS ed, 50 AS read_len FROM hits",
    "format_sam_header": f"WITH {A.CATALOG} SELECT seq_id, seq_len, descr FROM catalog",
}
