"""Views that give the star-schema tables the shape of sequencing data.

Each comes as a DataFrame and as the SQL text of the same rows, so a query and
its SQL check start from one definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import scratch


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment hits: read, reference, signed position, edit distance, mate."""
    line = read(spark, sf_dir, "lineitem")
    return line.select(
        F.col("l_orderkey").alias("read_id"),
        F.col("l_partkey").alias("seq_id"),
        F.col("l_linenumber").cast("long").alias("ed"),
        F.floor("l_quantity").cast("long").alias("pos"),
        F.when(F.col("l_returnflag") == "R", -1).otherwise(1).cast("long").alias("strand"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(2).cast("long").alias("mate"),
    ).distinct()


HITS = """hits AS (
  SELECT DISTINCT l_orderkey AS read_id, l_partkey AS seq_id, CAST(l_linenumber AS BIGINT) AS ed,
         CAST(floor(l_quantity) AS BIGINT) AS pos,
         CAST(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS BIGINT) AS strand,
         CAST(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 2 END AS BIGINT) AS mate
  FROM lineitem)"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference catalog: sequence, length, parent taxon, description."""
    part = read(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("seq_id"),
        F.floor("p_retailprice").cast("long").alias("seq_len"),
        F.col("p_brand").alias("parent_id"),
        F.col("p_name").alias("descr"),
    )


CATALOG = """catalog AS (
  SELECT p_partkey AS seq_id, CAST(floor(p_retailprice) AS BIGINT) AS seq_len, p_brand AS parent_id, p_name AS descr
  FROM part)"""


#: Letters of a text as bases, and as qualities; whatever else is there is N, or the quality 20.
LETTERS, AS_BASES, AS_QUALITIES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC", "IIIIHHHHGGFFEEDD@@??==AABB"


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads: every document as sequence and quality, two neighbours as a pair."""
    docs = read(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("read_id"),
        F.floor(F.col("doc_id") / 2).cast("long").alias("pair_id"),
        (F.col("doc_id") % 2 + 1).cast("long").alias("mate"),
        F.regexp_replace(F.translate("text", LETTERS, AS_BASES), "[^ACGT]", "N").alias("seq"),
        F.regexp_replace(F.translate("text", LETTERS, AS_QUALITIES), "[^A-I=?@5]", "5").alias("qual"),
    )


READS = f"""reads AS (
  SELECT doc_id AS read_id, doc_id // 2 AS pair_id, doc_id % 2 + 1 AS mate,
         regexp_replace(translate(text, '{LETTERS}', '{AS_BASES}'), '[^ACGT]', 'N', 'g') AS seq,
         regexp_replace(translate(text, '{LETTERS}', '{AS_QUALITIES}'), '[^A-I=?@5]', '5', 'g') AS qual
  FROM documents)"""


def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs: the bases of every document."""
    docs = read(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.regexp_replace(F.translate("text", "acgt", "ACGT"), "[^ACGT]", "").alias("seq"))


SEQS = """seqs AS (
  SELECT doc_id AS id, regexp_replace(translate(text, 'acgt', 'ACGT'), '[^ACGT]', '', 'g') AS seq FROM documents)"""


def links(spark: SparkSession, sf_dir: str, least: int = 2) -> DataFrame:
    """Edges: parts that share orders, with their number as score.

    Lines and pairs of parts are dealt out by the number of lines; few pairs occur
    twice, so they are counted only where they meet.
    """
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    lines = line.count()
    own = scratch.dealt(line, lines, "l_orderkey").distinct()
    a, b = own.withColumnRenamed("l_partkey", "n1"), own.withColumnRenamed("l_partkey", "n2")
    pairs = scratch.dealt(a.join(b, "l_orderkey").filter("n1 < n2").select("n1", "n2"), 2 * lines, "n1", "n2")
    rows = pairs.groupBy("n1", "n2").agg(F.count(F.lit(1)).alias("num")).filter(F.col("num") >= least)
    score = F.col("num") * 1000 + (F.col("n1") * 31 + F.col("n2") * 17) % 997
    return rows.select("n1", "n2", F.lit("FB").alias("dir"), "num", score.cast("double").alias("bits"), score.cast("double").alias("score"))


def links_sql(least: int = 2) -> str:
    return f"""own AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
links AS (
  SELECT a.l_partkey AS n1, b.l_partkey AS n2, 'FB' AS dir, count(*) AS num,
         CAST(count(*) * 1000 + (a.l_partkey * 31 + b.l_partkey * 17) % 997 AS DOUBLE) AS score
  FROM own a JOIN own b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey
  GROUP BY a.l_partkey, b.l_partkey HAVING count(*) >= {least})"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes: parts with a length, coverage and GC."""
    part = read(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("id"), (F.col("p_size") * 100 + F.col("p_partkey") % 97).cast("long").alias("seq_len"), (F.col("p_size") + 1.0).alias("cov"), ((F.col("p_partkey") % 60 + 20) / 100.0).alias("pct_gc")
    )


NODES = """nodes AS (
  SELECT p_partkey AS id, CAST(p_size * 100 + p_partkey % 97 AS BIGINT) AS seq_len, CAST(p_size + 1.0 AS DOUBLE) AS cov,
         CAST(p_partkey % 60 + 20 AS DOUBLE) / 100.0 AS pct_gc
  FROM part)"""
