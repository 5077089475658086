"""From raw documents to a training mixture, in five stages.

Each stage takes (spark, docs, sf_dir) and gets what the one before it kept. All
but the last return the columns of ``documents``; the last adds a document's
place in the mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern import scratch
from quern.llm import decontaminate, exact_dedup, langid, mix, near_dup


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and texts that no learnt language codes better than raw bytes."""
    return langid.keep_identified(docs, langid.train(docs))


def drop_exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at 0.8 of their five-word shingles that with the smallest doc_id stays."""
    return near_dup.keep_one(docs, shingle=5, percent=80)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold 0.8 or more of a benchmark item's five-word shingles."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's slot and position in a mixture by the square root of the sources' sizes."""
    return mix.interleave(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_duplicates),
    ("minhash_near_dup", drop_near_duplicates),
    ("decontaminate", decontaminate_benchmark),
    ("mix_sources", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each one's result is a table that the next one reads, and only the last one's stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch.scope() as made:
        for name, stage in STAGES:
            docs = scratch.table(stage(spark, docs, sf_dir), name)
        return made.keep(docs)


#: Language identification has no SQL form; run() is tested against a brute-force version.
ORACLE_SQL = None
