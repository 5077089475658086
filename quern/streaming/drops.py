"""Read files that keep arriving, as a stream: an extension, each file a bounded input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.sources.fastq import read_fastq


def watch(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None], once: bool = False) -> StreamingQuery:
    """Calls ``handle(reads, batch)`` with the records of the FASTQ files that came since the last batch.

    The stream itself carries only the files' paths; records are read as in batch.
    """
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.fastq*").schema("path string, modificationTime timestamp, length long, content binary").load(folder).select("path")

    def batch(paths: DataFrame, number: int) -> None:
        own = [r.path for r in paths.collect()]
        if own:
            handle(read_fastq(spark, own), number)

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def base_counts(reads: DataFrame) -> DataFrame:
    """Reads and bases by file, for a handler."""
    return reads.groupBy("file").agg(F.count(F.lit(1)).alias("reads"), F.sum(F.char_length("seq")).alias("bases"))
