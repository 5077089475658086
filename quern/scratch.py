"""Intermediate tables in the folder that every executor shares.

Operators that need a result twice, or want to cut a long lineage, write it
here instead of caching it: a lost executor then costs a re-read, not a
recomputation of everything before it.
"""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Narrow rows that one task writes in a second or so.
ROWS_A_TASK = 250_000
#: The largest table that is sent to every task.
BROADCAST_BYTES = 16 << 20


def root(spark: SparkSession) -> str:
    """This application's scratch folder under ``spark.checkpoint.dir``.

    Where the setting is absent on a local master (tests, a laptop) a temporary
    folder is made and registered with the session once. On a cluster it is an
    error: no other machine would see what is written there.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quern-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/quern-{sc.applicationId}"


def folder(spark: SparkSession, name: str) -> str:
    """A path under the scratch root that nothing else uses."""
    return f"{root(spark)}/{name}-{uuid.uuid4().hex}"


class Scope:
    """The tables written in one block of work."""

    def __init__(self) -> None:
        self.made: dict[str, SparkSession] = {}
        self.last: str | None = None
        self.kept: list[str] = []

    def keep(self, written: DataFrame) -> DataFrame:
        """The table that was written last, which stays after the block."""
        self.kept.append(self.last)
        return written


_open: list[Scope] = []


@contextlib.contextmanager
def scope() -> Iterator[Scope]:
    """Deletes the tables written in a block when it ends, but those that it keeps, which the block around it then owns."""
    own = Scope()
    _open.append(own)
    try:
        yield own
    finally:
        _open.remove(own)
        for path, spark in own.made.items():
            if path not in own.kept:
                drop(spark, path)
            elif _open:
                _open[-1].made[path] = spark
                _open[-1].last = path


def table(df: DataFrame, name: str, most_rows: int | None = None, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet and read it back, cutting its lineage.

    ``codec`` is for columns of text, which a stronger one than the session's makes smaller.

    Where at most ``most_rows`` rows are known to come, they are written by as many
    tasks as those need, not by one for each shuffle partition.
    """
    path = folder(df.sparkSession, name)
    if most_rows is not None and (tasks := most_rows // ROWS_A_TASK + 1) < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        df = df.coalesce(tasks)
    if _open:
        _open[-1].made[path], _open[-1].last = df.sparkSession, path
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """The rows with their place in an order, from 1, as ``name``.

    They are sorted in ranges by as many tasks as the data need; only the ranges'
    sizes meet in one.
    """
    place = F.monotonically_increasing_id()
    part = F.shiftright(place, 33)
    ranges = table(df.orderBy(*order).select("*", part.alias("_part"), (place - F.shiftleft(part, 33)).alias("_at")), name)
    sizes = ranges.groupBy(F.col("_part").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    first = sizes.select("_of", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    return ranges.join(first, F.col("_part") == F.col("_of")).withColumn(name, (F.col("_first") + F.col("_at") + 1).cast("int")).drop("_part", "_at", "_of", "_first")


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt out by its keys to as many tasks as about ``rows`` rows need.

    What adaptive execution merges into as many tasks as there are cores gives each
    of them more memory to hold as the input grows; a number that is given stays.
    """
    return df.repartition(max(rows // ROWS_A_TASK + 1, df.sparkSession.sparkContext.defaultParallelism), *keys)


def by_group(df: DataFrame, key: str, run: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """What ``run`` makes of the rows of each value of ``key``.

    Rows are sorted by the key in each task and taken as a stream, so a task holds
    one group at a time, and many small groups cost no more than their rows.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, out = [], None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                out.clear()

        for batch in batches:
            for row in batch.to_pylist():
                if held and row[key] != at:
                    out.extend(run(held))
                    held = []
                    if len(out) >= 10_000:
                        yield from flush()
                held.append(row)
                at = row[key]
        if held:
            out.extend(run(held))
        yield from flush()

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    names, types = arrow.names, arrow.types
    return df.repartition(key).sortWithinPartitions(key).mapInArrow(stream, schema)


def row_bytes(schema: StructType) -> int | None:
    """Bytes that a row takes in memory, about; None where a column's values have no bound."""
    fixed = {"boolean", "byte", "short", "integer", "long", "float", "double", "date", "timestamp"}
    return 16 + 8 * len(schema) if all(f.dataType.typeName() in fixed for f in schema) else None


def sized(written: DataFrame, most_rows: int, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A written table, marked for broadcast if it has at most ``most_rows`` rows and ``most_bytes`` bytes; joined by a shuffle beyond.

    A table with strings, arrays or the like is never sent.
    """
    if (width := row_bytes(written.schema)) is None:
        return written
    return F.broadcast(written) if written.count() <= min(most_rows, most_bytes // width) else written


def settle(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps whose results are tables now.

    Spark does so once the driver has collected what refers to them, which on an
    idle driver may take half an hour.
    """
    gc.collect()
    spark._jvm.System.gc()


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete scratch folders that no live DataFrame reads any more."""
    for path in paths:
        with contextlib.suppress(Exception):
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop_table(df: DataFrame) -> None:
    """Delete what :func:`table` wrote for ``df``."""
    drop(df.sparkSession, *{f.rpartition("/")[0] for f in df.inputFiles()})


def clear(spark: SparkSession) -> None:
    """Delete every scratch table of this application."""
    drop(spark, root(spark))
