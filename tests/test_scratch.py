"""Scratch tables: what is broadcast, and what is deleted when."""

import pytest

from quern import scratch


def there(df):
    return bool(df.sparkSession.read.format("binaryFile").load(df.inputFiles()).count())


def test_a_scope_deletes_what_it_does_not_keep(spark):
    rows = spark.range(10)
    with scratch.scope() as outer:
        first = scratch.table(rows, "first")
        with scratch.scope() as inner:
            gone = scratch.table(first, "gone")
            files = gone.inputFiles()
            kept = inner.keep(scratch.table(gone, "kept"))
        with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
            spark.read.parquet(*files).count()
        assert there(kept) and there(first)
        last = outer.keep(scratch.table(kept, "last"))
        files = first.inputFiles() + kept.inputFiles()
    for f in files:
        with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
            spark.read.parquet(f).count()
    assert last.count() == 10


def test_tables_are_sent_by_bytes(spark):
    sent = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    few = scratch.table(spark.range(1000).selectExpr("id", "id as b"), "few")
    assert sent(scratch.sized(few, 10**6)) and not sent(scratch.sized(few, 999)) and not sent(scratch.sized(few, 10**6, 1000 * 32 - 1))
    assert not sent(scratch.sized(scratch.table(spark.range(3).selectExpr("cast(id as string) s"), "text"), 10**6))


def test_rows_are_numbered_in_order(spark):
    from pyspark.sql import functions as F

    rows = spark.range(5000).selectExpr("id", "id % 7 as k").repartition(9)
    got = scratch.numbered(rows, "n", F.desc("k"), F.asc("id")).orderBy("n").collect()
    assert [(r.k, r.id) for r in got] == sorted(((k % 7, k) for k in range(5000)), key=lambda x: (-x[0], x[1]))
    assert [r.n for r in got] == list(range(1, 5001))
    assert scratch.numbered(rows.filter("id < 0"), "n", F.asc("id")).count() == 0
