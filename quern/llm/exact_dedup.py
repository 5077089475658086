"""Exact deduplication, in DataFrame operations only.

Texts are grouped by a 128-bit content hash. The grouping key also holds the
text itself, so the hash aggregate compares bytes inside a hash group and a
collision yields two groups, never one. Aggregation is partial before the
shuffle: a group that holds a third of all rows reaches its reducer as one row
per map task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern import scratch


def content_hash(text: Column) -> Column:
    """The 128 bits by which texts are grouped."""
    return F.unhex(F.md5(text))


def mark_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    hash_of: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per input row: which row of its group of equal texts stays.

    Returns ``<id_col>, keep_id, group_size, kept, text_sha256``.

    * Null text counts as empty; texts are compared as they are.
    * ``keep`` names the id that stays, ``min`` or ``max``. Null ids lose to any
      other; a group of null ids only has a null ``keep_id``.
    * Rows that repeat an id count in ``group_size`` and share ``kept``.
    * Other columns, whatever their names, are not read.
    * Texts of any length are compared whole; an empty table gives none.

    The text is shuffled once, combined before; the join back to the rows moves
    only the id and the hashes, and adaptive execution splits a hot group there.
    """
    best = {"min": F.min, "max": F.max}[keep]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("hash", hash_of(F.col("text")))
    groups = (
        rows.groupBy("hash", "text")
        .agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("hash", F.sha2("text", 256).alias("sha"), "keep_id", "group_size")
    )
    # Colliding hashes are told apart by the second digest; should both collide, the job must not guess.
    groups = (
        groups.groupBy("hash", "sha")
        .agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count(F.lit(1)).alias("texts"))
        .withColumn("keep_id", F.when(F.col("texts") > 1, F.raise_error(F.lit("different texts share both digests")).cast("long")).otherwise(F.col("keep_id")))
        .drop("texts")
    )
    # As a table, so that the join reads plain exchanges and adaptive execution can split a hot group's rows.
    groups = scratch.table(groups, "groups")
    narrow = rows.select("id", "hash", F.sha2("text", 256).alias("sha"))
    return narrow.join(groups, ["hash", "sha"]).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: one per distinct text, that with the smallest id.

    Null text counts as empty when compared and comes out as it came in. Rows
    that share the id as well as the text are ordered by their other columns, those
    that have no order by their JSON, so one of them stays and always the same.
    Texts of any length are compared whole; columns keep their names, whatever they
    are; an empty table stays empty.
    """
    names = docs.columns
    whole = F.struct(*[F.col(f"`{n}`").alias(f"c{k}") for k, n in enumerate(names) if n != text_col], F.col(text_col).isNull().alias("was_null"))
    nested = ("map", "variant", "array", "struct")
    plain = [F.to_json(F.struct(F.col(f"`{f.name}`").alias("v"))) if f.dataType.typeName() in nested else F.col(f"`{f.name}`") for f in docs.schema if f.name not in (id_col, text_col)]
    order = F.struct(F.col(id_col).isNull().alias("o"), F.col(id_col).alias("i"), F.col(text_col).isNull().alias("t"), *[c.alias(f"o{k}") for k, c in enumerate(plain)])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = (
        docs.select(text.alias("text"), whole.alias("whole"), order.alias("order"))
        .groupBy(content_hash(F.col("text")).alias("hash"), "text")
        .agg(F.min_by("whole", "order").alias("whole"))
    )
    back = [
        (F.when(~F.col("whole.was_null"), F.col("text")) if n == text_col else F.col(f"whole.c{k}")).alias(n)
        for k, n in enumerate(names)
    ]
    return kept.select(*back)
