"""Mixing sources to target weights by Pfair scheduling.

Where the sources share the slots exactly by weight, a block of a source is
served from some time to another; it is released at the slot in which the first
lies and due by the end of that with the second. Earliest deadline first over the
released blocks keeps every source within one block of its exact share at every
slot. Once a source has no blocks left, the others go on with their weights
scaled up, and no row is dropped.

Release times and deadlines follow from the blocks and weights of the sources. The
driver puts the blocks in order, one step and some tens of bytes for each; rows
take their slots from their blocks.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quern import scratch


def shares(weights: dict[str, float], resolution: int) -> tuple[dict[str, int], int]:
    """Weights as whole parts of ``q`` slots, each at least one, by largest remainder."""
    q = max(resolution, 10 * len(weights))
    total = math.fsum(weights.values())
    exact = {k: Fraction(w) / Fraction(total) * q for k, w in weights.items()}
    parts = {k: max(1, math.floor(x)) for k, x in exact.items()}
    order = sorted(parts, key=lambda k: (parts[k] - exact[k], k))
    at = 0
    while (left := q - sum(parts.values())) > 0:
        parts[order[at % len(order)]] += 1
        at += 1
    while left < 0:
        k = max(parts, key=lambda k: (parts[k] - exact[k] if parts[k] > 1 else -math.inf, k))
        parts[k] -= 1
        left += 1
    return parts, q


def period(parts: dict[str, int], q: int) -> dict[str, list[int]]:
    """The slots, within one period, of each source's blocks."""
    slots: dict[str, list[int]] = {k: [] for k in parts}
    released: list[list[str]] = [[] for _ in range(q + 1)]
    for k in sorted(parts):
        released[0].append(k)
    ready: list[tuple[int, str]] = []
    for t in range(q):
        for k in released[t]:
            heapq.heappush(ready, (-(-(len(slots[k]) + 1) * q // parts[k]), k))
        _, k = heapq.heappop(ready)
        slots[k].append(t)
        if (j := len(slots[k])) < parts[k]:
            released[max(t + 1, j * q // parts[k])].append(k)
    return slots


def phases(blocks: dict[str, int], weights: dict[str, float], resolution: int) -> list[tuple]:
    """Rows (source, first block, blocks, first slot, blocks a period, period, slots in a period) of the whole schedule."""
    out, slot, done = [], 0, dict.fromkeys(blocks, 0)
    while left := {k: n - done[k] for k, n in blocks.items() if n > done[k]}:
        parts, q = shares({k: weights[k] for k in left}, resolution)
        slots = period(parts, q)
        # Whole periods while none ends in them, then up to the slot in which the first does.
        whole = min((n - 1) // parts[k] for k, n in left.items())
        rest = {k: n - whole * parts[k] for k, n in left.items()}
        cut = min(slots[k][rest[k] - 1] + 1 for k in left if rest[k] <= parts[k])
        for k in left:
            n = whole * parts[k] + sum(s < cut for s in slots[k])
            if n:
                out.append((k, done[k], n, slot, parts[k], q, slots[k]))
                done[k] += n
        slot += whole * q + cut
    return out


def windows(blocks: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Source, number in it, release slot and deadline of every block.

    At virtual time v a source has been served ``min(blocks, weight * v)``; the
    slots gone by then are the sum over all sources.
    """
    w = weights.astype(np.longdouble)
    ends = blocks / w
    order = np.argsort(ends, kind="stable")
    over = np.concatenate([[0], np.cumsum(blocks[order])])
    active = np.concatenate([np.cumsum(w[order][::-1])[::-1], [0]])

    def time(v: np.ndarray) -> np.ndarray:
        at = np.searchsorted(ends[order], v)
        return over[at] + v * active[at]

    source = np.repeat(np.arange(len(blocks)), blocks)
    nth = np.arange(len(source)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    near = 1e-6  # a time this near to a slot's edge is on it
    release = np.floor(time(nth / w[source]) + near).astype(np.int64)
    due = np.ceil(time((nth + 1) / w[source]) - near).astype(np.int64)
    return source, nth, release, due


def schedule(blocks: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Source, number in it and slot of every block, by the exact weights; ties go to the first source."""
    source, nth, release, due = windows(blocks, weights)
    order = np.lexsort((nth, source, due))
    source, nth, release = source[order], nth[order], release[order]
    coming = np.argsort(release, kind="stable")
    slots = np.zeros(len(order), dtype=np.int64)
    block, start, slot = memoryview(coming), memoryview(release[coming]), memoryview(slots)
    ready: list[int] = []
    at = 0
    for t in range(len(order)):
        while at < len(order) and (start[at] <= t or not ready):
            heapq.heappush(ready, block[at])
            at += 1
        slot[heapq.heappop(ready)] = t
    return source, nth, slots


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def _plan(sources: DataFrame, block_rows: int, resolution: int | None) -> DataFrame:
    """The table ``id, block, slot`` of all blocks."""
    held = sources.select("id", "n", "w").toArrow().sort_by("id")  # numbers only: a source's name may be long
    ids, n, w = (held.column(c).to_numpy() for c in ("id", "n", "w"))
    blocks = -(-n // block_rows)
    if resolution is None:
        source, nth, slot = schedule(blocks, w)
    else:
        keys = {i: f"{i:012d}" for i in range(len(ids))}  # sorted like the sources
        rows = phases({keys[i]: int(x) for i, x in enumerate(blocks)}, {keys[i]: float(x) for i, x in enumerate(w)}, resolution)
        placed = [(int(k), first + j, slot0 + j // p * q + own[j % p]) for k, first, m, slot0, p, q, own in rows for j in range(m)]
        source, nth, slot = np.array(placed, dtype=np.int64).reshape(-1, 3).T
    made = pa.table({"id": pa.array(ids[source], pa.int64()), "block": pa.array(nth, pa.int64()), "slot": pa.array(slot, pa.int64())})
    return sources.sparkSession.createDataFrame(made)


def interleave(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: dict[str | None, float] | None = None,
    block_rows: int = 64,
    resolution: int | None = None,
    max_sources: int | None = None,
) -> DataFrame:
    """All rows and columns, with ``mix_slot`` and ``mix_position`` after them.

    Rows of a source are ordered by a hash of their id and cut into blocks of
    ``block_rows``; the last may be shorter. Sorted by ``mix_position``, which is
    the slot times ``block_rows`` plus the place in the block, every stretch of
    the result follows the target weights to within one block per source.

    * ``weights`` is by source; without it a source weighs the square root of
      its rows. Sources it lacks, or gives nothing, weigh the least that any has.
    * A null source is a source of its own. Null and repeated ids are rows like
      any other; rows alike in id change places freely.
    * With ``resolution`` weights are rounded to parts of it, and the schedule
      repeats after as many slots; the bound then holds for the rounded weights,
      anew whenever a source ends.
    * More than ``max_sources`` sources are an error, where it is given.
    * Columns named like the two new ones are replaced; others may have any names.
    * Texts and other columns of any length travel once. An empty table stays empty.

    Numbering is in two steps, by ranges of the hash, so a source with a third of
    all rows is spread over as many tasks as the data need.
    """
    spark, names = docs.sparkSession, [n for n in docs.columns if n not in ("mix_slot", "mix_position")]
    key, order = _key(F.col(source_col)), F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    sizes = docs.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        sizes = sizes.withColumn("w", F.sqrt("n"))
    else:
        given = {"null" if k is None else f"={k}": float(w) for k, w in weights.items() if w and w > 0}
        least = min(given.values(), default=1.0)
        sizes = sizes.join(spark.createDataFrame(list(given.items()), "k string, w double"), "k", "left").withColumn("w", F.coalesce("w", F.lit(least)))
    sources = scratch.table(sizes.orderBy("k").withColumn("id", F.monotonically_increasing_id()), "sources")  # ids in the order of k
    if max_sources is not None and sources.count() > max_sources:
        raise ValueError(f"more than {max_sources} sources")

    total = sources.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = max(0, math.ceil(math.log2(max(1, total / 20_000))))
    bucket = F.shiftrightunsigned(order, 64 - bits) if bits else F.lit(0).cast("long")
    counts = docs.groupBy(key.alias("k"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))

    # the slots of the blocks that each range of the hash has rows of
    at_block = lambda at: F.floor(at / block_rows).cast("long")
    first = at_block(F.col("before"))
    spans = counts.join(sources.select("k", "id"), "k").select("k", "bucket", "before", "id", F.explode(F.sequence(first, at_block(F.col("before") + F.col("rows") - 1))).alias("block"))
    slots = spans.join(_plan(sources, block_rows, resolution), ["id", "block"]).groupBy("k", "bucket", "before").agg(F.sort_array(F.collect_list(F.struct("block", "slot"))).alias("slots"))
    slots = scratch.table(slots.withColumn("slots", F.col("slots.slot")), "slots")

    whole = F.struct(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)]).alias("row")
    rows = docs.select(whole, key.alias("k"), bucket.alias("bucket"), order.alias("h"), F.col(id_col).alias("i"))
    place = F.row_number().over(Window.partitionBy("k", "bucket").orderBy("h", "i")) - 1
    found = rows.withColumn("place", place).join(slots, ["k", "bucket"]).withColumn("at", F.col("before") + F.col("place"))
    slot = F.element_at("slots", (at_block(F.col("at")) - first + 1).cast("int"))
    return found.withColumn("mix_slot", slot.cast("long")).select(
        *[F.col(f"row.c{i}").alias(n) for i, n in enumerate(names)],
        "mix_slot",
        (F.col("mix_slot") * block_rows + F.pmod(F.col("at"), F.lit(block_rows))).cast("long").alias("mix_position"),
    )
