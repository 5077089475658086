"""Near-duplicate documents by MinHash and a multi-index Hamming join.

A document is the set of its word shingles. Its signature is 112 MinHash
values of 16 bits, split into 14 chunks of 8. Two signatures that differ in at
most 27 values agree, by pigeonhole, in all but at most one value of some chunk;
so every chunk is indexed under its 8 variants that leave one value out, and all
pairs within that distance share a key. (Pairs at a similarity of 0.8 differ in
22 on average, and beyond 27 most still meet: one pair in 17,000 is missed.)

Keys are as long as seven values, so unrelated documents rarely meet, and no
group is expanded into its pairs:

1. Documents with equal sets are one node from the start.
2. Each key's group has a leader, the node that shares the most keys with others;
   among copies of one original that is the original, to which they are more
   alike than to each other. Every node is paired with the best of its leaders.
   What the full sets confirm is a link.
3. Nodes that are still in another component than the leader of one of their
   groups are paired with that.
4. Nodes of one group that are still in different components, none of them the
   leader, are written as their differences from the leader. They differ from it in
   more than similar sets may, so similar ones share much of their differences:
   those that share one of the rarest are compared, and confirmed where they meet.
   What all have in common, be it a passage or the rest of an original, is in no
   difference, and brings nothing together.

Pairs within a component need no look, and pairs whose sizes or whose values,
in four bits each, rule out the similarity are dropped before their sets are
read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern import scratch
from quern.llm import tokens
from quern.llm.columns import long_id
from quern.operators.graph import connected_components

CHUNKS, WIDTH = 14, 8
VALUES = CHUNKS * WIDTH
#: Longs that hold four bits of every value.
LONGS = VALUES // 16

_rng = np.random.default_rng(20240229)
_MULTIPLIERS = _rng.integers(0, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT, _LEFT_OUT = (_rng.integers(0, 2**63, (CHUNKS, WIDTH), dtype=np.uint64) for _ in range(2))

_BITS = [f"s{k}" for k in range(LONGS)]
SKETCH = "doc_id long, n long, h1 long, h2 long, " + ", ".join(f"{c} long" for c in _BITS) + ", keys array<long>"


def most_apart(percent: int) -> int:
    """How many of the four-bit values a pair at the similarity may differ in: the mean and 4.1 deviations."""
    p = (1 - percent / 100) * 15 / 16
    return math.ceil(VALUES * p + 4.1 * math.sqrt(VALUES * p * (1 - p)))


def values_apart(a: list[Column], b: list[Column]) -> Column:
    """In how many four-bit values two signatures differ."""

    def differing(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        some = d
        for k in (1, 2, 3):
            some = some.bitwiseOR(F.shiftrightunsigned(d, k))
        return F.bit_count(some.bitwiseAND(F.lit(0x1111111111111111).cast("long")))

    parts = [differing(x, y) for x, y in zip(a, b, strict=True)]
    return sum(parts[1:], parts[0])


def signature(shingles: np.ndarray, step: int = 4096) -> np.ndarray:
    """The smallest of each of the 112 permuted values of a set."""
    least = np.full(VALUES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(shingles), step):
        np.minimum(least, (shingles[a : a + step, None] * _MULTIPLIERS).min(axis=0), out=least)
    return least >> np.uint64(32)


def index_keys(signatures: np.ndarray) -> np.ndarray:
    """For each row the keys of all chunks without one value."""
    chunks = (signatures & np.uint64(0xFFFF)).reshape(-1, CHUNKS, WIDTH)
    terms = tokens.mix(chunks * np.uint64(0x9E3779B97F4A7C15) + _SALT)
    return tokens.mix(terms.sum(axis=2, keepdims=True, dtype=np.uint64) - terms + _LEFT_OUT).reshape(-1, VALUES)


def _sets(values: list[bytes], size: int) -> Iterator[np.ndarray]:
    words, counts = tokens.split(values)
    h, made = tokens.shingles(tokens.hashes(words), counts, size)
    ends = np.cumsum(made)
    for a, b in zip(ends - made, ends, strict=True):
        yield np.unique(h[a:b])


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    raw = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def _sketch(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tokens.pieces(batch):
            n, digests, rows = [], [], []
            for own in _sets(tokens.texts(part), size):
                n.append(len(own))
                digests.append(_digest(own) if len(own) else (None, None))
                rows.append(signature(own))
            low = np.array(rows, dtype=np.uint64).reshape(-1, VALUES)
            fours = ((low >> np.uint64(16)) & np.uint64(15)).reshape(-1, LONGS, 16)
            packed = (fours << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64).astype(np.int64)
            keys = index_keys(low).astype(np.int64)
            offsets = pa.array(np.arange(len(n) + 1, dtype=np.int32) * VALUES)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(n, pa.int64()),
                    *[pa.array([d[k] for d in digests], pa.int64()) for k in (0, 1)],
                    *[pa.array(packed[:, k]) for k in range(LONGS)],
                    pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())),
                ],
                names=["doc_id", "n", "h1", "h2", *_BITS, "keys"],
            )


def _contents(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The sets of those rows whose digest is the one that is asked for."""
    for batch in batches:
        for part in tokens.pieces(batch):
            out = [
                (doc, h1, own.astype(np.int64))
                for doc, h1, h2, own in zip(part.column("doc_id").to_pylist(), part.column("h1").to_pylist(), part.column("h2").to_pylist(), _sets(tokens.texts(part), size), strict=True)
                if _digest(own) == (h1, h2)
            ]
            if out:
                offsets = np.concatenate([[0], np.cumsum([len(x[2]) for x in out])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([x[2] for x in out])))],
                    names=["doc_id", "h1", "shingles"],
                )


def _sets_of(docs: DataFrame, classes: DataFrame, digests: DataFrame, size: int, broadcast_rows: int) -> DataFrame:
    """A table ``doc_id, h1, shingles`` of the full sets with the digests ``h``."""
    nodes = scratch.table(digests.join(classes.select("h1", "h2", "rep"), F.col("h") == F.col("h1")).select(F.col("rep").alias("r"), "h1", "h2"), "nodes")
    own = docs.join(scratch.sized(nodes, broadcast_rows), F.col("doc_id") == F.col("r")).select("doc_id", "text", "h1", "h2")
    sets = scratch.table(own.mapInArrow(lambda b: _contents(b, size), "doc_id long, h1 long, shingles array<long>"), "sets")
    # A row that repeats, id and text, gives its set again.
    return scratch.table(sets.dropDuplicates(["h1"]), "sets") if sets.count() > nodes.count() else sets


def _confirm(docs: DataFrame, classes: DataFrame, pairs: DataFrame, size: int, percent: int, broadcast_rows: int) -> DataFrame:
    """``a, b``: the documents that stand for the sets of ``pairs``, where the full sets are similar."""
    needed = pairs.select(F.col("ha").alias("h")).unionByName(pairs.select(F.col("hb").alias("h"))).distinct()
    sets = _sets_of(docs, classes, needed, size, broadcast_rows)
    left = sets.select(F.col("h1").alias("ha"), F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("h1").alias("hb"), F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    both = pairs.select("ha", "hb").join(left, "ha").join(right, "hb")
    similar = both.filter(shared * 100 >= percent * (F.size("sa") + F.size("sb") - shared))
    links = scratch.table(similar.select("a", "b"), "links")
    scratch.drop_table(sets)
    return links


def _across(groups: DataFrame, sets: DataFrame, percent: int, block: int, broadcast_rows: int) -> DataFrame:
    """``ha, hb``: the similar sets of different components ``c`` in groups ``hub, h, c``, confirmed.

    A member is written as its difference ``d`` from the hub, for the difference of
    two members is that of their ``d``. Members that are no links of the hub lack or
    have more than two similar sets may differ in, so similar ones share part of
    their ``d``: of two that may be ``t`` shingles apart, one of the first ``t / 2 + 1``
    of the smaller ``d`` and of the first ``t + 1`` of the larger, rarest in the group
    first. What is common to the group is in no ``d``, and hardly ever comes first.

    Two members that meet in a shingle are compared, whole, inside the join. Where
    many meet, their list is dealt to blocks of ``block`` members.
    """
    own = groups.join(sets.select(F.col("h1").alias("h"), F.col("shingles").alias("sa")), "h")
    own = own.join(sets.select(F.col("h1").alias("hub"), F.col("shingles").alias("sl")), "hub")
    unlike = F.concat(F.array_except("sa", "sl"), F.array_except("sl", "sa"))
    rows = scratch.table(own.select("hub", "h", "c", F.size("sa").alias("n"), F.size(unlike).alias("m"), unlike.alias("d")), "apart")

    items = rows.select("hub", "h", "c", "n", "m", F.explode("d").alias("s"))
    known = items.groupBy(F.col("hub").alias("k"), F.col("s").alias("ks")).agg(F.count(F.lit(1)).alias("df"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    place = F.row_number().over(Window.partitionBy("hub", "h").orderBy("df", "s"))
    t = F.floor(F.col("n") * (100 - percent) / percent)
    ranked = items.join(known, (F.col("hub") == F.col("k")) & (F.col("s") == F.col("ks"))).withColumn("place", place)
    first = ranked.filter((F.col("place") <= t + 1) & (F.col("lo") < F.col("hi")))
    first = scratch.table(first.select("hub", "s", "h", "c", "n", "m", "place", (F.col("place") <= F.floor(t / 2) + 1).alias("index")), "first")
    lists = first.groupBy("hub", "s").agg(F.count(F.lit(1)).alias("size"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("index").alias("any"))
    lists = lists.filter("lo < hi AND any").select(F.col("hub").alias("k"), F.col("s").alias("ks"), F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    met = first.join(scratch.sized(scratch.table(lists, "lists"), broadcast_rows), (F.col("hub") == F.col("k")) & (F.col("s") == F.col("ks"))).drop("k", "ks")
    met = met.join(rows.select(F.col("hub").alias("k"), F.col("h").alias("kh"), "d"), (F.col("hub") == F.col("k")) & (F.col("h") == F.col("kh")))
    met = scratch.table(met.select("hub", "s", "h", "c", "n", "m", "d", "place", "index", "blocks"), "meet")

    of = lambda x: [F.col(k).alias(f"{k}{x}") for k in ("h", "c", "n", "m", "d", "place")]
    x = met.select("hub", "s", F.pmod(F.xxhash64("h"), "blocks").alias("block"), *of("a"))
    y = met.filter("index").select("hub", "s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("block"), *of("b"))
    # How many shingles of d two similar sets share at least.
    least = (F.col("ma") + F.col("mb")) / 2 - (F.col("na") + F.col("nb")) * (100 - percent) / (2 * (100 + percent)) - 1e-6
    first_of = (F.col("placea") <= F.col("ma") - least + 1) & (F.col("placeb") <= F.col("mb") - least + 1)
    once = (F.col("ca") != F.col("cb")) & ((F.col("mb") < F.col("ma")) | (F.col("mb") == F.col("ma")) & (F.col("hb") < F.col("ha")))
    shared = (F.col("na") + F.col("nb") - F.col("ma") - F.col("mb")) / 2 + F.size(F.array_intersect("da", "db"))
    similar = shared * 100 >= percent * (F.col("na") + F.col("nb") - shared)
    return scratch.table(x.join(y, ["hub", "s", "block"]).filter(once & first_of & similar).select("ha", "hb").distinct(), "across")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    broadcast_rows: int = 1_000_000,
    block: int = 1024,
) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked if their sets of distinct word shingles have
    ``100 * intersection >= percent * union``, confirmed on the full sets;
    ``component_id`` is the smallest id that links reach, ``kept`` marks it.

    * Words are runs of characters other than ASCII white space, A-Z lower-cased.
      Fewer words than ``shingle`` are one shingle; no words, or null, is the
      empty set, linked with nothing.
    * An id is one document: rows that share an id are linked to each other. A
      row with a null id is linked to nothing, has a null component and is kept.
    * Tables of keys and of documents to confirm are sent to all tasks up to
      ``broadcast_rows``, and joined by a shuffle beyond.
    * ``percent`` below 80 lowers the share of pairs that the index finds.
    * Ids are whole numbers. Other columns, whatever their names, are not read;
      texts of any length are read whole; an empty table gives no rows.

    The result is a table; the tables that it was made of are deleted.
    """
    with scratch.scope() as made:
        return made.keep(scratch.table(_found(docs, id_col, text_col, shingle, percent, broadcast_rows, block), "near"))


def _found(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, broadcast_rows: int, block: int) -> DataFrame:
    rows = docs.select(long_id(docs, id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketches = scratch.table(rows.mapInArrow(lambda b: _sketch(b, shingle), SKETCH), "sketches")
    known = sketches.filter("doc_id IS NOT NULL AND n > 0")
    classes = scratch.table(known.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), *[F.max(c).alias(c) for c in _BITS]), "classes")
    sized = lambda df: scratch.sized(df, broadcast_rows)

    index = known.select(F.explode("keys").alias("key"), F.col("h1").alias("h"))
    shared = index.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    shared = scratch.table(shared.filter("lo < hi").select(F.col("key").alias("k")), "keys")
    group = scratch.table(index.join(sized(shared), F.col("key") == F.col("k")).select("key", "h").distinct(), "groups")
    crowd = scratch.table(group.groupBy("key").agg(F.count(F.lit(1)).alias("crowd")), "crowds")
    # How many keys a node shares, with the digest's low half: a number that orders nodes, all but unique.
    code = F.shiftleft(F.least("crowd", F.lit(2**30)), 32).bitwiseOR(F.col("h").bitwiseAND(F.lit(0xFFFFFFFF)))
    met = group.join(sized(crowd), "key").groupBy("h").agg(F.sum("crowd").alias("crowd")).select("h", code.alias("code"))
    met = scratch.table(met, "met")
    coded = group.join(sized(met), "h")
    lead = scratch.table(coded.groupBy("key").agg(F.max("code").alias("top")), "leaders")
    members = scratch.table(coded.join(sized(lead), "key").filter("code <> top").drop("code"), "members")
    leader = sized(met.select(F.col("code").alias("top"), F.col("h").alias("first")))

    sizes = sized(classes.select(F.col("h1").alias("h"), "n", *_BITS))
    of = lambda x: sizes.select(*[F.col(c).alias(f"{c}{x}") for c in ("h", "n", *_BITS)])
    near = (
        (F.col("na") * 100 >= F.col("nb") * percent)
        & (F.col("nb") * 100 >= F.col("na") * percent)
        & (values_apart(*[[F.col(f"{c}{x}") for c in _BITS] for x in "ab"]) <= most_apart(percent))
    )
    close = lambda pairs: pairs.join(of("a"), "ha").join(of("b"), "hb").filter(near).select("ha", "hb")
    confirm = lambda pairs: _confirm(rows, classes, pairs, shingle, percent, broadcast_rows)

    def labels(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Components of documents, and of digests."""
        found = scratch.table(connected_components(links, broadcast_rows=broadcast_rows), "components")
        by_digest = classes.join(sized(found), F.col("rep") == F.col("node"), "left").select(F.col("h1").alias("h"), F.coalesce("component", "rep").alias("c"))
        return found, sized(scratch.table(by_digest, "labels"))

    def ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
        return pairs.select(F.least(x, y).alias("ha"), F.greatest(x, y).alias("hb")).filter("ha < hb").distinct()

    one = scratch.table(close(ordered(members.groupBy("h").agg(F.max("top").alias("top")).join(leader, "top"), "first", "h")), "one")
    links = confirm(one)

    # Rows that repeat an id make its sets one document.
    ids = known.groupBy("doc_id").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"), F.min("h2").alias("lo2"), F.max("h2").alias("hi2"))
    again = scratch.table(ids.filter("lo < hi OR lo2 < hi2").select("doc_id"), "again")
    if not again.isEmpty():
        sets = known.join(sized(again), "doc_id", "left_semi").join(classes.select("h1", "h2", "rep"), ["h1", "h2"])
        links = scratch.table(links.unionByName(sets.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))), "links")

    found, label = labels(links)
    leaders = sized(scratch.table(leader.join(label, F.col("first") == F.col("h")).select("top", "first", F.col("c").alias("cf")), "led"))
    astray = members.join(label, "h").join(leaders, "top").filter("c <> cf").select("first", "h").distinct()
    astray = scratch.table(close(ordered(astray, "first", "h").join(sized(one), ["ha", "hb"], "left_anti")), "astray")
    if not astray.isEmpty():
        links = scratch.table(links.unionByName(confirm(astray)), "links")
        found, label = labels(links)

    apart = scratch.table(members.join(label, "h").join(leader, "top").select("key", F.col("first").alias("hub"), "h", "c"), "members")
    mixed = scratch.table(apart.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("key"), "mixed")
    rest = scratch.table(apart.join(sized(mixed), "key", "left_semi").select("hub", "h", "c").distinct(), "rest")
    if not rest.isEmpty():
        needed = rest.select("h").unionByName(rest.select(F.col("hub").alias("h"))).distinct()
        across = _across(rest, _sets_of(rows, classes, needed, shingle, broadcast_rows), percent, block, broadcast_rows)
        if not across.isEmpty():
            stand = lambda x, to: sized(classes.select(F.col("h1").alias(x), F.col("rep").alias(to)))
            found, _ = labels(links.unionByName(across.join(stand("ha", "a"), "ha").join(stand("hb", "b"), "hb").select("a", "b")))

    final = classes.join(sized(found), F.col("rep") == F.col("node"), "left").select("h1", "h2", F.coalesce("component", "rep").alias("component_id"))
    part = known.select("doc_id", "n", "h1", "h2").join(sized(scratch.table(final, "final")), ["h1", "h2"]).select("doc_id", "n", "component_id")
    other = sketches.filter("doc_id IS NULL OR n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return part.unionByName(other).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The documents that stay, rows and columns as they are: one of each group of near-duplicates.

    Rows that share a kept id all stay, as they are one document.
    """
    marked = near_duplicates(docs, id_col, text_col, shingle, percent, broadcast_rows)
    gone = scratch.table(marked.filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return docs.join(scratch.sized(gone, broadcast_rows), docs[id_col].cast("long") == gone["_gone"], "left_anti")
