"""Web archives: writing records, and reading them back by verified boundaries.

Reading splits files at arbitrary bytes. Each task finds the version line that
starts a record wherever it occurs, real or quoted inside a payload, and for
each such candidate computes where its successor would start. Only the
candidates on the chain of successors from the start of the file are records:
the chain is followed by pointer jumping inside each split, then by doubling
across the splits of a file. A second scan, knowing where the chain enters each
split, reads the payloads; only records cut by a split's end are put together
from pieces. Where damage breaks the chain, what it has reached before stays, in
whatever way the file is split, and :func:`breaks` says where it ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from quern import scratch
from quern.llm.columns import long_id

MAGIC = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 100, file_records: int = 20_000, broadcast_groups: int = 200_000) -> None:
    """Write one record per row, as files under ``path``.

    * The payload is the column in UTF-8, null as empty, inside an HTTP response.
    * Of records with equal payloads of at least ``least_bytes`` that with the
      smallest id is a response and the others are revisits that refer to it;
      smaller payloads are always responses.
    * Rows that repeat an id are written each; those beside the first response
      of a payload, equal in id, are responses too. Null ids have no id line.
    * Line breaks and control characters in a URL are percent-encoded; a null
      URL has no target line.
    * The table of repeated payloads is sent to all tasks up to
      ``broadcast_groups`` rows, and joined by a shuffle beyond.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    url = F.regexp_replace(F.col(url_col).cast("string"), r"[\x00-\x20\x7f]", "%20")
    rows = pages.select(long_id(pages, id_col).alias("id"), url.alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload"))
    narrow = rows.filter(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = scratch.table(narrow.filter("n > 1").select(F.col("digest").alias("d"), "first"), "payloads")
    if repeated.count() <= broadcast_groups:
        repeated = F.broadcast(repeated)
    rows = rows.join(repeated, (F.col("digest") == F.col("d")) & (F.col("bytes") >= least_bytes), "left")
    is_revisit = F.coalesce(F.col("first") != F.col("id"), F.col("first").isNotNull())
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    http = F.concat(F.lit(HTTP), line("Content-Length", F.col("bytes").cast("string")), F.lit("\r\n"))
    body = F.when(is_revisit, http).otherwise(F.concat(http, F.col("payload")))
    record = F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(is_revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), F.md5(F.concat_ws(":", F.lit("page"), F.col("id").cast("string"), "digest")), F.lit(">"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Page-ID", F.col("id").cast("string")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("WARC-Refers-To-Page-ID", F.when(is_revisit, F.col("first").cast("string"))),
        line("WARC-Profile", F.when(is_revisit, F.lit(PROFILE))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
        body,
    )
    rows.select(record.alias("value")).write.option("lineSep", END.decode()).option("maxRecordsPerFile", file_records).text(path)


def header(chunk: bytes) -> tuple[dict[bytes, bytes], int]:
    """Fields of the record whose version line precedes ``chunk``, by lower-case name, and the header's length; none if it has no end."""
    end = chunk.find(END)
    if end < 0:
        return {}, 0
    fields = {}
    for row in chunk[:end].split(b"\r\n"):
        name, _, value = row.partition(b":")
        fields[name.strip().lower()] = value.strip()
    return fields, end + len(END)


def successor(chunk: bytes) -> int:
    """Bytes from a candidate's version line to its successor's, 0 if its header is no record's."""
    fields, length = header(chunk)
    size = fields.get(b"content-length", b"")
    return len(MAGIC) + length + int(size) + len(END) if size.isdigit() and len(size) < 16 and b"warc-type" in fields else 0


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """What follows each version line, in file order within each split."""
    lines = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("chunk"))


def _runs(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[tuple, Iterator[bytes]]]:
    """The chunks of each split that a task reads; ``n`` leading columns tell splits apart."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            keys = list(zip(*[batch.column(k).to_pylist() for k in range(n)], strict=True))
            chunks = batch.column(n)
            for k, key in enumerate(keys):
                yield key, chunks[k].as_py()

    it = rows()
    ahead = next(it, None)
    while ahead is not None:
        key = ahead[0]

        def own(key=key) -> Iterator[bytes]:
            nonlocal ahead
            while ahead is not None and ahead[0] == key:
                yield ahead[1]
                ahead = next(it, None)

        yield key, own()


def ends(offset: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The end of the last record on the chain from each candidate of a split, by pointer jumping."""
    n = len(offset)
    slot = np.searchsorted(offset, to)
    known = (slot < n) & (offset[np.minimum(slot, n - 1)] == to)
    jump = np.where(known, slot, np.arange(n))  # a chain's last candidate points to itself
    while not np.array_equal(further := jump[jump], jump):
        jump = further
    return to[jump]


def exits(offset: np.ndarray, to: np.ndarray, size: int) -> np.ndarray:
    """Where the chain from each candidate leaves a split of ``size`` bytes; -1 where it breaks inside."""
    last = ends(offset, to)
    return np.where(last >= size, last, -1)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of each split, by offset from the split's first chunk, with the end of the chain in the split."""
    for (file, split), chunks in _runs(batches, 2):
        at, offset, to = 0, [], []
        for k, chunk in enumerate(chunks):
            # The file's first chunk is what comes before its first version line.
            if (k or split) and (step := successor(chunk)):
                offset.append(at - len(MAGIC))
                to.append(at - len(MAGIC) + step)
            at += len(chunk) + len(MAGIC)
        own, far = np.array(offset, dtype=np.int64), np.array(to, dtype=np.int64)
        last = ends(own, far) if len(own) else own
        out = (exits(own, far, at - len(MAGIC)) if len(own) else own) >= 0
        n = len(own) + 1
        yield pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array([split] * n, pa.int64()), pa.array([*own.tolist(), None], pa.int64()), pa.array([*last.tolist(), at], pa.int64()), pa.array([*out.tolist(), False])], names=["file", "split", "offset", "exit", "out"])


def entries(spark: SparkSession, path: str) -> DataFrame:
    """Where the chain from a file's start enters each of its splits: ``file, split, base, end, entry, leaves``.

    ``base`` is the file offset of the split's first chunk, ``end`` that of the next
    split's; ``entry`` that of the first record to start in the split or, where none
    does, the end of the last one before it; -1 in a file that starts with none.
    ``leaves`` is where the chain leaves the split or breaks in it. It takes log2 of
    a file's splits rounds; files of one split take none.
    """
    found = scratch.table(_chunks(spark, path).mapInArrow(_scan, "file string, split long, offset long, exit long, out boolean"), "candidates")
    by_split = Window.partitionBy("file").orderBy("split")
    base = F.coalesce(F.sum("exit").over(by_split.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = found.filter("offset IS NULL").withColumn("base", base).withColumn("end", F.col("base") + F.col("exit"))
    own = splits.select("file", "split", "base")
    nodes = found.filter("offset IS NOT NULL").join(own, ["file", "split"]).select("file", "split", (F.col("base") + F.col("offset")).alias("at"), (F.col("base") + F.col("exit")).alias("to"), "out")
    most = splits.groupBy("file").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    reached = own.filter("base = 0").select("file", F.lit(0).cast("long").alias("at")).distinct()
    jump = nodes.filter("out").select(F.col("file").alias("f"), F.col("at").alias("start"), F.col("to").alias("next"))
    steps = 1
    while steps < most:
        met = reached.join(jump, (F.col("file") == F.col("f")) & (F.col("at") == F.col("start"))).select("file", F.col("next").alias("at"))
        reached = scratch.table(reached.unionByName(met).distinct(), "reached")
        steps *= 2
        if steps < most:
            ahead = jump.select(F.col("f").alias("g"), F.col("start").alias("mid"), F.col("next").alias("far"))
            jump = scratch.table(jump.join(ahead, (F.col("f") == F.col("g")) & (F.col("next") == F.col("mid"))).select("f", "start", F.col("far").alias("next")), "jumps")
    first = nodes.join(reached, ["file", "at"]).groupBy("file", "split").agg(F.min("at").alias("entry"), F.min_by("to", "at").alias("leaves"))
    before = F.last("leaves", ignorenulls=True).over(by_split.rowsBetween(Window.unboundedPreceding, -1))
    return splits.join(first, ["file", "split"], "left").select("file", "split", "base", "end", F.coalesce("entry", before, F.lit(-1)).alias("entry"), "leaves")


def breaks(spark: SparkSession, path: str) -> DataFrame:
    """Files whose chain of records does not end where they end: ``file, reached, bytes``.

    ``reached`` is the end of the last record that the chain reaches, null if the
    file starts with none: less than ``bytes`` where damage or anything else
    follows it, more where that record is cut short.
    """
    whole = entries(spark, path).groupBy("file").agg(F.max("leaves").alias("reached"), (F.max("end") - len(MAGIC)).alias("bytes"))
    return whole.filter((F.col("bytes") > 0) & ~F.col("reached").eqNullSafe(F.col("bytes")))


def parse(record: bytes) -> tuple[str, int | None, str | None, bytes, str, int | None, bool]:
    """Type, page id, target, payload, payload digest, the id referred to, and whether the block is whole, of what follows a version line."""
    fields, length = header(record)
    block = record[length : length + int(fields[b"content-length"])]
    payload = block.partition(END)[2] if fields.get(b"content-type", b"").startswith(b"application/http") else block
    kind = fields[b"warc-type"].decode("utf-8", "replace")
    number = lambda k: int(fields[k]) if fields.get(k, b"").removeprefix(b"-").isdigit() else None
    target = fields.get(b"warc-target-uri")
    digest = fields.get(b"warc-payload-digest", b"").decode("utf-8", "replace").removeprefix("sha256:") if kind == "revisit" else hashlib.sha256(payload).hexdigest()
    whole = len(block) == int(fields[b"content-length"])
    return kind, number(b"warc-page-id"), target and target.decode("utf-8", "replace"), payload, digest, number(b"warc-refers-to-page-id"), whole


RECORD = "file string, offset long, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary, whole boolean, tail long, part long, raw binary"
_TYPES = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
_NAMES = [x.split()[0] for x in RECORD.split(", ")]
#: The columns that make a record.
_OWN = 10


def _row(file: str, offset: int, record: bytes, payloads: bool) -> tuple:
    kind, page, target, payload, digest, refers, whole = parse(record)
    return (file, offset, kind, page, target, len(payload), digest, refers, payload if payloads else None, whole, None, None, None)


def _records(batches: Iterator[pa.RecordBatch], payloads: bool, flush: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The records of each split. Pieces of one cut by a split's end come raw, with its file and end."""
    out: list[tuple] = []
    held = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=_NAMES)

    for (file, split, base, entry), chunks in _runs(batches, 4):
        at, want, start, end, record = base, entry, 0, -1, []
        piece = lambda offset, upto, raw: (file, offset, *[None] * (_OWN - 2), upto, at if offset is None else offset, raw)  # noqa: E731, B023
        for k, chunk in enumerate(chunks):
            mark = at - len(MAGIC)
            if k == 0 and split == 0:
                pass
            elif record:
                record += [MAGIC, chunk]
            elif mark == want:
                # Where the chain breaks, a version line may stand that starts no record.
                if step := successor(chunk):
                    start, end, record = mark, mark + step, [chunk]
                    want = end
            elif mark < want:
                out.append(piece(None, want, chunk))
                held += len(chunk)
            at += len(chunk) + len(MAGIC)
            if record and at - len(MAGIC) >= end:
                out.append(_row(file, start, b"".join(record), payloads))
                held += 500 + payloads * (end - start)
                record = []
            if held > flush:
                yield batch()
                out, held = [], 0
        if record:
            out.append(piece(start, end, b"".join(record)))
            held += end - start
    if out:
        yield batch()


def read(spark: SparkSession, path: str, payloads: bool = False, broadcast_splits: int = 200_000) -> DataFrame:
    """The records of the archives under ``path``, one row each.

    Returns ``file, offset, record_type, page_id, url, payload_bytes,
    payload_digest, refers_to, payload, whole``; the payload is null unless asked for.

    * A revisit's payload is empty and its digest is the one its header states.
    * Whatever the chain of records does not reach, be it a version line inside a
      payload or what follows damage, is not a record. What it reaches before
      damage is, and so is a last record that the file's end cuts after its
      header: its payload is what is there, and ``whole`` is false.
    * Ids that are no numbers are null. Empty files and folders have no records.
    * Splits' entries are sent to all tasks up to ``broadcast_splits``, and joined
      by a shuffle beyond.
    """
    table = scratch.table(entries(spark, path).select(F.col("file").alias("f"), F.col("split").alias("s"), "base", "entry"), "entries")
    chunks = _chunks(spark, path)
    on = (F.col("file") == F.col("f")) & (F.col("split") == F.col("s"))
    if table.count() <= broadcast_splits:
        placed = chunks.join(F.broadcast(table), on).select("file", "split", "base", "entry", "chunk")
    else:
        placed = chunks.withColumn("n", F.monotonically_increasing_id()).join(table, on).repartition("file", "split").sortWithinPartitions("file", "split", "n").select("file", "split", "base", "entry", "chunk")
    found = scratch.table(placed.mapInArrow(lambda b: _records(b, payloads), RECORD), "records")

    def join(pieces):  # noqa: ANN001, ANN202
        import pandas as pd

        pieces = pieces.sort_values("part")
        if pd.isna(pieces["offset"].iloc[0]):
            return pd.DataFrame(columns=_NAMES[:_OWN])
        return pd.DataFrame([_row(pieces["file"].iloc[0], int(pieces["offset"].iloc[0]), MAGIC.join(map(bytes, pieces["raw"])), payloads)[:_OWN]], columns=_NAMES[:_OWN])

    single = found.filter("raw IS NULL").select(*_NAMES[:_OWN])
    cut = found.filter("raw IS NOT NULL").groupBy("file", "tail").applyInPandas(join, ", ".join(RECORD.split(", ")[:_OWN]))
    return single.unionByName(cut)


def resolve(records: DataFrame) -> DataFrame:
    """One row per page: ``page_id, payload_bytes, payload_digest, record_type, refers_to``, revisits with the size of the payload they refer to."""
    heads = records.filter("record_type = 'response'").select(F.col("page_id").alias("r"), F.col("payload_digest").alias("g"), F.col("payload_bytes").alias("n")).distinct()
    on = (F.col("record_type") == "revisit") & (F.col("refers_to") == F.col("r")) & (F.col("payload_digest") == F.col("g"))
    return records.join(heads, on, "left").select("page_id", F.when(F.col("record_type") == "revisit", F.col("n")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
