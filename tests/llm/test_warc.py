import hashlib

import numpy as np

from quern import scratch
from quern.llm import queries, warc

SCHEMA = "page_id long, url string, html string, id long, digest string, first long, payload string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "d", 2, "p") for r in rows], SCHEMA)


def small_splits(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")


def fake(body, kind="response"):
    return f"\r\n\r\nWARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Page-ID: 999\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"


def brute(data):
    """The records of an archive, one after the other from its start."""
    at, out = 0, []
    while at < len(data):
        chunk = data[at + len(warc.MAGIC) :]
        out.append((at, warc.parse(chunk)))
        at += warc.successor(chunk)
    return out


HARD = [
    (1, "http://a/1", "plain " * 40),
    (2, None, None),
    (3, "http://a/ b\r\nWARC/1.1\r\n", ""),
    (4, "http://a/4", "WARC/1.1\r\n" * 50),
    (5, "http://a/5", "x" * 300 + fake("HTTP/1.1 200 OK\r\n\r\nnot a page") * 20 + "y" * 300),
    (6, "http://a/6", "plain " * 40),
    (7, "http://a/7", "short"),
    (8, "http://a/8", "short"),
    (9, "http://a/9", fake("z" * 5000) + "WARC/1.1\r\n"),
    (10, "http://a/10", "né☃" * 200),
    (11, "http://a/11", "long " * 100_000 + fake("deep") + "long " * 1000),
    (12, "http://a/12", fake("z" * 5000) + "WARC/1.1\r\n"),
]


def test_magic_in_payloads_at_every_split(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    path = scratch.folder(spark, "warc")
    warc.write(pages(spark, HARD).coalesce(1), path)
    try:
        for size in (7_001, 50_000, 1 << 30):
            small_splits(spark, size)
            rows = {r.page_id: r for r in warc.read(spark, path, payloads=True).collect()}
            assert rows.keys() == {r[0] for r in HARD}
            for i, url, html in HARD:
                text = (html or "").encode()
                if i in (6, 12):
                    assert rows[i].record_type == "revisit" and rows[i].refers_to == {6: 1, 12: 9}[i]
                    assert rows[i].payload_digest == hashlib.sha256(text).hexdigest()
                else:
                    assert rows[i].record_type == "response" and bytes(rows[i].payload) == text
                    assert (rows[i].payload_bytes, rows[i].payload_digest) == (len(text), hashlib.sha256(text).hexdigest())
            assert rows[3].url == "http://a/%20b%20%20WARC/1.1%20%20" and rows[2].url is None
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_files_are_archives(spark):
    path = scratch.folder(spark, "warc")
    warc.write(pages(spark, HARD).repartition(3), path, file_records=2)
    files = [bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect()]
    assert len(files) > 3
    ids = [rec[1] for f in files for _, rec in brute(f)]
    assert sorted(ids) == [r[0] for r in HARD]
    assert {r.page_id for r in warc.read(spark, path).collect()} == set(ids)


def test_damage_ends_a_chain(spark):
    path = scratch.folder(spark, "warc")
    good = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Page-ID: {}\r\nContent-Type: text/html\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    bad = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: what\r\n\r\nok\r\n\r\n"
    spark.createDataFrame([(good.format(1) + good.format(2) + bad + good.format(3),)], "value string").coalesce(1).write.option("lineSep", "\n").text(path)
    assert {r.page_id for r in warc.read(spark, path).collect()} == {1, 2}


def test_exits_follow_chains():
    offset = np.array([0, 10, 20, 30, 40])
    to = np.array([20, 15, 40, 99, 70])  # 0 -> 20 -> 40 -> out; 10 -> nowhere; 30 -> out
    assert warc.exits(offset, to, 60).tolist() == [70, -1, 70, 99, 70]


def test_repeats_nulls_and_both_joins(spark):
    rows = [(1, "u", "p" * 200), (1, "u", "p" * 200), (2, "u", "p" * 200), (None, "u", "p" * 200), (None, None, None), (3, "u", "q" * 99), (4, "u", "q" * 99)]
    for most in (200_000, 0):
        path = scratch.folder(spark, "warc")
        warc.write(pages(spark, rows), path, broadcast_groups=most)
        got = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in warc.resolve(warc.read(spark, path, broadcast_splits=most)).collect())
        assert got == sorted([("1", 200, "response", None), ("1", 200, "response", None), ("2", 200, "revisit", 1), ("None", 200, "revisit", 1), ("None", 0, "response", None), ("3", 99, "response", None), ("4", 99, "response", None)])


def test_empty_table(spark):
    path = scratch.folder(spark, "warc")
    warc.write(pages(spark, []), path)
    assert warc.resolve(warc.read(spark, path)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    want, first = {}, {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").orderBy("page_id").collect():
        b = (r.html or "").encode()
        d = hashlib.sha256(b).hexdigest()
        f = first.setdefault(d, r.page_id)
        again = len(b) >= 100 and f != r.page_id
        want[r.page_id] = (len(b), d, "revisit" if again else "response", f if again else None)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in queries.op9_warc(spark, sf).collect()}
    assert got == want


def record(page, size=2, length=None, kind="response"):
    body = "x" * size
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Page-ID: {page}\r\nContent-Type: text/html\r\nContent-Length: {size if length is None else length}\r\n\r\n{body}\r\n\r\n"


GOOD = "".join(record(k, 30 * k) for k in range(1, 7))
DAMAGED = {
    # an archive, the pages that it holds, those that are cut short, and how many bytes the chain reaches
    "undamaged": (GOOD, [1, 2, 3, 4, 5, 6], [], None),
    "bad length": (GOOD + record(0, 40, "what") + record(8), [1, 2, 3, 4, 5, 6], [], len(GOOD)),
    "length without end": (GOOD + record(0, 40, "9" * 30) + record(8), [1, 2, 3, 4, 5, 6], [], len(GOOD)),
    "line feed behind": (GOOD + "\n", [1, 2, 3, 4, 5, 6], [], len(GOOD)),
    "words behind": (GOOD + "what is this " * 60, [1, 2, 3, 4, 5, 6], [], len(GOOD)),
    "cut in a header": (GOOD + record(7)[:40], [1, 2, 3, 4, 5, 6], [], len(GOOD)),
    "cut in a body": (GOOD + record(7, 900)[:-400], [1, 2, 3, 4, 5, 6, 7], [7], len(GOOD) + len(record(7, 900))),
    "no page number": (record("seven") + record(2), [None, 2], [], None),
    "too long a record": (record(1) + record(2, 10, 3000) + GOOD, [1, 2], [2], len(record(1)) + len(record(2, 10, 3000)) + 2990),
    "no record first": ("junk" + GOOD, [], [], -1),
}


def test_what_the_chain_reaches_stays_at_every_split_size(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    path = scratch.folder(spark, "warc")
    for name, (text, *_) in DAMAGED.items():
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("lineSep", "\n").text(f"{path}/case={name.replace(' ', '_')}")
        # Spark ends its only line with a line feed, which is cut off again.
        fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        (part,) = [f.getPath() for f in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/case={name.replace(' ', '_')}")) if f.getPath().getName().startswith("part")]
        out = fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
    try:
        for size in (211, 1 << 30):
            small_splits(spark, size)
            rows = warc.read(spark, path).collect()
            broken = {r.file: (r.reached, r.bytes) for r in warc.breaks(spark, path).collect()}
            for name, (text, pages_there, short, reached) in DAMAGED.items():
                own = [r for r in rows if f"case={name.replace(' ', '_')}/" in r.file]
                assert sorted(str(r.page_id) for r in own) == sorted(map(str, pages_there)), (name, size)
                assert [r.page_id for r in own if not r.whole] == short, (name, size)
                told = [v for f, v in broken.items() if f"case={name.replace(' ', '_')}/" in f]
                assert told == ([] if reached is None else [(None if reached < 0 else reached, len(text))]), (name, size)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
