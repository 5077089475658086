"""Read-processing queries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import sequence as S
from quern.operators import reads as R
from quern.plans import adapters as A


def quality_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.reads(spark, sf_dir).select("read_id", S.quality_sum(F.col("qual")).alias("qsum"))


def trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.trim(A.reads(spark, sf_dir), 0.5).select("read_id", F.col("trim_len").cast("long").alias("trim_len"), F.md5("seq").alias("seq_md5"))


def trim_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.trim(A.reads(spark, sf_dir), 0.5, fixed_len=12).select("read_id", F.col("trim_len").cast("long").alias("trim_len"), "seq", "qual")


def trim_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.trim(A.reads(spark, sf_dir), 0.9, color=True).select("read_id", F.col("trim_len").cast("long").alias("trim_len"), F.md5("seq").alias("seq_md5"))


def keep_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.split_pairs(R.keep_reads(A.reads(spark, sf_dir), min_len=100, entropy=1.5)).select("read_id", "pair_id", "mate", "part")


def entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.reads(spark, sf_dir).select("read_id", F.round(S.dinucleotide_entropy(F.col("seq")), 6).alias("bits"))


def reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.reads(spark, sf_dir).select("read_id", F.md5(S.reverse_complement(F.col("seq"))).alias("rc_md5"), F.round(S.gc_fraction(F.col("seq")), 9).alias("gc"))


def pair_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = R.keep_reads(A.reads(spark, sf_dir), min_len=1000)
    return R.split_pairs(kept).select("pair_id", "mate", "part")


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.summary(R.split_pairs(R.keep_reads(A.reads(spark, sf_dir), min_len=500)))


def mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.interleave_mates(A.reads(spark, sf_dir), reverse=True).select("pair_id", "mate", F.md5("seq").alias("seq_md5"), F.md5("qual").alias("qual_md5"))


def pack_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.reads(spark, sf_dir).select("read_id", S.pack_prefix(F.col("seq"), 16).alias("packed"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = A.reads(spark, sf_dir)
    side = lambda k: own.filter(F.col("mate") == k).select("pair_id", F.col("seq").alias(f"seq{k}"), F.col("qual").alias(f"qual{k}"))
    return side(1).join(side(2), "pair_id")


def dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.drop_duplicate_pairs(_pairs(spark, sf_dir)).select("pair_id")


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sample(A.reads(spark, sf_dir), 0.1).select("pair_id", "mate")


def synchronise(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = A.reads(spark, sf_dir)
    first, second = own.filter(F.char_length("seq") > 800), own.filter(F.char_length("seq") < 2000)
    return R.synchronise(first, second).select("read_id", "part")


def diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = A.reads(spark, sf_dir).select("read_id", "seq")
    return R.diff_reads(own, own.withColumn("seq", F.translate("seq", "N", "A"))).select("read_id", "changed")


def colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.concat(F.translate(F.col("o_orderkey").cast("string"), "456789", "0123.."), F.lit(".0123"))
    rows = A.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("read_id"), digits.alias("c"))
    return rows.select("read_id", S.to_letters(F.col("c")).alias("letters"), S.to_colors(S.to_letters(F.col("c"))).alias("colors"))


def decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.translate(F.col("o_orderkey").cast("string"), "456789", "012301")
    return A.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("read_id"), S.decode_colors(digits, F.lit("T")).alias("seq"))


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.read(spark, sf_dir, "documents").select("doc_id", F.md5(S.clean_bases(F.col("text"))).alias("seq_md5"))


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.sources.fastq import parse_header

    c = A.read(spark, sf_dir, "customer")
    primer = F.when(F.col("c_custkey") % 3 == 0, "T2+").otherwise("")
    length = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.col("c_nationkey").cast("string"), F.lit("|"))).otherwise("")
    mate = F.when(F.col("c_custkey") % 5 == 0, "/2").when(F.col("c_custkey") % 5 == 1, "/1").otherwise("")
    header = F.concat(F.lit("@"), primer, length, F.lit("lib:"), F.col("c_custkey").cast("string"), mate)
    return c.select("c_custkey", *[v.alias(k) for k, v in parse_header(header).items()])


def reject_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = A.reads(spark, sf_dir).withColumn("prefix", F.substring("seq", 1, 3))
    return R.reject_rate(own, own.filter(F.char_length("seq") < 1000)).select("prefix", "total", "rejected", F.round("rate", 9).alias("rate"))


_COST = f"CASE WHEN c = '!' THEN 1000000000000000 ELSE CAST(round(-ln(1 - pow(10, -(ascii(c) - 33) / 10.0)) * {S.COST_UNIT}) AS BIGINT) END"
_BUDGET = round(-math.log(0.5) * S.COST_UNIT)

_TRIMMED = f"""p AS (SELECT read_id, unnest(string_split(qual, '')) AS c, generate_subscripts(string_split(qual, ''), 1) AS i FROM reads),
s AS (SELECT read_id, sum({_COST}) OVER (PARTITION BY read_id ORDER BY i) AS cum FROM p),
t AS (SELECT read_id, count(*) AS n FROM s WHERE cum <= {_BUDGET} GROUP BY read_id)"""
_COLOR_BUDGET = round(-math.log(0.9) * S.COST_UNIT)
_ENTROPY = f"""p AS (SELECT read_id, length(seq) AS n, unnest(list_transform(range(1, length(seq)), lambda i: seq[i:i+1])) AS d FROM reads),
c AS (SELECT read_id, n, d, count(*) AS k FROM p GROUP BY read_id, n, d),
l AS (SELECT read_id, n - coalesce(sum(k) FILTER (contains(d, 'N')), 0) AS l FROM c GROUP BY read_id, n),
e AS (SELECT read_id, sum(k * log2(CAST(l AS DOUBLE) / k)) AS b FROM c JOIN l USING (read_id) WHERE NOT contains(d, 'N') GROUP BY read_id)"""

QUERIES = {
    "reads_quality_sum": quality_sum,
    "reads_trim": trim,
    "reads_trim_fixed": trim_fixed,
    "reads_trim_colors": trim_colors,
    "reads_keep_entropy": keep_entropy,
    "reads_entropy": entropy,
    "reads_reverse_complement": reverse_complement,
    "reads_pair_split": pair_split,
    "reads_summary": summary,
    "reads_mates": mates,
    "reads_pack_prefix": pack_prefix,
    "reads_dedup": dedup,
    "reads_sample": sample,
    "reads_synchronise": synchronise,
    "reads_diff": diff,
    "reads_colors": colors,
    "reads_decode_colors": decode,
    "reads_headers": headers,
    "reads_clean_bases": clean,
    "reads_reject_rate": reject_rate,
}

ORACLES = {
    "reads_quality_sum": f"WITH {A.READS} SELECT read_id, CAST(coalesce(list_sum(list_transform(string_split(qual, ''), lambda c: ascii(c) - 33)), 0) AS BIGINT) AS qsum FROM reads",
    "reads_trim": f"""WITH {A.READS}, {_TRIMMED}
SELECT read_id, coalesce(n, 0) AS trim_len, md5(substring(seq, 1, coalesce(n, 0))) AS seq_md5 FROM reads LEFT JOIN t USING (read_id)""",
    "reads_entropy": f"""WITH {A.READS}, {_ENTROPY}
SELECT read_id, round(CASE WHEN length(seq) > 0 THEN coalesce(b, 0) / length(seq) END, 6) AS bits FROM reads LEFT JOIN e USING (read_id)""",
    "reads_trim_fixed": f"""WITH {A.READS}, {_TRIMMED}
SELECT read_id, CAST(12 AS BIGINT) AS trim_len, substring(seq, 1, 12) AS seq, substring(qual, 1, 12) AS qual FROM reads JOIN t USING (read_id) WHERE n >= 12""",
    "reads_trim_colors": f"""WITH {A.READS},
p AS (SELECT read_id, unnest(string_split(qual, '')) AS c, generate_subscripts(string_split(qual, ''), 1) AS i FROM reads),
q AS (SELECT read_id, i, pow(10, -(ascii(c) - 33) / 10.0) * coalesce(pow(10, -(ascii(lag(c) OVER (PARTITION BY read_id ORDER BY i)) - 33) / 10.0), 1) AS err FROM p),
s AS (SELECT read_id, sum(CASE WHEN err < 1 THEN CAST(round(-ln(1 - err) * {S.COST_UNIT}) AS BIGINT) ELSE 1000000000000000 END) OVER (PARTITION BY read_id ORDER BY i) AS cum FROM q),
t AS (SELECT read_id, count(*) AS n FROM s WHERE cum <= {_COLOR_BUDGET} GROUP BY read_id)
SELECT read_id, coalesce(n, 0) AS trim_len, md5(substring(seq, 1, coalesce(n, 0))) AS seq_md5 FROM reads LEFT JOIN t USING (read_id)""",
    "reads_keep_entropy": f"""WITH {A.READS}, {_ENTROPY},
k AS (SELECT read_id, pair_id, mate FROM reads LEFT JOIN e USING (read_id) WHERE length(seq) >= 100 AND coalesce(b, 0) / length(seq) >= 1.5)
SELECT read_id, pair_id, mate, CASE WHEN count(*) OVER (PARTITION BY pair_id) >= 2 THEN 'read' || mate ELSE 'single' END AS part FROM k""",
    "reads_reverse_complement": f"""WITH {A.READS}
SELECT read_id, md5(reverse(translate(seq, 'ACGTN', 'TGCAN'))) AS rc_md5,
       round(CASE WHEN length(regexp_replace(seq, '[^ACGT]', '', 'g')) > 0 THEN CAST(length(regexp_replace(seq, '[^GC]', '', 'g')) AS DOUBLE) / length(regexp_replace(seq, '[^ACGT]', '', 'g')) END, 9) AS gc FROM reads""",
    "reads_pair_split": f"""WITH {A.READS}
SELECT pair_id, mate, CASE WHEN count(*) OVER (PARTITION BY pair_id) >= 2 THEN 'read' || mate ELSE 'single' END AS part FROM reads WHERE length(seq) >= 1000""",
    "reads_summary": f"""WITH {A.READS},
k AS (SELECT seq, CASE WHEN count(*) OVER (PARTITION BY pair_id) >= 2 THEN 'read' || mate ELSE 'single' END AS part FROM reads WHERE length(seq) >= 500)
SELECT part, count(*) AS reads, CAST(sum(length(seq)) AS BIGINT) AS bases FROM k GROUP BY part""",
    "reads_mates": f"""WITH {A.READS}, k AS (SELECT *, count(*) OVER (PARTITION BY pair_id) AS n FROM reads)
SELECT pair_id, mate, md5(CASE WHEN mate = 2 THEN reverse(translate(seq, 'ACGTN', 'TGCAN')) ELSE seq END) AS seq_md5,
       md5(CASE WHEN mate = 2 THEN reverse(qual) ELSE qual END) AS qual_md5 FROM k WHERE n >= 2""",
    "reads_pack_prefix": f"""WITH {A.READS}, c AS (SELECT read_id, translate(rpad(substring(seq, 1, 16), 16, 'A'), 'ACGTN', '01230') AS d FROM reads)
SELECT read_id, CAST(list_sum(list_transform(range(16), lambda i: CAST(d[i+1] AS BIGINT) * (CAST(1 AS BIGINT) << CAST(2*i AS BIGINT)))) AS BIGINT) AS packed FROM c""",
    "reads_dedup": f"""WITH RECURSIVE {A.READS},
p AS (SELECT a.pair_id, translate(rpad(substring(a.seq, 1, 14), 14, 'A'), 'N', 'A') AS p1, translate(rpad(substring(b.seq, 1, 14), 14, 'A'), 'N', 'A') AS p2,
  list_sum(list_transform(string_split(a.qual || b.qual, ''), lambda c: ascii(c) - 33)) AS q
  FROM reads a JOIN reads b ON a.pair_id = b.pair_id AND a.mate = 1 AND b.mate = 2),
e AS (SELECT x.pair_id AS a, y.pair_id AS b FROM p x JOIN p y ON x.pair_id <> y.pair_id
  AND ((hamming(x.p1, y.p1) <= 1 AND hamming(x.p2, y.p2) <= 3) OR (hamming(x.p2, y.p2) <= 1 AND hamming(x.p1, y.p1) <= 3))),
r AS (SELECT pair_id AS node, pair_id AS seen FROM p UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a),
c AS (SELECT node, min(seen) AS component FROM r GROUP BY node)
SELECT pair_id FROM (SELECT pair_id, row_number() OVER (PARTITION BY component ORDER BY q DESC, pair_id) AS k FROM p JOIN c ON pair_id = node) WHERE k = 1""",
    "reads_sample": f"WITH {A.READS} SELECT pair_id, mate FROM reads WHERE CAST('0x' || left(md5('12345:' || pair_id), 8) AS BIGINT) < {round(0.1 * 2**32)}",
    "reads_synchronise": f"""WITH {A.READS}
SELECT read_id, CASE WHEN length(seq) > 800 AND length(seq) < 2000 THEN 'pair' WHEN length(seq) > 800 THEN 'single1' ELSE 'single2' END AS part FROM reads""",
    "reads_diff": f"WITH {A.READS} SELECT read_id, length(regexp_replace(seq, '[^N]', '', 'g')) AS changed FROM reads WHERE contains(seq, 'N')",
    "reads_colors": """WITH c AS (SELECT o_orderkey AS read_id, translate(CAST(o_orderkey AS VARCHAR), '456789', '0123..') || '.0123' AS c FROM orders)
SELECT read_id, translate(c, '0123.', 'ACGTN') AS letters, c AS colors FROM c""",
    "reads_clean_bases": "SELECT doc_id, md5(regexp_replace(translate(text, 'acgtn', 'ACGTN'), '[^ACGT]', 'N', 'g')) AS seq_md5 FROM documents",
    "reads_headers": """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'T2' END AS primer, CAST(CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END AS INTEGER) AS trim_len,
  'lib' AS prefix, CAST(c_custkey AS VARCHAR) AS read_id, CAST(CASE c_custkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 END AS INTEGER) AS mate FROM customer""",
    "reads_reject_rate": f"""WITH {A.READS}
SELECT substring(seq, 1, 3) AS prefix, count(*) AS total, count(*) FILTER (length(seq) < 1000) AS rejected,
       round(CAST(count(*) FILTER (length(seq) < 1000) AS DOUBLE) / count(*), 9) AS rate FROM reads GROUP BY 1""",
}
