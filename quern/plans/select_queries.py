"""Reference-selection and coverage queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import coverage as C
from quern.operators import select as R
from quern.plans import adapters as A
from quern.plans.flagship import BITS_SQL

READ_LEN = 50


def best_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.best_hits(A.hits(spark, sf_dir))


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.maps(A.hits(spark, sf_dir))


def read_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.read_bits(maps(spark, sf_dir)).select("read_id", "seq_count", F.round("bits", 9).alias("bits"))


def ref_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = R.ref_bits(maps(spark, sf_dir), A.catalog(spark, sf_dir))
    return scored.select("seq_id", "rd_cnt", F.round("total_bits", 6).alias("total_bits"), F.round("bits", 9).alias("bits"))


def threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.threshold(ref_bits(spark, sf_dir), fraction=0.5).select("seq_id", "bits")


def second_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.second_tier(A.hits(spark, sf_dir)).select("read_id", "seq_id", "ed", "pos", "strand", "mate", F.col("tier").cast("long").alias("tier"))


def limit_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.limit_hits(A.hits(spark, sf_dir), 4)


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.read(spark, sf_dir, "part").filter("p_size <= 10").select(F.col("p_partkey").alias("seq_id"))


def excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.exclude(A.hits(spark, sf_dir), _listed(spark, sf_dir))


def included(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.exclude(A.hits(spark, sf_dir), _listed(spark, sf_dir), invert=True)


def with_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_catalog(A.hits(spark, sf_dir), A.catalog(spark, sf_dir)).select("read_id", "seq_id", "pos", "ed", "strand", "mate", "seq_len", "parent_id")


def split_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.split_references(A.catalog(spark, sf_dir), 300)


def strands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.separate_strands(A.hits(spark, sf_dir)).groupBy("seq_id").agg(F.count(F.lit(1)).alias("hits"))


def shared_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.shared_edges(maps(spark, sf_dir), min_bits=15.0).select("seq1", "seq2", "num", F.round("bits", 6).alias("bits"))


def _mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = A.hits(spark, sf_dir)
    return hits.groupBy(F.col("read_id").alias("pair_id"), "mate", "seq_id").agg(F.min(F.col("pos") * F.col("strand")).alias("pos"), F.count(F.lit(1)).alias("map_count")).withColumn("bits", F.col("map_count").cast("double"))


MATES = """mates AS (
  SELECT read_id AS pair_id, mate, seq_id, min(pos * strand) AS pos, count(*) AS map_count, CAST(count(*) AS DOUBLE) AS bits
  FROM hits GROUP BY read_id, mate, seq_id)"""


def mate_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.mate_edges(_mates(spark, sf_dir), min_count=1).select("kind", "n1", "n2", "num", "bits", F.round("p1", 6).alias("p1"), F.round("p2", 6).alias("p2"))


def mate_edges_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.mate_edges(_mates(spark, sf_dir), min_count=1, strict=True).groupBy("kind").agg(F.count(F.lit(1)).alias("edges"), F.sum("num").alias("num"))


def insert_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Whole orders stand for a reference here, so that many pairs fall on one.
    hits = A.hits(spark, sf_dir).withColumn("pair_id", F.col("seq_id")).withColumn("ref", F.col("read_id") % 50)
    rows = hits.groupBy("pair_id", "mate", F.col("ref").alias("seq_id")).agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("map_count"))
    found = R.insert_sizes(rows)
    return found.select("seq_id", "mp_pairs", F.round("mp_ins_mean", 6).alias("mp_ins_mean"), F.round("mp_ins_stdev", 6).alias("mp_ins_stdev"))


def tier_abundance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.tier_abundance(maps(spark, sf_dir), A.catalog(spark, sf_dir)).select("seq_id", F.round("abundance", 9).alias("abundance"))


def abundance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.abundance(maps(spark, sf_dir), A.catalog(spark, sf_dir))


def greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.greedy_select(maps(spark, sf_dir), A.catalog(spark, sf_dir), fraction=0.2)


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold(spark, sf_dir).select("seq_id")


def remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.remap(A.hits(spark, sf_dir), _selected(spark, sf_dir), second_chance=True)
    return found.select("read_id", "seq_id", "pos", "ed", "strand", "mate", "tier", "second_chance")


def roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = A.catalog(spark, sf_dir)
    refs = ref_bits(spark, sf_dir).join(cat, "seq_id").withColumn("abundance", F.col("rd_cnt") / F.col("seq_len"))
    found = R.roll_up(refs)
    return found.select("parent_id", "refs", "seq_len", F.round("bits", 6).alias("bits"), F.round("abundance", 6).alias("abundance"), F.round("rel_ab", 6).alias("rel_ab"))


def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.run_stats(A.hits(spark, sf_dir), _selected(spark, sf_dir))


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = A.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pair_id"))
    hits = A.hits(spark, sf_dir).withColumnRenamed("read_id", "pair_id")
    return R.matched_reads(reads, hits, _selected(spark, sf_dir))


def unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = A.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pair_id"))
    hits = A.hits(spark, sf_dir).withColumnRenamed("read_id", "pair_id")
    return R.matched_reads(reads, hits, _selected(spark, sf_dir), invert=True)


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = A.hits(spark, sf_dir)
    start = F.col("pos") * 17 + F.col("read_id") % 13
    return hits.select("seq_id", start.cast("long").alias("start"), (start + READ_LEN).cast("long").alias("end"))


SPANS = f"""spans AS (SELECT seq_id, pos * 17 + read_id % 13 AS start, pos * 17 + read_id % 13 + {READ_LEN} AS stop FROM hits),
ins AS (SELECT seq_id, start, stop, seq_len FROM spans JOIN catalog USING (seq_id) WHERE start >= 1 AND stop - 1 <= seq_len),
ch AS (SELECT seq_id, p, sum(d) AS d FROM (SELECT seq_id, start AS p, 1 AS d FROM ins UNION ALL SELECT seq_id, stop, -1 FROM ins) GROUP BY seq_id, p),
runs AS (SELECT * FROM (SELECT seq_id, p AS start, lead(p) OVER w AS stop, CAST(sum(d) OVER w AS BIGINT) AS depth FROM ch WINDOW w AS (PARTITION BY seq_id ORDER BY p)) WHERE stop IS NOT NULL)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.depth_runs(C.inside(_spans(spark, sf_dir), A.catalog(spark, sf_dir)))


def insert_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("pos") * 17 + F.col("read_id") % 13
    pairs = A.hits(spark, sf_dir).select("seq_id", start.cast("long").alias("start"), (start + 40 + F.col("read_id") % 200).cast("long").alias("end"))
    return C.insert_runs(pairs).select("seq_id", "start", F.col("end").alias("stop"), "depth", F.round("mean_insert", 6).alias("mean_insert"))


def depth_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).select("seq_id", "start", F.col("end").alias("stop"), "depth")


def depth_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.depth_stats(_runs(spark, sf_dir), A.catalog(spark, sf_dir), margin=49)
    return found.select("seq_id", *[F.round(c, 6).alias(c) for c in ("adj_cov", "adj_cov_stddev")], "adj_cov_min", "adj_cov_max", F.round("pct_uncov", 9).alias("pct_uncov"))


def mean_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.mean_coverage(_runs(spark, sf_dir), A.catalog(spark, sf_dir)).select(F.round("mean", 9).alias("mean"), F.round("dup_threshold", 9).alias("dup_threshold"))


def duplications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.segments(_runs(spark, sf_dir), F.col("depth") >= 4, least=20.0)


def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.islands(_runs(spark, sf_dir), F.col("depth") == 0, 60).select("seq_id", "start", F.col("end").alias("stop"))


def end_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.end_peaks(_runs(spark, sf_dir))


def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    found = C.islands(runs, F.col("depth") == 0, 60).withColumn("type", F.lit("Z")).unionByName(C.islands(runs, F.col("depth") >= 3, 40).withColumn("type", F.lit("D")))
    return C.problem_report(found)


def moving_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = A.seqs(spark, sf_dir)
    bases = seqs.select(F.col("id").alias("seq_id"), F.posexplode(F.filter(F.split("seq", ""), lambda c: c != "")).alias("pos", "base")).withColumn("pos", F.col("pos").cast("long") + 1)
    found = C.moving_gc(bases, 100)
    return found.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("mean_gc"), 9).alias("lo"), F.round(F.max("mean_gc"), 9).alias("hi"), F.round(F.sum("mean_gc"), 4).alias("total"))


def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = A.read(spark, sf_dir, "lineitem")
    k = F.pmod(F.col("l_suppkey"), F.lit(4))
    counts = line.groupBy(F.col("l_partkey").alias("seq_id"), F.col("l_linenumber").cast("long").alias("pos")).agg(*[F.sum(F.when(k == i, F.col("l_quantity")).otherwise(0.0)).alias(b) for i, b in enumerate("acgt")])
    return C.consensus(counts)


SEL = f"""{BITS_SQL},
scored AS (SELECT seq_id, rd_cnt, round(total_bits, 6) AS total_bits, round(total_bits / seq_len, 9) AS bits FROM refs JOIN catalog USING (seq_id)),
sel AS (SELECT seq_id, bits FROM scored WHERE bits >= 0.5 * (SELECT max(bits) FROM scored))"""

_MATE_SQL = f"""{A.HITS}, {MATES},
pairs AS (SELECT a.pair_id, a.seq_id AS x, b.seq_id AS y, a.pos AS px, b.pos AS py, least(a.bits, b.bits) AS b FROM mates a JOIN mates b USING (pair_id) WHERE a.mate = 1 AND b.mate = 2),
same AS (SELECT DISTINCT pair_id FROM pairs WHERE x = y)"""
_KIND = "CASE WHEN x = y THEN 'internal' WHEN px < 0 AND py > 0 THEN 'FF' WHEN px >= 0 AND py <= 0 THEN 'BB' ELSE 'FB' END"
_FWD = f"CASE WHEN {_KIND} = 'FB' THEN px < 0 ELSE x <= y END"

QUERIES = {
    "select_best_hits": best_hits,
    "select_maps": maps,
    "select_read_bits": read_bits,
    "select_ref_bits": ref_bits,
    "select_threshold": threshold,
    "select_second_tier": second_tier,
    "select_limit_hits": limit_hits,
    "select_exclude": excluded,
    "select_include": included,
    "select_with_catalog": with_catalog,
    "select_split_references": split_references,
    "select_strands": strands,
    "select_shared_edges": shared_edges,
    "select_mate_edges": mate_edges,
    "select_mate_edges_strict": mate_edges_strict,
    "select_insert_sizes": insert_sizes,
    "select_tier_abundance": tier_abundance,
    "select_abundance": abundance,
    "select_greedy": greedy,
    "select_remap": remap,
    "select_roll_up": roll_up,
    "select_run_stats": run_stats,
    "select_matched_reads": matched,
    "select_unmatched_reads": unmatched,
    "coverage_depth_runs": depth_runs,
    "coverage_insert_runs": insert_runs,
    "coverage_depth_stats": depth_stats,
    "coverage_mean": mean_coverage,
    "coverage_duplications": duplications,
    "coverage_islands": islands,
    "coverage_end_peaks": end_peaks,
    "coverage_problem_report": problems,
    "coverage_moving_gc": moving_gc,
    "coverage_consensus": consensus,
}

ORACLES = {
    "select_best_hits": f"WITH {BITS_SQL} SELECT read_id, seq_id, ed, pos, strand, mate FROM best",
    "select_maps": f"WITH {BITS_SQL} SELECT * FROM maps",
    "select_read_bits": f"WITH {BITS_SQL} SELECT read_id, seq_count, round(bits, 9) AS bits FROM rbits",
    "select_ref_bits": f"WITH {SEL} SELECT * FROM scored",
    "select_threshold": f"WITH {SEL} SELECT * FROM sel",
    "select_second_tier": f"WITH {A.HITS} SELECT * FROM (SELECT *, ed - min(ed) OVER (PARTITION BY read_id) AS tier FROM hits) WHERE tier <= 1",
    "select_limit_hits": f"WITH {A.HITS} SELECT * EXCLUDE n FROM (SELECT *, count(*) OVER (PARTITION BY read_id) AS n FROM hits) WHERE n <= 4",
    "select_exclude": f"WITH {A.HITS} SELECT * FROM hits WHERE seq_id NOT IN (SELECT p_partkey FROM part WHERE p_size <= 10)",
    "select_include": f"WITH {A.HITS} SELECT * FROM hits WHERE seq_id IN (SELECT p_partkey FROM part WHERE p_size <= 10)",
    "select_with_catalog": f"WITH {A.HITS}, {A.CATALOG} SELECT read_id, seq_id, pos, ed, strand, mate, seq_len, parent_id FROM hits JOIN catalog USING (seq_id)",
    "select_split_references": f"""WITH {A.CATALOG},
n AS (SELECT *, greatest(seq_len // 300, 1) AS n FROM catalog), k AS (SELECT *, unnest(range(n)) AS k FROM n)
SELECT seq_id, seq_id || '|' || k || CASE WHEN k = n - 1 THEN '$' ELSE '' END AS chunk_id, k * 300 AS "offset",
       CASE WHEN k = n - 1 THEN seq_len - k * 300 ELSE 300 END AS seq_len, parent_id FROM k""",
    "select_strands": f"WITH {A.HITS} SELECT CASE WHEN strand < 0 THEN seq_id || '|R' ELSE CAST(seq_id AS VARCHAR) END AS seq_id, count(*) AS hits FROM hits GROUP BY 1",
    "select_shared_edges": f"""WITH {BITS_SQL}, m AS (SELECT read_id, seq_id, bits FROM maps JOIN rbits USING (read_id)),
e AS (SELECT a.seq_id AS seq1, b.seq_id AS seq2, count(*) AS num, sum(a.bits) AS bits FROM m a JOIN m b ON a.read_id = b.read_id AND a.seq_id < b.seq_id GROUP BY 1, 2)
SELECT seq1, seq2, num, round(bits, 6) AS bits FROM e WHERE bits >= 15""",
    "select_mate_edges": f"""WITH {_MATE_SQL},
r AS (SELECT {_KIND} AS kind, CASE WHEN {_FWD} THEN x ELSE y END AS n1, CASE WHEN {_FWD} THEN y ELSE x END AS n2,
  abs(CASE WHEN {_FWD} THEN px ELSE py END) + 25 AS m1, abs(CASE WHEN {_FWD} THEN py ELSE px END) + 25 AS m2, b FROM pairs)
SELECT kind, n1, n2, count(*) AS num, sum(b) AS bits, round(avg(m1), 6) AS p1, round(avg(m2), 6) AS p2 FROM r GROUP BY kind, n1, n2""",
    "select_mate_edges_strict": f"""WITH {_MATE_SQL},
r AS (SELECT {_KIND} AS kind, CASE WHEN {_FWD} THEN x ELSE y END AS n1, CASE WHEN {_FWD} THEN y ELSE x END AS n2 FROM pairs WHERE x = y OR pair_id NOT IN (SELECT pair_id FROM same)),
e AS (SELECT kind, n1, n2, count(*) AS num FROM r GROUP BY kind, n1, n2)
SELECT kind, count(*) AS edges, CAST(sum(num) AS BIGINT) AS num FROM e GROUP BY kind""",
    "select_insert_sizes": f"""WITH {A.HITS},
m AS (SELECT seq_id AS pair_id, mate, read_id % 50 AS ref, min(pos) AS pos, count(*) AS n FROM hits GROUP BY 1, 2, 3),
d AS (SELECT a.ref AS seq_id, abs(abs(b.pos) - abs(a.pos)) AS d FROM m a JOIN m b ON a.pair_id = b.pair_id AND a.ref = b.ref AND a.mate = 1 AND b.mate = 2 WHERE a.n = 1 AND b.n = 1)
SELECT seq_id, count(*) AS mp_pairs, round(avg(d), 6) AS mp_ins_mean, round(stddev_pop(d), 6) AS mp_ins_stdev FROM d GROUP BY seq_id""",
    "select_tier_abundance": f"""WITH {BITS_SQL},
r AS (SELECT *, count(*) OVER (PARTITION BY read_id) AS k FROM maps JOIN catalog USING (seq_id)),
u AS (SELECT seq_id, CAST(count(*) AS DOUBLE) / max(seq_len) AS ab FROM r WHERE k = 1 GROUP BY seq_id),
s AS (SELECT r.*, coalesce(ab, 0) * map_count AS w FROM r LEFT JOIN u USING (seq_id) WHERE k > 1),
t AS (SELECT *, CASE WHEN sum(w) OVER (PARTITION BY read_id) > 0 THEN w ELSE map_count END AS v FROM s),
x AS (SELECT *, v / sum(v) OVER (PARTITION BY read_id) AS share FROM t),
y AS (SELECT seq_id, sum(share) / max(seq_len) AS more FROM x GROUP BY seq_id)
SELECT seq_id, round(coalesce(ab, 0) + coalesce(more, 0), 9) AS abundance FROM u FULL JOIN y USING (seq_id)""",
    "select_remap": f"""WITH {SEL}, t AS (SELECT *, ed - min(ed) OVER (PARTITION BY read_id) AS tier FROM hits),
o AS (SELECT * FROM t WHERE tier <= 1 AND seq_id IN (SELECT seq_id FROM sel)),
z AS (SELECT *, false AS second_chance FROM o WHERE tier = 0 UNION ALL SELECT *, true FROM o WHERE tier = 1 AND read_id NOT IN (SELECT read_id FROM o WHERE tier = 0))
SELECT read_id, seq_id, pos, ed, strand, mate, tier, second_chance FROM z""",
    "select_roll_up": f"""WITH {SEL},
p AS (SELECT parent_id, count(*) AS refs, CAST(sum(seq_len) AS BIGINT) AS seq_len, sum(bits * seq_len) / sum(seq_len) AS bits,
  sum((CAST(rd_cnt AS DOUBLE) / seq_len) * seq_len) / sum(seq_len) AS abundance FROM scored JOIN catalog USING (seq_id) GROUP BY parent_id HAVING sum(bits * seq_len) > 0)
SELECT parent_id, refs, seq_len, round(bits, 6) AS bits, round(abundance, 6) AS abundance, round(abundance / (SELECT sum(abundance) FROM p), 6) AS rel_ab FROM p""",
    "select_run_stats": f"""WITH {SEL}
SELECT (SELECT count(DISTINCT read_id) FROM hits) AS reads, (SELECT count(DISTINCT seq_id) FROM hits) AS refs,
  (SELECT count(DISTINCT read_id) FROM hits WHERE seq_id IN (SELECT seq_id FROM sel)) AS reads_selected, (SELECT count(DISTINCT seq_id) FROM hits WHERE seq_id IN (SELECT seq_id FROM sel)) AS refs_selected""",
    "select_matched_reads": f"WITH {SEL} SELECT o_orderkey AS pair_id FROM orders WHERE o_orderkey IN (SELECT read_id FROM hits WHERE seq_id IN (SELECT seq_id FROM sel))",
    "select_unmatched_reads": f"WITH {SEL} SELECT o_orderkey AS pair_id FROM orders WHERE o_orderkey NOT IN (SELECT read_id FROM hits WHERE seq_id IN (SELECT seq_id FROM sel))",
    "coverage_depth_runs": f"WITH {A.HITS}, {A.CATALOG}, {SPANS} SELECT * FROM runs",
    "coverage_insert_runs": f"""WITH {A.HITS}, s AS (SELECT seq_id, pos * 17 + read_id % 13 AS a, pos * 17 + read_id % 13 + 40 + read_id % 200 AS b FROM hits),
c AS (SELECT seq_id, p, sum(d) AS d, sum(x) AS x FROM (SELECT seq_id, a AS p, 1 AS d, b - a AS x FROM s UNION ALL SELECT seq_id, b, -1, a - b FROM s) GROUP BY seq_id, p),
r AS (SELECT seq_id, p AS start, lead(p) OVER w AS stop, CAST(sum(d) OVER w AS BIGINT) AS depth, sum(x) OVER w AS x FROM c WINDOW w AS (PARTITION BY seq_id ORDER BY p))
SELECT seq_id, start, stop, depth, round(CASE WHEN depth > 0 THEN CAST(x AS DOUBLE) / depth END, 6) AS mean_insert FROM r WHERE stop IS NOT NULL""",
    "coverage_depth_stats": f"""WITH {A.HITS}, {A.CATALOG}, {SPANS},
c AS (SELECT seq_id, seq_len, depth, greatest(least(stop, seq_len - 49 + 1) - greatest(start, 50), 0) AS n, greatest(least(stop, seq_len + 1) - greatest(start, 1), 0) AS w FROM runs JOIN catalog USING (seq_id) WHERE seq_len > 98),
g AS (SELECT seq_id, seq_len, seq_len - 98 AS size, sum(n) AS n, sum(n * depth) AS s, sum(n * depth * depth) AS q, min(depth) FILTER (n > 0) AS lo, max(depth) FILTER (n > 0) AS hi, sum(w) FILTER (depth > 0) AS covered FROM c GROUP BY seq_id, seq_len)
SELECT seq_id, round(CAST(s AS DOUBLE) / size, 6) AS adj_cov, round(sqrt(greatest(CAST(q AS DOUBLE) / size - (CAST(s AS DOUBLE) / size) * (CAST(s AS DOUBLE) / size), 0)), 6) AS adj_cov_stddev,
  CASE WHEN n < size THEN 0 ELSE lo END AS adj_cov_min, coalesce(hi, 0) AS adj_cov_max, round(1 - CAST(covered AS DOUBLE) / seq_len, 9) AS pct_uncov FROM g""",
    "coverage_mean": f"""WITH {A.HITS}, {A.CATALOG}, {SPANS}, m AS (SELECT CAST(sum((stop - start) * depth) AS DOUBLE) / (SELECT sum(seq_len) FROM catalog) AS m FROM runs)
SELECT round(m, 9) AS mean, round(2 * m, 9) AS dup_threshold FROM m""",
    "coverage_end_peaks": f"""WITH {A.HITS}, {A.CATALOG}, {SPANS},
a AS (SELECT *, max(depth) OVER (PARTITION BY seq_id ORDER BY start RANGE BETWEEN CURRENT ROW AND 75 FOLLOWING) AS ahead, max(depth) OVER (PARTITION BY seq_id ORDER BY stop DESC RANGE BETWEEN CURRENT ROW AND 75 FOLLOWING) AS behind FROM runs)
SELECT seq_id, arg_min(depth, start) FILTER (depth >= ahead) AS front_peak, arg_max(depth, stop) FILTER (depth >= behind) AS back_peak FROM a GROUP BY seq_id""",
    "coverage_islands": f"WITH {A.HITS}, {A.CATALOG}, {SPANS} SELECT seq_id, start, stop FROM runs WHERE depth = 0 AND stop - start >= 60",
    "coverage_problem_report": f"""WITH {A.HITS}, {A.CATALOG}, {SPANS},
k AS (SELECT *, CASE WHEN depth >= 3 AND coalesce(lag(depth) OVER w, 0) >= 3 THEN 0 ELSE 1 END AS new FROM runs WINDOW w AS (PARTITION BY seq_id ORDER BY start)),
g AS (SELECT *, sum(new) OVER (PARTITION BY seq_id ORDER BY start) AS g FROM k),
d AS (SELECT seq_id, min(start) AS a, max(stop) AS b FROM g WHERE depth >= 3 GROUP BY seq_id, g HAVING max(stop) - min(start) >= 40),
p AS (SELECT 'D' AS type, seq_id, b - a AS n FROM d UNION ALL SELECT 'Z', seq_id, stop - start FROM runs WHERE depth = 0 AND stop - start >= 60)
SELECT type, count(*) AS problems, count(DISTINCT seq_id) AS refs, CAST(sum(n) AS BIGINT) AS bases FROM p GROUP BY type""",
    "coverage_moving_gc": f"""WITH {A.SEQS},
b AS (SELECT id AS seq_id, unnest(string_split(seq, '')) AS c, generate_subscripts(string_split(seq, ''), 1) AS pos, length(seq) AS n FROM seqs WHERE length(seq) > 0),
m AS (SELECT *, CASE WHEN c IN ('G', 'C') THEN 1.0 ELSE 0.0 END AS gc FROM b),
w AS (SELECT *, avg(gc) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING) AS a, avg(gc) OVER (PARTITION BY seq_id) AS whole FROM m),
i AS (SELECT *, CASE WHEN pos > 50 AND pos <= n - 50 THEN a END AS v FROM w),
e AS (SELECT *, arg_min(v, pos) FILTER (v IS NOT NULL) OVER (PARTITION BY seq_id) AS lo, arg_max(v, pos) FILTER (v IS NOT NULL) OVER (PARTITION BY seq_id) AS hi FROM i),
f AS (SELECT seq_id, coalesce(v, CASE WHEN pos <= 50 THEN lo ELSE hi END, whole) AS mean_gc FROM e)
SELECT seq_id, count(*) AS n, round(min(mean_gc), 9) AS lo, round(max(mean_gc), 9) AS hi, round(sum(mean_gc), 4) AS total FROM f GROUP BY seq_id""",
}
