"""Composition and taxonomy queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import compose as C
from quern.operators import taxonomy as T
from quern.plans import adapters as A


#: Columns of the table of scores that are looked at.
Z_COLUMNS = ["AAAA", "ACGT", "CATG", "GGCC", "TTTT"]


def kmer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.kmer_counts(A.seqs(spark, sf_dir), 4)


def z_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.z_scores(kmer_counts(spark, sf_dir)).select("id", "kmer", F.round("z", 6).alias("z"))


def z_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = C.z_table(kmer_counts(spark, sf_dir))
    return z.select("id", *[F.round(k, 6).alias(k) for k in Z_COLUMNS])


def threshold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds of suppliers: by a target from the balance and a length, from a table of nine."""
    grid = [(t, x, t * 0.5 + x * 0.01) for t in (0.9, 0.95, 0.99) for x in (12.0, 14.0, 18.0)]
    at = C.threshold_table(grid)
    rows = A.read(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 12 / 100 + 0.88).alias("target"), (F.col("s_suppkey") % 9 + 10.5).alias("log_len"))
    return rows.select("s_suppkey", F.round(F.udf(at, "double")("target", "log_len"), 9).alias("threshold"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("k", "z")).select("id", F.format_string("%03d", "k").alias("kmer"), F.col("z").cast("double").alias("z"))


def profile_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.profile_pairs(_vectors(spark, sf_dir), least=0.3).select("a", "b", F.round("r", 6).alias("r"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk_sequences(A.seqs(spark, sf_dir), 100).select("id", F.md5("seq").alias("seq_md5"))


def shared_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = A.seqs(spark, sf_dir).join(A.read(spark, sf_dir, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("id")), "id")
    return C.shared_kmer_fraction(A.seqs(spark, sf_dir), known, 8).select("id", F.round("fraction", 9).alias("fraction"))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cluster(A.seqs(spark, sf_dir), threshold=0.8, min_len=1000)


def _taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n, c = (A.read(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    lines = [
        r.select(F.concat_ws("*", F.col("r_regionkey").cast("string"), "r_name", F.lit("-1"), F.lit("1"), F.lit("domain")).alias("value")),
        n.select(F.concat_ws("*", (F.col("n_nationkey") + 100).cast("string"), "n_name", F.col("n_regionkey").cast("string"), F.lit("4"), F.lit("order")).alias("value")),
        c.select(F.concat_ws("*", (F.col("c_custkey") + 1000).cast("string"), "c_name", (F.col("c_nationkey") + 100).cast("string"), F.lit("8"), F.lit("genus")).alias("value")),
    ]
    return T.parse_training(lines[0].unionByName(lines[1]).unionByName(lines[2]))


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.branch_lengths(_taxa(spark, sf_dir)).select("taxid", "name", "parent", F.col("level").cast("long").alias("level"), "rank", F.col("length").cast("long").alias("length"))


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.lineages(_taxa(spark, sf_dir)).select("taxid", F.array_join("path", "/").alias("path"))


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n, c, o = (A.read(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.array("r_name", "n_name", "c_mktsegment").alias("path"), (F.col("o_orderkey") % 100 + 1).cast("double").alias("percent"), ((F.col("o_orderkey") % 7 + 1) / 8.0).alias("conf"), (F.col("o_orderkey") % 3).alias("sample"))


def _rolled(rows: DataFrame) -> DataFrame:
    return rows.select(F.array_join("node", "/").alias("node"), "num", F.round("pop", 4).alias("pop"), F.round("conf", 6).alias("conf"), F.round("w_conf", 6).alias("w_conf"))


def taxon_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolled(T.roll_up(_classified(spark, sf_dir)))


def taxon_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _classified(spark, sf_dir)
    trees = [T.roll_up(rows.filter(F.col("sample") == k)) for k in range(3)]
    return T.merge_trees(trees[0].unionByName(trees[1]).unionByName(trees[2])).select(F.array_join("node", "/").alias("node"), "num", F.round("pop", 4).alias("pop"), "conf", "w_conf")


def taxon_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.cumulative(T.roll_up(_classified(spark, sf_dir))).select(F.array_join("node", "/").alias("node"), F.round("cum", 4).alias("cum"), F.col("cnt").cast("long").alias("cnt"))


def taxon_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _classified(spark, sf_dir).withColumn("genus", F.element_at("path", 2))
    return T.keep_taxa(rows, "genus", "percent", 30_000.0).groupBy("genus").agg(F.count(F.lit(1)).alias("reads"))


def taxon_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = A.read(spark, sf_dir, "nation")
    path = F.array(F.struct(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("name"), F.lit(1).alias("level")), F.struct(F.col("n_name").alias("name"), F.lit(4).alias("level")))
    return n.select("n_nationkey", F.array_join(T.fill_gaps(path, 6), "/").alias("path"))


_TAXA = """taxa AS (
  SELECT CAST(r_regionkey AS BIGINT) AS taxid, r_name AS name, CAST(-1 AS BIGINT) AS parent, CAST(1 AS BIGINT) AS level, 'domain' AS rank FROM region
  UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey, 4, 'order' FROM nation
  UNION ALL SELECT c_custkey + 1000, c_name, c_nationkey + 100, 8, 'genus' FROM customer)"""
_CLASS = """reads AS (SELECT r_name AS a, n_name AS b, c_mktsegment AS c, CAST(o_orderkey % 100 + 1 AS DOUBLE) AS percent, (o_orderkey % 7 + 1) / 8.0 AS conf
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
x AS (SELECT a AS node, '' AS up, percent, conf FROM reads UNION ALL SELECT a || '/' || b, a, percent, conf FROM reads UNION ALL SELECT a || '/' || b || '/' || c, a || '/' || b, percent, conf FROM reads),
t AS (SELECT node, up, count(*) AS num, sum(percent) AS pop, avg(conf) AS conf, sum(percent * conf) / sum(percent) AS w_conf FROM x GROUP BY node, up)"""
_KMER = f"""{A.SEQS},
w AS (SELECT id, unnest(list_transform(range(1, length(seq) - 2), lambda i: seq[i:i+3])) AS kmer FROM seqs WHERE length(seq) >= 4),
f AS (SELECT id, kmer, count(*) AS n FROM w GROUP BY id, kmer),
k AS (SELECT id, kmer, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM f UNION ALL SELECT id, reverse(translate(kmer, 'ACGT', 'TGCA')), n FROM f) GROUP BY id, kmer)"""

_ZED = f"""{_KMER},
b AS (SELECT unnest(['A', 'C', 'G', 'T']) AS c), t AS (SELECT p.c || q.c || r.c || s.c AS kmer FROM b p, b q, b r, b s),
a AS (SELECT ids.id, t.kmer, coalesce(n, 0) AS n FROM (SELECT DISTINCT id FROM k) ids CROSS JOIN t LEFT JOIN k ON k.id = ids.id AND k.kmer = t.kmer),
e AS (SELECT id, kmer, n, CAST(sum(n) OVER (PARTITION BY id, kmer[1:3]) AS DOUBLE) AS f, CAST(sum(n) OVER (PARTITION BY id, kmer[2:4]) AS DOUBLE) AS b, CAST(sum(n) OVER (PARTITION BY id, kmer[2:3]) AS DOUBLE) AS d FROM a),
v AS (SELECT *, CASE WHEN d > 0 THEN f * b / d END AS x, CASE WHEN d > 0 THEN (f * b / d) * (d - f) * (d - b) / (d * d) END AS var FROM e),
zed AS (SELECT id, kmer, round(CASE WHEN d > 0 AND var > 0 THEN (n - x) / sqrt(var) ELSE 0 END, 6) AS z FROM v)"""

QUERIES = {
    "compose_kmer_counts": kmer_counts,
    "compose_z_scores": z_scores,
    "compose_z_table": z_table,
    "compose_threshold_table": threshold_table,
    "compose_profile_pairs": profile_pairs,
    "compose_chunks": chunks,
    "compose_shared_kmers": shared_kmers,
    "compose_clusters": clusters,
    "taxonomy_training": training,
    "taxonomy_lineage": lineage,
    "taxonomy_roll_up": taxon_roll_up,
    "taxonomy_merge": taxon_merge,
    "taxonomy_cumulative": taxon_cumulative,
    "taxonomy_keep": taxon_keep,
    "taxonomy_fill_gaps": taxon_gaps,
}

ORACLES = {
    "compose_kmer_counts": f"WITH {_KMER} SELECT * FROM k",
    "compose_z_scores": f"WITH {_ZED} SELECT id, kmer, z FROM zed",
    "compose_z_table": f"WITH {_ZED} SELECT id, {', '.join(f"max(z) FILTER (kmer = '{k}') AS {k}" for k in Z_COLUMNS)} FROM zed GROUP BY id",
    "compose_threshold_table": """WITH s AS (SELECT s_suppkey, s_suppkey % 12 / 100.0 + 0.88 AS t, s_suppkey % 9 + 10.5 AS x FROM supplier)
SELECT s_suppkey, round(CAST(least(greatest(t, 0.9), 0.99) * 0.5 + least(greatest(x, 12), 18) * 0.01 AS DOUBLE), 9) AS threshold FROM s""",
    "compose_profile_pairs": """WITH e AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS z, generate_subscripts(embedding, 1) AS k FROM embeddings),
p AS (SELECT a.id AS a, b.id AS b, corr(a.z, b.z) AS r FROM e a JOIN e b ON a.k = b.k AND a.id < b.id GROUP BY a.id, b.id)
SELECT a, b, round(r, 6) AS r FROM p WHERE abs(r) >= 0.3""",
    "compose_chunks": f"""WITH {A.SEQS}, k AS (SELECT id, seq, unnest(range(length(seq) // 100)) AS k FROM seqs)
SELECT id || '.' || k * 100 || '.' || (k + 1) * 100 - 1 AS id, md5(substring(seq, k * 100 + 1, 100)) AS seq_md5 FROM k""",
    "compose_shared_kmers": f"""WITH {A.SEQS}, w AS (SELECT DISTINCT id, unnest(list_transform(range(1, length(seq) - 6), lambda i: seq[i:i+7])) AS kmer FROM seqs WHERE length(seq) >= 8),
r AS (SELECT DISTINCT kmer FROM w JOIN documents ON id = doc_id WHERE lang = 'en')
SELECT id, round(CAST(count(r.kmer) AS DOUBLE) / count(*), 9) AS fraction FROM w LEFT JOIN r USING (kmer) GROUP BY id""",
    "taxonomy_training": f"WITH {_TAXA} SELECT t.*, coalesce(t.level - p.level, 0) AS length FROM taxa t LEFT JOIN taxa p ON t.parent = p.taxid",
    "taxonomy_lineage": f"""WITH RECURSIVE {_TAXA},
l AS (SELECT taxid, name AS path FROM taxa WHERE parent = -1 UNION ALL SELECT t.taxid, l.path || '/' || t.name FROM taxa t JOIN l ON t.parent = l.taxid) SELECT * FROM l""",
    "taxonomy_roll_up": f"WITH {_CLASS} SELECT node, num, round(pop, 4) AS pop, round(conf, 6) AS conf, round(w_conf, 6) AS w_conf FROM t",
    "taxonomy_merge": f"WITH {_CLASS} SELECT node, num, round(pop, 4) AS pop, round(conf, 2) AS conf, round(w_conf, 2) AS w_conf FROM t",
    "taxonomy_cumulative": f"""WITH {_CLASS}
SELECT node, round(coalesce(sum(pop) OVER w, 0), 4) AS cum, CAST(coalesce(sum(num) OVER w, 0) AS BIGINT) AS cnt FROM t WINDOW w AS (PARTITION BY up ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "taxonomy_keep": f"WITH {_CLASS} SELECT b AS genus, count(*) AS reads FROM reads GROUP BY b HAVING sum(percent) >= 30000",
    "taxonomy_fill_gaps": """SELECT n_nationkey, 'R' || n_regionkey || '/R' || n_regionkey || '_incertae_sedis/R' || n_regionkey || '_incertae_sedis/' || n_name AS path FROM nation""",
}
