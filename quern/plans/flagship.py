"""From hits to ranked references, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import select
from quern.plans import adapters as A


def flagship_ref_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References with at least a tenth of the best score, as a table."""
    scored = select.ref_bits(select.maps(A.hits(spark, sf_dir)), A.catalog(spark, sf_dir))
    return select.threshold(scored, fraction=0.1).select("seq_id", "descr", "seq_len", "rd_cnt", F.round("bits", 6).alias("bits"))


BITS_SQL = f"""
{A.HITS}, {A.CATALOG},
best AS (SELECT * FROM (SELECT *, min(ed) OVER (PARTITION BY read_id) AS m FROM hits) WHERE ed = m),
maps AS (SELECT read_id, seq_id, count(*) AS map_count, min(pos) AS pos FROM best GROUP BY read_id, seq_id),
num AS (SELECT CASE WHEN count(DISTINCT seq_id) = 1 THEN 2 ELSE count(DISTINCT seq_id) END AS num_seq FROM maps),
rbits AS (SELECT read_id, count(*) AS seq_count, log2(CAST(any_value(num_seq) AS DOUBLE) / count(*)) AS bits FROM maps, num GROUP BY read_id),
refs AS (SELECT seq_id, count(*) AS rd_cnt, sum(bits) AS total_bits FROM maps JOIN rbits USING (read_id) GROUP BY seq_id)
"""

QUERIES = {"flagship_ref_bits": flagship_ref_bits}
ORACLES = {
    "flagship_ref_bits": f"""
WITH {BITS_SQL},
s AS (SELECT seq_id, descr, seq_len, rd_cnt, total_bits / seq_len AS bits FROM refs JOIN catalog USING (seq_id))
SELECT seq_id, descr, seq_len, rd_cnt, round(bits, 6) AS bits FROM s WHERE bits >= 0.1 * (SELECT max(bits) FROM s)
"""
}
