"""Sequence-graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import scratch
from quern.functions import sequence as S
from quern.operators import graph as G
from quern.operators import scaffold as C
from quern.plans import adapters as A


#: Patterns to look for on both strands.
PATTERNS = ["ACCATTAG", "GATTACA", "TTAACC", "CCCGGG"]


def _graph(spark: SparkSession, sf_dir: str, least: int = 2) -> G.Graph:
    """Parts and their links; the links are a table, since most operators read them more than once."""
    return G.new_graph(A.nodes(spark, sf_dir), scratch.table(A.links(spark, sf_dir, least), "links"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.links(spark, sf_dir).select("n1", "n2", "num", "score")


def filter_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.filter_edges(_graph(spark, sf_dir), 2500.0).edges.select("n1", "n2", "state")


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.components(_graph(spark, sf_dir), "sequences").components
    return found.select("id", "component", "nodes", F.col("sequence").cast("long").alias("sequence"), F.col("ccnum").cast("long").alias("ccnum"))


def spanning_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.spanning_forest(_graph(spark, sf_dir)).live_edges().select("n1", "n2", "score")


def special_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.special_spanning_tree(_graph(spark, sf_dir)).live_edges().select("n1", "n2", "score")


def directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.make_directed(G.spanning_forest(_graph(spark, sf_dir))).live_edges().select("n1", "n2", "dir")


def pluck(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.pluck(_graph(spark, sf_dir), 2).nodes.select("id", "state")


def prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.prune(_graph(spark, sf_dir)).live_edges().select("n1", "n2", "score")


def _pushed(spark: SparkSession, sf_dir: str) -> G.Graph:
    return G.push(G.prune(G.pluck(G.spanning_forest(_graph(spark, sf_dir)), 3)), 3)


def push(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pushed(spark, sf_dir).live_edges().select("n1", "n2", "score")


def ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.linear_ends(_graph(spark, sf_dir))


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.chains(G.prune(_graph(spark, sf_dir)))


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.slice_chains(G.prune(_graph(spark, sf_dir)), 0.4).live_edges().select("n1", "n2")


def neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = A.nodes(spark, sf_dir).filter("seq_len >= 5090").select("id")
    return G.neighbourhood(_graph(spark, sf_dir), few, 2)


def select_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = A.nodes(spark, sf_dir).filter("seq_len >= 5090").select("id")
    return G.states(G.select_nodes(_graph(spark, sf_dir), few, 1))


def select_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.select_components(_graph(spark, sf_dir), ccrange=(1, 10), min_nodes=2)
    return found.live_nodes().select("id")


def seq_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.sequence_stats(A.nodes(spark, sf_dir))
    return found.select("nodes", "total_len", "n50", "max_len", "longest", F.round("mean_pct_gc", 9).alias("mean_pct_gc"), F.round("mean_cov", 9).alias("mean_cov"))


def component_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = G.components(_graph(spark, sf_dir))
    return G.sequence_stats(g.components.select("id", "seq_len", "component"), ["component"])


def shared_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.shared_neighbours(A.links(spark, sf_dir), 2200.0).select("a", "b", "bits")


def heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = A.nodes(spark, sf_dir)
    a, b = (n.select(F.col("id").alias(k), F.col("pct_gc").alias(f"g{k}"), F.col("cov").alias(f"c{k}")) for k in ("n1", "n2"))
    rows = A.links(spark, sf_dir).join(a, "n1").join(b, "n2")
    return rows.select("n1", "n2", F.round(S.edge_heuristic(F.col("bits"), F.col("gn1"), F.col("gn2"), F.col("cn1"), F.col("cn2")), 6).alias("score"))


def relink(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = G.filter_edges(_graph(spark, sf_dir), 2500.0)
    few = A.nodes(spark, sf_dir).filter("seq_len >= 4000").select("id")
    return G.states(G.relink(g, few, 2100.0))


def edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    new_nodes, new_edges = spark.createDataFrame([(-1,)], "id long"), spark.createDataFrame([(-1, 10)], "n1 long, n2 long")
    return G.states(G.edit(_graph(spark, sf_dir), new_nodes, new_edges, rem_nodes=[1, 2, 3, 4, 5], rem_edges=[(6, k) for k in range(7, 40)]))


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.graph_stats(G.filter_edges(_graph(spark, sf_dir), 2500.0))


def relink_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = A.nodes(spark, sf_dir)
    g = G.select_nodes(_graph(spark, sf_dir), n.filter("seq_len >= 4000").select("id"))
    return G.states(G.relink(g, n.filter("seq_len >= 4900").select("id"), 2050.0, radius=1, complete=True))


def relink_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.states(G.relink(G.filter_edges(_graph(spark, sf_dir), 2500.0), None, 2100.0, existing=True, ends=True))


def graft(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = _graph(spark, sf_dir)
    long_ones = G.Graph(full.nodes.filter("seq_len >= 2000"), full.edges.filter("score >= 2500"))
    counted = G.Graph(full.nodes.withColumn("mp_sh", F.col("seq_len") % 7), full.edges)
    done = G.graft_edges(long_ones, counted)
    return G.states(done).join(done.nodes.select(F.col("id").alias("a"), F.lit("node").alias("what"), "mp_sh"), ["what", "a"], "left")


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    part = lambda test: G.Graph(n := g.nodes.filter(test), g.edges.join(n.select(F.col("id").alias("n1")), "n1", "left_semi").join(n.select(F.col("id").alias("n2")), "n2", "left_semi"))
    return G.states(G.merge([part("seq_len < 2500"), part("seq_len >= 2500")]))


def find_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.find_sequences(A.seqs(spark, sf_dir), PATTERNS)


def select_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    g = G.Graph(g.nodes, g.edges, clusters=g.nodes.select("id", F.floor(F.col("seq_len") / 1000).alias("cluster_id")))
    return G.states(G.select_clusters(g, [1, 3], shift=1))


def chain_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = G.prune(_graph(spark, sf_dir))
    own = G.chains(g).groupBy(F.col("chain").alias("scaffold_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "id"))), lambda x: x["id"]).alias("nodes"))
    return G.scaffold_links(g, own, 2500.0)


def dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.sources import graphs

    return graphs.dot_lines(G.filter_edges(_graph(spark, sf_dir), 2500.0), detail=True, pen_scale=0.01, colored_edges=True).select("line")


def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.sources import graphs

    path = scratch.folder(spark, "graph")
    graphs.dump(G.filter_edges(_graph(spark, sf_dir), 2500.0), path)
    return G.states(graphs.load(spark, path))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.sources import graphs

    own = A.seqs(spark, sf_dir).filter("seq <> ''").select("id", "seq", (F.char_length("seq") / 1_000_000).alias("rel_ab"))
    return graphs.sequences(G.new_graph(own, spark.createDataFrame([], "n1 long, n2 long")), abundance=True).select("name", F.md5("seq").alias("seq_md5"))


def cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = G.cut_node(_graph(spark, sf_dir), 7, -7, 11, -11)
    return g.nodes.filter("id < 0").select("id", "seq_len", "cov")


def scaffolds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.scaffold(_pushed(spark, sf_dir)).scaffolds
    return found.select("scaffold_id", "ccnum", F.concat_ws(",", F.col("nodes").cast("array<string>")).alias("path"))


def insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.insert(_pushed(spark, sf_dir), thresh=2000.0).live_nodes().select("id")


def circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.circles(C.scaffold(_pushed(spark, sf_dir)), min_seqlen=0)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = C.scaffold(_pushed(spark, sf_dir))
    return G.scaffold_links(g, g.scaffolds, 1000.0)


def table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.sources import graphs

    return graphs.table(G.filter_edges(_graph(spark, sf_dir))).select("id", "seq_len", "cov", F.col("pct_gc").cast("double").alias("pct_gc"))


L2 = A.links_sql(2)
_CC = """reach AS (SELECT id AS node, id AS seen FROM nodes UNION SELECT reach.node, b FROM reach JOIN (SELECT n1 AS a, n2 AS b FROM links UNION ALL SELECT n2, n1 FROM links) ON seen = a),
cc AS (SELECT node AS id, min(seen) AS component FROM reach GROUP BY node)"""

QUERIES = {
    "graph_edges": edges,
    "graph_filter_edges": filter_edges,
    "graph_components": components,
    "graph_spanning_forest": spanning_forest,
    "graph_special_tree": special_tree,
    "graph_directed": directed,
    "graph_pluck": pluck,
    "graph_prune": prune,
    "graph_push": push,
    "graph_linear_ends": ends,
    "graph_chains": chains,
    "graph_slice": slices,
    "graph_neighbourhood": neighbourhood,
    "graph_select_nodes": select_nodes,
    "graph_select_components": select_components,
    "graph_sequence_stats": seq_stats,
    "graph_component_stats": component_stats,
    "graph_shared_neighbours": shared_neighbours,
    "graph_edge_heuristic": heuristic,
    "graph_relink": relink,
    "graph_edit": edit,
    "graph_cut_node": cut,
    "graph_scaffolds": scaffolds,
    "graph_insert": insert,
    "graph_circles": circles,
    "graph_scaffold_links": links,
    "graph_table": table,
    "graph_stats": stats,
    "graph_relink_complete": relink_complete,
    "graph_relink_ends": relink_ends,
    "graph_graft_edges": graft,
    "graph_merge": merged,
    "graph_find_sequences": find_sequences,
    "graph_select_clusters": select_clusters,
    "graph_chain_links": chain_links,
    "graph_dot": dot,
    "graph_json": json_round_trip,
    "graph_sequences": sequences,
}

ORACLES = {
    "graph_edges": f"WITH {L2} SELECT n1, n2, num, score FROM links",
    "graph_filter_edges": f"WITH {L2} SELECT n1, n2, CASE WHEN score < 2500 THEN 'removed' ELSE 'selected' END AS state FROM links",
    "graph_components": f"""WITH RECURSIVE {A.NODES}, {L2}, {_CC},
s AS (SELECT component, count(*) AS nodes, CAST(sum(seq_len) AS BIGINT) AS sequence FROM cc JOIN nodes USING (id) GROUP BY component),
r AS (SELECT *, row_number() OVER (ORDER BY sequence DESC, component) AS ccnum FROM s)
SELECT id, component, nodes, sequence, ccnum FROM cc JOIN r USING (component)""",
    "graph_pluck": f"""WITH {A.NODES}, {L2},
d1 AS (SELECT id, (SELECT count(*) FROM links WHERE n1 = id OR n2 = id) AS d FROM nodes),
r1 AS (SELECT id FROM d1 WHERE d <= 1), e1 AS (SELECT * FROM links WHERE n1 NOT IN (SELECT id FROM r1) AND n2 NOT IN (SELECT id FROM r1)),
d2 AS (SELECT id, (SELECT count(*) FROM e1 WHERE n1 = id OR n2 = id) AS d FROM nodes WHERE id NOT IN (SELECT id FROM r1)),
r2 AS (SELECT id FROM d2 WHERE d = 1)
SELECT id, CASE WHEN id IN (SELECT id FROM r1) OR id IN (SELECT id FROM r2) THEN 'removed' ELSE 'selected' END AS state FROM nodes""",
    "graph_prune": f"""WITH {L2}, r AS (SELECT *, row_number() OVER (PARTITION BY n1 ORDER BY score DESC, n1, n2) AS o, row_number() OVER (PARTITION BY n2 ORDER BY score DESC, n1, n2) AS i FROM links)
SELECT n1, n2, score FROM r WHERE o = 1 AND i = 1""",
    "graph_linear_ends": f"""WITH {A.NODES}, {L2}
SELECT * FROM (SELECT id, id NOT IN (SELECT n2 FROM links) AS is_head, id NOT IN (SELECT n1 FROM links) AS is_tail FROM nodes) WHERE is_head OR is_tail""",
    "graph_chains": f"""WITH RECURSIVE {A.NODES}, {L2},
r AS (SELECT *, row_number() OVER (PARTITION BY n1 ORDER BY score DESC, n1, n2) AS o, row_number() OVER (PARTITION BY n2 ORDER BY score DESC, n1, n2) AS i FROM links),
k AS (SELECT n1, n2 FROM r WHERE o = 1 AND i = 1),
c AS (SELECT id, id AS chain, CAST(0 AS BIGINT) AS idx FROM nodes WHERE id NOT IN (SELECT n2 FROM k) UNION ALL SELECT n2, chain, idx + 1 FROM c JOIN k ON n1 = id)
SELECT id, chain, idx FROM c""",
    "graph_neighbourhood": f"""WITH {A.NODES}, {L2}, b AS (SELECT n1 AS x, n2 AS y FROM links UNION SELECT n2, n1 FROM links),
z AS (SELECT id FROM nodes WHERE seq_len >= 5090), o AS (SELECT id FROM z UNION SELECT y FROM b JOIN z ON x = id)
SELECT id FROM o UNION SELECT y FROM b JOIN o ON x = id""",
    "graph_select_nodes": f"""WITH {A.NODES}, {L2}, b AS (SELECT n1 AS x, n2 AS y FROM links UNION SELECT n2, n1 FROM links),
z AS (SELECT id FROM nodes WHERE seq_len >= 5090), o AS (SELECT id FROM z UNION SELECT y FROM b JOIN z ON x = id)
SELECT 'node' AS what, id AS a, CAST(NULL AS BIGINT) AS b, CASE WHEN id IN (SELECT id FROM o) THEN 'selected' ELSE 'removed' END AS state FROM nodes
UNION ALL SELECT 'edge', n1, n2, CASE WHEN n1 IN (SELECT id FROM o) AND n2 IN (SELECT id FROM o) THEN 'selected' ELSE 'removed' END FROM links""",
    "graph_select_components": f"""WITH RECURSIVE {A.NODES}, {L2}, {_CC}, s AS (SELECT component, count(*) AS n FROM cc GROUP BY component),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, component) AS k FROM s) SELECT id FROM cc JOIN r USING (component) WHERE k <= 10 AND n >= 2""",
    "graph_sequence_stats": f"""WITH {A.NODES}, r AS (SELECT *, sum(seq_len) OVER (ORDER BY seq_len DESC, id) AS run FROM nodes)
SELECT count(*) AS nodes, CAST(sum(seq_len) AS BIGINT) AS total_len, max(seq_len) FILTER (run * 2 >= (SELECT sum(seq_len) FROM nodes)) AS n50, max(seq_len) AS max_len,
  (SELECT id FROM nodes ORDER BY seq_len DESC, id LIMIT 1) AS longest, round(sum(pct_gc * seq_len) / sum(seq_len), 9) AS mean_pct_gc, round(sum(cov * seq_len) / sum(seq_len), 9) AS mean_cov FROM r""",
    "graph_component_stats": f"""WITH RECURSIVE {A.NODES}, {L2}, {_CC}, j AS (SELECT * FROM cc JOIN nodes USING (id)),
r AS (SELECT *, sum(seq_len) OVER (PARTITION BY component ORDER BY seq_len DESC, id) AS run, sum(seq_len) OVER (PARTITION BY component) AS total FROM j)
SELECT component, count(*) AS nodes, CAST(sum(seq_len) AS BIGINT) AS total_len, max(seq_len) FILTER (run * 2 >= total) AS n50, max(seq_len) AS max_len, (arg_min(id, (-seq_len, id))) AS longest FROM r GROUP BY component""",
    "graph_shared_neighbours": f"""WITH {L2}, e AS (SELECT n1 AS x, n2 AS via, score FROM links WHERE score > 2200 UNION ALL SELECT n2, n1, score FROM links WHERE score > 2200)
SELECT p.x AS a, q.x AS b, max(least(p.score, q.score)) AS bits FROM e p JOIN e q ON p.via = q.via AND p.x < q.x GROUP BY p.x, q.x""",
    "graph_edge_heuristic": f"""WITH {A.NODES}, {L2}
SELECT n1, n2, round(score - score * (0.08 * abs(a.pct_gc - b.pct_gc) + 0.125 * abs(ln(a.cov) - ln(b.cov))), 6) AS score FROM links JOIN nodes a ON a.id = n1 JOIN nodes b ON b.id = n2""",
    "graph_relink": f"""WITH {A.NODES}, {L2}, k AS (SELECT id FROM nodes WHERE seq_len >= 4000)
SELECT 'node' AS what, id AS a, CAST(NULL AS BIGINT) AS b, 'selected' AS state FROM nodes
UNION ALL SELECT 'edge', n1, n2, CASE WHEN score >= 2500 OR (score >= 2100 AND (n1 IN (SELECT id FROM k) OR n2 IN (SELECT id FROM k))) THEN 'selected' ELSE 'removed' END FROM links""",
    "graph_edit": f"""WITH {A.NODES}, {L2}
SELECT 'node' AS what, id AS a, CAST(NULL AS BIGINT) AS b, CASE WHEN id BETWEEN 1 AND 5 THEN 'removed' ELSE 'selected' END AS state FROM nodes
UNION ALL SELECT 'node', -1, NULL, 'selected' UNION ALL SELECT 'edge', -1, 10, 'selected'
UNION ALL SELECT 'edge', n1, n2, CASE WHEN n1 BETWEEN 1 AND 5 OR n2 BETWEEN 1 AND 5 OR (n1 = 6 AND n2 BETWEEN 7 AND 39) THEN 'removed' ELSE 'selected' END FROM links""",
    "graph_stats": f"""WITH {A.NODES}, {L2} SELECT 'nodes' AS what, 'selected' AS state, count(*) AS n FROM nodes
UNION ALL SELECT 'edges', CASE WHEN score >= 2500 THEN 'selected' ELSE 'removed' END, count(*) FROM links GROUP BY 2""",
    "graph_relink_complete": f"""WITH {A.NODES}, {L2}, z AS (SELECT id FROM nodes WHERE seq_len >= 4000),
l AS (SELECT *, n1 IN (SELECT id FROM z) AND n2 IN (SELECT id FROM z) AS live FROM links),
y AS (SELECT id FROM nodes WHERE seq_len >= 4900),
i AS (SELECT id FROM y UNION SELECT n2 FROM l JOIN y ON n1 = id WHERE live UNION SELECT n1 FROM l JOIN y ON n2 = id WHERE live),
h AS (SELECT n1, n2 FROM l WHERE NOT live AND score >= 2050 AND (n1 IN (SELECT id FROM i) OR n2 IN (SELECT id FROM i))),
s AS (SELECT id FROM z UNION SELECT n1 FROM h UNION SELECT n2 FROM h)
SELECT 'node' AS what, id AS a, CAST(NULL AS BIGINT) AS b, CASE WHEN id IN (SELECT id FROM s) THEN 'selected' ELSE 'removed' END AS state FROM nodes
UNION ALL SELECT 'edge', n1, n2, CASE WHEN live OR score >= 2050 AND n1 IN (SELECT id FROM s) AND n2 IN (SELECT id FROM s) THEN 'selected' ELSE 'removed' END FROM l""",
    "graph_relink_ends": f"""WITH {A.NODES}, {L2}, t AS (SELECT id FROM nodes WHERE id NOT IN (SELECT n2 FROM links WHERE score >= 2500) OR id NOT IN (SELECT n1 FROM links WHERE score >= 2500))
SELECT 'node' AS what, id AS a, CAST(NULL AS BIGINT) AS b, 'selected' AS state FROM nodes
UNION ALL SELECT 'edge', n1, n2, CASE WHEN score >= 2500 OR (score >= 2100 AND (n1 IN (SELECT id FROM t) OR n2 IN (SELECT id FROM t))) THEN 'selected' ELSE 'removed' END FROM links""",
    "graph_graft_edges": f"""WITH {A.NODES}, {L2}, k AS (SELECT * FROM nodes WHERE seq_len >= 2000)
SELECT 'node' AS what, id AS a, CAST(NULL AS BIGINT) AS b, 'selected' AS state, seq_len % 7 AS mp_sh FROM k
UNION ALL SELECT 'edge', n1, n2, 'selected', NULL FROM links WHERE n1 IN (SELECT id FROM k) AND n2 IN (SELECT id FROM k)""",
    "graph_merge": f"""WITH {A.NODES}, {L2}
SELECT 'node' AS what, id AS a, CAST(NULL AS BIGINT) AS b, 'selected' AS state FROM nodes
UNION ALL SELECT 'edge', n1, n2, 'selected' FROM links JOIN nodes x ON x.id = n1 JOIN nodes y ON y.id = n2 WHERE (x.seq_len < 2500) = (y.seq_len < 2500)""",
    "graph_find_sequences": f"""WITH {A.SEQS}, p AS (SELECT unnest({PATTERNS}) AS pattern)
SELECT id, pattern FROM seqs, p WHERE contains(seq, pattern) OR contains(seq, reverse(translate(pattern, 'ACGT', 'TGCA')))""",
    "graph_select_clusters": f"""WITH {A.NODES}, {L2}, k AS (SELECT id FROM nodes WHERE seq_len // 1000 IN (2, 4))
SELECT 'node' AS what, id AS a, CAST(NULL AS BIGINT) AS b, CASE WHEN id IN (SELECT id FROM k) THEN 'selected' ELSE 'removed' END AS state FROM nodes
UNION ALL SELECT 'edge', n1, n2, CASE WHEN n1 IN (SELECT id FROM k) AND n2 IN (SELECT id FROM k) THEN 'selected' ELSE 'removed' END FROM links""",
    "graph_chain_links": f"""WITH RECURSIVE {A.NODES}, {L2},
r AS (SELECT *, row_number() OVER (PARTITION BY n1 ORDER BY score DESC, n1, n2) AS o, row_number() OVER (PARTITION BY n2 ORDER BY score DESC, n1, n2) AS i FROM links),
k AS (SELECT n1, n2 FROM r WHERE o = 1 AND i = 1),
c AS (SELECT id, id AS chain, 0 AS idx FROM nodes WHERE id NOT IN (SELECT n2 FROM k) UNION ALL SELECT n2, chain, idx + 1 FROM c JOIN k ON n1 = id),
e AS (SELECT chain, arg_min(id, idx) AS id, 'head' AS side FROM c GROUP BY chain UNION ALL SELECT chain, arg_max(id, idx), 'tail' FROM c GROUP BY chain)
SELECT x.chain AS s1, x.side AS end1, y.chain AS s2, y.side AS end2, n1, n2, score AS bits FROM links JOIN e x ON x.id = n1 JOIN e y ON y.id = n2 WHERE score >= 2500 AND x.chain <> y.chain""",
    "graph_dot": f"""WITH {A.NODES}, {L2}
SELECT printf('  "%d" [label="%d\\n%d"];', id, id, seq_len) AS line FROM nodes
UNION ALL SELECT printf('  "%d" -> "%d" [penwidth=%.2f, color=black];', n1, n2, greatest(1.0, score * 0.01)) FROM links WHERE score >= 2500
UNION ALL SELECT 'digraph seq {{' UNION ALL SELECT '  edge [arrowhead=normal];' UNION ALL SELECT '}}'""",
    "graph_json": f"""WITH {A.NODES}, {L2}
SELECT 'node' AS what, CAST(id AS VARCHAR) AS a, CAST(NULL AS VARCHAR) AS b, 'selected' AS state FROM nodes
UNION ALL SELECT 'edge', CAST(n1 AS VARCHAR), CAST(n2 AS VARCHAR), CASE WHEN score >= 2500 THEN 'selected' ELSE 'removed' END FROM links""",
    "graph_sequences": f"WITH {A.SEQS} SELECT printf('%d_%.6f', id, length(seq) / 1000000.0 * 100) AS name, md5(seq) AS seq_md5 FROM seqs WHERE seq <> ''",
    "graph_cut_node": f"WITH {A.NODES} SELECT CAST(-7 AS BIGINT) AS id, seq_len - 20 AS seq_len, cov FROM nodes WHERE id = 7",
    "graph_table": f"WITH {A.NODES} SELECT id, seq_len, cov, pct_gc FROM nodes",
}
