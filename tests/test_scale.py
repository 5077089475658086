"""What a task holds follows a fixed number of rows, not the input."""

import itertools
import math
import random
import time
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quern import scratch
from quern.functions import sequence as S
from quern.operators import compose, select
from quern.plans import adapters as A
from quern.plans import registry
from tests.test_queries import SF


def test_links_are_dealt_out_by_the_number_of_lines(spark, monkeypatch):
    monkeypatch.setattr(scratch, "ROWS_A_TASK", 500)
    lines = A.read(spark, SF, "lineitem").count()
    # Adaptive execution would merge what it deals out itself into as many tasks as there are cores.
    assert A.links(spark, SF).rdd.getNumPartitions() >= 2 * lines // 500


def test_groups_are_taken_as_a_stream(spark):
    rows = [(k % 700, k, None if k % 3 else float(k)) for k in range(5000)]
    df = spark.createDataFrame(rows, "key long, a long, b double").repartition(7)
    sizes = scratch.by_group(df, "key", lambda own: [(own[0]["key"], len(own), sum(r["b"] or 0.0 for r in own))], "key long, n long, total double")
    plan = sizes._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan
    want = {}
    for key, _, b in rows:
        n, t = want.get(key, (0, 0.0))
        want[key] = n + 1, t + (b or 0.0)
    assert {r.key: (r.n, r.total) for r in sizes.collect()} == want


def test_special_tree_takes_components_together_and_leaves_nodes_alone(spark, monkeypatch):
    from quern.operators import graph as G
    from quern.operators import scaffold

    # 300 triangles and 900 nodes alone; of a triangle's links the two from its longest node stay.
    nodes = [(i, 100 + (i % 3 == 0), 1.0, 0.5) for i in range(1800)]
    links = [(i + a, i + b, "FB", 1, 10.0 + a + b, 10.0 + a + b) for i in range(0, 900, 3) for a, b in ((0, 1), (0, 2), (1, 2))]
    g = G.new_graph(spark.createDataFrame(nodes, "id long, seq_len long, cov double, pct_gc double"), spark.createDataFrame(links, "n1 long, n2 long, dir string, num long, bits double, score double"))
    grouped, by_group = [], scratch.by_group
    monkeypatch.setattr(scratch, "by_group", lambda df, *a: grouped.append(df.count()) or by_group(df, *a))
    kept = {(r.n1, r.n2) for r in scaffold.special_spanning_tree(g).live_edges().collect()}
    assert kept == {(i + a, i + b) for i in range(0, 900, 3) for a, b in ((0, 1), (0, 2))}
    # Nodes and links of the triangles: a node alone is no group.
    assert grouped == [900 + 900]


def test_a_reference_at_just_half_the_best_score_is_taken_as_in_sql(spark, tmp_path):
    # 64 parts, so a part's own order has 6 bits and one of two parts 5: sums are exact. Parts 1 and 2 have 8 orders
    # of their own and 2 together, the others 4 and 1, which is just half; the tenth digit of their score decides in SQL.
    n, length = 64, next(k for k in range(900, 2000) if 0.3 < 29 / k * 1e9 % 1 < 0.45)
    lines, order = [], 0
    for part in range(1, n + 1):
        for _ in range(8 if part < 3 else 4):
            order += 1
            lines.append((order, part, 1, 7.0, "N", "O"))
    for a in [1, *range(1, n, 2)]:
        order += 1
        lines += [(order, a, 1, 3.0, "N", "O"), (order, a + 1, 1, 3.0, "N", "F")]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, f"p{k}", "b", float(length)) for k in range(1, n + 1)], "p_partkey long, p_name string, p_brand string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    for name in ("select_run_edges", "select_run_nodes"):
        want = con.execute(registry.ORACLES[name])
        columns = [d[0] for d in want.description]
        assert sorted(tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).select(columns).collect()) == sorted(want.fetchall())


def brute_counts(seq, k, both):
    turned = str.maketrans("ACGT", "TGCA")
    own = [seq[i : i + k] for i in range(len(seq) - k + 1)]
    own = [w for w in own if set(w) <= set("ACGT")]
    return Counter(own + [w.translate(turned)[::-1] for w in own] * both)


def test_windows_are_counted_across_pieces_and_rows_of_one_id(spark, monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(compose, "WINDOWS", 50)
    rows = [(i % 7, "".join(rng.choices("ACGTNé", [9, 9, 9, 9, 1, 1], k=rng.choice([0, 2, 3, 4, 5, 30, 70, 400])))) for i in range(60)] + [(9, None)]
    for k, both in ((4, True), (3, False), (24, True), (25, True)):
        want = {}
        for i, s in rows:
            for w, n in brute_counts(s or "", k, both).items():
                want[i, w] = want.get((i, w), 0) + n
        assert {(r.id, r.kmer): r.n for r in compose.kmer_counts(spark.createDataFrame(rows, "id long, seq string"), k, both).collect()} == want
        # In small pieces, here: the workers do not see the patched size.
        if k <= 24:
            here = Counter()
            for part in compose._counted(iter([pa.RecordBatch.from_pylist([{"id": i, "seq": s} for i, s in rows if s is not None])]), k, both):
                for r in part.to_pylist():
                    here[r["id"], r["kmer"]] += r["n"]
            assert here == want


def test_counts_and_profiles_are_dealt_out_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(scratch, "ROWS_A_TASK", 1000)
    counts = compose.kmer_counts(A.seqs(spark, SF))
    parts = counts.count() // 1000
    assert parts > 8
    # Adaptive execution would merge them into as many tasks as there are cores.
    for df in (counts, compose.z_scores(counts), compose.z_table(counts)):
        assert df.rdd.getNumPartitions() >= parts


def test_pairs_of_blocks_come_once_where_a_block_is_empty(spark):
    rng = random.Random(3)
    z = spark.createDataFrame([(f"s{i}", f"{k:02}", rng.random()) for i in range(23) for k in range(8)], "id string, kmer string, z double")
    rows = {}
    for r in z.collect():
        rows.setdefault(r.id, {})[r.kmer] = r.z
    v = {i: np.array([x[k] for k in sorted(x)]) for i, x in rows.items()}
    want = {(a, b): np.corrcoef(v[a], v[b])[0, 1] for a in v for b in v if a < b}
    for block in (1, 5, None):
        got = compose.profile_pairs(z, block=block).collect()
        assert len(got) == len(want) and all(r.r == pytest.approx(want[r.a, r.b]) for r in got)
        assert len(compose.profile_pairs(z, block=block, least=0.5).collect()) == sum(abs(r) >= 0.5 for r in want.values())


def test_thousands_of_profiles_are_merged_in_seconds():
    rng = np.random.default_rng(7)
    base = [rng.gamma(0.5, 40, 256) for _ in range(50)]
    counts = np.array([rng.poisson(base[k % 50]) for k in range(2500)])
    began = time.process_time()
    found = compose.merge_profiles(list(range(2500)), counts, [5000] * 2500, lambda _: (0.8, 0.8, 0.8))
    # Pair after pair in Python took minutes.
    assert time.process_time() - began < 60
    assert sorted(sorted(c) for c in found) == [list(range(k, 2500, 50)) for k in range(50)]


@pytest.mark.parametrize("seed", range(2))
def test_greedy_selection_in_rounds_is_that_of_one_task(spark, seed):
    rng = random.Random(seed)
    rows = sorted({(r, s) for r in range(400) for s in rng.sample(range(60), rng.choice([1, 1, 2, 3]))})
    maps = spark.createDataFrame(rows, "read_id long, seq_id long")
    # Few lengths, so that scores are often equal.
    catalog = spark.createDataFrame([(s, 100 * (1 + s % 2)) for s in range(60)], "seq_id long, seq_len long")
    one = sorted(tuple(r) for r in select.greedy_select(maps, catalog, fraction=0.2).collect())
    rounds = sorted(tuple(r) for r in select.greedy_select(maps, catalog, fraction=0.2, few=0).collect())
    assert one == rounds and len(one) > 5
    # Best first, as a plain loop takes them, with ties by id.
    left, want = set(rows), []
    refs_of = Counter(r for r, _ in rows)
    n = len({s for _, s in rows})
    units = {r: round(np.log2(n / c) * select.PARTS) for r, c in refs_of.items()}
    score = lambda s: sum(units[r] for r, x in left if x == s) / select.PARTS / (100 * (1 + s % 2))
    least = 0.2 * max(score(s) for s in range(60))
    while left:
        top, s = max((score(s), -s) for _, s in left)
        if top < least:
            break
        want.append((-s, top))
        gone = {r for r, x in left if x == -s}
        left = {(r, x) for r, x in left if r not in gone}
    assert [k for k, _ in one] == sorted(k for k, _ in want)
    assert dict(one) == pytest.approx(dict(want))


def test_abundance_holds_a_read_and_a_number_for_each_reference(spark):
    rng = random.Random(5)
    rows = [("c", k, f"r{i:05}", s, 1 + (i + s) % 2, 50 + s) for i in range(20_000) for k in [rng.choice([1, 2, 3])] for s in sorted(rng.sample(range(300), k))]
    rows.sort(key=lambda r: (r[0], r[1], r[2], r[3]))
    batches = [pa.RecordBatch.from_pylist([dict(zip(("component", "k", "read_id", "idx", "map_count", "seq_len"), r, strict=True)) for r in rows[at : at + 777]]) for at in range(0, len(rows), 777)]
    tracemalloc.start()
    tracemalloc.reset_peak()
    found = {r["idx"]: r["abundance"] for b in select._share(iter(batches)) for r in b.to_pylist()}
    assert tracemalloc.get_traced_memory()[1] < 1_000_000
    tracemalloc.stop()
    ab = [0.0] * 300
    for _, own in itertools.groupby(rows, key=lambda r: r[2]):
        own = [(r[3], r[4], r[5]) for r in own]
        w = [ab[k] * n for k, n, _ in own]
        w = [float(n) for _, n, _ in own] if len(own) == 1 or not sum(w) else w
        for (k, _, length), x in zip(own, w, strict=True):
            ab[k] += x / sum(w) / length
    assert [found[k] for k in range(300)] == ab


@pytest.mark.parametrize("color", [False, True])
def test_trimming_holds_the_sums_of_a_few_reads(color):
    rng = random.Random(6)
    quals = ["".join(rng.choices("I5!?@", [200, 20, 1, 5, 5], k=rng.choice([0, 1, 500, 4000]))) for _ in range(3000)] + [None, "", "I" * 600_000]
    budget = round(-math.log(0.5) * S.COST_UNIT)
    tracemalloc.start()
    tracemalloc.reset_peak()
    found = S.prefix_within(quals, budget, color)
    assert tracemalloc.get_traced_memory()[1] < 60_000_000
    tracemalloc.stop()
    costs = S.error_costs(budget)
    for q, kept in [*zip(quals, found, strict=True)][::50] + [*zip(quals, found, strict=True)][-3:]:
        if q is None:
            assert kept is None
            continue
        total, want = 0, 0
        for k, c in enumerate(q):
            total += int(costs[ord(q[k - 1]) + 1 if color and k else 0, ord(c)])
            if total > budget:
                break
            want = k + 1
        assert kept == want
