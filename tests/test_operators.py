"""Operators that SQL cannot express, against plain versions on small random inputs."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import compose, coverage, layout, reads, scaffold, select, taxonomy
from quern.operators import graph as G


def random_maps(seed, refs=25, n=120):
    rng = random.Random(seed)
    rows = set()
    for r in range(n):
        for s in rng.sample(range(refs), rng.choice([1, 1, 2, 3])):
            rows.add((r, s))
    return sorted(rows), {s: rng.randrange(50, 200) for s in range(refs)}


def frames(spark, rows, length):
    maps = spark.createDataFrame([(r, s, 1 + (r + s) % 2, 10) for r, s in rows], "read_id long, seq_id long, map_count long, pos long")
    return maps, spark.createDataFrame([(s, n) for s, n in length.items()], "seq_id long, seq_len long")


@pytest.mark.parametrize("seed", range(3))
def test_greedy_selection(spark, seed):
    rows, length = random_maps(seed)
    maps, catalog = frames(spark, rows, length)
    reads_of, refs_of = {}, {}
    for r, s in rows:
        refs_of.setdefault(r, set()).add(s)
        reads_of.setdefault(s, set()).add(r)
    bits = {r: np.log2(len(reads_of) / len(x)) for r, x in refs_of.items()}
    score = lambda s, gone: sum(bits[r] for r in reads_of[s] - gone) / length[s]
    least = 0.2 * max(score(s, set()) for s in reads_of)
    gone, want = set(), {}
    while True:
        left = [(score(s, gone), -s) for s in reads_of if s not in want and reads_of[s] - gone]
        if not left or max(left)[0] < least:
            break
        top, s = max(left)
        want[-s] = top
        gone |= reads_of[-s]
    got = {r.seq_id: r.bits for r in select.greedy_select(maps, catalog, fraction=0.2).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("seed", range(3))
def test_sequential_abundance(spark, seed):
    rows, length = random_maps(seed, refs=12, n=60)
    maps, catalog = frames(spark, rows, length)
    refs_of = {}
    for r, s in rows:
        refs_of.setdefault(r, []).append(s)
    ab = dict.fromkeys(length, 0.0)
    for r in sorted(refs_of, key=lambda r: (len(refs_of[r]), r)):
        w = {s: ab[s] * (1 + (r + s) % 2) for s in refs_of[r]}
        if len(w) == 1 or not sum(w.values()):
            w = {s: 1 + (r + s) % 2 for s in refs_of[r]}
        for s, x in w.items():
            ab[s] += x / sum(w.values()) / length[s]
    got = {r.seq_id: r.abundance for r in select.abundance(maps, catalog).collect()}
    assert got.keys() <= ab.keys() and all(got.get(s, 0.0) == pytest.approx(v) for s, v in ab.items())


def random_graph(seed, n=30, m=60):
    rng = random.Random(seed)
    edges = {}
    while len(edges) < m:
        a, b = sorted(rng.sample(range(1, n + 1), 2))
        edges[a, b] = float(rng.randrange(1, 12))
    return {i: rng.randrange(100, 900) for i in range(1, n + 1)}, edges


def graph(spark, nodes, edges, **extra):
    n = spark.createDataFrame([(i, x, 10.0 + i % 7, 0.3 + i % 5 / 10) for i, x in nodes.items()], "id long, seq_len long, cov double, pct_gc double")
    e = spark.createDataFrame([(a, b, "FB", w * 100, w) for (a, b), w in edges.items()], "n1 long, n2 long, dir string, bits double, score double")
    return G.new_graph(n, e)


@pytest.mark.parametrize("seed", range(3))
def test_spanning_forest_against_kruskal(spark, seed):
    nodes, edges = random_graph(seed)
    up = {i: i for i in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    want = set()
    for (a, b), _ in sorted(edges.items(), key=lambda e: (-e[1], e[0])):
        if find(a) != find(b):
            up[find(a)] = find(b)
            want.add((a, b))
    got = {(r.n1, r.n2) for r in G.spanning_forest(graph(spark, nodes, edges)).live_edges().collect()}
    assert got == want


def test_special_tree_is_prim_without_dead_ends():
    nodes = [(1, 900), (2, 100), (3, 100), (4, 100)]
    edges = [(1, 2, 9.0), (1, 3, 8.0), (2, 3, 10.0), (3, 4, 1.0)]
    tree = lambda inner: {(min(a, b), max(a, b)) for a, b, _ in scaffold.special_tree(nodes, edges, inner)}
    # From 2 nothing new is reached, as 3 is linked to 1: the better link of the two is left out.
    assert tree({}) == {(1, 2), (1, 3), (3, 4)}
    # With bits of its own, 3 counts as new, and the better link is taken.
    assert tree({3: 1.0}) == {(1, 2), (2, 3), (3, 4)}


@pytest.mark.parametrize("seed", range(4))
def test_longest_path_against_enumeration(seed):
    nodes, edges = random_graph(seed, n=9, m=14)
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)

    def paths(n):
        yield [n]
        for m in out.get(n, []):
            for p in paths(m):
                yield [n, *p]

    best = max(sum(nodes[i] for i in p) for n in nodes for p in paths(n))
    path = scaffold.longest_path(list(nodes.items()), [(a, b, None) for a, b in edges])
    assert sum(nodes[i] for i in path) == best and all(b in out[a] for a, b in itertools.pairwise(path))


def test_longest_path_breaks_cycles_at_positional_links():
    nodes = [(k, 10) for k in (1, 2, 3)]
    assert scaffold.longest_path(nodes, [(1, 2, None), (2, 3, None), (3, 1, 5.0)]) == [1, 2, 3]


def test_direction(spark):
    nodes = {1: 900, 2: 100, 3: 100, 4: 100}
    g = graph(spark, nodes, {})
    rows = [(1, 2, "FB", 5.0, 5.0), (2, 3, "FF", 5.0, 5.0), (3, 4, "BB", 5.0, 5.0)]
    g = G.new_graph(g.nodes, spark.createDataFrame(rows, "n1 long, n2 long, dir string, bits double, score double"))
    got = {(r.n1, r.n2, r.dir) for r in G.make_directed(g).live_edges().collect()}
    # 3 and 4 share an end, so 3 is turned; its back is then its front, from which 4 follows.
    assert got == {(1, 2, "forward"), (2, 3, "forward"), (3, 4, "forward")}


def test_pluck_push_and_chains(spark):
    nodes = dict.fromkeys(range(1, 8), 100)
    edges = {(1, 2): 5.0, (2, 3): 5.0, (3, 4): 5.0, (4, 5): 5.0, (3, 6): 1.0}
    g = G.pluck(graph(spark, nodes, edges), 1)
    assert {r.id for r in g.live_nodes().collect()} == {2, 3, 4}
    back = G.push(g, 1)
    assert {r.id for r in back.live_nodes().collect()} == {1, 2, 3, 4, 5}
    got = {(r.id, r.chain, r.idx) for r in G.chains(back).collect()}
    assert got == {(k, 1, k - 1) for k in range(1, 6)}


def test_slice_cuts_where_coverage_changes(spark):
    nodes = spark.createDataFrame([(k, 100, 10.0 if k < 5 else 1000.0, 0.5) for k in range(1, 9)], "id long, seq_len long, cov double, pct_gc double")
    edges = spark.createDataFrame([(k, k + 1, "FB", 5.0, 5.0) for k in range(1, 8)], "n1 long, n2 long, dir string, bits double, score double")
    cut = G.slice_chains(G.new_graph(nodes, edges), 0.5).edges.filter("state = 'removed'").collect()
    assert [(r.n1, r.n2) for r in cut] == [(4, 5)]


def test_insert_puts_a_node_into_its_slot(spark):
    rng = random.Random(0)
    seq = {k: "".join(rng.choices("ACGT", k=200)) for k in (1, 2, 3, 9, 10)}
    seq[11] = seq[2]
    nodes = spark.createDataFrame([(k, 200, "selected" if k < 4 else "removed", s) for k, s in seq.items()], "id long, seq_len long, state string, seq string")
    rows = [(1, 2, "selected"), (2, 3, "selected"), (1, 9, "removed"), (9, 2, "removed"), (10, 1, "removed"), (1, 11, "removed"), (11, 3, "removed")]
    edges = spark.createDataFrame([(a, b, "FB", 900.0, 9.0, s) for a, b, s in rows], "n1 long, n2 long, dir string, bits double, score double, state string")
    got = scaffold.insert(G.Graph(nodes, edges))
    assert {r.id for r in got.live_nodes().collect()} == {1, 2, 3, 9}  # 10 has no link in, 11 repeats 2
    assert {(r.n1, r.n2) for r in got.live_edges().collect()} == {(1, 2), (2, 3), (1, 9), (9, 2)}


def test_circles(spark):
    nodes, edges = dict.fromkeys(range(1, 6), 5000), {(1, 2): 5.0, (2, 3): 5.0, (3, 4): 5.0}
    g = scaffold.scaffold(graph(spark, {k: 5000 for k in range(1, 5)}, edges))
    closing = spark.createDataFrame([(4, 5, "FB", 300.0, 3.0, "removed"), (5, 1, "FB", 200.0, 2.0, "removed")], "n1 long, n2 long, dir string, bits double, score double, state string")
    spare = spark.createDataFrame([(5, 5000, 1.0, 0.5, "removed")], g.nodes.select("id", "seq_len", "cov", "pct_gc", "state").schema)
    g = G.Graph(g.nodes.unionByName(spare), g.edges.unionByName(closing), None, g.scaffolds)
    r = scaffold.circles(g).collect()
    assert [(x.head, x.tail, x.via, x.bits) for x in r] == [(1, 4, 5, 200.0)]
    assert scaffold.open_circle([1, 2, 3], {1: 10, 2: 30, 3: 20}) == ([3, 1], (2, (16, 30), (1, 15)))


def test_merge_and_edit(spark):
    a, b = graph(spark, {1: 5, 2: 5}, {(1, 2): 1.0}), graph(spark, {3: 5}, {})
    assert G.merge([a, b]).nodes.count() == 3
    with pytest.raises(ValueError):
        G.merge([a, a])
    cut = G.cut_node(graph(spark, {1: 100, 2: 5}, {(1, 2): 1.0}), 1, 50, 11, -11, include=[2])
    assert {(r.id, r.seq_len) for r in cut.nodes.collect()} == {(1, 100), (2, 5), (50, 80)}
    assert [(r.n1, r.n2) for r in cut.edges.collect()] == [(50, 2)]


def brute_pnn(ids, counts, lengths, r, r3):
    counts, members = {i: np.array(c, float) for i, c in zip(ids, counts, strict=True)}, {i: [i] for i in ids}
    z = lambda c: (compose._z_matrix(c[None])[0], compose._tri_z(c[None])[0])
    corr = lambda a, b: 0.0 if a.std() == 0 or b.std() == 0 else np.corrcoef(a, b)[0, 1]
    while True:
        best = None
        for i, j in itertools.combinations(sorted(counts), 2):
            (a, a3), (b, b3) = z(counts[i]), z(counts[j])
            if corr(a, b) >= r and corr(a3, b3) >= r3:
                best = max(best or (-9,), (round(corr(a, b), 9), -i, -j))
        if not best or best == (-9,):
            return sorted(sorted(m) for m in members.values() if len(m) > 1)
        i, j = -best[1], -best[2]
        counts[i] = counts[i] + counts.pop(j)
        members[i] += members.pop(j)


def test_clustering_against_brute_force():
    rng = np.random.default_rng(1)
    base = [rng.gamma(0.5, 100, 256) for _ in range(3)]
    counts = [rng.poisson(base[k % 3]) for k in range(12)]
    got = compose.merge_profiles(list(range(12)), counts, [10_000] * 12, lambda _: (0.8, 0.8, 0.5))
    assert sorted(sorted(m) for m in got) == brute_pnn(range(12), counts, None, 0.8, 0.5)


def test_clusters_take_thresholds_by_length(spark):
    rng = random.Random(4)
    one, two = ("".join(rng.choices("ACGT", k=k)) for k in (1500, 2500))
    seqs = spark.createDataFrame([(1, one), (2, one), (3, two), (4, two)], "id long, seq string")
    strict = lambda n: (0.99,) * 3 if n > 2000 else (2.0,) * 3
    found = compose.cluster(seqs, threshold=0.99, min_len=1000, thresholds=strict).collect()
    assert sorted(r.id for r in found) == [3, 4]


def test_composition_by_hand(spark):
    rng = random.Random(9)
    long = "".join(rng.choices("ACGT", k=2000))
    seqs = spark.createDataFrame([(1, "AACCGGTTAACC"), (3, "ACGNACGTACGT")], "id long, seq string")
    counts = {(r.id, r.kmer): r.n for r in compose.kmer_counts(seqs).collect()}
    want = {}
    for i, s in ((1, "AACCGGTTAACC"), (3, "ACGNACGTACGT")):
        for k in range(len(s) - 3):
            w = s[k : k + 4]
            if "N" not in w:
                for x in (w, w.translate(str.maketrans("ACGT", "TGCA"))[::-1]):
                    want[i, x] = want.get((i, x), 0) + 1
    assert counts == want
    seqs = spark.createDataFrame([(1, long), (2, long.translate(str.maketrans("ACGT", "TGCA"))[::-1]), (3, "".join(rng.choices("ACGT", k=2000)))], "id long, seq string")
    pairs = {(r.a, r.b): r.r for r in compose.profile_pairs(compose.z_scores(compose.kmer_counts(seqs)), block=1).collect()}
    assert pairs[1, 2] == pytest.approx(1.0) and len(pairs) == 3 and abs(pairs[1, 3]) < 0.5


def test_layout():
    a, b = "ACGTACGTACGTTTGGCC", "TTGGCCAAAACCCCGGGGAA"
    assert layout.overlap(a, b) == 6
    assert layout.join_contigs([a, b]) == "ACGTACGTACGTttggccAAAACCCCGGGGAA"
    rng = random.Random(3)
    left, gap, right = ("".join(rng.choices("ACGT", k=n)) for n in (100, 40, 100))
    assert layout.heal(left, right, left + gap + right) == left[-5:] + gap + right[:5]
    assert layout.join_contigs([left, right], left + gap + right).upper() == left + gap + right
    turned = (left + gap + right).translate(layout._RC)[::-1]
    assert layout.join_contigs([left, right], turned).upper() == left + gap + right
    joined = layout.join_contigs([left, right])
    assert joined.startswith(left + "n" * 15) and joined.endswith(right) and len(joined) - 200 in (15, 16, 17)
    assert layout.trim_ends("NNACGTACGTACGTNNAACCGGTTAACCNN") == "ACGTACGTACGTNNAACCGGTTAACC"


def test_segments_against_a_scan(spark):
    rng = random.Random(8)
    runs, at = [], 1
    for _ in range(60):
        n = rng.randrange(1, 30)
        runs.append((1, at, at + n, rng.randrange(0, 6)))
        at += n
    base = [d for _, a, b, d in runs for _ in range(a, b)]
    want, total, top, start, end = [], 0.0, 0.0, None, None
    for k, (_, a, b, d) in enumerate(runs):
        gain = (b - a) * (1 if d >= 3 else -1)
        start = a if start is None else start
        total += gain
        if total <= 0:
            if top > 20:
                want.append((start, end, top))
            total, top, start, end = 0.0, 0.0, None, None
        elif total > top:
            top, end = total, b
    if top > 20:
        want.append((start, end, top))
    assert len(base) == at - 1
    df = spark.createDataFrame(runs, "seq_id long, start long, end long, depth long")
    got = [(r.start, r.end, r.score) for r in coverage.segments(df, F.col("depth") >= 3, least=20.0).collect()]
    assert got == want and want


def test_consensus_by_hand(spark):
    rows = [(1, 1, 10.0, 0.0, 0.0, 0.0), (1, 2, 5.0, 0.0, 5.0, 0.0), (1, 3, 0.0, 0.0, 0.0, 0.0), (1, 4, 0.0, 9.0, 0.0, 1.0), (1, 5, 1.0, 1.0, 1.0, 1.0)]
    got = [r.base for r in coverage.consensus(spark.createDataFrame(rows, "seq_id long, pos long, a double, c double, g double, t double")).orderBy("pos").collect()]
    assert got[0] == "A" and got[1] == "R" and got[2] == "N" and got[3] == "C"


def test_duplicate_pairs_by_hand(spark):
    p = "ACGTACGTACGTAC"
    m = lambda s, *at: "".join("T" if k in at and c != "T" else "A" if k in at else c for k, c in enumerate(s))
    rows = [(1, p, p, "IIII", "IIII"), (2, p, p, "JJJJ", "JJJJ"), (3, m(p, 3), m(p, 1, 2, 5), "!!!!", "!!!!"), (4, m(p, 3, 7), p[::-1], "I", "I"), (5, "T" * 14, m(p, 2), "I", "I"), (6, "G" * 14, "C" * 14, "I", "I")]
    df = spark.createDataFrame(rows, "pair_id long, seq1 string, seq2 string, qual1 string, qual2 string")
    assert {r.pair_id for r in reads.drop_duplicate_pairs(df).collect()} == {2, 4, 5, 6}


def test_sampling_keeps_mates_together(spark):
    df = spark.createDataFrame([(k // 2, k % 2 + 1) for k in range(20_000)], "pair_id long, mate long")
    kept = reads.sample(df, 0.1).groupBy("pair_id").count().collect()
    assert all(r["count"] == 2 for r in kept) and abs(len(kept) - 1000) < 150
    assert abs(reads.sample(df, 5000).count() - 5000) < 400


def test_taxonomy(spark):
    lines = spark.createDataFrame([("3*Gamma*1*3*class",), ("1*Bact*0*1*domain",), ("7*Ecol*3*8*genus",), ("0*Root*-1*0*rootrank",), ("bad line",)], "value string")
    taxa = taxonomy.lineages(taxonomy.branch_lengths(taxonomy.parse_training(lines)))
    assert {r.taxid: ("/".join(r.path), r.length) for r in taxa.collect()} == {0: ("Root", 0), 1: ("Root/Bact", 1), 3: ("Root/Bact/Gamma", 2), 7: ("Root/Bact/Gamma/Ecol", 5)}
    tree = spark.createDataFrame([(["a"], 1.0), (["a", "b c"], 2.0), (["d"], 1.0)], "node array<string>, pop double")
    assert "tree tree1 = ((b_c)a,d);" in taxonomy.nexus(tree)




def test_color_consensus(spark):
    """Whatever the first base, the steps between the bases are those of the colours; errors lose."""
    rng = random.Random(6)
    want = "".join(rng.choices("ACGT", k=30))
    steps = [("ACGT".index(a) ^ "ACGT".index(b)) for a, b in itertools.pairwise(want)]
    rows = [(1, k + 1, *[10.0 * (c == s) + 1.0 * (c == (s + 1) % 4) for c in range(4)]) for k, s in enumerate(steps) if k not in (14, 15)]
    df = spark.createDataFrame(rows, "seq_id long, pos long, c0 double, c1 double, c2 double, c3 double")
    got = coverage.color_consensus(df, spark.createDataFrame([(1, 30)], "seq_id long, seq_len long")).first().seq
    assert len(got) == 30 and got[15] == "N"
    for lo, hi in ((0, 15), (16, 30)):
        assert [("ACGT".index(a) ^ "ACGT".index(b)) for a, b in itertools.pairwise(got[lo:hi])] == steps[lo : hi - 1]


def test_color_path_against_enumeration():
    rng = np.random.default_rng(2)
    from quern.functions.sequence import IUPAC_BITS

    scale = 0.5 + 2.5 * 0.2
    near = lambda z: min(1.0, coverage.MATCH[z.bit_count()] * scale)
    through = lambda y, c: sum(1 << (k ^ c) for k in range(4) if y >> k & 1)

    def cost(path, counts):
        total = near(path[0]) * counts[0].sum()
        for (y, z), row in zip(itertools.pairwise(path), counts, strict=True):
            total += sum(w * (near(z) if through(y, c) & z else coverage.MISMATCH[z.bit_count()]) for c, w in enumerate(row))
        return total

    for _ in range(5):
        counts = rng.integers(0, 6, (2, 4)).astype(float) + 0.5
        got = [IUPAC_BITS[c] for c in coverage._color_path(counts, 0.2)]
        best = min(cost(p, counts) for p in itertools.product(range(1, 16), repeat=3))
        assert cost(got, counts) == pytest.approx(best)


def test_new_territory_is_by_a_nodes_own_best_link():
    """3 is seen by a weak link before; its inner bits count beside its best link, not beside that."""
    nodes = [(1, 900), (2, 100), (3, 100), (4, 100)]
    edges = [(1, 2, 900.0), (1, 3, 10.0), (2, 3, 20.0), (3, 4, 800.0)]
    tree = lambda inner, strong=None: {(min(a, b), max(a, b)) for a, b, _ in scaffold.special_tree(nodes, edges, inner, strong=strong)}
    assert tree({3: 1.0}) == {(1, 2), (1, 3), (3, 4)}  # 1 / 800 is little, though 1 / 10 is not
    assert tree({3: 17.0}) == {(1, 2), (2, 3), (3, 4)}
    assert tree({3: 1.0}, {2: 900.0, 3: 20.0, 4: 800.0, 1: 900.0}) == {(1, 2), (2, 3), (3, 4)}  # bits differ from scores


def test_fixed_length_caps_what_the_quality_leaves(spark):
    df = spark.createDataFrame([(1, "ACGTAC", "!!!!!!"), (2, "ACGTAC", "IIIIII"), (3, "ACGTAC", "III!!!"), (4, "ACG", "III")], "read_id long, seq string, qual string")
    got = {r.read_id: (r.trim_len, r.seq, r.qual) for r in reads.trim(df, 0.5, fixed_len=4).collect()}
    assert got == {2: (4, "ACGT", "IIII")}
    got = {r.read_id: r.trim_len for r in reads.trim(df, 0.0, fixed_len=3).collect()}
    assert got == {1: 3, 2: 3, 3: 3, 4: 3}


def test_duplicate_pairs_with_two_index_errors(spark):
    rng = random.Random(8)
    own = ["".join(rng.choices("ACGT", k=14)) for _ in range(12)]

    def change(s, n):
        where = set(rng.sample(range(14), n))
        return "".join(rng.choice("ACGT") if k in where else c for k, c in enumerate(s))

    pairs = [(k, change(rng.choice(own), rng.randrange(4)), change(rng.choice(own), rng.randrange(5))) for k in range(250)]
    far = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True))
    for index, match in ((1, 3), (2, 3), (0, 2)):
        want = {(a, b) for (a, p, q), (b, r, s) in itertools.combinations(pairs, 2) if far(p, r) <= index and far(q, s) <= match or far(q, s) <= index and far(p, r) <= match}
        found = reads.duplicate_pairs(spark.createDataFrame(pairs, "pair_id long, seq1 string, seq2 string"), 14, index, match).collect()
        up = {k: k for k, *_ in pairs}

        def root(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        groups = []
        for links in ([(r.a, r.b) for r in found], want):
            up = {k: k for k, *_ in pairs}
            for a, b in links:
                x, y = sorted((root(a, up), root(b, up)))
                up[y] = x
            groups.append({k: root(k, up) for k in up})
        assert groups[0] == groups[1]
        assert {(r.a, r.b) for r in found} <= want


def test_chains_are_cut_until_none_is_bad(spark):
    n = 9
    nodes = spark.createDataFrame([(k, 100, 0.9 if k % 2 else 0.1, float(10 ** (k % 3))) for k in range(n)], "id long, seq_len long, pct_gc double, cov double")
    edges = spark.createDataFrame([(k, k + 1, "FB", 10.0, 10.0) for k in range(n - 1)], "n1 long, n2 long, dir string, bits double, score double")
    assert G.slice_chains(G.new_graph(nodes, edges), 0.01).live_edges().count() == 0


def test_deep_lineages(spark):
    taxa = spark.createDataFrame([(k, f"t{k}", k - 1) for k in range(70)] + [(200, "x", 201), (201, "y", 200)], "taxid long, name string, parent long")
    got = {r.taxid: r.path for r in taxonomy.lineages(taxa).collect()}
    assert got[69] == [f"t{k}" for k in range(70)] and 200 not in got
