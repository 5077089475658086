"""Sequence-graph operators.

A graph is two DataFrames: nodes (``id, seq_len, ...``) and edges (``n1, n2, dir,
bits, score, ...``), each with a ``state`` of ``selected`` or ``removed``: nothing
is deleted, so later steps can bring it back. Directed operators read an edge
as n1 -> n2.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern import scratch
from quern.functions import sequence as S

SELECTED, REMOVED = "selected", "removed"


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", broadcast_rows: int = 1_000_000) -> DataFrame:
    """``node, component`` for every node of an edge list: the smallest node it can reach.

    Alternates large-star and small-star, each an aggregation and a join back,
    until nothing changes: a logarithmic number of rounds for chains of any length.
    What is joined back is a table: sent to all tasks up to ``broadcast_rows``, and
    beyond joined by a shuffle in which a hub's rows can be split.
    """
    given = scratch.table(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    now, most = given.filter("u <> v"), None

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = state(now)
    most = 2 * seen[0]
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.table(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")), "least", most)
        large = both.filter("v > u").join(scratch.sized(least, broadcast_rows), F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.table(large.filter("u <> v").distinct(), "large", most)
        low = scratch.table(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w"), "low", most)
        small = large.join(scratch.sized(low, broadcast_rows), F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("w").alias("u"), F.col("m").alias("v")))
        now = scratch.table(small.filter("u <> v").distinct(), "edges", most)
        if (after := state(now)) == seen:
            break
        seen = after
    # A star now: every node but the smallest of its component points to that.
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")))
    loops = given.filter("u = v").select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))


@dataclass(frozen=True)
class Graph:
    """Nodes and edges with their states, and what later commands derive from them."""

    nodes: DataFrame
    edges: DataFrame
    components: DataFrame | None = None
    scaffolds: DataFrame | None = None
    clusters: DataFrame | None = None
    history: tuple[str, ...] = ()

    def live_nodes(self) -> DataFrame:
        return self.nodes.filter(F.col("state") == SELECTED)

    def live_edges(self) -> DataFrame:
        return self.edges.filter(F.col("state") == SELECTED)


def new_graph(nodes: DataFrame, edges: DataFrame) -> Graph:
    """A graph with everything selected, where no state is given."""
    mark = lambda df: df if "state" in df.columns else df.withColumn("state", F.lit(SELECTED))
    return Graph(mark(nodes), mark(edges))


def _where(df: DataFrame, test: Column, state: str) -> DataFrame:
    return df.withColumn("state", F.when(F.coalesce(test, F.lit(False)), state).otherwise(F.col("state")))


def filter_edges(g: Graph, thresh: float = 500.0) -> Graph:
    """Edges of fewer bits go to the removed pool."""
    return replace(g, edges=_where(g.edges, F.col("bits") < thresh, REMOVED), components=None)


def components(g: Graph, sortby: str = "nodes") -> Graph:
    """Numbers components from 1 by their nodes, or by their sequence, largest first."""
    live = g.live_nodes()
    label = connected_components(g.live_edges(), "n1", "n2")
    found = live.select("id", "seq_len").join(label, F.col("id") == F.col("node"), "left").select("id", "seq_len", F.coalesce("component", "id").alias("component"))
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("nodes"), F.sum("seq_len").alias("sequence"))
    ranked = scratch.numbered(sizes, "ccnum", F.desc("sequence" if sortby == "sequences" else "nodes"), F.asc("component"))
    return replace(g, components=found.join(ranked, "component").select("id", "seq_len", "component", "ccnum", "nodes", "sequence"), scaffolds=None)


def spanning_forest(g: Graph, weight: str = "score") -> Graph:
    """Maximal spanning forest in Boruvka rounds; the other edges are removed.

    Equal weights are ordered by the end nodes, so the forest is unique. A round
    lets every component choose its best edge out and at least halves them.
    """
    live = scratch.table(g.live_edges().select(F.least("n1", "n2").alias("a"), F.greatest("n1", "n2").alias("b"), F.col(weight).cast("double").alias("w")).filter("a <> b").groupBy("a", "b").agg(F.max("w").alias("w")), "live")
    label = live.select(F.col("a").alias("node")).unionByName(live.select(F.col("b").alias("node"))).distinct().withColumn("component", F.col("node"))
    forest = None
    while True:
        la, lb = label.select(F.col("node").alias("a"), F.col("component").alias("ca")), label.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        across = live.join(la, "a").join(lb, "b").filter("ca <> cb")
        best = F.min_by(F.struct("a", "b", "ca", "cb"), F.struct(-F.col("w"), "a", "b")).alias("e")
        chosen = across.select(F.col("ca").alias("c"), "a", "b", "ca", "cb", "w").unionByName(across.select(F.col("cb").alias("c"), "a", "b", "ca", "cb", "w")).groupBy("c").agg(best)
        chosen = scratch.table(chosen.select("e.*").distinct(), "chosen")
        if chosen.isEmpty():
            break
        forest = chosen.select("a", "b") if forest is None else forest.unionByName(chosen.select("a", "b"))
        merged = connected_components(chosen, "ca", "cb").select(F.col("node").alias("old"), F.col("component").alias("new"))
        label = scratch.table(label.join(merged, F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component")), "label")
    if forest is None:
        return replace(g, components=None)
    kept = forest.select(F.col("a").alias("fa"), F.col("b").alias("fb"), F.lit(True).alias("kept"))
    top = Window.partitionBy(F.least("n1", "n2"), F.greatest("n1", "n2"), "state").orderBy(F.desc(weight), "n1", "n2")
    joined = g.edges.withColumn("_top", F.row_number().over(top)).join(kept, (F.least("n1", "n2") == F.col("fa")) & (F.greatest("n1", "n2") == F.col("fb")), "left")
    gone = (F.col("state") == SELECTED) & (F.col("kept").isNull() | (F.col("_top") > 1))
    return replace(g, edges=_where(joined, gone, REMOVED).drop("fa", "fb", "kept", "_top"), components=None)


def make_directed(g: Graph) -> Graph:
    """Gives each node of a forest a strand and turns edges to n1 -> n2, starting at each component's longest node.

    Breadth first: a round joins the frontier to its edges. An FB edge leaves the
    front of n1 and enters the back of n2; FF and BB join equal ends, so one of the
    nodes is on the other strand. Ends' positions on such a node are counted from
    its other end, and its sequence, if there is one, is reverse-complemented.
    """
    g = g if g.components is not None else components(g)
    first = Window.partitionBy("component").orderBy(F.desc("seq_len"), "id")
    done = scratch.table(g.components.withColumn("_r", F.row_number().over(first)).filter("_r = 1").select("id", F.lit(True).alias("fwd")), "strands")
    live = g.live_edges().select("n1", "n2", "dir")
    frontier = done
    while True:
        out = live.join(frontier, F.col("n1") == F.col("id")).select(F.col("n2").alias("id"), F.when(F.col("dir") == "FB", F.col("fwd")).otherwise(~F.col("fwd")).alias("fwd"))
        back = live.join(frontier, F.col("n2") == F.col("id")).select(F.col("n1").alias("id"), F.when(F.col("dir") == "FB", F.col("fwd")).otherwise(~F.col("fwd")).alias("fwd"))
        new = out.unionByName(back).join(done.select("id"), "id", "left_anti").groupBy("id").agg(F.min("fwd").alias("fwd"))
        frontier = scratch.table(new, "frontier")
        if frontier.isEmpty():
            break
        done = scratch.table(done.unionByName(frontier), "strands")
    nodes = g.nodes.join(done, "id", "left")
    strand = done.select("id", "fwd")
    s1, s2 = strand.withColumnRenamed("id", "i1").withColumnRenamed("fwd", "f1"), strand.withColumnRenamed("id", "i2").withColumnRenamed("fwd", "f2")
    edges = g.edges.join(s1, F.col("n1") == F.col("i1"), "left").join(s2, F.col("n2") == F.col("i2"), "left")
    agrees = F.when(F.col("dir") == "FB", F.col("f1") == F.col("f2")).otherwise(F.col("f1") != F.col("f2"))
    # n1 is left at its front, in the component's direction, if it is forward and the edge is at its front.
    leaves = F.when(F.col("dir").isin("FB", "FF"), F.col("f1")).otherwise(~F.col("f1"))
    turn = agrees & ~leaves
    select = [c for c in g.edges.columns if c not in ("n1", "n2", "dir")]
    edges = edges.select(
        F.when(turn, F.col("n2")).otherwise(F.col("n1")).alias("n1"),
        F.when(turn, F.col("n1")).otherwise(F.col("n2")).alias("n2"),
        F.when(agrees, "forward").otherwise(F.col("dir")).alias("dir"),
        F.col("dir").alias("org_dir"),
        *[c for c in select if c != "org_dir"],
    )
    if "seq" in nodes.columns:
        nodes = nodes.withColumn("seq", F.when(~F.col("fwd"), S.reverse_complement(F.col("seq"))).otherwise(F.col("seq")))
    return replace(g, nodes=nodes.drop("fwd") if "fwd" in g.nodes.columns else nodes, edges=edges)


def _degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("n1").alias("id")).unionByName(edges.select(F.col("n2").alias("id")))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def pluck(g: Graph, iterate: int = 3) -> Graph:
    """Removes nodes with one link, ``iterate`` times; nodes without any in the first round.

    Removed edges carry the round in ``plucked``.
    """
    nodes = g.nodes
    edges = g.edges if "plucked" in g.edges.columns else g.edges.withColumn("plucked", F.lit(None).cast("int"))
    for k in range(1, iterate + 1):
        live = edges.filter(F.col("state") == SELECTED)
        degree = nodes.filter(F.col("state") == SELECTED).select("id").join(_degrees(live), "id", "left")
        leaf = degree.filter((F.col("degree") == 1) if k > 1 else (F.coalesce("degree", F.lit(0)) <= 1)).select(F.col("id").alias("leaf"))
        leaf = scratch.table(leaf, "leaves")
        if leaf.isEmpty():
            break
        mark = leaf.withColumn("is_leaf", F.lit(True))
        nodes = scratch.table(_where(nodes.join(mark, F.col("id") == F.col("leaf"), "left"), F.col("is_leaf"), REMOVED).drop("leaf", "is_leaf"), "nodes")
        touched = edges.join(mark.select(F.col("leaf").alias("l1"), F.lit(True).alias("m1")), F.col("n1") == F.col("l1"), "left").join(mark.select(F.col("leaf").alias("l2"), F.lit(True).alias("m2")), F.col("n2") == F.col("l2"), "left")
        hit = (F.col("state") == SELECTED) & (F.col("m1").isNotNull() | F.col("m2").isNotNull())
        touched = touched.withColumn("plucked", F.when(hit, F.lit(k)).otherwise(F.col("plucked")))
        edges = scratch.table(_where(touched, hit, REMOVED).drop("l1", "m1", "l2", "m2"), "edges")
    return replace(g, nodes=nodes, edges=edges, components=None)


def prune(g: Graph, strict: bool = False, ratio: float = 0.2) -> Graph:
    """Keeps each node's best link in and best link out.

    With ``strict``, where a node has more than two links and the second best on a
    side scores over ``ratio`` of the best, its weaker remaining link goes too and
    the node is marked ``no_push``.
    """
    live = g.live_edges().withColumn("_e", F.struct("n1", "n2"))
    rank = lambda end: F.row_number().over(Window.partitionBy(end).orderBy(F.desc("score"), "n1", "n2"))
    ranked = live.withColumn("_out", rank("n1")).withColumn("_in", rank("n2"))
    keep = ranked.filter("_out = 1 AND _in = 1").select("n1", "n2", "score")
    nodes = g.nodes
    if strict:
        def side(end: str, r: str) -> DataFrame:
            return ranked.groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("links"), F.max(F.when(F.col(r) == 1, F.col("score"))).alias("best"), F.max(F.when(F.col(r) == 2, F.col("score"))).alias("second"))

        o, i = side("n1", "_out"), side("n2", "_in")
        both = o.select("id", F.col("links").alias("lo"), (F.col("second") / F.col("best")).alias("ro"), F.col("best").alias("bo")).join(i.select("id", F.col("links").alias("li"), (F.col("second") / F.col("best")).alias("ri"), F.col("best").alias("bi")), "id", "full_outer")
        bad = both.filter((F.coalesce("lo", F.lit(0)) + F.coalesce("li", F.lit(0)) > 2) & ((F.coalesce("ro", F.lit(0.0)) > ratio) | (F.coalesce("ri", F.lit(0.0)) > ratio)))
        bad = scratch.table(bad.select("id", F.when(F.coalesce("bo", F.lit(float("inf"))) <= F.coalesce("bi", F.lit(float("inf"))), "out").otherwise("in").alias("weak")), "ambiguous")
        keep = keep.join(bad.filter("weak = 'out'").select(F.col("id").alias("n1")), "n1", "left_anti").join(bad.filter("weak = 'in'").select(F.col("id").alias("n2")), "n2", "left_anti")
        flag = bad.select("id", F.lit(True).alias("no_push"))
        nodes = (nodes.drop("no_push") if "no_push" in nodes.columns else nodes).join(flag, "id", "left")
    mark = keep.select(F.col("n1").alias("k1"), F.col("n2").alias("k2"), F.lit(True).alias("kept"))
    joined = g.edges.join(mark, (F.col("n1") == F.col("k1")) & (F.col("n2") == F.col("k2")), "left")
    edges = _where(joined, (F.col("state") == SELECTED) & F.col("kept").isNull(), REMOVED).drop("k1", "k2", "kept")
    return replace(g, nodes=nodes, edges=edges, components=None)


def push(g: Graph, iterate: int = 3) -> Graph:
    """Grows heads and tails by one plucked node a round: the best edge of the latest pluck, unless ``no_push``."""
    nodes, edges = g.nodes, g.edges
    for _ in range(iterate):
        h = Graph(nodes, edges)
        ends = linear_ends(h)
        if "no_push" in nodes.columns:
            ends = ends.join(nodes.filter("no_push").select("id"), "id", "left_anti")
        spare = edges.filter((F.col("state") == REMOVED) & F.col("plucked").isNotNull())
        absent = nodes.filter(F.col("state") == REMOVED).select(F.col("id").alias("new"))
        tail = spare.join(ends.filter("is_tail").select(F.col("id").alias("end")), F.col("n1") == F.col("end")).withColumn("new", F.col("n2"))
        head = spare.join(ends.filter("is_head").select(F.col("id").alias("end")), F.col("n2") == F.col("end")).withColumn("new", F.col("n1"))
        offers = tail.withColumn("side", F.lit("t")).unionByName(head.withColumn("side", F.lit("h"))).join(absent, "new")
        best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("plucked"), F.desc("score"), "n1", "n2"))
        chosen = offers.withColumn("_r", best("end", "side")).filter("_r = 1").withColumn("_s", best("new")).filter("_s = 1")
        chosen = scratch.table(chosen.select(F.col("n1").alias("c1"), F.col("n2").alias("c2"), F.col("new").alias("c")), "pushed")
        if chosen.isEmpty():
            break
        came = chosen.select("c", F.lit(True).alias("back")).distinct()
        nodes = scratch.table(_where(nodes.join(came, F.col("id") == F.col("c"), "left"), F.col("back"), SELECTED).drop("c", "back"), "nodes")
        mark = chosen.select("c1", "c2", F.lit(True).alias("back"))
        edges = scratch.table(_where(edges.join(mark, (F.col("n1") == F.col("c1")) & (F.col("n2") == F.col("c2")), "left"), F.col("back"), SELECTED).drop("c1", "c2", "back"), "edges")
    return replace(g, nodes=nodes, edges=edges, components=None)


def linear_ends(g: Graph) -> DataFrame:
    """Selected nodes without links in (heads) or out (tails)."""
    live = g.live_edges()
    ins, outs = live.select(F.col("n2").alias("id")).distinct().withColumn("i", F.lit(True)), live.select(F.col("n1").alias("id")).distinct().withColumn("o", F.lit(True))
    both = g.live_nodes().select("id").join(ins, "id", "left").join(outs, "id", "left")
    return both.select("id", F.col("i").isNull().alias("is_head"), F.col("o").isNull().alias("is_tail")).filter("is_head OR is_tail")


def chains(g: Graph) -> DataFrame:
    """``id, chain, idx`` for graphs where every node has at most one link in and one out; chains start at heads.

    Pointer jumping: each round doubles the distance known to the head.
    """
    live = g.live_edges().select(F.col("n2").alias("id"), F.col("n1").alias("up"))
    at = g.live_nodes().select("id").join(live, "id", "left").select("id", F.coalesce("up", "id").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("d"))
    at = scratch.table(at, "chains")
    most = max(1, at.count())
    steps = 1
    while steps < most:
        above = at.select(F.col("id").alias("i"), F.col("up").alias("u"), F.col("d").alias("e"))
        further = scratch.table(at.join(above, F.col("up") == F.col("i")).select("id", F.col("u").alias("up"), (F.col("d") + F.col("e")).alias("d")), "chains")
        if further.join(at.select("id", F.col("up").alias("old")), "id").filter("up <> old").isEmpty():
            break
        at, steps = further, steps * 2
    return at.select("id", F.col("up").alias("chain"), F.col("d").alias("idx"))


def slice_chains(g: Graph, thresh: float = 0.5) -> Graph:
    """Cuts each chain at its worst edge, again and again, until none is over ``thresh``.

    A round cuts every chain that has such an edge, so there are as many as the
    most cuts that follow from one another.

    An edge is as bad as the share of its bits that the difference between the
    means of GC and coverage before it and after it takes away.
    """
    edges = g.edges
    while True:
        h = Graph(g.nodes, edges)
        placed = chains(h).join(g.nodes.select("id", "seq_len", "pct_gc", "cov"), "id")
        by = Window.partitionBy("chain").orderBy("idx")
        up, down = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(1, Window.unboundedFollowing)
        mean = lambda c, w: F.sum(F.col(c) * F.col("seq_len")).over(w) / F.sum("seq_len").over(w)
        cut = placed.select("chain", "id", "idx", mean("pct_gc", up).alias("g1"), mean("pct_gc", down).alias("g2"), mean("cov", up).alias("c1"), mean("cov", down).alias("c2"))
        loss = 0.08 * F.abs(F.col("g1") - F.col("g2")) + 0.125 * F.abs(F.log("c1") - F.log("c2"))
        worst = F.row_number().over(Window.partitionBy("chain").orderBy(F.desc("loss"), "idx"))
        bad = cut.withColumn("loss", loss).filter(F.col("loss") > thresh).withColumn("_r", worst).filter("_r = 1")
        bad = scratch.table(bad.select(F.col("id").alias("b"), F.lit(True).alias("cut")), "cuts")
        if bad.isEmpty():
            break
        joined = edges.join(bad, (F.col("n1") == F.col("b")) & (F.col("state") == SELECTED), "left")
        edges = scratch.table(_where(joined, F.col("cut"), REMOVED).drop("b", "cut"), "edges")
    return replace(g, edges=edges, components=None)


def neighbourhood(g: Graph, ids: DataFrame, radius: int) -> DataFrame:
    """Nodes within ``radius`` links of the given ones; one join a step."""
    live = g.live_edges()
    near = ids.select("id").distinct()
    for _ in range(radius):
        out = live.join(near, F.col("n1") == F.col("id")).select(F.col("n2").alias("id"))
        back = live.join(near, F.col("n2") == F.col("id")).select(F.col("n1").alias("id"))
        near = scratch.table(near.unionByName(out).unionByName(back).distinct(), "near")
    return near


def select_nodes(g: Graph, ids: DataFrame, radius: int = 0) -> Graph:
    """Only the nodes within ``radius`` links of the given ones stay selected, with the edges between them."""
    near = neighbourhood(g, ids, radius).select(F.col("id").alias("k"), F.lit(True).alias("near"))
    return _restrict(g, near)


def _restrict(g: Graph, near: DataFrame) -> Graph:
    nodes = _where(g.nodes.join(near, F.col("id") == F.col("k"), "left"), F.col("near").isNull(), REMOVED).drop("k", "near")
    e = g.edges.join(near.select(F.col("k").alias("k1"), F.lit(True).alias("m1")), F.col("n1") == F.col("k1"), "left").join(near.select(F.col("k").alias("k2"), F.lit(True).alias("m2")), F.col("n2") == F.col("k2"), "left")
    edges = _where(e, F.col("m1").isNull() | F.col("m2").isNull(), REMOVED).drop("k1", "k2", "m1", "m2")
    return replace(g, nodes=nodes, edges=edges, components=None)


def select_components(
    g: Graph,
    ccnums: list[int] | None = None,
    names: list | None = None,
    ccrange: tuple[int, int] | None = None,
    shift: int = 0,
    min_nodes: int = 0,
    min_seqlen: int = 0,
    sequences: list[str] | None = None,
) -> Graph:
    """Keeps components by number, member, range (negative counts from the end), size or contained sequence."""
    g = g if g.components is not None else components(g)
    cc = g.components
    test = (F.col("nodes") >= min_nodes) & (F.col("sequence") >= min_seqlen)
    if ccnums:
        test &= F.col("ccnum").isin([n + shift for n in ccnums])
    if ccrange:
        most = cc.agg(F.max("ccnum")).first()[0] or 0
        lo, hi = (most + 1 + x if x < 0 else x for x in ccrange)
        test &= F.col("ccnum").between(lo + shift, hi + shift)
    kept = cc.filter(test)
    if names:
        kept = kept.join(cc.filter(F.col("id").isin(names)).select("component").distinct(), "component", "left_semi")
    if sequences:
        with_seq = find_sequences(g.nodes, sequences).select("id").distinct()
        kept = kept.join(cc.join(with_seq, "id", "left_semi").select("component").distinct(), "component", "left_semi")
    return _restrict(g, kept.select(F.col("id").alias("k"), F.lit(True).alias("near")))


def select_clusters(g: Graph, numbers: list[int] | None = None, shift: int = 0) -> Graph:
    """Keeps the nodes of the chosen clusters (``id, cluster_id``)."""
    kept = g.clusters if numbers is None else g.clusters.filter(F.col("cluster_id").isin([n + shift for n in numbers]))
    return _restrict(g, kept.select(F.col("id").alias("k"), F.lit(True).alias("near")).distinct())


def find_sequences(nodes: DataFrame, sequences: list[str]) -> DataFrame:
    """``id, pattern`` of the nodes whose sequence has a pattern on either strand; the patterns are an argument, so few."""
    wanted = F.array(*[F.lit(s) for s in sequences])
    hit = F.filter(wanted, lambda s: F.contains(F.col("seq"), s) | F.contains(F.col("seq"), S.reverse_complement(s)))
    return nodes.select("id", F.explode(hit).alias("pattern"))


def relink(g: Graph, ids: DataFrame | None = None, thresh: float = 0.0, existing: bool = False, radius: int = 0, complete: bool = False, ends: bool = False) -> Graph:
    """Brings back removed edges of at least ``thresh`` bits that touch the given nodes, and the nodes at their ends.

    * ``ids`` of None are all selected nodes; ``ends`` adds the heads and tails of
      chains to them, or stands for them alone where no ids are given.
    * ``radius`` widens them by as many steps over selected edges first.
    * With ``existing`` only edges between selected nodes come back; with ``complete``
      so do, after that, all edges between nodes that are selected by then.
    """
    if ends:
        tips = linear_ends(g).select("id")
        ids = tips if ids is None else ids.select("id").unionByName(tips)
    ids = g.live_nodes().select("id") if ids is None else ids
    ids = neighbourhood(g, ids, radius) if radius else ids
    around = ids.select(F.col("id").alias("k")).distinct()
    touch = g.edges.filter((F.col("state") == REMOVED) & (F.col("bits") >= thresh))
    hit = touch.join(around, F.col("n1") == F.col("k"), "left_semi").unionByName(touch.join(around, F.col("n2") == F.col("k"), "left_semi")).select("n1", "n2").distinct()
    if existing:
        live = g.live_nodes().select(F.col("id").alias("l"))
        hit = hit.join(live, F.col("n1") == F.col("l"), "left_semi").join(live, F.col("n2") == F.col("l"), "left_semi")
    hit = scratch.table(hit, "relinked")
    mark = hit.select(F.col("n1").alias("h1"), F.col("n2").alias("h2"), F.lit(True).alias("back"))
    edges = _where(g.edges.join(mark, (F.col("n1") == F.col("h1")) & (F.col("n2") == F.col("h2")), "left"), F.col("back"), SELECTED).drop("h1", "h2", "back")
    came = hit.select(F.col("n1").alias("k")).unionByName(hit.select(F.col("n2").alias("k"))).distinct().withColumn("back", F.lit(True))
    nodes = _where(g.nodes.join(came, F.col("id") == F.col("k"), "left"), F.col("back"), SELECTED).drop("k", "back")
    back = replace(g, nodes=nodes, edges=edges, components=None)
    if complete and not existing:
        back = relink(back, None, thresh, existing=True)
    return back


def edit(g: Graph, add_nodes: DataFrame | None = None, add_edges: DataFrame | None = None, rem_nodes: list | None = None, rem_edges: list[tuple] | None = None) -> Graph:
    """Selects nodes, then edges, then removes nodes with their edges, then edges."""
    nodes, edges = g.nodes, g.edges
    if add_nodes is not None:
        nodes = nodes.join(add_nodes.select("id"), "id", "left_anti").unionByName(add_nodes.withColumn("state", F.lit(SELECTED)), allowMissingColumns=True)
    if add_edges is not None:
        edges = edges.join(add_edges.select("n1", "n2"), ["n1", "n2"], "left_anti").unionByName(add_edges.withColumn("state", F.lit(SELECTED)), allowMissingColumns=True)
    if rem_nodes:
        nodes = _where(nodes, F.col("id").isin(rem_nodes), REMOVED)
        edges = _where(edges, F.col("n1").isin(rem_nodes) | F.col("n2").isin(rem_nodes), REMOVED)
    if rem_edges:
        pair = F.array(*[F.struct(F.lit(a).alias("n1"), F.lit(b).alias("n2")) for a, b in rem_edges])
        edges = _where(edges, F.array_contains(pair, F.struct("n1", "n2")), REMOVED)
    return replace(g, nodes=nodes, edges=edges, components=None)


def cut_node(g: Graph, node, new_name, begin: int, end: int, include: list | None = None) -> Graph:  # noqa: ANN001
    """A new node from bases ``begin`` to ``end`` of another, both counted from 1 and included, negative from the end.

    Edges to the nodes in ``include`` move to the new node, their positions on it
    counted from its start.
    """
    length = F.col("seq_len")
    b = F.lit(begin) if begin >= 0 else length + begin + 1
    e = F.lit(end) if end >= 0 else length + end + 1
    source = g.nodes.filter(F.col("id") == node)
    cut = source.withColumn("id", F.lit(new_name).cast(dict(g.nodes.dtypes)["id"])).withColumn("_l", e - b + 1)
    if "seq" in g.nodes.columns:
        cut = cut.withColumn("seq", F.substring("seq", b.cast("int"), F.col("_l").cast("int")))
    cut = cut.withColumn("seq_len", F.col("_l").cast(dict(g.nodes.dtypes)["seq_len"])).drop("_l")
    edges = g.edges
    if include:
        name = F.lit(new_name).cast(dict(g.nodes.dtypes)["id"])
        from_, to = (F.col("n1") == node) & F.col("n2").isin(include), (F.col("n2") == node) & F.col("n1").isin(include)
        start = begin if begin >= 0 else 0
        if "p1" in edges.columns:
            edges = edges.withColumn("p1", F.when(from_, F.greatest(F.col("p1") - start, F.lit(0))).otherwise(F.col("p1"))).withColumn("p2", F.when(to, F.greatest(F.col("p2") - start, F.lit(0))).otherwise(F.col("p2")))
        edges = edges.select(*[F.when(from_, name).otherwise(F.col("n1")).alias("n1") if c == "n1" else F.when(to, name).otherwise(F.col("n2")).alias("n2") if c == "n2" else F.col(c) for c in edges.columns])
    return replace(g, nodes=g.nodes.unionByName(cut), edges=edges, components=None)


def merge(graphs: list[Graph]) -> Graph:
    """The union of graphs without common nodes; common ones are an error."""
    nodes = graphs[0].nodes
    edges = graphs[0].edges
    for g in graphs[1:]:
        both = nodes.select("id").intersect(g.nodes.select("id"))
        if not both.isEmpty():
            raise ValueError(f"nodes in more than one graph: {[r[0] for r in both.limit(5).collect()]}")
        nodes, edges = nodes.unionByName(g.nodes, allowMissingColumns=True), edges.unionByName(g.edges, allowMissingColumns=True)
    return Graph(nodes, edges)


def graft_edges(g: Graph, other: Graph, stats: tuple[str, ...] = ("mp_pairs", "mp_sh", "mp_fwd", "mp_bwd")) -> Graph:
    """The first graph with the second one's edges between its nodes, and its mate statistics."""
    own = [c for c in stats if c in other.nodes.columns]
    nodes = g.nodes.drop(*own).join(other.nodes.select("id", *own), "id", "left") if own else g.nodes
    ids = g.nodes.select(F.col("id").alias("k"))
    edges = other.edges.join(ids, F.col("n1") == F.col("k"), "left_semi").join(ids, F.col("n2") == F.col("k"), "left_semi")
    return replace(g, nodes=nodes, edges=edges, components=None)


def shared_neighbours(edges: DataFrame, thresh: float = 0.0) -> DataFrame:
    """``a, b, via, bits``: nodes joined through a third one by two links over ``thresh``; the weaker counts."""
    strong = edges.filter(F.col("bits") > thresh)
    ends = strong.select(F.col("n1").alias("x"), F.col("n2").alias("via"), "bits").unionByName(strong.select(F.col("n2").alias("x"), F.col("n1").alias("via"), "bits"))
    left, right = ends.select(F.col("x").alias("a"), "via", F.col("bits").alias("ba")), ends.select(F.col("x").alias("b"), "via", F.col("bits").alias("bb"))
    return left.join(right, "via").filter("a < b").groupBy("a", "b").agg(F.max_by("via", F.struct(F.least("ba", "bb"), F.col("via"))).alias("via"), F.max(F.least("ba", "bb")).alias("bits"))


def states(g: Graph) -> DataFrame:
    """``what, a, b, state`` of every node and edge; a node has no ``b``."""
    kind = dict(g.nodes.dtypes)["id"]
    nodes = g.nodes.select(F.lit("node").alias("what"), F.col("id").alias("a"), F.lit(None).cast(kind).alias("b"), "state")
    return nodes.unionByName(g.edges.select(F.lit("edge").alias("what"), F.col("n1").alias("a"), F.col("n2").alias("b"), "state"))


def scaffold_links(g: Graph, scaffolds: DataFrame, thresh: float = 1000.0) -> DataFrame:
    """Links of at least ``thresh`` bits, of any state, between ends of different scaffolds (``scaffold_id, nodes``)."""
    ends = scaffolds.select("scaffold_id", F.explode(F.array(F.struct(F.element_at("nodes", 1).alias("id"), F.lit("head").alias("end")), F.struct(F.element_at("nodes", -1).alias("id"), F.lit("tail").alias("end")))).alias("e")).select("scaffold_id", "e.*").distinct()
    x = ends.select(F.col("scaffold_id").alias("s1"), F.col("id").alias("n1"), F.col("end").alias("end1"))
    y = ends.select(F.col("scaffold_id").alias("s2"), F.col("id").alias("n2"), F.col("end").alias("end2"))
    return g.edges.filter(F.col("bits") >= thresh).select("n1", "n2", "bits").join(x, "n1").join(y, "n2").filter("s1 <> s2").select("s1", "end1", "s2", "end2", "n1", "n2", "bits")


def sequence_stats(nodes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Count, total length, N50, the longest sequence, and GC and coverage weighted by length."""
    keys = by or []
    order = Window.partitionBy(*keys).orderBy(F.desc("seq_len"), "id")
    running = nodes.withColumn("_run", F.sum("seq_len").over(order)).withColumn("_all", F.sum("seq_len").over(Window.partitionBy(*keys)))
    weighted = lambda c: (F.sum(F.col(c) * F.col("seq_len")) / F.sum("seq_len")).alias(f"mean_{c}")
    aggs = [
        F.count(F.lit(1)).alias("nodes"),
        F.sum("seq_len").alias("total_len"),
        F.max(F.when(F.col("_run") * 2 >= F.col("_all"), F.col("seq_len"))).alias("n50"),
        F.max("seq_len").alias("max_len"),
        F.min_by("id", F.struct(-F.col("seq_len"), F.col("id"))).alias("longest"),
        *[weighted(c) for c in ("pct_gc", "cov") if c in nodes.columns],
    ]
    return running.groupBy(*keys).agg(*aggs) if keys else running.agg(*aggs)


def graph_stats(g: Graph) -> DataFrame:
    """Nodes and edges by state."""
    n = g.nodes.groupBy("state").agg(F.count(F.lit(1)).alias("n")).select(F.lit("nodes").alias("what"), "state", "n")
    e = g.edges.groupBy("state").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edges").alias("what"), "state", "n")
    return n.unionByName(e)
