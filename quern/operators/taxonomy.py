"""Taxonomy: from training lines and classified reads to trees with abundances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern import scratch

#: Levels of the ranks.
RANKS = {"rootrank": 0, "norank": 0, "domain": 1, "phylum": 2, "class": 3, "subclass": 4, "order": 5, "suborder": 6, "family": 7, "genus": 8, "species": 9}


def parse_training(lines: DataFrame) -> DataFrame:
    """``taxid, name, parent, level, rank`` of lines ``taxid*name*parent*level*rank``, in any order."""
    part = F.split("value", r"\*")
    return lines.filter(F.size(part) == 5).select(
        part[0].cast("long").alias("taxid"), part[1].alias("name"), part[2].cast("long").alias("parent"), part[3].cast("int").alias("level"), F.trim(part[4]).alias("rank")
    )


def branch_lengths(taxa: DataFrame) -> DataFrame:
    """Adds ``length``: how many levels below its parent a taxon is, 0 for roots."""
    up = taxa.select(F.col("taxid").alias("p"), F.col("level").alias("up"))
    return taxa.join(up, F.col("parent") == F.col("p"), "left").withColumn("length", F.coalesce(F.col("level") - F.col("up"), F.lit(0))).drop("p", "up")


def lineages(taxa: DataFrame) -> DataFrame:
    """Adds ``path``: the names from the root to the taxon. A round goes one level down, all taxa of it at once.

    It ends when no taxon is left below; one that no root reaches, being in a
    circle of parents, has no path and is left out.
    """
    found = scratch.table(taxa.join(taxa.select(F.col("taxid").alias("p")), F.col("parent") == F.col("p"), "left_anti").select("taxid", F.array("name").alias("path")), "lineage")
    frontier = found
    while True:
        up = frontier.select(F.col("taxid").alias("p"), F.col("path").alias("above"))
        frontier = scratch.table(taxa.filter("parent <> taxid").join(up, F.col("parent") == F.col("p")).select("taxid", F.concat("above", F.array("name")).alias("path")), "lineage")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return taxa.join(found, "taxid")


def fill_gaps(lineage: Column, levels: int) -> Column:
    """A lineage ``array<struct<name, level>>`` with a synthetic taxon, named after the one above, for each missing level."""
    deepest = F.array_max(F.transform(lineage, lambda t: t["level"]))
    last = lambda test: F.try_element_at(F.transform(F.filter(lineage, test), lambda t: t["name"]), F.lit(-1))

    def name(k: Column) -> Column:
        synthetic = F.concat(F.coalesce(last(lambda t: t["level"] < k), F.lit("root")), F.lit("_incertae_sedis"))
        return F.coalesce(last(lambda t: t["level"] == k), synthetic)

    return F.transform(F.filter(F.sequence(F.lit(1), F.lit(levels)), lambda k: k <= deepest), name)


def keep_taxa(reads: DataFrame, taxon: str, percent: str, least: float = 0.10) -> DataFrame:
    """Rows of taxa whose share sums to at least ``least``."""
    kept = reads.groupBy(taxon).agg(F.sum(percent).alias("_sum")).filter(F.col("_sum") >= least).select(taxon)
    return reads.join(kept, taxon, "left_semi")


def roll_up(reads: DataFrame, path: str = "path", percent: str = "percent", conf: str = "conf") -> DataFrame:
    """For every node above a read: ``num`` reads, ``pop`` their share, mean confidence, and the mean weighted by share.

    A read becomes a row per level of its lineage, which partial aggregation takes
    together before the shuffle.
    """
    steps = F.transform(F.sequence(F.lit(1), F.size(path)), lambda k: F.slice(F.col(path), F.lit(1), k))
    rows = reads.filter(F.size(path) > 0).select(F.explode(steps).alias("node"), F.col(percent).alias("p"), F.col(conf).alias("c"))
    return rows.groupBy("node").agg(F.count(F.lit(1)).alias("num"), F.sum("p").alias("pop"), F.avg("c").alias("conf"), (F.sum(F.col("p") * F.col("c")) / F.sum("p")).alias("w_conf"))


def merge_trees(trees: DataFrame) -> DataFrame:
    """One tree of several samples' nodes: sums of reads and shares, confidences weighted by them, in two decimals."""
    by = trees.groupBy("node").agg(F.sum("num").alias("num"), F.sum("pop").alias("pop"), F.sum(F.col("num") * F.col("conf")).alias("a"), F.sum(F.col("pop") * F.col("w_conf")).alias("b"))
    return by.select("node", "num", "pop", F.round(F.col("a") / F.col("num"), 2).alias("conf"), F.round(F.col("b") / F.col("pop"), 2).alias("w_conf"))


def cumulative(tree: DataFrame) -> DataFrame:
    """Adds ``cum`` and ``cnt``: among siblings in name order, share and reads of those before.

    Siblings share the path above them, so the window is by parent and no more
    than one node's children meet.
    """
    parent = F.array_join(F.slice("node", F.lit(1), F.size("node") - 1), "\t")
    by = Window.partitionBy(parent).orderBy(F.element_at("node", -1)).rowsBetween(Window.unboundedPreceding, -1)
    return tree.withColumn("cum", F.coalesce(F.sum("pop").over(by), F.lit(0.0))).withColumn("cnt", F.coalesce(F.sum("num").over(by), F.lit(0)))


def nexus(tree: DataFrame, most: int = 100_000) -> str:
    """The tree as NEXUS text. It is one string, so its nodes are collected, at most ``most``."""
    rows = tree.select("node", "pop").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} nodes")
    children: dict[tuple, list[tuple]] = {}
    for r in rows:
        children.setdefault(tuple(r.node[:-1]), []).append(tuple(r.node))
    clean = lambda s: "".join(c if c.isalnum() else "_" for c in s)

    def write(node: tuple) -> str:
        own = ",".join(write(c) for c in sorted(children.get(node, [])))
        return (f"({own})" if own else "") + clean(node[-1])

    roots = sorted(n for p, own in children.items() for n in own if not p)
    names = sorted({clean(r.node[-1]) for r in rows})
    return "\n".join(["#NEXUS", "begin taxa;", f"dimensions ntax={len(names)};", "taxlabels", *names, ";", "end;", "begin trees;", f"tree tree1 = ({','.join(map(write, roots))});", "end;"])
