"""Sequence graphs in and out: JSON, tables, DOT and output names."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.graph import REMOVED, SELECTED, Graph, merge
from quern.operators.layout import lay_out
from quern.sources.fasta import abundance_name, write_fasta

NODE_COLUMNS = ("seq_len", "cov", "rd_cnt", "rel_ab", "pct_gc", "bits", "seq", "descr")


def load(spark: SparkSession, *paths: str) -> Graph:
    """One or more graph files (disjoint) as a graph.

    ``nodes`` and ``removed_nodes`` are objects by id, ``edges`` and
    ``removed_edges`` lists. A file is one JSON document, so it is parsed in one
    task; the columns come from the documents.
    """
    graphs = []
    for path in paths:
        text = spark.read.text(path, wholetext=True).first()[0]
        doc = json.loads(text)
        nodes = [{**v, "id": k, "state": s} for part, s in (("nodes", SELECTED), ("removed_nodes", REMOVED)) for k, v in (doc.get(part) or {}).items()]
        edges = [{**e, "state": s} for part, s in (("edges", SELECTED), ("removed_edges", REMOVED)) for e in doc.get(part) or []]
        g = Graph(_frame(spark, nodes, "id string, state string"), _frame(spark, edges, "n1 string, n2 string, dir string, bits double, score double, state string"), history=tuple(json.dumps(x) for x in doc.get("processing") or []))
        if doc.get("scaffolds"):
            rows = [(k, int(v.get("ccnum", 0)), list(v["nodes"])) for k, v in doc["scaffolds"].items()]
            g = Graph(g.nodes, g.edges, None, spark.createDataFrame(rows, "scaffold_id string, ccnum int, nodes array<string>"), None, g.history)
        graphs.append(g)
    return graphs[0] if len(graphs) == 1 else merge(graphs)


def _frame(spark: SparkSession, rows: list[dict], empty: str) -> DataFrame:
    if not rows:
        return spark.createDataFrame([], empty)
    kinds = {}
    for r in rows:
        for k, v in r.items():
            kind = "boolean" if isinstance(v, bool) else "double" if isinstance(v, int | float) else "string"
            kinds[k] = kind if kinds.get(k, kind) == kind else "string"
    kinds |= {k: "string" for k in kinds if k in ("id", "n1", "n2")}  # nodes are keys of an object, so edges name them by text
    kinds |= {k: "long" for k in kinds if k in ("seq_len", "num", "p1", "p2") and kinds[k] == "double"}
    schema = ", ".join(f"`{k}` {v}" for k, v in kinds.items())
    cast = {"long": int, "double": float, "boolean": bool, "string": lambda v: v if isinstance(v, str) else json.dumps(v)}
    return spark.createDataFrame([tuple(None if r.get(k) is None else cast[v](r[k]) for k, v in kinds.items()) for r in rows], schema)


def dump(g: Graph, path: str) -> None:
    """The graph as one JSON document. It is one document, so it is made of collected rows: for graphs that fit one machine."""
    clean = lambda r: {k: v for k, v in r.asDict(recursive=True).items() if v is not None and k not in ("id", "state")}
    nodes, edges = g.nodes.collect(), g.edges.collect()
    doc = {
        "nodes": {str(r.id): clean(r) for r in nodes if r.state == SELECTED},
        "edges": [clean(r) for r in edges if r.state == SELECTED],
        "removed_nodes": {str(r.id): clean(r) for r in nodes if r.state == REMOVED},
        "removed_edges": [clean(r) for r in edges if r.state == REMOVED],
        "processing": [json.loads(h) for h in g.history],
    }
    if g.scaffolds is not None:
        doc["scaffolds"] = {r.scaffold_id: {"ccnum": r.ccnum, "nodes": list(r.nodes)} for r in g.scaffolds.collect()}
    spark = g.nodes.sparkSession
    spark.createDataFrame([(json.dumps(doc, sort_keys=True),)], "value string").coalesce(1).write.text(path)


TABLE = ("bits", "rel_ab", "cov", "rd_cnt", "pct_gc", "seq_len", "id", "descr")


def table(g: Graph) -> DataFrame:
    """One row per selected node; a missing GC is ``NA``, other missing columns are null."""
    have = set(g.nodes.columns)
    cols = [F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in TABLE]
    rows = g.live_nodes().select(*cols)
    return rows.withColumn("pct_gc", F.coalesce(F.col("pct_gc").cast("string"), F.lit("NA")))


def write_table(g: Graph, path: str, header: bool = True) -> None:
    table(g).write.csv(path, sep="\t", header=header)


def sequences(g: Graph, abundance: bool = False, scaff: bool = False, no_merge_scaffs: bool = False, **options: int) -> DataFrame:
    """``name, seq`` of the selected sequences, for :func:`quern.sources.fasta.write_fasta`.

    ``abundance`` puts the share in percent after the name. ``scaff`` joins the
    contigs of each scaffold; ``no_merge_scaffs`` leaves them apart, named by
    scaffold and place.
    """
    live = g.live_nodes().filter(F.col("seq").isNotNull())
    if scaff:
        return lay_out(g.scaffolds, live, **options).withColumnRenamed("scaffold_id", "name")
    if no_merge_scaffs:
        placed = g.scaffolds.select("scaffold_id", F.posexplode("nodes").alias("idx", "id"))
        return placed.join(live.select("id", "seq"), "id").select(F.concat_ws(":", F.col("id").cast("string"), "scaffold_id", F.col("idx").cast("string")).alias("name"), "seq")
    name = F.col("id").cast("string")
    return live.select((abundance_name(name, F.col("rel_ab")) if abundance else name).alias("name"), "seq")


def dot_lines(g: Graph, detail: bool = False, arrowtype: str = "normal", pen_scale: float = 0.0, colored_edges: bool = False) -> DataFrame:
    """The selected graph as graphviz text, ``part, a, b, line``; in that order the lines are the drawing."""
    spark = g.nodes.sparkSession
    text = lambda c: F.col(c).cast("string")
    label = F.concat(text("id"), F.lit("\\n"), text("seq_len")) if detail else text("id")
    nodes = g.live_nodes().select(F.lit(1).alias("part"), text("id").alias("a"), F.lit("").alias("b"), F.concat(F.lit('  "'), text("id"), F.lit('" [label="'), label, F.lit('"];')).alias("line"))
    style = []
    if pen_scale:
        style.append(F.format_string("penwidth=%.2f", F.greatest(F.lit(1.0), F.col("bits") * pen_scale)))
    if colored_edges:
        color = F.when(F.col("dir") == "FB", "black").when(F.col("dir") == "FF", "blue").when(F.col("dir") == "BB", "red").otherwise("gray")
        style.append(F.concat(F.lit("color="), color))
    ending = F.concat(F.lit(" ["), F.concat_ws(", ", *style), F.lit("];")) if style else F.lit(";")
    edges = g.live_edges().select(F.lit(2).alias("part"), text("n1").alias("a"), text("n2").alias("b"), F.concat(F.lit('  "'), text("n1"), F.lit('" -> "'), text("n2"), F.lit('"'), ending).alias("line"))
    frame = [(0, "", "", "digraph seq {"), (0, "", "1", f"  edge [arrowhead={arrowtype}];"), (3, "", "", "}")]
    return spark.createDataFrame(frame, "part int, a string, b string, line string").unionByName(nodes).unionByName(edges)


def write_dot(g: Graph, path: str, **options) -> None:  # noqa: ANN003
    """The drawing as one file: sorted in tasks, written in order by one."""
    dot_lines(g, **options).orderBy("part", "a", "b").select("line").coalesce(1).write.text(path)


def dot(g: Graph, detail: bool = False, arrowtype: str = "normal", pen_scale: float = 0.0, colored_edges: bool = False) -> str:
    """The drawing as one string, for graphs that fit one machine."""
    rows = dot_lines(g, detail, arrowtype, pen_scale, colored_edges).orderBy("part", "a", "b")
    return "\n".join(r.line for r in rows.toLocalIterator())


def output_name(template: str, taken: set[str], tag: str = "") -> str:
    """A name from a template: a run of ``@`` is the tag, a run of ``#`` the first free number, as wide."""
    name = re.sub("@+", lambda _: tag, template)
    if not (m := re.search("#+", name)):
        return name
    width = len(m.group())
    for k in range(10**width):
        if (found := name[: m.start()] + f"{k:0{width}d}" + name[m.end() :]) not in taken:
            return found
    raise FileExistsError(template)
