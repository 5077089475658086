"""A small language of graph commands: one ``NAME {json}`` a line."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import SparkSession

from quern.operators import graph as G
from quern.operators.compose import cluster
from quern.operators.coverage import problem_counts
from quern.operators import scaffold as C
from quern.sources import graphs


class NoData(RuntimeError):
    """A command left nothing, or there is nothing to work on."""


class Session:
    """Runs commands on a current graph, with a stack of earlier ones.

    DataFrames do not change, so a stashed graph costs nothing but its plan.
    """

    def __init__(self, spark: SparkSession, graph: G.Graph | None = None) -> None:
        self.spark, self.graph, self.stack, self.output = spark, graph, [], []
        ids = lambda names: spark.createDataFrame([(n,) for n in names], f"id {dict(self.graph.nodes.dtypes)['id']}")
        names = lambda name=None, names=None: ids([*([name] if name is not None else []), *(names or [])])
        on: dict[str, Callable] = {
            "CCOMPS": lambda **a: G.components(self.graph, **a),
            "EDGFLT": lambda **a: G.filter_edges(self.graph, **a),
            "MST": lambda bits=False: G.make_directed(G.spanning_forest(self.graph, "bits" if bits else "score")),
            "SST": lambda: G.make_directed(C.special_spanning_tree(self.graph)),
            "PLUCK": lambda **a: G.pluck(self.graph, **a),
            "PUSH": lambda **a: G.push(self.graph, **a),
            "PRUNE": lambda **a: G.prune(self.graph, **a),
            "SLICE": lambda **a: G.slice_chains(self.graph, **a),
            "INSERT": lambda **a: C.insert(self.graph, **a),
            "SCAFF": lambda: C.scaffold(self.graph),
            "SELCC": lambda **a: G.select_components(self.graph, **a),
            "SELND": lambda radius=0, **a: G.select_nodes(self.graph, names(**a), radius),
            "SELCLUST": lambda **a: G.select_clusters(self.graph, **a),
            "RELINK": lambda name=None, names=None, **a: G.relink(self.graph, ids([*([name] if name is not None else []), *(names or [])]), **a),
            "CUTND": lambda **a: G.cut_node(self.graph, **a),
            "EDIT": lambda **a: G.edit(self.graph, **a),
        }
        self.commands = on

    def run(self, name: str, **options) -> None:  # noqa: ANN003
        """One command; its result is the current graph, or is added to ``output``."""
        name = name.upper()
        if name == "LOAD":
            files = options.get("files") or [options["file"]]
            self.graph = graphs.load(self.spark, *files)
            if "edges" in options:
                self.graph = G.graft_edges(self.graph, graphs.load(self.spark, options["edges"]))
            return
        if name == "UNSTASH":
            if not self.stack:
                raise NoData("nothing is stashed")
            self.graph = self.stack[-1] if not options.get("free", True) else self.stack.pop()
            return
        if name == "HELP":
            self.output.append(self.help(options.get("command")))
            return
        if self.graph is None:
            raise NoData("no graph is loaded")
        if name == "STASH":
            self.stack.append(self.graph)
        elif name == "DUMP":
            graphs.dump(self.graph, options["file"])
        elif name == "TABLE":
            self.output.append(graphs.table(self.graph))
        elif name == "FASTA":
            file = options.pop("file", None)
            found = graphs.sequences(self.graph, **options)
            if file is None:
                self.output.append(found)
            else:
                graphs.write_fasta(found, file)
        elif name == "CLUST":
            nodes = self.graph.live_nodes().filter("seq IS NOT NULL").select("id", "seq")
            found = cluster(nodes, **options)
            self.graph = replace(self.graph, clusters=found)
        elif name == "PROBS":
            self.output.append(problem_counts(self.graph.live_nodes()))
        elif name == "DOT":
            self.output.append(graphs.dot(self.graph, **options))
        elif name in ("GC", "GCC"):
            by = None
            nodes = self.graph.live_nodes()
            if name == "GCC":
                self.graph = self.graph if self.graph.components is not None else G.components(self.graph)
                nodes, by = nodes.join(self.graph.components.select("id", "ccnum"), "id"), ["ccnum"]
            self.output.append(G.sequence_stats(nodes, by))
        elif name == "CIRCLE":
            self.output.append(C.circles(self.graph, **options))
        elif name == "SCAFLNK":
            self.output.append(G.scaffold_links(self.graph, self.graph.scaffolds, **options))
        elif name in self.commands:
            found = self.commands[name](**options)
            self.graph = replace(found, history=(*self.graph.history, json.dumps([name, options], default=str)))
        else:
            raise ValueError(f"no such command: {name}")

    def script(self, text: str, tag: str = "", depth: int = 0) -> bool:
        """The commands of a script; ``@`` runs become the tag. False if it ended for want of data."""
        for line in text.splitlines():
            line = line.strip()
            if not line or line.startswith("#"):
                continue
            name, _, rest = line.partition(" ")
            options = json.loads(rest.replace("@", tag) if rest.strip() else "{}")
            try:
                if name.upper() == "SCRIPT":
                    if depth > 8:
                        raise RecursionError("scripts call each other too deep")
                    inner = self.spark.read.text(options["file"], wholetext=True).first()[0]
                    if not self.script(inner, options.get("tag", tag), depth + 1):
                        return False
                else:
                    self.run(name, **options)
            except NoData:
                return False
        return True

    def help(self, command: str | None = None) -> str:
        known = {"MST": G.spanning_forest, "SST": C.special_spanning_tree, "CCOMPS": G.components, "PLUCK": G.pluck, "PUSH": G.push, "PRUNE": G.prune, "SLICE": G.slice_chains, "INSERT": C.insert, "SCAFF": C.scaffold, "CIRCLE": C.circles, "SCAFLNK": G.scaffold_links, "RELINK": G.relink, "CUTND": G.cut_node, "EDIT": G.edit, "EDGFLT": G.filter_edges, "SELCC": G.select_components, "SELND": G.select_nodes, "SELCLUST": G.select_clusters}
        if command:
            return (known[command.upper()].__doc__ or "").strip()
        return "\n".join(f"{k}: {(f.__doc__ or '').strip().splitlines()[0]}" for k, f in sorted(known.items()))
