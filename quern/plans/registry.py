"""Every registered query of the library, with its SQL."""

from __future__ import annotations

from quern.plans import compose_queries, flagship, format_queries, graph_queries, read_queries, select_queries, selection

QUERIES: dict = {}
ORACLES: dict = {}

for _module in (flagship, read_queries, select_queries, selection, graph_queries, compose_queries, format_queries):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
