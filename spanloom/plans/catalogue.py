"""All queries over the driver's tables, with their SQL."""

from __future__ import annotations

from . import eval_queries, graph_queries, infer_queries, io_queries, learn_queries, lm_queries, more_queries, text_queries, xml_queries

_MODULES = (graph_queries, text_queries, eval_queries, infer_queries, xml_queries, lm_queries, more_queries, learn_queries, io_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in _MODULES for name, s in m.SQL.items()}
