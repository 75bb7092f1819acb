"""Registered queries of the library and their DuckDB counterparts."""

from __future__ import annotations

from . import experiments, files, graph, prompts, retrieval, text, text_metrics

_MODULES = (text, retrieval, graph, text_metrics, experiments, prompts, files)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}

#: Retrieve, judge and aggregate over the embeddings: one row per ranking metric.
flagship = retrieval.ret16
