"""Every reference query by name, with its DuckDB oracle."""

from __future__ import annotations

from lodestar.plans import answer_queries, evaluation_queries, ingest_queries, observability_queries, retrieval_queries, run_queries, stream_queries

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (ingest_queries, retrieval_queries, answer_queries, evaluation_queries, observability_queries, stream_queries, run_queries):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
