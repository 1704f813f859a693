"""All registered queries of the core, and the SQL that they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.plans import control_queries, eval_queries, flow_queries, graph_queries, recall_queries, record_queries, repair, stream_queries, worker_queries, write_queries

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = [record_queries, control_queries, recall_queries, graph_queries, write_queries, flow_queries, eval_queries, worker_queries, stream_queries, repair]


def queries() -> dict[str, Query]:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
