"""Queries on records: orphan references (p2) and the change feed (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.operators import changes, references
from palimpsest.sources.tables import table


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    return references.orphan_edge_ends(*(table(spark, folder, t) for t in ("edges", "memories", "observations")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).select("edge_id", "side", "state")


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    return references.orphan_report(_orphans(spark, folder))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return changes.last_changes(table(spark, folder, "versions"))


def p5_state(spark: SparkSession, folder: str) -> DataFrame:
    return changes.current_memories(table(spark, folder, "memories"), table(spark, folder, "versions"))


QUERIES = {f.__name__: f for f in (p2_found, p2_report, p5_found, p5_state)}

#: Blanks of an identifier, as in ``functions.ids.ID_BLANKS``.
_B = r"chr(32)||chr(9)||chr(10)||chr(13)||chr(11)||chr(12)"


def _id(c: str) -> str:
    return f"nullif(lower(trim({c}, {_B})), '')"


_ORPHANS = f"""
WITH ends AS (
  SELECT {_id("edge_id")} AS edge_id, 'from' AS side, {_id("from_kind")} AS kind, memory_space, {_id("from_id")} AS id, created_at FROM edges
  UNION ALL
  SELECT {_id("edge_id")}, 'to', {_id("to_kind")}, memory_space, {_id("to_id")}, created_at FROM edges),
known AS (
  SELECT kind, memory_space, id, min(arrived_at) AS arrived FROM (
    SELECT 'memory' AS kind, memory_space, {_id("memory_id")} AS id, arrived_at FROM memories
    UNION ALL
    SELECT 'observation', memory_space, {_id("observation_id")}, arrived_at FROM observations)
  GROUP BY ALL),
judged AS (
  SELECT e.*, CASE WHEN k.id IS NULL THEN 'absent' WHEN k.arrived - e.created_at > 86400 THEN 'late' END AS state
  FROM ends e LEFT JOIN known k ON e.kind = k.kind AND e.memory_space = k.memory_space AND e.id = k.id
  WHERE e.kind IS NOT NULL AND e.id IS NOT NULL AND e.memory_space IS NOT NULL AND e.edge_id IS NOT NULL),
orphans AS (
  SELECT edge_id, side, min(state) AS state, min(kind) AS ref_table,
         strftime(make_timestamp(CAST(floor(min(created_at) * 1000000) AS BIGINT)), '%Y-%m') AS edge_month
  FROM judged WHERE state IS NOT NULL GROUP BY edge_id, side)
"""

_NEWEST = f"""
WITH feed AS (
  SELECT * REPLACE ({_id("memory_id")} AS memory_id, {_id("version_id")} AS version_id, {_id("action")} AS action) FROM versions),
newest AS (
  SELECT *, row_number() OVER (PARTITION BY memory_space, memory_id
    ORDER BY version DESC NULLS LAST, created_at DESC NULLS LAST, version_id DESC NULLS LAST) AS n
  FROM feed WHERE memory_space IS NOT NULL AND memory_id IS NOT NULL)
"""
_IMAGE = "title, summary, content, confidence, salience, status"

ORACLE = {
    "p2_found": _ORPHANS + "SELECT edge_id, side, state FROM orphans",
    "p2_report": _ORPHANS + "SELECT ref_table, edge_month, state, count(*) AS n_ends FROM orphans GROUP BY ALL",
    "p5_found": _NEWEST + "SELECT memory_space, memory_id, version_id FROM newest WHERE n = 1 AND action IS DISTINCT FROM 'archive'",
    "p5_state": _NEWEST
    + f"""SELECT memory_space, memory_id, {_IMAGE}, version_id FROM newest WHERE n = 1 AND action IS DISTINCT FROM 'archive'
UNION ALL
SELECT memory_space, memory_id, {_IMAGE}, NULL FROM (
  SELECT *, row_number() OVER (PARTITION BY memory_space, memory_id) AS n
  FROM (SELECT * REPLACE ({_id("memory_id")} AS memory_id) FROM memories)
  WHERE {_id("status")} IS DISTINCT FROM 'archived' AND memory_space IS NOT NULL AND memory_id IS NOT NULL) m
WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM newest v WHERE v.memory_space = m.memory_space AND v.memory_id = m.memory_id)""",
}
