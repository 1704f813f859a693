"""The bound tables in SQL, for the queries that the engine is compared with."""

from __future__ import annotations

_B = "chr(32)||chr(9)||chr(10)||chr(13)||chr(11)||chr(12)"


def ident(c: str) -> str:
    return f"nullif(lower(trim({c}, {_B})), '')"


def _once(name: str, ids: list[str], keys: list[str], need: list[str] | None = None) -> str:
    cleaned = ", ".join(f"{ident(c)} AS {c}" for c in ids)
    present = " AND ".join(f"{c} IS NOT NULL" for c in need or keys)
    return f"SELECT * EXCLUDE (n_) FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(keys)}) AS n_ FROM (SELECT * REPLACE ({cleaned}) FROM {name}) WHERE {present}) WHERE n_ = 1"


_EVENTS = "SELECT *, CAST(props->>'$.k' AS INT) AS k, epoch_us(ts) / 1e6 AS epoch, 'space_' || user_id AS memory_space FROM events"
VIEWS = {
    "e_": _once("entities", ["entity_key"], ["memory_space", "entity_key"]),
    "m_": _once("memories", ["memory_id", "entity_key", "latest_source_observation_id"], ["memory_space", "memory_id"]),
    "o_": _once("observations", ["observation_id"], ["memory_space", "observation_id"]),
    "g_": _once("edges", (ends := ["edge_id", "from_kind", "from_id", "to_kind", "to_id"]), ["edge_id"], ends),
    "v_": _once("versions", ["version_id", "memory_id", "action", "trigger_observation_id"], ["version_id"]),
    "d_": _once("identity_drafts", ["draft_id"], ["draft_id"]),
    "runs_": f"""SELECT 'run_' || event_id AS run_id, memory_space, event_type AS worker_type,
      CASE WHEN event_id % 17 <> 0 THEN CAST(floor(value * 10) AS BIGINT) END AS input_tokens, CAST(k AS BIGINT) AS output_tokens,
      CAST(floor(CAST(floor(value * 10) AS BIGINT) * k / 200) AS BIGINT) AS cached_tokens,
      CASE WHEN event_id % 10 = 0 THEN 'schema_error' ELSE 'ok' END AS parse_status, epoch AS created_at FROM ({_EVENTS})""",
    "tasks_": f"""SELECT 'task_' || event_id AS task_id, memory_space, task_type, status, k % 20 AS priority, k % 4 AS attempts, 3 AS max_attempts,
      epoch + k % 7 AS available_at, CASE WHEN status = 'running' THEN epoch + 60 END AS lease_expires_at, task_type || ':' || (k % 5) AS dedupe_key,
      'ent_' || (k % 10) AS entity_key, ['mem_' || k, 'mem_' || (k + 1)] AS memory_ids, epoch AS created_at
      FROM (SELECT *, ['continue_ingest','reindex_memory','refresh_entity_profile','repair_memory_edges','detect_merge_candidates'][event_id % 5 + 1] AS task_type,
      ['pending','running','succeeded','failed','dead_letter','cancelled'][k % 6 + 1] AS status FROM ({_EVENTS}))""",
    "audits_": f"""SELECT 'audit_' || event_id AS audit_id, memory_space, 'req_' || (event_id // 3) AS request_id, 'query ' || (k % 25) AS query, status,
      CASE WHEN status = 'rejected' THEN CASE WHEN k % 2 = 0 THEN 'no_identity' ELSE 'recall_failed' END END AS error_code,
      value * 10 AS latency_ms, epoch AS created_at FROM (SELECT *, ['ok','ok','rejected','not_ready'][event_id % 4 + 1] AS status FROM ({_EVENTS}))""",
}


def over(*names: str, recursive: bool = False) -> str:
    """``WITH`` and the named views, open for more."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + " "
