"""Queries of lookups, statistics and the task queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import lookup, stats, tasks
from palimpsest.plans.views import over
from palimpsest.sources import bindings as b

#: A space that is there at every scale, and a time in the middle of the events.
SPACE = "team:alder-main:primary"
NOW = 1_705_000_000.0

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(over("e_") + f"SELECT entity_key, display_name, updated_at FROM e_ WHERE memory_space = '{SPACE}' ORDER BY updated_at DESC NULLS LAST, entity_key LIMIT 200")
def q_list_entities(spark: SparkSession, d: str) -> DataFrame:
    return lookup.top(b.entities(spark, d), "updated_at", "entity_key", 200, memory_space=SPACE).select("entity_key", "display_name", "updated_at")


@query(over("o_") + f"SELECT observation_id, summary, created_at FROM o_ WHERE memory_space = '{SPACE}' ORDER BY created_at NULLS LAST, observation_id LIMIT 1000")
def q_list_observations(spark: SparkSession, d: str) -> DataFrame:
    rows = lookup.top(b.observations(spark, d), "created_at", "observation_id", 1000, newest=False, memory_space=SPACE)
    return rows.select("observation_id", "summary", "created_at")


@query(over("e_", "m_") + "SELECT e.memory_space, e.entity_key, e.display_name, m.memory_id, m.title FROM m_ m JOIN e_ e ON e.memory_space = m.memory_space AND e.entity_key = m.entity_key")
def q_point_entity(spark: SparkSession, d: str) -> DataFrame:
    m = b.memories(spark, d).select("memory_space", "entity_key", "memory_id", "title")
    return m.join(b.entities(spark, d).select("memory_space", "entity_key", "display_name"), ["memory_space", "entity_key"])


@query(
    over("m_", "v_")
    + """, asked AS (SELECT memory_space || '|' || trigger_observation_id AS request, list(memory_id ORDER BY version DESC, version_id) AS ids FROM v_ WHERE trigger_observation_id IS NOT NULL GROUP BY 1),
  placed AS (SELECT request, unnest(ids) AS memory_id, generate_subscripts(ids, 1) - 1 AS p FROM asked)
SELECT a.request, m.memory_id, max(p) AS position FROM placed a JOIN m_ m USING (memory_id) WHERE trim(memory_id) <> '' GROUP BY 1, 2"""
)
def q_memories_by_ids(spark: SparkSession, d: str) -> DataFrame:
    """The memories that one observation changed, newest change first: a request's ids are few."""
    v = b.versions(spark, d).where("trigger_observation_id IS NOT NULL").groupBy(F.concat_ws("|", "memory_space", "trigger_observation_id").alias("request"))
    asked = v.agg(F.array_sort(F.collect_list(F.struct((-F.col("version")).alias("v"), "version_id", "memory_id"))).alias("l"))
    asked = asked.select("request", F.transform("l", lambda x: x["memory_id"]).alias("ids"))
    return lookup.by_ids(b.memories(spark, d).select("memory_id"), "memory_id", asked).select("request", "memory_id", "position")


@query(
    over("m_")
    + """SELECT memory_space, entity_key, memory_id, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY memory_space, entity_key ORDER BY updated_at DESC NULLS LAST, memory_id) AS rank FROM m_) WHERE rank <= 5"""
)
def q_recent_memories(spark: SparkSession, d: str) -> DataFrame:
    recent = lookup.recent_per_key(b.memories(spark, d), ["memory_space", "entity_key"], "updated_at", "memory_id", 5)
    return recent.select("memory_space", "entity_key", "memory_id", "rank")


@query(
    over("m_", "g_")
    + """, s AS (SELECT memory_space, memory_id FROM m_ WHERE status = 'stale')
SELECT edge_id, from_id, to_id, edge_type FROM g_ g WHERE EXISTS (SELECT 1 FROM s WHERE s.memory_space = g.memory_space AND s.memory_id IN (g.from_id, g.to_id))"""
)
def q_incident_edges(spark: SparkSession, d: str) -> DataFrame:
    seeds = b.memories(spark, d).where("status = 'stale'")
    return lookup.incident_edges(b.edges(spark, d), seeds).select("edge_id", "from_id", "to_id", "edge_type")


@query(
    over("m_")
    + f""", hit AS (SELECT * FROM m_ WHERE memory_space LIKE 'team:%' AND contains(title, 'rota') AND status IN ('active', 'stale'))
SELECT memory_id, title, status, updated_at, (SELECT count(*) FROM hit) AS total FROM hit ORDER BY updated_at DESC NULLS LAST, memory_id LIMIT 200 OFFSET 10"""
)
def q_preview_memories(spark: SparkSession, d: str) -> DataFrame:
    statuses = lookup.known_statuses("active, stale, gone", stats.MEMORY_STATUSES)
    conditions = [lookup.like("memory_space", "team:", "prefix"), lookup.like("title", "rota"), F.col("status").isin(statuses)]
    shown = lookup.page(b.memories(spark, d), conditions, "updated_at", "memory_id", limit=500, offset=10)
    return shown.select("memory_id", "title", "status", "updated_at", "total")


@query(
    over("audits_")
    + """, hit AS (SELECT * FROM audits_ WHERE error_code = 'no_identity' AND query LIKE 'query 1%')
SELECT audit_id, query, created_at, (SELECT count(*) FROM hit) AS total FROM hit ORDER BY created_at DESC, audit_id LIMIT 50"""
)
def q_preview_audits(spark: SparkSession, d: str) -> DataFrame:
    conditions = [F.col("error_code") == "no_identity", lookup.like("query", "query 1", "prefix")]
    return lookup.page(b.recall_audits(spark, d), conditions, "created_at", "audit_id").select("audit_id", "query", "created_at", "total")


@query(
    over("o_")
    + r"""SELECT observation_id, coalesce(nullif(substr(regexp_replace(trim(summary, ' '), '[\r\n]+', ' ', 'g'), 1, 240), ''), substr(regexp_replace(content, '[\r\n]+', ' ', 'g'), 1, 240)) AS preview,
  coalesce(metadata->>'$.record_markers.stage_label', '') AS stage FROM o_"""
)
def q_preview_text(spark: SparkSession, d: str) -> DataFrame:
    flat = lambda c: F.substring(F.regexp_replace(c, r"[\r\n]+", " "), 1, 240)
    stage = F.coalesce(F.get_json_object("metadata", "$.record_markers.stage_label"), F.lit(""))
    return b.observations(spark, d).select("observation_id", F.coalesce(F.nullif(flat(F.btrim("summary")), F.lit("")), flat(F.col("content"))).alias("preview"), stage.alias("stage"))


@query(over("audits_") + "SELECT memory_space, query, max(struct_pack(c := created_at, a := audit_id)).a AS audit_id FROM audits_ GROUP BY 1, 2")
def q_latest_audit(spark: SparkSession, d: str) -> DataFrame:
    return lookup.latest(b.recall_audits(spark, d), ["memory_space", "query"], "created_at", "audit_id").select("memory_space", "query", "audit_id")


@query(over("tasks_") + "SELECT DISTINCT memory_space FROM tasks_ WHERE task_type = 'continue_ingest' AND status IN ('pending', 'running')")
def q_not_ready(spark: SparkSession, d: str) -> DataFrame:
    t = b.tasks(spark, d)
    return lookup.not_ready(t.select("memory_space").distinct(), t)


@query(over("e_", "m_") + "SELECT 'entity:' || memory_space || ':' || entity_key AS ref_doc FROM e_ UNION SELECT 'memory:' || memory_space || ':' || memory_id FROM m_")
def q_ref_docs(spark: SparkSession, d: str) -> DataFrame:
    return lookup.all_ref_docs(b.entities(spark, d), b.memories(spark, d))


@query(
    over("g_", "m_")
    + """SELECT 'edges' AS "table", edge_id AS id, 'edge_type' AS "column", edge_type AS value FROM g_ WHERE edge_type IS NULL OR edge_type NOT IN ('updates', 'supports', 'contradicts', 'derived_from')
UNION ALL SELECT 'memories', memory_id, 'status', status FROM m_ WHERE status IS NULL OR status NOT IN ('active', 'superseded', 'stale')"""
)
def q_violations(spark: SparkSession, d: str) -> DataFrame:
    edges = lookup.violations(b.edges(spark, d), "edges", "edge_id", {"edge_type": ["updates", "supports", "contradicts", "derived_from"]}, ["weight"])
    return edges.unionByName(lookup.violations(b.memories(spark, d), "memories", "memory_id", {"status": ["active", "superseded", "stale"]}, ["confidence", "salience"]))


_USAGE = "count(*) AS n_runs, sum(coalesce(input_tokens, 0)) AS input_tokens, sum(coalesce(output_tokens, 0)) AS output_tokens, sum(coalesce(cached_tokens, 0)) AS cached_tokens"


@query(
    over("runs_")
    + f""", s AS (SELECT worker_type, grouping(worker_type) AS whole, {_USAGE} FROM runs_ WHERE created_at >= {NOW} GROUP BY GROUPING SETS ((), (worker_type)))
SELECT worker_type, whole, n_runs, CAST(input_tokens AS BIGINT) AS input_tokens, CAST(output_tokens AS BIGINT) AS output_tokens, CAST(cached_tokens AS BIGINT) AS cached_tokens,
  CASE WHEN input_tokens > 0 THEN cached_tokens / input_tokens ELSE 0 END AS cache_hit_rate FROM s"""
)
def a_llm_usage(spark: SparkSession, d: str) -> DataFrame:
    return stats.llm_usage(b.llm_runs(spark, d), NOW)


@query(over("runs_") + f"SELECT run_id FROM runs_ WHERE created_at >= {NOW} - 7 * 86400")
def v_kept_runs(spark: SparkSession, d: str) -> DataFrame:
    return stats.kept_runs(b.llm_runs(spark, d), NOW).select("run_id")


@query(over("e_", "m_", "o_", "g_", "v_", "audits_") + " UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS n_rows FROM {v}" for n, v in [("entities", "e_"), ("memories", "m_"), ("observations", "o_"), ("edges", "g_"), ("versions", "v_"), ("recall_audits", "audits_")]))
def a_table_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.table_counts({n: getattr(b, n)(spark, d) for n in ("entities", "memories", "observations", "edges", "versions", "recall_audits")})


@query(over("v_") + "SELECT memory_space, memory_id, coalesce(max(version), 0) + 1 AS next_version FROM v_ GROUP BY 1, 2")
def a_next_version(spark: SparkSession, d: str) -> DataFrame:
    return stats.next_versions(b.versions(spark, d))


@query(
    over("m_", "g_", "tasks_")
    + """SELECT memory_space, 'memory_status' AS kind, status AS label, count(*) AS n FROM m_ GROUP BY ALL
UNION ALL SELECT memory_space, 'edge_type', edge_type, count(*) FROM g_ GROUP BY ALL
UNION ALL SELECT memory_space, 'open_task', task_type, count(*) FROM tasks_ WHERE status IN ('pending', 'running') GROUP BY ALL
UNION ALL SELECT memory_space, 'critical_task', task_type, count(*) FROM tasks_ WHERE status IN ('pending', 'running') AND task_type IN ('continue_ingest', 'reindex_memory', 'repair_memory_edges') GROUP BY ALL"""
)
def a_scope_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return stats.scope_snapshot(b.memories(spark, d), b.edges(spark, d), b.tasks(spark, d))


@query(
    over("audits_")
    + """SELECT status, count(*) AS n, round(avg(latency_ms), 6) AS mean_ms, median(latency_ms) AS median_ms, quantile_disc(latency_ms, 0.95) AS p95_ms,
  max(latency_ms) AS max_ms, min(latency_ms) AS min_ms, round(sum(latency_ms), 4) AS total_ms FROM audits_ GROUP BY 1"""
)
def a_latency(spark: SparkSession, d: str) -> DataFrame:
    out = stats.latency(b.recall_audits(spark, d), ["status"], "latency_ms")
    return out.withColumns({"mean_ms": F.round("mean_ms", 6), "total_ms": F.round("total_ms", 4)})


@query(
    over("audits_")
    + """SELECT memory_space, request_id, CASE WHEN bool_and(status = 'ok') THEN 'ok' WHEN bool_or(status = 'ok') THEN 'partial' WHEN bool_and(status = 'not_ready') THEN 'not_ready' ELSE 'rejected' END AS status,
  CASE WHEN count(DISTINCT error_code) FILTER (status <> 'ok') = 1 THEN min(error_code) FILTER (status <> 'ok') END AS error_code FROM audits_ GROUP BY 1, 2"""
)
def a_request_status(spark: SparkSession, d: str) -> DataFrame:
    return stats.request_status(b.recall_audits(spark, d))


@query(
    over("audits_")
    + """SELECT memory_space, count(*) AS n_audits, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status = 'rejected') AS n_rejected,
  count(*) FILTER (status = 'not_ready') AS n_not_ready, count(DISTINCT request_id) AS n_requests, count(DISTINCT error_code) AS n_error_codes FROM audits_ GROUP BY 1"""
)
def a_audit_summary(spark: SparkSession, d: str) -> DataFrame:
    return stats.audit_summary(b.recall_audits(spark, d))


_REQUESTED = "requested AS (SELECT * REPLACE ('new_' || task_id AS task_id) FROM tasks_ WHERE status = 'succeeded')"


@query(
    over("tasks_")
    + f""", {_REQUESTED} SELECT task_id, dedupe_key FROM (SELECT *, row_number() OVER (PARTITION BY memory_space, dedupe_key ORDER BY created_at, task_id) AS nth FROM requested) r
WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM tasks_ t WHERE t.status IN ('pending', 'running') AND t.memory_space = r.memory_space AND t.dedupe_key = r.dedupe_key)"""
)
def t_enqueue(spark: SparkSession, d: str) -> DataFrame:
    t = b.tasks(spark, d)
    requested = t.where("status = 'succeeded'").withColumn("task_id", F.concat(F.lit("new_"), "task_id"))
    return tasks.enqueue(t, requested).select("task_id", "dedupe_key")


_DUE = f"due AS (SELECT * FROM tasks_ WHERE status = 'pending' AND available_at <= {NOW} ORDER BY priority DESC, created_at, task_id LIMIT 500)"


@query(over("tasks_") + f", {_DUE} SELECT task_id, priority, created_at FROM due")
def t_due(spark: SparkSession, d: str) -> DataFrame:
    return tasks.due(b.tasks(spark, d), NOW, 500).select("task_id", "priority", "created_at")


@query(
    over("tasks_")
    + f""", {_DUE} SELECT t.task_id, CASE WHEN d.task_id IS NOT NULL THEN 'running' ELSE t.status END AS status,
  t.attempts + CASE WHEN d.task_id IS NOT NULL THEN 1 ELSE 0 END AS attempts, CASE WHEN d.task_id IS NOT NULL THEN {NOW + 60} ELSE t.lease_expires_at END AS lease_expires_at
FROM tasks_ t LEFT JOIN due d USING (task_id)"""
)
def t_claim(spark: SparkSession, d: str) -> DataFrame:
    return tasks.claim(b.tasks(spark, d), NOW, 500).select("task_id", "status", "attempts", "lease_expires_at")


@query(
    over("tasks_")
    + """, told AS (SELECT task_id, CASE WHEN priority % 3 = 0 THEN 'failed' WHEN priority % 3 = 1 THEN 'released' ELSE 'succeeded' END AS outcome FROM tasks_)
SELECT task_id, CASE WHEN status <> 'running' THEN status WHEN outcome = 'failed' THEN CASE WHEN attempts >= max_attempts THEN 'dead_letter' ELSE 'failed' END
  WHEN outcome = 'released' THEN 'pending' ELSE outcome END AS status FROM tasks_ JOIN told USING (task_id)"""
)
def t_finish(spark: SparkSession, d: str) -> DataFrame:
    t = b.tasks(spark, d)
    outcome = F.when(F.col("priority") % 3 == 0, "failed").when(F.col("priority") % 3 == 1, "released").otherwise("succeeded")
    return tasks.finish(t, t.select("task_id", outcome.alias("outcome"))).select("task_id", "status")


@query(
    over("tasks_")
    + f"""SELECT task_id, CASE WHEN (status = 'running' AND lease_expires_at <= {NOW}) OR (status = 'failed' AND attempts < max_attempts) THEN 'pending' ELSE status END AS status,
  CASE WHEN status = 'failed' AND attempts < max_attempts THEN {NOW} ELSE available_at END AS available_at FROM tasks_"""
)
def t_recover(spark: SparkSession, d: str) -> DataFrame:
    return tasks.recover(b.tasks(spark, d), NOW).select("task_id", "status", "available_at")


@query(
    over("tasks_")
    + """, k AS (SELECT *, CASE WHEN task_type = 'continue_ingest' THEN task_id ELSE task_type || '|' || memory_space || '|' || entity_key END AS grp FROM tasks_ WHERE status = 'running'),
l AS (SELECT grp, arg_min(task_id, struct_pack(c := created_at, t := task_id)) AS leader_id FROM k GROUP BY 1),
i AS (SELECT grp, id, min(struct_pack(c := created_at, t := task_id, p := p)) AS first FROM (SELECT grp, created_at, task_id, unnest(memory_ids) AS id, generate_subscripts(memory_ids, 1) AS p FROM k) GROUP BY 1, 2),
u AS (SELECT grp, array_to_string(list(id ORDER BY first), ',') AS ids FROM i GROUP BY 1)
SELECT task_id, leader_id, CASE WHEN task_id = leader_id THEN ids END AS memory_ids FROM k JOIN l USING (grp) JOIN u USING (grp)"""
)
def t_coalesce(spark: SparkSession, d: str) -> DataFrame:
    out = tasks.coalesce_tasks(b.tasks(spark, d).where("status = 'running'"))
    return out.withColumn("memory_ids", F.array_join("memory_ids", ","))


@query(
    over("tasks_")
    + f"""SELECT memory_space, entity_key, k.t AS task_type, k.p AS priority, CAST({NOW + 3} AS DOUBLE) AS available_at, k.t || ':' || entity_key AS dedupe_key FROM (SELECT DISTINCT memory_space, entity_key FROM tasks_),
  (SELECT unnest([struct_pack(t := 'refresh_entity_profile', p := 8), struct_pack(t := 'reindex_memory', p := 12), struct_pack(t := 'detect_merge_candidates', p := 4), struct_pack(t := 'repair_memory_edges', p := 11)]) AS k)"""
)
def t_follow_ups(spark: SparkSession, d: str) -> DataFrame:
    return tasks.follow_ups(b.tasks(spark, d), NOW)


@query(
    over("tasks_")
    + """SELECT state_key, s.v AS value, s.u AS updated_at FROM (SELECT dedupe_key AS state_key, max(struct_pack(u := created_at, v := status)) AS s FROM tasks_ GROUP BY 1)"""
)
def t_state(spark: SparkSession, d: str) -> DataFrame:
    s = b.tasks(spark, d).select(F.col("dedupe_key").alias("state_key"), F.col("status").alias("value"), F.col("created_at").alias("updated_at"))
    half = F.pmod(F.hash("state_key", "updated_at"), F.lit(2)) == 0
    return tasks.put_state(s.where(half), s.where(~half))


@query(over("e_") + f"SELECT entity_key, display_name, identity_profile.who AS who FROM e_ WHERE memory_space = '{SPACE}' AND entity_key = (SELECT min(entity_key) FROM e_ WHERE memory_space = '{SPACE}')")
def q_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The entity of the smallest key of a space, read by its key."""
    e = b.entities(spark, d)
    key = e.where(F.col("memory_space") == SPACE).agg(F.min("entity_key")).first()[0] or ""
    return lookup.point(e, memory_space=SPACE, entity_key=key).select("entity_key", "display_name", F.col("identity_profile.who").alias("who"))


@query(over("m_") + f"SELECT memory_id, entity_key, status, updated_at FROM m_ WHERE memory_space = '{SPACE}' AND status IN ('active', 'stale') ORDER BY updated_at DESC NULLS LAST, memory_id LIMIT 300")
def q_list_memories(spark: SparkSession, d: str) -> DataFrame:
    m = b.memories(spark, d).where(F.col("status").isin(lookup.known_statuses("active,stale", stats.MEMORY_STATUSES)))
    return lookup.top(m, "updated_at", "memory_id", 300, memory_space=SPACE).select("memory_id", "entity_key", "status", "updated_at")


@query(over("g_") + f"SELECT edge_id, edge_type, created_at FROM g_ WHERE memory_space = '{SPACE}' AND edge_type IN ('supports', 'updates') ORDER BY created_at NULLS LAST, edge_id LIMIT 5000")
def q_list_edges(spark: SparkSession, d: str) -> DataFrame:
    e = b.edges(spark, d).where(F.col("edge_type").isin("supports", "updates"))
    return lookup.top(e, "created_at", "edge_id", 5000, newest=False, memory_space=SPACE).select("edge_id", "edge_type", "created_at")


@query(over("e_", "m_") + "SELECT 'entity' AS kind, memory_space, entity_key AS id, created_at FROM e_ UNION ALL SELECT 'memory', memory_space, memory_id, created_at FROM m_")
def q_all_records(spark: SparkSession, d: str) -> DataFrame:
    """Every entity and memory, as a rebuild reads them: one scan each, in no pages."""
    part = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), "memory_space", F.col(key).alias("id"), "created_at")
    return part(b.entities(spark, d), "entity", "entity_key").unionByName(part(b.memories(spark, d), "memory", "memory_id"))


@query(over("m_") + "SELECT memory_space, memory_id FROM (SELECT *, row_number() OVER (PARTITION BY memory_space ORDER BY created_at NULLS LAST, memory_id) AS n FROM m_) WHERE n > 5 AND n <= 15")
def q_rebuild_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of ten of every space, five rows in, oldest first."""
    m = b.memories(spark, d).withColumn("n", -F.col("created_at"))
    return lookup.recent_per_key(m, ["memory_space"], "n", "memory_id", 15).where("rank > 5").select("memory_space", "memory_id")


@query(over("tasks_") + "SELECT task_id, task_type, status, created_at FROM tasks_ WHERE status IN ('pending', 'running') AND task_type IN ('continue_ingest', 'reindex_memory') ORDER BY created_at, task_id LIMIT 1000")
def q_list_tasks(spark: SparkSession, d: str) -> DataFrame:
    t = b.tasks(spark, d).where(F.col("status").isin("pending", "running") & F.col("task_type").isin("continue_ingest", "reindex_memory"))
    return lookup.top(t, "created_at", "task_id", 1000, newest=False).select("task_id", "task_type", "status", "created_at")


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Recall audits as the results of their requests, with traces that follow from the number of the query."""
    a = b.recall_audits(spark, d).withColumn("n", F.replace("query", F.lit("query "), F.lit("")).cast("int"))
    n = F.col("n")
    word = lambda p, m: F.concat(F.lit(p), (n % m).cast("string"))
    return a.select(
        "request_id", F.col("audit_id").alias("position"), "query", "status", F.when(F.col("status") == "ok", F.concat(F.lit("about "), "query")).alias("answer"),
        F.array(word("mem_", 5), F.lit(" "), word("mem_", 3)).alias("memory_ids"), F.array(word("obs_", 4)).alias("observation_ids"), F.when(n % 3 > 0, F.array(F.lit("supports"), F.when(n % 2 == 0, "updates"))).alias("edge_types"),
        (n % 4).alias("n_citations"), F.when(n % 6 == 0, F.array(F.lit("old"))).alias("uncertainties"), F.when(n % 2 == 0, "cross_entity").otherwise(F.when(n % 5 > 0, "entity_local")).alias("graph_intent"),
        F.when(n % 3 < 2, n % 3 == 0).alias("dynamic_skipped"), F.when(n % 4 > 0, F.lit(True)).alias("graph_first_attempted"), (n % 4 == 1).alias("graph_first_used"), F.when(n % 4 == 2, "ambiguous").when(n % 4 == 3, " ").alias("fallback_reason"),
        F.when(n % 7 > 2, n % 7).alias("profile_revision"),
    )


def _listed(name: str, *values: str) -> str:
    """A common table: the request's different values in order."""
    each = " UNION ALL ".join(f"SELECT request_id, audit_id, {i} AS i, {v} AS v FROM a" for i, v in enumerate(values))
    return f"{name} AS (SELECT request_id, array_to_string(list(v ORDER BY f), ',') AS l FROM (SELECT request_id, v, min(struct_pack(p := audit_id, i := i)) AS f FROM ({each}) WHERE trim(coalesce(v, ''), ' ') <> '' GROUP BY 1, 2) GROUP BY 1)"


@query(
    over("audits_")
    + f""", a AS (SELECT *, CAST(replace(query, 'query ', '') AS INT) AS n FROM audits_), {_listed("mem", "'mem_' || (n % 5)", "' '", "'mem_' || (n % 3)")}, {_listed("obs", "'obs_' || (n % 4)")},
{_listed("edge", "CASE WHEN n % 3 > 0 THEN 'supports' END", "CASE WHEN n % 3 > 0 AND n % 2 = 0 THEN 'updates' END")}, {_listed("unc", "CASE WHEN n % 6 = 0 THEN 'old' END")}, {_listed("int_", "CASE WHEN n % 2 = 0 THEN 'cross_entity' WHEN n % 5 > 0 THEN 'entity_local' END")},
{_listed("why", "CASE WHEN n % 4 = 2 THEN 'ambiguous' END")}
SELECT request_id, arg_min(query, audit_id) AS query_preview, length(arg_min(query, audit_id)) AS query_length, count(*) AS result_count, count(*) FILTER (status = 'ok') AS ok_result_count, count(*) FILTER (status = 'partial') AS partial_result_count,
  count(*) FILTER (status = 'rejected') AS rejected_result_count, count(*) FILTER (status = 'not_ready') AS not_ready_result_count, sum(n % 4) AS citation_count, coalesce(sum(CASE WHEN status = 'ok' THEN length('about ' || query) ELSE 0 END), 0) AS answer_length,
  count(*) FILTER (n % 3 = 0) AS dynamic_skipped_count, count(*) FILTER (n % 3 = 1) AS dynamic_run_count, count(*) FILTER (n % 4 > 0) AS graph_first_attempted_count, count(*) FILTER (n % 4 = 1) AS graph_first_used_count,
  coalesce(array_to_string(list(n % 7 ORDER BY audit_id) FILTER (n % 7 > 2), ','), '') AS profile_revisions, coalesce(any_value(mem.l), '') AS key_memory_ids, coalesce(any_value(obs.l), '') AS supporting_observation_ids, coalesce(any_value(edge.l), '') AS used_edge_types,
  coalesce(any_value(unc.l), '') AS uncertainties, coalesce(any_value(int_.l), '') AS graph_expansion_intents, coalesce(any_value(why.l), '') AS fallback_reasons
FROM a LEFT JOIN mem USING (request_id) LEFT JOIN obs USING (request_id) LEFT JOIN edge USING (request_id) LEFT JOIN unc USING (request_id) LEFT JOIN int_ USING (request_id) LEFT JOIN why USING (request_id) GROUP BY 1"""
)
def a_audit_metadata(spark: SparkSession, d: str) -> DataFrame:
    out = stats.audit_metadata(_results(spark, d), ["request_id"])
    lists = ["profile_revisions", "key_memory_ids", "supporting_observation_ids", "used_edge_types", "uncertainties", "graph_expansion_intents", "fallback_reasons"]
    return out.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in lists})


@query(
    over("audits_")
    + """, e AS (SELECT request_id, audit_id, 1 AS pos, 'retrieve' AS stage, CAST(floor(latency_ms) AS BIGINT) AS ms FROM audits_ UNION ALL SELECT request_id, audit_id, 1, status, CAST(floor(latency_ms) AS BIGINT) % 100 FROM audits_
UNION ALL SELECT request_id, audit_id, 2, CASE WHEN error_code IS NULL THEN 'retrieve' ELSE 'judge' END, CAST(floor(latency_ms) AS BIGINT) % 10 FROM audits_),
l AS (SELECT request_id, stage, arg_max(ms, struct_pack(i := audit_id, a := pos)) AS ms FROM e WHERE ms IS NOT NULL GROUP BY 1, 2) SELECT request_id, array_to_string(list(stage || '=' || ms ORDER BY stage), ',') AS stages FROM l GROUP BY 1"""
)
def a_stage_timings(spark: SparkSession, d: str) -> DataFrame:
    """Timings of the stages of a request's drafts, merged: of a stage that comes again, the last value stands."""
    ms = F.floor("latency_ms").cast("long")
    a = b.recall_audits(spark, d).select("request_id", "audit_id", F.create_map(F.lit("retrieve"), ms, F.col("status"), ms % 100).alias("one"), F.create_map(F.when(F.col("error_code").isNull(), "retrieve").otherwise("judge"), ms % 10).alias("two"))
    out = stats.merged_timings(a, ["request_id"], ["one", "two"], ["audit_id"])
    stage = F.transform(F.map_entries("stages"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return out.select("request_id", F.array_join(F.array_sort(stage), ",").alias("stages"))


@query(
    over("audits_")
    + """, w AS (SELECT memory_space AS run, status, max(created_at) - min(created_at) AS w FROM audits_ GROUP BY 1, 2)
SELECT status, count(*) AS n, round(avg(latency_ms), 6) AS mean_ms, median(latency_ms) AS median_ms, quantile_disc(latency_ms, 0.95) AS p95_ms, max(latency_ms) AS max_ms, min(latency_ms) AS min_ms, round(sum(latency_ms), 4) AS total_ms,
  (SELECT round(sum(w), 3) FROM w WHERE w.status = audits_.status) AS wall_clock_ms FROM audits_ GROUP BY 1"""
)
def a_merged_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Every space as a run, its audits of one status as the samples of a summary."""
    runs = b.recall_audits(spark, d).groupBy(F.col("memory_space").alias("run"), "status").agg(F.collect_list("latency_ms").alias("samples"), (F.max("created_at") - F.min("created_at")).alias("wall_clock_ms"))
    out = stats.merged_summaries(runs, ["status"])
    return out.withColumns({"mean_ms": F.round("mean_ms", 6), "total_ms": F.round("total_ms", 4), "wall_clock_ms": F.round("wall_clock_ms", 3)})
