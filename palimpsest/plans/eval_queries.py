"""Queries of grading and of the work around judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import evals, workers
from palimpsest.plans.views import over
from palimpsest.sources import bindings as b

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _cases(spark: SparkSession, d: str) -> DataFrame:
    """Recall requests as cases: their status, error and latency are the dimensions."""
    a = b.recall_audits(spark, d)
    dims = F.create_map(F.lit("status"), F.col("status") == "ok", F.lit("error"), F.col("error_code").isNull(), F.lit("latency"), F.col("latency_ms") < 1000)
    return a.select(F.col("audit_id").alias("case_id"), F.col("query").alias("category"), F.col("memory_space").alias("suite_id"), dims.alias("dimensions"))


_CASES = "cases AS (SELECT audit_id, query AS category, memory_space AS suite_id, status = 'ok' AS s, error_code IS NULL AS e, latency_ms < 1000 AS l FROM audits_)"


@query(
    over("audits_")
    + f""", {_CASES}, p AS (SELECT 'all' AS kind, 'all' AS label, s AND e AND l AS passed FROM cases UNION ALL SELECT 'category', category, s AND e AND l FROM cases UNION ALL SELECT 'dimension', 'status', s FROM cases
  UNION ALL SELECT 'dimension', 'error', e FROM cases UNION ALL SELECT 'dimension', 'latency', l FROM cases)
SELECT kind, label, count(*) AS n, count(*) FILTER (passed) AS n_passed, round(count(*) FILTER (passed) / count(*), 4) AS pass_rate FROM p GROUP BY 1, 2"""
)
def e_case_summary(spark: SparkSession, d: str) -> DataFrame:
    return evals.case_summary(_cases(spark, d))


@query(
    over("audits_")
    + f""", {_CASES} SELECT suite_id, count(*) AS n, count(*) FILTER (s AND e AND l) AS n_passed, round(count(*) FILTER (s AND e AND l) / count(*), 4) AS pass_rate, count(*) FILTER (s AND e AND l) < count(*) AS failing FROM cases GROUP BY 1"""
)
def e_suite_summary(spark: SparkSession, d: str) -> DataFrame:
    return evals.suite_summary(_cases(spark, d))


_TYPES = "task_type IN ('continue_ingest', 'refresh_entity_profile')"


@query(
    over("tasks_")
    + f""", c AS (SELECT memory_space, count(*) FILTER ({_TYPES} AND status IN ('pending', 'failed')) AS n_pending, count(*) FILTER ({_TYPES} AND status = 'running') AS n_running, count(*) FILTER ({_TYPES} AND status = 'dead_letter') AS n_dead,
  count(*) FILTER (task_type IN ('continue_ingest', 'reindex_memory', 'repair_memory_edges') AND status IN ('pending', 'failed', 'running')) AS n_critical FROM tasks_ GROUP BY 1)
SELECT memory_space, n_pending + n_running = 0 AS settled, n_pending, n_running, n_dead, n_pending + n_running = 0 OR n_critical = 0 AS settled_after_all FROM c"""
)
def e_settled(spark: SparkSession, d: str) -> DataFrame:
    t = b.tasks(spark, d)
    return evals.settled(t, t, ["continue_ingest", "refresh_entity_profile"])


@query(
    over("m_")
    + """, ex AS (SELECT memory_space, status AS label, count(*) + CASE WHEN status = 'stale' THEN 1 ELSE 0 END AS n FROM m_ GROUP BY 1, 2)
SELECT memory_space AS case_id, 'primary' AS scope, 'memory_status[stale] expected ' || n || ', got ' || (n - 1) AS failure FROM ex WHERE label = 'stale'"""
)
def e_count_failures(spark: SparkSession, d: str) -> DataFrame:
    m = b.memories(spark, d).groupBy("memory_space", F.lit("memory_status").alias("kind"), F.col("status").alias("label")).agg(F.count("*").alias("n"))
    expected = m.select(F.col("memory_space").alias("case_id"), F.lit("primary").alias("scope"), "memory_space", "kind", "label", (F.col("n") + F.when(F.col("label") == "stale", 1).otherwise(0)).alias("n"))
    return evals.count_failures(expected, m)


@query(
    over("audits_")
    + """, la AS (SELECT memory_space, query, max(struct_pack(c := created_at, a := audit_id, s := status, e := error_code)) AS x FROM audits_ GROUP BY 1, 2)
SELECT audit_id, list_filter([CASE WHEN a.status <> 'ok' THEN 'status' END, CASE WHEN error_code IS NOT NULL THEN 'error_code' END, CASE WHEN x.s <> a.status THEN 'audit status' END,
  CASE WHEN x.e IS DISTINCT FROM a.error_code THEN 'audit error code' END], lambda v: v IS NOT NULL)[1] AS failure FROM audits_ a JOIN la USING (memory_space, query)"""
)
def e_query_failures(spark: SparkSession, d: str) -> DataFrame:
    a = b.recall_audits(spark, d)
    last = a.groupBy("memory_space", "query").agg(F.max(F.struct("created_at", "audit_id", "status", "error_code")).alias("x"))
    r = a.join(last, ["memory_space", "query"]).select(
        "audit_id", "status", "error_code", F.lit("x").alias("answer"), F.lit(0).alias("n_citations"), F.array().cast("array<string>").alias("uncertainties"), F.lit(1).alias("n_results"),
        F.lit("ok").alias("expected_status"), F.lit(None).cast("string").alias("expected_error_code"), F.lit(True).alias("non_empty_answer"), F.lit(0).alias("citations_min"),
        F.array().cast("array<string>").alias("required_prefixes"), F.lit(None).cast("int").alias("expected_result_count"), F.col("x.status").alias("audit_status"), F.col("x.error_code").alias("audit_error_code"),
    )
    return evals.query_failures(r).select("audit_id", F.get("failures", F.lit(0)).alias("failure"))


@query(
    """SELECT event_id, CAST(props->>'$.k' AS INT) AS input_tokens, CAST(props->>'$.k' AS INT) AS cache_miss_tokens FROM events"""
)
def w_usage_tokens(spark: SparkSession, d: str) -> DataFrame:
    from palimpsest.sources.tables import table

    usage = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("int").alias("prompt_tokens")))
    return table(spark, d, "events").select("event_id", workers.usage_tokens(usage).alias("u")).select("event_id", "u.input_tokens", "u.cache_miss_tokens")
