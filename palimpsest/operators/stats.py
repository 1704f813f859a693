"""Usage, audit and state statistics. All are partial aggregates; nothing is sorted or collected beyond its groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN_COLUMNS = ["input_tokens", "output_tokens", "cached_tokens"]
MEMORY_STATUSES = ["active", "superseded", "stale", "archived"]
#: Task types that a settled state must have done.
CRITICAL_TASKS = ["continue_ingest", "reindex_memory", "repair_memory_edges"]


def hit_rate() -> Column:
    cached, read = F.col("cached_tokens"), F.col("input_tokens")
    return F.when(read > 0, cached / read).otherwise(F.lit(0.0)).alias("cache_hit_rate")


def llm_usage(runs: DataFrame, since: float | None = None) -> DataFrame:
    """(worker_type, n_runs, tokens…, cache_hit_rate) of every worker and, with a null worker, of all; null tokens count 0."""
    if since is not None:
        runs = runs.where(F.col("created_at") >= since)
    sums = [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in TOKEN_COLUMNS]
    grouped = runs.groupingSets([[], ["worker_type"]], "worker_type").agg(F.count("*").alias("n_runs"), *sums, F.grouping("worker_type").alias("whole"))
    nothing = "SELECT CAST(NULL AS STRING) AS worker_type, 0L AS n_runs, 0L AS input_tokens, 0L AS output_tokens, 0L AS cached_tokens, CAST(1 AS TINYINT) AS whole"
    grouped = grouped.unionByName(runs.sparkSession.sql(nothing))  # the total of no runs is a row of zeros
    grouped = grouped.groupBy("worker_type", "whole").agg(*[F.sum(c).alias(c) for c in ("n_runs", *TOKEN_COLUMNS)])
    return grouped.select("*", hit_rate())


def kept_runs(runs: DataFrame, now: float, days: float = 7) -> DataFrame:
    """Runs within the retention; those without a time are kept."""
    return runs.where(F.col("created_at").isNull() | (F.col("created_at") >= now - days * 86_400))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n_rows), also for empty tables."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def next_versions(versions: DataFrame) -> DataFrame:
    """(memory_space, memory_id, next_version): one more than the greatest version, 1 if no version has a number."""
    return versions.groupBy("memory_space", "memory_id").agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"))


def scope_snapshot(memories: DataFrame, edges: DataFrame, tasks: DataFrame) -> DataFrame:
    """(memory_space, kind, label, n): memories by status, edges by type, open tasks by type, critical ones apart."""
    part = lambda df, kind, label: df.groupBy("memory_space", F.col(label).alias("label")).agg(F.count("*").alias("n")).select("memory_space", F.lit(kind).alias("kind"), "label", "n")
    open_ = tasks.where(F.col("status").isin("pending", "running"))
    critical = open_.where(F.col("task_type").isin(CRITICAL_TASKS))
    return (
        part(memories, "memory_status", "status")
        .unionByName(part(edges, "edge_type", "edge_type"))
        .unionByName(part(open_, "open_task", "task_type"))
        .unionByName(part(critical, "critical_task", "task_type"))
    )


def latency(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """n, mean, median, p95 (a value that occurs), longest, shortest and total of every key, over all samples at once: samples
    of several runs are put together first, never their averages. Nulls are no samples."""
    c = F.col(column)
    return df.where(c.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(c).alias("mean_ms"),
        F.median(c).alias("median_ms"),
        F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {column})").alias("p95_ms"),
        F.max(c).alias("max_ms"),
        F.min(c).alias("min_ms"),
        F.sum(c).alias("total_ms"),
    )


def request_status(audits: DataFrame) -> DataFrame:
    """(memory_space, request_id, status, error_code) over the drafts of a request: ok if all are, partial if some are,
    not_ready if all are, else rejected; the error code only if the drafts that failed have exactly one."""
    ok = F.col("status") == "ok"
    grouped = audits.groupBy("memory_space", "request_id").agg(
        F.count("*").alias("n"),
        F.count_if(ok).alias("n_ok"),
        F.count_if(F.col("status") == "not_ready").alias("n_waiting"),
        F.min(F.when(~ok, F.col("error_code"))).alias("least"),
        F.max(F.when(~ok, F.col("error_code"))).alias("most"),
    )
    status = F.when(F.col("n_ok") == F.col("n"), "ok").when(F.col("n_ok") > 0, "partial").when(F.col("n_waiting") == F.col("n"), "not_ready").otherwise("rejected")
    return grouped.select("memory_space", "request_id", status.alias("status"), F.when(F.col("least") == F.col("most"), F.col("least")).alias("error_code"))


def audit_summary(audits: DataFrame) -> DataFrame:
    """Counts of every space's audits by status and error code."""
    count = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    return audits.groupBy("memory_space").agg(
        F.count("*").alias("n_audits"), count("ok"), count("rejected"), count("not_ready"),
        F.count_distinct("request_id").alias("n_requests"), F.count_distinct("error_code").alias("n_error_codes"),
    )


def merged_timings(df: DataFrame, keys: list[str], timings: list[str], order: list[str]) -> DataFrame:
    """One map column after the other merged, newest rows last: of a stage that comes again, the last value stands."""
    entries = df.select(*keys, *order, F.posexplode(F.array(*timings)).alias("at", "m")).select(*keys, *order, "at", F.explode("m").alias("stage", "ms"))
    last = entries.where("ms IS NOT NULL").groupBy(*keys, "stage").agg(F.max_by("ms", F.struct(*order, "at")).alias("ms"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "ms")))).alias("stages"))


#: Fixed value: characters of a query that an audit shows.
PREVIEW_CHARS = 512
ITEM_STATUSES = ["ok", "partial", "rejected", "not_ready"]


def _in_order(items: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """(keys, name): the different non-blank values of each key, in the order of ``position`` (then place within the row)."""
    told = items.select(*keys, "position", F.posexplode(value).alias("at", "v")).where(F.btrim(F.coalesce("v", F.lit(""))) != "")
    first = told.groupBy(*keys, F.btrim("v").alias("v")).agg(F.min(F.struct("position", "at")).alias("f"))
    return first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("f", "v")))["v"].alias(name))


def audit_metadata(items: DataFrame, keys: list[str]) -> DataFrame:
    """What an audit says of each request, from its results (keys, position, query, status, answer, memory_ids, observation_ids, edge_types,
    n_citations, uncertainties, graph_intent, dynamic_skipped, graph_first_attempted, graph_first_used, fallback_reason, profile_revision).

    Counts by status; different ids, edge types, intents and reasons in the order of first occurrence; how often the dynamic step was
    skipped and run (null is neither), and how often the graph-first way was tried and used; the profile revisions of all results that
    have one, in order. A request's lists are bounded by its results."""
    flat = F.btrim(F.replace(F.coalesce("query", F.lit("")), F.lit("\n"), F.lit(" ")))
    count = lambda s: F.count_if(F.col("status") == s).alias(f"{s}_result_count")
    base = items.groupBy(*keys).agg(
        F.min_by(flat, "position").alias("__q"), F.count("*").alias("result_count"), *[count(s) for s in ITEM_STATUSES], F.sum(F.coalesce("n_citations", F.lit(0))).alias("citation_count"),
        F.sum(F.length(F.coalesce("answer", F.lit("")))).alias("answer_length"), F.count_if(F.col("dynamic_skipped")).alias("dynamic_skipped_count"), F.count_if(~F.col("dynamic_skipped")).alias("dynamic_run_count"),
        F.count_if(F.col("graph_first_attempted")).alias("graph_first_attempted_count"), F.count_if(F.col("graph_first_used")).alias("graph_first_used_count"),
        F.array_sort(F.collect_list(F.when(F.col("profile_revision").isNotNull(), F.struct("position", "profile_revision"))))["profile_revision"].alias("profile_revisions"),
    )
    out = base.select(*keys, F.substring("__q", 1, PREVIEW_CHARS).alias("query_preview"), F.length("__q").alias("query_length"), *[c for c in base.columns if c not in (*keys, "__q")])
    lists = {"key_memory_ids": F.col("memory_ids"), "supporting_observation_ids": F.col("observation_ids"), "used_edge_types": F.col("edge_types"), "uncertainties": F.col("uncertainties")}
    lists |= {"graph_expansion_intents": F.array("graph_intent"), "fallback_reasons": F.array("fallback_reason")}
    for name, value in lists.items():
        out = out.join(_in_order(items, keys, value, name), keys, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


def merged_summaries(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Timing summaries of several runs (run, keys, samples array, wall_clock_ms) as one: statistics over all samples together, as
    ``latency`` has them, and the wall clocks of the runs summed; a run counts once for each key."""
    samples = runs.select(*keys, F.explode("samples").alias("ms"))
    clocks = runs.groupBy("run", *keys).agg(F.max("wall_clock_ms").alias("w")).groupBy(*keys).agg(F.sum("w").alias("wall_clock_ms"))
    return latency(samples, keys, "ms").join(clocks, keys)
