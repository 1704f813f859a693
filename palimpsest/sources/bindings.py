"""The engine's tables as they lie in a folder: ids cleaned, repeated deliveries taken once.

Control tables that the folder does not hold (model runs, tasks, recall audits) are derived from its ``events``, so that their
queries run over data that grows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.ids import clean_id
from palimpsest.sources.tables import table

TASK_TYPES = ["continue_ingest", "reindex_memory", "refresh_entity_profile", "repair_memory_edges", "detect_merge_candidates"]
TASK_STATUSES = ["pending", "running", "succeeded", "failed", "dead_letter", "cancelled"]
AUDIT_STATUSES = ["ok", "ok", "rejected", "not_ready"]


def _once(df: DataFrame, *keys: str) -> DataFrame:
    return df.dropna(subset=list(keys)).dropDuplicates(list(keys))


def entities(spark: SparkSession, folder: str) -> DataFrame:
    return _once(table(spark, folder, "entities").withColumn("entity_key", clean_id("entity_key")), "memory_space", "entity_key")


def memories(spark: SparkSession, folder: str) -> DataFrame:
    ids = {c: clean_id(c) for c in ("memory_id", "entity_key", "latest_source_observation_id")}
    return _once(table(spark, folder, "memories").withColumns(ids), "memory_space", "memory_id")


def observations(spark: SparkSession, folder: str) -> DataFrame:
    return _once(table(spark, folder, "observations").withColumn("observation_id", clean_id("observation_id")), "memory_space", "observation_id")


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges with both ends named."""
    ids = {c: clean_id(c) for c in ("edge_id", "from_kind", "from_id", "to_kind", "to_id")}
    return _once(table(spark, folder, "edges").withColumns(ids).dropna(subset=list(ids)), "edge_id")


def versions(spark: SparkSession, folder: str) -> DataFrame:
    ids = {c: clean_id(c) for c in ("version_id", "memory_id", "action", "trigger_observation_id")}
    return _once(table(spark, folder, "versions").withColumns(ids), "version_id")


def drafts(spark: SparkSession, folder: str) -> DataFrame:
    return _once(table(spark, folder, "identity_drafts").withColumn("draft_id", clean_id("draft_id")), "draft_id")


def _choice(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def _events(spark: SparkSession, folder: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # times without a zone are in UTC
    k = F.get_json_object("props", "$.k").cast("int")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1_000_000.0)
    return table(spark, folder, "events").withColumns({"k": k, "at": at, "memory_space": F.concat(F.lit("space_"), F.col("user_id").cast("string"))})


def llm_runs(spark: SparkSession, folder: str) -> DataFrame:
    e = _events(spark, folder)
    used = F.floor(F.col("value") * 10).cast("long")
    return e.select(
        F.concat(F.lit("run_"), F.col("event_id").cast("string")).alias("run_id"),
        "memory_space",
        F.col("event_type").alias("worker_type"),
        F.when(F.col("event_id") % 17 != 0, used).alias("input_tokens"),
        F.col("k").cast("long").alias("output_tokens"),
        F.floor(used * F.col("k") / 200).cast("long").alias("cached_tokens"),
        F.when(F.col("event_id") % 10 == 0, "schema_error").otherwise("ok").alias("parse_status"),
        F.col("at").alias("created_at"),
    )


def tasks(spark: SparkSession, folder: str) -> DataFrame:
    e = _events(spark, folder).withColumn("task_type", _choice(TASK_TYPES, F.col("event_id"))).withColumn("status", _choice(TASK_STATUSES, F.col("k")))
    return e.select(
        F.concat(F.lit("task_"), F.col("event_id").cast("string")).alias("task_id"),
        "memory_space",
        "task_type",
        "status",
        (F.col("k") % 20).alias("priority"),
        (F.col("k") % 4).alias("attempts"),
        F.lit(3).alias("max_attempts"),
        (F.col("at") + F.col("k") % 7).alias("available_at"),
        F.when(F.col("status") == "running", F.col("at") + 60).alias("lease_expires_at"),
        F.concat_ws(":", "task_type", (F.col("k") % 5).cast("string")).alias("dedupe_key"),
        F.concat(F.lit("ent_"), (F.col("k") % 10).cast("string")).alias("entity_key"),
        F.array(F.concat(F.lit("mem_"), F.col("k").cast("string")), F.concat(F.lit("mem_"), (F.col("k") + 1).cast("string"))).alias("memory_ids"),
        F.col("at").alias("created_at"),
    )


def recall_audits(spark: SparkSession, folder: str) -> DataFrame:
    e = _events(spark, folder).withColumn("status", _choice(AUDIT_STATUSES, F.col("event_id")))
    return e.select(
        F.concat(F.lit("audit_"), F.col("event_id").cast("string")).alias("audit_id"),
        "memory_space",
        F.concat(F.lit("req_"), F.floor(F.col("event_id") / 3).cast("string")).alias("request_id"),
        F.concat(F.lit("query "), (F.col("k") % 25).cast("string")).alias("query"),
        "status",
        F.when(F.col("status") == "rejected", F.when(F.col("k") % 2 == 0, "no_identity").otherwise("recall_failed")).alias("error_code"),
        (F.col("value") * 10).alias("latency_ms"),
        F.col("at").alias("created_at"),
    )
