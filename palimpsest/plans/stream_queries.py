"""Queries that run a table through a stream until nothing is left, and read what it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.checkpoints import shared_folder
from palimpsest.operators import changes
from palimpsest.plans.record_queries import _NEWEST
from palimpsest.plans.write_queries import NOW, _norm
from palimpsest.sources.snapshots import BucketedSnapshots
from palimpsest.sources.tables import table
from palimpsest.streaming import ingest


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    # as a pattern, since a table may be one file or a folder of files
    return ingest.stream_table(spark, f"{d.rstrip('/')}/{name}.parque[t]", table(spark, d, name).schema)


def s_followed_changes(spark: SparkSession, d: str) -> DataFrame:
    """The change feed as a stream: the newest change of every memory, tombstones included."""
    folder = f"{shared_folder(spark)}/palimpsest-stream-{uuid.uuid4().hex}"
    columns = [*changes.VERSION_KEYS, *changes.VERSION_ORDER, "action"]
    schema = changes.version_changes(table(spark, d, "versions")).select(*columns).schema
    newest = BucketedSnapshots(spark, f"{folder}/newest", schema, changes.VERSION_KEYS, buckets=8)
    ingest.follow_changes(_stream(spark, d, "versions"), newest, f"{folder}/checkpoint").awaitTermination()
    return newest.read().select("memory_space", "memory_id", "version_id", "action")


def s_ingested_texts(spark: SparkSession, d: str) -> DataFrame:
    """The documents as a stream of texts: one pending observation each."""
    folder = f"{shared_folder(spark)}/palimpsest-stream-{uuid.uuid4().hex}"
    schema = "observation_id string, memory_space string, source_ref string, content string, summary string, entity_resolution_status string, metadata string, created_at double"
    held = BucketedSnapshots(spark, f"{folder}/observations", spark.createDataFrame([], schema).schema, ["observation_id"], buckets=8)
    texts = _stream(spark, d, "documents").where("text IS NOT NULL")
    texts = texts.select("memory_space", F.col("source").alias("source_ref"), F.col("text").alias("content"), F.col("doc_id").cast("string").alias("request_id"))
    ingest.ingest_texts(texts, held, NOW, f"{folder}/checkpoint").awaitTermination()
    return held.read().select("observation_id", "memory_space", "source_ref", "summary")


QUERIES = {f.__name__: f for f in (s_followed_changes, s_ingested_texts)}
ORACLE = {
    "s_followed_changes": _NEWEST + "SELECT memory_space, memory_id, version_id, action FROM newest WHERE n = 1",
    "s_ingested_texts": f"""SELECT DISTINCT 'obs_' || substr(sha256(concat_ws(chr(31), memory_space, CAST(doc_id AS VARCHAR), text)), 1, 32) AS observation_id, memory_space, source AS source_ref, substr({_norm("text")}, 1, 500) AS summary
FROM documents WHERE text IS NOT NULL""",
}
