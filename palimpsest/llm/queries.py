"""The registered queries of the training-data operators (p1, p3, p4, p6, p7, p8) and their SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import groups, looks, names, packing, tokens, truncation
from palimpsest.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return names.variant_pairs(table(spark, folder, "identity_drafts"), table(spark, folder, "name_aliases"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return groups.entity_groups(table(spark, folder, "merge_logs"))


def _fields(spark: SparkSession, folder: str) -> DataFrame:
    return looks.text_fields(table(spark, folder, "identity_drafts"), table(spark, folder, "observations"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return looks.look_alike_pairs(_fields(spark, folder))


def p4_forms(spark: SparkSession, folder: str) -> DataFrame:
    return looks.doubles(_fields(spark, folder))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encoded(table(spark, folder, "documents"))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    sizes = tokens.token_counts(table(spark, folder, "documents"))
    placed = packing.containers(sizes, packing.window_sizes(table(spark, folder, "context_windows")))
    return placed.withColumnsRenamed({"item": "doc_id", "size": "n_tokens"})


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(p7_containers(spark, folder).withColumnRenamed("n_tokens", "size"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.judged_documents(table(spark, folder, "documents")).where("cut").select("doc_id")


def p8_sources(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return truncation.cut_shares(documents, truncation.judged_documents(documents))


QUERIES = {f.__name__: f for f in (p1_found, p3_found, p4_found, p4_forms, p6_ids, p7_containers, p7_fill, p8_found, p8_sources)}

_B = r"chr(32)||chr(9)||chr(10)||chr(13)||chr(11)||chr(12)"


def _id(c: str) -> str:
    return f"nullif(lower(trim({c}, {_B})), '')"


ORACLE = {
    "p3_found": f"""
WITH RECURSIVE pairs AS (
  SELECT DISTINCT memory_space, {_id("source_entity_key")} AS a, {_id("target_entity_key")} AS b FROM merge_logs
  WHERE {_id("source_entity_key")} IS NOT NULL AND {_id("target_entity_key")} IS NOT NULL AND memory_space IS NOT NULL),
both_ways AS (SELECT * FROM pairs UNION SELECT memory_space, b, a FROM pairs),
reach AS (
  SELECT memory_space, a, a AS b FROM both_ways
  UNION
  SELECT r.memory_space, r.a, w.b FROM reach r JOIN both_ways w ON w.memory_space = r.memory_space AND w.a = r.b)
SELECT memory_space, a AS entity_key, min(b) AS group_key FROM reach GROUP BY ALL""",
}
