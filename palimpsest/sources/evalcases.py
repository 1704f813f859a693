"""Evaluation cases, suites and reports: JSON in, JSON and Markdown out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASE = """case_id string, category string, description string, settle_timeout_seconds double, memory_scope_templates map<string,string>,
writes array<struct<context:string,raw_sample_id:string,expected_status:string,scope:string,concurrency_group:string>>,
queries array<struct<query_id:string,query:string,expected_status:string,expected_error_code:string,expected_result_count:int,scope:string,
citations_min:int,non_empty_answer:boolean,required_uncertainties:array<string>,required_uncertainty_prefixes:array<string>,
judge_required_facts:array<string>,judge_forbidden_facts:array<string>>>,
expected map<string,struct<entity_count:int,memory_count:int,observation_count:int,recall_audit_count:int,memory_status_counts:map<string,int>,
edge_type_counts:map<string,int>,required_memory_texts:array<string>,forbidden_memory_texts:array<string>>>"""
#: Rows of a report that its table for reading shows.
SHOWN = 1_000
MANIFEST = "matrix_id string, description string, suites array<struct<suite_id:string,description:string,cases:string,run_id:string,settle_timeout_seconds:double>>"


def cases(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Cases of JSON files that each hold a list, with defaults filled in. A case without a template for the scope ``primary``
    fails the job when it is read."""
    c = spark.read.schema(CASE).json(paths, multiLine=True)
    primary = F.coalesce(F.map_contains_key("memory_scope_templates", F.lit("primary")), F.lit(False))
    checked = F.when(primary, F.col("case_id")).otherwise(F.raise_error(F.concat(F.lit("no primary scope: "), F.coalesce("case_id", F.lit("?")))))
    scope = lambda x: F.coalesce(x["scope"], F.lit("primary"))
    writes = F.transform("writes", lambda x: x.withField("expected_status", F.coalesce(x["expected_status"], F.lit("accepted"))).withField("scope", scope(x)))
    queries = F.transform(
        "queries",
        lambda x: x.withField("expected_status", F.coalesce(x["expected_status"], F.lit("ok"))).withField("scope", scope(x))
        .withField("citations_min", F.coalesce(x["citations_min"], F.lit(0))).withField("non_empty_answer", F.coalesce(x["non_empty_answer"], F.lit(False))),
    )
    return c.withColumns({"case_id": checked, "writes": writes, "queries": queries})


def suites(spark: SparkSession, path: str) -> DataFrame:
    """(matrix_id, suite_id, description, cases, run_id, settle_timeout_seconds) of a manifest; ``cases`` is a path relative to it."""
    return spark.read.schema(MANIFEST).json(path, multiLine=True).select("matrix_id", F.explode("suites").alias("s")).select("matrix_id", "s.*")


def write_report(summary: DataFrame, folder: str) -> str:
    """Write a summary, whole, as JSON lines, and return it as a Markdown table for reading: of its first ``SHOWN`` rows, with a line
    below that says so where there are more."""
    summary.coalesce(1).write.mode("overwrite").json(folder)
    shown = summary.limit(SHOWN + 1).collect()
    rows = [summary.columns, ["-"] * len(summary.columns), *[[str(v) for v in r] for r in shown[:SHOWN]]]
    table = "\n".join("| " + " | ".join(r) + " |" for r in rows)
    return table if len(shown) <= SHOWN else f"{table}\n\nMore than {SHOWN} rows; all are in {folder}."
