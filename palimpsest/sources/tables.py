"""Reading the engine's tables; every reader only declares a scan, so filters and columns are pushed down to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` in ``folder``: one file or a folder of files."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
