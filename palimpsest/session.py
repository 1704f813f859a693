"""Session settings that the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings of a local session; on a cluster the submit configuration decides, and none of these is required for right results.
LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the benchmark: ``local[cores]`` with AQE, UTC and Arrow transfer."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("palimpsest")
    settings = LOCAL_CONF | {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": "12g"} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def task_slots(spark: SparkSession) -> int:
    """Tasks that the cluster runs at once, for sizing partitioned work; at least 1."""
    return max(1, spark.sparkContext.defaultParallelism)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
