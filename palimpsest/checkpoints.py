"""Cutting lineage: intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, tuple[SparkSession, str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a temporary folder on a single machine, and an error on a
    cluster, whose executors would each write to a disk of their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.palimpsest.scratch", None)
        if not folder:
            master = spark.conf.get("spark.master", "")
            if not re.fullmatch(r"local(\[.*\])?", master):
                raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors share (master is {master!r})")
            folder = "file://" + tempfile.mkdtemp(prefix="spark-palimpsest-")
            spark.conf.set("spark.palimpsest.scratch", folder)
    return folder.rstrip("/")


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Unlike a cached or locally checkpointed frame, the table outlives lost executors, later scans of it prune columns, and its
    lineage is one scan. ``forget`` deletes it early; what is left goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/palimpsest-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if not _written:
        atexit.register(_forget_all)
    _written[path] = (spark, path)
    out._palimpsest_path = path  # noqa: SLF001
    return out


def forget(df: DataFrame | None) -> None:
    """Delete the table behind a frame made by ``materialise``; other frames are left alone."""
    path = getattr(df, "_palimpsest_path", None)
    if path and path in _written:
        _delete(*_written.pop(path))


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm  # noqa: SLF001
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)  # noqa: SLF001
    except Exception:  # noqa: BLE001 - tidying must never fail a job
        pass


def _forget_all() -> None:
    for spark, path in list(_written.values()):
        _delete(spark, path)
    _written.clear()
