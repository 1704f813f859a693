"""Tables as versioned snapshots: a write makes a new folder, and a small pointer file names the one that counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

#: What tells whether an index fits the configuration, and the priority of rebuilding it.
INDEX_CONFIG = ["provider", "model", "dim", "projection_version"]
REBUILD_PRIORITY = 1000


class Snapshots:
    """Snapshots of one table under ``folder``. A reader that began before a write goes on with its snapshot; a write that fails
    leaves the pointer where it was. There is one writer at a time."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, partition_by: str | None = None):
        self.spark, self.folder, self.schema, self.partition_by = spark, folder.rstrip("/"), schema, partition_by

    def _pointer(self) -> int:
        try:
            return int(self.spark.read.schema("version long").json(f"{self.folder}/pointer").agg(F.max("version")).first()[0] or 0)
        except AnalysisException as e:  # anything but a missing path (no access, a broken file) is an error, or a write would start again
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0

    def read(self) -> DataFrame:
        """The current snapshot; an empty table before the first write."""
        version = self._pointer()
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/v{version}") if version else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame) -> int:
        """Make ``df``, in the columns of the schema, the current snapshot; it may read the one before."""
        version = self._pointer() + 1
        kinds = {f.name: f.dataType for f in self.schema}
        writer = df.select(*[F.col(n).cast(k).alias(n) for n, k in kinds.items()]).write.mode("overwrite")
        (writer.partitionBy(self.partition_by) if self.partition_by else writer).parquet(f"{self.folder}/v{version}")
        self.spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").json(f"{self.folder}/pointer")
        return version

    def append(self, df: DataFrame) -> int:
        return self.write(self.read().unionByName(df.select(*self.schema.fieldNames())))

    def merge(self, batch: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Make ``combine(what is held, batch)`` the current snapshot."""
        self.write(combine(self.read(), batch))


class BucketedSnapshots:
    """A table under ``folder`` in ``buckets`` parts by a hash of ``key``, each with versions of its own: a merge reads and writes only
    the buckets that its batch has keys of, so a small batch costs little however large the table is. The pointer is one small file
    a merge, which names the new versions of its buckets; a reader sees all of them or none. There is one writer at a time."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, key: Sequence[str], buckets: int = 64):
        self.spark, self.folder, self.schema, self.key, self.buckets = spark, folder.rstrip("/"), schema, list(key), buckets

    def _versions(self) -> dict[int, int]:
        """{bucket: current version}, at most one entry a bucket."""
        try:
            rows = self.spark.read.schema("bucket int, version long").json(f"{self.folder}/pointer").groupBy("bucket").agg(F.max("version")).collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        return dict(map(tuple, rows))

    def _of(self, versions: dict[int, int]) -> DataFrame:
        paths = [f"{self.folder}/v{v}/bucket={b}" for b, v in sorted(versions.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._of(self._versions())

    def merge(self, batch: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Replace the rows of the touched buckets by ``combine(what they hold, batch)``, which must keep every key in its bucket."""
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        touched = [r[0] for r in batch.select(bucket).distinct().collect()]  # at most one row a bucket
        if not touched:
            return
        versions = self._versions()
        held = self._of({b: v for b, v in versions.items() if b in touched})
        version = max(versions.values(), default=0) + 1
        out = combine(held, batch).select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).withColumn("bucket", bucket)
        out.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/v{version}")
        rows = [(b, version) for b in touched]
        self.spark.createDataFrame(rows, "bucket int, version long").coalesce(1).write.mode("append").json(f"{self.folder}/pointer")


def checked_vectors(df: DataFrame, dim: int) -> DataFrame:
    """Vectors of the index's dimension; any other one fails the job before anything is written."""
    said = F.concat(F.lit(f"a vector has not {dim} dimensions but "), F.coalesce(F.size("vec"), F.lit(0)).cast("string"))
    return df.withColumn("vec", F.when(F.coalesce(F.size("vec") == dim, F.lit(False)), F.col("vec")).otherwise(F.raise_error(said)))


def index_state(state: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """(index_state, rebuild_priority): ``ready`` if the index (one row a key: state_key, value) was built with the wanted
    configuration, else ``stale`` and due for rebuilding; an index that was never built is stale."""
    want = state.sparkSession.createDataFrame([(k, str(wanted[k])) for k in INDEX_CONFIG], "state_key string, want string")
    same = F.bool_and(F.coalesce(F.col("value") == F.col("want"), F.lit(False))).alias("same")
    return want.join(state, "state_key", "left").agg(same).select(
        F.when(F.col("same"), "ready").otherwise("stale").alias("index_state"), F.when(~F.col("same"), REBUILD_PRIORITY).alias("rebuild_priority")
    )


def index_states(states: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """(index_id, index_state, rebuild_priority) of many indexes (index_id, state_key, value), each as ``index_state`` has it."""
    want = F.create_map(*[F.lit(x) for k in INDEX_CONFIG for x in (k, str(wanted[k]))])
    same = F.coalesce(F.col("value") == want[F.col("state_key")], F.lit(False))
    known = states.where(F.col("state_key").isin(INDEX_CONFIG)).groupBy("index_id").agg(F.count_distinct(F.when(same, F.col("state_key"))).alias("n"))
    ready = F.coalesce(F.col("n"), F.lit(0)) == len(INDEX_CONFIG)
    every = states.select("index_id").distinct().join(known, "index_id", "left")
    return every.select("index_id", F.when(ready, "ready").otherwise("stale").alias("index_state"), F.when(~ready, REBUILD_PRIORITY).alias("rebuild_priority"))
