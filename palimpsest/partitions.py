"""Spreading work over the cluster's task slots."""

from __future__ import annotations

from pyspark.sql import DataFrame

from palimpsest.session import shuffle_partitions, task_slots


def spread(df: DataFrame, key: str, per_slot: int = 2) -> DataFrame:
    """``df`` in at least one partition a task slot, for steps that cost far more CPU than a shuffle.

    A large input is scanned in many splits and stays as it is; one with fewer splits than slots is hash-partitioned by
    ``key`` into ``per_slot`` partitions a slot. Only the number of planned splits is looked at, no data.
    """
    slots = task_slots(df.sparkSession)
    if df.rdd.getNumPartitions() >= slots:
        return df
    return df.repartition(max(per_slot * slots, shuffle_partitions(df.sparkSession)), key)
