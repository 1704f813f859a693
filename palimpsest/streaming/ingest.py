"""Streams over the engine's tables: ingest, the change feed, throttled follow-up tasks and lease timers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palimpsest.operators import changes, writepath
from palimpsest.sources.snapshots import BucketedSnapshots, Snapshots


def stream_table(spark: SparkSession, folder: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A growing folder of Parquet files as a stream."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


def available_now(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run ``apply`` on every micro-batch of what is there, then end. A batch that is replayed after a failure has the same
    number, so an ``apply`` whose effect follows from its rows takes effect once."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_texts(stream: DataFrame, observations: Snapshots | BucketedSnapshots, now: float, checkpoint: str) -> StreamingQuery:
    """Texts (memory_space, source_ref, content, request_id) to pending observations; a text that comes again is no new one. A table in
    buckets (by observation_id) is rewritten only where a batch has texts."""

    def combine(held: DataFrame, new: DataFrame) -> DataFrame:
        fresh = new.join(held.select("observation_id"), "observation_id", "left_anti").select(*new.columns)
        return held.unionByName(fresh)

    return available_now(stream, lambda batch, _: observations.merge(writepath.new_observations(batch, now), combine), checkpoint)


def follow_changes(stream: DataFrame, newest: Snapshots | BucketedSnapshots, checkpoint: str) -> StreamingQuery:
    """Keep the newest change of every memory (tombstones included) over a stream of versions. Late, repeated and disordered
    changes give the same table as one batch over all of them, since a change is replaced only by a later one. A table in buckets
    (by memory_space and memory_id) is rewritten only where a batch has changes."""
    carry = ["action"]
    columns = [*changes.VERSION_KEYS, *changes.VERSION_ORDER, *carry]

    def combine(held: DataFrame, new: DataFrame) -> DataFrame:
        return changes.newest_changes(held.select(*columns).unionByName(new), changes.VERSION_KEYS, changes.VERSION_ORDER, carry, batches=1)

    return available_now(stream, lambda batch, _: newest.merge(changes.version_changes(batch).select(*columns).dropna(subset=changes.VERSION_KEYS), combine), checkpoint)


def throttled(events: DataFrame, delay: float) -> DataFrame:
    """(key, due_at) of a stream (key string, at double): a key falls due ``delay`` seconds after its first event; events until
    then ask for nothing new (a leading-edge throttle, not a debounce), the next one after it does."""

    def on_rows(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        due = state.get[0] if state.exists else float("-inf")
        out = []
        for at in sorted(t for part in rows for t in part["at"].dropna()):
            if at >= due:
                due = at + delay
                out.append(due)
        state.update((due,))
        yield pd.DataFrame({"key": [key[0]] * len(out), "due_at": out})

    return events.groupBy("key").applyInPandasWithState(on_rows, "key string, due_at double", "due double", "append", GroupStateTimeout.NoTimeout)


def expired_leases(events: DataFrame, lease: float) -> DataFrame:
    """(task_id, expired_at) of a stream (task_id string, at double, status string): a task that runs falls back when the clock of
    its own later events, or of the stream's watermark, passes ``lease`` seconds after it was claimed without an end."""
    at = F.timestamp_seconds("at")
    marked = events.select("task_id", "status", "at", at.alias("time")).withWatermark("time", "0 seconds")

    def on_rows(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[float] = []
        if state.hasTimedOut:
            out.append(state.get[0])
            state.remove()
        else:
            until = state.get[0] if state.exists else None
            for row in pd.concat(list(rows)).sort_values("at").itertuples():
                if until is not None and row.at >= until:
                    out.append(until)
                    until = None
                until = row.at + lease if row.status == "running" else None
            if until is None:
                if state.exists:
                    state.remove()
            else:
                state.update((until,))
                state.setTimeoutTimestamp(max(int(until * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"task_id": [key[0]] * len(out), "expired_at": out})

    return marked.groupBy("task_id").applyInPandasWithState(on_rows, "task_id string, expired_at double", "until double", "append", GroupStateTimeout.EventTimeTimeout)
