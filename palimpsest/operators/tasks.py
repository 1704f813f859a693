"""The queue of maintenance tasks as set-based transitions; ``now`` is always a parameter. One writer applies them, so no row
locks are needed; effects are keyed by (task_id, attempts) and may be applied again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Task types whose tasks for one entity are done together; of these, one has lists of memories to unite.
COALESCED = ["reindex_memory", "refresh_entity_profile", "repair_memory_edges", "detect_merge_candidates"]
#: Types, priorities of the tasks that follow an ingest.
FOLLOW_UPS = [("refresh_entity_profile", 8), ("reindex_memory", 12), ("detect_merge_candidates", 4), ("repair_memory_edges", 11)]


def enqueue(tasks: DataFrame, requested: DataFrame, blocking: Sequence[str] = ("pending", "running")) -> DataFrame:
    """Requests that become new tasks: the first of every (space, dedupe key) that no task in a blocking status has. A request
    without a dedupe key always does. A task that is already there keeps its time."""
    waiting = tasks.where(F.col("status").isin(*blocking)).select("memory_space", "dedupe_key").distinct()
    first = Window.partitionBy("memory_space", "dedupe_key").orderBy("created_at", "task_id")
    keyed = requested.where("dedupe_key IS NOT NULL").withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    return keyed.join(waiting, ["memory_space", "dedupe_key"], "left_anti").select(*requested.columns).unionByName(requested.where("dedupe_key IS NULL"))


def due(tasks: DataFrame, now: float, limit: int) -> DataFrame:
    """Pending tasks whose time has come: greatest priority first, then the oldest, then by id."""
    ready = tasks.where((F.col("status") == "pending") & (F.col("available_at") <= now))
    return ready.orderBy(F.desc("priority"), "created_at", "task_id").limit(limit)


def claim(tasks: DataFrame, now: float, limit: int, lease: float = 60) -> DataFrame:
    """All tasks after the due ones were claimed: running, one attempt more, under a lease."""
    taken = due(tasks, now, limit).select("task_id", F.lit(True).alias("taken"))
    t = tasks.join(taken, "task_id", "left")
    return t.select(
        *[c for c in tasks.columns if c not in ("status", "attempts", "lease_expires_at")],
        F.when(F.col("taken"), "running").otherwise(F.col("status")).alias("status"),
        F.when(F.col("taken"), F.col("attempts") + 1).otherwise(F.col("attempts")).alias("attempts"),
        F.when(F.col("taken"), F.lit(now + lease)).otherwise(F.col("lease_expires_at")).alias("lease_expires_at"),
    )


def finish(tasks: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Tasks after the ``outcomes`` (task_id, outcome) of running ones: succeeded; released back to pending; failed, or dead
    letter once the attempts are used up. Outcomes of tasks that don't run are ignored; of repeated ones the worst stands."""
    told = outcomes.groupBy("task_id").agg(F.min("outcome").alias("outcome"))  # failed < released < succeeded
    t = tasks.join(told, "task_id", "left")
    spent = F.col("attempts") >= F.col("max_attempts")
    after = (
        F.when((F.col("status") != "running") | F.col("outcome").isNull(), F.col("status"))
        .when(F.col("outcome") == "failed", F.when(spent, "dead_letter").otherwise("failed"))
        .when(F.col("outcome") == "released", "pending")
        .otherwise(F.col("outcome"))
    )
    return t.select(*[c for c in tasks.columns if c != "status"], after.alias("status"))


def recover(tasks: DataFrame, now: float) -> DataFrame:
    """Tasks after failed ones with attempts left, and running ones whose lease is over, went back to pending, due at once. A
    lease that ends just now is over; attempts don't matter for it."""
    lost = (F.col("status") == "running") & (F.col("lease_expires_at") <= now)
    retry = (F.col("status") == "failed") & (F.col("attempts") < F.col("max_attempts"))
    return tasks.withColumns(
        {
            "status": F.when(lost | retry, "pending").otherwise(F.col("status")),
            "available_at": F.when(retry, F.lit(now)).otherwise(F.col("available_at")),
            "lease_expires_at": F.when(lost | retry, None).otherwise(F.col("lease_expires_at")),
        }
    )


def coalesce_tasks(claimed: DataFrame) -> DataFrame:
    """(task_id, leader_id, memory_ids): the tasks of one type, space and entity follow the first of them, which takes on all
    their memories, in the order of tasks, each once. Tasks of other types, or without an entity, lead themselves."""
    alone = ~F.col("task_type").isin(COALESCED) | F.col("entity_key").isNull()
    keyed = claimed.withColumn("group", F.when(alone, F.col("task_id")).otherwise(F.concat_ws("|", "task_type", "memory_space", "entity_key")))
    united = keyed.groupBy("group").agg(
        F.min_by("task_id", F.struct("created_at", "task_id")).alias("leader_id"),
        F.array_sort(F.collect_list(F.struct("created_at", "task_id", "memory_ids"))).alias("all"),
    )
    ids = F.array_distinct(F.flatten(F.transform("all", lambda x: F.coalesce(x["memory_ids"], F.array().cast("array<string>")))))
    leaders = united.select("group", "leader_id", ids.alias("united"))
    return keyed.join(leaders, "group").select("task_id", "leader_id", F.when(F.col("task_id") == F.col("leader_id"), F.col("united")).alias("memory_ids"))


def follow_ups(entities: DataFrame, now: float, delay: float = 3) -> DataFrame:
    """(memory_space, entity_key, task_type, priority, available_at, dedupe_key): the tasks that follow an ingest, for every
    entity that it touched."""
    kinds = F.array(*[F.struct(F.lit(t).alias("task_type"), F.lit(p).alias("priority")) for t, p in FOLLOW_UPS])
    each = entities.select("memory_space", "entity_key").distinct().select("memory_space", "entity_key", F.explode(kinds).alias("k"))
    return each.select("memory_space", "entity_key", "k.*", F.lit(now + delay).alias("available_at"), F.concat_ws(":", "k.task_type", "entity_key").alias("dedupe_key"))


def put_state(states: DataFrame, changes: DataFrame) -> DataFrame:
    """States (state_key, value, updated_at) after ``changes``; the newest of a key stands, a change before an equally old state."""
    both = states.withColumn("new", F.lit(0)).unionByName(changes.withColumn("new", F.lit(1)))
    newest = both.groupBy("state_key").agg(F.max_by(F.struct("value", "updated_at"), F.struct("updated_at", "new", "value")).alias("s"))
    return newest.select("state_key", "s.*")
