"""Applying a feed of inserts, updates and deletes, newest first.

The feed is cut into batches by ranges of its leading order column, and the batches are processed backwards: in a batch only
keys that no newer batch has resolved are kept (an anti-join), and each of them is resolved for good by the newest change of
the batch, as an image or a tombstone. Arrival order therefore never matters, and repeated deliveries collapse. The changes of a
batch become one a key inside the tasks before anything is shuffled, so a key with very many changes is no hot key; then the
anti-join drops the keys that are resolved. Every batch writes what it resolves, once. Base rows that no change touches are
appended at the end.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.checkpoints import materialise
from palimpsest.functions.ids import clean_id


def batch_bounds(changes: DataFrame, lead: str, batches: int) -> list[float]:
    """Lower bounds of all batches but the oldest, newest first; from approximate quantiles over the whole feed (one value
    each reaches the driver). Few distinct values give fewer batches, an empty feed none."""
    at = [1 - k / batches for k in range(1, batches)]
    if not at:
        return []
    found = changes.agg(F.percentile_approx(lead, at).alias("q")).first()["q"]
    bounds = sorted({b for b in found or [] if b is not None}, reverse=True)
    return [b + 1 for b in bounds] if all(isinstance(b, int) for b in bounds) else bounds


def newest_changes(
    changes: DataFrame, keys: Sequence[str], order: Sequence[str], carry: Sequence[str] = (), batches: int = 3
) -> DataFrame:
    """(keys, order, carry) of the newest change of every key, tombstones included.

    Changes compare by ``order``, nulls first, the last column deciding; changes equal in all of it are repeated deliveries of
    one change, of which the one with the greatest ``carry`` stands. A change with a null key column is ignored. The result
    does not depend on ``batches``. An empty feed gives no row.
    """
    keys, order, carry = list(keys), list(order), list(carry)
    usable = changes.select(*keys, *order, *carry)
    for k in keys:
        usable = usable.where(F.col(k).isNotNull())
    lead = F.col(order[0])
    parts: list[DataFrame] = []
    upper: float | None = None
    for lower in [*batch_bounds(usable, order[0], batches), None]:
        batch = usable
        if upper is not None:
            batch = batch.where((lead < upper) | lead.isNull() if lower is None else lead < upper)
        if lower is not None:
            batch = batch.where(lead >= lower)
        newest = batch.groupBy(*keys).agg(F.max(F.struct(*order, *carry)).alias("__newest")).select(*keys, "__newest.*")
        if parts:
            newest = newest.join(reduce(DataFrame.unionByName, parts).select(*keys), keys, "left_anti")
        parts.append(materialise(newest, "resolved") if lower is not None else newest)
        upper = lower
    return reduce(DataFrame.unionByName, parts)


def apply_changes(
    base: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    is_delete: Column,
    batches: int = 3,
) -> DataFrame:
    """The current state: images of the newest changes that are no deletes, then the base rows that no change touches.

    ``is_delete`` is a condition on columns of ``changes``; null counts as no delete. The result has the columns of ``base``
    (those that a change lacks are null in its image). Of base rows with one key, one stands (they are repeated deliveries);
    base rows with a null key column are dropped. The last column of ``order`` must identify a change within its key; the
    images are fetched by it only for resolved keys, so wide columns are not carried through the resolution.
    """
    keys, order = list(keys), list(order)
    marked = changes.withColumn("__delete", F.coalesce(is_delete, F.lit(False)))
    newest = materialise(newest_changes(marked, keys, order, ["__delete"], batches), "newest")
    ident = order[-1]
    alive = newest.where(~F.col("__delete")).select(*keys, ident)
    images = changes.join(alive, [*keys, ident], "left_semi")
    images = images.select(
        *[F.col(c) if c in images.columns else F.lit(None).cast(base.schema[c].dataType).alias(c) for c in base.columns],
        *([] if ident in base.columns else [ident]),
    ).dropDuplicates([*keys, ident])
    kept = base.dropna(subset=keys).dropDuplicates(keys).join(newest.select(*keys), keys, "left_anti")
    return images.select(*base.columns).unionByName(kept.select(*base.columns))


def version_changes(versions: DataFrame) -> DataFrame:
    """The feed of memory changes with cleaned ids and action; all other columns as they are."""
    cleaned = {c: clean_id(c) for c in ("memory_id", "version_id", "action")}
    return versions.withColumns(cleaned)


VERSION_KEYS, VERSION_ORDER = ["memory_space", "memory_id"], ["version", "created_at", "version_id"]


def last_changes(versions: DataFrame, batches: int = 3) -> DataFrame:
    """(memory_space, memory_id, version_id) of every memory's last change, unless that is an ``archive``.

    Order of changes: version, then created_at (null first), then version_id. A null action is no archive.
    """
    newest = newest_changes(version_changes(versions), VERSION_KEYS, VERSION_ORDER, ["action"], batches)
    return newest.where(F.coalesce(F.col("action") != "archive", F.lit(True))).select(*VERSION_KEYS, "version_id")


def current_memories(memories: DataFrame, versions: DataFrame, batches: int = 3) -> DataFrame:
    """The state of all memories that are not archived, rebuilt from the snapshot ``memories`` and the feed ``versions``.

    Columns: memory_space, memory_id, title, summary, content, confidence, salience, status, version_id (null for a memory
    that only the snapshot has). Snapshot rows whose status is ``archived`` are dropped.
    """
    columns = ["title", "summary", "content", "confidence", "salience", "status"]
    base = (
        memories.withColumn("memory_id", clean_id("memory_id"))
        .where(F.coalesce(clean_id("status") != "archived", F.lit(True)))
        .select(*VERSION_KEYS, *columns, F.lit(None).cast("string").alias("version_id"))
    )
    return apply_changes(base, version_changes(versions), VERSION_KEYS, VERSION_ORDER, F.col("action") == "archive", batches)
