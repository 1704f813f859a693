"""References to records that do not exist.

A reference is a composite key, any column of which may be null. References are grouped by their null mask; every mask that the
declared match semantics check is anti-joined on exactly its non-null columns, so each mask is one equi-join on keys that are
all present (no null-safe or disjunctive condition, hence no nested-loop join).
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.ids import clean_id

#: Match semantics of composite references, as in SQL's MATCH clause.
SEMANTICS = ("simple", "partial", "full")
DAY = 86_400.0


def null_mask(keys: Sequence[str]) -> Column:
    """``'01…'`` with a 1 for every null key column."""
    return F.concat(*[F.when(F.col(k).isNull(), "1").otherwise("0") for k in keys])


def checked_masks(n_keys: int, semantics: str) -> list[str]:
    """Masks whose references are looked up. simple: complete keys only; partial: any key with a non-null column;
    full: complete keys only (mixed ones are violations without a lookup)."""
    if semantics not in SEMANTICS:
        raise ValueError(f"semantics must be one of {SEMANTICS}, not {semantics!r}")
    masks = ["".join(bits) for bits in product("01", repeat=n_keys)]
    return [m for m in masks if "0" in m] if semantics == "partial" else [masks[0]]


def orphan_references(
    references: DataFrame,
    targets: DataFrame,
    keys: Sequence[str],
    *,
    semantics: str = "simple",
    happened: str | None = None,
    arrived: str | None = None,
    grace: float = DAY,
) -> DataFrame:
    """Rows of ``references`` with a ``state``, where the state is ``absent``, ``late`` or (full semantics) ``mixed``.

    ``absent``: no target agrees on the reference's non-null key columns. ``late`` (with ``happened`` and ``arrived``): one
    does, but the earliest ``arrived`` of them lies more than ``grace`` after the reference's ``happened``; a null time is
    never late. ``mixed``: under full semantics, a key with some but not all columns null.

    A reference whose key columns are all null refers to nothing and is never returned; under simple semantics neither is one
    with any null column. Repeated references are returned as often as they occur. Other columns of ``references`` pass
    through, whatever their names (columns of ``targets`` never appear, so equal names can't clash). With no targets every
    checked reference is absent; with no references the result is empty.

    The anti-join and the lateness test share one outer join, so each side is shuffled once; targets are reduced to one row
    a key before the shuffle. A key that holds a large share of the references is split by the skew handling of adaptive
    execution, which an outer join allows on its left side.
    """
    columns = references.columns
    mask, found, earliest, state = "__mask", "__found", "__earliest", "__state"
    masked = references.withColumn(mask, null_mask(keys))
    out: DataFrame | None = None
    for m in checked_masks(len(keys), semantics):
        on = [k for k, bit in zip(keys, m, strict=True) if bit == "0"]
        side = masked.where(F.col(mask) == m)
        wanted = [F.col(k).alias(f"__t_{k}") for k in on]
        first = F.min(arrived).alias(earliest) if arrived else F.lit(None).cast("double").alias(earliest)
        known = (
            targets.where(F.concat(*[F.col(k).isNotNull().cast("string") for k in on]) == "true" * len(on))
            .groupBy(*wanted)
            .agg(first, F.lit(True).alias(found))
        )
        joined = side.join(known, [side[k] == known[f"__t_{k}"] for k in on], "left")
        late = (F.col(earliest) - F.col(happened) > grace) if happened and arrived else F.lit(False)
        judged = joined.withColumn(state, F.when(F.col(found).isNull(), "absent").when(late, "late")).where(F.col(state).isNotNull())
        judged = judged.select(*[side[c] for c in columns], F.col(state).alias("state"))
        out = judged if out is None else out.unionByName(judged)
    if semantics == "full":
        mixed = masked.where(F.col(mask).contains("0") & F.col(mask).contains("1"))
        out = out.unionByName(mixed.select(*columns, F.lit("mixed").alias("state")))
    return out


def edge_ends(edges: DataFrame) -> DataFrame:
    """Both ends of every edge as references: (edge_id, side, kind, memory_space, id, created_at), ids and kinds cleaned."""
    end = lambda side: F.struct(
        F.lit(side).alias("side"), clean_id(f"{side}_kind").alias("kind"), clean_id(f"{side}_id").alias("id")
    )
    return edges.select(
        clean_id("edge_id").alias("edge_id"),
        "memory_space",
        "created_at",
        F.explode(F.array(end("from"), end("to"))).alias("end"),
    ).select("edge_id", "end.side", "end.kind", "memory_space", "end.id", "created_at")


def records(memories: DataFrame, observations: DataFrame) -> DataFrame:
    """What edges may refer to: (kind, memory_space, id, arrived_at)."""
    part = lambda df, kind, key: df.select(
        F.lit(kind).alias("kind"), "memory_space", clean_id(key).alias("id"), "arrived_at"
    )
    return part(memories, "memory", "memory_id").unionByName(part(observations, "observation", "observation_id"))


def orphan_edge_ends(edges: DataFrame, memories: DataFrame, observations: DataFrame, grace: float = DAY) -> DataFrame:
    """(edge_id, side, state, ref_table, edge_month): ends of edges that are absent or came more than ``grace`` seconds late.

    Simple semantics: an end without kind or id is no case. Every (edge_id, side) comes once, also for edges delivered
    repeatedly; should repeats disagree, ``absent`` wins and the earliest edge counts. An edge without an id can't be named
    and is left out. ``edge_month`` is 'yyyy-MM' in UTC, null for an edge without a time.
    """
    orphans = orphan_references(
        edge_ends(edges),
        records(memories, observations),
        ["kind", "memory_space", "id"],
        happened="created_at",
        arrived="arrived_at",
        grace=grace,
    )
    return (
        orphans.where(F.col("edge_id").isNotNull())
        .groupBy("edge_id", "side")
        .agg(F.min("state").alias("state"), F.min("kind").alias("ref_table"), F.min("created_at").alias("at"))
        .select(
            "edge_id",
            "side",
            "state",
            "ref_table",
            F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("at") / 86_400).cast("int")), "yyyy-MM").alias("edge_month"),
        )
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts per referenced table, month of the edge and state."""
    return orphans.groupBy("ref_table", "edge_month", "state").agg(F.count("*").alias("n_ends"))
