"""Keyed reads, filtered lists and top-k; every one is a filter that reaches the scan, and every order ends in a unique id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(df: DataFrame, by: str, ident: str, limit: int, *, newest: bool = True, **equal: str) -> DataFrame:
    """The first ``limit`` rows by ``by`` (newest first unless told otherwise; nulls last), among those with the given values."""
    for column, value in equal.items():
        df = df.where(F.col(column) == value)
    order = F.col(by).desc_nulls_last() if newest else F.col(by).asc_nulls_last()
    return df.orderBy(order, ident).limit(limit)


def point(df: DataFrame, **equal: str) -> DataFrame:
    """Rows with the given values; no order, at most one for a key."""
    for column, value in equal.items():
        df = df.where(F.col(column) == value)
    return df


def by_ids(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows for ``wanted`` (request, ids array), with the position of their id: one row a request and distinct id that exists.

    Of an id asked for twice the last position counts; null and blank ids are skipped. Both lists of ids and table may be
    large: it is one equi-join.
    """
    asked = wanted.select("request", F.posexplode("ids").alias("position", key)).where(F.btrim(key) != "")
    asked = asked.groupBy("request", key).agg(F.max("position").alias("position"))
    return df.join(asked, key)


def recent_per_key(df: DataFrame, keys: Sequence[str], by: str, ident: str, n: int) -> DataFrame:
    """The ``n`` newest rows of every key with their ``rank``, in one pass (no query per key). The rank limit is pushed below
    the shuffle, so a key that holds many rows sends ``n`` a partition."""
    order = Window.partitionBy(*keys).orderBy(F.col(by).desc_nulls_last(), F.col(ident))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def incident_edges(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Edges with an end among ``seeds`` (memory_space, memory_id), each once; a disjunctive join as two semi-joins."""
    seed = seeds.select("memory_space", "memory_id").distinct()
    out = edges.join(seed.withColumnRenamed("memory_id", "from_id"), ["memory_space", "from_id"], "left_semi")
    into = edges.join(seed.withColumnRenamed("memory_id", "to_id"), ["memory_space", "to_id"], "left_semi")
    return out.select(*edges.columns).unionByName(into.select(*edges.columns)).dropDuplicates(["edge_id"])


def like(column: str, text: str, how: str = "contains", like_compat: bool = False) -> Column:
    """Rows whose column contains (or starts with) a text taken literally; with ``like_compat``, % and _ in it are wild."""
    c = F.col(column)
    if like_compat:
        return c.like(f"%{text}%" if how == "contains" else f"{text}%")
    return c.contains(text) if how == "contains" else c.startswith(text)


def known_statuses(csv: str | None, known: Sequence[str]) -> list[str]:
    """The known statuses in a list with commas; if none of them is known, none (which means no filter)."""
    return [s for s in (p.strip() for p in (csv or "").split(",")) if s in known]


def page(df: DataFrame, conditions: Sequence[Column], by: str, ident: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the rows that meet all conditions, newest first, with the ``total`` number of such rows.

    ``limit`` is held to 1..200 and ``offset`` to 0 and more. The total is an aggregate beside the top-k, not a window over
    all rows. An empty page gives no rows, so no total either.
    """
    for c in conditions:
        df = df.where(c)
    shown = df.orderBy(F.col(by).desc_nulls_last(), ident).offset(max(0, offset)).limit(min(200, max(1, limit)))
    total = df.agg(F.count("*").alias("total"))
    return shown.join(F.broadcast(total))  # one row


def latest(df: DataFrame, keys: Sequence[str], by: str, ident: str) -> DataFrame:
    """The newest row of every key (greatest id among equals), by a partial aggregate; columns as in ``df``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(by, ident)).alias("r")).select(*keys, "r.*")


def not_ready(spaces: DataFrame, tasks: DataFrame) -> DataFrame:
    """Spaces in which an ingest is still pending or running; a failed one does not block."""
    open_ = tasks.where((F.col("task_type") == "continue_ingest") & F.col("status").isin("pending", "running"))
    return spaces.join(open_.select("memory_space"), "memory_space", "left_semi")


def all_ref_docs(entities: DataFrame, memories: DataFrame) -> DataFrame:
    """Ids of all documents that an index holds for the two tables."""
    part = lambda df, kind, key: df.select(F.concat(F.lit(f"{kind}:"), "memory_space", F.lit(":"), key).alias("ref_doc"))
    return part(entities, "entity", "entity_key").unionByName(part(memories, "memory", "memory_id")).distinct()


def violations(df: DataFrame, table: str, ident: str, allowed: dict[str, Sequence[str]], unit: Sequence[str] = ()) -> DataFrame:
    """(table, id, column, value): rows that break a declared constraint. ``allowed`` lists the values of a column (null is
    none of them); ``unit`` columns must lie in 0..1 unless null."""
    checks = [F.when(F.col(c).isNull() | ~F.col(c).isin(*values), F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))) for c, values in allowed.items()]
    checks += [F.when(~F.col(c).between(0, 1), F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))) for c in unit]
    broken = F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("v")
    return df.select(F.lit(table).alias("table"), F.col(ident).alias("id"), broken).select("table", "id", "v.*")
