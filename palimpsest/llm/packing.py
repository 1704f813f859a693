"""Filling containers of fixed capacity with items of varying length: minimum bin slack.

Items are dealt into shards by a hash of their id; each shard is packed by itself in one task, so no task ever holds more than a
shard. The price is what the last containers of every shard lack, which is measured (``fill_report``), not bounded by a proof. Within a shard, a container is opened with the
longest item left, and a bitset subset-sum programme over the lengths that are left finds the fullest combination that still fits;
that combination is taken out, as often as the lengths last. Containers without any slack end the search early.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.checkpoints import materialise

#: Items of one shard, on average: 24 bytes each in the task that packs them.
SHARD_ITEMS = 8_000
#: Container sizes that one call packs for at most; the driver reads them as parameters.
MAX_WINDOWS = 1_000


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> list[int]:
    """Lengths, with repetition, whose sum is the greatest not above ``room``; longer ones are preferred.

    ``lengths`` are the keys of ``counts`` in falling order. Bit s of ``reach`` says that s can be made; each step adds up to
    2^k items of one length at once, so a length costs the logarithm of its number of items.
    """
    mask = (1 << (room + 1)) - 1
    reach, goal, steps = 1, 1 << room, []
    for length in lengths:
        if length > room:
            continue
        left, take = min(counts[length], room // length), 1
        while left > 0:
            take = min(take, left)
            grown = (reach | reach << length * take) & mask
            if grown != reach:
                steps.append((length, take, reach))
                reach = grown
            left -= take
            take *= 2
        if reach & goal:
            break
    at, out = reach.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            out += [length] * take
            at -= length * take
    return out


def pack(sizes: dict[int, int], capacity: int) -> Iterator[tuple[list[int], int]]:
    """(lengths in a container, number of containers filled so) for a multiset of lengths {length: count} up to ``capacity``."""
    counts = {k: v for k, v in sizes.items() if v > 0}
    lengths = sorted(counts, reverse=True)
    while lengths:
        first = lengths[0]
        counts[first] -= 1
        combination = [first, *fullest(counts, [x for x in lengths if counts[x]], capacity - first)]
        counts[first] += 1
        used: dict[int, int] = {}
        for x in combination:
            used[x] = used.get(x, 0) + 1
        times = min(counts[x] // k for x, k in used.items())
        for x, k in used.items():
            counts[x] -= k * times
        lengths = [x for x in lengths if counts[x]]
        yield combination, times


def pack_shard(items: pd.DataFrame) -> pd.DataFrame:
    """Containers for the items (item, piece, size) of one shard and capacity; equal sizes go in the order of item and piece."""
    window, capacity, shard = (items[c].iloc[0] for c in ("window_id", "capacity_tokens", "shard"))
    items = items.sort_values(["size", "item", "piece"], kind="stable")
    rows = {size: list(part.index) for size, part in items.groupby("size")}
    order, container, n = [], [], 0
    for combination, times in pack({size: len(r) for size, r in rows.items()}, int(capacity)):
        for _ in range(times):
            for size in combination:
                order.append(rows[size].pop())
                container.append(f"s{shard}-{n}")
            n += 1
    out = items.loc[order, ["window_id", "capacity_tokens", "item", "piece", "size"]]
    return out.assign(container=container)


def containers(items: DataFrame, windows: list[tuple[int, int]], item: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(window_id, capacity_tokens, container, item, piece, size): every item in a container, for every (window_id, capacity).

    ``piece`` is 0 for an item that fits. Only an item longer than the capacity is split: into pieces that fill containers
    of their own, and a last one that is packed like any item; piece k starts at token k * capacity. Items of null or no size
    take no container and are left out; equal ids are items of their own and may share a container. No items, or no windows,
    give no rows. The longest item goes first, ties in the order of ids, so
    the lengths in a container do not depend on the order of rows (the names of containers with whole pieces do).
    """
    if len(windows) > MAX_WINDOWS:
        raise ValueError(f"{len(windows)} container sizes; at most {MAX_WINDOWS} are packed in one call")
    sized = items.where(f"`{size}` > 0").select(F.col(item).alias("item"), F.col(size).cast("int").alias("size"))
    sized = materialise(sized.withColumn("row", F.monotonically_increasing_id()), "sizes")  # written once, so rows keep their numbers
    shards = max(1, -(-sized.count() // SHARD_ITEMS))
    sizes = F.array(*[F.struct(F.lit(w).alias("window_id"), F.lit(c).alias("capacity_tokens")) for w, c in windows])
    kind = sized.schema["item"].dataType.simpleString()
    schema = f"window_id int, capacity_tokens int, item {kind}, piece int, size int, container string"
    if not windows:
        return sized.sparkSession.createDataFrame([], schema)
    asked = sized.select("row", "item", "size", F.explode(sizes).alias("w")).select("w.*", "row", "item", "size")
    full = F.floor(F.col("size") / F.col("capacity_tokens")).cast("int")
    own = asked.where("size > capacity_tokens").select(
        "window_id",
        "capacity_tokens",
        "item",
        F.explode(F.sequence(F.lit(0), full - 1)).alias("piece"),
        F.col("capacity_tokens").alias("size"),
        "row",
    )
    own = own.withColumn("container", F.concat(F.lit("d"), F.col("row").cast("string"), F.lit("-"), F.col("piece").cast("string")))
    rest = asked.withColumn("piece", F.when(F.col("size") > F.col("capacity_tokens"), full).otherwise(0))
    rest = rest.withColumn("size", F.col("size") - F.col("piece") * F.col("capacity_tokens")).where("size > 0")
    rest = rest.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)))
    packed = rest.groupBy("window_id", "capacity_tokens", "shard").applyInPandas(pack_shard, schema)
    return packed.unionByName(own.drop("row"))


def fill_report(placed: DataFrame) -> DataFrame:
    """(window_id, capacity_tokens, n_containers, n_tokens, fewest): containers used, and the fewest that could hold as much."""
    held = placed.groupBy("window_id", "capacity_tokens", "container").agg(F.sum("size").alias("held"))
    return held.groupBy("window_id", "capacity_tokens").agg(
        F.count("*").alias("n_containers"),
        F.sum("held").alias("n_tokens"),
        F.ceil(F.sum("held") / F.first("capacity_tokens")).alias("fewest"),
    )


def window_sizes(context_windows: DataFrame) -> list[tuple[int, int]]:
    """(window_id, capacity_tokens) of every usable window, as parameters of ``containers``."""
    rows = context_windows.where("window_id IS NOT NULL AND capacity_tokens > 0").select("window_id", "capacity_tokens").distinct()
    return sorted((r[0], r[1]) for r in rows.limit(MAX_WINDOWS + 1).collect())
