"""Consolidating pairwise matches into groups: connected components on a two-dimensional grid.

Vertices are hashed into ``B`` blocks, and every link goes to the cell of its two blocks, so the links of one vertex, however
many, are spread over the cells of one row and column of the grid. A round runs union-find inside each cell, exchanges the
cells' representatives of every vertex along its row and column, lets the vertex point to the smallest of them, and keeps only
links between representatives; the graph contracts until no link is left, when parents are stable. The pointers of all rounds
are then composed, newest last.

Vertices are numbered in an order that has nothing to do with their names, so chains of sorted names contract as fast as others.
Only counts reach the driver; all tables between rounds are written to the shared checkpoint folder.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.checkpoints import forget, materialise
from palimpsest.functions.ids import clean_id
from palimpsest.session import shuffle_partitions

#: Links that one cell should hold at most, on average: 16 bytes each, some 100 MB with the arrays that union-find needs.
LINKS_PER_CELL = 500_000


def grid_blocks(cells: int) -> int:
    """Blocks that make at least ``cells`` cells: the grid is symmetric, so B blocks make B(B+1)/2 of them."""
    return max(1, math.ceil((math.sqrt(8 * cells + 1) - 1) / 2))


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, smallest vertex of each one's component) of the links a[i]–b[i]."""
    names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = flat[: len(a)], flat[len(a) :]
    parent = np.arange(len(names))
    while True:  # roots are hooked to smaller roots, then all paths are halved until flat
        ra, rb = parent[a], parent[b]
        if np.array_equal(ra, rb):
            return names, names[parent]
        low = np.minimum(ra, rb)
        np.minimum.at(parent, ra, low)
        np.minimum.at(parent, rb, low)
        while not np.array_equal(parent, up := parent[parent]):
            parent = up


def cell_representatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, rep) for the vertices of the links (a, b) of one task, which is one cell."""
    got = list(batches)
    if any(x.num_rows for x in got):
        links = pa.Table.from_batches(got)
        v, rep = union_find(links["a"].to_numpy(), links["b"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(rep)], names=["v", "rep"])


def contract(links: DataFrame, blocks: int) -> tuple[DataFrame, DataFrame]:
    """One round over links (a, b): pointers (v, p) of all their vertices, and the links that remain, between representatives.

    Vertices of one link share the representative of its cell, and every representative that a vertex has is linked to the
    one that it points to; so the remaining links connect exactly what was connected. A vertex that is smallest in no cell
    is gone from them.
    """
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    low, high = F.least(block("a"), block("b")), F.greatest(block("a"), block("b"))
    cell = (low * (2 * blocks - low - 1) / 2).cast("int") + high  # numbers the upper half of the grid row by row
    cells = links.withColumn("cell", cell).repartitionById(blocks * (blocks + 1) // 2, F.col("cell")).select("a", "b")
    reps = materialise(cells.mapInArrow(cell_representatives, "v long, rep long"), "reps")
    pointers = materialise(reps.groupBy("v").agg(F.min("rep").alias("p")), "pointers")
    apart = reps.join(pointers, "v").where("rep <> p").select(F.col("p").alias("a"), F.col("rep").alias("b")).distinct()
    rest = materialise(apart, "links")
    forget(reps)
    return pointers, rest


def components(links: DataFrame) -> DataFrame:
    """(v, root): one row for each vertex of the links (a long, b long); ``root`` is the same for connected vertices only.

    Repeated links, links in either direction and loops are allowed; null ends are not. No links give no rows.
    """
    spark = links.sparkSession
    links = materialise(links.select("a", "b"), "links")
    rounds: list[DataFrame] = []
    cells = shuffle_partitions(spark)
    while n := links.count():
        blocks = grid_blocks(max(cells, math.ceil(n / LINKS_PER_CELL)))
        pointers, rest = contract(links, blocks)
        forget(links)
        rounds.append(pointers)
        links, cells = rest, 1
    if not rounds:
        return links.select(F.col("a").alias("v"), F.col("b").alias("root"))
    out = rounds[0].select("v", F.col("p").alias("root"))
    for later in rounds[1:]:
        step = later.select(F.col("v").alias("root"), "p")
        out = out.join(step, "root", "left").select("v", F.coalesce("p", "root").alias("root"))
    return out


def group_records(pairs: DataFrame, left: str, right: str, within: Sequence[str] = ()) -> DataFrame:
    """(within, key, group_key): one row for each key named in the pairs; ``group_key`` is the smallest key of its group.

    Keys are strings and have a meaning only together with the ``within`` columns. A pair with a null key or a null
    ``within`` column is ignored; one that names a key twice makes it a group of its own unless other pairs extend it. Pairs
    repeat freely. No pairs give no rows. Other columns of ``pairs`` are ignored, whatever their names.
    """
    within = list(within)
    ends = pairs.select(*within, F.col(left).alias("__l"), F.col(right).alias("__r")).dropna().distinct()
    ends = materialise(ends, "pairs")
    keys = ends.select(*within, F.col("__l").alias("key")).unionByName(ends.select(*within, F.col("__r").alias("key"))).distinct()
    keys = materialise(keys.withColumn("v", F.monotonically_increasing_id()), "keys")  # written once, so numbers are fixed
    number = lambda side, name: keys.select(*within, F.col("key").alias(side), F.col("v").alias(name))
    links = ends.join(number("__l", "a"), [*within, "__l"]).join(number("__r", "b"), [*within, "__r"]).select("a", "b")
    grouped = keys.join(components(links), "v")
    smallest = grouped.groupBy("root").agg(F.min("key").alias("group_key"))
    return grouped.join(smallest, "root").select(*within, "key", "group_key")


def entity_groups(merge_logs: DataFrame) -> DataFrame:
    """(memory_space, entity_key, group_key) of all entity keys in the merge log, cleaned; see ``group_records``."""
    pairs = merge_logs.select(
        "memory_space", clean_id("source_entity_key").alias("source"), clean_id("target_entity_key").alias("target")
    )
    return group_records(pairs, "source", "target", ["memory_space"]).withColumnRenamed("key", "entity_key")
