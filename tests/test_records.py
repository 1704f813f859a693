"""Orphan references and the change feed against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import changes, references

REF = "ref long, a string, b string, state string, at double"


def test_masks():
    assert references.checked_masks(2, "simple") == ["00"]
    assert references.checked_masks(2, "partial") == ["00", "01", "10"]
    with pytest.raises(ValueError):
        references.checked_masks(2, "other")


def test_semantics_nulls_and_clashing_names(spark):
    refs = spark.createDataFrame([(1, "x", "y", "s", 0.0), (2, "x", None, "s", 0.0), (3, None, None, "s", 0.0), (4, "z", "y", "s", 0.0), (4, "z", "y", "s", 0.0), (5, "z", None, "s", None), (6, None, "y", "s", 0.0)], REF)
    refs = refs.withColumnRenamed("state", "found")  # a name that the operator might use itself
    targets = spark.createDataFrame([("x", "y", 5.0, "k"), ("x", "y", 9.0, "k"), (None, "q", 1.0, "k")], "a string, b string, arrived double, found string")
    run = lambda **k: sorted((r.ref, r.state) for r in references.orphan_references(refs, targets, ["a", "b"], **k).collect())
    assert run() == [(4, "absent"), (4, "absent")]
    assert run(semantics="partial") == [(4, "absent"), (4, "absent"), (5, "absent")]
    assert run(semantics="full") == [(2, "mixed"), (4, "absent"), (4, "absent"), (5, "mixed"), (6, "mixed")]
    assert run(happened="at", arrived="arrived", grace=4) == [(1, "late"), (4, "absent"), (4, "absent")]
    assert run(happened="at", arrived="arrived", grace=5) == [(4, "absent"), (4, "absent")]
    assert references.orphan_references(refs.limit(0), targets, ["a", "b"]).count() == 0
    assert references.orphan_references(refs, targets.limit(0), ["a", "b"]).count() == 3


def test_edge_ends_clean_ids_and_once(spark):
    edges = spark.createDataFrame(
        [(" E1\t", "s", "Memory", "M1 ", "observation", " o9", 0.0), ("e1", "s", "memory", "m1", "observation", "o9", 0.0), ("e2", "s", "memory", "m2", None, "o1", 0.0), (None, "s", "memory", "gone", None, None, 0.0), ("e3", "t", "memory", "m1", "memory", " ", None)],
        "edge_id string, memory_space string, from_kind string, from_id string, to_kind string, to_id string, created_at double",
    )
    memories = spark.createDataFrame([("m1", "s", 1.0), ("M2", "s", 90_000.0), ("m2", "s", 86_401.0)], "memory_id string, memory_space string, arrived_at double")
    observations = spark.createDataFrame([], "observation_id string, memory_space string, arrived_at double")
    found = references.orphan_edge_ends(edges, memories, observations)
    assert sorted((r.edge_id, r.side, r.state, r.ref_table) for r in found.collect()) == [("e1", "to", "absent", "observation"), ("e2", "from", "late", "memory"), ("e3", "from", "absent", "memory")]
    assert {(r.edge_month, r.n_ends) for r in references.orphan_report(found).collect()} == {("1970-01", 1), (None, 1)}


FEED = "memory_space string, memory_id string, version int, created_at double, version_id string, action string, extra string"


def random_feed(seed, n=400):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        row = ("s%d" % rnd.randrange(2), rnd.choice([None, "m1", "m2", "m3", " M4", "m4"]), rnd.choice([None, 1, 2, 3, 9]), rnd.choice([None, 1.0, 2.0]), f"v{i}", rnd.choice(["create", "archive", " ARCHIVE", None]), "x")
        rows += [row] * rnd.choice([1, 1, 2])
    rnd.shuffle(rows)
    return rows


def newest_by_hand(rows):
    low = float("-inf")
    order = lambda r: (low if r[2] is None else r[2], low if r[3] is None else r[3], r[4])
    best = {}
    for r in rows:
        if r[1] and r[1].strip():
            k = (r[0], r[1].strip().lower())
            if k not in best or order(r) > order(best[k]):
                best[k] = r
    return best


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_newest_first_matches_brute_force(spark, batches):
    rows = random_feed(batches)
    got = {(r.memory_space, r.memory_id, r.version_id) for r in changes.last_changes(spark.createDataFrame(rows, FEED), batches).collect()}
    want = {(*k, r[4]) for k, r in newest_by_hand(rows).items() if (r[5] or "").strip().lower() != "archive"}
    assert got == want


def test_apply_changes(spark):
    base = spark.createDataFrame([("s", "m1", "old", "q"), ("s", "m5", "old", "q"), ("s", "m5", "old", "q"), ("s", None, "old", "q")], "memory_space string, memory_id string, extra string, version_id string")
    feed = spark.createDataFrame([("s", "m1", 1, 1.0, "v1", "create", "new"), ("s", "m1", 1, 1.0, "v1", "create", "new"), ("s", "m2", 2, None, "v2", "create", "made"), ("s", "m3", 1, 1.0, "v3", "archive", "x")], FEED)
    out = changes.apply_changes(base, feed, changes.VERSION_KEYS, changes.VERSION_ORDER, F.col("action") == "archive")
    assert sorted((r.memory_id, r.extra) for r in out.collect()) == [("m1", "new"), ("m2", "made"), ("m5", "old")]
    assert changes.apply_changes(base.limit(0), feed.limit(0), changes.VERSION_KEYS, changes.VERSION_ORDER, F.col("action") == "archive").count() == 0
    assert changes.last_changes(feed.limit(0)).count() == 0
