import random

import numpy as np

from palimpsest.llm import groups


def by_hand(pairs):
    parent = {}

    def find(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {v: find(v) for v in list(parent)}


def test_union_find():
    a, b = np.array([5, 1, 9, 9]), np.array([1, 2, 9, 10])
    v, rep = groups.union_find(a, b)
    assert dict(zip(v.tolist(), rep.tolist())) == {1: 1, 2: 1, 5: 1, 9: 9, 10: 9}


def test_grid_blocks():
    assert [groups.grid_blocks(n) for n in (1, 2, 3, 4, 6, 7)] == [1, 2, 2, 3, 3, 4]


def test_random_graph_chain_and_hub(spark, monkeypatch):
    monkeypatch.setattr(groups, "LINKS_PER_CELL", 20)  # several cells in every round
    rnd = random.Random(3)
    pairs = [(f"k{rnd.randrange(80):03d}", f"k{rnd.randrange(80):03d}") for _ in range(50)]
    pairs += [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(120)]  # a chain in the order of names
    pairs += [("hub", f"h{i:03d}") for i in range(150)] + [("self", "self")]
    df = spark.createDataFrame([("s", a, b) for a, b in pairs], "memory_space string, a string, b string")
    got = {r.key: r.group_key for r in groups.group_records(df, "a", "b", ["memory_space"]).collect()}
    assert got == by_hand(pairs)


def test_spaces_nulls_and_clashing_names(spark):
    rows = [("s", " A", "b", "x"), ("s", "B\t", "c", "x"), ("t", "a", "z", "x"), ("s", None, "q", "x"), ("s", " ", "q", "x"), (None, "p", "q", "x"), ("s", "b", "A", "x"), ("t", "y", "Y", "x")]
    logs = spark.createDataFrame(rows, "memory_space string, source_entity_key string, target_entity_key string, key string")
    got = sorted((r.memory_space, r.entity_key, r.group_key) for r in groups.entity_groups(logs).collect())
    assert got == [("s", "a", "a"), ("s", "b", "a"), ("s", "c", "a"), ("t", "a", "a"), ("t", "y", "y"), ("t", "z", "a")]
    assert groups.entity_groups(logs.limit(0)).count() == 0
