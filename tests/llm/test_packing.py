import itertools
import random
from collections import Counter

import pytest

from palimpsest.llm import packing


def best_sum(items, room):
    return max((sum(c) for n in range(len(items) + 1) for c in itertools.combinations(items, n) if sum(c) <= room), default=0)


def test_fullest_matches_brute_force():
    rnd = random.Random(0)
    for _ in range(200):
        items = [rnd.randrange(1, 30) for _ in range(rnd.randrange(0, 9))]
        room = rnd.randrange(0, 60)
        counts = Counter(items)
        got = packing.fullest(dict(counts), sorted(counts, reverse=True), room)
        assert sum(got) == best_sum(items, room)
        assert not Counter(got) - counts


def first_fit(items, capacity):
    rooms = []
    for x in sorted(items, reverse=True):
        at = next((i for i, r in enumerate(rooms) if r >= x), None)
        if at is None:
            rooms.append(capacity - x)
        else:
            rooms[at] -= x
    return len(rooms)


def test_pack_places_everything_once():
    rnd = random.Random(1)
    items = Counter(rnd.randrange(1, 101) for _ in range(500))
    bins = list(packing.pack(dict(items), 100))
    assert all(sum(c) <= 100 for c, _ in bins)
    placed = Counter()
    for c, times in bins:
        for x in c:
            placed[x] += times
    assert placed == items
    assert sum(t for _, t in bins) <= first_fit(items.elements(), 100)
    assert list(packing.pack({}, 100)) == []


def test_containers(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 40)
    rnd = random.Random(2)
    items = [(i, rnd.choice([rnd.randrange(1, 60), 100, 250])) for i in range(150)] + [(7, 250), (900, 0), (901, None)]
    df = spark.createDataFrame(items, "doc_id long, n_tokens int")
    rows = packing.containers(df, [(1, 100), (2, 300)]).collect()
    sizes = {}
    for i, n in items:
        sizes.setdefault(i, []).append(n)
    for window, capacity in ((1, 100), (2, 300)):
        mine = [r for r in rows if r.window_id == window]
        held = Counter()
        for r in mine:
            held[r.container] += r.size
        assert max(held.values()) <= capacity
        by_item = Counter()
        for r in mine:
            by_item[r.item] += r.size
        assert by_item == {i: sum(n or 0 for n in ns) for i, ns in sizes.items() if sum(n or 0 for n in ns)}
        assert all(r.piece == 0 for r in mine if max(n or 0 for n in sizes[r.item]) <= capacity)
        assert all(r.size == capacity for r in mine if r.container.startswith("d"))
    report = {r.window_id: r for r in packing.fill_report(packing.containers(df, [(1, 100)])).collect()}
    assert report[1].n_containers <= report[1].fewest + 5


def test_edges(spark):
    df = spark.createDataFrame([(1, 5)], "doc_id long, n_tokens int")
    assert packing.containers(df, []).count() == 0
    assert packing.containers(df.limit(0), [(1, 10)]).count() == 0
    with pytest.raises(ValueError):
        packing.containers(df, [(i, 10) for i in range(packing.MAX_WINDOWS + 1)])
    windows = spark.createDataFrame([(1, "a", 512), (None, "b", 3), (2, "c", None), (1, "a", 512)], "window_id int, purpose string, capacity_tokens int")
    assert packing.window_sizes(windows) == [(1, 512)]
