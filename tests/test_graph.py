"""The relation graph on literal cases and against brute force."""

import random

from palimpsest.operators import graph as g

EDGE = "edge_id string, memory_space string, from_kind string, from_id string, to_kind string, to_id string, edge_type string, weight double, created_at double"


def edge(i, a, b, t="related_to", w=1.0, at=None, kind="memory"):
    return (f"e{i}", "s", "memory", a, kind, b, t, w, float(at if at is not None else i))


def ids(df):
    return sorted(r.edge_id for r in df.collect())


def test_insert_skips_reverse_pairs_and_is_idempotent(spark):
    store = spark.createDataFrame([edge(1, "a", "b", "supports"), edge(2, "a", "b", "updates")], EDGE)
    proposed = spark.createDataFrame([edge(3, "b", "a", "supports"), edge(4, "b", "a", "updates"), edge(5, "c", "d"), edge(6, "d", "c"), edge(7, "a", "b", "contradicts")], EDGE)
    new = g.insertable(store, proposed, ["created_at", "edge_id"])
    assert ids(new) == ["e4", "e5", "e7"]
    assert g.insertable(store.unionByName(new), proposed, ["created_at", "edge_id"]).count() == 0


def test_normalised(spark):
    known = spark.createDataFrame([("s", "a"), ("s", "b")], "memory_space string, memory_id string")
    rows = [edge(1, "b", "a"), edge(2, "a", "b"), edge(3, "a", "a"), edge(4, "a", "x"), edge(5, "a", "b", "supports", 0.19), edge(6, "b", "a", "supports", 0.2), edge(7, "a", "b", "supports", None)]
    got = g.normalised(spark.createDataFrame(rows, EDGE), known, ["created_at"])
    assert sorted((r.edge_id, r.from_id, r.to_id) for r in got.collect()) == [("e1", "a", "b"), ("e6", "b", "a")]


def test_sparsified(spark):
    frontier = spark.createDataFrame([("s", "f1"), ("s", "f2")], "memory_space string, memory_id string")
    ranks = spark.createDataFrame([("s", "x", 2), ("s", "y", 1)], "memory_space string, memory_id string, rank int")
    rows = [edge(1, "f1", "x", w=0.5), edge(2, "y", "f1", w=0.5), edge(3, "f1", "z", w=0.4), edge(4, "f1", "x", "supports"), edge(5, "p", "q"), edge(6, "f2", "f1", w=0.9)]
    assert ids(g.sparsified(spark.createDataFrame(rows, EDGE), frontier, ranks)) == ["e2", "e4", "e5", "e6"]


def test_prune_keeps_the_bound(spark):
    rows = [edge(1, "a", "b", w=1.0), edge(2, "b", "c", w=0.85), edge(3, "c", "d", w=0.84), edge(4, "x", "y", w=0.1), edge(5, "a", "d", "supports", 0.1)]
    assert ids(g.pruned_components(spark.createDataFrame(rows, EDGE))) == ["e1", "e2", "e4", "e5"]


def test_connected_matches_union_find(spark):
    rnd = random.Random(2)
    links = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 200 + i) for i in range(50)]
    parent = {v: v for e in links for v in e}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.v: r.root for r in g.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {v: find(v) for v in parent}
    assert g.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_historical_conflicts(spark):
    mem = spark.createDataFrame([("s", "a", '{"record_markers":{"x":"y"}}'), ("s", "b", "{}"), ("s", "c", '{"record_markers":{"x":" "}}'), ("s", "d", None)], "memory_space string, memory_id string, metadata string")
    rows = [edge(1, "a", "b", "contradicts"), edge(2, "b", "c", "contradicts"), edge(3, "a", "z", "contradicts"), edge(4, "a", "b"), edge(5, "d", "z", "contradicts")]
    assert ids(g.without_historical_conflicts(spark.createDataFrame(rows, EDGE), mem)) == ["e2", "e4", "e5"]


def brute_expand(seeds, edges, owner, usable, anchor, intent, hops):
    held, place = list(dict.fromkeys(seeds)), dict.fromkeys(seeds, 0)

    def step(current, cross):
        seen = {t: [] for t in g.BUDGETS}
        for e in sorted(edges, key=lambda e: (e[8], e[0])):
            a, b, t = e[3], e[5], e[6]
            if a in current:
                other, out = b, True
            elif b in current:
                other, out = a, False
            else:
                continue
            if (owner.get(other, anchor) != anchor) != cross:
                continue
            if t == "updates" and not (intent == "history" or (intent in ("current", "latest") and not out) or (intent not in ("history", "current", "latest") and other not in held)):
                continue
            if other not in seen[t]:
                seen[t].append(other)
        ordered = [x for t, n in g.BUDGETS.items() for x in seen[t][:n]]
        added = []
        for x in ordered[: max(g.TOTAL - len(held), 0)]:
            if x in usable and x not in held and x not in added:
                added.append(x)
        return added

    added = step(set(held), False)
    held += added
    place |= dict.fromkeys(added, 1)
    frontier = list(held)
    for hop in range(2, hops + 2):
        added = step(set(frontier), True)
        held += added
        place |= dict.fromkeys(added, hop)
        frontier = added
        if not added:
            break
    return place


def test_expansion_matches_brute_force(spark):
    rnd = random.Random(5)
    names = [f"m{i:02d}" for i in range(60)]
    owner = {m: f"ent{rnd.randrange(4)}" for m in names[:55]}  # five memories don't exist
    status = {m: rnd.choice(["active", "active", "stale", "archived"]) for m in owner}
    edges = [edge(i, *rnd.sample(names, 2), t=rnd.choice(list(g.BUDGETS)), at=rnd.randrange(50)) for i in range(220)]
    memories = spark.createDataFrame([("s", m, owner[m], status[m]) for m in owner], "memory_space string, memory_id string, entity_key string, status string")
    seeds, want = [], {}
    usable = {m for m in owner if status[m] != "archived"}
    for n, intent in enumerate(["history", "latest", "uncertain", None]):
        for anchor in ("ent0", "ent1"):
            own = [m for m in usable if owner[m] == anchor][:3]
            request = f"{n}{anchor}"
            seeds += [(request, "s", anchor, intent, m) for m in own]
            want |= {(request, m): h for m, h in brute_expand(own, edges, owner, usable, anchor, intent, 3).items()}
    got = g.expanded(spark.createDataFrame(seeds, "request string, memory_space string, anchor string, time_intent string, memory_id string"), spark.createDataFrame(edges, EDGE), memories)
    assert {(r.request, r.memory_id): r.hop for r in got.collect()} == want


def test_short_refs(spark):
    rows = [("q", "B", 1), ("q", "a", 2), ("q", "b", 3), ("q", " ", 4), ("p", "a", 1)]
    refs = g.short_refs(spark.createDataFrame(rows, "request string, id string, position int"), "m")
    assert sorted((r.request, r.id, r.ref) for r in refs.collect()) == [("p", "a", "m1"), ("q", "B", "m1"), ("q", "a", "m2")]
    cited = spark.createDataFrame([("q", 1, "m2"), ("q", 2, "m9")], "request string, position int, ref string")
    assert [(r.position, r.id) for r in g.restored(cited, refs).collect()] == [(1, "a")]


def test_a_hub_is_thinned_and_nothing_is_lost(spark, monkeypatch):
    """Hubs with very many edges, most of them to a few entities; expansions equal those over all edges."""
    rnd = random.Random(11)
    names = ["hub0", "hub1"] + [f"m{i}" for i in range(500)]
    owner = {n: f"e{min(rnd.randrange(12), rnd.randrange(12))}" for n in names}
    memories = spark.createDataFrame([("s", n, owner[n], "active") for n in names], "memory_space string, memory_id string, entity_key string, status string")
    rows = []
    for i in range(6_000):
        a, b = rnd.choice(names[:2]) if i % 4 else rnd.choice(names), rnd.choice(names)
        a, b = (a, b) if rnd.random() < 0.5 else (b, a)
        rows.append((f"x{i:05d}", "s", "memory", a, "memory", b, rnd.choice(list(g.BUDGETS)), 0.5, float(rnd.randrange(300))))
    edges = spark.createDataFrame(rows, "edge_id string, memory_space string, from_kind string, from_id string, to_kind string, to_id string, edge_type string, weight double, created_at double")
    seeds = [(f"r{i}", "s", owner[n], intent, n) for i, (n, intent) in enumerate((n, t) for n in ["hub0", "hub1", *rnd.sample(names, 8)] for t in ("history", "latest", "uncertain"))]
    seeds = spark.createDataFrame(seeds, "request string, memory_space string, anchor string, time_intent string, memory_id string")
    ends = g._owned_ends(edges, memories)
    assert g._first_ends(ends).count() < 0.8 * ends.count()
    got = sorted(tuple(r) for r in g.expanded(seeds, edges, memories).collect())
    monkeypatch.setattr(g, "AHEAD", 10**9)
    assert got == sorted(tuple(r) for r in g.expanded(seeds, edges, memories).collect())
