"""Retrieval on literal cases and against brute force."""

import math
import random
import re

import pytest

from palimpsest.operators import retrieval as r


def test_oversample():
    assert r.oversampled(10, 100) == 24 and r.oversampled(30, 100) == 30 and r.oversampled(30, 5) == 5 and r.oversampled(1, 0) == 1


def test_rrf_floor_and_order_of_lists(spark):
    one = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query_id string, doc_id string, rank int")
    two = spark.createDataFrame([("q", "b", 1)], "query_id string, doc_id string, rank int")
    assert r.rrf([one.limit(1)], floor=0.5).count() == 0
    rows = lambda ls: sorted((x.doc_id, x.score) for x in r.rrf(ls).collect())
    assert rows([one, two]) == rows([two, one])
    assert rows([one, two])[1][1] == pytest.approx(1 / 52 + 1 / 51)


def test_dense_matches_brute_force(spark):
    rnd = random.Random(1)
    vec = lambda: [rnd.gauss(0, 1) for _ in range(8)]
    docs = [("g%d" % (i % 2), i, vec()) for i in range(60)] + [("g0", 98, [0.0] * 8), ("g0", 99, None)]
    docs += [("g0", 100, docs[0][2])]  # a tie
    queries = [("g0", "q0", vec()), ("g1", "q1", vec()), ("g2", "q2", vec()), ("g0", "q3", None)]
    got = r.dense(spark.createDataFrame(queries, "grp string, query_id string, vec array<double>"), spark.createDataFrame(docs, "grp string, doc_id long, vec array<double>"), k=5, floor=0.1)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    want = set()
    for g, q, v in queries[:3]:
        near = sorted((-round(cos(v, w), 9), i) for h, i, w in docs if h == g and w and any(w))
        want |= {(q, i, n + 1) for n, (s, i) in enumerate(near[:5]) if -s >= 0.1}
    assert {(x.query_id, x.doc_id, x.rank) for x in got.collect()} == want


def test_dense_floor_is_inclusive(spark):
    docs = spark.createDataFrame([("g", 1, [1.0, 0.0]), ("g", 2, [0.5, math.sqrt(0.75)]), ("g", 3, [0.49, math.sqrt(1 - 0.49**2)])], "grp string, doc_id long, vec array<double>")
    query = spark.createDataFrame([("g", "q", [1.0, 0.0])], "grp string, query_id string, vec array<double>")
    assert sorted(x.doc_id for x in r.dense(query, docs, floor=0.5).collect()) == [1, 2]


def test_bm25_matches_brute_force(spark):
    docs = [("g", "a", "red red fish"), ("g", "b", "blue fish 世界"), ("g", "c", None), ("g", "d", ""), ("h", "e", "red")]
    queries = [("q", "g", "Red fish fish"), ("p", "g", "世 ?"), ("n", "g", None), ("m", "k", "red")]
    got = {(x.query_id, x.doc_id): x.score for x in r.bm25(spark.createDataFrame(queries, "query_id string, grp string, text string"), spark.createDataFrame(docs, "grp string, doc_id string, text string")).collect()}
    toks = lambda s: re.findall(r"[A-Za-z0-9_]+|[一-鿿]", (s or "").lower())
    own = {i: toks(s) for g, i, s in docs if g == "g"}
    mean = sum(map(len, own.values())) / len(own)
    want = {}
    for q, g, s in queries[:3]:
        for i, words in own.items():
            score = 0
            for t in toks(s):
                df = sum(t in w for w in own.values())
                tf = words.count(t)
                if tf:
                    score += math.log(1 + (len(own) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / mean))
            if score > 0:
                want[q, i] = round(score, 9)
    assert got == pytest.approx(want)


def test_best_of_blocks_are_those_of_all_pairs(spark, monkeypatch):
    rnd = random.Random(2)
    said = lambda n: " ".join(rnd.choice(["red", "blue", "fish", "boat", "世", "界", "gate", "Gate"]) for _ in range(rnd.randrange(n)))
    docs = [("g" if i % 4 else "h", f"d{i}", said(9)) for i in range(90)] + [("g", "none", None), ("k", "alone", "red")]
    docs += [(g, f"{i}x", t) for g, i, t in docs[:30]]  # ties
    queries = [("g" if i % 3 else "h", f"q{i}", said(12)) for i in range(25)] + [("g", "empty", None), ("nowhere", "q", "red")]
    asked, held = spark.createDataFrame(queries, "grp string, query_id string, text string"), spark.createDataFrame(docs, "grp string, doc_id string, text string")
    want = sorted(tuple(x) for x in r.ranked(r.bm25(asked, held), 7).select("query_id", "doc_id", "score", "rank").collect())
    for block, part in ((r.BLOCK, r.ASKED_BLOCK), (8, 3)):
        monkeypatch.setattr(r, "BLOCK", block)
        monkeypatch.setattr(r, "ASKED_BLOCK", part)
        assert sorted(tuple(x) for x in r.bm25_best(asked, r.word_blocks(held), 7).select("query_id", "doc_id", "score", "rank").collect()) == want
    assert len(want) > 100


def test_index_maintenance(spark):
    kind = "ref_doc string, text string, updated_at double"
    index = spark.createDataFrame([("a", "x", 1.0), ("b", "x", None), ("c", "x", 3.0)], kind)
    expected = spark.createDataFrame([("a", "x", 1.0), ("b", "x", None), ("c", "y", 4.0), ("d", "y", 1.0)], kind)
    assert sorted(x.ref_doc for x in r.stale_documents(expected, index).collect()) == ["c", "d"]
    new = spark.createDataFrame([("c", " ", 4.0), ("d", "y", 1.0)], kind)
    assert sorted(x.ref_doc for x in r.upsert(index, new).collect()) == ["a", "b", "d"]


def test_seeds_follow_the_intent(spark):
    rows = [("q", "latest", "active"), ("q", "latest", "stale"), ("p", "latest", "stale"), ("o", "history", "stale"), ("o", None, "active")]
    got = r.intended_seeds(spark.createDataFrame(rows, "query_id string, time_intent string, status string"))
    assert sorted((x.query_id, x.status) for x in got.collect()) == [("o", "active"), ("o", "stale"), ("p", "stale"), ("q", "active")]


def test_a_name_finds_the_memories_of_its_entity(spark):
    profile = "struct<who:string,definition:string,surface_forms:array<string>,stable_qualifiers:array<string>>"
    entities = spark.createDataFrame(
        [("s", "e1", ("Ann Alder", None, ["Annie"], None), 1.0), ("s", "e2", ("Bob", None, None, None), 1.0), ("t", "e1", ("Cleo", None, None, None), 1.0)],
        f"memory_space string, entity_key string, identity_profile {profile}, updated_at double",
    )
    memories = spark.createDataFrame(
        [("s", "m1", "e1", "active"), ("s", "m2", "e2", "active"), ("s", "m3", "e1", "archived"), ("s", "m4", "e1", None), ("s", "m5", "gone", "active"), ("t", "m6", "e1", "active")],
        "memory_space string, memory_id string, entity_key string, status string",
    ).selectExpr("*", "'Job' AS title", "'moved to the harbour' AS summary", "cast(null AS string) AS content", "1.0 AS updated_at")
    documents = r.searched_memories(memories, entities)
    assert {x.doc_id for x in documents.collect()} == {"m1", "m2", "m4", "m5", "m6"}
    asked = spark.createDataFrame([("q", "s", "annie alder")], "query_id string, grp string, text string")
    assert {x.doc_id for x in r.bm25(asked, documents).collect()} == {"m1", "m4"}
