"""Flows, and what only small cases can show of them."""

import json
import re

import pytest
from pyspark.sql import functions as F

from palimpsest import checkpoints
from palimpsest.functions import text
from palimpsest.operators import flows, graph, retrieval, stats, workers
from palimpsest.plans import repair
from palimpsest.sources.snapshots import BucketedSnapshots, Snapshots, index_states

MEMORY = "memory_space string, memory_id string, entity_key string, title string, summary string, content string, confidence double, salience double, status string, latest_source_observation_id string, metadata string, created_at double, updated_at double"
ENTITY = "entity_key string, memory_space string, display_name string, identity_profile struct<schema_version:int,who:string,surface_forms:array<string>,stable_qualifiers:array<string>,definition:string>, metadata string, created_at double, updated_at double"


def memory(i, entity="e1", summary="s", status="active", at=1.0):
    return ("s", i, entity, "t", summary, "c", 0.5, 0.5, status, "o0", "{}", 0.0, at)


def entity(key, who, metadata="{}", forms=()):
    return (key, "s", who.title(), (2, who, list(forms), [], ""), metadata, 0.0, 1.0)


def fragments(value, most=240):
    """Sentences and lines, put together greedily, by walking over the characters."""
    cut, at = [], 0
    while at < len(value):
        end = at
        while end < len(value) and value[end] not in "。！？!?.\n":
            end += 1
        if end == at:
            at += 1
            continue
        stop = end
        if stop < len(value) and value[stop] == "\n":
            while stop < len(value) and value[stop] == "\n":
                stop += 1
        else:
            while stop < len(value) and value[stop] in "。！？!?.":
                stop += 1
        piece = value[at:stop]
        if piece.strip():
            cut.append([at + len(piece) - len(piece.lstrip()), at + len(piece.rstrip()), piece.strip()])
        at = stop
    if not cut and value.strip():
        cut = [[value.find(value.strip()), value.find(value.strip()) + len(value.strip()), value.strip()]]
    out = []
    for start, end, piece in cut:
        if out and len(out[-1][2]) + 1 + len(piece) <= most:
            out[-1] = [out[-1][0], end, f"{out[-1][2]} {piece}"]
        else:
            out.append([start, end, piece])
    return [(i + 1, *f) for i, f in enumerate(out)]


TEXTS = [None, "", " \n ", "One. Two! Three?", "  Lead.  \n\n Next line\nlast", "...", " .!\n", "世界很大。人很多！" * 40, "a" * 300 + ". b", "No mark at the end " * 30, "x.\n.y..\n\n z", "word " * 2_000 + ". " + "tail. " * 500]


def test_fragments(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, v string").select("i", text.fragments(F.col("v")).alias("f")).collect()
    assert {r.i: [tuple(f) for f in r.f] for r in rows} == {i: fragments(t or "") for i, t in enumerate(TEXTS)}


def test_intents_and_stable_json(spark):
    row = spark.createDataFrame([(" Current", "CROSS_ENTITY ", None, "ü")], "a string, b string, c string, d string")
    got = row.select(text.time_intent(F.col("a")), text.time_intent(F.col("c")), text.graph_intent(F.col("b")), text.graph_intent(F.col("a")), text.stable_json({"z": F.col("d"), "a": F.lit(1), "n": F.col("c")})).first()
    assert list(got) == ["current", "uncertain", "cross_entity", "entity_local", '{"a":1,"z":"ü"}']


def test_profile_refresh(spark):
    e = spark.createDataFrame([entity("e1", "ann", json.dumps({"k": 1, "profile_history": [{"revision": i} for i in range(10)], "profile_state": {"profile_revision": 4}})), entity("e2", "bea"), entity("e3", "cyd")], ENTITY)
    m = spark.createDataFrame([memory("m1", summary="new", at=2.0), memory("m2", summary="old"), memory("m3", "e2"), memory("m4", "e3", status="stale")], MEMORY)

    def writer(asked):
        out = []
        for p in map(json.loads, asked):
            who, told = p["current_identity_profile"]["who"], p["recent_memory_summaries"]
            out.append({"ann": json.dumps({"schema_version": 2, "who": "Ann", "surface_forms": ["A", "a", "B", "C", "D"], "stable_qualifiers": [], "definition": told[0] if told else ""}), "bea": json.dumps({"schema_version": 2, "who": "Zoe"})}.get(who, "no json"))
        return out

    got = {r.entity_key: r for r in flows.refreshed_profiles(e, m, writer, "r1", 9.0).collect()}
    assert (got["e1"].refresh_status, got["e1"].identity_profile.surface_forms, got["e1"].identity_profile.definition) == ("applied", ["a", "b", "c"], "new")
    kept = json.loads(got["e1"].metadata)
    assert kept["k"] == 1 and kept["profile_state"]["profile_revision"] == 5 and len(kept["profile_history"]) == 10 and kept["profile_history"][-1]["request_id"] == "r1"
    assert (got["e2"].refresh_status, got["e2"].identity_profile.who, got["e2"].display_name) == ("needs_identity_review", "bea", "bea")
    assert got["e3"].refresh_status == "reject" and json.loads(got["e3"].metadata)["profile_state"]["last_refresh_status"] == "reject"


def test_merges(spark):
    e = spark.createDataFrame([entity("e1", "ann"), entity("e2", "ann"), entity("e3", "ann"), entity("e4", "zed")], ENTITY)
    m = spark.createDataFrame([memory("m1", "e1"), memory("m2", "e2"), memory("m4", "e4")], MEMORY)
    merges = spark.createDataFrame([("s", "e1", "e2", 1.0, "x"), ("s", "e2", "e3", 2.0, "x"), ("s", "e4", "e3", 3.0, "x"), ("s", "e1", "e1", 0.0, "x"), ("s", "e1", "gone", 0.0, "x")], "memory_space string, source string, target string, at double, reason string")

    def judge(asked):
        out = []
        for p in map(json.loads, asked):
            same = p["source_entity"]["identity_profile"]["who"] == p["target_entity"]["identity_profile"]["who"]
            out.append(json.dumps({"decision": "merge" if same else "keep_separate", "survivor_entity_key": " ", "reason": "same", "merged_identity_profile": {"who": "Ann", "surface_forms": [], "stable_qualifiers": ["q"], "definition": ""}}))
        return out

    after = flows.applied_merges(merges, e, m, judge, "r", 9.0)
    assert {r.memory_id: r.entity_key for r in after["memories"].collect()} == {"m1": "e3", "m2": "e3", "m4": "e4"}
    left = {r.entity_key: r for r in after["entities"].collect()}
    assert set(left) == {"e3", "e4"} and left["e3"].identity_profile.stable_qualifiers == ["q"] and left["e3"].updated_at == 9.0 and left["e4"].updated_at == 1.0
    assert json.loads(left["e3"].metadata)["profile_state"]["last_refresh_reason"] == "entity_merged:safe_additive_update"
    assert sorted((r.source, r.target, r.reason) for r in after["log"].collect()) == [("e1", "e2", "same"), ("e2", "e3", "same")]
    assert [(r.dedupe_key, r.priority) for r in after["tasks"].collect()] == [("repair_memory_edges:e3", 11)]
    assert sorted(r.ref_doc for r in after["documents"].collect()) == ["entity:s:e1", "entity:s:e2"]


def test_entity_resolution(spark):
    kind = "memory_space string, request string, draft_id string, who string, surface_forms array<string>, stable_qualifiers array<string>"
    drafts = spark.createDataFrame([("s", "r", "d1", "Ann", [], []), ("s", "r", "d2", "ANN ", [], []), ("s", "r", "d3", "Bob", [], []), ("s", "r", "d4", "Cyd", [], []), ("s", "q", "d5", "Ann", [], []), ("s", "r", "d6", "Dan", [], [])], kind)
    candidates = spark.createDataFrame([("s", "r", d) for d in ("d1", "d2", "d3", "d4")] + [("s", "q", "d5")], "memory_space string, request string, owner_draft_id string")
    e = spark.createDataFrame([entity("ent_of_ann_00000001", "ann"), entity("e2", "bob")], ENTITY)
    m = spark.createDataFrame([memory("m1", "ent_of_ann_00000001", "told")], MEMORY)
    asked_for = []

    def scored(asked):
        asked_for.extend(r.query_id for r in asked.collect())
        known = spark.createDataFrame([("ann", "ent_of_ann_00000001"), ("bob", "e2")], "text string, entity_key string")
        return asked.select("query_id", F.lower("text").alias("text")).join(known, "text").select("query_id", "entity_key", F.lit(1).alias("rank"))

    def linker(asked):
        out = []
        for p in map(json.loads, asked):
            assert p["candidates"][0].get("recent_memory_summaries", ["told"]) == ["told"]
            out.append(json.dumps({"decision": "link_existing", "selected_entity_key": "ent_of_ann_0000001" if p["draft"]["who"] == "Ann" else "nobody", "ambiguous_entity_keys": []}))
        return out

    got = {r.draft_id: (r.decision, r.entity_key) for r in flows.entity_resolution(drafts, candidates, e, m, scored, linker).collect()}
    assert sorted(asked_for) == ["d1", "d3", "d4", "d5"] and set(got) == {"d1", "d2", "d3", "d4", "d5"}
    assert got["d1"] == got["d2"] == got["d5"] == ("link_existing", "ent_of_ann_00000001")  # a mistyped key is repaired
    assert got["d3"][0] == got["d4"][0] == "create_new" and got["d3"][1] != got["d4"][1]


EDGE = "edge_id string, memory_space string, from_kind string, from_id string, to_kind string, to_id string, edge_type string, weight double, reason string, created_at double"


def test_dynamic_recall(spark):
    e = spark.createDataFrame([entity("e1", "ann"), entity("e2", "bob")], ENTITY)
    rows = [memory("m1", "e1", "the red bridge was closed"), memory("m2", "e2", "the red bridge was painted"), memory("m3", "e2", "lunch at noon"), memory("m4", "e2", "painted boats and a red bridge", "archived"), memory("m5", "e2", "painted the boat house green")]
    m = spark.createDataFrame(rows, MEMORY)
    edges = spark.createDataFrame([("d1", "s", "memory", "m1", "observation", "o1", "derived_from", None, "", 1.0)], EDGE)
    obs = spark.createDataFrame([("o1", "s", "", "Who closed  the bridge?"), ("o2", "s", "x", "x")], "observation_id string, memory_space string, summary string, content string")
    held = spark.createDataFrame([("r", "s", "m1")], "request string, memory_space string, memory_id string")
    texts = [(r.position, r.text) for r in flows.dynamic_texts(held, m, edges, obs, spark.createDataFrame([("r", 1, "Ask this"), ("r", 2, "ask THIS"), ("r", 3, " ")], "request string, position int, text string")).orderBy("position").collect()]
    assert texts == [(1, "Ask this"), (2, "the red bridge was closed"), (3, "Who closed the bridge?")]
    judge = lambda pairs: pairs.withColumns({"edge_type": F.when(F.col("candidate_id") == "m3", "none").otherwise("related_to"), "weight": F.lit(0.5)})
    now, made = flows.dynamic_recall(held, m, e, edges, obs, judge)
    assert sorted((r.memory_id, r["round"]) for r in now.collect()) == [("m1", 0), ("m2", 1), ("m5", 2)]  # each frontier memory keeps one
    assert sorted((r.from_id, r.to_id) for r in made.collect()) == [("m1", "m2"), ("m2", "m5")]
    full = spark.createDataFrame([("r", "s", f"x{i}") for i in range(graph.TOTAL)], "request string, memory_space string, memory_id string")
    assert flows.dynamic_recall(full, m, e, edges, obs, judge)[0].count() == graph.TOTAL  # no room, nothing is searched


def test_dynamic_recall_makes_no_row_a_pair_that_shares_a_word(spark, monkeypatch):
    e = spark.createDataFrame([entity("e1", "ann")], ENTITY)
    m = spark.createDataFrame([memory("m1", "e1", "the red bridge"), memory("m2", "e1", "a red bridge"), memory("m3", "e2", "the red boat"), memory("m4", "e1", "the red bridge again")], MEMORY)
    edges, obs = spark.createDataFrame([], EDGE), spark.createDataFrame([], "observation_id string, memory_space string, summary string, content string")
    held = spark.createDataFrame([("r", "s", "m1")], "request string, memory_space string, memory_id string")
    judge = lambda pairs: pairs.withColumns({"edge_type": F.lit("supports"), "weight": text.overlap_score(F.col("left_text"), F.col("right_text"))})
    monkeypatch.setattr(retrieval, "bm25", lambda *_: pytest.fail("all pairs were joined"))
    now, _ = flows.dynamic_recall(held, m, e, edges, obs, judge, rounds=1)
    assert sorted(r.memory_id for r in now.collect()) == ["m1", "m2", "m3", "m4"]


def test_ties_of_weight_fall_to_the_candidates_rank(spark):
    rows = [("a", "s", "memory", "f", "memory", "x", "related_to", 0.5, "", 1.0, 2), ("b", "s", "memory", "f", "memory", "y", "related_to", 0.5, "", 1.0, 1)]
    edges = spark.createDataFrame(rows, EDGE + ", rank int")
    frontier = spark.createDataFrame([("s", "f")], "memory_space string, memory_id string")
    assert [r.edge_id for r in graph.sparsified(edges, frontier, rank="rank").collect()] == ["b"]


def test_frontiers_are_active_ones_if_any(spark):
    m = spark.createDataFrame([memory("m1", "e1", status="stale", at=9.0), memory("m2", "e1", at=1.0), memory("m3", "e2", status="stale", at=1.0), memory("m4", "e2", status=None, at=2.0)], MEMORY)
    assert sorted((r.memory_id, r.position) for r in graph.frontiers(m, 2).collect()) == [("m2", 1), ("m3", 2), ("m4", 1)]


def test_a_missing_entity_is_an_error(spark):
    m, e = spark.createDataFrame([memory("m1", "e1"), memory("m2", "e9")], MEMORY), spark.createDataFrame([entity("e1", "ann")], ENTITY)
    assert [tuple(r) for r in graph.missing_entities(m, e).collect()] == [("s", "e9", 1)]
    with pytest.raises(Exception, match="missing entity e9"):
        graph.owned_memories(m, e).collect()


def test_dense_search_in_many_blocks(spark, monkeypatch):
    rows = [(i, "g" if i % 5 else "h", [float(i % 7), float(i % 3) - 1, 1.0]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id int, grp string, vec array<double>")
    queries = docs.withColumnRenamed("doc_id", "query_id")
    want = sorted(tuple(r) for r in retrieval.dense(queries, docs, 5).collect())
    monkeypatch.setattr(retrieval, "BLOCK", 4)
    assert sorted(tuple(r) for r in retrieval.dense(queries, docs, 5).collect()) == want and len(want) > 200


def test_verdicts(spark):
    rows = [("a", '{"verdict":"pass"}'), ("b", '{"verdict":"maybe"}'), ("c", None), ("d", "x"), ("e", '{"verdict":"fail","grounded":false,"reason":"r"}')]
    got = {r.i: (r.verdict, r.grounded) for r in workers.answer_verdicts(spark.createDataFrame(rows, "i string, answer string")).collect()}
    assert got == {"a": ("pass", True), "b": (None, None), "c": (None, None), "d": (None, None), "e": ("fail", False)}


def test_merged_summaries_count_a_run_once(spark):
    runs = spark.createDataFrame([("r1", "k", [1.0, 9.0], 5.0), ("r1", "k", [2.0], 5.0), ("r2", "k", [], 7.0)], "run string, k string, samples array<double>, wall_clock_ms double")
    r = stats.merged_summaries(runs, ["k"]).first()
    assert (r.n, r.median_ms, r.wall_clock_ms) == (3, 2.0, 12.0)


def test_index_states(spark):
    wanted = {"provider": "p", "model": "m", "dim": 3, "projection_version": 1}
    rows = [("a", k, str(v)) for k, v in wanted.items()] + [("b", "provider", "p"), ("c", "other", "x")]
    got = {r.index_id: r.index_state for r in index_states(spark.createDataFrame(rows, "index_id string, state_key string, value string"), wanted).collect()}
    assert got == {"a": "ready", "b": "stale", "c": "stale"}


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf:
        def __init__(self, **held):
            self.held = held

        def get(self, key, default=None):
            return self.held.get(key, default)

    class Session:
        conf = Conf(**{"spark.master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoints.shared_folder(Session())
    Session.conf = Conf(**{"spark.master": "spark://host:7077", "spark.checkpoint.dir": "file:///shared/"})
    assert checkpoints.shared_folder(Session()) == "file:///shared"


def test_a_pointer_that_cannot_be_read_is_an_error(spark, tmp_path):
    schema = spark.createDataFrame([], "k int").schema
    s = Snapshots(spark, f"file://{tmp_path}/t", schema)
    assert s.read().count() == 0
    s.write(spark.createDataFrame([(1,)], schema))
    for f in (tmp_path / "t/pointer").glob("part-*.json"):
        f.write_bytes(b"\xff\xfe garbage")
        crc = f.with_name(f".{f.name}.crc")
        if not crc.exists():
            crc.write_bytes(b"crc\x00\x00\x00\x02\x00broken")
    with pytest.raises(Exception):  # noqa: B017, PT011
        s.write(spark.createDataFrame([(2,)], schema))
    assert re.fullmatch(r"v1", "".join(p.name for p in (tmp_path / "t").glob("v*")))


def test_a_merge_rewrites_only_the_buckets_of_its_batch(spark, tmp_path):
    schema = spark.createDataFrame([], "k int, v string").schema
    held = BucketedSnapshots(spark, f"file://{tmp_path}/b", schema, ["k"], buckets=8)
    newer = lambda old, new: new.unionByName(old.join(new.select("k"), "k", "left_anti"))
    assert held.read().count() == 0
    held.merge(spark.createDataFrame([], schema), newer)
    held.merge(spark.createDataFrame([(i, "a") for i in range(100)], schema), newer)
    held.merge(spark.createDataFrame([(7, "b")], schema), newer)
    assert sorted(map(tuple, held.read().collect())) == sorted([(i, "b" if i == 7 else "a") for i in range(100)])
    assert len(list((tmp_path / "b/v1").glob("bucket=*"))) == 8 and len(list((tmp_path / "b/v2").glob("bucket=*"))) == 1


def test_candidates_of_other_entities(spark):
    e = spark.createDataFrame([entity("e1", "ann"), entity("e2", "bob")], ENTITY)
    rows = [memory("m1", "e1", "the red bridge was closed"), memory("m2", "e1", "the red bridge was closed again"), memory("m3", "e2", "a red bridge"), memory("m4", "e9", "the red bridge was closed"), memory("m5", "e2", "red bridge", "archived")]
    m = spark.createDataFrame(rows, MEMORY)
    edges, obs = spark.createDataFrame([], EDGE), spark.createDataFrame([], "observation_id string, memory_space string, summary string, content string")
    frontier = spark.createDataFrame([("r1", "s", "e1", "m1"), ("r9", "s", "e9", "m4")], "request string, memory_space string, anchor string, memory_id string")
    assert [(r.request, r.candidate_id) for r in flows.related_candidates(frontier, m, e, edges, obs).collect()] == [("r1", "m3")]


def test_a_repair_is_planned_in_small_steps(spark):
    e = spark.createDataFrame([entity("e1", "ann lee"), entity("e2", "bob ray")], ENTITY)
    m = spark.createDataFrame([memory("m1", "e1", "the red bridge was closed"), memory("m2", "e2", "ann lee says the red bridge was closed"), memory("m3", "e2", "ann lee likes lunch")], MEMORY)
    made = repair.cross_entity_repair(m, e, spark.createDataFrame([], EDGE))
    assert [(r.from_id, r.to_id, r.edge_type) for r in made.collect()] == [("m1", "m2", "related_to")]
    plan = made._jdf.queryExecution().optimizedPlan().toString()  # noqa: SLF001
    assert len(re.findall(r"\bJoin\b", plan)) < 20 and len(re.findall(r"\bWindow\b", plan)) < 5
