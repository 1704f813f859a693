"""The judgement seam, grading, files, snapshots and streams."""

import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators import changes, evals, workers
from palimpsest.sources import evalcases, snapshots
from palimpsest.streaming import ingest
from tests.test_records import FEED, random_feed


def test_judged_in_batches(spark):
    df = spark.createDataFrame([("q", "a"), ("p", "b")], "answer_for string, payload string")
    got = workers.judged(df, lambda ps: [json.dumps({"said": p}) for p in ps])
    assert sorted((r.answer_for, r.answer) for r in got.collect()) == [("p", '{"said": "b"}'), ("q", '{"said": "a"}')]
    assert {r.answer for r in workers.judged(df, lambda ps: []).collect()} == {None}


def test_linked(spark):
    rows = [("r", "d1", "link_existing", "ent_0123456789abcdeg", None, ["ent_0123456789abcdef", "ent_zzz"]), ("r", "d2", "link_existing", "other", None, ["ent_1"]), ("r", "d3", "ambiguous", None, ["ent_1", "x"], ["ent_1"]), ("r", "d4", "create_new", " ", None, None), ("r", "d5", "link_existing", "ent_1", None, ["ent_1"])]
    df = spark.createDataFrame(rows, "request string, draft_id string, decision string, selected string, ambiguous array<string>, keys array<string>")
    got = {r.draft_id: (r.decision, r.entity_key, r.ambiguous) for r in workers.linked(df, "write").collect()}
    assert got == {"d1": ("link_existing", "ent_0123456789abcdef", None), "d2": ("create_new", None, None), "d3": ("ambiguous", None, ["ent_1"]), "d4": ("create_new", None, None), "d5": ("link_existing", "ent_1", None)}
    assert {r.decision for r in workers.linked(df, "query").where("draft_id = 'd2'").collect()} == {"cannot_resolve"}


def test_gate_and_candidates(spark):
    kind = "request string, draft_id string, profile struct<who:string,surface_forms:array<string>,stable_qualifiers:array<string>,definition:string>"
    drafts = spark.createDataFrame([("r1", "d1", (" Ann  B", ["ANN", "ann", "x", "y", "z"], None, None)), ("r1", "d2", (" ", [" "], ["q"], "d")), ("r2", "d3", (None, None, None, None))], kind)
    kept = workers.gated(drafts)
    assert [(r.draft_id, r.profile.who, r.profile.surface_forms, r.profile.schema_version) for r in kept.collect()] == [("d1", "ann b", ["ann", "x", "y"], 2)]
    assert {r.request: r.status for r in workers.gate_status(drafts, kept).collect()} == {"r1": "passed", "r2": "rejected_no_identity_profile"}
    c = spark.createDataFrame([("r1", "d1", "c1"), ("r1", "d2", "c2")], "request string, owner_draft_id string, candidate_id string")
    assert [r.candidate_id for r in workers.owned_candidates(c, kept).collect()] == ["c1"]


def test_resolver_outputs_and_edges(spark):
    out = spark.createDataFrame([("r", "c1", 1, "create", None), ("r", "c1", 2, "refresh", "m1"), ("r", "c2", 1, "stale", "m9"), ("r", "zz", 1, "create", None)], "request string, candidate_id string, position int, action string, target_ref string")
    asked = spark.createDataFrame([("r", "c1"), ("r", "c2"), ("r", "c3")], "request string, candidate_id string")
    refs = spark.createDataFrame([("r", "m1", "mem_1")], "request string, ref string, memory_id string")
    assert sorted((r.candidate_id, r.action, r.target_id) for r in workers.resolved_outputs(out, asked, refs).collect()) == [("c1", "refresh", "mem_1"), ("c2", "create", None)]
    e = spark.createDataFrame([("none",), ("supports",), ("odd",), (None,)], "edge_type string")
    assert [r.edge_type for r in workers.judged_edges(e).collect()] == ["supports"]


def test_citations(spark):
    c = spark.createDataFrame([("r", 1, "m1", None, "", None), ("r", 2, None, "o1", None, "said"), ("r", 3, "zz", "zz", "s", "e"), ("r", 4, "m1", None, "other", None), ("r", 5, "m2", "o1", None, None)], "request string, position int, memory_id string, observation_id string, summary string, excerpt string")
    m = spark.createDataFrame([("r", "m1", "T", "", "body"), ("r", "m2", "T2", "S2", "B2")], "request string, memory_id string, title string, summary string, content string")
    o = spark.createDataFrame([("r", "o1", "obs sum", "obs")], "request string, observation_id string, summary string, content string")
    d = spark.createDataFrame([("r", "o1", ["m2", "m1"])], "request string, observation_id string, memory_ids array<string>")
    got = sorted((r.position, r.memory_id, r.observation_id, r.summary, r.excerpt) for r in workers.citations(c, m, o, d).collect())
    assert got == [(1, "m1", None, "T", "body"), (2, "m2", "o1", "obs sum", "said"), (5, "m2", "o1", "obs sum", "obs sum")]


def test_identity_matches(spark):
    kind = "who:string,surface_forms:array<string>,stable_qualifiers:array<string>"
    cand = ("Ann Bee", ["annie"], ["frost lab"])
    rows = [(("ANN  bee", None, None), cand, True), (("Annie", [], []), cand, True), (("x", ["ann bee"], []), cand, True), (("x", [], ["Frost"]), cand, True), (("x", ["y"], ["z"]), cand, False), (("", [], []), cand, False)]
    df = spark.createDataFrame(rows, f"a struct<{kind}>, b struct<{kind}>, want boolean")
    assert df.where(workers.identity_matches(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_usage_names(spark):
    usage = ['{"prompt_tokens":150,"prompt_cache_hit_tokens":75}', '{"input_tokens":10,"output_tokens":2,"input_token_details":{"cache_read":4}}', None]
    got = [tuple(r.u) for r in spark.createDataFrame([(u,) for u in usage], "u string").select(workers.usage_tokens(F.col("u")).alias("u")).collect()]
    assert got == [(150, None, 75, 75, None), (10, 2, 4, 6, None), (None, None, None, None, None)] or got[:2] == [(150, None, 75, 75, None), (10, 2, 4, 6, None)]


def test_cases_suites_and_report(spark, tmp_path):
    case = {"case_id": "c1", "category": "k", "description": "d", "memory_scope_templates": {"primary": "p"}, "writes": [{"context": "x"}], "queries": [{"query_id": "q", "query": "?"}], "expected": {"primary": {"memory_count": 1, "edge_type_counts": {"supports": 2}}}}
    (tmp_path / "a.json").write_text(json.dumps([case]))
    got = evalcases.cases(spark, str(tmp_path / "a.json")).first()
    assert (got.writes[0].expected_status, got.writes[0].scope, got.queries[0].expected_status, got.queries[0].citations_min, got.expected["primary"].edge_type_counts) == ("accepted", "primary", "ok", 0, {"supports": 2})
    (tmp_path / "b.json").write_text(json.dumps([case | {"memory_scope_templates": {}}]))
    with pytest.raises(PySparkException):
        evalcases.cases(spark, str(tmp_path / "b.json")).collect()
    (tmp_path / "m.json").write_text(json.dumps({"matrix_id": "m", "suites": [{"suite_id": "s1", "cases": "a.json"}, {"suite_id": "s2", "cases": "b.json"}]}))
    assert [r.suite_id for r in evalcases.suites(spark, str(tmp_path / "m.json")).collect()] == ["s1", "s2"]
    summary = evals.case_summary(spark.createDataFrame([("c1", "k", {"a": True, "b": None})], "case_id string, category string, dimensions map<string,boolean>"))
    text = evalcases.write_report(summary.orderBy("kind", "label"), str(tmp_path / "report"))
    assert "| all | all | 1 | 0 | 0.0 |" in text and spark.read.json(str(tmp_path / "report")).count() == 4


def test_text_failures_and_verdicts(spark):
    e = spark.createDataFrame([("c", "primary", "s", "red", True), ("c", "primary", "s", "blue", True), ("c", "primary", "s", "fish", False), ("c", "primary", "s", "", False), ("c", "other", "t", "x", True)], "case_id string, scope string, memory_space string, fragment string, required boolean")
    m = spark.createDataFrame([("s", "red", "fish", None)], "memory_space string, title string, summary string, content string")
    assert sorted(r.failure for r in evals.text_failures(e, m).collect()) == ["forbidden memory text fish", "missing memory text blue", "missing memory text x"]
    v = spark.createDataFrame([("pass", True), ("fail", False), ("odd", True)], "verdict string, grounded boolean")
    assert tuple(evals.verdict_summary(v).first()) == (1, 0, 1, 0.5) and tuple(evals.verdict_summary(v.limit(0)).first()) == (0, 0, 0, 0.0)


def test_snapshots(spark, tmp_path):
    schema = T._parse_datatype_string("k string, v double")
    s = snapshots.Snapshots(spark, str(tmp_path / "t"), schema)
    assert s.read().count() == 0
    s.write(spark.createDataFrame([("a", 1.0)], schema))
    before = s.read()
    s.append(spark.createDataFrame([("b", 2.0)], schema))
    assert before.count() == 1 and s.read().count() == 2
    with pytest.raises(PySparkException):
        snapshots.checked_vectors(spark.createDataFrame([([1.0],)], "vec array<double>"), 2).collect()
    state = spark.createDataFrame([("provider", "x"), ("model", "m"), ("dim", "64")], "state_key string, value string")
    wanted = {"provider": "x", "model": "m", "dim": "64", "projection_version": "1"}
    assert tuple(snapshots.index_state(state, wanted).first()) == ("stale", 1000)
    assert tuple(snapshots.index_state(state.unionByName(spark.createDataFrame([("projection_version", "1")], state.schema)), wanted).first()) == ("ready", None)


def test_change_stream_equals_batch(spark, tmp_path):
    rows = random_feed(9, 120)
    for k in range(3):
        spark.createDataFrame(rows[k::3], FEED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    kept = snapshots.Snapshots(spark, str(tmp_path / "newest"), T._parse_datatype_string("memory_space string, memory_id string, version int, created_at double, version_id string, action string"))
    stream = ingest.stream_table(spark, str(tmp_path / "in"), T._parse_datatype_string(FEED), files_per_batch=1)
    ingest.follow_changes(stream, kept, str(tmp_path / "c")).awaitTermination()
    want = changes.newest_changes(changes.version_changes(spark.createDataFrame(rows, FEED)), changes.VERSION_KEYS, changes.VERSION_ORDER, ["action"])
    cols = ["memory_space", "memory_id", "version_id", "action"]
    assert sorted(map(str, kept.read().select(cols).collect())) == sorted(map(str, want.select(cols).collect()))


def test_ingest_stream_takes_repeats_once(spark, tmp_path):
    kind = "memory_space string, source_ref string, content string, request_id string"
    for rows in ([("s", None, " a  b ", "r1"), ("s", None, " a  b ", "r1")], [("s", None, " a  b ", "r1"), ("s", None, "c", "r2")]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = T._parse_datatype_string("observation_id string, memory_space string, source_ref string, content string, summary string, entity_resolution_status string, metadata string, created_at double")
    obs = snapshots.Snapshots(spark, str(tmp_path / "o"), schema)
    ingest.ingest_texts(ingest.stream_table(spark, str(tmp_path / "in"), T._parse_datatype_string(kind), 1), obs, 1.0, str(tmp_path / "c")).awaitTermination()
    assert sorted(r.summary for r in obs.read().collect()) == ["a b", "c"]


def run_stream(spark, df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    return [tuple(r) for r in spark.table(name).collect()]


def test_throttle_and_leases(spark, tmp_path):
    spark.createDataFrame([("k", 1.0), ("k", 2.0), ("k", 4.5), ("j", 3.0)], "key string, at double").coalesce(1).write.parquet(str(tmp_path / "t"))
    got = run_stream(spark, ingest.throttled(ingest.stream_table(spark, str(tmp_path / "t"), T._parse_datatype_string("key string, at double")), 3.0), "throttle", tmp_path / "a")
    assert sorted(got) == [("j", 6.0), ("k", 4.0), ("k", 7.5)]
    for i, rows in enumerate([[("a", 10.0, "running"), ("b", 10.0, "running")], [("b", 30.0, "succeeded")], [("z", 200.0, "succeeded")], [("z", 300.0, "succeeded")]]):
        spark.createDataFrame(rows, "task_id string, at double, status string").coalesce(1).write.parquet(str(tmp_path / "l" / f"{i}"))
        for f in (tmp_path / "l" / f"{i}").iterdir():
            os.utime(f, (1_700_000_000 + 100 * i,) * 2)  # files arrive in this order
    stream = ingest.stream_table(spark, str(tmp_path / "l" / "*"), T._parse_datatype_string("task_id string, at double, status string"), 1)
    assert run_stream(spark, ingest.expired_leases(stream, 60.0), "leases", tmp_path / "b") == [("a", 70.0)]
