"""Write path and task queue on literal cases."""

import json

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import lookup, stats, tasks
from palimpsest.operators import writepath as w

MEMORY = "memory_space string, memory_id string, entity_key string, title string, summary string, content string, confidence double, salience double, status string, latest_source_observation_id string, metadata string, created_at double, updated_at double"
ACT = "memory_space string, entity_key string, effect string, target string, new_id string, title string, summary string, content string, confidence double, salience double, observation_id string, metadata string"


def memory(i, status="active", content="old", meta="{}"):
    return ("s", i, "e", "t", "sum", content, 0.5, 0.5, status, "o0", meta, 1.0, 1.0)


def test_merged_json(spark):
    rows = [('{"a":1,"b":{"c":[1]}}', '{"b":2}'), (None, '{"x":null}'), ("broken", ""), ('{"a":1}', None)]
    got = [r.v for r in spark.createDataFrame(rows, "a string, b string").select(w.merged_json(F.col("a"), F.col("b")).alias("v")).collect()]
    assert [json.loads(v) for v in got] == [{"a": 1, "b": 2}, {"x": None}, {}, {"a": 1}]


def test_applied_actions(spark):
    memories = spark.createDataFrame([memory("m1"), memory("m2", "superseded"), memory("m3", meta='{"k":1}'), memory("m4")], MEMORY)
    acts = [("s", "e", "replace", "m1", "n1", "T", "S", "C", 0.9, 0.9, "o1", '{"c":1}'), ("s", "e", "refresh", "m2", None, None, "S", "old and new", None, 0.9, None, '{"c":1}'), ("s", "e", "stale", "m3", None, "T", "S", "C", 0.9, 0.9, "o1", '{"c":1}'), ("s", "e", "create", None, "n2", "T", "S", "C", 0.9, 0.9, "o1", '{"c":1}')]
    out = {r.memory_id: r for r in w.applied(memories, spark.createDataFrame(acts, ACT), 9.0).collect()}
    assert set(out) == {"m1", "m2", "m3", "m4", "n1", "n2"}
    assert (out["m1"].status, json.loads(out["m1"].metadata), out["m1"].content) == ("superseded", {"superseded_by": "n1"}, "old")
    assert (out["m2"].status, out["m2"].content, out["m2"].title, out["m2"].confidence, out["m2"].salience, out["m2"].latest_source_observation_id) == ("superseded", "old and new", "t", 0.5, 0.9, "o0")
    assert (out["m3"].status, json.loads(out["m3"].metadata), out["m3"].title, out["m3"].updated_at) == ("stale", {"k": 1, "c": 1}, "t", 9.0)
    assert (out["m4"].updated_at, out["n1"].status, out["n1"].latest_source_observation_id) == (1.0, "active", "o1")


def test_batch_order(spark):
    kind = "memory_space string, entity_key string, candidate_id string, action string, target_id string"
    rows = [("s", "e", "c1", "create", None), ("s", "e", "c2", "refresh", "c1"), ("s", "e", "c3", "replace", "c2"), ("s", "e", "c4", "stale", "c5"), ("s", "e", "c5", "stale", "c4"), ("s", "e", "c6", "refresh", "m1"), ("s", "e", "c7", "refresh", "gone")]
    existing = spark.createDataFrame([("s", "m1")], "memory_space string, memory_id string")
    out = {r.candidate_id: (r.round, r.action) for r in w.batch_order(spark.createDataFrame(rows, kind), existing).collect()}
    assert out == {"c1": (1, "create"), "c2": (2, "refresh"), "c3": (3, "replace"), "c4": (4, "create"), "c5": (4, "create"), "c6": (1, "refresh"), "c7": (1, "refresh")}
    chain = [("s", "e", f"c{i}", "refresh", f"c{i - 1}") for i in range(1, 26)] + [("s", "e", "c0", "create", None), ("s", "f", "c3", "refresh", "c2")]
    out = {(r.entity_key, r.candidate_id): (r.round, r.action) for r in w.batch_order(spark.createDataFrame(chain, kind), existing).collect()}
    assert out[("e", "c25")] == (26, "refresh") and out[("f", "c3")] == (1, "refresh")  # a chain of any length is followed


def test_effective_actions(spark):
    outputs = spark.createDataFrame([("s", "refresh", "m1"), ("s", "stale", "c1"), ("s", "replace", "gone"), ("s", "create", None)], "memory_space string, action string, target_id string")
    memories = spark.createDataFrame([("s", "m1")], "memory_space string, memory_id string")
    batch = spark.createDataFrame([("s", "c1", "n1")], "memory_space string, candidate_id string, memory_id string")
    assert sorted((r.target or "", r.effect) for r in w.effective_actions(outputs, memories, batch).collect()) == [("", "create"), ("", "create"), ("m1", "refresh"), ("n1", "stale")]


def test_versions_are_dense(spark):
    old = spark.createDataFrame([("s", "m1", 4), ("s", "m2", None)], "memory_space string, memory_id string, version int")
    new = spark.createDataFrame([("s", "m1", "b"), ("s", "m1", "a"), ("s", "m2", "a"), ("s", "m3", "a")], "memory_space string, memory_id string, seq string")
    assert sorted((r.memory_id, r.seq, r.version) for r in w.appended_versions(old, new).collect()) == [("m1", "a", 5), ("m1", "b", 6), ("m2", "a", 1), ("m3", "a", 1)]


@pytest.mark.parametrize(("who", "forms", "schema", "risk"), [("ann", [], 2, "safe"), ("Bea", [], 2, "needs_identity_review"), ("Bea", ["ANN "], 2, "safe"), ("Bea", ["ann"], 1, "reject"), ("", None, 2, "safe"), ("ann", [], None, "reject")])
def test_profile_risk(spark, who, forms, schema, risk):
    df = spark.createDataFrame([(("Ann",), (schema, who, forms))], "a struct<who:string>, b struct<schema_version:int,who:string,surface_forms:array<string>>")
    assert df.select(w.profile_risk(F.col("a"), F.col("b"))["risk"].alias("r")).first().r == risk


def test_history_keeps_ten(spark):
    df = spark.createDataFrame([(list(range(12)),), ([1],), (None,)], "h array<int>")
    assert [r.v for r in df.select(w.with_history(F.col("h"), F.lit(99)).alias("v")).collect()] == [[*range(3, 12), 99], [1, 99], [99]]


TASK = "task_id string, memory_space string, task_type string, status string, priority int, attempts int, max_attempts int, available_at double, lease_expires_at double, dedupe_key string, entity_key string, memory_ids array<string>, created_at double"


def task(i, status="pending", prio=1, attempts=0, at=0.0, lease=None, key=None, kind="reindex_memory", ids=None, created=None):
    return (f"t{i}", "s", kind, status, prio, attempts, 3, at, lease, key, "e", ids, float(i if created is None else created))


def test_queue(spark):
    rows = [task(1), task(2, prio=5), task(3, at=11.0), task(4, "running", lease=10.0), task(5, "running", lease=10.1), task(6, "failed", attempts=2), task(7, "failed", attempts=3), task(8, prio=5, created=0)]
    t = spark.createDataFrame(rows, TASK)
    assert [r.task_id for r in tasks.due(t, 10.0, 2).collect()] == ["t8", "t2"]
    claimed = {r.task_id: r for r in tasks.claim(t, 10.0, 2).collect()}
    assert (claimed["t8"].status, claimed["t8"].attempts, claimed["t8"].lease_expires_at, claimed["t1"].status) == ("running", 1, 70.0, "pending")
    back = {r.task_id: (r.status, r.available_at) for r in tasks.recover(t, 10.0).collect()}
    assert (back["t4"][0], back["t5"][0], back["t6"], back["t7"][0]) == ("pending", "running", ("pending", 10.0), "failed")
    told = spark.createDataFrame([("t4", "failed"), ("t4", "succeeded"), ("t5", "released"), ("t1", "succeeded")], "task_id string, outcome string")
    done = {r.task_id: r.status for r in tasks.finish(t, told).collect()}
    assert (done["t4"], done["t5"], done["t1"]) == ("failed", "pending", "pending")


def test_enqueue_and_coalesce(spark):
    t = spark.createDataFrame([task(1, key="a"), task(2, "succeeded", key="b")], TASK)
    asked = spark.createDataFrame([task(3, key="a"), task(4, key="b"), task(5, key="b"), task(6)], TASK)
    assert sorted(r.task_id for r in tasks.enqueue(t, asked).collect()) == ["t4", "t6"]
    rows = [task(1, ids=["x", "y"]), task(2, ids=["y", "z"]), task(3, kind="continue_ingest", ids=["q"]), task(4, ids=None)]
    got = {r.task_id: (r.leader_id, r.memory_ids) for r in tasks.coalesce_tasks(spark.createDataFrame(rows, TASK)).collect()}
    assert got == {"t1": ("t1", ["x", "y", "z"]), "t2": ("t1", None), "t3": ("t3", ["q"]), "t4": ("t1", None)}


def test_usage_rates(spark):
    runs = spark.createDataFrame([("a", 100, 1, 50), ("a", None, None, None), ("b", 50, 2, 25), ("c", 0, 1, 5)], "worker_type string, input_tokens long, output_tokens long, cached_tokens long")
    got = {r.worker_type: (r.n_runs, r.cache_hit_rate) for r in stats.llm_usage(runs.withColumn("created_at", F.lit(1.0))).collect()}
    assert got[None] == (4, 80 / 150) and got["a"] == (2, 0.5) and got["c"] == (1, 0.0)
    empty = stats.llm_usage(runs.limit(0).withColumn("created_at", F.lit(1.0))).collect()
    assert [(r.worker_type, r.n_runs, r.input_tokens) for r in empty] == [(None, 0, 0)]


def test_statuses_and_stage_timings(spark):
    rows = [("r1", "ok", None), ("r1", "ok", None), ("r2", "ok", None), ("r2", "rejected", "x"), ("r3", "not_ready", None), ("r4", "rejected", "x"), ("r4", "not_ready", "y"), ("r5", "rejected", "x"), ("r5", "rejected", "x")]
    a = spark.createDataFrame([("s", *r) for r in rows], "memory_space string, request_id string, status string, error_code string")
    got = {r.request_id: (r.status, r.error_code) for r in stats.request_status(a).collect()}
    assert got == {"r1": ("ok", None), "r2": ("partial", "x"), "r3": ("not_ready", None), "r4": ("rejected", None), "r5": ("rejected", "x")}
    t = spark.createDataFrame([("q", 1, {"a": 1, "b": 2}, {"b": 3}), ("q", 2, {"a": 5}, None)], "k string, n int, x map<string,int>, y map<string,int>")
    assert stats.merged_timings(t, ["k"], ["x", "y"], ["n"]).first().stages == {"a": 5, "b": 3}


def test_pages_and_lists(spark):
    df = spark.createDataFrame([(f"m{i}", f"100% sure{i}" if i % 2 else "1000 sure", float(i // 2)) for i in range(6)], "id string, title string, at double")
    shown = lookup.page(df, [lookup.like("title", "100%", "prefix")], "at", "id", limit=0, offset=-5).collect()
    assert [(r.id, r.total) for r in shown] == [("m5", 3)]
    assert df.where(lookup.like("title", "100%", "prefix", like_compat=True)).count() == 6
    assert lookup.known_statuses("gone, ,x", ["active"]) == [] and lookup.known_statuses(None, ["a"]) == []
    asked = spark.createDataFrame([("r", ["m1", "", None, "m1", "zz", "m0"])], "request string, ids array<string>")
    assert sorted((r.id, r.position) for r in lookup.by_ids(df, "id", asked).collect()) == [("m0", 5), ("m1", 3)]
    assert [r.id for r in lookup.top(df, "at", "id", 2).collect()] == ["m4", "m5"]


def test_merges_are_followed_to_the_survivor(spark):
    chain = [("s", f"k{i:02}", f"k{i + 1:02}", 50.0 - i) for i in range(40)]
    cycle = [("s", "x", "y", 1.0), ("s", "y", "z", 2.0), ("s", "z", "x", 3.0), ("s", "a", "z", 4.0), ("s", "w", "a", 5.0)]
    several = [("s", "m", "b2", 2.0), ("s", "m", "n", 1.0), ("s", "n", "n", 1.0), ("t", "n", "o", 1.0), ("s", "u", "v", None)]
    merges = spark.createDataFrame(chain + cycle + several, "memory_space string, source string, target string, at double")
    keys = sorted({k for m in chain + cycle + several for k in m[1:3]})
    entities = spark.createDataFrame([("s", k) for k in keys], "memory_space string, entity_key string")
    memories = spark.createDataFrame([("s", f"of {k}", k) for k in keys], "memory_space string, memory_id string, entity_key string")
    after, left = w.merged_entities(memories, entities, merges)
    to = {f"k{i:02}": "k40" for i in range(40)} | {k: "x" for k in "yzaw"} | {"m": "n", "u": "v"}
    assert {r.memory_id: r.entity_key for r in after.collect()} == {f"of {k}": to.get(k, k) for k in keys}
    assert sorted(r.entity_key for r in left.collect()) == [k for k in keys if k not in to]
    assert w.survivors(merges.limit(0)).count() == 0
