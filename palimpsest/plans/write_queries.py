"""Queries of the write path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.functions.ids import clean_id
from palimpsest.operators import retrieval, stats
from palimpsest.operators import writepath as w
from palimpsest.plans.views import ident, over
from palimpsest.sources import bindings as b
from palimpsest.sources.tables import table

NOW = 1_770_000_000.0
QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_BLANK = r"'[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'"


def _norm(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), {_BLANK}, ' ', 'g'))"


@query(f"""SELECT 'obs_' || substr(sha256(concat_ws(chr(31), memory_space, CAST(doc_id AS VARCHAR), text)), 1, 32) AS observation_id, memory_space, source AS source_ref, substr({_norm("text")}, 1, 500) AS summary, 'pending' AS entity_resolution_status
FROM documents WHERE text IS NOT NULL""")
def v_new_observations(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "documents").where("text IS NOT NULL").select("memory_space", F.col("source").alias("source_ref"), F.col("text").alias("content"), F.col("doc_id").cast("string").alias("request_id"))
    return w.new_observations(texts, NOW).select("observation_id", "memory_space", "source_ref", "summary", "entity_resolution_status")


@query(
    over("o_", "v_")
    + """, k AS (SELECT memory_space, trigger_observation_id AS observation_id, max(version) AS n FROM v_ WHERE trigger_observation_id IS NOT NULL GROUP BY 1, 2)
SELECT observation_id, CASE WHEN k.n IS NOT NULL THEN 'resolved' ELSE entity_resolution_status END AS entity_resolution_status,
  CASE WHEN k.n IS NOT NULL THEN k.n END AS n_versions, metadata->>'$.record_markers.round_label' AS round_label FROM o_ LEFT JOIN k USING (memory_space, observation_id)"""
)
def v_marked_observations(spark: SparkSession, d: str) -> DataFrame:
    v = b.versions(spark, d).where("trigger_observation_id IS NOT NULL").groupBy("memory_space", F.col("trigger_observation_id").alias("observation_id")).agg(F.max("version").alias("n_versions"))
    marks = v.select("memory_space", "observation_id", F.lit("resolved").alias("status"), F.to_json(F.struct("n_versions")).alias("metadata"))
    out = w.marked_observations(b.observations(spark, d), marks)
    get = lambda path: F.get_json_object("metadata", path)
    return out.select("observation_id", "entity_resolution_status", get("$.n_versions").cast("int").alias("n_versions"), get("$.record_markers.round_label").alias("round_label"))


@query(
    over("m_", "v_")
    + """, c AS (SELECT memory_space, entity_key, count(*) AS n_candidates FROM m_ WHERE status = 'active' GROUP BY 1, 2), x AS (SELECT memory_space, entity_key, count(*) AS n_existing FROM m_ WHERE status <> 'active' GROUP BY 1, 2)
SELECT memory_space, entity_key, n_candidates, coalesce(n_existing, 0) AS n_existing, CASE WHEN n_existing > 0 THEN 'resolver' WHEN n_candidates = 1 THEN 'create' ELSE 'batch' END AS route FROM c LEFT JOIN x USING (memory_space, entity_key)"""
)
def v_resolver_route(spark: SparkSession, d: str) -> DataFrame:
    m = b.memories(spark, d)
    return w.resolver_route(m.where("status = 'active'"), m.where("status <> 'active'"))


def outputs(spark: SparkSession, d: str) -> DataFrame:
    """The newest change of every memory that is no archive, as the output of a resolver; each third names a target that is gone."""
    v = b.versions(spark, d).where("action <> 'archive'")
    rest = [c for c in v.columns if c not in ("memory_space", "memory_id")]
    v = v.groupBy("memory_space", "memory_id").agg(F.max_by(F.struct(*rest), F.struct("version", "version_id")).alias("r")).select("memory_space", "memory_id", "r.*")
    lost = F.conv(F.right("version_id", F.lit(2)), 16, 10).cast("int") % 3 == 0
    return v.select(
        "memory_space", F.lit("ent_new").alias("entity_key"), F.col("version_id").alias("candidate_id"), "action",
        F.when(lost, F.concat(F.lit("gone_"), "memory_id")).otherwise(F.col("memory_id")).alias("target_id"), F.concat(F.lit("new_"), "version_id").alias("new_id"),
        "title", "summary", "content", "confidence", "salience", F.col("trigger_observation_id").alias("observation_id"), F.to_json(F.struct(F.col("version_id").alias("candidate_id"))).alias("metadata"),
    )


_OUT = """newest AS (SELECT *, row_number() OVER (PARTITION BY memory_space, memory_id ORDER BY version DESC, version_id DESC) AS n FROM v_ WHERE action <> 'archive'),
outs AS (SELECT *, CASE WHEN CAST('0x' || right(version_id, 2) AS INT) % 3 = 0 THEN 'gone_' || memory_id ELSE memory_id END AS target_id FROM newest WHERE n = 1),
acts AS (SELECT o.*, m.memory_id AS target, CASE WHEN action IN ('refresh', 'replace', 'stale') AND m.memory_id IS NULL THEN 'create' ELSE action END AS effect
  FROM outs o LEFT JOIN m_ m ON m.memory_space = o.memory_space AND m.memory_id = o.target_id)"""


@query(over("v_", "m_") + f", {_OUT} SELECT version_id AS candidate_id, target, effect FROM acts")
def v_effective_actions(spark: SparkSession, d: str) -> DataFrame:
    return w.effective_actions(outputs(spark, d), b.memories(spark, d)).select("candidate_id", "target", "effect")


_FOLD = "replace(lower({}), 'ß', 'ss')"


def _refresh(c: str, label: str) -> str:
    old, new = f"trim(coalesce(m.{c}, ''), ' ')", f"trim(coalesce(a.{c}, ''), ' ')"
    a, z = (f"replace(lower({_norm(x)}), 'ß', 'ss')" for x in (old, new))
    return f"CASE WHEN a.effect = 'refresh' THEN CASE WHEN {old} = '' THEN {new} WHEN {new} = '' THEN {old} WHEN contains({z}, {a}) THEN {new} WHEN contains({a}, {z}) THEN {old} ELSE {old} || chr(10) || chr(10) || '{label}: ' || {new} END ELSE m.{c} END"


@query(
    over("v_", "m_")
    + f""", {_OUT}
SELECT m.memory_id, CASE WHEN a.effect = 'refresh' THEN coalesce(a.title, m.title) ELSE m.title END AS title, {_refresh("content", "Refresh detail")} AS content,
  CASE a.effect WHEN 'replace' THEN 'superseded' WHEN 'stale' THEN 'stale' ELSE m.status END AS status,
  CASE WHEN a.effect = 'replace' THEN 'new_' || a.version_id ELSE NULL END AS superseded_by, CASE WHEN a.effect IS NOT NULL THEN {NOW} ELSE m.updated_at END AS updated_at
FROM m_ m LEFT JOIN (SELECT * FROM acts WHERE effect IN ('refresh', 'replace', 'stale')) a ON a.memory_space = m.memory_space AND a.target = m.memory_id
UNION ALL SELECT 'new_' || version_id, title, content, 'active', NULL, {NOW} FROM acts WHERE effect IN ('create', 'coexist', 'replace')"""
)
def v_applied(spark: SparkSession, d: str) -> DataFrame:
    m = b.memories(spark, d)
    after = w.applied(m, w.effective_actions(outputs(spark, d), m), NOW)
    return after.select("memory_id", "title", "content", "status", F.get_json_object("metadata", "$.superseded_by").alias("superseded_by"), "updated_at")


@query(
    over("v_", "m_")
    + """, last AS (SELECT memory_space, memory_id, max(version) AS n FROM v_ GROUP BY 1, 2), s AS (SELECT memory_space, memory_id, version_id FROM v_ WHERE action = 'refresh')
SELECT version_id AS seq, n + row_number() OVER (PARTITION BY memory_space, memory_id ORDER BY version_id) AS version FROM s JOIN last USING (memory_space, memory_id)"""
)
def v_appended_versions(spark: SparkSession, d: str) -> DataFrame:
    v = b.versions(spark, d)
    return w.appended_versions(v, v.where("action = 'refresh'").select("memory_space", "memory_id", F.col("version_id").alias("seq"))).select("seq", "version")


_PROPOSED = f"""prop AS (SELECT e.memory_space, e.entity_key, e.identity_profile AS cur, e.metadata, d.* EXCLUDE (memory_space) FROM e_ e JOIN d_ d ON d.memory_space = e.memory_space AND lower({_norm("d.surface_forms[1]")}) = e.identity_profile.who),
fold AS (SELECT *, {_FOLD.format(_norm("cur.who"))} AS old, {_FOLD.format(_norm("who"))} AS new, list_transform(coalesce(surface_forms, []), lambda x: {_FOLD.format(_norm("x"))}) AS forms FROM prop),
judged AS (SELECT *, CASE WHEN coalesce(schema_version <> 2, true) THEN 'reject' WHEN old <> '' AND new <> '' AND old <> new AND NOT list_contains(forms, old) THEN 'needs_identity_review' ELSE 'safe' END AS risk FROM fold)"""


@query(
    over("e_", "d_")
    + f""", {_PROPOSED} SELECT entity_key, draft_id, risk, coalesce(CAST(metadata->>'$.profile_state.profile_revision' AS INT), 0) + CASE WHEN risk = 'safe' THEN 1 ELSE 0 END AS profile_revision FROM judged"""
)
def v_profile_gate(spark: SparkSession, d: str) -> DataFrame:
    from palimpsest.functions.text import normalize_text

    e = b.entities(spark, d).select("memory_space", "entity_key", "identity_profile", "metadata", F.col("identity_profile.who").alias("match"))
    p = b.drafts(spark, d).select("memory_space", "draft_id", F.lower(normalize_text(F.get("surface_forms", F.lit(0)))).alias("match"), F.struct("schema_version", "who", "surface_forms").alias("proposed"))
    both = e.join(p, ["memory_space", "match"]).withColumn("verdict", w.profile_risk(F.col("identity_profile"), F.col("proposed")))
    state = w.next_profile_state(F.col("metadata"), F.col("verdict"))
    return both.select("entity_key", "draft_id", F.col("verdict.risk").alias("risk"), state["profile_revision"].alias("profile_revision"))


def _merges(spark: SparkSession, d: str, *more: Column) -> DataFrame:
    ends = ["memory_space", clean_id("source_entity_key").alias("source"), clean_id("target_entity_key").alias("target")]
    return table(spark, d, "merge_logs").select(*ends, *more).dropna(subset=["memory_space", "source", "target"])


_TO = f"""l AS (SELECT memory_space, {ident("source_entity_key")} AS s, {ident("target_entity_key")} AS t FROM merge_logs),
to_ AS (SELECT memory_space, s AS entity_key, min(t) AS target FROM l WHERE s IS NOT NULL AND t IS NOT NULL AND s <> t GROUP BY 1, 2)"""


@query(
    over("e_")
    + f""", {_TO}, p AS (SELECT DISTINCT t.memory_space, least(t.entity_key, t.target) AS a, greatest(t.entity_key, t.target) AS b, x.identity_profile AS own, y.identity_profile AS theirs
  FROM to_ t JOIN e_ x ON x.memory_space = t.memory_space AND x.entity_key = t.entity_key JOIN e_ y ON y.memory_space = t.memory_space AND y.entity_key = t.target)
SELECT DISTINCT memory_space, a AS entity_a, b AS entity_b FROM p WHERE theirs.schema_version = 2 AND NOT ({_norm("own.who")} <> '' AND {_norm("theirs.who")} <> '' AND {_FOLD.format(_norm("own.who"))} <> {_FOLD.format(_norm("theirs.who"))}
  AND NOT list_contains(list_transform(coalesce(theirs.surface_forms, []), lambda x: {_FOLD.format(_norm("x"))}), {_FOLD.format(_norm("own.who"))}))"""
)
def v_merge_candidates(spark: SparkSession, d: str) -> DataFrame:
    to = _merges(spark, d).where("source <> target").groupBy("memory_space", F.col("source").alias("entity_key")).agg(F.min("target").alias("candidate_key"))
    return w.merge_candidates(to, b.entities(spark, d)).drop("dedupe_key")


@query(
    over("m_", "v_")
    + f""", c AS (SELECT DISTINCT memory_space, memory_id FROM v_ WHERE action = 'stale') SELECT memory_id, CASE WHEN c.memory_id IS NOT NULL THEN 'archived' ELSE status END AS status,
  CASE WHEN c.memory_id IS NOT NULL AND status IS DISTINCT FROM 'archived' THEN {NOW} ELSE updated_at END AS updated_at FROM m_ LEFT JOIN c USING (memory_space, memory_id)"""
)
def v_archived(spark: SparkSession, d: str) -> DataFrame:
    return w.archived(b.memories(spark, d), b.versions(spark, d).where("action = 'stale'"), NOW)[0].select("memory_id", "status", "updated_at")


@query(
    over("m_", "v_")
    + f", c AS (SELECT DISTINCT memory_space, memory_id FROM v_ WHERE action = 'stale') SELECT memory_id, CAST({NOW + 30 * 86400} AS DOUBLE) AS available_at FROM m_ SEMI JOIN c USING (memory_space, memory_id) WHERE status IS DISTINCT FROM 'archived'"
)
def v_forgotten(spark: SparkSession, d: str) -> DataFrame:
    gone = w.archived(b.memories(spark, d), b.versions(spark, d).where("action = 'stale'"), NOW)[1]
    return w.purge_tasks(gone, NOW, 30 * w.DAY).select("memory_id", "available_at")


@query(
    over("m_", "v_", "g_")
    + """, x AS (SELECT memory_space, memory_id FROM m_ WHERE status = 'archived')
SELECT 'memories' AS "table", (SELECT count(*) FROM m_ ANTI JOIN x USING (memory_space, memory_id)) AS n_rows
UNION ALL SELECT 'versions', (SELECT count(*) FROM v_ ANTI JOIN x USING (memory_space, memory_id))
UNION ALL SELECT 'edges', (SELECT count(*) FROM g_ g WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.memory_space = g.memory_space AND (x.memory_id = from_id OR (to_kind = 'memory' AND x.memory_id = to_id))))"""
)
def v_purged(spark: SparkSession, d: str) -> DataFrame:
    m = b.memories(spark, d)
    left = w.purged(m.where("status = 'archived'"), m, b.versions(spark, d), b.edges(spark, d))
    return stats.table_counts(dict(zip(("memories", "versions", "edges"), left, strict=True)))


@query(
    over("m_", "v_", "g_", "e_")
    + """, x AS (SELECT memory_space, memory_id FROM m_ WHERE status = 'archived')
SELECT 'memory' AS kind, memory_space, memory_id AS id FROM m_ ANTI JOIN x USING (memory_space, memory_id) UNION ALL SELECT 'version', memory_space, version_id FROM v_ ANTI JOIN x USING (memory_space, memory_id)
UNION ALL SELECT 'edge', memory_space, edge_id FROM g_ g WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.memory_space = g.memory_space AND (x.memory_id = from_id OR (to_kind = 'memory' AND x.memory_id = to_id)))
UNION ALL SELECT 'document', memory_space, 'memory:' || memory_space || ':' || memory_id FROM m_ ANTI JOIN x USING (memory_space, memory_id) UNION ALL SELECT 'document', memory_space, 'entity:' || memory_space || ':' || entity_key FROM e_"""
)
def v_purged_rows(spark: SparkSession, d: str) -> DataFrame:
    """What is left of every table, and of the index, after the archived memories were purged."""
    m = b.memories(spark, d)
    gone = m.where("status = 'archived'")
    left = w.purged(gone, m, b.versions(spark, d), b.edges(spark, d))
    index = retrieval.projections(m, b.entities(spark, d))
    index = index.join(gone.select(text.ref_doc("memory", F.col("memory_space"), F.col("memory_id")).alias("ref_doc")), "ref_doc", "left_anti")
    part = lambda df, kind, i: df.select(F.lit(kind).alias("kind"), "memory_space", F.col(i).alias("id"))
    return part(left[0], "memory", "memory_id").unionByName(part(left[1], "version", "version_id")).unionByName(part(left[2], "edge", "edge_id")).unionByName(part(index, "document", "ref_doc"))
