"""Queries of whole flows: entity resolution, batches, profile refreshes, merges, recall beyond the stored graph."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.functions.ids import clean_id
from palimpsest.operators import flows, retrieval
from palimpsest.operators import writepath as w
from palimpsest.plans import graph_queries, repair
from palimpsest.plans.recall_queries import _BM25, _IDENTITY, _VECTORS, _tokens
from palimpsest.plans.views import ident, over
from palimpsest.plans.write_queries import _FOLD, _norm
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


# --- entity resolution -----------------------------------------------------------------------------------------------------


def rule_linker(asked: list[str]) -> list[str]:
    """A stand-in for a model: the first candidate of the same name, folded as the engine folds; else none."""
    out = []
    for payload in map(json.loads, asked):
        who = " ".join((payload["draft"].get("who") or "").lower().split())
        same = [c["entity_key"] for c in payload["candidates"] if who and (c["identity_profile"].get("who") or "") == who]
        out.append(json.dumps({"decision": "link_existing" if same else "create_new", "selected_entity_key": same[0] if same else None, "ambiguous_entity_keys": []}))
    return out


def _requests(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Drafts with their observation as the request, and candidate memories: each change that an observation triggered belongs to the
    drafts of the observation with an even number."""
    drafts = b.drafts(spark, d).withColumn("request", clean_id("observation_id")).where("request IS NOT NULL AND memory_space IS NOT NULL")
    drafts = drafts.select("memory_space", "request", "draft_id", "who", "surface_forms", "stable_qualifiers")
    even = drafts.where(F.conv(F.right("draft_id", F.lit(1)), 16, 10).cast("int") % 2 == 0)
    changes = b.versions(spark, d).select("memory_space", F.col("trigger_observation_id").alias("request")).distinct()
    return drafts, even.join(changes, ["memory_space", "request"]).select("memory_space", "request", F.col("draft_id").alias("owner_draft_id"))


def _items(c: str) -> str:
    return f"list_sort(list_distinct(list_filter(list_transform(coalesce({c}, []), lambda x: lower({_norm('x')})), lambda x: x <> '')))"


def _identity_hash(who: str, forms: str, qualifiers: str) -> str:
    return f"sha256(CAST(to_json(struct_pack(who := {_FOLD.format(_norm(who))}, s := {_items(forms)}, q := {_items(qualifiers)})) AS VARCHAR))"


_RESOLVING = f"""drafts AS (SELECT d_.* REPLACE ({ident("observation_id")} AS observation_id) FROM d_),
kept AS (SELECT memory_space, observation_id AS request, draft_id, who, {_identity_hash("who", "surface_forms", "stable_qualifiers")} AS identity FROM drafts d
  WHERE observation_id IS NOT NULL AND memory_space IS NOT NULL AND CAST('0x' || right(draft_id, 1) AS INT) % 2 = 0 AND EXISTS (SELECT 1 FROM v_ v WHERE v.memory_space = d.memory_space AND v.trigger_observation_id = d.observation_id)),
firsts AS (SELECT *, min(draft_id) OVER (PARTITION BY memory_space, request, identity) AS first_draft FROM kept),
asked AS (SELECT draft_id AS query_id, memory_space AS grp, who AS text FROM firsts WHERE draft_id = first_draft),
words AS (SELECT memory_space AS grp, entity_key AS doc_id, {_tokens(_IDENTITY)} AS w FROM (SELECT *, identity_profile AS p FROM e_)),
q AS (SELECT query_id, grp, unnest({_tokens("text")}) AS token FROM asked), """


@query(
    over("e_", "d_", "v_")
    + ", "
    + _RESOLVING
    + _VECTORS
    + """, fused AS (SELECT query_id, doc_id, round(1 / (50 + rank)::DOUBLE, 12) AS score FROM dense),
hits AS (SELECT * FROM (SELECT query_id, a.grp, entity_key, e_.identity_profile.who AS who, text, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, updated_at DESC NULLS LAST, entity_key) AS rank
  FROM fused JOIN asked a USING (query_id) JOIN e_ ON e_.memory_space = a.grp AND e_.entity_key = doc_id WHERE score >= 0.01) WHERE rank <= 10),
linked AS (SELECT query_id, arg_min(entity_key, rank) AS entity_key FROM hits WHERE who = lower(""" + _norm("text") + """) AND who <> '' GROUP BY 1)
SELECT f.draft_id, CASE WHEN l.entity_key IS NOT NULL THEN 'link_existing' ELSE 'create_new' END AS decision,
  coalesce(l.entity_key, 'ent_' || substr(sha256(concat_ws(chr(31), f.memory_space, f.identity)), 1, 32)) AS entity_key FROM firsts f LEFT JOIN linked l ON l.query_id = f.first_draft"""
)
def v_entity_resolution(spark: SparkSession, d: str) -> DataFrame:
    drafts, candidates = _requests(spark, d)
    e = b.entities(spark, d)
    docs = e.select(F.col("memory_space").alias("grp"), F.col("entity_key").alias("doc_id"), text.identity_text(F.col("identity_profile")).alias("text"))

    def scored(asked: DataFrame) -> DataFrame:
        fused = retrieval.rrf([retrieval.dense(retrieval.hashed_vectors(asked), retrieval.hashed_vectors(docs))])
        fused = fused.join(asked.select("query_id", F.col("grp").alias("memory_space")), "query_id").withColumnRenamed("doc_id", "entity_key")
        return retrieval.entity_candidates(fused, e)

    return flows.entity_resolution(drafts, candidates, e, b.memories(spark, d), scored, rule_linker).select("draft_id", "decision", "entity_key")


@query(
    over("d_", "e_")
    + f""", k AS (SELECT memory_space, {_identity_hash("p.who", "p.surface_forms", "p.stable_qualifiers")} AS identity, min(entity_key) AS known FROM (SELECT *, identity_profile AS p FROM e_) GROUP BY 1, 2),
i AS (SELECT memory_space, draft_id, {_identity_hash("who", "surface_forms", "stable_qualifiers")} AS identity FROM d_)
SELECT i.memory_space, draft_id, coalesce(known, 'ent_' || substr(sha256(concat_ws(chr(31), i.memory_space, i.identity)), 1, 32)) AS entity_key, known IS NULL AS is_new FROM i LEFT JOIN k ON k.memory_space = i.memory_space AND k.identity = i.identity"""
)
def v_resolved_identities(spark: SparkSession, d: str) -> DataFrame:
    return w.resolved_identities(b.drafts(spark, d), b.entities(spark, d))


# --- batches ---------------------------------------------------------------------------------------------------------------


def _batch(spark: SparkSession, d: str) -> DataFrame:
    """Every memory as an entity whose versions were put out as one batch, each about the one before."""
    v = b.versions(spark, d).where("memory_id IS NOT NULL AND memory_space IS NOT NULL")
    before = F.lag("version_id").over(Window.partitionBy("memory_space", "memory_id").orderBy(F.asc_nulls_first("version"), "version_id"))
    return v.select("memory_space", F.col("memory_id").alias("entity_key"), F.col("version_id").alias("candidate_id"), "action", before.alias("target_id"))


_BATCH = "ba AS (SELECT memory_space, memory_id, version_id, action, version, lag(version_id) OVER o AS target FROM v_ WHERE memory_id IS NOT NULL AND memory_space IS NOT NULL WINDOW o AS (PARTITION BY memory_space, memory_id ORDER BY version NULLS FIRST, version_id))"


@query(
    over("v_")
    + f""", {_BATCH}, runs AS (SELECT *, sum(CASE WHEN action IN ('refresh', 'replace', 'stale') AND target IS NOT NULL THEN 0 ELSE 1 END) OVER (PARTITION BY memory_space, memory_id ORDER BY version NULLS FIRST, version_id ROWS UNBOUNDED PRECEDING) AS run FROM ba)
SELECT version_id AS candidate_id, action, row_number() OVER (PARTITION BY memory_space, memory_id, run ORDER BY version NULLS FIRST, version_id) AS round FROM runs"""
)
def v_batch_order(spark: SparkSession, d: str) -> DataFrame:
    nothing = b.memories(spark, d).where("memory_space IS NULL")
    return w.batch_order(_batch(spark, d), nothing).select("candidate_id", "action", "round")


@query(
    over("v_", "m_")
    + """, o AS (SELECT m.memory_space, m.entity_key, action, CASE WHEN action NOT IN ('create', 'coexist') THEN v.memory_id END AS target FROM v_ v JOIN m_ m ON m.memory_space = v.memory_space AND m.memory_id = v.memory_id WHERE version <= 1)
SELECT memory_space, entity_key FROM o WHERE NOT EXISTS (SELECT 1 FROM m_ WHERE m_.memory_space = o.memory_space AND m_.entity_key = o.entity_key AND status = 'archived')
GROUP BY 1, 2 HAVING count(*) > 1 AND bool_and(coalesce(action IN ('create', 'coexist'), false) AND coalesce(trim(target), '') = '')"""
)
def v_batch_retry(spark: SparkSession, d: str) -> DataFrame:
    """The first versions of every entity's memories as its batch; an entity with an archived memory existed before."""
    v = b.versions(spark, d).where("version <= 1").select("memory_space", "memory_id", F.coalesce("action", F.lit("")).alias("action"))
    m = b.memories(spark, d).select("memory_space", "memory_id", "entity_key", "status")
    outputs = v.join(m, ["memory_space", "memory_id"]).withColumn("target_id", F.when(~F.col("action").isin("create", "coexist"), F.col("memory_id")))
    return w.needs_batch_retry(outputs, m.where("status = 'archived'").select("memory_space", "entity_key").distinct())


# --- profiles --------------------------------------------------------------------------------------------------------------


def rule_writer(asked: list[str]) -> list[str]:
    """A stand-in for a model: the entity under its display name, defined by its newest summary; an entity without summaries gets an
    answer of an old schema, one with four a name that nothing supports."""
    out = []
    for payload in map(json.loads, asked):
        told, now = payload["recent_memory_summaries"], payload.get("current_identity_profile") or {}
        who = "someone else" if len(told) == 4 else payload.get("current_display_name") or ""
        profile = {"schema_version": 2 if told else 1, "who": who, "surface_forms": [f for f in now.get("surface_forms") or [] if f], "stable_qualifiers": [q for q in now.get("stable_qualifiers") or [] if q]}
        out.append(json.dumps(profile | {"definition": told[0] if told else ""}))
    return out


def _first_items(c: str, n: int) -> str:
    """Items in order without blank and repeated ones, in lower case; for arrays in a struct."""
    clean = f"list_filter(list_transform(coalesce({c}, []), lambda x: lower({_norm('x')})), lambda x: x <> '')"
    return f"list_filter({clean}, lambda x, i: list_position({clean}, x) = i)[:{n}]"


_SUMMARIES = """recent AS (SELECT * FROM (SELECT memory_space, entity_key, coalesce(summary, '') AS summary, row_number() OVER (PARTITION BY memory_space, entity_key ORDER BY updated_at DESC NULLS LAST, memory_id) AS n FROM m_ WHERE status = 'active') WHERE n <= 4),
told AS (SELECT memory_space, entity_key, list(summary ORDER BY n) AS s FROM recent GROUP BY 1, 2)"""
_WRITTEN = f"""wr AS (SELECT e.*, identity_profile AS p, s, CASE WHEN len(s) = 4 THEN 'someone else' ELSE lower({_norm("display_name")}) END AS new_who, {_first_items("identity_profile.surface_forms", 3)} AS new_forms
  FROM e_ e LEFT JOIN told USING (memory_space, entity_key)),
gate AS (SELECT *, CASE WHEN coalesce(len(s), 0) = 0 THEN 'reject' WHEN {_FOLD.format(_norm("p.who"))} <> '' AND {_FOLD.format("new_who")} <> '' AND {_FOLD.format(_norm("p.who"))} <> {_FOLD.format("new_who")}
  AND NOT list_contains(list_transform(new_forms, lambda x: {_FOLD.format("x")}), {_FOLD.format(_norm("p.who"))}) THEN 'needs_identity_review' ELSE 'safe' END AS risk FROM wr)"""


@query(
    over("e_", "m_")
    + f""", {_SUMMARIES}, {_WRITTEN}
SELECT entity_key, CASE WHEN risk = 'safe' THEN 'applied' ELSE risk END AS refresh_status, CASE WHEN risk = 'safe' THEN coalesce(nullif(new_who, ''), display_name) ELSE coalesce(nullif(p.who, ''), display_name) END AS display_name,
  CASE WHEN risk = 'safe' THEN lower({_norm("s[1]")}) ELSE p.definition END AS definition, coalesce(CAST(metadata->>'$.profile_state.profile_revision' AS INT), 0) + CASE WHEN risk = 'safe' THEN 1 ELSE 0 END AS revision,
  least(coalesce(json_array_length(metadata, '$.profile_history'), 0) + 1, 10) AS n_history FROM gate"""
)
def v_profile_refresh(spark: SparkSession, d: str) -> DataFrame:
    out = flows.refreshed_profiles(b.entities(spark, d), b.memories(spark, d), rule_writer, "refresh", NOW)
    get = lambda path: F.get_json_object("metadata", path)
    history = F.size(F.from_json(get("$.profile_history"), "array<variant>"))
    return out.select("entity_key", "refresh_status", "display_name", F.col("identity_profile.definition").alias("definition"), get("$.profile_state.profile_revision").cast("int").alias("revision"), history.alias("n_history"))


# --- merges ----------------------------------------------------------------------------------------------------------------


def _merges(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "merge_logs").select("memory_space", clean_id("source_entity_key").alias("source"), clean_id("target_entity_key").alias("target"), F.col("created_at").alias("at"), "reason")
    return rows.dropna(subset=["memory_space", "source", "target"])


def rule_judge(asked: list[str]) -> list[str]:
    """A stand-in for a model: two entities are one unless one has no name; the smaller key survives, under the target's name with both
    names as forms. Without summaries on either side no profile is proposed."""
    out = []
    for payload in map(json.loads, asked):
        source, target = payload["source_entity"], payload["target_entity"]
        names = [(e.get("identity_profile") or {}).get("who") or "" for e in (target, source)]
        answer = {"decision": "merge" if all(names) else "keep_separate", "survivor_entity_key": min(source["entity_key"], target["entity_key"]), "reason": ""}
        if source.get("active_memory_summaries") or target.get("active_memory_summaries"):
            answer["merged_identity_profile"] = {"who": names[0], "surface_forms": names, "stable_qualifiers": [], "definition": ""}
        out.append(json.dumps(answer))
    return out


_LOG = f"""l AS (SELECT memory_space, {ident("source_entity_key")} AS s, {ident("target_entity_key")} AS t, created_at AS ts FROM merge_logs)"""


def survivors_sql(pairs: str) -> str:
    """``to_`` and ``ends``: (memory_space, entity_key, survivor) of the pairs (memory_space, s, t, at), by reachability."""
    return f"""to_ AS (SELECT memory_space, s, arg_min(t, struct_pack(late := ts IS NULL, a := ts, t := t)) AS t FROM {pairs} WHERE s IS NOT NULL AND t IS NOT NULL AND memory_space IS NOT NULL AND s <> t GROUP BY 1, 2),
reach AS (SELECT memory_space, s, t FROM to_ UNION SELECT r.memory_space, r.s, n.t FROM reach r JOIN to_ n ON n.memory_space = r.memory_space AND n.s = r.t),
last AS (SELECT r.memory_space, r.s, min(r.t) AS survivor FROM reach r WHERE NOT EXISTS (SELECT 1 FROM to_ n WHERE n.memory_space = r.memory_space AND n.s = r.t) OR EXISTS (SELECT 1 FROM reach c WHERE c.memory_space = r.memory_space AND c.s = r.t AND c.t = r.t) GROUP BY 1, 2),
ends AS (SELECT memory_space, s AS entity_key, survivor FROM last WHERE s <> survivor)"""


@query(over("m_", "e_", recursive=True) + f", {_LOG}, {survivors_sql('l')} SELECT memory_id AS id, coalesce(survivor, entity_key) AS entity_key FROM m_ LEFT JOIN ends USING (memory_space, entity_key) UNION ALL SELECT 'entity', entity_key FROM e_ ANTI JOIN ends USING (memory_space, entity_key)")
def v_merged_entities(spark: SparkSession, d: str) -> DataFrame:
    """Memories and entities after the whole merge log, in the order of its times; chains are followed to their end."""
    memories, entities = w.merged_entities(b.memories(spark, d), b.entities(spark, d), _merges(spark, d))
    return memories.select(F.col("memory_id").alias("id"), "entity_key").unionByName(entities.select(F.lit("entity").alias("id"), "entity_key"))


@query(over("e_", recursive=True) + f", {_LOG}, {survivors_sql('l')} SELECT memory_space, entity_key, survivor FROM ends")
def v_surviving_entities(spark: SparkSession, d: str) -> DataFrame:
    """The last survivor of every entity that was merged."""
    return w.survivors(_merges(spark, d)).select("memory_space", "entity_key", "survivor")


@query(
    over("e_", "m_", recursive=True)
    + f""", {_LOG}, ok AS (SELECT DISTINCT l.memory_space, greatest(s, t) AS s, least(s, t) AS t, ts, s AS src, t AS tgt, x.identity_profile.who AS s_who, y.identity_profile.who AS t_who,
  EXISTS (SELECT 1 FROM m_ WHERE m_.memory_space = l.memory_space AND m_.entity_key IN (l.s, l.t) AND status = 'active') AS told
  FROM l JOIN e_ x ON x.memory_space = l.memory_space AND x.entity_key = s JOIN e_ y ON y.memory_space = l.memory_space AND y.entity_key = t WHERE s <> t AND coalesce(x.identity_profile.who, '') <> '' AND coalesce(y.identity_profile.who, '') <> ''),
{survivors_sql("ok")},
step AS (SELECT ok.memory_space, survivor AS entity_key, struct_pack(a := ts, s := src, t := tgt) AS o, CASE WHEN told THEN t_who END AS new_who, s_who FROM ok JOIN ends ON ends.memory_space = ok.memory_space AND ends.entity_key = ok.s),
newest AS (SELECT memory_space, entity_key, arg_max(struct_pack(w := new_who, s := s_who), o) AS n FROM step GROUP BY 1, 2),
g AS (SELECT e.*, identity_profile AS p, n.w AS new_who, list_transform([n.w, n.s], lambda x: {_FOLD.format(_norm("x"))}) AS forms, newest.entity_key IS NOT NULL AS grew FROM e_ e ANTI JOIN ends USING (memory_space, entity_key) LEFT JOIN newest USING (memory_space, entity_key)),
r AS (SELECT *, CASE WHEN NOT grew THEN NULL WHEN new_who IS NULL OR {_norm("new_who")} = '' THEN 'needs_identity_review' WHEN {_FOLD.format(_norm("p.who"))} <> '' AND {_FOLD.format(_norm("p.who"))} <> {_FOLD.format(_norm("new_who"))} AND NOT list_contains(forms, {_FOLD.format(_norm("p.who"))})
  THEN 'needs_identity_review' ELSE 'applied' END AS status FROM g)
SELECT 'entity' AS kind, entity_key AS id, CASE WHEN status = 'applied' THEN lower({_norm("new_who")}) WHEN grew THEN coalesce(nullif(p.who, ''), display_name) ELSE display_name END AS value, status FROM r
UNION ALL SELECT 'memory', memory_id, coalesce(survivor, entity_key), NULL FROM m_ LEFT JOIN ends USING (memory_space, entity_key)
UNION ALL SELECT 'log', s, t, NULL FROM (SELECT DISTINCT memory_space, s, t, src, ts FROM ok)
UNION ALL SELECT DISTINCT 'task', 'repair_memory_edges:' || survivor, '11', NULL FROM (SELECT DISTINCT memory_space, survivor FROM ends)
UNION ALL SELECT 'document', 'entity:' || memory_space || ':' || entity_key, NULL, NULL FROM ends"""
)
def v_applied_merges(spark: SparkSession, d: str) -> DataFrame:
    merges = _merges(spark, d).drop("reason").withColumn("reason", F.lit("log"))
    out = flows.applied_merges(merges, b.entities(spark, d), b.memories(spark, d), rule_judge, "merge", NOW)
    none = F.lit(None).cast("string")
    before = b.entities(spark, d).select("memory_space", "entity_key", F.get_json_object("metadata", "$.profile_history").alias("old"))
    state = F.get_json_object("metadata", "$.profile_state.last_refresh_status")
    e = out["entities"].join(before, ["memory_space", "entity_key"])
    e = e.select(F.lit("entity").alias("kind"), F.col("entity_key").alias("id"), F.col("display_name").alias("value"), F.when(F.col("updated_at") == NOW, state).alias("status"))
    part = lambda df, kind, i, value: df.select(F.lit(kind).alias("kind"), i.alias("id"), value.cast("string").alias("value"), none.alias("status"))
    return (
        e.unionByName(part(out["memories"], "memory", F.col("memory_id"), F.col("entity_key")))
        .unionByName(part(out["log"], "log", F.col("source"), F.col("target")))
        .unionByName(part(out["tasks"], "task", F.col("dedupe_key"), F.col("priority")))
        .unionByName(part(out["documents"], "document", F.col("ref_doc"), none))
    )


@query(
    over("e_")
    + f""", asked AS (SELECT memory_space || '|' || entity_key AS query_id, memory_space AS grp, {_IDENTITY} AS text FROM (SELECT *, identity_profile AS p FROM e_)),
words AS (SELECT memory_space AS grp, entity_key AS doc_id, {_tokens(_IDENTITY)} AS w FROM (SELECT *, identity_profile AS p FROM e_)),
q AS (SELECT query_id, grp, unnest({_tokens("text")}) AS token FROM asked), """
    + _VECTORS
    + f""", hits AS (SELECT a.memory_space, a.entity_key, e.entity_key AS other, a.identity_profile AS own, e.identity_profile AS theirs, row_number() OVER (PARTITION BY query_id ORDER BY round(1 / (50 + rank)::DOUBLE, 12) DESC, e.updated_at DESC NULLS LAST, e.entity_key) AS n
  FROM dense JOIN e_ a ON a.memory_space || '|' || a.entity_key = query_id JOIN e_ e ON e.memory_space = a.memory_space AND e.entity_key = doc_id WHERE round(1 / (50 + rank)::DOUBLE, 12) >= 0.01)
SELECT DISTINCT memory_space, least(entity_key, other) AS entity_a, greatest(entity_key, other) AS entity_b FROM hits WHERE n <= 8 AND entity_key <> other AND theirs.schema_version = 2 AND NOT ({_norm("own.who")} <> '' AND {_norm("theirs.who")} <> ''
  AND {_FOLD.format(_norm("own.who"))} <> {_FOLD.format(_norm("theirs.who"))} AND NOT list_contains(list_transform(coalesce(theirs.surface_forms, []), lambda x: {_FOLD.format(_norm("x"))}), {_FOLD.format(_norm("own.who"))}))"""
)
def v_detected_merges(spark: SparkSession, d: str) -> DataFrame:
    """Merge tasks from the eight best candidates of every entity of a space."""
    e = b.entities(spark, d)
    docs = e.select(F.col("memory_space").alias("grp"), F.col("entity_key").alias("doc_id"), text.identity_text(F.col("identity_profile")).alias("text"))
    asked = docs.select(F.concat_ws("|", "grp", "doc_id").alias("query_id"), "grp", "text")
    fused = retrieval.rrf([retrieval.dense(retrieval.hashed_vectors(asked), retrieval.hashed_vectors(docs))])
    own = e.select(F.concat_ws("|", "memory_space", "entity_key").alias("query_id"), "memory_space", F.col("entity_key").alias("own_key"))
    best = retrieval.entity_candidates(fused.join(own.select("query_id", "memory_space"), "query_id").withColumnRenamed("doc_id", "entity_key"), e, 8)
    pairs = best.join(own, "query_id").select("memory_space", F.col("own_key").alias("entity_key"), F.col("entity_key").alias("candidate_key"))
    return w.merge_candidates(pairs, e).drop("dedupe_key")


# --- recall beyond the stored graph ----------------------------------------------------------------------------------------


def _held(spark: SparkSession, d: str) -> DataFrame:
    """What the requests of the entities whose number is divisible by 20 hold: their three newest memories."""
    seeds = graph_queries.seeds(spark, d)
    return seeds.where(F.conv(F.right("anchor", F.lit(4)), 16, 10).cast("int") % 20 == 0).select("request", "memory_space", "memory_id")


_HELD = """held AS (SELECT memory_space || '|' || entity_key AS request, memory_space, memory_id FROM (SELECT *, row_number() OVER (PARTITION BY memory_space, entity_key ORDER BY updated_at DESC NULLS LAST, memory_id) AS n FROM m_ WHERE status <> 'archived')
  WHERE n <= 3 AND CAST('0x' || right(entity_key, 4) AS INT) % 20 = 0)"""
_BODY = "coalesce(nullif(trim({0}.summary, ' '), ''), {0}.content)"


@query(
    over("m_", "g_", "o_")
    + f""", {_HELD}, t AS (SELECT request, held.memory_space, 1 AS source, memory_id AS ord, {_norm(_BODY.format("m"))} AS text FROM held JOIN m_ m USING (memory_space, memory_id)
UNION ALL SELECT DISTINCT request, h.memory_space, 2, o.observation_id, {_norm(_BODY.format("o"))} FROM held h JOIN g_ g ON g.memory_space = h.memory_space AND g.from_id = h.memory_id AND edge_type = 'derived_from' AND to_kind = 'observation'
  JOIN o_ o ON o.memory_space = h.memory_space AND o.observation_id = g.to_id),
f AS (SELECT request, lower(text) AS folded, min(struct_pack(s := source, a := ord, t := text)) AS f FROM t WHERE text <> '' GROUP BY 1, 2)
SELECT request, position, f.t AS text FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY f.s, f.a, folded) AS position FROM f) WHERE position <= 8"""
)
def g_dynamic_texts(spark: SparkSession, d: str) -> DataFrame:
    return flows.dynamic_texts(_held(spark, d), b.memories(spark, d), b.edges(spark, d), b.observations(spark, d)).select("request", "position", "text")


_SKIPPED = _VECTORS.replace("HAVING sum(x * x) > 0) nd ON nd.id = doc_id)", "HAVING sum(x * x) > 0) nd ON nd.id = doc_id) s").replace("WHERE score >= 0.12)", "WHERE score >= 0.12 AND NOT EXISTS (SELECT 1 FROM held WHERE held.request = s.query_id AND held.memory_id = s.doc_id))")


@query(
    over("m_", "g_", "o_", "e_")
    + f""", {_HELD}, t AS (SELECT request, held.memory_space, 1 AS source, memory_id AS ord, {_norm(_BODY.format("m"))} AS text FROM held JOIN m_ m USING (memory_space, memory_id)
UNION ALL SELECT DISTINCT request, h.memory_space, 2, o.observation_id, {_norm(_BODY.format("o"))} FROM held h JOIN g_ g ON g.memory_space = h.memory_space AND g.from_id = h.memory_id AND edge_type = 'derived_from' AND to_kind = 'observation'
  JOIN o_ o ON o.memory_space = h.memory_space AND o.observation_id = g.to_id),
f AS (SELECT request, memory_space, lower(text) AS folded, min(struct_pack(s := source, a := ord, t := text)) AS f FROM t WHERE text <> '' GROUP BY 1, 2, 3),
pt AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY f.s, f.a, folded) AS position FROM f),
asked AS (SELECT request AS query_id, memory_space AS grp, string_agg(f.t, chr(10) ORDER BY position) AS text FROM pt WHERE position <= 8 GROUP BY 1, 2),
i AS (SELECT memory_space, entity_key, {_IDENTITY} AS identity FROM (SELECT *, identity_profile AS p FROM e_)),
docs AS (SELECT m.memory_space AS grp, memory_id AS doc_id, array_to_string(list_filter([i.identity, title, summary, content], lambda x: trim(coalesce(x, ''), ' ') <> ''), chr(10)) AS text FROM m_ m LEFT JOIN i USING (memory_space, entity_key) WHERE status IN ('active', 'stale', 'superseded')),
words AS (SELECT grp, doc_id, {_tokens("text")} AS w FROM docs), q AS (SELECT query_id, grp, unnest({_tokens("text")}) AS token FROM asked),
"""
    + _BM25
    + ", "
    + _SKIPPED
    + """, lx AS (SELECT query_id, doc_id, score FROM bm25 WHERE score > 0 AND NOT EXISTS (SELECT 1 FROM held WHERE held.request = query_id AND held.memory_id = doc_id)),
lists AS (SELECT query_id, doc_id, rank FROM dense UNION ALL SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM lx) WHERE rank <= 24),
fused AS (SELECT query_id, doc_id, round(sum(1 / (50 + rank)::DOUBLE), 12) AS score FROM lists GROUP BY ALL),
cand AS (SELECT * FROM (SELECT query_id AS request, grp AS memory_space, m_.memory_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, status = 'active' DESC, salience DESC NULLS LAST, confidence DESC NULLS LAST, updated_at DESC NULLS LAST, m_.memory_id) AS rank
  FROM fused JOIN asked USING (query_id) JOIN m_ ON m_.memory_space = grp AND m_.memory_id = doc_id WHERE score >= 0.01) WHERE rank <= 14),
bt AS (SELECT grp, doc_id, w AS t FROM words),
jd AS (SELECT c.request, h.memory_id AS a, c.memory_id AS b, rank, round(CASE WHEN len(x.t) > 0 AND len(y.t) > 0 THEN coalesce(list_sum([least(len(list_filter(x.t, lambda v: v = z)), len(list_filter(y.t, lambda v: v = z))) for z in list_distinct(x.t)]), 0) / sqrt(len(x.t) * len(y.t)) ELSE 0 END, 6) AS weight
  FROM cand c JOIN held h ON h.request = c.request JOIN bt x ON x.grp = c.memory_space AND x.doc_id = h.memory_id JOIN bt y ON y.grp = c.memory_space AND y.doc_id = c.memory_id),
best AS (SELECT * FROM jd WHERE weight >= 0.2 QUALIFY row_number() OVER (PARTITION BY request, a ORDER BY weight DESC, rank, b) = 1),
new AS (SELECT request, b, row_number() OVER (PARTITION BY request ORDER BY min(rank), b) AS place FROM best GROUP BY 1, 2)
SELECT request, memory_id, 0 AS round, 0 AS place FROM held UNION ALL SELECT request, b, 1, place FROM new WHERE place <= 24 - (SELECT count(*) FROM held WHERE held.request = new.request)"""
)
def g_dynamic_step(spark: SparkSession, d: str) -> DataFrame:
    """The first of the two rounds of ``g_dynamic_recall``."""
    out, _ = flows.dynamic_recall(_held(spark, d), b.memories(spark, d), b.entities(spark, d), b.edges(spark, d), b.observations(spark, d), repair.rule_judge, rounds=1)
    return out.select("request", "memory_id", "round", "place")


@query()
def g_dynamic_recall(spark: SparkSession, d: str) -> DataFrame:
    """The requests of every entity whose number is divisible by 20, against all memories of its space."""
    out, _ = flows.dynamic_recall(_held(spark, d), b.memories(spark, d), b.entities(spark, d), b.edges(spark, d), b.observations(spark, d), repair.rule_judge)
    return out.select("request", "memory_id", "round", "place")
