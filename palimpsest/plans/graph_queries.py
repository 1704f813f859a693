"""Queries of the relation graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import graph, lookup
from palimpsest.plans.views import over
from palimpsest.sources import bindings as b

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_KEY = """CASE WHEN edge_type IN ('supports', 'contradicts', 'related_to') AND to_kind = 'memory' AND from_kind = 'memory' THEN least(from_id, to_id) ELSE from_id END AS a,
  CASE WHEN edge_type IN ('supports', 'contradicts', 'related_to') AND to_kind = 'memory' AND from_kind = 'memory' THEN greatest(from_id, to_id) ELSE to_id END AS b"""


def _turned(edges: DataFrame) -> DataFrame:
    """Proposals that are partly there: heavy relations the other way round, and all supports as contradictions."""
    heavy = edges.where("weight >= 0.5 AND to_kind = 'memory'")
    back = heavy.withColumns({"from_id": F.col("to_id"), "to_id": F.col("from_id"), "edge_id": F.concat(F.lit("t_"), "edge_id")})
    other = heavy.where("edge_type = 'supports'").withColumns({"edge_type": F.lit("contradicts"), "edge_id": F.concat(F.lit("c_"), "edge_id")})
    return back.unionByName(other)


@query(
    over("g_")
    + f""", heavy AS (SELECT * FROM g_ WHERE weight >= 0.5 AND to_kind = 'memory'),
p AS (SELECT *, {_KEY} FROM (SELECT * REPLACE (to_id AS from_id, from_id AS to_id, 't_' || edge_id AS edge_id) FROM heavy UNION ALL SELECT * REPLACE ('contradicts' AS edge_type, 'c_' || edge_id AS edge_id) FROM heavy WHERE edge_type = 'supports')),
n AS (SELECT *, row_number() OVER (PARTITION BY memory_space, edge_type, to_kind, a, b ORDER BY created_at, edge_id) AS nth FROM p), s AS (SELECT *, {_KEY} FROM g_)
SELECT edge_id, from_id, to_id, edge_type FROM n WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM s WHERE s.memory_space = n.memory_space AND s.edge_type = n.edge_type AND s.to_kind = n.to_kind AND s.a = n.a AND s.b = n.b)"""
)
def g_insertable(spark: SparkSession, d: str) -> DataFrame:
    e = b.edges(spark, d)
    return graph.insertable(e, _turned(e), ["created_at", "edge_id"]).select("edge_id", "from_id", "to_id", "edge_type")


@query(
    over("g_", "m_")
    + """, r AS (SELECT *, CASE WHEN edge_type IN ('contradicts', 'related_to') THEN least(from_id, to_id) ELSE from_id END AS f, CASE WHEN edge_type IN ('contradicts', 'related_to') THEN greatest(from_id, to_id) ELSE to_id END AS t FROM g_ g
  WHERE coalesce(weight, 0) >= 0.2 AND from_id <> to_id AND EXISTS (SELECT 1 FROM m_ WHERE m_.memory_space = g.memory_space AND memory_id = from_id) AND EXISTS (SELECT 1 FROM m_ WHERE m_.memory_space = g.memory_space AND memory_id = to_id)),
n AS (SELECT *, row_number() OVER (PARTITION BY memory_space, f, t, edge_type ORDER BY created_at, edge_id) AS nth FROM r)
SELECT edge_id, f AS from_id, t AS to_id, edge_type, weight FROM n WHERE nth = 1"""
)
def g_normalised(spark: SparkSession, d: str) -> DataFrame:
    out = graph.normalised(b.edges(spark, d), b.memories(spark, d), ["created_at", "edge_id"])
    return out.select("edge_id", "from_id", "to_id", "edge_type", "weight")


_FRONTIER = """live AS (SELECT *, max(status = 'active') OVER (PARTITION BY memory_space, entity_key) AS any_live FROM m_),
front AS (SELECT * FROM (SELECT memory_space, entity_key, memory_id, row_number() OVER (PARTITION BY memory_space, entity_key ORDER BY updated_at DESC NULLS LAST, memory_id) AS position FROM live WHERE NOT any_live OR status = 'active') WHERE position <= 8)"""


@query(over("m_") + f", {_FRONTIER} SELECT memory_space, entity_key, memory_id, position FROM front")
def g_frontiers(spark: SparkSession, d: str) -> DataFrame:
    return graph.frontiers(b.memories(spark, d))


@query(
    over("m_", "g_")
    + f""", {_FRONTIER}, fr AS (SELECT DISTINCT memory_space, memory_id FROM front),
o AS (SELECT g.*, CASE WHEN edge_type = 'related_to' THEN CASE WHEN a.memory_id IS NOT NULL THEN from_id WHEN z.memory_id IS NOT NULL THEN to_id END END AS owner FROM g_ g
  LEFT JOIN fr a ON a.memory_space = g.memory_space AND a.memory_id = from_id LEFT JOIN fr z ON z.memory_space = g.memory_space AND z.memory_id = to_id)
SELECT edge_id FROM o WHERE owner IS NULL UNION ALL
SELECT edge_id FROM (SELECT edge_id, row_number() OVER (PARTITION BY memory_space, owner ORDER BY coalesce(weight, 0) DESC, edge_id) AS n FROM o WHERE owner IS NOT NULL) WHERE n = 1"""
)
def g_sparsified(spark: SparkSession, d: str) -> DataFrame:
    return graph.sparsified(b.edges(spark, d), graph.frontiers(b.memories(spark, d))).select("edge_id")


@query(
    over("g_", recursive=True)
    + """, r AS (SELECT *, memory_space || chr(9) || from_id AS a, memory_space || chr(9) || to_id AS b FROM g_ WHERE edge_type = 'related_to'), l AS (SELECT a, b FROM r UNION SELECT b, a FROM r),
reach AS (SELECT a, a AS b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b), root AS (SELECT a, min(b) AS root FROM reach GROUP BY 1),
c AS (SELECT r.*, root, count(*) OVER (PARTITION BY root) AS n, max(coalesce(weight, 0)) OVER (PARTITION BY root) AS most FROM r JOIN root USING (a))
SELECT edge_id FROM c WHERE n <= 1 OR coalesce(weight, 0) >= most - 0.15::DOUBLE UNION ALL SELECT edge_id FROM g_ WHERE edge_type IS DISTINCT FROM 'related_to'"""
)
def g_pruned_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.pruned_components(b.edges(spark, d)).select("edge_id")


@query(
    over("g_", "m_")
    + """, k AS (SELECT memory_space, memory_id, len(list_filter(json_extract_string(metadata, '$.record_markers.*'), lambda x: trim(coalesce(x, ''), ' ') <> '')) > 0 AS has FROM m_)
SELECT edge_id FROM g_ g LEFT JOIN k a ON a.memory_space = g.memory_space AND a.memory_id = from_id LEFT JOIN k z ON z.memory_space = g.memory_space AND z.memory_id = to_id
WHERE edge_type <> 'contradicts' OR coalesce(a.has, false) = coalesce(z.has, false)"""
)
def g_historical_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return graph.without_historical_conflicts(b.edges(spark, d), b.memories(spark, d)).select("edge_id")


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return b.edges(spark, d).where("edge_type = 'supports' AND weight >= 0.8").withColumn("edge_id", F.concat(F.lit("j_"), "edge_id"))


@query(
    over("g_", "m_")
    + """, t AS (SELECT memory_space, memory_id FROM m_ WHERE status = 'stale')
SELECT edge_id FROM g_ g WHERE edge_type NOT IN ('supports', 'contradicts', 'related_to') OR NOT EXISTS (SELECT 1 FROM t WHERE t.memory_space = g.memory_space AND t.memory_id IN (from_id, to_id))
UNION ALL SELECT 'j_' || edge_id FROM g_ WHERE edge_type = 'supports' AND weight >= 0.8"""
)
def g_rebuilt_local(spark: SparkSession, d: str) -> DataFrame:
    return graph.rebuilt_local(b.edges(spark, d), b.memories(spark, d).where("status = 'stale'"), _judged(spark, d)).select("edge_id")


@query(
    over("g_", "m_")
    + """SELECT g.memory_space, edge_id, coalesce(a.entity_key <> z.entity_key, false) AS is_cross FROM g_ g LEFT JOIN m_ a ON a.memory_space = g.memory_space AND a.memory_id = from_id
LEFT JOIN m_ z ON z.memory_space = g.memory_space AND z.memory_id = to_id WHERE from_kind = 'memory' AND to_kind = 'memory'"""
)
def g_cross_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.local_share(b.edges(spark, d), b.memories(spark, d))


def seeds(spark: SparkSession, d: str) -> DataFrame:
    """The three newest memories of every entity that are not archived ask for what is around them; the intent follows the space."""
    recent = lookup.recent_per_key(b.memories(spark, d).where("status <> 'archived'"), ["memory_space", "entity_key"], "updated_at", "memory_id", 3)
    intent = F.when(F.col("memory_space").startswith("team:"), "history").when(F.col("memory_space").startswith("user:"), "latest").otherwise("uncertain")
    request = F.concat_ws("|", "memory_space", "entity_key")
    return recent.select(request.alias("request"), "memory_space", F.col("entity_key").alias("anchor"), intent.alias("time_intent"), "memory_id")


_SEEDS = """seeds AS (SELECT memory_space || '|' || entity_key AS request, memory_space, entity_key AS anchor, CASE WHEN memory_space LIKE 'team:%' THEN 'history' WHEN memory_space LIKE 'user:%' THEN 'latest' ELSE 'uncertain' END AS intent, memory_id
  FROM (SELECT *, row_number() OVER (PARTITION BY memory_space, entity_key ORDER BY updated_at DESC NULLS LAST, memory_id) AS n FROM m_ WHERE status <> 'archived') WHERE n <= 3),
ends AS (SELECT memory_space, from_id AS memory_id, to_id AS other, true AS outgoing, edge_id, edge_type, created_at FROM mm UNION ALL SELECT memory_space, to_id, from_id, false, edge_id, edge_type, created_at FROM mm)"""
_MM = "mm AS (SELECT * FROM g_ WHERE from_kind = 'memory' AND to_kind = 'memory' AND from_id <> to_id AND edge_type IN ('updates', 'supports', 'contradicts', 'related_to'))"


@query(
    over("m_", "g_")
    + f""", {_MM}, {_SEEDS},
met AS (SELECT * FROM (SELECT s.*, e.other, e.outgoing, e.edge_id, e.edge_type, e.created_at, row_number() OVER (PARTITION BY request, edge_id ORDER BY outgoing DESC) AS once FROM seeds s JOIN ends e ON e.memory_space = s.memory_space AND e.memory_id = s.memory_id) WHERE once = 1),
own AS (SELECT met.* FROM met LEFT JOIN m_ o ON o.memory_space = met.memory_space AND o.memory_id = met.other LEFT JOIN seeds k ON k.request = met.request AND k.memory_id = met.other
  WHERE NOT coalesce(o.entity_key <> met.anchor, false) AND (edge_type <> 'updates' OR met.intent = 'history' OR (met.intent = 'latest' AND NOT outgoing) OR (met.intent = 'uncertain' AND k.memory_id IS NULL))),
f AS (SELECT request, memory_space, edge_type, other, min(struct_pack(c := created_at, e := edge_id)) AS first FROM own GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY request, edge_type ORDER BY first) AS nth FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY list_position(['updates', 'supports', 'contradicts', 'related_to'], edge_type), nth) AS place FROM n WHERE nth <= CASE WHEN edge_type IN ('updates', 'supports') THEN 8 ELSE 6 END)
SELECT request, memory_id, 0 AS hop FROM seeds UNION ALL SELECT DISTINCT request, other, 1 FROM p WHERE place <= 24 - (SELECT count(*) FROM seeds s WHERE s.request = p.request)
  AND EXISTS (SELECT 1 FROM m_ WHERE m_.memory_space = p.memory_space AND memory_id = other AND status <> 'archived') AND NOT EXISTS (SELECT 1 FROM seeds s WHERE s.request = p.request AND s.memory_id = other)"""
)
def g_local_expansion(spark: SparkSession, d: str) -> DataFrame:
    return graph.expanded(seeds(spark, d), b.edges(spark, d), b.memories(spark, d), hops=0).select("request", "memory_id", "hop")


def _hops_sql(hops: int) -> str:
    """The steps of an expansion as common tables ``held1`` (after the step within the entity) to ``held{hops + 1}``."""
    out = "held0 AS (SELECT request, memory_space, anchor, intent, memory_id, 0 AS hop FROM seeds)"
    for k in range(1, hops + 2):
        before, start = f"held{k - 1}", f"held{k - 1} WHERE hop = {k - 1}" if k > 2 else f"held{k - 1}"
        far = "coalesce(o.entity_key <> x.anchor, false)"
        out += f""",
f{k} AS (SELECT * FROM {start}),
x{k} AS (SELECT * FROM (SELECT f.*, e.other, e.outgoing, e.edge_id, e.edge_type, e.created_at, row_number() OVER (PARTITION BY request, edge_id ORDER BY outgoing DESC) AS once FROM f{k} f JOIN ends e ON e.memory_space = f.memory_space AND e.memory_id = f.memory_id) WHERE once = 1),
y{k} AS (SELECT x.* FROM x{k} x LEFT JOIN m_ o ON o.memory_space = x.memory_space AND o.memory_id = x.other LEFT JOIN {before} k ON k.request = x.request AND k.memory_id = x.other
  WHERE {far if k > 1 else 'NOT ' + far} AND (edge_type <> 'updates' OR x.intent = 'history' OR (x.intent = 'latest' AND NOT outgoing) OR (x.intent = 'uncertain' AND k.memory_id IS NULL))),
z{k} AS (SELECT request, memory_space, anchor, intent, edge_type, other, min(struct_pack(c := created_at, e := edge_id)) AS first FROM y{k} GROUP BY ALL),
n{k} AS (SELECT *, row_number() OVER (PARTITION BY request, edge_type ORDER BY first) AS nth FROM z{k}),
p{k} AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY list_position(['updates', 'supports', 'contradicts', 'related_to'], edge_type), nth) AS place FROM n{k} WHERE nth <= CASE WHEN edge_type IN ('updates', 'supports') THEN 8 ELSE 6 END),
held{k} AS (SELECT * FROM {before} UNION ALL SELECT DISTINCT request, memory_space, anchor, intent, other, {k} FROM p{k} p WHERE place <= 24 - (SELECT count(*) FROM {before} h WHERE h.request = p.request)
  AND EXISTS (SELECT 1 FROM m_ WHERE m_.memory_space = p.memory_space AND memory_id = other AND status IS DISTINCT FROM 'archived') AND NOT EXISTS (SELECT 1 FROM {before} h WHERE h.request = p.request AND h.memory_id = other))"""
    return out


@query(over("m_", "g_") + f", {_MM}, {_SEEDS}, {_hops_sql(graph.HOPS)} SELECT request, memory_id, hop FROM held{graph.HOPS + 1}")
def g_expansion(spark: SparkSession, d: str) -> DataFrame:
    return graph.expanded(seeds(spark, d), b.edges(spark, d), b.memories(spark, d)).select("request", "memory_id", "hop")


@query(
    over("m_", "g_")
    + f""", {_MM}, {_SEEDS} SELECT s.request, to_id AS observation_id, array_to_string(list(DISTINCT s.memory_id ORDER BY s.memory_id), ',') AS memory_ids FROM seeds s
JOIN g_ g ON g.memory_space = s.memory_space AND g.from_id = s.memory_id WHERE edge_type = 'derived_from' AND to_kind = 'observation' GROUP BY ALL"""
)
def g_evidence(spark: SparkSession, d: str) -> DataFrame:
    return graph.evidence(seeds(spark, d), b.edges(spark, d)).withColumn("memory_ids", F.array_join("memory_ids", ","))


@query(
    over("m_", "g_")
    + f""", {_MM}, {_SEEDS}, f AS (SELECT request, other, min(struct_pack(c := created_at, e := edge_id)) AS first FROM seeds s JOIN ends e ON e.memory_space = s.memory_space AND e.memory_id = s.memory_id WHERE edge_type = 'contradicts' GROUP BY ALL)
SELECT request, 'contradicting_memory:' || other AS uncertainty FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY first, other) AS n FROM f) WHERE n <= 8"""
)
def g_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return graph.conflicts(seeds(spark, d), b.edges(spark, d))


@query(
    over("m_", "g_")
    + f""", {_MM}, {_SEEDS}, t AS (SELECT s.request, s.memory_id, list(DISTINCT edge_type ORDER BY edge_type) AS types FROM seeds s JOIN ends e ON e.memory_space = s.memory_space AND e.memory_id = s.memory_id
  WHERE EXISTS (SELECT 1 FROM seeds o WHERE o.request = s.request AND o.memory_id = e.other) GROUP BY ALL)
SELECT request, memory_id, CASE WHEN types IS NULL THEN 'expanded' WHEN list_contains(types, 'contradicts') THEN 'conflicting' WHEN list_contains(types, 'updates') THEN 'historical_or_updated'
  WHEN list_contains(types, 'supports') THEN 'supporting' ELSE 'background_only' END AS role, coalesce(array_to_string(types, ','), '') AS edge_types FROM seeds LEFT JOIN t USING (request, memory_id)"""
)
def g_roles(spark: SparkSession, d: str) -> DataFrame:
    held = seeds(spark, d).withColumn("hop", F.lit(1))
    return graph.evidence_roles(held, b.edges(spark, d))


@query(
    over("m_", "g_") + f", {_MM}, {_SEEDS} SELECT request, memory_id AS id, 'm' || row_number() OVER (PARTITION BY request ORDER BY memory_id) AS ref FROM seeds"
)
def g_short_refs(spark: SparkSession, d: str) -> DataFrame:
    s = seeds(spark, d).select("request", F.col("memory_id").alias("id"), F.col("memory_id").alias("position"))
    return graph.short_refs(s, "m")


@query(
    over("v_")
    + """, a AS (SELECT memory_space, action, trigger_observation_id AS o, 'new_' || version_id AS n, memory_id AS t FROM v_)
SELECT memory_space, n AS from_id, 'observation' AS to_kind, o AS to_id, 'derived_from' AS edge_type, 'resolver:' || action AS reason FROM a WHERE action IN ('create', 'coexist', 'replace') AND o IS NOT NULL
UNION ALL SELECT memory_space, t, 'observation', o, 'derived_from', 'resolver:refresh' FROM a WHERE action = 'refresh' AND o IS NOT NULL
UNION ALL SELECT memory_space, n, 'memory', t, 'updates', 'resolver:replace' FROM a WHERE action = 'replace'"""
)
def g_hot_path_edges(spark: SparkSession, d: str) -> DataFrame:
    v = b.versions(spark, d)
    acts = v.select("memory_space", "action", F.col("trigger_observation_id").alias("observation_id"), F.concat(F.lit("new_"), "version_id").alias("new_id"), F.col("memory_id").alias("target_id"))
    return graph.hot_path_edges(acts)


@query(over("m_", "e_") + "SELECT memory_space, entity_key, count(*) AS n_memories FROM m_ ANTI JOIN e_ USING (memory_space, entity_key) WHERE entity_key IS NOT NULL GROUP BY 1, 2")
def g_missing_entities(spark: SparkSession, d: str) -> DataFrame:
    return graph.missing_entities(b.memories(spark, d), b.entities(spark, d))


@query(over("m_", "e_") + "SELECT m.memory_space, memory_id, e.identity_profile.who AS who FROM m_ m JOIN e_ e ON e.memory_space = m.memory_space AND e.entity_key = m.entity_key")
def g_owned_memories(spark: SparkSession, d: str) -> DataFrame:
    """Memories of entities that exist, with their profile; a missing entity would be an error."""
    m, e = b.memories(spark, d), b.entities(spark, d)
    known = m.join(e.select("memory_space", "entity_key"), ["memory_space", "entity_key"], "left_semi")
    return graph.owned_memories(known, e).select("memory_space", "memory_id", F.col("identity_profile.who").alias("who"))


@query(
    over("m_", "g_")
    + f""", {_MM}, {_SEEDS}, r AS (SELECT s.request, g.edge_type, from_id, to_id, reason, weight, min(struct_pack(c := g.created_at, e := edge_id)) AS f FROM seeds s JOIN mm g ON g.memory_space = s.memory_space AND g.from_id = s.memory_id
  WHERE EXISTS (SELECT 1 FROM seeds o WHERE o.request = s.request AND o.memory_id = g.to_id) GROUP BY ALL),
x AS (SELECT request, from_id AS memory_id, * EXCLUDE (request) FROM r UNION ALL SELECT request, to_id, * EXCLUDE (request) FROM r),
l AS (SELECT request, memory_id, list(edge_type || ':' || from_id || '>' || to_id || ':' || coalesce(CAST(round(weight, 4) AS VARCHAR), '') ORDER BY f, edge_type, from_id, to_id) AS edges, list(edge_type ORDER BY f, edge_type, from_id, to_id) AS t FROM x GROUP BY 1, 2)
SELECT request, memory_id, m.status, coalesce(array_to_string(edges, ' '), '') AS edges, coalesce(array_to_string(list_filter(t, lambda v, i: list_position(t, v) = i), ','), '') AS types FROM seeds JOIN m_ m USING (memory_space, memory_id) LEFT JOIN l USING (request, memory_id)"""
)
def g_payload(spark: SparkSession, d: str) -> DataFrame:
    """What a composer is given of every request's seeds: their relations in order."""
    out = graph.evidence_payload(seeds(spark, d).withColumn("hop", F.lit(1)), b.edges(spark, d), b.memories(spark, d))
    said = F.transform(F.coalesce("relation_edges", F.expr("cast(array() AS array<struct<edge_type:string,from_id:string,to_id:string,reason:string,weight:double>>)")), lambda e: F.concat(e["edge_type"], F.lit(":"), e["from_id"], F.lit(">"), e["to_id"], F.lit(":"), F.coalesce(F.round(e["weight"], 4).cast("string"), F.lit(""))))
    return out.select("request", "memory_id", "status", F.array_join(said, " ").alias("edges"), F.array_join("relation_types", ",").alias("types"))


@query(
    over("m_", "g_")
    + f""", {_MM}, {_SEEDS}, r AS (SELECT request, memory_id, row_number() OVER (PARTITION BY request ORDER BY memory_id) AS n FROM seeds), c AS (SELECT request, n AS position, n % 4 AS cited FROM r)
SELECT c.request, position, memory_id AS id FROM c JOIN r ON r.request = c.request AND r.n = c.cited"""
)
def g_restored(spark: SparkSession, d: str) -> DataFrame:
    """References that a model gave back, among them unknown ones, with the ids that they stand for."""
    refs = g_short_refs(spark, d)
    n = F.substring("ref", 2, 9).cast("int")
    return graph.restored(refs.select("request", n.alias("position"), F.concat(F.lit("m"), (n % 4).cast("string")).alias("ref")), refs)
