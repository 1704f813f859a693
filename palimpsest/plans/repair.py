"""Repairing relations across entities: candidates, judgement, and all the pruning in one set-based plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.checkpoints import materialise
from palimpsest.functions import text
from palimpsest.operators import flows, graph, retrieval
from palimpsest.plans.graph_queries import _FRONTIER
from palimpsest.plans.recall_queries import _BM25, _IDENTITY, _VECTORS, _tokens
from palimpsest.plans.views import over
from palimpsest.plans.write_queries import _norm
from palimpsest.sources import bindings as b

CANDIDATES = 14


def mention_candidates(frontier: DataFrame, entities: DataFrame, memories: DataFrame, n: int = CANDIDATES) -> DataFrame:
    """(memory_space, memory_id, candidate_id, rank): for each frontier memory the newest memories of other entities of the space
    that mention its entity by name; at most ``n``. The name's first two tokens, in a row, are an equi-join key; a name of one
    token counts as it is."""
    pairs = lambda c: F.when(F.size(c) > 1, F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda x, y: F.concat_ws(" ", x, y))).otherwise(c)
    named = entities.select("memory_space", "entity_key", F.get(pairs(text.tokens(F.col("display_name"))), F.lit(0)).alias("name")).where("name IS NOT NULL AND display_name <> 'Unknown'")
    said = memories.where("status IS NULL OR status <> 'archived'").select("memory_space", F.col("memory_id").alias("doc_id"), F.col("entity_key").alias("owner"), "updated_at", text.tokens(F.concat_ws(" ", "title", "summary", "content")).alias("w"))
    said = said.select("memory_space", "doc_id", "owner", "updated_at", F.explode(F.array_distinct(pairs(F.col("w")))).alias("name"))
    # candidates depend on the entity only, so they are ranked before its frontier memories are joined
    met = named.join(said, ["memory_space", "name"]).where("entity_key <> owner")
    scored = met.select("memory_space", "entity_key", F.concat_ws("|", "memory_space", "entity_key").alias("query_id"), "doc_id", F.coalesce("updated_at", F.lit(0.0)).alias("score"))
    best = retrieval.ranked(scored, n).select("memory_space", "entity_key", F.col("doc_id").alias("candidate_id"), "rank")
    return best.join(frontier.select("memory_space", "entity_key", "memory_id"), ["memory_space", "entity_key"]).select("memory_space", "memory_id", "candidate_id", "rank")


def rule_judge(pairs: DataFrame) -> DataFrame:
    """A stand-in for a model: pairs (…, left_text, right_text) are related as strongly as their tokens overlap."""
    return pairs.withColumns({"edge_type": F.lit("related_to"), "weight": F.round(text.overlap_score(F.col("left_text"), F.col("right_text")), 6), "reason": F.lit("rule")})


def cross_entity_repair(memories: DataFrame, entities: DataFrame, edges: DataFrame, judge: Callable[[DataFrame], DataFrame] = rule_judge) -> DataFrame:
    """The new edges across entities: frontier memories and their candidates are judged; what is too weak, against known ids,
    or doubled goes; every frontier memory keeps its best relation, conflicts with mere records go, and so do weak relations of
    a component; what the store has already is not proposed again."""
    # every step reads the one before more than once, so unwritten ones would be planned and run many times over
    frontier = materialise(graph.frontiers(memories), "frontier")
    found = mention_candidates(frontier, entities, memories)
    body = memories.select("memory_space", "memory_id", F.concat_ws(" ", "title", "summary", "content").alias("text"))
    pairs = found.join(body.withColumnRenamed("text", "left_text"), ["memory_space", "memory_id"])
    pairs = pairs.join(body.withColumnsRenamed({"memory_id": "candidate_id", "text": "right_text"}), ["memory_space", "candidate_id"])
    judged = judge(pairs).select(
        "memory_space", F.concat_ws("|", "memory_id", "candidate_id").alias("edge_id"), F.lit("memory").alias("from_kind"), F.col("memory_id").alias("from_id"),
        F.lit("memory").alias("to_kind"), F.col("candidate_id").alias("to_id"), "edge_type", "weight", "reason", "rank",
    )
    kept = materialise(graph.normalised(materialise(judged, "judged"), memories, ["rank", "edge_id"]), "normalised")
    kept = materialise(graph.sparsified(kept, frontier, rank="rank"), "sparsified")
    kept = graph.pruned_components(materialise(graph.without_historical_conflicts(kept, memories), "kept"))
    return graph.insertable(edges, kept, ["edge_id"])


def repaired_by_retrieval(anchors: DataFrame, memories: DataFrame, entities: DataFrame, edges: DataFrame, observations: DataFrame, judge: Callable[[DataFrame], DataFrame] = rule_judge) -> DataFrame:
    """The new edges (request, memory_space, from_id, to_id, edge_type, weight, reason) across entities for the anchors (memory_space,
    entity_key), each by itself: the memories of other entities that hybrid retrieval finds for its frontier are judged against it, and
    the relations pruned within the anchor's own graph, as in ``cross_entity_repair``. What the store has is not proposed again; of
    edges that two anchors propose the one of the smaller request is made."""
    frontier = graph.frontiers(memories).join(anchors.select("memory_space", "entity_key").distinct(), ["memory_space", "entity_key"], "left_semi")
    frontier = frontier.select(F.concat_ws("|", "memory_space", "entity_key").alias("request"), "memory_space", F.col("entity_key").alias("anchor"), "memory_id")
    frontier = materialise(frontier, "frontier")
    found = materialise(flows.related_candidates(frontier, memories, entities, edges, observations), "related")
    body = memories.select("memory_space", "memory_id", F.concat_ws(" ", "title", "summary", "content").alias("text"))
    pairs = found.join(frontier.select("request", "memory_id"), "request").join(body.withColumnRenamed("text", "left_text"), ["memory_space", "memory_id"])
    pairs = pairs.join(body.withColumnsRenamed({"memory_id": "candidate_id", "text": "right_text"}), ["memory_space", "candidate_id"])
    # the graph of each request is pruned by itself, so the request stands in for the space
    judged = judge(pairs).select(
        F.col("request").alias("memory_space"), F.concat_ws("|", "memory_id", "candidate_id").alias("edge_id"), F.lit("memory").alias("from_kind"), F.col("memory_id").alias("from_id"),
        F.lit("memory").alias("to_kind"), F.col("candidate_id").alias("to_id"), "edge_type", "weight", "reason", "rank",
    )
    judged = materialise(judged, "judged")
    own = judged.select("memory_space", F.explode(F.array("from_id", "to_id")).alias("memory_id")).distinct()
    kept = graph.normalised(judged, own, ["rank", "edge_id"])
    kept = graph.sparsified(kept, frontier.select(F.col("request").alias("memory_space"), "memory_id"), rank="rank")
    spaces = frontier.select("request", F.col("memory_space").alias("space")).distinct()
    marks = own.withColumnRenamed("memory_space", "request").join(spaces, "request").withColumnRenamed("space", "memory_space")
    marks = marks.join(memories.select("memory_space", "memory_id", "metadata"), ["memory_space", "memory_id"]).select(F.col("request").alias("memory_space"), "memory_id", "metadata")
    kept = graph.pruned_components(materialise(graph.without_historical_conflicts(kept, marks), "kept"))
    placed = kept.withColumnRenamed("memory_space", "request").join(spaces, "request").withColumnRenamed("space", "memory_space")
    new = graph.insertable(edges, placed, ["request", "edge_id"])
    return new.select("request", "memory_space", "from_id", "to_id", "edge_type", "weight", "reason")


def g_repair_by_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Every entity whose number is divisible by 20 as an anchor, against all memories of its space."""
    e = b.entities(spark, d)
    anchors = e.where(F.conv(F.right("entity_key", F.lit(4)), 16, 10).cast("int") % 20 == 0)
    new = repaired_by_retrieval(anchors, b.memories(spark, d), e, b.edges(spark, d), b.observations(spark, d))
    return new.select("request", "from_id", "to_id", "edge_type", "weight")


def g_cross_entity_repair(spark: SparkSession, d: str) -> DataFrame:
    new = cross_entity_repair(b.memories(spark, d), b.entities(spark, d), b.edges(spark, d))
    return new.select("memory_space", "from_id", "to_id", "edge_type", "weight")


def _bigrams(tokens: str) -> str:
    """Neighbouring tokens as one; a single token by itself."""
    return f"CASE WHEN len({tokens}) > 1 THEN list_transform(range(1, len({tokens})), lambda i: {tokens}[i] || ' ' || {tokens}[i + 1]) ELSE {tokens} END"


_BODY = "concat_ws(' ', title, summary, content)"
_TEXT = "coalesce(nullif(trim({0}.summary, ' '), ''), {0}.content)"
_REPAIR = (
    over("m_", "e_", "g_", recursive=True)
    + f""", {_FRONTIER},
nt AS (SELECT memory_space, entity_key, {_tokens("display_name")} AS t FROM e_ WHERE display_name <> 'Unknown'), named AS (SELECT memory_space, entity_key, ({_bigrams("t")})[1] AS name FROM nt),
bt AS (SELECT memory_space, memory_id, entity_key, updated_at, status, {_tokens(_BODY)} AS t FROM m_), said AS (SELECT memory_space, memory_id, entity_key, updated_at, unnest(list_distinct({_bigrams("t")})) AS name FROM bt WHERE status IS DISTINCT FROM 'archived'),
best AS (SELECT * FROM (SELECT n.memory_space, n.entity_key, s.memory_id AS candidate, row_number() OVER (PARTITION BY n.memory_space, n.entity_key ORDER BY coalesce(s.updated_at, 0) DESC, s.memory_id) AS rank FROM named n JOIN said s ON s.memory_space = n.memory_space AND s.name = n.name AND s.entity_key <> n.entity_key) WHERE rank <= 14),
pairs AS (SELECT b.memory_space, f.memory_id AS a, b.candidate AS b, rank, x.t AS ta, y.t AS tb FROM best b JOIN front f ON f.memory_space = b.memory_space AND f.entity_key = b.entity_key JOIN bt x ON x.memory_space = b.memory_space AND x.memory_id = f.memory_id JOIN bt y ON y.memory_space = b.memory_space AND y.memory_id = b.candidate),
jd AS (SELECT *, round(CASE WHEN len(ta) > 0 AND len(tb) > 0 THEN coalesce(list_sum([least(len(list_filter(ta, lambda y: y = t)), len(list_filter(tb, lambda y: y = t))) for t in list_distinct(ta)]), 0) / sqrt(len(ta) * len(tb)) ELSE 0 END, 6) AS weight FROM pairs),
norm_ AS (SELECT memory_space, least(a, b) AS f, greatest(a, b) AS t, weight, rank, a || '|' || b AS edge_id FROM jd WHERE weight >= 0.2 AND a <> b QUALIFY row_number() OVER (PARTITION BY memory_space, least(a, b), greatest(a, b) ORDER BY rank, a || '|' || b) = 1),
fr AS (SELECT DISTINCT memory_space, memory_id FROM front),
own AS (SELECT n.*, CASE WHEN p.memory_id IS NOT NULL THEN f WHEN z.memory_id IS NOT NULL THEN t END AS owner FROM norm_ n LEFT JOIN fr p ON p.memory_space = n.memory_space AND p.memory_id = f LEFT JOIN fr z ON z.memory_space = n.memory_space AND z.memory_id = t),
sp AS (SELECT * FROM own WHERE owner IS NULL UNION ALL SELECT * FROM (SELECT * FROM own WHERE owner IS NOT NULL QUALIFY row_number() OVER (PARTITION BY memory_space, owner ORDER BY weight DESC, rank NULLS LAST, edge_id) = 1)),
v AS (SELECT *, memory_space || chr(9) || f AS va, memory_space || chr(9) || t AS vb FROM sp), l AS (SELECT va AS a, vb AS b FROM v UNION SELECT vb, va FROM v), reach AS (SELECT a, a AS b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
root AS (SELECT a, min(b) AS root FROM reach GROUP BY 1), c AS (SELECT v.*, count(*) OVER (PARTITION BY root) AS n, max(weight) OVER (PARTITION BY root) AS most FROM v JOIN root ON root.a = v.va)
SELECT memory_space, f AS from_id, t AS to_id, 'related_to' AS edge_type, weight FROM c WHERE (n <= 1 OR weight >= most - 0.15::DOUBLE)
  AND NOT EXISTS (SELECT 1 FROM g_ WHERE g_.memory_space = c.memory_space AND edge_type = 'related_to' AND from_kind = 'memory' AND to_kind = 'memory' AND least(from_id, to_id) = f AND greatest(from_id, to_id) = t)"""
)
_RETRIEVED = (
    over("m_", "e_", "g_", "o_", recursive=True)
    + f""", {_FRONTIER},
fa AS (SELECT f.memory_space || '|' || f.entity_key AS request, f.memory_space, f.entity_key AS anchor, f.memory_id FROM front f JOIN e_ USING (memory_space, entity_key) WHERE CAST('0x' || right(f.entity_key, 4) AS INT) % 20 = 0),
tx AS (SELECT request, fa.memory_space, anchor, 1 AS source, memory_id AS ord, {_norm(_TEXT.format("m"))} AS text FROM fa JOIN m_ m USING (memory_space, memory_id)
UNION ALL SELECT DISTINCT request, h.memory_space, anchor, 2, o.observation_id, {_norm(_TEXT.format("o"))} FROM fa h JOIN g_ g ON g.memory_space = h.memory_space AND g.from_id = h.memory_id AND edge_type = 'derived_from' AND to_kind = 'observation'
  JOIN o_ o ON o.memory_space = h.memory_space AND o.observation_id = g.to_id),
ft AS (SELECT request, memory_space, anchor, lower(text) AS folded, min(struct_pack(s := source, a := ord, t := text)) AS f FROM tx WHERE text <> '' GROUP BY 1, 2, 3, 4),
pt AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY f.s, f.a, folded) AS position FROM ft),
asked AS (SELECT request AS query_id, memory_space AS grp, anchor, string_agg(f.t, chr(10) ORDER BY position) AS text FROM pt WHERE position <= 8 GROUP BY 1, 2, 3),
i AS (SELECT memory_space, entity_key, {_IDENTITY} AS identity FROM (SELECT *, identity_profile AS p FROM e_)),
docs AS (SELECT m.memory_space AS grp, memory_id AS doc_id, entity_key AS own, array_to_string(list_filter([i.identity, title, summary, content], lambda x: trim(coalesce(x, ''), ' ') <> ''), chr(10)) AS text FROM m_ m LEFT JOIN i USING (memory_space, entity_key) WHERE status IN ('active', 'stale', 'superseded')),
words AS (SELECT grp, doc_id, {_tokens("text")} AS w FROM docs), q AS (SELECT query_id, grp, unnest({_tokens("text")}) AS token FROM asked),
"""
    + _BM25
    + ", "
    + _VECTORS.replace("WHERE score >= 0.12)", "WHERE score >= 0.12 AND EXISTS (SELECT 1 FROM asked z JOIN docs y ON y.grp = z.grp WHERE z.query_id = s.query_id AND y.doc_id = s.doc_id AND y.own IS DISTINCT FROM z.anchor))").replace("JOIN (SELECT id, sum(x * x) AS n FROM dv GROUP BY 1 HAVING sum(x * x) > 0) nd ON nd.id = doc_id)", "JOIN (SELECT id, sum(x * x) AS n FROM dv GROUP BY 1 HAVING sum(x * x) > 0) nd ON nd.id = doc_id) s")
    + f""", lx AS (SELECT bm25.query_id, bm25.doc_id, score FROM bm25 JOIN asked z USING (query_id) JOIN docs y ON y.grp = z.grp AND y.doc_id = bm25.doc_id WHERE score > 0 AND y.own IS DISTINCT FROM z.anchor),
lists AS (SELECT query_id, doc_id, rank FROM dense UNION ALL SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM lx) WHERE rank <= 24),
fused AS (SELECT query_id, doc_id, round(sum(1 / (50 + rank)::DOUBLE), 12) AS score FROM lists GROUP BY ALL),
cand AS (SELECT * FROM (SELECT query_id AS request, grp AS memory_space, m_.memory_id, m_.entity_key, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, status = 'active' DESC, salience DESC NULLS LAST, confidence DESC NULLS LAST, updated_at DESC NULLS LAST, m_.memory_id) AS rank
  FROM fused JOIN asked USING (query_id) JOIN m_ ON m_.memory_space = grp AND m_.memory_id = doc_id WHERE score >= 0.01) WHERE rank <= 14),
bt AS (SELECT memory_space, memory_id, {_tokens(_BODY)} AS t FROM m_),
pairs AS (SELECT c.request, c.memory_space, fa.memory_id AS a, c.memory_id AS b, rank, x.t AS ta, y.t AS tb FROM cand c JOIN e_ USING (memory_space, entity_key) JOIN fa ON fa.request = c.request JOIN bt x ON x.memory_space = c.memory_space AND x.memory_id = fa.memory_id JOIN bt y ON y.memory_space = c.memory_space AND y.memory_id = c.memory_id),
jd AS (SELECT *, round(CASE WHEN len(ta) > 0 AND len(tb) > 0 THEN coalesce(list_sum([least(len(list_filter(ta, lambda y: y = t)), len(list_filter(tb, lambda y: y = t))) for t in list_distinct(ta)]), 0) / sqrt(len(ta) * len(tb)) ELSE 0 END, 6) AS weight FROM pairs),
norm_ AS (SELECT request, memory_space, least(a, b) AS f, greatest(a, b) AS t, weight, rank, a || '|' || b AS edge_id FROM jd WHERE weight >= 0.2 AND a <> b QUALIFY row_number() OVER (PARTITION BY request, least(a, b), greatest(a, b) ORDER BY rank, a || '|' || b) = 1),
own_ AS (SELECT n.*, CASE WHEN p.memory_id IS NOT NULL THEN f WHEN z.memory_id IS NOT NULL THEN t END AS owner FROM norm_ n LEFT JOIN fa p ON p.request = n.request AND p.memory_id = f LEFT JOIN fa z ON z.request = n.request AND z.memory_id = t),
sp AS (SELECT * FROM own_ WHERE owner IS NULL UNION ALL SELECT * FROM (SELECT * FROM own_ WHERE owner IS NOT NULL QUALIFY row_number() OVER (PARTITION BY request, owner ORDER BY weight DESC, rank, edge_id) = 1)),
v AS (SELECT *, request || chr(9) || f AS va, request || chr(9) || t AS vb FROM sp), l AS (SELECT va AS a, vb AS b FROM v UNION SELECT vb, va FROM v), reach AS (SELECT a, a AS b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
root AS (SELECT a, min(b) AS root FROM reach GROUP BY 1), c AS (SELECT v.*, count(*) OVER (PARTITION BY root) AS n, max(weight) OVER (PARTITION BY root) AS most FROM v JOIN root ON root.a = v.va),
new AS (SELECT * FROM c WHERE n <= 1 OR weight >= most - 0.15::DOUBLE QUALIFY row_number() OVER (PARTITION BY memory_space, f, t ORDER BY request, edge_id) = 1)
SELECT request, f AS from_id, t AS to_id, 'related_to' AS edge_type, weight FROM new
  WHERE NOT EXISTS (SELECT 1 FROM g_ WHERE g_.memory_space = new.memory_space AND edge_type = 'related_to' AND from_kind = 'memory' AND to_kind = 'memory' AND least(from_id, to_id) = f AND greatest(from_id, to_id) = t)"""
)
QUERIES = {"g_cross_entity_repair": g_cross_entity_repair, "g_repair_by_retrieval": g_repair_by_retrieval}
ORACLE = {"g_cross_entity_repair": _REPAIR, "g_repair_by_retrieval": _RETRIEVED}
