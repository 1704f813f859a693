"""Queries of hybrid retrieval. The query set of a search is every row whose id is divisible by 20, against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.operators import retrieval as r
from palimpsest.plans.views import over
from palimpsest.sources import bindings as b
from palimpsest.sources.snapshots import index_states
from palimpsest.sources.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def requests(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, grp, text): the drafts whose number (the last four digits of the id) is divisible by 20 ask for their name."""
    ask = b.drafts(spark, d).where(F.conv(F.right("draft_id", F.lit(4)), 16, 10).cast("int") % 20 == 0)
    return ask.select(F.col("draft_id").alias("query_id"), F.col("memory_space").alias("grp"), F.col("who").alias("text"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """(grp, doc_id, text): the memories that are not archived."""
    m = b.memories(spark, d).where("status <> 'archived'")
    body = text.memory_text(F.lit(None).cast("string"), F.col("title"), F.col("summary"), F.col("content"))
    return m.select(F.col("memory_space").alias("grp"), F.col("memory_id").alias("doc_id"), body.alias("text"))


_BLANK = r"'[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'"


def _tokens(c: str) -> str:
    return f"regexp_extract_all(lower(trim(regexp_replace(coalesce({c}, ''), {_BLANK}, ' ', 'g'))), " + r"'[A-Za-z0-9_]+|[\x{4e00}-\x{9fff}]')"


_SETS = (
    over("d_", "m_")
    + f""", asked AS (SELECT draft_id AS query_id, memory_space AS grp, who AS text FROM d_ WHERE CAST('0x' || right(draft_id, 4) AS INT) % 20 = 0),
docs AS (SELECT memory_space AS grp, memory_id AS doc_id, array_to_string(list_filter([title, summary, content], lambda x: trim(coalesce(x, ''), ' ') <> ''), chr(10)) AS text FROM m_ WHERE status <> 'archived'),
words AS (SELECT grp, doc_id, {_tokens("text")} AS w FROM docs),
q AS (SELECT query_id, grp, unnest({_tokens("text")}) AS token FROM asked),
"""
)
_BM25 = """qt AS (SELECT grp, token, query_id, count(*) AS times FROM q GROUP BY ALL),
size AS (SELECT grp, count(*) AS n, avg(len(w)) AS mean FROM words GROUP BY 1),
post AS (SELECT grp, token, doc_id, length, count(*) AS tf FROM (SELECT grp, doc_id, len(w) AS length, unnest(w) AS token FROM words) GROUP BY ALL),
freq AS (SELECT grp, token, count(*) AS df FROM post GROUP BY ALL),
bm25 AS (SELECT query_id, doc_id, round(sum(times * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))), 9) AS score
  FROM qt JOIN freq USING (grp, token) JOIN size USING (grp) JOIN post USING (grp, token) GROUP BY ALL)
"""
_VECTORS = """qv AS (SELECT query_id AS id, grp, CAST('0x' || substr(md5(token), 1, 4) AS INT) % 64 AS b, sum(CASE WHEN CAST('0x' || substr(md5(token), 5, 1) AS INT) < 8 THEN 1.0::DOUBLE ELSE -1 END) AS x FROM q GROUP BY ALL),
dv AS (SELECT doc_id AS id, grp, CAST('0x' || substr(md5(token), 1, 4) AS INT) % 64 AS b, sum(CASE WHEN CAST('0x' || substr(md5(token), 5, 1) AS INT) < 8 THEN 1.0::DOUBLE ELSE -1 END) AS x
  FROM (SELECT grp, doc_id, unnest(w) AS token FROM words) GROUP BY ALL),
dot AS (SELECT a.id AS query_id, c.id AS doc_id, sum(a.x * c.x) AS s FROM qv a JOIN dv c ON a.grp = c.grp AND a.b = c.b GROUP BY ALL),
dense AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT query_id, doc_id, round(s / sqrt(nq.n) / sqrt(nd.n), 9) AS score FROM dot JOIN (SELECT id, sum(x * x) AS n FROM qv GROUP BY 1 HAVING sum(x * x) > 0) nq ON nq.id = query_id JOIN (SELECT id, sum(x * x) AS n FROM dv GROUP BY 1 HAVING sum(x * x) > 0) nd ON nd.id = doc_id)
  WHERE score >= 0.12) WHERE rank <= 24)
"""


@query(
    """WITH s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 9) AS score
  FROM embeddings q JOIN embeddings d ON q.label = d.label WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score >= 0.12)
SELECT query_id, doc_id, rank FROM r WHERE rank <= 24"""
)
def r_dense(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("grp"), F.col("embedding").alias("vec"))
    found = r.dense(e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "doc_id"))
    return found.select("query_id", "doc_id", "rank")


@query(_SETS + _BM25 + "SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm25 WHERE score > 0) WHERE rank <= 24")
def r_bm25(spark: SparkSession, d: str) -> DataFrame:
    return r.ranked(r.bm25(requests(spark, d), _documents(spark, d)), r.OVERSAMPLE).select("query_id", "doc_id", "rank")


@query(_SETS + _VECTORS + "SELECT query_id, doc_id, rank FROM dense")
def r_hashed_dense(spark: SparkSession, d: str) -> DataFrame:
    return r.dense(r.hashed_vectors(requests(spark, d)), r.hashed_vectors(_documents(spark, d))).select("query_id", "doc_id", "rank")


@query(
    _SETS
    + _BM25
    + ", "
    + _VECTORS
    + """, lists AS (SELECT query_id, doc_id, rank FROM dense UNION ALL
  SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm25 WHERE score > 0) WHERE rank <= 24),
fused AS (SELECT query_id, doc_id, round(sum(1 / (50 + rank)::DOUBLE), 12) AS score FROM lists GROUP BY ALL)
SELECT query_id, memory_id, rank FROM (SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id
  ORDER BY score DESC, status = 'active' DESC, salience DESC NULLS LAST, confidence DESC NULLS LAST, updated_at DESC NULLS LAST, memory_id) AS rank
  FROM fused JOIN asked USING (query_id) JOIN m_ ON m_.memory_space = grp AND m_.memory_id = doc_id WHERE score >= 0.01) WHERE rank <= 10"""
)
def r_hybrid_recall(spark: SparkSession, d: str) -> DataFrame:
    """Over the memories' own texts, as the SQL has it; ``r_identity_recall`` searches their entities' identities, too."""
    return _recalled(spark, d, _documents(spark, d))


def _searched(spark: SparkSession, d: str) -> DataFrame:
    return r.searched_memories(b.memories(spark, d), b.entities(spark, d))


def _recalled(spark: SparkSession, d: str, documents: DataFrame) -> DataFrame:
    asked = requests(spark, d)
    lexical = r.ranked(r.bm25(asked, documents), r.OVERSAMPLE)
    dense = r.dense(r.hashed_vectors(asked), r.hashed_vectors(documents))
    fused = r.rrf([lexical, dense]).join(asked.select("query_id", F.col("grp").alias("memory_space")), "query_id")
    return r.memory_candidates(fused.withColumnRenamed("doc_id", "memory_id"), b.memories(spark, d)).select("query_id", "memory_id", "rank")


_IDENTITY = """array_to_string(list_filter([CASE WHEN trim(coalesce(p.who, ''), ' ') <> '' THEN 'who: ' || p.who END, CASE WHEN trim(coalesce(p.definition, ''), ' ') <> '' THEN 'definition: ' || p.definition END,
  CASE WHEN len(list_filter(p.surface_forms, lambda x: trim(x, ' ') <> '')) > 0 THEN 'surface_forms: ' || array_to_string(list_filter(p.surface_forms, lambda x: trim(x, ' ') <> ''), ' | ') END,
  CASE WHEN len(list_filter(p.stable_qualifiers, lambda x: trim(x, ' ') <> '')) > 0 THEN 'stable_qualifiers: ' || array_to_string(list_filter(p.stable_qualifiers, lambda x: trim(x, ' ') <> ''), ' | ') END], lambda x: x IS NOT NULL), chr(10))"""
_PROJECTED = (
    over("e_", "m_")
    + f""", i AS (SELECT memory_space, entity_key, updated_at, {_IDENTITY} AS identity FROM (SELECT *, identity_profile AS p FROM e_)),
index_ AS (SELECT 'entity:' || memory_space || ':' || entity_key AS ref_doc, 'entity' AS kind, identity AS text, updated_at FROM i
UNION ALL SELECT 'memory:' || m.memory_space || ':' || memory_id, 'memory', array_to_string(list_filter([i.identity, title, summary, content], lambda x: trim(coalesce(x, ''), ' ') <> ''), chr(10)), m.updated_at
FROM m_ m LEFT JOIN i USING (memory_space, entity_key))"""
)


@query(_PROJECTED + "SELECT ref_doc, kind, text, updated_at FROM index_")
def r_projections(spark: SparkSession, d: str) -> DataFrame:
    return r.projections(b.memories(spark, d), b.entities(spark, d)).select("ref_doc", "kind", "text", "updated_at")


_WITH_IDENTITY = (
    over("e_", "d_", "m_")
    + f""", asked AS (SELECT draft_id AS query_id, memory_space AS grp, who AS text FROM d_ WHERE CAST('0x' || right(draft_id, 4) AS INT) % 20 = 0),
i AS (SELECT memory_space, entity_key, {_IDENTITY} AS identity FROM (SELECT *, identity_profile AS p FROM e_)),
docs AS (SELECT m.memory_space AS grp, memory_id AS doc_id, array_to_string(list_filter([i.identity, title, summary, content], lambda x: trim(coalesce(x, ''), ' ') <> ''), chr(10)) AS text FROM m_ m LEFT JOIN i USING (memory_space, entity_key) WHERE status IS DISTINCT FROM 'archived'),
words AS (SELECT grp, doc_id, {_tokens("text")} AS w FROM docs), q AS (SELECT query_id, grp, unnest({_tokens("text")}) AS token FROM asked),
"""
)
_RECALLED = """, lists AS (SELECT query_id, doc_id, rank FROM dense UNION ALL
  SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm25 WHERE score > 0) WHERE rank <= 24),
fused AS (SELECT query_id, doc_id, round(sum(1 / (50 + rank)::DOUBLE), 12) AS score FROM lists GROUP BY ALL)
SELECT query_id, memory_id, rank FROM (SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id
  ORDER BY score DESC, status = 'active' DESC, salience DESC NULLS LAST, confidence DESC NULLS LAST, updated_at DESC NULLS LAST, memory_id) AS rank
  FROM fused JOIN asked USING (query_id) JOIN m_ ON m_.memory_space = grp AND m_.memory_id = doc_id WHERE score >= 0.01) WHERE rank <= 10"""


@query(_WITH_IDENTITY + _BM25 + ", " + _VECTORS + _RECALLED)
def r_identity_recall(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid recall over identity, title, summary and content, so that a name finds the memories of its entity."""
    return _recalled(spark, d, _searched(spark, d))


@query(_WITH_IDENTITY + _BM25 + "SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm25 WHERE score > 0) WHERE rank <= 24")
def r_identity_bm25(spark: SparkSession, d: str) -> DataFrame:
    return r.ranked(r.bm25(requests(spark, d), _searched(spark, d)), r.OVERSAMPLE).select("query_id", "doc_id", "rank")


@query(_WITH_IDENTITY + _VECTORS + "SELECT query_id, doc_id, rank FROM dense")
def r_identity_dense(spark: SparkSession, d: str) -> DataFrame:
    return r.dense(r.hashed_vectors(requests(spark, d)), r.hashed_vectors(_searched(spark, d))).select("query_id", "doc_id", "rank")


@query(_WITH_IDENTITY + _BM25 + "SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm25 WHERE score >= 0.08::DOUBLE) WHERE rank <= 40")
def r_lexical(spark: SparkSession, d: str) -> DataFrame:
    return r.lexical(requests(spark, d), _searched(spark, d), 40).select("query_id", "doc_id", "rank")


@query(over("g_") + """, n AS (SELECT memory_space || '|' || from_id AS query_id, to_id AS ref_doc, edge_id AS node_id, weight AS score FROM g_ WHERE weight > 0)
SELECT query_id, ref_doc, max(score) AS score, array_to_string(list(node_id ORDER BY score DESC, node_id), ',') AS nodes FROM n GROUP BY 1, 2""")
def r_best_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Edges as nodes of the record that they point to: its greatest score, and its nodes by score."""
    nodes = b.edges(spark, d).select(F.concat_ws("|", "memory_space", "from_id").alias("query_id"), F.col("to_id").alias("ref_doc"), F.col("edge_id").alias("node_id"), F.col("weight").alias("score"))
    return r.best_nodes(nodes).withColumn("nodes", F.array_join("nodes", ","))


@query(over("m_") + """, s AS (SELECT memory_space, count(*) AS n, count(*) FILTER (status = 'active') AS live FROM m_ GROUP BY 1)
SELECT memory_space AS index_id, CASE WHEN n % 3 = 0 AND live > 0 THEN 'ready' ELSE 'stale' END AS index_state, CASE WHEN n % 3 = 0 AND live > 0 THEN NULL ELSE 1000 END AS rebuild_priority FROM s""")
def r_index_states(spark: SparkSession, d: str) -> DataFrame:
    """Every space as an index whose recorded model follows from its memories; one without active memories lacks a dimension."""
    s = b.memories(spark, d).groupBy(F.col("memory_space").alias("index_id")).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "active").alias("live"))
    config = F.create_map(F.lit("provider"), F.lit("hashing"), F.lit("model"), F.concat(F.lit("m"), (F.col("n") % 3).cast("string")), F.lit("dim"), F.when(F.col("live") > 0, "64"), F.lit("projection_version"), F.lit("1"))
    return index_states(s.select("index_id", F.explode(config).alias("state_key", "value")), {"provider": "hashing", "model": "m0", "dim": "64", "projection_version": "1"})


@query(_PROJECTED + "SELECT ref_doc, kind, text, updated_at FROM index_ WHERE trim(text, ' ') <> ''")
def r_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    return r.rebuilt(b.memories(spark, d), b.entities(spark, d)).select("ref_doc", "kind", "text", "updated_at")


@query(
    _PROJECTED
    + """, t AS (SELECT DISTINCT memory_space, entity_key FROM m_ WHERE status = 'stale'),
chosen AS (SELECT 'entity:' || e.memory_space || ':' || e.entity_key AS ref_doc FROM e_ e SEMI JOIN t USING (memory_space, entity_key) UNION SELECT 'memory:' || memory_space || ':' || memory_id FROM m_ WHERE salience > 0.9
UNION SELECT 'memory:' || memory_space || ':' || memory_id FROM (SELECT m_.*, row_number() OVER (PARTITION BY memory_space, entity_key ORDER BY updated_at DESC NULLS LAST, memory_id) AS n FROM m_ SEMI JOIN t USING (memory_space, entity_key)) WHERE n <= 3)
SELECT ref_doc, kind, CASE WHEN c.ref_doc IS NULL THEN 0 ELSE coalesce(updated_at, -1) END AS updated_at FROM index_ LEFT JOIN chosen c USING (ref_doc) WHERE c.ref_doc IS NULL OR trim(text, ' ') <> ''"""
)
def r_reindexed(spark: SparkSession, d: str) -> DataFrame:
    """An index of old times, of which the entities with a stale memory, three of their memories each, and the most salient memories
    are indexed anew."""
    m, e = b.memories(spark, d), b.entities(spark, d)
    index = r.projections(m, e).withColumn("updated_at", F.lit(0.0))
    out = r.reindexed(index, e, m, m.where("status = 'stale'"), m.where("salience > 0.9"), 3)
    return out.select("ref_doc", "kind", F.coalesce("updated_at", F.lit(-1.0)).alias("updated_at"))


_OLD = "held AS (SELECT memory_space, ref_doc, updated_at FROM (SELECT 'memory:' || memory_space || ':' || memory_id AS ref_doc, memory_space, max(created_at) AS updated_at FROM v_ GROUP BY ALL))"


@query(over("m_", "v_") + f", {_OLD} SELECT 'memory:' || m.memory_space || ':' || memory_id AS ref_doc, m.updated_at FROM m_ m LEFT JOIN held h ON h.ref_doc = 'memory:' || m.memory_space || ':' || memory_id WHERE h.ref_doc IS NULL OR m.updated_at IS DISTINCT FROM h.updated_at")
def r_stale_documents(spark: SparkSession, d: str) -> DataFrame:
    ref = text.ref_doc("memory", F.col("memory_space"), F.col("memory_id")).alias("ref_doc")
    held = b.versions(spark, d).groupBy("memory_space", "memory_id").agg(F.max("created_at").alias("updated_at")).select(ref, "updated_at")
    return r.stale_documents(b.memories(spark, d).select(ref, "updated_at"), held)


@query(_PROJECTED + "SELECT ref_doc, kind, updated_at + CASE WHEN kind = 'entity' THEN 1 ELSE 0 END AS updated_at FROM index_ WHERE kind = 'memory' OR trim(text, ' ') <> ''")
def r_upsert(spark: SparkSession, d: str) -> DataFrame:
    index = r.projections(b.memories(spark, d), b.entities(spark, d)).select("ref_doc", "kind", "text", "updated_at")
    new = index.where("kind = 'entity'").withColumn("updated_at", F.col("updated_at") + 1)
    return r.upsert(index, new).select("ref_doc", "kind", "updated_at")


_ENTITY_HITS = (
    over("e_", "d_")
    + f""", asked AS (SELECT draft_id AS query_id, memory_space AS grp, who AS text FROM d_ WHERE CAST('0x' || right(draft_id, 4) AS INT) % 20 = 0),
words AS (SELECT memory_space AS grp, entity_key AS doc_id, {_tokens(_IDENTITY)} AS w FROM (SELECT *, identity_profile AS p FROM e_)),
q AS (SELECT query_id, grp, unnest({_tokens("text")}) AS token FROM asked), """
)


@query(
    _ENTITY_HITS
    + _VECTORS
    + """, fused AS (SELECT query_id, doc_id, round(1 / (50 + rank)::DOUBLE, 12) AS score FROM dense)
SELECT query_id, entity_key, rank FROM (SELECT query_id, entity_key, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, updated_at DESC NULLS LAST, entity_key) AS rank
  FROM fused JOIN asked USING (query_id) JOIN e_ ON e_.memory_space = grp AND e_.entity_key = doc_id WHERE score >= 0.01) WHERE rank <= 10"""
)
def r_entity_candidates(spark: SparkSession, d: str) -> DataFrame:
    asked = requests(spark, d)
    docs = b.entities(spark, d).select(F.col("memory_space").alias("grp"), F.col("entity_key").alias("doc_id"), text.identity_text(F.col("identity_profile")).alias("text"))
    fused = r.rrf([r.dense(r.hashed_vectors(asked), r.hashed_vectors(docs))]).join(asked.select("query_id", F.col("grp").alias("memory_space")), "query_id")
    return r.entity_candidates(fused.withColumnRenamed("doc_id", "entity_key"), b.entities(spark, d)).select("query_id", "entity_key", "rank")


_F = """SELECT draft_id, trim(regexp_replace(coalesce(who, ''), """ + _BLANK + """, ' ', 'g')) AS who_norm FROM d_"""


@query(over("d_") + _F)
def f_normalized(spark: SparkSession, d: str) -> DataFrame:
    return b.drafts(spark, d).select("draft_id", text.normalize_text(F.col("who")).alias("who_norm"))


@query(over("o_") + f"SELECT observation_id, array_to_string({_tokens('content')}, ' ') AS tokens FROM o_")
def f_tokens(spark: SparkSession, d: str) -> DataFrame:
    return b.observations(spark, d).select("observation_id", F.array_join(text.tokens(F.col("content")), " ").alias("tokens"))


@query(
    over("o_")
    + f""", t AS (SELECT observation_id, {_tokens("content")} AS a, {_tokens("summary")} AS b FROM o_),
x AS (SELECT observation_id, len(a) AS na, len(b) AS nb, list_sum([least(len(list_filter(a, lambda y: y = t)), len(list_filter(b, lambda y: y = t))) for t in list_distinct(a)]) AS c FROM t)
SELECT observation_id, CASE WHEN na > 0 AND nb > 0 THEN round(coalesce(c, 0) / sqrt(na * nb), 9) ELSE 0 END AS score FROM x"""
)
def f_overlap(spark: SparkSession, d: str) -> DataFrame:
    return b.observations(spark, d).select("observation_id", F.round(text.overlap_score(F.col("content"), F.col("summary")), 9).alias("score"))


@query(
    over("d_")
    + """SELECT draft_id, coalesce(nullif(trim(regexp_replace(coalesce(who, ''), """
    + _BLANK
    + """, ' ', 'g')), ''), list_filter(surface_forms, lambda x: trim(coalesce(x, ''), ' ') <> '')[1], 'Unknown') AS display_name FROM d_"""
)
def f_display_name(spark: SparkSession, d: str) -> DataFrame:
    return b.drafts(spark, d).select("draft_id", text.display_name(F.col("who"), F.col("surface_forms")).alias("display_name"))


@query(
    over("d_")
    + """, i AS (SELECT draft_id, p, trim(regexp_replace(coalesce(x, ''), """
    + _BLANK
    + """, ' ', 'g')) AS x FROM (SELECT draft_id, unnest(stable_qualifiers) AS x, generate_subscripts(stable_qualifiers, 1) AS p FROM d_)),
f AS (SELECT draft_id, lower(x) AS l, min(struct_pack(p := p, x := x)) AS s FROM i WHERE x <> '' GROUP BY 1, 2), g AS (SELECT draft_id, list(s.x ORDER BY s.p) AS xs FROM f GROUP BY 1)
SELECT draft_id, array_to_string(xs[:4], '|') AS qualifiers FROM g"""
)
def f_distinct_in_order(spark: SparkSession, d: str) -> DataFrame:
    out = b.drafts(spark, d).select("draft_id", text.distinct_in_order(F.col("stable_qualifiers"), 4).alias("q"))
    return out.where(F.size("q") > 0).select("draft_id", F.array_join("q", "|").alias("qualifiers"))
