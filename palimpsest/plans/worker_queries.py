"""Queries of the work around judgements, and of the text functions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.functions.ids import clean_id
from palimpsest.operators import evals, retrieval, workers
from palimpsest.plans.views import ident, over
from palimpsest.plans.write_queries import _FOLD, _norm
from palimpsest.sources import bindings as b
from palimpsest.sources.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _items(c: str, n: int, lower: bool = True) -> str:
    """Items in order without blank ones and without those that an earlier one equals, case aside; the first n."""
    each = f"lower({_norm('x')})" if lower else _norm("x")
    clean = f"list_filter(list_transform(coalesce({c}, []), lambda x: {each}), lambda x: x <> '')"
    folded = f"list_transform({clean}, lambda x: lower(x))"
    return f"list_filter({clean}, lambda x, i: list_position({folded}, lower(x)) = i)[:{n}]"


# --- workers ---------------------------------------------------------------------------------------------------------------

_PROFILE = f"""struct_pack(schema_version := 2, who := lower({_norm("who")}), surface_forms := {_items("surface_forms", 3)}, stable_qualifiers := {_items("stable_qualifiers", 4)}, definition := lower({_norm("definition")}))"""


@query(over("d_") + f"SELECT draft_id, CAST(to_json(p) AS VARCHAR) AS profile FROM (SELECT draft_id, {_PROFILE} AS p FROM d_) WHERE p.who <> '' OR len(p.surface_forms) > 0")
def w_gated_drafts(spark: SparkSession, d: str) -> DataFrame:
    p = b.drafts(spark, d).select(F.col("observation_id").alias("request"), "draft_id", F.struct("who", "surface_forms", "stable_qualifiers", "definition").alias("profile"))
    return workers.gated(p).select("draft_id", F.to_json("profile").alias("profile"))


def _fold_names(p: str) -> str:
    return f"list_distinct(list_transform(list_filter(list_concat([{p}.who], coalesce({p}.surface_forms, [])), lambda x: trim(coalesce(x, ''), ' ') <> ''), lambda x: lower(trim(x, ' '))))"


@query(
    over("d_", "e_")
    + f""", a AS (SELECT draft_id, memory_space, unnest({_fold_names("d_")}) AS name FROM d_), k AS (SELECT memory_space, entity_key, unnest({_fold_names("identity_profile")}) AS name FROM e_)
SELECT draft_id AS query_id, min(entity_key) AS entity_key FROM a JOIN k USING (memory_space, name) GROUP BY 1 HAVING count(DISTINCT entity_key) = 1"""
)
def w_bound_entities(spark: SparkSession, d: str) -> DataFrame:
    """Drafts bound to the only entity of their space that they match by structure."""
    q = b.drafts(spark, d).select(F.col("draft_id").alias("query_id"), "memory_space", F.struct("who", "surface_forms", "stable_qualifiers").alias("draft"))
    e = b.entities(spark, d).select("memory_space", "entity_key", F.col("identity_profile").alias("profile"))
    fold = lambda c: F.explode(F.array_distinct(F.transform(F.filter(c, lambda x: F.btrim(x) != ""), lambda x: F.lower(F.btrim(x)))))
    names = lambda c: fold(F.concat(F.array(c["who"]), F.coalesce(c["surface_forms"], F.array().cast("array<string>"))))
    asked = q.select("query_id", "memory_space", "draft", names(F.col("draft")).alias("name"))
    known = e.select("memory_space", "entity_key", "profile", names(F.col("profile")).alias("name"))
    met = asked.join(known, ["memory_space", "name"]).where(workers.identity_matches(F.col("draft"), F.col("profile")))
    return workers.bound_entities(met.select("query_id", "entity_key").distinct())


_OBS = f"SELECT * REPLACE ({ident('observation_id')} AS observation_id) FROM d_"


@query(
    over("d_", "v_")
    + f""", dr AS ({_OBS}), s AS (SELECT observation_id, draft_id FROM dr WHERE observation_id IS NOT NULL AND (lower({_norm("who")}) <> '' OR len({_items("surface_forms", 3)}) > 0)),
c AS (SELECT version_id, trigger_observation_id AS request, (SELECT max(draft_id) FROM dr WHERE dr.observation_id = v_.trigger_observation_id) AS owner FROM v_)
SELECT version_id, owner FROM c WHERE EXISTS (SELECT 1 FROM s WHERE s.observation_id = c.request AND s.draft_id = c.owner)"""
)
def w_owned_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Every change as a candidate of the last draft of its observation; it stays if that draft passed the gate."""
    drafts = b.drafts(spark, d).withColumn("request", clean_id("observation_id")).where("request IS NOT NULL")
    last = drafts.groupBy("request").agg(F.max("draft_id").alias("owner_draft_id"))
    candidates = b.versions(spark, d).select("version_id", F.col("trigger_observation_id").alias("request")).join(last, "request")
    passed = workers.gated(drafts.select("request", "draft_id", F.struct("who", "surface_forms", "stable_qualifiers", "definition").alias("profile")))
    return workers.owned_candidates(candidates, passed).select("version_id", F.col("owner_draft_id").alias("owner"))


@query(
    over("d_", "e_")
    + f""", k AS (SELECT memory_space, list(entity_key ORDER BY entity_key)[:5] AS keys FROM e_ GROUP BY 1), a AS (SELECT draft_id, CAST('0x' || right(draft_id, 1) AS INT) % 4 AS n, keys FROM d_ JOIN k USING (memory_space))
SELECT draft_id, CASE WHEN n = 2 THEN 'create_new' WHEN n = 3 THEN 'ambiguous' ELSE 'link_existing' END AS decision, CASE WHEN n < 2 THEN keys[1] END AS entity_key, CASE WHEN n = 3 THEN array_to_string(keys[:2], ',') END AS ambiguous FROM a"""
)
def w_linked(spark: SparkSession, d: str) -> DataFrame:
    """Answers about the first five entities of a space: the first key, the first key without its last letter, an unknown key, or
    the first two keys (and one unknown) as ambiguous, by the draft's number."""
    w = Window.partitionBy("memory_space").orderBy("entity_key")
    first = b.entities(spark, d).select("memory_space", "entity_key").withColumn("n", F.row_number().over(w)).where("n <= 5")
    keys = first.groupBy("memory_space").agg(F.array_sort(F.collect_list("entity_key")).alias("keys"))
    n = F.conv(F.right("draft_id", F.lit(1)), 16, 10).cast("int") % 4
    a = b.drafts(spark, d).select("memory_space", "draft_id", n.alias("n")).join(keys, "memory_space")
    key = F.get("keys", F.lit(0))
    selected = F.when(F.col("n") == 0, key).when(F.col("n") == 1, F.expr("left(keys[0], length(keys[0]) - 1)")).when(F.col("n") == 2, F.lit("ent_of_nobody"))
    answers = a.select(
        F.col("memory_space").alias("request"), "draft_id", F.when(F.col("n") == 3, "ambiguous").otherwise("link_existing").alias("decision"), selected.alias("selected"),
        F.concat(F.slice("keys", 1, 2), F.array(F.lit("ent_of_nobody"))).alias("ambiguous"), "keys",
    )
    return workers.linked(answers, "write").select("draft_id", "decision", "entity_key", F.array_join("ambiguous", ",").alias("ambiguous"))


@query(
    over("v_", "m_")
    + """, refs AS (SELECT memory_space, memory_id FROM m_ WHERE status <> 'archived'),
o AS (SELECT v.memory_space, v.memory_id AS candidate_id, action, r.memory_id AS target, row_number() OVER (PARTITION BY v.memory_space, v.memory_id ORDER BY version_id DESC) AS n FROM v_ v LEFT JOIN refs r ON r.memory_space = v.memory_space AND r.memory_id = v.memory_id WHERE v.memory_id IS NOT NULL)
SELECT memory_space AS request, candidate_id, CASE WHEN action IN ('refresh', 'replace', 'stale') AND target IS NULL THEN 'create' ELSE action END AS action, target AS target_id FROM o WHERE n = 1"""
)
def w_resolved_outputs(spark: SparkSession, d: str) -> DataFrame:
    """The changes of a space as a resolver's outputs about its memories, of which those not archived have short references."""
    m = b.memories(spark, d).where("status <> 'archived'")
    targets = m.select(F.col("memory_space").alias("request"), "memory_id").withColumn("ref", F.concat(F.lit("m:"), "memory_id"))
    outputs = b.versions(spark, d).where("memory_id IS NOT NULL").select(F.col("memory_space").alias("request"), F.col("memory_id").alias("candidate_id"), F.col("version_id").alias("position"), "action", F.concat(F.lit("m:"), "memory_id").alias("target_ref"))
    return workers.resolved_outputs(outputs, outputs, targets)


_INTENTS = "CASE CAST('0x' || right(draft_id, 1) AS INT) % 5 WHEN 0 THEN ' Current ' WHEN 1 THEN 'LATEST' WHEN 2 THEN 'history' WHEN 3 THEN 'someday' END"


@query(
    over("d_")
    + f"""SELECT draft_id, {_norm("who")} AS query_text, array_to_string({_items("surface_forms", 3, False)}, '|') AS rewrites,
  CASE CAST('0x' || right(draft_id, 1) AS INT) % 5 WHEN 0 THEN 'current' WHEN 1 THEN 'latest' WHEN 2 THEN 'history' ELSE 'uncertain' END AS time_intent, lower({_norm("definition")}) AS definition FROM d_ WHERE {_norm("who")} <> ''"""
)
def w_planned(spark: SparkSession, d: str) -> DataFrame:
    """Every draft as a planned query for its name, with its surface forms as rewrites, and intents as models spell them."""
    n = F.conv(F.right("draft_id", F.lit(1)), 16, 10).cast("int") % 5
    intent = F.when(n == 0, " Current ").when(n == 1, "LATEST").when(n == 2, "history").when(n == 3, "someday")
    q = b.drafts(spark, d).select(
        "memory_space", "draft_id", F.col("who").alias("query_text"), F.struct("who", "surface_forms", "stable_qualifiers", "definition").alias("profile"), F.col("surface_forms").alias("rewrites"), intent.alias("time_intent")
    )
    return workers.planned(q).select("draft_id", "query_text", F.array_join("rewrites", "|").alias("rewrites"), "time_intent", F.col("profile.definition").alias("definition"))


@query(over("d_") + f"SELECT draft_id AS request, unnest({_items('list_concat(coalesce(stable_qualifiers, []), coalesce(surface_forms, []), [who])', 6, False)}) AS text FROM d_")
def w_cross_entity_texts(spark: SparkSession, d: str) -> DataFrame:
    none = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    texts = F.concat(none("stable_qualifiers"), none("surface_forms"), F.array("who"))
    return workers.cross_entity_texts(b.drafts(spark, d).select(F.col("draft_id").alias("request"), texts.alias("texts")))


@query(
    over("g_", "m_", "o_")
    + """, c AS (SELECT memory_space || '|' || to_id AS request, edge_id AS position, memory_space, CASE WHEN CAST('0x' || right(edge_id, 1) AS INT) % 2 = 0 THEN from_id END AS mid, to_id AS oid,
  CASE WHEN CAST('0x' || right(edge_id, 1) AS INT) % 3 = 0 THEN 'said' ELSE ' ' END AS summary FROM g_ WHERE edge_type = 'derived_from' AND to_kind = 'observation'),
der AS (SELECT request, list_sort(list(DISTINCT from_id)) AS ids FROM (SELECT memory_space || '|' || to_id AS request, from_id FROM g_ WHERE edge_type = 'derived_from' AND to_kind = 'observation') GROUP BY 1),
h AS (SELECT DISTINCT c.request, g.from_id AS memory_id, m.title, m.summary, m.content FROM c JOIN g_ g ON g.memory_space || '|' || g.to_id = c.request AND g.edge_type = 'derived_from' AND g.to_kind = 'observation' JOIN m_ m ON m.memory_space = g.memory_space AND m.memory_id = g.from_id),
x AS (SELECT c.request, c.position, CASE WHEN o.observation_id IS NOT NULL THEN c.oid END AS observation_id, coalesce(own.memory_id, CASE WHEN o.observation_id IS NOT NULL THEN der.ids[1] END) AS memory_id, c.summary AS said, o.summary AS os, o.content AS oc
  FROM c LEFT JOIN o_ o ON o.memory_space = c.memory_space AND o.observation_id = c.oid LEFT JOIN der ON der.request = c.request LEFT JOIN h own ON own.request = c.request AND own.memory_id = c.mid),
y AS (SELECT x.*, coalesce(nullif(trim(said, ' '), ''), nullif(trim(os, ' '), ''), nullif(trim(h.summary, ' '), ''), nullif(trim(h.title, ' '), ''), '') AS summary, coalesce(nullif(trim(os, ' '), ''), nullif(trim(oc, ' '), ''), nullif(trim(h.summary, ' '), ''), nullif(trim(h.content, ' '), ''), '') AS excerpt
  FROM x LEFT JOIN h ON h.request = x.request AND h.memory_id = x.memory_id WHERE x.memory_id IS NOT NULL OR observation_id IS NOT NULL)
SELECT request, position, memory_id, observation_id, summary, excerpt FROM (SELECT *, row_number() OVER (PARTITION BY request, memory_id, observation_id, excerpt ORDER BY position) AS n FROM y) WHERE n = 1"""
)
def w_citations(spark: SparkSession, d: str) -> DataFrame:
    """Every observation as a request about it, which cites it once for each memory that derives from it; half of the citations
    name no memory, two thirds bring no text."""
    derived = b.edges(spark, d).where("edge_type = 'derived_from' AND to_kind = 'observation'").withColumn("request", F.concat_ws("|", "memory_space", "to_id"))
    n = F.conv(F.right("edge_id", F.lit(1)), 16, 10).cast("int")
    cited = derived.select(
        "request", F.col("edge_id").alias("position"), F.when(n % 2 == 0, F.col("from_id")).alias("memory_id"), F.col("to_id").alias("observation_id"),
        F.when(n % 3 == 0, "said").otherwise(" ").alias("summary"), F.lit("").alias("excerpt"),
    )
    ends = derived.select("request", "memory_space", "from_id", "to_id").distinct()
    memories = ends.join(b.memories(spark, d).withColumnRenamed("memory_id", "from_id"), ["memory_space", "from_id"]).select("request", F.col("from_id").alias("memory_id"), "title", "summary", "content").distinct()
    observations = ends.join(b.observations(spark, d).withColumnRenamed("observation_id", "to_id"), ["memory_space", "to_id"]).select("request", F.col("to_id").alias("observation_id"), "summary", "content").distinct()
    whose = derived.groupBy("request", F.col("to_id").alias("observation_id")).agg(F.array_sort(F.collect_set("from_id")).alias("memory_ids"))
    return workers.citations(cited, memories, observations, whose)


def rule_answers(asked: list[str]) -> list[str | None]:
    """A stand-in for composer and answer judge: the first summary as the answer; a verdict by its length, one without a word, and
    some that are no JSON."""
    out: list[str | None] = []
    for p in map(json.loads, asked):
        n = len(p["summary"])
        verdict = ["pass", "partial", "fail", "maybe"][n % 4]
        cited = [{"memory_id": p["id"], "observation_id": None, "summary": p["summary"], "excerpt": ""}] * (n % 2)
        out.append("not json" if n % 7 == 0 else json.dumps({"answer": p["summary"], "uncertainties": ["u"] * (n % 3), "citations": cited, "verdict": verdict} | ({"grounded": n % 5 > 0} if n % 3 else {})))
    return out


def _answered(spark: SparkSession, d: str) -> DataFrame:
    m = b.memories(spark, d).select(F.concat_ws("|", "memory_space", "memory_id").alias("request"), F.to_json(F.struct(F.col("memory_id").alias("id"), F.coalesce("summary", F.lit("")).alias("summary"))).alias("payload"))
    return workers.judged(m, rule_answers)


_N = "n AS (SELECT memory_space || '|' || memory_id AS request, memory_id, coalesce(summary, '') AS s, length(coalesce(summary, '')) AS n FROM m_)"


@query(
    over("m_")
    + f""", {_N}, v AS (SELECT *, CASE WHEN n % 7 <> 0 AND n % 4 < 3 THEN ['pass', 'partial', 'fail'][n % 4 + 1] END AS verdict FROM n)
SELECT request, verdict, CASE WHEN verdict IS NOT NULL THEN CASE WHEN n % 3 = 0 THEN true ELSE n % 5 > 0 END END AS grounded FROM v"""
)
def w_answer_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return workers.answer_verdicts(_answered(spark, d)).select("request", "verdict", "grounded")


@query(
    over("m_")
    + f""", {_N} SELECT request, CASE WHEN n % 7 = 0 THEN '' ELSE s END AS answer, CASE WHEN n % 7 = 0 THEN 0 ELSE n % 3 END AS n_uncertainties, CASE WHEN n % 7 <> 0 AND n % 2 = 1 THEN memory_id END AS cited FROM n"""
)
def w_composed_answers(spark: SparkSession, d: str) -> DataFrame:
    whole, cited = workers.composed_answers(_answered(spark, d))
    cited = cited.where("position = 0").select("request", F.col("memory_id").alias("cited"))
    return whole.join(cited, "request", "left").select("request", "answer", F.size("uncertainties").alias("n_uncertainties"), "cited")


_PATHS = [
    ("prompt_tokens", "p"), ("input_tokens", "p"), ("completion_tokens", "c"), ("output_tokens", "c"), ("prompt_cache_hit_tokens", "h"), ("prompt_tokens_details.cached_tokens", "h"), ("prompt_tokens_details.cache_read", "h"),
    ("input_token_details.cached_tokens", "h"), ("input_token_details.cache_read", "h"), ("prompt_cache_miss_tokens", "m"), ("prompt_tokens_details.cache_miss", "m"), ("prompt_tokens_details.cache_write", "m"),
    ("input_token_details.cache_miss", "m"), ("input_token_details.cache_write", "m"), ("completion_tokens_details.reasoning_tokens", "r"), ("output_token_details.reasoning_tokens", "r"),
]


@query(
    """WITH e AS (SELECT event_id, CAST(props->>'$.k' AS INT) AS k FROM events), w AS (SELECT event_id, k, event_id % 16 AS p FROM e)
SELECT event_id, CASE WHEN p IN (0, 1) THEN k END AS input_tokens, CASE WHEN p IN (2, 3) THEN k END AS output_tokens, CASE WHEN p BETWEEN 4 AND 8 THEN k END AS cached_tokens,
  CASE WHEN p BETWEEN 9 AND 13 OR p IN (0, 1) THEN k END AS cache_miss_tokens, CASE WHEN p >= 14 THEN k END AS reasoning_tokens FROM w"""
)
def w_usage_paths(spark: SparkSession, d: str) -> DataFrame:
    """Usage records of one number each, in each of the places where providers put one in turn."""
    k = F.get_json_object("props", "$.k")
    said = F.lit(None).cast("string")
    for i, (path, _) in enumerate(_PATHS):
        outer, _, inner = path.partition(".")
        record = F.concat(F.lit(f'{{"{outer}":'), F.concat(F.lit(f'{{"{inner}":'), k, F.lit("}")) if inner else k, F.lit("}"))
        said = F.when(F.col("event_id") % len(_PATHS) == i, record).otherwise(said)
    out = table(spark, d, "events").select("event_id", workers.usage_tokens(said).alias("u")).select("event_id", "u.*")
    return out.withColumn("cache_miss_tokens", F.when(F.col("input_tokens").isNotNull() | (F.col("event_id") % 16).between(9, 13), F.col("cache_miss_tokens")))


# --- text functions --------------------------------------------------------------------------------------------------------


@query(
    over("d_")
    + f""", t AS (SELECT draft_id, replace(lower({_norm("who")}), ' ', '') AS a, replace(lower({_norm("surface_forms[1]")}), ' ', '') AS b FROM d_),
g AS (SELECT *, [a[i:i+1] for i in range(1, length(a))] AS ga, [b[i:i+1] for i in range(1, length(b))] AS gb FROM t),
c AS (SELECT *, list_sum([least(len(list_filter(ga, lambda y: y = x)), len(list_filter(gb, lambda y: y = x))) for x in list_distinct(ga)]) AS c FROM g)
SELECT draft_id, CASE WHEN a = '' OR b = '' THEN 0 WHEN length(a) < 2 OR length(b) < 2 THEN CASE WHEN a = b THEN 1 ELSE NULL END ELSE round(coalesce(c, 0) / sqrt(len(ga) * len(gb)), 9) END AS score FROM c"""
)
def f_chargrams(spark: SparkSession, d: str) -> DataFrame:
    who, form = F.col("who"), F.get("surface_forms", F.lit(0))
    plain = lambda c: F.replace(F.lower(text.normalize_text(c)), F.lit(" "), F.lit(""))
    short = (F.length(plain(who)) == 1) | (F.length(plain(form)) == 1)  # compared by words, see f_overlap
    score = F.round(text.chargram_score(who, form), 9)
    return b.drafts(spark, d).select("draft_id", F.when(short & (plain(who) != plain(form)) & (plain(who) != "") & (plain(form) != ""), F.lit(None)).otherwise(score).alias("score"))


_WORDS = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{M}}\p{{N}}_\x{{4e00}}-\x{{9fff}}]+')"


@query(
    over("m_")
    + f""", t AS (SELECT memory_id, memory_space, {_WORDS.format("title")} AS a, {_WORDS.format("content")} AS b FROM m_),
c AS (SELECT *, list_sum([least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))) for x in list_distinct(a)]) AS c FROM t)
SELECT memory_space, memory_id, CASE WHEN len(a) > 0 AND len(b) > 0 THEN round(coalesce(c, 0) / len(a), 9) ELSE 0 END AS score FROM c"""
)
def f_query_coverage(spark: SparkSession, d: str) -> DataFrame:
    return b.memories(spark, d).select("memory_space", "memory_id", F.round(text.query_coverage(F.col("title"), F.col("content")), 9).alias("score"))


@query()
def f_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Fragments of all observations, with the one that says most of the summary."""
    o = b.observations(spark, d).select("observation_id", "summary", F.explode(text.fragments(F.col("content"))).alias("f"))
    best = text.query_coverage(F.col("summary"), F.col("f.text"))
    first = F.row_number().over(Window.partitionBy("observation_id").orderBy(F.desc(best), "f.ordinal"))
    return o.withColumn("nth", first).select("observation_id", "f.*", (F.col("nth") == 1).alias("best"))


@query(
    over("m_")
    + """, c AS (SELECT memory_space || '|' || entity_key AS query_id, memory_id, status, CASE WHEN memory_space LIKE 'team:%' THEN 'history' WHEN memory_space LIKE 'user:%' THEN 'latest' ELSE 'current' END AS t FROM m_),
l AS (SELECT *, bool_or(coalesce(status = 'active', false)) OVER (PARTITION BY query_id) AS live FROM c) SELECT query_id, memory_id FROM l WHERE NOT (t IN ('current', 'latest') AND live AND coalesce(status <> 'active', false))"""
)
def f_intended_seeds(spark: SparkSession, d: str) -> DataFrame:
    intent = F.when(F.col("memory_space").startswith("team:"), "history").when(F.col("memory_space").startswith("user:"), "latest").otherwise("current")
    c = b.memories(spark, d).select(F.concat_ws("|", "memory_space", "entity_key").alias("query_id"), "memory_id", "status", intent.alias("time_intent"))
    return retrieval.intended_seeds(c).select("query_id", "memory_id")


@query(
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN memory_space || ':r' || (doc_id % 7) || ':' || doc_id ELSE memory_space || ':' || coalesce(source, '?') || ':exec:x' || doc_id END AS scope FROM documents WHERE memory_space IS NOT NULL"""
)
def f_scopes(spark: SparkSession, d: str) -> DataFrame:
    template = F.when(F.col("doc_id") % 2 == 0, F.concat("memory_space", F.lit(":{run_id}:{execution_id}"))).otherwise(F.concat("memory_space", F.lit(":{scope_alias}")))
    ident_ = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")).otherwise(F.concat(F.lit("x"), F.col("doc_id").cast("string")))
    scope = text.rendered_scope(template, F.concat(F.lit("r"), (F.col("doc_id") % 7).cast("string")), ident_, F.lit("case"), F.coalesce("source", F.lit("?")))
    return table(spark, d, "documents").where("memory_space IS NOT NULL").select("doc_id", scope.alias("scope"))


@query(over("m_") + "SELECT memory_space, memory_id, array_to_string(list_filter([trim(title, ' '), trim(summary, ' ')], lambda x: coalesce(x, '') <> ''), '|') AS variants FROM m_")
def f_fact_variants(spark: SparkSession, d: str) -> DataFrame:
    fact = F.concat_ws("||", "title", F.lit(" "), "summary", F.lit(""))
    return b.memories(spark, d).select("memory_space", "memory_id", F.array_join(text.fact_variants(fact), "|").alias("variants"))


@query(over("m_") + """SELECT memory_space, memory_id, CAST(json_object('confidence', confidence > 0.5, 'status', status, 'title', title) AS VARCHAR) AS stable FROM m_ WHERE title IS NOT NULL AND status IS NOT NULL AND confidence IS NOT NULL""")
def f_stable_json(spark: SparkSession, d: str) -> DataFrame:
    m = b.memories(spark, d).where("title IS NOT NULL AND status IS NOT NULL AND confidence IS NOT NULL")
    return m.select("memory_space", "memory_id", text.stable_json({"title": F.col("title"), "status": F.col("status"), "confidence": F.col("confidence") > 0.5}).alias("stable"))


@query(
    over("d_")
    + """, a AS (SELECT draft_id, list_filter(list_concat(coalesce(surface_forms, []), coalesce(stable_qualifiers, [])), lambda x: x <> '') AS xs FROM d_)
SELECT draft_id, array_to_string(list_filter(xs, lambda x, i: list_position(xs, x) = i), '|') AS merged, array_to_string(list_filter(xs, lambda x, i: list_position(xs, x) = i)[:2], '|') AS bounded FROM a"""
)
def f_merged_uncertainties(spark: SparkSession, d: str) -> DataFrame:
    none = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    both = F.concat(none("surface_forms"), none("stable_qualifiers"))
    return b.drafts(spark, d).select("draft_id", F.array_join(text.merged_uncertainties(F.col("surface_forms"), F.col("stable_qualifiers")), "|").alias("merged"), F.array_join(text.bounded_unique(both, 2), "|").alias("bounded"))


@query(over("d_") + f"SELECT draft_id, CASE WHEN coalesce({_INTENTS}, '') = '' THEN 'uncertain' WHEN lower(trim({_INTENTS}, ' ')) IN ('current', 'latest', 'history') THEN lower(trim({_INTENTS}, ' ')) ELSE 'uncertain' END AS time_intent, CASE WHEN right(draft_id, 1) = 'a' THEN 'cross_entity' ELSE 'entity_local' END AS graph_intent FROM d_")
def f_intents(spark: SparkSession, d: str) -> DataFrame:
    n = F.conv(F.right("draft_id", F.lit(1)), 16, 10).cast("int") % 5
    time = F.when(n == 0, " Current ").when(n == 1, "LATEST").when(n == 2, "history").when(n == 3, "someday")
    graph = F.when(F.right("draft_id", F.lit(1)) == "a", " Cross_Entity").when(n == 1, "everything")
    return b.drafts(spark, d).select("draft_id", text.time_intent(time).alias("time_intent"), text.graph_intent(graph).alias("graph_intent"))


# --- grading ---------------------------------------------------------------------------------------------------------------


@query(
    over("m_")
    + """, t AS (SELECT memory_space, string_agg(concat_ws(chr(10), title, summary, content), chr(10)) AS blob FROM m_ GROUP BY 1),
x AS (SELECT memory_space, min(title) AS must, max(title) AS may_not FROM m_ GROUP BY 1), e AS (SELECT memory_space, must AS fragment, true AS required FROM x UNION ALL SELECT memory_space, 'no such text', true FROM x UNION ALL SELECT memory_space, may_not, false FROM x UNION ALL SELECT memory_space, 'nor such a one', false FROM x)
SELECT memory_space AS case_id, CASE WHEN required THEN 'missing memory text ' ELSE 'forbidden memory text ' END || fragment AS failure FROM e JOIN t USING (memory_space) WHERE fragment <> '' AND required <> contains(blob, fragment)"""
)
def e_text_failures(spark: SparkSession, d: str) -> DataFrame:
    """Every space is to have its first title and one that nobody has, and not to have its last title nor one that nobody has."""
    m = b.memories(spark, d)
    x = m.groupBy("memory_space").agg(F.min("title").alias("must"), F.max("title").alias("may_not"))
    e = F.array(*[F.struct(f.alias("fragment"), F.lit(r).alias("required")) for f, r in ((F.col("must"), True), (F.lit("no such text"), True), (F.col("may_not"), False), (F.lit("nor such a one"), False))])
    expected = x.select(F.col("memory_space").alias("case_id"), F.lit("primary").alias("scope"), "memory_space", F.explode(e).alias("e")).select("case_id", "scope", "memory_space", "e.*")
    return evals.text_failures(expected, m).select("case_id", "failure")


@query(
    over("tasks_", "audits_")
    + """, s AS (SELECT DISTINCT memory_space FROM tasks_), dead AS (SELECT DISTINCT memory_space FROM tasks_ WHERE status = 'dead_letter'), ok AS (SELECT DISTINCT memory_space FROM audits_ WHERE status = 'rejected'),
f AS (SELECT memory_space AS case_id, CASE WHEN ok.memory_space IS NULL THEN 'missing snapshot' ELSE 'has dead_letter tasks' END AS failure FROM s LEFT JOIN ok USING (memory_space) LEFT JOIN dead USING (memory_space) WHERE ok.memory_space IS NULL OR dead.memory_space IS NOT NULL)
SELECT failure, count(DISTINCT case_id) AS n, array_to_string(list(DISTINCT case_id ORDER BY case_id)[:10], ',') AS case_ids FROM f GROUP BY 1"""
)
def e_failure_index(spark: SparkSession, d: str) -> DataFrame:
    """Spaces with tasks as cases; those that an audit rejected have a snapshot."""
    t = b.tasks(spark, d)
    expected = t.select(F.col("memory_space").alias("case_id"), F.lit("primary").alias("scope"), "memory_space").distinct()
    failures = evals.state_failures(expected, b.recall_audits(spark, d).where("status = 'rejected'"), t)
    return evals.failure_index(failures).withColumn("case_ids", F.array_join("case_ids", ","))


@query(
    over("audits_")
    + """, r AS (SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY audit_id) AS position, status FROM audits_), g AS (SELECT request_id, count(*) AS got, CAST(right(request_id, 1) AS INT) % 4 AS want FROM audits_ GROUP BY 1)
SELECT request_id AS query_id, 'expected ' || want || ' recall results, got ' || got AS failure FROM g WHERE want > 0 AND want <> got
UNION ALL SELECT request_id, 'result[' || position || '] expected status ok, got ' || status FROM r WHERE status <> 'ok' AND CAST(right(request_id, 1) AS INT) % 4 > 0"""
)
def e_result_failures(spark: SparkSession, d: str) -> DataFrame:
    a = b.recall_audits(spark, d)
    r = a.select(F.col("request_id").alias("query_id"), F.row_number().over(Window.partitionBy("request_id").orderBy("audit_id")).alias("position"), "status")
    want = F.right("request_id", F.lit(1)).cast("int") % 4
    expected = a.select(F.col("request_id").alias("query_id"), F.lit("ok").alias("expected_status"), F.when(want > 0, want).alias("expected_result_count")).distinct()
    return evals.result_failures(r, expected)


@query(
    over("audits_")
    + """, la AS (SELECT memory_space, query, max(struct_pack(c := created_at, a := audit_id, s := status, e := error_code)) AS x FROM audits_ GROUP BY 1, 2),
q AS (SELECT a.*, CAST(replace(a.query, 'query ', '') AS INT) AS n, x FROM audits_ a LEFT JOIN la ON la.memory_space = a.memory_space AND la.query = a.query AND a.status <> 'not_ready')
SELECT audit_id, array_to_string(list_filter([CASE WHEN status <> 'ok' THEN 'status' END, CASE WHEN error_code IS NOT NULL THEN 'error_code' END, CASE WHEN n % 3 = 0 THEN 'empty answer' END, CASE WHEN n % 4 < 2 THEN 'citations below minimum' END,
  CASE WHEN n % 5 = 0 THEN 'missing uncertainty' END, CASE WHEN n % 2 = 0 AND n % 6 <> 2 THEN 'result count' END, CASE WHEN x IS NULL THEN 'missing audit' END, CASE WHEN x.s <> status THEN 'audit status' END,
  CASE WHEN x IS NOT NULL AND x.e IS DISTINCT FROM error_code THEN 'audit error code' END], lambda v: v IS NOT NULL), '|') AS failures FROM q"""
)
def e_query_checks(spark: SparkSession, d: str) -> DataFrame:
    """Recall requests as answered queries whose answers, citations, uncertainties and numbers of results follow from the number of the
    query, so that every check fails for some and passes for others."""
    a = b.recall_audits(spark, d).withColumn("n", F.replace("query", F.lit("query "), F.lit("")).cast("int"))
    last = a.groupBy("memory_space", "query").agg(F.max(F.struct("created_at", "audit_id", "status", "error_code")).alias("x"))
    audited = a.where("status <> 'not_ready'").join(last, ["memory_space", "query"]).select("audit_id", "x")
    n, strings = F.col("n"), "array<string>"
    r = a.join(audited, "audit_id", "left").select(
        "audit_id", "status", "error_code", F.when(n % 3 == 0, " ").otherwise("said").alias("answer"), (n % 4).alias("n_citations"), F.array(F.lit("old:x"), F.lit("contradicting_memory:m1")).alias("uncertainties"), (n % 6).alias("n_results"),
        F.lit("ok").alias("expected_status"), F.lit(None).cast("string").alias("expected_error_code"), F.lit(True).alias("non_empty_answer"), F.lit(2).alias("citations_min"),
        F.when(n % 5 == 0, F.array(F.lit("contradicting_memory:"), F.lit("gone:"))).otherwise(F.array(F.lit("contradicting_memory:")).cast(strings)).alias("required_prefixes"), F.when(n % 2 == 0, 2).alias("expected_result_count"),
        F.col("x.status").alias("audit_status"), F.col("x.error_code").alias("audit_error_code"),
    )
    return evals.query_failures(r).select("audit_id", F.array_join("failures", "|").alias("failures"))


@query(over("tasks_", "audits_") + ", failed AS (SELECT DISTINCT memory_space FROM audits_ WHERE status = 'rejected') SELECT DISTINCT memory_space AS suite_id FROM tasks_ SEMI JOIN failed USING (memory_space) WHERE memory_space LIKE '%1'")
def e_chosen_suites(spark: SparkSession, d: str) -> DataFrame:
    suites = b.tasks(spark, d).select(F.col("memory_space").alias("suite_id")).distinct()
    failed = b.recall_audits(spark, d).where("status = 'rejected'").select(F.col("memory_space").alias("suite_id"))
    return evals.chosen_suites(suites, suites.where("suite_id LIKE '%1'"), failed)


@query(
    over("d_", "e_")
    + f""", x AS (SELECT draft_id, entity_key, {_FOLD.format(_norm("who"))} AS who, list_transform(coalesce(surface_forms, []), lambda x: {_FOLD.format(_norm("x"))}) AS forms, {_FOLD.format(_norm("e.identity_profile.who"))} AS want, list_transform(coalesce(e.identity_profile.surface_forms, []), lambda x: {_FOLD.format(_norm("x"))}) AS want_forms
  FROM d_ JOIN e_ e ON e.memory_space = d_.memory_space AND lower({_norm("surface_forms[1]")}) = e.identity_profile.who)
SELECT draft_id, entity_key, who = want AND (len(want_forms) = 0 OR list_has_any(want_forms, forms)) AS matched FROM x"""
)
def e_identity_scores(spark: SparkSession, d: str) -> DataFrame:
    """Drafts scored against the profile of the entity that their first surface form names."""
    e = b.entities(spark, d).select("memory_space", "entity_key", F.col("identity_profile.who").alias("match"), "identity_profile")
    p = b.drafts(spark, d).select("memory_space", "draft_id", F.lower(text.normalize_text(F.get("surface_forms", F.lit(0)))).alias("match"), F.struct("who", "surface_forms", "stable_qualifiers").alias("found"))
    none: Column = F.array().cast("array<string>")
    want = F.struct(F.array("identity_profile.who").alias("who_any"), F.col("identity_profile.surface_forms").alias("forms_any"), none.alias("forms_all"), none.alias("qualifiers_any"), none.alias("qualifiers_all"))
    return p.join(e, ["memory_space", "match"]).select("draft_id", "entity_key", evals.identity_score(F.col("found"), want).alias("matched"))


def _folded(c: str) -> str:
    return f"list_transform(coalesce({c}, []), lambda x: {_FOLD.format(_norm('x'))})"


@query(
    over("d_", "e_")
    + f""", x AS (SELECT draft_id, entity_key, CAST('0x' || right(draft_id, 1) AS INT) AS n, {_FOLD.format(_norm("who"))} AS who, {_folded("surface_forms")} AS forms, {_folded("stable_qualifiers")} AS quals, {_FOLD.format(_norm("d_.definition"))} AS said,
  {_folded("e.identity_profile.surface_forms")} AS want_forms, {_folded("e.identity_profile.stable_qualifiers")} AS want_quals, {_FOLD.format(_norm("e.identity_profile.who"))} AS name
  FROM d_ JOIN e_ e ON e.memory_space = d_.memory_space AND lower({_norm("surface_forms[1]")}) = e.identity_profile.who),
y AS (SELECT *, n % 2 = 0 AS req, n % 2 = 0 AND said = '' AS lacking FROM x)
SELECT draft_id, entity_key, array_to_string(list_filter([CASE WHEN len(want_forms) > 0 AND NOT list_has_any(want_forms, forms) THEN 'surface_forms: none expected' END,
  CASE WHEN n % 3 = 0 AND len(list_filter(want_forms, lambda v: NOT list_contains(forms, v))) > 0 THEN 'surface_forms: missing' END, CASE WHEN n % 3 = 0 AND len(want_forms) > 0 AND len(list_filter(forms, lambda v: NOT list_contains(want_forms, v))) > 0 THEN 'surface_forms: unexpected' END,
  CASE WHEN len(want_quals) > 0 AND NOT list_has_any(want_quals, quals) THEN 'stable_qualifiers: none expected' END, CASE WHEN n % 5 = 0 AND len(list_filter(want_quals, lambda v: NOT list_contains(quals, v))) > 0 THEN 'stable_qualifiers: missing' END,
  CASE WHEN lacking THEN 'definition: required' END, CASE WHEN req AND who <> '' AND said <> '' AND said = who THEN 'definition: repeats the name' END, CASE WHEN NOT lacking AND NOT contains(said, 'someone') AND NOT contains(said, 'organisation') THEN 'definition: none expected' END,
  CASE WHEN NOT lacking AND n % 4 = 0 AND NOT contains(said, name) THEN 'definition: missing' END, CASE WHEN NOT lacking AND said <> '' AND n % 7 IN (0, 1) THEN 'definition: judged' END], lambda v: v IS NOT NULL), '|') AS failures FROM y"""
)
def e_identity_failures(spark: SparkSession, d: str) -> DataFrame:
    """Drafts against the profile of the entity that their first surface form names; what is expected, and how a judge finds the
    definition, follows from the draft's number."""
    e = b.entities(spark, d).select("memory_space", "entity_key", F.col("identity_profile.who").alias("match"), "identity_profile")
    n = F.conv(F.right("draft_id", F.lit(1)), 16, 10).cast("int")
    p = b.drafts(spark, d).select("memory_space", "draft_id", n.alias("n"), F.lower(text.normalize_text(F.get("surface_forms", F.lit(0)))).alias("match"), F.struct("who", "surface_forms", "stable_qualifiers", "definition").alias("found"))
    forms, qualifiers = F.col("identity_profile.surface_forms"), F.col("identity_profile.stable_qualifiers")
    want = F.struct(
        forms.alias("forms_any"), F.when(F.col("n") % 3 == 0, forms).alias("forms_all"), qualifiers.alias("qualifiers_any"), F.when(F.col("n") % 5 == 0, qualifiers).alias("qualifiers_all"), (F.col("n") % 2 == 0).alias("definition_required"),
        F.array(F.lit("Someone"), F.lit("organisation")).alias("definition_any"), F.when(F.col("n") % 4 == 0, F.array("match")).alias("definition_all"),
    )
    verdict = F.when(F.col("n") % 7 == 0, "fail").when(F.col("n") % 7 == 1, "unsure").when(F.col("n") % 7 < 5, "pass")
    out = p.join(e, ["memory_space", "match"])
    return out.select("draft_id", "entity_key", F.array_join(evals.identity_failures(F.col("found"), want, verdict), "|").alias("failures"))
