"""Whole flows over the operators: resolving entities, refreshing profiles, applying merges, recall beyond the stored graph.

Each takes tables and the seam's adapter for what a model would judge, and returns the rows that it decides on; all requests of a
table go through it at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.checkpoints import materialise
from palimpsest.functions import text
from palimpsest.operators import graph, lookup, retrieval, workers, writepath
from palimpsest.operators.workers import Adapter

#: Memories whose summaries a linker and a profile writer see, and candidates that a linker is given.
LINKER_MEMORIES, PROFILE_MEMORIES, PROFILE_SUMMARIES, LINKER_CANDIDATES = 5, 10, 4, 10
#: Memories that a merge re-reads, texts and candidates of one dynamic step, its rounds, statuses that it may reach.
DYNAMIC_TEXTS, DYNAMIC_CANDIDATES, DYNAMIC_ROUNDS = 8, 14, 2
REACHABLE = ["active", "stale", "superseded"]
PROFILE = "struct<schema_version:int,who:string,surface_forms:array<string>,stable_qualifiers:array<string>,definition:string>"


def recent_summaries(memories: DataFrame, statuses: list[str], n: int, kept: int) -> DataFrame:
    """(memory_space, entity_key, summaries): of each entity's ``n`` newest memories in the statuses the first ``kept`` summaries."""
    recent = lookup.recent_per_key(memories.where(F.col("status").isin(statuses)), ["memory_space", "entity_key"], "updated_at", "memory_id", n)
    listed = recent.where(F.col("rank") <= kept).groupBy("memory_space", "entity_key").agg(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("summary", F.lit("")).alias("summary")))).alias("l"))
    return listed.select("memory_space", "entity_key", F.col("l")["summary"].alias("summaries"))


# --- resolving entities ----------------------------------------------------------------------------------------------------


def representatives(drafts: DataFrame, candidates: DataFrame) -> DataFrame:
    """(memory_space, request, draft_id, first_draft) of the drafts (memory_space, request, draft_id, who, surface_forms,
    stable_qualifiers) that a candidate memory (memory_space, request, owner_draft_id) refers to; others are not resolved.
    ``first_draft`` is the smallest draft of the request with the same identity, which is resolved for all of them."""
    owners = candidates.select("memory_space", "request", F.col("owner_draft_id").alias("draft_id")).distinct()
    kept = drafts.join(owners, ["memory_space", "request", "draft_id"], "left_semi")
    keyed = kept.select("memory_space", "request", "draft_id", text.identity_key(F.struct("who", "surface_forms", "stable_qualifiers")).alias("identity"))
    first = keyed.groupBy("memory_space", "request", "identity").agg(F.min("draft_id").alias("first_draft"))
    return keyed.join(first, ["memory_space", "request", "identity"]).select("memory_space", "request", "draft_id", "first_draft", "identity")


def entity_resolution(drafts: DataFrame, candidates: DataFrame, entities: DataFrame, memories: DataFrame, scored: Callable[[DataFrame], DataFrame], linker: Adapter) -> DataFrame:
    """(memory_space, request, draft_id, decision, entity_key): what becomes of every referenced draft.

    Drafts that say the same within a request are resolved once. A draft without any candidate entity makes a new one
    (``create_new``); others are put to the linker with their best candidates (``scored``: asked drafts to (query_id, entity_key,
    rank)), whose answer takes effect as ``workers.linked`` has it. Keys of new entities follow from space and identity.
    """
    known = materialise(representatives(drafts, candidates), "resolving")
    asked = known.where("draft_id = first_draft").join(drafts.select("memory_space", "request", "draft_id", "who", "surface_forms", "stable_qualifiers"), ["memory_space", "request", "draft_id"])
    found = scored(asked.select(F.col("draft_id").alias("query_id"), F.col("memory_space").alias("grp"), F.col("who").alias("text"))).where(F.col("rank") <= LINKER_CANDIDATES)
    about = asked.select("memory_space", "request", F.col("draft_id").alias("query_id"), F.struct("who", "surface_forms", "stable_qualifiers").alias("draft"))
    shown = found.join(about.select("query_id", "memory_space"), "query_id").join(entities.select("memory_space", "entity_key", "display_name", "identity_profile"), ["memory_space", "entity_key"])
    shown = shown.join(recent_summaries(memories, REACHABLE, LINKER_MEMORIES, LINKER_MEMORIES), ["memory_space", "entity_key"], "left")
    one = F.struct("rank", "entity_key", "display_name", "identity_profile", F.col("summaries").alias("recent_memory_summaries"))
    listed = shown.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("candidates"))  # at most LINKER_CANDIDATES
    payload = F.to_json(F.struct(F.lit("write").alias("mode"), "draft", "candidates"))
    asks = about.join(listed, "query_id").select("memory_space", "request", F.col("query_id").alias("draft_id"), F.col("candidates")["entity_key"].alias("keys"), payload.alias("payload"))
    told = workers.judged(asks, linker).withColumn("a", F.from_json("answer", "decision string, selected_entity_key string, ambiguous_entity_keys array<string>"))
    told = told.select("request", "draft_id", F.col("a.decision").alias("decision"), F.col("a.selected_entity_key").alias("selected"), F.col("a.ambiguous_entity_keys").alias("ambiguous"), "keys")
    answers = workers.linked(told, "write").select(F.col("draft_id").alias("first_draft"), F.col("decision").alias("said"), F.col("entity_key").alias("linked"))
    made = F.concat(F.lit("ent_"), F.substring(F.sha2(F.concat_ws("\x1f", "memory_space", "identity"), 256), 1, 32))
    out = known.join(answers, "first_draft", "left")
    links = (F.col("said") == "link_existing") & F.col("linked").isNotNull()
    decision = F.when(links, "link_existing").otherwise("create_new")
    return out.select("memory_space", "request", "draft_id", decision.alias("decision"), F.when(links, F.col("linked")).otherwise(made).alias("entity_key"))


# --- profiles --------------------------------------------------------------------------------------------------------------


def next_metadata(metadata: Column, previous: Column, proposed: Column, applied: Column, verdict: Column, request: Column) -> Column:
    """An entity's metadata (JSON) after a proposal: its profile state, and a history of the last ten proposals; the rest stays."""
    state = writepath.next_profile_state(metadata, verdict)
    safe = verdict["risk"] == "safe"
    entry = F.to_json(
        F.struct(
            state["profile_revision"].alias("revision"), previous.alias("previous_profile"), proposed.alias("proposed_profile"), applied.alias("applied_profile"),
            F.when(safe, "safe").otherwise(verdict["risk"]).alias("risk"), verdict["reason"].alias("reason"), request.alias("request_id"),
        )
    )
    old = F.from_json(F.coalesce(F.get_json_object(metadata, "$.profile_history"), F.lit("[]")), "array<variant>")
    history = writepath.with_history(old, F.parse_json(entry))
    return writepath.merged_json(metadata, F.to_json(F.struct(state.alias("profile_state"), history.alias("profile_history"))))


def refreshed_profiles(entities: DataFrame, memories: DataFrame, writer: Adapter, request: str, now: float) -> DataFrame:
    """(memory_space, entity_key, display_name, identity_profile, metadata, updated_at, refresh_status): every entity after its profile
    was written anew from its newest active memories. A proposal takes effect only if it is safe (``writepath.profile_risk``); else the
    profile stays, and the metadata, replaced as a whole, say why. An answer that is missing or not JSON is rejected."""
    summaries = recent_summaries(memories, ["active"], PROFILE_MEMORIES, PROFILE_SUMMARIES)
    e = entities.select("memory_space", "entity_key", "display_name", "identity_profile", "metadata").join(summaries, ["memory_space", "entity_key"], "left")
    asked = F.to_json(F.struct(F.col("identity_profile").alias("current_identity_profile"), F.col("display_name").alias("current_display_name"), F.coalesce("summaries", F.array().cast("array<string>")).alias("recent_memory_summaries")))
    told = workers.judged(e.withColumn("payload", asked).drop("summaries"), writer)
    raw = F.from_json("answer", PROFILE)
    cleaned = workers.clean_profile(raw).withField("schema_version", raw["schema_version"])
    told = told.withColumn("proposed", cleaned).withColumn("verdict", writepath.profile_risk(F.col("identity_profile"), F.col("proposed")))
    safe = F.col("verdict.risk") == "safe"
    profile = F.when(safe, F.col("proposed")).otherwise(F.col("identity_profile").cast(PROFILE))
    out = told.withColumn("profile", profile)
    name = F.coalesce(F.nullif(F.col("profile.who"), F.lit("")), F.col("display_name"))
    metadata = next_metadata(F.col("metadata"), F.col("identity_profile"), F.col("proposed"), F.col("profile"), F.col("verdict"), F.lit(request))
    return out.select(
        "memory_space", "entity_key", name.alias("display_name"), F.col("profile").alias("identity_profile"), metadata.alias("metadata"), F.lit(now).alias("updated_at"),
        F.when(safe, "applied").otherwise(F.col("verdict.risk")).alias("refresh_status"),
    )


# --- merges ----------------------------------------------------------------------------------------------------------------


def merge_judgements(merges: DataFrame, entities: DataFrame, memories: DataFrame, judge: Adapter) -> DataFrame:
    """(memory_space, source, target, at, survivor, merged, reason, proposed): the merges (memory_space, source, target, at, reason) of two
    different entities that both exist and that the judge lets through, with the one that survives (the target, unless the judge
    chooses the source) and the profile that it proposes (null for none)."""
    about = entities.select("memory_space", "entity_key", "display_name", "identity_profile").join(recent_summaries(memories, ["active"], LINKER_MEMORIES, LINKER_MEMORIES), ["memory_space", "entity_key"], "left")
    side = lambda end: about.select("memory_space", F.col("entity_key").alias(end), F.struct("entity_key", "display_name", "identity_profile", F.col("summaries").alias("active_memory_summaries")).alias(f"{end}_entity"))
    both = merges.where("source <> target").distinct().join(side("source"), ["memory_space", "source"]).join(side("target"), ["memory_space", "target"])
    asked = both.select("memory_space", "source", "target", "at", F.col("reason").alias("why"), F.to_json(F.struct("source_entity", "target_entity")).alias("payload"))
    told = workers.merge_verdicts(workers.judged(asked, judge)).where("decision = 'merge'")
    survivor = F.when(F.col("survivor_entity_key").isin(F.col("source"), F.col("target")), F.col("survivor_entity_key")).otherwise(F.col("target"))
    told = told.withColumn("survivor", survivor).withColumn("merged", F.when(survivor == F.col("target"), F.col("source")).otherwise(F.col("target")))
    return told.select("memory_space", "source", "target", "at", "survivor", "merged", F.coalesce(F.nullif(F.col("judged_reason"), F.lit("")), "why").alias("reason"), F.col("profile").alias("proposed"))


def applied_merges(merges: DataFrame, entities: DataFrame, memories: DataFrame, judge: Adapter, request: str, now: float) -> dict[str, DataFrame]:
    """The tables after all merges that the judge lets through: ``memories`` of merged entities belong to the last survivor of their
    chain, ``entities`` without the merged ones, whose survivors have the newest proposed profile if it is safe; ``log`` has a row
    (memory_space, source, target, survivor, reason) a merge, ``tasks`` a repair of each survivor's edges (memory_space, task_type,
    dedupe_key, priority), ``documents`` the index documents to delete (memory_space, ref_doc)."""
    judged = materialise(merge_judgements(merges, entities, memories, judge), "merges")
    pairs = judged.select("memory_space", F.col("merged").alias("source"), F.col("survivor").alias("target"), "at")
    final = materialise(writepath.survivors(pairs), "survivors")
    moved, left = writepath.repointed(memories, entities, final)
    ends = final.select("memory_space", F.col("survivor").alias("entity_key")).distinct()
    step = judged.join(final.withColumnsRenamed({"entity_key": "merged", "survivor": "last"}), ["memory_space", "merged"])
    newest = step.groupBy("memory_space", F.col("last").alias("entity_key")).agg(F.max_by(F.struct("proposed"), F.struct("at", "source", "target"))["proposed"].alias("proposed"))
    e = left.join(newest, ["memory_space", "entity_key"], "left").join(ends.withColumn("grew", F.lit(True)), ["memory_space", "entity_key"], "left")
    gate = writepath.profile_risk(F.col("identity_profile"), F.col("proposed"))
    missing = F.struct(F.lit("needs_identity_review").alias("risk"), F.lit("missing_merged_identity_profile").alias("reason"))
    verdict = F.when(F.col("proposed").isNull(), missing).otherwise(gate)
    e = e.withColumn("v", F.struct(verdict["risk"].alias("risk"), F.concat(F.lit("entity_merged:"), verdict["reason"]).alias("reason")))
    safe, grew = F.col("v.risk") == "safe", F.coalesce("grew", F.lit(False))
    e = e.withColumn("profile", F.when(grew & safe, F.col("proposed")).otherwise(F.col("identity_profile").cast(PROFILE)))
    metadata = next_metadata(F.col("metadata"), F.col("identity_profile"), F.col("proposed"), F.col("profile"), F.col("v"), F.lit(request))
    after = e.withColumns(
        {
            "display_name": F.when(grew, F.coalesce(F.nullif(F.col("profile.who"), F.lit("")), F.col("display_name"))).otherwise(F.col("display_name")),
            "metadata": F.when(grew, metadata).otherwise(F.col("metadata")),
            "updated_at": F.when(grew, F.lit(now)).otherwise(F.col("updated_at")),
        }
    ).withColumn("identity_profile", F.col("profile"))
    gone = final.select("memory_space", text.ref_doc("entity", F.col("memory_space"), F.col("entity_key")).alias("ref_doc"))
    tasks = ends.select("memory_space", F.lit("repair_memory_edges").alias("task_type"), F.concat(F.lit("repair_memory_edges:"), "entity_key").alias("dedupe_key"), F.lit(11).alias("priority"))
    return {"memories": moved, "entities": after.select(*entities.columns), "log": judged.select("memory_space", F.col("merged").alias("source"), F.col("survivor").alias("target"), "reason"), "tasks": tasks, "documents": gone}


# --- recall beyond the stored graph ----------------------------------------------------------------------------------------


def dynamic_texts(frontier: DataFrame, memories: DataFrame, edges: DataFrame, observations: DataFrame, asked: DataFrame | None = None, n: int = DYNAMIC_TEXTS) -> DataFrame:
    """(request, memory_space, position, text): at most ``n`` different texts that each request searches with: those of a query builder
    (``asked``: request, position, text), then the summaries (else contents) of its frontier memories (request, memory_space,
    memory_id), then those of the observations that these derive from; in the order of ids, white space and case aside."""
    own = frontier.select("request", "memory_space", "memory_id").distinct()
    body = lambda: F.coalesce(F.nullif(F.btrim("summary"), F.lit("")), F.col("content"))
    of_memories = own.join(memories.select("memory_space", "memory_id", body().alias("text")), ["memory_space", "memory_id"]).select("request", "memory_space", F.lit(1).alias("source"), F.col("memory_id").alias("at"), "text")
    derived = edges.where("edge_type = 'derived_from' AND to_kind = 'observation'").select("memory_space", F.col("from_id").alias("memory_id"), F.col("to_id").alias("observation_id"))
    seen = own.join(derived, ["memory_space", "memory_id"]).select("request", "memory_space", "observation_id").distinct()
    of_observations = seen.join(observations.select("memory_space", "observation_id", body().alias("text")), ["memory_space", "observation_id"]).select("request", "memory_space", F.lit(2).alias("source"), F.col("observation_id").alias("at"), "text")
    every = of_memories.unionByName(of_observations)
    if asked is not None:
        spaces = own.select("request", "memory_space").distinct()
        every = every.unionByName(asked.join(spaces, "request").select("request", "memory_space", F.lit(0).alias("source"), F.format_string("%09d", F.col("position").cast("long")).alias("at"), "text"))
    every = every.withColumn("text", text.normalize_text(F.col("text"))).where("text <> ''")
    first = every.groupBy("request", "memory_space", F.lower("text").alias("folded")).agg(F.min(F.struct("source", "at", "text")).alias("f"))
    order = Window.partitionBy("request").orderBy("f.source", "f.at", "folded")
    return first.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n).select("request", "memory_space", "position", F.col("f.text").alias("text"))


def dynamic_recall(held: DataFrame, memories: DataFrame, entities: DataFrame, edges: DataFrame, observations: DataFrame, judge: Callable[[DataFrame], DataFrame], rounds: int = DYNAMIC_ROUNDS) -> tuple[DataFrame, DataFrame]:
    """((request, memory_space, memory_id, round, place) of what every request holds in the end, (request, from_id, to_id, edge_type,
    weight) of the relations that led there): recall beyond stored edges, which stores nothing.

    In a round, the frontier (at first all that is held: request, memory_space, memory_id; then what the last round added) is turned
    into one query (``dynamic_texts``), which is searched by hybrid retrieval over the memories of the space that are not held yet;
    the best ones, as many as the budget leaves, are judged against the frontier. Judged relations are made as in a repair: too weak
    ones go, each frontier memory keeps its best ``related_to`` (ties by the candidate's rank), and what joins no frontier memory with a
    candidate goes. Candidates are added in the order of the relations until the budget is met.

    ``judge`` maps pairs (request, memory_space, memory_id, candidate_id, rank, left_text, right_text) to the same with edge_type and
    weight.
    """
    key = ["request", "memory_space"]
    now = materialise(held.select(*key, "memory_id").distinct().withColumns({"round": F.lit(0), "place": F.lit(0)}), "dynamic")
    frontier, made = now.select(*key, "memory_id"), None
    pool = retrieval.projections(memories.where(F.col("status").isin(REACHABLE)), entities).where("kind = 'memory'")
    pool = pool.select(F.col("memory_space").alias("grp"), F.col("key").alias("doc_id"), "text")
    pool = materialise(pool.join(now.select(F.col("memory_space").alias("grp")).distinct(), "grp", "left_semi"), "pool")
    # what is searched stays the same in all rounds
    words, vectors = materialise(retrieval.word_blocks(pool), "words"), materialise(retrieval.hashed_vectors(pool), "vectors")
    body = pool.select(F.col("grp").alias("memory_space"), F.col("doc_id").alias("memory_id"), "text")
    for n in range(1, rounds + 1):
        room = now.groupBy(*key).agg((graph.TOTAL - F.count("*")).alias("room")).where("room > 0")
        texts = dynamic_texts(frontier.join(room, key, "left_semi"), memories, edges, observations)
        corpus = texts.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list(F.struct("position", "text")))["text"], "\n").alias("text"))  # DYNAMIC_TEXTS rows
        asked = materialise(corpus.select(F.col("request").alias("query_id"), F.col("memory_space").alias("grp"), "text"), "asked")
        # lists are cut after what is held was taken out: a request holds at most TOTAL memories, which are ranked along
        deep = retrieval.OVERSAMPLE + graph.TOTAL
        mine = now.select(F.col("request").alias("query_id"), F.col("memory_id").alias("doc_id"))
        free = lambda scored: retrieval.ranked(scored.join(mine, ["query_id", "doc_id"], "left_anti").drop("rank"), retrieval.OVERSAMPLE)
        lists = [materialise(free(scored), "list") for scored in (retrieval.bm25_best(asked, words, deep), retrieval.dense(materialise(retrieval.hashed_vectors(asked), "vectors"), vectors, deep))]
        fused = retrieval.rrf(lists).join(asked.select("query_id", F.col("grp").alias("memory_space")), "query_id").withColumnRenamed("doc_id", "memory_id")
        found = retrieval.memory_candidates(fused, memories, DYNAMIC_CANDIDATES).withColumnRenamed("query_id", "request").join(room, "request").where(F.col("rank") <= F.col("room"))
        found = materialise(found.select(*key, F.col("memory_id").alias("candidate_id"), "rank", "room"), "candidates")
        pairs = frontier.join(found, key).join(body.withColumnRenamed("text", "left_text"), ["memory_space", "memory_id"])
        pairs = pairs.join(body.withColumnsRenamed({"memory_id": "candidate_id", "text": "right_text"}), ["memory_space", "candidate_id"])
        ends = judge(pairs).where((F.coalesce("weight", F.lit(0.0)) >= graph.LEAST_WEIGHT) & F.col("edge_type").isin(list(graph.BUDGETS)))
        best = Window.partitionBy("request", "memory_id").orderBy(F.desc("weight"), "rank", "candidate_id")
        related = F.col("edge_type") == "related_to"
        ends = ends.withColumn("__related", related).withColumn("__n", F.row_number().over(best.partitionBy("request", "memory_id", "__related"))).where(~related | (F.col("__n") == 1))
        new = materialise(ends.select(*key, F.col("memory_id").alias("from_id"), F.col("candidate_id").alias("to_id"), "edge_type", "weight", "rank", "room"), "relations")
        order = Window.partitionBy("request").orderBy("rank", "memory_id")
        added = new.groupBy(*key, F.col("to_id").alias("memory_id"), "room").agg(F.min("rank").alias("rank"))
        added = added.withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.col("room")).select(*key, "memory_id", F.lit(n).alias("round"), "place")
        now = materialise(now.unionByName(added), "dynamic")
        frontier = now.where(F.col("round") == n).select(*key, "memory_id")
        relations = new.select("request", "from_id", "to_id", "edge_type", "weight")
        made = relations if made is None else made.unionByName(relations)
    return now, made


def related_candidates(frontier: DataFrame, memories: DataFrame, entities: DataFrame, edges: DataFrame, observations: DataFrame, n: int = DYNAMIC_CANDIDATES) -> DataFrame:
    """(request, memory_space, candidate_id, rank): the ``n`` memories of other entities that fit best what each request's frontier
    (request, memory_space, anchor, memory_id) says: one query of its texts (see ``dynamic_texts``), searched by hybrid retrieval.
    Requests of an anchor that does not exist, and candidates of an entity that does not, are left out."""
    known = entities.select("memory_space", "entity_key")
    near = frontier.join(known.withColumnRenamed("entity_key", "anchor"), ["memory_space", "anchor"], "left_semi")
    texts = dynamic_texts(near, memories, edges, observations)
    corpus = texts.groupBy("request", "memory_space").agg(F.array_join(F.array_sort(F.collect_list(F.struct("position", "text")))["text"], "\n").alias("text"))  # DYNAMIC_TEXTS rows
    anchors = near.select("request", F.col("anchor").alias("own")).distinct()
    asked = materialise(corpus.join(anchors, "request").select(F.col("request").alias("query_id"), F.col("memory_space").alias("grp"), "text", "own"), "asked")
    owners = memories.where(F.col("status").isin(REACHABLE)).select(F.col("memory_space").alias("grp"), F.col("memory_id").alias("doc_id"), F.col("entity_key").alias("own"))
    pool = retrieval.projections(memories.where(F.col("status").isin(REACHABLE)), entities).where("kind = 'memory'").select(F.col("memory_space").alias("grp"), F.col("key").alias("doc_id"), "text")
    pool = materialise(pool.join(owners, ["grp", "doc_id"]), "pool")
    scored = retrieval.bm25(asked, pool).join(asked.select("query_id", "grp", F.col("own").alias("asks")), "query_id").join(owners, ["grp", "doc_id"])
    lexical = retrieval.ranked(scored.where(~F.col("own").eqNullSafe(F.col("asks"))).select("query_id", "doc_id", "score"), retrieval.OVERSAMPLE)
    dense = retrieval.dense(retrieval.hashed_vectors(asked), retrieval.hashed_vectors(pool))
    fused = retrieval.rrf([lexical, dense]).join(asked.select("query_id", F.col("grp").alias("memory_space")), "query_id").withColumnRenamed("doc_id", "memory_id")
    found = retrieval.memory_candidates(fused, memories, n).join(asked.select("query_id", F.col("grp").alias("memory_space")), "query_id")
    owned = memories.join(known, ["memory_space", "entity_key"], "left_semi").select("memory_space", "memory_id")
    return found.join(owned, ["memory_space", "memory_id"], "left_semi").select(F.col("query_id").alias("request"), "memory_space", F.col("memory_id").alias("candidate_id"), "rank")
