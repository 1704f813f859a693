"""Writing observations, entities, memories and their versions as set-based changes of snapshots.

Parquet snapshots are replaced, not updated: each function takes the tables before and returns rows or tables after. ``now`` and new
ids are parameters or follow from the input, so a change that is applied again gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.checkpoints import forget, materialise
from palimpsest.functions import text

SUMMARY_CHARS, HISTORY = 500, 10
DAY = 86_400.0


def merged_json(old: Column, new: Column) -> Column:
    """Two JSON objects merged on their top level, the new one winning; null, blank or broken ones count as empty. Keys come in
    the order old, new, as JSON text."""
    parsed = lambda c: F.coalesce(F.from_json(c, "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    a, b = parsed(old), parsed(new)
    kept = F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k))
    return F.to_json(F.map_concat(kept, b))


def new_observations(texts: DataFrame, now: float) -> DataFrame:
    """Observation rows for texts (memory_space, source_ref, content, request_id): pending, with a summary of the first 500
    characters of the normalised content. The id follows from space, request and content, so that a repeated request is one."""
    ident = F.concat(F.lit("obs_"), F.substring(F.sha2(F.concat_ws("\x1f", "memory_space", "request_id", "content"), 256), 1, 32))
    return texts.select(
        ident.alias("observation_id"),
        "memory_space",
        "source_ref",
        "content",
        F.substring(text.normalize_text(F.col("content")), 1, SUMMARY_CHARS).alias("summary"),
        F.lit("pending").alias("entity_resolution_status"),
        F.to_json(F.struct("request_id")).alias("metadata"),
        F.lit(now).alias("created_at"),
    ).dropDuplicates(["observation_id"])


def marked_observations(observations: DataFrame, marks: DataFrame) -> DataFrame:
    """Observations after ``marks`` (memory_space, observation_id, status, metadata): status set, metadata merged on its top
    level. Of several marks of one observation the greatest status, then metadata, stands."""
    m = marks.groupBy("memory_space", "observation_id").agg(F.max(F.struct("status", "metadata")).alias("__m"))
    o = observations.join(m, ["memory_space", "observation_id"], "left")
    hit = F.col("__m").isNotNull()
    return o.withColumns(
        {
            "entity_resolution_status": F.coalesce("__m.status", "entity_resolution_status"),
            "metadata": F.when(hit, merged_json(F.col("metadata"), F.col("__m.metadata"))).otherwise(F.col("metadata")),
        }
    ).select(*observations.columns)


def resolved_identities(drafts: DataFrame, entities: DataFrame) -> DataFrame:
    """(memory_space, draft_id, entity_key, is_new): drafts by exact identity. A draft with the identity of an entity of its
    space takes the smallest such entity; all others of one identity share a new entity, whose key follows from it."""
    identity = lambda: text.identity_key(F.struct("who", "surface_forms", "stable_qualifiers"))
    known = entities.select("memory_space", "entity_key", "identity_profile.*").select("memory_space", "entity_key", identity().alias("identity"))
    known = known.groupBy("memory_space", "identity").agg(F.min("entity_key").alias("known"))
    found = drafts.select("memory_space", "draft_id", identity().alias("identity")).join(known, ["memory_space", "identity"], "left")
    made = F.concat(F.lit("ent_"), F.substring(F.sha2(F.concat_ws("\x1f", "memory_space", "identity"), 256), 1, 32))
    return found.select("memory_space", "draft_id", F.coalesce("known", made).alias("entity_key"), F.col("known").isNull().alias("is_new"))


def resolver_route(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """(memory_space, entity_key, n_candidates, n_existing, route): what resolves an entity's candidates. ``create`` without a
    resolver for a single one where nothing exists; ``batch`` where several meet nothing, so that they may repeat one another;
    else ``resolver``."""
    c = candidates.groupBy("memory_space", "entity_key").agg(F.count("*").alias("n_candidates"))
    m = existing.groupBy("memory_space", "entity_key").agg(F.count("*").alias("n_existing"))
    both = c.join(m, ["memory_space", "entity_key"], "left").na.fill(0, ["n_existing"])
    route = F.when(F.col("n_existing") > 0, "resolver").when(F.col("n_candidates") == 1, "create").otherwise("batch")
    return both.withColumn("route", route)


def needs_batch_retry(outputs: DataFrame, existing: DataFrame) -> DataFrame:
    """(memory_space, entity_key) whose outputs must be resolved against each other: nothing exists, there are several, and all
    of them create or coexist without a target."""
    own = outputs.groupBy("memory_space", "entity_key").agg(
        F.count("*").alias("n"), F.bool_and(F.col("action").isin("create", "coexist") & (F.coalesce(F.btrim("target_id"), F.lit("")) == "")).alias("free")
    )
    return own.where("n > 1 AND free").join(existing, ["memory_space", "entity_key"], "left_anti").select("memory_space", "entity_key")


def batch_order(outputs: DataFrame, existing: DataFrame) -> DataFrame:
    """``outputs`` (memory_space, entity_key, candidate_id, action, target_id) with the ``round`` in which each may be written.

    A refresh, replace or stale waits while its target is a candidate of the same batch that is not written yet and does not
    exist; so its round is one more than its target's, however long the chain is (found by pointer doubling, a join for each
    doubling of the length). Candidates whose turn never comes (they wait for each other) are forced in the round after the last,
    as creations. A candidate has one output. Only counts reach the driver.
    """
    key = ["memory_space", "entity_key"]
    targets = existing.select("memory_space", F.col("memory_id").alias("target_id")).distinct()
    waits_for = outputs.where(F.col("action").isin("refresh", "replace", "stale")).join(targets, ["memory_space", "target_id"], "left_anti")
    names = outputs.select(*key, F.col("candidate_id").alias("target_id")).distinct()
    waits_for = waits_for.join(names, [*key, "target_id"], "left_semi").groupBy(*key, "candidate_id").agg(F.min("target_id").alias("to"))
    step = materialise(waits_for.withColumn("n", F.lit(1)), "waiting")
    waiting = step.select(*key, F.col("candidate_id").alias("to"))
    left, steps = step.join(waiting, [*key, "to"], "left_semi").count(), 1
    while left:
        ahead = step.select(*key, F.col("candidate_id").alias("to"), F.col("to").alias("__to"), F.col("n").alias("__n"))
        step = step.join(ahead, [*key, "to"], "left").select(*key, "candidate_id", F.coalesce("__to", "to").alias("to"), (F.col("n") + F.coalesce("__n", F.lit(0))).alias("n"))
        step, steps = materialise(step, "waiting"), 2 * steps
        before, left = left, step.join(waiting, [*key, "to"], "left_semi").count()
        if left == before and steps >= left:  # all that are left wait for each other
            break
    done = step.join(waiting, [*key, "to"], "left_anti").select(*key, "candidate_id", (F.col("n") + 1).alias("round"))
    stuck = step.join(waiting, [*key, "to"], "left_semi").select(*key, "candidate_id", F.lit(True).alias("__stuck"))
    longest = done.agg(F.coalesce(F.max("round"), F.lit(1)).alias("__longest"))
    out = outputs.join(done, [*key, "candidate_id"], "left").join(stuck, [*key, "candidate_id"], "left").join(F.broadcast(longest))  # one row
    forced = F.col("__stuck").isNotNull()
    rounds = {"action": F.when(forced, "create").otherwise(F.col("action")), "round": F.when(forced, F.col("__longest") + 1).otherwise(F.coalesce("round", F.lit(1)))}
    return out.withColumns(rounds).drop("__stuck", "__longest")


def effective_actions(outputs: DataFrame, memories: DataFrame, batch: DataFrame | None = None) -> DataFrame:
    """``outputs`` with ``target`` (the memory that the target names: one that exists, else the one that the candidate of that
    name became in the ``batch`` (memory_space, candidate_id, memory_id)) and ``effect``: a refresh, replace or stale without a
    target creates."""
    m = memories.select("memory_space", F.col("memory_id").alias("target_id"), F.col("memory_id").alias("__m")).distinct()
    out = outputs.join(m, ["memory_space", "target_id"], "left")
    if batch is not None:
        made = batch.select("memory_space", F.col("candidate_id").alias("target_id"), F.col("memory_id").alias("__b"))
        out = out.join(made, ["memory_space", "target_id"], "left")
    else:
        out = out.withColumn("__b", F.lit(None).cast("string"))
    out = out.withColumn("target", F.coalesce("__m", "__b")).drop("__m", "__b")
    lost = F.col("action").isin("refresh", "replace", "stale") & F.col("target").isNull()
    return out.withColumn("effect", F.when(lost, "create").otherwise(F.col("action")))


def applied(memories: DataFrame, acts: DataFrame, now: float) -> DataFrame:
    """Memories after ``acts`` (memory_space, entity_key, effect, target, new_id, title, summary, content, confidence, salience,
    observation_id, metadata), at most one an existing memory: created ones are active; a replaced one is superseded and names
    its successor; a refreshed one keeps status and what the new text does not contain; a stale one changes status only."""
    columns = ["memory_space", "memory_id", "entity_key", "title", "summary", "content", "confidence", "salience", "status", "latest_source_observation_id", "metadata", "created_at", "updated_at"]
    made = acts.where(F.col("effect").isin("create", "coexist", "replace")).select(
        "memory_space", F.col("new_id").alias("memory_id"), "entity_key", "title", "summary", "content", "confidence", "salience",
        F.lit("active").alias("status"), F.col("observation_id").alias("latest_source_observation_id"), "metadata", F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"),
    )
    change = acts.where(F.col("effect").isin("refresh", "replace", "stale")).select("memory_space", F.col("target").alias("memory_id"), F.struct("effect", "new_id", "title", "summary", "content", "confidence", "salience", "observation_id", "metadata").alias("a"))
    m = memories.select(*columns).join(change, ["memory_space", "memory_id"], "left")
    refresh, replace, stale, hit = F.col("a.effect") == "refresh", F.col("a.effect") == "replace", F.col("a.effect") == "stale", F.col("a").isNotNull()
    fresh = lambda c: F.when(refresh, F.coalesce(F.col(f"a.{c}"), F.col(c))).otherwise(F.col(c))
    successor = F.to_json(F.struct(F.col("a.new_id").alias("superseded_by")))
    after = m.withColumns(
        {
            "title": fresh("title"),
            "confidence": fresh("confidence"),
            "salience": fresh("salience"),
            "summary": F.when(refresh, text.merged_refresh(F.col("summary"), F.col("a.summary"), "Refresh summary")).otherwise(F.col("summary")),
            "content": F.when(refresh, text.merged_refresh(F.col("content"), F.col("a.content"), "Refresh detail")).otherwise(F.col("content")),
            "status": F.when(replace, "superseded").when(stale, "stale").otherwise(F.col("status")),
            "latest_source_observation_id": F.when(refresh | stale, F.coalesce("a.observation_id", "latest_source_observation_id")).otherwise(F.col("latest_source_observation_id")),
            "metadata": F.when(replace, merged_json(F.col("metadata"), successor)).when(hit, merged_json(F.col("metadata"), F.col("a.metadata"))).otherwise(F.col("metadata")),
            "updated_at": F.when(hit, F.lit(now)).otherwise(F.col("updated_at")),
        }
    )
    return after.select(*columns).unionByName(made)


def appended_versions(versions: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``snapshots`` (memory_space, memory_id, seq, …) with their ``version``: numbers that go on after the greatest of the
    memory, in the order of ``seq``; dense and unique whatever was there."""
    last = versions.groupBy("memory_space", "memory_id").agg(F.coalesce(F.max("version"), F.lit(0)).alias("last"))
    nth = F.row_number().over(Window.partitionBy("memory_space", "memory_id").orderBy("seq"))
    return snapshots.join(last, ["memory_space", "memory_id"], "left").withColumn("version", F.coalesce("last", F.lit(0)) + nth).drop("last")


def profile_risk(current: Column, proposed: Column) -> Column:
    """(risk, reason) of a proposed identity profile: rejected unless of schema 2; to be reviewed if the name changed and the
    old one is not among its surface forms; else safe."""
    fold = lambda c: text.casefold(text.normalize_text(c))
    old, new = fold(current["who"]), fold(proposed["who"])
    forms = F.transform(F.coalesce(proposed["surface_forms"], F.array().cast("array<string>")), fold)
    verdict = lambda risk, reason: F.struct(F.lit(risk).alias("risk"), F.lit(reason).alias("reason"))
    return (
        F.when(F.coalesce(proposed["schema_version"] != 2, F.lit(True)), verdict("reject", "schema_version_must_be_2"))
        .when((old != "") & (new != "") & (old != new) & ~F.array_contains(forms, old), verdict("needs_identity_review", "who_changed_without_alias"))
        .otherwise(verdict("safe", "safe_additive_update"))
    )


def next_profile_state(metadata: Column, verdict: Column) -> Column:
    """(revision, status, reason) after a proposal: the revision goes up only if it was applied."""
    revision = F.coalesce(F.get_json_object(metadata, "$.profile_state.profile_revision").cast("int"), F.lit(0))
    safe = verdict["risk"] == "safe"
    return F.struct(
        F.when(safe, revision + 1).otherwise(revision).alias("profile_revision"),
        F.when(safe, "applied").otherwise(verdict["risk"]).alias("last_refresh_status"),
        verdict["reason"].alias("last_refresh_reason"),
    )


def with_history(history: Column, entry: Column) -> Column:
    """A profile history with one entry more, of which the last ten stay."""
    whole = F.concat(F.coalesce(history, F.array()), F.array(entry))
    return F.slice(whole, F.greatest(F.size(whole) - HISTORY + 1, F.lit(1)), HISTORY)


def merge_candidates(pairs: DataFrame, entities: DataFrame, known_tasks: DataFrame | None = None) -> DataFrame:
    """(memory_space, entity_a, entity_b, dedupe_key) of pairs (memory_space, entity_key, candidate_key) worth a merge task: two
    different entities of which one's profile would be a safe update of the other's; each pair once, in order, and not if a
    task of that key is there."""
    e = entities.select("memory_space", "entity_key", "identity_profile")
    p = pairs.where("entity_key <> candidate_key").join(e.withColumnRenamed("identity_profile", "own"), ["memory_space", "entity_key"])
    p = p.join(e.withColumnsRenamed({"entity_key": "candidate_key", "identity_profile": "theirs"}), ["memory_space", "candidate_key"])
    p = p.where(profile_risk(F.col("own"), F.col("theirs"))["risk"] == "safe")
    out = p.select("memory_space", F.least("entity_key", "candidate_key").alias("entity_a"), F.greatest("entity_key", "candidate_key").alias("entity_b")).distinct()
    out = out.withColumn("dedupe_key", F.concat_ws(":", F.lit("merge"), "entity_a", "entity_b"))
    return out if known_tasks is None else out.join(known_tasks.select("memory_space", "dedupe_key"), ["memory_space", "dedupe_key"], "left_anti").select("memory_space", "entity_a", "entity_b", "dedupe_key")


def survivors(merges: DataFrame) -> DataFrame:
    """(memory_space, entity_key, survivor) of every source of merges (memory_space, source, target, and the time ``at`` where the
    log has one): the entity that it is part of after all of them.

    Of several targets of a source the first in time counts, then the smallest; a merge of an entity with itself is none. Chains
    are followed to their end by pointer doubling; the smallest key of a cycle survives, and has no row. Only counts reach the driver.
    """
    key = ["memory_space", "entity_key"]
    at = F.col("at") if "at" in merges.columns else F.lit(0.0)
    first = F.min(F.struct(at.isNull().alias("late"), at.alias("at"), "target"))["target"]
    to = merges.where("source <> target").groupBy("memory_space", F.col("source").alias("entity_key")).agg(first.alias("to"))
    step = materialise(to.withColumn("low", F.col("to")), "survivors")  # low: the smallest key that the pointer passed or reached
    sources = step.select("memory_space", F.col("entity_key").alias("to"))
    left, steps = step.join(sources, ["memory_space", "to"], "left_semi").count(), 1
    while left:
        ahead = step.select("memory_space", F.col("entity_key").alias("to"), F.col("to").alias("__to"), F.col("low").alias("__low"))
        step = step.join(ahead, ["memory_space", "to"], "left").select(*key, F.coalesce("__to", "to").alias("to"), F.least("low", "__low").alias("low"))
        step, steps = materialise(step, "survivors"), 2 * steps
        before, left = left, step.join(sources, ["memory_space", "to"], "left_semi").count()
        if left == before and steps >= left:  # all that are left lead into cycles, and their pointers are on them
            break
    cycles = step.select("memory_space", F.col("entity_key").alias("to"), F.col("low").alias("__low"))
    out = step.join(cycles, ["memory_space", "to"], "left").select(*key, F.coalesce("__low", "to").alias("survivor"))
    return out.where("entity_key <> survivor")


def merged_entities(memories: DataFrame, entities: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memories, entities) after all merges (memory_space, source, target, at): the memories of a source belong to its survivor,
    see ``survivors``; entities that did not survive are gone."""
    return repointed(memories, entities, materialise(survivors(merges), "merged"))


def repointed(memories: DataFrame, entities: DataFrame, survivors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memories, entities) after the ``survivors`` (memory_space, entity_key, survivor): memories of an entity that is gone belong to
    its survivor, and entities that are gone are left out."""
    to = survivors.withColumnRenamed("survivor", "__to")
    moved = memories.join(to, ["memory_space", "entity_key"], "left").withColumn("entity_key", F.coalesce("__to", "entity_key"))
    return moved.select(*memories.columns), entities.join(to.select("memory_space", "entity_key"), ["memory_space", "entity_key"], "left_anti").select(*entities.columns)


def archived(memories: DataFrame, chosen: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """(memories after, memory_space and memory_id of those archived): the chosen ones that are not archived yet."""
    c = chosen.select("memory_space", "memory_id", F.lit(True).alias("__c")).distinct()
    m = memories.join(c, ["memory_space", "memory_id"], "left")
    hit = F.coalesce("__c", F.lit(False)) & ~F.coalesce(F.col("status") == "archived", F.lit(False))
    after = m.withColumns({"__hit": hit, "status": F.when(hit, "archived").otherwise(F.col("status")), "updated_at": F.when(hit, F.lit(now)).otherwise(F.col("updated_at"))})
    return after.select(*memories.columns), after.where("__hit").select("memory_space", "memory_id")


def purge_tasks(forgotten: DataFrame, now: float, delay: float) -> DataFrame:
    """(memory_space, memory_id, task_type, available_at): the delayed purge of memories that were just archived."""
    return forgotten.select("memory_space", "memory_id", F.lit("purge_memory").alias("task_type"), F.lit(now + delay).alias("available_at"))


def purged(gone: DataFrame, memories: DataFrame, versions: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(memories, versions, edges) without all that belongs to the ``gone`` memories (memory_space, memory_id)."""
    g = gone.select("memory_space", "memory_id").distinct()
    drop = lambda df, c: df.join(g.withColumnRenamed("memory_id", c), ["memory_space", c], "left_anti").select(*df.columns)
    kept = drop(edges, "from_id")
    into = kept.where("to_kind = 'memory'")
    return drop(memories, "memory_id"), drop(versions, "memory_id"), drop(into, "to_id").unionByName(kept.where("to_kind <> 'memory' OR to_kind IS NULL"))
