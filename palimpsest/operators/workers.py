"""The seam for language-model judgements, and the deterministic work around it.

A worker is a function from payload rows to JSON text, applied in batches inside the tasks (``judged``); what a model would decide is
behind that function, and a rule stands in for it in tests. Everything that code decides about an answer, such as dropping,
repairing and mapping it, is a column expression or a join here, so an answer is checked the same way whoever gave it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text

Adapter = Callable[[list[str]], list[str]]
#: How many items of a profile are kept, query rewrites, cross-entity texts; least likeness of a mistyped key.
MAX_FORMS, MAX_QUALIFIERS, MAX_REWRITES, MAX_TEXTS, KEY_LIKENESS = 3, 4, 3, 6, 0.94
INTENTS = ["current", "latest", "history", "uncertain"]


def judged(payloads: DataFrame, adapter: Adapter, answer: str = "answer") -> DataFrame:
    """``payloads`` (…, payload) with the adapter's JSON answers in place of the payloads: one call a batch of rows. An answer
    that is missing is null. The adapter is pickled to the tasks and may keep a connection there."""
    names = [c for c in payloads.columns if c != "payload"]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(batch.schema.get_field_index("payload")).to_pylist()
            got = list(adapter(asked))[: len(asked)]
            got += [None] * (len(asked) - len(got))
            kept = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(got, pa.string())], names=[*names, answer])

    kinds = ", ".join(f"`{n}` {payloads.schema[n].dataType.simpleString()}" for n in names)
    return payloads.mapInArrow(ask, f"{kinds}, `{answer}` string")


def clean_profile(profile: Column) -> Column:
    """A profile as it is stored: schema 2, lower case, normalised, at most three surface forms and four qualifiers."""
    lowered = lambda c: F.lower(text.normalize_text(c))
    items = lambda c, n: text.distinct_in_order(F.transform(c, F.lower), n)
    return F.struct(
        F.lit(2).alias("schema_version"),
        lowered(profile["who"]).alias("who"),
        items(profile["surface_forms"], MAX_FORMS).alias("surface_forms"),
        items(profile["stable_qualifiers"], MAX_QUALIFIERS).alias("stable_qualifiers"),
        lowered(profile["definition"]).alias("definition"),
    )


def gated(drafts: DataFrame) -> DataFrame:
    """Drafts (request, draft_id, profile) that name someone, cleaned. A request without any is not among them: it is rejected."""
    cleaned = drafts.withColumn("profile", clean_profile(F.col("profile")))
    return cleaned.where((F.col("profile.who") != "") | (F.size("profile.surface_forms") > 0))


def gate_status(requests: DataFrame, surviving: DataFrame) -> DataFrame:
    """(request, status): passed where a draft survived, else rejected_no_identity_profile."""
    some = surviving.select("request", F.lit("passed").alias("__s")).distinct()
    return requests.select("request").distinct().join(some, "request", "left").select("request", F.coalesce("__s", F.lit("rejected_no_identity_profile")).alias("status"))


def owned_candidates(candidates: DataFrame, surviving: DataFrame) -> DataFrame:
    """Candidate memories (request, owner_draft_id, …) whose owner is a surviving draft of the request."""
    owners = surviving.select("request", F.col("draft_id").alias("owner_draft_id"))
    return candidates.join(owners, ["request", "owner_draft_id"], "left_semi")


def close_key(selected: pd.Series, keys: pd.Series) -> pd.Series:
    """The selected key, or the only candidate key that is nearly the same; null for a blank one, and for one that is unknown
    and close to none or several of the keys."""

    def one(key: str | None, valid: list[str]) -> str | None:
        key, valid = (key or "").strip(), sorted({v for v in (valid if valid is not None else []) if v})
        if not key or key in valid or not valid:
            return key or None
        # a key is close if the matching characters make up the share on both sides
        # their number is at most that of the shorter one, so keys of very different lengths need not be compared
        able = [v for v in valid if 2 * min(len(v), len(key)) >= KEY_LIKENESS * (len(v) + len(key))]
        near = [v for v in able if SequenceMatcher(None, v, key).ratio() >= KEY_LIKENESS]
        return near[0] if len(near) == 1 else None

    return pd.Series([one(k, v) for k, v in zip(selected, keys, strict=True)], dtype=object)


def linked(answers: DataFrame, mode: str) -> DataFrame:
    """Linker answers (request, draft_id, decision, selected, ambiguous, keys) as they take effect: a mistyped key is repaired,
    one that is not among the candidate ``keys`` makes a new entity (mode ``write``) or cannot be resolved (``query``), ambiguous
    keys are those among the candidates."""
    nearest = F.pandas_udf(close_key, "string")
    own, none = F.nullif(F.btrim("selected"), F.lit("")), F.array().cast("array<string>")
    keys = F.coalesce("keys", none)
    # only keys that are unknown are compared, with those of which enough letters can match: a share of 0.94 leaves few edits
    close = F.filter(keys, lambda k: F.levenshtein(k, own) <= F.ceil((1 - KEY_LIKENESS) * (F.length(k) + F.length(own))))
    asked = F.when(own.isNotNull() & ~F.array_contains(keys, own), close).otherwise(none)
    repaired = answers.withColumn("__close", asked).withColumn("__key", F.when(F.size("__close") > 0, F.coalesce(nearest("selected", "__close"), own)).otherwise(own)).drop("__close")
    unknown = F.col("__key").isNotNull() & ~F.array_contains(F.coalesce("keys", F.array().cast("array<string>")), F.col("__key"))
    decision = F.when(unknown, "create_new" if mode == "write" else "cannot_resolve").otherwise(F.col("decision"))
    ambiguous = F.when(~unknown & (F.col("decision") == "ambiguous"), F.array_intersect("ambiguous", "keys"))
    chosen = F.when(~unknown & (F.col("decision") != "ambiguous"), F.col("__key"))
    return repaired.select("request", "draft_id", decision.alias("decision"), chosen.alias("entity_key"), ambiguous.alias("ambiguous"))


def resolved_outputs(outputs: DataFrame, candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """Resolver outputs (request, candidate_id, position, action, target_ref) as they take effect: the last output of each
    candidate that was asked about, with the memory that its short reference stands for in ``targets`` (request, ref, memory_id);
    a refresh, replace or stale without a known target creates. Candidates without an output are dropped."""
    last = Window.partitionBy("request", "candidate_id").orderBy(F.desc("position"))
    asked = candidates.select("request", "candidate_id").distinct()
    out = outputs.join(asked, ["request", "candidate_id"], "left_semi").withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
    out = out.join(targets.select("request", F.col("ref").alias("target_ref"), F.col("memory_id").alias("target_id")), ["request", "target_ref"], "left")
    lost = F.col("action").isin("refresh", "replace", "stale") & F.col("target_id").isNull()
    return out.select("request", "candidate_id", F.when(lost, "create").otherwise(F.col("action")).alias("action"), "target_id")


def planned(drafts: DataFrame) -> DataFrame:
    """Query drafts (request, draft_id, query_text, profile, rewrites, time_intent) that ask something, cleaned; at most three
    rewrites, an unknown intent counts as uncertain."""
    intent = F.lower(F.btrim(F.coalesce("time_intent", F.lit(""))))
    return drafts.where(text.normalize_text(F.col("query_text")) != "").withColumns(
        {
            "query_text": text.normalize_text(F.col("query_text")),
            "profile": clean_profile(F.col("profile")),
            "rewrites": text.distinct_in_order(F.col("rewrites"), MAX_REWRITES),
            "time_intent": F.when(intent.isin(INTENTS), intent).otherwise("uncertain"),
        }
    )


def cross_entity_texts(answers: DataFrame) -> DataFrame:
    """(request, text): at most six different query texts of each answer (request, texts)."""
    return answers.select("request", F.explode(text.distinct_in_order(F.col("texts"), MAX_TEXTS)).alias("text"))


def merge_verdicts(answers: DataFrame) -> DataFrame:
    """Merge judge answers (…, answer) with decision (``merge`` or ``keep_separate``, which is what anything else counts as),
    survivor_entity_key (null for a blank one), profile (cleaned; null if there is none, or one that names nobody) and judged_reason."""
    kind = "decision string, survivor_entity_key string, reason string, merged_identity_profile struct<who:string,surface_forms:array<string>,stable_qualifiers:array<string>,definition:string>"
    parsed = answers.withColumn("__a", F.from_json("answer", kind))
    profile = clean_profile(F.col("__a.merged_identity_profile"))
    return parsed.withColumns(
        {
            "decision": F.when(F.col("__a.decision") == "merge", "merge").otherwise("keep_separate"),
            "survivor_entity_key": F.nullif(F.btrim("__a.survivor_entity_key"), F.lit("")),
            "profile": F.when(F.col("__a.merged_identity_profile").isNotNull() & (profile["who"] != ""), profile),
            "judged_reason": F.coalesce("__a.reason", F.lit("")),
        }
    ).drop("__a", "answer")


def answer_verdicts(answers: DataFrame) -> DataFrame:
    """Answer judge answers (…, answer) with verdict (pass, partial or fail; null where the judge said nothing of these), grounded
    (true unless said otherwise; null without a verdict) and reason."""
    parsed = answers.withColumn("__a", F.from_json("answer", "verdict string, grounded boolean, reason string"))
    verdict = F.when(F.col("__a.verdict").isin("pass", "partial", "fail"), F.col("__a.verdict"))
    columns = {"verdict": verdict, "grounded": F.when(verdict.isNotNull(), F.coalesce("__a.grounded", F.lit(True))), "reason": F.coalesce("__a.reason", F.lit(""))}
    return parsed.withColumns(columns).drop("__a", "answer")


def composed_answers(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((request, answer, uncertainties), (request, position, memory_id, observation_id, summary, excerpt)) of composer answers
    (request, answer): the answer as it is, and its citations as rows for ``citations``, in their order. A missing answer is empty."""
    kind = "answer string, uncertainties array<string>, citations array<struct<memory_id:string,observation_id:string,summary:string,excerpt:string>>"
    parsed = answers.select("request", F.from_json("answer", kind).alias("a"))
    none = F.array().cast("array<string>")
    whole = parsed.select("request", F.coalesce("a.answer", F.lit("")).alias("answer"), F.coalesce("a.uncertainties", none).alias("uncertainties"))
    return whole, parsed.select("request", F.posexplode("a.citations").alias("position", "c")).select("request", "position", "c.*")


def judged_edges(answers: DataFrame) -> DataFrame:
    """Judged relations without those of type ``none``, and without unknown types."""
    return answers.where(F.col("edge_type").isin("supports", "contradicts", "related_to", "updates"))


def citations(cited: DataFrame, memories: DataFrame, observations: DataFrame, derived: DataFrame) -> DataFrame:
    """(request, position, memory_id, observation_id, summary, excerpt): citations (request, position, memory_id, observation_id,
    summary, excerpt) as they are shown. Ids that the request does not hold are dropped; a missing memory is the first that the
    observation derives from (``derived``: request, observation_id, memory_ids); missing texts come from the observation, then
    from the memory; a citation without any id, or equal to an earlier one, is left out.

    ``memories`` (request, memory_id, title, summary, content) and ``observations`` (request, observation_id, summary, content)
    are those of each request.
    """
    filled = lambda *cs: F.coalesce(*[F.nullif(F.btrim(c), F.lit("")) for c in cs], F.lit(""))
    o = observations.select("request", "observation_id", F.col("summary").alias("o_summary"), F.col("content").alias("o_content"), F.lit(True).alias("o"))
    c = cited.join(o, ["request", "observation_id"], "left").withColumn("observation_id", F.when(F.col("o"), F.col("observation_id")))
    c = c.join(derived.select("request", "observation_id", "memory_ids"), ["request", "observation_id"], "left")
    own = memories.select("request", "memory_id", F.lit(True).alias("m"))
    c = c.join(own, ["request", "memory_id"], "left")
    c = c.withColumn("memory_id", F.coalesce(F.when(F.col("m"), F.col("memory_id")), F.get("memory_ids", F.lit(0)))).drop("m")
    m = memories.select("request", "memory_id", F.col("title").alias("m_title"), F.col("summary").alias("m_summary"), F.col("content").alias("m_content"))
    c = c.join(m, ["request", "memory_id"], "left").where("memory_id IS NOT NULL OR observation_id IS NOT NULL")
    c = c.withColumns({"summary": filled("summary", "o_summary", "m_summary", "m_title"), "excerpt": filled("excerpt", "o_summary", "o_content", "m_summary", "m_content")})
    first = Window.partitionBy("request", "memory_id", "observation_id", "excerpt").orderBy("position")
    return c.withColumn("__n", F.row_number().over(first)).where("__n = 1").select("request", "position", "memory_id", "observation_id", "summary", "excerpt")


def identity_matches(draft: Column, candidate: Column) -> Column:
    """Whether a query draft fits a candidate's profile by structure: equal names, a name among the other's surface forms, or
    all of the draft's qualifiers within what the candidate says."""
    fold = lambda c: text.casefold(text.normalize_text(c))
    items = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), fold), lambda x: x != "")
    d_who, c_who = fold(draft["who"]), fold(candidate["who"])
    d_forms, c_forms = items(draft["surface_forms"]), items(candidate["surface_forms"])
    d_qualifiers = items(draft["stable_qualifiers"])
    whole = F.concat_ws(" ", c_who, F.array_join(F.array_sort(c_forms), " "), F.array_join(items(candidate["stable_qualifiers"]), " "))
    named = (d_who != "") & ((d_who == c_who) | F.array_contains(c_forms, d_who))
    shared = F.arrays_overlap(d_forms, F.concat(c_forms, F.array(c_who))) & (F.size(d_forms) > 0)
    described = (F.size(d_qualifiers) > 0) & F.forall(d_qualifiers, lambda q: F.contains(whole, q))
    return named | shared | described


def bound_entities(matches: DataFrame) -> DataFrame:
    """(query_id, entity_key) where exactly one candidate of a query matched, so that no linker is needed."""
    one = matches.groupBy("query_id").agg(F.count_distinct("entity_key").alias("n"), F.min("entity_key").alias("entity_key"))
    return one.where("n = 1").select("query_id", "entity_key")


def usage_tokens(usage: Column) -> Column:
    """Tokens in a provider's usage record (JSON), with the names that providers use for the same thing."""
    get = lambda *paths: F.coalesce(*[F.get_json_object(usage, p).cast("int") for p in paths])
    read = get("$.prompt_tokens", "$.input_tokens")
    cached = get("$.prompt_cache_hit_tokens", "$.prompt_tokens_details.cached_tokens", "$.prompt_tokens_details.cache_read", "$.input_token_details.cached_tokens", "$.input_token_details.cache_read")
    missed = get("$.prompt_cache_miss_tokens", "$.prompt_tokens_details.cache_miss", "$.prompt_tokens_details.cache_write", "$.input_token_details.cache_miss", "$.input_token_details.cache_write")
    return F.struct(
        read.alias("input_tokens"),
        get("$.completion_tokens", "$.output_tokens").alias("output_tokens"),
        cached.alias("cached_tokens"),
        F.coalesce(missed, F.greatest(read - F.coalesce(cached, F.lit(0)), F.lit(0))).alias("cache_miss_tokens"),
        get("$.completion_tokens_details.reasoning_tokens", "$.output_token_details.reasoning_tokens").alias("reasoning_tokens"),
    )
