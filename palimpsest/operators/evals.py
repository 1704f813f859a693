"""Grading evaluation runs: expectations are rows, failures are rows, a pass is the absence of failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.operators.stats import CRITICAL_TASKS


def count_failures(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(case_id, scope, failure) of exact counts: ``expected`` (case_id, scope, memory_space, kind, label, n) against ``actual``
    (memory_space, kind, label, n); what the snapshot lacks counts 0, what nobody expects is not checked."""
    a = actual.select("memory_space", "kind", "label", F.col("n").alias("got"))
    met = expected.join(a, ["memory_space", "kind", "label"], "left").withColumn("got", F.coalesce("got", F.lit(0)))
    said = F.format_string("%s[%s] expected %d, got %d", "kind", "label", F.col("n").cast("long"), F.col("got").cast("long"))
    return met.where("n <> got").select("case_id", "scope", said.alias("failure"))


def text_failures(expected: DataFrame, memories: DataFrame) -> DataFrame:
    """(case_id, scope, failure) of texts (case_id, scope, memory_space, fragment, required) that no memory of the space
    contains though required, or that one contains though forbidden. Blank fragments are not checked."""
    e = expected.where("fragment <> ''")
    whole = F.concat_ws("\n", "title", "summary", "content")
    hits = e.join(memories.select("memory_space", whole.alias("whole")), "memory_space").where(F.contains("whole", F.col("fragment")))
    found = hits.select("case_id", "scope", "memory_space", "fragment", F.lit(True).alias("found")).distinct()
    met = e.join(found, ["case_id", "scope", "memory_space", "fragment"], "left").withColumn("found", F.coalesce("found", F.lit(False)))
    said = F.concat(F.when(F.col("required"), "missing memory text ").otherwise("forbidden memory text "), "fragment")
    return met.where(F.col("required") != F.col("found")).select("case_id", "scope", said.alias("failure"))


def query_failures(results: DataFrame) -> DataFrame:
    """``results`` with ``failures``: of each answered query (status, error_code, answer, citations, uncertainties, n_results, and
    what was expected of them, and the audit's status and error code) the list of checks that it fails."""
    none = F.array().cast("array<string>")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    fail = lambda cond, said: F.when(cond, F.lit(said))
    said = F.coalesce("uncertainties", none)
    missing = F.exists(F.coalesce("required_prefixes", none), lambda p: ~F.exists(said, lambda u: F.startswith(u, p)))
    checks = F.array(
        fail(~same("status", "expected_status"), "status"),
        fail(~same("error_code", "expected_error_code"), "error_code"),
        fail(F.col("non_empty_answer") & (F.btrim(F.coalesce("answer", F.lit(""))) == ""), "empty answer"),
        fail(F.coalesce("n_citations", F.lit(0)) < F.coalesce("citations_min", F.lit(0)), "citations below minimum"),
        fail(missing, "missing uncertainty"),
        fail(F.col("expected_result_count").isNotNull() & ~same("n_results", "expected_result_count"), "result count"),
        fail(F.col("audit_status").isNull(), "missing audit"),
        fail(F.col("audit_status").isNotNull() & ~same("audit_status", "status"), "audit status"),
        fail(F.col("audit_status").isNotNull() & ~same("audit_error_code", "error_code"), "audit error code"),
    )
    return results.withColumn("failures", F.filter(checks, lambda x: x.isNotNull()))


def full_pass(dimensions: Column) -> Column:
    """Whether all dimensions (a map to booleans) passed; a missing verdict did not, and neither did a case without dimensions."""
    values = F.map_values(dimensions)
    return F.coalesce((F.size(values) > 0) & F.forall(values, lambda v: F.coalesce(v, F.lit(False))), F.lit(False))


def case_summary(cases: DataFrame) -> DataFrame:
    """(kind, label, n, n_passed, pass_rate) of cases (case_id, category, dimensions): all of them, by category, by dimension;
    rates with four digits."""
    c = cases.withColumn("passed", full_pass(F.col("dimensions")))
    part = lambda df, kind, label: df.groupBy(label.alias("label")).agg(F.count("*").alias("n"), F.count_if("passed").alias("n_passed")).select(F.lit(kind).alias("kind"), "label", "n", "n_passed")
    each = c.select(F.explode("dimensions").alias("dimension", "passed"))
    out = part(c, "all", F.lit("all")).unionByName(part(c, "category", F.col("category"))).unionByName(part(each, "dimension", F.col("dimension")))
    return out.withColumn("pass_rate", F.round(F.col("n_passed") / F.col("n"), 4))


def verdict_summary(queries: DataFrame) -> DataFrame:
    """(n_pass, n_partial, n_fail, grounded_rate) of judged queries (verdict, grounded); other verdicts don't count."""
    q = queries.where(F.col("verdict").isin("pass", "partial", "fail"))
    n = lambda v: F.count_if(F.col("verdict") == v).alias(f"n_{v}")
    rate = F.coalesce(F.round(F.count_if("grounded") / F.nullif(F.count("*"), F.lit(0)), 4), F.lit(0.0))
    return q.agg(n("pass"), n("partial"), n("fail"), rate.alias("grounded_rate"))


def suite_summary(cases: DataFrame) -> DataFrame:
    """(suite_id, n, n_passed, pass_rate, failing) of every suite's cases (suite_id, dimensions)."""
    by = cases.groupBy("suite_id").agg(F.count("*").alias("n"), F.count_if(full_pass(F.col("dimensions"))).alias("n_passed"))
    return by.withColumn("pass_rate", F.round(F.col("n_passed") / F.col("n"), 4)).withColumn("failing", F.col("n_passed") < F.col("n"))


def settled(spaces: DataFrame, tasks: DataFrame, types: list[str]) -> DataFrame:
    """(memory_space, settled, n_pending, n_running, n_dead, settled_after_all) of spaces by their tasks of the given types: a space is
    settled while nothing is pending, failed (it will be tried again) or running. ``settled_after_all`` also passes a space where
    none of the critical tasks is open, whatever else is."""
    mine = F.col("task_type").isin(types)
    count = lambda cond, name: F.count_if(cond).alias(name)
    status = F.col("status")
    counted = tasks.groupBy("memory_space").agg(
        count(mine & status.isin("pending", "failed"), "n_pending"), count(mine & (status == "running"), "n_running"), count(mine & (status == "dead_letter"), "n_dead"),
        count(F.col("task_type").isin(CRITICAL_TASKS) & status.isin("pending", "failed", "running"), "n_critical"),
    )
    known = spaces.select("memory_space").distinct().join(counted, "memory_space", "left").na.fill(0)
    done = (F.col("n_pending") == 0) & (F.col("n_running") == 0)
    return known.select("memory_space", done.alias("settled"), "n_pending", "n_running", "n_dead", (done | (F.col("n_critical") == 0)).alias("settled_after_all"))


def state_failures(expected: DataFrame, snapshots: DataFrame, tasks: DataFrame) -> DataFrame:
    """(case_id, scope, failure) of scopes (case_id, scope, memory_space) without a snapshot, or with dead tasks."""
    there = snapshots.select("memory_space").distinct().withColumn("__there", F.lit(True))
    dead = tasks.where("status = 'dead_letter'").select("memory_space").distinct().withColumn("__dead", F.lit(True))
    e = expected.select("case_id", "scope", "memory_space").distinct().join(there, "memory_space", "left").join(dead, "memory_space", "left")
    said = F.when(F.col("__there").isNull(), "missing snapshot").when(F.col("__dead"), "has dead_letter tasks")
    return e.where(said.isNotNull()).select("case_id", "scope", said.alias("failure"))


def result_failures(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, failure) of recalls of several subjects: ``expected`` (query_id, expected_status, expected_result_count) against
    ``results`` (query_id, position, status). Queries that expect no number are not checked; of the others, the number must be met,
    and every result must have the expected status."""
    want = expected.where("expected_result_count IS NOT NULL")
    got = results.groupBy("query_id").agg(F.count("*").alias("got"))
    number = want.join(got, "query_id", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got <> expected_result_count")
    number = number.select("query_id", F.format_string("expected %d recall results, got %d", F.col("expected_result_count").cast("long"), F.col("got").cast("long")).alias("failure"))
    each = results.join(want, "query_id").where(F.coalesce("status", F.lit("")) != F.col("expected_status"))
    said = F.format_string("result[%d] expected status %s, got %s", F.col("position").cast("long"), "expected_status", F.coalesce("status", F.lit("")))
    return number.unionByName(each.select("query_id", said.alias("failure")))


def failure_index(failures: DataFrame) -> DataFrame:
    """(failure, n, case_ids) of failed cases (case_id, failure): how many cases fail so, and the first ten of them by id."""
    cases = failures.select("failure", "case_id").distinct()
    first = Window.partitionBy("failure").orderBy("case_id")
    shown = cases.withColumn("nth", F.row_number().over(first)).where("nth <= 10").groupBy("failure").agg(F.array_sort(F.collect_list("case_id")).alias("case_ids"))
    return cases.groupBy("failure").agg(F.count("*").alias("n")).join(shown, "failure")


def chosen_suites(suites: DataFrame, requested: DataFrame | None = None, failed_before: DataFrame | None = None) -> DataFrame:
    """Suites that were asked for, or that failed before, or all of them."""
    for chosen in (requested, failed_before):
        if chosen is not None:
            suites = suites.join(chosen.select("suite_id").distinct(), "suite_id", "left_semi")
    return suites


def identity_score(found: Column, expected: Column) -> Column:
    """Whether an extracted identity meets an expectation: its name among ``who_any``, all of ``forms_all`` and some of
    ``forms_any`` among its surface forms, likewise qualifiers; an empty list expects nothing. Case and white space don't matter."""
    fold = lambda c: text.casefold(text.normalize_text(c))
    items = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), fold)
    some = lambda want, have: (F.size(want) == 0) | F.arrays_overlap(want, have)
    every = lambda want, have: F.size(F.array_except(want, have)) == 0
    forms, qualifiers = items(found["surface_forms"]), items(found["stable_qualifiers"])
    return (
        some(items(expected["who_any"]), F.array(fold(found["who"])))
        & some(items(expected["forms_any"]), forms)
        & every(items(expected["forms_all"]), forms)
        & some(items(expected["qualifiers_any"]), qualifiers)
        & every(items(expected["qualifiers_all"]), qualifiers)
    )


#: Phrases that stand in for a definition.
PLACEHOLDERS = ["具体主体", "命名主体", "特定主体", "generic subject", "specific subject", "named subject", "concrete subject"]


def identity_failures(found: Column, expected: Column, semantics: Column) -> Column:
    """The checks that an extracted identity fails against its expectation (forms_any, forms_all, qualifiers_any, qualifiers_all,
    definition_required, definition_any, definition_all), by name. ``forms_all`` is the whole list of surface forms, ``qualifiers_all``
    a part of it; a definition must hold some of ``definition_any`` and all of ``definition_all``, and where one is required neither
    repeat the name nor be a placeholder. ``semantics`` is a judge's verdict on the definition (null for none asked). Empty lists
    expect nothing; case and white space don't matter."""
    fold = lambda c: text.casefold(text.normalize_text(c))
    items = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), fold)
    forms, qualifiers, who, said = items(found["surface_forms"]), items(found["stable_qualifiers"]), fold(found["who"]), fold(found["definition"])
    want = {c: items(expected[c]) for c in ("forms_any", "forms_all", "qualifiers_any", "qualifiers_all", "definition_any", "definition_all")}
    none_of = lambda w, have: (F.size(w) > 0) & ~F.arrays_overlap(w, have)
    required = F.coalesce(expected["definition_required"], F.lit(False))
    lacking, told = required & (said == ""), required & (who != "") & (said != "")
    checks = {
        "surface_forms: none expected": none_of(want["forms_any"], forms),
        "surface_forms: missing": F.size(F.array_except(want["forms_all"], forms)) > 0,
        "surface_forms: unexpected": (F.size(want["forms_all"]) > 0) & (F.size(F.array_except(forms, want["forms_all"])) > 0),
        "stable_qualifiers: none expected": none_of(want["qualifiers_any"], qualifiers),
        "stable_qualifiers: missing": F.size(F.array_except(want["qualifiers_all"], qualifiers)) > 0,
        "definition: required": lacking,
        "definition: repeats the name": told & (said == who),
        "definition: placeholder": told & F.exists(F.array(*map(F.lit, PLACEHOLDERS)), lambda x: F.contains(said, x)),
        "definition: none expected": ~lacking & (F.size(want["definition_any"]) > 0) & ~F.exists(want["definition_any"], lambda x: F.contains(said, x)),
        "definition: missing": ~lacking & F.exists(want["definition_all"], lambda x: ~F.contains(said, x)),
        "definition: judged": ~lacking & (said != "") & semantics.isNotNull() & (semantics != "pass"),
    }
    return F.filter(F.array(*[F.when(failed, F.lit(name)) for name, failed in checks.items()]), lambda x: x.isNotNull())
