"""Text functions as column expressions; everything stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what a token is, either a run of Latin letters, digits and underscores, or one Chinese character.
TOKEN = r"([A-Za-z0-9_]+|[\x{4e00}-\x{9fff}])"
#: Fixed value: white space of any script, and the four separators that count as such.
BLANKS = r"(?U)[\s\x1c-\x1f]+"


def normalize_text(c: Column) -> Column:
    """Without white space at the ends, each run of it inside as one blank; null as empty."""
    return F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), BLANKS, " "))


def tokens(c: Column) -> Column:
    """Lower-case tokens in order; an empty array for null and for text without any."""
    return F.regexp_extract_all(F.lower(normalize_text(c)), F.lit(TOKEN), F.lit(1))


def casefold(c: Column) -> Column:
    """Caseless form as far as lower case gives it, and the sharp s."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def distinct_in_order(items: Column, limit: int | None = None) -> Column:
    """Normalised items without empty ones and without those that differ from an earlier one in case only, first spelling
    kept; the first ``limit``. A null array gives an empty one. For short arrays: the work grows with the square of its length."""
    clean = F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), normalize_text), lambda x: x != "")
    lowered = F.transform(clean, F.lower)
    kept = F.filter(clean, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)
    return F.slice(kept, 1, limit) if limit is not None else kept


def bounded_unique(items: Column, limit: int) -> Column:
    """The first ``limit`` distinct non-empty items, in order."""
    return F.slice(F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != ""))), 1, limit)


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it occurs in there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _numbered(items: Column) -> Column:
    """The items, each with the number of equal ones before it, so that repeats differ."""
    return _bound(F.array_sort(items), lambda s: F.transform(s, lambda x, i: F.concat_ws(" ", x, (i + 1 - F.array_position(s, x)).cast("string"))))


def shared_tokens(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token arrays."""
    return F.size(F.array_intersect(_numbered(a), _numbered(b)))


def overlap_score(left: Column, right: Column) -> Column:
    """Shared tokens over the geometric mean of both token counts; 0 where a side has none."""
    score = lambda a, b: F.when((F.size(a) > 0) & (F.size(b) > 0), shared_tokens(a, b) / F.sqrt((F.size(a) * F.size(b)).cast("double"))).otherwise(0.0)
    return _bound(F.struct(tokens(left).alias("a"), tokens(right).alias("b")), lambda p: score(p["a"], p["b"]))


def chargrams(c: Column, n: int = 2) -> Column:
    """Character n-grams of the lower-case text without blanks."""
    text = F.replace(F.lower(normalize_text(c)), F.lit(" "), F.lit(""))
    grams = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, grams).otherwise(F.array().cast("array<string>"))


def chargram_score(left: Column, right: Column, n: int = 2) -> Column:
    """As ``overlap_score`` on character n-grams; texts shorter than n compare whole, or by tokens if they differ."""
    plain = lambda c: F.replace(F.lower(normalize_text(c)), F.lit(" "), F.lit(""))
    a, b = chargrams(left, n), chargrams(right, n)
    score = shared_tokens(a, b) / F.sqrt((F.size(a) * F.size(b)).cast("double"))
    short = F.when(plain(left) == plain(right), 1.0).otherwise(overlap_score(plain(left), plain(right)))
    empty = (plain(left) == "") | (plain(right) == "")
    return F.when(empty, 0.0).when((F.size(a) == 0) | (F.size(b) == 0), short).otherwise(score)


def query_coverage(query: Column, candidate: Column) -> Column:
    """Share of the query's words that the candidate has, repeated ones as often."""
    words = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)([\w\x{4e00}-\x{9fff}]+)"), F.lit(1))
    a, b = words(query), words(candidate)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared_tokens(a, b) / F.size(a)).otherwise(0.0)


def display_name(who: Column, surface_forms: Column) -> Column:
    """``who``, else the first surface form, else ``Unknown``; blank ones don't count."""
    blank = lambda c: F.nullif(normalize_text(c), F.lit(""))
    first = F.get(F.filter(F.coalesce(surface_forms, F.array().cast("array<string>")), lambda x: normalize_text(x) != ""), F.lit(0))
    return F.coalesce(blank(who), blank(first), F.lit("Unknown"))


def identity_text(profile: Column) -> Column:
    """An identity profile as labelled lines for indexing; blank parts are left out."""
    forms = lambda name: F.array_join(F.filter(F.coalesce(profile[name], F.array().cast("array<string>")), lambda x: F.trim(x) != ""), " | ")
    line = lambda label, value: F.when(F.trim(F.coalesce(value, F.lit(""))) != "", F.concat(F.lit(f"{label}: "), value))
    return F.concat_ws(
        "\n",
        line("who", profile["who"]),
        line("definition", profile["definition"]),
        line("surface_forms", forms("surface_forms")),
        line("stable_qualifiers", forms("stable_qualifiers")),
    )


def memory_text(identity: Column, title: Column, summary: Column, content: Column) -> Column:
    """Identity, title, summary and content as one text for indexing; blank parts are left out."""
    part = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", c)
    return F.concat_ws("\n", part(identity), part(title), part(summary), part(content))


def ref_doc(kind: str, space: Column, key: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), space, F.lit(":"), key)


def ref_doc_key(ref: Column) -> Column:
    """What follows the last colon."""
    return F.substring_index(ref, ":", -1)


def identity_key(profile: Column) -> Column:
    """A stable key of who, surface forms and qualifiers: equal for profiles that say the same, whatever the order of forms."""
    forms = lambda name: F.array_sort(distinct_in_order(F.transform(profile[name], F.lower)))
    whole = F.struct(casefold(normalize_text(profile["who"])).alias("who"), forms("surface_forms").alias("s"), forms("stable_qualifiers").alias("q"))
    return F.sha2(F.to_json(whole), 256)


def merged_refresh(old: Column, new: Column, label: str) -> Column:
    """Old and new text of a refresh: the one that contains the other (white space and case aside), else both, the new one
    labelled; a blank one gives the other."""
    old_, new_ = F.btrim(F.coalesce(old, F.lit(""))), F.btrim(F.coalesce(new, F.lit("")))
    a, b = casefold(normalize_text(old_)), casefold(normalize_text(new_))
    both = F.concat(old_, F.lit(f"\n\n{label}: "), new_)
    return F.when(old_ == "", new_).when(new_ == "", old_).when(F.contains(b, a), new_).when(F.contains(a, b), old_).otherwise(both)


def rendered_scope(template: Column, run_id: Column, execution_id: Column, case_id: Column, alias: Column) -> Column:
    """A memory scope from its template; the execution is appended where the template does not name it."""
    out = template
    for name, value in (("run_id", run_id), ("execution_id", execution_id), ("case_id", case_id), ("scope_alias", alias)):
        out = F.replace(out, F.lit("{" + name + "}"), value)
    named = F.contains(template, F.lit("{execution_id}"))
    return F.when(named, out).otherwise(F.concat(out, F.lit(":exec:"), execution_id))


def fact_variants(fact: Column) -> Column:
    """Variants of a required fact, separated by double bars; blank ones are left out."""
    return F.filter(F.transform(F.split(F.coalesce(fact, F.lit("")), r"\|\|"), lambda x: F.btrim(x)), lambda x: x != "")


def merged_uncertainties(first: Column, second: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.concat(F.coalesce(first, none), F.coalesce(second, none)), lambda x: x != ""))


def time_intent(c: Column) -> Column:
    """A time intent as it is understood: current, latest or history; anything else is uncertain."""
    return _one_of(c, ["current", "latest", "history"], "uncertain")


def graph_intent(c: Column) -> Column:
    """A graph intent as it is understood: cross_entity; anything else stays with the entity."""
    return _one_of(c, ["cross_entity"], "entity_local")


def _one_of(c: Column, known: list[str], other: str) -> Column:
    said = F.lower(F.btrim(F.coalesce(c, F.lit(""))))
    return F.when(said.isin(known), said).otherwise(other)


def stable_json(fields: dict[str, Column]) -> Column:
    """An object as compact JSON whose keys come in order, whatever the order of ``fields``; null values are left out."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


#: Marks that end a segment, and the characters of a fragment.
SEGMENT_ENDS, FRAGMENT_CHARS = "。！？!?.", 240


def fragments(content: Column, max_chars: int = FRAGMENT_CHARS) -> Column:
    """Fragments (ordinal, start, end, text) of a text: its sentences and lines, trimmed, of which neighbours are put together with a
    blank as long as they do not exceed ``max_chars``. ``start`` and ``end`` (exclusive) count characters of the text from 0. A text
    of nothing but marks is one fragment; null and blank texts have none."""
    none = "cast(array() AS array<struct<start:int,end:int,text:string>>)"
    pieces = F.regexp_extract_all(content, F.lit(rf"(?s)([^\n{SEGMENT_ENDS}]+(?:[{SEGMENT_ENDS}]+|\n+|$)|[\n{SEGMENT_ENDS}]+)"), F.lit(1))
    placed = F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("at"), F.expr(none).alias("l")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p)).alias("at"),
            F.when(
                ~p.rlike(rf"^[\n{SEGMENT_ENDS}]+$") & (_stripped(p) != ""),
                F.concat(s["l"], F.array(F.struct((s["at"] + F.length(p) - F.length(_stripped(p, "left"))).alias("start"), (s["at"] + F.length(_stripped(p, "right"))).alias("end"), _stripped(p).alias("text")))),
            ).otherwise(s["l"]).alias("l"),
        ),
        lambda s: s["l"],
    )
    whole = F.struct((F.length(content) - F.length(_stripped(content, "left"))).cast("int").alias("start"), F.length(_stripped(content, "right")).cast("int").alias("end"), _stripped(content).alias("text"))
    segments = F.when(F.size(placed) > 0, placed).otherwise(F.array(whole))
    last = lambda s: F.element_at(s, -1)
    fits = lambda s, x: (F.size(s) > 0) & (F.length(F.get(s, F.size(s) - 1)["text"]) + 1 + F.length(x["text"]) <= max_chars)
    merged = F.aggregate(
        segments,
        F.expr(none),
        lambda s, x: F.when(fits(s, x), F.concat(F.slice(s, 1, F.size(s) - 1), F.array(F.struct(last(s)["start"].alias("start"), x["end"].alias("end"), F.concat_ws(" ", last(s)["text"], x["text"]).alias("text"))))).otherwise(F.concat(s, F.array(x))),
    )
    numbered = F.transform(merged, lambda x, i: F.struct((i + 1).alias("ordinal"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text")))
    return F.when(_stripped(F.coalesce(content, F.lit(""))) != "", numbered).otherwise(F.expr("cast(array() AS array<struct<ordinal:int,start:int,end:int,text:string>>)"))


def _stripped(c: Column, side: str = "both") -> Column:
    """Without white space of any script at the ends."""
    left, right = r"(?U)^[\s\x1c-\x1f]+", r"(?U)[\s\x1c-\x1f]+$"
    return F.regexp_replace(c, {"left": left, "right": right, "both": f"{left}|{right[4:]}"}[side], "")
