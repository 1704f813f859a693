"""Variant spellings of names: which drafts of a memory_space denote the same person or organisation.

Every draft gives names (``who`` and its surface forms) and hints (what its qualifiers and its definition state). A name is
written in a few forms, each a point of a metric space: in full (words folded and sorted; titles, legal forms and known short
forms resolved), joined, with initials, as an acronym, in its Chinese characters or their reading, and so on. Points of one
memory_space and kind of form are joined within a radius of the true Damerau-Levenshtein metric, partitioned in metric space:
pivots are drawn from the points, each point is assigned to a ring of distances around every pivot, points near the border of a
ring are replicated beyond it as far as the triangle inequality asks for, cells that are still large are split by further pivots,
and every cell is joined by itself. Points at distance 0 are forms that names share; at distance 1 one of them is misspelt.

Drafts are linked over the points that meet, as spokes of a star and never in pairs: a point whose drafts have no contradicting
hints links them all, others link only drafts that share hints, too. Connected drafts are one entity; what contradicts is not
paired.

What qualifiers mean is read from the table itself: a value is a qualifier that contains no other one, its kind is the pair of
words between which it stands most often ("in _", "_ office"), so values are compared only with others that stand in such places.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.checkpoints import materialise
from palimpsest.functions.ids import clean_id
from palimpsest.llm.groups import components
from palimpsest.llm.looks import looks
from palimpsest.partitions import spread

#: Known short forms that are read at most; they are a parameter of every task.
MAX_ALIASES = 20_000
#: Radius of the join in Damerau-Levenshtein distance: a letter more, less or different, or two neighbours swapped.
RADIUS = 1
#: Points that a cell may hold before it is split, pivots that split it (besides the empty name), width of a ring around a pivot, and
#: levels of splitting, after which what is still large is compared in blocks.
CELL, PIVOTS, RING, LEVELS = 128, 2, 4, 3
#: Points of a block: a cell that is larger after all levels is cut into blocks, and each two of them are a cell.
BLOCK = 1_000
#: Longest pivot, and the distance from which on names are in the same outermost ring of it.
PIVOT_LETTERS, FAR = 64, 128
#: Shortest form that may be misspelt.
SHORTEST = 8
#: Words of a value that a qualifier states, values that a place in qualifiers must have to be a kind, and kinds that are compared.
VALUE_WORDS, KIND_VALUES, KINDS = 4, 3, 4
#: A hint identifies by itself if this many values of its kind are as frequent as all of them are on average.
IDENTIFYING = 100

#: Titles before and after names, legal forms after firm names, each in lower case.
TITLES = {"dr", "mr", "mrs", "ms", "mx", "miss", "prof", "eng", "sir", "herr", "frau", "sr", "sra", "don", "doña", "the"}
HAN_TITLES = ("老师", "先生", "女士", "小姐", "医生", "经理", "博士", "教授", "主任", "律师")
LEGAL_FORMS = {"ltd", "limited", "inc", "incorporated", "gmbh", "group", "co", "corp", "llc", "plc", "ag", "sa", "bv", "kg"}
HAN_LEGAL_FORMS = ("股份有限公司", "有限责任公司", "有限公司", "集团", "公司")
#: Readings of characters as surnames, where they differ from the usual ones.
SURNAME_READINGS = {"乜": "nie", "澹": "tan", "单": "shan", "曾": "zeng", "仇": "qiu", "解": "xie", "查": "zha", "区": "ou", "任": "ren", "朴": "piao", "盖": "ge", "员": "yun", "尉": "yu", "秘": "bi", "缪": "miao", "种": "chong"}
#: Letters that are not an accented form of a basic letter.
PLAIN_LETTERS = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "þ": "th", "ð": "d"})
#: Kinds of forms that spell a whole name: only in these misspellings are looked for.
WHOLE = ["f", "h"]
HINTS = [f"h{k}" for k in range(KINDS)]
_HINT_WORDS = re.compile(r"[㐀-鿿]+|[^\W㐀-鿿]+")


def fold(text: str) -> str:
    """Lower case without accents."""
    plain = unicodedata.normalize("NFD", text.lower().translate(PLAIN_LETTERS))
    return unicodedata.normalize("NFC", "".join(c for c in plain if not unicodedata.combining(c)))


def _cut(text: str, endings: tuple[str, ...]) -> str:
    return next((text[: -len(e)] for e in endings if text.endswith(e) and len(text) > len(e)), text)


def _han_keys(name: str, readings: dict[str, str]) -> tuple[list[str], list[str]]:
    name = _cut(_cut("".join(c for c in name if "㐀" <= c <= "鿿"), HAN_LEGAL_FORMS), HAN_TITLES)
    if len(name) == 1 or (len(name) == 2 and name[1] == "工"):
        return [], [f"s {name[0]}"]
    if not name:
        return [], []
    strong, weak = [f"h {name}"], []
    if len(name) <= 4:
        first = SURNAME_READINGS.get(name[0], readings.get(name[0], ""))
        given = "".join(readings.get(c, "") for c in name[1:])
        weak += [f"p {' '.join(sorted((first, given)))}", f"s {name[0]}"]
    if len(name) >= 4:
        weak.append(f"x {name}")
    if len(name) >= 6:  # a place may stand before the name of a firm
        weak += [f"x {name[2:]}", f"x {name[3:]}"]
    return strong, weak


def name_keys(look: str, aliases: dict[str, list[str]], readings: dict[str, str], alone: bool) -> tuple[list[str], list[str]]:
    """(strong keys, weak keys) of a name in mapped form. ``alone``: whether a single word may stand for the whole name (as a
    login, an acronym); among surface forms it does not. The first strong key has the words in order of the alphabet. Where short
    forms stand for several names, there is a spelling for each other reading of one word, so keys grow with the sum of the readings;
    names that agree only if two words take a later reading have no key in common."""
    if any("㐀" <= c <= "鿿" for c in look):
        return _han_keys(look, readings)
    text = re.sub(r"\s*[(\[{][^)\]}]*[)\]}]?\s*$", "", look.strip())
    text = re.sub(r"\s+/.*$", "", text)
    caps = re.fullmatch(r"[A-Z]{2,6}", text)
    if caps:
        return [], [f"c {text.lower()}"]
    text = fold(text)
    if "," in text:
        head, _, tail = text.partition(",")
        text = f"{tail.strip()} {head}" if " " not in head.strip() and tail.strip() else head
    unhyphened = [t for t in re.sub(r"[-'’]", "", text).split() if t.strip(".")]
    raw = [t for t in re.split(r"[\s\-_]+|(?<=\w)\.(?=\w)", text) if t.strip(".'’,;:")]
    words = [t.strip(".'’,;:") for t in raw]
    while len(words) > 1 and words[0] in TITLES:
        words = words[1:]
    initials = "".join(w[0] for w in words)
    core = list(words)
    while len(core) > 1 and core[-1] in LEGAL_FORMS:
        core.pop()
    firm = len(core) < len(words) or len(core) > 2
    short = any(t.endswith(".") and len(t) > 2 and t.strip(".") in core and t.strip(".") not in aliases for t in raw)
    strong, weak = [], []
    choices = [aliases.get(w) or [w] for w in core]
    several = any(len(c) > 1 for c in choices)
    first = [c[0] for c in choices]
    for variant in [first, *([*first[:i], other, *first[i + 1 :]] for i, c in enumerate(choices) for other in c[1:])]:
        long = [w for w in variant if len(w) > 1]
        one = [w for w in variant if len(w) == 1]
        if len(long) >= 2:
            own = weak if several else strong
            own += [f"f {' '.join(sorted(long))}", f"j {''.join(long)}"]
            weak.append(f"d {' '.join(sorted(long[:2]))}")
            if len(long) == 2 and not firm:
                a, b = long
                weak += [f"i {a[0]} {b}", f"i {b[0]} {a}", f"p {' '.join(sorted(long))}"]
                weak += [f"a {a} {b[:4]}", f"a {b} {a[:4]}", f"n {b}"]
        elif len(long) == 1 and one:
            weak.append(f"i {one[0]} {long[0]}")
        elif len(long) == 1 and alone and not firm and len(long[0]) > 4:
            weak += [f"i {long[0][0]} {long[0][1:]}"]
            strong.append(f"j {long[0]}")
    if len(unhyphened) == 2 and "-" in text:
        weak.append(f"p {' '.join(sorted(t.strip('.') for t in unhyphened))}")
    if short and strong:  # a word is shortened, so the name is not spelt in full
        strong, weak = [], [k for k in weak if k[0] in "ad"]
    if firm or len(core) == 2:
        weak += [f"c {initials}"] + ([f"c {initials[: len(core)]}"] if len(core) < len(words) else [])
    return list(dict.fromkeys(strong)), list(dict.fromkeys(weak))


def hint_texts(qualifiers: list[str | None] | None, definition: str | None) -> list[dict]:
    """The words of each qualifier and of the definition, folded, as (text, bare); ``bare`` is true for qualifiers."""
    told = {}
    for text, bare in [*((q, True) for q in qualifiers or []), (definition, False)]:
        words = " ".join(_HINT_WORDS.findall(fold(text or "")))
        if words:
            told[words] = told.get(words, False) or bare
    return [{"text": t, "bare": b} for t, b in told.items()]


def character_readings(spark: SparkSession) -> dict[str, str]:
    """The Latin readings of the Chinese characters, by the transliteration rules of the ICU library that Spark brings along. A
    session without the JVM at hand (a remote one) has no such rules and raises, since results would differ."""
    jvm = getattr(spark, "_jvm", None)
    if jvm is None:
        raise RuntimeError("readings of Chinese names need the JVM of a classic Spark session")
    rules = jvm.com.ibm.icu.text.Transliterator.getInstance("Han-Latin; Latin-ASCII")
    characters = [chr(c) for c in range(0x4E00, 0xA000)]
    said = rules.transliterate("\n".join(characters)).split("\n")
    return {c: r.strip() for c, r in zip(characters, said, strict=True) if r.strip().isascii() and r.strip().isalpha()}


def alias_table(name_aliases: DataFrame) -> dict[str, list[str]]:
    """{short form: full forms}, read as a parameter; more than ``MAX_ALIASES`` rows are refused."""
    rows = name_aliases.select("short_form", "full_form").dropna().distinct().limit(MAX_ALIASES + 1).collect()
    if len(rows) > MAX_ALIASES:
        raise ValueError(f"more than {MAX_ALIASES} known short forms")
    out: dict[str, set[str]] = {}
    for short, full in rows:
        if fold(short).strip():
            out.setdefault(fold(short).strip(" ."), set()).add(fold(full).strip())
    return {k: sorted(v) for k, v in out.items()}


# --- metric space ----------------------------------------------------------------------------------------------------------


def edit_distances(names: list[str], pivot: str) -> np.ndarray:
    """The Damerau-Levenshtein distance (with swaps of neighbours between which letters were put in or out: a true metric) of each
    name to the pivot, at most ``FAR``; a name longer than the pivot by ``FAR`` is not even compared."""
    out = np.full(len(names), FAR, np.int64)
    at = sorted((i for i, n in enumerate(names) if len(n) - len(pivot) < FAR), key=lambda i: len(names[i]))
    for low in range(0, len(at), 1024):  # names of like length together, in arrays of bounded size
        out[at[low : low + 1024]] = _distances([names[i] for i in at[low : low + 1024]], pivot)
    return out


def _distances(names: list[str], pivot: str) -> np.ndarray:
    sizes = np.array([len(n) for n in names])
    width, rows, m = int(sizes.max()), np.arange(len(names)), len(pivot)
    letters = np.zeros((width, len(names)), np.int32)
    for row, n in enumerate(names):
        letters[: len(n), row] = [ord(c) for c in n]
    d = np.full((m + 2, width + 2, len(names)), m + width, np.int16)  # d[i + 1, j + 1]: the first i letters of the pivot, j of the name
    d[1:, 1] = np.arange(m + 1)[:, None]
    d[1, 1:] = np.arange(width + 1)[:, None]
    last_row = np.zeros((width, len(names)), np.int16)  # where the pivot had each letter of the name last
    for i in range(1, m + 1):
        same = letters == ord(pivot[i - 1])
        last_column = np.zeros(len(names), np.int16)
        for j in range(1, width + 1):
            k, hit = last_row[j - 1], same[j - 1]
            swapped = d[k, last_column, rows] + (i - k) + (j - last_column) - 1
            edited = np.minimum(np.minimum(d[i, j] + ~hit, d[i + 1, j] + 1), d[i, j + 1] + 1)
            d[i + 1, j + 1] = np.minimum(edited, swapped)
            last_column[hit] = j
        last_row[same] = i
    return np.minimum(d[m + 1, sizes + 1, rows], FAR)


def split_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(point columns, cell) of points (.., form, cell, pivots): the new cells of each point, one for each combination of the rings
    that it is in. A point is at home in ring d // RING of a pivot; within ``RADIUS`` below the next ring it is in that, too. Of two
    points within the radius, whose distances to the pivot differ by no more than that, one is so in the home ring of the other."""
    for batch in batches:
        at: dict[int, list[int]] = {}
        for i, c in enumerate(batch.column("cell").to_pylist()):
            at.setdefault(c, []).append(i)
        forms = batch.column("form").to_pylist()
        taken, cells = [], []
        for cell, rows in at.items():
            own = [forms[i] for i in rows]
            pivots = batch.column("pivots")[rows[0]].as_py()
            distances = [np.array([len(f) for f in own]), *(edit_distances(own, p) for p in pivots if p)]
            placed = [(i, np.uint64(cell & 0xFFFFFFFFFFFFFFFF)) for i in range(len(own))]
            with np.errstate(over="ignore"):
                for d in distances:
                    ring, beyond = d // RING, (d + RADIUS) // RING
                    placed = [(i, (c ^ np.uint64(r + 1)) * np.uint64(0x9E3779B97F4A7C15)) for i, c in placed for r in range(int(ring[i]), int(beyond[i]) + 1)]
                    placed = [(i, c ^ (c >> np.uint64(31))) for i, c in placed]
            taken += [rows[i] for i, _ in placed]
            cells += [int(c) for _, c in placed]
        out = batch.take(pa.array(taken, pa.int64()))
        columns = [out.column(n) for n in ("memory_space", "kind", "form")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.array(cells, np.uint64).view(np.int64))], names=["memory_space", "kind", "form", "cell"])


POINT = ["memory_space", "kind", "form"]


def metric_cells(points: DataFrame) -> DataFrame:
    """(memory_space, kind, form, cell): the cells of different points; any two points of one space and kind within the radius are
    in some cell together. Cells are split while one is larger than ``CELL``; what is so after ``LEVELS`` splits (names that lie
    too close together for any pivot) is cut into blocks, all pairs of which are cells, so that no cell exceeds a bound."""
    points = points.select(*POINT, F.xxhash64("memory_space", "kind").alias("cell"))
    for level in range(LEVELS + 1):
        drawn = [F.min(F.when(F.length("form") <= PIVOT_LETTERS, F.struct(F.xxhash64("form", F.lit(10 * level + k)), "form")))["form"] for k in range(PIVOTS)]
        large = points.groupBy("cell").agg(F.count("*").alias("n"), F.array(*drawn).alias("pivots")).where(F.col("n") > (CELL if level < LEVELS else BLOCK))
        large = materialise(large, "large")
        if large.isEmpty():
            return points
        split = points.join(large, "cell")
        rest = points.join(large.select("cell"), "cell", "left_anti")
        if level == LEVELS:
            blocks = F.ceil(F.col("n") / BLOCK).cast("int")
            split = split.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("form"), "blocks"))
            split = split.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            split = split.select(*POINT, F.xxhash64("cell", F.least("block", "with"), F.greatest("block", "with")).alias("cell"))
        else:
            split = split.select(*POINT, "cell", "pivots").mapInArrow(split_cells, "memory_space string, kind string, form string, cell long")
        points = materialise(rest.select(*POINT, "cell").unionByName(split), "cells")
    return points


def near_points(points: DataFrame) -> DataFrame:
    """(memory_space, kind, form_a, form_b), form_a < form_b: different points (memory_space, kind, form) at distance 1, each pair
    once, by an exact join of every cell. Points shorter than ``SHORTEST`` letters have no neighbours."""
    points = points.where(F.length("form") >= SHORTEST)
    several = points.groupBy("memory_space", "kind").agg(F.count("*").alias("n")).where("n > 1")
    cells = metric_cells(points.join(several.select("memory_space", "kind"), ["memory_space", "kind"], "left_semi"))
    one = cells.select("memory_space", "kind", "cell", F.col("form").alias("form_a"))
    other = cells.select("memory_space", "kind", "cell", F.col("form").alias("form_b"))
    met = one.join(other, ["memory_space", "kind", "cell"]).where(
        (F.col("form_a") < F.col("form_b")) & (F.abs(F.length("form_a") - F.length("form_b")) <= 1) & (F.levenshtein("form_a", "form_b", 2) >= 1)
    )
    swap = F.expr(
        "length(form_a) = length(form_b) AND exists(sequence(1, length(form_a) - 1), i -> "
        "concat(left(form_a, i - 1), substr(form_a, i + 1, 1), substr(form_a, i, 1), substr(form_a, i + 2)) = form_b)"
    )
    return met.where((F.levenshtein("form_a", "form_b") == 1) | swap).drop("cell").distinct()


# --- drafts ----------------------------------------------------------------------------------------------------------------


def read_drafts(drafts: DataFrame, name_aliases: DataFrame) -> DataFrame:
    """(draft, memory_space, who, strong, weak, told) of every draft with an id and a space; repeated deliveries once.
    ``strong`` and ``weak`` are arrays of keys, ``told`` an array of the (text, bare) that hints are read from."""
    aliases, readings = alias_table(name_aliases), character_readings(drafts.sparkSession)
    shared = drafts.sparkSession.sparkContext.broadcast((aliases, readings))  # both of bounded size

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aliases, readings = shared.value
        for batch in batches:
            d = batch.to_pydict()
            strong, weak, told = [], [], []
            for look, forms, qualifiers, definition in zip(d["look"], d["forms"], d["stable_qualifiers"], d["definition"], strict=True):
                keys: tuple[dict, dict] = ({}, {})
                for name, alone in [(look, True), *((f, False) for f in forms or [])]:
                    for own, found in zip(keys, name_keys(name, aliases, readings, alone) if name else ((), ()), strict=True):
                        own.update(dict.fromkeys(found))
                strong.append(list(keys[0]))
                weak.append([k for k in keys[1]])
                told.append(hint_texts(qualifiers, definition))
            keys_type = pa.list_(pa.string())
            told_type = pa.list_(pa.struct([("text", pa.string()), ("bare", pa.bool_())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("draft"), batch.column("memory_space"), batch.column("who"), pa.array(strong, keys_type), pa.array(weak, keys_type), pa.array(told, told_type)],
                names=["draft", "memory_space", "who", "strong", "weak", "told"],
            )

    told = drafts.select(
        clean_id("draft_id").alias("draft"),
        "memory_space",
        "who",
        looks(F.col("who")).alias("look"),
        F.transform("surface_forms", looks).alias("forms"),
        "stable_qualifiers",
        "definition",
    )
    told = told.where("draft IS NOT NULL AND memory_space IS NOT NULL").dropDuplicates(["draft"])
    schema = "draft string, memory_space string, who string, strong array<string>, weak array<string>, told array<struct<text:string,bare:boolean>>"
    return spread(told, "draft").mapInArrow(read, schema)


PHRASES = f"""
flatten(transform(sequence(1, size(words)), i -> transform(sequence(1, least({VALUE_WORDS}, size(words) - i + 1)), n -> struct(
  array_join(slice(words, i, n), ' ') AS value, coalesce(get(words, i - 2), '^') AS before, coalesce(get(words, i + n - 1), '$') AS after, n < size(words) AS inside))))
"""


def hint_values(told: DataFrame) -> DataFrame:
    """(text, kind, value): what the different texts (text, bare) state.

    A value is a qualifier of up to ``VALUE_WORDS`` words that contains no other one, or a word with a digit; it is stated wherever
    its words stand. Its kind is the place (the words before and after it) that most values stand in of those where it stands
    itself, if at least ``KIND_VALUES`` do, with the script of its letters (a translation contradicts nothing); without such a
    place it is of the kind ``-``.
    """
    words = told.select("text", "bare", F.split("text", " ").alias("words"))
    phrases = materialise(words.select("text", "bare", F.explode(F.expr(PHRASES)).alias("p")).select("text", "bare", "p.*"), "phrases")
    qualifiers = told.where("bare").select(F.col("text").alias("value"))
    number = (~F.col("value").contains(" ")) & F.col("value").rlike("[0-9]")
    known = phrases.where(~number).join(qualifiers, "value", "left_semi").unionByName(phrases.where(number))
    containing = known.where("inside AND bare").select(F.col("text").alias("value")).distinct()
    stated = materialise(known.join(containing, "value", "left_anti"), "stated")
    place = stated.where("inside").groupBy("before", "after", "value").agg(F.count("*").alias("n"))
    places = place.groupBy("before", "after").agg(F.count("*").alias("values"), F.sum("n").alias("times")).where(F.col("values") >= KIND_VALUES)
    best = place.join(places, ["before", "after"]).groupBy("value").agg(F.max(F.struct("values", "times", "before", "after")).alias("at"))
    script = F.when(F.col("value").rlike("[㐀-鿿]"), F.lit("han"))
    kinds = best.select("value", F.concat_ws(" ", F.col("at.before"), F.col("at.after"), script).alias("kind"))
    return stated.select("text", "value").join(kinds, "value", "left").select("text", F.coalesce("kind", F.lit("-")).alias("kind"), "value").distinct()


def with_hints(read: DataFrame) -> tuple[DataFrame, list[bool]]:
    """(``read``, whose drafts have a number ``id``, with a column for each of the ``KINDS`` kinds of hints that most drafts state, whether each kind identifies by
    itself); see ``hint_values``. Of several values of one kind the smallest counts."""
    told = materialise(read.select("id", F.explode("told").alias("t")).select("id", "t.*"), "told")
    values = hint_values(told.groupBy("text").agg(F.max("bare").alias("bare")))
    given = materialise(told.select("id", "text").join(values, "text").select("id", "kind", "value").distinct(), "hints")
    counts = given.groupBy("kind", "value").agg(F.count("*").alias("n")).groupBy("kind")
    even = F.sum("n") * F.sum("n") / F.sum(F.col("n") * F.col("n"))  # as many equally frequent values make two drafts agree as often
    top = counts.agg(F.sum("n").alias("n"), even.alias("even")).orderBy(F.desc("n"), "kind").limit(KINDS).collect()  # KINDS rows
    names_of = [r["kind"] for r in top] + [None] * (KINDS - len(top))
    each = given.groupBy("id").agg(*[F.min(F.when(F.col("kind") == F.lit(k), F.col("value"))).alias(h) for h, k in zip(HINTS, names_of, strict=True)])
    return read.drop("told").join(each, "id", "left"), [r["even"] >= IDENTIFYING for r in top] + [False] * (KINDS - len(top))


def _agree() -> Column:
    """Whether a group has at most one value of every hint."""
    same = F.lit(True)
    for h in HINTS:
        same = same & F.coalesce(F.min(h) == F.max(h), F.lit(True))
    return same


def evidence(key: str, identifying: list[bool]) -> list[Column]:
    """The key together with each hint that identifies by itself, and with each two hints; null where a draft lacks them."""
    sets = [[h] for h, alone in zip(HINTS, identifying, strict=True) if alone]
    sets += [[HINTS[i], HINTS[j]] for j in range(KINDS) for i in range(j) if not (identifying[i] or identifying[j])]
    return [with_hint(key, *s) for s in sets]


def with_hint(key: str, *hints: str) -> Column:
    told = F.concat_ws("|", key, *[F.concat(F.lit(h), F.lit(" "), h) for h in hints])
    return F.when(F.expr(" AND ".join(f"{h} IS NOT NULL" for h in hints)), told)


def links(known: DataFrame, identifying: list[bool]) -> DataFrame:
    """(a, b): stars that connect drafts of one entity, by their numbers; b is the smallest draft at a point, or at two, that has what is
    required besides."""
    either = F.expr("concat(transform(strong, k -> struct(k AS key, true AS full)), transform(weak, k -> struct(k AS key, false AS full)))")
    spelt = known.select("id", "memory_space", *HINTS, F.get("strong", 0).alias("name"), F.explode(either).alias("k"))
    spelt = materialise(spelt.select("id", "memory_space", *HINTS, "name", "k.*"), "spelt")
    at = ["memory_space", "key", "full"]
    summary = [(F.min("id") != F.max("id")).alias("several"), _agree().alias("clear"), F.min("name").alias("least"), F.max("name").alias("most"), *[F.min(h).alias(f"{h}_k") for h in HINTS]]
    points = materialise(spelt.groupBy(*at).agg(*summary), "points")
    exploded = lambda df, target: df.select("memory_space", "id", F.explode(F.filter(target, lambda x: x.isNotNull())).alias("b"))

    # points at distance 0: names in full need a hint in common only where hints contradict, other forms nearly always
    meeting = spelt.join(points.where("several").select(*at, "clear", "least", "most"), at)  # most points are of one draft, and link none
    certain = F.when(F.col("full"), F.col("clear")).otherwise(F.col("clear") & (F.col("least") == F.col("most")) & ~F.substring("key", 1, 1).isin("s", "n"))
    any_hint = F.array(*[with_hint("key", h) for h in HINTS])
    target = F.when(certain, F.array("key")).when(F.col("full"), any_hint).otherwise(F.array(*evidence("key", identifying)))
    shared = exploded(meeting, target)

    # points at distance 1: with hints in common, or names in full where nothing contradicts
    point = points.select("memory_space", F.substring("key", 1, 1).alias("kind"), F.expr("substring(key, 3)").alias("form"), "full", "clear", *[f"{h}_k" for h in HINTS])
    near = materialise(near_points(point.where(F.col("kind").isin(WHOLE)).select(*POINT).distinct()), "near")
    names = point.where("full AND kind = 'f'")
    side = lambda s: names.select(*[F.col(c) for c in ("memory_space", "kind")], F.col("form").alias(f"form_{s}"), F.col("clear").alias(f"clear_{s}"), *[F.col(f"{h}_k").alias(f"{h}_{s}") for h in HINTS])
    both = near.join(side("a"), ["memory_space", "kind", "form_a"], "left").join(side("b"), ["memory_space", "kind", "form_b"], "left")
    no_clash = F.coalesce(F.col("clear_a") & F.col("clear_b"), F.lit(False))
    for h in HINTS:
        no_clash = no_clash & F.coalesce(F.col(f"{h}_a") == F.col(f"{h}_b"), F.lit(True))
    two = both.select("memory_space", F.concat_ws("~", "kind", "form_a", "form_b").alias("two"), no_clash.alias("no_clash"), F.explode(F.array(F.concat_ws(" ", "kind", "form_a"), F.concat_ws(" ", "kind", "form_b"))).alias("key"))
    target = F.when(F.col("no_clash"), F.array("two")).otherwise(F.array(*evidence("two", identifying)))
    misspelt = exploded(spelt.join(two, ["memory_space", "key"]), target)

    found = materialise(shared.unionByName(misspelt), "links")
    # a key that one draft has links nothing; most keys are such
    met = found.groupBy("memory_space", "b").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last")
    return found.join(met, ["memory_space", "b"]).where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b")).distinct()


def draft_entities(drafts: DataFrame, name_aliases: DataFrame) -> DataFrame:
    """(draft, memory_space, who, hints, entity) of every draft with an id and a space. ``entity`` is equal
    for drafts that denote the same entity of the space; a draft that nothing links is its own. Null and empty names, surface
    forms and qualifiers are ignored. No drafts give no rows. Other columns of the tables are ignored."""
    numbered = read_drafts(drafts, name_aliases).withColumn("id", F.monotonically_increasing_id())  # written once, so numbers are fixed
    known, identifying = with_hints(materialise(numbered, "read"))
    known = materialise(known, "drafts")
    entity = components(links(known, identifying)).select(F.col("v").alias("id"), F.col("root").alias("entity"))
    return known.drop("strong", "weak").join(entity, "id", "left").withColumn("entity", F.coalesce("entity", "id")).drop("id")


def variant_pairs(drafts: DataFrame, name_aliases: DataFrame) -> DataFrame:
    """(draft_id_a, draft_id_b), a < b: drafts of one entity whose stored ``who`` strings are not identical and whose hints do
    not contradict each other; see ``draft_entities``. Drafts with a null ``who`` are in no pair.

    Pairs are made from the different (who, hints) of an entity and then given their drafts, so equal drafts never meet.
    """
    found = draft_entities(drafts, name_aliases).where("who IS NOT NULL")
    spelling = ["memory_space", "entity", "who", *HINTS]
    found = materialise(found.withColumn("spelling", F.sha2(F.to_json(F.struct(*spelling)), 256)), "entities")
    kinds = found.select(*spelling, "spelling").distinct()
    mine = kinds.select("memory_space", "entity", *[F.col(c).alias(f"{c}_a") for c in ("who", *HINTS, "spelling")])
    theirs = kinds.select("memory_space", "entity", *[F.col(c).alias(f"{c}_b") for c in ("who", *HINTS, "spelling")])
    condition = F.col("spelling_a") < F.col("spelling_b")
    pairs = mine.join(theirs, ["memory_space", "entity"]).where(condition & (F.col("who_a") != F.col("who_b")))
    for h in HINTS:
        pairs = pairs.where(F.coalesce(F.col(f"{h}_a") == F.col(f"{h}_b"), F.lit(True)))
    side = lambda s: found.select(F.col("spelling").alias(f"spelling_{s}"), F.col("draft").alias(f"draft_{s}"))
    out = pairs.select("spelling_a", "spelling_b").join(side("a"), "spelling_a").join(side("b"), "spelling_b")
    return out.select(F.least("draft_a", "draft_b").alias("draft_id_a"), F.greatest("draft_a", "draft_b").alias("draft_id_b"))
