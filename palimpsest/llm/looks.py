"""Visually identical text with different characters.

Values are mapped character by character onto one member of each set of characters that look the same (wide and narrow forms,
blanks of any width, look-alike letters of other scripts, ligatures; invisible characters go). The mapped values are grouped in
SQL under the accent-sensitive, case-sensitive Unicode collation, which also equates composed and decomposed accents and ignores
what has no weight; each class gets a deterministic canonical member, which is joined back to all values of the class.

Mapping and grouping run in the JVM; records are compared by digests of their values, so long texts are shuffled for the grouping
only, and pairs are built from pairs of different spellings, never from all pairs of a class.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.checkpoints import materialise
from palimpsest.functions.ids import clean_id

#: Letters of other scripts and the Latin letter (or sign) that they look like, as pairs.
LOOK_ALIKES = """
АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ҮY ѴV ԚQ ԜW ҺH ӀI ӏl
аa сc ԁd еe һh іi јj оo рp ѕs уy хx ѵv ԛq ԝw үy
ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ϺM
οo νv ϲc ϳj ιi
ՕO ՍU ՏS օo սu հh ցg ոn
ɡg ɑa ɩi ʏy ꓐB ꓑP ꓒd ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓛC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU
‐- ‑- ʼ’ ʻ‘ ⁄/ ∕/
"""
#: Format characters that are visible, so they stay.
VISIBLE_FORMATS = "\u0600\u0601\u0602\u0603\u0604\u0605\u06dd\u070f\u08e2"
#: Characters without any look of their own outside the format category; variation selectors are such, too.
INVISIBLE = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180f\u3164\uffa0"


@cache
def look_tables() -> tuple[str, str, dict[str, str]]:
    """(from, to, longer): characters with the one that stands for them (those beyond the length of ``to`` vanish), and
    characters that several stand for. Everything but the fixed values above follows from the Unicode data by rule."""
    latin = {pair[0]: pair[1:] for pair in LOOK_ALIKES.split()}
    single, longer, gone = {}, {}, []
    for code in range(0x110000):
        c = chr(code)
        category = unicodedata.category(c)
        if category in ("Cn", "Co", "Cs"):
            continue
        selector = category == "Mn" and unicodedata.name(c, "").startswith("VARIATION SELECTOR")
        if (category == "Cf" and c not in VISIBLE_FORMATS) or c in INVISIBLE or selector or (category == "Cc" and c not in "\t\n\r"):
            gone.append(c)
            continue
        if category == "Zs":
            to = " "
        else:
            parts = unicodedata.decomposition(c).split()
            tag = parts.pop(0) if parts and parts[0].startswith("<") else ""
            plain = "".join(chr(int(p, 16)) for p in parts)
            upright = tag == "<font>" and unicodedata.name(c).startswith(("MATHEMATICAL SANS-SERIF ", "MATHEMATICAL MONOSPACE "))
            upright = upright and not {"BOLD", "ITALIC"} & set(unicodedata.name(c).split())
            same = tag in ("<wide>", "<narrow>", "<noBreak>") or upright or (
                tag == "<compat>" and (0x2E80 <= code <= 0x2FDF or 0x2160 <= code <= 0x217F or 0xFB00 <= code <= 0xFB06)
            )
            if (tag and same) or (plain and not tag):  # the untagged decompositions are canonical: the same character
                plain = unicodedata.normalize("NFKC" if tag else "NFD", c)
                to = unicodedata.normalize("NFC", "".join(latin.get(x, x) for x in plain))
            else:
                to = latin.get(c, c)
        if len(to) == 1 and to != c:
            single[c] = to
        elif len(to) > 1 and to[0] != " " and (tag or (code < 0x600 and unicodedata.normalize("NFD", c)[0] in latin)):
            longer[c] = to
    return "".join(single) + "".join(gone), "".join(single.values()), longer


def looks(value: Column) -> Column:
    """``value`` with every character replaced by the one that stands for its look, runs of blanks by one, none at the ends.
    Null stays null; a value without any visible character becomes empty. Case, accents and punctuation stay."""
    from_, to, longer = look_tables()
    spelled = value
    for c, several in longer.items():
        spelled = F.replace(spelled, F.lit(c), F.lit(several))
    spelled = F.when(value.rlike("[" + "".join(longer) + "]"), spelled).otherwise(value)
    mapped = F.when(value.rlike(r"[^\t\n\r\x20-\x7e]"), F.translate(spelled, from_, to)).otherwise(value)  # basic letters stay
    return F.btrim(F.regexp_replace(mapped, "[ \\t]{2,}|\\t", " "), F.lit(" \t\n\r"))


def _digest(value: Column) -> Column:
    return F.unhex(F.sha2(value, 256))


CLASSES = """
SELECT look COLLATE UNICODE AS look, min(struct(value <> look, length(value), value)).value AS canonical
FROM {values}
GROUP BY look COLLATE UNICODE
HAVING min(value) <> max(value)
"""
BACK = """
SELECT DISTINCT v.digest, c.canonical
FROM {values} v JOIN {classes} c ON v.look COLLATE UNICODE = c.look
"""


def look_classes(records: DataFrame, value: str = "value") -> DataFrame:
    """(digest, canonical): the values that have a double, i.e. another string that looks the same, with the canonical member
    of their class. The canonical member is one that already is in mapped form if there is any, then the shortest, then the
    smallest. ``digest`` is the SHA-256 of the value. Null values and those without visible characters are in no class.

    Equal values become one before anything is compared, so a value that many records share is no hot key; they are mapped and
    written once, and read for the grouping and for the join back."""
    values = records.select(F.col(value).alias("value"), _digest(F.col(value)).alias("digest")).where("value IS NOT NULL").distinct()
    values = materialise(values.withColumn("look", looks(F.col("value"))).where("look <> ''"), "values")
    spark = records.sparkSession
    classes = spark.sql(CLASSES, values=values)
    return spark.sql(BACK, values=values, classes=classes)


def text_fields(identity_drafts: DataFrame, observations: DataFrame) -> DataFrame:
    """(field, memory_space, id, value): who and each item of surface_forms of the drafts, content of the observations."""
    part = lambda df, field, key, value: df.select(
        F.lit(field).alias("field"), "memory_space", clean_id(key).alias("id"), value.alias("value")
    )
    return (
        part(identity_drafts, "who", "draft_id", F.col("who"))
        .unionByName(part(identity_drafts, "surface_forms", "draft_id", F.explode("surface_forms")))
        .unionByName(part(observations, "content", "observation_id", F.col("content")))
    )


def doubles(records: DataFrame) -> DataFrame:
    """(field, memory_space, id, value, canonical): the records (field, memory_space, id, value) whose value has a double
    anywhere in the table, with the form that stands for it."""
    classes = look_classes(records)
    return (
        records.withColumn("digest", _digest(F.col("value")))
        .join(classes, "digest")
        .select("field", "memory_space", "id", "value", "canonical")
        .distinct()
    )


def look_alike_pairs(records: DataFrame) -> DataFrame:
    """(field, id_a, id_b), id_a < id_b: different records of one memory_space with values in the same field that look the
    same but are not the same string; each pair once, whatever the number of values that match.

    A record may have several values (rows with the same id) and may be delivered repeatedly. Null ids, spaces and values
    are no case; neither are values without any visible character. Pairs come from pairs of different spellings within a
    field and space, joined with the records of either spelling, so records with equal strings are never paired on the way.
    """
    known = ["field", "memory_space"]
    spelled = (
        records.select(*known, "id", _digest(F.col("value")).alias("digest"))
        .dropna()
        .join(look_classes(records).select("digest", _digest(F.col("canonical")).alias("look")), "digest")
        .distinct()
    )
    spelled = materialise(spelled, "spellings")  # read four times below, and small: only values with a double
    spellings = spelled.select(*known, "look", "digest").distinct()
    one = spellings.withColumnRenamed("digest", "digest_a")
    other = spellings.withColumnRenamed("digest", "digest_b")
    pairs = one.join(other, [*known, "look"]).where("digest_a < digest_b").drop("look")
    side = lambda s: spelled.select(*known, F.col("digest").alias(f"digest_{s}"), F.col("id").alias(f"id_{s}"))
    met = pairs.join(side("a"), [*known, "digest_a"]).join(side("b"), [*known, "digest_b"]).where("id_a <> id_b")
    return met.select("field", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()
