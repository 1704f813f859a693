import pytest
from pyspark.sql import functions as F

from palimpsest.llm import looks

SAME = ["Ａｎｎ Ｌｅｅ", "Ann Lee", "Ann Lee", "Аnn Lеe", "An​n L­ee", " Ann  Lee ", "Ann\tLee", "Ann Lee﻿"]


def test_values_that_look_the_same(spark):
    values = ["Ann Lee", *SAME, "ann Lee", "Ánn Lee", "Ann-Lee", "Ann\nLee", "AnnLee"]
    got = [r.v for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", looks.looks(F.col("v")).alias("v")).orderBy("i").collect()]
    assert got[: len(SAME) + 1] == ["Ann Lee"] * (len(SAME) + 1)
    assert not set(got[len(SAME) + 1 :]) & {"Ann Lee"} and len(set(got[len(SAME) + 1 :])) == 5


PAIRS = [("ﬁsh", "fish"), ("K9", "K9"), ("⽔", "水"), ("理", "理"), ("x‑y", "x-y"), ("ｶﾞ", "ガ"), ("ё", "ë"), ("é", "é"), ("Ⅻ", "XII"), ("ў", "y̆"), ("𝖠nn", "Ann"), ("A\U000e0041nn", "Ann"), ("葛\U000e0100", "葛"), ("\U0002f804", "你"), ("a\x00b", "ab")]


@pytest.mark.parametrize(("a", "b"), PAIRS)
def test_pairs_are_doubles(spark, a, b):
    df = spark.createDataFrame([("who", "s", "1", a), ("who", "s", "2", b)], "field string, memory_space string, id string, value string")
    assert [tuple(r) for r in looks.look_alike_pairs(df).collect()] == [("who", "1", "2")]


def test_pairs(spark):
    rows = [
        ("who", "s", "d1", "Ann"), ("who", "s", "d1", "Ann"), ("who", "s", "d2", "Аnn"), ("who", "s", "d3", "Ann"), ("who", "t", "d4", "Аnn"), ("who", "s", "d5", "ann"),
        ("content", "s", "d2", "Ann"), ("who", "s", "d6", None), ("who", "s", "d7", "​"), ("who", "s", "d8", ""), (None, "s", "d9", "Ann"), ("who", None, "d9", "Аnn"), ("who", "s", None, "Аnn"),
        ("forms", "s", "d1", "X y"), ("forms", "s", "d1", "Х y"), ("forms", "s", "d2", "X y"), ("forms", "s", "d3", "X　y"),
    ]
    df = spark.createDataFrame(rows, "field string, memory_space string, id string, value string")
    got = sorted(tuple(r) for r in looks.look_alike_pairs(df).collect())
    assert got == [("forms", "d1", "d2"), ("forms", "d1", "d3"), ("forms", "d2", "d3"), ("who", "d1", "d2"), ("who", "d2", "d3")]
    forms = {(r.id, r.field): r.canonical for r in looks.doubles(df).where("field = 'who' AND memory_space = 's' AND id IS NOT NULL").collect()}
    assert set(forms.values()) == {"Ann"} and set(forms) == {("d1", "who"), ("d2", "who"), ("d3", "who")}
    assert looks.look_alike_pairs(df.limit(0)).count() == 0


def test_long_texts_and_fields(spark):
    long = "слово word " * 20_000
    drafts = spark.createDataFrame([("D1 ", "s", "Bob", ["Bob", None, ""]), ("d2", "s", None, None)], "draft_id string, memory_space string, who string, surface_forms array<string>")
    obs = spark.createDataFrame([("o1", "s", long), ("o2", "s", long.replace(" ", " "))], "observation_id string, memory_space string, content string")
    assert [tuple(r) for r in looks.look_alike_pairs(looks.text_fields(drafts, obs)).collect()] == [("content", "o1", "o2")]
