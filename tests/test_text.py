"""Text functions on literal cases."""

import math

from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.functions.ids import clean_id


def one(spark, column, **values):
    kinds = {str: "string", list: "array<string>", type(None): "string"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return df.select(column.alias("v")).first().v


def test_normalise_and_tokens(spark):
    assert one(spark, text.normalize_text(F.col("a")), a=" a 　b\x1c c\n") == "a b c"
    assert one(spark, text.normalize_text(F.col("a")), a=None) == ""
    assert one(spark, text.tokens(F.col("a")), a="Hello_1, 世界 Öl") == ["hello_1", "世", "界", "l"]
    assert one(spark, text.tokens(F.col("a")), a=None) == []
    assert one(spark, text.casefold(F.col("a")), a="Straße") == "strasse"
    assert one(spark, clean_id("a"), a="\t Mem_1 ") == "mem_1"
    assert one(spark, clean_id("a"), a=" \t") is None


def test_distinct_in_order(spark):
    items = ["B ", "a", None, "b", " ", "A", "c"]
    assert one(spark, text.distinct_in_order(F.col("a")), a=items) == ["B", "a", "c"]
    assert one(spark, text.distinct_in_order(F.col("a"), 2), a=items) == ["B", "a"]
    assert one(spark, text.bounded_unique(F.col("a"), 2), a=["x", "", "x", "y", "z"]) == ["x", "y"]
    assert one(spark, text.merged_uncertainties(F.col("a"), F.col("b")), a=["x", "y"], b=["y", "z"]) == ["x", "y", "z"]


def test_scores(spark):
    assert one(spark, text.overlap_score(F.col("a"), F.col("b")), a="a a b", b="a b c") == 2 / math.sqrt(9)
    assert one(spark, text.overlap_score(F.col("a"), F.col("b")), a="", b="a") == 0
    assert one(spark, text.chargram_score(F.col("a"), F.col("b")), a="abc", b="ab c") == 1.0
    assert one(spark, text.chargram_score(F.col("a"), F.col("b")), a="a", b="a") == 1.0
    assert one(spark, text.chargram_score(F.col("a"), F.col("b")), a="a", b=None) == 0.0
    assert one(spark, text.query_coverage(F.col("a"), F.col("b")), a="x x y", b="x z") == 1 / 3


def test_profiles_and_refs(spark):
    who = F.struct(F.lit("Ann").alias("who"), F.array(F.lit("ann"), F.lit(" ")).alias("surface_forms"), F.array().cast("array<string>").alias("stable_qualifiers"), F.lit("d").alias("definition"))
    assert one(spark, text.identity_text(who), a="") == "who: Ann\ndefinition: d\nsurface_forms: ann"
    assert one(spark, text.display_name(F.col("a"), F.col("b")), a=" ", b=[None, "", "B"]) == "B"
    assert one(spark, text.display_name(F.col("a"), F.col("b")), a=None, b=[]) == "Unknown"
    assert one(spark, text.ref_doc_key(F.col("a")), a="memory:team:x:mem_1") == "mem_1"
    assert one(spark, text.fact_variants(F.col("a")), a="one || two||") == ["one", "two"]
    scope = lambda t: text.rendered_scope(F.lit(t), F.lit("r"), F.lit("e"), F.lit("c"), F.lit("primary"))
    assert one(spark, scope("{run_id}:{case_id}:{scope_alias}"), a="") == "r:c:primary:exec:e"
    assert one(spark, scope("{execution_id}:{case_id}"), a="") == "e:c"


def test_refresh_merge(spark):
    merge = lambda a, b: one(spark, text.merged_refresh(F.col("a"), F.col("b"), "More"), a=a, b=b)
    assert merge("Old text", "the OLD  text is here") == "the OLD  text is here"
    assert merge("a b c", "B C") == "a b c"
    assert merge("one", "two") == "one\n\nMore: two"
    assert merge(None, "two") == "two" and merge("one", " ") == "one"
