"""Inline fixtures for the branches that the test tables don't reach."""

import pytest
from pyspark.sql import functions as F

from lumenloom.functions import text as T
from lumenloom.operators import classify, filters


def value(spark, column, **given):
    row = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, (list, tuple)) else F.array(*[F.lit(x) for x in v]).alias(k) for k, v in given.items()])
    return row.select(column.alias("v")).collect()[0]["v"]


def w(n, extra=""):
    return " ".join(["word"] * n) + extra


@pytest.mark.parametrize(
    ("text", "lang", "ok"),
    [
        (w(7), "en", False), (w(8), "en", True), (w(200), "en", True), (w(201), "en", False), ("山" * 14, "zh", False), ("山" * 15, "zh", True),
        (w(20, " https://a https://b"), "en", False), (w(40, " https://a"), "en", True), (w(8, " Getty Images"), "en", False), ("   ", "en", False), (None, "en", False),
        (w(8) + " 1234567890 1234567890 1234567890 12345", "en", False),
    ],
)
def test_quality(spark, text, lang, ok):
    assert value(spark, filters.quality(F.col("t").cast("string"), F.col("l")), t=text, l=lang) is ok


@pytest.mark.parametrize(("score", "ok"), [(None, True), (0.0, True), (0.5, True), (0.51, False), (float("nan"), True)])
def test_score(spark, score, ok):
    assert value(spark, filters.safe(F.col("s").cast("double")), s=score) is ok


@pytest.mark.parametrize(("text", "lang", "ok"), [("山" * 19, "zh", False), ("山" * 20, "zh", True), (w(8), "en", True), (w(150), "en", True), (w(151), "en", False)])
def test_final_length(spark, text, lang, ok):
    assert value(spark, filters.final_length(F.col("t"), F.col("l")), t=text, l=lang) is ok


def test_han_share_is_strict(spark):
    assert value(spark, T.is_han(F.col("t")), t="山山山abcdefg") is False
    assert value(spark, T.is_han(F.col("t")), t="山山山山abcdefg") is True


@pytest.mark.parametrize(("text", "clean"), [("a castle --ar 16:9 on a hill --v 5", "a castle on a hill"), ("a castle --tile", "a castle --tile")])
def test_flags(spark, text, clean):
    assert value(spark, T.without_flags(F.col("t")), t=text) == clean


def test_tokens(spark):
    assert value(spark, T.tokens(F.col("t"), F.lit("zh")), t="山水") == ["山水"]
    assert value(spark, T.tokens(F.col("t"), F.lit("zh")), t="山水画人") == ["山水画", "水画人"]
    assert value(spark, T.tokens(F.col("t"), F.lit("en")), t=" A  b ") == ["a", "b"]


@pytest.mark.parametrize(("text", "first"), [("The image displays a green hoodie. Worn by a person.", "a green hoodie"), ("A green hoodie.", None), ("This IMAGE shows a cat.\nAnd a dog", "a cat"), ("the image is . x", ". x")])
def test_caption(spark, text, first):
    assert value(spark, T.caption_sentence(F.col("t")), t=text) == first


@pytest.mark.parametrize(("text", "slug"), [("A Red  Car, 1970!", "a-red-car-1970"), ("!!!", "prompt")])
def test_slug(spark, text, slug):
    assert value(spark, T.slug(F.col("t")), t=text) == slug


def test_first_match_is_by_substring_in_order(spark):
    rules = {"S1": ["person"], "S2": ["cat"], "S3": ["education"]}
    assert value(spark, T.first_match(F.col("t"), rules, "S10"), t="higher education") == "S2"
    assert value(spark, T.first_match(F.col("t"), rules, "S10"), t="nothing") == "S10"


@pytest.mark.parametrize(("text", "weak"), [("a logo", True), ("a logo on a poster", False), ("none", True)])
def test_weak_design(spark, text, weak):
    assert value(spark, classify.weak_design(F.col("t")), t=text) is weak


def test_quality_score(spark):
    from lumenloom.plans.corpus import quality_score

    text = "A red car near a wooden house in Paris at sunset, 1970 Fiat"
    for source, score in (("docci", 0.6375), ("unknown", 0.4975)):
        assert round(value(spark, quality_score(F.col("t"), F.col("s"), {"docci": 1.0}), t=text, s=source), 6) == score


def test_small_formats(spark):
    assert value(spark, T.numeric_suffix(F.col("t")), t="checkpoint-123") == 123
    assert value(spark, T.numeric_suffix(F.col("t")), t="best") is None
    assert value(spark, T.padded(F.col("n"), 6), n=12) == "000012"
    assert value(spark, T.fit_length(F.col("a"), 4), a=[1, 2]) == [1, 2, 0, 0]
    assert value(spark, T.fit_length(F.col("a"), 1), a=[1, 2]) == [1]
    assert value(spark, T.generated_lines(F.col("t")), t="# x\n\n1. one\n 2) two \nthree") == ["one", "two", "three"]
    assert value(spark, T.chat(F.col("t")), t="hi").startswith("<|im_start|>user\nhi")
    assert value(spark, T.gigabytes(F.col("n")), n=1610612736) == "1.50 GB"


@pytest.mark.parametrize(
    ("keyword", "caption", "best", "gap", "code"),
    [("S2", None, "S5", 0.9, "S2"), ("S10", None, "S5", 0.06, "S5"), ("S10", None, "S5", 0.05, "S10"), ("S2", "S7", "S5", 0.9, "S7")],
)
def test_hybrid_subject(spark, keyword, caption, best, gap, code):
    c = classify.hybrid_subject(F.lit(keyword), F.lit(caption).cast("string"), F.lit(best), F.lit(gap))
    assert value(spark, c, t="x") == code


@pytest.mark.parametrize(
    ("text", "keyword", "caption", "best", "gap", "code"),
    [
        ("a logo", "T6", None, "T3", 0.2, "T3"), ("a poster", "T6", None, "T3", 0.2, "T6"), ("plain", "T1", None, "T6", 0.9, "T1"), ("plain", "T1", None, "T4", 0.2, "T4"),
        ("plain", "T1", None, "T4", 0.01, "T1"), ("plain", "T2", "T6", "T4", 0.9, "T1"), ("plain", "T2", "T3", "T4", 0.9, "T3"),
    ],
)
def test_hybrid_style(spark, text, keyword, caption, best, gap, code):
    c = classify.hybrid_style(F.col("t"), F.lit(keyword), F.lit("a quiet hill"), F.lit(caption).cast("string"), F.lit(best), F.lit(gap))
    assert value(spark, c, t=text) == code


@pytest.mark.parametrize(("real", "fake", "gap", "bad"), [(0.96, 0.96, 1.0, True), (0.5, 0.5, 1.0, True), (0.7, 0.7, 16.0, True), (0.7, 0.7, 0.05, True), (0.7, 0.96, 1.0, False), (None, 0.7, None, False)])
def test_failing(spark, real, fake, gap, bad):
    assert value(spark, filters.failing(F.lit(real).cast("double"), F.lit(fake), F.lit(gap).cast("double")), t=1) is bad
