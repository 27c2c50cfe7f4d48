import pytest
from pyspark.sql import functions as F

from lexgrove.functions import text as T


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "text string").select(expr.alias("x")).first()["x"]


def test_tokens_split_on_any_white_space(spark):
    assert one(spark, " a b\t\nc ", T.tokens("text")) == ["a", "b", "c"]
    assert one(spark, "  ", T.tokens("text")) == []
    assert one(spark, None, T.tokens("text")) is None


def test_punctuation_is_unicode_aware(spark):
    assert one(spark, "Café — naïve, don't_x 9!", T.strip_punctuation("text")) == "Café  naïve dont_x 9"


def test_preprocess(spark):
    assert one(spark, "Rust is a great programming language!", T.preprocess("text")) == ["rust", "is", "a", "great", "programming", "language"]
    assert one(spark, "The cat's a CAT", T.preprocess("text", ["the", "a"])) == ["cats", "cat"]


@pytest.mark.parametrize(("text", "n", "want"), [("a b c", 2, ["a b", "b c"]), ("a b", 3, []), ("", 1, []), ("a b", 1, ["a", "b"])])
def test_ngrams(spark, text, n, want):
    df = spark.createDataFrame([(text,)], "text string").select(T.tokens("text").alias("w"))
    assert df.select(T.ngrams("w", n).alias("x")).first()["x"] == want


def test_ngrams_of_nothing_is_an_error():
    with pytest.raises(ValueError):
        T.ngrams("w", 0)


@pytest.mark.parametrize(
    ("text", "label", "score"),
    [("I'm me. You?", "Subjective", 1.5), ("", "Objective", 0.0), ("...", "Objective", 0.0), ("It is mine! Ok. Ok.", "Objective", 1 / 3), ("étémeà.", "Objective", 0.0)],
)
def test_subjectivity(spark, text, label, score):
    got = one(spark, text, T.subjectivity("text"))
    assert got["label"] == label and got["score"] == pytest.approx(score)


def test_subjectivity_of_null(spark):
    got = one(spark, None, T.subjectivity("text"))
    assert got["label"] is None and got["score"] is None


def test_polarity_label_accepts_two_spellings(spark):
    rows = spark.createDataFrame([("positive",), ("Neutral",), ("NEGATIVE",), (None,)], "c string")
    assert [r[0] for r in rows.select(T.polarity_label("c")).collect()] == ["Positive", "Neutral", None, None]


def test_better_candidate_prefers_the_second_of_equals(spark):
    df = spark.sql("select struct('a' as label, 0.5d as score) a, struct('b' as label, 0.5d as score) b")
    assert df.select(T.better_candidate("a", "b").alias("x")).select(F.col("x.label")).first()[0] == "b"
