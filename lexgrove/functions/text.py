"""Column expressions on text: everything stays in Catalyst, and no regular expression is ASCII-only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRONOUNS = tuple(
    "me i mine my yours you yourself himself itself herself yourselves ourselves themselves".split()
)
OBJECTIVE, SUBJECTIVE = "Objective", "Subjective"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """Maximal runs without Unicode white space; no empty tokens. Null stays null."""
    return F.regexp_extract_all(_col(text), F.lit(r"(?U)(\S+)"), F.lit(1))


def strip_punctuation(text: Column | str) -> Column:
    """Without characters that are neither word characters nor white space; what they separated is joined."""
    return F.regexp_replace(_col(text), r"(?U)[^\w\s]", "")


def preprocess(text: Column | str, stopwords: list[str] | None = None) -> Column:
    """Lower case, punctuation off, tokens, stop words out; order and repeats stay."""
    words = tokens(strip_punctuation(F.lower(_col(text))))
    if not stopwords:
        return words
    stop = sorted(set(stopwords))  # so many literals are compared by a hash set
    return F.filter(words, lambda w: ~w.isin(*stop))


def ngrams(words: Column | str, n: int) -> Column:
    """Every window of n words, joined by one blank; an empty array if there are fewer. n < 1 is an error.

    `words` should be a column of a projection below, not an expression: each window would evaluate it anew."""
    if n < 1:
        raise ValueError("n must be at least 1")
    w = _col(words)
    if n == 1:
        return w
    last = F.size(w) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(
        F.when(w.isNotNull(), F.array().cast("array<string>"))
    )


def sentence_count(text: Column | str) -> Column:
    """Pieces between . ! and ? that aren't blank."""
    return F.size(F.filter(F.split(_col(text), "[.!?]"), lambda x: x.rlike(r"(?U)\S"))).cast("long")


def pronoun_count(text: Column | str) -> Column:
    return F.regexp_count(_col(text), F.lit(r"(?iU)\b(" + "|".join(PRONOUNS) + r")\b")).cast("long")


def subjectivity(text: Column | str) -> Column:
    """struct(label, score): personal pronouns by sentence, 0 without sentences; Objective below 0.5."""
    n = sentence_count(text)
    score = F.when(n > 0, pronoun_count(text) / n).otherwise(F.when(_col(text).isNotNull(), F.lit(0.0)))
    return F.struct(
        F.when(score < 0.5, OBJECTIVE).when(score.isNotNull(), SUBJECTIVE).alias("label"), score.cast("double").alias("score")
    )


def polarity_label(candidate: Column | str) -> Column:
    """positive, neutral or negative in either spelling that is accepted (all lower case, or capitalised); else null."""
    c = _col(candidate)
    return F.when(c.isin("Positive", "positive", "Neutral", "neutral", "Negative", "negative"), F.initcap(c))


def better_candidate(a: Column | str, b: Column | str) -> Column:
    """Of two struct(label, score) the one with the higher score; the second one if they are equal."""
    x, y = _col(a), _col(b)
    return F.when(x["score"] > y["score"], x).otherwise(y)
