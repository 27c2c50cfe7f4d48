"""Readers: stop words, one-token-a-line corpora, saved embedding models, scorers."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL_SCHEMA = (
    "vocab map<string,bigint>, index_to_word array<string>, input_vectors array<array<double>>, output_vectors array<array<double>>, "
    "window_size bigint, embedding_dim bigint, negative_samples bigint"
)


def default_stopwords() -> list[str]:
    """The library's own list of English function words and contractions, with and without apostrophes, as punctuation is taken off before words
    are compared. A few hundred words, so that it can be a literal of a plan."""
    return (resources.files("lexgrove") / "resources" / "stopwords.txt").read_text("utf-8").split()


def read_stopwords(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """(word): one word a line, trimmed, repeats and all; appended to `known` if given. Blank lines are skipped."""
    new = spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''")
    return new if known is None else known.select("word").unionByName(new)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(pos, word): one token a line, taken as it is; pos rises along the files."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("pos"), F.col("value").alias("word"))


def load_vectors_lines(spark: SparkSession, path: str) -> DataFrame:
    """(idx, word, input, output) of JSON lines, read in parallel: a file of any size is split, and only at ends of lines, never inside a
    character."""
    return spark.read.schema("idx long, word string, input array<double>, output array<double>").json(path)


def load_model_json(spark: SparkSession, path: str) -> DataFrame:
    """One saved embedding model as one row, all fields of it."""
    return spark.read.schema(MODEL_SCHEMA).option("multiLine", True).json(path)


def model_vectors(model: DataFrame) -> DataFrame:
    """(idx, word, input, output) of a model row. The word of an index is the one that the vocabulary gives it."""
    vocab = model.select(F.explode("vocab").alias("word", "idx"))
    rows = model.select(F.posexplode(F.arrays_zip(F.col("input_vectors").alias("input"), F.col("output_vectors").alias("output"))).alias("idx", "v"))
    return vocab.join(rows, "idx").select("idx", "word", F.col("v.input").alias("input"), F.col("v.output").alias("output"))


def embedding_of(vectors: DataFrame, words: DataFrame) -> DataFrame:
    """words(word) with their input vector; null for words that aren't in the vocabulary."""
    return words.join(vectors.select("word", "input"), "word", "left")


@dataclass
class ScorerConfig:
    """Files of a local polarity model, which all executors can read; see sentiment.save_scorer and sentiment.load_scorer."""

    model: str = "models/model.jsonl"
    config: str = "models/config.json"


@dataclass
class ApiConfig:
    """Address and token of a hosted polarity service; by default from the environment, and an error if that has none."""

    url: str = field(default_factory=lambda: os.environ.get("POLARITY_API_URL", ""))
    token: str = field(default_factory=lambda: os.environ.get("POLARITY_API_TOKEN", ""), repr=False)

    def __post_init__(self) -> None:
        if not self.url or not self.token:
            raise ValueError("a polarity service needs an address and a token")
