"""Subjectivity by rule and polarity by a scorer that the caller supplies."""

from __future__ import annotations

import json
import math
import re
import urllib.request
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.functions import text as T
from lexgrove.sources.text_files import ApiConfig, ScorerConfig

Scorer = Callable[[list[str]], list[tuple[str, float]]]


def score(texts: DataFrame, make: Callable[[], Scorer], source: str = "local", text: str = "text") -> DataFrame:
    """texts with polarity struct(source, label, score).

    make() is called once for each Python worker and gives a function from a list of texts to (label, score) of each: a
    model loaded there, or the client of a service. Labels other than positive, neutral and negative, in either
    accepted spelling, become null. A null text has no polarity.
    """

    @F.pandas_udf("struct<label: string, score: double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = make()
        for s in batches:
            some = s.notna()
            out = pd.DataFrame({"label": pd.Series(None, index=s.index, dtype=object), "score": pd.Series(None, index=s.index, dtype=float)})
            if some.any():
                out.loc[some, ["label", "score"]] = [list(x) for x in scorer(s[some].tolist())]
                out["score"] = out["score"].astype(float)
            yield out

    p = texts.withColumn("__p", run(F.col(text)))
    made = F.when(F.col("__p.score").isNotNull(), F.struct(F.lit(source).alias("source"), T.polarity_label("__p.label").alias("label"), F.col("__p.score").alias("score")))
    return p.withColumn("polarity", made).drop("__p")


def local_label(candidate: str) -> str:
    """Two-way label of a local model."""
    return "Positive" if candidate.lower() == "positive" else "Negative"


def top_of_two(texts: DataFrame, first: str, second: str) -> DataFrame:
    """texts with `best`: of two struct(label, score) columns the first if its score is strictly higher, else the second."""
    return texts.withColumn("best", T.better_candidate(first, second))


def analyze(texts: DataFrame, make: Callable[[], Scorer] | None = None, text: str = "text") -> DataFrame:
    """texts with content, polarity and subjectivity; polarity is Neutral, 0.0 without a scorer."""
    out = texts.withColumn("subjectivity", T.subjectivity(text)).withColumn("content", F.col(text))
    if make is None:
        return out.withColumn("polarity", F.struct(F.lit("none").alias("source"), F.lit("Neutral").alias("label"), F.lit(0.0).alias("score")))
    return score(out, make, text=text)


def train(rated: DataFrame, text: str = "text", positive: str = "positive") -> DataFrame:
    """(token, weight) from rated(text, positive boolean): naive Bayes with add-one smoothing; weight is the log of how much likelier a token
    is in positive texts than in the others. One aggregation by token over all rows; rows without text or rating don't count."""
    rows = rated.where(F.col(text).isNotNull() & F.col(positive).isNotNull()).select(F.explode(T.preprocess(text)).alias("token"), F.col(positive).alias("y"))
    counts = rows.groupBy("token").agg(F.count(F.when(F.col("y"), 1)).alias("p"), F.count(F.when(~F.col("y"), 1)).alias("n"))
    total = counts.agg(F.sum("p").alias("tp"), F.sum("n").alias("tn"), F.count(F.col("p") + F.col("n")).alias("v"))
    odds = F.ln((F.col("p") + 1) / (F.col("tp") + F.col("v"))) - F.ln((F.col("n") + 1) / (F.col("tn") + F.col("v")))
    return counts.crossJoin(F.broadcast(total)).select("token", odds.alias("weight"))  # total is one row


def _polarity(z: Column, source: str) -> Column:
    z = F.round(F.coalesce(z, F.lit(0.0)), 9)
    label = F.when(z == 0, "Neutral").when(z > 0, "Positive").otherwise("Negative")
    return F.struct(F.lit(source).alias("source"), label.alias("label"), F.abs(2 / (1 + F.exp(-z)) - 1).alias("score"))


def score_by_weights(texts: DataFrame, model: DataFrame, key: str = "doc_id", text: str = "text", source: str = "local") -> DataFrame:
    """texts with polarity by the mean weight of their known words, Neutral and 0 without any; keys are unique. A join by token, so that neither
    the model nor a text needs to fit anywhere."""
    words = texts.select(key, F.explode(T.preprocess(text)).alias("token"))
    mean = words.join(model, "token").groupBy(key).agg(F.avg("weight").alias("__z"))
    return texts.join(mean, key, "left").withColumn("polarity", F.when(F.col(text).isNotNull(), _polarity(F.col("__z"), source))).drop("__z")


def save_scorer(model: DataFrame, config: ScorerConfig) -> None:
    """(token, weight) as the files of a local scorer, for models that a worker can hold; the words go over the driver one at a time."""
    for path in (config.model, config.config):
        Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(config.model, "w", encoding="utf-8") as f:
        for r in model.toLocalIterator():
            f.write(json.dumps([r["token"], r["weight"]], ensure_ascii=False) + "\n")
    Path(config.config).write_text(json.dumps({"kind": "weights", "labels": ["Negative", "Neutral", "Positive"]}), "utf-8")


class WeightScorer:
    """Mean weight of a text's known words, as score_by_weights has it."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights

    def __call__(self, texts: list[str]) -> list[tuple[str, float]]:
        out = []
        for t in texts:
            known = [self.weights[w] for w in re.sub(r"[^\w\s]", "", t.lower()).split() if w in self.weights]
            z = round(sum(known) / len(known), 9) if known else 0.0
            out.append(("Neutral" if z == 0 else "Positive" if z > 0 else "Negative", abs(2 / (1 + math.exp(-z)) - 1)))
        return out


def load_scorer(config: ScorerConfig) -> Callable[[], WeightScorer]:
    """What `score` makes a scorer from: the files of `config` are read in each Python worker when the first text gets there."""

    def make() -> WeightScorer:
        kind = json.loads(Path(config.config).read_text("utf-8"))["kind"]
        if kind != "weights":
            raise ValueError(f"{config.config}: no scorer of kind {kind!r}")
        with open(config.model, encoding="utf-8") as f:
            return WeightScorer(dict(map(json.loads, f)))

    return make


def _post(url: str, headers: dict[str, str], body: bytes) -> bytes:
    with urllib.request.urlopen(urllib.request.Request(url, body, headers, method="POST"), timeout=60) as r:  # noqa: S310
        return r.read()


class ApiScorer:
    """Client of a hosted service: a request for each text, and of the first two candidates of the answer the one with the higher score, the
    second if they are equal. transport(url, headers, body) sends a request; tests give their own."""

    def __init__(self, config: ApiConfig, transport: Callable[[str, dict[str, str], bytes], bytes] = _post) -> None:
        self.config, self.transport = config, transport

    def __call__(self, texts: list[str]) -> list[tuple[str, float]]:
        out = []
        for t in texts:
            headers = {"Authorization": f"Bearer {self.config.token}", "Content-Type": "application/json"}
            found = json.loads(self.transport(self.config.url, headers, json.dumps({"inputs": t}).encode()))
            found = found[0] if found and isinstance(found[0], list) else found
            if len(found) < 2:
                raise ValueError(f"the service answered with {len(found)} candidates")
            best = found[0] if found[0]["score"] > found[1]["score"] else found[1]
            out.append((best["label"], float(best["score"])))
        return out


class LexiconScorer:
    """A small stand-in for a trained model: hits of two word lists."""

    def __init__(self, positive: set[str], negative: set[str]) -> None:
        self.positive, self.negative = positive, negative

    def __call__(self, texts: list[str]) -> list[tuple[str, float]]:
        out = []
        for t in texts:
            w = t.lower().split()
            p, n = sum(x in self.positive for x in w), sum(x in self.negative for x in w)
            out.append(("Neutral", 0.0) if p == n else ("Positive" if p > n else "Negative", abs(p - n) / (p + n)))
        return out
