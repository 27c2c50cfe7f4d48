"""Language identification: nearest of several TF-IDF centroids per language by cosine, with rejection by distance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrove.llm.textbuf import SPACE, Texts, fold, pieces

DIMS, CENTROIDS, SAMPLE, SEED = 4096, 4, 500, 31
SCHEMA = "doc_id long, language string, nearest string, cosine double, margin double"
LETTER = np.zeros(256, bool)
LETTER[97:123] = True
LETTER[0x80:] = True


@dataclass
class Centroids:
    idf: np.ndarray
    vectors: np.ndarray  # (centroids, DIMS), unit length
    owner: np.ndarray  # language number of each
    limit: np.ndarray  # smallest cosine that each accepts
    languages: list[str]


def ngram_counts(t: Texts) -> np.ndarray:
    """(rows, DIMS) counts of hashed byte 1- to 3-grams of lower-case letters; other bytes count as one blank."""
    n = len(t)
    data = fold(t.data)
    data[~LETTER[data]] = 32
    row = np.repeat(np.arange(n), np.diff(t.off))
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32) | (row[1:] != row[:-1])
    c, row = data[keep].astype(np.uint32), row[keep]
    out = np.zeros((n, DIMS), np.float32)
    for k in (1, 2, 3):
        if len(c) < k:
            continue
        code = c[: len(c) - k + 1].copy()
        for j in range(1, k):
            code = code * np.uint32(257) + c[j : len(c) - k + 1 + j]
        bucket = ((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
        same = row[: len(row) - k + 1] == row[k - 1 :]
        out += np.bincount((row[: len(row) - k + 1] * DIMS + bucket)[same], minlength=n * DIMS).reshape(n, DIMS)
    return out


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def _text(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(*more, F.col("text").cast("string").alias("text"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """At most 512 rows at once: their counts are a dense matrix."""
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            yield from pieces(batch.slice(i, 512), "text", 1 << 20)


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many of all documents have each bucket, and how many have any; added up in each partition first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMS, np.int64), 0
        for _, t in _blocks(batches):
            has = ngram_counts(t) > 0
            total += has.sum(axis=0)
            n += int(has.any(axis=1).sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1, dtype=np.int32)), pa.array(np.append(total, n))], names=["b", "n"])

    got = _text(docs.where("text is not null")).mapInArrow(run, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(DIMS + 1, np.int64)
    out[got["b"].to_numpy()] = got["n"].to_numpy()
    return out[:-1], int(out[-1])


def spherical_kmeans(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids; the first is the row nearest to the mean, each next the row farthest from those so far."""
    first = int((v @ v.mean(axis=0)).argmax())
    chosen = [first]
    while len(chosen) < min(k, len(v)):
        chosen.append(int((v @ v[chosen].T).max(axis=1).argmin()))
    c = v[chosen]
    for _ in range(rounds):
        who = (v @ c.T).argmax(axis=1)
        c = np.stack([v[who == i].sum(axis=0) if (who == i).any() else c[i] for i in range(len(c))])
        size = np.linalg.norm(c, axis=1, keepdims=True)
        c = np.divide(c, size, out=np.zeros_like(c), where=size > 0)
    return c


def train(docs: DataFrame, label: str = "lang", sample: int = SAMPLE, per_language: int = CENTROIDS, seed: int = SEED, slack: float = 0.5) -> Centroids:
    """Centroids from at most `sample` labelled documents of each language (the documented bound), document frequencies from all.

    Documents are chosen by a hash among those with an id, a label and text, so that a rare language is learnt as well as a common one. Rows
    that are repeated in full count as one. Other columns are ignored, whatever their names; without a labelled row there is no centroid. A centroid accepts cosines down to `slack` times the lowest but 1 % of its own training rows.
    """
    df, n = document_frequency(docs)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("string").alias("y"), F.col("text").cast("string").alias("text"))
    rows = rows.where(r"doc_id is not null and y is not null and text rlike '\\S'")
    ids = rows.select("doc_id", "y", F.xxhash64("text").alias("h"))
    order = W.partitionBy("y").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "h")
    # ranks are cut off before the shuffle, so that no language has more than `sample` rows of a task in it
    chosen = ids.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample).select("doc_id", "y", "h").distinct()
    chosen = F.broadcast(chosen)  # at most `sample` rows for each language
    rows = rows.withColumn("h", F.xxhash64("text")).join(chosen, ["doc_id", "y", "h"]).dropDuplicates(["doc_id", "y", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in _blocks(batches):
            c = ngram_counts(t)
            at = np.nonzero(c)
            off = np.searchsorted(at[0], np.arange(len(t) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(off), pa.array(x)) for x in (at[1].astype(np.int32), c[at].astype(np.float32))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists], names=["doc_id", "y", "b", "c"])

    got = rows.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y string, b array<int>, c array<float>").toPandas()
    got = got.iloc[sorted(range(len(got)), key=lambda i: (got["doc_id"].iloc[i], list(got["b"].iloc[i]), list(got["c"].iloc[i])))]
    langs, v, owner, limit = sorted(set(got["y"])), [], [], []
    for i, lang in enumerate(langs):
        own = got[got["y"] == lang]
        counts = np.zeros((len(own), DIMS), np.float32)
        for r, (b, c) in enumerate(zip(own["b"], own["c"], strict=True)):
            counts[r, b] = c
        x = vectors(counts, idf)
        x = x[np.abs(x).sum(axis=1) > 0]
        if not len(x):
            continue
        cents = spherical_kmeans(x, per_language)
        near = x @ cents.T
        who, best = near.argmax(axis=1), near.max(axis=1)
        for j, cent in enumerate(cents):
            v.append(cent)
            owner.append(i)
            limit.append(slack * float(np.quantile(best[who == j], 0.01)) if (who == j).any() else 1.0)
    return Centroids(idf, np.array(v, np.float32).reshape(-1, DIMS), np.array(owner, np.int64), np.array(limit), langs)


def identify(docs: DataFrame, model: Centroids) -> DataFrame:
    """doc_id, language (null if rejected), nearest (language of the nearest centroid), cosine, margin (over the best centroid
    of any other language).

    One row for each input row. A text that is null or has no letter has no vector: all null. Of equal cosines the
    language that sorts first wins. Rejected: cosine below the limit of the nearest centroid. Whole texts count, however long. A null doc_id
    stays null, repeated rows are identified alike. Other columns are ignored, whatever their names. An empty table gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in _blocks(batches):
            v = vectors(ngram_counts(t), model.idf)
            some = np.abs(v).sum(axis=1) > 0
            n = len(t)
            if not len(model.vectors):
                some[:] = False
            cos = v @ model.vectors.T if len(model.vectors) else np.zeros((n, 1), np.float32)
            near = cos.argmax(axis=1)
            best = cos[np.arange(n), near]
            own = model.owner[near] if len(model.owner) else np.zeros(n, np.int64)
            other = np.where(model.owner[None] != own[:, None], cos, -1.0).max(axis=1) if len(model.owner) else best
            names = np.array([*model.languages, ""], dtype=object)[own if len(model.owner) else np.zeros(n, np.int64)]
            ok = some & (best >= (model.limit[near] if len(model.limit) else 1))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(names, pa.string(), mask=~ok),
                    pa.array(names, pa.string(), mask=~some),
                    pa.array(best.astype(float), mask=~some),
                    pa.array((best - np.maximum(other, 0)).astype(float), mask=~some),
                ],
                names=["doc_id", "language", "nearest", "cosine", "margin"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
