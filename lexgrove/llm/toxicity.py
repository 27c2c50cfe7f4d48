"""Toxicity: cumulative-link ordinal regression over sparse text features."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.shared import bounded
from lexgrove.llm.textbuf import U64, Texts, pieces, word_hashes

BITS, SAMPLE, GRADES, SEED = 18, 6000, 4, 37
#: likelihood ratio at which a bucket has an eighth of its full scale (see evidence), and the penalty of a squared weight over all training rows
HALF, PRIOR = 8.0, 0.03
SCHEMA = "doc_id long, severity int, expected_severity double, p_toxic double, toxic boolean"
EDGE = np.zeros(256, bool)
EDGE[33:48] = EDGE[58:65] = EDGE[91:97] = EDGE[123:127] = True


@dataclass
class Ordinal:
    """P(grade <= k) = sigmoid(cut[k] - weight . x); the same weights at every threshold, cuts rising."""

    weight: np.ndarray
    cut: np.ndarray


def features(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, log(1 + occurrences)) of lower-case words without punctuation at their ends, by row and bucket."""
    clean = Texts(np.where(EDGE[t.data], 32, t.data).astype(np.uint8), t.off, t.valid)
    h, _, _, row = word_hashes(clean, lower=True)
    key = np.sort((row.astype(U64) << U64(BITS)) | (h >> U64(64 - BITS)))
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> U64(BITS)).astype(np.int64), (key & U64((1 << BITS) - 1)).astype(np.int64), np.log1p(count)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int, kept: int = 8) -> np.ndarray:
    """Limited-memory BFGS with backtracking; f gives value and gradient. Deterministic."""
    value, g = f(x)
    past: deque[tuple[np.ndarray, np.ndarray, float]] = deque(maxlen=kept)
    for _ in range(steps):
        d, parts = -g, []
        for s, y, r in reversed(past):
            parts.append(r * (s @ d))
            d = d - parts[-1] * y
        d = d * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])) if past else d / max(1.0, float(np.linalg.norm(g)))
        for (s, y, r), a in zip(past, reversed(parts), strict=True):
            d = d + s * (a - r * (y @ d))
        slope, t = float(d @ g), 1.0
        if slope > -1e-12:
            break
        new, grad = f(x + d)
        while new > value + 1e-4 * t * slope and t > 1e-9:
            t /= 2
            new, grad = f(x + t * d)
        if new > value:
            break
        s, y = t * d, grad - g
        if s @ y > 1e-14:
            past.append((s, y, 1 / float(s @ y)))
        small = value - new <= 1e-10 * max(1.0, abs(value))
        x, value, g = x + s, new, grad
        if small:
            break
    return x


def fit(row: np.ndarray, col: np.ndarray, val: np.ndarray, y: np.ndarray, width: int, grades: int, steps: int = 150, decay: float = 2e-5) -> Ordinal:
    """Penalised maximum likelihood; cuts are a first one plus positive gaps. Without rows all weights are 0."""
    n = len(y)
    share = np.clip(np.cumsum(np.bincount(y, minlength=grades))[:-1] / max(n, 1), 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    used, at = np.unique(col, return_inverse=True)
    m = len(used)

    def cuts(par: np.ndarray) -> np.ndarray:
        return np.concatenate([par[m : m + 1], par[m : m + 1] + np.cumsum(np.exp(par[m + 1 :]))])

    def loss(par: np.ndarray) -> tuple[float, np.ndarray]:
        w, cut = par[:m], cuts(par)
        s = np.bincount(row, weights=val * w[at], minlength=n)
        hi = np.where(y < grades - 1, _sigmoid(cut[np.minimum(y, grades - 2)] - s), 1.0)
        lo = np.where(y > 0, _sigmoid(cut[np.maximum(y - 1, 0)] - s), 0.0)
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        g_cut = np.zeros(grades - 1)
        np.add.at(g_cut, np.minimum(y, grades - 2), np.where(y < grades - 1, -d_hi, 0) / n)
        np.add.at(g_cut, np.maximum(y - 1, 0), np.where(y > 0, d_lo, 0) / n)
        tail = np.cumsum(g_cut[::-1])[::-1]
        g_w = np.bincount(at, weights=val * ((d_hi - d_lo) / n)[row], minlength=m) + decay * w
        return float(-np.log(p).mean() + decay / 2 * (w @ w)), np.concatenate([g_w, tail[:1], tail[1:] * np.exp(par[m + 1 :])])

    par = np.concatenate([np.zeros(m), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    par = minimise(loss, par, steps) if n else par
    w = np.zeros(width)
    w[used] = par[:m]
    return Ordinal(w, cuts(par))


def severity_grades(row: np.ndarray, col: np.ndarray, val: np.ndarray, toxic: np.ndarray, grades: int) -> np.ndarray:
    """Grades from 0/1 labels: 0 for clean rows; toxic ones by quantiles of how much they have of words that mark toxic rows.

    A word counts by its smoothed log odds between toxic and clean rows, if these are positive, times its evidence (see evidence)."""
    width = int(col.max()) + 1 if len(col) else 1
    n_bad, n_good = int(toxic.sum()), int((~toxic).sum())
    bad = np.bincount(col[toxic[row]], minlength=width)
    good = np.bincount(col[~toxic[row]], minlength=width)
    odds = np.log((bad + 1) / (n_bad + 2)) - np.log((good + 1) / (n_good + 2))
    amount = np.bincount(row, weights=val * (np.maximum(odds, 0) * evidence(row, col, toxic, width))[col], minlength=len(toxic))
    y = np.zeros(len(toxic), np.int64)
    if toxic.any():
        steps = np.quantile(amount[toxic], np.arange(1, grades - 1) / (grades - 1))
        y[toxic] = 1 + np.searchsorted(steps, amount[toxic], side="left")
    return y


def evidence(row: np.ndarray, col: np.ndarray, toxic: np.ndarray, width: int) -> np.ndarray:
    """The cube of G / (G + HALF) of every bucket, G being its likelihood ratio: near 1 for words that tell toxic rows from clean ones, near 0 for
    words that are as common in both or too rare to tell. No bucket is cut off."""
    g = np.maximum(likelihood_ratio(row, col, toxic, width), 0)
    return (g / (g + HALF)) ** 3


def likelihood_ratio(row: np.ndarray, col: np.ndarray, toxic: np.ndarray, width: int) -> np.ndarray:
    """G statistic of having a bucket against being toxic, of every bucket; (row, col) are distinct pairs."""
    n_bad, n_good = int(toxic.sum()), int((~toxic).sum())
    n = max(n_bad + n_good, 1)
    bad = np.bincount(col[toxic[row]], minlength=width).astype(float)
    good = np.bincount(col[~toxic[row]], minlength=width).astype(float)
    seen = bad + good

    def part(have: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return have * np.log(np.where(have > 0, have, 1) / np.where(have > 0, expected, 1))

    g = part(bad, seen * n_bad / n) + part(good, seen * n_good / n)
    return 2 * (g + part(n_bad - bad, (n - seen) * n_bad / n) + part(n_good - good, (n - seen) * n_good / n))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, grades: int = GRADES, seed: int = SEED) -> Ordinal:
    """A model from at most `sample` labelled documents (the documented bound, which holds for rows too), chosen by a hash of doc_id.

    The labels are 0/1, of repeated ones the highest counts; grades 1 .. grades - 1 are derived from them (see severity_grades). Features are
    scaled by their evidence before the penalised fit, so that rare words aren't learnt by heart, while a word that marks a few toxic rows counts.
    Rows without id, text or label are no training rows; without any all weights are 0. Rows that share an id are training rows of their own.
    Other columns are ignored, whatever their names.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y"))
        .where("doc_id is not null and y in (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id")
        .limit(sample)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    rows = bounded(rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text"), sample, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in pieces(batch, "text"):
                row, col, val = features(t)
                off = np.searchsorted(row, np.arange(len(t) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(off), pa.array(x)) for x in (col.astype(np.int32), val.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists], names=["doc_id", "y", "b", "v"])

    got = rows.mapInArrow(run, "doc_id long, y int, b array<int>, v array<float>").toPandas()
    got = got.iloc[sorted(range(len(got)), key=lambda i: (got["doc_id"].iloc[i], list(got["b"].iloc[i])))]
    size = [len(x) for x in got["b"]]
    row = np.repeat(np.arange(len(got)), size)
    col = np.concatenate([np.zeros(0, np.int64), *got["b"]]).astype(np.int64)
    val = np.concatenate([np.zeros(0), *got["v"]]).astype(float)
    toxic = got["y"].to_numpy() == 1
    y = severity_grades(row, col, val, toxic, grades)
    scale = evidence(row, col, toxic, 1 << BITS)
    m = fit(row, col, val * scale[col], y, 1 << BITS, grades, decay=PRIOR / max(len(got), 1))
    return Ordinal(m.weight * scale, m.cut)


def score(docs: DataFrame, model: Ordinal, threshold: float = 0.5) -> DataFrame:
    """doc_id, severity (most likely grade), expected_severity (mean grade), p_toxic (P(grade > 0)), toxic (p_toxic >= threshold).

    One row for each input row. A null text has null results and toxic false; one without words
    scores as the thresholds alone say. Of equally likely grades the lower one is given; p_toxic of exactly the threshold is toxic. Whole
    texts count, however long. A null doc_id stays null, repeated rows score alike. Other columns are ignored, whatever their names. An empty
    table gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in pieces(batch, "text"):
                row, col, val = features(t)
                s = np.bincount(row, weights=val * model.weight[col], minlength=len(t))
                below = np.hstack([np.zeros((len(t), 1)), _sigmoid(model.cut[None] - s[:, None]), np.ones((len(t), 1))])
                p = np.diff(below, axis=1)
                no = ~t.valid
                bad = 1 - p[:, 0]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(p.argmax(axis=1).astype(np.int32), mask=no),
                        pa.array(p @ np.arange(p.shape[1]), mask=no),
                        pa.array(bad, mask=no),
                        pa.array((bad >= threshold) & t.valid),
                    ],
                    names=["doc_id", "severity", "expected_severity", "p_toxic", "toxic"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
