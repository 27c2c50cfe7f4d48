"""Features of text lines, shared by the two line-labelling operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.shared import bounded
from lexgrove.llm.textbuf import FOLDED, U64, Texts, characters, lines, pieces, solid_bytes, spans_hash, words
from lexgrove.llm.textbuf import LOWER as LOWER_OF

LOWER, UPPER, DIGIT, BLANK, STOP, COMMA, BAR, SYMBOL, TRAIL = range(9)
KINDS = np.full(256, SYMBOL, np.uint8)
KINDS[97:123] = LOWER
KINDS[65:91] = UPPER
KINDS[48:58] = DIGIT
KINDS[[9, 10, 11, 12, 13, 32]] = BLANK
KINDS[[33, 46, 63]] = STOP
KINDS[[34, 39, 40, 41, 44, 45, 58, 59]] = COMMA
KINDS[124] = BAR
KINDS[0x80:0xC0] = TRAIL
KINDS[0xC0:] = LOWER
#: bias, upper, digit, symbol, bar, shout mark and repeated-word shares, repeated line, size, sentence end, word length, few words
NAMES = ("bias", "upper", "digit", "symbol", "bar", "shout", "repeated", "again", "size", "closed", "word", "few")
WIDTH = len(NAMES)


def line_features(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features (lines, WIDTH), characters of each line, lines of each row)."""
    s, e, row = lines(t)
    count = np.bincount(row, minlength=len(t)).astype(np.int64)
    if not len(s):
        return np.zeros((0, WIDTH)), np.zeros(0), count
    n = len(t.data)
    kind = KINDS[t.data]
    at, code, _ = characters(t.data, FOLDED)
    kind[at[LOWER_OF[code] != code]] = UPPER
    kind[(kind >= UPPER) & ~solid_bytes(t.data)[0]] = BLANK
    line_at = np.repeat(np.arange(len(s)), e - s)
    inside = np.zeros(n + 1, np.int32)
    np.add.at(inside, s, 1)
    np.add.at(inside, e, -1)
    mask = np.cumsum(inside[:-1]) > 0
    c = np.bincount(line_at * 9 + kind[mask], minlength=len(s) * 9).reshape(-1, 9).astype(float)
    chars = c.sum(axis=1) - c[:, TRAIL]
    letters = np.maximum(c[:, LOWER] + c[:, UPPER], 1)
    solid = np.maximum(chars - c[:, BLANK], 1)
    ws, we, _ = words(t)
    w_line = np.searchsorted(s, ws, side="right") - 1
    values = t.data.astype(U64) + U64(1)
    h = spans_hash(values, ws, we)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (w_line[1:] == w_line[:-1])
    n_words = np.maximum(np.bincount(w_line, minlength=len(s)), 1)
    repeated = np.bincount(w_line, weights=same, minlength=len(s)) / n_words
    doubled = np.zeros(n, bool)
    doubled[1:] = (t.data[1:] == 33) & (t.data[:-1] == 33)
    shout = np.zeros(n + 1)
    np.cumsum(doubled, out=shout[1:])
    lh = spans_hash(values, s, e)
    order = np.lexsort((np.arange(len(s)), lh, row))
    again = np.zeros(len(s))
    again[order[1:]] = (lh[order[1:]] == lh[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    last = t.data[np.maximum(we[np.searchsorted(ws, e, side="left") - 1] - 1, 0)]
    x = np.stack(
        [
            np.ones(len(s)),
            c[:, UPPER] / letters,
            c[:, DIGIT] / solid,
            c[:, SYMBOL] / solid,
            c[:, BAR] / n_words,
            (shout[e] - shout[s]) / n_words,
            repeated,
            again,
            np.log1p(chars),
            (KINDS[last] == STOP).astype(float),
            np.minimum((chars - c[:, BLANK]) / n_words, 30) / 10,
            (n_words <= 3).astype(float),
        ],
        axis=1,
    )
    return x, chars, count


def with_neighbours(x: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Each line's features, then those of the line before and the line after (0 beyond the document)."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    ends = np.cumsum(count[count > 0])
    before[np.concatenate([[0], ends[:-1]]).astype(int) if len(ends) else []] = 0
    after[ends - 1] = 0
    return np.hstack([x, before[:, 1:], after[:, 1:]])


def labelled_lines(docs: DataFrame, labels: DataFrame, bound: int, seed: int) -> list[tuple[int, int, np.ndarray]]:
    """(quality, lines, features) of at most `bound` labelled documents, chosen by a hash of doc_id.

    The bound holds what comes to the driver, rows that share an id included; rows without id, text or label are no training rows. Of
    repeated labels the highest counts.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
        .where("doc_id is not null and y in (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id")
        .limit(bound)
    )
    sample = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .where("text is not null")
        .join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "y", "text")
    )
    sample = bounded(sample, bound, seed).select("y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in pieces(batch, "text"):
                x, _, count = line_features(t)
                flat = x.astype(np.float32).reshape(-1)
                off = np.concatenate([[0], np.cumsum(count * WIDTH)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], names=["y", "x"]
                )

    got = sample.mapInArrow(run, "y int, x array<float>").toArrow()
    out = []
    for y, x in zip(got.column("y").to_pylist(), got.column("x"), strict=True):
        v = np.asarray(x.values, np.float64).reshape(-1, WIDTH) if x.is_valid else np.zeros((0, WIDTH))
        if len(v):
            out.append((int(y), len(v), v))
    out.sort(key=lambda r: (r[0], r[1], r[2].tobytes()))  # the same order whatever the partitions were
    return out
