"""Quality classifier: a linear-chain CRF over lines with neighbouring-line features, read out by forward-backward."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.crf import Crf, fit, marginals
from lexgrove.llm.linefeatures import WIDTH, labelled_lines, line_features, with_neighbours
from lexgrove.llm.textbuf import pieces

SCHEMA = "doc_id long, n_lines int, quality double, good boolean"
SAMPLE, SEED = 2000, 23


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> Crf:
    """A model of good (1) and bad (0) lines from at most `sample` labelled documents (the documented bound);
    every line has its document's label."""
    rows = labelled_lines(docs, labels, sample, seed)
    lengths = np.array([r[1] for r in rows], np.int64)
    x = np.vstack([r[2] for r in rows]) if rows else np.zeros((0, WIDTH))
    y = np.repeat(np.array([r[0] for r in rows], np.int64), lengths)
    return fit(with_neighbours(x, lengths), lengths, y)


def score(docs: DataFrame, model: Crf, threshold: float = 0.5) -> DataFrame:
    """Document quality: the mean of P(line is good), weighted by the characters of each line.

    One row for each input row: doc_id, n_lines, quality, good (quality >= threshold).
    A null or blank text has no lines: quality null, good false. A null doc_id stays null;
    repeated rows score alike. A quality of exactly the threshold is good. Whole texts are read, however long. Other columns are ignored,
    whatever their names. An empty table gives no row; a model without training rows gives 0.5 to every text with lines.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in pieces(batch, "text"):
                x, chars, count = line_features(t)
                p = marginals(model.scores(with_neighbours(x, count)), count, model.trans, model.start)[0][:, 1]
                row = np.repeat(np.arange(len(t)), count)
                total = np.bincount(row, weights=chars, minlength=len(t))
                q = np.divide(np.bincount(row, weights=chars * p, minlength=len(t)), total, out=np.zeros(len(t)), where=total > 0)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(count.astype(np.int32)), pa.array(q, mask=total == 0), pa.array((total > 0) & (q >= threshold))],
                    names=["doc_id", "n_lines", "quality", "good"],
                )

    return src.mapInArrow(run, SCHEMA)
