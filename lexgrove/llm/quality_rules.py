"""Quality rules: Viterbi decoding of a linear-chain CRF marks lines as content or boilerplate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.crf import Crf, fit, viterbi
from lexgrove.llm.linefeatures import WIDTH, labelled_lines, line_features
from lexgrove.llm.textbuf import pieces

SCHEMA = "doc_id long, n_lines int, n_content int, content_share double, keep boolean"
SAMPLE, SEED, MIN_SHARE = 2000, 17, 0.5
#: every line is content, so that every text with lines is kept
UNTRAINED = Crf(np.zeros((WIDTH, 2)), np.array([[0.0, 1.0], [0.0, 1.0]]), np.array([0.0, 1.0]), np.zeros(WIDTH), np.ones(WIDTH))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = SEED, rounds: int = 2) -> Crf:
    """A line model from document labels: label 1 is content.

    At most `sample` labelled documents are used (the documented bound). All lines of a good
    document are content; lines of a bad one start as boilerplate, and after each round
    those that the model itself decodes as content are relabelled, so that the ordinary
    lines of a bad document don't count against ordinary lines.
    Without a labelled document that has lines, nothing speaks against a line: the model is UNTRAINED, which calls all content.
    """
    rows = labelled_lines(docs, labels, sample, seed)
    lengths = np.array([r[1] for r in rows], np.int64)
    if not lengths.sum():
        return UNTRAINED
    x = np.vstack([r[2] for r in rows])
    doc_y = np.repeat(np.array([r[0] for r in rows]), lengths)
    y = doc_y.astype(np.int64)
    model = fit(x, lengths, y)
    for _ in range(rounds - 1):
        y = np.where(doc_y == 1, 1, viterbi(model.scores(x), lengths, model.trans, model.start)).astype(np.int64)
        if len(set(y.tolist())) < 2:
            break
        model = fit(x, lengths, y)
    return model


def apply(docs: DataFrame, model: Crf, min_share: float = MIN_SHARE, columns: list[str] | None = None) -> DataFrame:
    """Line labels decide which documents stay.

    Result, one row for each input row: doc_id, n_lines (lines that aren't blank), n_content, content_share
    (share of characters in content lines) and keep (content_share >= min_share).
    A null or blank text has no lines: 0, 0, null and keep false. A null doc_id stays null; repeated rows
    are decided alike, each by itself. A share of exactly min_share is kept; of equally good labellings the one with lower labels (boilerplate)
    from the end backwards counts. Whole texts are read, however long. With `columns`, the result is instead
    those columns of the rows that are kept; other columns are ignored, whatever their names. An empty table gives no row.
    """
    src = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[c for c in columns or () if c not in ("doc_id", "text")]
    )
    names = list(columns) if columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in pieces(batch, "text"):
                x, chars, count = line_features(t)
                good = viterbi(model.scores(x), count, model.trans, model.start).astype(bool)
                row = np.repeat(np.arange(len(t)), count)
                total = np.bincount(row, weights=chars, minlength=len(t))
                kept = np.bincount(row, weights=chars * good, minlength=len(t))
                share = np.divide(kept, total, out=np.zeros(len(t)), where=total > 0)
                keep = (total > 0) & (share >= min_share)
                if names:
                    yield part.filter(pa.array(keep)).select(names)
                    continue
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(count.astype(np.int32)),
                        pa.array(np.bincount(row, weights=good, minlength=len(t)).astype(np.int32)),
                        pa.array(share, mask=total == 0),
                        pa.array(keep),
                    ],
                    names=["doc_id", "n_lines", "n_content", "content_share", "keep"],
                )

    return src.mapInArrow(run, src.select(*names).schema if names else SCHEMA)
