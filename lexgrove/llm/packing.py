"""Order-preserving packing by dynamic programming with monotone-queue transitions."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrove.llm.shared import cut
from lexgrove.llm.textbuf import Texts, pieces, words

WINDOW, WINDOWS_PER_RUN = 2048, 512
#: token equivalents that a window end costs: at a document's end, a sentence's end, inside a sentence
PENALTY = (0, 64, 512)
SCHEMA = "run long, window int, n_tokens int, padding int, cut int, doc_ids array<long>, starts array<int>, ends array<int>"


def sentence_lengths(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(words of each sentence, sentences of each row). A sentence ends with a word that ends in . ! or ?, or with its line or row."""
    s, e, row = words(t)
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(len(t), np.int64)
    last = t.data[e - 1]
    stop = (last == 46) | (last == 33) | (last == 63)
    newline = np.zeros(len(t.data) + 1, np.int64)
    np.cumsum(t.data == 10, out=newline[1:])
    stop[:-1] |= (newline[s[1:]] > newline[e[:-1]]) | (row[1:] != row[:-1])
    stop[-1] = True
    at = np.flatnonzero(stop)
    return np.diff(np.append(-1, at)), np.bincount(row[at], minlength=len(t))


def cuts(units: list[int], kinds: list[int], window: int, penalty: tuple[int, int, int] = PENALTY) -> tuple[list[int], int]:
    """Window ends (indices into units, exclusive) of least cost, and the cost.

    units: lengths, none over `window`; kinds[i]: what ends after unit i (0 document, 1 sentence, 2 nothing).
    Cost: unused tokens of every window but the last, plus the penalty of every cut but the last. best(j) =
    window - S(j) + penalty(j) + min over windows (i, j] that fit of best(i) + S(i); as both ends only move
    forward, a monotone queue has that minimum at its front. Of equal costs the earliest start wins.
    """
    n = len(units)
    total, best, back = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    queue: deque[tuple[int, int]] = deque([(0, 0)])
    s = i_last = 0
    for j in range(1, n + 1):
        s += units[j - 1]
        total[j] = s
        while total[queue[0][1]] < s - window:
            queue.popleft()
        if j == n:  # the last window's padding is no choice: of all starts that fit, the cheapest so far
            while i_last < n and total[i_last] < s - window:
                i_last += 1
            b, back[j] = min((best[i], i) for i in range(i_last, n))
        else:
            low, back[j] = queue[0]
            b = low + window - s + penalty[kinds[j - 1]]
        best[j] = b
        v = b + s
        while queue and queue[-1][0] > v:
            queue.pop()
        queue.append((v, j))
    ends, j = [], n
    while j > 0:
        ends.append(j)
        j = back[j]
    return ends[::-1], best[n]


def split_units(lengths: np.ndarray, per_doc: np.ndarray, window: int) -> tuple[list[int], list[int], list[int]]:
    """(length, kind, document) of the units: sentences, those over an eighth of a window in even pieces of at most that."""
    piece = max(1, window // 8)
    units, kinds, docs = [], [], []
    at = 0
    for d, m in enumerate(per_doc.tolist()):
        for x in lengths[at : at + m].tolist():
            n = -(-x // piece)
            for i in range(n):
                units.append((i + 1) * x // n - i * x // n)
                kinds.append(2)
                docs.append(d)
            kinds[-1] = 1
        at += m
        if m:
            kinds[-1] = 0
    return units, kinds, docs


def pack(docs: DataFrame, window: int = WINDOW, windows_per_run: int = WINDOWS_PER_RUN, penalty: tuple[int, int, int] = PENALTY) -> DataFrame:
    """Windows of at most `window` tokens over the documents in order of doc_id.

    A token is a word (see textbuf). Windows end between sentences or documents where that
    is cheapest; inside a sentence only where it is longer than an eighth of a window. The order is cut into runs by the tokens before
    a document (one for every window * windows_per_run of them, whatever the ids are), each of which is solved exactly: run boundaries end
    a window, so runs are independent tasks and the result doesn't depend on partitions. Of equal costs the earliest start of the
    last window wins. Rows: run, window (from 0), n_tokens,
    padding, cut (0 after a document, 1 after a sentence, 2 inside one) and the window's parts: doc_ids and the
    word ranges starts, ends of each. Every word of every document is in exactly one window. Only sentence lengths
    are shuffled, no text. Null ids, and null or blank texts, have no window. Rows that share a doc_id, repeated rows too,
    follow one another, shorter first, each with its own part. A text of any length is in one run. Columns other than doc_id and text
    are ignored, whatever their names. An empty table gives no row.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(
        "doc_id is not null and text is not null"
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in pieces(batch, "text"):
                length, count = sentence_lengths(t)
                off = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                columns = [part.column(0), pa.array(np.bincount(np.repeat(np.arange(len(t)), count), weights=length, minlength=len(t)).astype(np.int64))]
                lists = pa.ListArray.from_arrays(pa.array(off), pa.array(length.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*columns, lists], names=["doc_id", "n", "lengths"]).filter(pa.array(count > 0))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            n = np.asarray(batch.column(1))
            at = np.asarray(batch.column(3)) + before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(at // (window * windows_per_run)), pa.array(at), batch.column(0), batch.column(2)], names=["run", "at", "doc_id", "lengths"])

    def solve(table: pa.Table) -> pa.Table:
        run = table.column("run")[0].as_py()
        ids = np.asarray(table.column("doc_id"))
        lists = [np.asarray(x.values) for x in table.column("lengths")]
        order = np.argsort(np.asarray(table.column("at")), kind="stable")
        units, kinds, owner = split_units(np.concatenate([lists[i] for i in order]), np.array([len(lists[i]) for i in order]), window)
        ends, _ = cuts(units, kinds, window, penalty)
        rows, at, inside = [], 0, {}
        for w, end in enumerate(ends):
            parts: dict[int, list[int]] = {}
            for u in range(at, end):
                d = owner[u]
                begin = inside.get(d, 0)
                inside[d] = begin + units[u]
                parts.setdefault(d, [begin, 0])[1] = inside[d]
            used = sum(units[at:end])
            rows.append((run, w, used, window - used, kinds[end - 1], [int(ids[order[d]]) for d in parts], [p[0] for p in parts.values()], [p[1] for p in parts.values()]))
            at = end
        kind = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.table({name: pa.array(col, k) for name, k, col in zip(names, kind, zip(*rows, strict=True), strict=True)})

    measured = cut(src.mapInArrow(measure, "doc_id long, n long, lengths array<int>").withColumn("tie", F.monotonically_increasing_id()))
    order = ["doc_id", "n", F.xxhash64("lengths"), "tie"]  # rows that tie up to here are equal in all that counts
    ranges = cut(measured.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "n", "lengths", F.spark_partition_id().alias("part")))
    earlier = F.sum("s").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = ranges.groupBy("part").agg(F.sum("n").alias("s")).select("part", F.coalesce(earlier, F.lit(0)).alias("start"))
    placed = ranges.join(F.broadcast(starts), "part").select("doc_id", "n", "lengths", "start")  # a row for each partition
    return placed.mapInArrow(number, "run long, at long, doc_id long, lengths array<int>").groupBy("run").applyInArrow(solve, SCHEMA)
