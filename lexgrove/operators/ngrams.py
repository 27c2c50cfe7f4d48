"""n-gram counts, distributions by period, and the co-occurrence graph."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.functions import text as T
from lexgrove.operators import batches as B
from lexgrove.session import cut

#: totals that are broadcast at most
FEW = 1 << 20


def counts(docs: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """(key, ngram, cnt) over raw tokens: neither case nor punctuation is changed."""
    return _counted(docs, n, key).drop("length")


def probability(docs: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """(key, ngram, p): as shares of counts, whose totals are known where a row is counted."""
    return _counted(docs, n, key).select(key, "ngram", (F.col("cnt") / F.col("length")).alias("p"))


def _counted(docs: DataFrame, n: int, key: str) -> DataFrame:
    if n < 1:
        raise ValueError("n must be at least 1")
    return B.count_in_rows(docs.select(key, "text"), key, "text", n, B.split, "ngram")


def counts_by_period(docs: DataFrame, n: int, period: str, order: str, mode: str = "last") -> DataFrame:
    """(period, ngram, cnt). mode 'last': of several texts of a period only the last by `order` counts; 'sum': all do.

    A period without n-grams is one row with a null n-gram and count 0.
    """
    if mode not in ("last", "sum"):
        raise ValueError("mode is 'last' or 'sum'")
    rows = docs.select(F.col(period).alias("period"), F.col(order).alias("ord"), "text")
    if mode == "last":  # max_by aggregates before the shuffle, where a ranking window would move every text
        rows = rows.groupBy("period").agg(F.max_by("text", "ord").alias("text"))
    return _met(rows.select("period", "text"), n, lambda t: t, "period {}, ngram string, cnt long")


def stats_by_ngram(docs: DataFrame, n: int, period: str) -> DataFrame:
    """(ngram, mean, variance, std_dev) of counts_by_period, mode 'sum': as stats.analyze, in the tasks that have all counts of an n-gram."""

    def analyzed(t: pa.Table) -> pa.Table:
        g = t.group_by("ngram", use_threads=False).aggregate([("cnt", "mean"), ("cnt", "variance")]).rename_columns(["ngram", "mean", "variance"])
        return g.append_column("std_dev", pc.sqrt(g["variance"]))

    return _met(docs.select(F.col(period).alias("period"), "text"), n, analyzed, "ngram string, mean double, variance double, std_dev double")


def _met(rows: DataFrame, n: int, then: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """`then` of the tables (period, ngram, cnt) of rows(period, text), of which each n-gram is in one."""
    if n < 1:
        raise ValueError("n must be at least 1")

    def added(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        for t in B.summed(["period", "ngram"])(tables):
            yield from B.batched(then(t.filter(pc.or_(pc.is_valid(t["ngram"]), pc.equal(t["cnt"], 0))).select(["period", "ngram", "cnt"])))

    return B.met(rows, _gram_tables(n), ["ngram"], added, schema.format(dict(rows.dtypes)["period"]))


def _gram_tables(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.Table]]:
    """Tables (ngram, period, cnt), and for each period of a batch a row with a null n-gram and the number of all its n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for batch in (x for batch in batches for x in B.slices(batch)):
            flat, size = B.split(batch.column(1))
            coded = batch.column(0).dictionary_encode(null_encoding="encode")
            period = np.asarray(coded.indices, np.int64)
            total = np.zeros(len(coded.dictionary), np.int64)
            np.add.at(total, period, np.maximum(size - n + 1, 0))
            yield pa.table({"ngram": pa.nulls(len(total), pa.string()), "period": coded.dictionary, "cnt": pa.array(total)})
            for i, j, some in B.pieces(flat, size):
                row = np.repeat(np.arange(i, j), size[i:j])
                group, gram, cnt = B.gram_counts(some, period[row], row, n)
                yield pa.table({"ngram": gram.cast(pa.string()), "period": coded.dictionary.take(pa.array(group)), "cnt": pa.array(cnt)})

    return run


def totals(docs: DataFrame, n: int, period: str) -> DataFrame:
    """(period, total): how many n-grams the texts of a period have; for periods with any."""
    rows = docs.select(F.col(period).alias("period"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for batch in batches for x in B.slices(batch)):
            size = B.split(batch.column(1))[1]
            t = pa.table({"period": batch.column(0), "total": pa.array(np.maximum(size - n + 1, 0))})
            yield from B.batched(t.group_by("period", use_threads=False).aggregate([("total", "sum")]).rename_columns(["period", "total"]))

    some = rows.mapInArrow(run, f"period {dict(rows.dtypes)['period']}, total long")
    return some.groupBy("period").agg(F.sum("total").alias("total")).where("total > 0")


def distribution(docs: DataFrame, n: int, period: str) -> DataFrame:
    """(period, ngram, p) over all texts of each period. Totals are counted in the texts first, so that n-grams are shuffled once."""
    return shares(counts_by_period(docs, n, period, period, mode="sum"), total=totals(docs, n, period))


def shares(table: DataFrame, key: str = "period", total: DataFrame | None = None) -> DataFrame:
    """(key, ngram, p): count by the key's total, which is (key, total) if the caller knows it."""
    some = table.where("cnt > 0").select(key, "ngram", "cnt")
    total = cut(some.groupBy(key).agg(F.sum("cnt").alias("total")) if total is None else total)
    if total.count() <= FEW:  # the table stays where it is; else all n-grams of a key would get to one task
        total = F.broadcast(total)
    return some.join(total, key).select(key, "ngram", (F.col("cnt") / F.col("total")).alias("p"))


def _edges(w: pa.Array, n: int, most: int = 1 << 17) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, src, dst, weight) of lists of words, at most about `most` words at once; a longer text is by itself."""
    size = pc.list_value_length(w).to_numpy(zero_copy_only=False).astype(np.int64)
    edge = np.concatenate([[0], np.cumsum(size)])
    i = 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(edge, edge[i] + most, side="right")) - 1)
        codes = np.asarray(pc.list_flatten(w.slice(i, j - i)).dictionary_encode().indices, np.int64)
        length = np.repeat(size[i:j], size[i:j])
        row = np.repeat(np.arange(i, j), size[i:j])
        pos = np.arange(len(codes)) - np.repeat(edge[i:j] - edge[i], size[i:j])
        order = np.lexsort((pos, codes, row))
        last = np.flatnonzero(np.append((codes[order][1:] != codes[order][:-1]) | (row[order][1:] != row[order][:-1]), True)) if len(codes) else np.zeros(0, np.int64)
        node = np.empty(len(codes), np.int64)
        node[order] = np.repeat(pos[order][last], np.diff(np.concatenate([[-1], last])))
        parts = []
        for d in range(1, n):
            at = np.flatnonzero(pos + d < length)
            x = pos[at]
            weight = np.minimum(x, length[at] - n) - np.maximum(0, x + d - n + 1) + 1  # windows of n words that have both positions
            at, weight = at[weight > 0], weight[weight > 0]
            parts.append((row[at], node[at], node[at + d], weight))
        if parts:
            r, src, dst, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((dst, src, r))
            r, src, dst, weight = r[order], src[order], dst[order], weight[order]
            first = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (src[1:] != src[:-1]) | (dst[1:] != dst[:-1]))) if len(r) else np.zeros(0, np.int64)
            if len(first):
                yield r[first], src[first], dst[first], np.add.reduceat(weight, first)
        i = j


def cooccurrence(docs: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """(key, src, dst, weight): directed edges from earlier to later words of a window of n words.

    A word's node is the last position it has in its text; a pair counts once for each window that has it, and a
    word that occurs twice in a window has a loop. Texts of fewer than n words have no edge. Each row is a text of its own, so all its
    edges are made and added up where it is read, without a shuffle; weights come from a closed form instead of listing windows.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    rows = docs.select(key, T.tokens("text").alias("w")).where(F.size("w") >= n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for batch in batches for x in B.slices(batch)):
            for row, src, dst, weight in _edges(batch.column(1), n):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(src), pa.array(dst), pa.array(weight.astype(float))], names=[key, "src", "dst", "weight"])

    return rows.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, src long, dst long, weight double")
