"""Counting in Arrow batches: words and n-grams of rows, and shuffles of packed rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: what Java's (?U)\s has
BLANK = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: words of rows that are counted at once, and rows that are held before they are packed, about
WORDS, HELD = 1 << 18, 1 << 18
_SPLIT = "[" + re.escape(BLANK) + "]+"


def whole(a: pa.Array | pa.ChunkedArray) -> pa.Array:
    return a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a


def split(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts, and how many each text has: those of functions.text.tokens. A null text has none."""
    trimmed = pc.fill_null(pc.utf8_trim(text, characters=BLANK), "")
    lists = pc.split_pattern_regex(trimmed, pattern=_SPLIT)
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    bare = pc.equal(trimmed, "").to_numpy(zero_copy_only=False)
    words = whole(pc.list_flatten(lists))
    if bare.any():
        words = words.filter(pa.array(np.repeat(~bare, size)))
        size[bare] = 0
    return words, size


def listed(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """As split, from lists of words."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return whole(pc.list_flatten(lists)), size


def slices(batch: pa.RecordBatch, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Rows of a batch with about `most` bytes."""
    step = max(1, int(batch.num_rows * most / max(batch.nbytes, most)))
    return (batch.slice(i, step) for i in range(0, batch.num_rows, step))


def pieces(words: pa.Array, size: np.ndarray, most: int = 0) -> Iterator[tuple[int, int, pa.Array]]:
    """(first row, row behind the last, words) of runs of rows with about `most` words; a longer row is by itself."""
    most, edge, i = most or WORDS, np.concatenate([[0], np.cumsum(size)]), 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(edge, edge[i] + most, side="right")) - 1)
        yield i, j, words.slice(edge[i], edge[j] - edge[i])
        i = j


def _dense(a: np.ndarray) -> np.ndarray:
    return np.unique(a, return_inverse=True)[1].reshape(-1)


def gram_counts(words: pa.Array, group: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(group, n-gram, count) of the windows of n words inside a row. group and row are numbers from 0, for each word."""
    coded = whole(words).dictionary_encode()
    codes, width = np.asarray(coded.indices, np.int64), max(len(coded.dictionary), 1)
    at = np.flatnonzero(row[n - 1 :] == row[: len(row) - n + 1]) if len(row) >= n else np.zeros(0, np.int64)
    gram = codes[at]
    for d in range(1, n):  # each step fits 63 bits: numbers are below the number of words
        gram = gram * width + codes[at + d]
        if d + 1 < n:
            gram = _dense(gram)
    spread = gram.max(initial=0) + 1
    if (group.max(initial=0) + 1) * float(spread) >= 2.0**62:
        gram = _dense(gram)
        spread = gram.max(initial=0) + 1
    _, first, count = np.unique(group[at] * spread + gram, return_index=True, return_counts=True)
    at = at[first]
    parts = [coded.dictionary.take(pa.array(codes[at + d])) for d in range(n)]
    return group[at], parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " "), count.astype(np.int64)


def hashes(words: pa.Array) -> np.ndarray:
    """64 bits of each string, the same in every process."""
    words = pc.fill_null(whole(words), "").cast(pa.large_string())
    off = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)
    size = np.diff(off)
    h = np.zeros(len(words), np.uint64)
    if len(words) and off[-1] > off[0]:
        data = np.frombuffer(words.buffers()[2], np.uint8, off[-1] - off[0], off[0])
        with np.errstate(over="ignore"):
            power = np.multiply.accumulate(np.full(int(size.max()), 0x9E3779B97F4A7C15, np.uint64))
            terms = (data.astype(np.uint64) + np.uint64(1)) * power[np.arange(len(data)) - np.repeat(off[:-1] - off[0], size)]
            some = np.flatnonzero(size)
            h[some] = np.add.reduceat(terms, off[:-1][some] - off[0])
    return mixed(h)


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def packed(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.Table]], by: list[str], buckets: int):
    """Rows (bucket, blob) of what `rows` makes of batches: those that agree in the strings `by` get to one bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.concat_tables(held).combine_chunks()
            h = np.zeros(len(t), np.uint64)
            for name in by:
                h = mixed(h + hashes(t.column(name)))
            bucket = (h % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            t, bucket = t.take(pa.array(order)).combine_chunks(), bucket[order]
            head = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            for k in range(0, len(head), 64):
                some, blobs = head[k : k + 64], []
                ends = [*head[k + 1 : k + 64].tolist(), int(head[k + 64]) if k + 64 < len(head) else len(t)]
                for i, j in zip(some.tolist(), ends, strict=True):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, t.schema) as w:
                        w.write_table(t.slice(i, j - i))
                    blobs.append(sink.getvalue().to_pybytes())
                yield pa.RecordBatch.from_arrays([pa.array(bucket[some]), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        for t in rows(batches):
            if len(t):
                held.append(t)
                size += len(t)
            if size >= HELD:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return run


def met(df: DataFrame, rows: Callable, by: list[str], together: Callable[[Iterator[pa.Table]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`together` of the tables that `rows` makes of df's batches, each task with all rows of its strings `by`. Rows are shuffled in blobs, which cost the
    JVM next to nothing for each row; there are twice as many tasks as spark.sql.shuffle.partitions says, as each holds its rows."""
    buckets = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = (pa.ipc.open_stream(blob.as_buffer()).read_all() for batch in batches for blob in batch.column(1))
        yield from together(tables)

    return df.mapInArrow(packed(rows, by, buckets), "bucket int, blob binary").repartitionById(buckets, "bucket").mapInArrow(run, schema)


def summed(keys: list[str]) -> Callable[[Iterator[pa.Table]], Iterator[pa.Table]]:
    """Sums of cnt by keys: rows that were added up are added up again when as many have come."""

    def add(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by(keys, use_threads=False).aggregate([("cnt", "sum")]).rename_columns([*keys, "cnt"])

    def run(tables: Iterator[pa.Table]) -> Iterator[pa.Table]:
        held, size, most = [], 0, 4 * HELD
        for t in tables:
            held.append(t.select([*keys, "cnt"]))
            size += len(t)
            if size >= most:
                held = [add(held)]
                size = len(held[0])
                most = max(most, 2 * size)
        if held:
            yield add(held)

    return run


def batched(t: pa.Table, most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    return iter(t.combine_chunks().to_batches(max_chunksize=most))


def repeated(df: DataFrame, key: str) -> DataFrame | None:
    """Values of key that several rows have; None if there are none. Only the key is read."""
    many = df.groupBy(key).agg(F.count("*").alias("__n")).where("__n > 1").select(F.col(key).alias("__key"))
    return many if many.limit(1).count() else None


def count_in_rows(df: DataFrame, key: str, column: str, n: int, words: Callable[[pa.Array], tuple[pa.Array, np.ndarray]], name: str) -> DataFrame:
    """(key, name, cnt, length) of df(key, column): n-grams of each key and how many the key has in all.

    A row is counted where it is read, without a shuffle. Only keys that several rows have are shuffled and added up.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for batch in batches for x in slices(batch)):
            flat, size = words(batch.column(1))
            for i, j, some in pieces(flat, size):
                row = np.repeat(np.arange(j - i), size[i:j])
                group, gram, cnt = gram_counts(some, row, row, n)
                if len(cnt):
                    length = np.maximum(size[i:j] - n + 1, 0)[group]
                    t = pa.Table.from_arrays([batch.column(0).take(pa.array(group + i)), gram, pa.array(cnt), pa.array(length)], names=[key, name, "cnt", "length"])
                    yield from batched(t)

    def each(rows: DataFrame) -> DataFrame:
        return rows.select(key, column).mapInArrow(run, f"`{key}` {kind}, `{name}` string, cnt long, length long")

    many = repeated(df, key)
    if many is None:
        return each(df)
    same = df[key].eqNullSafe(many["__key"])
    some = each(df.join(many, same, "left_semi"))
    added = some.groupBy(key, name).agg(F.sum("cnt").alias("cnt"))
    total = added.groupBy(F.col(key).alias("__key")).agg(F.sum("cnt").alias("length"))
    whole = added.join(total, added[key].eqNullSafe(total["__key"])).select(key, name, "cnt", "length")
    return each(df.join(many, same, "left_anti")).unionByName(whole)
