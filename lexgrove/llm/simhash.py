"""SimHash near-duplicates, searched by random bit sampling."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.components import components
from lexgrove.llm.shared import cut
from lexgrove.llm.textbuf import U64, pieces, splitmix, word_hashes

BITS = 256
WORDS64 = BITS // 64
#: largest distance of a near-duplicate pair; distance and recall that the number of tables is designed for
MAX_DISTANCE = DESIGN_DISTANCE = 50
DESIGN_RECALL = 0.95
SMALL, CAP = 48, 4096
#: rows of a bucket above which near copies of its pivot are salted; one row of so many is looked at to find such buckets
HOT, SAMPLED = 1 << 17, 256

BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.float32)


def _sign_sums(hashes: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """(n, BITS) number of set bits over each row's features, by histograms of the bytes of their hashes."""
    out = np.zeros((n, BITS), np.float32)
    base = row * 256
    for j in range(WORDS64):
        word = splitmix(hashes, 7 + j)
        for b in range(8):
            byte = ((word >> U64(56 - 8 * b)) & U64(255)).astype(np.int64)
            seen = np.bincount(base + byte, minlength=n * 256).reshape(n, 256).astype(np.float32)
            out[:, j * 64 + b * 8 : j * 64 + b * 8 + 8] = seen @ BYTE_BITS
    return out


def text_fingerprints(t) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints (n, WORDS64), distinct words) of each row's set of lower-case words; a word weighs 1."""
    h, _, _, row = word_hashes(t, lower=True)
    n = len(t)
    out, size = np.zeros((n, WORDS64), U64), np.zeros(n, np.int64)
    if not len(h):
        return out, size
    # distinct words of a row by one sort: the row above 44 bits of the hash
    for at in range(0, n, 2048):
        sel = slice(*np.searchsorted(row, [at, at + (2048)]))
        key = np.sort(((row[sel] - at).astype(U64) << U64(44)) | (h[sel] >> U64(20)))
        key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
        r = (key >> U64(44)).astype(np.int64)
        m = min(n - at, 2048)
        count = np.bincount(r, minlength=m)
        ones = _sign_sums(splitmix(key & U64((1 << 44) - 1), 3), r, m)
        out[at : at + m] = np.packbits(2 * ones > count[:, None], axis=1).view(">u8").astype(U64)
        size[at : at + m] = count
    return out, size


def to_binary(f: np.ndarray) -> pa.Array:
    """(n, WORDS64) as a binary column."""
    off = np.arange(len(f) + 1, dtype=np.int32) * (8 * WORDS64)
    return pa.BinaryArray.from_buffers(pa.binary(), len(f), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(f).view(np.uint8))])


def from_binary(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.binary())
    if not len(col):
        return np.zeros((0, WORDS64), U64)
    raw = np.frombuffer(col.buffers()[2], np.uint8)
    at = np.frombuffer(col.buffers()[1], np.int64 if pa.types.is_large_binary(col.type) else np.int32)[col.offset]
    return raw[at : at + len(col) * 8 * WORDS64].copy().view(U64).reshape(-1, WORDS64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, h, f): a hash of the text and the 256-bit SimHash of its word set. Rows with a null id or without words have none."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    src = src.withColumn("h", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in pieces(batch, "text"):
                f, size = text_fingerprints(t)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), to_binary(f)], names=["doc_id", "h", "f"]).filter(pa.array(size > 0))

    return src.where("doc_id is not null and text is not null").mapInArrow(run, "doc_id long, h long, f binary")


def meeting(bits: int, apart: int, among: int = BITS) -> float:
    """Probability that `bits` coordinates, drawn without replacement from `among`, miss all `apart` that differ."""
    return math.prod((among - apart - i) / (among - i) for i in range(bits))


def plan_tables(n: int, design: int = DESIGN_DISTANCE, recall: float = DESIGN_RECALL, used: int = 0) -> tuple[int, int]:
    """(sampled bits, tables): tables so that a pair at the design distance meets in one of them with probability `recall`.

    Tables grow steeply with the bits, so at most 16 bits are sampled, and what is shuffled grows as n does: fuller buckets are split by more
    bits where they are (see _bucket_edges). Only beyond 2**34 rows, where a bucket would outgrow a task, there are more.
    `used` bits are already equal, so that all differences are among the others.
    """
    log = math.ceil(math.log2(max(n, 2)))
    bits = min(48, max(8, min(16, log), log - 18))
    p = meeting(bits, design, BITS - used)
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log1p(-p)))


def bit_choice(table: int, bits: int, seed: int) -> np.ndarray:
    return np.argsort(splitmix(np.arange(BITS), seed * 1000003 + table), kind="stable")[:bits]


def sampled_keys(f: np.ndarray, table: int, bits: int, seed: int) -> np.ndarray:
    """Keys of one table: `bits` sampled coordinates of fingerprints (n, WORDS64)."""
    key = np.zeros(len(f), U64)
    for j in bit_choice(table, bits, seed):
        key = (key << U64(1)) | ((f[:, j // 64] >> U64(63 - j % 64)) & U64(1))
    return key.view(np.int64)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _all_pairs(ids: np.ndarray, f: np.ndarray, limit: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows linked to the smallest id of their component, after comparing all pairs."""
    m = len(ids)
    label = np.arange(m)
    near = []
    for i in range(0, m, 256):
        d = np.bitwise_count(f[i : i + 256, None, :] ^ f[None]).sum(axis=2, dtype=np.int16)
        x, y = np.nonzero(d <= limit)
        keep = x + i > y
        near.append((x[keep] + i, y[keep]))
    x, y = np.concatenate([a for a, _ in near]), np.concatenate([b for _, b in near])
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (before == label).all():
            break
    hit = label != np.arange(m)
    return [(ids[hit], ids[label[hit]])]


def _middle(f: np.ndarray) -> int:
    """The row that is nearest to the majority of each bit."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(f), 4096):
        ones += np.unpackbits(np.ascontiguousarray(f[i : i + 4096]).view(np.uint8).reshape(-1, BITS // 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(distance(f, np.packbits(2 * ones > len(f)).view(U64)).argmin())


def _peel(ids: np.ndarray, f: np.ndarray, limit: int, least: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Edges of the rows close to a pivot, and the rows that are left; exact, whatever the rows are.

    All rows within `limit` of the pivot are linked to it. By the triangle inequality a row within limit / 2 of it
    (the core) can otherwise only meet rows within 3 / 2 limit: those are compared with the core, and the core goes.
    """
    out = []
    while len(ids) > least:
        d = distance(f, f[_middle(f)])
        p = int(np.flatnonzero(d == 0)[0])
        ball = d <= limit
        ball[p] = False
        out.append((ids[ball], np.full(int(ball.sum()), ids[p])))
        core = d <= limit // 2
        shell = np.flatnonzero((d > limit) & (d <= limit + limit // 2))
        inner = np.flatnonzero(core)
        for i in range(0, len(shell), 256):
            left = shell[i : i + 256]
            for j in range(0, len(inner), 4096):  # one partner in the core is enough
                if not len(left):
                    break
                c = inner[j : j + 4096]
                near = np.bitwise_count(f[left][:, None, :] ^ f[c][None]).sum(axis=2, dtype=np.int16) <= limit
                hit = near.any(axis=1)
                out.append((ids[left[hit]], ids[c[near[hit].argmax(axis=1)]]))
                left = left[~hit]
        ids, f = ids[~core], f[~core]
        if core.sum() * 32 < len(ids):
            break
    return out, ids, f


def _bucket_edges(ids: np.ndarray, f: np.ndarray, limit: int, cap: int, seed: int, used: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect what is within `limit` inside one bucket.

    Near copies of one text are taken out around pivots. Of the rest, up to `cap` rows are compared pair by pair. A larger
    rest is split by additional sampled bits, in as many tables as keep the designed recall of pairs at `limit` that agree in the
    `used` bits of the bucket, and each part is handled in the same way; a part that the bits don't shrink is compared pair by pair too.
    """
    out, ids, f = _peel(ids, f, limit, SMALL)
    m = len(ids)
    if m <= cap:
        return out + (_all_pairs(ids, f, limit) if m > 1 else [])
    extra, tables = plan_tables(m // 64, limit, used=used)
    for table in range(tables):
        key = sampled_keys(f, table, extra, seed + 1)
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        for g in np.split(order, first[1:]):
            if 2 * len(g) > m:
                out += _all_pairs(ids[g], f[g], limit)
            elif len(g) > 1:
                out += _bucket_edges(ids[g], f[g], limit, cap, seed + 2, used + extra)
    return out


def bucket_pairs(key: np.ndarray, ids: np.ndarray, f: np.ndarray, limit: int, cap: int = CAP, used: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Verified edges among rows sorted by key."""
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(key)))
    a, b = [], []
    big = size > SMALL
    room = np.repeat(np.where(big, 0, first + size), size)  # where the bucket of each row ends
    at = np.arange(len(key))
    for shift in range(1, SMALL):
        at = at[at + shift < room[at]]
        if not len(at):
            break
        hit = at[distance(f[at], f[at + shift]) <= limit]
        a.append(ids[hit])
        b.append(ids[hit + shift])
    for i, m in zip(first[big], size[big], strict=True):
        for x, y in _bucket_edges(ids[i : i + m], f[i : i + m], limit, cap, 1, used):
            a.append(x)
            b.append(y)
    z = np.zeros(0, np.int64)
    return np.concatenate([z, *a]), np.concatenate([z, *b])


@dataclass
class Hot:
    """Buckets of one table with very many rows: keys in order, the pivot of each, and into how many groups its near copies go."""

    key: np.ndarray
    pivot: np.ndarray
    groups: np.ndarray

    def spread(self, key: np.ndarray, f: np.ndarray, ids: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, group) of every row with its groups: near copies of a pivot have one, the pivot and all other rows every one.

        Whatever is within limit / 2 of the pivot is linked to it in its own group, so that two of them needn't meet; any other pair
        of the bucket meets in a group."""
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        hit = self.key[at] == key
        d = distance(f, self.pivot[at])
        n = np.where(hit, self.groups[at], 1)
        one = ~hit | ((d <= limit // 2) & (d > 0))
        times = np.where(one, 1, n)
        row = np.repeat(np.arange(len(key)), times)
        group = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        own = (splitmix(ids, 13) % n.astype(U64)).astype(np.int64)
        return row, np.where(one[row], own[row], group)


def hot_buckets(unique: DataFrame, n: int, bits: int, tables: int, limit: int, seed: int) -> dict[int, Hot]:
    """Buckets of more than about HOT rows, found in a sample, which has no say in what is found but only in how it is spread.

    A bucket that is hot has eight times the rows that it has by chance, so there are at most 2**bits / 8 in a table: what the driver gets is bounded."""
    least = max(HOT, 8 * n >> bits)
    if n < least:
        return {}
    near = max(1, least // SAMPLED // 2)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = from_binary(batch.column("f"))
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f), t, np.int32)), pa.array(sampled_keys(f, t, bits, seed)), batch.column("f")], names=["t", "key", "f"])

    def pivot(key: tuple, rows: pa.Table) -> pa.Table:
        f = from_binary(rows.column("f"))
        p = f[_middle(f)]
        m, core = len(f), int((distance(f, p) <= limit // 2).sum())
        groups = min(-(-core * SAMPLED // least), max(1, 4 * m // max(m - core, 1)))  # at most four copies of a row on average
        return pa.table({"t": pa.array([key[0].as_py()], pa.int32()), "key": [key[1].as_py()], "pivot": to_binary(p[None]), "groups": pa.array([groups], pa.int32())})

    rows = unique.where(F.pmod(F.xxhash64("f"), F.lit(SAMPLED)) == 0).select("f").mapInArrow(keys, "t int, key long, f binary")
    big = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") >= near).select("t", "key")
    big = cut(big)
    if big.isEmpty():
        return {}
    got = rows.join(big.hint("shuffle_hash"), ["t", "key"], "left_semi").groupBy("t", "key").applyInArrow(pivot, "t int, key long, pivot binary, groups int")
    got = got.where("groups > 1").toArrow().sort_by([("t", "ascending"), ("key", "ascending")])
    t, key, f, groups = np.asarray(got.column("t")), np.asarray(got.column("key")), from_binary(got.column("pivot")), np.asarray(got.column("groups"))
    return {int(x): Hot(key[t == x], f[t == x], groups[t == x].astype(np.int64)) for x in np.unique(t)}


def near_edges(
    prints: DataFrame, max_distance: int = MAX_DISTANCE, design: int | None = None, recall: float = DESIGN_RECALL, seed: int = 11
) -> DataFrame:
    """Edges (a, b) whose components are the near-duplicate groups of distinct fingerprints (uid, f).

    They go to several tables; a row of a table carries its fingerprint, so that distances are verified
    where rows meet and nothing is joined back. Tables are planned for `design`, max_distance if it isn't given.
    """
    n = prints.count()
    bits, tables = plan_tables(n, max_distance if design is None else design, recall)
    hot = hot_buckets(prints, n, bits, tables, max_distance, seed)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, ids = from_binary(batch.column("f")), np.asarray(batch.column("uid"))
            for table in range(tables):
                key, uid, bits_of = sampled_keys(f, table, bits, seed), batch.column("uid"), batch.column("f")
                group = np.zeros(len(f), np.int64)
                if table in hot:
                    row, group = hot[table].spread(key, f, ids, max_distance)
                    key, uid, bits_of = key[row], uid.take(pa.array(row)), bits_of.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(key), table, np.int32)), pa.array(key), pa.array(group.astype(np.int32)), uid, bits_of],
                    names=["t", "key", "g", "uid", "f"],
                )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [np.asarray(batch.column(c)) for c in ("t", "key", "g")]
            if held and any(c[0] != held[-1].column(name)[-1].as_py() for c, name in zip(cols, ("t", "key", "g"), strict=True)):
                yield found(held)
                held = []
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0))
            done = int(change[-1]) + 1 if len(change) else 0  # the last bucket may go on in the next batch
            if done:
                yield found([*held, batch.slice(0, done)])
                held = []
            held.append(batch.slice(done))
        if held:
            yield found(held)

    def found(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        key = splitmix(np.asarray(rows.column("key"))) ^ splitmix(np.asarray(rows.column("t")).astype(np.int64) << 32 | np.asarray(rows.column("g")), 1)
        a, b = bucket_pairs(key, np.asarray(rows.column("uid")), from_binary(rows.column("f")), max_distance, used=bits)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    rows = prints.select("uid", "f").mapInArrow(expand, "t int, key long, g int, uid long, f binary")
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "t", "key", "g").sortWithinPartitions("t", "key", "g").mapInArrow(meet, "a long, b long")


def row_groups(docs: DataFrame, max_distance: int = MAX_DISTANCE, **how) -> tuple[DataFrame, DataFrame]:
    """((doc_id, h, n) of all rows with words, (doc_id, h, group_id, group_size, kept) of those that have a near-duplicate).

    h is a hash of the text and n how many rows have this doc_id and text: they are one document, of which n rows there are. Rows that share a
    doc_id alone are documents of their own. A group is named by its first document in order of (doc_id, h), which is the one that is kept."""
    rows = cut(fingerprints(docs).groupBy("f", "doc_id", "h").agg(F.count("*").alias("n")))
    unique = cut(rows.groupBy("f").agg(F.min(F.struct("doc_id", "h")).alias("first"), F.count("*").alias("docs")).withColumn("uid", F.monotonically_increasing_id()))
    comp = components(near_edges(unique.select("uid", "f"), max_distance, **how)).select(F.col("node").alias("uid"), "group")
    named = unique.join(comp.hint("shuffle_hash"), "uid", "left").where("docs > 1 or group is not null")
    named = cut(named.select("f", "first", "docs", F.coalesce("group", "uid").alias("group")))
    sized = named.groupBy("group").agg(F.min("first").alias("head"), F.sum("docs").alias("size"))
    labels = named.join(sized.hint("shuffle_hash"), "group").select("f", "head", "size")
    of = rows.join(labels.hint("shuffle_hash"), "f").select(
        "doc_id", "h", F.col("head.doc_id").alias("group_id"), F.col("size").alias("group_size"), (F.struct("doc_id", "h") == F.col("head")).alias("kept")
    )
    return rows.select("doc_id", "h", "n"), of


def groups(docs: DataFrame, max_distance: int = MAX_DISTANCE, **how) -> DataFrame:
    """Near-duplicate groups: (doc_id, group_id, group_size, kept), only of documents that have a near-duplicate.

    A group is a connected component of pairs within `max_distance` of 256 bits; group_id is its
    smallest doc_id, the one document that is kept (of several texts with this doc_id one, by a hash of the text). Rows that
    share doc_id and text count as one document; rows that share a doc_id alone are documents of their own, each with its own row.
    Null ids, and texts that are null or have no words, belong to no group. Whole texts count, however long. Columns other than doc_id
    and text are ignored, whatever their names. An empty table gives no row.
    """
    return row_groups(docs, max_distance, **how)[1].drop("h")
