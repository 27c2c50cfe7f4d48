"""Near-duplicate embeddings by spherical-cap filters with a structured random product code."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.components import components
from lexgrove.llm.shared import cut
from lexgrove.llm.textbuf import splitmix

MIN_COSINE, BLOCKS, SEED = 0.9, 3, 41
#: filters of one code that a vector exceeds on average (few filters of many codes need fewer copies for the same recall), unrelated vectors in a filter, recall of pairs at the limit that the number of codes is designed for
PER_CODE, BUCKET, RECALL = 0.5, 1024, 0.98
#: simulated pairs that a plan is measured on, and share of vectors without a filter
PAIRS, MISSED = 2048, 1e-4
#: a vector in a bucket larger than this is first compared with pivots
SMALL = 48
#: bits of a signature, and standard deviations by which the signatures of a pair at the limit may differ more than expected
SIGN_BITS, SLACK = 256, 4.5
#: vectors with a partner by signature whose ids are broadcast at most; more are joined by a shuffle
FEW = 1 << 20


def cap_height(dims: int, share: float) -> float:
    """The cosine that a random direction exceeds with probability `share`."""
    x = np.linspace(-1, 1, 400_001)
    density = np.maximum(1 - x * x, 0) ** max((dims - 3) / 2, 0)
    tail = np.cumsum(density[::-1])[::-1] / density.sum()
    return float(x[np.searchsorted(-tail, -share)])


def codebooks(dims: int, words: int, seed: int = SEED) -> list[np.ndarray]:
    """For each of BLOCKS slices of the dimensions, `words` random directions; a filter is one word of each, over sqrt(BLOCKS)."""
    out = []
    for b, part in enumerate(np.array_split(np.arange(dims), min(BLOCKS, dims))):
        g = np.random.Generator(np.random.Philox(key=[seed, b])).standard_normal((words, len(part)))
        out.append((g / np.linalg.norm(g, axis=1, keepdims=True) / np.sqrt(min(BLOCKS, dims))).astype(np.float32))
    return out


def rotation(dims: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    g = np.random.Generator(np.random.Philox(key=[seed, 1 << 20])).standard_normal((dims, dims))
    return np.linalg.qr(g)[0].astype(np.float32)


def pairs_at(cosine: float, n: int, dims: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """n random pairs of unit vectors with that cosine."""
    g = np.random.Generator(np.random.Philox(key=[seed, 1 << 21]))
    a, z = unit(g.standard_normal((n, dims)))[0], g.standard_normal((n, dims))
    z = unit(z - (z * a).sum(axis=1, keepdims=True) * a)[0]
    return a, (cosine * a + math.sqrt(1 - cosine**2) * z).astype(np.float32)


def plan(n: int, dims: int, limit: float, seed: int = SEED, recall: float = RECALL) -> tuple[int, float, int]:
    """(words of a codebook, height of the caps, codes) for n vectors.

    A code has so many filters that about BUCKET unrelated vectors share one, whatever n is. How often a pair at the limit meets in
    one code is measured on simulated pairs; the number of independent codes follows from it and the designed recall, and hardly a vector
    (one in 1 / MISSED) has no filter at all."""
    blocks = min(BLOCKS, dims)
    words = max(2, round((n * PER_CODE / BUCKET) ** (1 / blocks)))
    height = cap_height(dims, min(0.5, PER_CODE / words**blocks))
    a, b = pairs_at(limit, PAIRS, dims, seed)
    turn, books = rotation(dims, seed), codebooks(dims, words, seed)
    (ra, ca), (rb, cb) = list_decode(a @ turn, books, height), list_decode(b @ turn, books, height)
    met = len(set(ra[np.isin(ra * words**blocks + ca, rb * words**blocks + cb)].tolist())) / PAIRS
    met, some = (min(max(x, 1 / PAIRS), 0.999) for x in (met, len(np.unique(ra)) / PAIRS))
    return words, height, max(1, math.ceil(math.log(1 - recall) / math.log(1 - met)), math.ceil(math.log(MISSED) / math.log(1 - some)))


def list_decode(v: np.ndarray, books: list[np.ndarray], height: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of every filter direction whose inner product with the row is at least `height`.

    Blocks are added one by one, and a partial word stays only if the best words of the blocks that are
    left could still lift it to the height: the full code is never listed."""
    at, scores = 0, []
    for b in books:
        scores.append(v[:, at : at + b.shape[1]] @ b.T)
        at += b.shape[1]
    best = np.stack([s.max(axis=1) for s in scores], axis=1)
    rest = np.hstack([np.cumsum(best[:, ::-1], axis=1)[:, ::-1][:, 1:], np.zeros((len(v), 1), np.float32)])
    row, code, total = np.arange(len(v)), np.zeros(len(v), np.int64), np.zeros(len(v), np.float32)
    for i, s in enumerate(scores):
        grown = total[:, None] + s[row]
        x, y = np.nonzero(grown + rest[row, i][:, None] >= height)
        code, total, row = code[x] * s.shape[1] + y, grown[x, y], row[x]
    return row, code


def unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows at unit length, and which rows have one."""
    size = np.linalg.norm(v.astype(np.float64), axis=1)
    ok = np.isfinite(size) & (size > 0)
    return (v / np.where(ok, size, 1)[:, None]).astype(np.float32), ok


def _matrix(col: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(pc.list_flatten(col), np.float32).reshape(-1, dims)


def _peel(ids: np.ndarray, v: np.ndarray, limit: float) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Edges of the rows close to a pivot, and the rows that are left; exact, whatever the rows are.

    All rows within the limit's angle of the pivot are linked to it. By the triangle inequality a row within half of that angle
    (the core) can otherwise only meet rows within one and a half of it: those are compared with the core, and the core goes.
    """
    out, theta = [], math.acos(min(1.0, limit))
    half, reach = math.cos(theta / 2 * 0.999), math.cos(min(math.pi, theta * 1.501 + 1e-3))
    while len(ids) > SMALL:
        p = int((v @ v.mean(axis=0)).argmax())
        c = v @ v[p]
        ball = c >= limit
        ball[p] = False
        out.append((ids[ball], np.full(int(ball.sum()), ids[p])))
        core = c >= half
        core[p] = True
        inner, shell = np.flatnonzero(core), np.flatnonzero((c < limit) & (c >= reach))
        for i in range(0, len(shell), 512):
            left = shell[i : i + 512]
            for j in range(0, len(inner), 8192):  # one partner in the core is enough
                k = inner[j : j + 8192]
                near = v[left] @ v[k].T >= limit
                hit = near.any(axis=1)
                out.append((ids[left[hit]], ids[k[near[hit].argmax(axis=1)]]))
                left = left[~hit]
        ids, v = ids[~core], v[~core]
        if core.sum() * 32 < len(ids):
            break
    return out, ids, v


def _link(ids: np.ndarray, v: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what is within the limit in one bucket: near copies around pivots, then every row with every other."""
    out, ids, v = _peel(ids, v, limit)
    label = np.arange(len(ids))
    x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, len(ids), 512):
        a, b = np.nonzero(v[i : i + 512] @ v.T >= limit)
        keep = a + i > b
        x.append(a[keep] + i)
        y.append(b[keep])
    x, y = np.concatenate(x), np.concatenate(y)
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (before == label).all():
            break
    hit = label != np.arange(len(ids))
    out.append((ids[hit], ids[label[hit]]))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def signatures(v: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(n, SIGN_BITS / 64) signs of the vectors' products with random planes."""
    return np.packbits(v @ planes >= 0, axis=1).view(np.uint64)


def widest(limit: float) -> int:
    """The number of signs that a pair at the limit has different, at most, but for SLACK standard deviations."""
    p = math.acos(max(-1.0, min(1.0, limit))) / math.pi
    return math.ceil(SIGN_BITS * p + SLACK * math.sqrt(SIGN_BITS * p * (1 - p)))


def partnered(sig: np.ndarray, most: int) -> np.ndarray:
    """Which rows of a bucket have another one with at most `most` different signs; exact, and no pair is listed.

    What is close to a pivot is settled at once, together with the pivot; only the others are compared with all rows."""
    n = len(sig)
    out = np.zeros(n, bool)
    rest = np.arange(n)
    while len(rest) > SMALL:
        d = np.bitwise_count(sig ^ sig[rest[0]]).sum(axis=1)
        near = d <= most
        if near.sum() > 1:
            out |= near
        rest = rest[1:]
        rest = rest[~out[rest]]
        if near.sum() * 32 < n:
            break
    for i in range(0, len(rest), 256):
        at = rest[i : i + 256]
        d = np.bitwise_count(sig[at][:, None, 0] ^ sig[None, :, 0])
        for j in range(1, sig.shape[1]):
            d = d + np.bitwise_count(sig[at][:, None, j] ^ sig[None, :, j])
        near = d <= most
        near[np.arange(len(at)), at] = False
        out[at] |= near.any(axis=1)
        out |= near.any(axis=0)
    return out


def groups(
    vectors: DataFrame, min_cosine: float = MIN_COSINE, recall: float = RECALL, id_col: str = "vec_id", seed: int = SEED
) -> DataFrame:
    """Near-duplicate groups of embeddings: (vec_id, group_id, group_size, kept), only of vectors that have a near-duplicate.

    Vectors at cosine `min_cosine` or more are near-duplicates; a group is a connected component, named by its smallest id, which is kept.
    Every vector is a query. Pairs are searched in independent codes (see plan): buckets stay small at any size, and a pair at the limit
    is found with probability `recall`, closer ones more often. First only ids and short signatures go to the filters, which shows what
    may have a partner there; then these vectors alone are joined on the filters and verified. Vectors of equal bytes are one vector with
    several ids. Null ids, null vectors, those
    with a null, infinite or no entry, and zero vectors belong to no group; rows that share an id are one. Vectors of another length than
    the longest are compared among their own length only. A cosine that is exactly the limit counts (in 32-bit arithmetic). Other columns are
    ignored, whatever their names. An empty table gives no row.
    """
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("v"))
    src = src.where("id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) > 1e30)")
    src = src.where("exists(v, x -> x <> 0)")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            raw, off = np.asarray(pc.list_flatten(lists), np.float32), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
            raw = np.where(raw == 0, np.float32(0), raw)  # a negative zero is a zero
            codes = [hashlib.blake2b(raw[i:j].tobytes(), digest_size=16).digest() for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary()), pa.array(np.diff(off).astype(np.int32))], names=["id", "code", "d"])

    ids = cut(src.mapInArrow(digest, "id long, code binary, d int"))
    first = cut(ids.groupBy("code", "d").agg(F.min("id").alias("rep")))
    same = ids.join(first.hint("shuffle_hash"), ["code", "d"]).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    lengths = {r["d"]: r["n"] for r in first.groupBy("d").agg(F.count("*").alias("n")).collect()}
    edges = same
    for dims, n in sorted(lengths.items()):
        words, height, codes = plan(n, dims, min_cosine, seed, recall) if dims > 1 else (2, 0.5, 1)
        edges = edges.union(_near(src.where(F.size("v") == dims), dims, words, height, codes, min_cosine, seed))
    comp = components(edges)
    sized = comp.groupBy("group").agg(F.count("*").alias("n"))
    return comp.join(sized, "group").select(
        F.col("node").alias(id_col), F.col("group").alias("group_id"), F.col("n").alias("group_size"), (F.col("node") == F.col("group")).alias("kept")
    )


def _buckets(batches: Iterator[pa.RecordBatch], found) -> Iterator[pa.RecordBatch]:
    """found() of each bucket of rows that come in order of their filter, the first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        f = np.asarray(batch.column(0))
        if held and held[-1].column(0)[-1].as_py() != f[0]:
            yield found(pa.Table.from_batches(held))
            held = []
        change = np.flatnonzero(f[1:] != f[:-1])
        done = int(change[-1]) + 1 if len(change) else 0
        if done:
            yield found(pa.Table.from_batches([*held, batch.slice(0, done)]))
            held = []
        held.append(batch.slice(done))
    if held:
        yield found(pa.Table.from_batches(held))


def _edges(f: np.ndarray) -> list[tuple[int, int]]:
    """First row and end of each bucket of more than one row."""
    head = np.flatnonzero(np.append(True, f[1:] != f[:-1]))
    end = np.append(head[1:], len(f))
    return [(i, j) for i, j in zip(head.tolist(), end.tolist(), strict=True) if j > i + 1]


def _near(src: DataFrame, dims: int, words: int, height: float, codes: int, limit: float, seed: int) -> DataFrame:
    spark = src.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    books = [(rotation(dims, seed + i), codebooks(dims, words, seed + i)) for i in range(codes)]
    if dims == 1:  # two directions are all there are
        books = [(np.ones((1, 1), np.float32), [np.array([[1], [-1]], np.float32)])]
    planes = np.random.Generator(np.random.Philox(key=[seed, 1 << 22])).standard_normal((dims, SIGN_BITS)).astype(np.float32)
    most = widest(limit)

    def decode(payload):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[bytes] = set()
            for batch in batches:
                for i in range(0, batch.num_rows, 256):
                    part = batch.slice(i, 256)
                    raw = _matrix(part.column("v"), dims)
                    new = []  # of vectors that are equal in a partition one goes on; their ids are linked already
                    for j, row in enumerate(np.where(raw == 0, np.float32(0), raw)):
                        x = hashlib.blake2b(row.tobytes(), digest_size=16).digest()
                        if x not in seen:
                            seen.add(x)
                            new.append(j)
                    v, ids = unit(raw[new])[0], np.asarray(part.column("id"))[new]
                    found_in = [list_decode(v @ turn, b, height) for turn, b in books]
                    row = np.concatenate([r for r, _ in found_in])
                    code = np.concatenate([splitmix(c, i) for i, (_, c) in enumerate(found_in)])
                    yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(ids[row]), payload(v, row)], names=["f", "id", "x"])

        return run

    def short(v: np.ndarray, row: np.ndarray) -> pa.Array:
        raw = np.ascontiguousarray(signatures(v, planes)[row])
        off = np.arange(len(row) + 1, dtype=np.int32) * (SIGN_BITS // 8)
        return pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(off), pa.py_buffer(raw.view(np.uint8).reshape(-1))])

    def full(v: np.ndarray, row: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array((np.arange(len(row) + 1) * dims).astype(np.int32)), pa.array(v[row].reshape(-1)))

    def hopeful(rows: pa.Table) -> pa.RecordBatch:
        f, ids = np.asarray(rows.column("f")), np.asarray(rows.column("id"))
        x = rows.column("x").combine_chunks()
        sig = np.frombuffer(b"".join(x.to_pylist()), np.uint64).reshape(len(f), -1)
        some = [ids[i:j][partnered(sig[i:j], most)] for i, j in _edges(f)]
        return pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([np.zeros(0, np.int64), *some])))], names=["id"])

    def verified(rows: pa.Table) -> pa.RecordBatch:
        f, ids = np.asarray(rows.column("f")), np.asarray(rows.column("id"))
        v = _matrix(rows.column("x").combine_chunks(), dims)
        got = [_link(ids[i:j], v[i:j], limit) for i, j in _edges(f)]
        z = np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([z, *[g[k] for g in got]])) for k in (0, 1)], names=["a", "b"])

    def met(rows: DataFrame, found, schema: str) -> DataFrame:
        return rows.repartition(parts, "f").sortWithinPartitions("f").mapInArrow(lambda batches: _buckets(batches, found), schema)

    some = cut(met(src.mapInArrow(decode(short), "f long, id long, x binary"), hopeful, "id long").distinct())
    few = F.broadcast(some) if some.count() <= FEW else some.hint("shuffle_hash")
    rows = src.join(few, "id", "left_semi").mapInArrow(decode(full), "f long, id long, x array<float>")
    return met(rows, verified, "a long, b long")
