"""Bags of words, TF-IDF, clustering and topics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrove.functions import vector as V
from lexgrove.operators import batches as B
from lexgrove.session import cut, cut_plan, ranked

#: tokens in a block of centroids at most, weights in a cell on average at most
TOKENS, CELL = 1 << 19, 1 << 21


def bag(tokens: DataFrame) -> DataFrame:
    """(token, cnt) of all rows of (words)."""
    return tokens.select(F.explode("words").alias("token")).groupBy("token").agg(F.count("*").alias("cnt"))


def bag_by(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, token, cnt)."""
    return bag_with_length(tokens, key).drop("length")


def bag_with_length(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, token, cnt, length): length is the number of words of the key. A row is counted where it is read."""
    return B.count_in_rows(tokens, key, "words", 1, B.listed, "token")


def _length(bags: DataFrame, key: str) -> Column:
    """The column if the bags have it, else the key's counts are brought together."""
    return F.col("length") if "length" in bags.columns else F.sum("cnt").over(W.partitionBy(key))


def bag_maps(bags: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, bag): a map for each key."""
    return bags.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("token", "cnt")))).alias("bag"))


def document_frequency(bags: DataFrame) -> DataFrame:
    """(token, df) of (key, token, cnt). It reads cnt, so that a plan that also uses bags makes them once."""
    return bags.groupBy("token").agg(F.count(F.when(F.col("cnt") > 0, 1)).alias("df"))


def weighted(bags: DataFrame, n_docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, token, cnt, tfidf): as tfidf, with the counts.

    The frequency is a join by token: neither side is broadcast by force, both come from one exchange, and a token that
    nearly all documents have is a skewed key of that join, which adaptive execution splits.
    """
    return (
        bags.withColumn("tf", F.col("cnt") / _length(bags, key))
        .join(document_frequency(bags).hint("shuffle_hash"), "token")
        .crossJoin(n_docs)
        .select(key, "token", "cnt", (F.col("tf") * F.ln(F.col("n") / F.col("df"))).alias("tfidf"))
    )


def tfidf(bags: DataFrame, n_docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, token, tfidf): count / length times ln(N / df), unsmoothed; n_docs is one row (n), empty documents included."""
    return weighted(bags, n_docs, key).select(key, "token", "tfidf")


def tfidf_self(bags: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, token, tfidf): each token of a document as a document of its own: ln(length / count)."""
    return bags.select(key, "token", F.ln(_length(bags, key) / F.col("cnt")).alias("tfidf"))


def top_terms(bags: DataFrame, key: str, k: int) -> DataFrame:
    """(key, rank, token, cnt): the k commonest tokens of each key; of equal counts those that sort first."""
    sums = bags.groupBy(key, "token").agg(F.sum("cnt").alias("cnt"))
    order = W.partitionBy(key).orderBy(F.desc("cnt"), "token")
    return sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(key, "rank", "token", "cnt")


def hashed_vectors(weights: DataFrame, dims: int, key: str = "doc_id") -> DataFrame:
    """(key, v): weights (key, token, tfidf) added up in `dims` hash buckets, so that the width doesn't grow with the vocabulary."""
    bucket = weights.groupBy(key, F.pmod(F.xxhash64("token"), F.lit(dims)).cast("int").alias("b")).agg(F.sum("tfidf").alias("x"))
    m = bucket.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("b", "x"))).alias("m"))
    return m.select(key, F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias("v"))


def assign(vectors: DataFrame, centroids: DataFrame, key: str) -> DataFrame:
    """(key, cluster, distance): the nearest centroid by squared distance, of equal ones the lowest; centroids (cluster, c) are few."""
    pairs = vectors.crossJoin(F.broadcast(centroids))
    best = F.min(F.struct(V.squared_distance(F.col("v"), F.col("c")).alias("distance"), "cluster"))
    return pairs.groupBy(key).agg(best.alias("b")).select(key, "b.cluster", "b.distance")


def nearest(vectors: DataFrame, centroids: DataFrame, key: str) -> DataFrame:
    """As assign, without a shuffle: the centroids are one array, compared inside each row."""
    all_ = centroids.agg(F.sort_array(F.collect_list(F.struct("cluster", "c"))).alias("cs"))
    near = F.array_min(
        F.transform("cs", lambda s: F.struct(V.squared_distance(F.col("v"), s["c"]).alias("distance"), s["cluster"].alias("cluster")))
    )
    return vectors.crossJoin(F.broadcast(all_)).withColumn("b", near).select(key, "v", "b.cluster", "b.distance")


def update(assigned: DataFrame, dims: int) -> DataFrame:
    """(cluster, c, size): means of (cluster, v); partial sums before the shuffle."""
    sums = [F.avg(F.col("v")[i].cast("double")) for i in range(dims)]
    return assigned.groupBy("cluster").agg(F.array(*sums).alias("c"), F.count("*").alias("size"))


def align(vectors: DataFrame) -> DataFrame:
    """Vectors v as long as the longest, the rest 0: distances and products are those over the shorter length."""
    longest = vectors.agg(F.coalesce(F.max(F.size("v")), F.lit(0)).alias("__n"))
    zeros = F.array_repeat(F.lit(0.0), F.col("__n") - F.size("v"))
    return vectors.crossJoin(longest).withColumn("v", F.concat(F.col("v").cast("array<double>"), zeros)).drop("__n")


def kmeans(
    vectors: DataFrame, k: int = 3, initial: np.ndarray | None = None, seed: int = 0, max_iter: int = 100, tol: float = 1e-4, key: str = "vec_id"
) -> tuple[DataFrame, np.ndarray]:
    """Lloyd's algorithm: ((key, cluster) of every row with a vector, centroids). A vector with a null, infinite or NaN entry has none. Vectors
    of different lengths are an error: `align` makes them equally long.

    Starts are k rows by a hash of the key (fewer if there are fewer). A centroid without rows stays; it ends when no
    coordinate moves by tol, with a tol of 0 when none moves at all, or after max_iter rounds. Distances are added up coordinate by coordinate, as SQL
    does it. Each round is one pass in which a partition sends only k sums, so what the driver gets depends on k alone.
    """
    src = vectors.select(key, F.col("v").cast("array<double>").alias("v")).where("v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    if initial is None:
        rows = src.orderBy(F.xxhash64(F.lit(seed), key), key).limit(k).collect()
        initial = np.array([r["v"] for r in rows], float)
    c = np.array(initial, float)
    if not len(c):
        return src.select(key, F.lit(0).alias("cluster")), c

    def near(batch: pa.RecordBatch, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = np.asarray(batch.column(1).flatten(), float)
        if len(v) != batch.num_rows * c.shape[1]:
            raise ValueError(f"vectors must have {c.shape[1]} entries each")
        v = v.reshape(batch.num_rows, -1)
        distance = np.zeros((len(v), len(c)))
        for i in range(c.shape[1]):
            distance += (v[:, i, None] - c[:, i]) ** 2
        return v, distance.argmin(axis=1)

    def sums(c: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros_like(c), np.zeros(len(c), np.int64)
            for batch in batches:
                if batch.num_rows:
                    v, who = near(batch, c)
                    np.add.at(total, who, v)
                    n += np.bincount(who, minlength=len(c))
            off = np.arange(len(c) + 1, dtype=np.int32) * c.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(c), dtype=np.int32)), pa.array(n), pa.ListArray.from_arrays(pa.array(off), pa.array(total.reshape(-1)))],
                names=["cluster", "n", "s"],
            )

        return run

    src = cut(src)
    for _ in range(max_iter):
        got = src.mapInArrow(sums(c), "cluster int, n long, s array<double>")
        new = c.copy()
        for r in got.select("cluster", "n", F.posexplode("s").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect():
            if r["n"]:
                new[r["cluster"], r["i"]] = r["x"] / r["n"]
        moved = np.abs(new - c).max(initial=0.0)
        c = new
        if moved < tol or moved == 0:
            break

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near(batch, c)[1].astype(np.int32))], names=[key, "cluster"])

    kind = dict(src.dtypes)[key]
    return src.mapInArrow(label, f"{key} {kind}, cluster int"), c


def kmeans_terms(
    weights: DataFrame, k: int = 3, seed: int = 0, max_iter: int = 100, tol: float = 1e-4, key: str = "doc_id", keys: DataFrame | None = None
) -> DataFrame:
    """(key, cluster) of sparse vectors (key, token, tfidf): kmeans over one coordinate for each token, with the same starts and end.

    Documents and tokens are numbered once, and the weights are packed in cells of a block of tokens and one of documents, in the folder of
    checkpoints, by block of tokens. A round sends k numbers for each document from each block of tokens to the document's block, and the document's cluster
    back; the cells stay where they are, and no task has more centroids than those of its tokens. Of `keys` (key), those without weights are zero
    vectors: they are nearest to the shortest centroid and count in its mean, but none of them is a start.
    """
    spark = weights.sparkSession
    rows = cut(weights.select(key, "token", F.col("tfidf").cast("double").alias("x")))
    bare = None if keys is None else cut(keys.select(key).join(rows.select(key).distinct(), key, "left_anti"))
    empty = bare.count() if bare is not None else 0
    names = cut(ranked(rows.select(key).distinct(), [key], "d"))
    starts = [r["d"] for r in names.orderBy(F.xxhash64(F.lit(seed), key), key).limit(k).collect()]
    if not starts:
        return (rows if bare is None else bare).select(key, F.lit(0).alias("cluster"))
    tokens = ranked(rows.select("token").distinct(), ["token"], "t")
    numbers = cut(rows.join(names.hint("shuffle_hash"), key).join(tokens.hint("shuffle_hash"), "token").select("d", "t", "x"))
    n, n_docs, n_tokens = numbers.agg(F.count("*"), F.max("d") + 1, F.max("t") + 1).first()
    k, slots = len(starts), spark.sparkContext.defaultParallelism
    wide = max(slots, -(-n_tokens // TOKENS))  # blocks of tokens
    deep = max(1, -(-n // (wide * CELL)))  # blocks of documents
    block = F.pmod("t", F.lit(wide)).cast("int").alias("tb"), F.pmod("d", F.lit(deep)).cast("int").alias("db")
    sorted_ = numbers.select(*block, (F.col("d") / deep).cast("int").alias("d"), (F.col("t") / wide).cast("int").alias("t"), "x").repartition(wide, "tb").sortWithinPartitions("tb", "db", "d")
    cells = cut(sorted_.mapInArrow(_cells, "tb int, db int, cell binary").repartition(wide, "tb"))
    high = [-(-(n_docs - i) // deep) for i in range(deep)]
    long = [max(0, -(-(n_tokens - i) // wide)) for i in range(wide)]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Centroids that are the starts."""
        c: dict[int, np.ndarray] = {}
        for tb, db, cell in _each(batches):
            d, t, x = _open(cell)
            at = c.setdefault(tb, np.zeros((long[tb], k)))
            for j, start in enumerate(starts):
                if start % deep == db:
                    i, e = np.searchsorted(d, [start // deep, start // deep + 1])
                    at[t[i:e], j] += x[i:e]
        for tb, at in c.items():
            yield _centroids(tb, at, 0.0)

    def dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tb, db, cell, c in _each(batches):
            d, t, x = _open(cell)
            c = np.frombuffer(c).reshape(-1, k)
            head = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
            found = np.empty((len(head), k))
            for j in range(k):
                found[:, j] = np.add.reduceat(x * c[t, j], head)
            yield pa.RecordBatch.from_arrays([pa.array([db], pa.int32()), pa.array([d[head].tobytes()], pa.binary()), pa.array([found.tobytes()], pa.binary())], names=["db", "d", "dots"])

    def nearest_of(lengths: list[float]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for db, d, found in _each(batches):
                total.setdefault(db, np.zeros((high[db], k)))[np.frombuffer(d, np.int32)] += np.frombuffer(found).reshape(-1, k)
            for db, found in total.items():
                who = (np.array(lengths) - 2 * found).argmin(axis=1).astype(np.int32)
                size = np.bincount(who, minlength=k)
                yield pa.RecordBatch.from_arrays([pa.array([db], pa.int32()), pa.array([who.tobytes()], pa.binary()), pa.array([size.tolist()], pa.list_(pa.int64()))], names=["db", "who", "size"])

        return run

    def means(size: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            old: dict[int, np.ndarray] = {}
            for tb, _, cell, c, who in _each(batches):
                d, t, x = _open(cell)
                if tb not in sums:
                    sums[tb], old[tb] = np.zeros(long[tb] * k), np.frombuffer(c).reshape(-1, k)
                sums[tb] += np.bincount(t.astype(np.int64) * k + np.frombuffer(who, np.int32)[d], x, long[tb] * k)
            for tb, s in sums.items():
                new = np.where(size > 0, s.reshape(-1, k) / np.maximum(size, 1), old[tb])
                yield _centroids(tb, new, float(np.abs(new - old[tb]).max(initial=0.0)))

        return run

    def state(c: DataFrame) -> tuple[list[float], float]:
        """Squared lengths of the centroids, and the largest move of a coordinate: k numbers from each block."""
        got = c.select("lengths", "moved").collect()
        return np.sum([r["lengths"] for r in got], axis=0).tolist(), max(r["moved"] for r in got)

    kinds = "tb int, c binary, lengths array<double>, moved double"

    def assigned(c: DataFrame, lengths: list[float]) -> DataFrame:
        found = cells.join(c.select("tb", "c").hint("shuffle_hash"), "tb").select("tb", "db", "cell", "c").mapInArrow(dots, "db int, d binary, dots binary")
        return cut_plan(found.repartition(deep, "db").mapInArrow(nearest_of(lengths), "db int, who binary, size array<long>"))

    c = cut_plan(cells.mapInArrow(first, kinds))
    lengths, _ = state(c)
    for _ in range(max_iter):
        who = assigned(c, lengths)
        size = np.sum([r["size"] for r in who.select("size").collect()], axis=0)
        size[int(np.argmin(lengths))] += empty
        with_c = cells.join(c.select("tb", "c").hint("shuffle_hash"), "tb")
        both = with_c.join(F.broadcast(who.select("db", "who")), "db").select("tb", "db", "cell", "c", "who")  # 4 bytes for each document
        c = cut_plan(both.mapInArrow(means(size), kinds))
        lengths, moved = state(c)
        if moved < tol:
            break

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for db, who in _each(batches):
            of = np.frombuffer(who, np.int32)
            for i in range(0, len(of), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(db + deep * np.arange(i, min(i + (1 << 16), len(of)))), pa.array(of[i : i + (1 << 16)])], names=["d", "cluster"])

    found = names.join(assigned(c, lengths).select("db", "who").mapInArrow(opened, "d long, cluster int"), "d").select(key, "cluster")
    return found.unionByName(bare.select(key, F.lit(int(np.argmin(lengths))).alias("cluster"))) if empty else found


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows; binaries aren't copied."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(v.as_buffer() if pa.types.is_binary((v := c[i]).type) else v.as_py() for c in batch.columns)


def _open(cell: pa.Buffer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = cell.size // 16
    return np.frombuffer(cell, np.int32, n), np.frombuffer(cell, np.int32, n, 4 * n), np.frombuffer(cell, np.float64, n, 8 * n)


def _centroids(tb: int, c: np.ndarray, moved: float) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([tb], pa.int32()), pa.array([c.tobytes()], pa.binary()), pa.array([(c * c).sum(axis=0).tolist()], pa.list_(pa.float64())), pa.array([moved])],
        names=["tb", "c", "lengths", "moved"],
    )


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (tb, db, d) as one row for each cell."""
    at, held = None, []

    def flush() -> pa.RecordBatch:
        d, t, x = (np.concatenate(a) for a in zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([d.tobytes() + t.tobytes() + x.tobytes()], pa.binary())], names=["tb", "db", "cell"])

    for batch in batches:
        tb, db, d, t, x = (np.asarray(c) for c in batch.columns)
        cut_at = np.flatnonzero((tb[1:] != tb[:-1]) | (db[1:] != db[:-1])) + 1
        for i, j in zip([0, *cut_at.tolist()], [*cut_at.tolist(), len(tb)], strict=True):
            if i == j:
                continue
            if at is not None and at != (tb[i], db[i]):
                yield flush()
                held = []
            at = (tb[i], db[i])
            held.append((d[i:j].copy(), t[i:j].copy(), x[i:j].copy()))
    if held:
        yield flush()
