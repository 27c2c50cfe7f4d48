"""Mixing sources to target weights: fixed-length blocks, multinomial counts, index permutations, a join by index."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrove.llm.shared import cut, fresh_path
from lexgrove.llm.textbuf import U64, pieces, splitmix, texts_of, words

BLOCK, CHUNK_TOKENS, SLOTS_PER_SHARD, EXPONENT, SEED = 512, 1 << 17, 1024, 0.7, 29
#: sources that weights and totals can be held for; epochs of a chunk that one task writes; neighbours that a window adds up
MAX_SOURCES, EPOCHS, SPAN = 1 << 20, 16, 4096
SCHEMA = (
    "shard long, slot int, source string, block long, epoch int, n_tokens int, doc_ids array<long>, lang string, text string"
)


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n) at `index`: a four-round Feistel network that walks until it is below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = U64((1 << half) - 1)
    out = index.astype(U64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> U64(half), out[todo] & mask
        for r in range(4):
            left, right = right, left ^ (splitmix(right, key * 4 + r) & mask)
        out[todo] = (left << U64(half)) | right
        todo = todo[out[todo] >= U64(n)]
    return out.astype(np.int64)


def target_weights(blocks: dict[str, int], exponent: float = EXPONENT) -> dict[str, float]:
    """Shares proportional to blocks**exponent: 1 keeps the natural mix, 0 is uniform."""
    raw = {s: n**exponent for s, n in blocks.items()}
    total = sum(raw.values())
    return {s: x / total for s, x in raw.items()}


def total_slots(blocks: dict[str, int], weights: dict[str, float]) -> int:
    """So many slots that every block of every source with a weight is drawn at least once, short of a deviation of four sigma."""
    return max([0, *(math.ceil((n + 4 * math.sqrt(n)) / weights[s]) for s, n in blocks.items() if n and weights.get(s, 0) > 0)])


def shard_draws(shard: int, size: int, p: np.ndarray, seed: int) -> np.ndarray:
    """Source of each slot of one output shard, from its own generator: independent draws, so that counts are multinomial.
    A shard costs as much as it has slots, however many sources there are."""
    rng = np.random.Generator(np.random.Philox(key=[seed, shard]))
    return np.minimum(np.searchsorted(np.cumsum(p), rng.random(size), side="right"), len(p) - 1)


def sums_before(rows: DataFrame, by: str, place: str, amount: str) -> DataFrame:
    """rows with `before`: the sum of `amount` over smaller places of the same `by`. Places are added up in spans first, so that no
    task has all of a hot key's; rows should be cheap to read twice."""
    span = F.shiftright(place, SPAN.bit_length() - 1).alias("span")
    spans = rows.groupBy(by, span).agg(F.sum(amount).alias("s"))
    earlier = F.sum("s").over(W.partitionBy(by).orderBy("span").rowsBetween(W.unboundedPreceding, -1))
    spans = spans.select(by, "span", F.coalesce(earlier, F.lit(0)).alias("base"))
    inside = F.sum(amount).over(W.partitionBy(by, "span").orderBy(place).rowsBetween(W.unboundedPreceding, -1))
    return (
        rows.withColumn("span", span)
        .withColumn("inside", F.coalesce(inside, F.lit(0)))
        .join(spans.hint("shuffle_hash"), [by, "span"])
        .withColumn("before", F.col("base") + F.col("inside"))
        .drop("span", "base", "inside")
    )


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    slots: int | None = None,
    block: int = BLOCK,
    slots_per_shard: int = SLOTS_PER_SHARD,
    chunk_tokens: int = CHUNK_TOKENS,
    exponent: float = EXPONENT,
    seed: int = SEED,
) -> DataFrame:
    """Blocks of tokens drawn so that sources have the target weights.

    A token is a word (see textbuf). A source's documents are spread over chunks of about `chunk_tokens` tokens by a hash of doc_id and text;
    in a chunk they follow in order of (doc_id, text) and are cut into blocks of `block` tokens, the last of which may be
    shorter: chunks are independent tasks of bounded size, whatever the ids are. Each output shard draws its slots' sources from a multinomial
    distribution; a source's t-th slot overall takes block permutation(t mod n) of epoch t div n, each epoch having its own
    pseudorandom permutation, so that no block is used again before all of its source were. A chunk of a source that is drawn more than
    EPOCHS times goes to several tasks. The table is written once, with the tokens of each row, and its text shuffled once.

    weights: by source (default: tempered, see target_weights; a null source is the source ''; sources without a weight or
    with 0 are left out); slots: total (default: total_slots). Totals by source are held by the driver: over MAX_SOURCES sources are an error. Rows:
    shard, slot, source (null for ''), block, epoch, n_tokens, doc_ids (in the
    order of their parts), lang (of the first part), text (as it is between its first and last word; a newline between documents).
    Null ids, and null or blank texts, have no tokens. Rows that share a doc_id are documents of their own, and so are rows that are repeated
    in full: each is mixed, and in which chunk such a repeat lies depends on the partitions. A text of any length is in one chunk. Columns that
    aren't named here are ignored, whatever their names. An empty table gives no row.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    have = {c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string") for c in ("source", "lang")}
    src = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.coalesce(have["source"], F.lit("")).alias("source"),
        have["lang"].alias("lang"),
    ).where("doc_id is not null and text is not null")
    src = src.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            for part, t in pieces(batch, "text"):
                n = np.bincount(words(t)[2], minlength=len(t))
                h, again = np.asarray(part.column(4)), np.zeros(len(t), np.int64)
                for i, x in enumerate(h.tolist()):  # a row that is repeated in full gets another place
                    again[i] = seen[x] = seen.get(x, -1) + 1
                u = (splitmix(splitmix(h) + again.astype(U64)) >> U64(1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(u), pa.array(n)], names=["doc_id", "text", "source", "lang", "u", "n"]).filter(pa.array(n > 0))

    path = fresh_path(spark, "mixing")
    src.mapInArrow(count, "doc_id long, text string, source string, lang string, u long, n long").write.parquet(path)
    src = spark.read.parquet(path)
    tokens = {r["source"]: r["n"] for r in src.groupBy("source").agg(F.sum("n").alias("n")).orderBy("source").limit(MAX_SOURCES + 1).collect()}
    if len(tokens) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: name groups of them instead")
    listed = [(k, s, max(1, -(-n // chunk_tokens))) for k, (s, n) in enumerate(tokens.items())]
    known = F.broadcast(spark.createDataFrame(listed, "k int, source string, chunks long"))  # at most MAX_SOURCES rows
    placed_in = src.join(known, "source").withColumn("chunk", F.pmod("u", "chunks"))
    chunks = cut(placed_in.groupBy("k", "chunk").agg(F.ceil(F.sum("n") / block).alias("m")))
    total = {r["k"]: r["n"] for r in chunks.groupBy("k").agg(F.sum("m").alias("n")).collect()}
    blocks = {s: total[k] for k, s, _ in listed}
    weights = weights if weights is not None else target_weights(blocks, exponent)
    p = np.array([max(weights.get(s, 0), 0) for s in blocks], float)
    p = p / p.sum() if p.sum() > 0 else p
    slots = total_slots(blocks, dict(zip(blocks, p.tolist(), strict=True))) if slots is None else slots
    shards = -(-slots // slots_per_shard) if p.sum() > 0 else 0
    size = list(blocks.values())

    def draws(shard: int) -> np.ndarray:
        return shard_draws(shard, min(slots_per_shard, slots - shard * slots_per_shard), p, seed)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.column(0).to_pylist():
                k, c = np.unique(draws(s), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), s)), pa.array(k.astype(np.int32)), pa.array(c)], names=["shard", "k", "c"])

    # how many slots each source of a shard has in earlier shards
    drawn = cut(spark.range(shards).mapInArrow(counts, "shard long, k int, c long"))
    starts = sums_before(drawn, "k", "shard", "c").repartition(parts, "shard").groupBy("shard").agg(F.collect_list(F.struct("k", "before")).alias("b"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                order, before = draws(s), {x["k"]: x["before"] for x in b}
                index, epoch = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
                by = np.argsort(order, kind="stable")
                ks, first = np.unique(order[by], return_index=True)
                for k, at in zip(ks.tolist(), np.split(by, first[1:]), strict=True):
                    t = before[k] + np.arange(len(at))
                    epoch[at] = t // size[k]
                    for e in np.unique(epoch[at]):
                        sel = at[epoch[at] == e]
                        index[sel] = permute(t[epoch[at] == e] % size[k], size[k], (seed * 1009 + k) * 65537 + int(e))
                columns = [np.full(len(order), s), np.arange(len(order), dtype=np.int32), order.astype(np.int32), index, epoch.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["shard", "slot", "k", "block", "epoch"])

    placed = starts.mapInArrow(place, "shard long, slot int, k int, block long, epoch int")
    # the index of blocks: which chunk has a source's block number
    numbered = sums_before(chunks, "k", "chunk", "m").repartition(parts, "k", "chunk")
    index = numbered.select("k", "chunk", F.col("before").alias("first"), F.explode(F.sequence(F.col("before"), F.col("before") + F.col("m") - 1)).alias("block"))
    # the index has a row for each block, so it is never broadcast, however small the chunks that it is made of are
    wanted = placed.join(index.hint("shuffle_hash"), ["k", "block"]).withColumn("local", F.col("block") - F.col("first"))
    copies = [(k, max(1, math.ceil(slots * float(p[k]) / size[k] / EPOCHS))) for k, _, _ in listed if p[k] > 0]
    copies = F.broadcast(spark.createDataFrame(copies, "k int, copies int"))  # at most MAX_SOURCES rows

    def fill(key: tuple, rows: pa.Table, want: pa.Table) -> pa.Table:
        if not want.num_rows or not rows.num_rows:
            return pa.table({c: pa.array([], k) for c, k in kinds})
        ids, text = np.asarray(rows.column("doc_id")), rows.column("text")
        order = pc.sort_indices(rows.select(["doc_id", "text"]), sort_keys=[("doc_id", "ascending"), ("text", "ascending")])
        ids, lang = ids[np.asarray(order)], rows.column("lang").take(order).to_pylist()
        t = texts_of(text.take(order))
        s, e, row = words(t)
        local = np.asarray(want.column("local"))
        body: dict[int, tuple] = {}
        for i in np.unique(local).tolist():
            a, z = i * block, min((i + 1) * block, len(s))
            own = row[a:z]
            edge = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            parts = []
            for x, y in zip(edge, np.append(edge[1:], z - a), strict=True):
                parts.append(t.data[s[a + x] : e[a + y - 1]].tobytes())
            body[i] = (z - a, ids[own[edge]].tolist(), lang[own[0]], b"\n".join(parts).decode("utf-8", "replace"))
        name = rows.column("source")[0].as_py() or None
        cols = [want.column("shard"), want.column("slot"), pa.array([name] * len(local), pa.string()), want.column("block"), want.column("epoch")]
        got = [body[i] for i in local.tolist()]
        cols += [pa.array([g[j] for g in got], k) for j, k in enumerate((pa.int32(), pa.list_(pa.int64()), pa.string(), pa.string()))]
        return pa.table(dict(zip([c for c, _ in kinds], cols, strict=True)))

    kinds = list(
        zip(
            [c.split()[0] for c in SCHEMA.split(", ")],
            [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.string(), pa.string()],
            strict=True,
        )
    )
    left = placed_in.join(copies, "k").select("k", "chunk", "doc_id", "lang", "source", "text", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    right = wanted.join(copies, "k").withColumn("copy", F.pmod(F.floor(F.col("epoch") / EPOCHS).cast("int"), "copies"))
    right = right.select(F.col("k").alias("rk"), F.col("chunk").alias("rchunk"), F.col("copy").alias("rcopy"), "shard", "slot", "block", "epoch", "local")
    return left.groupBy("k", "chunk", "copy").cogroup(right.groupBy("rk", "rchunk", "rcopy")).applyInArrow(fill, SCHEMA)


def mixed_documents(docs: DataFrame, slots_per_shard: int = SLOTS_PER_SHARD, **how) -> DataFrame:
    """mix() as documents: a block is one, with the columns of the documents table. Its doc_id is its place in the mix and no id of
    an input document (mix() has those, in doc_ids)."""
    m = mix(docs, slots_per_shard=slots_per_shard, **how)
    return m.select(
        (F.col("shard") * slots_per_shard + F.col("slot")).alias("doc_id"), "text", "lang", "source", F.length("text").cast("long").alias("n_chars")
    )
