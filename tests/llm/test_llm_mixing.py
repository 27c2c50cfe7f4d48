"""Mixing against a plain version of the same draws; permutations; shares; edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexgrove.llm import mixing
from lexgrove.llm.textbuf import splitmix


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000])
def test_permutations(n):
    a, b = (mixing.permute(np.arange(n), n, key) for key in (3, 4))
    assert sorted(a.tolist()) == sorted(b.tolist()) == list(range(n))
    if n >= 16:
        assert a.tolist() != b.tolist() != list(range(n))


def test_weights():
    assert mixing.target_weights({"a": 100, "b": 100}) == {"a": 0.5, "b": 0.5}
    w = mixing.target_weights({"a": 1000, "b": 10})
    assert w["a"] + w["b"] == pytest.approx(1)
    assert w["b"] > 10 / 1010
    assert mixing.total_slots({}, {}) == 0


def places(spark, rows):
    """The hash of each row that chooses its chunk; no row is repeated."""
    df = spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(rows)], "i int, doc_id long, text string")
    h = {r.i: r.h for r in df.select("i", F.xxhash64(F.lit(mixing.SEED), "doc_id", "text").alias("h")).collect()}
    return [int(splitmix(splitmix(np.array([h[i]])))[0] >> np.uint64(1)) for i in range(len(rows))]


def brute(rows, weights, slots, block, per_shard, seed, chunk_tokens=1 << 40, u=None):
    """The same mix in plain Python over all rows."""
    docs = {}
    for i, (d, text, lang, source) in enumerate(rows):
        if d is not None and text and text.split():
            docs.setdefault(source or "", []).append((d, text, lang, u[i] if u else 0))
    blocks = {}
    for source, own in sorted(docs.items()):
        chunks = -(-sum(len(r[1].split()) for r in own) // chunk_tokens)
        for chunk in range(chunks):
            words = [(r[0], r[2], w) for r in sorted(own, key=lambda r: r[:2]) if r[3] % chunks == chunk for w in r[1].split()]
            blocks.setdefault(source, []).extend(words[i : i + block] for i in range(0, len(words), block))
    sizes = {s: len(b) for s, b in sorted(blocks.items())}
    weights = weights or mixing.target_weights(sizes)
    names = list(sizes)
    p = np.array([weights.get(s, 0) for s in names])
    p = p / p.sum()
    if slots is None:
        slots = max(math.ceil((sizes[s] + 4 * math.sqrt(sizes[s])) / x) for s, x in zip(names, p, strict=True))
    out, used = [], dict.fromkeys(range(len(names)), 0)
    for shard in range(-(-slots // per_shard)):
        order = mixing.shard_draws(shard, min(per_shard, slots - shard * per_shard), p, seed)
        for slot, k in enumerate(order.tolist()):
            n = sizes[names[k]]
            epoch, t = divmod(used[k], n)
            used[k] += 1
            i = int(mixing.permute(np.array([t]), n, (seed * 1009 + k) * 65537 + epoch)[0])
            words = blocks[names[k]][i]
            out.append((shard, slot, names[k] or None, i, epoch, len(words), tuple(dict.fromkeys(d for d, _, _ in words)), words[0][1], " ".join(w for _, _, w in words)))
    return out


def plain(df):
    return sorted(((*r[:6], tuple(dict.fromkeys(r.doc_ids)), r.lang, " ".join(r.text.split())) for r in df.collect()), key=lambda r: r[:2])


def test_against_a_plain_version(spark):
    g = np.random.default_rng(1)
    rows = [(i, " ".join(f"w{j}" for j in g.integers(0, 99, g.integers(1, 40))), "en", ["hot", "hot", "hot", "b", "c", None][i % 6]) for i in range(150)]
    rows += [(7, "a second row of seven", "de", "hot"), (7, "a second row of seven", "de", "hot")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    how = {"block": 16, "slots_per_shard": 32}
    assert plain(mixing.mix(docs, **how)) == brute(rows, None, None, 16, 32, mixing.SEED)
    w = {"hot": 0.2, "b": 0.8, "c": 0.0}
    got = mixing.mix(docs, weights=w, slots=500, **how)
    assert plain(got) == brute(rows, w, 500, 16, 32, mixing.SEED)
    share = got.where("source = 'b'").count() / 500
    assert share == pytest.approx(0.8, abs=0.07)


def test_many_chunks_against_a_plain_version(spark):
    g = np.random.default_rng(2)
    rows = [(i * 7919 - 300, " ".join(f"w{j}" for j in g.integers(0, 99, g.integers(1, 40))) + f" {i}", "en", ["hot", "hot", "b"][i % 3]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    want = brute(rows, None, None, 16, 32, mixing.SEED, 300, places(spark, rows))
    assert plain(mixing.mix(docs, block=16, slots_per_shard=32, chunk_tokens=300)) == want


def test_small_sources_may_be_drawn_many_times(spark):
    rows = [(i, f"word {i} " * 20, "en", "small" if i < 2 else "large") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    w = {"small": 0.9, "large": 0.1}
    got = plain(mixing.mix(docs, weights=w, slots=900, block=16, slots_per_shard=64))
    assert got == brute(rows, w, 900, 16, 64, mixing.SEED)
    assert max(r[4] for r in got) > 3 * mixing.EPOCHS


def test_ids_do_not_change_the_number_of_blocks(spark):
    """Dense, sparse, hashed and repeated ids, and rows that are repeated in full."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    ids = {"dense": F.col("doc_id"), "sparse": F.col("doc_id") * 1000003, "hashed": F.xxhash64("doc_id"), "one": F.lit(5).cast("long")}
    m = {k: mixing.mix(docs.withColumn("doc_id", c), exponent=1.0, chunk_tokens=1 << 14).groupBy("source").agg(F.countDistinct("block").alias("n")).agg(F.sum("n")).first()[0] for k, c in ids.items()}
    assert all(abs(x - m["dense"]) <= 0.015 * m["dense"] for x in m.values()), m


def test_repeated_rows_are_spread_over_chunks(spark):
    docs = spark.createDataFrame([(1, "the same row " * 10, "en", "a")] * 400, "doc_id long, text string, lang string, source string").coalesce(2)
    got = mixing.mix(docs, weights={"a": 1.0}, slots=400, block=64, chunk_tokens=1000).collect()
    assert sum(r.n_tokens for r in got if r.epoch == 0) == 400 * 30
    assert len({r.block for r in got}) >= 400 * 30 / 64


def test_sums_before(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SPAN", 4)
    df = spark.createDataFrame([(i % 2, i, i + 1) for i in range(40)], "k int, place long, c long")
    for r in mixing.sums_before(df, "k", "place", "c").collect():
        assert r.before == sum(i + 1 for i in range(r.place) if i % 2 == r.k)


def test_shares_of_draws_are_multinomial():
    p = np.array([0.5, 0.0, 0.3, 0.2])
    c = np.array([np.bincount(mixing.shard_draws(s, 1000, p, 3), minlength=4) for s in range(300)])
    assert (c[:, 1] == 0).all()
    assert np.allclose(c.mean(axis=0), 1000 * p, atol=5)
    assert np.allclose(c.var(axis=0)[[0, 2, 3]], 1000 * (p * (1 - p))[[0, 2, 3]], rtol=0.3)


def test_query_against_a_plain_version(spark):
    from lexgrove.llm.queries import op10_source_mixing

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    got = plain(op10_source_mixing(spark, sf))
    assert got == brute(rows, None, None, mixing.BLOCK, mixing.SLOTS_PER_SHARD, mixing.SEED)
    assert {d for r in got for d in r[6]} == {r[0] for r in rows if r[1].split()}  # every document is there


ROWS = [
    (1, "one two three", "en", "a"),
    (1, "one two three", "en", "a"),
    (2, None, "en", "a"),
    (3, "", "en", "b"),
    (None, "no id", "en", "b"),
    (4, "four", None, None),
    (5, "w " * 100_000, "en", "b"),
    (-9, "a negative id", "en", "a"),
    (2**60 + 1, "a huge id", "en", "a"),
]


@pytest.mark.parametrize("rows", [ROWS, [], ROWS[2:5]])
def test_edge_cases(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").select(
        "*", F.lit(0).cast("long").alias("n_chars"), *[F.lit("z").alias(c) for c in ("chunk", "n", "m", "block", "shard", "slot", "local", "u", "h", "k", "copies")]
    )
    got = mixing.mix(docs).collect()
    if len(rows) < 9:
        assert got == []
        return
    assert {d for r in got for d in r.doc_ids} == {1, 4, 5, -9, 2**60 + 1}
    assert {r.source for r in got} == {"a", "b", None}
    assert all(r.n_tokens == len(r.text.split()) <= mixing.BLOCK for r in got)
    as_docs = mixing.mixed_documents(docs)
    assert as_docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = [r.doc_id for r in as_docs.collect()]
    assert sorted(ids) == list(range(len(got)))


def test_partitions_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert plain(mixing.mix(docs.repartition(7))) == plain(mixing.mix(docs.coalesce(1)))
