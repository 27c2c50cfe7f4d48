"""SimHash groups against all pairs; oversized buckets; edge cases."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexgrove.llm import simhash
from lexgrove.llm.components import components
from lexgrove.llm.textbuf import texts_of


def near_components(ids, f, limit):
    """Components of all pairs within limit, as {id: smallest id}, and the pairs."""
    d = np.bitwise_count(f[:, None, :] ^ f[None]).sum(axis=2, dtype=np.int64)
    x, y = np.nonzero(np.triu(d <= limit, 1))
    root = {i: i for i in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    pairs = [(ids[a], ids[b]) for a, b in zip(x, y, strict=True) if ids[a] != ids[b]]
    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for p in pairs for i in p}, pairs


def flipped(g, base, most):
    """A fingerprint with up to `most` bits of base flipped."""
    out = base.copy()
    for b in g.choice(simhash.BITS, g.integers(0, most + 1), replace=False):
        out[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    return out


def test_a_fingerprint_is_the_majority_of_the_bits_of_the_distinct_words():
    f, size = simhash.text_fingerprints(texts_of(pa.array(["a b c", "C  b\na A a", "a", None, "", "other words here"])))
    assert size.tolist() == [3, 3, 1, 0, 0, 3]
    assert (f[0] == f[1]).all()  # a set of lower-case words
    assert simhash.distance(f[0], f[5]) > 60


def test_near_texts_are_near():
    words = [f"word{i}" for i in range(400)]
    a, b, c = " ".join(words), " ".join(words[:380] + ["x"] * 3), " ".join(f"other{i}" for i in range(400))
    f, _ = simhash.text_fingerprints(texts_of(pa.array([a, b, c])))
    assert simhash.distance(f[0], f[1]) <= simhash.MAX_DISTANCE < simhash.distance(f[0], f[2])


@pytest.mark.parametrize("cap", [32, 4096])
def test_oversized_buckets_keep_their_pairs(cap):
    g = np.random.default_rng(5)
    base = g.integers(0, 1 << 63, (12, 4), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    f = np.array([flipped(g, base[i % 12], 12) for i in range(600)] + list(g.integers(0, 1 << 63, (400, 4), dtype=np.uint64)))
    ids = np.arange(len(f))
    want, _ = near_components(ids.tolist(), f, simhash.MAX_DISTANCE)
    a, b = simhash.bucket_pairs(np.zeros(len(f), np.uint64), ids, f, simhash.MAX_DISTANCE, cap=cap)
    assert (simhash.distance(f[a], f[b]) <= 2 * simhash.MAX_DISTANCE).all()
    root = {i: i for i in ids.tolist()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = sorted((find(x), find(y)))
        root[y] = x
    got = {i: find(i) for i in want}
    assert np.mean([got[i] == want[i] for i in want]) >= 0.98
    assert all(find(i) == i for i in ids.tolist() if i not in want)


def test_a_huge_bucket_of_near_copies_ends_soon():
    g = np.random.default_rng(6)
    base = g.integers(0, 1 << 63, 4, dtype=np.uint64)
    f = np.array([flipped(g, base, 8) for _ in range(20_000)])
    f = np.unique(f, axis=0)
    ids = np.arange(len(f))
    a, b = simhash.bucket_pairs(np.zeros(len(f), np.uint64), ids, f, simhash.MAX_DISTANCE)
    assert len(set(a.tolist()) | set(b.tolist())) == len(f)
    assert len(a) < 4 * len(f)  # edges stay linear


def test_recall_of_the_search_against_all_pairs(spark):
    """Pairs at every distance up to the limit, among unrelated rows."""
    g = np.random.default_rng(7)
    base = g.integers(0, 1 << 63, (1500, 4), dtype=np.uint64)
    f = np.concatenate([base, np.array([flipped(g, b, 60) for b in base[:700]])])
    ids = list(range(len(f)))
    prints = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in zip(ids, f, strict=True)], "uid long, f binary")
    want, pairs = near_components(ids, f, simhash.MAX_DISTANCE)
    got = {r.node: r.group for r in components(simhash.near_edges(prints)).collect()}
    assert np.mean([a in got and b in got and got[a] == got[b] for a, b in pairs]) >= 0.9
    assert set(got) <= set(want)


@pytest.mark.parametrize("n", [1, 300, 8_300, 41_500, 250_000, 10**6, 15 * 10**6, 10**9])
def test_tables_are_planned_for_every_accepted_distance(n):
    bits, tables = simhash.plan_tables(n)
    for apart in range(simhash.MAX_DISTANCE + 1):
        meet = math.comb(simhash.BITS - apart, bits) / math.comb(simhash.BITS, bits)  # drawn without replacement
        assert 1 - (1 - meet) ** tables >= 0.9


def test_pairs_at_the_accept_distance_meet_in_a_table():
    g = np.random.default_rng(8)
    a = g.integers(0, 1 << 63, (2000, 4), dtype=np.uint64)
    flips = np.argsort(g.random((len(a), simhash.BITS)), axis=1) < simhash.MAX_DISTANCE
    b = a ^ np.packbits(flips, axis=1).view(">u8").astype(np.uint64)
    assert (simhash.distance(a, b) == simhash.MAX_DISTANCE).all()
    bits, tables = simhash.plan_tables(10**6)
    met = np.zeros(len(a), bool)
    for t in range(tables):
        met |= simhash.sampled_keys(a, t, bits, 11) == simhash.sampled_keys(b, t, bits, 11)
    assert met.mean() >= 0.9


@pytest.mark.parametrize("groups_of", [64, 1 << 17])
def test_hot_buckets_are_spread_without_loss(spark, monkeypatch, groups_of):
    """A third of all rows are near copies of one text; others are a little farther from it, linked by copies alone."""
    monkeypatch.setattr(simhash, "HOT", groups_of)
    monkeypatch.setattr(simhash, "SAMPLED", 2)
    g = np.random.default_rng(9)
    base = g.integers(0, 1 << 63, (1400, 4), dtype=np.uint64)
    copies = np.unique(np.array([flipped(g, base[0], 10) for _ in range(700)]), axis=0)
    shell = np.array([flipped(g, base[0], 60) for _ in range(60)])
    f = np.concatenate([base, copies, shell])
    ids = list(range(len(f)))
    prints = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in zip(ids, f, strict=True)], "uid long, f binary").repartition(3)
    if groups_of == 64:
        bits, tables = simhash.plan_tables(len(f))
        monkeypatch.setattr(simhash, "plan_tables", lambda *_, **__: (bits, tables))
        hot = simhash.hot_buckets(prints, 1 << 20 >> 9, bits, tables, simhash.MAX_DISTANCE, 11)
        assert hot and max(h.groups.max() for h in hot.values()) > 1
    want, pairs = near_components(ids, f, simhash.MAX_DISTANCE)
    got = {r.node: r.group for r in components(simhash.near_edges(prints)).collect()}
    assert set(got) <= set(want)
    assert np.mean([a in got and b in got and got[a] == got[b] for a, b in pairs]) >= 0.99


def test_a_pair_of_a_hot_bucket_meets_or_is_linked_through_the_pivot():
    g = np.random.default_rng(10)
    pivot = g.integers(0, 1 << 63, 4, dtype=np.uint64)
    f = np.array([pivot, *[flipped(g, pivot, 70) for _ in range(300)]])
    hot = simhash.Hot(np.array([7]), pivot[None], np.array([5]))
    row, group = hot.spread(np.full(len(f), 7), f, np.arange(len(f)), 50)
    of = [set(group[row == i].tolist()) for i in range(len(f))]
    core = simhash.distance(f, pivot) <= 25
    assert of[0] == set(range(5))
    for i in range(len(f)):
        assert of[i] and of[i] <= set(range(5))
        for j in range(i):
            assert of[i] & of[j] or (core[i] and core[j])
    assert hot.spread(np.full(3, 8), f[:3], np.arange(3), 50)[1].tolist() == [0, 0, 0]


def test_query_against_all_pairs_of_the_table(spark):
    from lexgrove.llm.queries import op7_simhash_bit_sampling

    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    f, size = simhash.text_fingerprints(texts_of(pa.array([r.text for r in rows])))
    ok = size > 0
    want, pairs = near_components([r.doc_id for r, o in zip(rows, ok, strict=True) if o], f[ok], simhash.MAX_DISTANCE)
    got = op7_simhash_bit_sampling(spark, sf).collect()
    group = {r.doc_id: r.group_id for r in got}
    assert len(group) == len(got)
    assert np.mean([a in group and b in group and group[a] == group[b] for a, b in pairs]) >= 0.9
    assert set(group) <= set(want)
    sizes = {}
    for r in got:
        assert r.kept == (r.doc_id == r.group_id)
        assert r.group_id <= r.doc_id
        sizes.setdefault(r.group_id, []).append(r.group_size)
    assert all(set(s) == {len(s)} for s in sizes.values())


ROWS = [
    (5, "the same short text"),
    (3, "the same short text"),
    (3, "the same short text"),
    (9, "The SAME short   text"),
    (None, "the same short text"),
    (1, None),
    (2, ""),
    (4, " \n "),
    (6, "w " * 100_000 + "end"),
    (7, "w " * 90_000 + "end"),
    (8, "nothing like any of the others at all, really"),
    (9, "a text of its own, though its id has another one too"),
]


def test_edge_cases(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").select("*", *[F.lit("z").alias(c) for c in ("f", "h", "uid", "first", "docs", "group", "node", "n")])
    got = {r.doc_id: (r.group_id, r.group_size, r.kept) for r in simhash.groups(docs).collect()}
    assert got == {3: (3, 3, True), 5: (3, 3, False), 9: (3, 3, False), 6: (6, 2, True), 7: (6, 2, False)}


def test_empty_table(spark):
    assert simhash.groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(1, 1), (None, 3), (5, 4), (4, 5)]
    got = {r.node: r.group for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 7: 7, **{i: 7 for i in range(200, 260)}, 4: 4, 5: 4}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
