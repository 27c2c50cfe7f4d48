"""Spherical-cap filters: list decoding against the full code, recall against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexgrove.llm import embedding_dedup as E


def all_pairs(ids, v, limit):
    u, ok = E.unit(v)
    sims = np.where(ok[:, None] & ok[None], u @ u.T, -1)
    x, y = np.nonzero(np.triu(sims >= limit, 1))
    root = {i: i for i in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    pairs = [(ids[a], ids[b]) for a, b in zip(x, y, strict=True)]
    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for p in pairs for i in p}, pairs


def test_list_decoding_lists_all_filters_above_the_height():
    g = np.random.default_rng(2)
    v, _ = E.unit(g.normal(size=(20, 17)))
    books = E.codebooks(17, 6)
    row, code = E.list_decode(v, books, 0.3)
    full = np.array([np.concatenate([books[0][a], books[1][b], books[2][c]]) for a in range(6) for b in range(6) for c in range(6)])
    assert np.allclose(np.linalg.norm(full, axis=1), 1, atol=1e-5)
    x, y = np.nonzero(v @ full.T >= 0.3)
    assert sorted(zip(row.tolist(), code.tolist(), strict=True)) == sorted(zip(x.tolist(), y.tolist(), strict=True))


def test_cap_height():
    g = np.random.default_rng(4)
    u, _ = E.unit(g.normal(size=(200_000, 16)))
    assert (u[:, 0] >= E.cap_height(16, 0.02)).mean() == pytest.approx(0.02, rel=0.1)


def test_recall_at_the_limit_among_random_vectors(spark):
    """Pairs at cosine 0.9 to 1, the hardest ones there are."""
    g = np.random.default_rng(8)
    base = g.normal(size=(2500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = g.normal(size=(1200, 64))
    noise -= (noise * base[:1200]).sum(axis=1, keepdims=True) * base[:1200]
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    cos = g.uniform(0.9005, 1, (1200, 1))
    v = np.concatenate([base, cos * base[:1200] + np.sqrt(1 - cos**2) * noise]).astype(np.float32)
    ids = list(range(len(v)))
    _, pairs = all_pairs(ids, v, E.MIN_COSINE)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.group_id for r in E.groups(df).collect()}
    assert len(pairs) >= 1200
    assert np.mean([got.get(a, -1) == got.get(b, -2) for a, b in pairs]) >= 0.9


def planted(rows, seed):
    """The rows of a table, and for every third of them another one at a cosine of 0.9 to 1, some exact, some of another length."""
    g = np.random.default_rng(seed)
    out = [(r.vec_id, list(r.embedding)) for r in rows]
    for i, r in enumerate(rows[::3]):
        a = np.array(r.embedding, float)
        z = g.normal(size=len(a))
        z -= z @ a / (a @ a) * a
        c = 1.0 if i % 10 == 0 else g.uniform(0.9005, 1)
        b = c * a / np.linalg.norm(a) + np.sqrt(1 - c * c) * z / np.linalg.norm(z)
        out.append((10**6 + i, (a if i % 20 == 0 else b * g.uniform(0.5, 3)).astype(np.float32).tolist()))
    return out


def test_query_against_all_pairs_of_a_whole_table_with_planted_pairs(spark, tmp_path):
    from lexgrove.llm.queries import op6_embedding_cap_filters

    rows = planted(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect(), 3)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    want, pairs = all_pairs([r[0] for r in rows], np.array([r[1] for r in rows]), E.MIN_COSINE)
    assert len(pairs) >= 650
    got = op6_embedding_cap_filters(spark, str(tmp_path)).collect()
    group = {r.vec_id: r.group_id for r in got}
    assert len(group) == len(got)
    assert set(group) <= set(want)
    assert np.mean([group.get(a, -1) == group.get(b, -2) for a, b in pairs]) >= 0.95
    sizes = {}
    for r in got:
        assert r.kept == (r.vec_id == r.group_id)
        sizes.setdefault(r.group_id, []).append(r.group_size)
    assert all(set(s) == {len(s)} for s in sizes.values())


def test_partners_by_signature_against_all_pairs():
    g = np.random.default_rng(5)
    base = g.normal(size=(300, 32))
    v, _ = E.unit(np.concatenate([base, base[:150] + 0.2 * g.normal(size=(150, 32)), base[:1] + 0.05 * g.normal(size=(400, 32))]))
    sig = E.signatures(v, g.standard_normal((32, E.SIGN_BITS)).astype(np.float32))
    for most in (10, 30, E.widest(0.9)):
        d = np.bitwise_count(sig[:, None] ^ sig[None]).sum(axis=2).astype(int)
        np.fill_diagonal(d, 999)
        assert (E.partnered(sig, most) == (d <= most).any(axis=1)).all()


def test_signatures_hardly_ever_part_a_pair_at_the_limit():
    a, b = E.pairs_at(0.9, 20_000, 64, 1)
    planes = np.random.default_rng(1).standard_normal((64, E.SIGN_BITS)).astype(np.float32)
    d = np.bitwise_count(E.signatures(a.astype(np.float32), planes) ^ E.signatures(b, planes)).sum(axis=1)
    assert (d > E.widest(0.9)).mean() < 0.001


def test_many_survivors_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(E, "FEW", 1)
    g = np.random.default_rng(6)
    v = g.normal(size=(40, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(np.concatenate([v, v * 2]))], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.group_id for r in E.groups(df).collect()}
    assert all(got[i] == got[i + 40] for i in range(40))


A, B = [1.0, 0.0, 0.0, 0.5], [0.0, 1.0, -1.0, 0.0]
ROWS = [
    (4, A),
    (2, A),
    (2, A),
    (9, [2.0, 0.0, 0.0, 1.0]),  # the same direction
    (None, A),
    (5, None),
    (6, []),
    (7, [0.0] * 4),
    (8, [1.0, None, 0.0, 0.0]),
    (10, [float("nan"), 0.0, 0.0, 0.0]),
    (11, [float("inf"), 0.0, 0.0, 0.0]),
    (12, B),
    (13, [1.0, 0.0]),
    (14, [1.0, 0.001]),
    (15, [3.0]),
    (16, [2.0]),
    (17, [-2.0]),
]


def test_edge_cases(spark):
    df = spark.createDataFrame(ROWS, "vec_id long, embedding array<float>").select("*", *[F.lit(1).alias(c) for c in ("id", "v", "f", "rep", "label", "d", "code", "x")])
    got = {r.vec_id: (r.group_id, r.group_size, r.kept) for r in E.groups(df).collect()}
    assert got == {
        2: (2, 3, True), 4: (2, 3, False), 9: (2, 3, False), 13: (13, 2, True), 14: (13, 2, False), 15: (15, 2, True), 16: (15, 2, False)
    }


def test_empty_table(spark):
    assert E.groups(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
