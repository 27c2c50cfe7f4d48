"""Packing against every possible choice of cuts, and as an exact round trip of words."""

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexgrove.llm import packing
from lexgrove.llm.textbuf import texts_of


def cost(units, kinds, ends, window, penalty):
    total, at = 0, 0
    for i, end in enumerate(ends):
        used = sum(units[at:end])
        if used > window:
            return None
        if i < len(ends) - 1:
            total += window - used + penalty[kinds[end - 1]]
        at = end
    return total


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 6), st.integers(0, 2)), min_size=1, max_size=9), st.integers(6, 12))
def test_cuts_are_the_cheapest_of_all(units, window):
    lengths, kinds = [u for u, _ in units], [k for _, k in units]
    n, penalty = len(units), (0, 2, 5)
    ends, best = packing.cuts(lengths, kinds, window, penalty)
    costs = []
    for mask in range(1 << (n - 1)):
        c = cost(lengths, kinds, [i + 1 for i in range(n - 1) if mask >> i & 1] + [n], window, penalty)
        if c is not None:
            costs.append(c)
    assert best == min(costs) == cost(lengths, kinds, ends, window, penalty)


def test_sentences():
    n, per = packing.sentence_lengths(texts_of(pa.array(["a b. c d! e", None, "", "x\ny z"])))
    assert n.tolist() == [2, 2, 1, 1, 2]
    assert per.tolist() == [3, 0, 0, 2]


def test_long_sentences_are_split_evenly():
    import numpy as np

    units, kinds, docs = packing.split_units(np.array([20, 3]), np.array([2]), 64)
    assert units == [6, 7, 7, 3]
    assert kinds == [2, 2, 1, 0]
    assert docs == [0, 0, 0, 0]


ROWS = [
    (3, "Cc dd. " * 40),
    (1, "one two three. four five"),
    (1, "one two three. four five"),
    (2, ""),
    (4, None),
    (None, "no id here."),
    (5, "w " * 70_000),
    (2000, "another run."),
    (-7, "a negative id."),
]


def check_round_trip(rows, got, window, per_run):
    """Every word of every document with an id is in exactly one window, in order; nothing is larger than a window."""
    want = {}
    for d, text in rows:
        if d is not None and text and text.split():
            want.setdefault(d, []).append(len(text.split()))
    parts, before = {}, 0
    for r in sorted(got, key=lambda r: (r.run, r.window)):
        assert r.n_tokens + r.padding == window
        assert r.n_tokens == sum(e - s for s, e in zip(r.starts, r.ends, strict=True))
        assert list(r.doc_ids) == sorted(r.doc_ids)
        if r.window == 0:  # a run starts with the first document that starts in it
            assert r.run == before // (window * per_run)
        before += r.n_tokens
        for d, s, e in zip(r.doc_ids, r.starts, r.ends, strict=True):
            parts.setdefault(d, []).append((s, e))
    assert list(parts) == sorted(want)
    for d, spans in parts.items():
        ends = []
        for s, e in spans:  # a row's parts follow one another; the next row with the same id starts at 0 again
            assert e > s
            if s == 0:
                ends.append(0)
            assert s == ends[-1]
            ends[-1] = e
        assert ends == sorted(want[d])


@pytest.mark.parametrize("rows", [ROWS, []])
def test_round_trip_and_edge_cases(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in ("run", "lengths", "window", "doc_ids", "n", "tie", "part", "at")])
    got = packing.pack(docs, window=64, windows_per_run=4).collect()
    check_round_trip(rows, got, 64, 4)


def test_query_on_a_whole_table_is_optimal_in_each_run(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    from lexgrove.llm.queries import op4_packing_dp

    got = op4_packing_dp(spark, sf).collect()
    check_round_trip(rows, got, packing.WINDOW, packing.WINDOWS_PER_RUN)
    # the same cost as a quadratic dynamic program over the same units
    text = [t for _, t in sorted(r for r in rows if r[1])]
    units, kinds, _ = packing.split_units(*packing.sentence_lengths(texts_of(pa.array(text))), packing.WINDOW)
    best = [0.0] + [float("inf")] * len(units)
    total = [0]
    for u in units:
        total.append(total[-1] + u)
    for j in range(1, len(units) + 1):
        i = j - 1
        while i >= 0 and total[j] - total[i] <= packing.WINDOW:
            own = 0 if j == len(units) else packing.WINDOW - (total[j] - total[i]) + packing.PENALTY[kinds[j - 1]]
            best[j] = min(best[j], best[i] + own)
            i -= 1
    got.sort(key=lambda r: r.window)
    assert sum(r.padding + packing.PENALTY[r.cut] for r in got[:-1]) == best[-1]


def test_partitions_do_not_matter(spark):
    rows = [(i // 3, f"Doc {i % 90} has some words. " * (i % 7 + 1)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a = packing.pack(docs.repartition(5), window=50, windows_per_run=8).collect()
    b = packing.pack(docs.coalesce(1), window=50, windows_per_run=8).collect()
    assert sorted(a) == sorted(b)


def test_ids_do_not_change_the_number_of_windows(spark):
    """Dense, sparse, hashed, repeated and equal ids."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    ids = {"dense": F.col("doc_id"), "sparse": F.col("doc_id") * 1000003, "hashed": F.xxhash64("doc_id"), "pairs": F.floor(F.col("doc_id") / 2), "one": F.lit(1)}
    n = {k: packing.pack(docs.withColumn("doc_id", c)).count() for k, c in ids.items()}
    assert all(abs(x - n["dense"]) <= 0.01 * n["dense"] for x in n.values()), n


def test_equal_costs_take_the_earliest_start():
    # any of three places could end the first of two windows at the same cost
    assert packing.cuts([2, 2, 2, 2], [0, 0, 0, 0], 6, (0, 0, 0))[0] in ([3, 4],)
    assert packing.cuts([3, 3, 3], [1, 1, 1], 6, (0, 1, 2)) == ([2, 3], 1)
