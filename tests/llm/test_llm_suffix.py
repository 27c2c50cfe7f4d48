"""Suffix arrays and repeats against naive versions."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexgrove.llm import suffix_dedup


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60))
def test_suffix_array_and_prefixes(symbols):
    s = np.array([*symbols, 0])
    sa = suffix_dedup.suffix_array(s)
    assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    lcp = suffix_dedup.common_prefixes(s, sa)
    for i in range(1, len(s)):
        a, b = s[sa[i - 1] :], s[sa[i] :]
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert lcp[i] == n


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=30), st.lists(st.integers(0, 20), max_size=30))
def test_merge(a, b):
    a, b = np.sort(np.array(a, np.uint64)), np.sort(np.array(b, np.uint64))
    got = suffix_dedup.merge((a, np.zeros(len(a))), (b, np.ones(len(b))))
    assert got[0].tolist() == sorted([*a.tolist(), *b.tolist()])
    assert got[1].sum() == len(b)


def brute(rows, k):
    """Stretches by comparing every window of k words with all windows of documents with a smaller id."""
    first = {}
    for d, text in rows:
        if d is not None and text:
            w = text.split()
            for p in range(len(w) - k + 1):
                key = tuple(w[p : p + k])
                first[key] = min(first.get(key, d), d)
    out = set()
    hit = {}
    for d, text in rows:
        if d is not None and text:
            w = text.split()
            hit.setdefault(d, set()).update(p for p in range(len(w) - k + 1) if first[tuple(w[p : p + k])] < d)
    for d, at in hit.items():
        cover = sorted({x for p in at for x in range(p, p + k)})
        runs = []
        # windows that touch or overlap are one stretch
        for p in sorted(at):
            if runs and p <= runs[-1][1]:
                runs[-1][1] = p + k
            else:
                runs.append([p, p + k])
        assert sum(b - a for a, b in runs) == len(cover)
        out |= {(d, a, b) for a, b in runs}
    return out


def random_rows(seed, n):
    g = np.random.default_rng(seed)
    shared = [" ".join(g.choice(list("abcdefgh"), 9)) for _ in range(5)]
    rows = []
    for i in range(n):
        parts = [" ".join(g.choice([f"u{j}" for j in range(500)], g.integers(0, 12))) for _ in range(3)]
        parts.insert(int(g.integers(0, 4)), shared[int(g.integers(0, 5))] if g.random() < 0.5 else "")
        rows.append((int(i), " ".join(parts)))
    return rows


@pytest.mark.parametrize("shard_words", [20, 200, 1 << 20])
def test_repeats_against_brute_force(spark, shard_words):
    rows = random_rows(3, 120)
    rows += [(200, rows[4][1]), (201, rows[4][1]), (4, rows[4][1]), (300, "a b a b a b a b a b a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {tuple(r) for r in suffix_dedup.repeats(docs, min_words=6, shard_words=shard_words).collect()}
    assert got == brute(rows, 6)
    assert got


def test_query_against_brute_force_on_a_whole_table(spark):
    from lexgrove.llm.queries import op8_suffix_array_repeats

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    # words are split at ASCII white space; the table has no other white space
    assert {tuple(r) for r in op8_suffix_array_repeats(spark, sf).collect()} == brute(rows, suffix_dedup.MIN_WORDS)


def test_words_decide_where_hashes_agree(tmp_path):
    """Candidates across shards, right and wrong ones, against comparing words."""
    g = np.random.default_rng(6)
    files, words = [], []
    for i in range(3):
        words.append(g.integers(0, 3, 400).astype(np.uint64) << np.uint64(60))
        files.append(str(tmp_path / f"s{i}"))
        suffix_dedup._Shard.write(files[-1], np.array([5, 9]), np.array([1, 2]), np.array([0, 200]), words[-1])
    words[1][100:150] = words[0][20:70]
    suffix_dedup._Shard.write(files[1], np.array([5, 9]), np.array([1, 2]), np.array([0, 200]), words[1])
    tok = np.concatenate([np.arange(20, 66), g.integers(0, 390, 500)])
    other, at = np.concatenate([np.full(46, 0), g.integers(0, 2, 500)]), np.concatenate([np.arange(100, 146), g.integers(0, 390, 500)])
    mine = suffix_dedup._Shard(files[0])
    assert mine.documents().tolist() == [[5, 9], [1, 2], [0, 200]]
    got = suffix_dedup._same(mine, tok, other, at, files[1:], 4)
    want = [(words[0][t : t + 4] == words[1 + o][a : a + 4]).all() for t, o, a in zip(tok, other, at, strict=True)]
    assert got.tolist() == want and sum(want) > 46 > len(want) - sum(want) - 500


def test_equal_windows():
    a = np.array([1, 2, 3, 4, 5, 6])
    assert suffix_dedup.equal_windows(a, np.array([1, 2, 9, 4, 5, 6]), 2).tolist() == [True, False, False, True, True]
    assert suffix_dedup.equal_windows(a[:2], a[:2], 2).tolist() == [True]


LONG = " ".join(f"p{i}" for i in range(60))
ROWS = [
    (1, "start " + LONG + " end", "a"),
    (2, "other words " + LONG + "  and a tail\nwith a line", "b"),
    (2, None, "c"),
    (None, LONG, "d"),
    (3, LONG, None),
    (4, None, "e"),
    (5, "", "f"),
    (6, "x " * 120_000, "g"),
    (7, "x " * 100, "h"),
    (8, LONG + " " + LONG + " tail", "i"),
    (8, "a text without any of it " * 9, "j"),  # its id has a repeat, it hasn't
    (9, "你" + "好世界" * 30, "k"),
    (10, "再" + "好世界" * 30, "l"),
]


def test_edge_cases(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").select(
        "*", F.length("text").cast("long").alias("n_chars"), *[F.lit("z").alias(c) for c in ("part", "kind", "blob", "cuts", "start_word", "cut_from", "cut_id", "_cut_id", "cut_hash", "file", "h")]
    )
    got = {(r.doc_id, r.start_word, r.end_word) for r in suffix_dedup.repeats(docs).collect()}
    assert {(2, 2, 62), (3, 0, 60), (7, 0, 100)} <= got
    assert not any(d in (1, 4, 5, 6, 9, None) for d, _, _ in got)
    out = suffix_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    by = {r.lang: r for r in rows}
    assert by["a"].text == ROWS[0][1]
    assert by["b"].text == "other words and a tail\nwith a line"
    assert by["b"].n_chars == len(by["b"].text)
    assert by["c"].text is None and by["e"].text is None and by["f"].text == "" and by["d"].text == LONG  # rows without a stretch stay
    assert None not in by and "h" not in by  # nothing was left of documents 3 and 7
    assert by["i"].text == "tail"
    assert by["a"].blob == "z"
    assert by["j"].text == ROWS[10][1]
    assert by["k"].text == ROWS[11][1] and by["l"].text == "再"


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.repeats(docs).collect() == []
    assert suffix_dedup.without_repeats(docs).collect() == []
