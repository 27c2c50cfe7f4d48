"""CRF recursions against enumeration; the two line-labelling operators on edge cases and held-out labels."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexgrove.llm import quality_classifier, quality_rules
from lexgrove.llm.crf import Crf, fit, marginals, viterbi
from lexgrove.llm.linefeatures import WIDTH, line_features, with_neighbours
from lexgrove.llm.textbuf import texts_of

SF = "/root/testdata/sf0.01"


def path_score(s, y, trans, start):
    return start[y[0]] + sum(s[t, y[t]] for t in range(len(y))) + sum(trans[y[t - 1], y[t]] for t in range(1, len(y)))


@pytest.fixture
def chain():
    g = np.random.default_rng(3)
    lengths = np.array([3, 0, 5, 1, 4])
    return g.normal(size=(lengths.sum(), 2)), lengths, g.normal(size=(2, 2)), g.normal(size=2)


def test_viterbi_is_the_best_of_all_paths(chain):
    s, lengths, trans, start = chain
    got, at = viterbi(s, lengths, trans, start), 0
    for n in lengths:
        if n:
            best = max(itertools.product((0, 1), repeat=int(n)), key=lambda y: path_score(s[at : at + n], y, trans, start))
            assert tuple(got[at : at + n]) == best
        at += n


def test_marginals_are_sums_over_all_paths(chain):
    s, lengths, trans, start = chain
    p, pair, log_z = marginals(s, lengths, trans, start)
    want_pair, want_z, at = np.zeros((2, 2)), 0.0, 0
    for n in lengths:
        if n:
            paths = list(itertools.product((0, 1), repeat=int(n)))
            w = np.exp([path_score(s[at : at + n], y, trans, start) for y in paths])
            want_z += np.log(w.sum())
            for t in range(n):
                one = sum(x for x, y in zip(w, paths, strict=True) if y[t] == 1) / w.sum()
                assert p[at + t, 1] == pytest.approx(one)
            for x, y in zip(w / w.sum(), paths, strict=True):
                for t in range(1, n):
                    want_pair[y[t - 1], y[t]] += x
        at += n
    assert np.allclose(pair, want_pair)
    assert log_z == pytest.approx(want_z)


def test_viterbi_ties_take_lower_labels():
    assert viterbi(np.zeros((4, 2)), np.array([4]), np.zeros((2, 2)), np.zeros(2)).tolist() == [0, 0, 0, 0]


def test_fit_separates_and_survives_no_rows():
    g = np.random.default_rng(1)
    y = np.repeat([0, 1, 0, 1], 25)
    x = np.stack([np.ones(100), y + g.normal(0, 0.3, 100)], axis=1)
    m = fit(x, np.array([50, 50]), y)
    assert (viterbi(m.scores(x), np.array([50, 50]), m.trans, m.start) == y).mean() > 0.95
    assert not fit(np.zeros((0, 3)), np.zeros(0, int), np.zeros(0, int)).emit.any()


def test_neighbours_stop_at_documents():
    x = np.arange(8.0).reshape(4, 2)
    got = with_neighbours(x, np.array([1, 0, 3]))
    assert got[:, 2].tolist() == [0, 0, 3, 5]  # before, without the bias column
    assert got[:, 3].tolist() == [0, 5, 7, 0]


def test_features_of_lines():
    t = texts_of(pa.array(["AB cd.\n\n  \nAB cd.\na a a a", None, "", "ÉÉ 12!!"]))
    x, chars, count = line_features(t)
    assert count.tolist() == [3, 0, 0, 1]
    assert chars.tolist() == [6, 6, 7, 7]
    assert x.shape == (4, WIDTH)
    assert x[:, 7].tolist() == [0, 1, 0, 0]  # the second line repeats the first
    assert x[2, 6] == 0.75  # three of four words repeat the one before
    assert x[3, 1] == 1.0  # an accented capital is a capital


ODD = [
    (1, "A good line.\nAnother one here."),
    (1, "A good line.\nAnother one here."),
    (None, "Some text without an id."),
    (2, None),
    (3, ""),
    (4, " \n\t\n"),
    (5, "word " * 60_000),
    (6, "x\n" * 20_000),
]


def docs_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # extra columns with the names of results and helpers
    return df.select("*", *[F.lit("extra").alias(c) for c in ("y", "x", "keep", "n_lines", "quality", "good", "content_share")])


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))


LABELS = [(1, 1, 0), (1, 1, 0), (5, 0, 0), (None, 1, 1), (2, 1, 0), (6, None, None), (99, 0, 1)]


@pytest.mark.parametrize("rows", [ODD, []])
@pytest.mark.parametrize("labels", [LABELS, []])
def test_edge_cases(spark, rows, labels):
    docs, lab = docs_of(spark, rows), labels_of(spark, labels)
    r = quality_rules.apply(docs, quality_rules.train(docs, lab)).collect()
    c = quality_classifier.score(docs, quality_classifier.train(docs, lab)).collect()
    assert len(r) == len(c) == len(rows)
    for x in r:
        if x.doc_id in (2, 3, 4):
            assert (x.n_lines, x.n_content, x.content_share, x.keep) == (0, 0, None, False)
    for x in c:
        if x.doc_id in (2, 3, 4):
            assert (x.n_lines, x.quality, x.good) == (0, None, False)
    if rows:
        assert len({x for x in r if x.doc_id == 1}) == 1  # repeated rows are decided alike
        assert {x.n_lines for x in r if x.doc_id == 6} == {20_000}
        assert sum(x.doc_id is None for x in r) == 1
    kept = quality_rules.apply(docs, quality_rules.train(docs, lab), columns=["doc_id", "text"])
    assert kept.columns == ["doc_id", "text"]
    assert kept.count() == sum(x.keep for x in r)


@pytest.mark.parametrize("labels", [[], [(1, None, None)], [(12345, 1, 0)], [(2, 0, 0), (3, 0, 0), (4, 1, 0)]])
def test_without_usable_labels_every_text_with_lines_is_kept(spark, labels):
    docs = docs_of(spark, ODD)
    for r in quality_rules.apply(docs, quality_rules.train(docs, labels_of(spark, labels))).collect():
        assert r.keep == (r.n_lines > 0) and r.n_content == r.n_lines


def split(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    side = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    return docs, labels.where(side), labels.where(~side)


def test_rules_on_held_out_labels(spark):
    docs, train, test = split(spark)
    got = quality_rules.apply(docs, quality_rules.train(docs, train)).join(test, "doc_id").select("quality", "keep").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert good.keep.mean() > 0.95  # clean documents stay
    assert (~bad.keep).mean() > 0.6


def test_classifier_on_held_out_labels(spark):
    docs, train, test = split(spark)
    got = quality_classifier.score(docs, quality_classifier.train(docs, train)).join(test.select("doc_id", F.col("quality").alias("y")), "doc_id").toPandas()
    assert got[got.y == 1].good.mean() > 0.95
    assert (~got[got.y == 0].good).mean() > 0.6


def test_scores_of_a_query_against_one_document_at_a_time(spark):
    docs, train, _ = split(spark)
    model = quality_classifier.train(docs, train)
    rules = quality_rules.train(docs, train)
    q = {r.doc_id: r.quality for r in quality_classifier.score(docs, model).collect()}
    s = {r.doc_id: r.content_share for r in quality_rules.apply(docs, rules).collect()}
    for r in docs.orderBy("n_chars").take(150):
        x, chars, count = line_features(texts_of(pa.array([r.text])))
        if not len(x):
            assert q[r.doc_id] is None
            continue
        p = marginals(model.scores(with_neighbours(x, count)), count, model.trans, model.start)[0][:, 1]
        assert q[r.doc_id] == pytest.approx((p * chars).sum() / chars.sum())
        y = viterbi(rules.scores(x), count, rules.trans, rules.start)
        assert s[r.doc_id] == pytest.approx((y * chars).sum() / chars.sum())


def test_unfitted_model_is_undecided():
    m = Crf(np.zeros((2, 2)), np.zeros((2, 2)), np.zeros(2), np.zeros(2), np.ones(2))
    p, _, _ = marginals(m.scores(np.ones((3, 2))), np.array([3]), m.trans, m.start)
    assert np.allclose(p, 0.5)


def test_queries_against_one_document_at_a_time(spark):
    """op3 and op5 over all documents of a table, the longest too: labels by enumeration's recursions in plain Python."""
    from lexgrove.llm.queries import op3_quality_rules_crf, op5_quality_classifier_crf

    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rules, classes = quality_rules.train(docs, labels), quality_classifier.train(docs, labels)
    kept = {r.doc_id: r for r in op3_quality_rules_crf(spark, sf).collect()}
    good = {r.doc_id: r for r in op5_quality_classifier_crf(spark, sf).collect()}
    rows = docs.collect()
    assert len(kept) == len(good) == len(rows)
    for r in rows:
        lines = [x for x in r.text.split("\n") if x.strip()]
        assert kept[r.doc_id].n_lines == good[r.doc_id].n_lines == len(lines)
        if not lines:
            assert not kept[r.doc_id].keep and good[r.doc_id].quality is None
            continue
        x, chars, _ = line_features(texts_of(pa.array([r.text])))
        assert chars.tolist() == [len(line) for line in lines]
        s = rules.scores(x)
        best, back = [s[0][y] + rules.start[y] for y in (0, 1)], []
        for t in range(1, len(lines)):
            step = [max((0, 1), key=lambda a, y=y: best[a] + rules.trans[a][y]) for y in (0, 1)]
            best = [best[step[y]] + rules.trans[step[y]][y] + s[t][y] for y in (0, 1)]
            back.append(step)
        label = [int(best[1] > best[0])]
        for step in reversed(back):
            label.append(step[label[-1]])
        label = np.array(label[::-1])
        share = (chars * label).sum() / chars.sum()
        assert kept[r.doc_id].n_content == label.sum() and kept[r.doc_id].content_share == pytest.approx(share)
        assert kept[r.doc_id].keep == (share >= quality_rules.MIN_SHARE)
        wide = np.array([[*x[t], *(x[t - 1][1:] if t else np.zeros(WIDTH - 1)), *(x[t + 1][1:] if t + 1 < len(x) else np.zeros(WIDTH - 1))] for t in range(len(x))])
        s = classes.scores(wide)
        a, total = [np.exp(s[0] + classes.start)], []
        for t in range(1, len(s)):
            total.append(a[-1].sum())
            a[-1] = a[-1] / total[-1]
            a.append((a[-1] @ np.exp(classes.trans)) * np.exp(s[t]))
        b = [np.ones(2)]
        for t in range(len(s) - 1, 0, -1):
            v = np.exp(classes.trans) @ (np.exp(s[t]) * b[0])
            b.insert(0, v / v.sum())
        p = np.array([f * v / (f @ v) for f, v in zip(a, b, strict=True)])[:, 1]
        assert good[r.doc_id].quality == pytest.approx((chars * p).sum() / chars.sum(), abs=1e-9)
        assert good[r.doc_id].good == (good[r.doc_id].quality >= 0.5)


def test_a_share_or_quality_of_exactly_the_limit_counts(spark):
    docs = spark.createDataFrame([(1, "abcd\nefgh")], "doc_id long, text string")
    half = Crf(np.zeros((WIDTH, 2)), np.array([[0.0, 0.0], [0.0, -9.0]]), np.array([0.0, 1.0]), np.zeros(WIDTH), np.ones(WIDTH))  # first line content, second not
    r = quality_rules.apply(docs, half).first()
    assert (r.n_content, r.content_share, r.keep) == (1, 0.5, True)
    none = Crf(np.zeros((3 * WIDTH - 2, 2)), np.zeros((2, 2)), np.zeros(2), np.zeros(3 * WIDTH - 2), np.ones(3 * WIDTH - 2))
    r = quality_classifier.score(docs, none).first()
    assert (r.quality, r.good) == (pytest.approx(0.5), True)
