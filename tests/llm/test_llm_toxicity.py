"""Ordinal regression: gradients, order of the thresholds, held-out labels, edge cases."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexgrove.llm import toxicity
from lexgrove.llm.linefeatures import labelled_lines
from lexgrove.llm.shared import bounded
from lexgrove.llm.textbuf import texts_of

SF = "/root/testdata/sf0.01"


def probabilities(model, s):
    below = np.concatenate([[0], 1 / (1 + np.exp(-(model.cut - s))), [1]])
    return np.diff(below)


def test_fit_recovers_grades_that_share_one_direction():
    g = np.random.default_rng(1)
    x = g.normal(size=(400, 3))
    s = x @ np.array([2.0, -1.0, 0.0]) + g.logistic(size=400) * 0.3
    y = np.searchsorted([-1.5, 0.0, 1.5], s)
    row, col = np.repeat(np.arange(400), 3), np.tile(np.arange(3), 400)
    m = toxicity.fit(row, col, x.reshape(-1), y, 3, 4, steps=400)
    assert (np.diff(m.cut) > 0).all()
    p = np.array([probabilities(m, v @ m.weight) for v in x])
    assert np.allclose(p.sum(axis=1), 1)
    assert (p.argmax(axis=1) == y).mean() > 0.8
    assert m.weight[0] / -m.weight[1] == pytest.approx(2, rel=0.25)


def test_fit_is_at_a_minimum_of_the_likelihood():
    """The analytic steps end where no small change of a weight or cut lowers the penalised loss."""
    g = np.random.default_rng(2)
    n, width = 200, 4
    x = g.normal(size=(n, width))
    y = np.searchsorted([-0.5, 0.8], x[:, 0] + g.logistic(size=n))
    row, col = np.repeat(np.arange(n), width), np.tile(np.arange(width), n)
    m = toxicity.fit(row, col, x.reshape(-1), y, width, 3, steps=3000)

    def loss(w, cut):
        p = np.array([probabilities(toxicity.Ordinal(w, cut), v @ w)[k] for v, k in zip(x, y, strict=True)])
        return -np.log(p).mean() + 1e-5 * (w**2).sum()

    best = loss(m.weight, m.cut)
    for i in range(width):
        for d in (-0.05, 0.05):
            w = m.weight.copy()
            w[i] += d
            assert loss(w, m.cut) > best - 1e-5
    for i in range(2):
        for d in (-0.05, 0.05):
            c = m.cut.copy()
            c[i] += d
            assert loss(m.weight, c) > best - 1e-5


def test_likelihood_ratio():
    toxic = np.array([True] * 10 + [False] * 30)
    row, col = np.array([*range(10), *range(40)]), np.array([0] * 10 + [1] * 40)
    g = toxicity.likelihood_ratio(row, col, toxic, 3)
    assert g[0] == pytest.approx(2 * (10 * np.log(4) + 30 * np.log(4 / 3)))
    assert g[1:] == pytest.approx([0, 0])


@pytest.mark.parametrize("n", [1, 2, 4, 5])
def test_a_few_toxic_rows_teach_their_word(spark, n):
    """As few as one toxic row among 200 clean ones."""
    g = np.random.default_rng(n)
    common = [f"word{i}" for i in range(60)]
    rows = [(i, " ".join(g.choice(common, 20)) + (" grobnak" if i < n else "")) for i in range(200 + n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    m = toxicity.train(docs, spark.createDataFrame([(i, int(i < n)) for i in range(200 + n)], "doc_id long, toxic int"))
    probe = spark.createDataFrame([(1, "word1 word2 grobnak word3"), (2, "word1 word2 word3"), (3, "Grobnak!")], "doc_id long, text string")
    p = {r.doc_id: r.p_toxic for r in toxicity.score(probe, m).collect()}
    assert p[1] > (5 if n > 1 else 1) * p[2] and p[3] > p[2]
    assert n < 4 or p[3] > 0.5
    word = toxicity.features(texts_of(pa.array(["grobnak"])))[1][0]
    assert m.weight.argmax() == word


def test_minimise_finds_the_minimum_of_a_narrow_valley():
    def f(x):
        return float((1 - x[0]) ** 2 + 100 * (x[1] - x[0] ** 2) ** 2), np.array([-2 * (1 - x[0]) - 400 * x[0] * (x[1] - x[0] ** 2), 200 * (x[1] - x[0] ** 2)])

    assert np.allclose(toxicity.minimise(f, np.array([-1.2, 1.0]), 200), 1, atol=1e-4)


def test_the_sample_bound_holds_for_rows_that_share_an_id(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)], "doc_id long, text string")
    assert bounded(docs, 20, 3).count() == 20
    assert len(labelled_lines(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"), 7, 3)) == 7


def test_ties_take_the_lower_grade_and_a_threshold_that_is_met_is_toxic(spark):
    m = toxicity.Ordinal(np.zeros(1 << toxicity.BITS), np.array([0.0]))
    r = toxicity.score(spark.createDataFrame([(1, "any words")], "doc_id long, text string"), m).first()
    assert (r.severity, r.p_toxic, r.toxic) == (0, 0.5, True)


def test_query_against_one_document_at_a_time(spark):
    """All documents of a table, the longest ones too, against plain counting of words."""
    from lexgrove.llm.queries import op2_toxicity_ordinal

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    m = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r.doc_id: r for r in op2_toxicity_ordinal(spark, sf).collect()}
    edge = {chr(c) for c in np.flatnonzero(toxicity.EDGE)}
    rows = docs.collect()
    assert len(got) == len(rows)
    bucket = {}
    for r in rows:
        words = "".join(" " if c in edge else c.lower() for c in r.text).split()
        for w in set(words) - set(bucket):
            bucket[w] = int(toxicity.features(texts_of(pa.array([w])))[1][0])
        counts = {}
        for w in words:
            counts[bucket[w]] = counts.get(bucket[w], 0) + 1
        p = probabilities(m, sum(np.log1p(c) * m.weight[b] for b, c in counts.items()))
        assert got[r.doc_id].severity == p.argmax() and got[r.doc_id].toxic == (1 - p[0] >= 0.5)
        assert got[r.doc_id].expected_severity == pytest.approx((p * np.arange(4)).sum(), abs=1e-6)


def test_features_are_word_counts():
    row, col, val = toxicity.features(texts_of(pa.array(["Bad, bad word", None, "", "word!"])))
    assert row.tolist() == [0, 0, 3]
    assert sorted(np.round(np.expm1(val[row == 0])).tolist()) == [1, 2]
    assert col[row == 3][0] in col[row == 0]  # case and punctuation don't matter


ROWS = [(1, "plain words here"), (1, "plain words here"), (None, "no id"), (2, None), (3, ""), (4, "w " * 150_000), (5, "zork zork plain")]
LABELS = [(1, 0), (1, 0), (5, 1), (None, 1), (2, 1), (4, None), (77, 1)]


@pytest.mark.parametrize("rows", [ROWS, []])
@pytest.mark.parametrize("labels", [LABELS, [], [(1, 0)], [(5, 1)]])
def test_edge_cases(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(9).alias(c) for c in ("y", "b", "v", "toxic", "severity")])
    lab = spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    got = toxicity.score(docs, toxicity.train(docs, lab)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id == 2:
            assert (r.severity, r.expected_severity, r.p_toxic, r.toxic) == (None, None, None, False)
        else:
            assert 0 <= r.severity < toxicity.GRADES and 0 <= r.expected_severity <= toxicity.GRADES - 1
            assert r.toxic == (r.p_toxic >= 0.5)
    if rows:
        assert len({tuple(r) for r in got if r.doc_id == 1}) == 1


def test_held_out_labels_and_the_score_of_each_document(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    side = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    model = toxicity.train(docs, labels.where(side))
    assert (np.diff(model.cut) > 0).all()
    scored = toxicity.score(docs, model)
    got = scored.join(labels.where(~side).select("doc_id", F.col("toxic").alias("y")), "doc_id").toPandas()
    bad, good = got[got.y == 1], got[got.y == 0]
    # a fifth of the labels of toxic rows, and more in this small table, are noise: such rows have no word that marks them
    words = {r.doc_id for r in docs.where(r"lower(text) rlike '(trash|pathetic|idiot|disgusting|worthless|stupid|loser|clown|scum|moron)'").collect()}
    assert bad[bad.doc_id.isin(words)].toxic.mean() > 0.9
    assert good.toxic.mean() < 0.01
    assert bad.expected_severity.mean() > good.expected_severity.mean() + 0.5
    by = {r.doc_id: r for r in scored.collect()}
    for r in docs.orderBy("n_chars").take(100):
        row, col, val = toxicity.features(texts_of(pa.array([r.text])))
        p = probabilities(model, (val * model.weight[col]).sum())
        assert by[r.doc_id].expected_severity == pytest.approx((p * np.arange(4)).sum(), abs=1e-6)
        assert by[r.doc_id].p_toxic == pytest.approx(1 - p[0], abs=1e-6)
