"""The pipeline's stages, each against a plain version on its own input, and on odd tables."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline as P
from lexgrove.llm import mixing, packing, quality_rules, simhash
from lexgrove.llm.crf import viterbi
from lexgrove.llm.linefeatures import line_features
from lexgrove.llm.textbuf import texts_of

SF = "/root/testdata/sf0.001"


def test_stages():
    assert [f.__name__ for _, f in P.STAGES] == ["quality_stage", "near_duplicate_stage", "repeated_passage_stage", "mixing_stage", "packing_stage"]
    assert P.ORACLE_SQL is None
    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert [sum(k.startswith(f"op{n}_") for k in names) for n in range(1, 11)] == [1] * 10


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Rows before and after each stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (_, f) in enumerate(P.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / f"{i}")
        f(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        if i < len(P.STAGES) - 1:
            assert after.columns == P.COLUMNS
        out.append((docs.collect(), after.collect()))
        docs = after
    return out


def test_quality_keeps_what_one_document_at_a_time_keeps(spark, steps):
    before, after = steps[0]
    model = quality_rules.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    want = set()
    for r in before:
        x, chars, count = line_features(texts_of(pa.array([r.text])))
        if len(x) and (viterbi(model.scores(x), count, model.trans, model.start) * chars).sum() / chars.sum() >= quality_rules.MIN_SHARE:
            want.add(tuple(r))
    assert {tuple(r) for r in after} == want
    assert 0 < len(after) < len(before)


def test_one_document_of_each_group_stays(steps):
    before, after = steps[1]
    f, size = simhash.text_fingerprints(texts_of(pa.array([r.text for r in before])))
    root = list(range(len(before)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(before)):
        near = np.flatnonzero((simhash.distance(f, f[i]) <= simhash.MAX_DISTANCE) & (size > 0))
        for j in near.tolist() if size[i] else []:
            a, b = find(i), find(j)
            if a != b:
                lo, hi = sorted((a, b), key=lambda k: before[k].doc_id)
                root[hi] = lo
    want = {tuple(r) for i, r in enumerate(before) if find(i) == i}
    got = {tuple(r) for r in after}
    # the search may miss a pair: nothing that should stay goes, and hardly anything that should go stays
    assert want <= got
    assert len(got - want) <= 0.02 * len(before)
    assert len(after) < len(before)


def test_repeated_passages_go(steps):
    before, after = steps[2]
    first = {}
    for r in before:
        w = r.text.split()
        for p in range(len(w) - 49):
            key = tuple(w[p : p + 50])
            first[key] = min(first.get(key, r.doc_id), r.doc_id)
    want = {}
    for r in before:
        w, gone = r.text.split(), set()
        for p in range(len(w) - 49):
            if first[tuple(w[p : p + 50])] < r.doc_id:
                gone.update(range(p, p + 50))
        left = [x for i, x in enumerate(w) if i not in gone]
        if left:
            want[r.doc_id] = left
    assert {r.doc_id: r.text.split() for r in after} == want
    assert all(r.n_chars == len(r.text) for r in after if len(r.text.split()) < len(next(b.text for b in before if b.doc_id == r.doc_id).split()))


def test_mixing_has_all_words_in_blocks(steps):
    before, after = steps[3]
    have = {w for r in before for w in r.text.split()}
    assert {w for r in after for w in r.text.split()} == have
    assert {r.source for r in after} == {r.source for r in before}
    assert all(len(r.text.split()) <= mixing.BLOCK and r.n_chars == len(r.text) for r in after)
    assert sorted(r.doc_id for r in after) == list(range(len(after)))


def test_packing_covers_the_blocks_in_order(steps):
    before, after = steps[4]
    size = {r.doc_id: len(r.text.split()) for r in before}
    at = dict.fromkeys(size, 0)
    for r in sorted(after, key=lambda r: (r.run, r.window)):
        assert r.n_tokens == sum(b - a for a, b in zip(r.starts, r.ends, strict=True)) == packing.WINDOW - r.padding
        for d, a, b in zip(r.doc_ids, r.starts, r.ends, strict=True):
            assert at[d] == a
            at[d] = b
    assert at == size


def test_run_is_the_stages_one_after_another(spark, steps):
    got = P.run(spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, steps[-1][1]))


def test_a_document_is_an_id_with_its_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a, "en", "s", 1), (2, a, "en", "s", 1), (2, b, "en", "s", 1), (3, c, "fr", "t", 2), (3, c, "en", "z", 9), (3, c, "fr", "t", 2)]
    rows += [(4, a + " more", "en", "s", 1)] * 2 + [(None, a, "en", "s", 1)] * 2 + [(5, None, "en", "s", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted(map(tuple, P.near_duplicate_stage(spark, docs, SF).collect()), key=repr)
    assert got == sorted([rows[0], rows[2], rows[4], *rows[-4:]], key=repr)


LONG = " ".join(f"p{i}" for i in range(60))
ODD = [
    (1, "A fine sentence of plain words.", "en", "a", 31),
    (1, "A fine sentence of plain words.", "en", "a", 31),
    (2, None, None, None, None),
    (None, "A row without an id but words.", "en", "a", None),
    (3, "", "en", "b", 0),
    (4, "Long words go on. " * 15_000, "en", None, None),
    (5, "Starts here. " + LONG + " tail one.", None, "b", None),
    (6, "Begins there, otherwise. " + LONG + " tail two.", "en", "b", None),
]


@pytest.mark.parametrize("rows", [ODD, []])
def test_every_stage_on_odd_tables(spark, tmp_path, rows):
    """Each stage on the odd rows themselves, with extra columns, and the stages one after another."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.lit("z").alias(c) for c in ("f", "rep", "node", "group", "__gone", "__from", "keep", "run", "chunk", "part")])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(1, 1, 0), (5, 1, 0), (4, 0, 0), (None, 1, 1), (3, None, None)] if rows else []
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for i, (_, f) in enumerate(P.STAGES):
        out = f(spark, docs, str(tmp_path))
        assert i == len(P.STAGES) - 1 or out.columns == P.COLUMNS
        got = out.collect()
        if not rows:
            assert got == []
        elif i == 1:
            assert [r.doc_id for r in got].count(1) == 1  # rows that repeat id and text are one
            assert [r.text for r in got if r.doc_id is None] == [ODD[3][1]] and any(r.doc_id == 2 for r in got)
        elif i == 2:
            assert next(r.text for r in got if r.doc_id == 6) == "Begins there, otherwise. two."  # the passage has "tail" too
            assert len(got) == len(rows)
    P.run(spark, str(tmp_path)).collect()
