"""Nearest centroids: vectors against plain counting, held-out accuracy, rejection, edge cases."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexgrove.llm import language
from lexgrove.llm.textbuf import texts_of

SF = "/root/testdata/sf0.01"


def slow_counts(text):
    data = []
    for b in text.lower().encode():
        c = b if 97 <= b <= 122 or b >= 0x80 else 32
        if c != 32 or not data or data[-1] != 32:
            data.append(c)
    out = np.zeros(language.DIMS)
    for k in (1, 2, 3):
        for i in range(len(data) - k + 1):
            code = 0
            for c in data[i : i + k]:
                code = (code * 257 + c) % 2**32
            out[code * 2654435761 % 2**32 >> 20] += 1
    return out


def test_counts():
    texts = ["The quick  brown fox -- 12 jumps!", None, "", "ÄÖ über", "a"]
    got = language.ngram_counts(texts_of(pa.array(texts)))
    for g, t in zip(got, texts, strict=True):
        assert np.array_equal(g, slow_counts(t or ""))


def test_document_frequency_covers_all_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    df, n = language.document_frequency(docs)
    texts = [r.text for r in docs.select("text").collect() if r.text]
    want = np.sum([language.ngram_counts(texts_of(pa.array([t])))[0] > 0 for t in texts], axis=0)
    assert np.array_equal(df, want)
    assert n == sum(bool(t.strip()) for t in texts)


def test_kmeans_on_fewer_rows_than_centroids():
    v = np.eye(3, 8, dtype=np.float32)
    c = language.spherical_kmeans(v, 5)
    assert len(c) == 3
    assert np.allclose(np.linalg.norm(c, axis=1), 1)


def test_held_out_accuracy_and_rejection(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    side = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    model = language.train(docs.where(side))
    assert len(model.vectors) > len(model.languages)  # several for each language
    got = language.identify(docs.where(~side), model).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("n_chars >= 40").toPandas()
    assert (got.nearest == got.lang).mean() > 0.97
    assert (got.language == got.lang).mean() > 0.95
    odd = spark.createDataFrame([(1, "zqxj " * 40), (2, "это совсем другой язык, которого модель не знает " * 3), (3, "你好世界" * 20)], "doc_id long, text string")
    assert [r.language for r in language.identify(odd, model).collect()] == [None] * 3


def test_each_row_against_plain_cosines(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs)
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    for r in docs.orderBy("n_chars").take(60):
        v = np.log1p(slow_counts(r.text)) * model.idf if r.text.isascii() else language.vectors(language.ngram_counts(texts_of(pa.array([r.text]))), model.idf)[0]
        if not v.any():
            assert got[r.doc_id].nearest is None
            continue
        cos = model.vectors @ (v / np.linalg.norm(v))
        assert got[r.doc_id].cosine == pytest.approx(cos.max(), abs=1e-4)
        assert model.languages[model.owner[cos.argmax()]] == got[r.doc_id].nearest


def test_query_against_plain_cosines_of_all_documents(spark):
    """Every document of a table, the longest ones too."""
    from lexgrove.llm.queries import op9_language_centroids

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.train(docs)
    got = {r.doc_id: r for r in op9_language_centroids(spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        # slow counts lower whole texts; bytes of other letters are letters as they are
        counts = slow_counts(r.text) if len(r.text) < 3000 else language.ngram_counts(texts_of(pa.array([r.text])))[0]
        v = np.log1p(counts) * model.idf
        if not v.any():
            assert got[r.doc_id].nearest is None
            continue
        cos = model.vectors @ (v / np.linalg.norm(v))
        best = cos.argmax()
        assert got[r.doc_id].cosine == pytest.approx(cos[best], abs=1e-4)
        assert got[r.doc_id].nearest == model.languages[model.owner[best]]
        assert got[r.doc_id].language == (got[r.doc_id].nearest if got[r.doc_id].cosine >= model.limit[best] else None)


def test_a_rare_language_has_centroids(spark):
    rows = [(i, f"the quick words go over hill number {i}", "en") for i in range(3000)] + [(9000, "der hund und die katze", "de"), (9001, None, "fr"), (9002, " ", "es")]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=50)
    assert model.languages == ["de", "en"]


ROWS = [
    (1, "the cat and the dog went over the hill", "en"),
    (1, "the cat and the dog went over the hill", "en"),
    (2, "der hund und die katze gingen nach hause", "de"),
    (3, None, "en"),
    (4, "", "de"),
    (None, "a row without id in the table", "en"),
    (5, "the words " * 30_000, "en"),
    (6, "12 34 !!", "de"),
    (7, "label is missing on the row", None),
]


@pytest.mark.parametrize("rows", [ROWS, [], [(1, "same text", "aa"), (2, "same text", "bb")]])
def test_edge_cases(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("*", *[F.lit("z").alias(c) for c in ("y", "b", "c", "language", "cosine")])
    model = language.train(docs)
    got = language.identify(docs, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for d in (3, 4):
        if d in by:
            assert tuple(by[d])[1:] == (None, None, None, None)
    if len(rows) == 2:
        assert {r.nearest for r in got} == {"aa"}  # of equal cosines the language that sorts first
        assert {round(r.margin, 6) for r in got} == {0}
    if len(rows) > 2:
        assert by[1].language == "en" and by[2].language == "de"


def test_no_model(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert tuple(language.identify(docs, language.train(docs)).first()) == (1, None, None, None, None)
