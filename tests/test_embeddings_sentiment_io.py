import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexgrove.operators import embeddings, sentiment
from lexgrove.sources import sinks, text_files
from lexgrove.streaming.term_counts import windowed_ngrams

WORDS = "the quick brown fox jumps over the lazy dog".split()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(0, WORDS)], "doc_id long, words array<string>")


def test_pairs_and_vocabulary(spark, docs):
    assert embeddings.pairs(docs, 2).count() == 30
    corpus = spark.createDataFrame(list(enumerate(WORDS)), "pos long, word string")
    vocab = {r.word: r.idx for r in embeddings.vocabulary(corpus).collect()}
    assert vocab == {w: i for i, w in enumerate(dict.fromkeys(WORDS))}


def test_gradient_step_uses_old_copies(spark):
    df = spark.createDataFrame([(1.0, [1.0, 2.0], [0.5, -1.0])], "label double, input array<double>, output array<double>")
    r = embeddings.gradient_step(df, 0.1).first()
    a, b = np.array([1.0, 2.0]), np.array([0.5, -1.0])
    g = 1 / (1 + np.exp(-a @ b)) - 1
    assert np.allclose(r.new_input, a - 0.1 * g * b) and np.allclose(r.new_output, b - 0.1 * g * a)


def test_training_brings_neighbours_together_and_round_trips(spark, tmp_path):
    d = spark.createDataFrame([(i, (["a", "b"] if i % 2 else ["c", "d"]) * 6) for i in range(20)], "doc_id long, words array<string>")
    m = embeddings.train(d, dim=8, window=1, negative=2, epochs=30, rate=0.5, seed=2)
    v = {r.word: (np.array(r.input), np.array(r.output)) for r in m.collect()}
    assert v["a"][0] @ v["b"][1] > v["a"][0] @ v["d"][1]
    sinks.save_model_json(m, str(tmp_path / "m"), 1, 8, 2)
    back = text_files.model_vectors(text_files.load_model_json(spark, str(tmp_path / "m")))
    for r in back.collect():
        assert np.allclose(r.input, v[r.word][0]) and np.allclose(r.output, v[r.word][1])
    got = text_files.embedding_of(back, spark.createDataFrame([("a",), ("zz",)], "word string")).collect()
    assert {r.word: r.input is None for r in got} == {"a": False, "zz": True}


def test_the_training_query_covers_the_documents_at_the_defaults(spark, tmp_path):
    from lexgrove.queries import sgns_train

    rows = [(1, "a red fox, a dog"), (2, None), (3, "no word of the benchmark")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "passage")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.word: r.input for r in sgns_train(spark, str(tmp_path)).collect()}
    assert set(got) == {"a", "red", "fox", "dog", "no", "word", "of", "the", "benchmark"}
    assert {len(v) for v in got.values()} == {50}


@pytest.mark.parametrize("blocks", [1, 3])
def test_an_epoch_is_one_update_for_each_pair_in_some_order(spark, monkeypatch, blocks):
    """With minibatches of one pair, against a plain loop over the same pairs, cell by cell."""
    monkeypatch.setattr(embeddings, "negatives", lambda *_: F.array().cast("array<bigint>"))
    words = [["a", "b"] * 10, ["b", "c", "a", "d"]]
    d = spark.createDataFrame(list(enumerate(words)), "doc_id long, words array<string>").coalesce(1)
    vocab = spark.createDataFrame([(i, w) for i, w in enumerate("abcd")], "idx long, word string")
    start = embeddings.initial(vocab, 6, 3).orderBy("idx").collect()
    x, y = np.array([r.input for r in start]), np.array([r.output for r in start])
    rate = 3.0  # so high that a minibatch is one pair
    new = embeddings.train(d, dim=6, window=1, epochs=1, rate=rate, seed=3, blocks=blocks).orderBy("idx").collect()
    seq = [("abcd".index(doc[i]), "abcd".index(doc[j])) for doc in words for i in range(len(doc)) for j in (i - 1, i + 1) if 0 <= j < len(doc) and doc[i] != doc[j]]
    # the rows of a partition may come in any order of documents; both orders are tried
    def run(pairs):
        a, b = x.copy(), y.copy()
        for r in range(blocks):
            for c, t in pairs:
                if (t - c) % blocks == r:
                    g = 1 / (1 + np.exp(-a[c] @ b[t])) - 1
                    a[c], b[t] = a[c] - rate * g * b[t], b[t] - rate * g * a[c]
        return np.hstack([a, b])

    got = np.hstack([[r.input for r in new], [r.output for r in new]])
    first = 38  # pairs of the first document
    assert any(np.allclose(got, run(p), atol=1e-8) for p in (seq, seq[first:] + seq[:first]))


def test_minibatches_sum_their_gradients():
    g = np.random.default_rng(1)
    x, y = g.normal(size=(5, 3)), g.normal(size=(4, 3))
    c, t, label = g.integers(0, 5, 30), g.integers(0, 4, 30), g.integers(0, 2, 30)
    a, b = x.copy(), y.copy()
    embeddings.descend(a, b, c, t, label, 0.01)  # one minibatch holds all 30
    want_a, want_b = x.copy(), y.copy()
    for i, j, l in zip(c, t, label, strict=True):
        d = 0.01 * (1 / (1 + np.exp(-x[i] @ y[j])) - l)
        want_a[i] -= d * y[j]
        want_b[j] -= d * x[i]
    assert np.allclose(a, want_a) and np.allclose(b, want_b)


def test_many_epochs_leave_the_plan_small(spark):
    """Size estimates must not grow from epoch to epoch."""
    d = spark.createDataFrame([(i, ["a", "b"] if i % 2 else ["c", "d"]) for i in range(6)], "doc_id long, words array<string>")
    m = embeddings.train(d, dim=4, window=1, negative=1, epochs=60, rate=0.1)
    assert m.count() == 4
    assert len(str(m._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 40


def test_rows_that_share_a_key_are_rows_of_their_own(spark):
    d = spark.createDataFrame([(1, ["a", "b"]), (1, ["a", "b"]), (1, []), (2, None)], "doc_id long, words array<string>")
    vocab = spark.createDataFrame([(0, "a"), (1, "b")], "idx long, word string")
    assert sorted(r.words for r in embeddings.numbered(d, vocab, "doc_id").collect()) == [[0, 1], [0, 1]]


def test_negatives_have_neither_the_positive_nor_repeats(spark):
    from pyspark.sql import functions as F

    n = embeddings.negatives([F.col("id")], F.col("id") % 5, F.lit(5), 8, 1)
    for r in spark.range(40).select("id", n.alias("n")).collect():
        assert r.id % 5 not in r.n and len(set(r.n)) == len(r.n) <= 4


def test_stopwords_and_corpus(spark, tmp_path):
    (tmp_path / "s.txt").write_text(" a \nb\n\nb\n")
    first = text_files.read_stopwords(spark, str(tmp_path / "s.txt"))
    assert sorted(r.word for r in text_files.read_stopwords(spark, str(tmp_path / "s.txt"), first).collect()) == ["a", "a", "b", "b", "b", "b"]
    assert [r.word for r in text_files.read_corpus(spark, str(tmp_path / "s.txt")).orderBy("pos").collect()] == [" a ", "b", "", "b"]
    words = text_files.default_stopwords()
    assert len(words) == len(set(words)) and {"the", "don't", "dont", "ourselves", "between"} <= set(words)
    assert all(w == w.lower() for w in words)


def test_sentiment(spark):
    df = spark.createDataFrame([("good day to me",), (None,), ("trash",), ("",)], "text string")
    rows = sentiment.analyze(df, lambda: sentiment.LexiconScorer({"good"}, {"trash"})).collect()
    assert [r.polarity and r.polarity.label for r in rows] == ["Positive", None, "Negative", "Neutral"]
    assert rows[0].subjectivity.label == "Subjective"
    assert sentiment.analyze(df).first().polarity.label == "Neutral"
    assert sentiment.local_label("POSITIVE") == "Positive" and sentiment.local_label("x") == "Negative"


RATED = [("good day, good food", True), ("fine day", True), ("bad food", False), ("Bad, bad night", False), (None, True), ("unrated", None)]


def test_trained_weights_and_both_ways_to_score(spark, tmp_path):
    model = sentiment.train(spark.createDataFrame(RATED, "text string, positive boolean"))
    w = {r.token: r.weight for r in model.collect()}
    assert set(w) == {"good", "day", "food", "fine", "bad", "night"}  # 6 words in positive texts, 5 in the others
    assert w["good"] == pytest.approx(np.log(3 / 12) - np.log(1 / 11)) and w["bad"] == pytest.approx(np.log(1 / 12) - np.log(4 / 11))
    texts = spark.createDataFrame([(1, "a good day"), (2, "bad!"), (3, "unknown words"), (4, None), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r.polarity for r in sentiment.score_by_weights(texts, model).collect()}
    assert [got[i] and got[i].label for i in range(1, 6)] == ["Positive", "Negative", "Neutral", None, "Neutral"]
    config = text_files.ScorerConfig(str(tmp_path / "m" / "model.jsonl"), str(tmp_path / "m" / "config.json"))
    sentiment.save_scorer(model, config)
    again = {r.doc_id: r.polarity for r in sentiment.score(texts, sentiment.load_scorer(config)).collect()}
    for i in (1, 2, 3, 5):
        assert again[i].label == got[i].label and again[i].score == pytest.approx(got[i].score)
    (tmp_path / "m" / "config.json").write_text('{"kind": "other"}')
    with pytest.raises(ValueError, match="other"):
        sentiment.load_scorer(config)()


def test_a_hosted_service_through_its_transport(spark):
    def transport(url, headers, body):
        assert url == "http://service" and headers["Authorization"] == "Bearer secret"
        text = json.loads(body)["inputs"]
        high = 0.9 if "good" in text else 0.5
        return json.dumps([[{"label": "positive", "score": high}, {"label": "negative", "score": 0.5}]]).encode()

    df = spark.createDataFrame([("a good one",), ("another",), (None,)], "text string")
    rows = sentiment.score(df, lambda: sentiment.ApiScorer(text_files.ApiConfig("http://service", "secret"), transport), source="api").collect()
    assert [r.polarity and (r.polarity.source, r.polarity.label, r.polarity.score) for r in rows] == [("api", "Positive", 0.9), ("api", "Negative", 0.5), None]
    with pytest.raises(ValueError, match="candidates"):
        sentiment.ApiScorer(text_files.ApiConfig("u", "t"), lambda *_: b"[[]]")(["x"])


def test_vectors_as_lines_round_trip_in_parallel(spark, tmp_path):
    words = [f"wört{i}世" for i in range(400)]
    v = spark.createDataFrame([(i, w, [i / 3, 1.0], [0.5, -i / 7]) for i, w in enumerate(words)], "idx long, word string, input array<double>, output array<double>").coalesce(1)
    sinks.save_vectors_lines(v, str(tmp_path / "v"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")  # splits fall inside lines and characters
    try:
        back = text_files.load_vectors_lines(spark, str(tmp_path / "v"))
        assert back.rdd.getNumPartitions() > 4
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, v.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_api_config(monkeypatch):
    monkeypatch.delenv("POLARITY_API_URL", raising=False)
    with pytest.raises(ValueError):
        text_files.ApiConfig()
    assert text_files.ApiConfig("u", "t").url == "u"


def test_event_log(tmp_path, capsys):
    log = sinks.EventLog(str(tmp_path / "logs" / "e.log"))
    assert log.event("start", "now", "bad") == "start: now - bad"
    assert "start: now - bad" in (tmp_path / "logs" / "e.log").read_text() and "start: now - bad" in capsys.readouterr().out
    with sinks.timed("block"):
        pass
    assert "block" in capsys.readouterr().out


def test_stream_of_terms(spark, tmp_path):
    src = tmp_path / "in"
    spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'a b a' text").write.parquet(str(src))
    stream = spark.readStream.schema("ts timestamp, text string").parquet(str(src))
    q = windowed_ngrams(stream, 1).writeStream.format("memory").queryName("terms").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.ngram, r.cnt) for r in spark.table("terms").collect()} == {("a", 2), ("b", 1)}


def test_pair_counts_and_first_words_are_those_of_the_rows(spark):
    """Against pairs and positions one by one; rows of a key, repeats and empty rows among them."""
    from collections import Counter

    rng = __import__("random").Random(3)
    rows = [(i // 2 * 7 % 11, [rng.choice("abcdefé") for _ in range(rng.randint(0, 9))]) for i in range(30)] + [(None, ["z", "a"]), (3, None), (4, [])]
    d = spark.createDataFrame(rows, "doc_id long, words array<string>")
    for window in (1, 2, 4):
        want = Counter((r.word, r.context) for r in embeddings.pairs(d, window).collect())
        assert {(r.word, r.context): r.cnt for r in embeddings.pair_counts(d, window).collect()} == want
    first = {}
    for k, w in rows:
        for i, x in enumerate(w or []):
            first[x] = min(first.get(x, (99, 0)), (-1 if k is None else k, i))
    got = embeddings.first_words(d).groupBy("word").agg(F.min("pos").alias("pos")).collect()
    assert {r.word: (-1 if r.pos.doc_id is None else r.pos.doc_id, r.pos.i) for r in got} == first


def test_words_and_pairs_are_added_up_before_they_are_shuffled(spark):
    """A row for each word of a batch and not for each place."""
    d = spark.createDataFrame([(i, ["a", "b"] * 50) for i in range(40)], "doc_id long, words array<string>").coalesce(1)
    assert embeddings.first_words(d).count() == 2


def test_negatives_of_all_blocks_are_uniform_and_never_the_target_or_twice():
    """The cases of all blocks together: each pair once, and draws over all words, the same whatever the blocks."""
    n, k, g = 11, 5, np.random.default_rng(3)
    words = g.integers(0, n, (4000, 3))
    whole = {}
    for blocks in (1, 4):
        found = []
        for cell in range(blocks):
            w = words[words[:, 0] % blocks == cell].astype(np.int32)
            w[:, 1:][w[:, 1:] == w[:, :1]] = -1
            w[:, 0] //= blocks
            for block in range(blocks):
                c, t, y = embeddings.cases(w, np.random.Generator(np.random.SFC64(7)), k, n, blocks, block)
                found += list(zip((c * blocks + cell).tolist(), (t * blocks + block).tolist(), y.tolist(), strict=True))
        whole[blocks] = found
        want = sorted((int(c), int(t)) for c, *ts in words for t in ts if t != c)
        assert sorted((c, t) for c, t, y in found if y) == want
        share = np.bincount([t for _, t, y in found if not y], minlength=n) / len(want)
        assert np.all(np.abs(share - share.mean()) < 0.05)
        distinct = n * (1 - (1 - 1 / n) ** k) * (n - 1) / n  # words that k draws hit, without the target
        assert abs(share.sum() - distinct) < 0.05
    pair, seen = None, set()
    for c, t, y in whole[1]:  # one block: a pair is followed by its negatives
        seen = {t} if y else seen
        assert y or t not in seen
        seen.add(t)


def test_training_writes_no_more_than_its_model_and_rounds_follow_the_tasks_at_once(spark, monkeypatch):
    """Rounds hand vectors on in files: an epoch has as many rounds as tasks run at once, of which each leaves nothing behind."""
    gone = []
    real = embeddings.remove
    monkeypatch.setattr(embeddings, "remove", lambda s, path: (gone.append(path), real(s, path)))
    d = spark.createDataFrame([(i, [f"w{i}", f"w{i + 1}", "a"]) for i in range(3000)], "doc_id long, words array<string>")
    m = embeddings.train(d, dim=4, window=1, negative=2, epochs=2)
    assert len(gone) == 2 * spark.sparkContext.defaultParallelism
    assert m.count() == 3002 and m.select("idx").distinct().count() == 3002
