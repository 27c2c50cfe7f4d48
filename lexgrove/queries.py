"""Queries of the analytics operators over whole tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.functions import text as T
from lexgrove.functions import vector as V
from lexgrove.operators import embeddings, graph, ngrams, sentiment, stats, topics
from lexgrove.plans import topic_model
from lexgrove.sources import sinks
from lexgrove.session import cut, ranked
from lexgrove.sources.text_files import default_stopwords
from lexgrove.streaming.term_counts import windowed_ngrams

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_DIGITS = 6
PHRASES = ["I'm me. You?", "", "...", "It is mine! Ask yourself, ask them.", "Nothing personal here.", "étémeà me"]


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c, digits: int = _DIGITS):
    return F.round(c, digits)


# SQL building blocks
_STOP = "[" + ",".join("'" + w.replace("'", "''") + "'" for w in default_stopwords()) + "]"
_RAW = r"regexp_extract_all(text, '\S+')"
_PLAIN = r"regexp_extract_all(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_\s]', '', 'g'), '\S+')"
_KEPT = f"list_filter({_PLAIN}, lambda x: NOT list_contains({_STOP}, x))"
_TOK = f"tok AS (SELECT doc_id, lang, source, unnest({_KEPT}) AS token FROM documents)"
_BAG = _TOK + ", bag AS (SELECT doc_id, token, count(*) AS cnt FROM tok GROUP BY ALL)"
_RAWPOS = f"raw AS (SELECT doc_id, lang, source, {_RAW} AS w FROM documents)"
_GRAMS = (
    _RAWPOS
    + ", grams AS (SELECT doc_id, lang, source, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS ngram FROM raw WHERE len(w) >= 2)"
)
_DIST = _GRAMS + (
    ", c AS (SELECT lang AS period, ngram, count(*) AS cnt FROM grams GROUP BY ALL)"
    ", d AS (SELECT period, ngram, cnt / sum(cnt) OVER (PARTITION BY period) AS p FROM c)"
    ", keys AS (SELECT DISTINCT period FROM d)"
)
_SERIES = "s AS (SELECT event_type AS series, CAST(ts AS DATE) AS day, count(*) AS x FROM events GROUP BY ALL)"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", "lang", "source", T.preprocess("text", default_stopwords()).alias("words"))


def _bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.bag_by(_words(spark, sf_dir))


def _by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.counts_by_period(_t(spark, sf_dir, "documents"), 2, "lang", "doc_id", mode="sum")


def _dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.distribution(_t(spark, sf_dir, "documents"), 2, "lang")


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series"), F.to_date("ts").alias("day")).agg(F.count("*").alias("x"))


# text
@_query(f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, array_to_string(w, ' ') AS tokens FROM (SELECT doc_id, {_KEPT} AS w FROM documents)")
def preprocess_tokens(spark, sf_dir):
    return _words(spark, sf_dir).select("doc_id", F.size("words").cast("long").alias("n_tokens"), F.array_join("words", " ").alias("tokens"))


@_query(
    f"""WITH t AS (SELECT unnest({_PLAIN}) AS token FROM documents), s AS (SELECT DISTINCT unnest({_STOP}) AS token)
    SELECT token, count(*) AS cnt FROM t WHERE token NOT IN (SELECT token FROM s) GROUP BY token"""
)
def stopword_filter(spark, sf_dir):
    stop = spark.createDataFrame([(w,) for w in sorted(set(default_stopwords()))], "token string")
    toks = _t(spark, sf_dir, "documents").select(F.explode(T.preprocess("text")).alias("token"))
    return toks.groupBy("token").agg(F.count("*").alias("cnt")).join(F.broadcast(stop), "token", "left_anti")


@_query(
    f"""WITH {_TOK}, c AS (SELECT lang, token, count(*) AS cnt FROM tok GROUP BY ALL),
    r AS (SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, token) AS INT) AS rank, token, cnt FROM c)
    SELECT * FROM r WHERE rank <= 10"""
)
def top_terms_by_lang(spark, sf_dir):
    toks = _words(spark, sf_dir).select("lang", F.explode("words").alias("token"))
    return topics.top_terms(toks.withColumn("cnt", F.lit(1).cast("long")), "lang", 10)


@_query(r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[.!?]'), lambda x: regexp_matches(x, '\S'))) AS BIGINT) AS sentences FROM documents")
def sentence_count(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.sentence_count("text").alias("sentences"))


_PRONOUNS = "[" + ",".join(f"'{p}'" for p in T.PRONOUNS) + "]"
_VALUES = ", ".join(f"({-1 - i}, '{p.replace(chr(39), chr(39) * 2)}')" for i, p in enumerate(PHRASES))


@_query(
    rf"""WITH a AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {_VALUES})),
    n AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[.!?]'), lambda x: regexp_matches(x, '\S'))) AS s,
        len(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}_]+'), lambda x: list_contains({_PRONOUNS}, x))) AS h FROM a)
    SELECT doc_id, CASE WHEN s > 0 AND h / s >= 0.5 THEN 'Subjective' ELSE 'Objective' END AS label,
        CASE WHEN s > 0 THEN round(h / s, 6) ELSE 0.0 END AS score FROM n"""
)
def subjectivity_score(spark, sf_dir):
    extra = spark.createDataFrame([(-1 - i, p) for i, p in enumerate(PHRASES)], "doc_id long, text string")
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text").union(extra)
    s = docs.select("doc_id", T.subjectivity("text").alias("s"))
    return s.select("doc_id", "s.label", _r(F.col("s.score")).alias("score"))


# n-grams
@_query(f"WITH {_GRAMS} SELECT doc_id, ngram, count(*) AS cnt FROM grams GROUP BY ALL")
def ngram_counts(spark, sf_dir):
    return ngrams.counts(_t(spark, sf_dir, "documents"), 2)


@_query(
    f"""WITH {_GRAMS}, last AS (SELECT source, max(doc_id) AS doc_id FROM documents GROUP BY source),
    f AS (SELECT l.source AS period, g.ngram, count(g.ngram) AS cnt FROM last l LEFT JOIN grams g USING (doc_id) GROUP BY ALL)
    SELECT * FROM f"""
)
def ngram_counts_last_wins(spark, sf_dir):
    return ngrams.counts_by_period(_t(spark, sf_dir, "documents"), 2, "source", "doc_id")


@_query(f"WITH {_GRAMS} SELECT source AS period, ngram, count(*) AS cnt FROM grams GROUP BY ALL")
def ngram_counts_by_period(spark, sf_dir):
    return ngrams.counts_by_period(_t(spark, sf_dir, "documents"), 2, "source", "doc_id", mode="sum")


@_query(
    f"""WITH {_GRAMS}, last AS (SELECT source, max(doc_id) AS doc_id FROM documents GROUP BY source),
    c AS (SELECT l.source AS period, ngram, count(*) AS cnt FROM last l JOIN grams g USING (doc_id) GROUP BY ALL)
    SELECT period, ngram, round(cnt / sum(cnt) OVER (PARTITION BY period), 6) AS p FROM c"""
)
def ngram_freq_by_period(spark, sf_dir):
    d = ngrams.shares(ngrams.counts_by_period(_t(spark, sf_dir, "documents"), 2, "source", "doc_id"))
    return d.withColumn("p", _r(F.col("p")))


@_query(f"WITH {_GRAMS}, c AS (SELECT doc_id, ngram, count(*) AS cnt FROM grams GROUP BY ALL) SELECT doc_id, ngram, round(cnt / sum(cnt) OVER (PARTITION BY doc_id), 6) AS p FROM c")
def ngram_probability(spark, sf_dir):
    return ngrams.probability(_t(spark, sf_dir, "documents"), 2).withColumn("p", _r(F.col("p")))


@_query(f"WITH {_DIST} SELECT period, round(sum(-p * log2(p)), 6) AS entropy FROM d GROUP BY period")
def ngram_entropy(spark, sf_dir):
    return stats.entropy(_dist(spark, sf_dir), "period").withColumn("entropy", _r(F.col("entropy")))


@_query(f"WITH {_DIST}, r AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY p DESC, ngram DESC) AS n FROM d) SELECT period, ngram, round(p, 6) AS p FROM r WHERE n = 1")
def ngram_mode(spark, sf_dir):
    return stats.mode(_dist(spark, sf_dir), "period").withColumn("p", _r(F.col("p")))


@_query(
    f"""WITH {_DIST}, k AS (SELECT a.period AS p_key, b.period AS q_key, sum(a.p * log2(a.p / b.p)) AS kl FROM d a JOIN d b USING (ngram) GROUP BY ALL)
    SELECT x.period AS p_key, y.period AS q_key, round(coalesce(kl, 0.0), 6) AS kl FROM keys x CROSS JOIN keys y
    LEFT JOIN k ON k.p_key = x.period AND k.q_key = y.period"""
)
def ngram_kl(spark, sf_dir):
    return stats.kl_divergence(_dist(spark, sf_dir), "period").withColumn("kl", _r(F.col("kl") + 0.0))


_JS = """SELECT p_key, q_key, round((sum(a) + sum(b)) / 2, 6) AS js FROM (
    SELECT x.period AS p_key, y.period AS q_key, a.p * log2(a.p / ((a.p + coalesce(b.p, 0)) / 2)) AS a,
        CASE WHEN b.p > 0 THEN b.p * log2(b.p / ((a.p + b.p) / 2)) ELSE 0 END AS b
    FROM keys x CROSS JOIN keys y JOIN d a ON a.period = x.period LEFT JOIN d b ON b.period = y.period AND b.ngram = a.ngram)
    GROUP BY ALL"""


@_query(f"WITH {_DIST} {_JS}")
def ngram_js(spark, sf_dir):
    return stats.js_divergence(_dist(spark, sf_dir), "period").withColumn("js", _r(F.col("js")))


@_query(
    f"""WITH {_DIST} SELECT p_key, q_key, round((sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END)) / 2, 6) AS js
    FROM (SELECT x.period AS p_key, y.period AS q_key, n.ngram, coalesce(a.p, 0) AS p, coalesce(b.p, 0) AS q FROM keys x CROSS JOIN keys y
        CROSS JOIN (SELECT DISTINCT ngram FROM d) n LEFT JOIN d a ON a.period = x.period AND a.ngram = n.ngram LEFT JOIN d b ON b.period = y.period AND b.ngram = n.ngram)
    GROUP BY ALL"""
)
def ngram_js_symmetric(spark, sf_dir):
    return stats.js_divergence(_dist(spark, sf_dir), "period", symmetric=True).withColumn("js", _r(F.abs(F.col("js"))))


@_query(f"WITH {_DIST} SELECT period, round(avg(cnt), 6) AS mean, round(var_pop(cnt), 6) AS variance, round(stddev_pop(cnt), 6) AS std_dev FROM c GROUP BY period")
def ngram_stats_by_period(spark, sf_dir):
    return _round_all(stats.analyze(_by_lang(spark, sf_dir), "period"), "mean", "variance", "std_dev")


@_query(f"WITH {_DIST} SELECT ngram, round(avg(cnt), 6) AS mean, round(var_pop(cnt), 6) AS variance, round(stddev_pop(cnt), 6) AS std_dev FROM c GROUP BY ngram")
def ngram_stats_by_ngram(spark, sf_dir):
    return _round_all(ngrams.stats_by_ngram(_t(spark, sf_dir, "documents"), 2, "lang"), "mean", "variance", "std_dev")


def _round_all(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: _r(F.col(c)) for c in columns})


# series
@_query(
    f"""WITH {_SERIES} SELECT series, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS variance, round(stddev_pop(x), 6) AS std_dev,
    round(median(x), 6) AS median, max(x) - min(x) AS range FROM s GROUP BY series"""
)
def series_stats(spark, sf_dir):
    return _round_all(stats.describe(_series(spark, sf_dir), "series"), "mean", "variance", "std_dev", "median")


@_query(f"WITH {_SERIES} SELECT series, round(avg((x - 40.0) * (x - 40.0)), 6) AS variance FROM s GROUP BY series")
def series_variance_about(spark, sf_dir):
    return _round_all(stats.variance_about(_series(spark, sf_dir), "series", 40.0), "variance")


@_query(
    f"""WITH {_SERIES}, l AS (SELECT *, lag(x) OVER (PARTITION BY series ORDER BY day) AS b FROM s)
    SELECT series, CAST(day AS VARCHAR) AS day, round((x - b) / nullif(b, 0) * 100, 6) AS growth FROM l WHERE b IS NOT NULL"""
)
def series_growth(spark, sf_dir):
    return _round_all(stats.growth(_series(spark, sf_dir), "series", "day"), "growth").withColumn("day", F.col("day").cast("string"))


@_query(
    f"""WITH {_SERIES} SELECT a.series AS a, b.series AS b, round(covar_pop(a.x, b.x), 6) AS covariance,
    CASE WHEN stddev_pop(a.x) * stddev_pop(b.x) = 0 THEN 'NaN'::DOUBLE ELSE round(covar_pop(a.x, b.x) / (stddev_pop(a.x) * stddev_pop(b.x)), 6) END AS correlation
    FROM s a JOIN s b USING (day) GROUP BY ALL"""
)
def series_covariance_correlation(spark, sf_dir):
    s = _series(spark, sf_dir)
    pairs = s.select(F.col("series").alias("a"), "day", "x").join(s.select(F.col("series").alias("b"), "day", F.col("x").alias("y")), "day")
    return _round_all(stats.covariance_and_correlation(pairs, ["a", "b"]), "covariance", "correlation")


# bags and weights
@_query(f"WITH {_TOK} SELECT token, count(*) AS cnt FROM tok GROUP BY token")
def bag_of_words(spark, sf_dir):
    return topics.bag(_words(spark, sf_dir))


@_query(f"WITH {_BAG} SELECT * FROM bag")
def document_bags(spark, sf_dir):
    return _bags(spark, sf_dir)


@_query(f"WITH {_BAG} SELECT token, count(*) AS df FROM bag GROUP BY token")
def doc_frequency(spark, sf_dir):
    return topics.document_frequency(_bags(spark, sf_dir))


@_query(
    f"""WITH {_BAG}, df AS (SELECT token, count(*) AS df FROM bag GROUP BY token)
    SELECT doc_id, token, round(cnt / sum(cnt) OVER (PARTITION BY doc_id) * ln((SELECT count(*) FROM documents) / df), 6) AS tfidf FROM bag JOIN df USING (token)"""
)
def tfidf_corpus(spark, sf_dir):
    n = _t(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
    return topics.tfidf(topics.bag_with_length(_words(spark, sf_dir)), n).withColumn("tfidf", _r(F.col("tfidf")))


@_query(f"WITH {_BAG} SELECT doc_id, token, round(ln(sum(cnt) OVER (PARTITION BY doc_id) / cnt), 6) AS tfidf FROM bag")
def tfidf_self(spark, sf_dir):
    return topics.tfidf_self(topics.bag_with_length(_words(spark, sf_dir))).withColumn("tfidf", _r(F.col("tfidf")))


@_query(
    f"""WITH {_TOK}, c AS (SELECT source AS cluster, token, count(*) AS cnt FROM tok GROUP BY ALL),
    r AS (SELECT cluster, CAST(row_number() OVER (PARTITION BY cluster ORDER BY cnt DESC, token) AS INT) AS rank, token, cnt FROM c)
    SELECT * FROM r WHERE rank <= 5"""
)
def cluster_top_terms(spark, sf_dir):
    toks = _words(spark, sf_dir).select(F.col("source").alias("cluster"), F.explode("words").alias("token"))
    return topics.top_terms(toks.withColumn("cnt", F.lit(1).cast("long")), "cluster", 5)


# vectors and clusters
@_query(
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
    SELECT a.vec_id AS a, b.vec_id AS b, round(list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))), 6) AS cosine
    FROM e a JOIN e b ON b.vec_id = a.vec_id + 1"""
)
def cosine_pairs(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("w"))
    return e.join(nxt, F.col("vec_id") == F.col("a")).select("a", "b", _r(V.cosine(F.col("embedding"), F.col("w"))).alias("cosine"))


def _first_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings")
    return e.groupBy(F.col("label").alias("cluster")).agg(F.min_by("embedding", "vec_id").alias("c"))


_CENT = """e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
    c AS (SELECT label AS cluster, arg_min(v, vec_id) AS c FROM e GROUP BY label),
    d AS (SELECT vec_id, v, cluster, list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS distance FROM e CROSS JOIN c),
    a AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) AS n FROM d)"""


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return topics.nearest(vectors, _first_by_label(spark, sf_dir), "vec_id")


@_query(f"WITH {_CENT} SELECT vec_id, cluster, round(distance, 6) AS distance FROM a WHERE n = 1")
def kmeans_assign_step(spark, sf_dir):
    return _assigned(spark, sf_dir).select("vec_id", "cluster", _r(F.col("distance")).alias("distance"))


@_query(
    f"""WITH {_CENT}, x AS (SELECT cluster, unnest(range(1, len(v) + 1)) AS dim, v FROM a WHERE n = 1)
    SELECT cluster, CAST(dim - 1 AS INT) AS dim, round(avg(v[dim]), 6) AS value, count(*) AS size FROM x GROUP BY cluster, dim"""
)
def kmeans_update_step(spark, sf_dir):
    rows = cut(_assigned(spark, sf_dir))
    c = topics.update(rows, rows.agg(F.max(F.size("v"))).first()[0])
    return c.select("cluster", "size", F.posexplode("c").alias("dim", "value")).select("cluster", "dim", _r(F.col("value")).alias("value"), "size")


def _lloyd_sql(rounds: int) -> str:
    """So many rounds from the first row of each label; rounds after the one that moves nothing change nothing."""
    ctes = ["e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)", "c0 AS (SELECT label AS cluster, arg_min(v, vec_id) AS c FROM e GROUP BY label)"]
    for i in range(rounds + 1):
        d = f"SELECT vec_id, v, arg_min(cluster, struct_pack(d := list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), k := cluster)) AS cluster FROM e CROSS JOIN c{i} GROUP BY vec_id, v"
        ctes.append(f"a{i} AS MATERIALIZED ({d})")
        u = f"SELECT cluster, unnest(range(1, len(v) + 1)) AS dim, unnest(v) AS x FROM a{i}"
        m = f"SELECT cluster, dim, avg(x) AS x FROM ({u}) GROUP BY cluster, dim"
        ctes.append(f"m{i} AS MATERIALIZED (SELECT cluster, list(x ORDER BY dim) AS c FROM ({m}) GROUP BY cluster)")
        ctes.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))")
    return "WITH " + ", ".join(ctes) + f" SELECT vec_id, cluster FROM a{rounds}"


@_query(_lloyd_sql(30))
def kmeans_fit_from_starts(spark, sf_dir):
    starts = _first_by_label(spark, sf_dir).orderBy("cluster").collect()
    vectors = _t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return topics.kmeans(vectors, initial=[r["c"] for r in starts], max_iter=30, tol=0.0)[0]  # as many rounds as the SQL has


@_query()
def kmeans_fit(spark, sf_dir):
    return topics.kmeans(_t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v")), k=10, seed=3)[0]


@_query()
def topic_fit(spark, sf_dir):
    return topic_model.fit(_t(spark, sf_dir, "documents"))[1]


@_query()
def cluster_json(spark, sf_dir):
    return sinks.cluster_json(*reversed(topic_model.fit(_t(spark, sf_dir, "documents"))))


@_query(
    f"""WITH {_TOK}, c AS (SELECT source AS cluster, token, count(*) AS cnt FROM tok GROUP BY ALL),
    r AS (SELECT cluster, row_number() OVER (PARTITION BY cluster ORDER BY cnt DESC, token) AS rank, token FROM c),
    t AS (SELECT cluster, list(token ORDER BY rank) AS topics FROM r WHERE rank <= 5 GROUP BY cluster),
    d AS (SELECT source AS cluster, list(doc_id ORDER BY doc_id) AS documents, count(*) AS size FROM documents GROUP BY source)
    SELECT cluster, 0 AS chunk, CAST(to_json(struct_pack(id := cluster, documents := documents, topics := topics, size := size)) AS VARCHAR) AS json FROM d LEFT JOIN t USING (cluster)"""
)
def cluster_json_by_source(spark, sf_dir):
    """Sources as clusters; at scales where SQL is run each is one object."""
    members = _t(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("cluster"))
    top = cluster_top_terms(spark, sf_dir)
    listed = top.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "token"))), lambda s: s["token"]).alias("topics"))
    sizes = members.groupBy("cluster").agg(F.count("*").alias("size"))
    return sinks.cluster_json(sizes.join(listed, "cluster", "left"), members)


# co-occurrence and graphs
@_query(
    f"""WITH {_RAWPOS}, p AS (SELECT doc_id, len(w) AS len, unnest(w) AS word, unnest(range(len(w))) AS i FROM raw WHERE len(w) >= 3),
    node AS (SELECT doc_id, word, max(i) AS node FROM p GROUP BY ALL),
    e AS (SELECT a.doc_id, a.word AS x, b.word AS y, least(a.i, a.len - 3) - greatest(0, b.i - 3 + 1) + 1 AS k
        FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.i IN (a.i + 1, a.i + 2)),
    s AS (SELECT doc_id, x, y, CAST(sum(k) AS DOUBLE) AS weight FROM e WHERE k > 0 GROUP BY ALL)
    SELECT s.doc_id, n.node AS src, m.node AS dst, weight FROM s JOIN node n ON n.doc_id = s.doc_id AND n.word = x JOIN node m ON m.doc_id = s.doc_id AND m.word = y"""
)
def cooccurrence_edges(spark, sf_dir):
    return ngrams.cooccurrence(_t(spark, sf_dir, "documents"), 3)


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Words of the benchmark passages as nodes, one edge for each pair of neighbours and passage; weight: their number in it."""
    rows = _t(spark, sf_dir, "benchmark").select("item_id", T.tokens("text").alias("w"))
    nodes = ranked(rows.select(F.explode("w").alias("data")).distinct(), ["data"], "id").select("id", "data")
    pairs = ngrams.counts(_t(spark, sf_dir, "benchmark"), 2, "item_id").select("item_id", F.split("ngram", " ").alias("g"), "cnt")
    named = (
        pairs.select("item_id", F.col("g")[0].alias("a"), F.col("g")[1].alias("b"), F.col("cnt").cast("double").alias("weight"))
        .join(nodes.select(F.col("data").alias("a"), F.col("id").alias("src")), "a")
        .join(nodes.select(F.col("data").alias("b"), F.col("id").alias("dst")), "b")
    )
    return nodes, named.select(F.col("item_id").alias("seq"), "src", "dst", "weight")


_GRAPH = (
    f"r AS (SELECT item_id, {_RAW} AS w FROM benchmark), nodes AS (SELECT word AS data, row_number() OVER (ORDER BY word) - 1 AS id FROM (SELECT DISTINCT unnest(w) AS word FROM r)),"
    " g AS (SELECT item_id, unnest(list_transform(range(1, len(w)), lambda i: {'a': w[i], 'b': w[i + 1]})) AS p FROM r),"
    " c AS (SELECT item_id, p.a AS a, p.b AS b, CAST(count(*) AS DOUBLE) AS weight FROM g GROUP BY ALL),"
    " edges AS (SELECT item_id AS seq, x.id AS src, y.id AS dst, weight FROM c JOIN nodes x ON x.data = a JOIN nodes y ON y.data = b),"
    " links AS (SELECT DISTINCT src, dst FROM edges)"
)
_BFS = f"WITH RECURSIVE {_GRAPH}, v(node, level) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT dst, level + 1 FROM v JOIN links ON src = node WHERE level < 40), f AS (SELECT node, min(level) AS level FROM v GROUP BY node)"


@_query(f"WITH {_GRAPH} SELECT src, dst, arg_max(weight, seq) AS weight FROM edges GROUP BY src, dst")
def graph_lookup_last_write(spark, sf_dir):
    return graph.lookup(_graph(spark, sf_dir)[1])


@_query(f"WITH {_GRAPH} SELECT src, array_to_string(list_sort(list(DISTINCT dst)), ',') AS neighbors FROM edges GROUP BY src")
def graph_neighbors(spark, sf_dir):
    return graph.neighbors(_graph(spark, sf_dir)[1]).select("src", F.array_join(F.col("neighbors").cast("array<string>"), ",").alias("neighbors"))


@_query(
    f"""WITH {_GRAPH} SELECT id, count(DISTINCT dst) AS out_degree, count(dst) AS out_degree_multi FROM nodes LEFT JOIN edges ON src = id GROUP BY id"""
)
def graph_degree(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return graph.degrees(edges, nodes.select("id"))


@_query(f"{_BFS} SELECT node, CAST(level AS INT) AS level FROM f")
def graph_bfs_levels(spark, sf_dir):
    return graph.bfs_levels(_graph(spark, sf_dir)[1], 0)


def _order_sql(key: str, rounds: int = 40) -> str:
    """Ranks level by level: a node follows its first parent, in order of `key` among that parent's links."""
    ctes = [f"WITH RECURSIVE {_GRAPH}", f"o AS (SELECT src, dst, min({key}) AS o FROM edges GROUP BY src, dst)", "l0 AS (SELECT CAST(0 AS BIGINT) AS node, CAST(0 AS BIGINT) AS rank)", "s0 AS (SELECT * FROM l0)"]
    for i in range(1, rounds):
        k = f"SELECT dst AS node, min(struct_pack(r := rank, o := o)) AS k FROM l{i - 1} JOIN o ON src = node WHERE dst NOT IN (SELECT node FROM s{i - 1}) GROUP BY dst"
        ctes.append(f"l{i} AS MATERIALIZED (SELECT node, (SELECT count(*) FROM s{i - 1}) + row_number() OVER (ORDER BY k, node) - 1 AS rank FROM ({k}))")
        ctes.append(f"s{i} AS MATERIALIZED (SELECT * FROM s{i - 1} UNION ALL SELECT * FROM l{i})")
    return ", ".join(ctes) + f" SELECT node, rank FROM s{rounds - 1}"


@_query(_order_sql("dst"))
def graph_bfs_order(spark, sf_dir):
    return graph.bfs_order(_graph(spark, sf_dir)[1], 0)


@_query(_order_sql("seq"))
def graph_bfs_order_as_inserted(spark, sf_dir):
    return graph.bfs_order(_graph(spark, sf_dir)[1], 0, by="seq")


@_query(f"{_BFS} SELECT node FROM f")
def graph_reachable(spark, sf_dir):
    return graph.reachable(_graph(spark, sf_dir)[1], 0)


@_query(f"{_BFS} SELECT id, f.node IS NOT NULL AS has_path FROM nodes LEFT JOIN f ON node = id")
def graph_has_path(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    found = graph.reachable(edges, 0).withColumn("y", F.lit(True))
    return nodes.join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("y", F.lit(False)).alias("has_path"))


def _paths_sql(edges: str = "edges") -> str:
    return f"""WITH RECURSIVE {_GRAPH}, own AS (SELECT src, dst, min(weight) AS weight FROM {edges} GROUP BY src, dst), v(node, hops, d) AS (SELECT CAST(0 AS BIGINT), 0, CAST(0.0 AS DOUBLE)
    UNION ALL SELECT dst, hops + 1, min(d + weight) FROM v JOIN own ON src = node WHERE hops < 40 GROUP BY dst, hops),
    f AS (SELECT node, min(struct_pack(d := d, h := hops)) AS b FROM v GROUP BY node),
    p AS (SELECT y.node, y.b.d AS distance, y.b.h AS hops, min(x.node) AS previous FROM f x JOIN own ON src = x.node JOIN f y ON y.node = dst
        WHERE x.b.d + weight = y.b.d AND x.b.h + 1 = y.b.h AND y.node <> 0 GROUP BY ALL)"""


@_query(_paths_sql() + " SELECT node, distance FROM p")
def graph_shortest_path(spark, sf_dir):
    return graph.shortest_paths(_graph(spark, sf_dir)[1], 0).select("node", "distance")


@_query(_paths_sql() + " SELECT node, distance, hops, previous FROM p")
def graph_shortest_path_tree(spark, sf_dir):
    return graph.shortest_paths(_graph(spark, sf_dir)[1], 0)


@_query(
    _paths_sql()
    + """, way(node, distance, path) AS (SELECT CAST(0 AS BIGINT), CAST(0.0 AS DOUBLE), '0' UNION ALL
    SELECT p.node, p.distance, way.path || ',' || p.node FROM way JOIN p ON previous = way.node) SELECT * FROM way WHERE node <> 0"""
)
def graph_shortest_path_nodes(spark, sf_dir):
    found = graph.paths(graph.shortest_paths(_graph(spark, sf_dir)[1], 0), 0)
    return found.select("node", "distance", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


@_query(_paths_sql("(SELECT * FROM edges WHERE src % 5 <> 3 AND dst % 5 <> 3)") + " SELECT node, distance FROM p")
def graph_shortest_path_registered(spark, sf_dir):
    """A search over registered nodes alone: a fifth of the words isn't."""
    nodes, edges = _graph(spark, sf_dir)
    return graph.shortest_paths(edges, 0, nodes.where("id % 5 <> 3")).select("node", "distance")


@_query(f"WITH {_GRAPH} SELECT seq, dst, weight FROM edges WHERE src = 0")
def graph_edge_details(spark, sf_dir):
    return graph.edge_details(_graph(spark, sf_dir)[1], 0).select("seq", "dst", "weight")


@_query(f"WITH {_GRAPH} SELECT seq, src, dst, weight FROM edges WHERE src <> 1 AND dst <> 1")
def graph_remove_node(spark, sf_dir):
    return graph.remove_node(*_graph(spark, sf_dir), 1)[1]


@_query(
    f"""WITH {_GRAPH}, p AS (SELECT min(src) AS s, arg_min(dst, (src, dst)) AS t FROM edges), f AS (SELECT min(seq) AS q FROM edges, p WHERE src = s AND dst = t)
    SELECT seq, src, dst, weight FROM edges, p, f WHERE NOT (src = s AND dst = t AND seq = q)"""
)
def graph_remove_edge(spark, sf_dir):
    edges = cut(_graph(spark, sf_dir)[1])
    pair = edges.agg(F.min(F.struct("src", "dst")).alias("p")).first()["p"]
    return graph.remove_edge(edges, pair["src"], pair["dst"])[0].select("seq", "src", "dst", "weight")


@_query(f"WITH {_GRAPH}, p AS (SELECT min(struct_pack(s := src, t := dst)) AS p FROM edges) SELECT src, dst, arg_max(weight, seq) AS weight FROM edges, p WHERE NOT (src = p.s AND dst = p.t) GROUP BY src, dst")
def graph_remove_edge_lookup(spark, sf_dir):
    edges = cut(_graph(spark, sf_dir)[1])
    pair = edges.agg(F.min(F.struct("src", "dst")).alias("p")).first()["p"]
    return graph.remove_edge(edges, pair["src"], pair["dst"])[1]


@_query(
    f"""WITH {_GRAPH}, q AS (SELECT id, 400 * (1 + sqrt(id / (id + 50.0)) * cos(id * {sinks.GOLDEN})) AS x, 300 * (1 + sqrt(id / (id + 50.0)) * sin(id * {sinks.GOLDEN})) AS y FROM nodes)
    SELECT src, dst, round(a.x, 4) AS x1, round(a.y, 4) AS y1, round(b.x, 4) AS x2, round(b.y, 4) AS y2, CASE WHEN weight > 0.5 THEN 'red' ELSE 'blue' END AS color
    FROM edges JOIN q a ON a.id = src JOIN q b ON b.id = dst"""
)
def graph_plot_edges(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return sinks.plot_edges(edges, nodes).withColumns({c: _r(F.col(c), 4) for c in ("x1", "y1", "x2", "y2")})


# skip-gram
_SGNS = rf"""w AS (SELECT doc_id, {_PLAIN} AS w FROM documents), p AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM w)"""


def _plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", T.preprocess("text").alias("words"))


@_query(
    f"""WITH {_SGNS}, f AS (SELECT word, min(struct_pack(d := doc_id, i := i)) AS pos FROM p GROUP BY word)
    SELECT row_number() OVER (ORDER BY pos) - 1 AS idx, word FROM f"""
)
def sgns_vocab(spark, sf_dir):
    return embeddings.vocabulary(embeddings.first_words(_plain(spark, sf_dir)))


@_query(
    f"""WITH {_SGNS} SELECT a.word, b.word AS context, count(*) AS cnt FROM p a JOIN p b ON a.doc_id = b.doc_id
    AND b.i IN (a.i - 2, a.i - 1, a.i + 1, a.i + 2) WHERE a.word <> b.word GROUP BY ALL"""
)
def sgns_pairs(spark, sf_dir):
    return embeddings.pair_counts(_plain(spark, sf_dir), 2)


@_query(
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    p AS (SELECT a.vec_id AS a, b.vec_id AS b, l.label, a.v AS x, b.v AS y FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 CROSS JOIN (VALUES (0.0), (1.0)) l(label)),
    g AS (SELECT *, 0.01 * (1 / (1 + exp(-list_inner_product(x, y))) - label) AS g FROM p)
    SELECT a, b, CAST(label AS DOUBLE) AS label, round(list_sum(list_transform(range(1, len(x) + 1), lambda i: x[i] - g * y[i])), 6) AS input_sum,
        round(list_sum(list_transform(range(1, len(x) + 1), lambda i: y[i] - g * x[i])), 6) AS output_sum FROM g"""
)
def sgns_gradient_step(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    pairs = e.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), F.col("v").alias("input")).join(e.select(F.col("vec_id").alias("b"), F.col("v").alias("output")), "b")
    rows = pairs.withColumn("label", F.explode(F.array(F.lit(0.0), F.lit(1.0))))
    total = lambda c: _r(F.aggregate(c, F.lit(0.0), lambda s, x: s + x))
    return embeddings.gradient_step(rows, 0.01).select("a", "b", "label", total("new_input").alias("input_sum"), total("new_output").alias("output_sum"))


@_query()
def sgns_train(spark, sf_dir):
    return embeddings.train(_plain(spark, sf_dir)).select("idx", "word", "input")


# sentiment
_LEXICON = (["good", "the"], ["trash", "idiot", "stupid"])


@_query(
    rf"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '\S+') AS w FROM documents),
    h AS (SELECT doc_id, len(list_filter(w, lambda x: list_contains({_LEXICON[0]}, x))) AS p, len(list_filter(w, lambda x: list_contains({_LEXICON[1]}, x))) AS n FROM w)
    SELECT doc_id, 'local' AS source, CASE WHEN p = n THEN 'Neutral' WHEN p > n THEN 'Positive' ELSE 'Negative' END AS label,
        CASE WHEN p = n THEN 0.0 ELSE round(abs(p - n) / (p + n), 6) END AS score, 'Objective' AS subjectivity FROM h"""
)
def polarity_score(spark, sf_dir):
    """A scorer that the caller supplies, here two word lists; no document of these tables has a pronoun."""
    words = [set(x) for x in _LEXICON]
    p = sentiment.analyze(_t(spark, sf_dir, "documents").select("doc_id", "text"), lambda: sentiment.LexiconScorer(*words))
    return p.select("doc_id", "polarity.source", "polarity.label", _r(F.col("polarity.score")).alias("score"), F.col("subjectivity.label").alias("subjectivity"))


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _t(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("positive"))
    return _t(spark, sf_dir, "documents").join(labels, "doc_id").select("text", "positive")


_TRAINED = (
    f"t AS (SELECT doc_id, {_PLAIN} AS w FROM documents), l AS (SELECT unnest(w) AS token, quality = 1 AS y FROM t JOIN labels USING (doc_id)),"
    " k AS (SELECT token, count(*) FILTER (WHERE y) AS p, count(*) FILTER (WHERE NOT y) AS n FROM l GROUP BY token),"
    " s AS (SELECT sum(p) AS p, sum(n) AS n, count(*) AS v FROM k),"
    " m AS (SELECT token, ln((k.p + 1) / (s.p + s.v)) - ln((k.n + 1) / (s.n + s.v)) AS weight FROM k, s)"
)


@_query(f"WITH {_TRAINED} SELECT token, round(weight, 6) AS weight FROM m")
def polarity_train(spark, sf_dir):
    """Word weights from the quality labels: what the corpus has as ratings."""
    return sentiment.train(_rated(spark, sf_dir)).select("token", _r(F.col("weight")).alias("weight"))


@_query(
    f"""WITH {_TRAINED}, x AS (SELECT doc_id, unnest(w) AS token FROM t), a AS (SELECT doc_id, round(avg(weight), 9) AS z FROM x JOIN m USING (token) GROUP BY doc_id)
    SELECT doc_id, CASE WHEN z IS NULL OR z = 0 THEN 'Neutral' WHEN z > 0 THEN 'Positive' ELSE 'Negative' END AS label, round(coalesce(abs(2 / (1 + exp(-z)) - 1), 0.0), 6) AS score
    FROM documents LEFT JOIN a USING (doc_id)"""
)
def polarity_trained_score(spark, sf_dir):
    """All documents by the trained weights, without leaving the JVM."""
    model = cut(sentiment.train(_rated(spark, sf_dir)))
    p = sentiment.score_by_weights(_t(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return p.select("doc_id", "polarity.label", _r(F.col("polarity.score")).alias("score"))


@_query(
    """WITH c(id, label, score, other, other_score) AS (VALUES (1, 'Positive', 0.9, 'negative', 0.1), (2, 'POSITIVE', 0.8, 'Neutral', 0.2), (3, 'negative', 0.5, 'Positive', 0.5)),
    b AS (SELECT id, CASE WHEN score > other_score THEN label ELSE other END AS l FROM c)
    SELECT id, CASE WHEN l IN ('Positive', 'positive', 'Neutral', 'neutral', 'Negative', 'negative') THEN upper(l[1]) || lower(l[2:]) END AS label FROM b"""
)
def polarity_candidates(spark, sf_dir):
    rows = [(1, ("Positive", 0.9), ("negative", 0.1)), (2, ("POSITIVE", 0.8), ("Neutral", 0.2)), (3, ("negative", 0.5), ("Positive", 0.5))]
    c = spark.createDataFrame(rows, "id int, a struct<label: string, score: double>, b struct<label: string, score: double>")
    return sentiment.top_of_two(c, "a", "b").select("id", T.polarity_label("best.label").alias("label"))


# windows of time
@_query(
    r"""WITH g AS (SELECT time_bucket(INTERVAL 1 hour, ts) AS start, unnest(regexp_extract_all(props, '\S+')) AS ngram FROM events)
    SELECT start, ngram, count(*) AS cnt FROM g GROUP BY ALL"""
)
def windowed_term_counts(spark, sf_dir):
    rows = windowed_ngrams(_t(spark, sf_dir, "events"), 1, "ts", "props")
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))
