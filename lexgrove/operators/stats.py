"""Statistics of series and of n-gram distributions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrove.operators import batches as B
from lexgrove.session import cut


def describe(series: DataFrame, by: str, x: str = "x") -> DataFrame:
    """(by, mean, variance, std_dev, median, range): population variance, exact median; nulls for a group without values."""
    return series.groupBy(by).agg(
        F.avg(x).alias("mean"),
        F.var_pop(x).alias("variance"),
        F.stddev_pop(x).alias("std_dev"),
        F.median(x).alias("median"),
        (F.max(x) - F.min(x)).alias("range"),
    )


def variance_about(series: DataFrame, by: str, mean: float, x: str = "x") -> DataFrame:
    """(by, variance): the mean square about a mean that the caller gives."""
    return series.groupBy(by).agg(F.avg(F.pow(F.col(x) - mean, 2)).alias("variance"))


def growth(series: DataFrame, by: str, order: str, x: str = "x") -> DataFrame:
    """(by, order, growth): per cent against the value before; the first row has none, null after a 0."""
    before = F.lag(x).over(W.partitionBy(by).orderBy(order))
    return (
        series.select(by, order, F.col(x).alias("x"), before.alias("before"))
        .where("before is not null")
        .select(by, order, (F.try_divide((F.col("x") - F.col("before")).cast("double"), F.col("before").cast("double")) * 100).alias("growth"))
    )


def covariance_and_correlation(pairs: DataFrame, by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """(by, covariance, correlation): population covariance, Pearson correlation, NaN for a constant series."""
    size = F.stddev_pop(x) * F.stddev_pop(y)
    return pairs.groupBy(*by).agg(
        F.covar_pop(x, y).alias("covariance"),
        F.when(size == 0, F.lit(float("nan"))).otherwise(F.covar_pop(x, y) / F.nullif(size, F.lit(0.0))).alias("correlation"),
    )


def _information(p: Column) -> Column:
    return F.when(p > 0, -p * F.log2(p)).otherwise(0.0)


def entropy(dist: DataFrame, by: str) -> DataFrame:
    """(by, entropy) in bits of (by, ngram, p)."""
    return dist.groupBy(by).agg(F.sum(_information(F.col("p"))).alias("entropy"))


def mode(dist: DataFrame, by: str) -> DataFrame:
    """(by, ngram, p): the most likely n-gram; of equal ones the one that sorts last."""
    best = F.max(F.struct("p", "ngram"))
    return dist.groupBy(by).agg(best.alias("b")).select(by, "b.ngram", "b.p")


def _pairs(dist: DataFrame, by: str) -> DataFrame:
    """(p_key, q_key, kl, a, b, sp, sq): sums over the n-grams that two distributions share, in both orders and of each with itself.

    One shuffle by n-gram; pairs are made and added up in its task, so that only rows for pairs of keys leave it. With m = (p + q) / 2 a is the sum of
    p log2(p / m), b that of q log2(q / m)."""
    names = ["kl", "a", "b", "sp", "sq"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for batch in batches:
            yield pa.Table.from_batches([batch])

    def together(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        held = list(tables)
        if not held:
            return
        t = pa.concat_tables(held).combine_chunks()
        gram = np.asarray(B.whole(t["ngram"]).dictionary_encode(null_encoding="encode").indices, np.int64)
        coded = B.whole(t["k"]).dictionary_encode(null_encoding="encode")
        order = np.argsort(gram, kind="stable")
        gram, key, p = gram[order], np.asarray(coded.indices, np.int64)[order], np.asarray(t["p"], float)[order]
        width, step, total = len(coded.dictionary), 0, {}
        while len(same := np.flatnonzero(gram[step:] == gram[: len(gram) - step]) if step < len(gram) else np.zeros(0, np.int64)):
            for x, y in [(same, same + step), (same + step, same)][: 2 if step else 1]:
                pair, back = np.unique(key[x] * width + key[y], return_inverse=True)
                mid = (p[x] + p[y]) / 2
                sums = [p[x] * np.log2(p[x] / p[y]), p[x] * np.log2(p[x] / mid), p[y] * np.log2(p[y] / mid), p[x], p[y]]
                for k, *values in zip(pair.tolist(), *[np.bincount(back.reshape(-1), s, len(pair)) for s in sums], strict=True):
                    total[k] = np.array(values) + total.get(k, 0.0)
            step += 1
        pairs = np.array(list(total), np.int64)
        sums = np.array(list(total.values())).reshape(-1, len(names))
        out = pa.table({"p_key": coded.dictionary.take(pa.array(pairs // width)), "q_key": coded.dictionary.take(pa.array(pairs % width))} | {c: pa.array(sums[:, i]) for i, c in enumerate(names)})
        yield from B.batched(out)

    some = dist.select("ngram", F.col(by).alias("k"), F.col("p").cast("double").alias("p")).where("p > 0")
    kind = dict(some.dtypes)["k"]
    found = B.met(some, rows, ["ngram"], together, f"p_key {kind}, q_key {kind}, " + ", ".join(f"{c} double" for c in names))
    return found.groupBy("p_key", "q_key").agg(*[F.sum(c).alias(c) for c in names])


def _every(part: DataFrame) -> DataFrame:
    """part(p_key, q_key, ..) with rows for pairs that share nothing; every key shares its n-grams with itself."""
    keys = part.where("p_key = q_key").select("p_key")
    return keys.crossJoin(keys.select(F.col("p_key").alias("q_key"))).join(part, ["p_key", "q_key"], "left")


def kl_divergence(dist: DataFrame, by: str) -> DataFrame:
    """(p_key, q_key, kl) of all ordered pairs of distributions: n-grams that both have; 0 if none. The table of pairs is small and made at once."""
    part = cut(_pairs(dist, by).select("p_key", "q_key", "kl"))
    return _every(part).select("p_key", "q_key", F.coalesce("kl", F.lit(0.0)).alias("kl"))


def js_divergence(dist: DataFrame, by: str, symmetric: bool = False) -> DataFrame:
    """(p_key, q_key, js) of all ordered pairs.

    The mixture has the n-grams of P alone, so the measure isn't symmetric and disjoint distributions give 0.5; with
    `symmetric` it has those of both. Only n-grams that P and Q share need to meet: with s the mass of P on them, the rest of P
    adds half of 1 - s (p against p/2 is one bit), and the same holds for Q in the symmetric form.
    """
    shared = cut(_pairs(dist, by).drop("kl"))
    zero = F.lit(0.0)
    left = F.coalesce("a", zero) + (1 - F.coalesce("sp", zero))
    right = F.coalesce("b", zero) + ((1 - F.coalesce("sq", zero)) if symmetric else zero)
    return _every(shared).select("p_key", "q_key", ((left + right) / 2).alias("js"))


def analyze(table: DataFrame, by: str) -> DataFrame:
    """(by, mean, variance, std_dev) of the counts of each key of (.., cnt)."""
    return table.groupBy(by).agg(F.avg("cnt").alias("mean"), F.var_pop("cnt").alias("variance"), F.stddev_pop("cnt").alias("std_dev"))
