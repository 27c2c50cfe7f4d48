"""Term counts over windows of event time, on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.functions import text as T


def windowed_ngrams(stream: DataFrame, n: int, ts: str = "ts", text: str = "text", window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, ngram, cnt) by tumbling windows; rows later than `late` behind the watermark are dropped. Batch tables work too."""
    rows = stream.withWatermark(ts, late) if stream.isStreaming else stream
    grams = rows.select(F.window(ts, window).alias("w"), T.tokens(text).alias("t")).select("w", F.explode(T.ngrams("t", n)).alias("ngram"))
    return grams.groupBy("w", "ngram").agg(F.count("*").alias("cnt")).select(F.col("w.start").alias("start"), "ngram", "cnt")
