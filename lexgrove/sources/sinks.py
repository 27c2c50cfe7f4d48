"""Writers: models, clusters, graph layouts, logs."""

from __future__ import annotations

import logging
import sys
import time
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GOLDEN = 2.399963229728653


def save_vectors(vectors: DataFrame, path: str) -> None:
    """(idx, word, input, output) as Parquet: the form for vocabularies of any size."""
    vectors.write.mode("overwrite").parquet(path)


def save_vectors_lines(vectors: DataFrame, path: str) -> None:
    """(idx, word, input, output) as JSON, a word a line, which readers split where they like."""
    vectors.select("idx", "word", "input", "output").write.mode("overwrite").json(path)


def save_model_json(vectors: DataFrame, path: str, window: int, dim: int, negatives: int) -> None:
    """One JSON object with the seven fields that load_model_json reads; the whole model is one row, so for small models."""
    rows = F.sort_array(F.collect_list(F.struct("idx", "word", "input", "output")))
    vectors.agg(rows.alias("r")).select(
        F.map_from_arrays(F.col("r.word"), F.col("r.idx")).alias("vocab"),
        F.col("r.word").alias("index_to_word"),
        F.col("r.input").alias("input_vectors"),
        F.col("r.output").alias("output_vectors"),
        F.lit(window).cast("long").alias("window_size"),
        F.lit(dim).cast("long").alias("embedding_dim"),
        F.lit(negatives).cast("long").alias("negative_samples"),
    ).write.mode("overwrite").json(path)


def cluster_json(clusters: DataFrame, members: DataFrame, key: str = "doc_id", most: int = 100_000) -> DataFrame:
    """(cluster, chunk, json) from (cluster, size, topics) and members(key, cluster): an object has about `most` documents at most, so that
    no row grows with the table; size and topics are those of the whole cluster."""
    sized = members.join(clusters.select("cluster", "size"), "cluster")
    chunk = F.pmod(F.xxhash64(key), F.ceil(F.col("size") / most)).cast("int").alias("chunk")
    listed = sized.groupBy("cluster", chunk).agg(F.sort_array(F.collect_list(key)).alias("documents"))
    return listed.join(clusters, "cluster").select(
        "cluster", "chunk", F.to_json(F.struct(F.col("cluster").alias("id"), "documents", "topics", "size")).alias("json")
    )


def _place(node: Column, width: int, height: int) -> tuple[Column, Column]:
    """A sunflower spiral: every node has a place of its own whatever other nodes there are."""
    r = F.sqrt(node / (node + 50.0))
    return width / 2 * (1 + r * F.cos(node * GOLDEN)), height / 2 * (1 + r * F.sin(node * GOLDEN))


def plot_edges(edges: DataFrame, nodes: DataFrame | None = None, width: int = 800, height: int = 600) -> DataFrame:
    """(src, dst, x1, y1, x2, y2, color): red above weight 0.5, else blue; only between `nodes` if these are given."""
    if nodes is not None:
        for end in ("src", "dst"):
            edges = edges.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    (x1, y1), (x2, y2) = _place(F.col("src"), width, height), _place(F.col("dst"), width, height)
    return edges.select(
        "src", "dst", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), F.when(F.col("weight") > 0.5, "red").otherwise("blue").alias("color")
    )


def plot_nodes(nodes: DataFrame, edges: DataFrame, width: int = 800, height: int = 600) -> DataFrame:
    """(id, data, x, y, out_degree, out_degree_multi): what a viewer shows of each node."""
    degree = edges.groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("d"), F.count("*").alias("m"))
    x, y = _place(F.col("id"), width, height)
    return nodes.join(degree, "id", "left").select(
        "id", "data", x.alias("x"), y.alias("y"), F.coalesce("d", F.lit(0)).alias("out_degree"), F.coalesce("m", F.lit(0)).alias("out_degree_multi")
    )


class EventLog:
    """Events to a file, appended, and to standard output."""

    def __init__(self, path: str, name: str = "lexgrove.events") -> None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        self.log = logging.getLogger(name)
        self.log.setLevel(logging.INFO)
        self.log.propagate = False
        for h in list(self.log.handlers):
            self.log.removeHandler(h)
            h.close()
        for h in (logging.FileHandler(path), logging.StreamHandler(sys.stdout)):
            h.setFormatter(logging.Formatter("%(asctime)s [%(levelname)s] %(message)s"))
            self.log.addHandler(h)

    def event(self, name: str, details: str | None = None, error: str | None = None) -> str:
        message = name + (f": {details}" if details else "") + (f" - {error}" if error else "")
        self.log.log(logging.ERROR if error else logging.INFO, message)
        return message


@contextmanager
def timed(what: str) -> Iterator[None]:
    """Print the wall time of a block."""
    start = time.perf_counter()
    try:
        yield
    finally:
        print(f"{what}: {time.perf_counter() - start:.3f} s")
