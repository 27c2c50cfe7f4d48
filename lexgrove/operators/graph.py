"""Directed weighted graphs as DataFrames.

edges(seq, src, dst, weight) is a multigraph in order of insertion; nodes(id, data) are those that are registered,
which edges don't need. lookup(edges) is the matrix view, in which the last edge of a pair counts. Searches are
loops of frontier joins whose lineage ends in reliable checkpoints, so that a lost executor costs no more than one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.session import cut, fresh, ranked

NODES, EDGES = "id bigint, data string", "seq bigint, src bigint, dst bigint, weight double"


def empty(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES)


def size(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(size): one more than the largest id of a node or an edge's end; 0 without any."""
    ids = edges.select(F.greatest("src", "dst").alias("id")).union(nodes.select("id"))
    return ids.agg(F.coalesce(F.max("id") + 1, F.lit(0)).alias("size"))


def add_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """New nodes replace those of the same id; edges stay."""
    return nodes.join(new.select("id"), "id", "left_anti").select("id", "data").unionByName(new.select("id", "data"))


def add_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Appended: new(seq, src, dst, weight) has later seq values."""
    return edges.unionByName(new)


def lookup(edges: DataFrame) -> DataFrame:
    """(src, dst, weight): of each pair the edge with the highest seq."""
    return edges.groupBy("src", "dst").agg(F.max_by("weight", "seq").alias("weight"))


def get_weight(edges: DataFrame, src: int, dst: int) -> float | None:
    row = lookup(edges.where((F.col("src") == src) & (F.col("dst") == dst))).first()
    return row["weight"] if row else None


def edge_details(edges: DataFrame, src: int) -> DataFrame:
    return edges.where(F.col("src") == src)


def neighbors(edges: DataFrame) -> DataFrame:
    """(src, neighbors): distinct out-neighbours, ascending."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("neighbors"))


def degrees(edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(id, out_degree, out_degree_multi): distinct out-neighbours, and edges; of all ids that occur or of `ids`, 0 for those without."""
    if ids is None:
        ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    d = edges.groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("d"), F.count("*").alias("m"))
    return ids.join(d, "id", "left").select("id", F.coalesce("d", F.lit(0)).alias("out_degree"), F.coalesce("m", F.lit(0)).alias("out_degree_multi"))


def remove_node(nodes: DataFrame, edges: DataFrame, node: int) -> tuple[DataFrame, DataFrame]:
    """Without the node and all edges into or out of it."""
    return nodes.where(F.col("id") != node), edges.where((F.col("src") != node) & (F.col("dst") != node))


def remove_edge(edges: DataFrame, src: int, dst: int) -> tuple[DataFrame, DataFrame]:
    """(edges, lookup) after removal: the list loses the pair's first edge alone, the matrix the whole pair."""
    pair = (F.col("src") == src) & (F.col("dst") == dst)
    first = edges.where(pair).agg(F.min("seq").alias("__first"))
    left = edges.join(F.broadcast(first), pair & (F.col("seq") == F.col("__first")), "left_anti")
    return left, lookup(edges.where(~pair))


class _Rounds:
    """What the rounds of a search found, each appended to a folder once: a round reads what there is, but rewrites nothing."""

    def __init__(self, first: DataFrame):
        self.spark, self.schema, self.path, self.n = first.sparkSession, first.schema, fresh(first.sparkSession, "search"), 0
        self.add(first)

    def add(self, rows: DataFrame) -> DataFrame:
        at = f"{self.path}/round={self.n}"
        rows.write.parquet(at)
        self.n += 1
        return self.spark.read.schema(self.schema).parquet(at)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/round={i}" for i in range(self.n)])


def bfs_levels(edges: DataFrame, start: int) -> DataFrame:
    """(node, level): fewest edges from start, of every node that can be reached. Each step joins the newest level alone."""
    links = cut(edges.select("src", "dst").distinct())
    frontier = edges.sparkSession.range(start, start + 1).select(F.col("id").alias("node"), F.lit(0).alias("level"))
    rounds = _Rounds(frontier)
    while True:
        step = frontier.join(links, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = rounds.add(step.join(rounds.all(), "node", "left_anti").select("node", F.lit(rounds.n).alias("level")))
        if frontier.isEmpty():
            return rounds.all()


def bfs_order(edges: DataFrame, start: int, by: str = "dst") -> DataFrame:
    """(node, rank): the order in which a queue visits nodes; by='dst' takes neighbours in ascending order, by='seq' as inserted.

    A level is ranked by (rank of the first parent, neighbour order), by ranges: no task has a whole level.
    """
    if by not in ("dst", "seq"):
        raise ValueError("by is 'dst' or 'seq'")
    links = cut(edges.groupBy("src", "dst").agg(F.min("seq" if by == "seq" else "dst").alias("o")))
    frontier, known = edges.sparkSession.range(start, start + 1).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("rank")), 1
    rounds = _Rounds(frontier)
    while True:
        step = frontier.join(links, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min(F.struct("rank", "o")).alias("k"))
        new = step.join(rounds.all().select("node"), "node", "left_anti")
        frontier = rounds.add(ranked(new, ["k", "node"], "rank", known).select("node", "rank"))
        n = frontier.count()
        if not n:
            return rounds.all()
        known += n


def reachable(edges: DataFrame, start: int) -> DataFrame:
    """(node): start and what can be reached from it, along the direction of edges."""
    return bfs_levels(edges, start).select("node")


def has_path(edges: DataFrame, start: int, end: int) -> bool:
    return start == end or not reachable(edges, start).where(F.col("node") == end).isEmpty()


def strongly_connected(edges: DataFrame, start: int) -> DataFrame:
    """(node): what is reached from start and also reaches it."""
    back = edges.select("seq", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return reachable(edges, start).join(reachable(back, start), "node", "left_semi")


def shortest_paths(edges: DataFrame, start: int, nodes: DataFrame | None = None) -> DataFrame:
    """(node, distance, hops, previous): least total weight from start, of equal ones the fewest edges, and the node before, of several the
    smallest; without start itself. `paths` follows them back.

    Rounds of relaxation over all edges, parallel ones too, from the nodes that got nearer, until none does. With `nodes`
    only edges between registered ones count. A negative weight is an error.
    """
    if nodes is not None:
        for end in ("src", "dst"):
            edges = edges.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    links = cut(edges.groupBy("src", "dst").agg(F.min("weight").alias("weight")))
    if not links.where("weight < 0 or weight is null").isEmpty():
        raise ValueError("weights must not be negative or null")
    best = F.min(F.struct("distance", "hops")).alias("b")
    frontier = edges.sparkSession.range(start, start + 1).select(F.col("id").alias("node"), F.lit(0.0).alias("distance"), F.lit(0).alias("hops"))
    rounds = _Rounds(frontier)
    while True:
        step = frontier.join(links, F.col("node") == F.col("src")).select(
            F.col("dst").alias("node"), (F.col("distance") + F.col("weight")).alias("distance"), (F.col("hops") + 1).alias("hops")
        )
        step = step.groupBy("node").agg(best).select("node", "b.distance", "b.hops")
        old = rounds.all().groupBy("node").agg(best).select("node", F.col("b.distance").alias("d"), F.col("b.hops").alias("h"))
        nearer = step.join(old, "node", "left").where("d is null or struct(distance, hops) < struct(d, h)")
        frontier = rounds.add(nearer.select("node", "distance", "hops"))
        if frontier.isEmpty():
            break
    final = cut(rounds.all().groupBy("node").agg(best).select("node", "b.distance", "b.hops"))
    ends = final.join(links, F.col("node") == F.col("src")).select(
        F.col("node").alias("previous"), F.col("dst").alias("node"), (F.col("distance") + F.col("weight")).alias("distance"), (F.col("hops") + 1).alias("hops")
    )
    found = final.join(ends, ["node", "distance", "hops"]).groupBy("node", "distance", "hops").agg(F.min("previous").alias("previous"))
    return found.where(F.col("node") != start)


def paths(found: DataFrame, start: int) -> DataFrame:
    """(node, distance, path) of shortest_paths(): each path is made once, from that of the node before, in order of hops."""
    found = cut(found)
    last = found.sparkSession.range(start, start + 1).select(F.col("id").alias("node"), F.lit(0.0).alias("distance"), F.array("id").alias("path"))
    rounds = _Rounds(last)
    for hops in range(1, (found.agg(F.max("hops")).first()[0] or 0) + 1):
        before = last.select(F.col("node").alias("previous"), "path")
        step = found.where(F.col("hops") == hops).join(before, "previous")
        last = rounds.add(step.select("node", "distance", F.concat("path", F.array("node")).alias("path")))
    return rounds.all().where(F.col("node") != start)


def shortest_path(edges: DataFrame, start: int, end: int, nodes: DataFrame | None = None) -> tuple[list[int], float] | None:
    """(path, distance), or None if there is none or start is end."""
    if start == end:
        return None
    row = paths(shortest_paths(edges, start, nodes), start).where(F.col("node") == end).first()
    return (list(row["path"]), row["distance"]) if row else None
