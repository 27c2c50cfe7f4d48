import heapq
import random

import pytest

from lexgrove.operators import graph
from lexgrove.sources import sinks

SMALL = [(0, 1, 2, 4.0), (1, 1, 3, 2.0), (2, 2, 4, 3.0), (3, 3, 4, 1.0)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(SMALL, graph.EDGES)


def order(df):
    return [r.node for r in df.orderBy("rank").collect()]


def test_small_graph(spark, edges):
    assert order(graph.bfs_order(edges, 1)) == [1, 2, 3, 4] == order(graph.bfs_order(edges, 1, by="seq"))
    assert graph.shortest_path(edges, 1, 4) == ([1, 3, 4], 3.0)
    assert graph.shortest_path(edges, 1, 1) is None and graph.shortest_path(edges, 4, 1) is None
    nodes = spark.createDataFrame([(i, f"n{i}") for i in range(1, 5)], graph.NODES)
    assert graph.size(edges, nodes).first()[0] == 5
    assert graph.has_path(edges, 1, 4) and graph.has_path(edges, 9, 9) and not graph.has_path(edges, 4, 1)


def test_random_graph_against_plain_search(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.randrange(12), rnd.randrange(12), float(rnd.randrange(1, 9))) for i in range(30)]
    e = spark.createDataFrame(rows, graph.EDGES)
    queue, seen = [0], [0]
    while queue:
        u = queue.pop(0)
        for v in sorted({b for _, a, b, _ in rows if a == u}):
            if v not in seen:
                seen.append(v)
                queue.append(v)
    assert order(graph.bfs_order(e, 0)) == seen
    dist, heap = {0: 0.0}, [(0.0, 0)]
    while heap:
        d, u = heapq.heappop(heap)
        for _, a, b, w in rows:
            if a == u and d + w < dist.get(b, 1e9):
                dist[b] = d + w
                heapq.heappush(heap, (d + w, b))
    got = {r.node: r.distance for r in graph.shortest_paths(e, 0).collect()}
    assert got == {k: v for k, v in dist.items() if k != 0}
    assert {r.node for r in graph.reachable(e, 0).collect()} == set(seen)


def test_parallel_edges_and_removal(spark):
    e = spark.createDataFrame([(0, 1, 2, 5.0), (1, 1, 2, 7.0), (2, 2, 2, 1.0)], graph.EDGES)
    assert graph.get_weight(e, 1, 2) == 7.0 and graph.get_weight(e, 2, 1) is None
    left, look = graph.remove_edge(e, 1, 2)
    assert {r.seq for r in left.collect()} == {1, 2} and {(r.src, r.dst) for r in look.collect()} == {(2, 2)}
    d = {r.id: (r.out_degree, r.out_degree_multi) for r in graph.degrees(e).collect()}
    assert d == {1: (1, 2), 2: (1, 1)}
    nodes = spark.createDataFrame([(1, "a"), (2, "b")], graph.NODES)
    n, r = graph.remove_node(nodes, e, 2)
    assert n.count() == 1 and r.count() == 0
    new = spark.createDataFrame([(2, "c"), (3, "d")], graph.NODES)
    assert {(x.id, x.data) for x in graph.add_nodes(nodes, new).collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_paths_have_the_fewest_edges_of_equal_distances(spark):
    rows = [(0, 1, 2, 1.0), (1, 2, 3, 1.0), (2, 1, 3, 2.0), (3, 3, 4, 0.0), (4, 4, 3, 0.0), (5, 1, 5, 1.0), (6, 5, 6, 1.0), (7, 2, 6, 1.0)]
    e = spark.createDataFrame(rows, graph.EDGES)
    found = graph.shortest_paths(e, 1)
    got = {r.node: (r.distance, r.hops, r.previous) for r in found.collect()}
    assert got == {2: (1.0, 1, 1), 3: (2.0, 1, 1), 4: (2.0, 2, 3), 5: (1.0, 1, 1), 6: (2.0, 2, 2)}
    assert {r.node: r.path for r in graph.paths(found, 1).collect()} == {2: [1, 2], 3: [1, 3], 4: [1, 3, 4], 5: [1, 5], 6: [1, 2, 6]}
    assert graph.paths(graph.shortest_paths(e, 4), 4).count() == 1 and graph.paths(graph.shortest_paths(e, 99), 99).count() == 0


def test_edge_details_and_removal_where_seq_is_shared(spark):
    e = spark.createDataFrame([(1, 1, 2, 5.0), (1, 2, 3, 6.0), (2, 1, 2, 7.0)], graph.EDGES)
    assert {tuple(r) for r in graph.edge_details(e, 1).collect()} == {(1, 1, 2, 5.0), (2, 1, 2, 7.0)}
    left, look = graph.remove_edge(e, 1, 2)
    assert {tuple(r) for r in left.collect()} == {(1, 2, 3, 6.0), (2, 1, 2, 7.0)} and look.count() == 1


def test_registered_nodes_only(spark, edges):
    nodes = spark.createDataFrame([(1, ""), (2, ""), (4, "")], graph.NODES)
    assert graph.shortest_path(edges, 1, 4, nodes) == ([1, 2, 4], 7.0)


def test_negative_weight_is_an_error(spark):
    e = spark.createDataFrame([(0, 1, 2, -1.0)], graph.EDGES)
    with pytest.raises(ValueError):
        graph.shortest_paths(e, 1)


def test_strongly_connected(spark):
    e = spark.createDataFrame([(0, 1, 2, 1.0), (1, 2, 1, 1.0), (2, 2, 3, 1.0)], graph.EDGES)
    assert {r.node for r in graph.strongly_connected(e, 1).collect()} == {1, 2}


def test_plot(spark, edges):
    nodes = spark.createDataFrame([(1, "a"), (2, "b")], graph.NODES)
    assert sinks.plot_edges(edges, nodes).count() == 1 and {r.out_degree for r in sinks.plot_nodes(nodes, edges).collect()} == {1, 2}


def test_empty(spark):
    nodes, e = graph.empty(spark)
    assert graph.size(e, nodes).first()[0] == 0 and graph.neighbors(e).count() == 0
