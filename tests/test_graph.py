"""Shortest paths region by region against a plain priority queue."""

import heapq
import random
import re

import pytest

from wakeline.operators import graph

SCHEMA = "src struct<lat:bigint,lon:bigint>, dst struct<lat:bigint,lon:bigint>, w double"


def street_grid(n, seed, drop=0.2):
    rng, out = random.Random(seed), []
    for i in range(n):
        for j in range(n):
            for a, b in ((i + 1, j), (i, j + 1)):
                if a < n and b < n and rng.random() > drop:
                    w = float(rng.randint(1, 9))
                    out += [((i, j), (a, b), w), ((a, b), (i, j), w)]
    return out


def dijkstra(edges, start):
    near = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
    dist, queue = {start: 0.0}, [(0.0, start)]
    while queue:
        d, n = heapq.heappop(queue)
        if d > dist[n]:
            continue
        for b, w in near.get(n, []):
            if d + w < dist.get(b, float("inf")):
                dist[b] = d + w
                heapq.heappush(queue, (d + w, b))
    return dist


def node(spark, at):
    return spark.createDataFrame([(at,)], "node struct<lat:bigint,lon:bigint>")


@pytest.mark.parametrize("per_region", [10, 60, 10_000])
def test_like_a_plain_queue(spark, per_region):
    edges = street_grid(12, per_region)
    edges += [((0, 0), (11, 11), 500.0), ((3, 3), (3, 3), 0.0), ((0, 0), (0, 1), 3.0), ((0, 0), (0, 1), 1.0), ((90, 90), (91, 90), 1.0)]
    df = spark.createDataFrame(edges, SCHEMA)
    got = {tuple(r.node): (r.dist, tuple(r.prev)) for r in graph.regional_distances(df, node(spark, (0, 0)), per_region=per_region).collect()}
    want = dijkstra(edges, (0, 0))
    assert {n: d for n, (d, _) in got.items()} == want
    w = {}
    for a, b, c in edges:
        w[a, b] = min(c, w.get((a, b), c))
    for n, (d, p) in got.items():
        # The smallest of the nodes that lie on a shortest way.
        assert p == n if n == (0, 0) else p == min(a for (a, b), c in w.items() if b == n and a in want and want[a] + c == d and c > 0)


def test_target_and_odd_starts(spark):
    edges = street_grid(10, 1, 0.0)
    df = spark.createDataFrame(edges, SCHEMA)
    want = dijkstra(edges, (0, 0))
    got = {tuple(r.node): r.dist for r in graph.regional_distances(df, node(spark, (0, 0)), target=node(spark, (4, 4)), per_region=15).collect()}
    assert got[4, 4] == want[4, 4]
    assert [(tuple(r.node), r.dist) for r in graph.regional_distances(df, node(spark, (50, 50))).collect()] == [((50, 50), 0.0)]
    assert graph.regional_distances(df.limit(0), node(spark, (0, 0)).limit(0)).count() == 0


def test_a_large_grid_settles_in_few_rounds(spark):
    """10^5 nodes in some thirty regions: fewer than 50 rounds, where hops would be hundreds."""
    edges = street_grid(317, 5, 0.1)
    df = spark.createDataFrame(edges, SCHEMA)
    got = graph.regional_distances(df, node(spark, (0, 0)), per_region=4000, max_rounds=50)
    want = dijkstra(edges, (0, 0))
    assert {tuple(r.node): r.dist for r in got.select("node", "dist").toLocalIterator()} == want


def test_nodes_are_not_broadcast(spark, monkeypatch):
    """Rounds hand round lists of regions; joins by node are dealt, so the driver never holds a region's nodes."""
    plans = []

    def seen(make):
        def run(df):
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return make(df)

        return run

    for name in ("checkpoint", "written"):
        if hasattr(graph, name):
            monkeypatch.setattr(graph, name, seen(getattr(graph, name)))
    n = 300
    rows = [((0, k), (0, k + step), 1.0) for k in range(n) for step in (-1, 1) if 0 <= k + step < n]
    line = spark.createDataFrame(rows, "src struct<lat:bigint,lon:bigint>, dst struct<lat:bigint,lon:bigint>, w double")
    out = graph.regional_distances(line, spark.createDataFrame([((0, 0),)], "node struct<lat:bigint,lon:bigint>"), per_region=100)
    assert sorted((r.node.lon, r.dist, r.prev.lon) for r in out.collect()) == [(k, float(k), max(0, k - 1)) for k in range(n)]
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 6 and not [p for p in plans if re.search(r"BroadcastHashJoin \[(node|src|dst|prev)#", p)]



def line(spark, n, w=1.0):
    rows = [((0, k), (0, k + step), w) for k in range(n) for step in (-1, 1) if 0 <= k + step < n]
    return spark.createDataFrame(rows, SCHEMA)


def test_rounds_write_labels_of_borders_alone(spark, monkeypatch):
    """What rounds write follows from borders and not from the nodes known so far, which grow from round to round."""
    rows, make = [], graph.written

    def seen(df):
        out = make(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(graph, "written", seen)
    n = 1000
    out = graph.regional_distances(line(spark, n), node(spark, (0, 0)), per_region=100)
    assert sorted((r.node.lon, r.dist, r.prev.lon) for r in out.collect()) == [(k, float(k), max(0, k - 1)) for k in range(n)]
    # The edges once, the result once, and beyond them a few labels a round.
    assert sum(rows) < 4 * n


def test_predecessors_form_no_ring_without_length(spark):
    n = 60
    got = {r.node.lon: (r.dist, r.prev.lon) for r in graph.regional_distances(line(spark, n, 0.0), node(spark, (0, n - 1)), per_region=10).collect()}
    assert got == {k: (0.0, min(k + 1, n - 1)) for k in range(n)}
