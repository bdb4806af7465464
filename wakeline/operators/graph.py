"""Road graphs: edges from ways, nearest nodes, shortest paths by relaxation or region by region."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wakeline.functions.geo import haversine, micro
from wakeline.session import checkpoint, written, written_by

# The classes of ways of the two profiles.
DRIVABLE = (
    "motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "service", "living_street",
    "motorway_link", "trunk_link", "primary_link", "secondary_link",
)
WALKABLE = (*DRIVABLE, "footway", "path", "pedestrian", "track", "steps")


def edges(ways: DataFrame, allowed=DRIVABLE) -> DataFrame:
    """(src_lat, src_lon, dst_lat, dst_lon in millionths, w metres): both directions, parallel edges kept."""
    x = ways.filter(F.try_element_at("tags", F.lit("highway")).isin(*allowed)).select(F.transform("points", lambda p: F.struct(micro(p["lat"]).alias("lat"), micro(p["lon"]).alias("lon"))).alias("p"))
    x = x.filter(F.size("p") >= 2).select(F.explode(F.arrays_zip(F.slice("p", F.lit(1), F.size("p") - 1).alias("a"), F.slice("p", F.lit(2), F.size("p") - 1).alias("b"))).alias("e"))
    x = x.select("e.a", "e.b").filter("a != b")
    w = haversine(F.col("a.lat") / 1e6, F.col("a.lon") / 1e6, F.col("b.lat") / 1e6, F.col("b.lon") / 1e6)
    x = x.select("a", "b", w.alias("w"))
    # By a generator, so that the ways are made once and not once a direction.
    return x.select(F.inline(F.array(*[F.struct(F.col(p).alias("src"), F.col(q).alias("dst"), "w") for p, q in (("a", "b"), ("b", "a"))])))


def nearest_node(graph: DataFrame, lat: float, lon: float):
    """The node (struct) nearest to a position, the smallest on ties; null for an empty graph."""
    at = haversine(F.lit(lat), F.lit(lon), F.col("src.lat") / 1e6, F.col("src.lon") / 1e6)
    return graph.select("src").distinct().agg(F.min_by("src", F.struct(at, "src")).alias("node")).select("node")


def distances(graph: DataFrame, starts: DataFrame, max_rounds: int = 10_000, target: DataFrame | None = None) -> DataFrame:
    """(node, dist, prev): shortest distance from the nearest of ``starts`` (node) to every node reached.

    ``graph`` has src, dst (any comparable type) and w >= 0. Each round joins the nodes that improved
    with their edges and keeps the least per node, ties to the smaller predecessor; states are written to the shared
    folder, and the driver sees one row a round. With a ``target`` (node) the rounds end once no open node is nearer
    than it: its distance is right then, and those of nodes beyond it may not be.
    """
    best_edges = checkpoint(graph.groupBy("src", "dst").agg(F.min("w").alias("w")))
    known = checkpoint(starts.select("node").distinct().select("node", F.lit(0.0).cast("double").alias("dist"), F.col("node").alias("prev")))
    front = known
    for _ in range(max_rounds):
        step = front.join(best_edges, front["node"] == best_edges["src"]).select(F.col("dst").alias("node"), (F.col("dist") + F.col("w")).alias("dist"), F.col("src").alias("prev"))
        step = step.groupBy("node").agg(F.min(F.struct("dist", "prev")).alias("s")).select("node", "s.dist", "s.prev")
        old = known.select("node", F.col("dist").alias("_old"))
        better = checkpoint(step.join(old, "node", "left").filter("_old is null or dist < _old").select("node", "dist", "prev"))
        nearest = better.agg(F.min("dist")).first()[0]
        if nearest is None:
            return known
        known = checkpoint(known.join(better.select("node"), "node", "left_anti").unionByName(better))
        if target is not None and (there := known.join(target.select("node").distinct(), "node").agg(F.max("dist")).first()[0]) is not None:
            better = better.filter(F.col("dist") < there)
            if nearest >= there:
                return known
        front = better
    raise RuntimeError(f"distances did not settle in {max_rounds} rounds")


#: Nodes of a region, about.
PER_REGION = 250_000
LABELS = "part int, node long, dist double, still int, prev long"
#: A region: its nodes in order, nodes beyond its border and their regions, edges by source as numbers of nodes (first those inside), nodes whose labels others need.
PACKED = "part int, own array<bigint>, far array<bigint>, far_part array<int>, starts array<int>, dst array<int>, w array<double>, marks array<int>"


def _flat(node):
    """A node (lat, lon in millionths) as one number."""
    return F.col(f"{node}.lat").cast("long") * 1_000_000_000 + F.col(f"{node}.lon")


def _unflat(node: str):
    """The latitude and longitude of a node given as one number."""
    lon = f"(pmod({node} + 500000000, 1000000000) - 500000000)"
    return F.expr(f"({node} - {lon}) div 1000000000"), F.expr(lon)


def _dealer(edges: DataFrame, per_region: int):
    """A function that adds the regions of nodes: bands of latitude, cut by longitude, with about as many edges each.

    The driver sees the bounds of regions alone.
    """
    from pyspark.ml.feature import Bucketizer  # here, so that workers do without the package

    regions = -(-edges.agg(F.approx_count_distinct("src")).first()[0] // per_region)
    if regions < 2:
        return lambda df, **nodes: df.withColumns({name: F.lit(0) for name in nodes})
    shares = lambda n: [k / n for k in range(1, n)]
    near = max(10_000, 100 * regions)

    def cut(df, names, bounds):
        return Bucketizer(splitsArray=[bounds] * len(names), inputCols=names, outputCols=[f"{c}_cut" for c in names]).transform(df)

    def banded(df, bounds, nodes):
        places = {name: _unflat(node) for name, node in nodes.items()}
        df = cut(df.withColumns({f"_{name}": lat.cast("double") for name, (lat, _) in places.items()}), [f"_{name}" for name in nodes], bounds)
        # Bands side by side on one axis.
        return df.withColumns({f"_{name}": F.col(f"_{name}_cut") * 1e9 + lon for name, (_, lon) in places.items()})

    lats = edges.agg(F.percentile_approx(_unflat("src")[0], shares(1 + math.isqrt(regions)), near)).first()[0]
    bands = [-math.inf, *sorted({float(c) for c in lats}), math.inf]
    found = banded(edges, bands, {"at": "src"}).groupBy("_at_cut").agg(F.count("*").alias("n"), F.percentile_approx("_at", shares(regions), near).alias("cuts")).collect()
    bounds, all_ = {-math.inf, math.inf}, sum(r.n for r in found)
    for r in found:
        parts = max(1, round(r.n / all_ * regions))
        bounds |= {r["_at_cut"] * 1e9 - 5e8, *(r.cuts[min(len(r.cuts) - 1, round(share * regions) - 1)] for share in shares(parts))}
    bounds = sorted(bounds)

    def deal(df: DataFrame, **nodes: str) -> DataFrame:
        names = [f"_{name}" for name in nodes]
        df = cut(banded(df, bands, nodes).drop(*(f"{c}_cut" for c in names)), names, bounds)
        return df.withColumns({name: F.col(f"_{name}_cut").cast("int") for name in nodes}).drop(*names, *(f"{c}_cut" for c in names))

    return deal


def _pack(key: tuple, rows: pa.Table) -> pa.Table:
    """A region's edges, and nodes without an edge (dst null) whose labels others need -> the region as one row."""
    part = key[0].as_py()
    marks = np.unique(rows.filter(pc.is_null(rows["dst"]))["src"].to_numpy())
    rows = rows.filter(pc.is_valid(rows["dst"]))
    src, dst, w, to = (rows[c].to_numpy() for c in ("src", "dst", "w", "to"))
    inside = to == part
    own = np.unique(np.concatenate([src, dst[inside], marks]))
    far, first = np.unique(dst[~inside], return_index=True)
    a, b = np.searchsorted(own, src), np.where(inside, np.searchsorted(own, dst), len(own) + np.searchsorted(far, dst))
    order = np.lexsort((w, b, a))
    a, b, w = a[order], b[order], w[order]
    # The shortest of parallel edges; no edge from a node to itself.
    keep = a != b
    keep[1:] &= (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b, w = a[keep], b[keep], w[keep]
    starts = np.searchsorted(a, np.arange(len(own) + 1))
    columns = {"own": own, "far": far, "far_part": to[~inside][first].astype(np.int32), "starts": starts.astype(np.int32), "dst": b.astype(np.int32), "w": w, "marks": np.searchsorted(own, marks).astype(np.int32)}
    return pa.table({"part": pa.array([part], pa.int32()), **{c: pa.ListArray.from_arrays([0, len(v)], pa.array(v)) for c, v in columns.items()}})


def _settle(key: tuple, rows: pa.Table, packed: pa.Table, whole: bool) -> pa.Table:
    """A region's labels from outside and the region -> labels of all its nodes, or those that others need and those for nodes of other regions.

    ``still`` counts the steps without length at the end of a way: of ways as long the one with fewer is taken, then
    the one from the smaller predecessor, so that predecessors never form a ring.
    """
    part = key[0].as_py()
    own, far, far_part, starts, dst, w, marks = ((packed[c][0].values.to_numpy() if packed.num_rows else np.zeros(0, np.int64)) for c in ("own", "far", "far_part", "starts", "dst", "w", "marks"))
    n, names = len(own), np.concatenate([own, far])
    name, starts, dst, w = own.tolist(), starts.tolist(), dst.tolist(), w.tolist()
    dist, still, prev = [float("inf")] * len(names), [0] * len(names), [0] * len(names)
    given = rows["node"].to_numpy()
    at = np.searchsorted(own, given)
    found = at < n
    found[found] = own[at[found]] == given[found]
    queue = []
    for i, *label in zip(at[found].tolist(), *(rows[c].to_numpy()[found].tolist() for c in ("dist", "still", "prev")), strict=True):
        dist[i], still[i], prev[i] = label
        queue.append((dist[i], still[i], i))
    heapq.heapify(queue)
    while queue:
        d, z, i = heapq.heappop(queue)
        if d > dist[i] or z > still[i]:
            continue  # stale
        me = name[i]
        for k in range(starts[i], starts[i + 1]):
            other, there = dst[k], d + w[k]
            old = dist[other]
            if there > old:
                continue
            step = z + 1 if there == d else 0
            if there < old or step < still[other]:
                dist[other], still[other], prev[other] = there, step, me
                if other < n:
                    heapq.heappush(queue, (there, step, other))
            elif step == still[other] and me < prev[other]:
                prev[other] = me
    dist = np.array(dist, np.float64)
    out = np.arange(n) if whole else np.concatenate([marks, np.arange(n, len(names))])
    out = out[dist[out] < np.inf]
    to = np.concatenate([np.full(n, part), far_part])[out]
    table = {"part": to.astype(np.int32), "node": names[out], "dist": dist[out], "still": np.array(still, np.int32)[out], "prev": np.array(prev, np.int64)[out], "own": out < n}
    table = pa.table(table)
    if whole and not found.all():  # starts without an edge
        alone = rows.select(["part", "node", "dist", "still", "prev"]).filter(pa.array(~found))
        table = pa.concat_tables([table, alone.append_column("own", pa.array([True] * alone.num_rows)).cast(table.schema)])
    return table


def regional_distances(graph: DataFrame, starts: DataFrame, target: DataFrame | None = None, per_region: int = PER_REGION, max_rounds: int = 10_000) -> DataFrame:
    """(node, dist, prev) as ``distances`` gives them, for road graphs of any size: rounds follow from regions, not from hops.

    Nodes are (lat, lon) in millionths, dealt over bands of latitude cut by longitude, about ``per_region`` a
    region, and every region is packed into one row of a folder of its own. A round reads the regions that have new labels
    and no others, runs a priority queue inside each from all labels at its border, and hands labels of nodes beyond the border to
    their regions. Between rounds only labels of nodes at borders are kept; a last pass gives those of all nodes.
    Equal distances keep the smaller predecessor. With a ``target`` (node) labels farther than it are not handed on, once it
    is reached. The driver sees numbers of regions, never nodes, and nothing is broadcast.
    """
    edges = written(graph.select(_flat("src").alias("src"), _flat("dst").alias("dst"), "w").filter("src is not null and dst is not null and w is not null"))
    deal = _dealer(edges, per_region)
    goal = None if target is None else target.select(_flat("node").alias("node")).filter("node is not null").distinct()
    row = F.struct("part", "src", "dst", "w", "to")
    # A node that is entered from another region is told to its own.
    mark = F.when(F.col("part") != F.col("to"), F.struct(F.col("to").alias("part"), F.col("dst").alias("src"), *(F.lit(None).cast(kind).alias(c) for c, kind in (("dst", "long"), ("w", "double"), ("to", "int")))))
    rows = deal(edges, part="src", to="dst").select(F.inline(F.array_compact(F.array(row, mark))))
    if goal is not None:
        rows = rows.unionByName(deal(goal, part="node").select("part", F.col("node").alias("src")), allowMissingColumns=True)
        goals = goal.count()
    packed = written_by(rows.groupBy("part").applyInArrow(_pack, PACKED), "part")
    first = deal(starts.select(_flat("node").alias("node")).filter("node is not null").distinct(), part="node")
    held = written(first.select("part", "node", F.lit(0.0).alias("dist"), F.lit(0).alias("still"), F.col("node").alias("prev"), F.lit(True).alias("fresh")))
    label = F.struct("dist", "still", "prev")

    def settle(labels, regions, whole):
        run = lambda key, rows, packed: _settle(key, rows, packed, whole)
        return labels.drop("fresh").groupBy("part").cogroup(regions.groupBy("part")).applyInArrow(run, f"{LABELS}, own boolean")

    for _ in range(max_rounds):
        fresh = held.filter("fresh")
        if goal is not None:
            there, reached = held.join(goal.hint("merge"), "node").agg(F.max("dist"), F.count("*")).first()
            if reached and reached == goals:
                fresh = fresh.filter(F.col("dist") <= there)
        # Numbers of regions, so that folders of others are not even opened.
        active = [r.part for r in fresh.select("part").distinct().collect()]
        if not active:
            out = written(settle(held, packed, True).select("node", "dist", "prev"))
            place = lambda c: F.struct(*(x.alias(name) for x, name in zip(_unflat(c), ("lat", "lon"), strict=True)))
            return out.select(place("node").alias("node"), "dist", place("prev").alias("prev"))
        on = F.col("part").isin(active)
        both = held.drop("fresh").withColumn("own", F.lit(True)).unionByName(settle(held.filter(on), packed.filter(on), False))
        least = both.groupBy("part", "node").agg(F.min(label).alias("s"), F.min(F.when(F.col("own"), label)).alias("_old"))
        held = written(least.select("part", "node", "s.*", (F.col("_old").isNull() | (F.col("s") < F.col("_old"))).alias("fresh")))
    raise RuntimeError(f"distances did not settle in {max_rounds} rounds")


def routes(reached: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, node, back): every node on the way to each of ``targets`` (node), ``back`` steps before it.

    Predecessors are followed by doubling, so a way of n steps takes log n joins, all targets at once;
    targets that were not reached are absent.
    """
    jump = checkpoint(reached.filter("node != prev").select("node", F.col("prev").alias("far")))
    on = targets.select("node").distinct().join(reached.select("node"), "node").select(F.col("node").alias("target"), "node", F.lit(0).cast("long").alias("back"))
    on, step = checkpoint(on), 1
    while not jump.isEmpty():
        more = on.join(jump, "node").select("target", F.col("far").alias("node"), (F.col("back") + step).alias("back"))
        on = checkpoint(on.unionByName(more))
        jump = checkpoint(jump.select("node", F.col("far").alias("mid")).join(jump.withColumnRenamed("node", "mid"), "mid").select("node", "far"))
        step *= 2
    return on


def route(graph: DataFrame, start: tuple[float, float], end: tuple[float, float]) -> DataFrame:
    """(place, lat, lon, metres) of the shortest way from one position (lat, lon) to another along the graph.

    The first row is the start itself and the last the end; between them lie the nodes, from the one nearest to
    the start to the one nearest to the end. ``metres`` is the length between those two nodes, the same in every row.
    No rows where no way leads there, or where the graph is empty.
    """
    near, far = checkpoint(nearest_node(graph, *start).filter("node is not null")), checkpoint(nearest_node(graph, *end).filter("node is not null"))
    reached = distances(graph, near, target=far)
    way = routes(reached, far)
    n = F.max("back").over(Window.partitionBy("target"))
    nodes = way.select((n - F.col("back") + 1).alias("place"), (F.col("node.lat") / 1e6).alias("lat"), (F.col("node.lon") / 1e6).alias("lon"), n.alias("_n"))
    length = reached.join(far, "node").select(F.col("dist").alias("metres"))
    ends = nodes.groupBy().agg(F.max("_n").alias("_n")).filter("_n is not null")
    ends = ends.select(F.explode(F.array(*[F.struct(place.cast("long").alias("place"), F.lit(at[0]).alias("lat"), F.lit(at[1]).alias("lon")) for place, at in ((F.lit(0), start), (F.col("_n") + 2, end))])).alias("e")).select("e.*")
    # One row on the right: the length of the one way.
    return nodes.drop("_n").unionByName(ends).crossJoin(F.broadcast(length))
