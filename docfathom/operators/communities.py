"""Communities and distances of large graphs: Louvain by aggregations, breadth-first search by bits, neighbourhood sketches.

Each step is a plan over tables of nodes and edges, cut by tables in the shared folder; the driver sees sums. Exact distances alone take a graph of
bounded size to every worker. No other component, community or neighbourhood
goes through one task: a hub's edges are summed by community before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .graph import arrays, components, directed

#: Sources of one search: 64 a word.
WORDS = 16


def _by_key(rows: DataFrame) -> DataFrame:
    """rows for a join by shuffles: small tables of nodes, broadcast in each turn of each level, would go through the driver time and again."""
    return rows.hint("merge")


def modularity(links: DataFrame, label: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of label (node, c) over links (u, v, w), which hold both directions of every edge."""
    at = links.join(_by_key(label.select(F.col("node").alias("u"), F.col("c").alias("cu"))), "u").join(_by_key(label.select(F.col("node").alias("v"), F.col("c").alias("cv"))), "v")
    own = at.groupBy("cu").agg(F.sum("w").alias("all"), F.sum(F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(0.0)).alias("inside"))
    inside, squares, whole = own.agg(F.sum("inside"), F.sum(F.col("all") * F.col("all")), F.sum("all")).first()
    return inside / whole - resolution * squares / whole / whole if whole else 0.0


def _moves(links: DataFrame, label: DataFrame, whole: float, resolution: float, turn: int) -> DataFrame:
    """label (node, c, k) after the nodes whose turn it is have gone where they add most; equals go to the smallest community, and stay if that adds as much."""
    total = label.groupBy("c").agg(F.sum("k").alias("total"), F.count(F.lit(1)).alias("size"))
    near = links.where("u <> v").join(_by_key(label.select(F.col("node").alias("v"), "c")), "v").groupBy("u", "c").agg(F.sum("w").alias("w"))
    own = label.join(_by_key(total), "c").select(F.col("node").alias("u"), F.col("c").alias("own"), "k", F.col("total").alias("own_total"), F.col("size").alias("own_size"))
    cost = lambda weight, total: F.round(weight - resolution * F.col("k") * total / whole, 10)
    # of two nodes alone, only the one of the larger name goes to the other: both would only swap names
    seen = near.join(_by_key(total), "c").join(_by_key(own), "u").where("size > 1 or own_size > 1 or c <= own")
    gain = F.when(F.col("c") == F.col("own"), cost(F.col("w"), F.col("total") - F.col("k"))).otherwise(cost(F.col("w"), F.col("total")))
    best = seen.select("u", "c", "own", "k", "own_total", gain.alias("gain")).groupBy("u").agg(
        F.min_by("c", F.struct(-F.col("gain"), "c")).alias("c"), F.max("gain").alias("gain"), F.max(F.when(F.col("c") == F.col("own"), F.col("gain"))).alias("stay"),
        F.first("k").alias("k"), F.first("own_total").alias("own_total"))
    stay = F.coalesce("stay", cost(F.lit(0.0), F.col("own_total") - F.col("k")))
    going = best.where((F.pmod(F.xxhash64("u", F.lit(turn // 2)), F.lit(2)) == turn % 2) & (F.col("gain") > stay)).select(F.col("u").alias("node"), F.col("c").alias("to"))
    return label.join(_by_key(going), "node", "left").select("node", F.coalesce("to", "c").alias("c"), "k")


def louvain(nodes: DataFrame, edges: DataFrame, weight: Column | None = None, resolution: float = 1.0, rounds: int = 16, levels: int = 8, floor: float = 1e-6) -> DataFrame:
    """(node, community): communities of high modularity, named by their smallest node.

    Nodes move in turns, half of them at a time by a hash, as long as modularity grows; then each community becomes a node, and
    so on. A turn that
    adds nothing is taken back, so no step lowers modularity. weight: of edges (a, b, ...), at least
    `floor`; edges that repeat add up. A node without edges is a community of its own.
    """
    w = F.greatest(F.lit(floor), F.coalesce(weight if weight is not None else F.lit(1.0), F.lit(0.0))).cast("double")
    both = edges.where("a is not null and b is not null").select("a", "b", w.alias("w"))
    links = directed(both.where("a <> b")).unionByName(both.where("a = b").select(F.col("a").alias("u"), F.col("b").alias("v"), (2 * F.col("w")).alias("w")))
    links = cut(links.groupBy("u", "v").agg(F.sum("w").alias("w")))
    whole = links.agg(F.sum("w")).first()[0]
    home = links.select(F.col("u").alias("node")).distinct().select("node", F.col("node").alias("c"))
    best = modularity(links, home, resolution) if whole else 0.0
    for _ in range(levels if whole else 0):
        degree = links.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("k"))
        label = kept = degree.select("node", F.col("node").alias("c"), "k")
        before, idle = best, 0
        for turn in range(rounds):
            label = cut(_moves(links, label, whole, resolution, turn))
            now = modularity(links, label, resolution)
            idle = 0 if now > best + 1e-9 else idle + 1
            if now > best + 1e-9:
                best, kept = now, label
            label = kept  # moves at one time can undo each other's gain
            if idle == 3:
                break
        if best <= before + 1e-9:
            break
        place = kept.select(F.col("node").alias("was"), F.col("c").alias("now"))
        home = cut(home.join(_by_key(place), F.col("c") == F.col("was")).select("node", F.col("now").alias("c")))
        to = lambda side, links=links, place=place: place.select(F.col("was").alias(side), F.col("now").alias(f"c{side}"))
        links = cut(links.join(_by_key(to("u")), "u").join(_by_key(to("v")), "v").groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w")))
    named = home.groupBy("c").agg(F.min("node").alias("community"))
    found = home.join(_by_key(named), "c").select("node", "community")
    return nodes.select("node").distinct().join(_by_key(found), "node", "left").select("node", F.coalesce("community", "node").alias("community"))


def largest_component(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node): the nodes of the largest component, of equals the one of the smallest node."""
    comp = cut(components(nodes, edges))
    largest = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return comp.join(F.broadcast(largest), "component", "left_semi").select("node")


def distances(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(distance, pairs): how many ordered pairs of different nodes are so many edges apart; exact.

    Every worker holds the graph's arrays, which are bounded as for betweenness(). Sources are shared out 64 * WORDS at a time, each a bit of a
    table with a row a node; a step joins by bitwise or the bits of each node's neighbours. That is as many steps as the graph is wide for each
    such block, so it is for graphs of up to some 100,000 nodes; sketched_distances() is for larger ones.
    """
    spark = nodes.sparkSession
    shared, per = spark.sparkContext.broadcast(arrays(edges)), 64 * WORDS

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, first, near = shared.value
        linked = first[:-1]  # a node of the arrays has an edge
        for frame in frames:
            for low in range(0, len(frame), per):
                x = frame["node"].to_numpy()[low : low + per]
                at = np.minimum(np.searchsorted(ids, x), max(0, len(ids) - 1))
                at = at[ids[at] == x] if len(ids) else at[:0]
                seen, k = np.zeros((len(ids), WORDS), np.uint64), np.arange(len(at))
                np.bitwise_or.at(seen, (at, k // 64), np.uint64(1) << (k % 64).astype(np.uint64))
                front, step = seen.copy(), 0
                while len(at):
                    step += 1
                    front = np.bitwise_or.reduceat(front[near], linked, axis=0) & ~seen
                    new = int(np.bitwise_count(front).sum())
                    if not new:
                        break
                    seen |= front
                    yield pd.DataFrame({"distance": [step], "pairs": [new]})

    held = nodes.select("node").distinct().repartition(max(1, spark.sparkContext.defaultParallelism))
    return held.mapInPandas(run, "distance int, pairs long").groupBy("distance").agg(F.sum("pairs").alias("pairs"))


def sketched_distances(nodes: DataFrame, edges: DataFrame, steps: int = 50, size: int = 12) -> DataFrame:
    """(distance, pairs) from sketches of the nodes within each distance: a HyperLogLog of 2 ** size registers a node, with a standard error
    of 1.04 / sqrt(2 ** size) in a node's count (1.6 % for 12), and less in their sum. Stops after `steps` or when no count grows."""
    both = cut(directed(edges.where("a <> b").select("a", "b")).distinct())
    ball = cut(nodes.select("node").distinct().groupBy("node").agg(F.hll_sketch_agg(F.xxhash64("node"), F.lit(size)).alias("s")))
    counts = [float(ball.count())]
    for _ in range(steps):
        near = both.join(ball, F.col("v") == F.col("node")).select(F.col("u").alias("node"), "s").unionByName(ball)
        ball = cut(near.groupBy("node").agg(F.hll_union_agg("s").alias("s")))
        counts.append(float(ball.agg(F.sum(F.hll_sketch_estimate("s"))).first()[0] or 0))
        if counts[-1] <= counts[-2]:
            break
    rows = [(k, round(b - a)) for k, (a, b) in enumerate(zip(counts, counts[1:], strict=False), 1) if b > a]
    return nodes.sparkSession.createDataFrame(rows, "distance int, pairs long")


def path_metrics(nodes: DataFrame, edges: DataFrame, exact_nodes: int = 100_000) -> DataFrame:
    """One row (nodes, diameter, mean_path) of the largest component: exact up to exact_nodes nodes, else from sketches; nulls for a single node."""
    inside = cut(largest_component(nodes, edges))
    links = edges.select("a", "b").join(inside.select(F.col("node").alias("a")), "a", "left_semi")
    n = inside.count()
    held = distances(inside, links) if n <= exact_nodes else sketched_distances(inside, links)
    return held.agg(F.lit(n).cast("long").alias("nodes"), F.max("distance").alias("diameter"), (F.sum(F.col("distance") * F.col("pairs")) / F.sum("pairs")).alias("mean_path"))
