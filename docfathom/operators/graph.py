"""Consistency graph: edges from similarity and shared values, filters, and graph analytics.

Iterative operators keep one table of node state, cut by checkpoint() after each step (a driver-side loop over plans, no
rows); components come from star contraction. Betweenness and exact distances give every worker the graph's arrays and share out the sources; they
refuse more than MAX_COMPONENT edges. Communities and distances are in operators.communities.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, free, with_checkpoints

MAX_COMPONENT = 2_000_000
#: Nodes of one value that are joined with as many others under one key.
BLOCK = 200
#: Pairs of nodes with a common value that a task counts, about.
PAIRS = 4_000_000
#: Nodes, with copies, that shortest paths are looked for in at once, or one component.
TOGETHER = 1 << 16
#: Values of a node whose pairs are counted under one key.
SHARE = 4096
# Severity by relationship, and synonyms of relationships.
SEVERITY = {"conflict": 1.0, "partial_conflict": 0.6, "duplicate": 0.3, "consistent": 0.0}
SYNONYMS = {
    "consistent": "consistent", "fully consistent": "consistent", "mostly consistent": "consistent", "aligned": "consistent", "fully aligned": "consistent",
    "partial_conflict": "partial_conflict", "partially conflicting": "partial_conflict", "partially inconsistent": "partial_conflict",
    "partially consistent": "partial_conflict", "partially aligned": "partial_conflict", "minor conflict": "partial_conflict", "minor discrepancy": "partial_conflict",
    "conflict": "conflict", "conflicting": "conflict", "fully conflicting": "conflict", "direct conflict": "conflict", "contradiction": "conflict",
    "contradictory": "conflict", "duplicate": "duplicate", "duplicates": "duplicate", "duplicated": "duplicate", "near duplicate": "duplicate",
}


def relationship(label: Column) -> Column:
    """The known relationship a label means; consistent if it says nothing."""
    low = F.lower(F.trim(label))
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair]), low)
    rules = (F.when(low.contains("duplicate"), "duplicate").when(low.contains("conflict") | low.contains("contradic"), "conflict")
             .when(low.contains("partial") | low.contains("minor"), "partial_conflict").otherwise("consistent"))
    return F.coalesce(known, rules)


def severity(rel: Column, confidence: Column, similarity: Column) -> Column:
    base = F.try_element_at(F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair]), rel)
    return F.coalesce(base, F.lit(0.0)) * confidence * similarity


def worth_checking(similarity: Column, a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Pairs that a model should look at: similarity 0.5 to 0.9, code of one language with shared dependencies, like types."""
    code = a["category"].contains("code") & b["category"].contains("code")
    other_language = (a["language"] != "") & (b["language"] != "") & (F.lower(a["language"]) != F.lower(b["language"]))
    nothing_shared = (F.size(a["deps"]) > 0) & (F.size(b["deps"]) > 0) & ~F.arrays_overlap(a["deps"], b["deps"])
    types = (a["type"] != "") & (b["type"] != "") & (F.lower(a["type"]) != F.lower(b["type"])) & ~F.lower(F.concat(a["type"], b["type"])).contains("config")
    return similarity.between(0.5, 0.9) & ~(code & (other_language | nothing_shared)) & ~types


def canonical(edges: DataFrame) -> DataFrame:
    """Edges (a, b, severity, ...) with a < b, of doubles the one of most severity."""
    a, b = F.least("a", "b"), F.greatest("a", "b")
    rows = edges.where("a <> b").withColumn("_b", b).withColumn("a", a).withColumn("b", F.col("_b")).drop("_b")
    order = Window.partitionBy("a", "b").orderBy(F.desc("severity"))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def directed(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, as (u, v, ...)."""
    rest = [c for c in edges.columns if c not in ("a", "b")]
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v"), *rest).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"), *rest))


def conflict_score(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    total = directed(edges).groupBy("u").agg(F.sum("severity").alias("s"))
    return nodes.join(total, F.col("node") == F.col("u"), "left").select("node", F.coalesce("s", F.lit(0.0)).alias("conflict"))


def shared_value_edges(rows: DataFrame, most: int | None = None) -> DataFrame:
    """(a, b, shared) of rows (node, value): all pairs that share values and how many.

    Nodes of a common value are dealt into blocks of about BLOCK, and each two blocks are joined under a key of their own, so
    that no task holds all pairs of a value. Only where `most` is given, a value of over `most` nodes links its nodes to its
    first one alone, so that a common value gives a star and not all its pairs."""
    rows = cut(rows.dropna(subset=["node", "value"]).select("node", "value").distinct())  # read twice
    free(rows.sparkSession)
    sizes = cut(rows.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first")).where("n > 1"))  # a value of one node has no pair
    sized = rows.join(sizes.hint("merge"), "value")  # a table of values doesn't go through the driver
    small = sized if most is None else sized.where(F.col("n") <= most)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = small.select("value", "node", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("at"))
    left = dealt.select("value", F.col("at").alias("i"), F.explode(F.sequence(F.col("at"), F.col("blocks") - 1)).alias("j"), F.col("node").alias("u"))
    right = dealt.select("value", F.explode(F.sequence(F.lit(0), F.col("at"))).alias("i"), F.col("at").alias("j"), F.col("node").alias("v"))
    pairs = left.join(right, ["value", "i", "j"]).where("i < j or u < v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    if most is not None:
        pairs = pairs.unionByName(sized.where((F.col("n") > most) & (F.col("node") != F.col("first"))).select(F.col("first").alias("a"), F.col("node").alias("b")))
    # a number of parts by the number of pairs: a part's counts fit into a task's memory whatever the table's size, and no table of counts is built before the shuffle
    n = F.least("n", F.lit(most)) if most is not None else F.col("n")
    total = sizes.agg(F.sum(n.cast("double") * (n - 1) / 2)).first()[0] or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total // PAIRS) + 1)
    return pairs.repartition(parts, "a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def value_overlap(rows: DataFrame) -> DataFrame:
    """(a, b, weight) of rows (node, value): all pairs a < b that share values, and the shared ones as a part of the values of the end that has more.

    A pair is counted at that end, of equal ones at the larger node. An end gets, for each value, one row with a list of its others, and its own number of values: pairs are made
    after the shuffle, not before, and need no join for the numbers. Nodes of a value are dealt into blocks of about BLOCK, each two of which meet by themselves; the
    others of an end of over SHARE values are dealt into parts."""
    rows = cut(rows.where("node is not null").select("node", "value").distinct())  # read four times
    free(rows.sparkSession)
    held = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.where("value is not null")
    sizes = rows.groupBy("value").agg(F.count(F.lit(1)).alias("size"))
    common = sizes.where(F.col("size") > BLOCK).select("value", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    dealt = rows.join(held, "node").join(common, "value", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("at", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = dealt.select("value", "node", "n", "at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k")).select("value", "node", "n", "at", F.least("at", "k").alias("i"), F.greatest("at", "k").alias("j"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = dealt.repartition(parts, "value", "i", "j").groupBy("i", "j", "value").agg(F.sort_array(F.collect_list(F.struct("n", "node", "at"))).alias("met"))
    ends = met.select("i", "j", "met", F.posexplode("met").alias("k", "e")).where("k > 0")
    across = F.transform(F.filter(F.slice("met", F.lit(1), F.col("k")), lambda x: x["at"] != F.col("e.at")), lambda x: x["node"])
    ends = ends.select(F.col("e.node").alias("end"), F.col("e.n").alias("n"), F.when(F.col("i") == F.col("j"), F.slice("met.node", F.lit(1), F.col("k"))).otherwise(across).alias("others"))
    shares = F.ceil(F.col("n") / SHARE)
    ends = ends.select("end", "n", "others", shares.alias("shares"), F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("share"))
    own = F.filter("others", lambda x: F.pmod(F.xxhash64(x), F.col("shares")) == F.col("share"))
    ends = ends.select("end", "n", "share", F.when(F.col("shares") == 1, F.col("others")).otherwise(own).alias("others")).where(F.size("others") > 0)
    total = sizes.agg(F.sum(F.col("size").cast("double") * (F.col("size") - 1) / 2)).first()[0] or 0
    pairs = ends.repartition(max(parts, int(total // PAIRS) + 1), "end", "share").select("end", "n", "share", F.explode("others").alias("other"))
    counts = pairs.groupBy("end", "n", "share", "other").agg(F.count(F.lit(1)).alias("shared"))
    return counts.select(F.least("end", "other").alias("a"), F.greatest("end", "other").alias("b"), (F.col("shared") / F.col("n")).alias("weight"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    return edges.join(nodes.select(F.col("node").alias("a")), "a", "left_semi").join(nodes.select(F.col("node").alias("b")), "b", "left_semi")


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(node, hop): nodes within so many hops of the seeds, with the least number."""
    both = directed(edges.select("a", "b"))
    seen = seeds.select("node", F.lit(0).alias("hop")).distinct()
    for hop in range(1, hops + 1):
        reached = seen.where(F.col("hop") == hop - 1).join(both, F.col("node") == F.col("u")).select(F.col("v").alias("node")).distinct()
        seen = seen.unionByName(reached.join(seen, "node", "left_anti").withColumn("hop", F.lit(hop)))
    return seen


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable; star contraction, a number of steps that grows with the logarithm."""
    with_checkpoints(nodes.sparkSession)
    now = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().checkpoint()
    mark = None
    while True:
        said = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if said == mark or not said[0]:
            break
        mark = said
        both = directed(now)
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        now = small.unionByName(low.select(F.col("m").alias("a"), "b")).distinct().checkpoint()
    return nodes.select("node").distinct().join(now, F.col("node") == F.col("b"), "left").select("node", F.coalesce("a", "node").alias("component"))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(node, rank) after so many rounds; nodes without an edge share their rank among all."""
    with_checkpoints(nodes.sparkSession)
    n = nodes.count()
    both = directed(edges.select("a", "b"))
    out = both.groupBy("u").agg(F.count(F.lit(1)).alias("degree"))
    links = both.join(out, "u").checkpoint()
    rank = nodes.select("node", F.lit(1.0 / max(1, n)).alias("rank"))
    for k in range(rounds):
        lone = F.broadcast(rank.join(out, F.col("node") == F.col("u"), "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lone")))  # one row
        got = links.join(rank, F.col("u") == F.col("node")).groupBy("v").agg(F.sum(F.col("rank") / F.col("degree")).alias("got"))
        rank = nodes.join(got, F.col("node") == F.col("v"), "left").crossJoin(lone).select("node", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lone") / n)).alias("rank"))
        rank = rank.checkpoint()  # the next round reads it twice
    return rank


def eigenvector(nodes: DataFrame, edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(node, centrality): power iteration of A + I, of length one."""
    with_checkpoints(nodes.sparkSession)
    both = directed(edges.select("a", "b"))
    x = nodes.select("node", F.lit(1.0).alias("x"))
    for k in range(rounds):
        got = both.join(x, F.col("v") == F.col("node")).groupBy("u").agg(F.sum("x").alias("got"))
        y = x.join(got, F.col("node") == F.col("u"), "left").select("node", (F.col("x") + F.coalesce("got", F.lit(0.0))).alias("y"))
        norm = F.broadcast(y.agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("norm")))  # one row
        x = y.crossJoin(norm).select("node", (F.col("y") / F.col("norm")).alias("x"))
        x = x.checkpoint()  # the next round reads it twice
    return x.withColumnRenamed("x", "centrality")


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, label): each round the most frequent label of the neighbours, the smallest of equals; all nodes at once."""
    with_checkpoints(nodes.sparkSession)
    both = directed(edges.select("a", "b"))
    label = nodes.select("node", F.col("node").alias("label"))
    for k in range(rounds):
        votes = both.join(label, F.col("v") == F.col("node")).groupBy("u", "label").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("u").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("best"))
        label = label.join(best, F.col("node") == F.col("u"), "left").select("node", F.coalesce("best", "label").alias("label"))
        label = label.checkpoint()  # the next round reads it twice
    return label


def triangles(edges: DataFrame) -> DataFrame:
    """(node, triangles): edges point to the end of higher degree, so a hub has few out-edges to pair."""
    simple = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    degree = directed(simple).groupBy("u").agg(F.count(F.lit(1)).alias("d"))
    with_d = simple.join(degree.select(F.col("u").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("u").alias("b"), F.col("d").alias("db")), "b")
    forward = F.struct("da", "a") < F.struct("db", "b")
    out = with_d.select(F.when(forward, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("y"))
    wedge = out.join(out.select("x", F.col("y").alias("z")), "x").where("y < z")
    closed = wedge.join(simple.select(F.col("a").alias("y"), F.col("b").alias("z")), ["y", "z"])
    return closed.select(F.explode(F.array("x", "y", "z")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("triangles"))


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, degree, clustering): 2 T / (d (d - 1)), 0 under two neighbours."""
    degree = directed(edges.select("a", "b").distinct()).groupBy("u").agg(F.count(F.lit(1)).alias("d"))
    rows = nodes.join(degree, F.col("node") == F.col("u"), "left").drop("u").join(triangles(edges), "node", "left")
    d = F.coalesce("d", F.lit(0))
    value = F.when(d > 1, 2 * F.coalesce("triangles", F.lit(0)) / (d * (d - 1))).otherwise(0.0)
    return rows.select("node", d.alias("degree"), value.alias("clustering"))


def strength(edges: DataFrame, mode: str = "parity") -> DataFrame:
    """Edges with jaccard, preferential attachment and weight * (1 + jaccard). parity: link-prediction scores are of pairs
    without an edge, so an edge's jaccard is 0; true: the share of common neighbours."""
    both = directed(edges.select("a", "b"))
    degree = both.groupBy("u").agg(F.count(F.lit(1)).alias("d"))
    rows = edges.join(degree.select(F.col("u").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("u").alias("b"), F.col("d").alias("db")), "b")
    if mode == "parity":
        common = F.lit(0)
    else:
        shared = edges.select("a", "b").join(both.select(F.col("u").alias("a"), "v"), "a").join(both.select(F.col("u").alias("b"), "v"), ["b", "v"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
        rows, common = rows.join(shared, ["a", "b"], "left"), F.coalesce("common", F.lit(0))
    jaccard = common / (F.col("da") + F.col("db") - common)
    return rows.withColumn("jaccard", jaccard).withColumn("attachment", F.when(F.lit(mode == "parity"), 0).otherwise(F.col("da") * F.col("db"))).withColumn("combined", F.col("weight") * (1 + F.col("jaccard")))


def arrays(edges: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, starts, near) of a graph of at most MAX_COMPONENT edges (a, b): sorted names of nodes with edges, and for each one the places of its neighbours."""
    simple = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if simple.limit(MAX_COMPONENT + 1).count() > MAX_COMPONENT:
        raise ValueError("a graph too large for each worker to hold")
    rows = simple.toPandas()
    ids = np.unique(np.concatenate([rows["a"], rows["b"]])) if len(rows) else np.empty(0, object)
    ends = np.stack([np.searchsorted(ids, rows[c]) for c in ("a", "b")]) if len(rows) else np.empty((2, 0), int)
    both = np.concatenate([ends, ends[::-1]], axis=1)
    both = both[:, np.argsort(both[0], kind="stable")]
    return ids, np.searchsorted(both[0], np.arange(len(ids) + 1)), both[1]


def arcs_of(nodes: np.ndarray, first: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(u, v): all arcs from the nodes, in their order."""
    n = first[nodes + 1] - first[nodes]
    at = np.arange(n.sum()) + np.repeat(first[nodes] - np.cumsum(n) + n, n)
    return np.repeat(nodes, n), near[at]


def dependencies(sources: np.ndarray, first: np.ndarray, near: np.ndarray) -> np.ndarray:
    """For each node the sum over sources of the shares of shortest paths from a source that go through it, by Brandes.

    Sources of small components go together, each with a copy of its component's nodes, TOGETHER nodes or one source at a time: a source in a small component
    costs few calls of its own. Nodes of a component are numbered one after another; those reached are told apart by marks, not by sorting."""
    n = len(first) - 1
    if not len(sources):
        return np.zeros(n)
    label = np.arange(n)
    while True:  # the least number of each component; every node has an arc
        least = np.minimum(label, np.minimum.reduceat(label[near], first[:-1]))
        least = np.minimum(least, least[least])
        if (least == label).all():
            break
        label = least
    order = np.argsort(label, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    degree, near, label = np.diff(first)[order], rank[arcs_of(order, first, near)[1]], label[order]
    first, start = np.append(0, np.cumsum(degree)), np.searchsorted(label, label)
    size = np.searchsorted(label, label, "right") - start
    sources = rank[sources]
    sources = sources[np.argsort(size[sources], kind="stable")]
    total, low = np.zeros(n), 0
    while low < len(sources):
        part = sources[low : low + max(1, int(np.searchsorted(np.cumsum(size[sources[low : low + TOGETHER]]), TOGETHER, "right")))]
        low += len(part)
        sizes, starts = size[part], start[part]
        at = np.cumsum(sizes) - sizes
        back = np.repeat(at - starts, sizes)  # a copy's number less the node's own
        paths, share, mark, free = np.zeros(len(back)), np.zeros(len(back)), np.empty(len(back), np.int64), np.ones(len(back), bool)
        layer, steps = part + at - starts, []
        paths[layer], free[layer] = 1, False
        while True:  # a layer at a time: arcs from it to nodes not reached before
            apart = back.take(layer)
            node = layer - apart
            many = degree.take(node)
            own = np.repeat(np.arange(len(layer)), many)
            v = near.take(np.arange(len(own)) + np.repeat(first.take(node) - np.cumsum(many) + many, many)) + np.repeat(apart, many)
            new = np.flatnonzero(free.take(v))
            if not len(new):
                break
            own, v, count = own.take(new), v.take(new), np.arange(len(new))
            mark[v] = count
            last = mark.take(v)
            one = last == count
            after, place = v.take(np.flatnonzero(one)), (np.cumsum(one) - 1).take(last)
            steps.append((layer, own, after, place))
            paths[after], free[after] = np.bincount(place, paths.take(layer).take(own), len(after)), False
            layer = after
        for layer, own, after, place in steps[::-1]:
            share[layer] = paths.take(layer) * np.bincount(own, ((1 + share.take(after)) / paths.take(after)).take(place), len(layer))
        share[part + at - starts] = 0
        np.add.at(total, np.arange(len(back)) - back, share)
    out = np.empty(n)
    out[order] = total
    return out


def betweenness(nodes: DataFrame, edges: DataFrame, k: int | None = None) -> DataFrame:
    """(node, betweenness): Brandes from every node, or from k of them (the smallest hashes), scaled up. Every worker holds the graph's
    arrays, which are bounded by MAX_COMPONENT edges; the sources are shared out. A source costs what it reaches."""
    spark, n = nodes.sparkSession, nodes.count()
    shared = spark.sparkContext.broadcast(arrays(edges))
    chosen = nodes.select("node") if k is None else nodes.select("node").orderBy(F.xxhash64("node"), "node").limit(k)
    scale = 1.0 if k is None else n / max(1, min(k, n))

    def run(frames):
        ids, first, near = shared.value
        asked = np.concatenate([ids[:0], *(frame["node"].dropna().to_numpy() for frame in frames)])
        at = np.searchsorted(ids, asked)
        there = at < len(ids)
        there[there] = ids[at[there]] == asked[there]
        total = dependencies(at[there], first, near)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"node": ids[at], "value": total[at]})

    kind = dict(nodes.dtypes)["node"]
    found = chosen.repartition(max(1, spark.sparkContext.defaultParallelism)).mapInPandas(run, f"node {kind}, value double").groupBy("node").agg((F.sum("value") * scale / max(1, (n - 1) * (n - 2))).alias("betweenness"))
    return nodes.select("node").join(found, "node", "left").fillna({"betweenness": 0.0})


def leanings(clusters: DataFrame, edges: DataFrame, weight: Column, least: float) -> DataFrame:
    """(node, cluster, weight): clusters (node, cluster) other than its own that a node's edges to weigh `least` or more on average."""
    both = directed(edges.select("a", "b", weight.alias("w")))
    at = lambda side, name: clusters.select(F.col("node").alias(side), F.col("cluster").alias(name)).hint("merge")  # noqa: E731  nothing goes through the driver
    there = both.join(at("v", "cluster"), "v").join(at("u", "own"), "u").where("cluster <> own")
    return there.groupBy(F.col("u").alias("node"), "cluster").agg(F.avg("w").alias("weight")).where(F.col("weight") >= least)


def topology(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, mean clustering, components and size of the largest."""
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    e = edges.select("a", "b").distinct().agg(F.count(F.lit(1)).alias("m"))
    c = clustering(nodes, edges).agg(F.avg("clustering").alias("clustering"))
    k = components(nodes, edges).groupBy("component").agg(F.count(F.lit(1)).alias("s")).agg(F.count(F.lit(1)).alias("components"), F.max("s").alias("largest"))
    row = n.crossJoin(e).crossJoin(c).crossJoin(k)  # one row each
    return row.withColumn("density", F.coalesce(F.try_divide(2 * F.col("m"), F.col("n") * (F.col("n") - 1)), F.lit(0.0)))


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, layer) of a directed graph (u, v): nodes without open predecessors are peeled off; what is left comes last."""
    with_checkpoints(nodes.sparkSession)
    left, arcs, done, k = nodes.select("node"), edges.select("u", "v").distinct(), None, 0
    while True:
        free = left.join(arcs, F.col("node") == F.col("v"), "left_anti").checkpoint()
        if free.isEmpty():
            break
        part = free.withColumn("layer", F.lit(k))
        done = part if done is None else done.unionByName(part)
        left = left.join(free, "node", "left_anti").checkpoint()
        arcs = arcs.join(free, F.col("u") == F.col("node"), "left_anti").checkpoint()
        k += 1
    rest = left.withColumn("layer", F.lit(k))
    return rest if done is None else done.unionByName(rest)
