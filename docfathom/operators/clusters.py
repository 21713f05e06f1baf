"""Clusters of vectors: an index of cells for nearest neighbours, sampled graphs, and linkage of vocabularies.

The index is fitted on a bounded sample and covers every row. A search looks into the cells nearest to a query; the exact
search then looks into all that the distances to their middles and their radii don't rule out, by lots of cells: a query goes to a lot once,
however many of its cells are looked into. A cell or lot, however many rows it has, is dealt into blocks, and a task holds two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, free
from .keyword import top
from .vectors import BLOCK, CELLS, JOIN_BLOCK, _unit, close_pairs, nearest_of

#: Rows that the middles of cells are fitted on, and rounds of fitting.
SAMPLE, ROUNDS = 20_000, 8
MOST_CELLS = 4096
#: Copies of rows that single linkage shuffles at a time, about.
COPIES = 8_000_000
#: Clusters of a group, at most, whose merges a task ends by itself.
IN_TASK = 4096


def _middles(m: np.ndarray, cells: int) -> np.ndarray:
    """Unit vectors of the middles of so many groups of unit vectors, begun from rows far from each other."""
    r = np.random.default_rng(7)
    chosen, far = [int(r.integers(len(m)))], np.full(len(m), np.inf)
    while len(chosen) < min(cells, len(m)):
        far = np.minimum(far, 1 - m @ m[chosen[-1]])
        weight = np.maximum(far, 0)
        if not weight.sum() > 1e-9:
            break
        chosen.append(int(r.choice(len(m), p=weight / weight.sum())))
    c = m[chosen]
    for _ in range(ROUNDS):
        own = np.argmax(m @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, m)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-12, total / np.maximum(size, 1e-300), c)
    return c


class CellIndex:
    """An index of rows (id, v) by cosine. rows is read for each search, so it should be a table or a checkpoint."""

    def __init__(self, rows: DataFrame, cells: int | None = None, sample: int = SAMPLE):
        rows = rows.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).where("v is not null")
        n = rows.count()
        cells = min(MOST_CELLS, max(1, round(n**0.5))) if cells is None else cells
        share = min(1.0, 1.2 * sample / max(1, n))
        bound = min((1 << 63) - 1, int((2 * share - 1) * (1 << 63)))
        seen = rows.where(F.xxhash64("id") <= bound).orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
        if n and not len(seen):
            seen = rows.limit(1).toPandas()
        self.middles = _middles(_unit(seen.v), cells) if len(seen) else np.zeros((0, 0))
        self.spark, middles = rows.sparkSession, self.middles

        def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    s = _unit(f.v) @ middles.T
                    own = np.argmax(s, axis=1)
                    yield pd.DataFrame({"id": f.id, "v": f.v, "cell": own, "turn": np.arccos(np.clip(s[np.arange(len(f)), own], -1, 1))})

        self.rows = cut(rows.mapInPandas(place, "id long, v array<double>, cell int, turn double"))
        #: A row a cell: how many rows it has, and the largest angle of one to its middle.
        self.cells = self.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("turn").alias("radius")).collect()

    def _lots(self) -> np.ndarray:
        """The lot of each cell: cells near each other, of about JOIN_BLOCK rows together."""
        size = np.zeros(len(self.middles), np.int64)
        for c in self.cells:
            size[c.cell] = c.n
        lot, n = np.full(len(size), -1), 0
        for first in range(len(size)):
            if lot[first] < 0:
                near = np.argsort(-(self.middles @ self.middles[first]), kind="stable")
                near = near[lot[near] < 0]
                near = np.concatenate([[first], near[near != first]])
                lot[near[: max(1, int(np.searchsorted(np.cumsum(size[near]), JOIN_BLOCK, "right")))]] = n
                n += 1
        return lot

    def _probes(self, queries: DataFrame, probes: int) -> DataFrame:
        """(id, v, cell): for each query the `probes` nearest cells that have rows."""
        middles, empty = self.middles, np.full(len(self.middles), True)
        empty[[c.cell for c in self.cells]] = False

        def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in _parts(frames, len(middles)):
                s = np.where(empty, -np.inf, _unit(f.v) @ middles.T)
                cell = np.argsort(-s, axis=1, kind="stable")[:, :probes]
                row, at = np.nonzero(np.isfinite(np.take_along_axis(s, cell, 1)))
                yield pd.DataFrame({"id": f.id.to_numpy()[row], "v": f.v.to_numpy()[row], "cell": cell[row, at].astype(np.int32)})

        return queries.mapInPandas(find, "id long, v array<double>, cell int")

    def _reached(self, queries: DataFrame, lot: np.ndarray) -> DataFrame:
        """(id, v, cell): for each query (id, v, reach) the lots with a cell that its reach, an angle, doesn't rule out."""
        middles, radius = self.middles, np.full(len(self.middles), -np.inf)
        for c in self.cells:
            radius[c.cell] = c.radius
        order = np.argsort(lot, kind="stable")
        starts = np.searchsorted(lot[order], np.arange(lot.max() + 1))

        def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in _parts(frames, len(middles)):
                turn = np.arccos(np.clip(_unit(f.v) @ middles.T, -1, 1))
                near = turn - radius[None, :] <= f.reach.to_numpy()[:, None] + 1e-6
                row, at = np.nonzero(np.logical_or.reduceat(near[:, order], starts, axis=1))
                yield pd.DataFrame({"id": f.id.to_numpy()[row], "v": f.v.to_numpy()[row], "cell": at.astype(np.int32)})

        return queries.mapInPandas(find, "id long, v array<double>, cell int")

    def _meet(self, asked: DataFrame, k: int, same: bool, lot: np.ndarray | None = None) -> DataFrame:
        """(query_id, id, similarity): the k nearest in the cells, or lots of cells, asked for (id, v, cell), for each block of one."""
        rows, block, size = self.rows, BLOCK, {c.cell: c.n for c in self.cells}
        if lot is not None:
            place = F.broadcast(self.spark.createDataFrame([(c.cell, int(lot[c.cell])) for c in self.cells], "cell int, lot int"))  # a row a cell
            rows, block, size = rows.join(place, "cell").select("id", "v", F.col("lot").alias("cell")), JOIN_BLOCK, {}
            for c in self.cells:
                size[int(lot[c.cell])] = size.get(int(lot[c.cell]), 0) + c.n
        sizes = F.broadcast(self.spark.createDataFrame([(c, -(-n // block)) for c, n in size.items()], "cell int, blocks long"))  # a row a cell
        many = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("asking"))
        deal = lambda df, own, other: df.select("id", "v", "cell", F.pmod(F.xxhash64("id"), F.col(own)).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(other))
        left = deal(asked.join(sizes, "cell").join(F.broadcast(many), "cell"), "asking", "blocks").select("cell", "asking", "blocks", "id", "v")  # many: a row a cell
        right = deal(rows.join(sizes, "cell").join(F.broadcast(many), "cell"), "blocks", "asking").select("cell", "asking", "blocks", "id", "v")
        by = ["cell", "asking", "blocks"]
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(lambda q, r: nearest_of(q, r, k, same), "query_id long, id long, similarity double")

    def nearest(self, queries: DataFrame, k: int, probes: int = 8, exact: bool = False, same: bool = True) -> DataFrame:
        """(query_id, id, similarity): the k nearest rows to each query (id, v), ties by id; same: ids name the same things, and a row isn't its own neighbour.

        A query without a vector has none. exact: all cells that can hold a row as near as the k-th found are looked into, in lots.
        """
        queries = queries.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).where("v is not null")
        best = lambda df: top(df, ["query_id"], [F.desc(F.round("similarity", 12)), F.asc("id")], k).drop("rank")
        if not self.cells:
            return self.spark.createDataFrame([], "query_id long, id long, similarity double")
        found = best(self._meet(self._probes(queries, probes), k, same))
        if not exact:
            return found
        found = cut(found)
        kth = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("s"))
        reach = F.when(F.col("n") == k, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "s")))).otherwise(F.lit(10.0))
        more = queries.join(kth, F.col("id") == F.col("query_id"), "left").select("id", "v", F.coalesce(reach, F.lit(10.0)).alias("reach"))
        lot = self._lots()
        return best(self._meet(self._reached(more, lot), k, same, lot))


def _parts(frames: Iterator[pd.DataFrame], cells: int) -> Iterator[pd.DataFrame]:
    """Frames in parts whose table of rows and cells is bounded."""
    step = max(1, CELLS // 4 // max(1, cells))
    for f in frames:
        for low in range(0, len(f), step):
            yield f.iloc[low : low + step]


def neighbours_for(n: int, most: int | None = None) -> int:
    """How many neighbours a node of a graph of n nodes is given: fewer in larger graphs."""
    k = next((k for limit, k in ((100, 20), (500, 15), (2000, 10)) if n < limit), 5)
    return k if most is None else min(k, most)


def sampled(rows: DataFrame, rate: float) -> Column:
    """Whether a row (id, ...) is among about `rate` of all by a hash of its id; the one of the least hash always is."""
    code = F.md5(F.col("id").cast("string"))
    least = rows.agg(F.min(code)).first()[0] or ""
    return (code < f"{int(min(1.0, rate) * 0xFFFFFFFF):08x}") | (code == least)


def sampled_graph(rows: DataFrame, rate: float, most: int, least: float = 0.5, upto: float = 0.9, near: int = 4, factor: float = 0.8) -> DataFrame:
    """(a, b, confidence) of nodes (id, v): edges of similarity least to upto between neighbours among the sampled nodes, from the smaller id,
    and for each other node those of the first sampled one among its `near` nearest, at less confidence."""
    chosen = sampled(rows, rate)
    inside = cut(rows.where(chosen))
    pairs = CellIndex(inside).nearest(inside, most, exact=True)
    edges = cut(pairs.where((F.col("query_id") < F.col("id")) & F.col("similarity").between(least, upto)).select(F.col("query_id").alias("a"), F.col("id").alias("b"), F.col("similarity").alias("confidence")))
    around = CellIndex(rows).nearest(rows.where(~chosen), near, exact=True)
    first = around.join(inside.select("id"), "id", "left_semi").groupBy("query_id").agg(F.min_by("id", F.struct(-F.round("similarity", 12), "id")).alias("id"))
    copies = first.join(edges, F.col("id") == F.col("a")).select(F.col("query_id").alias("a"), "b", (F.col("confidence") * factor).alias("confidence")).where("a <> b")
    return edges.unionByName(copies)


def _dots(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    return q @ r.T


def linked(vectors: DataFrame, threshold: float = 0.8, linkage: str = "average", by: str | None = None) -> DataFrame:
    """(id, cluster): the vectors (id, v) merged as long as two clusters are as alike as `threshold`, within the values of the column `by` if one is named.

    average: the mean cosine of their pairs; complete: the least; single: the largest; ward: what a merge adds to the squared distances
    to the middles, as 1 - half its root. Each round merges all clusters that are each other's nearest, which gives what
    merging one nearest pair at a time gives, ties aside. A cluster is named by its smallest id. No cluster or vocabulary goes through
    one task: nearest clusters are found by blocks of their middles, each block giving a cluster's nearest alone, or among the pairs over the
    threshold; what is left of a group is merged in a task once it has at most IN_TASK clusters that can merge. Single linkage takes links
    enough to join a cluster, and not all its pairs.
    """
    if linkage == "single":
        return _linked_single(vectors, threshold, by)
    unit = cut(vectors.select(F.col("id").cast("long").alias("id"), _unit_column(F.col("v")).alias("v"), (F.col(by) if by else F.lit(0)).cast("string").alias("g")))
    label = unit.select("id", F.col("id").alias("cluster"))
    best = lambda near: near.groupBy("id").agg(F.min_by("other", F.struct(-F.round("s", 12), "other")).alias("other"))
    mutual = lambda first: cut(first.join(first.select(F.col("id").alias("other"), F.col("other").alias("id")), ["id", "other"]).where("id < other").select(F.col("other").alias("was"), F.col("id").alias("now")))
    moved = lambda label, into: cut(label.join(into, F.col("cluster") == F.col("was"), "left").select("id", F.coalesce("now", "cluster").alias("cluster")))
    if linkage in ("average", "ward"):
        return _linked_middles(unit, threshold, linkage, best, mutual, moved)
    if linkage not in ("single", "complete"):
        raise ValueError("linkage is single, complete, average or ward")
    pairs = _pairs(unit, threshold)
    while True:
        near = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "s").unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other"), "s"))
        into = mutual(cut(best(near)))
        if into.isEmpty():
            return label
        label = moved(label, into)
        # two clusters stay a pair if each half is one with each half, at the least of these
        size = into.select(F.col("now").alias("id"), F.lit(2).alias("halves"))
        for side in ("a", "b"):
            pairs = pairs.join(into, F.col(side) == F.col("was"), "left").withColumn(side, F.coalesce("now", side)).drop("was", "now")
        pairs = pairs.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("s").alias("s"), F.count(F.lit(1)).alias("n"))
        halves = lambda side: size.select(F.col("id").alias(side), F.col("halves").alias(f"h{side}"))
        full = F.coalesce("ha", F.lit(1)) * F.coalesce("hb", F.lit(1))
        pairs = cut(pairs.join(halves("a"), "a", "left").join(halves("b"), "b", "left").where(F.col("n") == full).select("a", "b", "s"))


def _linked_single(vectors: DataFrame, least: float, by: str | None) -> DataFrame:
    """linked() by the nearest pair. Rows are dealt into blocks and each two blocks meet in a task, which gives a forest of its links; pairs of blocks go in strips of
    about COPIES rows, so what is shuffled at a time doesn't grow with the square of the table."""
    from .graph import components

    rows = cut(vectors.select(F.col("id").cast("long").alias("id"), "v", (F.col(by) if by else F.lit(0)).cast("string").alias("g")))
    n = rows.count()
    blocks = max(1, -(-n // JOIN_BLOCK))
    at, wide, links = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), max(1, COPIES // max(1, n)), []
    for low in range(0, blocks, wide):
        other = F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: F.least(k, "at").between(low, low + wide - 1))
        dealt = rows.where("v is not null").withColumn("at", at).select("id", "v", "g", "at", F.explode(other).alias("k")).select("id", "v", "g", "at", F.least("at", "k").alias("i"), F.greatest("at", "k").alias("j"))
        links.append(cut(dealt.groupBy("i", "j").applyInPandas(lambda f: forest(f, least), "a long, b long")))
        free(rows.sparkSession)
    return components(rows.select(F.col("id").alias("node")), reduce(DataFrame.unionAll, links)).select(F.col("node").alias("id"), F.col("component").alias("cluster"))


def forest(f: pd.DataFrame, least: float) -> pd.DataFrame:
    """(a, b): links between the rows (id, v, g, at) of two blocks, or of one, that join all that chains of pairs of cosine `least` within a g join, and no more than do that."""
    f = f.sort_values("at", kind="stable")
    ids, m, g, place = f.id.to_numpy(), _unit(f.v), pd.factorize(f.g)[0], f["at"].to_numpy()
    start = int(np.searchsorted(place, place[0], "right")) % len(f)  # where the second block begins; one block meets itself
    small, margin = m.astype(np.float32), (m.shape[1] + 8) * float(np.finfo(np.float32).eps)
    label, found, step = np.arange(len(f)), [np.empty((0, 2), np.int64)], max(1, CELLS // (len(f) - start))
    for low in range(0, start or len(f), step):
        stop = min(low + step, start or len(f))
        row, col = np.nonzero(small[low:stop] @ small[start:].T >= least - margin)
        row, col = row + low, col + start
        near = (label[row] != label[col]) & (g[row] == g[col])  # short numbers leave few out; of the others digits decide
        row, col = row[near], col[near]
        for k in range(0, len(row), BLOCK):
            x, y = row[k : k + BLOCK], col[k : k + BLOCK]
            close = np.round((m[x] * m[y]).sum(axis=1), 12) >= least
            x, y = x[close], y[close]
            while True:
                apart = label[x] != label[y]
                if not apart.any():
                    break
                x, y = x[apart], y[apart]
                high, first = np.unique(np.maximum(label[x], label[y]), return_index=True)
                found.append(np.column_stack([ids[x[first]], ids[y[first]]]))
                into = np.arange(len(f))
                into[high] = np.minimum(label[x], label[y])[first]
                while (into[into] != into).any():
                    into = into[into]
                label = into[label]
    return pd.DataFrame(np.concatenate(found), columns=["a", "b"])


def _linked_middles(unit: DataFrame, threshold: float, linkage: str, best, mutual, moved) -> DataFrame:
    """linked() by middles. A merged cluster is to no other one more alike than the more alike of its halves, so a cluster's nearest stays until it is merged, and a
    cluster that has none over the threshold gets none: only clusters that were merged, or whose nearest was, are asked again."""
    # equal vectors come first, in one step: in rounds a pair a round would merge of a group of them
    copies = (F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x) > 0) if threshold <= 1 else F.lit(False)
    own = unit.withColumn("key", F.when(copies, F.lit(-1).cast("long")).otherwise(F.col("id")))
    state = cut(own.groupBy("g", "v", "key").agg(F.min("id").alias("id"), F.count(F.lit(1)).cast("double").alias("n")).select("id", "v", "g", "n"))
    label = cut(own.join(own.groupBy("g", "v", "key").agg(F.min("id").alias("cluster")), ["g", "v", "key"]).select("id", "cluster"))
    asked, first, whole = state, None, True
    while True:
        count = cut(state.groupBy("g").agg(F.count(F.lit(1)).alias("rows")))
        if not count.where(F.col("rows") <= IN_TASK).isEmpty():  # what is left of these groups is merged in a task each
            small = state.join(count.where(F.col("rows") <= IN_TASK).select("g"), "g", "left_semi").select("id", "v", "g", "n")
            label = moved(label, cut(small.groupBy("g").applyInPandas(lambda f: merged_of(f, threshold, linkage), "was long, now long")))
            large = count.where(F.col("rows") > IN_TASK).select("g")
            state, asked = cut(state.join(large, "g", "left_semi").select("id", "v", "g", "n")), cut(asked.join(large, "g", "left_semi").select("id", "v", "g", "n"))
            first = first if first is None else cut(first.join(state.select("id"), "id", "left_semi"))
        if state.isEmpty():
            return label
        found = best(_nearest_clusters(asked, state, threshold, linkage))
        first = cut(found if first is None else found.unionByName(first))
        into = mutual(first)
        if into.isEmpty():
            if whole:
                return label
            asked, first, whole = state, None, True  # nearly equal likenesses can leave a ring: all are asked once more
            continue
        label = moved(label, into)
        merged = cut(state.join(first.select("id"), "id", "left_semi").join(into, F.col("id") == F.col("was"), "left").withColumn("id", F.coalesce("now", "id")).drop("was", "now"))
        weighted = F.transform("v", lambda x: x * F.col("n"))
        both = merged.groupBy("id").agg(F.first("g").alias("g"), F.sum("n").alias("size"), F.collect_list(weighted).alias("parts"))  # one or two
        summed = F.aggregate(F.slice("parts", 2, 1), F.get("parts", F.lit(0)), lambda s, x: F.zip_with(s, x, lambda p, q: p + q))
        state = cut(both.select("id", F.transform(summed, lambda x: x / F.col("size")).alias("v"), "g", F.col("size").alias("n")))
        gone = into.select(F.explode(F.array("was", "now")).alias("x"))
        first = cut(first.join(gone, F.col("id") == F.col("x"), "left_anti").join(gone, F.col("other") == F.col("x"), "left_anti").select("id", "other"))
        asked, whole = cut(state.join(first, "id", "left_anti").select("id", "v", "g", "n")), False


def merged_of(f: pd.DataFrame, least: float, linkage: str) -> pd.DataFrame:
    """(was, now): the clusters (id, v, n) of one group that end in another, merged a pair at a time."""
    f = f.sort_values("id")
    score, ids, n, m = _dots if linkage == "average" else _ward, f.id.to_numpy(), f.n.to_numpy(float), np.stack(f.v.to_numpy()).astype(float)
    wide = lambda at: m[at] if linkage == "average" else np.column_stack([m[at], n[at]])
    every, into, alive = np.arange(len(ids)), np.arange(len(ids)), np.ones(len(ids), bool)
    s = np.concatenate([np.round(score(wide(every[k : k + 512]), wide(every)), 12) for k in range(0, len(ids), 512)])
    s[every, every] = -np.inf
    near = s.argmax(axis=1)  # the first of equal ones, by id
    far = s[every, near]
    while far.max() >= least:
        i = int(far.argmax())
        a, b = sorted((i, int(near[i])))
        m[a], n[a], into[b], alive[b] = (m[a] * n[a] + m[b] * n[b]) / (n[a] + n[b]), n[a] + n[b], a, False
        row = np.where(alive, np.round(score(wide(every[a : a + 1]), wide(every))[0], 12), -np.inf)
        row[a] = -np.inf
        s[b], s[:, b], s[a], s[:, a] = -np.inf, -np.inf, row, row
        again = alive & ((near == a) | (near == b))
        again[a] = True
        near[again] = s[again].argmax(axis=1)
        closer = alive & ~again & ((row > far) | (row == far) & (a < near))
        near[closer] = a
        far = np.where(alive, s[every, near], -np.inf)
    for k in every:  # a cluster goes into an earlier one
        into[k] = into[into[k]]
    return pd.DataFrame({"was": ids[~alive], "now": ids[into[~alive]]})


def _unit_column(v: Column) -> Column:
    v = v.cast("array<double>")
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: F.when(size > 0, x / size).otherwise(x))


def _pairs(unit: DataFrame, least: float) -> DataFrame:
    """(a, b, s): pairs within a group that are as alike as `least`."""
    found = close_pairs(unit, least).where("query_id < id")
    of = lambda side, name: unit.select(F.col("id").alias(side), F.col("g").alias(name))
    both = found.select(F.col("query_id").alias("a"), F.col("id").alias("b"), F.col("similarity").alias("s"))
    return cut(both.join(of("a", "ga"), "a").join(of("b", "gb"), "b").where("ga = gb").select("a", "b", "s"))


def _ward(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    a, b, na, nb = q[:, :-1], r[:, :-1], q[:, -1][:, None], r[:, -1][None, :]
    apart = np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)
    return 1 - np.sqrt(2 * na * nb / (na + nb) * apart) / 2


def best_of(q: pd.DataFrame, r: pd.DataFrame, score, least: float) -> pd.DataFrame:
    """(id, other, s): for each row of the block q (id, v) the row of the block r of the best score, of equal ones (by 12 digits) the smallest id, if it is `least` or more."""
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    if len(q) and len(r):
        r = r.sort_values("id")
        mine, theirs, qid, rid = np.stack(q.v.to_numpy()).astype(float), np.stack(r.v.to_numpy()).astype(float), q.id.to_numpy(), r.id.to_numpy()
        step = max(1, CELLS // len(r))
        for low in range(0, len(q), step):
            s = score(mine[low : low + step], theirs)
            s[rid[None, :] == qid[low : low + step, None]] = -np.inf
            row, col = np.nonzero((s >= s.max(axis=1)[:, None] - 2e-12) & (s >= least - 1e-11))
            value = np.round(s[row, col], 12)
            order = np.lexsort((rid[col], -value, row))
            order = order[value[order] >= least]
            row, at = np.unique(row[order], return_index=True)
            found.append((qid[low + row], rid[col[order[at]]], value[order[at]]))
    return pd.DataFrame(dict(zip(("id", "other", "s"), map(np.concatenate, zip(*found)))))


def _nearest_clusters(asked: DataFrame, state: DataFrame, least: float, linkage: str) -> DataFrame:
    """(id, other, s): for each asked cluster (id, v, g, n) the most alike of each block of its group's, if it is as alike as `least`."""
    score = _dots if linkage == "average" else _ward
    v = F.col("v") if linkage == "average" else F.concat("v", F.array("n"))  # n comes along as one more dimension
    blocks = lambda df, name: df.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias(name))
    sizes = cut(blocks(asked, "qs").join(blocks(state, "rs"), "g"))
    deal = lambda df, own, other, of, across: df.select(F.col("id").alias("id"), v.alias("v"), F.col("g").alias("g")).join(sizes, "g").select("id", "v", "g", F.pmod(F.xxhash64("id"), F.col(of)).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.col(across) - 1)).alias(other))
    by = ["g", "qb", "rb"]
    left, right = deal(asked, "qb", "rb", "qs", "rs").select("id", "v", *by), deal(state, "rb", "qb", "rs", "qs").select("id", "v", *by)
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(lambda q, r: best_of(q, r, score, least), "id long, other long, s double")


def cluster_facts(vectors: DataFrame, label: DataFrame, category: str | None = None, weight: str | None = None) -> DataFrame:
    """(cluster, size, confidence, centroid, categories, mean_weight): the mean cosine of a cluster's pairs (1 for a single one), the mean of its vectors,
    the distinct values of a column and the mean of another."""
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"), (F.col(category) if category else F.lit(None).cast("string")).alias("c"), (F.col(weight) if weight else F.lit(None).cast("double")).alias("w"))
    rows = cut(rows.join(label, "id").withColumn("u", _unit_column(F.col("v"))))
    flat = rows.select("cluster", F.posexplode(F.arrays_zip("v", "u")).alias("at", "x")).groupBy("cluster", "at").agg(F.avg("x.v").alias("mean"), F.sum("x.u").alias("total"))
    packed = flat.groupBy("cluster").agg(F.sum(F.col("total") * F.col("total")).alias("square"), F.array_sort(F.collect_list(F.struct("at", "mean"))).alias("m"))
    held = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.count_distinct("c").alias("categories"), F.avg("w").alias("mean_weight"))
    n = F.col("size")
    return held.join(packed, "cluster").select("cluster", "size", F.when(n > 1, (F.col("square") - n) / (n * (n - 1))).otherwise(1.0).alias("confidence"), F.col("m.mean").alias("centroid"), "categories", "mean_weight")
