"""Communities, distances and sketches on hand-made and random graphs, against plain loops."""

import math
import random
from collections import defaultdict

import pytest

from docfathom.operators import communities as C
from docfathom.operators.graph import betweenness


def frames(spark, n, edges):
    return spark.createDataFrame([(k,) for k in range(n)], "node long"), spark.createDataFrame(edges or [], "a long, b long, w double")


def quality(edges, of, resolution=1.0):
    m = sum(w for *_, w in edges)
    degree, inside = defaultdict(float), 0.0
    for a, b, w in edges:
        degree[of[a]] += w
        degree[of[b]] += w
        inside += w * (of[a] == of[b])
    return inside / m - resolution * sum((d / 2 / m) ** 2 for d in degree.values())


def greedy(n, edges):
    """Merges of the two communities that add most, one at a time."""
    of = {k: k for k in range(n)}
    while True:
        best, pair = quality(edges, of), None
        for a, b in sorted({tuple(sorted((of[a], of[b]))) for a, b, _ in edges if of[a] != of[b]}):
            now = quality(edges, {k: a if c == b else c for k, c in of.items()})
            if now > best + 1e-12:
                best, pair = now, (a, b)
        if pair is None:
            return of
        of = {k: pair[0] if c == pair[1] else c for k, c in of.items()}


def planted(seed, groups=4, size=6):
    r = random.Random(seed)
    n = groups * size
    return n, [(a, b, 1.0) for a in range(n) for b in range(a + 1, n) if r.random() < (0.7 if a // size == b // size else 0.06)]


@pytest.mark.parametrize("seed", range(2))
def test_louvain_is_at_least_greedy(spark, seed):
    n, edges = planted(seed)
    nodes, rows = frames(spark, n + 1, edges)  # one node alone
    of = {r.node: r.community for r in C.louvain(nodes, rows).collect()}
    assert len(of) == n + 1 and of[n] == n and all(of[c] == c and c <= k for k, c in of.items())
    assert quality(edges, of) >= quality(edges, greedy(n, edges)) - 1e-9


def test_louvain_weights_resolution_and_odd_edges(spark):
    cliques = [(a, b, 1.0) for base in (0, 5) for a in range(base, base + 5) for b in range(a + 1, base + 5)] + [(4, 5, 1.0)]
    nodes, rows = frames(spark, 10, cliques + [(3, 3, 1.0), (None, 2, 1.0)])
    of = {r.node: r.community for r in C.louvain(nodes, rows).collect()}
    assert of == {k: 0 if k < 5 else 5 for k in range(10)}
    path = [(0, 1, 9.0), (1, 2, 0.0), (2, 3, 9.0)]
    nodes, rows = frames(spark, 4, path)
    of = {r.node: r.community for r in C.louvain(nodes, rows, rows.w).collect()}
    assert of == {0: 0, 1: 0, 2: 2, 3: 2}
    assert {r.community for r in C.louvain(nodes, rows, resolution=0.01).collect()} == {0}
    nodes, rows = frames(spark, 3, [])
    assert sorted(map(tuple, C.louvain(nodes, rows).collect())) == [(0, 0), (1, 1), (2, 2)]


def reach(n, edges):
    near = defaultdict(set)
    for a, b, _ in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    pairs = defaultdict(int)
    for s in range(n):
        seen, front, step = {s}, {s}, 0
        while front:
            front = {v for u in front for v in near[u]} - seen
            seen |= front
            step += 1
            if front:
                pairs[step] += len(front)
    return dict(pairs)


def test_distances(spark, monkeypatch):
    monkeypatch.setattr(C, "WORDS", 1)  # several blocks of sources
    r = random.Random(3)
    n = 90
    edges = [(r.randrange(n), r.randrange(n), 1.0) for _ in range(110)] + [(0, 0, 1.0), (1, 2, 1.0), (2, 1, 1.0)]
    nodes, rows = frames(spark, n, edges)
    want = reach(n, edges)
    assert {x.distance: x.pairs for x in C.distances(nodes, rows).collect()} == want
    near = {x.distance: x.pairs for x in C.sketched_distances(nodes, rows).collect()}
    assert near.keys() == want.keys() and all(math.isclose(near[k], want[k], rel_tol=0.05, abs_tol=6) for k in want)


def test_path_metrics(spark):
    path = [(k, k + 1, 1.0) for k in range(4)] + [(7, 8, 1.0)]
    nodes, rows = frames(spark, 9, path)
    got = C.path_metrics(nodes, rows).first()
    assert (got.nodes, got.diameter) == (5, 4) and math.isclose(got.mean_path, 2.0)
    near = C.path_metrics(nodes, rows, exact_nodes=2).first()
    assert near.diameter == 4 and abs(near.mean_path - 2.0) < 0.2
    nodes, rows = frames(spark, 1, [])
    got = C.path_metrics(nodes, rows).first()
    assert got.diameter is None and got.mean_path is None and got.nodes == 1


def test_distances_write_no_table_a_step(spark, monkeypatch):
    """Two paths and a lone node, without a table for each step of each block of sources."""
    monkeypatch.setattr(C, "WORDS", 1)
    made = []
    monkeypatch.setattr(C, "cut", lambda df: made.append(df) or df)
    nodes = spark.range(200).selectExpr("id as node")
    edges = nodes.where("node < 198 and node <> 98").selectExpr("node as a", "node + 1 as b")
    got = {r.distance: r.pairs for r in C.distances(nodes, edges).collect()}
    assert got == {d: 2 * (max(0, 99 - d) + max(0, 100 - d)) for d in range(1, 100)} and len(made) <= 3


def test_betweenness_of_several_components(spark):
    """A star, a path and a cycle; what one source leaves doesn't reach the next."""
    edges = [(0, k) for k in range(1, 6)] + [(10, 11), (11, 12), (12, 13)] + [(20, 21), (21, 22), (22, 23), (23, 20)]
    nodes = spark.createDataFrame([(k,) for k in [*range(6), *range(10, 14), *range(20, 24), 30]], "node long")
    got = {r.node: round(r.betweenness * 14 * 13, 9) for r in betweenness(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {k: v for k, v in got.items() if v} == {0: 20, 11: 4, 12: 4, 20: 1, 21: 1, 22: 1, 23: 1} and len(got) == 15


def test_turns_broadcast_nothing(spark):
    """tables of nodes would go through the driver in each turn of each level."""
    links = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (2, 3, 1.0), (3, 2, 1.0)], "u long, v long, w double")
    label = spark.createDataFrame([(1, 1, 1.0), (2, 2, 2.0), (3, 3, 1.0)], "node long, c long, k double")
    plan = C._moves(C.cut(links), C.cut(label), 4.0, 1.0, 0)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_sources_of_small_components_go_together(spark, monkeypatch):
    """against plain counting of paths; values of one node are left out before the join."""
    import numpy as np
    from docfathom.operators import graph as G

    r = np.random.default_rng(2)
    ends = np.concatenate([low + r.integers(0, n, (2, 2 * n)) for low, n in ((0, 9), (9, 30), (39, 6), (45, 2))], axis=1)
    ends = np.unique(np.sort(ends[:, ends[0] != ends[1]], axis=0), axis=1)
    names, ends = np.unique(ends, return_inverse=True)
    ends, n = ends.reshape(2, -1), len(names)
    both = np.concatenate([ends, ends[::-1]], axis=1)
    both = both[:, np.argsort(both[0], kind="stable")]
    first, near = np.searchsorted(both[0], np.arange(n + 1)), both[1]
    dist, paths = np.full((n, n), np.inf), np.eye(n)
    np.fill_diagonal(dist, 0)
    for k in range(n):
        step = np.zeros((n, n))
        for u, v in zip(*both, strict=True):
            step[:, v] += np.where(dist[:, u] == k, paths[:, u], 0)
        new = (step > 0) & np.isinf(dist)
        dist[new], paths[new] = k + 1, step[new]
    want = np.zeros(n)
    for s in range(n):
        for t in range(n):
            if s != t and np.isfinite(dist[s, t]):
                on = (dist[s] + dist[:, t] == dist[s, t]) & (np.arange(n) != s) & (np.arange(n) != t)
                want[on] += paths[s, on] * paths[on, t] / paths[s, t]
    calls, repeat = [], np.repeat
    monkeypatch.setattr(G.np, "repeat", lambda *a: calls.append(1) or repeat(*a))
    for together in (1, 20, 1 << 16):
        monkeypatch.setattr(G, "TOGETHER", together)
        calls.clear()
        assert np.allclose(G.dependencies(np.arange(n), first, near), want)
    assert len(calls) < 3 * n  # all at once
    monkeypatch.undo()
    cuts, cut = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df: cuts.append(cut(df)) or cuts[-1])
    rows = spark.createDataFrame([(1, 7), (2, 7), (2, 7), (3, 8), (4, 9), (None, 8)], "node long, value long")
    assert [tuple(e) for e in G.shared_value_edges(rows).collect()] == [(1, 2, 1)] and [x.value for x in cuts[1].collect()] == [7]
