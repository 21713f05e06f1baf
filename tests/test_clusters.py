"""Nearest neighbours by cells, sampled graphs and linkage against plain loops."""

import numpy as np
import pandas as pd
import pytest

from docfathom.operators import clusters as C


def vectors(spark, m, **more):
    rows = [(k, [float(x) for x in v], *(c[k] for c in more.values())) for k, v in enumerate(m)]
    return spark.createDataFrame(rows, ", ".join(["id long", "v array<double>", *[f"{c} {'double' if c == 'weight' else 'string'}" for c in more]]))


def unit(m):
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def grouped(seed, groups, size, dims, spread):
    r = np.random.default_rng(seed)
    return np.concatenate([r.normal(size=dims) + spread * r.normal(size=(size, dims)) for _ in range(groups)])


@pytest.fixture(scope="module")
def many(spark):
    m = grouped(1, 40, 50, 16, 0.6)
    s = np.round(unit(m) @ unit(m).T, 12)
    np.fill_diagonal(s, -np.inf)
    want = {q: np.lexsort((np.arange(len(m)), -s[q]))[:10].tolist() for q in range(0, len(m), 20)}
    rows = vectors(spark, m).checkpoint()
    return rows, want, C.CellIndex(rows, cells=32, sample=500)


def test_exact_search_sends_a_query_to_a_lot_once(many):
    """However many cells are within reach, no query has a row for each of them."""
    rows, want, index = many
    lot = index._lots()
    asked = index._reached(rows.where("id % 20 = 0").selectExpr("id", "v", "10.0D as reach"), lot)
    assert len(lot) > 1 and lot.max() == 0 and asked.count() == len(want)


def test_recall_and_exact_search(many, monkeypatch):
    rows, want, index = many
    got = {}
    for r in index.nearest(rows.where("id % 20 = 0"), 10, probes=6).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    assert sum(len(got[q] & set(w)) for q, w in want.items()) >= 0.9 * 10 * len(want)
    monkeypatch.setattr(C, "BLOCK", 16)  # cells of many blocks
    got = {}
    for r in sorted(index.nearest(rows.where("id % 20 = 0"), 10, probes=1, exact=True).collect(), key=lambda r: (-round(r.similarity, 12), r.id)):
        got.setdefault(r.query_id, []).append(r.id)
    assert got == want


def test_odd_rows(spark):
    same = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(6)] + [(9, None), (8, [0.0, 0.0])], "id long, v array<double>")
    index = C.CellIndex(same)
    assert [r.id for r in index.nearest(same.where("id in (3, 9)"), 2, exact=True).collect()] == [0, 1]
    none = C.CellIndex(same.limit(0))
    assert none.nearest(same, 3, exact=True).count() == 0
    assert [C.neighbours_for(n) for n in (0, 99, 100, 499, 500, 1999, 2000)] == [20, 20, 15, 15, 10, 10, 5] and C.neighbours_for(50, 8) == 8


def plain_linkage(m, threshold, linkage):
    """The nearest two clusters are merged, one pair at a time."""
    u = unit(m)
    groups = [[k] for k in range(len(m))]

    def alike(a, b):
        s = u[a] @ u[b].T
        if linkage == "ward":
            d = u[a].mean(axis=0) - u[b].mean(axis=0)
            return 1 - np.sqrt(2 * len(a) * len(b) / (len(a) + len(b)) * (d @ d)) / 2
        return {"single": s.max(), "complete": s.min(), "average": s.mean()}[linkage]

    while len(groups) > 1:
        s, i, j = max((alike(a, b), -i, -j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if s < threshold:
            break
        groups[-i] = sorted(groups[-i] + groups[-j])
        groups.pop(-j)
    return {k: min(g) for g in groups for k in g}


@pytest.mark.parametrize("linkage,threshold", [("average", 0.6), ("complete", 0.5), ("single", 0.9), ("ward", 0.45)])
def test_linkage(spark, linkage, threshold):
    m = grouped(5, 6, 7, 8, 0.5)
    want = plain_linkage(m, threshold, linkage)
    got = {r.id: r.cluster for r in C.linked(vectors(spark, m), threshold, linkage).collect()}
    assert got == want and 1 < len(set(want.values())) < len(m)


def test_linkage_within_groups_and_facts(spark):
    m = grouped(6, 3, 6, 8, 0.3)
    kinds = ["x" if k % 2 else "y" for k in range(len(m))]
    rows = vectors(spark, m, kind=kinds, weight=[float(k) for k in range(len(m))])
    got = {r.id: r.cluster for r in C.linked(rows, 0.7, "average", "kind").collect()}
    want = {}
    for kind in "xy":
        own = [k for k in range(len(m)) if kinds[k] == kind]
        want |= {own[k]: own[c] for k, c in plain_linkage(m[own], 0.7, "average").items()}
    assert got == want
    label = spark.createDataFrame(sorted(got.items()), "id long, cluster long")
    for f in C.cluster_facts(rows, label, "kind", "weight").collect():
        own = [k for k, c in got.items() if c == f.cluster]
        s = unit(m[own]) @ unit(m[own]).T
        pairs = s[~np.eye(len(own), dtype=bool)]
        assert f.size == len(own) and f.categories == 1 and np.isclose(f.mean_weight, np.mean(own)) and np.allclose(f.centroid, m[own].mean(axis=0))
        assert np.isclose(f.confidence, pairs.mean() if len(own) > 1 else 1.0)
    with pytest.raises(ValueError, match="linkage"):
        C.linked(rows, 0.5, "median")


def test_linkage_of_copies_takes_few_rounds(spark, monkeypatch):
    m = np.repeat(grouped(8, 2, 1, 8, 0.3), 20, axis=0)
    cuts, cut = [], C.cut
    monkeypatch.setattr(C, "cut", lambda df: cuts.append(1) or cut(df))
    got = {r.id: r.cluster for r in C.linked(vectors(spark, m), 0.9, "average").collect()}
    assert got == plain_linkage(m, 0.9, "average") and len(cuts) < 40


def test_a_block_gives_the_nearest_alone():
    m = unit(grouped(9, 2, 30, 8, 0.1))
    rows = pd.DataFrame({"id": np.arange(len(m)), "v": list(m)})
    found = C.best_of(rows, rows, C._dots, 0.5)
    s = m @ m.T - 2 * np.eye(len(m))
    assert found.id.tolist() == list(range(len(m))) and found.other.tolist() == s.argmax(axis=1).tolist()


@pytest.mark.parametrize("linkage,threshold", [("average", 0.6), ("ward", 0.45)])
def test_linkage_in_rounds_ends_as_in_a_task(spark, monkeypatch, linkage, threshold):
    m = grouped(5, 6, 7, 8, 0.5)
    monkeypatch.setattr(C, "IN_TASK", 4)
    got = {r.id: r.cluster for r in C.linked(vectors(spark, m), threshold, linkage).collect()}
    assert got == plain_linkage(m, threshold, linkage)


def test_single_linkage_in_strips_of_blocks(spark, monkeypatch):
    """blocks meet in strips of a bounded number of copies, within groups, and give forests, not all pairs."""
    m = grouped(7, 8, 9, 8, 0.4)
    kinds = ["x" if k % 3 else "y" for k in range(len(m))]
    monkeypatch.setattr(C, "JOIN_BLOCK", 16)
    monkeypatch.setattr(C, "COPIES", 2 * len(m))
    cuts, cut = [], C.cut
    monkeypatch.setattr(C, "cut", lambda df: cuts.append(1) or cut(df))
    rows = vectors(spark, m, kind=kinds)
    assert {r.id: r.cluster for r in C.linked(rows, 0.9, "single").collect()} == plain_linkage(m, 0.9, "single")
    assert len(cuts) == 1 + 3  # 5 blocks, two at a time
    want = {}
    for kind in "xy":
        own = [k for k in range(len(m)) if kinds[k] == kind]
        want |= {own[k]: own[c] for k, c in plain_linkage(m[own], 0.9, "single").items()}
    assert {r.id: r.cluster for r in C.linked(rows, 0.9, "single", "kind").collect()} == want
    nobody = spark.createDataFrame([(1, None), (2, [1.0, 0.0]), (3, [1.0, 0.0])], "id long, v array<double>")
    assert {r.id: r.cluster for r in C.linked(nobody, 0.9, "single").collect()} == {1: 1, 2: 2, 3: 2}


def test_a_forest_of_copies_is_small():
    m = np.repeat(grouped(3, 3, 1, 8, 0.1), 60, axis=0)
    for at in (np.zeros(180, int), np.arange(180) % 2):
        found = C.forest(pd.DataFrame({"id": np.arange(180), "v": list(m), "g": "0", "at": at}), 0.99)
        assert len(found) == 180 - 3
